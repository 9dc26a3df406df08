"""How aggregates are described."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column

#: Hidden column that holds the order of rows, where a frame has one.
ROW = "__loomframe_row"


@dataclass(frozen=True)
class Aggregate:
    """How an aggregate is computed.

    simple(ctx, *columns): an aggregate Column. special(df, keys, columns, order, out): a frame of the keys and
    `out`, for aggregates that need more than one pass; keys, columns and out are names. windowed: whether
    `simple` may stand over a window. in_list(ctx, array): the value for a list's elements. ordered: needs row order.
    """

    simple: Callable | None = None
    special: Callable | None = None
    windowed: bool = True
    ordered: bool = False
    empty: Any = None


class Composite:
    """An aggregate that is a function of several aggregate Columns, so that each can be put over a window."""

    def __init__(self, fn: Callable, *parts: Column):
        self.fn, self.parts = fn, parts

    def over(self, w: Any) -> Column:
        return self.fn(*[p.over(w) for p in self.parts])

    def alias(self, name: str) -> Column:
        return self.fn(*self.parts).alias(name)
