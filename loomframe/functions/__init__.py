"""Constructors of expressions."""

from __future__ import annotations

import builtins
from collections.abc import Callable
from typing import Any

from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomframe import types as LT
from loomframe.errors import InvalidArgumentError
from loomframe.functions.expr import Expr, as_expr, column, literal, named, selector
from loomframe.functions.spec import ROW

__all__ = ["all", "coalesce", "col", "duration", "element", "exclude", "implode", "lit", "seq_range", "struct", "when"]
_all, any_ = builtins.all, builtins.any


def _visible(schema: T.StructType) -> list[T.StructField]:
    return [f for f in schema.fields if not f.name.startswith(ROW)]


def col(name: Any) -> Expr:
    """A column by name; or every column of a list of names, of a type, or of a list of types."""
    if isinstance(name, str):
        return column(name)
    many = list(name) if isinstance(name, (list, tuple)) else [name]
    if _all(isinstance(n, str) for n in many):
        return selector(lambda schema: many)
    kinds = [LT.as_type(k) for k in many]
    return selector(lambda schema: [f.name for f in _visible(schema) if any_(k.matches(f.dataType) for k in kinds)])


def all() -> Expr:  # noqa: A001
    """Every column."""
    return selector(lambda schema: [f.name for f in _visible(schema)])


def exclude(columns: Any) -> Expr:
    """Every column but these."""
    gone = {columns} if isinstance(columns, str) else set(columns)
    return selector(lambda schema: [f.name for f in _visible(schema) if f.name not in gone])


def lit(value: Any, *, dtype: Any = None, name: str | None = None) -> Expr:
    e = as_expr(value)._with(name=name or "literal")
    return e if dtype is None else e.cast(dtype).alias(name or "literal")


def element() -> Expr:
    """The element at hand, inside arr.eval, arr.agg and arr.filter."""
    return Expr(None, kind="element", name="element")


def coalesce(*exprs: Any) -> Expr:
    """The first that is not null; text names columns, and a column that is missing counts as null."""
    flat = [e for x in exprs for e in (x if isinstance(x, (list, tuple)) else [x])]
    if not flat:
        raise InvalidArgumentError("coalesce takes an expression or more")

    def maybe(name: str) -> Expr:
        return Expr(lambda ctx: F.col(f"`{name}`") if name in ctx.df.columns else F.lit(None), name=name, extra=("col", name))

    args = [maybe(e) if isinstance(e, str) else as_expr(e) for e in flat]
    return Expr(lambda ctx, *c: F.coalesce(*c), args, name=args[0].name)


class When(Expr):
    """A chain of conditions; without otherwise() null where none holds."""

    def __init__(self, cases: list[tuple[Expr, Expr]], default: Expr | None = None):
        self.cases, self.default = cases, default
        flat = [e for pair in cases for e in pair] + ([default] if default is not None else [])

        def build(ctx, *c):
            out = F
            for i in range(0, 2 * len(cases), 2):
                test = c[i] if isinstance(ctx.type(c[i]), T.BooleanType) else F.lit(False)
                out = out.when(test, c[i + 1])
            return out.otherwise(c[-1]) if default is not None else out

        super().__init__(build, flat, name=cases[0][1].name if cases else "literal")

    def when(self, *conditions: Any) -> Then:
        return Then(self.cases, _both(conditions))

    def otherwise(self, value: Any) -> Expr:
        return When(self.cases, _value(value))._plain()

    def _plain(self) -> Expr:
        return Expr(self.build, self.args, name=self._name)

    def _with(self, **changes: Any) -> Expr:
        return self._plain()._with(**changes)


class Then:
    def __init__(self, cases: list, condition: Expr):
        self.cases, self.condition = cases, condition

    def then(self, value: Any) -> When:
        return When([*self.cases, (self.condition, _value(value))])


def _both(conditions: tuple) -> Expr:
    out = named(conditions[0])
    for c in conditions[1:]:
        out = out.and_(named(c))
    return out


def _value(v: Any) -> Expr:
    """Text is the column of that name where there is one, else itself."""
    if isinstance(v, str):
        return Expr(lambda ctx: F.col(f"`{v}`") if v in ctx.df.columns else F.lit(v), name=v)
    return as_expr(v)


def when(*conditions: Any) -> Then:
    return Then([], _both(conditions))


def struct(fields: Any) -> Expr:
    """A struct of name: column, or of a list of columns."""
    items = [(k, named(v)) for k, v in fields.items()] if isinstance(fields, dict) else [(e.name, e) for e in map(named, fields)]
    return Expr(lambda ctx, *c: F.struct(*[x.alias(k) for x, (k, _) in zip(c, items)]), [e for _, e in items], name="struct")


#: Milliseconds of each unit of duration().
PARTS = {"weeks": 604_800_000, "days": 86_400_000, "hours": 3_600_000, "minutes": 60_000, "seconds": 1000, "milliseconds": 1, "microseconds": 1e-3, "nanoseconds": 1e-6}


def duration(*, time_unit: str = "ms", **parts: Any) -> Expr:
    """The sum of its parts in a unit (ms, us or ns); text names columns; null if a part is."""
    if not parts or set(parts) - set(PARTS):
        raise InvalidArgumentError(f"duration takes some of {', '.join(PARTS)}")
    scale = {"ms": 1, "us": 1e3, "ns": 1e6}[time_unit]

    def build(ctx, *c):
        out = None
        for x, k in zip(c, parts):
            v = LT.number(x, ctx.type(x)) * (PARTS[k] * scale)
            out = v if out is None else out + v
        return out

    return Expr(build, [named(v) for v in parts.values()], name="duration")


def implode(column_: Any) -> Expr:
    """All values of a column as a list."""
    return named(column_).implode()


def seq_range(value: Any = 0, *, n: int | None = None, mode: str = "cumulative", step: Any = 1, strict: bool = True, pad: bool = False, truncate: bool = False, pad_value: Any = None, start_index: int | None = None, end_index: int | None = None, dtype: Any = None, name: str | None = None) -> Expr:
    """value, value + step... by row position. The frame checks n against its height when strict.

    mode constant: value in each row. A function as step gets {index, prev or initial_value}: such
    sequences are made on the driver for the frame's height, as each value hangs on the one before.
    """
    if mode not in ("constant", "cumulative", "independent"):
        raise InvalidArgumentError("mode is constant, cumulative or independent")
    spec = {"n": n, "strict": strict, "pad": pad, "truncate": truncate, "pad_value": pad_value, "start": start_index, "end": end_index}

    def build(ctx, parts, _):
        w = W.partitionBy(*parts).orderBy(ctx.order)
        at = F.row_number().over(w) - 1
        height = F.count(F.lit(1)).over(W.partitionBy(*parts))
        lo = _index(spec["start"], height, F.lit(0))
        hi = _index(spec["end"], height, height)
        width = F.greatest(F.lit(0), hi - lo)
        have = width if n is None else F.lit(n)
        i = at - lo
        if mode == "constant":
            v = F.lit(value)
        elif callable(step):
            v = _stepped(value, step, mode, ctx.df.count() if n is None else n, i)
        elif mode == "independent":
            v = F.lit(value) + at * F.lit(step)
        else:
            v = F.lit(value) + i * F.lit(step)
        if strict:
            wrong = F.raise_error(F.concat(F.lit("seq_range has another height than the frame: "), have.cast("string")))
            out = F.when(have == height, v).otherwise(wrong)
        else:
            short, long = have < width, have > width
            checks = F.when(short & F.lit(not pad), F.raise_error(F.lit("seq_range is shorter than its rows; pad it"))).when(long & F.lit(not truncate), F.raise_error(F.lit("seq_range is longer than its rows; truncate it")))
            out = checks.when((at >= lo) & (at < hi) & (i < have), v).otherwise(literal(pad_value))
        return LT.lenient(out, T.DoubleType() if isinstance(value, float) else T.LongType() if isinstance(value, int) else T.StringType(), LT.as_type(dtype)) if dtype is not None else out

    return Expr(build, [lit(value)], "win", name=name or "literal")


def _index(i: int | None, height, default):
    if i is None:
        return default
    return F.least(F.lit(i), height) if i >= 0 else F.greatest(F.lit(0), height + i)


def _stepped(value: Any, step: Callable, mode: str, n: int, i):
    out = []
    for k in range(n):
        out.append(step({"index": k, "initial_value": value}) if mode == "independent" else value if k == 0 else step({"index": k, "prev": out[-1]}))
    return F.get(literal(out), i.cast("int"))
