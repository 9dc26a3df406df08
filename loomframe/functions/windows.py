"""Window functions. `over` gives the partition; rows stand in the frame's order; frames of rows are implied by the function."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomframe import types as LT
from loomframe.errors import InvalidArgumentError
from loomframe.functions.aggregates import kept, num, total


class Windows:
    def over(self, *columns: Any):
        """The last aggregate or window function of this expression, by partitions of the columns (names or expressions)."""
        from loomframe.functions.expr import named

        flat = [c for x in columns for c in (x if isinstance(x, (list, tuple)) else [x])]
        keys = tuple(named(c) for c in flat)

        def put(e):
            if e.kind in ("agg", "win"):
                return e._with(keys=keys)
            if not e.args:
                return e
            done = tuple(put(a) if a.has("agg", "win") and not (a.keys is not None) else a for a in e.args)
            return e._with(args=done)

        if not self.has("agg", "win"):
            raise InvalidArgumentError("over stands after an aggregate or a window function")
        return put(self)

    def _frame(self, fn, before, after):
        """fn(ctx, x) as an aggregate over rows from before to after."""
        return self._win(lambda ctx, parts, x: fn(ctx, x).over(W.partitionBy(*parts).orderBy(ctx.order).rowsBetween(before, after)))

    def _running(self, fn, reverse):
        return self._frame(fn, *((0, W.unboundedFollowing) if reverse else (W.unboundedPreceding, 0)))

    def cum_count(self, reverse: bool = False):
        return self._running(lambda ctx, x: F.count(kept(x, ctx)), reverse)

    def cum_max(self, reverse: bool = False):
        return self._running(lambda ctx, x: F.max(kept(x, ctx)), reverse)

    def cum_min(self, reverse: bool = False):
        return self._running(lambda ctx, x: F.min(kept(x, ctx)), reverse)

    def cum_prod(self, reverse: bool = False):
        return self._running(lambda ctx, x: F.product(num(ctx, x)), reverse)

    def cum_sum(self, reverse: bool = False):
        """Running sum, 0 before the first value."""
        from loomframe.functions.spec import Composite

        return self._running(lambda ctx, x: Composite(lambda v: F.coalesce(v, F.lit(0)), F.sum(total(ctx, x))), reverse)

    def rank(self):
        """1 for the smallest value, the same for equals; null of null."""
        return self._ranked(F.rank)

    def dense_rank(self):
        return self._ranked(F.dense_rank)

    def _ranked(self, fn):
        def build(ctx, parts, x):
            v = LT.nan_null(x, ctx.type(x))
            return F.when(v.isNotNull(), fn().over(W.partitionBy(*parts).orderBy(v.asc_nulls_last())))

        build.ordered = False
        return self._win(build)

    def lag(self, offset: int = 1, default: Any = None):
        return self._shifted(F.lag, offset, default)

    def lead(self, offset: int = 1, default: Any = None):
        return self._shifted(F.lead, offset, default)

    def _shifted(self, fn, offset, default):
        def build(ctx, parts, x):
            w = W.partitionBy(*parts).orderBy(ctx.order)
            moved = fn(F.struct(x.alias("v")), offset).over(w)
            return moved["v"] if default is None else F.when(moved.isNull(), F.lit(default)).otherwise(moved["v"])

        return self._win(build)

    def row_number(self):
        """Position in the partition, from 1."""
        return self._win(lambda ctx, parts, x: F.row_number().over(W.partitionBy(*parts).orderBy(ctx.order)), name="row_number")._with(extra="row_number")

    def _rolling(self, size, fn):
        if size < 1:
            raise InvalidArgumentError("a window has 1 row or more")
        return self._frame(fn, -(size - 1), 0)

    def rolling_max(self, window_size: int):
        return self._rolling(window_size, lambda ctx, x: F.max(kept(x, ctx)))

    def rolling_min(self, window_size: int):
        return self._rolling(window_size, lambda ctx, x: F.min(kept(x, ctx)))

    def rolling_sum(self, window_size: int):
        return self._rolling(window_size, lambda ctx, x: F.sum(total(ctx, x)))

    def rolling_mean(self, window_size: int):
        return self._rolling(window_size, lambda ctx, x: F.avg(num(ctx, x)))

    def rolling_std(self, window_size: int):
        from loomframe.functions.spec import Composite

        return self._rolling(window_size, lambda ctx, x: Composite(lambda v: F.coalesce(v, F.lit(0.0)), F.stddev_samp(num(ctx, x))))

    def rolling_median(self, window_size: int):
        return self.rolling_quantile(0.5, window_size)

    def rolling_quantile(self, quantile: float, window_size: int):
        if not 0 <= quantile <= 1:
            raise InvalidArgumentError("a quantile is from 0 to 1")
        return self._rolling(window_size, lambda ctx, x: F.percentile(num(ctx, x), F.lit(quantile)))

    def rolling_rank(self, window_size: int):
        """Rank of the row's value among those of its window; null of null."""
        if window_size < 1:
            raise InvalidArgumentError("a window has 1 row or more")

        def build(ctx, parts, x):
            v = LT.nan_null(x, ctx.type(x))
            seen = F.collect_list(v).over(W.partitionBy(*parts).orderBy(ctx.order).rowsBetween(-(window_size - 1), 0))
            return F.when(v.isNotNull(), F.size(F.filter(seen, lambda e: e < v)) + 1)

        return self._win(build)
