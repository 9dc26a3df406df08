"""Aggregates: over groups, whole frames or, after `over`, partitions. NaN counts as missing where numbers are aggregated."""

from __future__ import annotations

import math
from typing import Any

from pyspark.sql import Column
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomframe import types as LT
from loomframe.errors import InvalidArgumentError
from loomframe.functions.spec import Aggregate, Composite


def num(ctx: Any, x: Column) -> Column:
    """x as a double, NaN as null."""
    d = LT.number(x, ctx.type(x)).cast("double")
    return F.when(~F.isnan(d), d)


def total(ctx: Any, x: Column) -> Column:
    """x as long where it is an integer, else double; NaN as null."""
    t = ctx.type(x)
    if isinstance(t, LT.INT_TYPES):
        return x.cast("long")
    return x if isinstance(t, T.DecimalType) else num(ctx, x)


def pairs(ctx: Any, x: Column, y: Column) -> tuple[Column, Column]:
    a, b = num(ctx, x), num(ctx, y)
    ok = a.isNotNull() & b.isNotNull()
    return F.when(ok, a), F.when(ok, b)


def kept(x: Column, ctx: Any) -> Column:
    return LT.nan_null(x, ctx.type(x))


def correlation(n, sx, sy, sxy) -> Column:
    r = F.try_divide(sxy, sx * sy)
    return F.when((n >= 2) & (sx > 0) & (sy > 0), F.greatest(F.lit(-1.0), F.least(F.lit(1.0), r)))


def _position(df, keys, cols, order, out, lowest=True):
    w = W.partitionBy(*keys).orderBy(order) if keys else W.orderBy(order)
    x = F.col(cols[0])
    at = df.withColumn("__loomframe_at", F.row_number().over(w) - 1)
    ok = x.isNotNull() & (~F.isnan(x) if LT.is_float(df.schema[cols[0]].dataType) else F.lit(True))
    key = F.when(ok, F.struct(x, "__loomframe_at") if lowest else F.struct(x, (-F.col("__loomframe_at")).alias("__loomframe_at")))
    pick = F.min_by("__loomframe_at", key) if lowest else F.max_by("__loomframe_at", key)
    return at.groupBy(*keys).agg(pick.cast("long").alias(out))


def _modes(df, keys, cols, order, out):
    x = F.col(cols[0])
    t = df.schema[cols[0]].dataType
    n = df.where(x.isNotNull() & (~F.isnan(x) if LT.is_float(t) else F.lit(True))).groupBy(*keys, cols[0]).agg(F.count(F.lit(1)).alias("__loomframe_n"))
    top = n.groupBy(*keys).agg(F.max("__loomframe_n").alias("__loomframe_m"))
    if keys:
        top = top.select(*[F.col(k).alias(f"{k}__t") for k in keys], "__loomframe_m")
        cond = F.col("__loomframe_n") == F.col("__loomframe_m")
        for k in keys:
            cond = cond & F.col(k).eqNullSafe(F.col(f"{k}__t"))
        best = n.join(top, cond)
    else:
        best = n.crossJoin(F.broadcast(top)).where("__loomframe_n = __loomframe_m")
    return best.groupBy(*keys).agg(F.when(F.count(F.lit(1)) > 0, F.array_sort(F.collect_list(cols[0]))).alias(out))


def _frequencies(base):
    def special(df, keys, cols, order, out):
        x = F.col(cols[0])
        t = df.schema[cols[0]].dataType
        n = df.where(x.isNotNull() & (~F.isnan(x) if LT.is_float(t) else F.lit(True))).groupBy(*keys, cols[0]).agg(F.count(F.lit(1)).cast("double").alias("__loomframe_n"))
        s, sl = F.sum("__loomframe_n"), F.sum(F.col("__loomframe_n") * F.ln("__loomframe_n"))
        return n.groupBy(*keys).agg((F.greatest(F.lit(0.0), F.ln(s) - sl / s) / math.log(base)).alias(out))

    return special


def _spearman(df, keys, cols, order, out):
    x, y = (LT.nan_null(F.col(c), df.schema[c].dataType) for c in cols)
    valid = df.select(*keys, x.cast("double").alias("__loomframe_x"), y.cast("double").alias("__loomframe_y")).where("__loomframe_x is not null and __loomframe_y is not null")

    def rank(c):
        return F.rank().over(W.partitionBy(*keys).orderBy(c)) + (F.count(F.lit(1)).over(W.partitionBy(*keys, c)) - 1) / 2

    ranked = valid.withColumns({"__loomframe_rx": rank("__loomframe_x"), "__loomframe_ry": rank("__loomframe_y")})
    return ranked.groupBy(*keys).agg(correlation(F.count("__loomframe_rx"), F.stddev_samp("__loomframe_rx"), F.stddev_samp("__loomframe_ry"), F.covar_samp("__loomframe_rx", "__loomframe_ry")).alias(out))


class Aggregates:
    def all(self):
        """Whether every value is true; null, NaN and 0 are false; of nothing true."""
        from loomframe.functions.scalars import truth

        return self._agg(Aggregate(lambda ctx, x: Composite(lambda v: F.coalesce(v, F.lit(True)), F.bool_and(truth(ctx, x)))))

    def any(self):
        from loomframe.functions.scalars import truth

        return self._agg(Aggregate(lambda ctx, x: Composite(lambda v: F.coalesce(v, F.lit(False)), F.bool_or(truth(ctx, x)))))

    def all_null(self):
        return self._agg(Aggregate(lambda ctx, x: Composite(lambda v: F.coalesce(v, F.lit(True)), F.bool_and(x.isNull()))))

    def any_null(self):
        return self._agg(Aggregate(lambda ctx, x: Composite(lambda v: F.coalesce(v, F.lit(False)), F.bool_or(x.isNull()))))

    def arg_max(self):
        """Position in the group, from 0 in row order, of the first largest value."""
        return self._agg(Aggregate(special=lambda *a: _position(*a, lowest=False), ordered=True))

    def arg_min(self):
        return self._agg(Aggregate(special=_position, ordered=True))

    def sum(self):
        return self._agg(Aggregate(lambda ctx, x: F.sum(total(ctx, x))))

    def avg(self):
        return self._agg(Aggregate(lambda ctx, x: F.avg(num(ctx, x))))

    mean = avg

    def bitwise_and(self):
        return self._bits(F.bit_and)

    def bitwise_or(self):
        return self._bits(F.bit_or)

    def bitwise_xor(self):
        return self._bits(F.bit_xor)

    def _bits(self, fn):
        def whole(ctx, x):
            t = ctx.type(x)
            if isinstance(t, LT.INT_TYPES):
                return x.cast("long")
            d = num(ctx, x)
            return F.when(d == F.floor(d), d).try_cast("long")

        return self._agg(Aggregate(lambda ctx, x: fn(whole(ctx, x))))

    def count(self, *, include_nulls: bool = False):
        """Values that are neither null nor NaN; include_nulls: rows."""
        return self._agg(Aggregate(lambda ctx, x: F.count(F.lit(1)) if include_nulls else F.count(kept(x, ctx)), empty=0))

    def len(self):
        return self.count(include_nulls=True)

    def corr(self, other):
        """Pearson correlation over rows where both are numbers; null without variance."""

        def simple(ctx, x, y):
            a, b = pairs(ctx, x, y)
            return Composite(correlation, F.count(a), F.stddev_samp(a), F.stddev_samp(b), F.covar_samp(a, b))

        return self._agg(Aggregate(simple), other)

    def cov(self, other):
        return self._agg(Aggregate(lambda ctx, x, y: F.covar_samp(*pairs(ctx, x, y))), other)

    def dot(self, other):
        return self._agg(Aggregate(lambda ctx, x, y: F.sum(num(ctx, x) * num(ctx, y))), other)

    def entropy(self, base: float = math.e, normalize: bool = True):
        """Shannon entropy of the values' frequencies; normalize=False: of the values taken as weights (null if one is negative)."""
        if base <= 0 or base == 1:
            return self._agg(Aggregate(lambda ctx, x: F.max(F.lit(None).cast("double"))))
        if normalize:
            return self._agg(Aggregate(special=_frequencies(base)))

        def simple(ctx, x):
            v = num(ctx, x)
            plus = F.when(v > 0, v)
            return Composite(lambda s, sl, low: F.when((s > 0) & (low >= 0), (F.ln(F.when(s > 0, s)) - F.try_divide(sl, s)) / math.log(base)), F.sum(plus), F.sum(plus * F.ln(plus)), F.min(v))

        return self._agg(Aggregate(simple))

    def first(self):
        """The value of the first row, null or not."""
        return self._agg(Aggregate(lambda ctx, x: F.min_by(x, ctx.order), ordered=True))

    def last(self):
        return self._agg(Aggregate(lambda ctx, x: F.max_by(x, ctx.order), ordered=True))

    def implode(self):
        """All values as a list in row order, nulls kept."""
        return self._agg(Aggregate(lambda ctx, x: Composite(lambda v: F.transform(F.array_sort(v), lambda e: e["v"]), F.collect_list(F.struct(ctx.order.alias("o"), x.alias("v")))), ordered=True))

    def kurtosis(self, *, fisher: bool = True, bias: bool = True):
        add = 0 if fisher else 3

        def simple(ctx, x):
            v = num(ctx, x)
            if bias:
                return Composite(lambda k, s: F.when(s > 0, k + add), F.kurtosis(v), F.stddev_pop(v))
            # the unbiased form from the population excess
            return Composite(lambda k, s, n: F.when((n > 3) & (s > 0), F.try_divide((n - 1) * ((n + 1) * k + 6), (n - 2) * (n - 3)) + add), F.kurtosis(v), F.stddev_pop(v), F.count(v))

        return self._agg(Aggregate(simple))

    def skew(self, *, bias: bool = True):
        def simple(ctx, x):
            v = num(ctx, x)
            if bias:
                return Composite(lambda g, s: F.when(s > 0, g), F.skewness(v), F.stddev_pop(v))
            return Composite(lambda g, s, n: F.when((n > 2) & (s > 0), g * F.try_divide(F.sqrt((n * (n - 1)).cast("double")), n - 2)), F.skewness(v), F.stddev_pop(v), F.count(v))

        return self._agg(Aggregate(simple))

    def max(self):
        return self._agg(Aggregate(lambda ctx, x: F.max(kept(x, ctx))))

    def min(self):
        return self._agg(Aggregate(lambda ctx, x: F.min(kept(x, ctx))))

    def max_by(self, by):
        """This value at the first largest `by`; rows where either is null are left out."""

        return self._agg(Aggregate(special=lambda *a: _by(*a, False), ordered=True), by)

    def min_by(self, by):
        return self._agg(Aggregate(special=lambda *a: _by(*a, True), ordered=True), by)

    def median(self):
        return self.quantile(0.5)

    def quantile(self, q: float):
        """Linear between neighbours; q from 0 to 1."""
        if not 0 <= q <= 1:
            raise InvalidArgumentError("q is from 0 to 1")
        return self._agg(Aggregate(lambda ctx, x: F.percentile(num(ctx, x), F.lit(q))))

    def mode(self):
        """Sorted list of all most frequent values."""
        return self._agg(Aggregate(special=_modes))

    def n_unique(self, key=None):
        """Different values, null one of them; key: a function of this expression whose values are counted instead."""
        e = key(self) if key else self
        return e._agg(Aggregate(lambda ctx, x: Composite(lambda n, z: n + F.coalesce(z, F.lit(0)), F.count_distinct(x), F.max(x.isNull().cast("int"))), windowed=False))

    def nan_max(self):
        return self._agg(Aggregate(lambda ctx, x: F.max(x)))

    def nan_min(self):
        def simple(ctx, x):
            t = ctx.type(x)
            if not LT.is_float(t):
                return F.min(x)
            return Composite(lambda has, low: F.when(has, F.lit(float("nan"))).otherwise(low), F.bool_or(F.isnan(x)), F.min(x))

        return self._agg(Aggregate(simple))

    def null_count(self):
        """Nulls and NaNs."""
        return self._agg(Aggregate(lambda ctx, x: F.count_if(kept(x, ctx).isNull()), empty=0))

    def product(self):
        return self._agg(Aggregate(lambda ctx, x: F.product(num(ctx, x))))

    def spearman_corr(self, other):
        """Pearson correlation of average ranks."""
        return self._agg(Aggregate(special=_spearman), other)

    def std(self):
        """Sample standard deviation; 0 of fewer than two values."""
        return self._agg(Aggregate(lambda ctx, x: Composite(lambda v: F.coalesce(v, F.lit(0.0)), F.stddev_samp(num(ctx, x)))))

    def variance(self):
        return self._agg(Aggregate(lambda ctx, x: Composite(lambda v: F.coalesce(v, F.lit(0.0)), F.var_samp(num(ctx, x)))))

    var = variance

    def w_avg(self, weights):
        """Weighted mean over rows where both are numbers; null if the weights sum to 0."""

        def simple(ctx, x, y):
            a, b = pairs(ctx, x, y)
            return Composite(lambda s, w: F.when(F.abs(w) >= 1e-12, F.try_divide(s, w)), F.sum(a * b), F.sum(b))

        return self._agg(Aggregate(simple), weights)


def _by(df, keys, cols, order, out, lowest):
    """The value at the first extreme: one pass for the extreme, one for the first row that has it."""
    x, y = F.col(cols[0]), F.col(cols[1])
    ok = x.isNotNull() & LT.nan_null(y, df.schema[cols[1]].dataType).isNotNull()
    valid = df.where(ok)
    if lowest:
        return valid.groupBy(*keys).agg(F.min_by(x, F.struct(y, F.col(order))).alias(out))
    best = valid.groupBy(*keys).agg(F.max(y).alias("__loomframe_best"))
    if keys:
        best = best.select(*[F.col(k).alias(f"{k}__t") for k in keys], "__loomframe_best")
        cond = y == F.col("__loomframe_best")
        for k in keys:
            cond = cond & F.col(k).eqNullSafe(F.col(f"{k}__t"))
        rows = valid.join(best, cond)
    else:
        rows = valid.crossJoin(F.broadcast(best)).where(y == F.col("__loomframe_best"))
    return rows.groupBy(*keys).agg(F.min_by(x, F.col(order)).alias(out))
