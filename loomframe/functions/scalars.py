"""Arithmetic, comparison, logic and null handling, row by row. Null operands give null; nothing raises."""

from __future__ import annotations

import math
from collections.abc import Iterable
from typing import Any

from pyspark.sql import Column
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomframe import types as LT
from loomframe.errors import InvalidArgumentError
from loomframe.functions.spec import Aggregate

INF = float("inf")


def wide(c: Column, t: T.DataType) -> Column:
    """c as a number that sums and products of everyday size fit in: small integers as long, text parsed, dates as milliseconds."""
    if isinstance(t, (T.ByteType, T.ShortType, T.IntegerType)):
        return c.cast("long")
    if isinstance(t, T.FloatType):
        return c.cast("double")
    return LT.number(c, t)


def double(ctx: Any, c: Column) -> Column:
    return LT.number(c, ctx.type(c)).cast("double")


def rounded(x: Column, decimals: int) -> Column:
    """Half toward plus infinity at a number of decimals."""
    down = -F.round(-x, decimals)
    up = F.round(x, decimals)
    if decimals < 16:
        # a half of a negative number goes up: take what is nearer, and the upper of two equally near
        step = F.lit(10.0**-decimals)
        tie = F.round(x - up, 12) == F.round(step / 2, 12)
        return F.when(x >= 0, up).when(tie, up + step).otherwise(down)
    return up


class Arithmetic:
    def _unary(self, fn, domain=None):
        def build(ctx, x):
            d = double(ctx, x)
            return fn(d) if domain is None else F.when(domain(d), fn(d))

        return self._map(build)

    def _pair(self, other, fn):
        return self._map(lambda ctx, x, y: fn(double(ctx, x), double(ctx, y)), other)

    def abs(self):
        return self._map(lambda ctx, x: F.abs(wide(x, ctx.type(x))))

    def acos(self):
        return self._unary(F.acos, lambda x: x.between(-1, 1))

    def acosh(self):
        return self._unary(F.acosh, lambda x: x >= 1)

    def asin(self):
        return self._unary(F.asin, lambda x: x.between(-1, 1))

    def asinh(self):
        return self._unary(F.asinh)

    def atan(self):
        return self._unary(F.atan)

    def atan2(self, val):
        return self._pair(val, F.atan2)

    def atanh(self):
        return self._unary(F.atanh, lambda x: F.abs(x) < 1)

    def cbrt(self):
        return self._unary(F.cbrt)

    def ceil(self):
        return self._map(lambda ctx, x: F.ceil(wide(x, ctx.type(x))))

    def floor(self):
        return self._map(lambda ctx, x: F.floor(wide(x, ctx.type(x))))

    def clip(self, lower=None, upper=None):
        """Held to [lower, upper]; if lower is above upper, lower; NaN is lower (else upper)."""

        def build(ctx, x):
            t = ctx.type(x)
            v = wide(x, t)
            nan = F.isnan(v) if LT.is_float(ctx.type(v)) else F.lit(False)
            low, high = (None if b is None else F.lit(b) for b in (lower, upper))
            out = F.when(v.isNull(), v)
            if low is not None:
                out = out.when(nan | (v < low), low)
            if high is not None:
                out = out.when(nan | (v > high), F.greatest(high, low) if low is not None else high)
            return out.otherwise(v)

        return self._map(build)

    def copysign(self, val):
        return self._pair(val, lambda x, y: F.abs(x) * F.when(y >= 0, 1.0).when(y < 0, -1.0))

    def cos(self):
        return self._unary(F.cos)

    def cosh(self):
        return self._unary(F.cosh)

    def degrees(self):
        return self._unary(F.degrees)

    def radians(self):
        return self._unary(F.radians)

    def exp(self):
        return self._unary(F.exp)

    def expm1(self):
        return self._unary(F.expm1)

    def hypot(self, val):
        return self._pair(val, F.hypot)

    def log(self, base: float = math.e):
        return self._unary((lambda x: F.ln(x)) if base == math.e else lambda x: F.log(float(base), x), lambda x: x > 0)

    def log1p(self):
        return self._unary(F.log1p, lambda x: x > -1)

    def sin(self):
        return self._unary(F.sin)

    def sinh(self):
        return self._unary(F.sinh)

    def sqrt(self):
        return self._unary(F.sqrt, lambda x: x >= 0)

    def tan(self):
        return self._unary(F.tan)

    def tanh(self):
        return self._unary(F.tanh)

    def sign(self):
        return self._unary(F.signum)

    def trunc(self):
        return self._map(lambda ctx, x: F.when(wide(x, ctx.type(x)) < 0, F.ceil(wide(x, ctx.type(x)))).otherwise(F.floor(wide(x, ctx.type(x)))))

    def add(self, val):
        """Sum; text is joined; a date counts as epoch milliseconds."""

        def build(ctx, x, y):
            tx, ty = ctx.type(x), ctx.type(y)
            if isinstance(tx, T.StringType) and isinstance(ty, T.StringType):
                return F.concat(x, y)
            return wide(x, tx) + wide(y, ty)

        return self._map(build, val)

    def sub(self, val):
        return self._map(lambda ctx, x, y: wide(x, ctx.type(x)) - wide(y, ctx.type(y)), val)

    def mul(self, val):
        return self._map(lambda ctx, x, y: wide(x, ctx.type(x)) * wide(y, ctx.type(y)), val)

    def div(self, val):
        """Quotient of doubles; by zero: null."""
        return self._pair(val, F.try_divide)

    def floordiv(self, val):
        return self._pair(val, lambda x, y: F.floor(F.try_divide(x, y)))

    def mod(self, val):
        """Remainder with the sign of the dividend; by zero: null."""
        return self._map(lambda ctx, x, y: F.try_mod(wide(x, ctx.type(x)), wide(y, ctx.type(y))), val)

    def pow(self, val):
        return self._pair(val, F.pow)

    def negate(self):
        return self._map(lambda ctx, x: -wide(x, ctx.type(x)))

    def round(self, decimals: int = 0):
        """Half toward plus infinity."""
        return self._map(lambda ctx, x: rounded(double(ctx, x), decimals))

    def round_sig_figs(self, sig_figs: int):
        """sig_figs significant digits; zero and what is not finite stay."""
        if sig_figs < 1:
            raise InvalidArgumentError("sig_figs is 1 or more")

        def build(ctx, x):
            d = double(ctx, x)
            place = F.lit(sig_figs - 1) - F.floor(F.log10(F.abs(d)))
            scale = F.pow(F.lit(10.0), F.abs(place).cast("double"))
            up = F.floor(d * scale + 0.5) / scale
            down = F.floor(d / scale + 0.5) * scale
            return F.when((d == 0) | F.isnan(d) | (F.abs(d) == INF), d).when(place >= 0, up).otherwise(down)

        return self._map(build)

    def rand(self, seed: int | None = None, *, min: float = 0.0, max: float = 1.0, integer: bool = False):
        """A random number per row in [min, max), or an integer from min to max; with a seed from a hash of row order and seed."""

        def build(ctx, _, x):
            u = F.rand() if seed is None else F.pmod(F.xxhash64(ctx.order, F.lit(seed)), F.lit(1 << 53)) / float(1 << 53)
            return F.floor(u * (max - min + 1) + min).cast("long") if integer else u * (max - min) + min

        build.ordered = seed is not None
        return self._win(build)

    __add__ = add
    __sub__ = sub
    __mul__ = mul
    __truediv__ = div
    __floordiv__ = floordiv
    __mod__ = mod
    __pow__ = pow
    __neg__ = negate

    def __radd__(self, o):
        return self._flip(o, "add")

    def __rsub__(self, o):
        return self._flip(o, "sub")

    def __rmul__(self, o):
        return self._flip(o, "mul")

    def __rtruediv__(self, o):
        return self._flip(o, "div")

    def _flip(self, o, name):
        from loomframe.functions.expr import as_expr

        return getattr(as_expr(o), name)(self)


class Comparison:
    def _compare(self, other, fn):
        """fn(x, y); any comparison with NaN is false (for ne true), dates compare with milliseconds."""

        def build(ctx, x, y):
            tx, ty = ctx.type(x), ctx.type(y)
            if LT.is_time(tx) and LT.is_number(ty):
                x, tx = LT.millis(x, tx), T.LongType()
            elif LT.is_time(ty) and LT.is_number(tx):
                y, ty = LT.millis(y, ty), T.LongType()
            if isinstance(tx, T.StringType) != isinstance(ty, T.StringType) and (LT.is_number(tx) or LT.is_number(ty) or isinstance(tx, T.BooleanType) or isinstance(ty, T.BooleanType)):
                return fn(F.lit(0), F.lit(1), False) if fn is _eq else fn(x.cast("string"), y.cast("string"), None) if fn is _ne else fn(LT.number(x, tx), LT.number(y, ty), None)
            nan = [F.isnan(c) for c, t in ((x, tx), (y, ty)) if LT.is_float(t)]
            return fn(x, y, nan[0] | nan[1] if len(nan) == 2 else nan[0] if nan else None)

        return self._map(build, other)

    def eq(self, val):
        return self._compare(val, _eq)

    def ne(self, val):
        return self._compare(val, _ne)

    def gt(self, val):
        return self._compare(val, lambda x, y, nan: _guard(x > y, nan))

    def ge(self, val):
        return self._compare(val, lambda x, y, nan: _guard(x >= y, nan))

    def lt(self, val):
        return self._compare(val, lambda x, y, nan: _guard(x < y, nan))

    def le(self, val):
        return self._compare(val, lambda x, y, nan: _guard(x <= y, nan))

    __eq__ = eq
    __ne__ = ne
    __gt__ = gt
    __ge__ = ge
    __lt__ = lt
    __le__ = le

    def eq_missing(self, val):
        return self._map(lambda ctx, x, y: x.eqNullSafe(y), val)

    def ne_missing(self, val):
        return self._map(lambda ctx, x, y: ~x.eqNullSafe(y), val)

    def between(self, lower, upper, closed: str = "both"):
        """closed: both, left, right or none; null if any of the three is."""
        if closed not in ("both", "left", "right", "none"):
            raise InvalidArgumentError(f"closed is both, left, right or none, not {closed!r}")

        def build(ctx, x, lo, hi):
            above = x >= lo if closed in ("both", "left") else x > lo
            below = x <= hi if closed in ("both", "right") else x < hi
            inside = above & below
            if LT.is_float(ctx.type(x)):
                inside = inside & ~F.isnan(x)
            return F.when(x.isNotNull() & lo.isNotNull() & hi.isNotNull(), inside)

        return self._map(build, lower, upper)

    def is_in(self, values):
        """Membership in a list of values or in a list column; null stays null, and members that are null count for nothing."""
        return self._member(values, False)

    def not_in(self, values):
        return self._member(values, True)

    def _member(self, values, negate):
        if isinstance(values, Iterable) and not isinstance(values, (str, bytes)) and not hasattr(values, "_map"):
            known = [v for v in values if v is not None]

            def build(ctx, x):
                t = ctx.type(x)
                same = [v for v in known if isinstance(v, str) == isinstance(t, T.StringType) or LT.is_time(t)]
                hit = x.isin(same) if same else F.lit(False)
                if LT.is_float(t) and any(isinstance(v, float) and v != v for v in same):
                    hit = hit | F.isnan(x)
                return F.when(x.isNotNull(), ~hit if negate else hit)

            return self._map(build)

        def build(ctx, x, y):
            hit = F.exists(y, lambda e: e.eqNullSafe(x)) if isinstance(ctx.type(y), T.ArrayType) else y.eqNullSafe(x)
            hit = F.coalesce(hit, F.lit(False))
            return F.when(x.isNotNull(), ~hit if negate else hit)

        return self._map(build, values)

    def is_close(self, other, *, abs_tol: float = 1e-8, rel_tol: float = 1e-8, nans_equal: bool = False):
        def build(ctx, x, y):
            a, b = double(ctx, x), double(ctx, y)
            near = F.abs(a - b) <= F.greatest(rel_tol * F.greatest(F.abs(a), F.abs(b)), F.lit(abs_tol))
            nan = F.isnan(a) | F.isnan(b)
            endless = (F.abs(a) == INF) | (F.abs(b) == INF)
            return F.when(a.isNotNull() & b.isNotNull(), F.when(nan, F.lit(nans_equal) & F.isnan(a) & F.isnan(b)).when(endless, a == b).otherwise(near))

        return self._map(build, other)

    def is_null(self):
        return self._map(lambda ctx, x: x.isNull())

    def is_not_null(self):
        return self._map(lambda ctx, x: x.isNotNull())

    def _float_test(self, fn, otherwise):
        return self._map(lambda ctx, x: F.when(x.isNotNull(), fn(x) if LT.is_float(ctx.type(x)) else F.lit(otherwise)))

    def is_nan(self):
        return self._float_test(F.isnan, False)

    def is_not_nan(self):
        return self._float_test(lambda x: ~F.isnan(x), True)

    def is_finite(self):
        return self._float_test(lambda x: ~F.isnan(x) & (F.abs(x) != INF), True)

    def is_infinite(self):
        return self._float_test(lambda x: F.abs(x) == INF, False)

    def is_empty(self, *, ignore_nulls: bool = False):
        """Text or list of length 0 (ignore_nulls: also a list of nulls only); null for other types."""

        def build(ctx, x):
            t = ctx.type(x)
            if isinstance(t, T.StringType):
                return F.length(x) == 0
            if isinstance(t, T.ArrayType):
                return F.when(x.isNotNull(), F.size(F.filter(x, lambda e: e.isNotNull()) if ignore_nulls else x) == 0)
            return F.lit(None).cast("boolean")

        return self._map(build)

    def has_nulls(self):
        """Aggregate: whether any value is null."""
        return self._agg(Aggregate(lambda ctx, x: _has(x)))

    def is_duplicated(self):
        return self._occurs(lambda n: n > 1)

    def is_unique(self):
        return self._occurs(lambda n: n == 1)

    def _occurs(self, test):
        def build(ctx, parts, x):
            return test(F.count(F.lit(1)).over(W.partitionBy(*parts, x)))

        build.ordered = False
        return self._win(build)


def _has(x):
    from loomframe.functions.spec import Composite

    return Composite(lambda v: F.coalesce(v, F.lit(False)), F.bool_or(x.isNull()))


def _guard(c, nan):
    return c if nan is None else c & ~nan


def _eq(x, y, nan):
    return F.lit(False) if nan is False else _guard(x == y, nan)


def _ne(x, y, nan):
    return x != y if nan is None else (x != y) | nan


def truth(ctx: Any, x: Column) -> Column:
    """Truth of a value: null, 0, NaN and the empty text are false."""
    t = ctx.type(x)
    return F.coalesce(truthy(x, t), F.lit(False))


def truthy(x: Column, t: T.DataType) -> Column:
    if isinstance(t, T.BooleanType):
        return x
    if LT.is_float(t):
        return (x != 0) & ~F.isnan(x)
    if LT.is_number(t):
        return x != 0
    if isinstance(t, T.StringType):
        return F.length(x) > 0
    return x.isNotNull()


class Logic:
    def _bool(self, fn, *others):
        return self._map(lambda ctx, *cols: fn(*[c if isinstance(ctx.type(c), T.BooleanType) else truthy(c, ctx.type(c)) for c in cols]), *others)

    def and_(self, other):
        return self._bool(lambda x, y: x & y, other)

    def or_(self, other):
        return self._bool(lambda x, y: x | y, other)

    def xor(self, other):
        return self._bool(lambda x, y: x != y, other)

    def not_(self):
        return self._bool(lambda x: ~x)

    __and__ = and_
    __or__ = or_
    __xor__ = xor
    __invert__ = not_


class Filling:
    def fill_null(self, value: Any = None, strategy: str | None = None, limit: int | None = None):
        """Nulls from a value or column, or by strategy: forward, backward (at most `limit` in a row), min, max, mean, zero, one."""
        if strategy is None:
            return self._map(lambda ctx, x, v: F.coalesce(x, v.cast(ctx.type(x)) if not isinstance(ctx.type(v), type(ctx.type(x))) and LT.is_number(ctx.type(x)) and LT.is_float(ctx.type(x)) else v), value)
        if strategy in ("forward", "backward"):
            forward = strategy == "forward"

            def build(ctx, parts, x):
                w = W.partitionBy(*parts).orderBy(ctx.order)
                if forward:
                    return F.last(x, ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding if limit is None else -limit, 0))
                return F.first(x, ignorenulls=True).over(w.rowsBetween(0, W.unboundedFollowing if limit is None else limit))

            return self._win(build)
        if strategy in ("min", "max", "mean"):
            return self.fill_null({"min": self.min, "max": self.max, "mean": self.mean}[strategy]())
        if strategy in ("zero", "one"):
            return self.fill_null(0 if strategy == "zero" else 1)
        raise InvalidArgumentError(f"no fill strategy is called {strategy!r}")

    def reverse(self):
        """The column's values in reverse row order, apart from the other columns: a join of positions with mirrored positions."""
        from loomframe.functions.expr import Expr

        return Expr(None, (self,), "win", name=self._name, extra="reverse")
