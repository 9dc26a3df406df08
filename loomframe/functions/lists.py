"""The `.arr` family: functions of one list each, as higher-order functions in the JVM. Positions count from 0, negative from the end."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomframe import types as LT
from loomframe.errors import InvalidArgumentError


def elements(x: Column, t: T.DataType) -> Column:
    """The list without nulls and NaNs."""
    return F.filter(x, lambda e: e.isNotNull() & ~F.isnan(e)) if LT.is_float(t.elementType) else F.filter(x, lambda e: e.isNotNull())


def numbers(x: Column, t: T.DataType) -> Column:
    """The list's numbers as doubles."""
    return F.filter(F.transform(x, lambda e: LT.number(e, t.elementType).cast("double")), lambda e: e.isNotNull() & ~F.isnan(e))


def add_up(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, e: s + e)


def let(value: Column, fn: Any) -> Column:
    """fn(value) with the value computed once: what a lambda uses from outside is computed for every element, unless it is a variable itself."""
    return F.get(F.transform(F.array(value), fn), 0)


def spread(values: Column) -> Column:
    """Sample variance, 0 of fewer than two."""

    def of(a: Column) -> Column:
        n = F.size(a)
        square = let(add_up(a) / F.greatest(n, F.lit(1)), lambda mean: F.aggregate(a, F.lit(0.0), lambda s, e: s + (e - mean) * (e - mean)))
        return F.when(n <= 1, F.lit(0.0)).otherwise(square / F.greatest(n - 1, F.lit(1)))

    return let(values, of)


class Lists:
    def __init__(self, e):
        self.e = e

    def _l(self, fn, *operands):
        """fn(list, its type, operands); null for what is no list."""

        def build(ctx, x, *others):
            t = ctx.type(x)
            if not isinstance(t, T.ArrayType):
                return F.lit(None)
            return F.when(x.isNotNull(), fn(x, t, *others))

        return self.e._map(build, *operands)

    def _item(self, fn, item):
        return self._l(lambda x, t, y: fn(x, y.cast(t.elementType)), item)

    def all(self):
        from loomframe.functions.scalars import truthy

        return self._l(lambda x, t: F.forall(x, lambda e: F.coalesce(truthy(e, t.elementType), F.lit(False))))

    def any(self):
        from loomframe.functions.scalars import truthy

        return self._l(lambda x, t: F.exists(x, lambda e: F.coalesce(truthy(e, t.elementType), F.lit(False))))

    def arg_max(self):
        return self._l(lambda x, t: _first_at(x, F.array_max(elements(x, t))))

    def arg_min(self):
        return self._l(lambda x, t: _first_at(x, F.array_min(elements(x, t))))

    def contains(self, item):
        return self._item(lambda x, y: F.exists(x, lambda e: e.eqNullSafe(y)), item)

    def contains_all(self, items):
        return self._l(lambda x, t, y: let(x, lambda v: F.forall(y.cast(t), lambda i: F.exists(v, lambda e: e.eqNullSafe(i)))), list(items) if not hasattr(items, "_map") else items)

    def contains_any(self, items):
        return self._l(lambda x, t, y: let(x, lambda v: F.exists(y.cast(t), lambda i: F.exists(v, lambda e: e.eqNullSafe(i)))), list(items) if not hasattr(items, "_map") else items)

    def count_matches(self, item):
        return self._item(lambda x, y: F.size(F.filter(x, lambda e: e.eqNullSafe(y))), item)

    def lengths(self):
        return self._l(lambda x, t: F.size(x))

    len = lengths

    def get(self, index: Any, null_on_oob: bool = True):
        if hasattr(index, "_map"):
            return self._l(lambda x, t, i: _at(x, i, null_on_oob), index)
        return self._l(lambda x, t: _at(x, F.lit(index), null_on_oob))

    def first(self, null_on_oob: bool = True):
        return self.get(0, null_on_oob)

    def last(self, null_on_oob: bool = True):
        return self.get(-1, null_on_oob)

    def gather(self, indices: Any, null_on_oob: bool = True):
        many = [indices] if isinstance(indices, int) else indices
        return self._l(lambda x, t, y: let(x, lambda v: F.transform(y, lambda i: _at(v, i, null_on_oob))), list(many) if not hasattr(many, "_map") else many)

    def gather_every(self, step: int = 1, *, offset_start: int = 0, offset_end: int = 0, max_items: int | None = None):
        """Every step-th element from offset_start, up to offset_end before the end; negative steps go from the end. A start outside the list gives null."""
        if step == 0:
            raise InvalidArgumentError("step is not 0")

        def build(x, t):
            n = F.size(x)
            if step > 0:
                start, stop = F.lit(offset_start), n - 1 - offset_end
                some, at = start <= stop, F.sequence(start, F.greatest(start, stop), F.lit(step))
            else:
                start, stop = n - 1 - offset_end, F.lit(offset_start)
                some, at = start >= stop, F.sequence(F.greatest(start, stop), stop, F.lit(step))
            out = F.transform(at, lambda i: F.get(x, i))
            if max_items is not None:
                out = F.slice(out, F.lit(1), F.lit(max_items))
            return F.when((start < 0) | (start >= n), F.lit(None)).when(some, out).otherwise(F.slice(x, 1, 0))

        return self._l(lambda x, t: let(x, lambda v: build(v, t)))

    def join(self, separator: str = ",", *, ignore_nulls: bool = False, null_value: str = "", prefix: str = "", suffix: str = "", limit: int | None = None, truncation_marker: str = "...", value_formatter: Any = None):
        """Elements as one text; value_formatter (value, index) -> text runs as a Python UDF, which keeps the elements' types."""
        if value_formatter is not None:
            put = F.udf(lambda v: None if v is None else [None if e is None else str(value_formatter(e, i)) for i, e in enumerate(v)], T.ArrayType(T.StringType()))
            rest = {"ignore_nulls": ignore_nulls, "null_value": null_value, "prefix": prefix, "suffix": suffix, "limit": limit, "truncation_marker": truncation_marker}
            return Lists(self.e._map(lambda ctx, x: put(x))).join(separator, **rest)

        def build(x, t):
            s = F.transform(x, lambda e: LT.lenient(e, t.elementType, LT.Utf8))
            if ignore_nulls:
                s = F.filter(s, lambda e: e.isNotNull())
            shown = s if limit is None else F.slice(s, F.lit(1), F.lit(max(0, limit)))
            out = F.array_join(shown, separator, None if ignore_nulls else null_value)
            if limit is not None:
                out = F.concat(out, F.when(F.size(s) > limit, F.lit((separator if limit > 0 else "") + truncation_marker)).otherwise(F.lit("")))
            return F.concat(F.lit(prefix), out, F.lit(suffix))

        return self._l(build)

    def max(self):
        return self._l(lambda x, t: F.array_max(elements(x, t)))

    def min(self):
        return self._l(lambda x, t: F.array_min(elements(x, t)))

    def sum(self):
        def build(x, t):
            def of(a):
                s = add_up(a)
                return F.when(F.size(a) > 0, s.cast("long") if isinstance(t.elementType, LT.INT_TYPES) else s)

            return let(numbers(x, t), of)

        return self._l(build)

    def mean(self):
        return self._l(lambda x, t: let(numbers(x, t), lambda a: F.try_divide(add_up(a), F.size(a))))

    def median(self):
        def of(a):
            n = F.size(a)
            half = F.floor(n / 2).cast("int")
            return F.when(n == 0, F.lit(None).cast("double")).when(n % 2 == 1, F.get(a, half)).otherwise((F.get(a, half - 1) + F.get(a, half)) / 2)

        return self._l(lambda x, t: let(F.array_sort(numbers(x, t)), of))

    def std(self):
        return self._l(lambda x, t: F.sqrt(spread(numbers(x, t))))

    def variance(self):
        return self._l(lambda x, t: spread(numbers(x, t)))

    def mode(self):
        """Sorted list of all most frequent elements; null of none."""

        def runs(a):
            """The first places of equal elements of a sorted list, and its length after the last."""
            return F.concat(F.filter(F.sequence(F.lit(0), F.size(a) - 1), lambda i: (i == 0) | (F.get(a, i) != F.get(a, i - 1))), F.array(F.size(a)))

        def most(a, at):
            sizes = F.transform(F.sequence(F.lit(0), F.size(at) - 2), lambda k: F.struct((F.get(at, k + 1) - F.get(at, k)).alias("n"), F.get(at, k).alias("i")))
            return let(sizes, lambda s: let(F.array_max(F.transform(s, lambda r: r["n"])), lambda top: F.transform(F.filter(s, lambda r: r["n"] == top), lambda r: F.get(a, r["i"]))))

        return self._l(lambda x, t: let(F.array_sort(elements(x, t)), lambda a: F.when(F.size(a) > 0, let(runs(a), lambda at: most(a, at)))))

    def n_unique(self, key=None):
        """Different elements, null one of them; key: a function of an element's expression whose values are counted instead."""
        if key is not None:
            from loomframe.functions import element

            return self.eval(key(element())).arr.n_unique()
        return self._l(lambda x, t: F.size(F.array_distinct(x)))

    def unique(self):
        return self._l(lambda x, t: F.array_distinct(x))

    def reverse(self):
        return self._l(lambda x, t: F.reverse(x))

    def shift(self, n: int = 1):
        """Elements moved n places to the end (negative: to the start), nulls in their place."""

        def build(x, t):
            size = F.size(x)
            k = F.least(F.lit(abs(n)), size)
            gap = F.array_repeat(F.lit(None).cast(t.elementType), k)
            return F.concat(gap, F.slice(x, F.lit(1), size - k)) if n >= 0 else F.concat(F.slice(x, k + 1, size - k), gap)

        return self._l(build)

    def slice(self, start: int | None = None, end: int | None = None):
        """From start up to end, both may be negative."""

        def build(x, t):
            n = F.size(x)
            lo, hi = _clamped(start, n, F.lit(0)), _clamped(end, n, n)
            return F.slice(x, lo + 1, F.greatest(F.lit(0), hi - lo))

        return self._l(build)

    def splice(self, start: int, delete_count: int | None = None, *items: Any):
        """delete_count elements from start (all that follow by default) replaced by items."""

        def build(x, t, *new):
            n = F.size(x)
            lo = _clamped(start, n, F.lit(0))
            gone = n - lo if delete_count is None else F.least(F.lit(max(0, delete_count)), n - lo)
            parts = [F.slice(x, F.lit(1), lo)]
            if new:
                parts.append(F.array(*[i.cast(t.elementType) for i in new]))
            parts.append(F.slice(x, lo + gone + 1, n - lo - gone))
            return F.concat(*parts)

        return self._l(build, *items)

    def sort(self, *, descending: bool = False, nulls_last: bool = True):
        def build(x, t):
            some, none = F.array_sort(F.filter(x, lambda e: e.isNotNull())), F.filter(x, lambda e: e.isNull())
            some = F.reverse(some) if descending else some
            return F.concat(some, none) if nulls_last else F.concat(none, some)

        return self._l(build)

    def to_struct(self, fields: Any = None, *, upper_bound: int | None = None):
        """Elements as fields field_0, field_1...; their number is upper_bound, that of the names in `fields`, or else the longest list's."""
        names = fields if isinstance(fields, (list, tuple)) else None
        width = upper_bound if upper_bound is not None else len(names) if names else None
        if width == 0:
            raise InvalidArgumentError("a struct has a field or more")

        def build(ctx, x):
            n = width if width is not None else ctx.df.select(F.max(F.size(x))).first()[0]
            if not n or n < 1:
                raise InvalidArgumentError("a struct has a field or more; all lists are empty")
            label = (lambda i: names[i] if i < len(names) else f"field_{i}") if names else fields if callable(fields) else (lambda i: f"field_{i}")
            return F.when(x.isNotNull(), F.struct(*[F.get(x, i).alias(label(i)) for i in range(n)]))

        return self.e._map(build)

    def filter(self, expr):
        """Elements for which the expression of element() is true."""
        from loomframe.functions.scalars import truthy

        def build(ctx, x):
            kind, fn = _body(ctx, x, expr)
            return F.filter(x, lambda e: F.coalesce(truthy(fn(e), kind), F.lit(False)))

        return self.e._map(build)

    def eval(self, expr):
        """The expression of element() over each list: for each element, or once for an aggregate of the elements."""
        if expr.has("win"):
            from loomframe.functions.expr import Expr

            return Expr(None, (self.e,), "win", extra=("list", expr))
        whole = _reduced(expr)
        if whole is not None:
            return self._reduce(whole)
        return self.e._map(lambda ctx, x: F.transform(x, _body(ctx, x, expr)[1]))

    def agg(self, expr):
        """As eval; of one value for each element the first."""
        whole = _reduced(expr)
        if whole is not None:
            return self._reduce(whole, False)
        return self.eval(expr).arr.first()

    def _reduce(self, whole, as_list: bool = True):
        before, name, args, after = whole
        inner = self.e if before.kind == "element" else self.eval(before)
        out = getattr(Lists(inner), name)(*args)
        if after is not None:
            out = after(out)
        return out._map(lambda ctx, x: F.when(x.isNotNull(), F.array(x))) if as_list else out

    def explode(self, *, empty_as_null: bool = True, keep_nulls: bool = True):
        """A row for each element; empty lists and nulls give a row with null, or none if so wanted."""
        return self.e._with(build=None, args=(self.e,), kind="explode", extra=(empty_as_null, keep_nulls), name=self.e.name, keys=None)


def _first_at(x: Column, v: Column) -> Column:
    return F.when(v.isNotNull(), (F.array_position(x, v) - 1).cast("int"))


def _at(x: Column, i: Column, null_on_oob: bool) -> Column:
    n = F.size(x)
    at = F.when(i < 0, i + n).otherwise(i)
    if null_on_oob:
        return F.get(x, at.cast("int"))
    return F.when((at < 0) | (at >= n), F.raise_error(F.lit("an index is outside its list"))).otherwise(F.get(x, at.cast("int")))


def _clamped(i: int | None, n: Column, default: Column) -> Column:
    if i is None:
        return default
    return F.least(F.lit(i), n) if i >= 0 else F.greatest(F.lit(0), n + i)


def _body(ctx: Any, x: Column, expr: Any) -> tuple[T.DataType, Any]:
    """The type of expr over x's elements, and the lambda: it is rehearsed on a real column, as lambda variables have no type yet."""
    from loomframe.functions.expr import Rehearsal, Replay

    probe = ctx.df.select("*", F.explode(x).alias("__loomframe_e"))
    rehearsal = Rehearsal(probe, F.col("__loomframe_e"))
    out = expr.column(rehearsal)
    kind = probe.select(out).schema[0].dataType
    return kind, lambda e: expr.column(Replay(ctx, e, rehearsal.kinds))


#: Aggregates of element() and what they are called for lists.
REDUCERS = ("all", "any", "arg_max", "arg_min", "max", "mean", "median", "min", "mode", "n_unique", "std", "sum", "variance")


def _reduced(expr: Any):
    """(element expression, reducer, its arguments, what follows) if expr is an aggregate of element(), else None."""
    node = next((n for n in expr.walk() if n.kind == "agg"), None)
    if node is None:
        return None
    from loomframe.functions.expr import Expr

    name = next((r for r in REDUCERS if _same(getattr(Expr, r), node)), None)
    if name is None:
        raise InvalidArgumentError("this aggregate can't be taken of a list")
    after = None
    if node is not expr:
        after = lambda out: expr.replaced(lambda n: out if n.extra is node.extra and n.kind == "agg" else n)
    return node.args[0], name, (), after


def _same(method: Any, node: Any) -> bool:
    """Whether an aggregate node was made by a method, told by where its function was written."""
    probe = method(node.args[0]).extra
    a, b = probe.simple or probe.special, node.extra.simple or node.extra.special
    return a.__code__ is b.__code__ and (probe.simple is None) == (node.extra.simple is None) and _cells(a) == _cells(b)


def _cells(f: Any) -> list:
    return [repr(c.cell_contents) for c in f.__closure__ or ()]
