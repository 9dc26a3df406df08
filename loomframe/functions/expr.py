"""Expressions: small trees that become Spark Columns once a frame's schema is known.

A node is a row function, an aggregate, a window function, an explode, or a selector of several
columns. The frame decides what an aggregate becomes: an output of groupBy, a window over the keys
of `over`, or a one-row table joined to every row. Operands that are plain Python values are
literals, strings too; columns are named with col().
"""

from __future__ import annotations

import builtins
import datetime
import decimal
from collections.abc import Callable
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomframe import types as LT
from loomframe.errors import ColumnNotFoundError, InvalidArgumentError
from loomframe.functions.aggregates import Aggregates
from loomframe.functions.scalars import Arithmetic, Comparison, Filling, Logic
from loomframe.functions.spec import ROW, Aggregate
from loomframe.functions.windows import Windows

class Context:
    """What an expression needs to become a Column: the frame it reads, and how rows are ordered."""

    def __init__(self, df: DataFrame, order: Column | None = None):
        self.df, self.order = df, order
        self.element: tuple[Column, T.DataType] | None = None

    def type(self, c: Column) -> T.DataType:
        if self.element is not None and c is self.element[0]:
            return self.element[1]
        return self.df.select(c).schema[0].dataType

    def column(self, name: str) -> Column:
        if name not in self.df.columns:
            raise ColumnNotFoundError(f"no column {name!r}; there are {[c for c in self.df.columns if not c.startswith('__')]}")
        return F.col(f"`{name}`")


class Replay(Context):
    """A context for lambda bodies, whose Columns can't be analysed: types come from a rehearsal on a real column."""

    def __init__(self, base: Context, element: Column, kinds: list[T.DataType]):
        super().__init__(base.df, base.order)
        self.element, self.kinds, self.at = (element, T.NullType()), kinds, 0

    def type(self, c: Column) -> T.DataType:
        self.at += 1
        return self.kinds[self.at - 1]


class Rehearsal(Context):
    def __init__(self, df: DataFrame, element: Column):
        super().__init__(df)
        self.element, self.kinds = (element, self.df.select(element).schema[0].dataType), []

    def type(self, c: Column) -> T.DataType:
        self.kinds.append(super().type(c))
        return self.kinds[-1]


class Expr(Arithmetic, Comparison, Logic, Filling, Aggregates, Windows):
    """An expression; every method gives a new one."""

    def __init__(self, build: Callable | None, args: tuple = (), kind: "str" = "row", name: "str | None" = None, extra: Any = None, keys: tuple | None = None):
        self.build, self.args, self.kind, self._name, self.extra, self.keys = build, tuple(args), kind, name, extra, keys

    # ---- making new nodes

    def _with(self, **changes: Any) -> Expr:
        held = {"build": self.build, "args": self.args, "kind": self.kind, "name": self._name, "extra": self.extra, "keys": self.keys}
        return Expr(**(held | changes))

    def _map(self, build: Callable, *operands: Any) -> Expr:
        """A row function of this expression's Column and the operands'."""
        return Expr(build, (self, *[as_expr(o) for o in operands]))

    def _agg(self, spec: Aggregate, *operands: Any) -> Expr:
        return Expr(None, (self, *[as_expr(o) for o in operands]), "agg", extra=spec)

    def _win(self, fn: Callable, *operands: Any, name: str | None = None) -> Expr:
        """fn(ctx, partition, *columns) gives a Column; partition is the list of key Columns."""
        return Expr(fn, (self, *[as_expr(o) for o in operands]), "win", name=name)

    def alias(self, name: str) -> Expr:
        return self._with(name=name)

    def cast(self, to: Any) -> Expr:
        """Lenient coercion: what doesn't fit is null or held in range, and nothing fails."""
        kind = LT.as_type(to)
        return self._map(lambda ctx, x: LT.lenient(x, ctx.type(x), kind))

    def debug(self, label: str = "") -> Expr:
        """Print the Column that this expression becomes; values pass through."""

        def build(ctx, x):
            print(f"{label or self.name}: {x}")
            return x

        return self._map(build)

    @property
    def name(self) -> str:
        if self._name:
            return self._name
        return self.args[0].name if self.args else "literal"

    # ---- structure

    def walk(self):
        yield self
        for a in self.args:
            yield from a.walk()

    def has(self, *kinds: str) -> bool:
        return any(n.kind in kinds for n in self.walk())

    def replaced(self, fn: Callable[[Expr], Expr]) -> Expr:
        """The tree with fn applied to each node, leaves first."""
        args = tuple(a.replaced(fn) for a in self.args)
        keys = None if self.keys is None else tuple(k.replaced(fn) for k in self.keys)
        old = (*self.args, *(self.keys or ()))
        same = builtins.all(a is b for a, b in zip((*args, *(keys or ())), old))
        return fn(self if same else self._with(args=args, keys=keys))

    def column(self, ctx: Context) -> Column:
        """The Column of a tree without aggregates, windows and selectors left in it."""
        if self.kind == "element":
            if ctx.element is None:
                raise InvalidArgumentError("element() only has a meaning inside a list")
            return ctx.element[0]
        if self.kind in ("agg", "win", "sel"):
            raise InvalidArgumentError(f"{self.name}: an aggregate or window can't stand here")
        return self.build(ctx, *[a.column(ctx) for a in self.args])

    # ---- families with names of their own

    @property
    def str(self):
        from loomframe.functions.strings import Strings

        return Strings(self)

    @property
    def dt(self):
        from loomframe.functions.temporal import Temporal

        return Temporal(self)

    @property
    def arr(self):
        from loomframe.functions.lists import Lists

        return Lists(self)

    @property
    def struct(self):
        from loomframe.functions.structs import Structs

        return Structs(self)

    def __bool__(self) -> bool:
        raise TypeError("an expression has no truth value; use &, | and ~")

    __hash__ = object.__hash__


def literal(v: Any) -> Column:
    """A Python value as a Column."""
    if isinstance(v, (list, tuple)):
        return F.array(*[literal(x) for x in v]) if v else F.array().cast("array<string>")
    if isinstance(v, dict):
        return F.struct(*[literal(x).alias(k) for k, x in v.items()])
    if isinstance(v, datetime.datetime) and v.tzinfo is None:
        return F.lit(v.isoformat(sep=" ")).cast("timestamp_ntz")
    if isinstance(v, datetime.timedelta):
        return F.lit(v.total_seconds() * 1000)
    if isinstance(v, decimal.Decimal) or v is None or isinstance(v, (int, float, str, bool, bytes, datetime.date)):
        return F.lit(v)
    return F.lit(v)


def as_expr(v: Any) -> Expr:
    """v, or a literal of it."""
    return v if isinstance(v, Expr) else Expr(lambda ctx: literal(v), name="literal", extra=("lit", v))


def named(v: Any) -> Expr:
    """v, or the column that the string v names."""
    if isinstance(v, str):
        return column(v)
    return as_expr(v)


def column(name: str) -> Expr:
    return Expr(lambda ctx: ctx.column(name), name=name, extra=("col", name))


def selector(pick: Callable[[T.StructType], list[str]]) -> Expr:
    """An expression for each of the columns that pick chooses from a schema."""
    return Expr(None, kind="sel", extra=pick)


def expanded(e: Expr, schema: T.StructType) -> list[Expr]:
    """One expression for each column that the selectors in e choose; e itself without selectors."""
    found = next((n for n in e.walk() if n.kind == "sel"), None)
    if found is None:
        return [e]
    pick = found.extra
    out = []
    for c in pick(schema):
        out.append(e.replaced(lambda n, c=c: column(c)._with(name=n._name or c) if n.kind == "sel" and n.extra is pick else n))
    return [y for x in out for y in expanded(x, schema)]


# ---- aggregates and windows become columns


class Plan:
    """Turns expressions over a frame into Columns, adding helper columns (slots) to the frame where windows and aggregates need them."""

    def __init__(self, df: DataFrame, order: Callable[[DataFrame], tuple[DataFrame, Column]]):
        """order(df): df with an order column attached if it had none, and that column."""
        self.df, self._order, self.order_column = df, order, None
        self.n = 0

    def slot(self) -> str:
        self.n += 1
        return f"__loomframe_s{self.n}_{id(self) % 100000}"

    def need_order(self) -> Column:
        if self.order_column is None:
            self.df, self.order_column = self._order(self.df)
        return self.order_column

    def context(self) -> Context:
        return Context(self.df, self.order_column)

    def rows(self, exprs: list[Expr]) -> list[Column]:
        """Row-level Columns of the expressions; aggregates without `over` are those of the whole frame."""
        globals_ = {id(n): n for e in exprs for n in e.walk() if n.kind == "agg" and n.keys is None}
        if globals_:
            one, slots = self.grouped(list(globals_.values()), [])
            self.df = self.df.crossJoin(F.broadcast(one))  # one row
            refs = dict(zip(globals_, slots))
            exprs = [e.replaced(lambda n: n) if not e.has("agg") else _swap(e, refs) for e in exprs]
        done = [self._windows(e) for e in exprs]
        ctx = self.context()
        return [e.column(ctx) for e in done]

    def _windows(self, e: Expr) -> Expr:
        if not e.has("agg", "win"):
            return e
        args = tuple(self._windows(a) for a in e.args)
        keys = None if e.keys is None else tuple(self._windows(k) for k in e.keys)
        e = e._with(args=args, keys=keys)
        if e.kind == "win" and e.extra in ("reverse", "row_number") and not e.keys:
            return self._positions(e)
        if e.kind == "win" and isinstance(e.extra, tuple) and e.extra[0] == "list":
            return self._in_lists(e)
        if e.kind == "win":
            order_needed = getattr(e.build, "ordered", True)
            if order_needed:
                self.need_order()
            ctx = self.context()
            parts = [k.column(ctx) for k in e.keys or ()]
            value = e.build(ctx, parts, *[a.column(ctx) for a in e.args])
            return self._keep(value, e)
        if e.kind == "agg":
            spec = e.extra
            if spec.ordered:
                self.need_order()
            if spec.simple and spec.windowed:
                from pyspark.sql import Window

                ctx = self.context()
                w = Window.partitionBy(*[k.column(ctx) for k in e.keys])
                return self._keep(spec.simple(ctx, *[a.column(ctx) for a in e.args]).over(w), e)
            names = []
            for k in e.keys:
                names.append(self.slot())
                self.df = self.df.withColumn(names[-1], k.column(self.context()))
            table, (out,) = self.grouped([e._with(keys=None)], names)
            table = table.select(*[F.col(k).alias(f"{k}k") for k in names], out)
            cond = None
            for k in names:
                c = F.col(k).eqNullSafe(F.col(f"{k}k"))
                cond = c if cond is None else cond & c
            self.df = self.df.join(table, cond, "left").drop(*[f"{k}k" for k in names])
            return column(out)._with(name=e.name)
        return e

    def _positions(self, e: Expr) -> Expr:
        """Row numbers and mirrored values over the whole frame, without a window over one partition."""
        from loomframe.operators.order import indexed

        if e.extra == "reverse" and e.keys is not None:
            raise InvalidArgumentError("reverse takes no partition; reverse a list with arr.reverse")
        at, out = self.slot(), self.slot()
        self.df = indexed(self.df, at)
        if e.extra == "row_number":
            self.df = self.df.withColumn(out, F.col(at) + 1)
        else:
            n = self.df.count()
            mirror = self.df.select((F.lit(n - 1) - F.col(at)).alias(f"{at}m"), e.args[0].column(self.context()).alias(out))
            self.df = self.df.withColumnRenamed(at, f"{at}f").join(mirror, F.col(f"{at}f") == F.col(f"{at}m"))
        return column(out)._with(name=e.name)

    def _in_lists(self, e: Expr) -> Expr:
        """An expression with windows over each list: elements as rows, windows by list and position, and lists again."""
        row, items, whole, at, out = (self.slot() for _ in range(5))
        names = self.df.columns
        df = self.df.withColumn(items, e.args[0].column(self.context())).withColumn(whole, F.struct(*[F.col(f"`{c}`") for c in names]))
        # one pass, no join: a row's id is made once, before the only shuffle
        df = df.withColumn(row, F.monotonically_increasing_id())
        each = df.select(row, whole, items, F.posexplode_outer(items).alias(at, "__loomframe_element")).withColumn(ROW, F.col(at))
        inner = Plan(each, lambda d: (d, F.col(ROW)))

        def bound(n: Expr) -> Expr:
            if n.kind == "element":
                return column("__loomframe_element")
            return n._with(keys=(column(row),)) if n.kind in ("win", "agg") and n.keys is None else n

        (value,) = inner.rows([e.extra[1].replaced(bound)])
        made = inner.df.select(row, whole, items, F.struct(F.col(at).alias("at"), value.alias("v")).alias("s"))
        made = made.groupBy(row).agg(F.first(whole).alias(whole), F.first(F.size(items)).alias(at), F.transform(F.array_sort(F.collect_list("s")), lambda x: x["v"]).alias(out))
        kept_list = F.when(F.col(at) > 0, F.col(out)).when(F.col(at) == 0, F.slice(out, 1, 0))
        self.df = made.select(*[F.col(whole)[c].alias(c) for c in names], kept_list.alias(out))
        return column(out)._with(name=e.name)

    def _keep(self, value: Column, e: Expr) -> Expr:
        name = self.slot()
        self.df = self.df.withColumn(name, value)
        return column(name)._with(name=e.name)

    def grouped(self, nodes: list[Expr], keys: list[str]) -> tuple[DataFrame, list[str]]:
        """A frame of the key columns and one slot for each aggregate node; one row without keys."""
        inner, slots, special, simple = [], [], [], []
        for n in nodes:
            inner.append(n._with(args=tuple(self._windows(a) for a in n.args)))
        if any(n.extra.ordered or n.extra.special for n in inner):
            self.need_order()
        ctx = self.context()
        for n in inner:
            out = self.slot()
            slots.append(out)
            if n.extra.simple:
                simple.append(n.extra.simple(ctx, *[a.column(ctx) for a in n.args]).alias(out))
            else:
                special.append((n, out))
        base = self.df
        if simple:
            table = base.groupBy(*keys).agg(*simple) if keys else base.agg(*simple)
        else:
            table = base.select(*keys).distinct() if keys else base.agg(F.count(F.lit(1)).alias("__loomframe_n")).drop("__loomframe_n")
        for n, out in special:
            cols = [self.slot() for _ in n.args]
            order = self.slot()
            part = base.select(*keys, *[a.column(ctx).alias(c) for a, c in zip(n.args, cols)], self.order_column.alias(order))
            more = n.extra.special(part, keys, cols, order, out)
            if keys:
                more = more.select(*[F.col(k).alias(f"{k}__j") for k in keys], out)
                cond = None
                for k in keys:
                    c = F.col(f"`{k}`").eqNullSafe(F.col(f"`{k}__j`"))
                    cond = c if cond is None else cond & c
                table = table.join(more, cond, "left").drop(*[f"{k}__j" for k in keys])
                if n.extra.empty is not None:
                    table = table.withColumn(out, F.coalesce(F.col(out), F.lit(n.extra.empty)))
            else:
                table = table.crossJoin(F.broadcast(more.agg(F.first(out, True).alias(out))))
        return table, slots


def _swap(e: Expr, refs: dict[int, str]) -> Expr:
    """e with its global aggregate nodes replaced by their slots."""
    if id(e) in refs:
        return column(refs[id(e)])._with(name=e.name)
    args = tuple(_swap(a, refs) for a in e.args)
    keys = None if e.keys is None else tuple(_swap(k, refs) for k in e.keys)
    return e._with(args=args, keys=keys)
