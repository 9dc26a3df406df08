"""Frame: a Spark DataFrame with the expression API. Every method gives a new frame.

Nothing runs before rows are asked for, with these exceptions, which have to know rows to make their plan: row positions (`with_row_index`, `slice`,
`reverse`, `gather`, `item`, horizontal concat, `row_number` without `over`) store the ordered rows, as-of joins count the left side, `pivot` without
`columns` finds them, negative positions need the height, `transpose` and `arr.to_struct` read what becomes columns.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomframe import types as LT
from loomframe.errors import ColumnNotFoundError, InvalidArgumentError, SchemaError, ShapeError
from loomframe.functions.expr import Expr, Plan, as_expr, column, expanded, named
from loomframe.functions.spec import ROW
from loomframe.operators import joins, reshape
from loomframe.operators.order import indexed, with_order


def flat(args: Any) -> list:
    return [y for x in args for y in (flat(x) if isinstance(x, (list, tuple)) else [x])]


class Frame:
    def __init__(self, df: DataFrame):
        self._df = df

    # ---- what it is

    @property
    def df(self) -> DataFrame:
        """The Spark DataFrame, without the hidden order column."""
        return self._df.drop(ROW) if ROW in self._df.columns else self._df

    @property
    def columns(self) -> list[str]:
        return joins.visible(self._df)

    @property
    def schema(self) -> dict[str, LT.DataType]:
        return {f.name: LT.of_spark(f.dataType) for f in self.df.schema.fields}

    @property
    def dtypes(self) -> list[LT.DataType]:
        return list(self.schema.values())

    @property
    def width(self) -> int:
        return len(self.columns)

    @property
    def height(self) -> int:
        """Rows; runs a job."""
        return self._df.count()

    @property
    def shape(self) -> tuple[int, int]:
        return self.height, self.width

    def clone(self) -> Frame:
        return Frame(self._df)

    def explain(self, mode: str = "formatted") -> None:
        self.df.explain(mode)

    def __repr__(self) -> str:
        return f"Frame[{', '.join(f'{f.name}: {f.dataType.simpleString()}' for f in self.df.schema.fields)}]"

    def show(self, n: int = 20) -> None:
        self._sorted().drop(ROW).show(n)

    # ---- order

    def order_by(self, *names: str) -> Frame:
        """Rows taken in the order of these columns (a unique key makes it certain); nothing is sorted yet."""
        self._need(names)
        return Frame(self._df.drop(ROW).withColumn(ROW, F.struct(*[F.col(f"`{n}`") for n in names])))

    def _ordered(self) -> DataFrame:
        return with_order(self._df)[0]

    def _sorted(self) -> DataFrame:
        return self._df.orderBy(ROW) if ROW in self._df.columns else self._df

    def _need(self, names: Any) -> None:
        for n in names:
            if n not in self.columns:
                raise ColumnNotFoundError(f"no column {n!r}; there are {self.columns}")

    def _plan(self) -> Plan:
        return Plan(self._df, with_order)

    def _keep_row(self, df: DataFrame) -> list[Column]:
        return [F.col(ROW)] if ROW in df.columns else []

    # ---- projection

    def _outputs(self, args: tuple, kwargs: dict | None = None) -> list[Expr]:
        out: list[Expr] = []
        for a in flat(args):
            if isinstance(a, dict):
                out += [as_expr(v).alias(k) for k, v in a.items()]
            else:
                out += expanded(named(a), self.df.schema)
        return out + [as_expr(v).alias(k) for k, v in (kwargs or {}).items()]

    def select(self, *args: Any, **kwargs: Any) -> Frame:
        """Columns, expressions, or name: expression. Aggregates and literals only: one row; with others: the aggregate on every row."""
        exprs = self._outputs(args, kwargs)
        seen: set[str] = set()
        for e in exprs:
            if e.name in seen and e.kind != "unnest":
                raise SchemaError(f"two outputs are called {e.name!r}")
            seen.add(e.name)
        if exprs and any(e.has("agg") for e in exprs) and all(_constant(e) for e in exprs):
            return self._aggregate(exprs)
        return self._project(exprs, [])

    def with_columns(self, *args: Any, **kwargs: Any) -> Frame:
        """Columns added, or set anew in their place; of two with one name the later counts."""
        exprs = list({e.name: e for e in self._outputs(args, kwargs)}.values())
        new = {e.name: e for e in exprs}
        have = self.columns
        full = [new.get(c, column(c)) for c in have] + [e for e in exprs if e.name not in have]
        return self._project(full, [])

    def _project(self, exprs: list[Expr], extra: list[Column]) -> Frame:
        plan = self._plan()
        exploded = [e for e in exprs if e.kind == "explode"]
        inner = [e.args[0] if e.kind in ("explode", "unnest") else e for e in exprs]
        cols = plan.rows(inner)
        out = []
        for e, c in zip(exprs, cols):
            if e.kind == "unnest":
                t = plan.df.select(c).schema[0].dataType
                out += [c.getField(f).alias(f) for f in t.fieldNames()]
            else:
                out.append(c.alias(e.name))
        made = plan.df.select(*out, *self._keep_row(plan.df), *extra)
        frame = Frame(made)
        if exploded:
            empty, nulls = exploded[0].extra
            frame = frame.explode([e.name for e in exploded], empty_as_null=empty, keep_nulls=nulls)
        return frame

    def _aggregate(self, exprs: list[Expr]) -> Frame:
        plan = self._plan()
        nodes = {id(n): n for e in exprs for n in e.walk() if n.kind == "agg"}
        table, slots = plan.grouped(list(nodes.values()), [])
        refs = dict(zip(nodes, slots))
        from loomframe.functions.expr import Context, _swap

        ctx = Context(table)
        return Frame(table.select(*[_swap(e, refs).column(ctx).alias(e.name) for e in exprs]))

    def insert_column(self, index: int, name: str, expr: Any) -> Frame:
        have = self.columns
        at = index if index >= 0 else len(have) + index
        if not 0 <= at <= len(have):
            raise InvalidArgumentError(f"no place {index} among {len(have)} columns")
        if name in have:
            raise SchemaError(f"there is a column {name!r}")
        return self._project([*[column(c) for c in have[:at]], as_expr(expr).alias(name), *[column(c) for c in have[at:]]], [])

    def drop(self, *names: Any) -> Frame:
        return Frame(self._df.drop(*[n for n in flat(names) if n in self.columns]))

    def rename(self, mapping: dict[str, str] | None = None) -> Frame:
        mapping = mapping or {}
        self._need(mapping)
        new = [mapping.get(c, c) for c in self.columns]
        if len(set(new)) != len(new):
            raise SchemaError(f"two columns would be called the same: {new}")
        return Frame(self._df.withColumnsRenamed(mapping))

    def with_row_index(self, name: str = "index", offset: int = 0) -> Frame:
        if name in self.columns:
            raise SchemaError(f"there is a column {name!r}")
        df = indexed(self._df, "__loomframe_index")
        keep = self.columns
        return Frame(df.select((F.col("__loomframe_index") + offset).alias(name), *[F.col(f"`{c}`") for c in keep], F.col("__loomframe_index").alias(ROW)))

    # ---- rows

    def filter(self, *predicates: Any) -> Frame:
        """Rows for which every predicate is true.

        A Python function of a row (a dict) is called row by row in Python workers: tens of times slower than an expression, and
        nothing of it reaches the scan. It sees NaN as None.
        """
        out = self
        calls = [p for p in flat(predicates) if callable(p) and not isinstance(p, Expr)]
        exprs = [x for p in flat(predicates) if not (callable(p) and not isinstance(p, Expr)) for x in expanded(named(p), self.df.schema)]
        if exprs:
            from loomframe.functions.scalars import truth

            plan = out._plan()
            cols = plan.rows(exprs)
            ctx = plan.context()
            test = None
            for c in cols:
                t = c if isinstance(ctx.type(c), T.BooleanType) else truth(ctx, c)
                test = t if test is None else test & t
            keep = out._df.columns + ([ROW] if ROW in plan.df.columns and ROW not in out._df.columns else [])
            out = Frame(plan.df.where(test).select(*[F.col(f"`{c}`") for c in keep]))
        for fn in calls:
            names = out.columns

            @F.pandas_udf(T.BooleanType())
            def test_rows(frame, fn=fn):
                return frame.apply(lambda r: bool(fn({k: (None if r[k] is None or r[k] != r[k] else r[k]) for k in frame.columns})), axis=1).astype(bool) if len(frame) else frame.iloc[:, 0].astype(bool)

            out = Frame(out._df.where(test_rows(F.struct(*[F.col(f"`{n}`") for n in names]))))
        return out

    def drop_nulls(self, subset: Any = None) -> Frame:
        names = self.columns if subset is None else flat([subset])
        self._need(names)
        test = F.lit(True)
        for n in names:
            test = test & F.col(f"`{n}`").isNotNull()
        return Frame(self._df.where(test))

    def fill_null(self, value: Any = None, strategy: str | None = None, limit: int | None = None) -> Frame:
        if value is not None:
            kinds = {f.name: f.dataType for f in self.df.schema.fields}
            fits = [c for c in self.columns if isinstance(value, Expr) or LT.is_number(kinds[c]) == (isinstance(value, (int, float)) and not isinstance(value, bool)) and isinstance(kinds[c], T.StringType) == isinstance(value, str)]
            return self.with_columns(*[column(c).fill_null(value) for c in fits])
        numeric = strategy in ("mean", "zero", "one")
        names = [f.name for f in self.df.schema.fields if not numeric or LT.is_number(f.dataType)]
        return self.with_columns(*[column(c).fill_null(None, strategy, limit) for c in names])

    def unique(self, columns: Any = None) -> Frame:
        """The first row of each key (of all columns by default). Without an order any row of a key may stand for it."""
        names = self.columns if columns is None else flat([columns])
        self._need(names)
        if ROW not in self._df.columns:
            return Frame(self._df.dropDuplicates(names))
        others = [c for c in self._df.columns if c not in names]
        # the first row of a key is a partial aggregate, so a hot key is no single task's
        first = self._df.groupBy(*[F.col(f"`{n}`") for n in names]).agg(F.min_by(F.struct(*[F.col(f"`{c}`") for c in others]), F.col(ROW)).alias("__loomframe_first"))
        return Frame(first.select(*[(F.col(f"`{c}`") if c in names else F.col("__loomframe_first")[c].alias(c)) for c in self._df.columns]))

    def sort(self, by: Any = None, *, descending: Any = False, nulls_last: Any = True, custom: dict[str, Callable] | None = None) -> Frame:
        """Stable sort; nulls last in both directions by default. custom: for a column a function from value to sort key, run as an Arrow UDF."""
        names = self.columns if by is None else flat([by])
        exprs = [named(b) for b in names]
        down = descending if isinstance(descending, (list, tuple)) else [descending] * len(exprs)
        last = nulls_last if isinstance(nulls_last, (list, tuple)) else [nulls_last] * len(exprs)
        plan = self._plan()
        cols = plan.rows(exprs)
        keep = plan.df.columns if ROW in plan.df.columns else self._df.columns
        keep = [c for c in keep if not c.startswith("__loomframe_s")]
        order = []
        for e, c, d, z in zip(exprs, cols, down, last):
            if custom and e.name in custom:
                fn = custom[e.name]
                kind = T.DoubleType()

                @F.pandas_udf(kind)
                def key(s, fn=fn):
                    return s.map(lambda v: float(fn(v)))

                c = key(c)
            order.append((c.desc_nulls_last() if z else c.desc_nulls_first()) if d else (c.asc_nulls_last() if z else c.asc_nulls_first()))
        had = ROW in self._df.columns
        df = plan.df.orderBy(*order, *([F.col(ROW)] if had else []))
        made = df.select(*[F.col(f"`{c}`") for c in keep if c != ROW])
        # the sorted order is the new row order: ids of sorted partitions ascend
        return Frame(made.withColumn(ROW, F.monotonically_increasing_id()))

    def top_k(self, k: int, by: Any, *, descending: bool = True) -> Frame:
        """The k first rows by a sort, without a full sort."""
        exprs = [named(b) for b in flat([by])]
        plan = self._plan()
        cols = plan.rows(exprs)
        order = [c.desc_nulls_last() if descending else c.asc_nulls_last() for c in cols]
        return Frame(plan.df.orderBy(*order).limit(k).select(*[F.col(f"`{c}`") for c in self._df.columns]))

    def reverse(self) -> Frame:
        df = indexed(self._df, "__loomframe_i")
        keep = [c for c in self.columns]
        return Frame(df.select(*[F.col(f"`{c}`") for c in keep], (-F.col("__loomframe_i")).alias(ROW)))

    def limit(self, n: int, *, offset: int = 0, from_: str = "start") -> Frame:
        if n < 0 or offset < 0 or from_ not in ("start", "end"):
            raise InvalidArgumentError("n and offset are 0 or more; from_ is start or end")
        if from_ == "start":
            df = self._sorted()
            return Frame((df.offset(offset) if offset else df).limit(n))
        df = self._ordered()
        tail = df.orderBy(F.desc(ROW))
        return Frame((tail.offset(offset) if offset else tail).limit(n).orderBy(ROW))

    def head(self, n: int = 10) -> Frame:
        return self.limit(max(0, n)) if n >= 0 else self.slice(0, n)

    def tail(self, n: int = 10) -> Frame:
        return self.limit(max(0, n), from_="end")

    def slice(self, start: int, end: int | None = None) -> Frame:
        """Rows from start up to end; negative ones count from the end."""
        df = indexed(self._df, "__loomframe_i")
        n = df.count() if start < 0 or (end or 0) < 0 else None
        lo = max(0, n + start) if start < 0 else start
        hi = None if end is None else max(0, n + end) if end < 0 else end
        test = F.col("__loomframe_i") >= lo
        if hi is not None:
            test = test & (F.col("__loomframe_i") < hi)
        return Frame(df.where(test).select(*[F.col(f"`{c}`") for c in self.columns], F.col("__loomframe_i").alias(ROW)))

    # ---- groups

    def groupby(self, *keys: Any) -> Grouped:
        return Grouped(self, [named(k) for k in flat(keys)])

    group_by = groupby

    # ---- several frames

    def join(self, other: Frame, **options: Any) -> Frame:
        """inner, left, right, outer, semi, anti, cross. on, or left_on and right_on; suffixes ("", "_right") where names meet.

        join_nulls: null keys match each other. coalesce (default): one key column under its left name. maintain_order: none, left, right, left_right, right_left.
        """
        order = options.get("maintain_order") not in (None, False, "none")
        return Frame(joins.join(self._ordered() if order else self._df, other._ordered() if order else other._df, **options))

    def join_asof(self, other: Frame, *, check_sorted: bool = False, **options: Any) -> Frame:
        """strategy backward, forward or nearest; by; tolerance (a number, a timedelta or "2h"); allow_exact_matches. Sides need not be sorted."""
        if check_sorted:
            for f, k in ((self, options.get("left_on") or options.get("on")), (other, options.get("right_on") or options.get("on"))):
                if not f._ascending(k):
                    raise InvalidArgumentError(f"{k} is not in ascending order")
        return Frame(joins.join_asof(self._df, other._df, **options))

    def _ascending(self, key: str) -> bool:
        from pyspark.sql import Window

        df = indexed(self._df, "__loomframe_i").where(F.col(f"`{key}`").isNotNull())
        runs = df.withColumn("__loomframe_b", F.floor(F.col("__loomframe_i") / 100_000))
        w = Window.partitionBy("__loomframe_b").orderBy("__loomframe_i")
        inside = runs.withColumn("__loomframe_p", F.lag(F.col(f"`{key}`")).over(w)).where(F.col("__loomframe_p") > F.col(f"`{key}`")).limit(1).count()
        ends = [tuple(r) for r in runs.groupBy("__loomframe_b").agg(F.min(f"`{key}`"), F.max(f"`{key}`")).orderBy("__loomframe_b").collect()]
        return not inside and all(a[2] <= b[1] for a, b in zip(ends, ends[1:]))

    def concat(self, *others: Any, how: str = "vertical", strict: bool = True) -> Frame:
        from loomframe.operators.concat import concat

        return concat([self, *flat(others)], how=how, strict=strict)

    def vstack(self, *others: Any) -> Frame:
        return self.concat(*others)

    def hstack(self, *others: Any, strict: bool = True) -> Frame:
        return self.concat(*others, how="horizontal", strict=strict)

    # ---- shape

    def explode(self, columns: Any, *, empty_as_null: bool = True, keep_nulls: bool = True, position: str | None = None) -> Frame:
        """A row for each element of the lists; position names a new column of their places, from 0."""
        names = [c if isinstance(c, str) else c.name for c in flat([columns])]
        self._need(names)
        return Frame(reshape.explode(self._df, names, empty_as_null, keep_nulls, position))

    def unnest(self, *columns: str) -> Frame:
        return self.select(*[column(c).struct.unnest() if c in columns else column(c) for c in self.columns])

    def pivot(self, *, on: str, index: Any, values: str, columns: list | None = None) -> Frame:
        """One row for each index, one column for each value of `on` in order of first appearance; of several values the last.

        columns: the values of `on`, which saves the job that finds them.
        """
        names = flat([index])
        self._need([on, values, *names])
        return Frame(reshape.pivot(self._ordered(), on, names, values, columns))

    def unpivot(self, *, index: Any = (), on: Any = None, variable_name: str = "variable", value_name: str = "value") -> Frame:
        ids = flat([index])
        many = [c for c in self.columns if c not in ids] if on is None else flat([on])
        self._need([*ids, *many])
        return Frame(reshape.unpivot(self._df, ids, many, variable_name, value_name))

    melt = unpivot

    def transpose(self, *, include_header: bool = False, header_name: str = "column", column_names: Any = None, max_rows: int = 10_000) -> Frame:
        return Frame(reshape.transpose(self._sorted().drop(ROW), include_header, header_name, column_names, max_rows))

    def find(self, predicate: Any) -> dict | None:
        """The first row for which the predicate is true."""
        rows = self.filter(predicate).limit(1).to_dicts()
        return rows[0] if rows else None

    def gather(self, indices: Any) -> Frame:
        """Rows at positions, in the order given."""
        at = [indices] if isinstance(indices, int) else list(indices)
        df = indexed(self._df, "__loomframe_i")
        if any(i < 0 for i in at):
            n = df.count()
            at = [i + n if i < 0 else i for i in at]
        wanted = df.sparkSession.createDataFrame([(i, k) for k, i in enumerate(at)], "i long, k long")
        return Frame(df.join(F.broadcast(wanted), F.col("__loomframe_i") == F.col("i")).select(*[F.col(f"`{c}`") for c in self.columns], F.col("k").alias(ROW)))

    def implode(self) -> Frame:
        return self.select(*[column(c).implode() for c in self.columns])

    # ---- results on the driver

    def to_dicts(self) -> list[dict]:
        return [r.asDict(recursive=True) for r in self._sorted().drop(ROW).collect()]

    def to_dict(self) -> dict[str, list]:
        rows = self._sorted().drop(ROW).collect()
        return {c: [r[i] for r in rows] for i, c in enumerate(self.columns)}

    def to_pandas(self) -> Any:
        return self._sorted().drop(ROW).toPandas()

    def to_array(self, expr: Any) -> list:
        return [r[0] for r in self.select(named(expr).alias("v"))._sorted().drop(ROW).collect()]

    def item(self, row: int | None = None, col: Any = None) -> Any:
        if row is None and col is None:
            rows = self.limit(2).to_dicts()
            if len(rows) != 1 or self.width != 1:
                raise ShapeError("item() needs a frame of one cell")
            return next(iter(rows[0].values()))
        name = self.columns[col] if isinstance(col, int) else col if col is not None else self.columns[0]
        self._need([name])
        got = self.slice(row or 0, None if row == -1 else (row or 0) + 1).to_dicts()
        if not got:
            raise InvalidArgumentError(f"no row {row}")
        return got[0][name]

    def iter_rows(self, *, named: bool = False) -> Iterator:
        """Rows one after the other, a partition at a time."""
        for r in self._sorted().drop(ROW).toLocalIterator():
            yield r.asDict(recursive=True) if named else tuple(r)

    def iter_columns(self) -> Iterator[list]:
        for c in self.columns:
            yield self.to_array(c)

    # ---- sinks

    def write_csv(self, path: str | None = None, **options: Any) -> str:
        from loomframe.sources.csv import write_csv

        return write_csv(self, path, **options)

    def write_json(self, path: str | None = None, **options: Any) -> str:
        from loomframe.sources.json import write_json

        return write_json(self, path, **options)

    def write_parquet(self, path: str, *, partition_by: Any = (), mode: str = "error") -> None:
        self.df.write.mode(mode).partitionBy(*flat([partition_by])).parquet(path)


def _constant(e: Expr) -> bool:
    """Whether a value is the same for all rows: made of aggregates and literals."""
    if e.kind == "agg" and e.keys is None:
        return True
    if e.kind in ("win", "agg", "explode", "unnest", "sel"):
        return False
    if isinstance(e.extra, tuple) and e.extra and e.extra[0] == "lit":
        return True
    return bool(e.args) and all(_constant(a) for a in e.args)


class Grouped:
    """Rows by keys; null is a key of its own."""

    def __init__(self, frame: Frame, keys: list[Expr]):
        if not keys:
            raise InvalidArgumentError("groupby takes a key or more")
        self.frame = frame
        self.keys = [x for k in keys for x in expanded(k, frame.df.schema)]

    def to_dataframe(self) -> Frame:
        """The different keys, in order of first appearance."""
        return self.agg()

    def agg(self, *args: Any, **kwargs: Any) -> Frame:
        """One row for each group, in order of first appearance where the frame has an order.

        What stands before an aggregate is computed on rows, what stands after it on groups; expressions without an
        aggregate see the outputs before them.
        """
        frame = self.frame
        exprs: list[Expr] = []
        key_names = [k.name for k in self.keys]
        rest = T.StructType([f for f in frame.df.schema.fields if f.name not in key_names])
        for a in flat(args):
            if isinstance(a, dict):
                exprs += [as_expr(v).alias(k) for k, v in a.items()]
            else:
                exprs += expanded(named(a), rest)
        exprs += [as_expr(v).alias(k) for k, v in kwargs.items()]
        names = [*key_names, *[e.name for e in exprs]]
        if len(set(names)) != len(names):
            raise SchemaError(f"two outputs are called the same: {names}")
        plan = frame._plan()
        key_cols = plan.rows(self.keys)
        slots = []
        for c in key_cols:
            slots.append(plan.slot())
            plan.df = plan.df.withColumn(slots[-1], c)
        nodes = {id(n): n for e in exprs for n in e.walk() if n.kind == "agg" and n.keys is None}
        listed = list(nodes.values())
        had = ROW in plan.df.columns
        if had:
            listed.append(_first_row())
        table, out = plan.grouped(listed, slots)
        from loomframe.functions.expr import Context, _swap

        refs = dict(zip(nodes, out))
        done = table.select(*[F.col(s).alias(k) for s, k in zip(slots, key_names)], *[F.col(o) for o in out])
        for e in exprs:
            done = done.withColumn(e.name, _swap(e, refs).column(Context(done)))
        keep = [F.col(f"`{n}`") for n in names]
        return Frame(done.select(*keep, *([F.col(out[-1]).alias(ROW)] if had else [])))


def _first_row() -> Expr:
    from loomframe.functions.spec import Aggregate

    return Expr(None, (), "agg", extra=Aggregate(lambda ctx: F.min(F.col(ROW))))
