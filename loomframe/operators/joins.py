"""Joins of two frames: equi-joins of every kind, and as-of joins."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomframe import types as LT
from loomframe.errors import ColumnNotFoundError, InvalidArgumentError, SchemaError
from loomframe.functions.spec import ROW

HOW = {"inner": "inner", "left": "left", "right": "right", "outer": "full_outer", "full": "full_outer", "semi": "left_semi", "anti": "left_anti", "cross": "cross"}
#: Left rows for each bucket of an as-of join, and the most buckets.
BUCKET_ROWS, MAX_BUCKETS = 500_000, 4096
ORDERS = ("none", "left", "right", "left_right", "right_left")


def visible(df: DataFrame) -> list[str]:
    return [c for c in df.columns if not c.startswith(ROW)]


def keys(on: Any, left_on: Any, right_on: Any) -> tuple[list[str], list[str]]:
    many = lambda x: [] if x is None else [x] if isinstance(x, str) else list(x)
    if on is not None and (left_on is not None or right_on is not None):
        raise InvalidArgumentError("give `on`, or `left_on` and `right_on`")
    left, right = (many(on), many(on)) if on is not None else (many(left_on), many(right_on))
    if len(left) != len(right):
        raise InvalidArgumentError("left_on and right_on have the same length")
    return left, right


def kind(t: T.DataType) -> str:
    return "number" if LT.is_number(t) else "time" if LT.is_time(t) else t.typeName()


def check(l: DataFrame, r: DataFrame, left: list[str], right: list[str]) -> None:
    for a, b in zip(left, right):
        for df, c in ((l, a), (r, b)):
            if c not in df.columns:
                raise ColumnNotFoundError(f"no column {c!r} to join on")
        ta, tb = l.schema[a].dataType, r.schema[b].dataType
        if kind(ta) != kind(tb) and not isinstance(ta, T.NullType) and not isinstance(tb, T.NullType):
            raise SchemaError(f"{a} is {ta.simpleString()} and {b} is {tb.simpleString()}")


def names(left: list[str], right: list[str], suffixes: tuple[str, str]) -> tuple[dict, dict]:
    """Output names of both sides' columns: the suffixes where a name is on both sides, numbers where that is taken too."""
    both = set(left) & set(right)
    taken: set[str] = set()
    out: list[dict] = []
    for cols, suffix in ((left, suffixes[0]), (right, suffixes[1])):
        named = {}
        for c in cols:
            new = c + suffix if c in both else c
            k = 1
            while new in taken or (suffix is suffixes[1] and c in both and new in set(right) - both):
                new, k = f"{c}{suffix}_{k}", k + 1
            taken.add(new)
            named[c] = new
        out.append(named)
    return out[0], out[1]


def join(l: DataFrame, r: DataFrame, *, on: Any = None, left_on: Any = None, right_on: Any = None, how: str = "inner", suffixes: tuple[str, str] = ("", "_right"), join_nulls: bool = False, coalesce: bool = True, maintain_order: Any = "none") -> DataFrame:
    """The joined frame; Catalyst picks the strategy and AQE splits skewed keys. See Frame.join."""
    if how not in HOW:
        raise InvalidArgumentError(f"how is one of {', '.join(HOW)}, not {how!r}")
    maintain_order = {True: "left", False: "none", None: "none"}.get(maintain_order, maintain_order)
    if maintain_order not in ORDERS:
        raise InvalidArgumentError(f"maintain_order is one of {', '.join(ORDERS)}")
    left, right = keys(on, left_on, right_on)
    if how == "cross" and left:
        raise InvalidArgumentError("a cross join has no keys")
    if how != "cross" and not left:
        raise InvalidArgumentError("a join needs keys")
    check(l, r, left, right)
    lcols, rcols = visible(l), visible(r)
    lr, rr = ROW in l.columns, ROW in r.columns
    a = l.select(*[F.col(f"`{c}`").alias(f"l{i}") for i, c in enumerate(lcols)], *([F.col(ROW).alias("lrow")] if lr else []))
    b = r.select(*[F.col(f"`{c}`").alias(f"r{i}") for i, c in enumerate(rcols)], *([F.col(ROW).alias("rrow")] if rr else []))
    L, R = {c: F.col(f"l{i}") for i, c in enumerate(lcols)}, {c: F.col(f"r{i}") for i, c in enumerate(rcols)}
    cond = None
    for x, y in zip(left, right):
        same = L[x].eqNullSafe(R[y]) if join_nulls else L[x] == R[y]
        cond = same if cond is None else cond & same
    made = a.crossJoin(b) if how == "cross" else a.join(b, cond, HOW[how])
    if how in ("semi", "anti"):
        return made.select(*[L[c].alias(c) for c in lcols], *([F.col("lrow").alias(ROW)] if lr else []))
    merge = coalesce and how != "cross"
    dropped = set(right) if merge else set()
    lnames, rnames = names(lcols, [c for c in rcols if c not in dropped], suffixes)
    if merge:  # key columns go by their left name
        lnames |= {c: c for c in left if c not in rnames.values()}
    at = dict(zip(left, right))

    def key(c: str):
        """A merged key: both sides' only where either may lack it, else that of the side all rows have, whose partitioning the next operator can use."""
        if l.schema[c].dataType != r.schema[at[c]].dataType or HOW[how] == "full_outer":
            return F.coalesce(L[c], R[at[c]])
        return R[at[c]] if how == "right" else L[c]

    out = [(key(c) if merge and c in at else L[c]).alias(lnames[c]) for c in lcols]
    out += [R[c].alias(rnames[c]) for c in rcols if c not in dropped]
    lrow = F.col("lrow") if lr else F.lit(0).cast("long")
    rrow = F.col("rrow") if rr else F.lit(0).cast("long")
    first, second = (rrow, lrow) if maintain_order.startswith("right") else (lrow, rrow)
    if lr or rr or maintain_order != "none":  # rows without a partner stand last
        out.append(F.struct(first.isNull().alias("a"), first.alias("b"), second.isNull().alias("c"), second.alias("d")).alias(ROW))
    return made.select(*out)


def distance(c: Any, t: T.DataType) -> Any:
    return LT.millis(c, t).cast("double") if LT.is_time(t) else c.cast("double")


def join_asof(l: DataFrame, r: DataFrame, *, on: Any = None, left_on: Any = None, right_on: Any = None, by: Any = None, left_by: Any = None, right_by: Any = None, strategy: str = "backward", tolerance: Any = None, allow_exact_matches: bool = True, coalesce: bool = True, suffixes: tuple[str, str] = ("", "_right"), buckets: int | None = None) -> DataFrame:
    """Each left row with the nearest right row at or before it (backward), after it (forward) or either (nearest; of equals the one before).

    Both sides are united and sorted once by (by, on); the last right row seen is carried over the left
    rows, so no pair of rows is ever formed. The sort is cut into `buckets` ranges of `on` (approximate quantiles of the left side; by default
    one for BUCKET_ROWS left rows, which are counted first), each a task's work, so that one hot key or no key at all is no single task's; what a bucket
    ends with is carried into the next ones by a summary of a row for each bucket.
    """
    if strategy not in ("backward", "forward", "nearest"):
        raise InvalidArgumentError("strategy is backward, forward or nearest")
    (lk,), (rk,) = (x if len(x) == 1 else _one(x) for x in keys(on, left_on, right_on))
    lby, rby = keys(by, left_by, right_by)
    check(l, r, [lk, *lby], [rk, *rby])
    if not LT.is_number(l.schema[lk].dataType) and not LT.is_time(l.schema[lk].dataType):
        raise SchemaError(f"{lk} is neither number nor time")
    lcols, rcols = visible(l), visible(r)
    bys = [f"b{i}" for i in range(len(lby))]
    payload = F.struct(*[F.col(f"`{c}`").alias(f"r{i}") for i, c in enumerate(rcols)])
    r2 = r if ROW in r.columns else r.withColumn(ROW, F.monotonically_increasing_id())
    had_order = ROW in l.columns
    l2 = l if had_order else l.withColumn(ROW, F.monotonically_increasing_id())
    t = l.schema[lk].dataType
    left = l2.select(*[F.col(f"`{c}`").alias(b) for c, b in zip(lby, bys)], F.col(f"`{lk}`").alias("k"), F.lit(None).cast(r2.select(payload.alias("p")).schema[0].dataType).alias("p"), F.struct(*[F.col(f"`{c}`").alias(f"l{i}") for i, c in enumerate(lcols)], F.col(ROW).alias("row")).alias("l"), F.lit(None).cast(r2.schema[ROW].dataType).alias("o"))
    rk_value = F.col(f"`{rk}`").cast(t) if kind(t) == "time" and type(r.schema[rk].dataType) is not type(t) else F.col(f"`{rk}`")
    right = r2.where(F.col(f"`{rk}`").isNotNull()).select(*[F.col(f"`{c}`").alias(b) for c, b in zip(rby, bys)], rk_value.alias("k"), payload.alias("p"), F.lit(None).cast(left.schema["l"].dataType).alias("l"), F.col(ROW).alias("o"))
    both = left.unionByName(right)
    is_left = F.col("l").isNotNull()

    cuts = _cuts(l2, lk, t, buckets if buckets is not None else min(MAX_BUCKETS, -(-l2.count() // BUCKET_ROWS)))
    bucket = F.size(F.filter(F.array(*cuts), lambda c: c <= F.col("k"))) if cuts else F.lit(0)
    both = both.withColumn("bucket", F.when(F.col("k").isNull(), F.lit(-1)).otherwise(bucket))
    rkey = f"r{rcols.index(rk)}"

    def carried(df: DataFrame, forward: bool, out: str) -> DataFrame:
        """df with the last right row before (the first after) each left row, equal keys counted if they may."""
        # nearest prefers an equal key before to one after, so both of its windows can have the order of the first, and one sort does
        right_first = True if strategy == "nearest" and allow_exact_matches else allow_exact_matches != forward
        side = F.when(is_left, F.lit(1 if right_first else 0)).otherwise(F.lit(0 if right_first else 1))
        w = W.partitionBy(*bys, "bucket").orderBy(F.asc_nulls_first("k"), side, F.asc("o"))
        if forward:
            near = F.first("p", ignorenulls=True).over(w.rowsBetween(0, W.unboundedFollowing))
        else:
            near = F.last("p", ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, 0))
        df = df.withColumn(out, near)
        if not cuts:
            return df
        # a row for each bucket of each key: its first or last right row, then that of the nearest bucket that has one
        edge = F.min_by("p", F.struct("k", "o")) if forward else F.max_by("p", F.struct("k", "o"))
        ends = both.where(~is_left).groupBy(*bys, "bucket").agg(edge.alias("e"))
        have = both.select(*bys, "bucket").distinct().join(_same(ends, bys), _matches(bys), "left").drop("bucket_", *[f"{b}_" for b in bys])
        along = W.partitionBy(*bys).orderBy("bucket")
        if forward:
            carry = F.first("e", ignorenulls=True).over(along.rowsBetween(1, W.unboundedFollowing))
        else:
            carry = F.last("e", ignorenulls=True).over(along.rowsBetween(W.unboundedPreceding, -1))
        carry = have.select(*bys, "bucket", carry.alias("carry"))
        joined = df.join(_same(carry, bys), _matches(bys), "left")
        return joined.withColumn(out, F.coalesce(out, "carry")).drop("carry", "bucket_", *[f"{b}_" for b in bys])

    if strategy == "nearest":
        seen = carried(carried(both, False, "bp"), True, "fp").where(is_left)
        db, df_ = (F.abs(distance(F.col("k"), t) - distance(F.col(x)[rkey], r.schema[rk].dataType)) for x in ("bp", "fp"))
        match = F.when(F.col("fp").isNull() | (db <= df_), F.col("bp")).otherwise(F.col("fp"))
        seen = seen.withColumn("m", match)
    else:
        seen = carried(both, strategy == "forward", "m").where(is_left)
    ok = F.col("k").isNotNull()
    if tolerance is not None:
        most = milliseconds(tolerance) if not isinstance(tolerance, (int, float)) else tolerance
        ok = ok & (F.abs(distance(F.col("k"), t) - distance(F.col("m")[rkey], r.schema[rk].dataType)) <= F.lit(float(most)))
    seen = seen.withColumn("m", F.when(ok, F.col("m")))
    dropped = {*rby, *([rk] if coalesce else [])} if coalesce else set()
    lnames, rnames = names(lcols, [c for c in rcols if c not in dropped], suffixes)
    if coalesce:
        lnames |= {c: c for c in (lk, *lby) if c not in rnames.values()}
    out = [F.col("l")[f"l{i}"].alias(lnames[c]) for i, c in enumerate(lcols)]
    out += [F.col("m")[f"r{i}"].alias(rnames[c]) for i, c in enumerate(rcols) if c not in dropped]
    return seen.select(*out, *([F.col("l")["row"].alias(ROW)] if had_order else []))


def _cuts(df: DataFrame, key: str, t: T.DataType, buckets: int) -> list:
    """Up to buckets - 1 values that cut the keys into ranges of about one size, as literals."""
    if buckets <= 1:
        return []
    c = F.col(f"`{key}`")
    asked = [i / buckets for i in range(1, buckets)]
    got = df.select(F.percentile_approx(c.cast("timestamp_ntz") if isinstance(t, T.DateType) else c, asked, max(1000, 4 * buckets))).first()[0]
    return [F.lit(v).cast("timestamp_ntz" if LT.is_time(t) and not isinstance(t, T.TimestampType) else t) for v in sorted(set(got or []))]


def _same(df: DataFrame, bys: list[str]) -> DataFrame:
    """df with its keys renamed, to be joined by _matches."""
    return df.withColumnsRenamed({c: f"{c}_" for c in (*bys, "bucket")})


def _matches(bys: list[str]):
    cond = F.col("bucket") == F.col("bucket_")
    for b in bys:
        cond = cond & F.col(b).eqNullSafe(F.col(f"{b}_"))
    return cond


def _one(x: list) -> list:
    raise InvalidArgumentError("an as-of join has one key besides `by`")


#: Milliseconds of the units of a tolerance such as "2h30m".
UNIT_MS = {"w": 604_800_000, "d": 86_400_000, "h": 3_600_000, "m": 60_000, "s": 1000, "ms": 1}


def milliseconds(tolerance: Any) -> float:
    import datetime
    import re

    if isinstance(tolerance, datetime.timedelta):
        return tolerance.total_seconds() * 1000
    parts = re.findall(r"(\d+(?:\.\d+)?)(ms|[wdhms])", str(tolerance))
    if not parts or "".join(a + b for a, b in parts) != str(tolerance):
        raise InvalidArgumentError(f"{tolerance!r} is no tolerance")
    return sum(float(a) * UNIT_MS[b] for a, b in parts)
