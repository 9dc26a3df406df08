"""Explode, pivot, unpivot, transpose."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomframe.errors import InvalidArgumentError, SchemaError, ShapeError
from loomframe.functions.spec import ROW


#: Most columns that a pivot finds for itself: each is an aggregate of its own.
MAX_PIVOT = 10_000


def explode(df: DataFrame, names: list[str], empty_as_null: bool = True, keep_nulls: bool = True, position: str | None = None) -> DataFrame:
    """A row for each element of the lists in `names`, which have one length in each row; columns that are no lists stay. position: a new column of places in the list, from 0."""
    if position in df.columns:
        raise SchemaError(f"there is a column {position!r}")
    lists = [n for n in names if isinstance(df.schema[n].dataType, T.ArrayType)]
    if not lists:
        return df
    first = F.col(f"`{lists[0]}`")
    sizes = [F.coalesce(F.size(F.col(f"`{n}`")), F.lit(-1)) for n in lists]
    if len(lists) > 1:
        same = F.lit(True)
        for s in sizes[1:]:
            same = same & (s == sizes[0])
        df = df.where(F.when(same, F.lit(True)).otherwise(F.raise_error(F.lit("lists exploded together differ in length")).cast("boolean")))
    if not keep_nulls:
        df = df.where(first.isNotNull())
    if not empty_as_null:
        df = df.where(first.isNull() | (F.size(first) > 0))
    one = len(lists) == 1
    made = first if one else F.arrays_zip(*[F.col(f"`{n}`") for n in lists])
    keep = [F.col(f"`{c}`") for c in df.columns if c not in lists]
    if ROW in df.columns or position:
        packed = df.select(*keep, F.posexplode_outer(made).alias("__loomframe_pos", "__loomframe_item"))
    else:
        packed = df.select(*keep, F.explode_outer(made).alias("__loomframe_item"))
    cell = F.col("__loomframe_item")
    out = [(cell if one else cell.getField(c)).alias(c) if c in lists else F.col(f"`{c}`") for c in df.columns if c != ROW]
    if position:
        out.append(F.col("__loomframe_pos").cast("long").alias(position))
    if ROW in df.columns:
        out.append(F.struct(F.col(ROW).alias("a"), F.col("__loomframe_pos").alias("b")).alias(ROW))
    return packed.select(*out)


def pivot(df: DataFrame, on: str, index: list[str], values: str, columns: list | None) -> DataFrame:
    """The last value in row order for each index and value of `on`; a null value of `on` is the column "null"."""
    header = F.coalesce(F.col(f"`{on}`").cast("string"), F.lit("null"))
    t = df.select(*[F.col(f"`{i}`") for i in index], header.alias("__loomframe_on"), F.col(f"`{values}`").alias("__loomframe_value"), F.col(ROW))
    if columns is None:
        columns = [r[0] for r in t.groupBy("__loomframe_on").agg(F.min(ROW).alias("o")).orderBy("o").select("__loomframe_on").limit(MAX_PIVOT + 1).collect()]
        if len(columns) > MAX_PIVOT:
            raise ShapeError(f"{on} has over {MAX_PIVOT} values; give `columns`")
    names = ["null" if c is None else str(c) for c in columns]
    clash = set(names) & set(index)
    if clash:
        raise SchemaError(f"values of {on} are called like index columns: {sorted(clash)}")
    aggs = [F.max_by(F.struct(F.col("__loomframe_value").alias("v")), F.when(F.col("__loomframe_on") == c, F.col(ROW)))["v"].alias(c) for c in names]
    first = t.groupBy(*[F.col(f"`{i}`") for i in index]).agg(*aggs, F.min(ROW).alias(ROW)) if index else t.agg(*aggs)
    return first


def unpivot(df: DataFrame, ids: list[str], on: list[str], variable: str, value: str) -> DataFrame:
    """A row for each row and column of `on`, in row order; values of several types become their common type, else text."""
    if not on:
        raise InvalidArgumentError("unpivot needs columns")
    if {variable, value} & set(ids):
        raise SchemaError("the new columns are called like an id")
    kinds = {df.schema[c].dataType.simpleString() for c in on}
    number = {"tinyint", "smallint", "int", "bigint", "float", "double"}
    to = None if len(kinds) == 1 else "double" if kinds <= number and kinds & {"float", "double"} else "bigint" if kinds <= number else "string"
    cell = lambda c: F.col(f"`{c}`") if to is None else F.col(f"`{c}`").cast(to)
    items = F.array(*[F.struct(F.lit(c).alias("k"), cell(c).alias("v")) for c in on])
    made = df.select(*[F.col(f"`{c}`") for c in ids], *([F.col(ROW)] if ROW in df.columns else []), F.posexplode(items).alias("__loomframe_pos", "__loomframe_item"))
    out = [*[F.col(f"`{c}`") for c in ids], F.col("__loomframe_item")["k"].alias(variable), F.col("__loomframe_item")["v"].alias(value)]
    if ROW in df.columns:
        out.append(F.struct(F.col(ROW).alias("a"), F.col("__loomframe_pos").alias("b")).alias(ROW))
    return made.select(*out)


def transpose(df: DataFrame, include_header: bool, header_name: str, column_names: Any, max_rows: int) -> DataFrame:
    """Columns as rows, for frames of at most max_rows rows: every row becomes a column, which no plan holds many of."""
    rows = df.limit(max_rows + 1).collect()
    if len(rows) > max_rows:
        raise ShapeError(f"a frame of more than {max_rows} rows is not transposed")
    cols = df.columns
    if isinstance(column_names, str):
        if column_names not in cols:
            raise SchemaError(f"no column {column_names!r}")
        names = [str(r[column_names]) for r in rows]
        cols = [c for c in cols if c != column_names]
    else:
        names = [str(n) for n, _ in zip(column_names, rows)] if column_names is not None else []
        names += [f"column_{i}" for i in range(len(names), len(rows))]
    kinds = {df.schema[c].dataType.simpleString() for c in cols}
    number = {"tinyint", "smallint", "int", "bigint", "float", "double"}
    kind = df.schema[cols[0]].dataType if len(kinds) == 1 else T.DoubleType() if kinds <= number else T.StringType()
    put = (lambda v: v) if len(kinds) == 1 else (lambda v: None if v is None else float(v)) if kinds <= number else (lambda v: None if v is None else str(v))
    data = [([c] if include_header else []) + [put(r[c]) for r in rows] for c in cols]
    fields = ([T.StructField(header_name, T.StringType())] if include_header else []) + [T.StructField(n, kind) for n in names]
    made = df.sparkSession.createDataFrame([(*d, i) for i, d in enumerate(data)], T.StructType([*fields, T.StructField(ROW, T.LongType())]))
    return made
