"""Frames of rows or columns at hand."""

from __future__ import annotations

import datetime
from typing import Any

from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomframe import types as LT
from loomframe.errors import SchemaError, ShapeError
from loomframe.functions.spec import ROW


def session() -> SparkSession:
    return SparkSession.getActiveSession() or SparkSession.builder.getOrCreate()


def guess(values: list) -> T.DataType:
    """The narrowest type that holds all values; text if they are of several kinds, or none is known."""
    known = [v for v in values if v is not None]
    if not known:
        return T.StringType()
    if all(isinstance(v, bool) for v in known):
        return T.BooleanType()
    if all(isinstance(v, int) and not isinstance(v, bool) for v in known):
        return T.IntegerType() if all(-(1 << 31) <= v < 1 << 31 for v in known) else T.LongType()
    if all(isinstance(v, (int, float)) and not isinstance(v, bool) for v in known):
        return T.DoubleType()
    if all(isinstance(v, (bytes, bytearray)) for v in known):
        return T.BinaryType()
    if all(isinstance(v, datetime.datetime) for v in known):
        return T.TimestampNTZType()
    if all(isinstance(v, datetime.date) for v in known):
        return T.DateType()
    if all(isinstance(v, (list, tuple)) for v in known):
        return T.ArrayType(guess([e for v in known for e in v]))
    if all(isinstance(v, dict) for v in known):
        names = list(dict.fromkeys(k for v in known for k in v))
        return T.StructType([T.StructField(n, guess([v.get(n) for v in known])) for n in names])
    return T.StringType()


def fitted(v: Any, t: T.DataType) -> Any:
    """v as createDataFrame wants it for t."""
    if v is None:
        return None
    if isinstance(t, T.ArrayType):
        return [fitted(e, t.elementType) for e in v]
    if isinstance(t, T.StructType):
        return tuple(fitted(v.get(f.name), f.dataType) for f in t.fields)
    if isinstance(t, T.DoubleType):
        return float(v)
    if isinstance(t, T.TimestampNTZType) and v.tzinfo is not None:
        return v.astimezone(datetime.timezone.utc).replace(tzinfo=None)
    if isinstance(t, T.StringType) and not isinstance(v, str):
        return str(v)
    return v


def data(items: Any, schema: dict | None = None, spark: SparkSession | None = None):
    """A frame of rows (dicts, whose keys are united) or of columns ({name: values}).

    schema: {name: type} coerces the columns leniently, drops the others and adds those missing as nulls.
    """
    from loomframe.operators.frame import Frame

    spark = spark or session()
    if isinstance(items, dict):
        names = list(items)
        columns = [list(v) for v in items.values()]
        if len({len(c) for c in columns}) > 1:
            raise ShapeError("columns differ in length")
    else:
        rows = [r if isinstance(r, dict) else r.asDict(recursive=True) for r in items]
        names = list(dict.fromkeys(k for r in rows for k in r))
        columns = [[r.get(n) for r in rows] for n in names]
    if any(n.startswith(ROW) for n in names):
        raise SchemaError(f"names that begin with {ROW} are taken")
    kinds = [guess(c) for c in columns]
    table = [tuple(fitted(v, k) for v, k in zip(r, kinds)) + (i,) for i, r in enumerate(zip(*columns))]
    struct = T.StructType([*(T.StructField(n, k) for n, k in zip(names, kinds)), T.StructField(ROW, T.LongType(), False)])
    df = spark.createDataFrame(table, struct)
    if schema is not None:
        df = coerced(df, schema)
    return Frame(df)


def coerced(df: Any, schema: dict) -> Any:
    """df with the schema's columns only, each leniently of its type."""
    out = []
    for name, kind in schema.items():
        t = LT.as_type(kind)
        c = LT.lenient(F.col(f"`{name}`"), df.schema[name].dataType, t) if name in df.columns else F.lit(None).cast(t.spark)
        out.append(c.alias(name))
    return df.select(*out, *([F.col(ROW)] if ROW in df.columns else []))
