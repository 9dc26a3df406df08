"""Row order. Spark has none, so a frame that needs it carries a hidden, sortable column.

Frames made in memory carry it from the start. Frames read from files get it when an operator first asks for it,
as monotonically increasing ids over the scan; give `order_by` a unique key to have an order that does not hang on how files
are cut.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomframe.functions.spec import ROW
from loomframe.sources.scratch import scratch


def with_order(df: DataFrame) -> tuple[DataFrame, Column]:
    if ROW not in df.columns:
        df = df.withColumn(ROW, F.monotonically_increasing_id())
    return df, F.col(ROW)


def indexed(df: DataFrame, name: str) -> DataFrame:
    """df with a gapless position from 0 in row order.

    The ordered rows are stored once with the number of their partition and their place in it, as two runs of one plan need not
    cut rows alike. The stored rows are counted by partition (what reaches the driver is a number for each), and
    each partition starts where those before it end. The table goes when the application ends. Runs two jobs.
    """
    spark = df.sparkSession
    if ROW in df.columns:
        df = df.orderBy(ROW)
    nothing = [isinstance(f.dataType, T.NullType) for f in df.schema.fields]
    kept = [F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(df.columns) if not nothing[i]]
    marked = df.select(F.monotonically_increasing_id().alias("id"), *kept)
    path = scratch(spark, "positions")
    marked.write.parquet(path)
    rows = spark.read.schema(marked.schema).parquet(path)
    part = F.shiftright("id", 33)
    counts = sorted((r[0], r[1]) for r in rows.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n")).collect())
    starts, at = [], 0
    for p, n in counts:
        starts.append((p, at))
        at += n
    within = F.col("id") - F.shiftleft(part, 33)
    columns = [(F.lit(None) if nothing[i] else F.col(f"c{i}")).alias(c) for i, c in enumerate(df.columns)]
    if len(starts) < 2:
        return rows.select(*columns, within.alias(name))
    offsets = spark.createDataFrame(starts, "part long, start long")  # a row for each partition
    placed = rows.withColumn("part", part).join(F.broadcast(offsets), "part")
    return placed.select(*columns, (within + F.col("start")).alias(name))
