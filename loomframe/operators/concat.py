"""Concatenation of frames."""

from __future__ import annotations

from functools import reduce
from typing import Any

from pyspark.sql import functions as F

from loomframe.errors import InvalidArgumentError, SchemaError, ShapeError
from loomframe.functions.spec import ROW
from loomframe.operators.order import indexed


def concat(items: Any, *, how: str = "vertical", strict: bool = True):
    """vertical: rows of frames with the same columns; diagonal: of any columns, nulls for those missing; horizontal: columns side by side.

    strict (horizontal): frames have one height; else short ones are filled with nulls.
    """
    from loomframe.operators.frame import Frame

    frames = list(items)
    if not frames:
        raise InvalidArgumentError("concat takes a frame or more")
    if how not in ("vertical", "horizontal", "diagonal"):
        raise InvalidArgumentError("how is vertical, horizontal or diagonal")
    if len(frames) == 1:
        return frames[0]
    if how == "horizontal":
        names = [c for f in frames for c in f.columns]
        if len(set(names)) != len(names):
            raise SchemaError(f"two columns are called the same: {names}")
        if strict:
            heights = [f.height for f in frames]
            if len(set(heights)) > 1:
                raise ShapeError(f"frames have heights {heights}")
        sides = [indexed(f._df, "__loomframe_i").drop(ROW) for f in frames]
        made = reduce(lambda a, b: a.join(b, "__loomframe_i", "inner" if strict else "full_outer"), sides)
        return Frame(made.select(*[F.col(f"`{c}`") for c in names], F.col("__loomframe_i").alias(ROW)))
    first = frames[0].df.schema
    if how == "vertical":
        for f in frames[1:]:
            if [(x.name, x.dataType) for x in f.df.schema.fields] != [(x.name, x.dataType) for x in first.fields]:
                raise SchemaError(f"columns differ: {first.simpleString()} and {f.df.schema.simpleString()}")
    else:
        kinds: dict = {}
        for f in frames:
            for x in f.df.schema.fields:
                if kinds.setdefault(x.name, x.dataType) != x.dataType:
                    raise SchemaError(f"{x.name} is {kinds[x.name].simpleString()} and {x.dataType.simpleString()}")
    ordered = any(ROW in f._df.columns for f in frames)
    parts = []
    for i, f in enumerate(frames):
        df = f._df
        if ordered:  # rows of one frame after those of the frame before it
            df = df if ROW in df.columns else df.withColumn(ROW, F.monotonically_increasing_id())
            df = indexed(df, "__loomframe_i").drop(ROW).withColumn(ROW, F.struct(F.lit(i).alias("a"), F.col("__loomframe_i").alias("b"))).drop("__loomframe_i")
        parts.append(df)
    return Frame(reduce(lambda a, b: a.unionByName(b, allowMissingColumns=how == "diagonal"), parts))
