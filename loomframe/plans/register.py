"""Where queries and their SQL twins are registered."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from loomframe import Frame

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a function of a table loader as a query, with its SQL."""

    def put(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            out = fn(lambda name: Frame(spark.read.parquet(f"{sf_dir}/{name}.parquet")))
            return out.df if isinstance(out, Frame) else out

        run.__name__, run.__doc__ = fn.__name__, fn.__doc__
        QUERIES[fn.__name__] = run
        if sql:
            ORACLES[fn.__name__] = sql
        return fn

    return put
