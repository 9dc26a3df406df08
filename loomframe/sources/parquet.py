"""Parquet files and Spark DataFrames as frames."""

from __future__ import annotations

from pyspark.sql import DataFrame

from loomframe.sources.memory import session


def read_parquet(*paths: str):
    """A frame of Parquet files; filters and column choice reach the scan."""
    from loomframe.operators.frame import Frame

    return Frame(session().read.parquet(*paths))


def from_spark(df: DataFrame):
    from loomframe.operators.frame import Frame

    return Frame(df)
