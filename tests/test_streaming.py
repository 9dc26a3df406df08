"""Streams: late rows, the end of windows by the watermark, and update mode."""

import datetime

from pyspark.sql import functions as F

from loomframe.streaming import windows

DAY = datetime.datetime(2024, 1, 1)
SCHEMA = "k string, ts timestamp_ntz, v double"


def batches(spark, path, *many):
    """A stream of one file for each list of (key, minute, value), in that order."""
    for i, rows in enumerate(many):
        df = spark.createDataFrame([(k, DAY + datetime.timedelta(minutes=m), float(v)) for k, m, v in rows], SCHEMA).coalesce(1)
        df.write.parquet(str(path / f"b{i}"))
        for f in (path / f"b{i}").glob("part-*"):
            f.rename(path / f"{i:03}.parquet")
            import os

            os.utime(path / f"{i:03}.parquet", (1_700_000_000 + i, 1_700_000_000 + i))
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(path / "*.parquet"))


def aggs():
    return {"n": F.count(F.lit(1)), "s": F.sum("v")}


def shown(table):
    return sorted((r.k, int((r.window_start - DAY).total_seconds() // 60), r.n, r.s) for r in table.collect())


def test_late_rows_are_dropped_and_windows_end(spark, tmp_path):
    stream = batches(spark, tmp_path, [("a", 1, 1), ("a", 5, 2)], [("a", 40, 4)], [("a", 41, 8)], [("a", 2, 100), ("a", 42, 1)], [("a", 90, 16)], [("b", 91, 32)])
    got = windows.drained(windows.tumbling(stream, "ts", "10 minutes", ["k"], aggs(), watermark="10 minutes"), "late", "append")
    # the row of minute 2 came two batches after minute 40, with a watermark of 10: its window was closed; the windows of 90 are open yet
    assert shown(got) == [("a", 0, 2, 3.0), ("a", 40, 3, 13.0)]


def test_rows_within_the_watermark_count(spark, tmp_path):
    stream = batches(spark, tmp_path, [("a", 1, 1)], [("a", 9, 2)], [("a", 2, 4)], [("a", 60, 8)], [("a", 61, 8)])
    got = windows.drained(windows.tumbling(stream, "ts", "10 minutes", ["k"], aggs(), watermark="15 minutes"), "within", "append")
    assert shown(got) == [("a", 0, 3, 7.0)]


def test_update_mode_gives_each_change(spark, tmp_path):
    stream = batches(spark, tmp_path, [("a", 1, 1)], [("a", 2, 2), ("b", 3, 4)])
    got = windows.drained(windows.tumbling(stream, "ts", "10 minutes", ["k"], aggs(), watermark="15 minutes"), "updates", "update")
    assert shown(got) == [("a", 0, 1, 1.0), ("a", 0, 2, 3.0), ("b", 0, 1, 4.0)]


def test_sessions_end_after_their_gap(spark, tmp_path):
    stream = batches(spark, tmp_path, [("a", 1, 1), ("a", 4, 1)], [("a", 7, 1)], [("a", 50, 1)], [("a", 51, 1)])
    got = windows.drained(windows.sessions(stream, "ts", "5 minutes", ["k"], aggs(), watermark="1 minute"), "sessions", "append")
    assert shown(got) == [("a", 1, 3, 3.0)]
