"""Helpers that the training-data operators share."""

from __future__ import annotations

import sys
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.cloudpickle import register_pickle_by_value
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: UTF-8 bytes of text that a Python worker takes at once, besides one whole text.
CHUNK_BYTES = 1 << 20
#: Bytes of an Arrow batch that Spark sends to a worker, besides one whole row. Rows alone are no bound, as texts have any length.
BATCH_BYTES = 2 << 20


def ship(module: str) -> None:
    """Send a module's functions to the workers by value, so executors need no copy of this package."""
    register_pickle_by_value(sys.modules[module])


ship(__name__)


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir; a local one only where that is unset and Spark runs in local mode (tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        jdir = spark.sparkContext._jsc.sc().getCheckpointDir()
        if jdir.isDefined():
            return jdir.get()
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="loomframe-"))
        return spark.sparkContext._jsc.sc().getCheckpointDir().get()
    return found


def _path(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def new_path(spark: SparkSession, what: str) -> str:
    """A path in the shared folder that is not there yet; what will be in it goes when the application ends, or with `discard_path`."""
    fs, at = _path(spark, f"{shared_dir(spark).rstrip('/')}/{what}-{uuid.uuid4().hex}")
    fs.mkdirs(at)
    fs.deleteOnExit(at)
    return f"{at.toString()}/data"


def discard_path(spark: SparkSession, path: str) -> None:
    """Delete what new_path gave."""
    fs, at = _path(spark, path.removesuffix("/data"))
    fs.delete(at, True)


def stored(df: DataFrame, what: str) -> DataFrame:
    """Write df as Parquet to the shared folder and read it again: cuts lineage and survives lost executors."""
    path = new_path(df.sparkSession, what)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete stored tables that nothing reads any more: all that was made of them is itself stored."""
    for t in tables:
        path = getattr(t, "_stored_at", None)
        if path:
            discard_path(t.sparkSession, path)


def free_name(df: DataFrame, name: str) -> str:
    """name, or name with underscores before it when df has such a column in any case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def small_batches(spark: SparkSession) -> None:
    """Have the session send BATCH_BYTES at most to a Python worker at once, so that long texts don't add up.

    This lowers spark.sql.execution.arrow.maxBytesPerBatch for the whole session, as Spark reads it when a result is asked for.
    """
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(key)) > BATCH_BYTES:
        spark.conf.set(key, str(BATCH_BYTES))


def chunks(sizes: list[int], most: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of consecutive rows of about `most` bytes; a larger row is alone in its range."""
    start = held = 0
    for i, n in enumerate(sizes):
        if held and held + n > most:
            yield start, i
            start, held = i, 0
        held += n
    if start < len(sizes):
        yield start, len(sizes)


def map_texts(df: DataFrame, text: str, keep: list[str], fn: Callable[[list], dict], out: T.StructType) -> DataFrame:
    """The columns `keep` of df and those that fn makes of each chunk of texts (bytes; null as None).

    fn gets a list of at most CHUNK_BYTES of UTF-8 texts, or one longer text, and gives
    a dict of Arrow arrays named as in `out`. Rows map one to one; nothing is shuffled.
    """
    small_batches(df.sparkSession)
    kept = [F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(keep)]
    source = df.select(*kept, F.col(f"`{text}`").cast("binary").alias("text"))
    names = [f.name for f in out.fields]
    n = len(keep)

    def run(batches):
        for b in batches:
            texts = b.column(n)
            sizes = [0 if v is None else v for v in pa.compute.binary_length(texts).to_pylist()]
            for lo, hi in chunks(sizes):
                got = fn(texts.slice(lo, hi - lo).to_pylist())
                yield pa.RecordBatch.from_arrays([b.column(i).slice(lo, hi - lo) for i in range(n)] + [got[c] for c in names], names=[f"k{i}" for i in range(n)] + names)

    schema = T.StructType([T.StructField(f"k{i}", df.schema[c].dataType) for i, c in enumerate(keep)] + out.fields)
    made = source.mapInArrow(run, schema)
    return made.toDF(*keep, *names) if keep else made
