"""Separator scan: token counts of the documents in flat, unindexed token files.

A token file is a stretch of little-endian ids of fixed width with the end-of-document id after each
document, and nothing else. Files are cut into blocks; each block is searched for the identifier with
one vectorised comparison. A prefix scan over a file's block summaries (separators before the block, last separator before
it) stitches documents that cross block boundaries, and gives each its ordinal and start.

The driver sees no file: a listing (path, length; no content) is cut into byte ranges, which are dealt to tasks whatever file they
are in, and a task holds one block at a time. Ranges are read through pyarrow's file systems (local and mounted
folders, HDFS, S3, GCS, ABFS); a path of any other store is refused by name.

Defined results: an empty file has no documents; tokens after the last separator are one more document,
marked as not terminated; an empty document has 0 tokens; a null text is an empty document; equal and repeated texts are documents each, and a very long one
spans blocks. A file whose length is no multiple of the width raises ValueError. An empty table makes files without documents. Only
the text column is read, so other columns may have any name.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomframe.llm.common import discard_path, map_texts, new_path, ship, stored
from loomframe.llm.tokens import encoder, rank_file, vocabulary

ship(__name__)

END = 50256
WIDTH = 2
BLOCK_TOKENS = 1 << 18
#: Blocks that a task of the scan reads, one after the other.
TASK_BLOCKS = 64


def write_token_files(docs: DataFrame, path: str, text: str = "text", end: int = END, width: int = WIDTH, tokenizer: str | None = None) -> None:
    """Write the documents' ids to flat files under path, `end` after each; a null text has no ids.

    Strings of special tokens in a text are ordinary text here, so `end` only ends documents. Files are written by Spark's own
    sink and committed as a whole, so lost tasks leave nothing behind: rows are raw bytes, and `end` is the line separator.
    """
    vocab = tokenizer or vocabulary()
    ranks = rank_file(vocab)

    def ids(texts):
        encode = encoder(vocab, special=False, ranks=ranks)
        found = encode([(t or b"").decode("utf-8", "replace") for t in texts])
        if any(len(x) and (int(x.max()) >= 1 << 8 * width or (x == end).any()) for x in found):
            raise ValueError(f"ids don't fit {width} bytes, or a text holds the id {end}")
        return {"ids": pa.array([x.astype(f"<u{width}").tobytes() for x in found], pa.binary())}

    made = map_texts(docs, text, [], ids, T.StructType([T.StructField("ids", T.BinaryType())]))
    separator = int(end).to_bytes(width, "little").decode("latin-1")
    made.select(F.col("ids").cast("string").alias("value")).write.option("lineSep", separator).option("encoding", "ISO-8859-1").text(path)


def find_separators(block: bytes, end: int, width: int) -> np.ndarray:
    """Positions of `end` among a block's tokens."""
    return np.flatnonzero(np.frombuffer(block, f"<u{width}") == end)


def opened(path: str):
    """A file at a path as Spark writes it, for reading at any offset."""
    from pyarrow import fs

    scheme, _, rest = path.partition(":") if re.match(r"[A-Za-z][\w+.-]*:", path) else ("file", "", path)
    if scheme == "file":
        return fs.LocalFileSystem().open_input_file("/" + rest.lstrip("/"))
    name = {"s3a": "s3", "s3n": "s3", "abfss": "abfs"}.get(scheme, scheme)
    authority, _, key = rest.removeprefix("//").partition("/")
    try:
        store, root = fs.FileSystem.from_uri(f"{name}://{authority}/")
    except (pa.ArrowInvalid, OSError) as e:
        raise ValueError(f"{path} is in a store that pyarrow can't read: {e}") from e
    return store.open_input_file(f"{root.rstrip('/')}/{key}")


def separators(spark: SparkSession, path: str, end: int, width: int, block_tokens: int) -> DataFrame:
    """(file, block, tokens, ends): the places of `end` in each block of the files under path, stored."""
    size = block_tokens * width
    files = spark.read.format("binaryFile").load(path).select("path", "length").where("length > 0")
    whole = F.when(F.col("length") % width != 0, F.raise_error(F.format_string("%s is no whole number of tokens", "path"))).otherwise(F.col("length"))
    blocks = files.select("path", whole.alias("length")).select("path", "length", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("length") - 1) / size).cast("long"))).alias("block"))
    n = files.agg(F.sum(F.ceil(F.col("length") / size))).first()[0] or 0
    # neighbours of a file stay together as far as tasks go; a large file is many tasks' work
    dealt = blocks.repartition(max(1, -(-n // TASK_BLOCKS)), "path", F.floor(F.col("block") / TASK_BLOCKS))

    def search(batches):
        name, source = None, None
        for b in batches:
            for file, length, k in zip(*(c.to_pylist() for c in b.columns)):
                if file != name:
                    if source:
                        source.close()
                    name, source = file, opened(file)
                raw = source.read_at(min(size, length - k * size), k * size)
                at = find_separators(raw, end, width) + k * block_tokens
                yield pa.RecordBatch.from_arrays([pa.array([file]), pa.array([k]), pa.array([len(raw) // width]), pa.array([at], pa.list_(pa.int64()))], names=["file", "block", "tokens", "ends"])

    return stored(dealt.mapInArrow(search, "file string, block long, tokens long, ends array<bigint>"), "separators")


def scan_token_files(spark: SparkSession, path: str, end: int = END, width: int = WIDTH, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """(file, ordinal, start, tokens, terminated): every document of the files under path, start and tokens in tokens.

    The files are read when this is called; the result needs them no more.
    """
    found = separators(spark, path, end, width, block_tokens)
    # the prefix scan sees a row of four numbers for each block, never the separators themselves
    summary = found.select("file", "block", F.size("ends").alias("n"), F.try_element_at("ends", F.lit(-1)).alias("last"))
    before = W.partitionBy("file").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    carried = summary.select(
        "file",
        "block",
        F.coalesce(F.sum("n").over(before), F.lit(0)).alias("ordinal"),
        F.coalesce(F.max("last").over(before) + 1, F.lit(0)).alias("carry"),
        F.lead("block").over(W.partitionBy("file").orderBy("block")).isNull().alias("is_last"),
    )
    stitched = found.join(carried, ["file", "block"])
    whole = F.transform("ends", lambda e, j: F.struct((F.col("ordinal") + j).alias("ordinal"), F.when(j == 0, F.col("carry")).otherwise(F.get("ends", j - 1) + 1).alias("start"), e.alias("end"), F.lit(True).alias("terminated")))
    last_start = F.coalesce(F.try_element_at("ends", F.lit(-1)) + 1, F.col("carry"))
    file_end = F.col("block") * block_tokens + F.col("tokens")
    rest = F.when(F.col("is_last") & (last_start < file_end), F.array(F.struct((F.col("ordinal") + F.size("ends")).alias("ordinal"), last_start.alias("start"), file_end.alias("end"), F.lit(False).alias("terminated")))).otherwise(F.array().cast("array<struct<ordinal:bigint,start:bigint,end:bigint,terminated:boolean>>"))
    docs = stitched.select("file", F.explode(F.concat(whole, rest)).alias("d"))
    return docs.select("file", "d.ordinal", "d.start", (F.col("d.end") - F.col("d.start")).alias("tokens"), "d.terminated")


def op4_separator_scan(spark, sf_dir: str) -> DataFrame:
    path = new_path(spark, "tokens")
    write_token_files(spark.read.parquet(f"{sf_dir}/documents.parquet"), path)
    out = scan_token_files(spark, path)
    discard_path(spark, path)
    return out.select(F.regexp_extract("file", "part-(\\d+)", 1).cast("int").alias("part"), F.regexp_extract("file", "-c(\\d+)", 1).cast("int").alias("roll"), "ordinal", "start", "tokens", "terminated")
