"""Sampled splitters: range partitioning of records into shards of near-equal bytes.

1. Each record's key (hash of the text, id, row number) and size are written to the shared folder: equal texts are
   neighbours in key order, and the row number makes every key different.
2. Keys are drawn with probability in proportion to size; quantiles of the draw are the range boundaries.
3. Records get their range by binary search. A shard is a union of neighbouring ranges, each going where its middle lies; a range is
   overfull if a shard's equal share ends inside it and it holds more than the largest record (law `rows`: more than one row).
   Overfull ranges are subdivided by draws of their own until there are none, so a shard differs from its equal share by the largest record at most.
4. Rows of a range are numbered by a window; the totals of the ranges before it in its shard give the rest of the slot.

The draws are the boundaries: other draws cut elsewhere, within the same law. A hot key is cut like any other range, as its rows
differ in id or row number. What reaches the driver does not grow with the table: RANGES_PER_SHARD ranges a shard and
SPLIT_DRAWS subdivisions of each range at a shard's end, with DRAWS_PER_RANGE keys drawn for a range (of a small table a quarter of the keys).

`placed` gives exact places in a whole order by the same ranges, for operators that need an order rather than shards.

Defined results: a null text has no bytes and the checksum of an empty one; null ids come first among
equal texts; repeated rows each get a place; a very long text is one record of its size; an empty table gives an empty result. Only the
id and text columns are read, so other columns may have any name.
"""

from __future__ import annotations

import bisect

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomframe.llm.common import ship, stored

ship(__name__)

SHARDS = 24
#: Bytes that a record needs besides its text.
RECORD_BYTES = 8
DRAWS_PER_RANGE = 16
RANGES_PER_SHARD = 64
#: Splitters that an overfull range is cut with at once; four times as many records are all taken as splitters.
SPLIT_DRAWS = 256
#: For `placed`: rows that a range aims at, and the most ranges drawn at first.
RANGE_ROWS = 2000
MAX_RANGES = 4096
#: Rounds of subdivision after which something is wrong: each cuts a range into SPLIT_DRAWS parts or so.
ROUNDS = 40


class Splitters:
    """Sorted boundary keys (hash, id, row); range i holds the keys from boundary i-1 on and below boundary i."""

    def __init__(self, keys: list[tuple[int, int, int]]):
        self.keys = sorted(set(keys))
        self.h = np.array([k[0] for k in self.keys], np.int64)

    def find(self, h: np.ndarray, i: np.ndarray, r: np.ndarray) -> np.ndarray:
        out = np.searchsorted(self.h, h, "right")
        tied = np.flatnonzero(np.searchsorted(self.h, h, "left") != out)
        if len(tied):  # keys whose hash is a boundary's: the ids, then the rows, decide
            for v in np.unique(h[tied]):
                rows = tied[h[tied] == v]
                lo, hi = np.searchsorted(self.h, v, "left"), np.searchsorted(self.h, v, "right")
                ids = np.array([k[1] for k in self.keys[lo:hi]], np.int64)
                out[rows] = lo + np.searchsorted(ids, i[rows], "right")
                same = rows[np.searchsorted(ids, i[rows], "left") != np.searchsorted(ids, i[rows], "right")]
                for at in same.tolist():
                    out[at] = bisect.bisect_right(self.keys, (int(h[at]), int(i[at]), int(r[at])))
        return out


def ranged(records: DataFrame, splitters: Splitters) -> DataFrame:
    """records (h, i, r, size, ...) with their range in column `part`."""

    def run(batches):
        for b in batches:
            h, i, r = (b.column(b.schema.get_field_index(c)).to_numpy() for c in "hir")
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(splitters.find(h, i, r).astype(np.int32))], names=[*b.schema.names, "part"])

    return records.mapInArrow(run, T.StructType([*records.schema.fields, T.StructField("part", T.IntegerType())]))


def drawn(records: DataFrame, rate: Column, seed: int) -> list:
    """Keys drawn with the probability in `rate`, decided by a hash of the key."""
    u = F.pmod(F.xxhash64("h", "i", "r", F.lit(seed)), F.lit(1 << 40)) / float(1 << 40)
    return [tuple(x) for x in records.where(u < rate).select("h", "i", "r").collect()]


def quantiles(keys: list, n: int) -> list:
    """n - 1 boundaries that cut the sorted keys evenly."""
    keys = sorted(keys)
    return [keys[len(keys) * j // n] for j in range(1, n)] if keys else []


def around_repeats(keys: list) -> list:
    """Boundaries that leave each key drawn more than once, so one that many records share, in a range of its own."""
    keys = sorted(keys)
    return [b for a, c in zip(keys, keys[1:]) if a == c for b in (a, (a[0], a[1], a[2] + 1))]


def overfull(sums: list[tuple[int, int, int]], at: int, goal: float, n_shards: int, most: int) -> list[int]:
    """Ranges (part, bytes, rows) in order in which a share of `goal` ends and that hold over `most`; at: 1 for bytes, 2 for rows."""
    out, begin = [], 0
    for s in sums:
        end = begin + s[at]
        k = int(begin / goal) + 1  # the first share to end after begin
        if s[2] > 1 and s[at] > most and any(begin < j * goal < end for j in (k - 1, k, k + 1) if 0 < j < n_shards):
            out.append(s[0])
        begin = end
    return out


def split(records: DataFrame, n_shards: int, law: str = "bytes", seed: int = 0) -> tuple[Splitters, list[tuple[int, int, int, int, int]]]:
    """Boundaries, and (part, shard, rows before it in the shard, bytes, rows) of each range that has records (h, i, r, size)."""
    total, rows, top = (int(v or 0) for v in records.agg(F.sum("size"), F.count(F.lit(1)), F.max("size")).first())
    if not rows:
        return Splitters([]), []
    at, whole, most = (1, total, top) if law == "bytes" else (2, rows, 1)
    goal = whole / n_shards
    weight = F.col("size") if law == "bytes" else F.lit(1)
    n = n_shards * RANGES_PER_SHARD
    draws = min(n * DRAWS_PER_RANGE, rows / 4)
    splitters = Splitters(quantiles(drawn(records, weight * (draws / max(1, whole)), seed), n))
    for k in range(ROUNDS):
        parted = ranged(records, splitters)
        sums = sorted((p, int(b), int(c)) for p, b, c in parted.groupBy("part").agg(F.sum("size"), F.count(F.lit(1))).collect())
        over = overfull(sums, at, goal, n_shards, most)
        if not over:
            break
        held = {s[0]: s for s in sums}
        inside = parted.where(F.col("part").isin(over))
        few = [p for p in over if held[p][2] <= 4 * SPLIT_DRAWS]  # of so few records every other one is a splitter
        two = [p for p in few if held[p][2] == 2]
        rate = F.create_map(*[x for p in over for x in (F.lit(p), F.lit(4 * SPLIT_DRAWS / held[p][at]))])
        rate = F.when(F.col("part").isin(two), 1.0).when(F.col("part").isin(few), 0.5).otherwise(rate[F.col("part")] * weight)
        found: dict = {}
        for key in drawn(inside, rate, seed + k + 1):
            found.setdefault(int(splitters.find(*(np.array([v], np.int64) for v in key))[0]), []).append(key)
        new = [q for p, keys in found.items() for q in (keys if p in few else quantiles(keys, SPLIT_DRAWS))]
        splitters = Splitters([*splitters.keys, *new])
    else:
        raise RuntimeError(f"ranges are still overfull after {ROUNDS} rounds of subdivision")
    out, begin, first, last = [], 0, 0, 0
    for p, b, c in sums:
        held_ = (0, b, c)[at]
        shard = max(last, min(n_shards - 1, int((begin + held_ / 2) / goal)))
        first = first if shard == last else 0
        out.append((p, shard, first, b, c))
        begin, first, last = begin + held_, first + c, shard
    return splitters, out


def placed(records: DataFrame, seed: int = 0, range_rows: int = RANGE_ROWS, max_ranges: int = MAX_RANGES) -> tuple[DataFrame, int, int]:
    """records (h, i, r long; size long; ...) with `part`, `before` (bytes before it) and `place` (rows before it) in key order; all bytes, all rows.

    Ranges that hold more than twice their share of bytes or rows are subdivided. Rows with one key (h, i, r) can't be
    told apart and stay in one range. What reaches the driver: the draws (at most about DRAWS_PER_RANGE a range) and a row per range.
    """
    total, rows = (int(v or 0) for v in records.agg(F.sum("size"), F.count(F.lit(1))).first())
    n = max(1, min(max_ranges, -(-rows // range_rows)))
    rate = F.greatest(F.col("size") * (n * DRAWS_PER_RANGE / max(1, total)), F.lit(n * DRAWS_PER_RANGE / 4 / max(1, rows)))
    keys = drawn(records, rate, seed)
    splitters = Splitters([*quantiles(keys, n), *around_repeats(keys)])
    settled: set = set()
    for k in range(ROUNDS):
        parted = ranged(records, splitters)
        sums = {p: (int(b), int(c)) for p, b, c in parted.groupBy("part").agg(F.sum("size"), F.count(F.lit(1))).collect()}
        lows = {p: splitters.keys[p - 1] if p else None for p in sums}
        over = {p: max(2, round(max(b * n / max(1, total), c * n / max(1, rows)))) for p, (b, c) in sums.items() if lows[p] not in settled and c > 1 and (b > 2 * total / n or c > 2 * rows / n) and c > range_rows // 4}
        if not over:
            break
        share = F.create_map(*[F.lit(v) for p, m in over.items() for v in (p, m * DRAWS_PER_RANGE / sums[p][1])])
        inside = parted.where(F.col("part").isin(list(over)))
        found: dict = {}
        for key in drawn(inside, share[F.col("part")], seed + k + 1):
            found.setdefault(int(splitters.find(*(np.array([v], np.int64) for v in key))[0]), []).append(key)
        one_key = {r.part for r in inside.groupBy("part").agg(F.min(F.struct("h", "i", "r")).alias("a"), F.max(F.struct("h", "i", "r")).alias("b")).where("a = b").collect()}
        settled |= {lows[p] for p in one_key}
        splitters = Splitters([*splitters.keys, *(q for p, keys in found.items() for q in [*quantiles(keys, over[p]), *around_repeats(keys)])])
    else:
        raise RuntimeError(f"ranges are still overfull after {ROUNDS} rounds of subdivision")
    at_bytes = at_rows = 0
    offsets = []
    for p in sorted(sums):
        offsets.append((p, at_bytes, at_rows))
        at_bytes, at_rows = at_bytes + sums[p][0], at_rows + sums[p][1]
    offs = records.sparkSession.createDataFrame(offsets, "part int, part_bytes long, part_rows long")
    order = W.partitionBy("part").orderBy("h", "i", "r")
    out = parted.withColumns({"before": F.coalesce(F.sum("size").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)), "place": F.row_number().over(order) - 1})
    out = out.join(F.broadcast(offs), "part")  # a row per range: 20 bytes each
    return out.withColumns({"before": F.col("before") + F.col("part_bytes"), "place": (F.col("place") + F.col("part_rows")).cast("long")}).drop("part_bytes", "part_rows"), total, rows


def sharded(docs: DataFrame, n_shards: int = SHARDS, id_col: str = "doc_id", text: str = "text", law: str = "bytes", seed: int = 0) -> DataFrame:
    """(id, size, text_crc32, shard, slot, range): every row in a shard of 0 to n_shards - 1.

    law `bytes`: shards differ from an equal share of bytes by the largest record at most;
    law `rows`: their counts differ by one at most. slot counts a shard's rows from 0 without gaps, in key order.
    """
    if law not in ("bytes", "rows"):
        raise ValueError(f"law is bytes or rows, not {law}")
    t = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    slim = docs.select(F.xxhash64(t).alias("h"), F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit(-(1 << 63))).alias("i"), F.monotonically_increasing_id().alias("r"), (F.octet_length(t) + RECORD_BYTES).cast("long").alias("size"), F.crc32(t.cast("binary")).alias("crc"), F.col(f"`{id_col}`").alias("id"))
    records = stored(slim, "records")
    splitters, ranges = split(records, n_shards, law, seed)
    table = records.sparkSession.createDataFrame([r[:3] for r in ranges], "part int, shard int, first long")
    order = W.partitionBy("part").orderBy("h", "i", "r")
    out = ranged(records, splitters).withColumn("slot", F.row_number().over(order) - 1)
    out = out.join(F.broadcast(table), "part")  # a row per range
    return out.select("id", "size", F.col("crc").alias("text_crc32"), "shard", (F.col("slot") + F.col("first")).cast("long").alias("slot"), F.col("part").alias("range"))


def op3_sampled_splitters(spark, sf_dir: str) -> DataFrame:
    out = sharded(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select(F.col("id").alias("doc_id"), "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
