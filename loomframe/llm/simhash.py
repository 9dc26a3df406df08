"""SimHash near-duplicates through a byte-position inverted index with count filtering.

A 64-bit fingerprint has eight positional bytes. Fingerprints that differ in at most two bits share at least six of
them: the guaranteed minimum. The bytes stand in four pairs, and two differing bytes leave two pairs whole, so every
distinct fingerprint is listed under its six choices of two pairs. The members of a list are candidates: each pair's
shared positional bytes are tallied over all eight, pairs that reach six are kept, and those are verified bit by
bit. (Lists of single bytes, of which there are 2,048, would hold a 256th of all fingerprints each and tally a number of
pairs that grows with the square of the corpus.)

A hot list, of more than PAIRWISE members, is split by the choices of two of the four bytes outside its key: at most two of those
differ, so every link is in one of its six parts. A part's key is six shared bytes, the guaranteed minimum itself, and two
bytes are free, so it holds 65,536 members at most. In a long part the verified links are found without forming pairs: fingerprints at most two
bits apart have a common neighbour at most one bit from each, and all that are at most one bit from
the same value are at most two bits apart. Both ways find the same components; each list gives a
spanning forest of its verified links.

Exact copies are one fingerprint, so hot groups of copies meet the index once. Documents are
matched to their components by a join on the fingerprint; the labels' side has each fingerprint once, and AQE splits the documents' side where
one fingerprint (as that of the empty text) is hot.

Defined results: null and blank texts have fingerprint 0 and link like any other; ties do not arise, as a component is named by its smallest id; repeated
rows, and rows with the same id, are kept; a null id names a component only where all its ids are null; a very long text is read whole, alone
in its chunk; an empty table gives an empty result. Only the id and text columns are read, so other columns may have any name.

The pipeline's near-dedup has another law, a Jaccard likeness of five-word shingles, and takes the same steps: fingerprints of those shingles, the
index, the count of shared bytes, the bits. Up to NEAR_BITS differ there, so three bytes are the guaranteed minimum, and a text's nearest partners are
compared shingle by shingle. Likenesses of 0.8 lie about ten bits apart, which no count of eight bytes guarantees to find, so `likeness.py` finds the links
that are left between components, without a miss.
"""

from __future__ import annotations

from collections.abc import Callable
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomframe.llm import likeness
from loomframe.llm.common import discard, free_name, map_texts, ship, small_batches, stored
from loomframe.llm.components import components, forest

ship(__name__)

SHINGLE_WORDS = 3
SEED = 42
MAX_BITS = 2
BYTES = 8
SHARED = BYTES - MAX_BITS
#: The four pairs of positional bytes, and the lists of a fingerprint: its choices of two pairs.
PAIRS = ((0, 1), (2, 3), (4, 5), (6, 7))
KEYS = [(*a, *b) for a, b in combinations(PAIRS, 2)]
#: The same for near-dedup: of the bytes that NEAR_BITS bits leave whole two are in one half, so the lists are the pairs of either half.
NEAR_BITS = 5
NEAR_SHARED = BYTES - NEAR_BITS
NEAR_KEYS = [k for half in (range(4), range(4, BYTES)) for k in combinations(half, 2)]
#: Hashes whose bits are counted at once: a worker holds 64 numbers for each.
COUNTED = 16_000
#: Members of a list whose pairs are tallied one by one; longer lists are hot.
PAIRWISE = 256
LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def majority(h: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Signed 64-bit SimHash of each run of hashes: a bit is set if over half of the run set it. sizes: of the runs, which may be empty."""
    counts = np.zeros((len(sizes), 64), np.int64)
    of = np.repeat(np.arange(len(sizes)), sizes)
    for s in range(0, len(h), COUNTED):
        bits = np.unpackbits(h[s : s + COUNTED].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        first = np.flatnonzero(np.diff(of[s : s + COUNTED], prepend=-1))
        counts[of[s + first]] += np.add.reduceat(bits, first, axis=0, dtype=np.int32)
    return np.packbits(counts * 2 > np.asarray(sizes)[:, None], axis=1, bitorder="little").view(np.int64).ravel()


def fingerprint(texts: list, k: int = SHINGLE_WORDS) -> np.ndarray:
    """Signed 64-bit SimHash of each text (bytes or None): a bit is set if over half the shingles' hashes set it."""
    out = np.zeros(len(texts), np.int64)
    digest = xxhash.xxh64_intdigest
    at, sizes, held = [], [], []

    def flush():
        if held:
            out[at] = majority(np.concatenate(held), np.asarray(sizes))
        at.clear(), sizes.clear(), held.clear()

    for i, t in enumerate(texts):
        w = (t or b"").translate(LOWER).split()
        if not w:
            continue
        joined = b" ".join(w)
        if len(w) <= k:
            h = np.array([digest(joined, SEED)], np.uint64)
        else:
            lengths = np.fromiter(map(len, w), np.int64, len(w))
            ends = np.cumsum(lengths + 1) - 1
            starts = ends - lengths
            h = np.fromiter([digest(joined[s:e], SEED) for s, e in zip(starts[: len(w) - k + 1].tolist(), ends[k - 1 :].tolist())], np.uint64, len(w) - k + 1)
        at.append(i), sizes.append(len(h)), held.append(h)
        if sum(sizes) > 200_000:
            flush()
    flush()
    return out


def tallied(u: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All pairs of one list's fingerprints and how many of the eight positional bytes each shares."""
    i, j = np.triu_indices(len(u), 1)
    return i, j, ((u[i] ^ u[j]).view(np.uint8).reshape(-1, BYTES) == 0).sum(axis=1)


def neighbours(u: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs at most two bits apart, as connected as all such pairs: each fingerprint with the first one next to a value it is next to."""
    free = np.bitwise_or.reduce(u ^ u[0])
    flips = [np.uint64(0)] + [np.uint64(1 << b) for b in range(64) if int(free) >> b & 1]
    around = np.concatenate([u ^ f for f in flips])
    who = np.tile(np.arange(len(u)), len(flips))
    order = np.lexsort((who, around))
    around, who = around[order], who[order]
    first = np.concatenate([[True], around[1:] != around[:-1]])
    i, j = who[np.maximum.accumulate(np.where(first, np.arange(len(who)), 0))], who
    apart = i != j
    return i[apart], j[apart]


def linked(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Spanning links among the fingerprints of one list: pairs that share SHARED bytes and differ in MAX_BITS bits at most.

    More than PAIRWISE fingerprints share SHARED bytes already, those of the list's key.
    """
    u = np.unique(fps.view(np.uint64))
    if len(u) <= PAIRWISE:
        i, j, tally = tallied(u)
        enough = tally >= SHARED
        i, j = i[enough], j[enough]
        near = np.bitwise_count(u[i] ^ u[j]) <= MAX_BITS
        i, j = i[near], j[near]
    else:
        i, j = neighbours(u)
    if not len(i):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    a, b = forest(i, j)
    return u[a].view(np.int64), u[b].view(np.int64)


def nearest(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each fingerprint of one list with the nearest of those before it: pairs that share NEAR_SHARED bytes and differ in NEAR_BITS bits at most.

    Of more than PAIRWISE fingerprints, which share NEAR_SHARED bytes already, only pairs up to two bits apart are found.
    """
    u = np.unique(fps.view(np.uint64))
    if len(u) <= PAIRWISE:
        i, j, tally = tallied(u)
        i, j = i[tally >= NEAR_SHARED], j[tally >= NEAR_SHARED]
    else:
        i, j = neighbours(u)
    apart = np.bitwise_count(u[i] ^ u[j])
    order = np.lexsort((i, apart, j))
    order = order[apart[order] <= NEAR_BITS]
    order = order[np.diff(j[order], prepend=-1) != 0]
    return u[i[order]].view(np.int64), u[j[order]].view(np.int64)


def mask(positions: tuple) -> int:
    """The bits of some positional bytes, as a signed long."""
    m = sum(0xFF << 8 * p for p in positions)
    return m - (1 << 64) if m >= 1 << 63 else m


def listed(fps: DataFrame, most: int | None = None, by: list = KEYS, least: int = SHARED) -> DataFrame:
    """(fps) of each list of two members or more. fps: distinct fingerprints in column fp; by: the bytes of the lists; least: how many shared bytes a part's key has."""
    most = PAIRWISE if most is None else most
    keys = F.array(*[F.struct(F.lit(i).cast("byte").alias("key"), F.col("fp").bitwiseAND(F.lit(mask(k))).alias("shared")) for i, k in enumerate(by)])
    posted = fps.select("fp", F.explode(keys).alias("l")).select("l.key", "l.shared", "fp")
    sizes = posted.groupBy("key", "shared").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    met = posted.join(sizes, ["key", "shared"])
    parts = F.lit(None)
    for i, k in enumerate(by):
        more = [mask((*k, *others)) for others in combinations([p for p in range(BYTES) if p not in k], least - len(k))]
        inner = F.array(*[F.struct(F.lit(1 + j).cast("byte").alias("part"), F.col("fp").bitwiseAND(F.lit(m)).alias("bytes")) for j, m in enumerate(more)])
        parts = F.when(F.col("key") == i, inner).otherwise(parts)
    whole = F.array(F.struct(F.lit(0).cast("byte").alias("part"), F.col("shared").alias("bytes")))
    cut = met.select("key", F.explode(F.when(F.col("n") > most, parts).otherwise(whole)).alias("p"), "fp")
    # one column as the key: a hot list's parts are dealt anew instead of staying where the list was counted
    lists = cut.groupBy(F.struct("key", "p.part", "p.bytes").alias("list")).agg(F.collect_list("fp").alias("fps"))
    return lists.where(F.size("fps") > 1).select("fps")


def index_links(fps: DataFrame, find: Callable = linked, by: list = KEYS, least: int = SHARED) -> DataFrame:
    """Links (a, b) that `find` gives of each list, spanning ones unless told otherwise; fps: distinct fingerprints in column fp."""

    def run(batches):
        for batch in batches:
            column = batch.column(0)
            values, cuts = column.values.to_numpy(), column.offsets.to_numpy()
            found = [find(values[s:e]) for s, e in zip(cuts, cuts[1:])]
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([f[s] for f in found])) for s in (0, 1)], names=["a", "b"])

    small_batches(fps.sparkSession)
    return listed(fps, None, by, least).mapInArrow(run, "a long, b long")


def with_components(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, fp, component): fp is null never; component is the smallest id that links reach, itself included."""
    made = map_texts(docs, text, [id_col], lambda texts: {"fp": pa.array(fingerprint(texts))}, T.StructType([T.StructField("fp", T.LongType())]))
    marks = stored(made.toDF("id", "fp"), "fingerprints")
    each = stored(marks.groupBy("fp").agg(F.min("id").alias("least")), "distinct")
    roots = components(index_links(each.select("fp")))
    named = each.join(roots, each.fp == roots.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    first = named.groupBy("root").agg(F.min("least").alias("component"))
    labels = stored(named.join(first, "root").select("fp", "component"), "labels")
    discard(each)
    return marks.join(labels, "fp").select("id", "fp", "component")


def near_links(fps: DataFrame) -> DataFrame:
    """Candidates (a, b) of near-dedup among the distinct fingerprints in column fp; a pair may come of several lists."""
    return index_links(fps, nearest, NEAR_KEYS, NEAR_SHARED)


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text: str = "text", width: int = likeness.WIDTH, least: float = likeness.LIKENESS) -> DataFrame:
    """docs with one row of each component of texts whose shingles of `width` words have a Jaccard likeness of `least` or more.

    Links are those that the byte index finds and a comparison of shingles confirms, and the rest of them, which prefix filtering finds.
    Of a component stays the row with the smallest (id, hash of the text, internal key), ids that are null last.
    """
    key = free_name(docs, "__row")
    keyed = stored(docs.withColumn(key, F.monotonically_increasing_id()), "rows")
    rows = keyed.select(F.col(key).alias("row"), F.col(f"`{id_col}`").alias("id"), F.col(f"`{text}`").alias("text"))
    order = F.struct(F.col("id").isNull().alias("none"), "id", F.xxhash64("text").alias("hash"), "row")
    roots = likeness.roots(rows.select("row", "text"), "text", majority, near_links, width, least)
    # only components of more than one row are ranked, and only the rows that go meet the texts again
    many = roots.groupBy("root").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("root")
    found = stored(roots.join(many, "root", "left_semi").join(rows.select("row", order.alias("order")), "row"), "found")
    stay = found.groupBy("root").agg(F.min("order").alias("order")).select("order.row")
    gone = stored(found.select("row").join(stay, "row", "left_anti").withColumnRenamed("row", key), "gone")
    discard(roots, found)
    return keyed.join(gone, key, "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])


def op7_simhash_byte_index(spark, sf_dir: str) -> DataFrame:
    found = with_components(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select(F.col("id").alias("doc_id"), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), F.col("component").alias("component_id"))
