"""Quality classifier: hashed word n-gram logistic regression, trained with follow-the-regularised-leader.

A text's words are runs of letters or digits and runs of other marks. Its features are hashed
n-grams (one and two words) of the words and of their shapes (letters as a or A, digits as 0, runs
cut to one), with a shape of its own for a word that repeats the word before it. Each feature's value is
its count over the number of words, times SCALE. Scores are sparse dot products: hashed indexes look up the
weights, and a segment sum adds a document's products.

Training takes at most MAX_TRAIN labelled rows, those with the smallest hash of their id, and of these only as many as hold
MAX_TRAIN_BYTES of text together, in one
task: follow-the-regularised-leader is a sequence of updates. The bounds hold memory fixed
whatever the corpus; everything else covers all rows. Scoring is a narrow transformation; what it
broadcasts is the weight table, of 2**BITS floats.

Defined results: null and blank texts score as the bias alone. Labels that are null are left out; a
document with several labels counts as 1 if their mean is 0.5 or more. No usable label: all scores
are 0.5. Repeated rows score the same; scores may tie. A very long text is scored whole, and if it is over MAX_TRAIN_BYTES it is not trained on. A column called
`score` keeps its name and the new one gets underscores; an empty table gives an empty result.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomframe.llm.common import free_name, map_texts, ship

ship(__name__)

BITS = 18
MAX_TRAIN = 6000
MAX_TRAIN_BYTES = 256 << 20
EPOCHS = 2
SCALE = 8.0
ALPHA, BETA, L1, L2 = 0.3, 1.0, 0.02, 0.5
THRESHOLD = 0.3
FOLDS = 5
_WORDS = re.compile(r"\w+|[^\w\s]+")
_SHAPES = [(re.compile(r"[A-ZÀ-Þ]+"), "A"), (re.compile(r"[a-zß-ÿ]+"), "a"), (re.compile(r"\d+"), "0"), (re.compile(r"(.)\1+"), r"\1\1")]
#: Distinct words whose hashes a worker keeps.
MEMORY = 200_000


class Hashes(dict):
    """word -> its hash in the low and its shape's hash in the high 32 bits."""

    def __missing__(self, w: str) -> int:
        shape = w
        for pattern, to in _SHAPES:
            shape = pattern.sub(to, shape)
        got = zlib.crc32(w.encode("utf-8", "replace")) | zlib.crc32(b"shape " + shape.encode("utf-8", "replace")) << 32
        if len(self) >= MEMORY:
            self.clear()
        self[w] = got
        return got


def _mix(h: np.ndarray, salt: int, bits: int) -> np.ndarray:
    return ((h + np.uint64(salt)) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - bits)


def features(texts: list, memory: Hashes, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """(feature indexes, 4 a word, of all texts; words of each text)."""
    parts, sizes = [], []
    for t in texts:
        w = _WORDS.findall((t or b"").decode("utf-8", "replace"))
        parts.append(np.fromiter(map(memory.__getitem__, w), np.uint64, len(w)))
        sizes.append(len(w))
    both = np.concatenate(parts) if parts else np.zeros(0, np.uint64)
    n = len(both)
    word, shape = both & np.uint64(0xFFFFFFFF), both >> np.uint64(32)
    starts = np.cumsum(sizes) - sizes
    first = np.zeros(n, bool)
    first[starts[np.asarray(sizes, int) > 0]] = True
    before, shape_before = np.concatenate([[np.uint64(1)], word[:-1]])[:n], np.concatenate([[np.uint64(1)], shape[:-1]])[:n]
    before[first], shape_before[first] = 1, 1
    shape = np.where(~first & (before == word), np.uint64(0xABCDEF), shape)
    idx = np.empty((n, 4), np.uint32)
    idx[:, 0] = _mix(word, 0, bits)
    idx[:, 1] = _mix(word * np.uint64(31) ^ before << np.uint64(17), 1, bits)
    idx[:, 2] = _mix(shape, 2, bits)
    idx[:, 3] = _mix(shape * np.uint64(31) ^ shape_before << np.uint64(17), 3, bits)
    return idx, np.asarray(sizes, np.int64)


def scores(texts: list, weights: np.ndarray, bias: float, memory: Hashes, bits: int = BITS) -> np.ndarray:
    """Probability of label 1 of each text."""
    idx, sizes = features(texts, memory, bits)
    total = np.concatenate([[0.0], np.cumsum(weights[idx].sum(axis=1, dtype=np.float64))])
    ends = np.cumsum(sizes)
    z = bias + SCALE * (total[ends] - total[ends - sizes]) / np.maximum(sizes, 1)
    return 1 / (1 + np.exp(-np.clip(z, -35, 35)))


def fit(rows: list[tuple[np.ndarray, np.ndarray, int]], bits: int = BITS, epochs: int = EPOCHS) -> tuple[np.ndarray, float]:
    """Weights and bias from (feature indexes, values, label) rows, in their order."""
    z, n, w = np.zeros(1 << bits), np.zeros(1 << bits), np.zeros(1 << bits)
    bz = bn = 0.0
    bias = 0.0
    for _ in range(epochs):
        for idx, x, y in rows:
            zi, ni = z[idx], n[idx]
            wi = np.where(np.abs(zi) <= L1, 0.0, -(zi - np.sign(zi) * L1) / ((BETA + np.sqrt(ni)) / ALPHA + L2))
            bias = -bz / ((BETA + np.sqrt(bn)) / ALPHA)
            g = 1 / (1 + np.exp(-np.clip(bias + wi @ x, -35, 35))) - y
            gi = g * x
            new = ni + gi * gi
            z[idx] = zi + gi - (np.sqrt(new) - np.sqrt(ni)) / ALPHA * wi
            n[idx] = new
            bz += g - (np.sqrt(bn + g * g) - np.sqrt(bn)) / ALPHA * bias
            bn += g * g
    w = np.where(np.abs(z) <= L1, 0.0, -(z - np.sign(z) * L1) / ((BETA + np.sqrt(n)) / ALPHA + L2))
    return w, -bz / ((BETA + np.sqrt(bn)) / ALPHA)


def fold(id_col: Column) -> Column:
    """crc32 of the id's text, mod 5: the fold of a row; null ids are in fold 0."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % FOLDS, F.lit(0))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text", label: str = "quality", most: int = MAX_TRAIN) -> tuple[np.ndarray, float]:
    """Weights and bias learnt from at most `most` labelled rows outside fold 0."""
    known = labels.where(F.col(f"`{id_col}`").isNotNull() & F.col(f"`{label}`").isNotNull()).groupBy(F.col(f"`{id_col}`").alias("id")).agg((F.avg(label) >= 0.5).cast("int").alias("y"))
    known = known.where(fold(F.col("id")) != 0)
    have = docs.select(F.col(f"`{id_col}`").alias("id")).where("id is not null")
    chosen = known.join(have, "id", "left_semi").orderBy(F.xxhash64("id"), "id").limit(most)
    # at most `most` ids: broadcast; of documents with the same id all count, most of them at the utmost
    sample = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text}`").cast("binary").alias("text")).join(F.broadcast(chosen), "id").orderBy(F.xxhash64("id"), F.xxhash64("text")).limit(most)
    so_far = W.partitionBy(F.lit(0)).orderBy(F.xxhash64("id"), F.xxhash64("text")).rowsBetween(W.unboundedPreceding, 0)  # at most `most` rows
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")
    sample = sample.withColumn("held", F.sum(F.when(size <= MAX_TRAIN_BYTES, size).otherwise(0)).over(so_far)).where((F.col("held") <= MAX_TRAIN_BYTES) & (size <= MAX_TRAIN_BYTES)).drop("held")

    def learn(batches):
        memory, rows = Hashes(), []
        for b in batches:
            for i, t, y in zip(*(b.column(c).to_pylist() for c in ("id", "text", "y"))):
                idx, sizes = features([t], memory)
                u, c = np.unique(idx, return_counts=True)
                rows.append((zlib.crc32(str(i).encode()), u.astype(np.uint32), (c * (SCALE / max(1, int(sizes[0])))).astype(np.float32), y))
        rows.sort(key=lambda r: r[0])
        w, bias = fit([r[1:] for r in rows])
        at = np.flatnonzero(w)
        yield pa.RecordBatch.from_arrays([pa.array([*at.tolist(), -1], pa.int32()), pa.array([*w[at].tolist(), bias])], names=["i", "w"])

    got = sample.mapInArrow(learn, "i int, w double").toPandas()
    weights = np.zeros(1 << BITS, np.float32)
    bias = float(got.w[got.i < 0].sum())
    got = got[got.i >= 0]
    weights[got.i.to_numpy()] = got.w.to_numpy()
    return weights, bias


def scored(docs: DataFrame, weights: np.ndarray, bias: float, keep: list[str], text: str = "text") -> DataFrame:
    """docs' columns `keep` and, last, the score (underscores before the name if taken)."""
    sent = docs.sparkSession.sparkContext.broadcast((weights, bias))  # 2**BITS floats: 1 MB
    state: dict = {}

    def run(texts):
        memory = state.setdefault("memory", Hashes())
        w, b = sent.value
        return {"score": pa.array(scores(texts, w, b, memory))}

    made = map_texts(docs, text, keep, run, T.StructType([T.StructField("score", T.DoubleType())]))
    return made.toDF(*keep, free_name(docs.select(*[F.col(f"`{c}`") for c in keep]), "score"))


def quality_filter(docs: DataFrame, labels: DataFrame, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs that score `threshold` or more, with docs' own columns."""
    keep = docs.columns
    out = scored(docs, *train(docs, labels, text=text), keep, text)
    return out.where(F.col(f"`{out.columns[-1]}`") >= threshold).select(*[F.col(f"`{c}`") for c in keep])


def op6_ftrl_quality(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = scored(docs, *train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")), ["doc_id"])
    return out.select("doc_id", (fold(F.col("doc_id")) == 0).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
