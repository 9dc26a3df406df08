"""Mixing sources to target weights by iterative proportional fitting.

Tokens are summed in cells of source, language and topic; a category without a target of its own is
pooled as `other`, so the number of cells is bounded by the targets and not by the corpus. The cells' weights are raked
in turn to each marginal until all agree, with every document's probability held at 1 at the most: cells
that reach it give up what they can't hold to the others of the marginal. Where the share of tokens asked for can't be had so, the sample takes
less, until the targets are met; what cells without tokens make
impossible is returned as the residual and warned of. Documents are then drawn by
their cell's probability, decided by a hash of id and text, so that a run repeated gives the same
sample and equal rows fall alike. The cells are joined back by broadcast (at most MAX_CELLS rows).

Targets are shares by category, or a number: the exponent that tempers the categories' own shares (1 keeps them, 0
makes them equal), taken from the tokens of all rows for the MAX_CATEGORIES largest, none over LIFT times its own share. Topics are a column of the table, or by default
KINDS kinds of text (kinds.py), fitted to all rows.

Defined results: a null category is `other`; a null or blank text has no tokens and is drawn with its cell's
probability; targets of categories that no document has are dropped and the others scaled up; ties can't arise, as draws are independent; repeated
rows are drawn together; a very long text counts whole; columns called as the new ones keep their names and the new ones get underscores; an
empty table gives an empty sample.
"""

from __future__ import annotations

import warnings

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomframe.llm import kinds
from loomframe.llm.common import free_name, map_texts, ship, stored
from loomframe.llm.tokens import encoder, rank_file, vocabulary

ship(__name__)

OTHER = "other"
MAX_CELLS = 100_000
MAX_CATEGORIES = 200
#: The most that tempering raises a category's share: within 1 / SHARE, so that the category has the tokens.
LIFT = 1.5
ROUNDS, TOLERANCE = 2_000, 1e-9
#: By how much the sample's share of tokens shrinks in a try.
SHRINK = 0.95
#: A larger residual is warned of.
MISSED = 1e-3
#: What the registered query and the pipeline rake to: tempered shares of the sources and topics found, fixed shares of languages.
SOURCES = 0.7
LANGS = {"en": 0.55, "de": 0.15, "fr": 0.15, "es": 0.1, OTHER: 0.05}
TOPICS = 0.7
#: Share of all tokens that the sample aims at.
SHARE = 0.6


def free(tokens: np.ndarray, codes: list[np.ndarray], goals: list[np.ndarray]) -> np.ndarray:
    """Weights that meet the goals (tokens of each category), whatever their size: plain iterative proportional fitting."""
    w = np.where(tokens > 0, 1.0, 0.0)
    for _ in range(ROUNDS):
        before = w
        for code, goal in zip(codes, goals):
            have = np.bincount(code, tokens * w, len(goal))
            w = w * np.where(have > 0, goal / np.maximum(have, 1e-300), 0.0)[code]
        if np.abs(w - before).max() < TOLERANCE:
            break
    return w


def held(tokens: np.ndarray, codes: list[np.ndarray], goals: list[np.ndarray], p: np.ndarray) -> np.ndarray:
    """Probabilities of 1 at the most, fitted from p: what cells at 1 can't hold goes to the others of their category."""
    for _ in range(ROUNDS // 10):
        before = p
        for code, goal in zip(codes, goals):
            for _ in range(8):
                full = p >= 1.0
                fixed = np.bincount(code, np.where(full, tokens, 0.0), len(goal))
                loose = np.bincount(code, np.where(full, 0.0, tokens * p), len(goal))
                down = fixed + loose > goal
                ratio = np.where(down, goal / np.maximum(fixed + loose, 1e-300), np.where(loose > 0, np.maximum(goal - fixed, 0) / np.maximum(loose, 1e-300), 1.0))
                new = np.minimum(1.0, p * np.where(full & ~down[code], 1.0, ratio[code]))
                still = np.abs(new - p).max() < TOLERANCE
                p = new
                if still:
                    break
        if np.abs(p - before).max() < TOLERANCE:
            break
    return p


def rake(tokens: np.ndarray, codes: list[np.ndarray], targets: list[np.ndarray], share: float = SHARE) -> np.ndarray:
    """Probability of each cell: the shares of tokens * probability are the targets, their sum is `share` of all or the most found that probabilities up to 1 allow.

    codes: each cell's category in each marginal; targets: the categories' shares of the sample's tokens.
    """
    total = tokens.sum()
    if total <= 0:
        return np.full(len(tokens), min(1.0, share))
    goals = []
    for code, goal in zip(codes, targets):
        goal = np.where(np.bincount(code, tokens, len(goal)) > 0, goal, 0.0)
        goals.append(goal / max(goal.sum(), 1e-300) * total)
    w = free(tokens, codes, goals)
    least = max(residuals(tokens, codes, targets, w))  # what no probabilities can better
    top = 1.0 / max(w.max(), 1e-300)
    reached = top * (tokens * w).sum() / total  # the share at which the plain weights are probabilities
    s, best = min(1.0, share), None
    while s > reached and best is None:
        p = held(tokens, codes, [g * s for g in goals], np.minimum(1.0, w * s))
        best = p if max(residuals(tokens, codes, targets, p)) <= least + 1e-6 else None
        s *= SHRINK
    if best is None:
        best = w * min(share / max((tokens * w).sum() / total, 1e-300), top)
    return np.where(tokens > 0, np.minimum(best, 1.0), min(1.0, share))


def residuals(tokens: np.ndarray, codes: list[np.ndarray], targets: list[np.ndarray], p: np.ndarray) -> list[float]:
    """How far each marginal of tokens * p is from its targets, of the categories that have tokens: the largest difference of shares."""
    out = []
    for code, goal in zip(codes, targets):
        goal = np.where(np.bincount(code, tokens, len(goal)) > 0, goal, 0.0)
        have = np.bincount(code, tokens * p, len(goal))
        out.append(float(np.abs(have / max(have.sum(), 1e-300) - goal / max(goal.sum(), 1e-300)).max(initial=0.0)))
    return out


def tempered(counted: DataFrame, column: str, tokens: str, power: float) -> dict:
    """Targets of the MAX_CATEGORIES categories with the most tokens, all others pooled: their shares of tokens to the power, scaled to 1."""
    sums = counted.where(F.col(f"`{column}`").isNotNull()).groupBy(F.col(f"`{column}`").cast("string").alias("c")).agg(F.sum(f"`{tokens}`").alias("n"))
    rows = sums.orderBy(F.desc("n"), "c").limit(MAX_CATEGORIES).collect()
    total = float(counted.agg(F.sum(f"`{tokens}`")).first()[0] or 0)
    out = {r.c: float(r.n or 0) for r in rows if r.c != OTHER}
    out[OTHER] = max(0.0, total - sum(out.values()))
    return limited({c: n / max(1.0, total) for c, n in out.items()}, power)


def limited(shares: dict, power: float) -> dict:
    """shares to a power, scaled to 1, none over LIFT times what it was: what is cut off goes to the others in proportion."""
    out = {c: x**power if x > 0 else 0.0 for c, x in shares.items()}
    capped: set = set()
    while True:
        left = 1.0 - sum(LIFT * shares[c] for c in capped)
        loose = sum(x for c, x in out.items() if c not in capped)
        out = {c: LIFT * shares[c] if c in capped else x * left / max(1e-300, loose) for c, x in out.items()}
        over = {c for c in out if c not in capped and out[c] > LIFT * shares[c] * (1 + 1e-12)}
        if not over:
            return out
        capped |= over


def pooled(column: str, targets: dict) -> Column:
    """The category, or OTHER if it has no target of its own."""
    c = F.col(f"`{column}`").cast("string")
    return F.when(c.isin([k for k in targets if k != OTHER]), c).otherwise(F.lit(OTHER))


def mixed(docs: DataFrame, id_col: str = "doc_id", text: str = "text", source: str = "source", lang: str = "lang", topic: str | None = None, targets: tuple = (SOURCES, LANGS, TOPICS), share: float = SHARE, seed: int = 7, tokenizer: str | None = None, keep: list[str] | None = None) -> tuple[DataFrame, list[str]]:
    """docs' columns `keep` (all by default) with five more, whose names are given: tokens, topic, probability, drawn (boolean), residual.

    topic: a column of docs; by default the kind of text. Tokens are ids of the
    tokenizer (a vocabulary file, by default that of packing). residual: the largest miss of a marginal's target, the same on every row.
    """
    vocab = tokenizer or vocabulary()
    ranks = rank_file(vocab)
    keep = docs.columns if keep is None else keep
    n_tokens, made_topic, probability, drawn, residual = (free_name(docs, c) for c in ("tokens", "topic", "probability", "drawn", "residual"))
    names = [c for c in (source, lang, topic) if c]
    # texts are read once: what raking and drawing need is made here
    u = F.pmod(F.xxhash64(F.col(f"`{id_col}`"), F.col(f"`{text}`"), F.lit(seed)), F.lit(1 << 40)) / float(1 << 40)
    plain = docs.select(*[F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(keep)], *[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names)], u.alias("u"), F.col(f"`{text}`").alias("text"))

    def read(texts):
        ids = encoder(vocab, ranks=ranks)([(t or b"").decode("utf-8", "replace") for t in texts])
        made = {"tokens": pa.array([len(x) for x in ids], pa.int64())}
        return made if topic else made | {"style": pa.array(list(kinds.style(texts)), pa.list_(pa.float64()))}

    fields = [T.StructField("tokens", T.LongType())] + ([] if topic else [T.StructField("style", T.ArrayType(T.DoubleType()))])
    counted = stored(map_texts(plain, "text", [c for c in plain.columns if c != "text"], read, T.StructType(fields)), "counted")
    if topic:
        placed = counted.withColumn("topic", F.col("c2").cast("string"))
    else:
        placed = counted.withColumn("topic", kinds.nearest("style", kinds.fitted(counted, "style")))
    columns = ["c0", "c1", "topic"]
    goals = [t if isinstance(t, dict) else tempered(placed, c, "tokens", float(t)) for c, t in zip(columns, targets)]
    bound = int(np.prod([len({*t, OTHER}) for t in goals]))
    if bound > MAX_CELLS:
        raise ValueError(f"the targets make {bound} cells; {MAX_CELLS} is the most")
    cells = ["s", "l", "t"]
    in_cells = placed.select(*[pooled(c, t).alias(a) for c, t, a in zip(columns, goals, cells)], "tokens")
    sums = in_cells.groupBy(*cells).agg(F.sum("tokens").alias("n")).collect()  # at most MAX_CELLS
    p, miss = [], 0.0
    if sums:
        listed = [sorted({*t, OTHER}) for t in goals]
        codes = [np.array([at.index(r[c]) for r in sums]) for at, c in zip(listed, cells)]
        shares = [np.array([float(t.get(k, 0.0)) for k in at]) for at, t in zip(listed, goals)]
        n = np.array([float(r["n"]) for r in sums])
        p = rake(n, codes, shares, share)
        misses = residuals(n, codes, shares, p)
        miss = max(misses)
        if miss > MISSED:
            warnings.warn(f"targets are missed by {misses} (source, language, topic)", stacklevel=2)
    table = docs.sparkSession.createDataFrame([(*r[:3], float(x)) for r, x in zip(sums, p)], "s string, l string, t string, p double")
    out = placed.withColumns({a: pooled(c, t) for c, t, a in zip(columns, goals, cells)}).join(F.broadcast(table), cells, "left")
    out = out.select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(keep)], F.col("tokens").alias(n_tokens), F.col("topic").alias(made_topic), F.col("p").alias(probability), (F.col("u") < F.col("p")).alias(drawn), F.lit(miss).alias(residual))
    return out, [n_tokens, made_topic, probability, drawn, residual]


def sample(docs: DataFrame, **options) -> DataFrame:
    """The documents drawn, with docs' own columns."""
    out, (_, _, _, drawn, _) = mixed(docs, **options)
    return out.where(F.col(f"`{drawn}`")).select(*[F.col(f"`{c}`") for c in docs.columns])


def op8_raked_mixing(spark, sf_dir: str) -> DataFrame:
    out, _ = mixed(spark.read.parquet(f"{sf_dir}/documents.parquet"), keep=["doc_id", "source", "lang"])
    return out
