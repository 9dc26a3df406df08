"""Quality rules: repetition inside a document, found with a suffix array over its words.

A document's words are the runs of bytes outside x20 and x09-x0D. The suffix array of each
document is built by prefix doubling, vectorised over many documents at once (a word's first
rank holds its document, so suffixes of different documents never compare equal). Ranks of
every doubling level are kept; they give the longest common prefix of neighbouring suffixes
by binary descent. A position's longest repeated substring is the larger of the prefixes
shared with its two neighbours; the union of these spans is the union of all maximal repeats
(every longest-common-prefix interval's occurrences).

Defined results: null or blank text has no words and no repeats; ties and repeated rows
are judged row by row; a very long text is processed whole, alone in its batch.
"""

from __future__ import annotations

from collections import defaultdict
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomframe.llm.common import free_name, map_texts, ship

ship(__name__)

#: Rule limits (production parameters).
MIN_REPEAT_WORDS = 8
MAX_COVERED = 0.4
MAX_LONGEST = 50
MIN_WORDS = 50
WINDOW = 3
MAX_WINDOW_PERCENT = 50


def longest_repeats(words: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """For each position the words of the longest substring that starts there and occurs again in its document.

    words: ids of the words of all documents, one after the other; ends: where each document ends.
    """
    n = len(words)
    out = np.zeros(n, np.int64)
    if n < 2:
        return out
    lengths = np.diff(ends, prepend=0)
    doc = np.repeat(np.arange(len(ends), dtype=np.int64), lengths)
    end = np.repeat(np.asarray(ends, np.int64), lengths)

    def groups(key: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The order that sorts key, the start of each sorted item's group, and whether that group has others."""
        order = np.argsort(key, kind="stable")
        s = key[order]
        new = np.empty(len(s), bool)
        new[0] = True
        np.not_equal(s[1:], s[:-1], out=new[1:])
        start = np.maximum.accumulate(np.where(new, np.arange(len(s)), 0))
        many = ~new
        many[:-1] |= ~new[1:]
        return order, start, many

    order, start, many = groups(doc * (int(words.max()) + 1) + words)
    rank = np.empty(n, np.int32 if n < 1 << 31 else np.int64)  # a level of doubling is kept for each bit of the longest repeat
    rank[order] = start
    levels, width = [rank], 1
    active = order[many]
    while len(active):
        rank = levels[-1]
        ahead = active + width
        inside = ahead < end[active]
        follow = np.where(inside, rank[np.minimum(ahead, n - 1)].astype(np.int64) + 1, 0)
        base = rank[active].astype(np.int64)
        order, start, many = groups(base * (n + 1) + follow)
        sorted_base = base[order]
        first = np.empty(len(order), bool)
        first[0] = True
        np.not_equal(sorted_base[1:], sorted_base[:-1], out=first[1:])
        group = np.maximum.accumulate(np.where(first, np.arange(len(order)), 0))
        active = active[order]
        rank = rank.copy()
        rank[active] = sorted_base + start - group
        levels.append(rank)
        width *= 2
        active = active[many]
    pair_at = np.flatnonzero(np.bincount(levels[0], minlength=n)[levels[0]] > 1)
    if not len(pair_at):
        return out
    suffixes = pair_at[np.argsort(levels[-1][pair_at], kind="stable")]
    a, b = suffixes[:-1], suffixes[1:]
    same = levels[0][a] == levels[0][b]
    a, b = a[same], b[same]
    shared = np.zeros(len(a), np.int64)
    for level in range(len(levels) - 1, -1, -1):
        x, y = a + shared, b + shared
        ok = (x < end[a]) & (y < end[b])
        r = levels[level]
        equal = ok & (r[np.minimum(x, n - 1)] == r[np.minimum(y, n - 1)])
        shared[equal] += 1 << level
    np.maximum.at(out, a, shared)
    np.maximum.at(out, b, shared)
    return out


def covered(longest: np.ndarray, least: int) -> np.ndarray:
    """Whether each position lies in some repeat of `least` words or more: the union of the spans."""
    n = len(longest)
    edge = np.zeros(n + 1, np.int64)
    at = np.flatnonzero(longest >= least)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + longest[at], -1)
    return np.cumsum(edge[:-1]) > 0


def measure(texts: list, min_repeat: int = MIN_REPEAT_WORDS, spans: bool = False) -> dict:
    """The figures of each text (bytes or None) as Arrow arrays; see repetition_stats."""
    ids: dict = defaultdict(count().__next__)
    parts, n_words, chars, symbols, dup_lines = [], [], [], [], []
    for t in texts:
        t = t or b""
        w = t.split()
        n_words.append(len(w))
        parts.append(np.fromiter(map(ids.__getitem__, w), np.int64, len(w)))
        whites = len(t) - sum(map(len, w))
        chars.append(len(t.decode("utf-8", "replace")) - whites)
        symbols.append(len(t) - len(t.translate(None, b"#*$%&|<>")))
        lines = [x for x in t.split(b"\n") if x.strip()]
        dup_lines.append(len(lines) - len(set(lines)))
    words = np.concatenate(parts) if parts else np.zeros(0, np.int64)
    ends = np.cumsum(n_words)
    longest = longest_repeats(words, ends)
    total = np.concatenate([[0], np.cumsum(covered(longest, WINDOW))])
    wide = covered(longest, min_repeat)
    total_wide = np.concatenate([[0], np.cumsum(wide)])
    starts = ends - n_words
    top = np.array([longest[s:e].max(initial=0) for s, e in zip(starts, ends)], np.int64)
    out = {
        "n_words": pa.array(n_words, pa.int64()),
        "word_chars": pa.array(chars, pa.int64()),
        "n_symbols": pa.array(symbols, pa.int64()),
        "n_dup_lines": pa.array(dup_lines, pa.int64()),
        "n_repeat_words": pa.array(total[ends] - total[starts], pa.int64()),
        "n_covered": pa.array(total_wide[ends] - total_wide[starts], pa.int64()),
        "longest_repeat": pa.array(top, pa.int64()),
    }
    if spans:
        rows = []
        for s, e in zip(starts, ends):
            flag = np.diff(np.concatenate([[0], wide[s:e].astype(np.int8), [0]]))
            rows.append([{"start": int(i), "words": int(j - i)} for i, j in zip(np.flatnonzero(flag == 1), np.flatnonzero(flag == -1))])
        out["repeat_spans"] = pa.array(rows, pa.list_(pa.struct([("start", pa.int64()), ("words", pa.int64())])))
    return out


STATS = T.StructType([T.StructField(c, T.LongType()) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_covered", "longest_repeat")])
SPANS = T.StructField("repeat_spans", T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("words", T.LongType())])))


def repetition_stats(df: DataFrame, text: str = "text", keep: list[str] | None = None, min_repeat: int = MIN_REPEAT_WORDS, spans: bool = False) -> DataFrame:
    """Each row's `keep` columns (all by default) with its repetition figures.

    n_words, word_chars, n_symbols, n_dup_lines: words, code points in words, characters of
    ``#*$%&|<>``, lines with a word equal to an earlier line. n_repeat_words: words in repeats of
    three words or more. n_covered: words in repeats of min_repeat words or more. longest_repeat:
    words of the longest repeat. repeat_spans (on request): the union of the latter's spans.
    A column of df with one of these names is kept under its own name; the figure gets underscores before it.
    """
    keep = df.columns if keep is None else keep
    schema = T.StructType([*STATS.fields, *([SPANS] if spans else [])])
    made = map_texts(df, text, keep, lambda texts: measure(texts, min_repeat, spans), schema)
    probe = df.select(*[F.col(f"`{c}`") for c in keep])
    return made.toDF(*keep, *[free_name(probe, f.name) for f in schema.fields])


def with_verdict(stats: DataFrame, named=lambda c: c, max_covered: float = MAX_COVERED, max_longest: int = MAX_LONGEST, min_words: int = MIN_WORDS) -> tuple:
    """Columns (base_failed, kept) for a frame of repetition_stats; named gives a figure's column name."""
    n, w, cov, top = (F.col(f"`{named(c)}`") for c in ("n_words", "n_repeat_words", "n_covered", "longest_repeat"))
    failed = (n < min_words) | (100 * w > MAX_WINDOW_PERCENT * n)
    return failed, ~failed & (cov <= F.lit(max_covered) * n) & (top <= max_longest)


def quality_filter(df: DataFrame, text: str = "text", **limits) -> DataFrame:
    """The rows of df that the rules keep, with df's own columns only."""
    keep = df.columns
    stats = repetition_stats(df, text)
    name = dict(zip([f.name for f in STATS.fields], stats.columns[len(keep) :]))
    return stats.where(with_verdict(stats, name.__getitem__, **limits)[1]).select(*[F.col(f"`{c}`") for c in keep])


def op1_repetition_rules(spark, sf_dir: str) -> DataFrame:
    stats = repetition_stats(spark.read.parquet(f"{sf_dir}/documents.parquet"), keep=["doc_id"])
    failed, kept = with_verdict(stats)
    return stats.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), kept.alias("kept"), "n_covered")


def _grams(name: str, k: int) -> str:
    """A table of the places of k-word windows that their document holds twice or more."""
    return f"""{name} AS (SELECT id, i FROM (SELECT id, i, count(*) OVER (PARTITION BY id, g) AS n FROM
 (SELECT id, i, array_to_string(w[i:i + {k - 1}], ' ') AS g FROM (SELECT id, w, unnest(range(1, len(w) - {k - 2})) AS i FROM words WHERE len(w) >= {k}))) WHERE n > 1)"""


#: The rules without suffix arrays: a repeat of k words or more is a chain of k-word windows found twice.
OP1_SQL = f"""WITH words AS (SELECT row_number() OVER () AS id, doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
{_grams("small", WINDOW)}, {_grams("wide", MIN_REPEAT_WORDS)}, {_grams("huge", MAX_LONGEST + 1)},
in_small AS (SELECT id, count(DISTINCT p) AS n FROM (SELECT id, i + unnest(range({WINDOW})) AS p FROM small) GROUP BY 1),
in_wide AS (SELECT id, count(DISTINCT p) AS n FROM (SELECT id, i + unnest(range({MIN_REPEAT_WORDS})) AS p FROM wide) GROUP BY 1),
lines AS (SELECT id, count(*) - count(DISTINCT l) AS n FROM (SELECT id, unnest(string_split(t, chr(10))) AS l FROM words) WHERE regexp_matches(l, '[^\\x20\\x09-\\x0D]') GROUP BY 1),
f AS (SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars, length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
 coalesce(lines.n, 0)::BIGINT AS n_dup_lines, coalesce(in_small.n, 0)::BIGINT AS n_repeat_words, coalesce(in_wide.n, 0)::BIGINT AS n_covered, words.id IN (SELECT id FROM huge) AS too_long
 FROM words LEFT JOIN lines ON lines.id = words.id LEFT JOIN in_small ON in_small.id = words.id LEFT JOIN in_wide ON in_wide.id = words.id)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_WINDOW_PERCENT} * n_words AS base_failed,
 NOT (n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_WINDOW_PERCENT} * n_words) AND n_covered <= {MAX_COVERED} * n_words AND NOT too_long AS kept, n_covered FROM f"""
