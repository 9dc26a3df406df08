from collections import Counter

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from loomframe.llm import repetition as R
from tests.llm.conftest import SF


def brute(words, k):
    n = len(words)
    seen = Counter(tuple(words[i : i + k]) for i in range(n - k + 1))
    hit = [False] * n
    for i in range(n - k + 1):
        if seen[tuple(words[i : i + k])] > 1:
            hit[i : i + k] = [True] * k
    return sum(hit)


def longest(words):
    best = 0
    for i in range(len(words)):
        for j in range(i + 1, len(words)):
            k = 0
            while j + k < len(words) and words[i + k] == words[j + k]:
                k += 1
            best = max(best, k)
    return best


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.integers(0, 3), max_size=24), min_size=1, max_size=5))
def test_suffix_arrays_of_several_documents(docs):
    got = R.longest_repeats(np.array([w for d in docs for w in d], np.int64), np.cumsum([len(d) for d in docs]))
    at = 0
    for d in docs:
        part = got[at : at + len(d)]
        assert part.max(initial=0) == longest(d)
        for k in (2, 3, 5):
            assert int(R.covered(part, k).sum()) == brute(d, k)
        at += len(d)


def test_query_against_brute_force(spark, documents):
    got = {r.doc_id: r for r in R.op1_repetition_rules(spark, SF).collect()}
    assert len(got) == len(documents)
    for doc, text in documents:
        w = text.encode().split()
        r = got[doc]
        n = len(w)
        assert r.n_words == n and r.n_repeat_words == brute(w, 3) and r.n_covered == brute(w, R.MIN_REPEAT_WORDS)
        assert r.word_chars == sum(len(x.decode()) for x in w)
        assert r.n_symbols == sum(c in "#*$%&|<>" for c in text)
        lines = [x for x in text.split("\n") if x.encode().strip()]
        assert r.n_dup_lines == len(lines) - len(set(lines))
        failed = n < 50 or 100 * r.n_repeat_words > 50 * n
        assert r.base_failed == failed
        assert r.kept == (not failed and r.n_covered <= R.MAX_COVERED * n and not brute(w, R.MAX_LONGEST + 1))


def test_edges(edge, empty):
    out = R.repetition_stats(edge, spans=True)
    assert out.columns[:7] == edge.columns and out.columns[7] == "_n_words"
    rows = {r.doc_id: r for r in out.collect()}
    assert rows[1]["_n_words"] == rows[2]["_n_words"] == rows[3]["_n_words"] == 0
    assert rows[5]["longest_repeat"] == 117 and rows[5]["repeat_spans"][0].words == 120
    assert rows[7]["_n_words"] == 60_000 and rows[7]["longest_repeat"] == 0
    assert R.quality_filter(edge).columns == edge.columns
    assert [r.doc_id for r in R.quality_filter(edge).collect()] == [7]
    assert R.quality_filter(empty).count() == 0


def test_a_long_repeat_is_rejected_and_a_short_one_kept(spark):
    body = [f"w{i}" for i in range(400)]
    texts = [(1, " ".join(body)), (2, " ".join(body + body[:60])), (3, " ".join(body + body[:12]))]
    kept = {r.doc_id for r in R.quality_filter(spark.createDataFrame(texts, "doc_id long, text string")).collect()}
    assert kept == {1, 3}
