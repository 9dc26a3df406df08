import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from loomframe.llm import kinds as K
from loomframe.llm import mixing as M
from loomframe.llm.tokens import encoder, vocabulary
from tests.llm.conftest import SF


def test_raking_meets_the_marginals():
    rng = np.random.default_rng(0)
    codes = [rng.integers(0, 4, 60), rng.integers(0, 3, 60), rng.integers(0, 5, 60)]
    tokens = rng.integers(100, 5000, 60).astype(float)
    base = [np.bincount(c, tokens) / tokens.sum() for c in codes]
    goals = [b * rng.uniform(0.8, 1.2, len(b)) for b in base]
    goals = [g / g.sum() for g in goals]
    p = M.rake(tokens, codes, goals, 0.4)
    assert p.max() <= 1
    for c, g in zip(codes, goals):
        assert np.allclose(np.bincount(c, tokens * p) / (tokens * p).sum(), g, atol=1e-5)
    assert abs((tokens * p).sum() / tokens.sum() - 0.4) < 1e-5


def test_targets_out_of_reach_keep_probabilities_within_one():
    p = M.rake(np.array([10.0, 90.0]), [np.array([0, 1])] * 3, [np.array([0.9, 0.1])] * 3, 0.6)
    assert p[0] == 1.0 and 0 <= p[1] < 1


def test_the_share_gives_way_to_the_targets():
    tokens, codes = np.array([10.0, 90.0]), [np.array([0, 1])]
    p = M.rake(tokens, codes, [np.array([0.5, 0.5])], 0.6)
    assert p[0] == 1.0 and abs(p[1] - 1 / 9) < 1e-9


def test_targets_that_cells_make_impossible_are_told(spark):
    """Source a has only English and b only German: their shares can't differ from the languages'."""
    docs = spark.createDataFrame([(i, "some words of a text", "ab"[i % 2], ("en", "de")[i % 2], "x") for i in range(100)], "doc_id long, text string, source string, lang string, topic string")
    with pytest.warns(UserWarning, match="targets are missed"):
        out, _ = M.mixed(docs, topic="topic", targets=({"a": 0.9, "b": 0.1}, {"en": 0.1, "de": 0.9}, 1))
    assert out.first().residual > 0.1


def marginal(rows, key, goals):
    """The largest difference between the shares that the rows' probabilities give and goals."""
    total = sum(r.tokens * r.probability for r in rows)
    have = {}
    for r in rows:
        k = getattr(r, key)
        k = k if k in goals else M.OTHER
        have[k] = have.get(k, 0) + r.tokens * r.probability / total
    return max(abs(have.get(k, 0) - g) for k, g in goals.items())


def tempered(rows, key, power):
    """Shares of tokens to the power, none lifted over 1.5 times: the common factor of the others is found by bisection."""
    sums = {}
    for r in rows:
        sums[getattr(r, key)] = sums.get(getattr(r, key), 0) + r.tokens
    own = {k: n / sum(sums.values()) for k, n in sums.items()}
    low, high = 0.0, 1e6
    for _ in range(200):
        mid = (low + high) / 2
        got = {k: min(mid * x**power, 1.5 * x) for k, x in own.items()}
        low, high = (mid, high) if sum(got.values()) < 1 else (low, mid)
    return got


@pytest.mark.parametrize("sf", ["/root/testdata/sf0.001", "/root/testdata/sf0.01"])
def test_query_meets_its_targets(spark, sf):
    """From the rows alone: token ids of the whole texts, the marginals of tokens * probability, and the draws."""
    rows = M.op8_raked_mixing(spark, sf).collect()
    text = dict(duckdb.sql(f"SELECT doc_id, text FROM '{sf}/documents.parquet'").fetchall())
    assert len(rows) == len(text)
    ids = encoder(vocabulary())([text[r.doc_id] for r in rows])
    assert [r.tokens for r in rows] == [len(x) for x in ids]
    langs = {k: v for k, v in M.LANGS.items() if k in {r.lang for r in rows}}
    langs = {k: v / sum(langs.values()) for k, v in langs.items()}
    assert marginal(rows, "source", tempered(rows, "source", M.SOURCES)) < 1e-3
    assert marginal(rows, "lang", langs) < 1e-3
    assert marginal(rows, "topic", tempered(rows, "topic", M.TOPICS)) < 1e-3
    total = sum(r.tokens for r in rows)
    share = sum(r.tokens * r.probability for r in rows) / total
    assert 0.3 < share <= M.SHARE + 1e-9 and all(0 <= r.probability <= 1 and r.residual < 1e-3 for r in rows)
    assert abs(sum(r.tokens for r in rows if r.drawn) / total - share) < 0.1
    again = {r.doc_id: r.drawn for r in M.op8_raked_mixing(spark, sf).collect()}
    assert again == {r.doc_id: r.drawn for r in rows}


def test_kinds_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    raw = [r.text.encode() for r in docs]
    styles = K.style(raw)
    for t, s in zip(raw[:50], styles):
        digits = sum(48 <= b <= 57 for b in t)
        assert abs(s[list(K._CLASSES).index("digit")] ** 2 - digits / len(t)) < 1e-12
    table = spark.createDataFrame([(r.doc_id, [float(v) for v in s]) for r, s in zip(docs, styles)], "doc_id long, style array<double>")
    model = K.fitted(table, "style")
    mean, scale, centres = map(np.array, model)
    got = {r.doc_id: r.kind for r in table.select("doc_id", K.nearest("style", model).alias("kind")).collect()}
    for r, s in zip(docs, styles):
        apart = (((s - mean) * scale - centres) ** 2).sum(axis=1)
        assert abs(apart[int(got[r.doc_id])] - apart.min()) < 1e-9
    assert len(set(got.values())) > 2 and not K.style([None, b""]).any()


def test_edges(edge, empty):
    out, names = M.mixed(edge)
    assert names[0] == "_tokens" and out.count() == edge.count()
    rows = out.collect()
    assert all(r["probability"] is not None for r in rows)
    assert len({(r["drawn"]) for r in rows if r["doc_id"] == 6}) == 1
    assert M.sample(edge).columns == edge.columns and M.sample(empty).count() == 0
    given = edge.withColumn("about", F.lit("0"))
    assert M.mixed(given, topic="about")[0].count() == edge.count()
    clashing = edge.withColumns({"__p": F.lit(1), "__cell_source": F.lit(1), "topic": F.lit("t"), "u": F.lit(2), "k0": F.lit(3)})
    assert M.sample(clashing).columns == clashing.columns and M.mixed(clashing)[0].count() == edge.count()
