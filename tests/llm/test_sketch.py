import hashlib
import re

from pyspark.sql import functions as F

from loomframe.llm import sketch as K
from tests.llm.conftest import SF


def shingles(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def like(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def expected(rows):
    """(doc, edited text, next text) by the rule, for rows of different ids."""
    down = sorted(rows, key=lambda r: -r[0])
    for i, (doc, text) in enumerate(down):
        text, after = text or "", down[(i + 1) % len(down)][1] or ""
        h = len(text) // 2
        yield doc, text, text[: len(text) - h] + after[:h], after


def test_query_against_brute_force(spark, documents):
    got = {r.doc_id: r for r in K.op5_bottom_k_sketch(spark, SF).collect()}
    assert len(got) == len(documents)
    off = []
    for doc, text, edited, after in expected(documents):
        r = got[doc]
        assert r.n_chars == len(text) and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        off += [abs(r.near_edited - like(shingles(text), shingles(edited))), abs(r.near_next - like(shingles(text), shingles(after)))]
        n = len(shingles(text))
        assert abs(r.n_shingles - n) <= max(0.5, 0.45 * n)
        assert (r.fingerprint == r.edited_fingerprint) == (r.near_edited == 1.0)
    assert sum(off) / len(off) < 0.03 and max(off) < 0.25


def test_order_and_copies_over_many_buckets(spark):
    rows = [(i * i - 50_000, f"text {i}") for i in range(2000)] + [(10**15, "far")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(9)
    out = K.next_texts(df)
    assert out.where("not is_copy").count() == len(rows)
    from pyspark.sql import Window as W

    w = W.partitionBy("bucket").orderBy("is_copy", F.desc("id"))
    got = {r.id: r.next for r in out.withColumn("next", F.lead("text").over(w)).where("not is_copy").collect()}
    down = sorted(rows, key=lambda r: -r[0])
    assert got == {r[0]: down[(i + 1) % len(down)][1] for i, r in enumerate(down)}


def test_merging(spark):
    text = [" ".join(f"w{i}" for i in range(a, b)) for a, b in ((0, 400), (200, 700), (650, 900))]
    df = spark.createDataFrame([(i, "p", t) for i, t in enumerate(text)], "doc_id long, part string, text string")
    each = K.sketched(df)
    whole = K.merge_parts(each, "part").first()["sketch"]
    union = set()
    for r in each.collect():
        union |= set(r.sketch)
    assert whole == sorted(union)[: K.K]
    n = spark.createDataFrame([(whole,)], "s array<bigint>").select(K.distinct_shingles(F.col("s"))).first()[0]
    true = len(shingles(text[0]) | shingles(text[1]) | shingles(text[2]))
    assert abs(n - true) < 0.3 * true


def test_edges(spark, edge, empty, tmp_path):
    edge.write.parquet(str(tmp_path / "a" / "documents.parquet"))
    empty.write.parquet(str(tmp_path / "b" / "documents.parquet"))
    rows = K.op5_bottom_k_sketch(spark, str(tmp_path / "a")).collect()
    assert len(rows) == edge.count()
    by = {r.doc_id: r for r in rows}
    assert by[1].fingerprint == "" and by[1].n_chars == 0 and by[1].near_edited == 1.0
    assert len({r.fingerprint for r in rows if r.doc_id in (5, 6)}) == 1
    assert K.op5_bottom_k_sketch(spark, str(tmp_path / "b")).count() == 0


def test_no_python_on_the_executors(spark):
    plan = K.op5_bottom_k_sketch(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_a_hot_part_of_copies_merges(spark):
    df = spark.range(30_000).selectExpr("id as doc_id", "'p' as part", "case when id % 2 = 0 then 'one text of more than five words' else concat('text number ', id % 50, ' of a part that is hot') end as text")
    each = K.sketched(df)
    union = set()
    for r in each.select("sketch").distinct().collect():
        union |= set(r.sketch)
    merged = K.merge_parts(each, "part").collect()
    assert len(merged) == 1 and merged[0]["sketch"] == sorted(union)[: K.K]
    none = K.merge_parts(spark.createDataFrame([(None, []), ("a", None)], "part string, sketch array<bigint>"), "part")
    assert {r.part: r.sketch for r in none.collect()} == {None: [], "a": []}
