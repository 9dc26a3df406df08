import corpus_pipeline as P
from loomframe.llm import classifier, mixing, repetition
from tests.llm.conftest import SF
from tests.llm.test_likeness import slow_roots


def test_stages_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    cols = docs.columns
    first = P.rules(spark, docs, SF)
    assert first.columns == cols
    kept = {r.doc_id for r in repetition.op1_repetition_rules(spark, SF).where("kept").collect()}
    assert {r.doc_id for r in first.collect()} == kept
    second = P.classified(spark, first, SF)
    assert second.columns == cols
    w, b = classifier.train(first, spark.read.parquet(f"{SF}/labels.parquet"))
    good = {r.doc_id for r in classifier.scored(first, w, b, ["doc_id"]).where("score >= 0.3").collect()}
    rows = sorted(second.collect(), key=lambda r: r.doc_id)
    assert {r.doc_id for r in rows} == good
    third = P.dedup(spark, second, SF)
    want = {rows[i].doc_id for i in slow_roots([r.text for r in rows])}  # five words, likeness 0.8: op7's two-bit links bind op7 alone
    assert third.columns == cols and sorted(r.doc_id for r in third.collect()) == sorted(want)
    fourth = P.sampled(spark, third, SF)
    out, _ = mixing.mixed(third)
    assert fourth.columns == cols and {r.doc_id for r in fourth.collect()} == {r.doc_id for r in out.where("drawn").collect()}
    fifth = P.packed(spark, fourth, SF)
    assert {r.doc_id for r in fifth.collect()} == {r.doc_id for r in fourth.collect()}


def test_run(spark):
    rows = P.run(spark, SF).collect()
    assert rows and 4 <= len(P.STAGES) <= 5


def test_edges(spark, edge, empty, tmp_path):
    labels = spark.createDataFrame([(5, 0, 0), (7, 1, 0)], "doc_id long, quality int, toxic int")
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    for table in (edge, empty):
        docs = table
        for i, (_, stage) in enumerate(P.STAGES):
            docs = stage(spark, docs, str(tmp_path))
            if i + 1 < len(P.STAGES):
                assert docs.columns == edge.columns
        docs.collect()
