from loomframe.llm import mixing as M
from loomframe.llm.tokens import encoder, vocabulary

SF = "/root/testdata/sf0.01"


def test_weights_are_token_ids(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out, _ = M.mixed(docs)
    rows = out.collect()
    ids = encoder(vocabulary())([r.text for r in rows])
    assert [r.tokens for r in rows] == [len(x) for x in ids]
    total = sum(r.tokens * r.probability for r in rows)
    present = {r.lang for r in rows} & set(M.LANGS)
    for lang in present:
        share = sum(r.tokens * r.probability for r in rows if r.lang == lang) / total
        goal = M.LANGS[lang] / sum(M.LANGS[x] for x in present)
        assert abs(share - goal) < 1e-3, (lang, share, goal)
