import zlib

import numpy as np

from loomframe.llm import sharding as D
from tests.llm.conftest import SF


def check(rows, texts, law, n=24):
    sizes, slots = {}, {}
    for r in rows:
        sizes[r.shard] = sizes.get(r.shard, 0) + r.size
        slots.setdefault(r.shard, []).append(r.slot)
    for s in slots.values():
        assert sorted(s) == list(range(len(s)))
    if law == "rows":
        counts = [len(slots.get(s, [])) for s in range(n)]
        assert max(counts) - min(counts) <= 1
    else:
        top = max(r.size for r in rows)
        for s in range(n):
            assert abs(sizes.get(s, 0) - sum(sizes.values()) / n) <= top


def test_query(spark, documents):
    rows = D.op3_sampled_splitters(spark, SF).collect()
    texts = dict(documents)
    assert sorted(r.doc_id for r in rows) == sorted(texts)
    for r in rows:
        raw = texts[r.doc_id].encode()
        assert r.size == len(raw) + 8 and r.text_crc32 == zlib.crc32(raw) and r.law == "bytes" and r.grown_shard is None
    check(rows, texts, "bytes")


def test_hot_texts_and_laws(spark):
    rows = [(i, "hot" if i % 3 == 0 else f"text {i} " * (i % 17)) for i in range(9000)] + [(4, "twin"), (4, "twin")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    for law in ("bytes", "rows"):
        got = D.sharded(df, law=law).collect()
        assert len(got) == len(rows)
        check(got, None, law)


def test_overfull_ranges_are_subdivided(spark):
    df = spark.range(20_000).selectExpr("case when id < 15000 then 7 else id end as h", "id as i", "id as r", "cast(1 as long) as size")
    out, total, rows = D.placed(df, range_rows=1000)
    parts = out.groupBy("part").count().collect()
    assert total == rows == 20_000 and max(r["count"] for r in parts) <= 2 * 1000
    assert sorted(r.place for r in out.select("place").collect()) == list(range(20_000))
    placed = out.orderBy("place").select("h", "i").collect()
    assert placed == sorted(placed)


def test_splitters_find_places():
    rng = np.random.default_rng(3)
    keys = [tuple(int(v) for v in k) for k in rng.integers(0, 5, (300, 3))]
    s = D.Splitters(keys[:40])
    got = s.find(*(np.array([k[i] for k in keys], np.int64) for i in range(3)))
    assert got.tolist() == [sum(b <= k for b in s.keys) for k in keys]


def test_edges(edge, empty):
    rows = D.sharded(edge).collect()
    assert len(rows) == edge.count() and {r.size for r in rows if r.id in (1, 2)} == {8}
    assert {r.text_crc32 for r in rows if r.id == 1} == {0}
    assert D.sharded(empty).count() == 0


def test_other_draws_cut_elsewhere_within_the_law(spark):
    for n in (200, 1000, 20_000):
        df = spark.range(n).selectExpr("id as doc_id", "case when id % 3 = 0 then 'hot' else repeat(cast(id as string), cast(id % 40 as int)) end as text").repartition(4)
        ends = []
        for seed in (1, 99):
            rows = D.sharded(df, seed=seed).collect()
            assert len(rows) == n
            check(rows, None, "bytes")
            held = {}
            for r in rows:
                held.setdefault(r.shard, set()).add(r.range)
            ranges = [x for h in held.values() for x in h]
            assert len(ranges) == len(set(ranges))  # a shard is a union of whole ranges
            ends.append(sorted((r.id, r.shard) for r in rows))
        assert ends[0] != ends[1]


def test_ranges_that_stay_overfull_raise(spark, monkeypatch):
    import pytest

    monkeypatch.setattr(D, "ROUNDS", 0)
    with pytest.raises(RuntimeError, match="overfull"):
        D.sharded(spark.createDataFrame([(1, "a"), (2, "b")], "doc_id long, text string"), n_shards=2)


def test_a_key_that_many_records_share_is_a_range(spark):
    df = spark.range(12_000).selectExpr("case when id < 9000 then 7 else id end as h", "0L as i", "case when id < 9000 then 1 else id end as r", "1L as size")
    out, total, rows = D.placed(df, range_rows=500)
    assert total == rows == 12_000 and sorted(r.place for r in out.select("place").collect()) == list(range(12_000))
    hot = {r.part for r in out.where("h = 7").select("part").distinct().collect()}
    assert len(hot) == 1


def test_clashing_names_and_a_long_text(spark):
    df = spark.createDataFrame([(1, "x" * 3_000_000, 5, 5), (2, "y", 6, 6), (None, None, 7, 7)], "doc_id long, text string, h int, size int")
    rows = D.sharded(df, n_shards=2).collect()
    assert sorted(r.size for r in rows) == [8, 9, 3_000_008] and {r.slot for r in rows} <= {0, 1}
