import numpy as np
import xxhash

from loomframe.llm import simhash as S
from loomframe.llm.components import components, forest
from tests.llm.conftest import SF


def slow_fingerprint(text):
    low = bytes(b + 32 if 65 <= b <= 90 else b for b in (text or "").encode())
    w = low.split()
    if not w:
        return 0
    shingles = [b" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or [b" ".join(w)]
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def slow_components(ids, fps):
    root = {i: i for i in range(len(ids))}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(ids)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 2:
                root[find(i)] = find(j)
    least = {}
    for i in range(len(ids)):
        r = find(i)
        least[r] = min(least.get(r, ids[i]), ids[i])
    return [least[find(i)] for i in range(len(ids))]


def test_query_against_brute_force(spark, documents):
    got = {r.doc_id: r for r in S.op7_simhash_byte_index(spark, SF).collect()}
    fps = [slow_fingerprint(t) for _, t in documents]
    want = slow_components([d for d, _ in documents], fps)
    for (doc, _), fp, c in zip(documents, fps, want):
        assert got[doc].fingerprint == f"{fp:016x}" and got[doc].component_id == c


def test_spark_hash_is_the_same(spark):
    from pyspark.sql import functions as F

    assert spark.range(1).select(F.xxhash64(F.lit("a b ç"))).first()[0] % 2**64 == xxhash.xxh64_intdigest("a b ç".encode(), 42)


def test_long_lists_find_the_same_components():
    rng = np.random.default_rng(5)
    for n, bits in ((40, 6), (200, 9), (3000, 16)):
        base = np.uint64(int(rng.integers(1 << 62)))
        fps = np.unique(base ^ rng.integers(0, 1 << bits, n).astype(np.uint64))
        old, S.PAIRWISE = S.PAIRWISE, 0
        try:
            far = S.linked(fps.view(np.int64))
            S.PAIRWISE = 10_000
            near = S.linked(fps.view(np.int64))
        finally:
            S.PAIRWISE = old
        assert sorted(zip(*map(list, forest(*far)))) == sorted(zip(*map(list, forest(*near))))


def test_index_finds_every_link(spark):
    """Random fingerprints with neighbours one and two bits away, in every pair of bytes."""
    rng = np.random.default_rng(1)
    base = rng.integers(0, 1 << 63, 60, dtype=np.uint64)
    some = [int(b) for b in base]
    for b in base[:40]:
        i, j = rng.choice(64, 2, replace=False)
        some += [int(b) ^ 1 << int(i), int(b) ^ 1 << int(i) ^ 1 << int(j)]
    some = sorted(set(some))
    signed = [(x - (1 << 64) if x >= 1 << 63 else x,) for x in some]
    got = {r.node % 2**64: r.root % 2**64 for r in components(S.index_links(spark.createDataFrame(signed, "fp long"))).collect()}
    want = slow_components(list(range(len(some))), some)
    groups = {}
    for x, c in zip(some, want):
        groups.setdefault(c, set()).add(x)
    for g in groups.values():
        assert len({got.get(x, x) for x in g}) == 1
    assert len({got.get(x, x) for x in some}) == len(groups)


def test_chain_and_hub_components(spark):
    chain = [(i, i + 1) for i in range(60)]
    hub = [(1000, i) for i in range(1001, 1200)]
    got = {r.node: r.root for r in components(spark.createDataFrame(chain + hub + [(7, 7)], "a long, b long").repartition(7)).collect()}
    assert all(got[i] == 0 for i in range(1, 61)) and all(got[i] == 1000 for i in range(1001, 1200))


def test_edges(edge, empty):
    rows = S.with_components(edge).collect()
    assert len(rows) == edge.count()
    by = {r.id: r for r in rows}
    assert by[1].fp == by[2].fp == by[3].fp == 0 and by[1].component == by[2].component == by[3].component == 1
    assert by[5].component == by[6].component == 5
    kept = S.near_dedup(edge)
    assert kept.columns == edge.columns
    assert sorted(r.doc_id or 0 for r in kept.collect()) == [0, 1, 4, 5, 7, 8]
    assert S.near_dedup(empty).count() == 0 and S.with_components(empty).count() == 0


def test_the_count_rejects_candidates(spark):
    """Fingerprints that share two pairs of bytes are candidates; those that share fewer than six bytes are not kept, and what is kept is verified."""
    base = 0x0123456789ABCDEF
    near, apart, many_bits = base ^ 1 << 40 ^ 1 << 50, base ^ 0xFF00FFFF << 32, base ^ 0x7 << 60
    u = np.array(sorted([base, near, apart, many_bits]), np.uint64)
    i, j, tally = S.tallied(u)
    shared = {tuple(sorted((int(u[a]), int(u[b])))): int(t) for a, b, t in zip(i, j, tally)}
    assert shared[tuple(sorted((base, apart)))] == 5 and shared[tuple(sorted((base, near)))] == 6 and shared[tuple(sorted((base, many_bits)))] == 7
    a, b = S.linked(u.view(np.int64))
    assert {tuple(sorted((int(x) % 2**64, int(y) % 2**64))) for x, y in zip(a, b)} == {tuple(sorted((base, near)))}
    lists = S.listed(spark.createDataFrame([(int(x),) for x in u.view(np.int64)], "fp long")).collect()
    assert any({base, apart} <= {x % 2**64 for x in r.fps} for r in lists)


def test_hot_lists_are_split_and_lose_no_link(spark):
    """One key of four bytes that thousands share: every part shares six bytes, and components are those of brute force."""
    rng = np.random.default_rng(3)
    fps = sorted({int(x) for x in rng.integers(0, 1 << 32, 1500)} | {int(x) ^ 1 << int(b) for x in rng.integers(0, 1 << 32, 300) for b in rng.integers(0, 32, 2)} | {int(x) for x in rng.integers(0, 1 << 14, 600)})
    df = spark.createDataFrame([(x,) for x in fps], "fp long")
    for r in S.listed(df).collect():
        u = np.array(r.fps, np.int64).view(np.uint64)
        if len(u) > S.PAIRWISE:
            assert (S.tallied(u[:200])[2] >= S.SHARED).all() and len(u) <= 65_536
    got = {r.node: r.root for r in components(S.index_links(df)).collect()}
    want = slow_components(fps, fps)
    groups = {}
    for x, c in zip(fps, want):
        groups.setdefault(c, set()).add(got.get(x, x))
    assert all(len(g) == 1 for g in groups.values()) and len({got.get(x, x) for x in fps}) == len(groups)


def test_a_hot_fingerprint(spark):
    df = spark.range(30_000).selectExpr("id as doc_id", "case when id % 3 = 0 then '' else concat('text ', id, ' of ', id) end as text")
    got = S.with_components(df)
    assert got.where("fp = 0").select("component").distinct().collect()[0][0] == 0 and got.count() == 30_000


def test_rows_that_share_an_id_are_kept_apart(spark):
    a, b = "one text of some eight words or so", "another text that is not like the first"
    df = spark.createDataFrame([(5, a, 1), (6, a, 2), (6, b, 3)], "doc_id long, text string, __keep int")
    got = S.near_dedup(df)
    assert got.columns == df.columns and sorted((r.doc_id, r.text) for r in got.collect()) == [(5, a), (6, b)]
