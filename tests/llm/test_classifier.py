import zlib

import duckdb
import numpy as np

from loomframe.llm import classifier as C

SF = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    got = {r.doc_id: r for r in C.op6_ftrl_quality(spark, SF).collect()}
    labels = dict(duckdb.sql(f"SELECT doc_id, quality FROM '{SF}/labels.parquet'").fetchall())
    for r in got.values():
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3)
    held = [(labels[d], r) for d, r in got.items() if r.held_out and d in labels]
    assert np.mean([r.predicted == y for y, r in held]) > 0.9


def test_scores_are_sparse_dot_products():
    rng = np.random.default_rng(0)
    w = rng.normal(size=1 << C.BITS).astype(np.float32)
    texts = ["a b a | x", "", "one TWO two!!", None]
    raw = [None if t is None else t.encode() for t in texts]
    got = C.scores(raw, w, 0.25, C.Hashes())
    for t, s in zip(raw, got):
        idx, n = C.features([t], C.Hashes())
        z = 0.25 + C.SCALE * sum(float(w[i]) for i in idx.ravel()) / max(1, n[0])
        assert abs(s - 1 / (1 + np.exp(-z))) < 1e-6


def test_training_separates():
    rng = np.random.default_rng(1)
    rows = []
    for _ in range(400):
        y = int(rng.integers(2))
        idx = np.unique(rng.integers(0, 50, 8) + (0 if y else 40)).astype(np.uint32)
        rows.append((idx, np.ones(len(idx), np.float32), y))
    w, b = C.fit(rows, bits=8)
    assert np.mean([(w[i].sum() + b > 0) == y for i, _, y in rows]) > 0.9


def test_edges(spark, edge, empty):
    labels = spark.createDataFrame([(4, 1), (4, 0), (5, 0), (7, 1), (None, 1), (8, None)], "doc_id long, quality int")
    w, b = C.train(edge, labels)
    out = C.scored(edge, w, b, edge.columns)
    assert out.columns[-1] == "_score" and out.count() == edge.count()
    assert C.quality_filter(edge, labels).columns == edge.columns
    assert C.scored(empty, w, b, ["doc_id"]).count() == 0
    none, zero = C.train(edge, labels.where("false"))
    assert not none.any() and {r.score for r in C.scored(edge, none, zero, ["doc_id"]).collect()} == {0.5}


def test_updates_against_a_reference_loop():
    """Follow the regularised leader, one coordinate after the other, as published."""
    rng = np.random.default_rng(4)
    rows = []
    for _ in range(120):
        idx = np.unique(rng.integers(0, 60, 9)).astype(np.uint32)
        rows.append((idx, rng.uniform(0.1, 3, len(idx)).astype(np.float32), int(rng.integers(2))))
    z, n = {}, {}
    bias_z = bias_n = 0.0

    def weight(i, l1=C.L1, l2=C.L2):
        zi, ni = z.get(i, 0.0), n.get(i, 0.0)
        return 0.0 if abs(zi) <= l1 else -(zi - (1 if zi > 0 else -1) * l1) / ((C.BETA + ni**0.5) / C.ALPHA + l2)

    for _ in range(C.EPOCHS):
        for idx, x, y in rows:
            w = {int(i): weight(int(i)) for i in idx}
            bias = -bias_z / ((C.BETA + bias_n**0.5) / C.ALPHA)
            score = bias + sum(w[int(i)] * float(v) for i, v in zip(idx, x))
            g = 1 / (1 + np.exp(-score)) - y
            for i, v in zip(map(int, idx), map(float, x)):
                step = g * v
                sigma = ((n.get(i, 0.0) + step**2) ** 0.5 - n.get(i, 0.0) ** 0.5) / C.ALPHA
                z[i] = z.get(i, 0.0) + step - sigma * w[i]
                n[i] = n.get(i, 0.0) + step**2
            bias_z += g - ((bias_n + g * g) ** 0.5 - bias_n**0.5) / C.ALPHA * bias
            bias_n += g * g
    got, b = C.fit(rows, bits=6)
    assert np.allclose(got, [weight(i) for i in range(64)], atol=1e-6)
    assert abs(b + bias_z / ((C.BETA + bias_n**0.5) / C.ALPHA)) < 1e-6


def test_training_is_bounded_by_bytes(spark, monkeypatch):
    monkeypatch.setattr(C, "MAX_TRAIN_BYTES", 5_000)
    docs = spark.createDataFrame([(i, ("good words " if i % 2 else "BAD!! ") * 20) for i in range(200)] + [(1000, "BAD!! " * 10_000)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(200)] + [(1000, 1)], "doc_id long, quality int")
    w, b = C.train(docs, labels)
    got = {r.doc_id: r.score for r in C.scored(docs, w, b, ["doc_id"]).collect()}
    assert got[1] > 0.5 > got[0]
