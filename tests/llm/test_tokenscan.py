import numpy as np
import pytest

from loomframe.llm import tokens
from loomframe.llm import tokenscan as X
from tests.llm.conftest import SF


def test_query_counts_every_document(spark, documents):
    rows = X.op4_separator_scan(spark, SF).collect()
    ids = tokens.encoder(tokens.vocabulary(), special=False)([t for _, t in documents])
    assert sorted(r.tokens for r in rows) == sorted(len(x) for x in ids) and all(r.terminated for r in rows)
    at = {}
    for r in sorted(rows, key=lambda r: (r.part, r.roll, r.ordinal)):
        start, n = at.get((r.part, r.roll), (0, 0))
        assert (r.start, r.ordinal) == (start, n)
        at[r.part, r.roll] = (start + r.tokens + 1, n + 1)


def scan(spark, path, **options):
    return [(r.ordinal, r.start, r.tokens, r.terminated) for r in X.scan_token_files(spark, str(path), **options).orderBy("file", "ordinal").collect()]


def brute(a, end):
    out, start = [], 0
    for i, v in enumerate(a):
        if v == end:
            out.append((len(out), start, i - start, True))
            start = i + 1
    if start < len(a):
        out.append((len(out), start, len(a) - start, False))
    return out


@pytest.mark.parametrize("width", [2, 4])
@pytest.mark.parametrize("block", [1, 3, 16, 1000])
def test_blocks_are_stitched(spark, tmp_path, block, width):
    rng = np.random.default_rng(block)
    a = np.where(rng.random(500) < 0.1, 9, rng.integers(10, 2560, 500)).astype(f"<u{width}")
    a.tofile(tmp_path / "a.bin")
    assert scan(spark, tmp_path, end=9, width=width, block_tokens=block) == brute(a, 9)


def test_edges(spark, tmp_path, edge, empty):
    (tmp_path / "a.bin").write_bytes(b"")
    np.array([9, 9, 5], "<u2").tofile(tmp_path / "b.bin")
    assert scan(spark, tmp_path, end=9) == [(0, 0, 0, True), (1, 1, 0, True), (2, 2, 1, False)]
    (tmp_path / "c.bin").write_bytes(b"abc")
    with pytest.raises(Exception, match="whole number"):
        scan(spark, tmp_path, end=9)
    X.write_token_files(edge, str(tmp_path / "edge"))
    rows = scan(spark, tmp_path / "edge")
    assert len(rows) == edge.count() and [r[2] for r in rows].count(0) == 2
    X.write_token_files(empty, str(tmp_path / "none"))
    assert scan(spark, tmp_path / "none") == []


def test_a_file_of_many_blocks_is_many_tasks(spark, tmp_path):
    """A task reads its own blocks of a file and holds one at a time; documents cross blocks and tasks."""
    rng = np.random.default_rng(2)
    block = 128
    a = np.where(rng.random(block * X.TASK_BLOCKS * 5 + 17) < 0.003, 9, rng.integers(10, 2560, block * X.TASK_BLOCKS * 5 + 17)).astype("<u2")
    a.tofile(tmp_path / "a.bin")
    found = X.separators(spark, str(tmp_path), 9, 2, block)
    rows = found.collect()
    assert len(rows) == -(-len(a) // block) and max(r.tokens for r in rows) == block
    assert found.rdd.getNumPartitions() > 1
    assert scan(spark, tmp_path, end=9, block_tokens=block) == brute(a, 9)


def test_the_query_leaves_no_files(spark):
    import os

    X.op4_separator_scan(spark, SF).count()
    assert not any(n.startswith("tokens-") for n in os.listdir(spark.conf.get("spark.checkpoint.dir")))


def test_paths_of_unknown_stores_are_refused():
    with pytest.raises(ValueError, match="store"):
        X.opened("nosuch://somewhere/file")
