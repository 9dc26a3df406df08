import random
from fractions import Fraction

from loomframe.llm import likeness as L
from loomframe.llm import simhash as S
from tests.llm.test_simhash import slow_fingerprint

SF = "/root/testdata/sf0.01"


def slow_roots(texts):
    """Components of 5-word Jaccard likeness 0.8 or more, by comparing all pairs; each named by its first text."""
    sets = []
    for t in texts:
        w = bytes(b + 32 if 65 <= b <= 90 else b for b in (t or "").encode()).split()
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))})
    root = list(range(len(sets)))
    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if root[i] != root[j] and 5 * min(len(a), len(b)) >= 4 * max(len(a), len(b)) and 5 * len(a & b) >= 4 * len(a | b):
                low, high = sorted((root[i], root[j]))
                root = [low if r == high else r for r in root]
    return root


def test_near_copies_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id")
    rows = docs.select("doc_id", "text").collect()
    want = {rows[r].doc_id for r in slow_roots([r.text for r in rows])}
    assert sorted(r.doc_id for r in S.near_dedup(docs).select("doc_id").collect()) == sorted(want)


def test_a_pair_many_bits_apart(spark):
    rows = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").where("doc_id in (1, 255)").collect()}
    assert (slow_fingerprint(rows[1]) ^ slow_fingerprint(rows[255])).bit_count() > 2
    got = S.near_dedup(spark.createDataFrame(sorted(rows.items()), "doc_id long, text string")).collect()
    assert [r.doc_id for r in got] == [1]


def test_a_large_group_with_common_words(spark):
    """Copies with an edit each, and texts that share a line with all of them but nothing else."""
    line = " ".join(f"c{i}" for i in range(12))
    base = [f"b{i}" for i in range(60)]
    data = [(i, " ".join(base[: i % 60] + [f"x{i}"] + base[i % 60 + 1 :]) + " " + line) for i in range(300)]
    data += [(i, line + " " + " ".join(f"y{i}.{k}" for k in range(20))) for i in range(300, 500)]
    got = sorted(r.doc_id for r in S.near_dedup(spark.createDataFrame(data, "doc_id long, text string")).collect())
    want = slow_roots([t for _, t in data])
    assert got == sorted(set(want)) and len(got) == 201


def test_the_bound_is_exact():
    a = b" ".join(b"w%d" % i for i in range(13))  # 9 shingles, 8 of which the other has: 8 of 10 in all
    b = b" ".join([b"w%d" % i for i in range(12)] + [b"else"])
    assert L.alike(a, b, 5, Fraction(4, 5)) and not L.alike(a, b, 5, Fraction(81, 100))


def test_pipeline_stage_drops_near_copies(spark):
    import corpus_pipeline as P

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").orderBy("doc_id")
    rows = docs.select("doc_id", "text").collect()
    out = P.dedup(spark, docs, "")
    want = {rows[r].doc_id for r in slow_roots([r.text for r in rows])}
    assert out.columns == docs.columns and {r.doc_id for r in out.collect()} == want


def test_rows_that_share_an_id_or_have_none(spark):
    a, b = "one text of some eight words or so", "another text that is not like the first"
    data = [(1, a), (1, b), (None, "seen twice without any id at all"), (None, "seen twice without any id at all"), (None, a), (2, b)]
    got = S.near_dedup(spark.createDataFrame(data, "doc_id long, text string").repartition(3)).collect()
    assert sorted((r.doc_id or 0, r.text) for r in got) == sorted([(0, "seen twice without any id at all"), (1, a), (1, b)])


def test_links_go_through_the_byte_index(spark, monkeypatch):
    """The stage lists fingerprints of five-word shingles by bytes; each gets its nearest partner up to five bits away."""
    seen = []
    index = S.near_links
    monkeypatch.setattr(S, "near_links", lambda fps: seen.append(sorted(r.fp for r in fps.collect())) or index(fps))
    base = [f"b{i}" for i in range(400)]
    data = [(i, " ".join(base[:i] + ["x"] + base[i + 1 :])) for i in range(0, 400, 8)] + [(i, " ".join(f"y{i}.{k}" for k in range(30))) for i in range(400, 450)]
    got = S.near_dedup(spark.createDataFrame(data, "doc_id long, text string")).collect()
    at, h, _ = L.shingles([t.encode() for _, t in data], L.Powers(), 5)
    n = [int((at == i).sum()) for i in range(len(data))]
    u = sorted({int(f) & (1 << 64) - 1 for f in S.majority(h, n)})
    assert [sorted(f & (1 << 64) - 1 for f in s) for s in seen] == [u] and len(got) == 51
    nearest = {min(((a ^ b).bit_count(), a, b) for a in u[:i]) for i, b in enumerate(u) if i}
    want = {(a, b) for bits, a, b in nearest if bits <= 5}
    found = {tuple(v & (1 << 64) - 1 for v in (r.a, r.b)) for r in index(spark.createDataFrame([(f - (f >> 63 << 64),) for f in u], "fp long")).collect()}
    assert want <= found and len(want) > 30 and all((a ^ b).bit_count() <= 5 for a, b in found)


def test_pairs_of_a_large_group_grow_with_its_size(spark, monkeypatch):
    """Half the pairs of the group are links; a few of each text's are compared, and those that join components."""
    compared = []
    verified = L.verified
    monkeypatch.setattr(L, "verified", lambda pairs, *more: compared.append(pairs.count()) or verified(pairs, *more))
    base = [f"b{i}" for i in range(150)]
    data = []
    for i in range(400):
        words = list(base)
        for k in range(1 + i % 3):
            words[(i * 37 + k * 53) % 150] = f"x{i}.{k}"
        data.append((i, " ".join(words)))
    got = sorted(r.doc_id for r in S.near_dedup(spark.createDataFrame(data, "doc_id long, text string")).collect())
    assert got == sorted(set(slow_roots([t for _, t in data]))) == [0]
    assert sum(compared) < 25 * len(data)  # of 79,800 pairs


def test_near_copies_that_are_no_links_meet_about_once(spark, monkeypatch):
    """Pairs that share hundreds of shingles meet in the list of the first, or in none where a text's own shingles before it leave too few."""
    rows = []
    met = L.met
    monkeypatch.setattr(L, "met", lambda *given: rows.append((found := met(*given)).count()) or found)

    def texts(name, edits):
        """24 texts of 1,504 words, each with so many words of its own, and the last one again with another word."""
        out = []
        for i in range(24):
            words = [f"{name}{k}" for k in range(1504)]
            for k in random.Random(i).sample(range(1504), edits):
                words[k] = f"{name}.{i}.{k}"
            out.append(" ".join(words))
        return [*out, out[-1] + " else"]

    def stage(name, edits):
        given = texts(name, edits)
        rows.clear()
        got = sorted(r.doc_id for r in S.near_dedup(spark.createDataFrame(list(enumerate(given)), "doc_id long, text string")).collect())
        assert got == sorted(set(slow_roots(given))) == list(range(24))
        return sum(rows)

    assert stage("b", 44) == 0
    assert 0 < stage("a", 24) < 2 * 25 * 24 / 2
