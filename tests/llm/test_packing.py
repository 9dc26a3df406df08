import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from loomframe.llm import packing as P
from loomframe.llm import tokens
from tests.llm.conftest import SF


def test_query_round_trip(spark, documents):
    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rows = P.op9_cost_balanced_packing(spark, SF).collect()
    pieces, sequences = {}, {}
    for r in rows:
        pieces.setdefault(r.doc_id, []).append(r)
        sequences.setdefault(r.sequence_id, []).append(r)
    assert set(pieces) == {d for d, _ in documents}
    total = 0
    for doc, text in documents:
        ids = np.array([*tok.encode(text, add_special_tokens=False).ids, 1], "<u4")
        at = 0
        for r in sorted(pieces[doc], key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids) and r.length > 0
            assert r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids)
        total += at
    for held in sequences.values():
        at = 0
        for r in sorted(held, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 2048
    assert len(sequences) * 2048 - total < 2048 * len({s >> 33 for s in sequences})


def test_costs_are_balanced():
    rng = np.random.default_rng(0)
    lengths = [int(x) for x in rng.integers(20, 1500, 400)]
    held = P.place(lengths)
    cost = [sum(P.LINEAR * m + P.QUADRATIC * m * m for _, m in s) for s in held]
    assert len(held) == -(-sum(lengths) // 2048)
    naive, at, room = [], 0.0, 2048
    for m in lengths:  # in order, next fit with cuts
        while m:
            k = min(m, room)
            at += P.LINEAR * k + P.QUADRATIC * k * k
            room, m = room - k, m - k
            if not room:
                naive.append(at)
                at, room = 0.0, 2048
    assert np.std(cost[:-1]) < np.std(naive)
    got = {}
    for s in held:
        assert sum(m for _, m in s) <= 2048
        for i, m in s:
            got[i] = got.get(i, 0) + m
    assert [got[i] for i in range(len(lengths))] == lengths


def test_fast_ids_equal_the_library(documents):
    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = [t for _, t in documents] + ["", "<|endoftext|> a<|endoftext|>", "a  b\n\n c\t\r\n", "١٢ ²³ Ⅷ x's 'S   y\u0085z", "\U0001f600\U0001f468‍\U0001f469", "\x1c a\x1d\x1eb"]
    for t, got in zip(texts, tokens.encoder(tokens.vocabulary())(texts)):
        assert got.tolist() == tok.encode(t, add_special_tokens=False).ids
    tok.encode_special_tokens = True
    for t, got in zip(texts, tokens.encoder(tokens.vocabulary(), special=False)(texts)):
        assert got.tolist() == tok.encode(t, add_special_tokens=False).ids


def test_edges(edge, empty):
    rows = P.pack(edge).collect()
    by = {}
    for r in rows:
        by.setdefault(r.doc_id, []).append(r)
    assert [r.doc_tokens for r in by[1]] == [1] and [r.doc_tokens for r in by[2]] == [1]
    assert sum(r.length for r in by[6]) == 2 * by[6][0].doc_tokens
    assert None in by and P.pack(empty).count() == 0


def test_places_against_brute_force():
    """The rule, naively: the longest piece left goes to the cheapest sequence with room; where there is none the emptiest takes what it can."""
    rng = np.random.default_rng(6)
    for size in (1, 7, 60, 300):
        lengths = [int(x) for x in rng.integers(1, 2048, size)]
        n = -(-sum(lengths) // 2048)
        held, room, cost = [[] for _ in range(n)], [2048] * n, [0.0] * n
        left = [(m, i) for i, m in enumerate(lengths)]
        while left:
            m, i = max(left, key=lambda p: (p[0], -p[1]))
            left.remove((m, i))
            fit = [k for k in range(n) if room[k] >= m]
            k = min(fit, key=lambda k: (cost[k], k)) if fit else max(range(n), key=lambda k: (room[k], -k))
            put = min(m, room[k])
            if put < m:
                left.append((m - put, i))
            held[k].append((i, put))
            room[k] -= put
            cost[k] += P.LINEAR * put + P.QUADRATIC * put * put
        assert P.place(lengths) == held


def test_fast_ids_are_compared_before_use(documents):
    import copy
    import json

    path = tokens.vocabulary()
    ranks = tokens.rank_file(path)
    assert ranks
    tok = Tokenizer.from_file(path)
    texts = [t for _, t in documents] + ["", "<|endoftext|> a<|endoftext|>", "a  b\n\n c\t\r\n", "١٢ ²³ Ⅷ x's 'S   y\u0085z", "\U0001f600\U0001f468‍\U0001f469", "\x1c a\x1d\x1eb"]
    for t, got in zip(texts, tokens.encoder(path, ranks=ranks)(texts)):
        assert got.tolist() == tok.encode(t, add_special_tokens=False).ids
    tok.encode_special_tokens = True
    for t, got in zip(texts, tokens.encoder(path, special=False, ranks=ranks)(texts)):
        assert got.tolist() == tok.encode(t, add_special_tokens=False).ids
    spec, table = json.load(open(path, encoding="utf-8")), tokens._ranks(ranks[0])
    assert not tokens.same_ids(spec, table, public_tokenizers.PATTERN + "|x")
    for change in (lambda s: s["model"]["merges"].pop(), lambda s: s["model"]["merges"].reverse(), lambda s: s["model"].update(ignore_merges=True), lambda s: s["pre_tokenizer"].update(use_regex=False), lambda s: s.update(normalizer={"type": "NFC"})):
        other = copy.deepcopy(spec)
        change(other)
        assert not tokens.same_ids(other, table, public_tokenizers.PATTERN)
