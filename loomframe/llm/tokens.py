"""Token ids of the public byte-level BPE.

The vocabulary file is named by a parameter. Ids are those of the `tokenizers` library on the
.json file without added special tokens; as in that file, the string of the one special token
in a text is that token. Texts are encoded with `tiktoken` (about four times
faster) only after all that decides ids was compared, else with `tokenizers` itself: see `same_ids`.
"""

from __future__ import annotations

import base64
import json
import os
import sys

import numpy as np

from loomframe.llm.common import ship

ship(__name__)

#: The pattern of a byte-level pre-tokenizer, as the `tokenizers` library has it.
BYTE_LEVEL_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def vocabulary() -> str:
    """Path of the default vocabulary file."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _byte_table() -> dict:
    """Characters that stand for bytes in a byte-level vocabulary: printable ones for themselves, the rest from 256 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in printable]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(rest)}


def same_ids(spec: dict, ranks: dict, pattern: str) -> bool:
    """Whether ids by rank (tiktoken: join the neighbours whose joint bytes have the lowest rank) are those of the .json file's merges.

    Compared are the entries, the normaliser, the pre-tokenizer and its pattern, and every setting of the model. As to merges: ids must rise with
    the merges' order, and every entry must become one token when it stands alone. That is enough: if two neighbours a, b join to an
    entry t, no merge has crossed t's ends, so what happened inside t is what happens when t stands alone up to that merge; as t alone becomes one
    token, its next merge is (a, b). So each join by rank is a merge of the file, with the same precedence.
    """
    model, pre = spec["model"], spec["pre_tokenizer"]
    marks = {t["content"] for t in spec["added_tokens"]}
    plain = all(not model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
    if not plain or model["type"] != "BPE" or spec["normalizer"] or spec["truncation"] or spec["padding"] or spec["post_processor"]:
        return False
    if pre["type"] != "ByteLevel" or pre["add_prefix_space"] or not pre["use_regex"] or pattern != BYTE_LEVEL_PATTERN:
        return False
    table = _byte_table()
    if {bytes(table[c] for c in k): v for k, v in model["vocab"].items() if k not in marks} != ranks:
        return False
    order: dict = {}
    before = -1
    for i, m in enumerate(model["merges"]):
        a, b = (bytes(table[c] for c in side) for side in (m if isinstance(m, list) else m.split(" ")))
        made = ranks.get(a + b, -1)
        if made <= before:
            return False
        before = made
        order[a, b] = i
    for t in ranks:
        parts = [t[i : i + 1] for i in range(len(t))]
        while len(parts) > 1:
            i, at = min((order.get(p, len(order)), k) for k, p in enumerate(zip(parts, parts[1:])))
            if i == len(order):
                return False
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
    return True


def rank_file(path: str) -> tuple[str, tuple] | None:
    """The file of ranks beside a .json file that gives the same ids, and its special tokens, if there is one. Compared once a process; the driver asks, workers are told."""
    known = sys.__dict__.setdefault("_loomframe_rank_files", {})
    if path not in known:
        ranks_path = path[: -len(".json")] + ".tiktoken"
        known[path] = None
        if path.endswith(".json") and os.path.exists(ranks_path):
            import public_tokenizers

            with open(path, encoding="utf-8") as f:
                spec = json.load(f)
            if same_ids(spec, _ranks(ranks_path), public_tokenizers.PATTERN):
                known[path] = ranks_path, tuple((t["content"], t["id"]) for t in spec["added_tokens"])
    return known[path]


def _ranks(path: str) -> dict:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def encoder(path: str, special: bool = True, ranks: tuple | None = None):
    """A function from a list of str to a list of uint32 arrays; kept for the life of the process.

    special: whether the string of a special token in a text is that token, else it is ordinary text. ranks: what rank_file(path) gave.
    """
    # functions are sent to workers by value, so a worker keeps what it has loaded where later tasks find it
    loaded = sys.__dict__.setdefault("_loomframe_encoders", {})
    if (path, special, ranks) in loaded:
        return loaded[path, special, ranks]
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    if ranks:
        import public_tokenizers
        import tiktoken

        enc = tiktoken.Encoding("public", pat_str=public_tokenizers.PATTERN, mergeable_ranks=_ranks(ranks[0]), special_tokens=dict(ranks[1]))
        allowed = "all" if special else set()

        def fn(texts):
            return [np.asarray(enc.encode_to_numpy(t, allowed_special=allowed, disallowed_special=()), np.uint32) for t in texts]

    else:
        from tokenizers import Tokenizer

        tok = Tokenizer.from_file(path)
        tok.encode_special_tokens = not special

        def fn(texts):
            return [np.array(e.ids, np.uint32) for e in tok.encode_batch(texts, add_special_tokens=False)]

    loaded[path, special, ranks] = fn
    return fn
