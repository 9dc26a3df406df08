"""Cost-balanced packing of token sequences.

Documents stream through each task in windows of WINDOW_TOKENS tokens. In a window, every full
stretch of 2,048 tokens of a document is a sequence of its own. The remaining pieces are taken
longest first; each goes to the sequence with the lowest estimated cost (linear + quadratic
attention cost of what it holds) among those that still have room for it, and where none has room it
is cut: the emptiest sequence takes as much as it can hold and the rest is placed in turn. A window
opens as many sequences as its tokens need, so at most one sequence's worth of padding is left in it.

Windows are narrow transformations: no shuffle, no gathered group, memory bounded by a window and
one document; hot sources or copies are dealt as the input is.

Defined results: a null or empty text is the end id alone; repeated rows are packed each; among pieces of one length the earlier
row goes first, among sequences of one cost the first; a very long text fills sequences of its own and may end a window early; an empty table
gives an empty result. Only the id and text columns are read, so other columns may have any name; the id column keeps its name, which
must not be one of the new ones.
"""

from __future__ import annotations

import heapq
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomframe.llm.common import CHUNK_BYTES, chunks, ship, small_batches
from loomframe.llm.tokens import encoder, rank_file, vocabulary

ship(__name__)

LENGTH = 2048
END = 1
WINDOW_TOKENS = 4_000_000
#: Cost of a piece of n tokens: LINEAR * n + QUADRATIC * n * n (attention stays inside a piece).
LINEAR, QUADRATIC = 1.0, 1.0 / 1024


def place(lengths: list[int], length: int = LENGTH, linear: float = LINEAR, quadratic: float = QUADRATIC) -> list[list[tuple[int, int]]]:
    """Sequences as lists of (piece, tokens); pieces are shorter than `length`, and cut only where no sequence has room."""
    total = sum(lengths)
    n = -(-total // length)
    room = np.full(n, length, np.int64)
    cost = np.zeros(n)
    out: list[list[tuple[int, int]]] = [[] for _ in range(n)]
    todo = [(-m, i) for i, m in enumerate(lengths) if m]
    heapq.heapify(todo)
    while todo:
        m, i = heapq.heappop(todo)
        m = -m
        fits = np.where(room >= m, cost, np.inf)
        b = int(fits.argmin())
        if fits[b] == np.inf:
            b = int(room.argmax())
            heapq.heappush(todo, (int(room[b]) - m, i))
            m = int(room[b])
        out[b].append((i, m))
        room[b] -= m
        cost[b] += linear * m + quadratic * m * m
    return out


def window_rows(docs: list[tuple[object, np.ndarray]], first: int, length: int = LENGTH) -> tuple[list[tuple], int]:
    """Rows (doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset) of one window; the next free sequence."""
    rows, seq, rests = [], first, []
    for doc, ids in docs:
        full = len(ids) // length * length
        for s in range(0, full, length):
            rows.append((doc, s, length, zlib.crc32(ids[s : s + length]), len(ids), seq, 0))
            seq += 1
        if full < len(ids):
            rests.append((doc, ids, full))
    done = [r[2] for r in rests]
    for held in place([len(ids) - s for _, ids, s in rests], length):
        at = 0
        for i, m in held:
            doc, ids, _ = rests[i]
            s = done[i]
            rows.append((doc, s, m, zlib.crc32(ids[s : s + m]), len(ids), seq, at))
            done[i] += m
            at += m
        seq += 1
    return rows, seq


def pack(docs: DataFrame, id_col: str = "doc_id", text: str = "text", length: int = LENGTH, end: int = END, tokenizer: str | None = None, window_tokens: int = WINDOW_TOKENS) -> DataFrame:
    """One row per piece: id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A document is its text's ids and then `end`; a null or empty text is `end` alone. sequence_id
    is the task's number times 2**33 plus a count, the same when a task runs again.
    """
    path = tokenizer or vocabulary()
    ranks = rank_file(path)
    names = ["start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    schema = f"doc {docs.schema[id_col].dataType.simpleString()}, " + ", ".join(f"{c} long" for c in names)
    kind = docs.schema[id_col].dataType

    def run(batches):
        encode = encoder(path, ranks=ranks)
        seq = TaskContext.get().partitionId() << 33
        window, held = [], 0

        def emit():
            nonlocal seq, window, held
            rows, seq = window_rows(window, seq, length)
            window, held = [], 0
            cols = list(zip(*rows))
            from pyspark.sql.pandas.types import to_arrow_type

            return pa.RecordBatch.from_arrays([pa.array(cols[0], to_arrow_type(kind))] + [pa.array(c, pa.int64()) for c in cols[1:]], names=["doc", *names])

        for b in batches:
            texts = b.column(1)
            sizes = [v or 0 for v in pa.compute.binary_length(texts).to_pylist()]
            for lo, hi in chunks(sizes, CHUNK_BYTES):
                part = texts.slice(lo, hi - lo).to_pylist()
                for doc, ids in zip(b.column(0).slice(lo, hi - lo).to_pylist(), encode([t or "" for t in part])):
                    window.append((doc, np.append(ids, np.uint32(end)).astype("<u4")))
                    held += len(ids) + 1
                    if held >= window_tokens:
                        yield emit()
        if window:
            yield emit()

    small_batches(docs.sparkSession)
    source = docs.select(F.col(f"`{id_col}`").alias("doc"), F.col(f"`{text}`").alias("text"))
    return source.mapInArrow(run, schema).withColumnRenamed("doc", id_col)


def op9_cost_balanced_packing(spark, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))
