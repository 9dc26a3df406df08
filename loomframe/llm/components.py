"""Connected components of a large graph by alternating large-star and small-star steps.

Every step is a partial aggregate and an equi-join over the edge table, so a hub's edges are
summed before the shuffle and its join partition can be split by AQE; no group of edges is ever
gathered in one task, and nothing but a four-number digest of the table reaches the driver.
Each step's edges are written to the shared folder, which also cuts the lineage.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomframe.llm.common import discard, ship, stored

ship(__name__)


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, smallest node of its tree) for the nodes of edges (a, b), without the roots themselves."""
    nodes, inverse = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = inverse[: len(a)], inverse[len(a) :]
    root = np.arange(len(nodes))
    while True:
        low = np.minimum(root[x], root[y])
        new = root.copy()
        np.minimum.at(new, root[x], low)
        np.minimum.at(new, root[y], low)
        new = new[new]
        if np.array_equal(new, root):
            break
        root = new
    moved = root != np.arange(len(nodes))
    return nodes[moved], nodes[root[moved]]


def contracted(edges: DataFrame) -> DataFrame:
    """Each partition's edges (a, b) as stars around its components' smallest nodes: as connected, no more rows than nodes."""

    def run(batches):
        held: list = []
        rows = 0
        for batch in batches:
            held.append((batch.column(0).to_numpy(), batch.column(1).to_numpy()))
            rows += batch.num_rows
            if rows > 500_000:
                held = [forest(np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held]))]
                rows = len(held[0][0])
                if rows > 250_000:
                    yield pa.RecordBatch.from_arrays([pa.array(held[0][0]), pa.array(held[0][1])], names=["a", "b"])
                    held, rows = [], 0
        if held:
            a, b = forest(np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held]))
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    return edges.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")).where("a is not null and b is not null and a <> b").mapInArrow(run, "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node that each node of the edges (a, b; long) can reach. Isolated nodes are not listed."""
    e = stored(contracted(edges).distinct(), "edges")
    seen = None
    while True:
        both = e.select("a", "b").unionAll(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = stored(large.where("a <> b").distinct(), "edges")
        down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        low = down.groupBy("a").agg(F.min("b").alias("m"))
        small = down.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").unionAll(low.select("a", F.col("m").alias("b")))
        before, e = e, stored(small.distinct(), "edges")
        discard(before, large)
        now = e.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b")), F.bit_xor(F.xxhash64("b", "a")), F.sum(F.xxhash64("a", "b") % 1000003)).first()
        if now == seen:
            return e.select(F.col("a").alias("node"), F.col("b").alias("root"))
        seen = now
