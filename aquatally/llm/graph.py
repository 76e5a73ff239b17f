"""Connected components over a table of links."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from aquatally.llm.util import written

EDGES = 1 << 17  # links that one task connects by itself


def components(links: DataFrame, most: int = EDGES) -> DataFrame:
    """(node, root) for the nodes of ``links`` (a, b): the smallest node each one reaches.

    Every task first hangs what its own links connect on the smallest node, ``most`` links at a time.  If ``most``
    links or fewer are left, they are one task's work.  Of more, every
    round hangs the neighbours of a node on the smallest of them, first the larger
    neighbours, then the smaller ones, until nothing changes; the number of rounds grows with
    the logarithm of the table.  Sums and minima combine before they move, so a node with
    very many links is no task of its own.
    """
    stars = links.where("a <> b").select("a", "b").mapInArrow(lambda batches: _stars(batches, most), "a long, b long")
    edges = written(stars.where("a <> b"), "edges")
    if edges.count() <= most:
        own = edges.coalesce(1).mapInArrow(lambda batches: _stars(batches, most), "a long, b long")
        return own.select(F.col("a").alias("node"), F.col("b").alias("root"))
    before = None
    while True:
        edges = written(_hang(_hang(edges, larger=True), larger=False), "edges")
        state = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
        if state == before or state[0] == 0:
            break
        before = state
    # every node hangs on its root by now, the roots on themselves
    ends = F.explode(F.array("a", "b")).alias("node")
    return edges.select(ends, F.col("b").alias("root")).distinct()


def connected(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of the links (a, b) and the smallest node that each one reaches."""
    nodes, place = np.unique(np.concatenate([a, b]), return_inverse=True)
    p, q = place[: len(a)], place[len(a) :]
    root = np.arange(len(nodes))
    while True:
        x, y = root[p], root[q]
        apart = x != y
        if not apart.any():
            return nodes, nodes[root]
        p, q, x, y = p[apart], q[apart], x[apart], y[apart]
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while (root[root] != root).any():
            root = root[root]


def _stars(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """(node, smallest node) of what each ``most`` links connect."""

    def star() -> pa.RecordBatch:
        nodes, roots = connected(*(np.concatenate(x) for x in zip(*held)))
        return pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(roots)], names=["a", "b"])

    held, size = [], 0
    for batch in batches:
        held.append((batch.column(0).to_numpy(), batch.column(1).to_numpy()))
        size += len(batch)
        if size >= most:
            yield star()
            held, size = [], 0
    if held:
        yield star()


def _hang(edges: DataFrame, larger: bool) -> DataFrame:
    # edges go from the larger node to the smaller one
    if larger:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("least"))
        moved = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("least").alias("b"))
        return moved.where("a <> b")
    least = edges.groupBy("a").agg(F.min("b").alias("least"))
    met = edges.join(least, "a")
    up = F.struct(F.col("b").alias("a"), F.col("least").alias("b"))
    own = F.struct(F.col("a").alias("a"), F.col("least").alias("b"))
    return met.select(F.explode(F.array(up, own)).alias("e")).select("e.*").where("a <> b").distinct()
