"""Connected components of an edge table by union-find.

Each task first reduces its edges, batch by batch, to a forest. If the forests have few edges, one task unites them; else
rounds of hooking to the smallest neighbour run over the cluster. Both ways give the same components.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SMALL_ROWS, materialise, small


def _united(parent: dict[int, int], batch: pa.RecordBatch) -> None:
    """Add the edges of a batch to the sets in ``parent``; the root of a set is its smallest node."""

    def find(x: int) -> int:
        root = x
        while (up := parent.setdefault(root, root)) != root:
            root = up
        while parent[x] != root:
            parent[x], x = root, parent[x]
        return root

    for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), strict=True):
        x, y = find(a), find(b)
        if x != y:
            parent[max(x, y)] = min(x, y)


def _roots(parent: dict[int, int]) -> list[tuple[int, int]]:
    """(root, node) of every node. Nodes go upwards, so a node's parent, which is smaller, has its root already."""
    for x in sorted(parent):
        parent[x] = parent[parent[x]]
    return [(root, x) for x, root in parent.items()]


def _rows(pairs: list[tuple[int, int]], names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([p[0] for p in pairs], pa.int64()), pa.array([p[1] for p in pairs], pa.int64())], names)


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The edges of a batch as those of each node with its root: fewer edges and the same components."""
    for batch in batches:
        parent: dict[int, int] = {}
        _united(parent, batch)
        yield _rows([p for p in _roots(parent) if p[0] != p[1]], ["a", "b"])


def _whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    parent: dict[int, int] = {}
    for batch in batches:
        _united(parent, batch)
    yield _rows(_roots(parent), ["component", "id"])


def components(edges: DataFrame, few: int = SMALL_ROWS) -> DataFrame:
    """(id, component) of every node of the edges (a, b); the component is its smallest node. ``few``: edges of the forests that one
    task unites at most."""
    now = materialise(edges.select("a", "b").mapInArrow(_forest, "a long, b long").distinct(), "forest")
    if now.count() <= few:
        return materialise(now.coalesce(1).mapInArrow(_whole, "component long, id long").select("id", "component"), "components")
    return _rounds(now)


def _rounds(now: DataFrame) -> DataFrame:
    """Large-star and small-star steps alternate: each node's neighbours above it, then at or below it, are tied to the smallest
    of them. Only minima are grouped, so a node of many neighbours is summed up before the shuffle; they are written before they
    are joined back, so that such a node's edges can be split. Ends when a round changes nothing; every round is written to the
    shared folder."""
    before = None
    while True:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.join(small(materialise(least, "least")), "a").where("b > a").select(F.col("m").alias("a"), "b").where("a <> b").distinct()
        # each edge now goes from a smaller to a larger node; the larger one's smaller neighbours are tied to the least of them
        large = materialise(large, "large")
        low = large.groupBy("b").agg(F.min("a").alias("m"))
        tied = large.join(small(materialise(low, "low")), "b").select(F.explode(F.array(F.struct(F.col("m").alias("a"), F.col("b")), F.struct(F.col("m").alias("a"), F.col("a").alias("b")))).alias("e")).select("e.*").where("a <> b").distinct()
        now = materialise(tied, "star")
        seen = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if seen == before:
            break
        before = seen
    return now.select(F.col("b").alias("id"), F.col("a").alias("component")).unionByName(now.select(F.col("a").alias("id"), F.col("a").alias("component")).distinct())
