"""Connected components of an edge table, by alternating large and small stars.

Each task first links the nodes of its part of the edges to the least of their group there; where all
edges are one part, that is the result. Each round then joins edges with the least neighbour of their ends; hubs are added up before
the shuffle and split by adaptive joins. Rounds are written to the shared folder.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgraph.llm.common import materialize


#: Edges of a part, about (16 bytes each).
PART = 1 << 20


def least_of_groups(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes that aren't the least of their component, and that least node."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y, root = at[: len(a)], at[len(a) :], np.arange(len(nodes))
    while len(apart := np.flatnonzero(root[x] != root[y])):
        x, y = root[x[apart]], root[y[apart]]
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while np.any(root != (up := root[root])):
            root = up
    moved = np.flatnonzero(root != np.arange(len(root)))
    return nodes[moved], nodes[root[moved]]


def _grouped(edges: DataFrame, parts: int) -> DataFrame:
    """Links to the least nodes of the groups that the edges of each part make."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.zeros((2, 0), np.int64), *(np.stack([x.to_numpy() for x in batch.columns]) for batch in batches)]
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in least_of_groups(*np.concatenate(held, axis=1))], ["a", "b"])

    return edges.coalesce(parts).mapInArrow(run, "a long, b long")


def _least(edges: DataFrame) -> DataFrame:
    return edges.groupBy("a").agg(F.min("b").alias("least"))


def _large_star(edges: DataFrame) -> DataFrame:
    """Links larger neighbours of each node to its least neighbour, or to itself if that is less."""
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = _least(both).select("a", F.least("a", "least").alias("least"))
    return both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("least").alias("b")).where("a <> b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Links each node and its smaller neighbours to the least of them."""
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    joined = down.join(_least(down), "a")
    return joined.select(F.col("b").alias("a"), F.col("least").alias("b")).union(joined.select("a", F.col("least").alias("b"))).where("a <> b").distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """``a, b``: each node of ``edges(a, b)`` that isn't the least of its component, and that least node.

    Edges may repeat, point either way or to their own node; edges with a null end are none.
    """
    now = materialize(edges.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")).dropna().where("a <> b"), "edges")
    parts = max(1, -(-now.count() // PART))
    now = materialize(_grouped(now, parts), "groups")
    if parts == 1:
        return now
    state = None
    while True:
        now = materialize(_small_star(_large_star(now)), "stars")
        row = now.agg(F.count("*"), F.sum(F.col("a").cast("decimal(38,0)")), F.sum(F.col("b").cast("decimal(38,0)")), F.bit_xor(F.xxhash64("a", "b"))).first()
        if tuple(row) == state:
            return now
        state = tuple(row)
