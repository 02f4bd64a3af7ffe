"""Connected components of an edge list: local union-find, and large-star / small-star rounds (Kiveris et al. 2014) where
the edges left are too many for one task."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dendra.plans.scratch import written

#: Edges that a task holds at once, and up to which one task ends the work.
TASK_EDGES = 1 << 20


def roots_of(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Every node of the edges (u[i], v[i]), and the smallest node of its component."""
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    parent, a, b = np.arange(len(nodes)), at[: len(u)], at[len(u) :]
    while True:
        ra, rb = parent[a], parent[b]
        open_ = ra != rb
        if not open_.any():
            return nodes, nodes[parent]
        a, b, ra, rb = a[open_], b[open_], ra[open_], rb[open_]
        np.minimum.at(parent, np.maximum(ra, rb), np.minimum(ra, rb))
        while not np.array_equal(up := parent[parent], parent):
            parent = up


def contracted(edges: DataFrame, at_once: int) -> DataFrame:
    """Edges (u, v), u > v, that connect what ``edges`` connects: each task replaces its own by stars around the smallest nodes."""
    kind = T.StructType([T.StructField(n, edges.schema[n].dataType) for n in ("u", "v")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        u, v, more = [], [], 0
        types: list[pa.DataType] = []

        def stars(last: bool) -> Iterator[pa.RecordBatch]:
            nonlocal u, v, more
            if not u:
                return
            nodes, roots = roots_of(np.concatenate(u), np.concatenate(v))
            real = nodes != roots
            u, v, more = [nodes[real]], [roots[real]], 0
            if last or len(u[0]) > at_once:
                for a in range(0, len(u[0]), 1 << 16):
                    yield pa.RecordBatch.from_arrays([pa.array(x[0][a : a + (1 << 16)], t) for x, t in zip((u, v), types)], names=["u", "v"])
                u, v = [], []

        for batch in batches:
            types = types or [c.type for c in batch.columns]
            u.append(batch.column(0).to_numpy(zero_copy_only=False))
            v.append(batch.column(1).to_numpy(zero_copy_only=False))
            more += batch.num_rows
            if more > at_once:
                yield from stars(False)
        yield from stars(True)

    return edges.select("u", "v").mapInArrow(run, kind)


def components(edges: DataFrame, a: str, b: str, rounds: int = 60, task_edges: int = TASK_EDGES) -> DataFrame:
    """(node, root) of every node with an edge to another: root is the smallest node that it reaches.

    Each task first contracts its own edges. Up to ``task_edges`` edges, one task contracts what is left; beyond, a round joins
    every node's neighbours to the smallest of them, which takes about the logarithm of the longest path in rounds. Neighbours
    are only aggregated by minimum, so a hub's list is never gathered. Each round is written out once.
    """
    edges = edges.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
    edges = written(contracted(edges, task_edges), "edges")
    for _ in range(rounds):
        if edges.count() <= task_edges:  # read from the files' footers
            edges = written(contracted(edges.coalesce(1), 2 * task_edges), "edges")
            break
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        edges = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = edges.groupBy("u").agg(F.min("v").alias("m"))
        small = edges.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = written(contracted(small.unionByName(low.select("u", F.col("m").alias("v"))).where("u <> v").distinct(), task_edges), "edges")
        # settled once every node has one edge, and none leads to a node that has one itself
        ends = edges.select(F.col("u").alias("x"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(edges.select(F.col("v").alias("x"), F.lit(0).alias("up"), F.lit(1).alias("down")))
        if not ends.groupBy("x").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up > 1 OR (up = 1 AND down = 1)").take(1):
            break
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
