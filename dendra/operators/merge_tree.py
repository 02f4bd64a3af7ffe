"""The merge tree of a dendrogram: one table that gives the segments at every threshold, without new components.

1. ``spanning_forest``: the edges that a merge by falling affinity needs, one per merge. Each task drops from its own edges what closes a circle; while too many
   are left for one task, a Boruvka round takes every part's best edge, and contracts what these connect.
2. ``links``: a label stops being its segment's smallest at one affinity, where a smaller one takes it in: a row (label, up, affinity). Edges go in
   ranges of falling affinity, each one task's work per connected part. Up the links affinities don't rise, so the segment of a label at a threshold is
   found by following links while they reach it.
3. ``build``: links of links, doubling the length, so that following takes the logarithm of the longest chain in joins.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dendra.operators.components import TASK_EDGES, components
from dendra.plans.scratch import written

FOREST = "a long, b long, affinity double, seg0 long, seg1 long"
LINKS = "label long, up long, affinity double"


class MergeTree(NamedTuple):
    """links: level, label, up, affinity: 2 ** level links up from ``label``, all of ``affinity`` or more. levels: how many there are."""

    links: DataFrame
    levels: int


def kept_edges(a: np.ndarray, b: np.ndarray, affinity: np.ndarray, seg0: np.ndarray, seg1: np.ndarray) -> np.ndarray:
    """Which edges a merge by falling affinity needs, in that order; ties go to the smaller segments."""
    order = np.lexsort((seg1, seg0, -affinity))
    _, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = ends[: len(a)].tolist(), ends[len(a) :].tolist()
    parent = list(range(max(max(x, default=0), max(y, default=0)) + 1))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    out = []
    for e in order.tolist():
        i, j = root(x[e]), root(y[e])
        if i != j:
            parent[max(i, j)] = min(i, j)
            out.append(e)
    return np.array(out, np.int64)


def _thinned(edges: DataFrame, at_once: int) -> DataFrame:
    """``edges`` less what closes a circle within a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        rows = 0

        def kept() -> pa.Table:
            own = pa.Table.from_batches(held)
            return own.take(pa.array(kept_edges(*(c.to_numpy() for c in own.columns))))

        for batch in batches:
            held.append(batch)
            rows += batch.num_rows
            if rows > 2 * at_once:
                held = kept().to_batches()
                rows = sum(h.num_rows for h in held)
                if rows > at_once:
                    yield from held
                    held, rows = [], 0
        if held:
            yield from kept().to_batches(max_chunksize=1 << 16)

    return edges.select("a", "b", "affinity", "seg0", "seg1").mapInArrow(run, FOREST)


def spanning_forest(dendro: DataFrame, task_edges: int = TASK_EDGES) -> DataFrame:
    """(seg0, seg1, affinity): a maximum spanning forest of the edges. Ties go to the smaller segments."""
    own = dendro.where("seg0 <> seg1").select(F.col("seg0").alias("a"), F.col("seg1").alias("b"), F.col("affinity").cast("double").alias("affinity"), "seg0", "seg1")
    edges, done = written(_thinned(own, task_edges), "edges"), []
    while edges.count() > task_edges:  # read from the files' footers
        best = F.min(F.struct((-F.col("affinity")).alias("s"), "seg0", "seg1", "a", "b")).alias("k")
        ends = [edges.select(F.col(c).alias("part"), "affinity", "seg0", "seg1", "a", "b") for c in ("a", "b")]
        taken = written(ends[0].unionByName(ends[1]).groupBy("part").agg(best).select("k.*").distinct(), "taken")
        done.append(taken.select("seg0", "seg1", (-F.col("s")).alias("affinity")))
        roots = components(taken, "a", "b")
        for end in ("a", "b"):
            edges = edges.join(roots.select(F.col("node").alias(end), "root"), end, "left").withColumn(end, F.coalesce("root", end)).drop("root")
        edges = written(_thinned(edges.where("a <> b"), task_edges), "edges")
    rest = written(_thinned(edges.coalesce(1), 2 * task_edges), "forest").select("seg0", "seg1", "affinity")
    return reduce(DataFrame.unionByName, [*done, rest])


def part_links(a: list[int], b: list[int], affinity: list[float]) -> list[tuple[int, int, float]]:
    """LINKS of one connected part, whose edges come by falling affinity."""
    low: dict[int, int] = {}  # of each part, its smallest label; labels are joined under it

    def root(i: int) -> int:
        low.setdefault(i, i)
        while low[i] != i:
            low[i] = low[low[i]]
            i = low[i]
        return i

    out = []
    for x, y, s in zip(a, b, affinity):
        x, y = sorted((root(x), root(y)))
        if x != y:
            low[y] = x
            out.append((y, x, s))
    return out


def links(forest: DataFrame, task_edges: int = TASK_EDGES) -> DataFrame:
    """LINKS of a forest: at ``affinity``, ``label`` is taken in by ``up``, the smallest label of its segment then. Every range of falling affinity
    has at most some ``task_edges`` edges, and starts from the segments that the ranges before have made."""
    forest = written(forest, "forest")
    n = forest.count()  # from the files' footers
    ranges = max(1, -(-n // task_edges))
    if ranges > 1:
        cuts = forest.agg(F.expr(f"approx_percentile(affinity, array({', '.join(repr(1 - i / ranges) for i in range(1, ranges))}), 100000)")).first()[0]
        number = sum((F.col("affinity") < F.lit(c)).cast("int") for c in sorted(set(cuts), reverse=True))
        forest = written(forest.withColumn("range", number), "ranges")
        numbers = sorted(r["range"] for r in forest.select("range").distinct().collect())  # one per ``task_edges`` edges
    else:
        forest, numbers = forest.withColumn("range", F.lit(0)), [0]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        own = pdf.sort_values(["affinity", "seg0", "seg1"], ascending=[False, True, True])
        return pd.DataFrame(part_links(own["a"].tolist(), own["b"].tolist(), own["affinity"].tolist()), columns=["label", "up", "affinity"])

    out, roots = [], None
    for i in numbers:
        edges = forest.where(F.col("range") == i).select(F.col("seg0").alias("a"), F.col("seg1").alias("b"), "affinity", "seg0", "seg1")
        if roots is not None:
            for end in ("a", "b"):
                edges = edges.join(roots.select(F.col("node").alias(end), "root"), end, "left").withColumn(end, F.coalesce("root", end)).drop("root")
        edges = written(edges, "range")
        parts = components(edges, "a", "b")
        tied = edges.join(parts.select(F.col("node").alias("a"), F.col("root").alias("part")), "a")
        own = written(tied.groupBy("part").applyInPandas(run, LINKS), "links")
        out.append(own)
        if i != numbers[-1]:
            moved = parts if roots is None else roots.join(parts.select(F.col("node").alias("root"), F.col("root").alias("to")), "root", "left").select("node", F.coalesce("to", "root").alias("root")).unionByName(
                parts.join(roots.select("node"), "node", "left_anti"))
            roots = written(moved, "roots")
    return reduce(DataFrame.unionByName, out)


def build(dendro: DataFrame, task_edges: int = TASK_EDGES) -> MergeTree:
    """The merge tree of the edges (seg0, seg1, affinity)."""
    level = written(links(spanning_forest(dendro, task_edges), task_edges), "links")
    levels = [level]
    while True:
        on = level.select(F.col("label").alias("up"), F.col("up").alias("top"), F.col("affinity").alias("low"))
        level = written(level.join(on, "up").select("label", F.col("top").alias("up"), F.col("low").alias("affinity")), "links")
        if not level.take(1):
            break
        levels.append(level)
    return MergeTree(written(reduce(DataFrame.unionByName, [df.withColumn("level", F.lit(i)) for i, df in enumerate(levels)]), "tree"), len(levels))


def segments(tree: MergeTree, thresholds: list[float]) -> DataFrame:
    """(threshold, label, root): labels that merge, and the smallest label of their segment, at each threshold."""
    own = tree.links.where("level = 0")
    at = F.explode(F.array(*[F.lit(float(t)) for t in thresholds]))
    now = own.select("label").withColumn("threshold", at).withColumn("root", F.col("label"))
    for i in reversed(range(tree.levels)):
        step = tree.links.where(F.col("level") == i).select(F.col("label").alias("root"), "up", "affinity")
        far = now.join(step, "root", "left")
        now = far.select("threshold", "label", F.when(F.col("affinity") >= F.col("threshold"), F.col("up")).otherwise(F.col("root")).alias("root"))
    moved = now.where("label <> root")
    return moved.unionByName(moved.select("threshold", F.col("root").alias("label"), "root").distinct()).select("threshold", "label", "root")


def save(tree: MergeTree, path: str, mode: str = "error") -> None:
    tree.links.write.mode(mode).partitionBy("level").parquet(path)


def load(spark: SparkSession, path: str) -> MergeTree:
    rows = spark.read.parquet(path).select("label", "up", "affinity", F.col("level").cast("int").alias("level"))
    top = rows.agg(F.max("level")).first()[0]
    return MergeTree(rows, 0 if top is None else top + 1)
