"""Region graphs of labelled volumes, their agglomeration, and relabelling.

Voxels: (z, y, x, label, aff_x, aff_y, aff_z), or blocks of them (``blocks``); label 0 is background; an affinity belongs to the voxel and its lower neighbour.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dendra.operators import blocks
from dendra.operators.components import components
from dendra.plans.scratch import written

#: Neighbours in a row of ``neighbours``.
CHUNK = 1 << 12
#: Rounds of ``greedy_dendrogram`` after which its merges are put together.
WRITTEN_ROUNDS = 8
#: Edges that one task of it merges one by one, each of which takes a kilobyte or more of Python's objects there; up to twice as many in a range of labels.
GREEDY_EDGES = 1 << 16


def region_graph(voxels: DataFrame, edge: int = blocks.EDGE) -> DataFrame:
    """(seg0, seg1, n, aff_sum): contact count and affinity sum of touching segments, by blocks (see there); voxels or BLOCKS.
    The sum is a whole number where the affinities are."""
    if "labels" in voxels.columns:
        return blocks.region_graph(voxels, edge)
    kinds = {voxels.schema[f"aff_{a}"].dataType for a in "xyz"}
    graph = blocks.region_graph(blocks.from_voxels(voxels, edge), edge)
    return graph.withColumn("aff_sum", F.col("aff_sum").cast("long")) if all(isinstance(k, T.IntegralType) for k in kinds) else graph


def neighbours(graph: DataFrame, most: int = CHUNK) -> DataFrame:
    """(seg, first, neighbours): each segment's neighbours, sorted, in rows of at most ``most``; first is a row's smallest. Rows are dealt by ranges of
    (segment, neighbour), so a hub's are built by several tasks."""
    both = graph.select(F.col("seg0").alias("seg"), F.col("seg1").alias("other")).unionByName(graph.select(F.col("seg1").alias("seg"), F.col("seg0").alias("other")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seg, held = None, np.zeros(0, np.int64)

        def rows(parts: list[tuple[int, np.ndarray]]) -> pa.RecordBatch:
            cut = [(s, x[i : i + most]) for s, x in parts for i in range(0, len(x), most)]
            columns = [[s for s, _ in cut], [int(x[0]) for _, x in cut], [x.tolist() for _, x in cut]]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.int64(), pa.list_(pa.int64())))], names=["seg", "first", "neighbours"])

        for batch in batches:
            of, other = (c.to_numpy() for c in batch.columns)
            cuts = np.flatnonzero(np.diff(of)) + 1
            done = []
            for own, x in zip(np.split(of, cuts), np.split(other, cuts)):
                if len(own) and own[0] != seg:
                    done += [(seg, held)] if len(held) else []
                    seg, held = int(own[0]), x
                else:
                    held = np.concatenate([held, x])
                whole = len(held) // most * most
                if whole:
                    done.append((seg, held[:whole]))
                    held = held[whole:]
            if done:
                yield rows(done)
        if len(held):
            yield rows([(seg, held)])

    return both.repartitionByRange("seg", "other").sortWithinPartitions("seg", "other").mapInArrow(run, "seg long, first long, neighbours array<long>")


def _order() -> Column:
    """Edges by falling affinity sum; ties by segments."""
    return F.struct((-F.col("aff_sum")).alias("s"), F.col("seg0").alias("a"), F.col("seg1").alias("b"))


def dendrogram(graph: DataFrame, min_threshold: float) -> DataFrame:
    """(seg0, seg1, affinity, aff_sum): edges in falling order of the affinity *sum*, up to the first whose *mean* is below
    ``min_threshold``. Later edges are left out even if their own mean is high.

    The first failing edge is found by one aggregate, so no window runs over all edges.
    """
    mean = F.col("aff_sum") / F.col("n")
    edges = graph.withColumns({"affinity": mean, "__k": _order()})
    stop = edges.where(F.col("affinity") < min_threshold).agg(F.min("__k").alias("__stop"))
    kept = edges.join(F.broadcast(stop), F.col("__stop").isNull() | (F.col("__k") < F.col("__stop")))  # one row
    return kept.select("seg0", "seg1", "affinity", "aff_sum")


def greedy_merges(edges: dict[tuple[int, int], tuple[int, float, tuple[int, int]]], min_threshold: float, foreign: set[int] | None = None) -> list[tuple[int, int, float, tuple[int, int]]]:
    """Merges (kept, merged, mean, pair) of one graph, in order; see ``greedy_dendrogram``. edges: segments to contacts, sum, pair.

    foreign: segments of other parts, not all of whose edges are here. They don't merge here, nor does what has its first edge with one, nor what
    waits for that. An edge that comes first among all left is first for both of its segments unless one waits, so the others merge as they would in the whole."""
    near: dict[int, dict[int, tuple]] = {}
    for (a, b), edge in edges.items():
        near.setdefault(a, {})[b] = near.setdefault(b, {})[a] = edge
    heap = [(-s / n, pair, a, b, n) for (a, b), (n, s, pair) in edges.items()]
    heapq.heapify(heap)
    out, waits = [], set(foreign or ())
    while heap:
        mean, pair, a, b, n = heapq.heappop(heap)
        if near.get(a, {}).get(b, (0, 0.0, None))[::2] != (n, pair):
            continue  # the edge has changed since
        if -mean < min_threshold:
            break
        if a in waits or b in waits:
            waits |= {a, b}
            continue
        out.append((a, b, -mean, pair))
        del near[a][b]
        for c, (n, s, pair) in near.pop(b).items():
            if c == a:
                continue
            del near[c][b]
            old = near[a].get(c, (0, 0.0, pair))
            near[a][c] = near[c][a] = joined = (old[0] + n, old[1] + s, min(old[2], pair))
            heapq.heappush(heap, (-joined[1] / joined[0], joined[2], min(a, c), max(a, c), joined[0]))
    return out


MERGES = "root long, seg0 long, seg1 long, affinity double, t0 long, t1 long"


def _best_pairs(edges: DataFrame, min_threshold: float) -> DataFrame:
    """Edges that come first for both of their segments, with a mean of at least ``min_threshold``. Each segment is in one at most."""
    key = F.struct((-F.col("aff_sum") / F.col("n")).alias("s"), "t0", "t1", "root", "seg0", "seg1")
    both = edges.select(F.col("seg0").alias("seg"), key.alias("k")).unionByName(edges.select(F.col("seg1").alias("seg"), key.alias("k")))
    agreed = both.groupBy("seg").agg(F.min("k").alias("k")).groupBy("k").count().where((F.col("count") == 2) & (F.col("k.s") <= -min_threshold))
    return agreed.select("k.root", "k.seg0", "k.seg1", (-F.col("k.s")).alias("affinity"), "k.t0", "k.t1")


def _part_merges(edges: DataFrame, min_threshold: float, turn: int, task_edges: int) -> DataFrame:
    """Merges that parts of the graph settle alone, one part a task: ranges of labels, moved by half a range from turn to turn. Parts that are
    too large for a task take no part."""
    ends = edges.agg(F.count("*").alias("n"), F.min("seg0").alias("low"), F.max("seg1").alias("high")).first()
    parts = max(2, -(-2 * ends["n"] // max(1, task_edges)))
    width = max(1, -(-(ends["high"] - ends["low"] + 1) // parts))
    shift = (turn % 2) * (width // 2) - ends["low"]
    of = lambda c: F.expr(f"({c} + {shift}) div {width}")  # noqa: E731  no number is below zero
    dealt = edges.withColumn("part", F.explode(F.array_distinct(F.array(of("seg0"), of("seg1")))))
    small = dealt.groupBy("part").count().where(F.col("count") <= 2 * max(1, task_edges)).select("part")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        part = pdf["part"].iloc[0]
        roots = dict(zip(pdf["seg0"].tolist(), pdf["root"].tolist()))
        columns = [pdf[c].tolist() for c in ("seg0", "seg1", "n", "aff_sum", "t0", "t1")]
        own = {(a, b): (n, s, (t, u)) for a, b, n, s, t, u in zip(*columns)}
        foreign = {x for e in own for x in e if (x + shift) // width != part}
        rows = [(roots[a], *m[:3], *m[3]) for m in greedy_merges(own, min_threshold, foreign) for a in [min(m[0], m[1])]]
        return pd.DataFrame(rows, columns=["root", "seg0", "seg1", "affinity", "t0", "t1"])

    return dealt.join(small, "part").groupBy("part").applyInPandas(run, MERGES)


def _after(edges: DataFrame, merges: DataFrame) -> DataFrame:
    """``edges`` between the segments that are left."""
    moves = components(merges, "seg0", "seg1").where("node <> root")  # a segment stays under its smallest label
    for end in ("seg0", "seg1"):
        edges = edges.join(moves.select(F.col("node").alias(end), F.col("root").alias("__to")), end, "left").withColumn(end, F.coalesce("__to", end)).drop("__to")
    own = edges.where("seg0 <> seg1").withColumns({"seg0": F.least("seg0", "seg1"), "seg1": F.greatest("seg0", "seg1"), "t": F.struct("t0", "t1")})
    sums = own.groupBy("root", "seg0", "seg1").agg(F.sum("n").alias("n"), F.sum("aff_sum").alias("aff_sum"), F.min("t").alias("t"))
    return sums.select("root", "seg0", "seg1", "n", "aff_sum", "t.t0", "t.t1")


def greedy_dendrogram(graph: DataFrame, min_threshold: float, task_edges: int = GREEDY_EDGES) -> DataFrame:
    """(root, step, seg0, seg1, affinity): agglomeration that recomputes means as segments merge; seg0 is the one that stays, root
    the smallest segment of the connected part, step the order within it.

    The edge with the largest mean goes first; ties go to the edge with the smallest pair of first segments among all that it
    joins. So an edge that is joined from two never comes before both, and merging every edge that is first for both of its segments
    at once gives what merging one by one gives. (Sums that aren't exact may differ in the last bit.) While there are more than
    ``task_edges`` edges, a round first merges what ranges of labels settle alone, a chain of rising means inside a range at once, and then every edge that
    is first for both; what is left is merged one by one, a connected part per task. At worst a chain of rising means changes its range at every step, and each round
    merges one edge of it.
    """
    parts = components(graph, "seg0", "seg1").select(F.col("node").alias("seg0"), "root")
    first = graph.join(parts, "seg0").select("root", "seg0", "seg1", "n", F.col("aff_sum").cast("double").alias("aff_sum"), F.col("seg0").alias("t0"), F.col("seg1").alias("t1"))
    edges, done, turn = written(first, "edges"), None, 0
    while edges.count() > task_edges:  # read from the files' footers
        found = False
        for merges in (lambda: _part_merges(edges, min_threshold, turn, task_edges), lambda: _best_pairs(edges, min_threshold)):
            merges = written(merges(), "merges")
            if merges.take(1):
                found, done = True, merges if done is None else done.unionByName(merges)
                edges = written(_after(edges, merges), "edges")
        if not found:
            return _numbered(done if done is not None else merges)
        turn += 1
        if turn % WRITTEN_ROUNDS == 0:
            done = written(done, "merges")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        own = pdf.sort_values(["seg0", "seg1"])
        columns = [own[c].tolist() for c in ("seg0", "seg1", "n", "aff_sum", "t0", "t1")]
        rows = [(pdf["root"].iloc[0], *m[:3], *m[3]) for m in greedy_merges({(a, b): (n, s, (t, u)) for a, b, n, s, t, u in zip(*columns)}, min_threshold)]
        return pd.DataFrame(rows, columns=["root", "seg0", "seg1", "affinity", "t0", "t1"])

    rest = edges.groupBy("root").applyInPandas(run, MERGES)
    return _numbered(written(rest if done is None else done.unionByName(rest), "merges"))


def _numbered(merges: DataFrame) -> DataFrame:
    """``step`` from 0 in each connected part: ranges of the order are numbered by a task each, after the part's ranges before."""
    order = [F.desc("affinity"), F.asc("t0"), F.asc("t1")]
    ranged = written(merges.repartitionByRange(F.asc("root"), *order).withColumn("__part", F.spark_partition_id()), "steps")
    before = Window.partitionBy("root").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = ranged.groupBy("root", "__part").count().select("root", "__part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("__before"))
    own = F.row_number().over(Window.partitionBy("root", "__part").orderBy(*order)) - 1
    numbered = ranged.withColumn("__own", own).join(offsets, ["root", "__part"])
    return numbered.select("root", (F.col("__own") + F.col("__before")).cast("long").alias("step"), "seg0", "seg1", "affinity")


def with_steps(dendro: DataFrame) -> DataFrame:
    """The edges numbered in order: each range of the order is numbered by a task of its own, after the edges of the ranges before."""
    order = [F.desc("aff_sum"), F.asc("seg0"), F.asc("seg1")]
    ranged = written(dendro.repartitionByRange(*order).withColumn("__part", F.spark_partition_id()), "steps")
    counts = sorted((r["__part"], r["count"]) for r in ranged.groupBy("__part").count().collect())  # a row per range
    before = [(p, sum(n for q, n in counts if q < p)) for p, _ in counts]
    offsets = dendro.sparkSession.createDataFrame(before, "__part int, __before long")
    own = F.row_number().over(Window.partitionBy("__part").orderBy(*order)) - 1
    return ranged.withColumn("step", own).join(F.broadcast(offsets), "__part").withColumn("step", (F.col("step") + F.col("__before")).cast("long")).drop("__part", "__before")


def build_dendrogram(voxels: DataFrame, min_threshold: float) -> DataFrame:
    return dendrogram(region_graph(voxels), min_threshold)


def labels(voxels: DataFrame) -> DataFrame:
    return voxels.select("label").distinct()


def segments(dendro: DataFrame, threshold: float) -> DataFrame:
    """(label, root) of labels that merge: the smallest label that edges with affinity >= threshold reach."""
    return components(dendro.where(F.col("affinity") >= threshold), "seg0", "seg1").select(F.col("node").alias("label"), "root")


def relabel(voxels: DataFrame, roots: DataFrame) -> DataFrame:
    """``voxels`` with each label replaced by its root. Spark broadcasts ``roots`` only if it is small."""
    joined = voxels.join(roots, "label", "left")
    return joined.withColumn("label", F.coalesce("root", "label")).select(*voxels.columns)


def segment(voxels: DataFrame, dendro: DataFrame, threshold: float) -> DataFrame:
    return relabel(voxels, segments(dendro, threshold))


def merge_counts(voxels: DataFrame, dendro: DataFrame, threshold: float) -> DataFrame:
    """One row: n_labels, n_merges (edges at or above the threshold) and n_segments left; background counts as a label."""
    own = labels(voxels).join(segments(dendro, threshold), "label", "left").agg(F.count("*").alias("n_labels"), F.countDistinct(F.coalesce("root", "label")).alias("n_segments"))
    merges = dendro.where(F.col("affinity") >= threshold).agg(F.count("*").alias("n_merges"))
    return own.join(F.broadcast(merges)).select("n_labels", "n_merges", "n_segments")  # a row each
