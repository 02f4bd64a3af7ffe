"""Downsampling of skeletons by walking distance, with smoothing.

A segment runs from a seed (a root, or a child of a branch point) to the next branch point or tip. Inside it, a node is kept
once it lies ``step`` or more from the last kept one, and is then moved to the mean of its parent, itself and its first child.
Seeds and segment ends are always kept. Segments don't depend on each other, so each is folded alone.

Small neurons are spread by hash, and folded whole; large ones are cut into their segments first, found by pointer doubling.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from dendra.operators.spatial import by_size
from dendra.plans.scratch import written

#: Nodes of a neuron that one task folds whole.
TASK_NODES = 1 << 18
OUT = "neuron_id string, idx int, class int, x double, y double, z double, r double, parent int, source_idx int"


def _first_children(parent: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of children, and the child with the largest index (-1: none)."""
    has = np.flatnonzero(parent >= 0)
    first = np.full(len(parent), -1)
    np.maximum.at(first, parent[has], has)
    return np.bincount(parent[has], minlength=len(parent)), first


def fold_chain(xyzr: np.ndarray, beyond: np.ndarray | None, step2: float) -> tuple[list[int], list[list[float]]]:
    """Kept places along a segment, and their coordinates. beyond: the first child of its end, if there is one."""
    points = xyzr.tolist()  # plain numbers: a call of numpy takes longer than a node
    follow = [*points[1:], None if beyond is None else beyond.tolist()]
    kept, placed = [0], [points[0]]
    before = last = points[0]  # the previous node, as moved, and the last kept one
    for i in range(1, len(points)):
        here = points[i]
        dx, dy, dz = here[0] - last[0], here[1] - last[1], here[2] - last[2]
        if dx * dx + dy * dy + dz * dz >= step2:
            after = follow[i]
            here = [(u + v) / 2 for u, v in zip(before, here)] if after is None else [(u + v + w) / 3 for u, v, w in zip(before, here, after)]
            kept.append(i)
            placed.append(here)
            last = here
        before = here
    return kept, placed


def _with_end(kept: list[int], placed: list[np.ndarray], end: int, where: np.ndarray, duplicate: bool) -> tuple[list[int], list[np.ndarray]]:
    """The segment's end is kept too; if it is already, it comes twice where asked for."""
    if kept[-1] != end:
        return [*kept, end], [*placed, where]
    return ([*kept, end], [*placed, placed[-1]]) if duplicate else (kept, placed)


def downsample_arrays(xyzr: np.ndarray, parent: np.ndarray, step: float, duplicate_junctions: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(source nodes, coordinates, parents) of the smaller tree. parent: -1 or less at roots.

    duplicate_junctions: end nodes that already are the last kept one come twice, the second as its own parent, and children
    hang on the second.
    """
    count, first = _first_children(parent)
    by_parent = np.argsort(parent, kind="stable")
    begins = np.searchsorted(parent[by_parent], np.arange(len(parent)))
    nodes: list[int] = []
    where: list[np.ndarray] = []
    above: list[int] = []
    todo = [(int(s), -1) for s in np.flatnonzero(parent < 0)]
    while todo:
        seed, up = todo.pop()
        chain = [seed]
        while count[chain[-1]] == 1:
            chain.append(int(first[chain[-1]]))
        end = chain[-1]
        at, placed = fold_chain(xyzr[chain], xyzr[first[end]] if first[end] >= 0 else None, step * step)
        kept, placed = _with_end([chain[i] for i in at], placed, end, xyzr[end], duplicate_junctions)
        above += [up, *kept[:-1]]
        nodes += kept
        where += placed
        below = by_parent[begins[end] : begins[end] + count[end]]  # rising; the largest is the first child
        todo += [(int(c), end) for c in (*below[-1:], *below[:-1])]
    new = {n: i for i, n in enumerate(nodes)}
    return np.array(nodes, np.int64), np.array(where).reshape(-1, 4), np.array([new[p] if p >= 0 else -1 for p in above], np.int64)


def _whole(nodes: DataFrame, step: float, duplicate_junctions: bool) -> DataFrame:
    """A neuron per task. One shuffle."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("idx", ignore_index=True)
        at = pd.Series(pdf.index, index=pdf["idx"])
        parent = pdf["parent"].map(at).fillna(-1).to_numpy(np.int64)
        kept, xyzr, up = downsample_arrays(pdf[["x", "y", "z", "r"]].to_numpy(float), parent, step, duplicate_junctions)
        out = pd.DataFrame(xyzr, columns=["x", "y", "z", "r"])
        out["neuron_id"], out["idx"] = pdf["neuron_id"].iloc[0], np.arange(len(out))
        out["class"], out["source_idx"] = pdf["class"].to_numpy()[kept], pdf["idx"].to_numpy()[kept]
        out["parent"] = pd.array(np.where(up < 0, 0, up), dtype="Int64")
        out.loc[up < 0, "parent"] = pd.NA
        return out[["neuron_id", "idx", "class", "x", "y", "z", "r", "parent", "source_idx"]]

    columns = ["neuron_id", "idx", "class", "x", "y", "z", "r", "parent"]
    return nodes.select(*columns).groupBy("neuron_id").applyInPandas(run, OUT)


def chains(nodes: DataFrame) -> DataFrame:
    """(neuron_id, idx, seed, hops): the segment of each node, known by its first node, and its place there, by pointer doubling: the logarithm of the
    longest segment in rounds, each a join of the nodes that haven't reached their seed."""
    counts = nodes.groupBy("neuron_id", F.col("parent").alias("idx")).agg(F.count("*").alias("n"))
    lone = counts.where("n = 1").select("neuron_id", F.col("idx").alias("parent"), F.lit(True).alias("lone"))
    at = nodes.select("neuron_id", "idx", "parent").join(lone, ["neuron_id", "parent"], "left")
    at = written(at.select("neuron_id", "idx", F.when(F.col("lone"), F.col("parent")).otherwise(F.col("idx")).alias("seed"), F.coalesce("lone", F.lit(False)).cast("long").alias("hops")), "chains")
    done, todo = [], at.where("hops > 0")
    while True:
        # a node that points to none of these points to its seed
        on = reduce(DataFrame.unionByName, [*[df.withColumn("end", F.lit(True)) for df in done], todo.withColumn("end", F.lit(False))])
        on = on.select("neuron_id", F.col("idx").alias("seed"), F.col("seed").alias("to"), F.col("hops").alias("more"), "end")
        near = todo.join(on, ["neuron_id", "seed"], "left").withColumn("settled", F.coalesce("end", F.lit(True)))
        near = written(near.select("neuron_id", "idx", F.coalesce("to", "seed").alias("seed"), (F.col("hops") + F.coalesce("more", F.lit(0))).alias("hops"), "settled"), "chains")
        done.append(near.where("settled").drop("settled"))
        todo = near.where("NOT settled").drop("settled")
        if not todo.take(1):
            return reduce(DataFrame.unionByName, [at.where("hops = 0"), *done])


def _by_segments(nodes: DataFrame, step: float, duplicate_junctions: bool) -> DataFrame:
    """Segments are spread over tasks, and a task folds its own in one pass, so that a segment takes no call of its own. Nodes are numbered by rising source_idx."""
    xyzr = ["x", "y", "z", "r"]
    first = nodes.groupBy("neuron_id", F.col("parent").alias("idx")).agg(F.max("idx").alias("child"))
    child = nodes.select("neuron_id", F.col("idx").alias("child"), *[F.col(c).alias("f" + c) for c in xyzr])
    placed = nodes.join(chains(nodes), ["neuron_id", "idx"]).join(first, ["neuron_id", "idx"], "left").join(child, ["neuron_id", "child"], "left")

    names = ["neuron_id", "source_idx", "copy", "class", *xyzr, "up"]

    def folded_segments(table: pa.Table) -> pa.RecordBatch:
        """Whole segments, one after the other, in order."""
        hops, idx, child, parent = (table.column(c).to_numpy() for c in ("hops", "idx", "child", "parent"))  # NaN for null
        x, beyond = (np.column_stack([table.column(p + c).to_numpy() for c in xyzr]).astype(float) for p in ("", "f"))
        starts = np.flatnonzero(hops == 0)
        at, where, copy, up = [], [], [], []
        for a, b in zip(starts.tolist(), [*starts[1:].tolist(), len(hops)]):
            kept, placed = fold_chain(x[a:b], None if np.isnan(child[b - 1]) else beyond[b - 1], step * step)
            kept, placed = _with_end(kept, placed, b - a - 1, x[b - 1].tolist(), duplicate_junctions)
            twice = len(kept) > 1 and kept[-1] == kept[-2]
            at += [a + i for i in kept]
            where += placed
            copy += [*[0] * (len(kept) - 1), int(twice)]
            up += [None if np.isnan(parent[a]) else int(parent[a]), *[int(idx[a + i]) for i in kept[:-1]]]
        own = table.take(pa.array(at, pa.int64())).combine_chunks()
        same = [pa.concat_arrays(own.column(c).chunks) for c in ("neuron_id", "idx", "class")]
        moved = [pa.array(c) for c in np.array(where).reshape(-1, 4).T.copy()]
        return pa.RecordBatch.from_arrays([*same[:2], pa.array(copy, pa.int32()), same[2], *moved, pa.array(up, pa.int32())], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by segment and place. What may go on in the next batch is held back, a segment at most."""
        held: list[pa.RecordBatch] = []
        for batch in batches:
            starts = np.flatnonzero(batch.column("hops").to_numpy() == 0)
            if len(starts):
                last = int(starts[-1])
                whole = [*held, batch.slice(0, last)]
                if sum(b.num_rows for b in whole):
                    yield folded_segments(pa.Table.from_batches(whole))
                held = [batch.slice(last)]
            elif batch.num_rows:
                held.append(batch)
        if held:
            yield folded_segments(pa.Table.from_batches(held))

    kinds = "neuron_id string, source_idx int, copy int, class int, x double, y double, z double, r double, up int"
    dealt = placed.select("neuron_id", "idx", "class", *xyzr, "parent", "seed", "hops", "child", *["f" + c for c in xyzr])
    folded = dealt.repartition("neuron_id", "seed").sortWithinPartitions("neuron_id", "seed", "hops").mapInArrow(run, kinds)
    order = ["neuron_id", "source_idx", "copy"]
    ranged = written(folded.repartitionByRange(*order).withColumn("__part", F.spark_partition_id()), "folded")
    ahead = Window.partitionBy("neuron_id").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = ranged.groupBy("neuron_id", "__part").count().select("neuron_id", "__part", F.coalesce(F.sum("count").over(ahead), F.lit(0)).alias("__ahead"))
    own = F.row_number().over(Window.partitionBy("neuron_id", "__part").orderBy("source_idx", "copy")) - 1
    numbered = written(ranged.withColumn("__own", own).join(offsets, ["neuron_id", "__part"]).withColumn("idx", (F.col("__own") + F.col("__ahead")).cast("int")).drop("__own", "__ahead", "__part"), "numbered")
    # children, and the second of two equal nodes, hang on the second
    tops = numbered.groupBy("neuron_id", F.col("source_idx").alias("up")).agg(F.max("idx").alias("parent"))
    return numbered.join(tops, ["neuron_id", "up"], "left").select("neuron_id", "idx", "class", *xyzr, "parent", "source_idx")


def downsample(nodes: DataFrame, step: float, duplicate_junctions: bool = False, task_nodes: int = TASK_NODES) -> DataFrame:
    """Smaller skeletons (columns of a skeleton frame and source_idx).

    A neuron of up to ``task_nodes`` nodes is one task's work, in one shuffle; of a larger one each segment is (a single segment stays whole,
    as its walk is sequential), and its nodes are numbered by rising source_idx."""
    columns = ["neuron_id", "idx", "class", "x", "y", "z", "r", "parent"]
    own = by_size(nodes.select(*columns), "neuron_id", task_nodes)
    parts = [_whole(own.small, step, duplicate_junctions)] if own.groups or own.large is None else []
    if own.large is not None:
        parts.append(_by_segments(own.large, step, duplicate_junctions))
    return reduce(DataFrame.unionByName, parts)
