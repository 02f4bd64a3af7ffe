"""Partition trees of point clouds: median splits along the widest axis, leaves as rows of arrays, searched by box distance.

Build. Neurons of more than ``leaf`` points are split by rounds: a node's cuts, LEVELS deep at most, come from a sample of it of bounded size (a
task a node), and its points walk down them by an expression. Nodes that are still too large go to the next round, so dense places get more
leaves. Points that coincide are cut by a hash. A leaf is one row, its points in arrays; ``nodes`` holds the boxes above, STEP levels apart.

Search, exact. Queries come as leaves too. 1. Each query leaf walks down every target to the nearest leaf and finds k points there: a bound for
each of its points. 2. It walks down again, now to every leaf whose box is within its largest bound. 3. To such a leaf go only the points whose own bound
reaches the leaf's box, and what they find is merged. A task's work is a leaf and some leaves' points, so no cell or neuron is a hot key.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute  # noqa: F401  pa.compute
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dendra.operators.batches import AXES, box_gap, packed, unpack
from dendra.operators.search import Cloud, to_boxes
from dendra.plans.scratch import written

#: Points of a leaf, levels cut in a round, sampled points per leaf to be, levels between stored boxes.
LEAF = 1 << 11
LEVELS = 10
SAMPLE = 64
STEP = 3
#: A node is cut while it has more than this many times ``leaf`` points: sampled medians aren't exact.
SLACK = 1.5
#: Query leaves that are searched in a target leaf by one call, and rows put together before a task hands them on.
SPAN = 64
OUT_ROWS = 1 << 16
BOX = [f"{e}_{c}" for e in ("low", "high") for c in AXES]


class Tree(NamedTuple):
    """nodes: id, node, parent, n, is_leaf and the box. leaves: id, node, n, idxs, data (x, y, z) and the box. Node h's children are 2h and 2h + 1."""

    nodes: DataFrame
    leaves: DataFrame


def cuts_of(x: np.ndarray, depth: int) -> tuple[list[int], list[float]]:
    """Axis and value of the median cut of each inner node, by heap number from 1; axis 3 where the points coincide."""
    axes, values, rows = [3] * (2**depth - 1), [0.0] * (2**depth - 1), {1: x}
    for h in range(1, 2**depth):
        own = rows.pop(h)
        spread = own.max(axis=0) - own.min(axis=0) if len(own) else np.zeros(3)
        axis = int(spread.argmax())
        if spread[axis] > 0:
            c = own[:, axis]
            cut = np.partition(c, len(c) // 2)[len(c) // 2]
            cut = cut if (c < cut).any() else c[c > cut].min()
            axes[h - 1], values[h - 1] = axis, float(cut)
            left = c < cut
            parts = own[left], own[~left]
        else:
            parts = own[::2], own[1::2]
        rows[2 * h], rows[2 * h + 1] = parts
    return axes, values


def _deeper() -> Column:
    """The node of a point after the cuts (depth, axes, cuts) of its node."""

    def down(h: Column, _: Column) -> Column:
        axis, cut = F.element_at("axes", h.cast("int")), F.element_at("cuts", h.cast("int"))
        at = F.when(axis == 0, F.col("x")).when(axis == 1, F.col("y")).otherwise(F.col("z"))
        right = F.when(axis == 3, F.pmod(F.xxhash64("idx", h), F.lit(2))).otherwise((at >= cut).cast("long"))
        return h * 2 + right

    one = F.lit(1).cast("long")
    low = F.call_function("shiftleft", one, F.col("depth"))
    end = F.aggregate(F.sequence(F.lit(1), F.col("depth")), one, down)
    return F.when(F.col("depth").isNull(), F.col("node")).otherwise(F.call_function("shiftleft", F.col("node"), F.col("depth")) + end - low)


def leaf_of_points(points: DataFrame, leaf: int = LEAF) -> DataFrame:
    """points (id, idx, x, y, z) with ``node``: their leaf."""
    at = points.select("id", "idx", *AXES, F.lit(1).cast("long").alias("node"))
    kind = points.schema["id"].dataType.simpleString()

    def split(pdf: pd.DataFrame) -> pd.DataFrame:
        depth = int(pdf["depth"].iloc[0])
        axes, cuts = cuts_of(pdf[list(AXES)].to_numpy(float), depth)
        return pd.DataFrame({"id": [pdf["id"].iloc[0]], "node": [pdf["node"].iloc[0]], "depth": [depth], "axes": [axes], "cuts": [cuts]})

    while True:
        sizes = at.groupBy("id", "node").agg(F.count("*").alias("n"))
        dense = written(sizes.where(F.col("n") > SLACK * leaf).withColumn("depth", F.least(F.lit(LEVELS), F.ceil(F.log2(F.col("n") / leaf))).cast("int")), "dense")
        if not dense.take(1):
            return at
        share = F.lit(float(SAMPLE)) * F.pow(F.lit(2.0), F.col("depth")) / F.col("n")
        drawn = at.join(dense, ["id", "node"]).where(F.pmod(F.xxhash64("idx", "node"), F.lit(1 << 30)) < share * (1 << 30))
        cuts = written(drawn.groupBy("id", "node").applyInPandas(split, f"id {kind}, node long, depth int, axes array<int>, cuts array<double>"), "cuts")
        at = written(at.join(cuts, ["id", "node"], "left").select("id", "idx", *AXES, _deeper().alias("node")), "walked")


def build(points: DataFrame, leaf: int = LEAF) -> Tree:
    """The trees of all neurons of ``points`` (id, idx, x, y, z)."""
    leaves = written(packed(leaf_of_points(points, leaf), ["id", "node"], list(AXES)), "leaves")
    depth = F.length(F.conv("node", 10, 2)) - 1
    meta = leaves.select("id", "node", "n", *BOX).withColumn("depth", depth)
    own = meta.select("id", "node", F.call_function("shiftright", "node", (F.col("depth") - 1) % STEP + 1).alias("parent"), "n", F.lit(True).alias("is_leaf"), *BOX)
    up = meta.where("depth > 0").withColumn("at", F.explode(F.sequence(F.lit(0), F.col("depth") - 1, F.lit(STEP))))
    up = up.withColumn("node", F.call_function("shiftright", "node", F.col("depth") - F.col("at")))
    ends = [(F.min if c.startswith("low") else F.max)(c).alias(c) for c in BOX]
    inner = up.groupBy("id", "node", "at").agg(F.sum("n").alias("n"), *ends)
    inner = inner.select("id", "node", F.when(F.col("at") > 0, F.call_function("shiftright", "node", F.lit(STEP))).otherwise(0).alias("parent"), "n", F.lit(False).alias("is_leaf"), *BOX)
    own = own.withColumn("parent", F.when(F.col("node") == 1, 0).otherwise(F.col("parent")))
    return Tree(written(own.unionByName(inner), "nodes"), leaves)


def save(tree: Tree, path: str, mode: str = "error") -> None:
    """Nodes and leaves as Parquet, for ``load``."""
    for name, df in tree._asdict().items():
        df.write.mode(mode).parquet(f"{path}/{name}")


def load(spark: SparkSession, path: str) -> Tree:
    return Tree(*[spark.read.parquet(f"{path}/{name}") for name in Tree._fields])


def points_of(leaves: DataFrame) -> DataFrame:
    """(id, idx, x, y, z) of the points in ``leaves``."""
    kind = leaves.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                idx, x = np.frombuffer(batch.column(1)[i].as_py(), "<i8"), unpack(batch.column(2)[i].as_py(), 3)
                yield pa.RecordBatch.from_arrays([pa.repeat(batch.column(0)[i], len(idx)), pa.array(idx), *[pa.array(c) for c in x.T.copy()]], names=["id", "idx", *AXES])

    return leaves.select("id", "idxs", "data").mapInArrow(run, f"id {kind}, idx long, x double, y double, z double")


# search


def _steps(tree: Tree) -> int:
    deepest = tree.nodes.agg(F.max("node")).first()[0] or 1
    return -(-(deepest.bit_length() - 1) // STEP)


def _named(nodes: DataFrame) -> DataFrame:
    return nodes.select(F.col("id").alias("target"), F.col("parent").alias("at"), F.col("node").alias("next"), "is_leaf", *[F.col(c).alias("t" + c) for c in BOX])


def _walk(start: DataFrame, tree: Tree, nearest: bool) -> DataFrame:
    """(q, qnode, target, node, is_leaf): the leaves that ``start`` (q, qnode, target, qlow_x .. qhigh_z, bound) comes to from the roots: the nearest one, or
    all within ``bound``. A level joins each node's children; no leaf is met with all others."""
    nodes = _named(tree.nodes)
    box = ["q" + c for c in BOX]
    todo, out = start.withColumn("at", F.lit(0).cast("long")), None
    for _ in range(_steps(tree) + 1):
        near = todo.join(nodes, ["target", "at"]).withColumn("gap", box_gap("q", "t"))
        if nearest:
            middle = sum((F.col(f"tlow_{c}") + F.col(f"thigh_{c}") - F.col(f"qlow_{c}") - F.col(f"qhigh_{c}")) ** 2 for c in AXES)
            first = F.min(F.struct(F.col("gap"), middle.alias("middle"), "next", "is_leaf")).alias("to")
            near = near.groupBy("q", "qnode", "target", *box, "bound").agg(first).select("q", "qnode", "target", *box, "bound", F.col("to.next").alias("next"), F.col("to.is_leaf").alias("is_leaf"))
        else:
            near = near.where("gap <= bound")
        reached = near.where("is_leaf").select("q", "qnode", "target", F.col("next").alias("node"))
        out = reached if out is None else out.unionByName(reached)
        todo = near.where("NOT is_leaf").select("q", "qnode", "target", *box, "bound", F.col("next").alias("at"))
    return out


def pairs_of(queries: DataFrame, targets: DataFrame, pairs: str, parts: int) -> DataFrame:
    """(q, qnode, qlow_x .. qhigh_z, target) of the query leaves and targets asked for. Each target meets the leaves in one of ``parts`` tasks."""
    own = queries.select(F.col("id").alias("q"), F.col("node").alias("qnode"), *[F.col(c).alias("q" + c) for c in BOX])
    if pairs == "same":
        return own.join(targets.select(F.col("id").alias("target")), F.col("q") == F.col("target"))
    spread = own.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    there = targets.select(F.col("id").alias("target"), F.pmod(F.xxhash64("id"), F.lit(parts)).cast("int").alias("part"))
    both = spread.join(there, "part").drop("part")
    return both.where("q <> target") if pairs == "other" else both


def spans(batch: pa.RecordBatch) -> Iterator[tuple[int, int]]:
    """Runs of rows with the same target leaf, in parts of at most SPAN."""
    cut = np.zeros(max(0, batch.num_rows - 1), bool)
    for c in (batch.column("target"), batch.column("node")):
        cut |= ~pa.compute.equal(c[1:], c[:-1]).to_numpy(zero_copy_only=False)
    ends = [*(np.flatnonzero(cut) + 1).tolist(), batch.num_rows]
    for a, b in zip([0, *ends], ends):
        yield from ((i, min(i + SPAN, b)) for i in range(a, b, SPAN))


def _joined(column: pa.Array, kind: str) -> tuple[np.ndarray, np.ndarray]:
    """The numbers that the rows of bytes hold, one after the other, and how many each has."""
    parts = column.to_pylist()
    return np.frombuffer(b"".join(parts), kind), np.array([len(x) // 8 for x in parts], np.int64)


def nearest(queries: DataFrame, tree: Tree, k: int, pairs: str = "all") -> DataFrame:
    """(q, idx0, target, idx, d2): for each point of the leaves ``queries`` its k nearest points in each target, and some more that aren't: the caller cuts at k."""
    spark = queries.sparkSession
    qkind, tkind = queries.schema["id"].dataType.simpleString(), tree.leaves.schema["id"].dataType.simpleString()
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    asked = pairs_of(queries, tree.nodes.where("node = 1").select("id"), pairs, parts)
    box = ["q" + c for c in BOX]
    start = _walk(asked.withColumn("bound", F.lit(float("inf"))), tree, True)
    blocks = queries.select(F.col("id").alias("q"), F.col("node").alias("qnode"), *[F.col(c).alias("q" + c) for c in BOX], F.col("idxs").alias("qidxs"), F.col("data").alias("qdata"))
    there = tree.leaves.select(F.col("id").alias("target"), "node", "idxs", "data")

    def found(q: np.ndarray, idxs: bytes, data: bytes) -> tuple[np.ndarray, np.ndarray]:
        at, d2 = Cloud(unpack(data, 3)).nearest(q, k)
        return np.frombuffer(idxs, "<i8")[at], d2

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            near, bounds, own = [], [], []
            for a, b in spans(batch):
                x, sizes = _joined(batch.column("qdata")[a:b], "<f8")
                at, d2 = found(x.reshape(-1, 3), batch.column("idxs")[a].as_py(), batch.column("data")[a].as_py())
                each = d2[:, -1] if d2.shape[1] == k else np.full(len(d2), np.inf)
                ends = np.cumsum(sizes // 3)
                for i, j in zip([0, *ends.tolist()], ends.tolist()):
                    near.append(at[i:j].astype("<i8").tobytes() + d2[i:j].tobytes())
                    own.append(each[i:j].tobytes())
                    bounds.append(float(each[i:j].max()))
            kept = [batch.column(c) for c in ("q", "qnode", "target", "node", *box, "qidxs", "qdata")]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(near, pa.binary()), pa.array(own, pa.binary()), pa.array(bounds, pa.float64())], names=[*out_names])

    out_names = ["q", "qnode", "target", "node", *box, "qidxs", "qdata", "near", "own", "bound"]
    boxes = ", ".join(f"{c} double" for c in box)
    joined = start.join(blocks, ["q", "qnode"]).join(there, ["target", "node"]).sortWithinPartitions("target", "node")
    one = written(joined.mapInArrow(first, f"q {qkind}, qnode long, target {tkind}, node long, {boxes}, qidxs binary, qdata binary, near binary, own binary, bound double"), "first")

    reach = _walk(one.select("q", "qnode", "target", *box, "bound"), tree, False)
    reach = reach.join(one.select("q", "qnode", "target", "node"), ["q", "qnode", "target", "node"], "left_anti")
    named = tree.nodes.where("is_leaf").select(F.col("id").alias("target"), "node", F.array(*BOX).alias("box"))
    lists = reach.join(named, ["target", "node"]).groupBy("q", "qnode", "target").agg(F.collect_list(F.struct("node", "box")).alias("to"))  # leaves near one leaf

    def sent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The points that may find something nearer in a leaf, per leaf."""

        def rows(batch: pa.RecordBatch, of: list, cells: list) -> pa.RecordBatch:
            marks = [batch.column(c).take(pa.array(of, pa.int64())) for c in ("q", "target")]
            node, *data = zip(*cells)
            return pa.RecordBatch.from_arrays([*marks, pa.array(node, pa.int64()), *[pa.array(d, pa.binary()) for d in data]], names=["q", "target", "node", "qidxs", "qdata", "own"])

        for batch in batches:
            of, cells = [], []
            for n, (qidxs, qdata, own, to) in enumerate(zip(*(batch.column(c) for c in ("qidxs", "qdata", "own", "to")))):
                at, x, bound = np.frombuffer(qidxs.as_py(), "<i8"), unpack(qdata.as_py(), 3), np.frombuffer(own.as_py(), "<f8")
                nodes = to.values.field("node").to_numpy()
                ends = to.values.field("box").flatten().to_numpy().reshape(-1, 6)
                near = to_boxes(x, ends[:, :3], ends[:, 3:]) <= bound[:, None]
                for i in np.flatnonzero(near.any(axis=0)).tolist():
                    r = near[:, i]
                    of.append(n)
                    cells.append((int(nodes[i]), at[r].tobytes(), x[r].tobytes(), bound[r].tobytes()))
                if len(cells) * len(at) > OUT_ROWS:
                    yield rows(batch, of, cells)
                    of, cells = [], []
            if cells:
                yield rows(batch, of, cells)

    def found_rows(batch: pa.RecordBatch, parts: Iterator[tuple[np.ndarray, ...]]) -> Iterator[pa.RecordBatch]:
        """parts: rows of the batch, numbers of query points and of found ones, distances. Put together."""
        held, n = [], 0

        def rows() -> pa.RecordBatch:
            of, idx0, idx, d2 = (np.concatenate(c) for c in zip(*held))
            of = pa.array(of)
            return pa.RecordBatch.from_arrays([batch.column("q").take(of), pa.array(idx0), batch.column("target").take(of), pa.array(idx), pa.array(d2)], names=["q", "idx0", "target", "idx", "d2"])

        for part in parts:
            held.append(part)
            n += len(part[0])
            if n > OUT_ROWS:
                yield rows()
                held, n = [], 0
        if n:
            yield rows()

    def second(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def parts(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, ...]]:
            for a, b in spans(batch):
                qidx, sizes = _joined(batch.column("qidxs")[a:b], "<i8")
                x, bound = (_joined(batch.column(c)[a:b], "<f8")[0] for c in ("qdata", "own"))
                at, d2 = found(x.reshape(-1, 3), batch.column("idxs")[a].as_py(), batch.column("data")[a].as_py())
                r, c = np.nonzero(d2 <= bound[:, None])
                yield np.repeat(np.arange(a, b), sizes)[r], qidx[r], at[r, c], d2[r, c]

        for batch in batches:
            yield from found_rows(batch, parts(batch))

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def parts(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, ...]]:
            for n, (qidxs, near) in enumerate(zip(batch.column("qidxs"), batch.column("near"))):
                at, near = np.frombuffer(qidxs.as_py(), "<i8"), near.as_py()
                half = len(near) // 2
                ids, d2 = np.frombuffer(near[:half], "<i8"), np.frombuffer(near[half:], "<f8")
                yield np.full(len(ids), n), np.repeat(at, len(ids) // len(at)), ids, d2

        for batch in batches:
            yield from found_rows(batch, parts(batch))

    out = f"q {qkind}, idx0 long, target {tkind}, idx long, d2 double"
    subsets = one.select("q", "qnode", "target", "qidxs", "qdata", "own").join(lists, ["q", "qnode", "target"])
    subsets = subsets.mapInArrow(sent, f"q {qkind}, target {tkind}, node long, qidxs binary, qdata binary, own binary")
    again = subsets.join(there, ["target", "node"]).sortWithinPartitions("target", "node").mapInArrow(second, out)
    return one.select("q", "target", "qidxs", "near").mapInArrow(listed, out).unionByName(again)
