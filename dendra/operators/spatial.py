"""Bounding boxes and nearest neighbours over point frames."""

from __future__ import annotations

from functools import reduce
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dendra.operators import tiles, tree
from dendra.operators.batches import AXES
from dendra.operators.search import Cloud

#: Points of a target that one task searches whole.
TASK_POINTS = 1 << 14
KEY = ["query_id", "query_idx", "target_id"]


def bounding_box(points: DataFrame, group: list[str]) -> DataFrame:
    """Group columns, min_x .. max_z, and ``dim`` (0 to 2): the axis of largest extent, the first on ties."""
    box = points.groupBy(*group).agg(*[f(c).alias(f"{n}_{c}") for n, f in (("min", F.min), ("max", F.max)) for c in AXES])
    return box.withColumn("dim", largest_extent())


def largest_extent() -> Column:
    dx, dy, dz = (F.col(f"max_{c}") - F.col(f"min_{c}") for c in AXES)
    return F.when((dx >= dy) & (dx >= dz), 0).when(dy >= dz, 1).otherwise(2)


def box_distance() -> Column:
    """Squared distance from the point x, y, z to the box min_x .. max_z; 0 inside."""
    total = None
    for c in AXES:
        d = F.greatest(F.lit(0.0), F.col(f"min_{c}") - F.col(c), F.col(c) - F.col(f"max_{c}"))
        total = d * d if total is None else total + d * d
    return total


def _best(candidates: DataFrame, key: list[str], k: int) -> DataFrame:
    """The k candidates of each key with the smallest (d2, idx); Spark cuts each partition to k before the shuffle."""
    order = Window.partitionBy(*key).orderBy("d2", "idx")
    return candidates.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


class Sized(NamedTuple):
    """Points of the groups of at most so many points, how many points and groups these are, and the points of larger groups (None if there are none)."""

    small: DataFrame
    points: int
    groups: int
    large: DataFrame | None


def by_size(points: DataFrame, group: str, most: int) -> Sized:
    """One pass of counts."""
    sizes = points.groupBy(group).count()
    few = F.col("count") <= most
    got = sizes.agg(F.count("*").alias("all"), F.count(F.when(few, 1)).alias("groups"), F.sum(F.when(few, F.col("count"))).alias("points")).first()
    if got["all"] == got["groups"]:
        return Sized(points, got["points"] or 0, got["groups"], None)
    marked = points.join(sizes.select(group, few.alias("__few")), group)
    return Sized(marked.where("__few").select(*points.columns), got["points"] or 0, got["groups"], marked.where("NOT __few").select(*points.columns))


def _within(queries: DataFrame, targets: DataFrame, k: int) -> DataFrame:
    """Each query point's k nearest among the points of its own neuron; a neuron is one task's work."""
    kinds = {f.name: f.dataType.simpleString() for f in [*queries.schema.fields, *targets.schema.fields]}
    names = ["query_id", "query_idx", "target_id", "idx", "d2"]

    def run(q: pd.DataFrame, t: pd.DataFrame) -> pd.DataFrame:
        if not len(q) or not len(t):
            return pd.DataFrame({c: pd.Series([], dtype=object) for c in names})
        t = t.sort_values("idx", kind="stable")
        at, d2 = Cloud(t[list(AXES)].to_numpy(float)).nearest(q[["qx", "qy", "qz"]].to_numpy(float), k)
        own = lambda c: np.repeat(q[c].to_numpy(), at.shape[1])
        return pd.DataFrame({"query_id": own("query_id"), "query_idx": own("query_idx"), "target_id": own("query_id"), "idx": t["idx"].to_numpy()[at.ravel()], "d2": d2.ravel()})[names]

    out = ", ".join(f"{c} {kinds[c]}" for c in names[:4]) + ", d2 double"
    return queries.groupBy("query_id").cogroup(targets.groupBy("target_id")).applyInPandas(run, out)


def _in_tiles(queries: DataFrame, targets: DataFrame, k: int, same: bool, points: int, neurons: int) -> DataFrame:
    """Each query point's k nearest in each of the targets, none of which is large: a task has some targets and some queries."""
    asked = queries.select(F.col("query_id").alias("id"), F.col("query_idx").alias("idx"), *[F.col("q" + c).alias(c) for c in AXES])
    size = asked.agg(F.count("*").alias("n"), F.approx_count_distinct("id").alias("ids")).first()
    parts = int(queries.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    there = tiles.pack_targets(targets.withColumnRenamed("target_id", "id"), list(AXES))
    dealt = tiles.tiles(there, tiles.pack_queries(asked, list(AXES)), tiles.groups(points, neurons, parts), tiles.groups(size["n"], size["ids"], parts))

    def work(target, idxs, cloud, _, query, own, x):
        for a in range(0, len(x), step := max(1, tiles.OUT_ROWS // k)):
            at, d2 = cloud.nearest(x[a : a + step, :3], k)
            flat = [np.repeat(own[a : a + step], at.shape[1]), idxs[at.ravel()], d2.ravel()]
            q, i, d = (pa.array(v) for v in flat)
            yield pa.RecordBatch.from_arrays([pa.repeat(query, len(d)), q, pa.repeat(target, len(d)), i, d], names=["query_id", "query_idx", "target_id", "idx", "d2"])

    kinds = [df.schema[c].dataType.simpleString() for df, c in ((queries, "query_id"), (targets, "target_id"))]
    return tiles.met(dealt, work, f"query_id {kinds[0]}, query_idx long, target_id {kinds[1]}, idx long, d2 double", 3, same)


def _by_tree(queries: DataFrame, targets: DataFrame, k: int, pairs: str, leaf: int) -> DataFrame:
    there = tree.build(targets.withColumnRenamed("target_id", "id"), leaf)
    asked = tree.build(queries.select(F.col("query_id").alias("id"), F.col("query_idx").alias("idx"), *[F.col("q" + c).alias(c) for c in AXES]), leaf)
    found = tree.nearest(asked.leaves, there, k, pairs)
    return found.select(F.col("q").alias("query_id"), F.col("idx0").alias("query_idx"), F.col("target").alias("target_id"), "idx", "d2")


def knn(queries: DataFrame, targets: DataFrame, k: int, pairs: str = "all", leaf: int = tree.LEAF, task_points: int = TASK_POINTS) -> DataFrame:
    """The k nearest target points of every query point, in each target neuron.

    queries: (query_id, query_idx, qx, qy, qz). targets: (target_id, idx, x, y, z). Result: query_id, query_idx, target_id, idx, d2,
    rank (1: nearest); ties go to the smaller idx; a target with fewer than k points gives all of them.

    pairs: "all" target neurons, "same" (target_id = query_id, for neighbourhoods) or "other" (all but the same).

    A neuron's own points are searched in one task; others in tiles of some targets and some queries (``tiles``). Targets of more than
    ``task_points`` points are cut into leaves of some ``leaf`` points and searched by box distance (``tree``). All are exact.
    """
    if k < 1:
        raise ValueError("k must be at least 1")
    own, out = by_size(targets, "target_id", task_points), []
    if own.groups or own.large is None:
        if pairs == "same":
            found = _within(queries if own.large is None else queries.join(own.small.select(F.col("target_id").alias("query_id")).distinct(), "query_id", "left_semi"), own.small, k)
        else:
            found = _in_tiles(queries, own.small, k, pairs == "all", own.points, own.groups)
        out.append(found.withColumn("rank", F.row_number().over(Window.partitionBy(*KEY).orderBy("d2", "idx"))))
    if own.large is not None:
        asked = queries.join(own.large.select(F.col("target_id").alias("query_id")).distinct(), "query_id", "left_semi") if pairs == "same" else queries
        out.append(_best(_by_tree(asked, own.large, k, pairs, leaf), KEY, k))
    kinds = {"query_idx": queries.schema["query_idx"].dataType, "idx": targets.schema["idx"].dataType}
    return reduce(DataFrame.unionByName, [df.withColumns({c: F.col(c).cast(t) for c, t in kinds.items()}) for df in out]).select(*KEY, "idx", "d2", "rank")


def as_queries(points: DataFrame) -> DataFrame:
    """A point frame (neuron_id, idx, x, y, z) as ``knn`` wants its queries."""
    return points.select(F.col("neuron_id").alias("query_id"), F.col("idx").alias("query_idx"), *[F.col(c).alias("q" + c) for c in AXES])


def as_targets(points: DataFrame) -> DataFrame:
    return points.select(F.col("neuron_id").alias("target_id"), "idx", *AXES)


def farthest_first(neighbours: DataFrame) -> DataFrame:
    """(query_id, query_idx, target_id, neighbours): indices by falling distance, as a nearest-neighbour query lists them."""
    by = neighbours.groupBy("query_id", "query_idx", "target_id").agg(F.sort_array(F.collect_list(F.struct(F.col("rank"), F.col("idx"))), asc=False).alias("l"))
    return by.select("query_id", "query_idx", "target_id", F.transform("l", lambda s: s["idx"]).alias("neighbours"))
