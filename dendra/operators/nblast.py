"""Similarity of neurons: each query point is matched with the nearest target point, and the pair scored by distance and direction."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dendra.functions.linalg import directions, first_component, moments
from dendra.functions.score_table import ScoreTable
from dendra.operators import tiles
from dendra.operators.batches import AXES, runs
from dendra.operators.search import Cloud
from dendra.operators.spatial import TASK_POINTS, Sized, as_queries, as_targets, by_size, knn
from dendra.operators.tiles import OUT_ROWS
from dendra.operators.tree import LEAF
from dendra.plans.scratch import written

DIRECTION = ("vx", "vy", "vz")


def _near_directions(points: DataFrame, k: int) -> DataFrame:
    """``points`` with the direction of each one's k nearest. A neuron is one task's work."""
    given = list(points.columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for own in runs(batches, "neuron_id"):
            x = np.column_stack([own.column(c).to_numpy().astype(float) for c in AXES])
            cloud = Cloud(x)
            for a in range(0, len(x), step := max(1, OUT_ROWS // k)):
                part = x[a : a + step]
                at, _ = cloud.nearest(part, k)
                v = directions(x[at] - part[:, None])
                rows = own.slice(a, len(part)).combine_chunks()
                kept = [rows.column(c).combine_chunks() for c in given]
                yield pa.RecordBatch.from_arrays([*kept, *[pa.array(c, mask=np.isnan(c)) for c in v.T]], names=[*given, *DIRECTION])

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in points.schema.fields)
    sorted_ = points.repartition("neuron_id").sortWithinPartitions("neuron_id", "idx")
    return sorted_.mapInArrow(run, f"{kinds}, " + ", ".join(f"{c} double" for c in DIRECTION))


def _joined_directions(points: DataFrame, k: int, leaf: int) -> DataFrame:
    """The same for neurons of any size."""
    near = knn(as_queries(points), as_targets(points), k, "same", leaf, 0)
    there = points.select(F.col("neuron_id").alias("target_id"), "idx", *[F.col(c).alias("n" + c) for c in AXES])
    own = points.select(F.col("neuron_id").alias("query_id"), F.col("idx").alias("query_idx"), *AXES)
    joined = near.select("query_id", "query_idx", "target_id", "idx").join(there, ["target_id", "idx"]).join(own, ["query_id", "query_idx"])
    sums = joined.groupBy("query_id", "query_idx", *AXES).agg(*moments(*[F.col("n" + c) - F.col(c) for c in AXES]))
    return first_component(sums.withColumnsRenamed({"query_id": "neuron_id", "query_idx": "idx"}), DIRECTION).select("neuron_id", "idx", *AXES, *DIRECTION)


def direction_vectors(points: DataFrame, k: int, leaf: int = LEAF, task_points: int = TASK_POINTS) -> DataFrame:
    """``points`` (neuron_id, idx, x, y, z) with the first principal component of each point's k nearest points, itself included.

    Where there is none (see ``first_component``) the direction is NULL and scores as |dot| = 0.
    """
    points = points.select("neuron_id", "idx", *AXES)
    own = by_size(points, "neuron_id", task_points)
    found = _near_directions(own.small, k)
    if own.large is not None:
        found = found.unionByName(_joined_directions(own.large, k, leaf))
    return written(found, "vectors")  # a scoring plan reads them several times


def self_scores(vectors: DataFrame, table: ScoreTable) -> DataFrame:
    """Each neuron against itself: its points times the best score."""
    return vectors.groupBy("neuron_id").agg((F.count("*") * F.lit(table.self_score)).alias("raw")).select(F.col("neuron_id").alias("target_id"), F.col("neuron_id").alias("query_id"), "raw")


def matches(query: DataFrame, target: DataFrame, pairs: str = "all", leaf: int = LEAF, task_points: int = TASK_POINTS) -> DataFrame:
    """(query_id, query_idx, target_id, idx, distance, adp) of each query point and its nearest point in each target.

    adp is rounded to 9 digits before it is binned, so that engines whose cosines differ in the last bit agree.
    """
    near = knn(as_queries(query), as_targets(target), 1, pairs, leaf, task_points).select("query_id", "query_idx", "target_id", "idx", "d2")
    q = query.select(F.col("neuron_id").alias("query_id"), F.col("idx").alias("query_idx"), *[F.col(c).alias("q" + c) for c in DIRECTION])
    t = target.select(F.col("neuron_id").alias("target_id"), "idx", *DIRECTION)
    dot = F.abs(F.col("qvx") * F.col("vx") + F.col("qvy") * F.col("vy") + F.col("qvz") * F.col("vz"))
    joined = near.join(q, ["query_id", "query_idx"]).join(t, ["target_id", "idx"])
    return joined.select("query_id", "query_idx", "target_id", "idx", F.sqrt("d2").alias("distance"), F.round(F.coalesce(dot, F.lit(0.0)), 9).alias("adp"))


def tile_scores(query: DataFrame, target: Sized, table: ScoreTable, same: bool, own: bool) -> DataFrame:
    """(target_id, query_id, raw) of small targets: each task scores some of them against some queries, so a point is copied once per group and
    only sums leave the task. own: the queries are the targets."""
    values = [*AXES, *DIRECTION]
    renamed = lambda df: df.select(F.col("neuron_id").alias("id"), "idx", *values)
    parts = int(query.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    there, n = tiles.pack_targets(renamed(target.small), values), tiles.groups(target.points, target.groups, parts)
    if own:
        dealt = tiles.tiles(there, there, n, n)
    else:
        size = query.agg(F.count("*").alias("n"), F.approx_count_distinct("neuron_id").alias("ids")).first()
        dealt = tiles.tiles(there, tiles.pack_queries(renamed(query), values), n, tiles.groups(size["n"], size["ids"], parts))

    def work(target_id, _, cloud, there, query_id, idxs, x):
        at, d2 = cloud.nearest(x[:, :3], 1)
        if not at.shape[1]:
            return
        a, b = x[:, 3:], there[at[:, 0], 3:]
        adp = np.round(np.nan_to_num(np.abs(a[:, 0] * b[:, 0] + a[:, 1] * b[:, 1] + a[:, 2] * b[:, 2]), nan=0.0), 9)
        raw = float(table.scores(np.sqrt(d2[:, 0]), adp).sum())
        yield pa.RecordBatch.from_arrays([pa.array([target_id]), pa.array([query_id]), pa.array([raw])], names=["target_id", "query_id", "raw"])

    kinds = [df.schema["neuron_id"].dataType.simpleString() for df in (target.small, query)]
    return tiles.met(dealt, work, f"target_id {kinds[0]}, query_id {kinds[1]}, raw double", len(values), same)


def raw_scores(query: DataFrame, target: DataFrame, table: ScoreTable | None = None, pairs: str = "all", leaf: int = LEAF, task_points: int = TASK_POINTS) -> DataFrame:
    """(target_id, query_id, raw): the sum over query points. pairs: "all" or "other" targets."""
    table = table or ScoreTable()
    own = by_size(target, "neuron_id", task_points)
    found = tile_scores(query, own, table, pairs == "all", query is target and own.large is None)
    if own.large is not None:
        scored = matches(query, own.large, pairs, leaf, 0).withColumn("raw", table.score(F.col("distance"), F.col("adp")))
        found = found.unionByName(scored.select("target_id", "query_id", "raw"))
    return found.groupBy("target_id", "query_id").agg(F.sum("raw").alias("raw"))


def score_matrix(vectors: DataFrame, table: ScoreTable | None = None) -> DataFrame:
    """All pairs of neurons in one plan; the diagonal needs no matching."""
    table = table or ScoreTable()
    return raw_scores(vectors, vectors, table, "other").unionByName(self_scores(vectors, table))


def _check(ok: Column, value: Column, message: str) -> Column:
    return F.when(ok, value).otherwise(F.raise_error(F.lit(message)).cast("double"))


def normalized(scores: DataFrame, validate: bool = False) -> DataFrame:
    """(target_id, query_id, normalized): raw over the query's score against itself.

    validate: fail at run time where a score is above the diagonal of its column.
    """
    scores = written(scores, "scores")  # read twice
    diagonal = scores.where("target_id = query_id").select("query_id", F.col("raw").alias("own"))
    ratio = F.col("raw") / F.col("own")
    value = _check(F.col("raw") <= F.col("own"), ratio, "a score is above its column's diagonal") if validate else ratio
    return scores.join(diagonal, "query_id").select("target_id", "query_id", value.alias("normalized"))


def mean_scores(norm: DataFrame, validate: bool = False) -> DataFrame:
    """(target_id, query_id, mean): of both directions; 1 on the diagonal.

    validate: fail at run time where a normalised score is above 1.
    """
    norm = written(norm, "normalized")  # read twice
    back = norm.select(F.col("target_id").alias("query_id"), F.col("query_id").alias("target_id"), F.col("normalized").alias("other"))
    both = (F.col("normalized") + F.col("other")) / 2
    value = _check(F.greatest("normalized", "other") <= 1 + 1e-9, both, "a normalised score is above 1") if validate else both
    return norm.join(back, ["target_id", "query_id"]).select("target_id", "query_id", F.when(F.col("target_id") == F.col("query_id"), 1.0).otherwise(value).alias("mean"))


def neuron_count(scores: DataFrame) -> int:
    return scores.select("query_id").distinct().count()


def to_matrix(scores: DataFrame, value: str):
    """Targets by queries as a pandas frame; for matrices that fit the driver."""
    return scores.toPandas().pivot(index="target_id", columns="query_id", values=value).sort_index().sort_index(axis=1)
