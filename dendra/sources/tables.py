"""Frames from and to arrays, pandas and Parquet."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dendra.operators.skeleton import AXES, attributes, reindex
from dendra.schemas import SKELETON, SWC, VECTORS, ensure_schema, reject_nan


def from_swc_rows(rows: DataFrame) -> DataFrame:
    """A skeleton frame from (neuron_id, row): arrays of id, class, x, y, z, radius, parent, ids as in the file, in any order.

    A row of another length and a NaN coordinate fail at run time.
    """
    row = F.when(F.size("row") == 7, F.col("row")).otherwise(F.raise_error(F.lit("a row needs 7 values")).cast("array<double>"))
    value = lambda i, kind: F.get("row", F.lit(i)).cast(kind)
    at = {"id": (0, "int"), "class": (1, "int"), "x": (2, "double"), "y": (3, "double"), "z": (4, "double"), "r": (5, "double"), "parent": (6, "int")}
    own = rows.select("neuron_id", row.alias("row")).select("neuron_id", *[value(*v).alias(c) for c, v in at.items()])
    return reindex(reject_nan(ensure_schema(own, SWC), *AXES))


def from_point_rows(rows: DataFrame) -> DataFrame:
    """A skeleton frame from (neuron_id, idx, point, parent) and, if there is one, class (default 0).

    point: x, y, z and perhaps the radius (default 0). parent: 0-based, negative or NULL for none. NaN fails at run time.
    """
    point = lambda i: F.get("point", F.lit(i)).cast("double")
    kind = F.col("class") if "class" in rows.columns else F.lit(0)
    own = rows.select("neuron_id", "idx", kind.alias("class"), *[point(i).alias(c) for i, c in enumerate(AXES)], F.coalesce(point(3), F.lit(0.0)).alias("r"), F.when(F.col("parent") >= 0, F.col("parent")).alias("parent"))
    return reject_nan(ensure_schema(own, SKELETON), *AXES)


def from_attribute_rows(rows: DataFrame) -> DataFrame:
    """A skeleton frame from (neuron_id, idx, point, attributes): class, parent, first child, next sibling, the last two derived
    anew when needed."""
    at = lambda i: F.get("attributes", F.lit(i)).cast("int")
    return from_point_rows(rows.select("neuron_id", "idx", "point", at(0).alias("class"), at(1).alias("parent")))


def from_swc_array(spark: SparkSession, array: np.ndarray, neuron_id: str = "0") -> DataFrame:
    """``from_swc_rows`` of one neuron's N x 7 array."""
    array = np.asarray(array, float)
    if array.ndim != 2 or array.shape[1] != 7:
        raise ValueError(f"7 columns are needed; the array's shape is {array.shape}")
    return from_swc_rows(spark.createDataFrame([(neuron_id, r) for r in array.tolist()], "neuron_id string, row array<double>"))


def from_points_and_parents(spark: SparkSession, points: np.ndarray, parents: np.ndarray, classes: np.ndarray | None = None, neuron_id: str = "0") -> DataFrame:
    """``from_point_rows`` of one neuron's N x 3 or N x 4 points and 0-based parents (negative: none)."""
    points, parents = np.asarray(points, float), np.asarray(parents, int)
    classes = np.zeros(len(points), int) if classes is None else np.asarray(classes, int)
    if points.ndim != 2 or points.shape[1] not in (3, 4) or not len(points) == len(parents) == len(classes):
        raise ValueError(f"shapes don't fit: {points.shape}, {parents.shape}, {classes.shape}")
    if (parents >= len(points)).any():
        raise ValueError("a parent is beyond the last point")
    rows = [(neuron_id, i, p, u, c) for i, (p, u, c) in enumerate(zip(points.tolist(), parents.tolist(), classes.tolist()))]
    return from_point_rows(spark.createDataFrame(rows, "neuron_id string, idx int, point array<double>, parent int, class int"))


def from_points_and_attributes(spark: SparkSession, points: np.ndarray, attrs: np.ndarray, neuron_id: str = "0") -> DataFrame:
    """From one neuron's points and N x 4 attributes (class, parent, first child, sibling)."""
    attrs = np.asarray(attrs, int)
    return from_points_and_parents(spark, points, attrs[:, 1], attrs[:, 0], neuron_id)


def to_arrays(nodes: DataFrame) -> dict[str, tuple[np.ndarray, np.ndarray]]:
    """Neuron to (N x 4 points as float32, N x 4 attributes as int32), on the driver: for neurons that fit it."""
    pdf = nodes.select("neuron_id", "idx", *AXES, "r").join(attributes(nodes), ["neuron_id", "idx"]).toPandas().sort_values(["neuron_id", "idx"])
    return {n: (g[[*AXES, "r"]].to_numpy("f4"), g[["class", "parent", "first_child", "next_sibling"]].to_numpy("i4")) for n, g in pdf.groupby("neuron_id")}


def points_from_array(spark: SparkSession, points: np.ndarray, neuron_id: str = "0") -> DataFrame:
    """A point frame from the first three columns of an array; NaN is refused."""
    points = np.asarray(points, float)[:, :3]
    if np.isnan(points).any():
        raise ValueError("a coordinate is NaN")
    return spark.createDataFrame([(neuron_id, i, *map(float, p)) for i, p in enumerate(points)], "neuron_id string, idx int, x double, y double, z double")


def save(df: DataFrame, path: str, mode: str = "error") -> None:
    """Skeletons or vectors as Parquet, a folder per neuron, so that a filter on neurons reads only theirs."""
    df.repartition("neuron_id").sortWithinPartitions("neuron_id", "idx").write.mode(mode).partitionBy("neuron_id").parquet(path)


def load_skeletons(spark: SparkSession, path: str) -> DataFrame:
    return ensure_schema(spark.read.parquet(path), SKELETON)


def load_vectors(spark: SparkSession, path: str) -> DataFrame:
    return ensure_schema(spark.read.parquet(path), VECTORS)
