"""Objects for interactive use on one or a few neurons: thin handles on frames, with arrays in and out.

Every method is a query on the frame; for many neurons use the operators directly.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dendra.functions.linalg import pca_first_component as _pca
from dendra.functions.linalg import pca_first_component_any
from dendra.functions.score_table import ScoreTable
from dendra.operators import downsample as _down
from dendra.operators import merge_tree, nblast, segmentation, skeleton, spatial
from dendra.plans.scratch import written
from dendra.sources import precomputed, swc, tables, volumes

__all__ = ["KDTree", "ScoreMatrix", "ScoreTable", "Skeleton", "SupervoxelDendrogram", "VectorCloud", "mean_matrix", "normalized_matrix", "pca_first_component"]


def _spark(spark: SparkSession | None) -> SparkSession:
    return spark or SparkSession.builder.getOrCreate()


class _Handle:
    """A handle on ``frame``; its pickle holds the rows, and is opened in the session that is active then."""

    frame: DataFrame

    def __getstate__(self) -> dict:
        return self.__dict__ | {"frame": self.frame.toArrow()}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state, frame=_spark(None).createDataFrame(state["frame"]))


class Skeleton(_Handle):
    """One neuron's tree."""

    def __init__(self, frame: DataFrame):
        self.frame = frame

    @classmethod
    def from_swc_array(cls, array: np.ndarray, spark: SparkSession | None = None) -> Skeleton:
        return cls(tables.from_swc_array(_spark(spark), array))

    @classmethod
    def from_points_and_parents(cls, points: np.ndarray, parents: np.ndarray, classes: np.ndarray | None = None, spark: SparkSession | None = None) -> Skeleton:
        return cls(tables.from_points_and_parents(_spark(spark), points, parents, classes))

    @classmethod
    def from_points_and_attributes(cls, points: np.ndarray, attributes: np.ndarray, spark: SparkSession | None = None) -> Skeleton:
        return cls(tables.from_points_and_attributes(_spark(spark), points, attributes))

    @classmethod
    def from_swc(cls, path: str, spark: SparkSession | None = None) -> Skeleton:
        return cls(swc.read_swc(_spark(spark), path))

    @classmethod
    def from_precomputed(cls, data: bytes, spark: SparkSession | None = None) -> Skeleton:
        return cls(precomputed.decode(_spark(spark).createDataFrame([("0", bytearray(data))], "neuron_id string, data binary")))

    def to_precomputed(self) -> bytes:
        return bytes(precomputed.encode(self.frame).first()["data"])

    def to_swc_str(self, precision: int = 3) -> str:
        return swc.swc_text(self.frame, precision).first()["swc"]

    def to_swc(self, path: str, precision: int = 3) -> None:
        """One text file on the driver."""
        with open(path, "w") as f:
            f.write(self.to_swc_str(precision))

    write_swc = to_swc

    @property
    def points(self) -> np.ndarray:
        pdf = skeleton.points(self.frame).orderBy("idx").toPandas()
        return pdf[["x", "y", "z", "r"]].to_numpy("f4")

    @points.setter
    def points(self, new: np.ndarray) -> None:
        rows = [(i, *map(float, p)) for i, p in enumerate(np.asarray(new))]
        key = self.frame.select("neuron_id").distinct()
        df = self.frame.sparkSession.createDataFrame(rows, "idx int, x double, y double, z double, r double")
        self.frame = skeleton.set_points(self.frame, df.join(F.broadcast(key)))  # one neuron

    @property
    def attributes(self) -> np.ndarray:
        pdf = skeleton.attributes(self.frame).orderBy("idx").toPandas()
        return pdf[["class", "parent", "first_child", "next_sibling"]].to_numpy("i4")

    @property
    def parents(self) -> np.ndarray:
        return self.attributes[:, 1]

    @property
    def edges(self) -> np.ndarray:
        return skeleton.edges(self.frame).orderBy("child").toPandas()[["child", "parent"]].to_numpy("u4")

    @property
    def path_length(self) -> float:
        return float(skeleton.path_length(self.frame).first()["path_length"])

    def __len__(self) -> int:
        return self.frame.count()

    def __eq__(self, other: object) -> bool:
        return isinstance(other, Skeleton) and bool(skeleton.equal(self.frame, other.frame.withColumn("neuron_id", F.lit(self.frame.first()["neuron_id"]))).first()["equal"])

    __hash__ = None

    def translate_centroid_to_origin(self) -> None:
        """The radius is centred too, as in the arrays' column mean."""
        self.frame = skeleton.center(self.frame, include_radius=True)

    def downsample(self, step: float, duplicate_junctions: bool = False) -> None:
        self.frame = _down.downsample(self.frame, step, duplicate_junctions).drop("source_idx")


class KDTree(_Handle):
    """Nearest neighbours of single points; ``leaf_size`` can't change an answer and is only kept."""

    def __init__(self, points: np.ndarray, leaf_size: int = 10, spark: SparkSession | None = None):
        self.frame, self.leaf_size = spatial.as_targets(tables.points_from_array(_spark(spark), points)), leaf_size

    def knn(self, point: Sequence[float], k: int) -> np.ndarray:
        """Indices of the k nearest points, the farthest first; all points if there are fewer."""
        q = self.frame.sparkSession.createDataFrame([("q", 0, *map(float, point[:3]))], "query_id string, query_idx int, qx double, qy double, qz double")
        rows = spatial.farthest_first(spatial.knn(q, self.frame, k)).collect()
        return np.array(rows[0]["neighbours"] if rows else [], "u4")


class VectorCloud(_Handle):
    """One neuron's points with their directions."""

    def __init__(self, points: np.ndarray, leaf_size: int = 10, k: int = 20, spark: SparkSession | None = None):
        self.frame = nblast.direction_vectors(tables.points_from_array(_spark(spark), points), k)

    @property
    def vectors(self) -> np.ndarray:
        return self.frame.orderBy("idx").select(*nblast.DIRECTION).toPandas().to_numpy("f4")

    def __len__(self) -> int:
        return self.frame.count()

    def query_by_self(self, table: ScoreTable) -> float:
        return len(self) * table.self_score

    def query_by(self, query: VectorCloud, table: ScoreTable) -> float:
        """Score of ``query`` against this cloud as the target."""
        return float(nblast.raw_scores(query.frame, self.frame, table).first()["raw"])


class ScoreMatrix:
    """All pairs of clouds: targets are rows, queries columns."""

    def __init__(self, clouds: Sequence[VectorCloud], table: ScoreTable | None = None):
        named = [c.frame.withColumn("neuron_id", F.lit(f"{i:06d}")) for i, c in enumerate(clouds)]
        frame = named[0]
        for n in named[1:]:
            frame = frame.unionByName(n)
        self.scores = nblast.score_matrix(frame, table)

    @property
    def raw_score_matrix(self) -> np.ndarray:
        return nblast.to_matrix(self.scores, "raw").to_numpy()

    @property
    def normalized_score_matrix(self) -> np.ndarray:
        return nblast.to_matrix(nblast.normalized(self.scores), "normalized").to_numpy()

    @property
    def mean_score_matrix(self) -> np.ndarray:
        return nblast.to_matrix(nblast.mean_scores(nblast.normalized(self.scores)), "mean").to_numpy()


def _long(spark: SparkSession, matrix: np.ndarray, value: str) -> DataFrame:
    rows = [(f"{t:06d}", f"{q:06d}", float(v)) for (t, q), v in np.ndenumerate(np.asarray(matrix, float))]
    return spark.createDataFrame(rows, f"target_id string, query_id string, {value} double")


def normalized_matrix(raw: np.ndarray, spark: SparkSession | None = None) -> np.ndarray:
    """Each column over its diagonal, which must be its largest value."""
    return nblast.to_matrix(nblast.normalized(_long(_spark(spark), raw, "raw"), validate=True), "normalized").to_numpy()


def mean_matrix(normalized: np.ndarray, spark: SparkSession | None = None) -> np.ndarray:
    """Mean of both directions; no value may be above 1."""
    return nblast.to_matrix(nblast.mean_scores(_long(_spark(spark), normalized, "normalized"), validate=True), "mean").to_numpy()


def pca_first_component(sample: np.ndarray, spark: SparkSession | None = None) -> np.ndarray | None:
    """First principal component of an N x d array; None where no direction stands out."""
    spark, sample = _spark(spark), np.asarray(sample, float)
    if sample.shape[1] == 3:
        r = _pca(tables.points_from_array(spark, sample), ["neuron_id"]).first()
        return None if r["vx"] is None else np.array([r["vx"], r["vy"], r["vz"]])
    names = [f"f{i}" for i in range(sample.shape[1])]
    df = spark.createDataFrame([("0", *map(float, r)) for r in sample], ", ".join(["g string", *[f"{n} double" for n in names]]))
    got = pca_first_component_any(df, ["g"], names).first()["component"]
    return None if got is None else np.array(got)


class SupervoxelDendrogram:
    """Agglomeration of a labelled volume; ``segment`` may be called for several thresholds."""

    def __init__(self, affinities: np.ndarray, labels: np.ndarray, min_threshold: float, spark: SparkSession | None = None):
        self.voxels = volumes.voxels_from_arrays(_spark(spark), labels, affinities)
        self.frame = segmentation.build_dendrogram(self.voxels, min_threshold)

    def segment(self, threshold: float) -> np.ndarray:
        return volumes.labels_to_array(segmentation.segment(self.voxels, self.frame, threshold))

    def segment_all(self, thresholds: Sequence[float]) -> list[np.ndarray]:
        """The same for several thresholds, from one merge tree."""
        at = written(merge_tree.segments(merge_tree.build(self.frame), list(thresholds)), "segments")
        return [volumes.labels_to_array(segmentation.relabel(self.voxels, at.where(F.col("threshold") == float(t)).select("label", "root"))) for t in thresholds]
