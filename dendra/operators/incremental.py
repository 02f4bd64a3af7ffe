"""A score matrix that grows: neurons that arrive are scored against those that are there, and back, and nothing else is scored again.

The state is a folder of versions. Version v holds the vectors of the neurons that came with it, and the scores of the pairs that it added: new against old, old against
new, new against new. A version that is written again after a failure replaces itself, so every pair is there once; a version counts from the moment that its scores
are whole (Spark's mark of success).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dendra.functions.score_table import ScoreTable
from dendra.operators import nblast
from dendra.schemas import VECTORS, ensure_schema

SCORES = "target_id string, query_id string, raw double"


class MatrixState:
    """The state in the folder ``path``. k: neighbours of a direction; the same for all versions."""

    def __init__(self, spark: SparkSession, path: str, k: int, table: ScoreTable | None = None):
        self.spark, self.path, self.k, self.table = spark, path.rstrip("/"), k, table or ScoreTable()

    def versions(self) -> list[int]:
        """Those that are whole."""
        jvm = self.spark.sparkContext._jvm
        folder = jvm.org.apache.hadoop.fs.Path(f"{self.path}/scores")
        fs = folder.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        if not fs.exists(folder):
            return []
        names = [f.getPath() for f in fs.listStatus(folder)]
        return sorted(int(p.getName().split("=")[1]) for p in names if fs.exists(jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS")))

    def _read(self, kind: str, versions: list[int], ddl: str) -> DataFrame:
        if not versions:
            return self.spark.createDataFrame([], ddl)
        return ensure_schema(self.spark.read.parquet(*[f"{self.path}/{kind}/version={v}" for v in versions]), ddl)

    def vectors(self, before: int | None = None) -> DataFrame:
        return self._read("vectors", [v for v in self.versions() if before is None or v < before], VECTORS)

    def scores(self) -> DataFrame:
        """(target_id, query_id, raw) of all pairs so far."""
        return self._read("scores", self.versions(), SCORES)

    def add(self, points: DataFrame, version: int) -> None:
        """Takes in the neurons of ``points`` (neuron_id, idx, x, y, z) as ``version``: a number above those that are whole, or the last of them
        again. A neuron that is there already is an error."""
        there = self.versions()
        if there and version < there[-1]:
            raise ValueError(f"version {version} comes before {there[-1]}")
        old = self.vectors(version)
        again = points.select("neuron_id").distinct().join(old.select("neuron_id").distinct(), "neuron_id", "left_semi").take(1)
        if again:
            raise ValueError(f"neuron {again[0][0]} is there already")
        vectors = f"{self.path}/vectors/version={version}"
        nblast.direction_vectors(points, self.k).write.mode("overwrite").parquet(vectors)
        new = ensure_schema(self.spark.read.parquet(vectors), VECTORS)
        pairs = nblast.score_matrix(new, self.table)
        if any(v < version for v in there):
            pairs = pairs.unionByName(nblast.raw_scores(new, old, self.table)).unionByName(nblast.raw_scores(old, new, self.table))
        ensure_schema(pairs, SCORES).write.mode("overwrite").parquet(f"{self.path}/scores/version={version}")

    def follow(self, arrivals: DataFrame, checkpoint: str, **trigger):
        """Adds each delivery of the stream ``arrivals`` (whole neurons) as a version. A delivery that is repeated is the same version."""

        def deliver(points: DataFrame, number: int) -> None:
            if points.take(1):
                self.add(points, number)

        return arrivals.writeStream.foreachBatch(deliver).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def added_pairs(state: MatrixState, version: int) -> int:
    """How many pairs a version scored."""
    return state._read("scores", [version], SCORES).agg(F.count("*")).first()[0]
