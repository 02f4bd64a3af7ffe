"""Domain frames derived from the driver's tables, by whole-number keys, so that SQL derives the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from dendra.plans.scratch import fresh
from dendra.sources import swc


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A neuron per label of ``embeddings``; the first three components scaled to nanometres."""
    e = _table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label")
    order = Window.partitionBy("label").orderBy("vec_id")
    xyz = {c: F.col("embedding")[i].cast("double") * 40000 for i, c in enumerate("xyz")}
    return e.select(F.col("label").cast("string").alias("neuron_id"), (F.row_number().over(order) - 1).cast("int").alias("idx"), *[v.alias(k) for k, v in xyz.items()])


def numbered_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes of ``skeletons`` by file id (p_partkey), with the parent as a file id: neuron per brand."""
    p = _table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_size", "p_retailprice")
    order = Window.partitionBy("p_brand").orderBy("p_partkey")
    return p.select(
        F.col("p_brand").alias("neuron_id"), F.col("p_partkey").alias("id"), (F.row_number().over(order) - 1).cast("int").alias("idx"),
        (F.col("p_size") % 8).cast("int").alias("class"), F.col("p_size").cast("double").alias("x"), (F.col("p_retailprice") - 900).alias("y"),
        (F.col("p_partkey") % 100).cast("double").alias("z"), (F.col("p_size") / 10).alias("r"),
    )


def skeletons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parent: none at 0, a third of the index at multiples of 9, else the node before."""
    n = numbered_parts(spark, sf_dir).drop("id")
    i = F.col("idx")
    parent = F.when(i == 0, F.lit(None)).when(i % 9 == 0, F.floor(i / 3)).otherwise(i - 1).cast("int")
    return n.withColumn("parent", parent)


def swc_folder(spark: SparkSession, sf_dir: str) -> str:
    """SWC files of ``skeletons`` in the shared folder; each fifth line is indented, each seventh has a comment behind it."""
    own = swc.lines(skeletons(spark, sf_dir), precision=2)
    indent, tail = F.when(F.col("idx") % 5 == 0, "  ").otherwise(""), F.when(F.col("idx") % 7 == 0, " # a remark").otherwise("")
    path = fresh(spark, "swc")
    swc.write_lines(own.withColumn("line", F.concat(indent, "line", tail)), path)
    return path


def voxels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A 20 x 20 x n volume from ``events``; affinities are whole thousandths, the same for the three axes."""
    e = _table(spark, sf_dir, "events").select("event_id", "event_type", "value")
    i = F.col("event_id")
    z, y, x = (F.floor(i / 400), F.floor(i / 20) % 20, i % 20)
    block = 1 + F.floor(z / 5) * 16 + F.floor(y / 5) * 4 + F.floor(x / 5)
    label = F.when((F.col("event_type") == "error") & (F.col("value") < 5), 0).otherwise(block).cast("long")
    aff = F.least(F.lit(1000), F.floor(20 * F.col("value"))).cast("long")
    return e.select(z.cast("int").alias("z"), y.cast("int").alias("y"), x.cast("int").alias("x"), label.alias("label"), *[aff.alias(f"aff_{a}") for a in "xyz"])
