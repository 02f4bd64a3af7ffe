"""Neurons that arrive as SWC files: a stream that writes skeletons to a table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from dendra.schemas import SKELETON, ensure_schema
from dendra.sources import swc


def swc_stream(spark: SparkSession, folder: str, table: str, checkpoint: str, strict: bool = False, files_a_batch: int = 10_000, **trigger) -> StreamingQuery:
    """Reads each SWC file once that comes to ``folder``, and writes its skeleton to the Parquet folder ``table``, a folder per delivery.

    Files come whole to a delivery, so a node's parent is in the same one. A delivery that is repeated after a failure writes its folder again, so a
    file's rows are there once. trigger: as for Spark's ``trigger``, by default until all files there now are read.
    """

    def deliver(lines: DataFrame, number: int) -> None:
        ensure_schema(swc.parsed(lines, strict), SKELETON).write.mode("overwrite").parquet(f"{table}/delivery={number}")

    found = spark.readStream.format("text").option("maxFilesPerTrigger", files_a_batch).load(folder).select("value", "_metadata")
    return found.writeStream.foreachBatch(deliver).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def read_deliveries(spark: SparkSession, table: str) -> DataFrame:
    """The skeleton frame of all deliveries."""
    return ensure_schema(spark.read.parquet(table), SKELETON)
