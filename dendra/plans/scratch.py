"""Tables written between steps of a plan, in the folder that all machines share."""

from __future__ import annotations

import threading
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Bytes of a row group in written tables, so that a writer holds little.
ROW_GROUP = 16 << 20
ARROW_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"

_own = threading.local()


def _paths() -> list[str]:
    if not hasattr(_own, "paths"):
        _own.paths = []
    return _own.paths


def _is_local(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    return jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getScheme() == "file"


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, and where that is unset the session's warehouse.
    A warehouse on the machine's own disk will do for a local session only."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    warehouse, master = spark.conf.get("spark.sql.warehouse.dir").rstrip("/"), spark.sparkContext.master
    if (not master.startswith("local") or master.startswith("local-cluster")) and _is_local(spark, warehouse):
        raise RuntimeError(f"set spark.checkpoint.dir to a folder that all machines share; the warehouse {warehouse} is on each machine's own disk")
    return f"{warehouse}/dendra_scratch"


def fresh(spark: SparkSession, label: str) -> str:
    """An unused path in the shared folder, for the caller to write to; ``release`` deletes it."""
    path = f"{shared_folder(spark)}/dendra-{label}-{uuid.uuid4().hex}"
    _paths().append(path)
    return path


def written(df: DataFrame, label: str, arrow_rows: int | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts the lineage, survives lost executors,
    and makes a value computed once stay the same in every later scan.

    arrow_rows: rows per batch that Python functions in ``df`` get while it is written (whole texts are large rows).
    """
    spark = df.sparkSession
    path = fresh(spark, label)
    before = spark.conf.get(ARROW_ROWS)
    if arrow_rows:
        spark.conf.set(ARROW_ROWS, str(arrow_rows))
    try:
        df.write.option("parquet.block.size", str(ROW_GROUP)).parquet(path)
    finally:
        if arrow_rows:
            spark.conf.set(ARROW_ROWS, before)
    return spark.read.schema(df.schema).parquet(path)


def held() -> int:
    """How many tables this thread has written and not released."""
    return len(_paths())


def taken(since: int) -> list[str]:
    """The paths this thread has written after the first ``since``; from now on they are the caller's to ``drop``."""
    paths = _paths()
    own, paths[since:] = paths[since:], []
    return own


def given(paths: list[str]) -> None:
    """Hands paths back to ``release``."""
    _paths().extend(paths)


def drop(spark: SparkSession, paths: list[str]) -> None:
    for name in paths:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def release(spark: SparkSession, since: int = 0, but_last: bool = False) -> None:
    """Delete what this thread has written (after the first ``since`` tables; the last one stays if ``but_last``); call it once
    the results that read it are stored."""
    own = taken(since)
    kept = own[-1:] if but_last else []
    drop(spark, own[: len(own) - len(kept)])
    given(kept)
