"""SWC files: one neuron per file, a line per node: id class x y z r parent."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dendra.operators.skeleton import AXES, reindex
from dendra.schemas import reject_nan
from dendra.sources import files

#: Comment at the head of files that are written; it holds no time, so that equal skeletons make equal files.
HEADER = "id class x y z r parent"
#: Files renamed at once when neurons are written.
RENAMES = 32


def read_swc(spark: SparkSession, paths: str | list[str], strict: bool = False, neurons: list[str] | None = None) -> DataFrame:
    """A skeleton frame of all files that ``paths`` names (globs work); neuron_id is the file name without ``.swc``.

    By default lines with other than seven fields are skipped, and so are lines that start with ``#`` or with a blank (the
    blank makes an eighth, empty field). ``strict`` trims lines, cuts comments behind ``#`` and fails on lines with
    another number of fields. Files that don't exist are an error, and so is a coordinate that is NaN. ``neurons``: read only theirs; Spark
    prunes the list of files by their names, so no other file is opened.
    """
    found = spark.read.text(paths)
    if neurons is not None:
        found = found.where(F.col("_metadata.file_name").isin([f"{n}.swc" for n in neurons]))
    return parsed(found, strict)


def parsed(found: DataFrame, strict: bool = False) -> DataFrame:
    """A skeleton frame of the lines of whole files (a text frame with its metadata)."""
    lines = found.select(F.col("_metadata.file_name").alias("f"), F.regexp_replace("value", r"\r$", "").alias("value"))
    lines = lines.withColumn("neuron_id", F.regexp_replace(F.url_decode(F.replace("f", F.lit("+"), F.lit("%2B"))), r"\.swc$", ""))
    if strict:
        lines = lines.withColumn("value", F.trim(F.regexp_replace("value", r"#.*$", ""))).where("value <> ''")
    tokens = F.split("value", r"\s+")
    fields = lines.select("neuron_id", tokens.alias("t"))
    ok = F.size("t") == 7
    if strict:
        fields = fields.withColumn("t", F.when(ok, F.col("t")).otherwise(F.raise_error(F.concat(F.lit("a line of another number of fields in "), F.col("neuron_id"))).cast("array<string>")))
    else:
        fields = fields.where(ok & ~F.get("t", F.lit(0)).startswith("#"))
    t = lambda i, kind: F.get("t", F.lit(i)).cast("double").cast(kind)
    nodes = fields.select("neuron_id", t(0, "int").alias("id"), t(1, "int").alias("class"), *[t(i, "double").alias(c) for i, c in enumerate("xyzr", 2)], t(6, "int").alias("parent"))
    return reindex(reject_nan(nodes, *AXES))


def lines(nodes: DataFrame, precision: int = 3) -> DataFrame:
    """(neuron_id, idx, line): ids and parents count from 1, a missing parent is -1."""
    if precision < 0:
        raise ValueError("precision must not be negative")
    number = f"%.{precision}f"
    parent = F.coalesce(F.col("parent") + 1, F.lit(-1)).cast("int")
    text = F.format_string(f"%d %d {number} {number} {number} {number} %d", F.col("idx") + 1, "class", "x", "y", "z", "r", parent)
    return nodes.select("neuron_id", "idx", text.alias("line"))


def _file_lines(nodes: DataFrame, precision: int, header: str) -> DataFrame:
    """``lines``, with the header's lines, a ``#`` before each, ahead of node 0."""
    head = "".join(f"# {h}\n" for h in header.split("\n"))
    return lines(nodes, precision).withColumn("line", F.when(F.col("idx") == 0, F.concat(F.lit(head), "line")).otherwise(F.col("line")))


def swc_text(nodes: DataFrame, precision: int = 3, header: str = HEADER) -> DataFrame:
    """(neuron_id, swc): the whole file as text, as ``write_swc`` writes it."""
    by = _file_lines(nodes, precision, header).groupBy("neuron_id").agg(F.sort_array(F.collect_list(F.struct("idx", "line"))).alias("l"))
    return by.select("neuron_id", F.concat(F.array_join(F.transform("l", lambda s: s["line"]), "\n"), F.lit("\n")).alias("swc"))


def write_swc(nodes: DataFrame, path: str, precision: int = 3, mode: str = "error", header: str = HEADER) -> None:
    """A file <neuron_id>.swc per neuron in the folder ``path`` (ids with a colon or a slash make no file name and are an error).

    ``mode`` is error, or overwrite, which empties ``path`` first."""
    write_lines(_file_lines(nodes, precision, header), path, mode)


def write_lines(own: DataFrame, path: str, mode: str = "error") -> None:
    """Files of (neuron_id, idx, line): one shuffle, sorted inside each task, names given by the tasks and committed once (``files``).

    Where only Spark reaches the file system, Spark names the parts and the driver renames one file per neuron."""
    if mode not in ("error", "overwrite"):
        raise ValueError(f"mode {mode}")
    if files.reachable(path):
        ended = F.concat("line", F.lit("\n"))
        files.write_files(own.select(F.concat("neuron_id", F.lit(".swc")).alias("name"), "idx", ended.alias("data")), path, mode, "idx")
    else:
        _renamed(own, path, mode)


def _renamed(own: DataFrame, path: str, mode: str) -> None:
    spark = own.sparkSession
    as_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    fs = as_path(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if fs.exists(as_path(path)):
        if mode == "error":
            raise FileExistsError(path)
        fs.delete(as_path(path), True)
    parts = f"{path}/_parts"
    sorted_lines = own.repartition("neuron_id").sortWithinPartitions("neuron_id", "idx").select("neuron_id", "line")
    sorted_lines.write.option("maxRecordsPerFile", 0).partitionBy("neuron_id").text(parts)

    def settle(folder) -> None:
        (part,) = [f.getPath() for f in fs.listStatus(folder) if f.getPath().getName().startswith("part-")]
        neuron = unquote(folder.getName().split("=", 1)[1])
        if not fs.rename(part, as_path(f"{path}/{neuron}.swc")):
            raise OSError(f"{part} can't be renamed")

    folders = [f.getPath() for f in fs.listStatus(as_path(parts)) if f.isDirectory()]
    with ThreadPoolExecutor(RENAMES) as pool:
        list(pool.map(settle, folders))
    fs.delete(as_path(parts), True)
