"""Volumes in chunks: a folder of .npy files, one per block and kind, read without a helper library and written by names that say their place.

``labels-<z>-<y>-<x>.npy`` (z, y, x) and ``affinities-<z>-<y>-<x>.npy`` (channel x, y, z; then z, y, x) hold the block at that place of the grid. Reading takes whole
files through Spark, so any file system that it reaches will do; a chunk is as small as a block. Writing the same chunks again replaces them by equal files.
"""

from __future__ import annotations

import ast
import io
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dendra.operators.blocks import PLACE, block_row, unpacked
from dendra.schemas import BLOCKS
from dendra.sources.files import write_files


def array_of(data: bytes) -> np.ndarray:
    """The array of an .npy file (format versions 1 to 3); objects are refused."""
    if data[:6] != b"\x93NUMPY":
        raise ValueError("no .npy file")
    wide = 2 if data[6] == 1 else 4
    size = int.from_bytes(data[8 : 8 + wide], "little")
    head = ast.literal_eval(data[8 + wide : 8 + wide + size].decode("latin1"))
    kind = np.dtype(head["descr"])
    if kind.hasobject:
        raise ValueError("an .npy file of objects")
    flat = np.frombuffer(data, kind, int(np.prod(head["shape"], dtype=np.int64)), 8 + wide + size)
    return flat.reshape(head["shape"], order="F" if head["fortran_order"] else "C")


def file_of(array: np.ndarray) -> bytes:
    out = io.BytesIO()
    np.save(out, array, allow_pickle=False)
    return out.getvalue()


def read_chunks(spark: SparkSession, path: str) -> DataFrame:
    """BLOCKS of the chunks in the folder ``path``. A block without affinities has zeros; affinities without labels are an error. All voxels of a chunk are there."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", "*.npy").load(path)
    name = F.element_at(F.split("path", "/"), -1)
    part = F.split(F.regexp_replace(name, r"\.npy$", ""), r"-(?=-?\d)")
    place = [F.element_at(part, i + 2).cast("long").alias(p) for i, p in enumerate(PLACE)]
    of = lambda kind: found.where(F.element_at(part, 1) == kind).select(*place, F.col("content").alias(kind))
    both = of("labels").join(of("affinities"), list(PLACE), "full")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for *at, labels, affinities in zip(*(c.to_pylist() for c in batch.columns)):
                if labels is None:
                    raise ValueError(f"affinities without labels at {at}")
                labels = array_of(labels)
                values = np.zeros((3, *labels.shape)) if affinities is None else array_of(affinities)[::-1]  # channels x, y, z
                if values.shape != (3, *labels.shape):
                    raise ValueError(f"labels {labels.shape} and affinities {values.shape} don't fit at {at}")
                yield block_row(tuple(at), labels.astype(np.int64), values, np.ones(labels.shape, bool))

    return both.select(*PLACE, "labels", "affinities").mapInArrow(run, BLOCKS)


def write_chunks(blocks: DataFrame, path: str, mode: str = "error", labels: str = "<u4", affinities: str | None = "<f4") -> None:
    """Chunks of ``blocks`` in the folder ``path``. labels, affinities: the files' kinds; None leaves affinities out. Voxels that aren't there are 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in unpacked(batches):
            at = "-".join(str(block[p]) for p in PLACE)
            out = [(f"labels-{at}.npy", file_of(block["labels"].astype(labels)))]
            if affinities:
                out.append((f"affinities-{at}.npy", file_of(np.ascontiguousarray(block["affinities"][::-1].astype(affinities)))))
            yield pa.RecordBatch.from_arrays([pa.array([n for n, _ in out]), pa.array([d for _, d in out], pa.binary())], names=["name", "data"])

    write_files(blocks.mapInArrow(run, "name string, data binary"), path, mode)
