"""Binary skeletons: two unsigned 32-bit counts (vertices, edges), xyz as float32, edges as unsigned 32-bit pairs, and optionally
radii as float32 and classes as unsigned bytes; all little-endian."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dendra.schemas import reject_nan

NODES = "neuron_id string, idx int, class int, x double, y double, z double, r double, parent int"


def encode_arrays(xyz: np.ndarray, parent: np.ndarray, r: np.ndarray, kind: np.ndarray) -> bytes:
    """Radii are written if any radius or class is not 0, classes if any is not 0."""
    child = np.flatnonzero(parent >= 0)
    parts = [np.array([len(xyz), len(child)], "<u4"), xyz.astype("<f4"), np.stack([child, parent[child]], axis=1).astype("<u4")]
    if r.any() or kind.any():
        parts.append(r.astype("<f4"))
    if kind.any():
        parts.append(kind.astype("u1"))
    return b"".join(p.tobytes() for p in parts)


def decode_arrays(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """xyz, parent (-1 at roots), radius, class. Raises if the length doesn't fit the counts."""
    if len(data) < 8:
        raise ValueError(f"{len(data)} bytes hold no counts")
    n, m = (int(v) for v in np.frombuffer(data, "<u4", 2))
    body = 8 + 12 * n + 8 * m
    if len(data) not in (body, body + 4 * n, body + 5 * n):
        raise ValueError(f"{n} vertices and {m} edges don't make {len(data)} bytes")
    xyz = np.frombuffer(data, "<f4", 3 * n, 8).reshape(n, 3)
    edges = np.frombuffer(data, "<u4", 2 * m, 8 + 12 * n).reshape(m, 2).astype(np.int64)
    if m and edges.max() >= n:
        raise ValueError("an edge names a vertex that isn't there")
    parent = np.full(n, -1)
    parent[edges[:, 0]] = edges[:, 1]
    r = np.frombuffer(data, "<f4", n, body) if len(data) > body else np.zeros(n, "<f4")
    kind = np.frombuffer(data, "u1", n, body + 4 * n) if len(data) == body + 5 * n and n else np.zeros(n, "u1")
    return xyz, parent, r, kind


def encode(nodes: DataFrame) -> DataFrame:
    """(neuron_id, data). A neuron is one value, so its nodes meet in one task."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("idx")
        data = encode_arrays(pdf[["x", "y", "z"]].to_numpy(float), pdf["parent"].fillna(-1).to_numpy(np.int64), pdf["r"].fillna(0).to_numpy(float), pdf["class"].fillna(0).to_numpy(np.int64))
        return pd.DataFrame({"neuron_id": [pdf["neuron_id"].iloc[0]], "data": [data]})

    return nodes.select(*[c.split()[0] for c in NODES.split(", ")]).groupBy("neuron_id").applyInPandas(run, "neuron_id string, data binary")


def decode(encoded: DataFrame) -> DataFrame:
    """A skeleton frame from (neuron_id, data). NaN coordinates fail at run time."""

    def run(batches):
        for pdf in batches:
            for neuron, data in zip(pdf["neuron_id"], pdf["data"]):
                xyz, parent, r, kind = decode_arrays(bytes(data))
                out = pd.DataFrame(xyz.astype(float), columns=["x", "y", "z"])
                out["neuron_id"], out["idx"], out["class"], out["r"] = neuron, np.arange(len(out)), kind.astype(int), r.astype(float)
                up = pd.array(np.maximum(parent, 0), dtype="Int64")
                up[parent < 0] = pd.NA
                out["parent"] = up
                yield out[["neuron_id", "idx", "class", "x", "y", "z", "r", "parent"]]

    return reject_nan(encoded.select("neuron_id", "data").mapInPandas(run, NODES), "x", "y", "z")


def read_precomputed(spark: SparkSession, path: str) -> DataFrame:
    """A skeleton frame of all files under ``path``; neuron_id is the file name."""
    files = spark.read.format("binaryFile").load(path)
    return decode(files.select(F.element_at(F.split("path", "/"), -1).alias("neuron_id"), F.col("content").alias("data")))
