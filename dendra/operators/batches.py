"""Arrow batches of sorted rows, cut where a group ends; points packed into rows of arrays."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  pa.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

AXES = ("x", "y", "z")


def runs(batches: Iterator[pa.RecordBatch], *names: str) -> Iterator[pa.Table]:
    """The rows of each run of equal ``names``, in order; only one run is held."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        cut = np.zeros(batch.num_rows, bool)
        for n in names:
            c = batch.column(n)
            same = pa.compute.equal(c[1:], c[:-1])
            cut[1:] |= ~same.fill_null(True).to_numpy(zero_copy_only=False)
        if held and any(held[-1].column(n)[-1] != batch.column(n)[0] for n in names):
            yield pa.Table.from_batches(held)
            held = []
        ends = [*np.flatnonzero(cut).tolist(), batch.num_rows]
        for a, b in zip([0, *ends], ends):
            held.append(batch.slice(a, b - a))
            if b < batch.num_rows:
                yield pa.Table.from_batches(held)
                held = []
    if held:
        yield pa.Table.from_batches(held)


def pack(matrix: np.ndarray) -> bytes:
    return np.ascontiguousarray(matrix, "<f8").tobytes()


def unpack(data: bytes, width: int) -> np.ndarray:
    return np.frombuffer(data, "<f8").reshape(-1, width)


def packed(points: DataFrame, keys: list[str], values: list[str], most: int | None = None, idx: str = "idx") -> DataFrame:
    """A row per group of ``keys``: the keys, n, ``idxs`` (64-bit numbers, rising) and ``data`` (doubles, a line of ``values`` per point; NaN for null),
    low_x to high_z (the box of the first three values). Groups go whole to a task; more than ``most`` points go into several rows."""
    kinds = {f.name: f.dataType for f in points.schema.fields}
    out = T.StructType([T.StructField(k, kinds[k]) for k in keys] + [T.StructField("n", T.LongType()), T.StructField("idxs", T.BinaryType()), T.StructField("data", T.BinaryType())] + [T.StructField(f"{e}_{c}", T.DoubleType()) for e in ("low", "high") for c in AXES])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for own in runs(batches, *keys):
            for a in range(0, own.num_rows, most or own.num_rows):
                part = own.slice(a, most or own.num_rows)
                x = np.column_stack([part.column(v).to_numpy().astype(float) for v in values])
                at = part.column(idx).to_numpy().astype("<i8")
                ends = [pa.array([v]) for v in (*x[:, :3].min(axis=0), *x[:, :3].max(axis=0))]
                marks = [part.column(k).slice(0, 1).combine_chunks() for k in keys]
                yield pa.RecordBatch.from_arrays([*marks, pa.array([len(x)], pa.int64()), pa.array([at.tobytes()], pa.binary()), pa.array([pack(x)], pa.binary()), *ends], names=out.names)

    dealt = points.select(*keys, idx, *values).repartition(*keys).sortWithinPartitions(*keys, idx)
    return dealt.mapInArrow(run, out)


def box_gap(one: str, other: str):
    """Squared distance between two boxes, named by prefixes; 0 where they touch."""
    total = None
    for c in AXES:
        d = F.greatest(F.lit(0.0), F.col(f"{one}low_{c}") - F.col(f"{other}high_{c}"), F.col(f"{other}low_{c}") - F.col(f"{one}high_{c}"))
        total = d * d if total is None else total + d * d
    return total
