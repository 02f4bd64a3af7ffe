"""Pairs of neurons in tiles: neurons are dealt into groups, and a task has one group of targets and one of queries.

A point is copied once per group of the other side, not once per neuron of it. Targets of a tile are held, queries stream past them.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dendra.operators.batches import packed, runs, unpack
from dendra.operators.search import Cloud

#: Points of a group, and of a row of packed points.
GROUP_POINTS = 1 << 18
ROW_POINTS = 1 << 14
#: Rows that a task hands on at once.
OUT_ROWS = 1 << 16


def groups(points: int, neurons: int, partitions: int) -> int:
    """How many groups a side has: by its points, and enough for tiles to keep ``partitions`` tasks busy."""
    return max(1, -(-points // GROUP_POINTS), min(neurons, math.isqrt(max(0, partitions - 1)) + 1))


def tiles(targets: DataFrame, queries: DataFrame, of_targets: int, of_queries: int) -> DataFrame:
    """(i, j, side, id, and the packed columns): targets (side 0) in tiles (i, all j), queries (side 1) in tiles (all i, j). The sides hold rows of ``packed``, by ``id``."""
    group = lambda g: F.pmod(F.xxhash64("id"), F.lit(g)).cast("int")
    every = lambda g: F.explode(F.sequence(F.lit(0), F.lit(g - 1)))
    own = ["id", "n", "idxs", "data"]
    left = targets.select(group(of_targets).alias("i"), every(of_queries).alias("j"), F.lit(0).alias("side"), *own)
    right = queries.select(every(of_targets).alias("i"), group(of_queries).alias("j"), F.lit(1).alias("side"), *own)
    return left.unionByName(right).repartition("i", "j").sortWithinPartitions("i", "j", "side")


def met(dealt: DataFrame, work: Callable, out: str, width: int, same: bool) -> DataFrame:
    """``work`` (target id, target idxs, Cloud, target data, query id, query idxs, query data) over all pairs of a tile; it gives a batch of ``out``.
    same: also a neuron with itself."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        for own in runs(batches, "i", "j", "side", "id"):
            i, j, side, name = (own.column(c)[0].as_py() for c in ("i", "j", "side", "id"))
            if (i, j) != now:
                now, held = (i, j), []
            for idxs, data in zip(own.column("idxs"), own.column("data")):
                at, x = np.frombuffer(idxs.as_py(), "<i8"), unpack(data.as_py(), width)
                if side == 0:
                    held.append((name, at, Cloud(x[:, :3]), x))
                    continue
                for target in held:
                    if same or target[0] != name:
                        yield from work(*target, name, at, x)

    return dealt.mapInArrow(run, out)


def pack_targets(points: DataFrame, values: list[str]) -> DataFrame:
    return packed(points, ["id"], values)


def pack_queries(points: DataFrame, values: list[str]) -> DataFrame:
    """Large neurons go to several tasks, by ranges of their idx."""
    ranged = points.withColumn("part", F.floor(F.col("idx") / ROW_POINTS))
    return packed(ranged, ["id", "part"], values, ROW_POINTS)
