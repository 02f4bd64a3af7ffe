"""Labelled volumes as blocks of arrays, and what touches what in them.

A block is one row: its place in a grid of cubes of EDGE voxels, and the labels and affinities inside as arrays. Contacts inside a block are
found by comparing arrays, and summed there. Between blocks only faces go through the shuffle: a block gives its last layer along each axis to the block
behind, which compares it with its own first layer. So a volume is never sorted, and what is shuffled is its faces and the summed edges.

A voxel that isn't there counts as background, which separates.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dendra.operators.batches import runs
from dendra.schemas import BLOCKS

#: Voxels along the side of a block.
EDGE = 32
PLACE = ("bz", "by", "bx")
AFFINITIES = ("aff_z", "aff_y", "aff_x")
EDGES = "seg0 long, seg1 long, n long, aff_sum double"


def block_row(place: tuple[int, int, int], labels: np.ndarray, affinities: np.ndarray, present: np.ndarray) -> pa.RecordBatch:
    """One row of BLOCKS. affinities: (z, y, x channels) by labels' shape; present: which voxels there are."""
    shape = labels.shape
    data = [labels.astype("<i8").tobytes(), np.ascontiguousarray(affinities, "<f8").tobytes(), np.packbits(present).tobytes()]
    names = [*PLACE, "nz", "ny", "nx", "labels", "affinities", "present"]
    return pa.RecordBatch.from_arrays([*[pa.array([v], pa.int64()) for v in place], *[pa.array([v], pa.int32()) for v in shape], *[pa.array([d], pa.binary()) for d in data]], names=names)


def from_voxels(voxels: DataFrame, edge: int = EDGE) -> DataFrame:
    """BLOCKS of a voxel frame (z, y, x, label, aff_x, aff_y, aff_z). One shuffle, by block."""
    placed = voxels.select(*[F.floor(F.col(c) / edge).cast("long").alias("b" + c) for c in "zyx"], *[F.pmod(c, F.lit(edge)).cast("int").alias(c) for c in "zyx"], F.col("label").cast("long").alias("label"), *[F.col(a).cast("double").alias(a) for a in AFFINITIES])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for own in runs(batches, *PLACE):
            at = tuple(own.column(c).to_numpy() for c in "zyx")
            shape = tuple(int(c.max()) + 1 for c in at)
            labels, affinities, present = np.zeros(shape, np.int64), np.zeros((3, *shape)), np.zeros(shape, bool)
            labels[at], present[at] = own.column("label").to_numpy(), True
            for i, a in enumerate(AFFINITIES):
                affinities[i][at] = own.column(a).to_numpy()
            yield block_row(tuple(own.column(c)[0].as_py() for c in PLACE), labels, affinities, present)

    return placed.repartition(*PLACE).sortWithinPartitions(*PLACE).mapInArrow(run, BLOCKS)


def to_voxels(blocks: DataFrame, edge: int = EDGE) -> DataFrame:
    """The voxels that there are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in unpacked(batches):
            at = np.nonzero(block["present"])
            corner = [block[b] * edge for b in PLACE]
            place = [pa.array((a + c).astype(np.int32)) for a, c in zip(at, corner)]
            yield pa.RecordBatch.from_arrays([*place, pa.array(block["labels"][at]), *[pa.array(block["affinities"][i][at]) for i in (2, 1, 0)]], names=["z", "y", "x", "label", "aff_x", "aff_y", "aff_z"])

    return blocks.mapInArrow(run, "z int, y int, x int, label long, aff_x double, aff_y double, aff_z double")


def unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for i in range(batch.num_rows):
            row = {n: batch.column(n)[i].as_py() for n in batch.schema.names}
            shape = (row["nz"], row["ny"], row["nx"])
            count = shape[0] * shape[1] * shape[2]
            row["labels"] = np.frombuffer(row["labels"], "<i8").reshape(shape)
            row["affinities"] = np.frombuffer(row["affinities"], "<f8").reshape(3, *shape)
            row["present"] = np.unpackbits(np.frombuffer(row["present"], np.uint8), count=count).reshape(shape).astype(bool)
            yield row


def summed(pairs: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> tuple[np.ndarray, ...]:
    """(seg0, seg1, n, sum) of touching labels (here, below, affinity); background and equal labels don't touch."""
    here, below, affinity = (np.concatenate([np.ravel(p[i]) for p in pairs]) for i in range(3))
    real = (here > 0) & (below > 0) & (here != below)
    both = np.column_stack([np.minimum(here[real], below[real]), np.maximum(here[real], below[real])])
    each, of = np.unique(both, axis=0, return_inverse=True)
    of = of.ravel()
    return each[:, 0], each[:, 1], np.bincount(of, minlength=len(each)), np.bincount(of, affinity[real], minlength=len(each))


def inside(block: dict) -> tuple[np.ndarray, ...]:
    """Contacts within a block."""
    labels, out = block["labels"], []
    for axis in range(3):
        here, below = (np.moveaxis(labels, axis, 0)[s] for s in (slice(1, None), slice(None, -1)))
        out.append((here, below, np.moveaxis(block["affinities"][axis], axis, 0)[1:]))
    return summed(out)


FACES = "axis int, bz long, by long, bx long, first boolean, rows int, columns int, labels binary, affinities binary"


def faces(block: dict, edge: int) -> Iterator[tuple]:
    """Rows of FACES: the first layer along each axis under the block's own place, with affinities; the last under the place behind."""
    place = [block[b] for b in PLACE]
    for axis in range(3):
        layers = np.moveaxis(block["labels"], axis, 0)
        if (layers[0] > 0).any():
            yield (axis, *place, True, *layers[0].shape, layers[0].tobytes(), np.moveaxis(block["affinities"][axis], axis, 0)[0].tobytes())
        if len(layers) == edge and (layers[-1] > 0).any():
            behind = [p + (i == axis) for i, p in enumerate(place)]
            yield (axis, *behind, False, *layers[-1].shape, np.ascontiguousarray(layers[-1]).tobytes(), b"")


def region_graph(blocks: DataFrame, edge: int = EDGE) -> DataFrame:
    """(seg0, seg1, n, aff_sum): contact count and affinity sum of touching segments."""

    def edges(found: tuple[np.ndarray, ...]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c) for c in (*found[:2], found[2].astype(np.int64), found[3].astype(float))], names=["seg0", "seg1", "n", "aff_sum"])

    def within(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in unpacked(batches):
            yield edges(inside(block))

    def given(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split(" ")[0] for c in FACES.split(", ")]
        kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.int32(), pa.int32(), pa.binary(), pa.binary()]
        for block in unpacked(batches):
            rows = list(faces(block, edge))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)

    def between(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for own in runs(batches, "axis", *PLACE):
            if own.num_rows == 2:
                below, here = (np.frombuffer(own.column("labels")[i].as_py(), "<i8").reshape(own.column("rows")[i].as_py(), -1) for i in (0, 1))
                affinity = np.frombuffer(own.column("affinities")[1].as_py(), "<f8").reshape(here.shape)
                both = tuple(slice(0, min(a, b)) for a, b in zip(here.shape, below.shape))
                yield edges(summed([(here[both], below[both], affinity[both])]))

    met = blocks.mapInArrow(given, FACES).repartition("axis", *PLACE).sortWithinPartitions("axis", *PLACE, "first")
    own = blocks.mapInArrow(within, EDGES).unionByName(met.mapInArrow(between, EDGES))
    return own.groupBy("seg0", "seg1").agg(F.sum("n").alias("n"), F.sum("aff_sum").alias("aff_sum"))


def relabel(blocks: DataFrame, roots: DataFrame) -> DataFrame:
    """``blocks`` with each label replaced by its root, if ``roots`` (label, root) has one. A block asks for the labels that it holds."""

    def held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in unpacked(batches):
            own = np.unique(block["labels"])
            yield pa.RecordBatch.from_arrays([*[pa.array(np.full(len(own), block[b])) for b in PLACE], pa.array(own)], names=[*PLACE, "label"])

    asked = blocks.mapInArrow(held, "bz long, by long, bx long, label long").join(roots.select("label", "root"), "label").where("label <> root")
    lists = asked.groupBy(*PLACE).agg(F.sort_array(F.collect_list(F.struct("label", "root"))).alias("to"))  # as many as a block has labels

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index("labels")
            out = []
            for data, to in zip(batch.column("labels"), batch.column("to")):
                data, to = data.as_py(), to.as_py()
                if to:
                    labels, old, new = np.frombuffer(data, "<i8"), np.array([t["label"] for t in to]), np.array([t["root"] for t in to])
                    i = np.minimum(np.searchsorted(old, labels), len(old) - 1)
                    data = np.where(old[i] == labels, new[i], labels).tobytes()
                out.append(data)
            columns = [pa.array(out, pa.binary()) if i == at else c for i, c in enumerate(batch.columns)][: len(batch.columns) - 1]
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names[:-1])

    return blocks.join(lists, list(PLACE), "left").select(*blocks.columns, "to").mapInArrow(run, BLOCKS)
