"""Volumes as blocks: contacts, faces, relabelling, and back to voxels."""

from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from dendra.operators import blocks
from dendra.operators import segmentation as seg
from test_spatial_scores import brute_graph, volume

R = np.random.default_rng(31)


def edges(graph):
    return {(r["seg0"], r["seg1"]): (r["n"], round(r["aff_sum"], 6)) for r in graph.collect()}


@pytest.mark.parametrize("edge", [2, 3, 32])
def test_graph_by_blocks(spark, edge):
    labels, aff = R.integers(0, 6, (7, 4, 6)), R.random((3, 7, 4, 6)).round(3)
    labels[3] = 0
    v = volume(spark, labels, aff)
    want = {k: (n, round(s, 6)) for k, (n, s) in brute_graph(labels, aff).items()}
    assert edges(seg.region_graph(v, edge)) == want == edges(seg.region_graph(blocks.from_voxels(v, edge), edge))
    holes = v.where("(x + 2 * y + z) % 5 <> 0")  # voxels that aren't there
    gone = np.add.outer(np.add.outer(np.arange(7), 2 * np.arange(4)), np.arange(6)) % 5 == 0
    assert edges(seg.region_graph(holes, edge)) == {k: (n, round(s, 6)) for k, (n, s) in brute_graph(np.where(gone, 0, labels), aff).items()}


def test_voxels_come_back(spark):
    labels, aff = R.integers(0, 6, (5, 4, 6)), R.random((3, 5, 4, 6))
    v = volume(spark, labels, aff).where("x <> 2").withColumns({"x": F.col("x") - 4, "z": F.col("z") + 100})  # places below zero too
    back = blocks.to_voxels(blocks.from_voxels(v, 3), 3)
    assert Counter(map(tuple, back.collect())) == Counter(map(tuple, v.collect()))
    assert blocks.from_voxels(v.limit(0)).count() == 0 and seg.region_graph(v.limit(0)).count() == 0


def test_only_faces_are_shuffled(spark):
    """The graph of blocks: one shuffle of faces and one of summed edges; no sort or window over the volume."""
    b = spark.createDataFrame([], blocks.BLOCKS)
    plan = blocks.region_graph(b)._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and plan.count("Exchange hashpartitioning(axis") == 1 and plan.count("Exchange") == 2


def test_whole_affinities_stay_whole(spark):
    v = spark.createDataFrame([(0, 0, 0, 1, 1, 1, 1), (0, 0, 1, 2, 7, 1, 1)], "z int, y int, x int, label long, aff_x long, aff_y long, aff_z long")
    assert [tuple(r) for r in seg.region_graph(v).collect()] == [(1, 2, 1, 7)] and dict(seg.region_graph(v).dtypes)["aff_sum"] == "bigint"


def test_relabelled_blocks(spark):
    labels = R.integers(0, 9, (5, 4, 6))
    v = volume(spark, labels, np.zeros((3, 5, 4, 6)))
    roots = spark.createDataFrame([(3, 1), (7, 2), (1, 1), (40, 5)], "label long, root long")
    b = blocks.from_voxels(v, 3)
    got = {(r["z"], r["y"], r["x"]): r["label"] for r in blocks.to_voxels(blocks.relabel(b, roots), 3).collect()}
    assert got == {p: {3: 1, 7: 2}.get(int(labels[p]), int(labels[p])) for p in np.ndindex(labels.shape)}
