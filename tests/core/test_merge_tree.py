"""Merge trees against new components at every threshold."""

import numpy as np
import pytest

from dendra.operators import merge_tree
from dendra.operators import segmentation as seg

R = np.random.default_rng(41)


def graph(spark, nodes, edges, values):
    rows = {(min(a, b), max(a, b)): float(v) for (a, b), v in zip(R.integers(1, nodes, (edges, 2)).tolist(), R.integers(0, values, edges)) if a != b}
    return spark.createDataFrame([(a, b, v) for (a, b), v in rows.items()] or [(1, 1, 0.0)], "seg0 long, seg1 long, affinity double"), rows


def brute(rows, t):
    parent = {x: x for e in rows for x in e}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for (a, b), v in rows.items():
        if v >= t:
            a, b = sorted((root(a), root(b)))
            parent[b] = a
    sizes = {}
    for x in parent:
        sizes.setdefault(root(x), []).append(x)
    return {(x, r) for r, own in sizes.items() if len(own) > 1 for x in own}


@pytest.mark.parametrize("nodes, edges, values, task_edges", [(60, 90, 1000, 1 << 20), (60, 90, 5, 1 << 20), (80, 160, 50, 20), (40, 0, 5, 10)])
def test_every_threshold(spark, nodes, edges, values, task_edges):
    """Also with ties, and with more edges than a task takes."""
    df, rows = graph(spark, nodes, edges, values)
    tree = merge_tree.build(df.repartition(3), task_edges)
    thresholds = [values * i / 9 for i in range(10)]
    got = {}
    for r in merge_tree.segments(tree, thresholds).collect():
        got.setdefault(r["threshold"], set()).add((r["label"], r["root"]))
    assert all(got.get(t, set()) == brute(rows, t) for t in thresholds)


def test_forest(spark):
    """As heavy as one built edge by edge, with an edge per merge, whatever the tasks."""
    df, rows = graph(spark, 50, 120, 1000)
    want = sorted(v for v, keep in one_by_one(rows) if keep)
    for task_edges in (1 << 20, 15):
        got = merge_tree.spanning_forest(df.repartition(4), task_edges).collect()
        assert sorted(r["affinity"] for r in got) == want and all(rows[r["seg0"], r["seg1"]] == r["affinity"] for r in got)


def one_by_one(rows):
    parent = {x: x for e in rows for x in e}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for (a, b), v in sorted(rows.items(), key=lambda e: (-e[1], e[0])):
        a, b = root(a), root(b)
        parent[a] = b
        yield v, a != b


def test_long_chain_takes_few_levels(spark, tmp_path):
    """Affinities fall along the chain from its large end, so every label's link leads to the next: as long as chains get."""
    n = 100
    df = spark.createDataFrame([(i, i + 1, float(i)) for i in range(1, n)], "seg0 long, seg1 long, affinity double")
    merge_tree.save(merge_tree.build(df), str(tmp_path / "tree"))
    tree = merge_tree.load(spark, str(tmp_path / "tree"))
    assert tree.levels == 7
    got = {(r["label"], r["root"]) for r in merge_tree.segments(tree, [40.0]).collect()}
    assert got == {(i, 40) for i in range(40, n + 1)}


def test_equals_components(spark):
    df, _ = graph(spark, 60, 100, 100)
    tree = merge_tree.build(df)
    for t in (10.0, 55.0, 90.0):
        got = {(r["label"], r["root"]) for r in merge_tree.segments(tree, [t]).collect()}
        assert got == {(r["label"], r["root"]) for r in seg.segments(df, t).collect()}
