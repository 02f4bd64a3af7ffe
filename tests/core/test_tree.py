"""Partition trees, the search inside a task, and tiles of pairs."""

import math
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from dendra.functions import linalg
from dendra.functions.score_table import ScoreTable
from dendra.operators import batches, nblast, search, spatial, tiles, tree

R = np.random.default_rng(21)


def frame(spark, **clouds):
    rows = [(n, i, *map(float, p)) for n, pts in clouds.items() for i, p in enumerate(pts)]
    return spark.createDataFrame(rows, "id string, idx int, x double, y double, z double")


def brute(q, x, k):
    d = search.squared(q, x)
    return [np.lexsort((np.arange(len(x)), row))[:k].tolist() for row in d]


@pytest.mark.parametrize("k", [1, 6, 900, 3000])
def test_search_in_a_task(k):
    for x in (R.normal(size=(1500, 3)), np.round(R.normal(size=(1500, 3)) * 2), np.zeros((700, 3)), R.normal(size=(5, 3))):
        q = np.concatenate([x[:40], R.normal(size=(20, 3)) * 5])
        at, d = search.Cloud(x).nearest(q, k)
        assert at.tolist() == brute(q, x, k) and np.array_equal(d, np.take_along_axis(search.squared(q, x), at, 1))
    assert search.Cloud(np.zeros((0, 3))).nearest(q, k)[0].shape == (len(q), 0)


def clustered(n):
    """Half of the points in a thousandth of the room, a tenth in one place."""
    x = np.concatenate([R.normal(size=(n // 2, 3)) * 0.001, R.random((n - n // 2, 3)) * 100])
    x[: n // 10] = 5.0
    return x[R.permutation(n)]


def test_leaves_hold_all_points_in_bounded_boxes(spark):
    clouds = {"a": clustered(6000), "b": R.normal(size=(30, 3)), "c": np.ones((500, 3))}
    points = frame(spark, **clouds)
    t = tree.build(points, leaf=64)
    got = {(r["id"], r["idx"]): (r["x"], r["y"], r["z"]) for r in tree.points_of(t.leaves).collect()}
    assert got == {(n, i): tuple(map(float, p)) for n, x in clouds.items() for i, p in enumerate(x)}
    leaves = t.leaves.collect()
    assert max(r["n"] for r in leaves) <= tree.SLACK * 64 and Counter(r["id"] for r in leaves)["b"] == 1
    for r in leaves:
        x = batches.unpack(r["data"], 3)
        assert [r[f"low_{c}"] for c in "xyz"] == x.min(axis=0).tolist() and [r[f"high_{c}"] for c in "xyz"] == x.max(axis=0).tolist()
    nodes = {(r["id"], r["node"]): r for r in t.nodes.collect()}
    assert {k for k, r in nodes.items() if r["is_leaf"]} == {(r["id"], r["node"]) for r in leaves}
    for (name, node), r in nodes.items():
        inside = [v for v in nodes.values() if v["id"] == name and v["parent"] == node]
        assert (node == 1) == (r["parent"] == 0) and (r["is_leaf"] or sum(v["n"] for v in inside) == r["n"])
        assert r["parent"] == 0 or all(r[f"low_{c}"] >= nodes[name, r["parent"]][f"low_{c}"] for c in "xyz")


def test_saved_tree_answers_alike(spark, tmp_path):
    x, q = clustered(3000), np.concatenate([R.random((50, 3)) * 120 - 10, np.full((3, 3), 5.0)])
    tree.save(tree.build(frame(spark, t=x), leaf=100), str(tmp_path / "tree"))
    back = tree.load(spark, str(tmp_path / "tree"))
    asked = tree.build(frame(spark, q=q), leaf=16)
    found = tree.nearest(asked.leaves, back, 7)
    best = spatial._best(found, ["q", "idx0", "target"], 7).groupBy("idx0").agg(F.sort_array(F.collect_list(F.struct("rank", "idx"))).alias("l")).collect()
    want = brute(q, x, 7)
    assert len(best) == len(q) and all([e["idx"] for e in r["l"]] == want[r["idx0"]] for r in best)


def test_leaves_of_a_large_clustered_target_are_even(spark):
    """A million points, a tenth of them in one place: no leaf holds twice the median, and each point has one."""
    n = 1_000_000
    u = [F.rand(seed) for seed in (1, 2, 3)]
    dense = F.col("id") % 2 == 0
    points = spark.range(0, n, 1, 8).select(
        F.lit("t").alias("id"), F.col("id").cast("int").alias("idx"),
        *[F.when(F.col("id") % 10 == 0, 5.0).when(dense, v * 0.001).otherwise(v * 100).alias(c) for c, v in zip("xyz", u)],
    )
    sizes = tree.leaf_of_points(points).groupBy("node").count()
    got = sizes.agg(F.sum("count").alias("all"), F.max("count").alias("most"), F.median("count").alias("middle"), F.count("*").alias("leaves")).first()
    assert got["all"] == n and got["most"] < 2 * got["middle"] and got["leaves"] < 4 * n / tree.LEAF


def test_packed_rows(spark):
    x = R.normal(size=(25, 3))
    rows = batches.packed(frame(spark, a=x, b=x[:3]), ["id"], ["x", "y", "z"], 10).collect()
    assert Counter((r["id"], r["n"]) for r in rows) == {("a", 10): 2, ("a", 5): 1, ("b", 3): 1}
    parts = sorted((np.frombuffer(r["idxs"], "<i8").tolist(), r["data"]) for r in rows if r["id"] == "a")
    assert [i for p, _ in parts for i in p] == list(range(25)) and np.array_equal(np.concatenate([batches.unpack(d, 3) for _, d in parts]), x)


@pytest.mark.parametrize("neurons", [8, 24])
def test_tiles_copy_a_point_once_per_group(spark, neurons):
    """Packed rows through the shuffle: each neuron once per group of the other side, whatever the number of neurons."""
    points = frame(spark, **{f"n{i}": R.normal(size=(10, 3)) for i in range(neurons)})
    own = tiles.pack_targets(points, ["x", "y", "z"])
    dealt = tiles.tiles(own, own, 3, 4)
    assert dealt.groupBy("side").agg(F.sum("n").alias("n")).orderBy("side").collect() == [(0, neurons * 10 * 4), (1, neurons * 10 * 3)]
    met = dealt.groupBy("i", "j").agg(F.collect_list(F.struct("side", "id")).alias("l")).collect()
    pairs = Counter((a["id"], b["id"]) for r in met for a in r["l"] for b in r["l"] if (a["side"], b["side"]) == (0, 1))
    assert len(pairs) == neurons**2 and set(pairs.values()) == {1}


def test_groups():
    assert tiles.groups(100, 5, 4) == 2 and tiles.groups(100, 1, 200) == 1 and tiles.groups(10 * tiles.GROUP_POINTS, 100, 4) == 10


def test_scores_of_large_and_small_targets_agree(spark):
    clouds = {n: np.cumsum(R.normal(size=(m, 3)) * 900, axis=0) for n, m in (("a", 150), ("b", 60), ("c", 20))}
    points = frame(spark, **clouds).withColumnRenamed("id", "neuron_id")
    whole = nblast.direction_vectors(points, 5)
    cut = nblast.direction_vectors(points, 5, leaf=16, task_points=50)
    key = lambda df: {(r["neuron_id"], r["idx"]): [round(r[c], 9) for c in ("vx", "vy", "vz")] for r in df.collect()}
    assert key(whole) == key(cut)
    for pairs, most in (("all", 100), ("other", 0)):
        scores = [{(r["target_id"], r["query_id"]): r["raw"] for r in nblast.raw_scores(whole, whole, pairs=pairs, leaf=16, task_points=n).collect()} for n in (1000, most)]
        assert len(scores[0]) == (9 if pairs == "all" else 6)
        assert all(set(s) == set(scores[0]) and all(math.isclose(s[p], scores[0][p], rel_tol=1e-9) for p in s) for s in scores)
    table = ScoreTable()
    d, a = R.random(500) * 60000, np.round(R.random(500), 2)
    assert table.scores(d, a).tolist() == [table[x, y] for x, y in zip(d, a)]


def test_directions_of_many_sets_at_once(spark):
    sets = [R.normal(size=(6, 3)) @ R.normal(size=(3, 3)) for _ in range(50)] + [np.ones((6, 3)), np.concatenate([np.eye(3), -np.eye(3)]), np.outer(np.arange(6), [1.0, 0, 0])]
    got = linalg.directions(np.array(sets))
    assert np.isnan(got[50]).all() and np.isnan(got[51]).all() and np.allclose(got[52], [1, 0, 0]) and np.isnan(linalg.directions(np.ones((2, 1, 3)))).all()
    for x, v in zip(sets[:50], got):
        want = np.linalg.eigh(np.cov(x.T))[1][:, -1]
        assert abs(abs(v @ want) - 1) < 1e-6 and v[np.abs(v).argmax()] > 0
    rows = spark.createDataFrame([(i, *map(float, p)) for i, x in enumerate(sets) for p in x], "g int, x double, y double, z double")
    for r in linalg.pca_first_component(rows, ["g"]).collect():
        assert (r["vx"] is None) == bool(np.isnan(got[r["g"], 0])) and (r["vx"] is None or np.allclose([r["vx"], r["vy"], r["vz"]], got[r["g"]], atol=1e-6))


def test_query_leaves_share_a_search(spark):
    """Rows of one target leaf are searched by one call, up to SPAN of them."""
    nodes = [3] * 5 + [4] * (tree.SPAN + 2) + [4]
    batch = pa.RecordBatch.from_arrays([pa.array(["a"] * (len(nodes) - 1) + ["b"]), pa.array(nodes)], names=["target", "node"])
    n = len(nodes)
    assert list(tree.spans(batch)) == [(0, 5), (5, 5 + tree.SPAN), (5 + tree.SPAN, n - 1), (n - 1, n)] and list(tree.spans(batch.slice(0, 1))) == [(0, 1)]
