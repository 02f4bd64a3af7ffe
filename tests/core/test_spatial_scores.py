"""Nearest neighbours, principal directions, similarity scores and segmentation: published values and brute force."""

import inspect
import math
import tracemalloc
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from dendra.functions import linalg
from dendra.functions.score_table import DISTANCES, ScoreTable, adp_bin, dist_bin
from dendra.operators import nblast, spatial, tiles
from dendra.operators import segmentation as seg
from dendra.operators.components import components
from dendra.plans import registry

R = np.random.default_rng(8)


def cloud(spark, **neurons):
    rows = [(n, i, *map(float, p)) for n, pts in neurons.items() for i, p in enumerate(pts)]
    return spark.createDataFrame(rows, "neuron_id string, idx int, x double, y double, z double")


def at(spark, *points):
    return spark.createDataFrame([("q", i, *map(float, p)) for i, p in enumerate(points)], "query_id string, query_idx int, qx double, qy double, qz double")


def listed(near):
    return {r["query_idx"]: r["neighbours"] for r in spatial.farthest_first(near).collect()}


def test_knn_known_answers(spark):
    grid = spatial.as_targets(cloud(spark, t=np.arange(24).reshape(8, 3)))
    q = at(spark, (6.1, 7.1, 8.1), (21.1, 23.1, 34.1))
    assert listed(spatial.knn(q, grid, 1)) == {0: [2], 1: [7]}
    assert listed(spatial.knn(q, grid, 2))[1] == [6, 7]  # the farthest first
    line = spatial.as_targets(cloud(spark, t=[(i, i, i) for i in range(100)]))
    got = listed(spatial.knn(at(spark, (10.1, 10.1, 10.1)), line, 20))[0]
    assert got[-1] == 10 and set(got) == set(range(1, 21)) | set() or len(got) == 20
    assert listed(spatial.knn(at(spark, (0, 0, 0)), spatial.as_targets(cloud(spark, t=[(1, 0, 0), (-1, 0, 0)])), 1)) == {0: [0]}  # a tie


@pytest.mark.parametrize("k, sizes", [(1, (1 << 14, 64)), (4, (1 << 14, 64)), (500, (1 << 14, 64)), (1, (0, 3)), (4, (50, 8)), (500, (0, 16))])
def test_knn_equals_brute_force(spark, k, sizes):
    t = {"a": R.normal(size=(60, 3)) * 10, "b": np.repeat(R.normal(size=(8, 3)), 5, axis=0)}  # repeated points tie
    q = np.concatenate([R.normal(size=(15, 3)) * 10, [[1e4, 0, 0]], t["b"][:2]])
    got = defaultdict(list)
    for r in spatial.knn(at(spark, *q), spatial.as_targets(cloud(spark, **t)), k, task_points=sizes[0], leaf=sizes[1]).collect():
        got[r["query_idx"], r["target_id"]].append((r["rank"], r["idx"]))
    assert len(got) == len(q) * 2
    for (i, name), own in got.items():
        d = ((t[name] - q[i]) ** 2).sum(axis=1)
        assert [x for _, x in sorted(own)] == sorted(range(len(d)), key=lambda j: (d[j], j))[:k] or np.allclose(np.sort(d[[x for _, x in sorted(own)]]), np.sort(d)[:k])
        assert sorted(x for x, _ in own) == list(range(1, min(k, len(d)) + 1))


def test_pairs(spark):
    p = cloud(spark, a=R.normal(size=(5, 3)), b=R.normal(size=(5, 3)))
    near = lambda which: {(r["query_id"], r["target_id"]) for r in spatial.knn(spatial.as_queries(p), spatial.as_targets(p), 1, which).collect()}
    assert near("same") == {("a", "a"), ("b", "b")} and near("other") == {("a", "b"), ("b", "a")} and len(near("all")) == 4
    with pytest.raises(ValueError):
        spatial.knn(spatial.as_queries(p), spatial.as_targets(p), 0)


def test_boxes(spark):
    p = cloud(spark, a=[(0, 0, 0), (1, 3, 3)], b=[(5, 5, 5)])
    box = {r["neuron_id"]: r for r in spatial.bounding_box(p, ["neuron_id"]).collect()}
    assert (box["a"]["max_y"], box["a"]["dim"], box["b"]["dim"]) == (3.0, 1, 0)
    far = p.crossJoin(spatial.bounding_box(p, ["neuron_id"]).where("neuron_id = 'a'").drop("neuron_id")).withColumn("d", spatial.box_distance())
    assert {r["d"] for r in far.collect()} == {0.0, 16.0 + 4.0 + 4.0}


def component(spark, points):
    (r,) = linalg.pca_first_component(cloud(spark, g=points), ["neuron_id"]).collect()
    return None if r["vx"] is None else np.array([r["vx"], r["vy"], r["vz"]])


# Points of a neuron in nanometres, and their first principal direction.
NEURON = [
    (261680, 162640, 790605), (261680, 162640, 790740), (261680, 162640, 790695), (261680, 162640, 791010), (261680, 162640, 790965),
    (261680, 162640, 790920), (261680, 162640, 790875), (261680, 162640, 791055), (261680, 162640, 790830), (261680, 162640, 790785),
    (261680, 162640, 790650), (261680, 162640, 790470), (261680, 162480, 790380), (261680, 161840, 789750), (261680, 162560, 790425),
    (261680, 162640, 790515), (261680, 161920, 789840), (261760, 162000, 789885), (261680, 161840, 789795), (261760, 162000, 789930),
]
NEURON_DIRECTION = (0.02229965, -0.57740044, -0.81615652)


def test_principal_directions(spark):
    assert np.allclose(component(spark, np.arange(12).reshape(4, 3)), 3**-0.5)
    assert abs(abs(component(spark, NEURON) @ NEURON_DIRECTION) - 1) < 1e-7
    for _ in range(4):
        x = R.normal(size=(30, 3)) @ R.normal(size=(3, 3)) + 1e5
        v = np.linalg.eigh(np.cov(x.T))[1][:, -1]
        got = component(spark, x)
        assert abs(abs(got @ v) - 1) < 1e-6 and got[np.abs(got).argmax()] > 0 and abs(got @ got - 1) < 1e-9
    assert component(spark, [(1, 2, 3)]) is None and component(spark, [(1, 2, 3)] * 4) is None
    assert component(spark, [(1, 0, 0), (-1, 0, 0), (0, 1, 0), (0, -1, 0), (0, 0, 1), (0, 0, -1)]) is None


def test_directions_in_any_dimension(spark):
    x = R.normal(size=(40, 5)) @ R.normal(size=(5, 5))
    df = spark.createDataFrame([("g", *map(float, r)) for r in x] + [("h", 1.0, 1.0, 1.0, 1.0, 1.0)], "g string, a double, b double, c double, d double, e double")
    got = {r["g"]: r["component"] for r in linalg.pca_first_component_any(df, ["g"], list("abcde")).collect()}
    assert abs(abs(np.dot(got["g"], np.linalg.eigh(np.cov(x.T))[1][:, -1])) - 1) < 1e-9 and got["h"] is None


# Fixed values: (distance, |dot|) and score.
LOOKUPS = [(0, 0, 9.500096818), (50000, 0.93, -10.1287588679926), (26000, 0.73, -2.70184701924541), (11000, 0.62, 0.28008292141423), (1800, 0.38, 8.23731427922735), (15976.5, 1, -0.892506), (16011.2, 1, -1.31413), (15000, 1, -0.892505829)]


def test_score_lookups(spark, tmp_path):
    table = ScoreTable()
    for d, a, s in LOOKUPS:
        assert math.isclose(table[d, a], s, abs_tol=1e-4)
    edges = [(d, a) for lo in DISTANCES for d in (lo, math.nextafter(lo, 0)) for a in (0.0, 0.1, 0.1001, 0.95, 1.0, 1.0001)] + [(math.inf, 1.0)]
    df = spark.createDataFrame([(float(d), float(a)) for d, a in edges + [x[:2] for x in LOOKUPS]], "d double, a double")
    for r in df.select("d", "a", table.score(F.col("d"), F.col("a")).alias("s"), dist_bin(F.col("d")).alias("i"), adp_bin(F.col("a")).alias("j")).collect():
        assert r["s"] == table[r["d"], r["a"]] == table.rows[r["i"]][r["j"]]
    frame = table.frame(spark)
    joined = df.join(frame, (F.col("d") >= F.col("dist_lo")) & (F.col("d") < F.col("dist_hi")) & (F.col("adp_bin") == adp_bin(F.col("a"))))
    assert all(r["score"] == table[r["d"], r["a"]] for r in joined.collect())
    (tmp_path / "t.csv").write_text("\n".join(",".join(str(2 * v) for v in r) for r in table.rows))
    assert ScoreTable.read(spark, str(tmp_path / "t.csv")).self_score == 2 * table.self_score
    with pytest.raises(ValueError):
        ScoreTable([[1.0]])


def test_line_and_shifted_line(spark):
    line = np.zeros((100, 3))
    line[:, 2] = np.arange(100)
    v = nblast.direction_vectors(cloud(spark, a=line), 2)
    assert {(r["vx"], r["vy"], r["vz"]) for r in v.collect()} == {(0.0, 0.0, 1.0)}
    both = nblast.direction_vectors(cloud(spark, a=line, b=line + [15000, 0, 0]), 10)
    scores = {(r["target_id"], r["query_id"]): r["raw"] for r in nblast.score_matrix(both).collect()}
    assert math.isclose(scores["a", "b"], -89.2506, rel_tol=1e-2) and math.isclose(scores["a", "a"], 100 * 11.38922975)
    assert nblast.neuron_count(nblast.self_scores(both, ScoreTable())) == 2


def test_matrix_and_normalisation(spark):
    clouds = {n: np.cumsum(R.normal(size=(m, 3)) * 900, axis=0) + c for n, m, c in (("a", 40, 0), ("b", 30, 2000), ("c", 25, 60000))}
    v = nblast.direction_vectors(cloud(spark, **clouds), 5).cache()
    vec = {n: np.array([r[2:] for r in sorted(v.where(F.col("neuron_id") == n).collect(), key=lambda r: r["idx"])], float) for n in clouds}
    table, raw = ScoreTable(), {}
    for t in clouds:
        for q in clouds:
            d = np.linalg.norm(clouds[q][:, None] - clouds[t][None], axis=2)
            near = d.argmin(axis=1)
            raw[t, q] = len(d) * table.self_score if t == q else sum(table[d[i, j], abs(vec[q][i, 3:] @ vec[t][j, 3:])] for i, j in enumerate(near))
    scores = nblast.score_matrix(v).cache()
    got = {(r["target_id"], r["query_id"]): r["raw"] for r in scores.collect()}
    assert set(got) == set(raw) and all(math.isclose(got[k], raw[k], rel_tol=1e-9) for k in raw)
    norm = nblast.normalized(scores, validate=True)
    n = {(r["target_id"], r["query_id"]): r["normalized"] for r in norm.collect()}
    assert all(math.isclose(n[t, q], raw[t, q] / raw[q, q]) for t, q in raw)
    m = {(r["target_id"], r["query_id"]): r["mean"] for r in nblast.mean_scores(norm, validate=True).collect()}
    assert all(m[t, q] == 1 if t == q else math.isclose(m[t, q], (n[t, q] + n[q, t]) / 2) for t, q in raw)
    assert nblast.to_matrix(scores, "raw").shape == (3, 3)
    with pytest.raises(Exception, match="above its column"):
        nblast.normalized(scores.withColumn("raw", F.when(F.col("target_id") != F.col("query_id"), 1e9).otherwise(F.col("raw"))), validate=True).collect()


# segmentation


def volume(spark, labels, aff):
    rows = [(z, y, x, int(labels[z, y, x]), *(float(aff[c, z, y, x]) for c in range(3))) for z, y, x in np.ndindex(labels.shape)]
    return spark.createDataFrame(rows, "z int, y int, x int, label long, aff_x double, aff_y double, aff_z double")


def brute_graph(labels, aff):
    g = defaultdict(lambda: [0, 0.0])
    for p in np.ndindex(labels.shape):
        for axis in range(3):
            q = tuple(v - (i == axis) for i, v in enumerate(p))
            if min(q) >= 0 and labels[p] > 0 and labels[q] > 0 and labels[p] != labels[q]:
                e = g[tuple(sorted((int(labels[p]), int(labels[q]))))]
                e[0] += 1
                e[1] += aff[(2 - axis, *p)]
    return g


def test_segmentation_of_a_random_volume(spark):
    labels, aff = R.integers(0, 9, (5, 4, 6)), R.random((3, 5, 4, 6)).round(3)
    v, want = volume(spark, labels, aff), brute_graph(labels, aff)
    graph = seg.region_graph(v).cache()
    assert {(r["seg0"], r["seg1"]): (r["n"], round(r["aff_sum"], 6)) for r in graph.collect()} == {k: (n, round(s, 6)) for k, (n, s) in want.items()}
    order = sorted(want.items(), key=lambda e: (-e[1][1], e[0]))
    cut = next((i for i, (_, (n, s)) in enumerate(order) if s / n < 0.45), len(order))
    dendro = seg.dendrogram(graph, 0.45).cache()
    assert {(r["seg0"], r["seg1"]) for r in dendro.collect()} == {k for k, _ in order[:cut]}
    assert [r["step"] for r in seg.with_steps(dendro).orderBy("step").collect()] == list(range(cut))
    parent = {int(x): int(x) for x in np.unique(labels)}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for (a, b), (n, s) in order[:cut]:
        if s / n >= 0.5:
            a, b = sorted((root(a), root(b)))
            parent[b] = a
    for r in seg.segment(v, dendro, 0.5).collect():
        assert r["label"] == root(int(labels[r["z"], r["y"], r["x"]]))
    (c,) = seg.merge_counts(v, dendro, 0.5).collect()
    assert (c["n_labels"], c["n_segments"]) == (len(parent), len({root(i) for i in parent}))


def test_small_volume_and_cut(spark):
    labels = np.array([[[1, 1], [2, 0]], [[1, 3], [2, 3]]])
    g = {(r["seg0"], r["seg1"]): r["n"] for r in seg.region_graph(volume(spark, labels, np.ones((3, 2, 2, 2)))).collect()}
    assert g == {(1, 2): 2, (1, 3): 2, (2, 3): 1}
    graph = spark.createDataFrame([(1, 2, 10, 4.0), (2, 3, 1, 0.9)], "seg0 long, seg1 long, n long, aff_sum double")
    assert seg.dendrogram(graph, 0.5).count() == 0  # the largest sum has a low mean: everything after it goes
    assert seg.dendrogram(graph, 0.4).count() == 2 and seg.segments(seg.dendrogram(graph, 0.5), 0.1).count() == 0
    near = defaultdict(list)
    for r in sorted(seg.neighbours(graph).collect()):
        near[r["seg"]] += r["neighbours"]
    assert near == {1: [2], 2: [1, 3], 3: [2]}


def test_gap_in_a_volume_is_no_contact(spark):
    v = spark.createDataFrame([(0, 0, 0, 1, 1.0, 1.0, 1.0), (0, 0, 2, 2, 1.0, 1.0, 1.0)], "z int, y int, x int, label long, aff_x double, aff_y double, aff_z double")
    assert seg.region_graph(v).count() == 0


def test_components_equal_union_find(spark):
    for n, m in ((200, 150), (50, 200), (10, 0)):
        edges = [(int(a), int(b)) for a, b in R.integers(0, n, (m, 2))] + [(i, i + 1) for i in range(1000, 1060)]
        parent = {}

        def root(i):
            while parent.setdefault(i, i) != i:
                i = parent[i]
            return i

        for a, b in edges:
            a, b = sorted((root(a), root(b)))
            parent[b] = a
        got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()}
        assert got == {i: root(i) for i in {x for e in edges if e[0] != e[1] for x in e}}


def plain_greedy(edges, least):
    """Merges one by one; each edge carries the smallest pair of first segments that it joins, for ties."""
    edges, out = {k: [*v, k] for k, v in edges.items()}, []
    while edges:
        (a, b), (n, s, pair) = min(edges.items(), key=lambda e: (-e[1][1] / e[1][0], e[1][2]))
        if s / n < least:
            break
        out.append((a, b))
        del edges[a, b]
        for k in [k for k in edges if b in k]:
            m, t, pair = edges.pop(k)
            c = k[0] if k[1] == b else k[1]
            e = edges.setdefault((min(a, c), max(a, c)), [0, 0.0, pair])
            edges[min(a, c), max(a, c)] = [e[0] + m, e[1] + t, min(e[2], pair)]
    return out


def random_graph(nodes, edges, worst):
    out = {}
    for a, b in R.integers(0, nodes, (edges, 2)).tolist():
        if a != b:
            out[min(a, b), max(a, b)] = (int(R.integers(1, 9)), float(R.integers(1, worst)))
    return out


def test_greedy_merges():
    for worst in (200, 200, 200, 4) * 10:  # few values make ties
        edges = random_graph(12, 25, worst)
        assert [m[:2] for m in seg.greedy_merges({k: (*v, k) for k, v in edges.items()}, 0.5)] == plain_greedy(edges, 0.5)


def test_parts_merge_what_the_whole_merges():
    """Any segments may be foreign; what merges is among the whole's merges, and an own chain of rising means merges at once."""
    for worst in (200, 200, 4) * 10:
        edges = random_graph(14, 30, worst)
        whole = [m[:2] for m in seg.greedy_merges({k: (*v, k) for k, v in edges.items()}, 0.5)]
        foreign = set(R.integers(0, 14, 4).tolist())
        got = [m[:2] for m in seg.greedy_merges({k: (*v, k) for k, v in edges.items()}, 0.5, foreign)]
        assert set(got) <= set(whole) and not {x for m in got for x in m} & foreign
    chain = {(i, i + 1): (1, 10.0 + i, (i, i + 1)) for i in range(50)}
    assert len(seg.greedy_merges(chain, 0.5, {0})) == 49 and len(seg.greedy_merges(chain, 0.5, {50})) == 0


@pytest.mark.parametrize("task_edges, worst", [(0, 4), (12, 200), (1000, 4)])
def test_greedy_dendrogram(spark, task_edges, worst):
    frame = lambda edges: spark.createDataFrame([(*k, *v) for k, v in edges.items()], "seg0 long, seg1 long, n long, aff_sum double")
    few = frame({(1, 2): (2, 1.8), (2, 3): (1, 0.8), (1, 3): (4, 0.4), (7, 8): (1, 0.9)})
    got = {(r["root"], r["step"]): (r["seg0"], r["seg1"], round(r["affinity"], 6)) for r in seg.greedy_dendrogram(few, 0.2, task_edges).collect()}
    assert got == {(1, 0): (1, 2, 0.9), (1, 1): (1, 3, 0.24), (7, 0): (7, 8, 0.9)}
    assert seg.greedy_dendrogram(few, 5.0, task_edges).count() == 0 and seg.greedy_dendrogram(few.limit(0), 0.2, task_edges).count() == 0
    edges = random_graph(30, 60, worst)
    rows = seg.greedy_dendrogram(frame(edges), 0.5, task_edges).collect()
    for root in {r["root"] for r in rows}:
        own = sorted((r["step"], r["seg0"], r["seg1"]) for r in rows if r["root"] == root)
        part = {r["seg0"] for r in rows if r["root"] == root} | {r["seg1"] for r in rows if r["root"] == root}
        want = [m for m in plain_greedy(edges, 0.5) if m[0] in part]
        assert [m[0] for m in own] == list(range(len(own))) and [m[1:] for m in own] == want
    assert len(rows) == len(plain_greedy(edges, 0.5))


@pytest.mark.parametrize("pairs, most", [("same", 70), ("other", 0)])
def test_searches_within_tasks_and_by_tree_agree(spark, monkeypatch, pairs, most):
    monkeypatch.setattr(tiles, "GROUP_POINTS", 50)
    monkeypatch.setattr(tiles, "ROW_POINTS", 20)
    monkeypatch.setattr(tiles, "OUT_ROWS", 30)
    points = cloud(spark, a=R.normal(size=(60, 3)), b=np.round(R.normal(size=(90, 3)) * 2), c=np.zeros((7, 3)))  # b and c hold ties
    q, t = spatial.as_queries(points), spatial.as_targets(points)
    rows = lambda n: sorted((r["query_id"], r["query_idx"], r["target_id"], r["rank"], r["idx"], r["d2"]) for r in spatial.knn(q, t, 4, pairs, leaf=10, task_points=n).collect())
    whole = rows(1000)
    assert whole == rows(most) and len({r[2] for r in whole}) == 3


def test_memory_of_a_task_of_greedy_merges():
    """Twice the edges that a task is given by default, at what an edge takes, stay far below an executor's Python."""
    edges = {(i, i + j): (1, 500.0 + (i * 7 + j * 13) % 97, (i, i + j)) for i in range(4000) for j in (1, 2, 5)}
    tracemalloc.start()
    seg.greedy_merges(edges, 630.0)
    each = tracemalloc.get_traced_memory()[1] / len(edges)
    tracemalloc.stop()
    assert each * 2 * inspect.signature(seg.greedy_dendrogram).parameters["task_edges"].default < 400e6


def test_steps_count_over_ranges(spark):
    edges = spark.createDataFrame([(int(a), int(b), 1, float(c)) for a, b, c in zip(range(300), range(300, 600), R.integers(0, 20, 300))], "seg0 long, seg1 long, n long, aff_sum double")
    got = seg.with_steps(edges).collect()
    assert [r["step"] for r in sorted(got, key=lambda r: (-r["aff_sum"], r["seg0"], r["seg1"]))] == list(range(300))


def test_components_over_several_rounds(spark):
    """Too many edges for one task."""
    edges = [(i, i + 1) for i in range(0, 90)] + [(200, i) for i in range(201, 240)] + [(5, 5)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long").repartition(3), "a", "b", task_edges=4).collect()}
    assert got == {i: 0 for i in range(91)} | {i: 200 for i in range(200, 240)}


def test_neighbours_of_a_hub_spread(spark):
    """A hub's rows are short, sorted, built by several tasks, and hold every neighbour once."""
    n = 200_000
    graph = spark.range(1, n).select(F.lit(0).cast("long").alias("seg0"), F.col("id").alias("seg1")).unionByName(spark.createDataFrame([(1, 5), (1, 3)], "seg0 long, seg1 long"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # few bytes would be put together again
    try:
        rows = seg.neighbours(graph, 1000).withColumn("part", F.spark_partition_id()).where("seg = 0").collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert sorted(x for r in rows for x in r["neighbours"]) == list(range(1, n)) and len({r["part"] for r in rows}) >= 2
    assert all(r["first"] == r["neighbours"][0] and len(r["neighbours"]) <= 1000 and r["neighbours"] == sorted(r["neighbours"]) for r in rows)
    assert [x for r in seg.neighbours(graph).where("seg = 1").orderBy("first").collect() for x in r["neighbours"]] == [0, 3, 5]


def test_greedy_query(spark, sf_dir):
    """The registered query against merging one by one over the given table."""
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "event_type", "value").collect()
    cells = {}
    for i, kind, value in rows:
        z, y, x = i // 400, i // 20 % 20, i % 20
        label = 0 if kind == "error" and value < 5 else 1 + z // 5 * 16 + y // 5 * 4 + x // 5
        cells[z, y, x] = (label, min(1000, math.floor(20 * value)))
    edges = defaultdict(lambda: (0, 0.0))
    for (z, y, x), (label, aff) in cells.items():
        for below in ((z - 1, y, x), (z, y - 1, x), (z, y, x - 1)):
            other = cells.get(below, (0,))[0]
            if label and other and label != other:
                k = (min(label, other), max(label, other))
                edges[k] = (edges[k][0] + 1, edges[k][1] + aff)
    got = sorted((r["root"], r["step"], r["seg0"], r["seg1"]) for r in registry.g3_greedy(spark, sf_dir).collect())
    merges = plain_greedy(edges, registry.MIN_MEAN)
    assert len({r[0] for r in got}) == 1 and [r[2:] for r in got] == merges
