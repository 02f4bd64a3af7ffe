"""Skeleton operators and codecs: small trees by hand, plain Python versions, and round trips."""

import math
import random
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from dendra.operators import downsample as down
from dendra.operators import skeleton
from dendra.schemas import SKELETON, ensure_schema, reject_nan
from dendra.sources import precomputed, swc, tables

#   0 - 1 - 2 - 3      2 has the children 3 and 5; a second root 7 stands alone
#           `- 5 - 4 - 6
ROWS = [
    ("a", 0, 1, 0.0, 0.0, 0.0, 1.0, None), ("a", 1, 3, 3.0, 4.0, 0.0, 1.0, 0), ("a", 2, 3, 3.0, 4.0, 1.0, 2.0, 1), ("a", 3, 3, 3.0, 4.0, 3.0, 0.0, 2),
    ("a", 4, 3, 3.0, 7.0, 1.0, 1.0, 5), ("a", 5, 3, 3.0, 5.0, 1.0, 1.0, 2), ("a", 6, 6, 3.0, 8.0, 1.0, 4.0, 4), ("a", 7, 0, 9.0, 9.0, 9.0, 0.0, None),
    ("b", 0, 1, 1.0, 1.0, 1.0, 1.0, None),
]


@pytest.fixture(scope="module")
def tree(spark):
    return spark.createDataFrame(ROWS, SKELETON).cache()


def of(df, neuron="a", *cols):
    return {r["idx"]: tuple(r[c] for c in cols) if len(cols) > 1 else r[cols[0]] for r in df.where(F.col("neuron_id") == neuron).collect()}


def test_topology(tree):
    t = of(skeleton.topology(tree), "a", "first_child", "next_sibling")
    assert t == {0: (1, None), 1: (2, None), 2: (5, None), 3: (None, None), 4: (6, None), 5: (4, 3), 6: (None, None), 7: (None, None)}
    a = of(skeleton.attributes(tree), "a", "parent", "first_child", "next_sibling")
    assert a[0] == (-2, 1, -2) and a[5] == (2, 4, 3) and a[7] == (-2, -2, -2)


def test_kinds_counts_edges(tree):
    k = of(skeleton.node_kinds(tree), "a", "is_root", "is_terminal", "is_branching")
    assert {i for i, v in k.items() if v[0]} == {0, 7} and {i for i, v in k.items() if v[1]} == {3, 6, 7} and {i for i, v in k.items() if v[2]} == {2}
    assert set(of(skeleton.terminals(tree), "a", "idx")) == {3, 6, 7} and set(of(skeleton.roots(tree), "a", "idx")) == {0, 7}
    assert set(of(skeleton.branch_points(tree), "a", "idx")) == {2}
    assert {r[0]: r[1] for r in skeleton.point_count(tree).collect()} == {"a": 8, "b": 1}
    assert {r[0]: r[1] for r in skeleton.edge_count(tree).collect()} == {"a": 6, "b": 0}
    assert {(r["child"], r["parent"]) for r in skeleton.edges(tree).collect()} == {(1, 0), (2, 1), (3, 2), (4, 5), (5, 2), (6, 4)}
    assert of(skeleton.children(tree), "a", "children") == {0: [1], 1: [2], 2: [5, 3], 5: [4], 4: [6]}


def test_path_length_and_center(tree):
    assert {r[0]: r[1] for r in skeleton.path_length(tree).collect()} == {"a": 5 + 1 + 2 + 1 + 2 + 1, "b": 0}
    c = skeleton.center(tree, include_radius=True)
    for r in c.groupBy("neuron_id").agg(*[F.avg(x).alias(x) for x in "xyzr"]).collect():
        assert all(abs(r[x]) < 1e-9 for x in "xyzr")
    assert of(skeleton.center(tree), "a", "r") == of(tree, "a", "r")


def test_equality(tree):
    same = lambda other: {r["neuron_id"]: r["equal"] for r in skeleton.equal(tree, other).collect()}
    assert same(tree) == {"a": True, "b": True}
    assert same(tree.withColumn("x", F.col("x") + 0.0009)) == {"a": True, "b": True}
    assert same(tree.withColumn("x", F.col("x") + F.when(F.col("idx") == 3, 0.01).otherwise(0))) == {"a": False, "b": True}
    assert same(tree.where("idx <> 6")) == {"a": False, "b": True}
    assert same(tree.withColumn("parent", F.lit(0))) == {"a": False, "b": False}


def test_points_and_initial_nodes(tree, spark):
    moved = tree.withColumn("x", F.col("x") + 1)
    assert of(skeleton.set_points(tree, skeleton.points(moved)), "a", "x") == of(moved, "a", "x")
    assert skeleton.initialize(3, spark).where("x = 0 AND parent IS NULL").count() == 3
    assert len(skeleton.sample_for_plot(tree, 2)) == 3


def walk(xyzr, parent, step):
    """Downsampling, restated node by node on one list."""
    n = len(parent)
    kids = [[j for j in range(n) if parent[j] == i] for i in range(n)]
    at = [np.array(p, float) for p in xyzr]
    out, stack = [], [(i, None) for i in range(n) if parent[i] < 0]
    while stack:
        node, up = stack.pop()
        out.append((node, up))
        last = node
        while len(kids[node]) == 1:
            node = kids[node][-1]
            if np.linalg.norm(at[node][:3] - at[last][:3]) >= step:
                near = [at[parent[node]], at[node]] + ([at[kids[node][-1]]] if kids[node] else [])
                at[node] = sum(near) / len(near)
                out.append((node, last))
                last = node
        if last != node:
            out.append((node, last))
        own = kids[node]
        stack += [(k, node) for k in own[-1:] + own[:-1]]
    return out, at


def random_tree(n, seed):
    r = random.Random(seed)
    parent = [-1] + [r.choice([i - 1, i - 1, i - 1, r.randrange(i)]) if r.random() > 0.02 else -1 for i in range(1, n)]
    return [[r.uniform(0, 10) for _ in range(4)] for _ in range(n)], parent


@pytest.mark.parametrize("seed", range(6))
def test_downsample_equals_the_walk(seed):
    xyzr, parent = random_tree(120, seed)
    nodes, where, up = down.downsample_arrays(np.array(xyzr), np.array(parent), 7.0)
    want, at = walk(xyzr, parent, 7.0)
    assert nodes.tolist() == [n for n, _ in want]
    assert [nodes[u] if u >= 0 else None for u in up] == [u for _, u in want]
    assert np.allclose(where, [at[n] for n in nodes])
    # a tree: an edge per node that isn't a root, and as many roots as before
    assert len(set(nodes.tolist())) == len(nodes) and (up < 0).sum() == sum(p < 0 for p in parent)


def test_downsample_frame(tree):
    got = down.downsample(tree, 1.5)
    assert got.groupBy("neuron_id").count().count() == 2
    assert {r["source_idx"] for r in got.where("neuron_id = 'a'").collect()} == {0, 1, 2, 3, 5, 4, 6, 7}
    twice = down.downsample_arrays(np.array([r[3:7] for r in ROWS[:8]]), np.array([-1 if r[7] is None else r[7] for r in ROWS[:8]]), 1.5, duplicate_junctions=True)
    loops = [i for i, u in enumerate(twice[2]) if u == i]
    assert loops and all(twice[0].tolist().count(twice[0][i]) == 2 for i in loops)


SWC = "# head\n\n1 1 0 0 0 1 -1\n3 3 1 0 0 1 1\r\n7 3 2 0 0 1e-1 3\n 8 3 3 0 0 1 7\n9 3 4 0 0 1\n#2 1 0 0 0 1 -1\n"


def test_read_swc(spark, tmp_path):
    (tmp_path / "n1.swc").write_text(SWC)
    (tmp_path / "n 2.swc").write_text("2 1 5 5 5 1 1\n1 1 0 0 0 1 -1\n")
    got = swc.read_swc(spark, str(tmp_path / "*.swc"))
    assert of(got, "n1", "x", "parent") == {0: (0.0, None), 1: (1.0, 0), 2: (2.0, 1)}  # gaps in ids, an indented and a short line
    assert of(got, "n 2", "x", "parent") == {0: (0.0, None), 1: (5.0, 0)}
    (tmp_path / "n1.swc").write_text("\n".join(SWC.split("\n")[:6]) + " # tail\n")
    assert len(of(swc.read_swc(spark, str(tmp_path / "n1.swc"), strict=True), "n1", "x")) == 4
    (tmp_path / "n1.swc").write_text(SWC)
    with pytest.raises(Exception, match="another number of fields"):
        swc.read_swc(spark, str(tmp_path / "n1.swc"), strict=True).collect()
    with pytest.raises(Exception):
        swc.read_swc(spark, str(tmp_path / "none.swc")).collect()


def test_swc_round_trip(tree, spark, tmp_path):
    own = tree.withColumn("neuron_id", F.when(F.col("neuron_id") == "b", "b+1 #%").otherwise(F.col("neuron_id")))
    out = str(tmp_path / "out")
    swc.write_swc(own, out)
    texts = {r["neuron_id"]: r["swc"] for r in swc.swc_text(own).collect()}
    assert {p.name.removesuffix(".swc"): p.read_text() for p in (tmp_path / "out").glob("*.swc")} == texts
    assert texts["b+1 #%"] == "# id class x y z r parent\n1 1 1.000 1.000 1.000 1.000 -1\n"
    assert all(r["equal"] for r in skeleton.equal(own, swc.read_swc(spark, out)).collect())
    with pytest.raises(FileExistsError):
        swc.write_swc(own, out)
    swc.write_swc(tree.where("neuron_id = 'b'"), out, 1, "overwrite", header="two\nlines")
    assert {p.name: p.read_text() for p in (tmp_path / "out").glob("*.swc")} == {"b.swc": "# two\n# lines\n1 1 1.0 1.0 1.0 1.0 -1\n"}
    for bad in (lambda: swc.write_swc(tree, out, mode="append"), lambda: swc.lines(tree, -1)):
        with pytest.raises(ValueError):
            bad()


def test_sources_refuse_nan(spark, tmp_path):
    (tmp_path / "n.swc").write_text("1 1 0 NaN 0 1 -1\n")
    nan = [math.nan, 0.0, 0.0]
    swc_rows = spark.createDataFrame([("a", [1.0, 0.0, *nan, 1.0, -1.0][:7])], "neuron_id string, row array<double>")
    point_rows = spark.createDataFrame([("a", 0, nan, -1)], "neuron_id string, idx int, point array<double>, parent int")
    data = precomputed.encode_arrays(np.array([nan]), np.array([-1]), np.zeros(1), np.zeros(1, int))
    binary = precomputed.decode(spark.createDataFrame([("a", bytearray(data))], "neuron_id string, data binary"))
    for df in (swc.read_swc(spark, str(tmp_path / "n.swc")), tables.from_swc_rows(swc_rows), tables.from_point_rows(point_rows), binary):
        with pytest.raises(Exception, match="missing or NaN"):
            df.collect()
    with pytest.raises(Exception, match="a row needs 7 values"):
        tables.from_swc_rows(swc_rows.select("neuron_id", F.slice("row", 1, 6).alias("row"))).collect()


def test_plot_points(tree):
    assert skeleton.plot_points(tree, 3).count() == 4 and len(skeleton.sample_for_plot(tree, 2)) == 3


def test_precomputed_layout():
    xyz = np.array([[0, 0, 0], [1.5, 2, 3]])
    plain = precomputed.encode_arrays(xyz, np.array([-1, 0]), np.zeros(2), np.zeros(2, int))
    assert plain == struct.pack("<II6f2I", 2, 1, 0, 0, 0, 1.5, 2, 3, 1, 0)
    assert len(precomputed.encode_arrays(xyz, np.array([-1, 0]), np.ones(2), np.zeros(2, int))) == len(plain) + 8
    assert len(precomputed.encode_arrays(xyz, np.array([-1, 0]), np.zeros(2), np.ones(2, int))) == len(plain) + 10
    for bad in (b"", plain[:-1], plain + b"x", struct.pack("<II3f2I", 1, 1, 0, 0, 0, 5, 0)):
        with pytest.raises(ValueError):
            precomputed.decode_arrays(bad)


def test_precomputed_round_trip(tree, spark, tmp_path):
    encoded = precomputed.encode(tree)
    assert all(r["equal"] for r in skeleton.equal(tree, precomputed.decode(encoded)).collect())
    for r in encoded.collect():
        (tmp_path / r["neuron_id"]).write_bytes(bytes(r["data"]))
    assert all(r["equal"] for r in skeleton.equal(tree, precomputed.read_precomputed(spark, str(tmp_path))).collect())


def test_schema_checks(tree, spark):
    assert ensure_schema(tree.withColumn("more", F.lit(1)), SKELETON).columns == tree.columns
    with pytest.raises(ValueError):
        ensure_schema(tree.drop("r"), SKELETON)
    assert reject_nan(tree, "x", "y", "z").count() == len(ROWS)
    with pytest.raises(Exception, match="missing or NaN"):
        reject_nan(tree.withColumn("y", F.lit(math.nan)), "x", "y", "z").collect()
