"""The handles, the array sources and the driver entry."""

import pickle

import numpy as np
import pytest

import __spark_entry__
from dendra import api
from dendra.sources import tables, volumes

POINTS = np.array([[0, 0, 0, 1], [3, 4, 0, 1], [3, 4, 2, 2], [3, 5, 2, 0]], float)
PARENTS = np.array([-2, 0, 1, 1])


@pytest.fixture(scope="module")
def tree(spark):
    return api.Skeleton.from_points_and_parents(POINTS, PARENTS)


def test_skeleton_arrays(tree):
    assert len(tree) == 4 and np.array_equal(tree.points, POINTS) and np.array_equal(tree.parents, PARENTS)
    assert tree.attributes.tolist() == [[0, -2, 1, -2], [0, 0, 3, -2], [0, 1, -2, -2], [0, 1, -2, 2]]
    assert tree.edges.tolist() == [[1, 0], [2, 1], [3, 1]] and np.isclose(tree.path_length, 5 + 2 + 5**0.5)


def test_skeleton_round_trips(tree, tmp_path):
    assert api.Skeleton.from_precomputed(tree.to_precomputed()) == tree
    tree.to_swc(str(tmp_path / "t.swc"))
    back = api.Skeleton.from_swc(str(tmp_path / "t.swc"))
    assert (tmp_path / "t.swc").read_text() == tree.to_swc_str()
    assert back == tree and not back == api.Skeleton.from_points_and_parents(POINTS + 1, PARENTS)
    swc = [[i + 1, 0, *p, u + 1 if u >= 0 else -1] for i, (p, u) in enumerate(zip(POINTS, PARENTS))]
    assert api.Skeleton.from_swc_array(np.array(swc)[::-1]) == tree
    assert api.Skeleton.from_points_and_attributes(tree.points, tree.attributes) == tree
    for bad in (lambda: tables.from_swc_array(tree.frame.sparkSession, np.zeros((2, 6))), lambda: api.Skeleton.from_points_and_parents(POINTS, PARENTS[:2]), lambda: api.Skeleton.from_points_and_parents(POINTS, [9] * 4)):
        with pytest.raises(ValueError):
            bad()


def test_pickles(tree):
    assert pickle.loads(pickle.dumps(tree)) == tree
    cloud = api.VectorCloud(np.cumsum(np.ones((12, 3)), axis=0), k=4)
    assert np.array_equal(pickle.loads(pickle.dumps(cloud)).vectors, cloud.vectors)
    trees = api.KDTree(np.arange(24).reshape(8, 3), leaf_size=3)
    back = pickle.loads(pickle.dumps(trees))
    assert back.leaf_size == 3 and back.knn((6.1, 7.1, 8.1), 1).tolist() == [2]


def test_skeleton_changes(spark):
    t = api.Skeleton.from_points_and_parents(POINTS, PARENTS)
    t.points = t.points * 2
    assert np.array_equal(t.points, POINTS * 2)
    t.translate_centroid_to_origin()
    assert np.allclose(t.points.mean(axis=0), 0, atol=1e-6)
    t.downsample(100.0)
    assert len(t) == 4  # root, branch point and two tips


def test_saved_frames(tree, spark, tmp_path):
    tables.save(tree.frame, str(tmp_path / "s"))
    assert api.Skeleton(tables.load_skeletons(spark, str(tmp_path / "s"))) == tree
    cloud = api.VectorCloud(np.cumsum(np.ones((12, 3)), axis=0), k=4)
    tables.save(cloud.frame, str(tmp_path / "v"))
    assert tables.load_vectors(spark, str(tmp_path / "v")).count() == 12
    assert {n: p.shape for n, (p, _) in tables.to_arrays(tree.frame).items()} == {"0": (4, 4)}


def test_trees_and_clouds(spark):
    t = api.KDTree(np.arange(24).reshape(8, 3))
    assert t.knn((21.1, 23.1, 34.1), 2).tolist() == [6, 7] and len(t.knn((0, 0, 0), 99)) == 8
    line = np.zeros((50, 3))
    line[:, 2] = np.arange(50)
    table, a, b = api.ScoreTable(), api.VectorCloud(line, 10, 5), api.VectorCloud(line + [15000, 0, 0], 10, 5)
    assert np.allclose(a.vectors, [0, 0, 1]) and len(a) == 50 and np.isclose(a.query_by_self(table), 50 * table.self_score)
    assert np.isclose(a.query_by(b, table), 50 * -0.892506, rtol=1e-2)
    m = api.ScoreMatrix([a, b], table)
    assert np.allclose(api.normalized_matrix(m.raw_score_matrix), m.normalized_score_matrix)
    assert np.allclose(api.mean_matrix(m.normalized_score_matrix), m.mean_score_matrix) and np.allclose(np.diag(m.mean_score_matrix), 1)
    with pytest.raises(ValueError):
        tables.points_from_array(spark, np.array([[np.nan, 0, 0]]))


def test_components_of_arrays(spark):
    assert np.allclose(api.pca_first_component(np.arange(12).reshape(4, 3)), 3**-0.5)
    assert np.allclose(api.pca_first_component(np.array([[0, 0], [1, 1], [2, 2]])), 2**-0.5)


def test_dendrogram(spark):
    labels = np.array([[[1, 1, 2, 2], [3, 3, 2, 0]]], np.uint32)
    d = api.SupervoxelDendrogram(np.full((3, *labels.shape), 0.8), labels, 0.1)
    assert d.segment(0.5).tolist() == [[[1, 1, 1, 1], [1, 1, 1, 0]]] and np.array_equal(d.segment(0.9), labels)
    assert [x.tolist() for x in d.segment_all([0.5, 0.9])] == [d.segment(0.5).tolist(), labels.tolist()]
    with pytest.raises(ValueError):
        volumes.voxels_from_arrays(spark, labels, np.ones((2, *labels.shape)))


def test_entry(spark):
    rows = __spark_entry__.entry(spark).collect()
    assert len(rows) == 100 and all(r["normalized"] == 1 for r in rows if r["target_id"] == r["query_id"])
    names = __spark_entry__.queries()
    assert set(__spark_entry__.oracle_sql()) <= set(names) and len(names) >= 31
