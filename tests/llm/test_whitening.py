"""Whitening against plain numpy and exact whole numbers, and its defined cases."""

import math
from collections import defaultdict
from fractions import Fraction

import numpy as np
import pytest

from dendra.llm import queries, whitening
from dendra.llm.common import table

R = np.random.default_rng(11)


def usable(vectors):
    return [v for v in vectors if v is not None and all(c is not None and math.isfinite(c) for c in v)]


def brute(vectors):
    """(n, sums, x, eigenvalues, components, trace) from exact means."""
    x = [[math.floor(1024 * c) + 100000 for c in v] for v in usable(vectors)]
    n, total = len(x), [sum(c) for c in zip(*x)]
    centred = np.array([[float(Fraction(n * c - s, n)) for c, s in zip(row, total)] for row in x])
    v = centred.T @ centred / n
    values, axes = np.linalg.eigh(v)
    return n, total, x, centred, values[::-1], axes[:, ::-1], np.trace(v)


def hold(rows, ids, vectors, components=8):
    """rows: id to a list of result rows, one per component."""
    n, total, x, centred, values, axes, trace = brute(vectors)
    kept = [i for i, v in zip(ids, vectors) if usable([v])]
    assert sorted(rows) == sorted(kept)
    for k in range(min(components, len(values))):
        want = centred @ axes[:, k] / math.sqrt(values[k])
        got = np.array([rows[i][k]["whitened"] for i in kept])
        sign = 1.0 if got @ want > 0 else -1.0
        assert np.allclose(got, sign * want, atol=1e-7)
        assert all(math.isclose(rows[i][k]["explained"], values[k] / trace, rel_tol=1e-9) for i in kept)
    for i, row in zip(kept, x):
        assert {r["n"] for r in rows[i]} == {n} and {int(r["deviation"]) for r in rows[i]} == {sum((n * c - s) ** 2 for c, s in zip(row, total))}


def test_query(spark, sf_dir):
    given = table(spark, sf_dir, "embeddings").collect()
    got = queries.whitened(spark, sf_dir).collect()
    rows = defaultdict(list)
    for r in sorted(got, key=lambda r: r["component"]):
        rows[r["vec_id"]].append(r)
    assert all([r["component"] for r in v] == list(range(1, 9)) for v in rows.values())
    assert len({r["identity_error"] for r in got}) == 1 and 0 <= got[0]["identity_error"] < 1e-9
    hold(rows, [r["vec_id"] for r in given], [r["embedding"] for r in given])


def whitened(spark, vectors, **more):
    df = spark.createDataFrame([(i, v, "x") for i, v in enumerate(vectors)], "vec_id long, embedding array<double>, n string").repartition(3)
    out = whitening.whiten(df, **more)
    assert out.columns == ["vec_id", "embedding", "n", "deviation", "whitened", "explained", "identity_error"]
    rows = {r["vec_id"]: [{"n": r["n"], "deviation": r["deviation"], "whitened": w, "explained": e, "error": r["identity_error"]} for w, e in zip(r["whitened"], r["explained"])] for r in out.collect()}
    return rows


@pytest.mark.parametrize("width", [1, 3, 12])
def test_equals_brute_force(spark, width):
    vectors = [(R.normal(size=width) * (1 + np.arange(width)) + 500).tolist() for _ in range(200)]
    vectors[3:6] = [None, [None] * width, [math.nan] * width]
    vectors[7][0] = math.inf
    vectors[9] = vectors[8]
    hold(whitened(spark, vectors), range(200), vectors)


def test_large_entries_stay_exact(spark):
    vectors = [[1e12 + 3 * i, -1e30 if i % 2 else 1e30, float(i)] for i in range(20)]
    rows = whitened(spark, vectors)
    n, total, x, *_ = brute(vectors)
    assert len(rows) == 20
    for i, r in rows.items():
        want = sum((n * c - s) ** 2 for c, s in zip(x[i], total))
        assert r[0]["deviation"] is None and want >= 10**38
    vectors = [[1e12 + 3 * i, float(i % 5)] for i in range(20)]
    n, total, x, *_ = brute(vectors)
    assert {i: int(r[0]["deviation"]) for i, r in whitened(spark, vectors).items()} == {i: sum((n * c - s) ** 2 for c, s in zip(x[i], total)) for i in range(20)}


def test_far_from_zero_loses_no_digits():
    exact = np.round(R.normal(size=(1000, 4)) * 1000).astype(np.int64)
    parts = [whitening.state_of(p + 10**12) for p in np.array_split(exact, [1, 7, 400])]
    chan = parts[0]
    for p in parts[1:]:
        chan = whitening.merged(chan, p)
    centred = exact - exact.mean(axis=0)
    assert chan.n == 1000 and list(chan.total) == [int(v) + 10**15 for v in exact.sum(axis=0)]
    assert np.allclose(chan.scatter, centred.T @ centred, rtol=1e-13, atol=1e-3)
    assert np.allclose(whitening.state_of(exact + 10**12).scatter, chan.scatter, rtol=1e-13, atol=1e-3)


def test_defined_cases(spark):
    assert whitened(spark, []) == {} and whitened(spark, [None, [math.nan]]) == {}
    one = whitened(spark, [[1.0, 2.0]])[0]  # no variance at all
    assert [(r["n"], int(r["deviation"]), r["whitened"], r["explained"], r["error"]) for r in one] == [(1, 0, None, None, None)] * 2
    flat = whitened(spark, [[float(i), 2.0] for i in range(4)])  # variance in one of two components
    assert [r["whitened"] is None for r in flat[0]] == [False, True] and flat[0][0]["error"] < 1e-9
    mixed = whitened(spark, [[float(i)] for i in range(3)] + [[float(i), i * i / 2] for i in range(3)] + [[]])
    assert [len(mixed[i]) for i in range(7)] == [1, 1, 1, 2, 2, 2, 0] and all(r["n"] == 3 for v in mixed.values() for r in v)
    twice = whitened(spark, [[0.0], [0.0], [3.0]])
    assert [int(twice[i][0]["deviation"]) for i in range(3)] == [(3 * 0 - 3072) ** 2] * 2 + [(9216 - 3072) ** 2]


def test_floats_and_extra_columns(spark):
    df = spark.createDataFrame([(None, [0.5, 1.5], 1), (None, [2.5, 1.0], 2), (2, [0.0, 0.25], 3)], "vec_id long, embedding array<float>, whitened int")
    out = whitening.whiten(df, components=1)
    got = out.collect()
    assert len(got) == 3 and {r["vec_id"] for r in got} == {None, 2} and all(len(r["whitened"]) == 1 for r in got)
