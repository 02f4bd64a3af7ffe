"""Neurons cut into segments give what whole neurons give."""

from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from dendra.operators import downsample as down

R = np.random.default_rng(51)


def trees(spark):
    rows = []
    for name, n, branch in (("long", 300, 0.03), ("bushy", 150, 0.5), ("line", 120, 0.0), ("dot", 1, 0.0)):
        x = np.cumsum(R.normal(size=(n, 4)), axis=0).round(6)
        for i in range(n):
            up = None if i == 0 or (name == "bushy" and i == 70) else (int(R.integers(0, i)) if R.random() < branch else i - 1)
            rows.append((name, i, i % 5, *map(float, x[i]), up))
    return spark.createDataFrame(rows, "neuron_id string, idx int, class int, x double, y double, z double, r double, parent int")


def listed(out):
    up = out.select("neuron_id", F.col("idx").alias("parent"), F.col("source_idx").alias("source_parent"))
    rows = out.join(up, ["neuron_id", "parent"], "left").collect()
    return Counter((r["neuron_id"], r["source_idx"], r["class"], *(round(r[c], 9) for c in "xyzr"), r["source_parent"]) for r in rows)


@pytest.mark.parametrize("duplicate", [False, True])
def test_segments_equal_whole_neurons(spark, duplicate):
    nodes = trees(spark).repartition(3)
    whole = down.downsample(nodes, 3.0, duplicate)
    cut = down.downsample(nodes, 3.0, duplicate, task_nodes=130)  # some neurons are large, others aren't
    assert listed(whole) == listed(cut)
    rows = cut.collect()
    for name in ("long", "bushy", "line", "dot"):
        own = sorted((r for r in rows if r["neuron_id"] == name), key=lambda r: r["idx"])
        assert [r["idx"] for r in own] == list(range(len(own)))
        assert all(r["parent"] is None or 0 <= r["parent"] < len(own) for r in own)
    assert [r["source_idx"] for r in sorted((r for r in rows if r["neuron_id"] == "long"), key=lambda r: r["idx"])] == sorted(r["source_idx"] for r in rows if r["neuron_id"] == "long")


def test_chains(spark):
    nodes = trees(spark)
    got = {(r["neuron_id"], r["idx"]): (r["seed"], r["hops"]) for r in down.chains(nodes).collect()}
    rows = {(r["neuron_id"], r["idx"]): r["parent"] for r in nodes.collect()}
    children = Counter((n, p) for (n, _), p in rows.items() if p is not None)
    for (n, i), (seed, hops) in got.items():
        at, steps = i, 0
        while rows[n, at] is not None and children[n, rows[n, at]] == 1:
            at, steps = rows[n, at], steps + 1
        assert (seed, hops) == (at, steps)
    assert len(got) == len(rows) and len({s for (n, _), (s, _) in got.items() if n == "long"}) > 5  # a neuron's segments are tasks of their own


def test_segments_are_folded_by_batches(spark, monkeypatch):
    """No group in pandas per segment; a segment may go on over several batches."""
    nodes, plans, store = trees(spark).repartition(3), {}, down.written

    def seen(df, label):
        plans[label] = df._jdf.queryExecution().toString()
        return store(df, label)

    want = listed(down.downsample(nodes, 3.0))
    monkeypatch.setattr(down, "written", seen)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        assert listed(down.downsample(nodes, 3.0, task_nodes=0)) == want
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert "MapInArrow" in plans["folded"] and "FlatMapGroupsInPandas" not in plans["folded"]
