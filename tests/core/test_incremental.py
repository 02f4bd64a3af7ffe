"""A matrix that grows equals one computed at once."""

import math

import numpy as np
import pytest

from dendra.operators import nblast
from dendra.operators.incremental import MatrixState, added_pairs
from dendra.plans import ship

R = np.random.default_rng(71)


def cloud(spark, *names):
    rows = [(n, i, *map(float, p)) for n in names for i, p in enumerate(np.cumsum(R.normal(size=(20, 3)) * 900, axis=0))]
    return spark.createDataFrame(rows, "neuron_id string, idx int, x double, y double, z double")


def test_three_deliveries(spark, tmp_path):
    ship.to_workers(spark)
    parts = [cloud(spark, "a", "b"), cloud(spark, "c"), cloud(spark, "d", "e", "f")]
    whole = parts[0].unionByName(parts[1]).unionByName(parts[2])
    state = MatrixState(spark, str(tmp_path / "state"), 5)
    assert state.versions() == [] and state.scores().count() == 0
    (tmp_path / "inbox").mkdir()
    stream = spark.readStream.schema(whole.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "inbox"))
    for i, part in enumerate(parts[:2]):
        part.coalesce(1).write.mode("append").parquet(str(tmp_path / "inbox"))
        state.follow(stream, str(tmp_path / "checkpoint")).awaitTermination()
    state.add(parts[2], 2)
    state.add(parts[2], 2)  # again, as after a failure
    assert state.versions() == [0, 1, 2] and [added_pairs(state, v) for v in (0, 1, 2)] == [4, 5, 27]
    rows = lambda df: {(r["target_id"], r["query_id"]): r["raw"] for r in df.collect()}
    got, want = rows(state.scores()), rows(nblast.score_matrix(nblast.direction_vectors(whole, 5)))
    assert state.scores().count() == 36 == len(want) and set(got) == set(want)
    assert all(math.isclose(got[k], want[k], rel_tol=1e-9) for k in want)
    with pytest.raises(ValueError, match="is there already"):
        state.add(parts[0], 3)
    with pytest.raises(ValueError, match="comes before"):
        state.add(cloud(spark, "z"), 1)
