"""Sinks that commit once, streams of arriving files, and volumes in chunks."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from dendra.operators import blocks
from dendra.operators import segmentation as seg
from dendra.plans import ship
from dendra.sources import arrivals, chunks, files, swc
from test_spatial_scores import volume

R = np.random.default_rng(61)


@pytest.fixture(autouse=True)
def workers(spark):
    ship.to_workers(spark)


def skeleton(spark, *names):
    rows = [(n, i, 3, float(i), float(j), 0.5, 1.0, i - 1 if i else None) for j, n in enumerate(names) for i in range(5)]
    return spark.createDataFrame(rows, "neuron_id string, idx int, class int, x double, y double, z double, r double, parent int")


def test_files_are_named_by_tasks(spark, tmp_path):
    own = skeleton(spark, *[f"n{i}" for i in range(20)]).repartition(5)
    swc.write_swc(own, str(tmp_path / "out"))
    assert sorted(p.name for p in (tmp_path / "out").iterdir()) == sorted(f"n{i}.swc" for i in range(20))
    assert sorted(map(tuple, swc.read_swc(spark, str(tmp_path / "out")).collect()), key=str) == sorted(map(tuple, own.collect()), key=str)
    assert [p.name for p in tmp_path.iterdir()] == ["out"]  # no job's folder is left
    with pytest.raises(FileExistsError):
        swc.write_swc(own, str(tmp_path / "out"))
    swc.write_swc(own.where("neuron_id = 'n3'"), str(tmp_path / "out"), mode="overwrite")
    assert [p.name for p in (tmp_path / "out").iterdir()] == ["n3.swc"]


def test_a_failed_job_leaves_nothing(spark, tmp_path):
    rows = spark.range(100).select(F.concat(F.lit("f"), F.col("id")).alias("name"), F.when(F.col("id") < 90, "x").otherwise(F.raise_error(F.lit("broken")).cast("string")).alias("data"))
    with pytest.raises(Exception, match="broken"):
        files.write_files(rows, str(tmp_path / "out"))
    with pytest.raises(Exception, match="no file name"):
        files.write_files(spark.createDataFrame([("a", "x"), ("b/c", "x")], "name string, data string"), str(tmp_path / "out"))
    assert list(tmp_path.iterdir()) == []


def test_no_rows_make_an_empty_folder(spark, tmp_path):
    swc.write_swc(skeleton(spark, "a").limit(0), str(tmp_path / "out"))
    assert list((tmp_path / "out").iterdir()) == []


def test_where_only_spark_reaches(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(files, "reachable", lambda path: False)
    swc.write_swc(skeleton(spark, "a", "b"), str(tmp_path / "out"))
    assert sorted(p.name for p in (tmp_path / "out").iterdir() if p.suffix == ".swc") == ["a.swc", "b.swc"]


def test_other_neurons_files_are_not_opened(spark, tmp_path):
    swc.write_swc(skeleton(spark, "a", "b", "c"), str(tmp_path / "out"))
    got = swc.read_swc(spark, str(tmp_path / "out"), neurons=["b"])
    assert {r["neuron_id"] for r in got.collect()} == {"b"}
    (tmp_path / "out" / "c.swc").write_text("1 0 NaN 0 0 0 -1\n")  # would fail if it was read
    assert swc.read_swc(spark, str(tmp_path / "out"), neurons=["a", "b"]).count() == 10


def test_stream_equals_batch(spark, tmp_path):
    inbox = tmp_path / "inbox"
    inbox.mkdir()

    def arrive(*names):
        swc.write_swc(skeleton(spark, *names), str(tmp_path / names[0]))
        for p in (tmp_path / names[0]).iterdir():
            p.rename(inbox / p.name)

    for names in (("a", "b"), ("c",), ("d", "e", "f")):
        arrive(*names)
        arrivals.swc_stream(spark, str(inbox), str(tmp_path / "table"), str(tmp_path / "state"), files_a_batch=2).awaitTermination(120)
    key = lambda df: sorted(map(tuple, df.collect()), key=str)
    got = arrivals.read_deliveries(spark, str(tmp_path / "table"))
    assert key(got) == key(swc.read_swc(spark, str(inbox))) and got.count() == 30
    assert len(list((tmp_path / "table").glob("delivery=*"))) == 4  # three arrivals, the last in two


@pytest.mark.parametrize("kind", ["<i8", ">f4", "|u1"])
def test_npy(kind):
    for a in (R.integers(0, 90, (3, 4, 5)).astype(kind), np.asfortranarray(R.integers(0, 90, (2, 3)).astype(kind)), np.zeros((0, 2), kind), np.array(7, kind)):
        back = chunks.array_of(chunks.file_of(a))
        assert np.array_equal(back, a) and back.dtype == a.dtype
    with pytest.raises(ValueError):
        chunks.array_of(b"none")


def test_chunked_volume(spark, tmp_path):
    labels, aff = R.integers(0, 6, (5, 4, 6)), R.random((3, 5, 4, 6)).astype("f4").astype(float)
    v = volume(spark, labels, aff)
    chunks.write_chunks(blocks.from_voxels(v, 3), str(tmp_path / "v"))
    assert len(list((tmp_path / "v").iterdir())) == 2 * 2 * 2 * 2
    back = chunks.read_chunks(spark, str(tmp_path / "v"))
    assert sorted(map(tuple, blocks.to_voxels(back, 3).collect())) == sorted(map(tuple, v.collect()))
    key = lambda df: sorted((r["seg0"], r["seg1"], r["n"], round(r["aff_sum"], 6)) for r in df.collect())
    assert key(seg.region_graph(back, 3)) == key(seg.region_graph(v))
    first = {p.name: p.read_bytes() for p in (tmp_path / "v").iterdir()}
    chunks.write_chunks(back, str(tmp_path / "v2"))
    assert {p.name: p.read_bytes() for p in (tmp_path / "v2").iterdir()} == first
    for p in (tmp_path / "v").glob("labels*"):
        p.unlink()
    with pytest.raises(Exception, match="without labels"):
        chunks.read_chunks(spark, str(tmp_path / "v")).count()
