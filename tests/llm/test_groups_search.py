"""SimHash groups, exact top-k and sharding against brute force, and their defined cases."""

import math
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import brute
from dendra.llm import queries, sharding, simhash, topk
from dendra.llm.common import table

R = np.random.default_rng(3)
ODD = [None, "", " \n", "a", "A", "a b", "A  b\t", "x" * 40000, "word " * 30000, "é Ä ß", "one two three four five", "ONE two three four five"]


def docs(spark, texts, ids=None):
    return spark.createDataFrame([(i, t, i) for i, t in zip(ids or range(len(texts)), texts)], "doc_id long, text string, fp long")


# near duplicates


@pytest.mark.parametrize("text", ODD)
def test_fingerprint(text):
    assert simhash.fingerprint(text) == brute.fingerprint(text)


def test_fingerprint_in_blocks(monkeypatch):
    text = " ".join(f"w{i % 977}" for i in range(5000))
    monkeypatch.setattr(simhash, "BLOCK", 100)
    assert simhash.fingerprint(text) == brute.fingerprint(text)


def brute_sets(f, bits):
    parent = np.arange(len(f))
    for i in range(len(f)):
        j = np.flatnonzero(np.bitwise_count(f[i] ^ f[i + 1 :]) <= bits) + i + 1
        parent = simhash.union(parent, np.full(len(j), i), j)
    return parent


def flips(x, n):
    for _ in range(n):
        x = x ^ (np.uint64(1) << R.integers(0, 64, len(x)).astype(np.uint64))
    return x


@pytest.mark.parametrize("kind", ["random", "near", "cluster", "dense", "tiny", "one", "chain"])
@pytest.mark.parametrize("bits", [3, 1, 0])
def test_index_finds_all_links(kind, bits):
    base = R.integers(0, 1 << 64, 900, dtype=np.uint64)
    f = {
        "random": base,
        "near": np.concatenate([base, flips(base, 3), flips(base, 2)]),
        "cluster": flips(np.full(1500, base[0]), 6),
        "dense": flips(np.full(1500, base[0]), 2),
        "tiny": base[:3],
        "one": base[:1],
        "chain": np.array([sum(1 << b for b in range(i)) for i in range(65)], dtype=np.uint64),
    }[kind]
    f = np.unique(f)
    parent, at = np.arange(len(f)), {int(x): i for i, x in enumerate(f)}
    for mask in simhash.bands(bits, list(range(64))):
        a, b = simhash.bucket_links(f, mask, bits)
        assert all(int(x ^ y).bit_count() <= 64 for x, y in zip(a, b))
        if len(a):
            parent = simhash.union(parent, np.array([at[int(x)] for x in a]), np.array([at[int(x)] for x in b]))
    assert np.array_equal(parent, brute_sets(f, bits))


@pytest.mark.parametrize("hot", [1 << 20, 5])
def test_links_with_buckets_dealt_again(spark, hot):
    f = np.unique(np.concatenate([flips(np.full(300, R.integers(0, 1 << 63, dtype=np.uint64)), 4), R.integers(0, 1 << 64, 200, dtype=np.uint64)])).view(np.int64)
    df = spark.createDataFrame([(int(x),) for x in f], "fp long")
    roots = {r["node"]: r["root"] for r in simhash.components(simhash.links(df, 3, hot), "a", "b").collect()}
    got = [roots.get(int(x), int(x)) for x in f]
    parent = brute_sets(f.view(np.uint64), 3)
    assert len(set(got)) == len(set(parent.tolist())) == len(set(zip(got, parent.tolist())))


def test_near_duplicate_query(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").collect()
    fps = [brute.fingerprint(r["text"]) for r in rows]
    want = dict(zip((r["doc_id"] for r in rows), zip((f"{x:016x}" for x in fps), brute.groups([r["doc_id"] for r in rows], fps))))
    got = queries.near_duplicates(spark, sf_dir).collect()
    assert len(got) == len(rows) and {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in got} == want


def test_near_duplicate_cases(spark):
    ids = [5, None, 3, 4, None, 9, 7, 8, 2, 1, 11, 12]
    rows = list(zip(ids, ODD)) + [(3, ODD[2]), (3, ODD[2])]  # repeated rows
    df = docs(spark, [t for _, t in rows], [i for i, _ in rows])
    got = simhash.near_duplicates(df)
    assert got.columns == ["doc_id", "text", "fp", "component_id", "representative"]
    got = got.collect()
    want = Counter(zip(ids + [3, 3], (brute.groups([i for i, _ in rows], [brute.fingerprint(t) for _, t in rows]))))
    assert Counter((r["doc_id"], r["component_id"]) for r in got) == want
    per = defaultdict(int)
    for r in got:
        per[(r["component_id"], r["fp"] if r["component_id"] is None else 0)] += r["representative"]
    assert set(per.values()) <= {1} and sum(per.values()) == len({(r["component_id"]) for r in got})
    assert simhash.near_duplicates(df.limit(0)).count() == 0


# exact top-k


def brute_top(ids, x, asked, k=10):
    out = {}
    for q in np.flatnonzero(asked):
        s = x @ x[q]
        own = sorted((-int(s[j]), int(ids[j])) for j in range(len(x)) if ids[j] != ids[q])[:k]
        out[int(ids[q])] = [(i, -v) for v, i in own]
    return out


def answers(df):
    out = defaultdict(list)
    for r in sorted(df.collect(), key=lambda r: (r["query_id"], r["rank"])):
        out[r["query_id"]].append((r["vec_id"], r["score"]))
        assert r["rank"] == len(out[r["query_id"]])
    return dict(out)


def test_top_k_query(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").collect()
    ids = np.array([r["vec_id"] for r in rows])
    x = np.floor(1024 * np.array([r["embedding"] for r in rows], np.float64)).astype(np.int64)
    assert answers(queries.exact_top_k(spark, sf_dir)) == brute_top(ids, x, ids % 100 == 0)


@pytest.mark.parametrize("sizes", [(2048, 16384, 4096), (3, 40, 20)])
def test_top_k_prunes_nothing_it_needs(spark, monkeypatch, sizes):
    for name, n in zip(("QUERY_ROWS", "SLOT_ROWS", "HEAD_ROWS"), sizes):
        monkeypatch.setattr(topk, name, n)
    monkeypatch.setattr(topk, "STEP", 16)
    monkeypatch.setattr(topk, "FIRST", 3)
    v = R.normal(size=(400, 8)) * R.lognormal(size=(400, 1))
    v[100:160] = v[3]  # ties
    rows = [(i, [float(c) for c in r]) for i, r in enumerate(v)]
    bad = [(1000, None), (1001, [1.0, None] + [0.0] * 6), (1002, [math.nan] * 8), (1003, [math.inf] * 8), (1004, [1.0]), (1005, []), (None, [1.0] * 8)]
    df = spark.createDataFrame(rows + bad, "vec_id long, embedding array<double>")
    x = np.floor(1024 * v).astype(np.int64)
    short = spark.createDataFrame([(5000, [1.0]), (5001, [-2.0])], "vec_id long, embedding array<double>")  # another length, with 1004
    by_length = answers(topk.top_k(df.unionByName(short), F.col("vec_id").isin(5000, 5001)))
    assert by_length == {5000: [(1004, 1 << 20), (5001, -2 << 20)], 5001: [(1004, -2 << 20), (5000, -2 << 20)]}
    clash = df.withColumns({"score": F.lit("x"), "rank": F.lit(None), "query_id": F.col("vec_id")})
    assert answers(topk.top_k(clash, F.col("vec_id") % 20 == 0)) == brute_top(np.arange(400), x, np.arange(400) % 20 == 0)


def test_top_k_small_tables(spark):
    schema = "vec_id long, embedding array<float>"
    assert topk.top_k(spark.createDataFrame([], schema), F.lit(True)).count() == 0
    assert topk.top_k(spark.createDataFrame([(0, [1.0])], schema), F.lit(True)).count() == 0
    three = spark.createDataFrame([(0, [1.0]), (1, [2.0]), (1, [3.0]), (100, [-1.0])], schema)
    assert answers(topk.top_k(three, F.col("vec_id") == 0)) == {0: [(1, 3 << 20), (1, 2 << 20), (100, -(1 << 20))]}


def test_top_k_bounds(spark):
    big = spark.createDataFrame([(0, [3e6] * 4), (1, [3e6] * 4)], "vec_id long, embedding array<double>")
    with pytest.raises(ValueError, match="64 bits"):
        topk.top_k(big, F.lit(True))
    with pytest.raises(ValueError, match="vec_id"):
        topk.top_k(big.withColumn("vec_id", F.lit("x")), F.lit(True))


def test_slots_and_blocks():
    assert topk.dealt([(9, 3), (8, 30), (7, 4), (6, 5), (5, 2)], 10) == [(9, 0, 1), (8, 1, 3), (7, 4, 1), (6, 4, 1), (5, 5, 1)]


def test_repeated_ids_are_answered_each(spark):
    rows = [(0, [1.0, 0.0]), (0, [0.0, 2.0]), (3, [1.0, 1.0])]
    got = topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), F.col("vec_id") == 0)
    assert sorted((r["rank"], r["vec_id"], r["score"]) for r in got.collect()) == [(1, 3, 1 << 20), (1, 3, 2 << 20), (2, 0, 0), (2, 0, 0)]


# sharding


def one_by_one(sizes, shards):
    """Plain scheduling: the loads, and how many of each size a shard got."""
    load, got = [0] * shards, defaultdict(lambda: [0] * shards)
    for size in sorted(sizes, reverse=True):
        s = min(range(shards), key=lambda i: (load[i], i))
        load[s] += size
        got[size][s] += 1
    return load, got


@pytest.mark.parametrize("shards", [1, 3, 16])
def test_runs_equal_one_step_a_group(shards):
    for few in (sharding.FEW, 0):
        for high, n in ((4, 500), (50, 800), (10**6, 60), (3, 7)):
            sizes = Counter(R.integers(1, high, n).tolist())
            items = sorted(sizes.items(), reverse=True)
            loads = [0] * shards
            with pytest.MonkeyPatch.context() as m:
                m.setattr(sharding, "FEW", few)
                got = [sharding.run_of(loads, size, count) for size, count in items]
            load, want = one_by_one(sizes.elements(), shards)
            assert loads == load and all(g == want[size] for g, (size, _) in zip(got, items))


def check_shards(rows, texts, shards=16):
    by = defaultdict(list)
    for r in rows:
        t = texts[r["doc_id"]] or ""
        assert r["size"] == len(t.encode()) + 1 and r["text_crc32"] == brute.crc(t) and r["law"] == "bytes" and 0 <= r["shard"] < shards
        by[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in by.values())
    of = defaultdict(set)
    for r in rows:
        of[texts[r["doc_id"]] or ""].add(r["shard"])
    assert all(len(s) == 1 for s in of.values())
    return [sum(r["size"] for r in rows if r["shard"] == s) for s in range(shards)]


def test_sharding_query(spark, sf_dir):
    texts = {r["doc_id"]: r["text"] for r in table(spark, sf_dir, "documents").collect()}
    got = queries.shards(spark, sf_dir).collect()
    assert len(got) == len(texts)
    groups = Counter()
    for t in texts.values():
        groups[t or ""] += len((t or "").encode()) + 1
    assert check_shards(got, texts) == one_by_one(groups.values(), 16)[0]


def test_sharding_cases(spark):
    texts = dict(enumerate([*ODD, "same"] + ["same"] * 200))
    rows = spark.createDataFrame([(i, t, "clash") for i, t in texts.items()], "doc_id long, text string, shard string")
    groups = Counter()
    for t in texts.values():
        groups[t or ""] += len((t or "").encode()) + 1
    for hot_share, slot_rows in ((1 << 12, 1 << 20), (2, 4), (1 << 30, 4)):
        out = sharding.assign(rows, 4, hot_share=hot_share, slot_rows=slot_rows)
        assert out.columns == ["doc_id", "text", "size", "text_crc32", "law", "shard", "slot"]
        assert check_shards(out.collect(), texts, 4) == one_by_one(groups.values(), 4)[0]
    assert sharding.assign(rows.limit(0)).count() == 0
    repeated = spark.createDataFrame([(None, "a")] * 5 + [(1, None)] * 3, "doc_id long, text string")
    assert sharding.assign(repeated).count() == 8
    with pytest.raises(ValueError):
        sharding.assign(rows, 0)
