"""The pipeline's near-duplicate stage finds its candidates by fingerprints and their index."""

import random

import numpy as np
import pytest

import corpus_pipeline as pipeline
from dendra.llm import jaccard, simhash

WORDS = [f"w{i}" for i in range(5000)]
M64 = (1 << 64) - 1


def random_set(rng, n):
    return np.unique(np.array([rng.getrandbits(64) for _ in range(n)], np.uint64))


def near(rng, s, out):
    """``s`` with ``out`` members exchanged."""
    keep = rng.sample(s.tolist(), len(s) - out)
    return np.unique(np.array(keep + [rng.getrandbits(64) for _ in range(out)], np.uint64))


@pytest.mark.parametrize("n", [0, 1, 2, 255, 256, 700])
def test_set_fingerprints_are_majorities(n):
    hashes = random_set(random.Random(n), n)
    mix = simhash._MIX.tolist()
    for turn, got in enumerate(simhash.set_fingerprints(hashes).tolist()):
        mixed = []
        for h in hashes.tolist():
            x = h * mix[turn] & M64
            x = (x ^ x >> 32) * mix[-1] & M64
            mixed.append(x ^ x >> 29)
        assert got == sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in mixed) > n)


def test_small_sets_share_a_head():
    rng = random.Random(1)
    for n in range(1, 41):
        for _ in range(200):
            a = random_set(rng, n)
            b = near(rng, a, rng.randint(0, n // 5))
            b = b if rng.random() < 0.5 else b[rng.randint(0, n // 5) :]
            if jaccard.similar(a, b) and min(len(a), len(b)) <= jaccard.SMALL:
                assert set(jaccard.heads(a, 0.8).tolist()) & set(jaccard.heads(b, 0.8).tolist())


@pytest.mark.parametrize("hot, power", [(simhash.HOT_QUARTER, simhash.BAND_POWER), (6, simhash.BAND_POWER), (simhash.HOT_QUARTER, 4)])
def test_candidate_groups_equal_brute_force(spark, monkeypatch, hot, power):
    """Also with buckets cut into groups, and with bands as narrow as for many sets."""
    monkeypatch.setattr(simhash, "SAMPLE", 1)
    rng, sets = random.Random(2), []
    for _ in range(8):
        base = random_set(rng, rng.choice([20, 60, 200]))
        sets += [near(rng, base, rng.randint(0, len(base) // 2)) for _ in range(14)]
    keys = [k - 50 for k in range(len(sets))]
    prints, firsts = [simhash.set_fingerprints(s) for s in sets], [set(jaccard.heads(s, 0.8).tolist()) for s in sets]
    least = most = np.arange(len(sets))  # pairs that must be found, and pairs that may be: buckets of a band are searched together
    for i in range(len(sets)):
        for j in range(i):
            z = prints[i] ^ prints[j]
            extra = max(0, (len(sets) - 1).bit_length() - power)
            besides = np.any([(np.roll(z, -1 - v) & np.uint64((1 << extra) - 1)) == 0 for v in range(int(np.ceil(simhash.AGREE**-extra)))], axis=0)
            quarter = sum((z >> np.uint64(16 * q) & np.uint64(0xFFFF)) == 0 for q in range(4)) > 0
            close = quarter & (np.bitwise_count(z) <= simhash.TURN_BITS) & (np.bitwise_count(np.roll(z, -20)) <= simhash.MORE_BITS)
            if firsts[i] & firsts[j] or close.any():
                most = simhash.union(most.copy(), np.array([i]), np.array([j]))
                if firsts[i] & firsts[j] or (close & besides).any():
                    least = simhash.union(least.copy(), np.array([i]), np.array([j]))
    signed = lambda x: np.array(list(x), np.uint64).view(np.int64).tolist()
    rows = [(k, signed(p), signed(sorted(f))) for k, p, f in zip(keys, prints, firsts)]
    df = spark.createDataFrame(rows, "key long, prints array<long>, heads array<long>")
    got = {r["node"]: r["root"] for r in simhash.candidate_groups(df, hot, power).collect()}
    root = np.array([got.get(k, k) for k in keys])
    assert (root == root[least]).all() and (most == most[root + 50]).all() and 50 < len(got) < len(sets)
    assert (least == most).all() == (power == simhash.BAND_POWER)


def test_stage_links_only_what_fingerprints_find(spark, monkeypatch):
    rng = random.Random(3)
    words = rng.sample(WORDS, 200)
    docs = spark.createDataFrame([(0, " ".join(words)), (1, " ".join(words[:100] + ["other"] + words[101:])), (2, " ".join(words))], "doc_id long, text string")
    seen = []

    def groups(sets):
        seen.extend(r["prints"] for r in sets.collect())
        return spark.createDataFrame([], "node long, root long")

    kept = lambda: sorted(r["doc_id"] for r in pipeline.one_of_each(spark, docs, "").collect())
    assert kept() == [0]
    monkeypatch.setattr(jaccard, "candidate_groups", groups)
    assert kept() == [0, 1]  # equal texts are one class
    want = [simhash.set_fingerprints(jaccard.shingles(r["text"])).view(np.int64).tolist() for r in docs.where("doc_id < 2").collect()]
    assert sorted(seen) == sorted(want)
