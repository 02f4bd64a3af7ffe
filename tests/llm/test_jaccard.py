"""The pipeline's near-duplicate stage: links are five-word Jaccard similarities of 0.8 or more, and nothing else."""

import random

import numpy as np
import pytest

import brute
import corpus_pipeline as pipeline
from dendra.llm import jaccard

WORDS = [f"w{i}" for i in range(5000)]


def shingle_set(text):
    w = text.lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}


def similarity(a, b):
    a, b = shingle_set(a), shingle_set(b)
    return len(a & b) / len(a | b)


def bits(a, b):
    return (brute.fingerprint(a) ^ brute.fingerprint(b)).bit_count()


def kept(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return {r["doc_id"] for r in pipeline.one_of_each(spark, docs, "").collect()}


def test_copies_beyond_three_bits_are_found(spark):
    rng, texts = random.Random(1), []
    while len(texts) < 80:
        words = rng.sample(WORDS, 120)
        pair = [" ".join(words), " ".join(words[:60] + ["other"] + words[61:])]
        if similarity(*pair) >= 0.8 and bits(*pair) > 3:
            texts += pair
    assert kept(spark, texts) == set(range(0, 80, 2))


def test_texts_within_three_bits_but_unlike_stay(spark):
    rng = random.Random(2)
    common = " ".join(rng.sample(WORDS, 31) * 60)
    pair = [common + " " + " ".join(rng.sample(WORDS, 40)) for _ in range(2)]
    assert bits(*pair) <= 3 and similarity(*pair) < 0.8
    assert kept(spark, pair) == {0, 1}


@pytest.mark.parametrize("group_rows", [1 << 11, 6])
def test_groups_equal_brute_force(spark, group_rows):
    """Also with buckets cut into many groups."""
    rng, texts = random.Random(3), []
    for _ in range(6):
        words = rng.sample(WORDS, 100)
        for _ in range(12):  # similarities on both sides of the bound
            words = list(words)
            for i in rng.sample(range(100), rng.choice([1, 2, 3, 4])):
                words[i] = rng.choice(WORDS)
            texts.append(" ".join(words))
    texts += ["", " \n", "few words", "Few words"]
    parent = list(range(len(texts)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            if similarity(texts[i], texts[j]) >= 0.8:
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    want = {i for i in range(len(texts)) if root(i) == i}
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = jaccard.near_duplicates(docs, group_rows=group_rows)
    assert {r["doc_id"]: r["component_id"] for r in got.collect()} == {i: root(i) for i in range(len(texts))}
    if group_rows == jaccard.GROUP_ROWS:
        assert kept(spark, texts) == want


def test_links_across_components_of_a_bucket():
    rng = np.random.default_rng(5)
    base = np.sort(rng.choice(1 << 40, 60, replace=False)).astype(np.uint64)
    for _ in range(20):
        sets = [np.unique(np.concatenate([rng.choice(base, 60 - k, replace=False), rng.choice(1 << 40, k).astype(np.uint64)])) for k in rng.integers(0, 14, 30)]
        key, root = np.arange(30), rng.integers(0, 12, 30)
        for side in (np.zeros(30, np.int64), rng.integers(0, 2, 30)):
            pairs = [(a, b) for a in range(30) for b in range(a) if jaccard.similar(sets[a], sets[b]) and ((side == side[0]).all() or side[a] != side[b])]
            found = list(jaccard.across(key, root, side, sets, 0.8))
            assert set(found) <= {p for a, b in pairs for p in ((a, b), (b, a))}
            of = dict(enumerate(root.tolist()))

            def joined(links, of=of):
                of = dict(of)
                for a, b in links:
                    old, new = of[a], of[b]
                    of = {k: new if v == old else v for k, v in of.items()}
                return {frozenset(k for k in of if of[k] == v) for v in of.values()}

            assert joined(found) == joined(pairs) and len(found) <= 11


def test_bound_is_met_exactly():
    a = np.arange(9, dtype=np.uint64)
    assert jaccard.similar(a[:8], np.append(a[:8], a[8:] + np.uint64(1))) and jaccard.similar(a[:4], a[:5]) and not jaccard.similar(a[:3], a[:4])


def test_a_null_id_alone_in_its_group(spark):
    texts = [" ".join(WORDS[60 * i : 60 * i + 60]) for i in range(3)]
    near = texts[1].replace("w60 ", "other ", 1)
    docs = spark.createDataFrame([(None, texts[0]), (None, texts[1]), (7, near), (None, texts[2]), (None, texts[2])], "doc_id long, text string")
    got = [(r["doc_id"], r["component_id"], r["representative"]) for r in jaccard.near_duplicates(docs).collect()]
    assert sorted(got, key=str) == sorted([(None, None, True), (None, 7, False), (7, 7, True), (None, None, True), (None, None, False)], key=str)
