"""MinHash groups against brute force over whole sets, the sketches' estimates, and the defined cases."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from dendra.llm import minhash, queries
from dendra.llm.common import table

WORDS = [f"w{i}" for i in range(4000)]


def shingle_set(text, k=3):
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def brute(ids, texts, percent=85, k=3):
    """(id, set size, smallest id reachable) of each row."""
    sets = [shingle_set(t, k) for t in texts]
    where, parent = defaultdict(list), list(range(len(ids)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, s in enumerate(sets):
        shared = Counter(j for g in s for j in where[g])
        for j, both in shared.items():
            if 100 * both >= percent * (len(s) + len(sets[j]) - both):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
        for g in s:
            where[g].append(i)
    least = {}
    for i, d in enumerate(ids):
        least.setdefault(find(i), []).append(d)
    low = {r: min((d for d in v if d is not None), default=None) for r, v in least.items()}
    return [(d, len(s), low[find(i)]) for i, (d, s) in enumerate(zip(ids, sets))]


def groups(spark, texts, ids=None, **more):
    df = spark.createDataFrame(list(zip(ids or range(len(texts)), texts, texts)), "doc_id long, text string, component_id string")
    out = minhash.near_duplicates(df, **more)
    assert out.columns == ["doc_id", "text", "n_shingles", "component_id", "representative"]
    return out.collect()


def rows_of(got):
    return Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got)


def families(seed, n=25, size=100, each=8):
    """Copies of copies, with similarities on both sides of the bound."""
    rng, texts = random.Random(seed), []
    for _ in range(n):
        words = rng.sample(WORDS, rng.randint(4, size))
        for _ in range(each):
            words = list(words)
            for i in rng.sample(range(len(words)), min(len(words), rng.choice([0, 1, 1, 2, 3]))):
                words[i] = rng.choice(WORDS)
            texts.append(" ".join(words))
    rng.shuffle(texts)
    return texts


def test_query(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").collect()
    want = {(*r, r[0] == r[2]) for r in brute([r["doc_id"] for r in rows], [r["text"] for r in rows])}
    got = queries.minhash_groups(spark, sf_dir).collect()
    assert len(got) == len(rows) and {tuple(r) for r in got} == want


@pytest.mark.parametrize("cuts", [{}, {"bucket_rows": 5, "group_rows": 4}])
def test_equals_brute_force(spark, cuts):
    """Also with buckets and groups cut into many parts."""
    texts = families(1)
    assert rows_of(groups(spark, texts, **cuts)) == Counter(brute(range(len(texts)), texts))


@pytest.mark.parametrize("cuts", [{}, {"bucket_rows": 16, "group_rows": 16}])
def test_a_large_group_of_near_copies(spark, cuts):
    """All near one text, many not near each other, and some near none but another leftover."""
    rng = random.Random(2)
    base = rng.sample(WORDS, 300)
    texts = [" ".join(base)]
    for _ in range(300):
        words = list(base)
        for i in rng.sample(range(300), rng.randint(0, 12)):
            words[i] = rng.choice(WORDS)
        texts.append(" ".join(words))
    got = groups(spark, texts, **cuts)
    want = brute(range(len(texts)), texts)
    assert rows_of(got) == Counter(want) and len({w[2] for w in want}) > 3


@pytest.mark.parametrize("percent,shingle", [(80, 5), (95, 1), (100, 3)])
def test_other_bounds(spark, percent, shingle):
    texts = families(3, 10)
    got = groups(spark, texts, percent=percent, shingle=shingle)
    assert rows_of(got) == Counter(brute(range(len(texts)), texts, percent, shingle))


def test_short_texts(spark):
    """Sets of 7 and 6 of 7 are linked, 6 and 5 of 6 are not."""
    a, b = "a b c d e f g h i", "a b c d e f g h"
    c, d = "p q r s t u v w", "p q r s t u v"
    got = {r["doc_id"]: r["component_id"] for r in groups(spark, [a, b, c, d])}
    assert got == {0: 0, 1: 0, 2: 2, 3: 3}


def test_defined_cases(spark):
    texts = [None, "", " \n", "a", "A", "a b", "A  b\t", "word " * 30000, "WORD " * 30000, "é Ä ß", "one two three four five", "ONE two three four five", "ONE two three four five"]
    ids = [7, 3, None, 9, 4, None, 2, 6, None, None, 12, 11, 11]
    got = groups(spark, texts, ids)
    assert rows_of(got) == Counter((d, n, d if not n else c) for d, n, c in brute(ids, texts))
    per = Counter()
    for r in got:
        per[(r["text"] or "").lower().split().__str__() if r["n_shingles"] else r["doc_id"]] += r["representative"]
    assert set(per.values()) == {1}
    assert groups(spark, []) == []


def test_repeated_rows_in_other_partitions(spark):
    one, other = " ".join(WORDS[:50]), " ".join(WORDS[:51])
    got = groups(spark, [one] * 40 + [other] * 40, [1] * 40 + [2] * 40)
    assert Counter((r["doc_id"], r["component_id"], r["representative"]) for r in got) == {(1, 1, True): 1, (1, 1, False): 39, (2, 1, False): 40}


def test_sketches_estimate_high_similarities():
    rng = np.random.default_rng(5)
    for share in (0.7, 0.85, 0.9, 0.97):
        seen = []
        for _ in range(60):
            u = rng.integers(0, 1 << 64, 400, dtype=np.uint64)
            n = round(400 * share)
            cut = n + (400 - n) // 2
            a, b = (minhash.odd_sketch(minhash.samples(x)) for x in (u[:cut], np.concatenate([u[:n], u[cut:]])))
            seen.append(int(minhash.apart(a, b)))
        assert abs(minhash.similarity(np.mean(seen)) - share) < 0.02
        assert share < 0.85 or max(seen) <= minhash.sketch_limit()


def test_limit():
    """The distribution by simulation: two flips a differing sample."""
    rng = np.random.default_rng(6)
    limit = minhash.sketch_limit(miss=0.01)
    differing = rng.binomial(minhash.SAMPLES, 0.15, 20000)
    seen = np.array([(np.bincount(rng.integers(0, minhash.SKETCH, 2 * d), minlength=minhash.SKETCH) & 1).sum() for d in differing])
    assert (seen > limit).mean() < 0.013 and (seen > limit - 4).mean() > 0.01
    assert minhash.sketch_limit() > limit
