"""The pipeline against a plain Python version of its stages, and its defined cases."""

import os
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

import brute
import corpus_pipeline as pipeline
from dendra.llm import quality_rules
from dendra.llm.common import held, release, shared_folder, table
from dendra.plans import scratch


def keeps(text):
    n, chars, symbols, dup, rep = brute.quality(text)
    lines = len([x for x in (text or "").split("\n") if brute.WORD.search(x)])
    bad = [n < 10, 100 * rep > 20 * n, 10 * symbols > n, 2 * dup > lines, chars < 2 * n, chars > 15 * n, 2 * (text or "").count("!") > n]
    return not any(bad)


def redacted(text, spans):
    out, at, first = "", 0, True
    for a, _, b in spans:
        if a > at or first:
            out += text[at:a] + "[SECRET]"
            first = False
        at = max(at, b)
    return out + text[at:]


def stages(spark, docs):
    out = []
    for name, stage in pipeline.STAGES:
        docs = pipeline.written(stage(spark, docs, ""), name)
        out.append(docs)
    return out


def test_stages_equal_plain_python(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    rows = {r["doc_id"]: r for r in docs.collect()}
    quality, unique, clean, packed = stages(spark, docs)
    assert quality.columns == unique.columns == clean.columns == docs.columns
    good = sorted(i for i, r in rows.items() if keeps(r["text"]))
    assert sorted(r["doc_id"] for r in quality.collect()) == good
    component = brute.shingle_groups(good, [rows[i]["text"] for i in good])
    kept = sorted(set(component))
    assert sorted(r["doc_id"] for r in unique.collect()) == kept and len(kept) < len(good)
    after = {r["doc_id"]: r for r in clean.collect()}
    assert sorted(after) == kept
    for i, spans in zip(kept, brute.all_secrets([rows[i]["text"] for i in kept])):
        assert after[i]["text"] == redacted(rows[i]["text"], spans)
        assert after[i]["n_chars"] == (len(after[i]["text"]) if spans else rows[i]["n_chars"])
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    got = defaultdict(dict)
    for r in packed.collect():
        got[r["doc_id"]][r["start"]] = np.frombuffer(r["ids"], "<u4").tolist()
    assert {i: sum((v[k] for k in sorted(v)), []) for i, v in got.items()} == {i: [*t.encode(r["text"], add_special_tokens=False).ids, 0] for i, r in after.items()}


def test_labelled_documents_that_are_good_stay(spark, sf_dir):
    good = {r["doc_id"] for r in table(spark, sf_dir, "labels").where("quality = 1").collect()}
    docs = table(spark, sf_dir, "documents")
    kept = {r["doc_id"] for r in pipeline.quality(spark, docs, "").collect()}
    base = {r["doc_id"] for r in quality_rules.apply_policy(quality_rules.build_ledger(docs), "base-1").where("kept").collect()}
    assert good & base <= kept


def test_run_and_release(spark, sf_dir):
    release(spark)
    out = pipeline.run(spark, sf_dir)
    by_stages = stages(spark, table(spark, sf_dir, "documents"))[-1]
    digest = lambda df: Counter((r["doc_id"], r["start"], r["length"], r["doc_tokens"], zlib.crc32(r["ids"])) for r in df.collect())
    total = lambda d: {k: sum(n for (i, _, n, _, _), c in d.items() for _ in range(c) if i == k) for k in {x[0] for x in d}}
    one, other = digest(out), digest(by_stages)
    assert total(one) == total(other) and {(x[0], x[3]) for x in one} == {(x[0], x[3]) for x in other}
    paths = list(scratch._paths())
    release(spark)
    assert paths and held() == 0
    root = shared_folder(spark).removeprefix("file:")
    assert not [p for p in paths if os.path.exists(p.removeprefix("file:"))] and os.path.isdir(root)


def test_cases(spark):
    text = " ".join(f"word{i}" for i in range(60))
    rows = [(1, text, "x"), (1, text, "x"), (2, text, None), (None, text + " more", "y"), (3, None, "z"), (4, "", "z"), (5, text + " token=abcdefghijklmnop", "z"), (6, "few words", None), (7, " ".join(f"other{i}" for i in range(40)), None), (7, " ".join(f"third{i}" for i in range(40)), None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fail_bits string")
    quality, unique, clean, packed = stages(spark, docs)
    assert Counter(r["doc_id"] for r in quality.collect()) == Counter([1, 1, 2, None, 5, 7, 7])
    assert quality.columns == unique.columns == clean.columns == docs.columns
    per = [r["doc_id"] for r in unique.collect()]
    assert per.count(1) == 1 and 2 not in per and per.count(7) == 2  # an id twice, with different texts
    assert all("abcdefghijklmnop" not in r["text"] for r in clean.collect())
    assert packed.count() >= 1
    assert all(df.count() == 0 for df in stages(spark, docs.limit(0)))


def test_one_very_long_text(spark):
    """Taken whole by every stage."""
    rng = np.random.default_rng(9)
    long = " ".join(f"word{i}" for i in rng.permutation(60_000))
    docs = spark.createDataFrame([(1, long), (2, long + " end"), (3, long[: len(long) // 2] + " token=abcdefghijklmnop"), (4, " ".join(f"short{i}" for i in range(30)))], "doc_id long, text string")
    quality, unique, clean, packed = stages(spark, docs)
    assert sorted(r["doc_id"] for r in unique.collect()) == [1, 3, 4]
    texts = {r["doc_id"]: r["text"] for r in clean.collect()}
    assert texts[1] == long and texts[3] == long[: len(long) // 2] + " [SECRET]"
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    lengths = Counter()
    for r in packed.collect():
        lengths[r["doc_id"]] += r["length"]
    assert lengths == {i: len(t.encode(x, add_special_tokens=False).ids) + 1 for i, x in texts.items()}
