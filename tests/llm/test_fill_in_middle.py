"""Fill-in-the-middle documents against plain Python, and their defined cases."""

import hashlib
import re

import pytest
from pyspark.sql import functions as F

from dendra.llm import fill_in_middle, queries
from dendra.llm.common import table

TOKEN = {
    "letters": r"[A-Za-z]+|[^A-Za-z]",
    "words": r"[\x20\x09-\x0D]+|[^\x20\x09-\x0D]+",
    "lines": r"[^\n]*\n|[^\n]+",
    "characters": r"[\s\S]",
    "tokens": r"[A-Za-z]+|[0-9]+|\x20+|[^A-Za-z0-9\x20]",
}
ODD = [None, "", " ", "\n", "a", "ab", "a b", "ab1", "1ab", "é Ä ß", "a😀b", "😀😀", "x😀\n\r\nq", "İstanbul ǅ", "<P", "<P>", "say <S> it", "a<M>", "x" * 60000, "ab1 " * 40000, "\x00a\x00", "a b\u0085c", "éa", "  two  spaces ", "tail\n"]


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def brute(doc_id, text):
    text = text or ""
    u = re.findall(TOKEN["letters"], text)
    digest = sha("1:" + ("" if doc_id is None else str(doc_id)))
    h1, h2, h3, h4 = (int(digest[8 * i : 8 * i + 8], 16) for i in range(4))
    n = len(u)
    lo, hi = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = ("".join(x) for x in (u[:lo], u[lo:hi], u[hi:]))
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return n, "plain", None, None, sha(text), sha(text)
    if h4 % 100 < 20:
        return n, "spm", len(p), len(m), sha("<S>" + s + "<P>" + p + "<M>" + m), sha(text)
    return n, "psm", len(p), len(m), sha("<P>" + p + "<S>" + s + "<M>" + m), sha(text)


@pytest.mark.parametrize("grammar", sorted(fill_in_middle.GRAMMARS))
def test_units(spark, grammar):
    texts = [t for t in ODD if t is not None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = df.select("i", fill_in_middle.units(F.col("t"), grammar).alias("u")).collect()
    assert {r["i"]: r["u"] for r in got} == {i: re.findall(TOKEN[grammar], t) for i, t in enumerate(texts)}


def test_query(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").collect()
    got = queries.fill_in_the_middle(spark, sf_dir).collect()
    assert sorted(tuple(r) for r in got) == sorted((r["doc_id"], *brute(r["doc_id"], r["text"])) for r in rows)


def test_odd_texts(spark, tmp_path):
    rows = [(i + 1000 * k, t) for k in range(12) for i, t in enumerate(ODD)] + [(None, "a b c d"), (None, None), (5, "same id"), (5, "same id")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = sorted(map(tuple, queries.fill_in_the_middle(spark, str(tmp_path)).collect()), key=str)
    assert got == sorted(((i, *brute(i, t)) for i, t in rows), key=str)
    assert {r[2] for r in got} == {"plain", "psm", "spm"}


def test_general_interface(spark):
    df = spark.createDataFrame([(i, f"one two {i}\nthree", "clash") for i in range(60)], "doc_id long, text string, form string")
    out = fill_in_middle.reorder(df, grammar="words", reordered=100, suffix_first=0)
    assert out.columns == ["doc_id", "text", "n_units", "form", "prefix", "middle", "suffix", "output"]
    for r in out.collect():
        assert r["form"] == "psm" and r["n_units"] == 7 and r["prefix"] + r["middle"] + r["suffix"] == r["text"]
        assert r["output"] == f"<P>{r['prefix']}<S>{r['suffix']}<M>{r['middle']}"
    assert {r["form"] for r in fill_in_middle.reorder(df, reordered=0).collect()} == {"plain"}
    assert fill_in_middle.reorder(df.limit(0)).count() == 0
    with pytest.raises(ValueError, match="no unit grammar"):
        fill_in_middle.reorder(df, grammar="none")
