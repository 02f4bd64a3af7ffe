"""Secret scan: three patterns, and a battery of randomness tests for strings that no pattern knows
(DataFrame functions only).

Base spans come from the patterns ``assign``, ``access`` and ``hex``. Besides, every run of 20 or more
characters of the base64 alphabets that overlaps no base span is a candidate:

1. Its encoding is the smallest alphabet that holds it (hex, base32, base36, base62, base64; runs of digits
   alone are numbers, not candidates).
2. Battery, under the hypothesis of even, independent symbols: chi-squared uniformity over the
   alphabet, runs above and below the alphabet's middle, lag-one serial correlation. Each |z| may reach CRITICAL.
3. Against the hypothesis of natural text, two z-values with mean and variance from the length: the number of equal symbol pairs (what
   chi-squared sums up), by the symbol frequencies of text in that alphabet, and the number of changes between digits, upper case, lower
   case and marks, by how often words, camel case and paths change. Their sum over the root of two (Stouffer) is one z-value, so
   strings of 20 symbols, for which either alone is weak, carry enough evidence.
4. False discoveries: in each stratum (encoding and length band) over the whole table, the Benjamini-Hochberg rule at level
   FDR picks a bound for that z-value. Only a histogram of fixed size (strata times bins) reaches the driver.

A candidate that passes the battery and its stratum's bound is a span of kind ``random``.

Defined cases: a null text is empty and has no spans. Repeated rows are tested each. Null ids pass through. Long runs are tested
whole. Positions are code points. An empty table gives an empty result. Input columns named like an added one are replaced.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dendra.llm.common import HIDDEN, need, text_of, without, written

KINDS = ["assign", "access", "hex", "random"]
KEY = r"(?i:password|passwd|secret|token|api_?key)"
ASSIGN = KEY + r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
# a run of a class is matched whole, so asking for its least length in the pattern gives the same spans
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"
LEAST = {"assign": 12, "access": 18, "hex": 16}
#: Patterns that some match of the base patterns fits; cheap to look for in texts without any.
HINT = {"assign": KEY + r"""["']?\x20*[:=]""", "access": r"AKIA[A-Z0-9]{14}", "hex": r"[0-9a-f]{16}"}
CANDIDATE = r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}"

#: Encoding: pattern, alphabet in order of value, and for natural text in it the chance that two, and three, symbols are equal; the
#: values at which another class of symbols (digits, upper, lower, marks) begins, and how often natural text changes class at most.
ENCODINGS = [
    ("hex", r"^(?:[0-9a-f]+|[0-9A-F]+)$", "0123456789abcdef", 0.2606, 0.0852, [10, 99, 99], 0.12),
    ("base32", r"^[A-Z2-7]+$", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", 0.0667, 0.0057, [26, 99, 99], 0.12),
    ("base36", r"^[0-9a-z]+$", "0123456789abcdefghijklmnopqrstuvwxyz", 0.0667, 0.0057, [10, 99, 99], 0.12),
    ("base62", r"^[0-9A-Za-z]+$", "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz", 0.0667, 0.0057, [10, 36, 99], 0.3),
    ("base64", r"", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", 0.0667, 0.0057, [26, 52, 62], 0.35),
]
BANDS = [32, 48, 80]
CRITICAL = 3.0
FDR = 0.01
#: z-values against text are binned by tenths up to this bin.
TOP_BIN = 120
SPAN = "struct<start:int,kind:int,end:int>"
FOUND = "array<struct<start:int,end:int,stratum:int,bin:int,even:boolean>>"
ADDED = ["spans", "n_assign", "n_access", "n_hex", "n_random"]


def _none(kind: str) -> Column:
    return F.array().cast(f"array<{kind}>" if not kind.startswith("array") else kind)


def _matches(t: Column, kind: int, pattern: str, hint: str, value_group: int, least: int) -> Column:
    """Spans of a pattern's leftmost, non-overlapping matches whose value is long enough.

    The text is cut into (gap, match) pairs, up to the end: their lengths are the positions.
    """
    cut = f"(?s)(.*?)({pattern}|\\z)"
    part = lambda g: F.regexp_extract_all(t, F.lit(cut), F.lit(g))
    sizes = lambda g: F.transform(part(g), lambda x: F.length(x))
    pairs = F.arrays_zip(sizes(1).alias("gap"), sizes(2).alias("hit"), sizes(2 + value_group).alias("value"))
    span = lambda a, x: F.struct((a["at"] + x["gap"]).alias("start"), F.lit(kind).alias("kind"), (a["at"] + x["gap"] + x["hit"]).alias("end"))
    spans = F.aggregate(
        pairs,
        F.struct(F.lit(0).alias("at"), _none(SPAN).alias("out")),
        lambda a, x: F.struct((a["at"] + x["gap"] + x["hit"]).alias("at"), F.when((x["hit"] > 0) & (x["value"] >= least), F.concat(a["out"], F.array(span(a, x)))).otherwise(a["out"]).alias("out")),
        lambda a: a["out"],
    )
    return F.when(t.rlike(hint), spans).otherwise(_none(SPAN))


def _pick(index: Column, values: list) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), index + 1)


def _candidates(t: Column, base: Column) -> Column:
    """array<struct<start, end, token, enc>> of runs to test."""
    cut = f"(?s)(.*?)({CANDIDATE}|\\z)"
    part = lambda g: F.regexp_extract_all(t, F.lit(cut), F.lit(g))
    kind = "array<struct<start:int,end:int,token:string>>"
    pairs = F.zip_with(part(1), part(2), lambda g, m: F.struct(F.length(g).alias("gap"), m.alias("token")))
    runs = F.aggregate(
        pairs,
        F.struct(F.lit(0).alias("at"), _none(kind).alias("out")),
        lambda a, x: F.struct(
            (a["at"] + x["gap"] + F.length(x["token"])).alias("at"),
            F.concat(a["out"], F.array(F.struct((a["at"] + x["gap"]).alias("start"), (a["at"] + x["gap"] + F.length(x["token"])).alias("end"), x["token"].alias("token")))).alias("out"),
        ),
        lambda a: a["out"],
    )
    free = F.filter(runs, lambda x: (F.length(x["token"]) > 0) & ~x["token"].rlike("^[0-9]+$") & ~F.exists(base, lambda b: (b["start"] < x["end"]) & (b["end"] > x["start"])))
    enc = lambda tok: reduce(lambda rest, e: F.when(tok.rlike(e[1][1]), F.lit(e[0])).otherwise(rest), reversed(list(enumerate(ENCODINGS))[:-1]), F.lit(len(ENCODINGS) - 1))
    typed = F.transform(free, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["token"].alias("token"), enc(x["token"]).alias("enc")))
    return F.when(t.rlike(CANDIDATE), typed).otherwise(_none("struct<start:int,end:int,token:string,enc:int>"))


def _tested(name: str, df: DataFrame) -> DataFrame:
    """``name`` (candidates) turned into FOUND, one step of the arithmetic per projection."""
    alphabets = [e[2] for e in ENCODINGS]
    col = F.col(name)

    def values(x: Column) -> Column:
        folded = F.when(x["enc"] == 0, F.lower(x["token"])).otherwise(F.translate(x["token"], "-_", "+/"))
        # regexp_extract_all, as split would give an empty last symbol
        return F.transform(F.regexp_extract_all(folded, F.lit("(?s)."), F.lit(0)), lambda c: (F.call_function("instr", _pick(x["enc"], alphabets), c) - 1).cast("double"))

    step1 = F.transform(col, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["enc"].alias("enc"), values(x).alias("v")))

    def sums(x: Column) -> Column:
        v, n = x["v"], F.size(x["v"])
        size = _pick(x["enc"], [float(len(a)) for a in alphabets])
        mid = (size - 1) / 2
        zero = F.lit(0.0)
        # equal pairs: sorted, each symbol adds the length of its run so far
        pairs = F.aggregate(
            F.array_sort(v),
            F.struct(F.lit(-1.0).alias("last"), zero.alias("run"), zero.alias("pairs")),
            lambda a, s: F.struct(s.alias("last"), F.when(s == a["last"], a["run"] + 1).otherwise(zero).alias("run"), (a["pairs"] + F.when(s == a["last"], a["run"] + 1).otherwise(zero)).alias("pairs")),
            lambda a: a["pairs"],
        )
        cuts = [_pick(x["enc"], [float(e[5][k]) for e in ENCODINGS]) for k in range(3)]
        kind_of = lambda s: reduce(lambda a, b: a + b, [(s >= c).cast("int") for c in cuts])
        walk = F.aggregate(
            v,
            F.struct(F.lit(None).cast("double").alias("last"), zero.alias("high"), zero.alias("changes"), zero.alias("serial"), zero.alias("turns")),
            lambda a, s: F.struct(
                s.alias("last"),
                (a["high"] + F.when(s > mid, 1.0).otherwise(0.0)).alias("high"),
                (a["changes"] + F.when((a["last"] > mid) != (s > mid), 1.0).otherwise(0.0)).alias("changes"),
                (a["serial"] + F.coalesce((a["last"] - mid) * (s - mid), zero)).alias("serial"),
                (a["turns"] + F.when(kind_of(a["last"]) != kind_of(s), 1.0).otherwise(0.0)).alias("turns"),
            ),
        )
        return F.struct(x["start"].alias("start"), x["end"].alias("end"), x["enc"].alias("enc"), n.cast("double").alias("n"), size.alias("a"), pairs.alias("pairs"), walk.alias("w"))

    step2 = F.transform(F.col(name), sums)

    def judged(x: Column) -> Column:
        n, a, pairs, w = x["n"], x["a"], x["pairs"], x["w"]
        all_pairs = n * (n - 1) / 2
        chi = a * (2 * pairs + n) / n - n
        z_chi = (chi - (a - 1)) / F.sqrt(2 * (a - 1) * (n - 1) / n)
        high, low = w["high"], n - w["high"]
        runs = 2 * high * low / n + 1
        spread = (runs - 1) * (runs - 2) / (n - 1)
        z_runs = (w["changes"] + 1 - runs) / F.sqrt(spread)
        z_serial = w["serial"] / (F.sqrt(n - 1) * (a * a - 1) / 12)
        even = (high > 0) & (low > 0) & (spread > 0) & (F.abs(z_chi) <= CRITICAL) & (F.abs(z_runs) <= CRITICAL) & (F.abs(z_serial) <= CRITICAL)
        two, three = (_pick(x["enc"], [e[i] for e in ENCODINGS]) for i in (3, 4))
        z_pairs = (all_pairs * two - pairs) / F.sqrt(all_pairs * two * (1 - two) + n * (n - 1) * (n - 2) * (three - two * two))
        often = _pick(x["enc"], [e[6] for e in ENCODINGS])
        z_turns = (w["turns"] - (n - 1) * often) / F.sqrt((n - 1) * often * (1 - often))
        z_text = (z_pairs + z_turns) / math.sqrt(2)
        band = reduce(lambda rest, b: F.when(n < b[1], F.lit(b[0])).otherwise(rest), reversed(list(enumerate(BANDS))), F.lit(len(BANDS)))
        return F.struct(
            x["start"].alias("start"), x["end"].alias("end"), (x["enc"] * (len(BANDS) + 1) + band).cast("int").alias("stratum"),
            F.least(F.greatest(F.floor(z_text * 10), F.lit(0)), F.lit(TOP_BIN)).cast("int").alias("bin"), F.coalesce(even, F.lit(False)).alias("even"),
        )

    # a projection each: what a lambda reads twice is then computed once
    return df.withColumn(name, step1).withColumn(name, step2).withColumn(name, F.transform(F.col(name), judged))


def p_text(bin_: int) -> float:
    """Largest p-value, against natural text, of a candidate in a bin."""
    return 0.5 * math.erfc(bin_ / 10 / math.sqrt(2)) if bin_ else 1.0


def bounds(histogram: list[tuple[int, int, int, int]], fdr: float = FDR) -> dict[int, int]:
    """Stratum to the least bin that is accepted. histogram: (stratum, bin, candidates, of them even).

    Benjamini-Hochberg on binned p-values: all candidates count as tests, those that pass the battery as discoveries.
    """
    out: dict[int, int] = {}
    for stratum in {h[0] for h in histogram}:
        own = sorted((h for h in histogram if h[0] == stratum), key=lambda h: -h[1])
        tests, found = sum(h[2] for h in own), 0
        for _, bin_, _, even in own:
            found += even
            if found and p_text(bin_) * tests <= fdr * found:
                out[stratum] = bin_
    return out


def scan(docs: DataFrame, text: str = "text", fdr: float = FDR, keep_text: bool = True) -> DataFrame:
    """``docs`` with ``spans`` (array of struct start, kind, end; sorted, kind numbered as in KINDS, end exclusive) and the
    counts n_assign, n_access, n_hex, n_random. One pass over the texts, whose findings are written to the shared
    folder; the false-discovery bounds come from a histogram over them."""
    need(docs, text)
    t, base, found = F.col(HIDDEN + "t"), F.col(HIDDEN + "b"), HIDDEN + "f"
    kinds = [("assign", ASSIGN, 1), ("access", ACCESS, 0), ("hex", HEX, 0)]
    spans = F.array_sort(F.concat(*[_matches(t, k, p, HINT[n], g, LEAST[n]) for k, (n, p, g) in enumerate(kinds)]))
    clean = without(docs, *[c for c in ADDED if c != text])
    rows = clean.withColumn(HIDDEN + "t", text_of(text)).withColumn(HIDDEN + "b", spans).withColumn(found, _candidates(t, base))
    rows = _tested(found, rows).drop(HIDDEN + "t", *([] if keep_text else [text]))
    rows = written(rows, "secrets")

    tried = rows.select(F.inline(found))
    histogram = tried.groupBy("stratum", "bin").agg(F.count("*").alias("n"), F.sum(F.col("even").cast("long")).alias("even")).collect()  # bounded: strata times bins
    least = bounds([(r["stratum"], r["bin"], r["n"], r["even"]) for r in histogram], fdr)
    bound = F.array(*[F.lit(least.get(s, TOP_BIN + 1)) for s in range(len(ENCODINGS) * (len(BANDS) + 1))])
    random = F.transform(
        F.filter(F.col(found), lambda x: x["even"] & (x["bin"] >= F.get(bound, x["stratum"]))),
        lambda x: F.struct(x["start"].alias("start"), F.lit(3).alias("kind"), x["end"].alias("end")),
    )
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long")
    return rows.withColumn("spans", F.array_sort(F.concat(base, random))).withColumns({f"n_{n}": count(k) for k, n in enumerate(KINDS)}).drop(HIDDEN + "b", found)


def span_text(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def base_spans(spans: Column) -> Column:
    return F.filter(spans, lambda s: s["kind"] < 3)


def redact(scanned: DataFrame, text: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """``scanned`` with each run of overlapping spans in the text replaced by ``mark``. Texts without spans stay as they are."""
    t = F.col(text)
    piece = lambda a, b: F.substr(t, a + 1, b - a)
    state = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    # a span that starts at or before the last one's end only moves that end
    done = F.aggregate(
        "spans",
        state,
        lambda a, s: F.struct(
            F.greatest(a["at"], s["end"]).alias("at"),
            F.when((s["start"] > a["at"]) | (F.length(a["out"]) == 0), F.concat(a["out"], piece(a["at"], s["start"]), F.lit(mark))).otherwise(a["out"]).alias("out"),
        ),
        lambda a: F.concat(a["out"], piece(a["at"], F.length(t))),
    )
    return scanned.withColumn(text, F.when(F.size("spans") > 0, done).otherwise(t))
