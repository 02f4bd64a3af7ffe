"""Quality rules as a ledger of failure bits (DataFrame functions only).

``build_ledger`` evaluates every rule once, one bit per failed rule beside the measurements; ``store_ledger``
writes that down. Policies are versioned bit masks, so a new policy or an ablation reads the
stored ledger, never the texts again.

Defined cases: a null text has no words, so it fails ``too_few_words``; so does an empty one. Rows are
judged alone: repeated rows get equal results and none is merged. Null ids pass through. Very long texts
are judged whole; a row's words and windows are held at once. An empty table gives an empty ledger. Input columns that have the name of a ledger column are replaced.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dendra.llm.common import HIDDEN, SPACES, need, text_of, without, written

SYMBOLS = "#*$%&|<>"
WINDOW = 5
MEASURES = ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_bangs"]


@dataclass(frozen=True)
class Rule:
    """``fails`` gets a column by measurement name. Bounds are whole numbers, so no engine rounds."""

    name: str
    bit: int
    fails: Callable[[Callable[[str], Column]], Column]

    @property
    def mask(self) -> int:
        return 1 << self.bit


RULES = (
    Rule("too_few_words", 0, lambda m: m("n_words") < 10),
    Rule("repeated_passages", 1, lambda m: 100 * m("n_repeat_words") > 20 * m("n_words")),
    Rule("symbol_heavy", 2, lambda m: 10 * m("n_symbols") > m("n_words")),
    Rule("duplicate_lines", 3, lambda m: 2 * m("n_dup_lines") > m("n_lines")),
    Rule("short_words", 4, lambda m: m("word_chars") < 2 * m("n_words")),
    Rule("long_words", 5, lambda m: m("word_chars") > 15 * m("n_words")),
    Rule("shouting", 6, lambda m: 2 * m("n_bangs") > m("n_words")),
)
BIT = {r.name: r.mask for r in RULES}
ALL_BITS = reduce(int.__or__, BIT.values())


@dataclass(frozen=True)
class Policy:
    """A document is kept if it fails no rule of ``hard`` and at most ``tolerated`` rules of ``soft``."""

    version: str
    hard: int
    soft: int = 0
    tolerated: int = 0


POLICIES = {
    "base-1": Policy("base-1", BIT["too_few_words"] | BIT["repeated_passages"]),
    "prose-1": Policy("prose-1", ALL_BITS),
    "lenient-1": Policy("lenient-1", BIT["too_few_words"] | BIT["repeated_passages"], ALL_BITS & ~3, 1),
}


def _measured(docs: DataFrame, text: str) -> DataFrame:
    """Adds the measurements. Each helper column stands in a projection of its own, as lambdas share no work."""
    h = lambda name: HIDDEN + name
    count = lambda e: e.cast("long")
    t = F.col(h("t"))
    words = F.when(F.col(h("s")) == "", F.array().cast("array<string>")).otherwise(F.split(F.col(h("s")), r"[\x20\x09-\x0D]+"))
    n = F.size(F.col(h("h")))
    shingles = F.when(
        n >= WINDOW,
        F.transform(F.sequence(F.lit(0), n - WINDOW), lambda i: F.xxhash64(*[F.get(F.col(h("h")), i + k) for k in range(WINDOW)])),
    ).otherwise(F.array().cast("array<bigint>"))
    g, s = F.col(h("g")), F.col(h("o"))
    ordered = F.when(F.size(F.array_distinct(g)) < F.size(g), F.sort_array(F.transform(g, lambda x, i: F.struct(x.alias("x"), i.alias("i")))))
    again = F.array_sort(
        F.transform(
            F.filter(s, lambda e, k: (e["x"] == F.get(s, k - 1)["x"]) | F.coalesce(e["x"] == F.get(s, k + 1)["x"], F.lit(False))),
            lambda e: e["i"],
        )
    )
    p = F.col(h("p"))
    covered = F.aggregate(
        p,
        F.struct(F.lit(0).alias("n"), F.lit(-WINDOW).alias("at")),
        lambda a, i: F.struct((a["n"] + F.least(F.lit(WINDOW), i - a["at"])).alias("n"), i.alias("at")),
        lambda a: a["n"],
    )
    lines = F.filter(F.split(t, "\n"), lambda x: F.btrim(x, F.lit(SPACES)) != "")
    return (
        docs.withColumn(h("t"), text_of(text))
        .withColumn(h("s"), F.btrim(t, F.lit(SPACES)))
        .withColumn(h("w"), words)
        .withColumn(h("h"), F.transform(F.col(h("w")), lambda w: F.xxhash64(w)))
        .withColumn(h("g"), shingles)
        .withColumn(h("o"), ordered)
        .withColumn(h("p"), again)
        .withColumn(h("l"), lines)
        .withColumns(
            {
                "n_words": count(n),
                "word_chars": count(F.length(F.concat_ws("", F.col(h("w"))))),
                "n_symbols": count(F.length(t) - F.length(F.translate(t, SYMBOLS, ""))),
                "n_lines": count(F.size(F.col(h("l")))),
                "n_dup_lines": count(F.size(F.col(h("l"))) - F.size(F.array_distinct(F.col(h("l"))))),
                "n_repeat_words": count(F.coalesce(covered, F.lit(0))),
                "n_bangs": count(F.length(t) - F.length(F.replace(t, F.lit("!"), F.lit("")))),
            }
        )
        .drop(*[h(x) for x in "tswhgopl"])
    )


def build_ledger(docs: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``docs`` with the measurements and ``fail_bits`` (long; bit k set: rule k failed). No shuffle."""
    need(docs, text)
    measured = _measured(without(docs, *[c for c in [*MEASURES, "fail_bits"] if c != text]), text)
    bits = [F.when(r.fails(F.col), F.lit(r.mask)).otherwise(F.lit(0)).cast("long") for r in rules]
    # A filter on the bits must not be pushed below them: the optimizer would copy every measurement into it, many times
    # over. It stops at a column that it takes for not deterministic; this condition always holds.
    stop = F.monotonically_increasing_id() >= 0
    return measured.withColumn("fail_bits", F.when(stop, reduce(lambda a, b: a.bitwiseOR(b), bits)))


def store_ledger(docs: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The ledger (with the columns ``keep`` of ``docs``, all if None), evaluated once and written to the shared folder; policies and
    ablations read it from there."""
    ledger = build_ledger(docs, text)
    return written(ledger if keep is None else ledger.select(*keep, *MEASURES, "fail_bits"), "ledger")


def verdict(policy: Policy, bits: Column | None = None) -> Column:
    bits = F.col("fail_bits") if bits is None else bits
    passed = bits.bitwiseAND(F.lit(policy.hard)) == 0
    return passed & (F.bit_count(bits.bitwiseAND(F.lit(policy.soft))) <= policy.tolerated) if policy.soft else passed


def apply_policy(ledger: DataFrame, policy: Policy | str) -> DataFrame:
    """``ledger`` with ``kept`` and ``policy``: reads the bits alone."""
    policy = POLICIES[policy] if isinstance(policy, str) else policy
    return without(ledger, "kept", "policy").withColumns({"kept": verdict(policy), "policy": F.lit(policy.version)})


def ablate(ledger: DataFrame, policy: Policy | str, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """One row per rule: how many documents fail it, how many only it rejects, and how many stay without it.

    The ledger is first counted by distinct bit pattern (at most 2 to the number of rules), so the
    per-rule part handles a bounded number of rows.
    """
    policy = POLICIES[policy] if isinstance(policy, str) else policy
    patterns = ledger.groupBy("fail_bits").agg(F.count("*").alias("n"))
    tried = F.inline(F.array(*[F.struct(F.lit(r.name).alias("rule"), F.lit(r.mask).cast("long").alias("mask")) for r in rules]))
    rows = patterns.select("fail_bits", "n", tried)
    without_rule = F.col("fail_bits").bitwiseAND(F.bitwise_not("mask"))
    kept, kept_without = verdict(policy), verdict(policy, without_rule)
    total = lambda cond: F.sum(F.when(cond, F.col("n")).otherwise(0)).alias
    return rows.groupBy("rule", "mask").agg(
        F.sum("n").alias("n_docs"),
        total(F.col("fail_bits").bitwiseAND(F.col("mask")) != 0)("n_failed"),
        total(kept_without & ~kept)("n_only_this_rule"),
        total(kept_without)("n_kept_without"),
        F.bit_or("fail_bits").alias("bits_seen"),
        F.bit_and("fail_bits").alias("bits_in_all"),
    )
