"""URL filter: host and path rules, and logistic regression on hashed character n-grams for the rest.

Rules are judged with DataFrame functions; the longest that fits wins. Every url also gets the model's
probability of being unwanted; its verdict counts where no rule fits. The model is trained on the driver from a
small labelled table by full-batch gradient descent, so equal tables give equal weights. N-grams of host and path have weights of their own. ``max_rows`` bounds
the labelled rows that are read; the weights have a fixed size.

Defined cases: a null url, or one without ``://``, has an empty host and path, fits no rule and is judged from no n-grams:
it is allowed. Repeated rows get equal results. Of two rules of equal length that fit, the first by name counts. Very long urls are judged
whole. Input columns named like an added one are replaced, others pass through. An empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dendra.llm.common import need, without

BITS = 14
SIZES = (3, 4, 5)
STEPS = 400
RATE = 8.0
DECAY = 2e-5
MAX_ROWS = 20_000
ADDED = ["host", "path", "rule", "verdict", "p_block"]


@dataclass(frozen=True)
class Rule:
    host: str
    path: str
    verdict: str

    @property
    def name(self) -> str:
        return self.host + self.path


RULES = (
    Rule("org", "/", "allow"),
    Rule("example.org", "/es/", "block"),
    Rule("example.org", "/en/1", "block"),
    Rule("com", "/fr/", "allow"),
    Rule("com", "/de/", "block"),
)

# Words of ordinary and of unwanted sites, from which the small labelled table is made that stands in where no other is given.
WANTED = """
library museum archive school college campus clinic hospital council townhall county parish news daily herald gazette tribune journal review
weather forecast harbour river lake mountain valley forest garden gardeners rose heron birdwatch nature wildlife ocean island bakery kitchen recipes
bread cheese coffee tea wine market grocer farmer orchard pottery woodwork knitting quilting craft paper print books authors poetry drama theatre
opera orchestra choir jazz guitar piano cinema film photo gallery painting design studio architecture bridge railway ferry airport cycling hiking
climbing sailing rowing tennis chess football athletics history rome medieval law courts notary census statistics tables atlas maps travel spain
physics chemistry biology algebra geometry maths astronomy moon planets robotics software toolbox code compiler linux printers help docs guide wiki
forum notes essays thinkers philosophy language grammar dictionary energy solar water climate housing insurance savings union charity volunteers
""".split()
UNWANTED = """
casinos roulette blackjack jackpot slotmachine poker pokies betting bookie sportsbet wager gamble gambling lottery winner winnings bingo
pill pharma pharmacy viagra cialis rxmeds steroids slimming weightloss dietpill porn porno xxx sexcam sexchat escorts hookup nude erotic fetish
adultery adults hotgirls adserver adserving advert adclick popads popunder banners trackers tracking clicktrack clickbait retarget affiliate
spammer spammy spambot linkfarms backlinks seoboost buyfollowers buylikes crack keygen warez torrents nulled serials cheats hackz
cheapest cheaper replica fakebags knockoff discountpills payday fastloan quickcash easymoney getrich earnfast giveaway freebie freemoney prizes
phishing malware scam fraudster hoax pyramid ponzi
""".split()
_SITES, _ENDS, _SECTIONS = ("www.", "m.", "blog.", ""), (".com", ".net", ".org", ".info", ".site.com", ".host.net"), ("en", "fr", "de", "es", "post", "a", "page")
SEED_ROWS = 6
#: Ordinary hosts with names that mean nothing, as many sites have.
SEED_NAMES = 700
#: Share of the path's evidence against the host's.
PATH_SHARE = 0.25


def seeds() -> list[tuple[str, int]]:
    """The labelled table: SEED_ROWS urls per word. Ordinary sites have one or two ordinary words in the host, unwanted ones an
    unwanted word, mostly with another of either kind; prefixes, endings and paths are alike, so they tell nothing. SEED_NAMES ordinary
    hosts have made-up names."""
    rng, rows = np.random.Generator(np.random.PCG64(1)), []
    pick = lambda words: words[int(rng.integers(len(words)))]
    path = lambda: f"/{pick(_SECTIONS)}/{int(rng.integers(10_000))}{pick(('', '/', '.html'))}"
    for label, words in ((0, WANTED), (1, UNWANTED)):
        for word in words:
            for _ in range(SEED_ROWS):
                other = pick(UNWANTED) if label and rng.random() < 0.3 else pick(WANTED)
                name = [word] if rng.random() < 0.3 else [word, other] if rng.random() < 0.5 else [other, word]
                host = pick(_SITES) + pick(("", "-", "-")).join(name) + pick(("", "", "4u", "24", "s")) + pick(_ENDS)
                rows.append((f"http://{host}{path()}", label))
    for _ in range(SEED_NAMES):
        name = "".join(pick(("th", "st", "br", *"aeioubcdfghlmnprstvw")) for _ in range(int(rng.integers(3, 8))))
        rows.append((f"http://{pick(_SITES)}{name}{pick(_ENDS)}{path()}", 0))
    return rows


def parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url; both empty without ``://``."""
    url = F.coalesce(url.cast("string"), F.lit(""))
    rest = F.when(F.instr(url, "://") > 0, F.substr(url, F.instr(url, "://") + 3)).otherwise("")
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), upper, upper.lower()), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: tuple[Rule, ...]) -> Column:
    """The longest rule that fits (struct of name and verdict), else null; of equally long ones the first by name."""
    found = None
    for r in sorted(rules, key=lambda r: (-len(r.name), r.name)):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        value = F.struct(F.lit(r.name).alias("name"), F.lit(r.verdict).alias("verdict"))
        found = F.when(fits, value) if found is None else found.when(fits, value)
    return F.lit(None).cast("struct<name:string,verdict:string>") if found is None else found


def split_url(url: str) -> tuple[str, str]:
    """The same host and path outside Spark."""
    rest = url.partition("://")[2]
    cut = min((i for c in "/?#" if (i := rest.find(c)) >= 0), default=len(rest))
    host, tail = rest[:cut], rest[cut:]
    end = min((i for c in "?#" if (i := tail.find(c)) >= 0), default=len(tail))
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), tail[:end]


def grams(text: str) -> np.ndarray:
    """Hashed n-grams of one string, repeats included."""
    data = text.encode()
    return np.array([zlib.crc32(data[i : i + n]) for n in SIZES for i in range(len(data) - n + 1)], np.int64) & ((1 << BITS) - 1)


def features(host: str, path: str) -> tuple[np.ndarray, np.ndarray]:
    """Hashed n-grams of host and path apart: ``^`` and ``$`` mark the host's ends, ``>`` the path's start."""
    return (grams(f"^{host}$"), grams(f">{path}")) if host or path else (np.zeros(0, np.int64),) * 2


@dataclass
class Classifier:
    """Host and path have weights of their own, and each is scaled by its own length, so a long path can't drown a host."""

    host: np.ndarray
    path: np.ndarray
    bias: float

    def probability(self, hosts: list[str], paths: list[str]) -> np.ndarray:
        """Of being unwanted. Each distinct host or path is hashed once."""
        seen: dict[tuple[int, str], float] = {}

        def part(which: int, text: str) -> float:
            key = (which, text)
            if key not in seen:
                g = grams(text)
                seen[key] = float((self.path if which else self.host)[g].sum()) / np.sqrt(max(1, len(g))) * (PATH_SHARE if which else 1)
            return seen[key]

        out = np.zeros(len(hosts))
        for i, (h, p) in enumerate(zip(hosts, paths)):
            if h or p:
                out[i] = 1 / (1 + np.exp(-(self.bias + part(0, f"^{h}$") + part(1, f">{p}"))))
        return out


def train(labelled: list[tuple[str, int]]) -> Classifier:
    """Logistic regression on length-normalised n-gram counts by accelerated gradient descent; classes weigh alike."""
    rows = [(features(*split_url(u)), y) for u, y in labelled if u]
    y = np.array([r[1] for r in rows], float)
    if not len(rows) or y.min() == y.max():
        raise ValueError("both classes are needed")
    n, size = len(rows), 1 << BITS
    at = np.concatenate([np.repeat(np.arange(n), [len(r[0][k]) for r in rows]) for k in (0, 1)])
    cell = np.concatenate([np.concatenate([r[0][k] for r in rows]) + k * size for k in (0, 1)])
    value = np.concatenate([np.repeat([(PATH_SHARE if k else 1) / np.sqrt(max(1, len(r[0][k]))) for r in rows], [len(r[0][k]) for r in rows]) for k in (0, 1)])
    used, cell = np.unique(cell, return_inverse=True)
    weight = np.where(y == 1, 0.5 / y.sum(), 0.5 / (n - y.sum()))
    w = ahead = np.zeros(len(used) + 1)  # the last one is the bias
    for step in range(STEPS):
        z = ahead[-1] + np.bincount(at, weights=ahead[cell] * value, minlength=n)
        error = weight * (1 / (1 + np.exp(-z)) - y)
        slope = np.append(np.bincount(cell, weights=error[at] * value, minlength=len(used)) + DECAY * ahead[:-1], error.sum())
        new = ahead - RATE * slope
        w, ahead = new, new + step / (step + 3) * (new - w)
    whole = np.zeros(2 * size)
    whole[used] = w[:-1]
    return Classifier(whole[:size], whole[size:], float(w[-1]))


@lru_cache(maxsize=1)
def default_model() -> Classifier:
    return train(seeds())


def sampled(labelled: DataFrame, max_rows: int) -> list[tuple[str, int]]:
    """At most ``max_rows`` labelled rows, as many of each class where there are: those with the least hash of their url."""
    need(labelled, "url", "label")
    rows = labelled.where("url IS NOT NULL AND label IS NOT NULL").select(F.col("url").cast("string").alias("url"), F.col("label").cast("int").alias("label"))
    order = F.xxhash64("url")
    return [(r["url"], r["label"]) for y in (0, 1) for r in rows.where(F.col("label") == y).orderBy(order, "url").limit(max_rows // 2).collect()]


def judge(pages: DataFrame, url: str = "url", labelled: DataFrame | None = None, rules: tuple[Rule, ...] = RULES, threshold: float = 0.5, max_rows: int = MAX_ROWS) -> DataFrame:
    """``pages`` with host, path, rule, verdict ('allow' or 'block') and p_block. No shuffle.

    labelled: (url, label 0 or 1); at most ``max_rows`` rows are taken, half of each class, by a hash of the url.
    """
    need(pages, url)
    trained = default_model() if labelled is None else train(sampled(labelled, max_rows))
    model = pages.sparkSession.sparkContext.broadcast(trained)  # twice 2**BITS weights
    host, path = parts(F.col(url))
    split = without(pages, *[c for c in ADDED if c != url]).withColumns({"host": host, "path": path})
    split = split.withColumn("rule", rule_of(F.col("host"), F.col("path"), rules))

    @F.pandas_udf("double")
    def p_block(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for h, p in batches:
            yield pd.Series(model.value.probability(h.tolist(), p.tolist()))

    scored = split.withColumn("p_block", p_block("host", "path"))
    own = F.when(F.col("p_block") >= threshold, "block").otherwise("allow")
    return scored.withColumns({"verdict": F.coalesce("rule.verdict", own), "rule": F.col("rule.name")})
