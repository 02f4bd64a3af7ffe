"""Fill-in-the-middle documents: a text is cut at two unit boundaries, and its parts are reordered behind marks.

A unit grammar names classes of characters that cover all characters, and the pairs of neighbouring classes that stay in one unit.
``boundary`` translates it to a regular expression of no width: a place whose left and right neighbour are of classes that don't stay
together. Splitting there keeps every character, so the pieces joined again are the text. Cuts and form follow from the hash of the
document's id alone: the same document is cut alike in every run. Only DataFrame functions, one pass, no shuffle.

Defined cases: null and empty texts have no unit and are ``plain`` (splitting an empty text would give one empty piece, so it is told
apart); a text that contains a mark is ``plain``, since it couldn't be rebuilt; very long texts are cut whole; a null id
counts as the empty string; rows that repeat an id are cut at the same numbers, repeated rows stay rows; columns of the input
named as one of the results are replaced, others pass through; an empty table gives an empty result.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dendra.llm.common import HIDDEN, need, text_of, without

PREFIX, SUFFIX, MIDDLE = MARKS = ("<P>", "<S>", "<M>")
#: Of a hundred documents, how many are reordered, and how many of those have the suffix first.
REORDERED, SUFFIX_FIRST = 90, 20
SALT = "1"


class Grammar(NamedTuple):
    """classes: name to the inside of a character class; together they hold every character once. joined: (left, right) that share a unit."""

    classes: dict[str, str]
    joined: list[tuple[str, str]]


#: letters: runs of A-Z and a-z, all else alone. words: runs of words and runs of white space. lines: up to and with the line feed.
#: characters: each alone. tokens: runs of letters, of digits and of spaces, all else alone.
GRAMMARS = {
    "letters": Grammar({"letter": "A-Za-z", "other": "^A-Za-z"}, [("letter", "letter")]),
    "words": Grammar({"space": r"\x20\x09-\x0D", "word": r"^\x20\x09-\x0D"}, [("space", "space"), ("word", "word")]),
    "lines": Grammar({"feed": r"\n", "text": r"^\n"}, [("text", "text"), ("text", "feed")]),
    "characters": Grammar({"any": r"\s\S"}, []),
    "tokens": Grammar({"letter": "A-Za-z", "digit": "0-9", "space": r"\x20", "other": r"^A-Za-z0-9\x20"}, [("letter", "letter"), ("digit", "digit"), ("space", "space")]),
}


def boundary(grammar: Grammar) -> str:
    """The regular expression, of no width, of the places between units. It looks at one character on each side, so neither
    end of a text is such a place."""
    out = []
    for left, inside in grammar.classes.items():
        apart = [c for right, c in grammar.classes.items() if (left, right) not in grammar.joined]
        if apart:
            out.append(f"(?<=[{inside}])(?:" + "|".join(f"(?=[{c}])" for c in apart) + ")")
    return "|".join(out) or "(?!)"


def units(text: Column, grammar: str = "letters") -> Column:
    """The text's units, in order; none for an empty text."""
    if grammar not in GRAMMARS:
        raise ValueError(f"no unit grammar {grammar}; there are {sorted(GRAMMARS)}")
    return F.when(text == "", F.array().cast("array<string>")).otherwise(F.split(text, boundary(GRAMMARS[grammar]), -1))


def draws(key: Column, salt: str = SALT) -> list[Column]:
    """Four whole numbers below 2^32 from the SHA-256 of salt:key."""
    digest = F.sha2(F.concat(F.lit(salt + ":"), F.coalesce(key.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)]


def reorder(docs: DataFrame, id_col: str = "doc_id", text: str = "text", grammar: str = "letters", keep: list[str] | None = None, salt: str = SALT, reordered: int = REORDERED, suffix_first: int = SUFFIX_FIRST) -> DataFrame:
    """The columns of ``docs`` (or those of ``keep``) with ``n_units``, ``form`` (plain, psm or spm), ``prefix``, ``middle`` and
    ``suffix`` (null if plain) and ``output``.

    The prefix ends after the smaller of two draws, each 0 to n units, the middle after the larger. ``reordered`` of a hundred
    documents have a form other than plain, ``suffix_first`` of a hundred of those spm.
    """
    need(docs, id_col, text)
    h = [HIDDEN + f"h{i}" for i in range(4)]
    t, u, lo, hi = (HIDDEN + x for x in ("text", "units", "lo", "hi"))
    own = ["n_units", "form", "prefix", "middle", "suffix", "output"]
    kept = [c for c in (docs.columns if keep is None else keep) if c not in own]
    cut = docs.withColumns({t: text_of(text)} | dict(zip(h, draws(F.col(id_col), salt)))).withColumn(u, units(F.col(t), grammar))
    n = F.size(u).cast("long")
    a, b = F.col(h[0]) % (n + 1), F.col(h[1]) % (n + 1)
    marked = F.col(t).contains(PREFIX) | F.col(t).contains(SUFFIX) | F.col(t).contains(MIDDLE)
    plain = (F.col(t) == "") | marked | (F.col(h[2]) % 100 >= reordered)
    form = F.when(plain, "plain").when(F.col(h[3]) % 100 < suffix_first, "spm").otherwise("psm")
    cut = without(cut, *own).withColumns({"n_units": n, lo: F.least(a, b).cast("int"), hi: F.greatest(a, b).cast("int"), "form": form})
    part = lambda start, length: F.when(F.col("form") != "plain", F.array_join(F.slice(u, start, length), ""))
    cut = cut.withColumns({
        "prefix": part(F.lit(1), F.col(lo)), "middle": part(F.col(lo) + 1, F.col(hi) - F.col(lo)), "suffix": part(F.col(hi) + 1, F.size(u) - F.col(hi)),
    })
    parts = {PREFIX: F.col("prefix"), SUFFIX: F.col("suffix"), MIDDLE: F.col("middle")}
    in_order = lambda *marks: F.concat(*[x for m in marks for x in (F.lit(m), parts[m])])
    output = F.when(F.col("form") == "psm", in_order(PREFIX, SUFFIX, MIDDLE)).when(F.col("form") == "spm", in_order(SUFFIX, PREFIX, MIDDLE)).otherwise(F.col(t))
    return cut.withColumn("output", output).select(*kept, *own)


def restored(output: Column, form: Column) -> Column:
    """The text, from the output and its form. A reordered text holds no mark, so the marks cut the output into nothing and its three parts;
    a plain output is the text, marks and all."""
    parts = F.split(output, "|".join(MARKS), -1)
    at = lambda i: F.element_at(parts, i)
    return F.when(form == "psm", F.concat(at(2), at(4), at(3))).when(form == "spm", F.concat(at(3), at(4), at(2))).otherwise(output)
