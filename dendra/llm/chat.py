"""Chat formatting with a loss mask aligned to token offsets.

A conversation is rendered whole, encoded once with offsets, and the sorted spans of its turns are
intersected with the token spans by binary search.

Template: ``<s>`` and then the turns in order:
  user       ``[INST]`` text ``[/INST]``
  assistant  text ``</s>``
  system     ``<<SYS>>`` text ``<</SYS>>``
  any other  ``[ROLE]`` role ``[/ROLE]`` text ``</s>``
Texts and role names are escaped: a backslash is doubled, and every control string gets a backslash behind
its first character, so a rendered text holds no control string and the escape can be undone exactly.
Control strings are added to the tokenizer as tokens of their own, so no token reaches over a turn's edge.

Defined cases: rows of a conversation are ordered by turn, then role, then text (null first), so ties and
repeated rows have one result; a null text or role is empty; each row with a null conversation id is a
conversation of its own, so any number of them spreads over the tasks; an empty table gives an empty result. Other columns,
whatever their names, are ignored. Very long texts are encoded whole. One conversation is held at a time.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dendra.llm import byte_bpe
from dendra.llm.common import HIDDEN, need, whole_ids

CONTROLS = ["<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "[ROLE]", "[/ROLE]"]
_CONTROL = re.compile("|".join(map(re.escape, CONTROLS)))
_TO_ESCAPE = re.compile(r"\\|" + _CONTROL.pattern)
_ESCAPED = re.compile(r"\\(.)", re.S)
LEARNED_ROLES = ("assistant",)
_EDGES = {"user": ("[INST]", "[/INST]"), "assistant": ("", "</s>"), "system": ("<<SYS>>", "<</SYS>>")}
OUT = "conv_id long, formatted string, token_ids array<int>, loss_spans array<struct<start:int,end:int>>, loss_mask array<boolean>"


def escape(text: str) -> str:
    return _TO_ESCAPE.sub(lambda m: "\\\\" if m[0] == "\\" else f"{m[0][0]}\\{m[0][1:]}", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


@dataclass
class Rendered:
    text: str
    #: (start, end, role) of each turn's escaped text, in order.
    spans: list[tuple[int, int, str]]


def render(turns: list[tuple[str, str]]) -> Rendered:
    parts, at, spans = ["<s>"], 3, []
    for role, text in turns:
        before, after = _EDGES.get(role, (f"[ROLE]{escape(role)}[/ROLE]", "</s>"))
        body = escape(text)
        spans.append((at + len(before), at + len(before) + len(body), role))
        parts += [before, body, after]
        at += len(before) + len(body) + len(after)
    return Rendered("".join(parts), spans)


def parse(formatted: str) -> list[tuple[str, str]]:
    """The turns, read back from a rendered conversation; ``render`` undone."""
    cuts = list(_CONTROL.finditer(formatted))
    if not cuts or cuts[0][0] != "<s>" or cuts[0].start():
        raise ValueError("not a rendered conversation")
    end_of = {"[INST]": "[/INST]", "<<SYS>>": "<</SYS>>"}
    role_of = {"[INST]": "user", "<<SYS>>": "system"}
    turns, at, i = [], 3, 1
    while i < len(cuts):
        c = cuts[i]
        if c[0] in end_of and c.start() == at:
            close = cuts[i + 1]
            if close[0] != end_of[c[0]]:
                raise ValueError(f"{c[0]} at {at} is closed by {close[0]}")
            turns.append((role_of[c[0]], unescape(formatted[c.end() : close.start()])))
            at, i = close.end(), i + 2
        elif c[0] == "[ROLE]" and c.start() == at:
            close, end = cuts[i + 1], cuts[i + 2]
            turns.append((unescape(formatted[c.end() : close.start()]), unescape(formatted[close.end() : end.start()])))
            at, i = end.end(), i + 3
        elif c[0] == "</s>":
            turns.append(("assistant", unescape(formatted[at : c.start()])))
            at, i = c.end(), i + 1
        else:
            raise ValueError(f"{c[0]} at {c.start()} is out of place")
    if at != len(formatted):
        raise ValueError("text after the last turn")
    return turns


def loss_tokens(spans: list[tuple[int, int, str]], starts: np.ndarray, ends: np.ndarray, learned: tuple[str, ...] = LEARNED_ROLES) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """A flag per token, and per learned turn the characters under its flagged tokens, cut to the turn.

    starts, ends: of the tokens, each sorted. The tokens of a turn are a run whose ends two binary searches find. What a tokenizer
    drops between two tokens of the run (white space, with some) counts as under them.
    """
    mask = np.zeros(len(starts), bool)
    own = [(a, b) for a, b, role in spans if role in learned and a < b]
    if not own:
        return mask, []
    first = np.searchsorted(ends, [a for a, _ in own], "right").tolist()
    last = np.searchsorted(starts, [b for _, b in own], "left").tolist()
    covered = []
    for (a, b), i, j in zip(own, first, last):
        if i < j:
            mask[i:j] = True
            covered.append((max(a, int(starts[i])), min(b, int(ends[j - 1]))))
    return mask, covered


def turns_digest(turns: list[tuple[str, str]]) -> str:
    return hashlib.sha256("".join(f"{role}\n{text}\n" for role, text in turns).encode("utf-8", "surrogatepass")).hexdigest()


def _conversations(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int | None, list[tuple[str, str]]]]:
    now, turns, any_ = None, [], False
    for batch in batches:
        for c, r, t in zip(*(batch.column(k).to_pylist() for k in ("conv_id", "role", "text"))):
            if any_ and (c != now or c is None):
                yield now, turns
                turns = []
            now, any_ = c, True
            turns.append((r or "", t or ""))
    if any_:
        yield now, turns


#: Characters of rendered conversations after which a batch is handed on.
BATCH_CHARS = 1 << 20


def _lists(values: list, kind: pa.DataType) -> pa.Array:
    """A list column of ``values`` (arrays or lists), made of one buffer."""
    ends = np.zeros(len(values) + 1, np.int32)
    np.cumsum([len(v) for v in values], out=ends[1:])
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(values) if len(values) else [], kind))


def format_chats(conversations: DataFrame, tokenizer_path: str | None = None, learned: tuple[str, ...] = LEARNED_ROLES) -> DataFrame:
    """One row per conversation: the rendered text, its token ids, a loss flag per token and the loss characters' spans.

    Needs conv_id, turn, role and text; other columns are ignored. One shuffle, by conversation.
    """
    need(conversations, "conv_id", "turn", "role", "text")
    whole_ids(conversations, "conv_id")
    lone = HIDDEN + "lone"
    rows = conversations.select("conv_id", "turn", "role", "text", F.when(F.col("conv_id").isNull(), F.monotonically_increasing_id()).alias(lone))
    rows = rows.selectExpr("cast(conv_id AS long) AS conv_id", "turn", "cast(role AS string) AS role", "cast(text AS string) AS text", lone)
    rows = rows.repartition("conv_id", lone).sortWithinPartitions("conv_id", "turn", "role", "text").drop(lone)

    def flush(rows: list[tuple]) -> pa.RecordBatch:
        ids, texts, tokens, spans, masks = zip(*rows)
        edges = np.array([x for s in spans for x in s], np.int32).reshape(-1, 2)
        sides = pa.StructArray.from_arrays([pa.array(edges[:, 0]), pa.array(edges[:, 1])], names=["start", "end"])
        ends = np.zeros(len(spans) + 1, np.int32)
        np.cumsum([len(s) for s in spans], out=ends[1:])
        return pa.RecordBatch.from_arrays(
            [pa.array(ids, pa.int64()), pa.array(texts, pa.string()), _lists(tokens, pa.int32()), pa.ListArray.from_arrays(pa.array(ends), sides), _lists(masks, pa.bool_())],
            names=["conv_id", "formatted", "token_ids", "loss_spans", "loss_mask"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = byte_bpe.load(tokenizer_path, tuple(CONTROLS))
        out, chars = [], 0
        for conv, turns in _conversations(batches):
            done = render(turns)
            ids, starts, ends = bpe.spans(done.text)
            mask, spans = loss_tokens(done.spans, starts, ends, learned)
            out.append((conv, done.text, ids.astype(np.int32), spans, mask))
            chars += len(done.text)
            if chars >= BATCH_CHARS:
                yield flush(out)
                out, chars = [], 0
        if out:
            yield flush(out)

    return rows.mapInArrow(run, OUT)


def read_back(formatted: DataFrame) -> DataFrame:
    """What the formatted rows hold, from the rendered text and the loss spans alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = []
            for conv, text, spans in zip(*(c.to_pylist() for c in batch.columns)):
                turns = parse(text)
                loss = unescape("".join(text[s["start"] : s["end"]] for s in spans))
                got.append((conv, len(turns), turns_digest(turns), len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(text)))
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*got) if got else [[]] * 6, kinds)], names=names)

    return formatted.select("conv_id", "formatted", "loss_spans").mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
