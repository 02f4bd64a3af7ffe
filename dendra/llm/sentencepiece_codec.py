"""SentencePiece encoding and decoding on the tokenizers library.

The model file (a protobuf) is parsed here; from it come the normaliser, the metaspace marker, the pieces with their
scores and the byte fallback of a ``tokenizers`` tokenizer. Unigram models keep their scores; for BPE models the merges are
rebuilt from the pieces: every split of a piece into two pieces, by falling score.

Where no piece holds a marker behind another character, a text may be cut in front of each run of markers without
changing its pieces; then the tokenizer splits there, and each distinct word is encoded once per worker.

Parity: with ``check=True`` (the default) a worker compares its tokenizer with the sentencepiece library on PROBES before its
first batch and raises if any ids differ.

Defined cases: a null text has null ids; an empty text has none and decodes to an empty text. A marker character in a text
decodes to a space, as in the library itself, and where the model says so, so do the characters that its normaliser changes.
Control pieces in a text (like ``</s>``) are ordinary characters. Repeated rows and null ids are rows like any other.
Very long texts are encoded whole, cut in front of runs of markers where that changes nothing. Columns of the input named ``piece_ids`` or ``decoded`` are replaced, others
pass through. An empty table gives an empty result.
"""

from __future__ import annotations

import os
import struct
from collections.abc import Iterator
from dataclasses import dataclass, field
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from dendra.llm.common import need, without

MODEL = "piece_bpe_32k.model"
MARK = "▁"
UNIGRAM, BPE = 1, 2
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = range(1, 7)
#: Threads that a worker spreads a batch over; as many tasks run beside it, so more threads than this only wait for cores.
THREADS = 2
#: Pieces of text whose ids a worker remembers; it starts anew beyond that.
WORDS = 1 << 19
#: Bytes of text encoded at once.
BATCH_CHARS = 1 << 18
PROBES = [
    "", " ", "  ", "a", " a", "a ", "Hello world", "Hello  world", "a   b    c", "tab\there\nline\r\n", "café naïve über", "日本語 中文",
    "\U0001f600 emoji ‍ x", "1234567890 3.14", "</s> <s> <unk> <0x0A>", "MixedCASE under_score kebab-case", "x" * 50, " " * 20 + "y", "▁marker", "\u0000nul", "tionst thereaing,\nPUNCT!!! ($#@)",
]


@dataclass
class Model:
    pieces: list[tuple[str, float, int]] = field(default_factory=list)
    kind: int = UNIGRAM
    byte_fallback: bool = False
    unk_id: int = 0
    charsmap: bytes = b""
    dummy_prefix: bool = True
    squeeze_spaces: bool = True
    escape_spaces: bool = True


def _varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        byte = data[at]
        at += 1
        value |= (byte & 127) << shift
        shift += 7
        if byte < 128:
            return value, at


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    at = 0
    while at < len(data):
        key, at = _varint(data, at)
        wire = key & 7
        if wire == 0:
            value, at = _varint(data, at)
        else:
            size, at = (8, at) if wire == 1 else (4, at) if wire == 5 else _varint(data, at)
            value, at = data[at : at + size], at + size
        yield key >> 3, value


def parse_model(data: bytes) -> Model:
    """Field numbers are those of the public sentencepiece_model.proto."""
    m = Model()
    for number, value in _fields(data):
        if number == 1:
            piece = dict(_fields(value))
            m.pieces.append((piece.get(1, b"").decode(), struct.unpack("<f", piece[2])[0] if 2 in piece else 0.0, piece.get(3, NORMAL)))
        elif number == 2:
            trainer = dict(_fields(value))
            m.kind, m.byte_fallback, m.unk_id = trainer.get(3, UNIGRAM), bool(trainer.get(35, 0)), trainer.get(40, 0)
        elif number == 3:
            norm = dict(_fields(value))
            m.charsmap, m.dummy_prefix = norm.get(2, b""), bool(norm.get(3, 1))
            m.squeeze_spaces, m.escape_spaces = bool(norm.get(4, 1)), bool(norm.get(5, 1))
    if m.kind not in (UNIGRAM, BPE):
        raise ValueError(f"model type {m.kind} is not supported")
    return m


def merges_of(m: Model) -> list[tuple[str, str]]:
    usable = {p: s for p, s, kind in m.pieces if kind in (NORMAL, USER)}
    ids = {p: i for i, (p, _, _) in enumerate(m.pieces)}
    found = [(-score, ids[p], ids[p[:i]], ids[p[i:]], p[:i], p[i:]) for p, score in usable.items() for i in range(1, len(p)) if p[:i] in usable and p[i:] in usable]
    # The library merges the leftmost of equal scores (runs of markers have one), so a run grows from its left end:
    # among equal scores the longest piece with the longest left part comes first.
    found.sort(key=lambda x: (x[0], -len(x[4]) - len(x[5]), -len(x[4]), x[1:4]))
    return [x[4:] for x in found]


def build(m: Model):
    """The model as a tokenizers tokenizer."""
    from tokenizers import Regex, Tokenizer, decoders, models, normalizers, pre_tokenizers

    unk = m.pieces[m.unk_id][0]
    if m.kind == UNIGRAM:
        core = models.Unigram([(p, s) for p, s, _ in m.pieces], unk_id=m.unk_id, byte_fallback=m.byte_fallback)
    else:
        core = models.BPE(vocab={p: i for i, (p, _, _) in enumerate(m.pieces)}, merges=merges_of(m), unk_token=unk, fuse_unk=True, byte_fallback=m.byte_fallback)
    t = Tokenizer(core)
    steps = [normalizers.Precompiled(m.charsmap)] if m.charsmap else []
    if m.squeeze_spaces:
        steps += [normalizers.Strip(left=True, right=True), normalizers.Replace(Regex(" {2,}"), " ")]
    if m.dummy_prefix:
        steps.append(normalizers.Prepend(MARK if m.escape_spaces else " "))
    if m.escape_spaces:
        steps.append(normalizers.Replace(" ", MARK))
    t.normalizer = normalizers.Sequence(steps)
    if splits_at_marks(m):
        t.pre_tokenizer = pre_tokenizers.Split(Regex(f"{MARK}*[^{MARK}]+|{MARK}+"), "isolated")
    back = [decoders.Replace(MARK, " "), decoders.ByteFallback(), decoders.Fuse()]
    t.decoder = decoders.Sequence(back + [decoders.Strip(" ", 1, 0)] * m.dummy_prefix)
    return t


def splits_at_marks(m: Model) -> bool:
    """Whether no piece holds a marker behind another character."""
    return m.escape_spaces and all(MARK not in p.lstrip(MARK) for p, _, kind in m.pieces if kind in (NORMAL, USER, UNUSED))


class Codec:
    """Encodes and decodes with the rebuilt tokenizer.

    Where pieces allow it (see ``splits_at_marks``) and the model only turns spaces into markers, a text is cut in front of
    spaces and line feeds, and each distinct piece of text is encoded once per worker: new ones are strung together, and
    the tokens that begin with the marker (or are the line feed's) mark the cuts again. Other texts are encoded whole.
    """

    def __init__(self, path: str | None = None, check: bool = True):
        import public_tokenizers
        from tokenizers import normalizers

        path = path or public_tokenizers.path(MODEL)
        m = parse_model(Path(path).read_bytes())
        self.tokenizer = build(m)
        self.known: dict[str, bytes] = {}
        plain = not m.charsmap and not m.squeeze_spaces and m.dummy_prefix and m.escape_spaces and m.byte_fallback
        self.by_word = plain and splits_at_marks(m) and not any("\n" in p for p, _, _ in m.pieces)
        if self.by_word:
            self.bare = build(m)
            self.bare.normalizer = normalizers.Sequence([])  # markers are set here
            line_feed = next(i for i, (p, _, kind) in enumerate(m.pieces) if kind == BYTE and p == "<0x0A>")
            self.starts = {MARK: np.array([p.startswith(MARK) for p, _, _ in m.pieces]), "\n": np.arange(len(m.pieces)) == line_feed}
        #: What each id decodes to, the byte pieces to their byte.
        self.bytes = [bytes([int(p[1:-1], 16)]) if kind == BYTE else p.replace(MARK, " ").encode() for p, _, kind in m.pieces]
        self.prefix = m.dummy_prefix
        if check:
            self.verify(path)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text; what is new goes to the tokenizer as one batch, spread over its threads."""
        short = [self.by_word and bool(t) and t[0] != " " and "  " not in t and MARK not in t for t in texts]
        pieces = [t.replace("\n", " \n").split(" ") for t, ok in zip(texts, short) if ok]
        known = self.known
        if len(known) > WORDS:
            known.clear()
        self.learn(set().union(*pieces) - known.keys())
        quick = iter([np.frombuffer(b"".join(map(known.__getitem__, p)), np.int32) for p in pieces])
        whole = self.tokenizer.encode_batch_fast([t for t, ok in zip(texts, short) if not ok], add_special_tokens=False)
        slow = iter([np.array(e.ids, np.int32) for e in whole])
        return [next(quick if ok else slow) for ok in short]

    def learn(self, new: set[str]) -> None:
        for sep, own in ((MARK, [p for p in new if p[:1] != "\n"]), ("\n", [p for p in new if p[:1] == "\n"])):
            cut = -(-len(own) // THREADS) or 1
            groups = [own[i : i + cut] for i in range(0, len(own), cut)]
            coded = self.bare.encode_batch_fast(["".join([sep + p.removeprefix("\n") for p in g]) for g in groups], add_special_tokens=False) if own else []
            for group, e in zip(groups, coded):
                ids = np.array(e.ids, np.int32)
                cuts = np.flatnonzero(self.starts[sep][ids])
                if len(cuts) != len(group):
                    raise ValueError("a piece reaches over a marker")
                data, at = ids.tobytes(), [*(4 * cuts).tolist(), 4 * len(ids)]
                for p, a, b in zip(group, at, at[1:]):
                    self.known[p] = data[a:b]

    def verify(self, path: str) -> None:
        import sentencepiece

        own = sentencepiece.SentencePieceProcessor(model_file=path)
        for probe in PROBES:
            if (a := own.encode(probe)) != (b := self.encode([probe])[0].tolist()):
                raise ValueError(f"ids differ from the sentencepiece library's on {probe!r}: {a} and {b}")
            if (x := own.decode(a)) != (y := self.decode([np.array(a, np.int32)])[0]) or y != self.tokenizer.decode(a, skip_special_tokens=False):
                raise ValueError(f"texts differ from the sentencepiece library's on {probe!r}: {x!r} and {y!r}")

    def decode(self, ids: list[np.ndarray]) -> list[str]:
        """Texts of ids. Bytes that are no UTF-8 are left to the tokenizer's decoder."""
        out = []
        for x in ids:
            try:
                text = b"".join(map(self.bytes.__getitem__, x.tolist())).decode()
                out.append(text[1:] if self.prefix and text[:1] == " " else text)
            except UnicodeDecodeError:
                out.append(self.tokenizer.decode(x.tolist(), skip_special_tokens=False))
        return out


_codecs: dict[tuple, Codec] = {}


def codec(path: str | None, check: bool) -> Codec:
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "true")
    os.environ.setdefault("RAYON_NUM_THREADS", str(THREADS))  # read once, at the first batch
    if (path, check) not in _codecs:
        _codecs[path, check] = Codec(path, check)
    return _codecs[path, check]


def _slices(batch: pa.RecordBatch, sizes: list[int]) -> Iterator[tuple[int, int]]:
    """Runs of rows whose sizes add up to about BATCH_CHARS."""
    start = total = 0
    for i, n in enumerate(sizes):
        total += n
        if total >= BATCH_CHARS:
            yield start, i + 1
            start, total = i + 1, 0
    if start < len(sizes):
        yield start, len(sizes)


def encode(docs: DataFrame, text: str = "text", model_path: str | None = None, check: bool = True) -> DataFrame:
    """``docs`` with ``piece_ids`` (array of int)."""
    need(docs, text)
    docs = without(docs, "piece_ids")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(model_path, check)
        for batch in batches:
            column = batch.column(batch.schema.get_field_index(text))
            for a, b in _slices(batch, [n or 0 for n in pc.binary_length(column).to_pylist()]):
                texts = column.slice(a, b - a).to_pylist()
                own = [i for i, t in enumerate(texts) if t is not None]
                coded = c.encode([texts[i] for i in own])
                sizes = np.zeros(b - a, np.int64)
                sizes[own] = [len(x) for x in coded]
                ends = pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32))
                gone = pa.array([t is None for t in texts])
                ids = pa.ListArray.from_arrays(ends, pa.array(np.concatenate([np.zeros(0, np.int32), *coded])), mask=gone)
                yield pa.RecordBatch.from_arrays([*batch.slice(a, b - a).columns, ids], names=[*batch.schema.names, "piece_ids"])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField("piece_ids", T.ArrayType(T.IntegerType()))]))


def decode(encoded: DataFrame, ids: str = "piece_ids", model_path: str | None = None, check: bool = True) -> DataFrame:
    """``encoded`` with ``decoded`` (string)."""
    need(encoded, ids)
    encoded = without(encoded, "decoded")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(model_path, check)
        for batch in batches:
            column = batch.column(batch.schema.get_field_index(ids))
            for a, b in _slices(batch, [3 * (n or 0) for n in column.value_lengths().to_pylist()]):
                part = column.slice(a, b - a)
                there, at, flat = part.is_valid().to_pylist(), part.offsets.to_numpy(), part.values.to_numpy(zero_copy_only=False)
                own = [i for i, ok in enumerate(there) if ok]
                texts: list = [None] * (b - a)
                for i, t in zip(own, c.decode([flat[at[i] : at[i + 1]] for i in own])):
                    texts[i] = t
                yield pa.RecordBatch.from_arrays([*batch.slice(a, b - a).columns, pa.array(texts, pa.string())], names=[*batch.schema.names, "decoded"])

    return encoded.mapInArrow(run, T.StructType([*encoded.schema.fields, T.StructField("decoded", T.StringType())]))
