"""Sequence packing along a space-filling curve.

Each document is tokenized once, its token counts are hashed into a vector, projected to a few
dimensions by fixed random signs, and given the Hilbert key of its cell. Documents are range-sorted by
that key, and each range is cut into sequences of ``length`` tokens, so neighbours along the curve
share sequences. Only a range's last tokens can leave a sequence short: they are cut into sequences of
powers of two, which need no padding.

Defined cases: a null text counts as empty; an empty text is its end token alone. Repeated rows are packed
each. Ties on the curve are split by row number, so copies spread over ranges and no range is larger for them.
An empty table gives an empty result. A document longer than a sequence is cut; each id lies in one piece. Other columns than
id and text, whatever their names, are ignored; ids that aren't whole numbers are an error.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dendra.llm import byte_bpe
from dendra.llm.common import HIDDEN, need, whole_ids, with_row_id, written

LENGTH = 1024
END = 0
BUCKETS = 512
DIMS = 3
BITS = 10
#: Bits of the key that tell the cells whose tokens are counted on the driver (at most 2 to this power).
CELL_BITS = 18
#: Bytes of tokens in a range; less where the input would give fewer ranges than tasks.
RANGE_BYTES = 512 << 20
LEAST_RANGE_BYTES = 8 << 20
#: Texts per batch that a worker is handed.
TEXT_ROWS = 500
#: Documents' characters encoded before a batch is handed on.
BATCH_CHARS = 1 << 20


def hilbert_key(cells: np.ndarray, bits: int) -> np.ndarray:
    """Positions along the Hilbert curve of n x d whole-number cells below 2**bits (Skilling 2004)."""
    x = cells.astype(np.int64).T.copy()
    d = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(d):
            high = (x[i] & q) != 0
            swap = np.where(high, 0, (x[0] ^ x[i]) & p)
            x[0] ^= np.where(high, p, swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, d):
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        t ^= np.where((x[d - 1] & q) != 0, q - 1, 0)
        q >>= 1
    x ^= t
    key = np.zeros_like(t)
    for b in range(bits - 1, -1, -1):
        for i in range(d):
            key = (key << 1) | ((x[i] >> b) & 1)
    return key


def bucket_of(ids: np.ndarray) -> np.ndarray:
    """A bucket per token id, by multiplicative hashing."""
    return ((ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - BUCKETS.bit_length() + 1)).astype(np.int64)


def curve_points(tokens: list[np.ndarray]) -> np.ndarray:
    """The documents' hashed counts, projected by fixed random signs; about standard normal in each dimension."""
    signs = np.random.Generator(np.random.PCG64(7)).choice([-1.0, 1.0], size=(BUCKETS, DIMS))
    of = np.repeat(np.arange(len(tokens)), [len(x) for x in tokens])
    v = np.sqrt(np.bincount(of * BUCKETS + bucket_of(np.concatenate(tokens)), minlength=len(tokens) * BUCKETS)).reshape(-1, BUCKETS)
    v -= v.mean(axis=1, keepdims=True)
    return v @ signs / np.maximum(np.sqrt((v * v).sum(axis=1, keepdims=True)), 1e-9)


def curve_keys(points: np.ndarray) -> np.ndarray:
    """Hilbert keys of the points' cells; points beyond four deviations lie in the outermost cells."""
    cells = np.clip((points + 4) * (1 << BITS) / 8, 0, (1 << BITS) - 1)
    return hilbert_key(cells.astype(np.int64), BITS)


def tokenized(docs: DataFrame, id_col: str, text: str, tokenizer_path: str | None) -> DataFrame:
    """(id, ids with the end token in the tokenizer's width, key, number of ids) per row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = byte_bpe.load(tokenizer_path)
        end = np.array([END], bpe.width)

        def flush(own, tokens):
            return pa.RecordBatch.from_arrays(
                [pa.array(own, pa.int64()), pa.array([x.tobytes() for x in tokens], pa.binary()), pa.array(curve_keys(curve_points(tokens))), pa.array([len(x) for x in tokens], pa.int64())],
                names=["id", "tokens", "key", "n"],
            )

        for batch in batches:
            own, tokens, chars = [], [], 0
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1)):
                t = t.as_py() or ""
                own.append(i)
                tokens.append(np.concatenate([bpe.ids(t), end]))
                chars += len(t)
                if chars > BATCH_CHARS:
                    yield flush(own, tokens)
                    own, tokens, chars = [], [], 0
            if own:
                yield flush(own, tokens)

    return docs.select(F.col(id_col).cast("long"), F.col(text).cast("string")).mapInArrow(run, "id long, tokens binary, key long, n long")


def ranges_of(cells: list[tuple[int, int]], ranges: int) -> list[tuple[int, int, int]]:
    """(cell, first range, ranges that it spans) for cells (number, tokens) in the curve's order, dealt into ``ranges`` ranges of
    about equal tokens. A cell with more than a range's tokens spans several."""
    total, at, out = max(1, sum(n for _, n in cells)), 0, []
    for cell, n in cells:
        first, last = at * ranges // total, max(at, at + n - 1) * ranges // total
        out.append((cell, first, last - first + 1))
        at += n
    return out


def cuts(at: int, n: int, length: int) -> Iterator[tuple[int, int]]:
    """(offset in its sequence, tokens) of the pieces of n tokens that begin at position ``at`` of a stream."""
    while n:
        take = min(n, length - at % length)
        yield at % length, take
        at, n = at + take, n - take


def tail_sizes(n: int) -> list[int]:
    """n as falling powers of two."""
    return [1 << b for b in range(n.bit_length() - 1, -1, -1) if n >> b & 1]


def pack(docs: DataFrame, id_col: str = "doc_id", text: str = "text", length: int = LENGTH, tokenizer_path: str | None = None, range_bytes: int | None = None) -> DataFrame:
    """One row per piece: doc_id, start, length, ids (binary: little-endian unsigned 32-bit), doc_tokens,
    sequence_id, offset, sequence_tokens. ``length`` must be a power of two.

    Tokens are written to the shared folder once (2 bytes each, 4 with a vocabulary over 65536) and dealt into ranges of about
    ``range_bytes``, by a count of tokens per cell of the curve; a range is streamed, so its size doesn't bind memory.
    """
    need(docs, id_col, text)
    whole_ids(docs, id_col)
    if length < 1 or length & (length - 1):
        raise ValueError("length must be a power of two")
    rid, cell = HIDDEN + "rid", HIDDEN + "cell"
    rows = written(with_row_id(tokenized(docs, id_col, text, tokenizer_path), rid), "tokens", arrow_rows=TEXT_ROWS)
    at = F.shiftright("key", DIMS * BITS - CELL_BITS)
    cells = sorted((r["cell"], r["n"]) for r in rows.groupBy(at.alias("cell")).agg(F.sum("n").alias("n")).collect())  # reads keys and counts alone
    width = byte_bpe.load(tokenizer_path).width
    total, tasks = width.itemsize * sum(n for _, n in cells), int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    if range_bytes is None:
        range_bytes = min(RANGE_BYTES, max(LEAST_RANGE_BYTES, total // max(1, tasks)))
    ranges = max(1, -(-total // range_bytes))
    place = docs.sparkSession.createDataFrame(ranges_of(cells, ranges), f"{cell} long, {cell}_first long, {cell}_span long")
    dealt = (
        rows.withColumn(cell, at.cast("long"))
        .join(F.broadcast(place), cell)  # 2 to the power CELL_BITS rows at most
        .withColumn("part", (F.col(cell + "_first") + F.pmod(F.xxhash64(rid), F.col(cell + "_span"))).cast("int"))
        .select("id", "tokens", "key", rid, "part")
        .repartitionById(ranges, F.col("part"))
        .sortWithinPartitions("key", rid)
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset", "sequence_tokens"]
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]

        def flush(pieces):
            return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*pieces), kinds)], names=names)

        open_: list[tuple] = []  # pieces of the open sequence
        at = sequence = part = 0
        out: list[tuple] = []
        for batch in batches:
            part = batch.column(4)[0].as_py()
            for own, tokens in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = np.frombuffer(tokens.as_buffer(), width).astype("<u4")
                start = 0
                for offset, n in cuts(at, len(ids), length):
                    open_.append((own, start, n, ids[start : start + n].tobytes(), len(ids), offset))
                    start += n
                    at += n
                    if at % length == 0:
                        out += [(*p[:5], (part << 40) + sequence, p[5], length) for p in open_]
                        open_, sequence = [], sequence + 1
                if len(out) > 2000:
                    yield flush(out)
                    out = []
            if out:
                yield flush(out)
                out = []
        ends = tail_sizes(at % length)
        base = 0
        for size in ends:
            for own, start, n, ids, all_, offset in open_:
                a, b = max(offset, base), min(offset + n, base + size)
                if a < b:
                    out.append((own, start + a - offset, b - a, ids[4 * (a - offset) : 4 * (b - offset)], all_, (part << 40) + sequence, a - base, size))
            base, sequence = base + size, sequence + 1
        if out:
            yield flush(out)

    schema = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long, sequence_tokens long"
    return dealt.mapInArrow(run, schema)
