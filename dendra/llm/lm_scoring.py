"""Stupid-backoff language-model scores (Brants et al. 2007), trigrams over bigrams over unigrams, computed as relations.

Score of a word w after the words u v:  c(u v w) / c(u v) if that trigram was counted, else ``alpha`` times the score of
w after v:  c(v w) / c(v) if that bigram was counted, else ``alpha`` * c(w) / N, with c(w) floored at one. A document's second word
starts at the bigram, its first at c(w) / N. ``lm_score`` is the mean natural logarithm over the document's words.

A corpus that scores itself leaves each document's own counts (and words) out: what a document says but once scores by
what the others say, so text that occurs elsewhere stands out and back-off happens.

The plan, in two shuffles of packed rows:
1. A block of documents explodes into its distinct n-grams of all orders, with multiplicity, one row per hash partition.
2. A partition adds up the counts of its n-grams over all blocks (the count table, partitioned by hash), joins them
   to each block's n-grams, and sends each block its counts, in the order in which they came.
3. A block, with its documents, joins the counts to their n-grams and sums each document's logarithms.

A block's n-gram goes to its partition once, however often the block has it, so no frequent word makes a partition large. The
number of partitions follows the input without a bound, and the blocks grow with it, so rows stay well filled. N-grams are known by
their partition and 48 bits more of a 64-bit hash.

Defined cases: a null text is empty; a document without words has n_words 0 and a null score. Repeated rows are
scored each, and counted each (a copy is another document). Null ids stay; ids that aren't whole numbers are an error. Very long texts
are scored whole. Other columns, whatever their names, are ignored. Empty tables give empty results; an empty corpus floors every count at one.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dendra.llm.common import SPACES, need, whole_ids, written

ALPHA = 0.4
ORDERS = 3
#: Characters of text whose n-grams make one block: at least, per hash partition, and at most; bounds memory.
BLOCK_CHARS = 4 << 20
BLOCK_CHARS_PER_PART = 200
MOST_BLOCK_CHARS = 32 << 20
#: Bytes of text per hash partition.
PARTITION_BYTES = 12 << 20
#: Bytes of text hashed at once.
HASH_BYTES = 1 << 20
#: Roles of packed n-grams: they are counted, they are scored, or both.
COUNTED, SCORED = 1, 2
#: Fixed multipliers of the hashes: of a byte's place in its word, and of the words of an n-gram.
_PLACE, _A, _B = np.uint64(0x9E3779B97F4A7C15 | 5), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_BYTE = np.random.Generator(np.random.PCG64(3)).integers(0, 1 << 64, 256, np.uint64)
_IS_SPACE = np.isin(np.arange(256), list(SPACES.encode()))


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _A
    x = (x ^ (x >> np.uint64(27))) * _B
    return x ^ (x >> np.uint64(31))


def words_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the texts' words in order, and the text that each is from. Words are runs of anything but SPACES."""
    hashes, owner, at = [], [], 0
    while at < len(texts):
        end, size = at, 0
        while end < len(texts) and (size == 0 or size + len(texts[end]) < HASH_BYTES):
            size += len(texts[end]) + 1
            end += 1
        raw = np.frombuffer(b"\n".join(texts[at:end]) + b"\n", np.uint8)
        inside = ~_IS_SPACE[raw]
        edges = np.flatnonzero(np.diff(inside, prepend=False))
        starts, lengths = edges[::2], edges[1::2] - edges[::2]
        if len(starts):
            first = np.concatenate([[0], np.cumsum(lengths)[:-1]])
            place = np.arange(lengths.sum()) - np.repeat(first, lengths)
            power = np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(int(lengths.max()), _PLACE)]))
            hashes.append(mixed(np.add.reduceat(_BYTE[raw[inside]] * power[place], first) + lengths.astype(np.uint64)))
            begins = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts[at:end]])[:-1]])
            owner.append(at + np.searchsorted(begins, starts, "right") - 1)
        at = end
    if not hashes:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return np.concatenate(hashes), np.concatenate(owner)


def instances(words: np.ndarray, owner: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Per order, the hashes of all n-grams in order of their last word, and the places of these last words."""
    grams, last = [words], [np.arange(len(words))]
    for n in range(2, ORDERS + 1):
        whole = np.flatnonzero(owner[n - 1 :] == owner[: 1 - n]) + n - 1 if len(words) >= n else np.zeros(0, np.int64)
        h = mixed(words[whole - n + 1] + np.uint64(n))
        for k in range(n - 2, -1, -1):
            h = mixed(h * _PLACE + words[whole - k])
        grams.append(h)
        last.append(whole)
    return grams, last


def part_starts(parts: int) -> np.ndarray:
    """The least hash of each partition: hashes are cut into ``parts`` runs of equal length."""
    return np.array([-(-(p << 64) // parts) for p in range(parts)], np.uint64)


def place_in_part(h: np.ndarray, parts: int) -> np.ndarray:
    """How far into its partition's run a hash lies, in 48 bits; rises with the hash."""
    return (h * np.uint64(parts)) >> np.uint64(16)


def runs(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and length of each run of equal numbers."""
    starts = np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]])) if len(x) else np.zeros(0, np.int64)
    return starts, np.diff(starts, append=len(x))


def squeezed(data: bytes, level: int = 1) -> bytes:
    return len(data).to_bytes(8, "little") + (pa.Codec("zstd", compression_level=level).compress(data, asbytes=True) if data else b"")


def unsqueezed(data: bytes) -> bytes:
    size = int.from_bytes(data[:8], "little")
    return pa.decompress(data[8:], decompressed_size=size, codec="zstd", asbytes=True) if size else b""


def packed_numbers(x: np.ndarray) -> bytes:
    """Whole numbers from 0 in as few bytes each as hold them (the length tells which), compressed."""
    most = int(x.max(initial=0))
    return squeezed(x.astype(np.uint8 if most < 1 << 8 else np.uint16 if most < 1 << 16 else np.int64).tobytes())


def numbers(data: bytes, n: int) -> np.ndarray:
    data = unsqueezed(data)
    return np.frombuffer(data, {1: np.uint8, 2: np.uint16, 8: np.int64}[len(data) // n if n else 1])


def packed_places(x: np.ndarray) -> tuple[bytes, bytes]:
    """Rising 48-bit numbers: their low 32 bits, and the gaps between their high bits."""
    return (x & np.uint64(0xFFFFFFFF)).astype("<u4").tobytes(), packed_numbers(np.diff((x >> np.uint64(32)).astype(np.int64), prepend=0))


def places(low: bytes, gaps: bytes) -> np.ndarray:
    x = np.frombuffer(low, "<u4").astype(np.uint64)
    return x | (np.cumsum(numbers(gaps, len(x)), dtype=np.uint64) << np.uint64(32))


GRAMS = "part int, role int, block long, low binary, gaps binary, counts binary"
_GRAM_KINDS = [pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary()]
#: part is -1 for the block's documents: ids, null marks and texts in place of counts and checks.
ANSWERS = "block long, part int, a binary, b binary, c binary"
_ANSWER_KINDS = [pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary()]


def _batch(rows: list[tuple], schema: str, kinds: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows), kinds)], names=[x.split()[0] for x in schema.split(", ")])


def blocks(batches: Iterator[pa.RecordBatch], chars: int) -> Iterator[tuple[int, list[int | None], list[bytes]]]:
    """(number, ids, texts) of a task's blocks; the same each time that the same rows come."""
    number, ids, texts, size = None, [], [], 0
    for batch in batches:
        if number is None and batch.num_rows:
            number = batch.column(2)[0].as_py() << 24  # a task's own number would count the other side of a union as well
        for i, t in zip(batch.column(0).to_pylist(), batch.column(1)):
            t = t.as_py() or b""
            ids.append(i)
            texts.append(t)
            size += len(t) + 64
            if size >= chars:
                yield number, ids, texts
                number, ids, texts, size = number + 1, [], [], 0
    if ids:
        yield number, ids, texts


def exploded(rows: DataFrame, parts: int, role: int, chars: int) -> DataFrame:
    """Packed n-grams of rows (id, t, scan): a row per block and partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        starts = part_starts(parts)
        for number, _, texts in blocks(batches, chars):
            all_ = np.sort(np.concatenate(instances(*words_of(texts))[0]))
            at, n = runs(all_)
            h = all_[at]
            edges = np.append(np.searchsorted(h, starts), len(h))
            out = []
            for p in np.flatnonzero(np.diff(edges)).tolist():
                a, b = edges[p], edges[p + 1]
                out.append((p, role, number, *packed_places(place_in_part(h[a:b], parts)), packed_numbers(n[a:b])))
            if out:
                yield _batch(out, GRAMS, _GRAM_KINDS)

    return rows.mapInArrow(run, GRAMS)


def by_key(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple]]:
    """Runs of rows with one first value."""
    rows: list[tuple] = []
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            if rows and row[0] != rows[0][0]:
                yield rows
                rows = []
            rows.append(row)
    if rows:
        yield rows


def answered(grams: DataFrame, parts: int) -> DataFrame:
    """Adds up each partition's n-grams and answers the blocks that are scored: their n-grams' counts in other blocks, in their order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in by_key(batches):
            own = [places(r[3], r[4]) for r in rows]
            known, at = np.unique(np.concatenate(own), return_inverse=True)
            n = np.concatenate([numbers(r[5], len(h)) if r[1] & COUNTED else np.zeros(len(h), np.uint8) for r, h in zip(rows, own)])
            counts, start, out, held = np.bincount(at, weights=n, minlength=len(known)).astype(np.int64), 0, [], 0
            for r, h in zip(rows, own):
                if r[1] & SCORED:
                    here = slice(start, start + len(h))
                    out.append((r[2], r[0], packed_numbers(counts[at[here]] - n[here]), np.bitwise_xor.reduce(h).tobytes(), len(h).to_bytes(8, "little")))
                    held += len(h)
                start += len(h)
                if held > 1 << 22:
                    yield _batch(out, ANSWERS, _ANSWER_KINDS)
                    out, held = [], 0
            if out:
                yield _batch(out, ANSWERS, _ANSWER_KINDS)

    return grams.repartitionById(parts, F.col("part")).sortWithinPartitions("part").mapInArrow(run, ANSWERS)


def texts_of(rows: DataFrame, chars: int) -> DataFrame:
    """A row per block with its documents, compressed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, ids, texts in blocks(batches, chars):
            own = pa.array(ids, pa.int64())
            lengths = np.array([len(t) for t in texts], "<i8").tobytes()
            head = np.array([i is None for i in ids]).tobytes() + own.fill_null(0).to_numpy().astype("<i8").tobytes()
            joined = b"".join(texts)
            yield _batch([(number, -1, head, lengths, squeezed(joined, 3))], ANSWERS, _ANSWER_KINDS)

    return rows.mapInArrow(run, ANSWERS)


def score_block(texts: list[bytes], elsewhere: np.ndarray, own: bool, log_alpha: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Per document: words, sum of logarithms without the terms in N, words scored by c(w) / N, words backed off.

    elsewhere: counts of the block's distinct n-grams, by rising hash, without the block's own. own: the block was counted too.
    """
    words, owner = words_of(texts)
    grams, last = instances(words, owner)
    all_, of = np.concatenate(grams), np.concatenate([owner[x] for x in last])
    order = np.argsort(all_, kind="stable")  # so an n-gram's instances stay in the documents' order
    at, n = runs(all_[order])
    if len(at) != len(elsewhere):
        raise RuntimeError("a block's n-grams changed between two reads of the documents; call score with reread=False")
    sorted_counts = np.repeat(elsewhere + n if own else elsewhere, n)
    if own:
        gram = np.repeat(np.arange(len(at)), n)
        _, same = runs(gram * len(texts) + of[order])
        sorted_counts = sorted_counts - np.repeat(same, same)
    count = np.empty(len(all_), np.int64)
    count[order] = sorted_counts
    by_order = np.split(count, np.cumsum([len(g) for g in grams])[:-1])
    full = np.zeros((ORDERS, len(words)), np.int64)  # by place of the last word; 0 where there is no such n-gram
    for row, c, x in zip(full, by_order, last):
        row[x] = c
    first = np.concatenate([[True], owner[1:] != owner[:-1]]) if len(words) else np.zeros(0, bool)
    place = np.arange(len(words)) - np.maximum.accumulate(np.where(first, np.arange(len(words)), 0))
    used = np.ones(len(words), np.int64)
    logs = np.log(np.maximum(full[0], 1))
    for n in range(1, ORDERS):
        seen = np.flatnonzero((full[n] > 0) & (place >= n))
        used[seen] = n + 1
        logs[seen] = np.log(full[n, seen]) - np.log(full[n - 1, seen - 1])
    steps = np.minimum(place + 1, ORDERS) - used
    docs = len(texts)
    sums = np.bincount(owner, weights=logs + steps * log_alpha, minlength=docs)
    return np.bincount(owner, minlength=docs), sums.astype(np.float64), np.bincount(owner[used == 1], minlength=docs), np.bincount(owner[steps > 0], minlength=docs)


def summed(answers: DataFrame, own: bool, log_alpha: float) -> DataFrame:
    """(id, n_words, logs, n_single, n_backed) per document: a block's counts meet its documents."""
    out = "id long, n_words long, logs double, n_single long, n_backed long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in by_key(batches):
            docs, sent = next((r for r in rows if r[1] < 0), None), sorted((r for r in rows if r[1] >= 0), key=lambda r: r[1])
            if docs is None:
                raise RuntimeError("a block of documents is missing in a second read; call score with reread=False")
            lengths = np.frombuffer(docs[3], "<i8")
            joined = unsqueezed(docs[4])
            ends = np.cumsum(lengths)
            texts = [joined[a:b] for a, b in zip((ends - lengths).tolist(), ends.tolist())]
            totals = np.concatenate([np.zeros(0, np.int64), *(numbers(r[2], int.from_bytes(r[4], "little")).astype(np.int64) for r in sent)])
            words, logs, single, backed = score_block(texts, totals, own, log_alpha)
            null, ids = np.frombuffer(docs[2][: len(lengths)], bool), np.frombuffer(docs[2][len(lengths) :], "<i8")
            yield pa.RecordBatch.from_arrays([pa.array(ids, mask=null), pa.array(words), pa.array(logs), pa.array(single), pa.array(backed)], names=["id", "n_words", "logs", "n_single", "n_backed"])

    return answers.repartition("block").sortWithinPartitions("block").mapInArrow(run, out)


def parts_for(df: DataFrame, text: str, part_bytes: int) -> int:
    """Hash partitions, from the texts' bytes."""
    size = df.agg(F.sum(F.octet_length(F.col(text).cast("string"))).alias("n")).first()["n"] or 0
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) // 2, -(-size // part_bytes), 1)


def score(docs: DataFrame, corpus: DataFrame | None = None, id_col: str = "doc_id", text: str = "text", alpha: float = ALPHA, part_bytes: int = PARTITION_BYTES, reread: bool = False) -> DataFrame:
    """(id_col, n_words, n_backed_off, log_prob, lm_score) for every row of ``docs``, by the counts of ``corpus`` (if None, of all
    other rows of ``docs``).

    part_bytes: text per hash partition; a worker takes some twelve times that. reread: ``docs`` is a plain scan of stored files, whose
    partitions are the same each time; it is then read twice instead of being written to the shared folder (a difference is an error).
    """
    need(docs, id_col, text)
    whole_ids(docs, id_col)
    own = corpus is None
    parts = parts_for(docs if own else corpus, text, part_bytes)
    chars = max(BLOCK_CHARS, min(MOST_BLOCK_CHARS, BLOCK_CHARS_PER_PART * parts))
    as_rows = lambda df, i: df.select(i.cast("long").alias("id"), F.col(text).cast("string").cast("binary").alias("t"), F.spark_partition_id().alias("scan"))
    if not reread:
        docs = written(docs.select(F.col(id_col).cast("long").alias(id_col), F.col(text).cast("string").alias(text)), "texts")
    rows = as_rows(docs, F.col(id_col))
    grams = exploded(rows, parts, COUNTED | SCORED if own else SCORED, chars)
    if not own:
        need(corpus, text)
        grams = grams.unionByName(exploded(as_rows(corpus, F.lit(None)), parts, COUNTED, chars))
    scored = written(summed(answered(grams, parts).unionByName(texts_of(rows, chars)), own, math.log(alpha)), "scores")
    words = F.size(F.array_remove(F.split(F.coalesce(F.col(text).cast("string"), F.lit("")), r"[\x20\x09-\x0D]+"), ""))
    total = (scored.agg(F.sum("n_words").alias("n")) if own else corpus.agg(F.sum(words).alias("n"))).first()["n"] or 0
    log_n = F.log(F.greatest(F.lit(total) - F.col("n_words") if own else F.lit(total), F.lit(1)))
    logs = F.when(F.col("n_words") > 0, F.col("logs") - F.col("n_single") * log_n)
    out = scored.select(F.col("id").alias(id_col), "n_words", F.col("n_backed").alias("n_backed_off"), logs.alias("log_prob"))
    return out.withColumn("lm_score", F.col("log_prob") / F.col("n_words"))
