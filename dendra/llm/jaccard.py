"""Near-duplicate groups by the Jaccard similarity of word shingles: candidates by fingerprints in Gray order, each link verified.

1. A text is the set of its shingles (XXH64 of the words in lower case). Texts with equal sets are one class, never expanded into pairs.
2. A class has ``simhash.TURNS`` fingerprints, and ``simhash.candidate_groups`` joins classes by the Gray-order index: those that agree in a
   quarter of some fingerprint, differ in 9 bits or fewer of it and in 16 or fewer of another. Two large sets at exactly 0.8 are missed with probability 0.0001.
   The votes of small sets scatter more: sets of up to SMALL shingles are joined, without a miss, to all that share one
   of their first shingles by hash, of which sets at ``least`` have one in common.
3. Each member of a component of candidates is compared with its smallest class, and components are formed of the links that hold.
4. Where candidates still fall into several components, every pair across components is compared, inside the task that holds
   them: a member's similarity to all others comes from an inverted index of their shingles, exactly, and a task returns
   a spanning forest of its links, never pairs that fail. What is too large for one task is cut into groups, and each pair of
   groups is a task's work.

A link holds only if the sets themselves, not signatures, reach ``least``. Sets are built again from the texts of
candidates alone, picked by a bitmap whose size follows their number.

Defined cases: a null text counts as empty, texts without words are one class, a text shorter than a shingle is one shingle,
repeated rows stay rows, null ids are never the smallest while another is there; very long texts are taken whole; an empty
table gives an empty result; input columns named ``component_id`` or ``representative`` are replaced, others pass through.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dendra.llm.common import HIDDEN, SEED, need, with_row_id, written
from dendra.llm.simhash import TURNS, candidate_groups, set_fingerprints
from dendra.operators.components import components

SHINGLE = 5
LEAST = 0.8
#: Shingles of a set whose candidates don't depend on fingerprints.
SMALL = 32
#: Members, and shingles of theirs, that one task compares at once; larger buckets are cut into groups of half as many.
GROUP_ROWS = 1 << 11
GROUP_SHINGLES = 1 << 21
#: Texts or sets that a Python worker is handed at once.
ROWS_AT_ONCE = 500
#: Bits of the bitmap of candidates per candidate, and the most.
BITS_EACH, BITMAP = 16, 1 << 28
LINK = "a long, b long"


def shingles(text: str | None, shingle: int = SHINGLE) -> np.ndarray:
    """Hashes of the text's distinct shingles, sorted."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    joined = memoryview(b" ".join(words))
    starts = np.zeros(len(words) + 1, np.int64)
    np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1, out=starts[1:])
    n = max(1, len(words) - shingle + 1)
    ends = starts[min(shingle, len(words)) :] - 1
    return np.unique(np.fromiter((xxhash.xxh64_intdigest(joined[s:e], SEED) for s, e in zip(starts[:n].tolist(), ends.tolist())), np.uint64, n))


def heads(hashes: np.ndarray, least: float) -> np.ndarray:
    """A small set's first shingles by hash: a set of up to SMALL shingles shares one of its own with every set at ``least`` or more.
    Partners may be larger than SMALL, so sets of up to SMALL / least have some."""
    n = len(hashes)
    return hashes[: n - int(np.ceil(least * n - 1e-9)) + 1] if n <= SMALL / least + 1e-9 else hashes[:0]


def similar(a: np.ndarray, b: np.ndarray, least: float = LEAST) -> bool:
    """Whether the Jaccard similarity of two sorted sets is ``least`` or more."""
    if min(len(a), len(b)) < least * max(len(a), len(b)) - 1e-9:
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both >= least * (len(a) + len(b) - both) - 1e-9


def signed(docs: DataFrame, text: str, shingle: int, least: float) -> DataFrame:
    """``docs`` with key (of the shingle set), prints and heads. One pass, no shuffle."""
    names = [HIDDEN + x for x in ("key", "prints", "heads")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, prints, firsts = np.zeros(batch.num_rows, np.uint64), np.zeros((batch.num_rows, TURNS), np.uint64), []
            for i, x in enumerate(batch.column(batch.schema.get_field_index(text))):
                own = shingles(x.as_py(), shingle)
                keys[i] = xxhash.xxh64_intdigest(own.tobytes(), SEED)
                prints[i] = set_fingerprints(own)
                firsts.append(heads(own, least).view(np.int64).tolist())
            wide = pa.ListArray.from_arrays(pa.array(np.arange(batch.num_rows + 1) * TURNS, pa.int32()), pa.array(prints.ravel().view(np.int64)))
            added = [pa.array(keys.view(np.int64)), wide, pa.array(firsts, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *added], names=[*batch.schema.names, *names])

    added = [T.StructField(n, t) for n, t in zip(names, (T.LongType(), T.ArrayType(T.LongType()), T.ArrayType(T.LongType())))]
    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, *added]))


def sets_of(rows: DataFrame, wanted: DataFrame, text: str, shingle: int) -> DataFrame:
    """(key, n, grams) of the rows whose rid is in ``wanted``; other texts are dropped by a bitmap, unshuffled. Its size follows the number wanted up to
    BITMAP bits; beyond, it drops fewer, and the join does the rest."""
    rid = HIDDEN + "rid"
    bits = min(BITMAP, max(1 << 16, 1 << (BITS_EACH * wanted.count()).bit_length()))  # from the files' footers
    at = F.pmod(F.xxhash64(rid), F.lit(bits)) + 1
    parts = wanted.groupBy(F.bitmap_bucket_number(at).alias("part")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(at)).alias("bits")).collect()  # BITMAP / 8 bytes at most
    width = max((len(p["bits"]) for p in parts), default=0)
    table = np.zeros((bits // (8 * width) if width else 0, width), np.uint8)
    for p in parts:
        table[p["part"] - 1] = np.frombuffer(p["bits"], np.uint8)
    shared = rows.sparkSession.sparkContext.broadcast(table.ravel())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = shared.value
        for batch in batches:
            at = batch.column(3).to_numpy()
            hit = np.flatnonzero(bits[at >> 3] >> (at & 7).astype(np.uint8) & 1) if len(bits) else np.zeros(0, np.int64)
            if len(hit):
                some = batch.take(pa.array(hit))
                grams = [shingles(x.as_py(), shingle).tobytes() for x in some.column(2)]
                sizes = pa.array([len(g) // 8 for g in grams], pa.int64())
                yield pa.RecordBatch.from_arrays([*some.columns[:2], sizes, pa.array(grams, pa.binary())], names=["rid", "key", "n", "grams"])

    seen = rows.select(rid, HIDDEN + "key", text, (at - 1).alias("at"))
    held = seen.mapInArrow(run, "rid long, key long, n long, grams binary")
    return written(held.join(wanted.withColumnRenamed(rid, "rid"), "rid", "left_semi").drop("rid"), "sets", arrow_rows=ROWS_AT_ONCE)


def verified(pairs: DataFrame, held: DataFrame, least: float) -> DataFrame:
    """The pairs (a, b) of classes whose sets are similar."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = ((np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)) for x, y in zip(batch.column(2), batch.column(3)))
            good = [i for i, (x, y) in enumerate(sets) if similar(x, y, least)]
            yield pa.RecordBatch.from_arrays([batch.column(c).take(pa.array(good, pa.int64())) for c in (0, 1)], names=["a", "b"])

    side = lambda n: held.select(F.col("key").alias(n), F.col("grams").alias("of_" + n))
    return written(pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "of_a", "of_b").mapInArrow(run, LINK), "links", arrow_rows=ROWS_AT_ONCE)


def across(key: np.ndarray, root: np.ndarray, side: np.ndarray, sets: list[np.ndarray], least: float) -> Iterator[tuple[int, int]]:
    """Links (a, b) between members of different components that join all components linked by some pair of ``least`` or more.

    side: pairs of one side are left out (another task has them), unless all are of one. An inverted index gives a member's
    common shingles with all others at once. Members of the largest component need no turn: its links show from the other end.
    """
    n, sizes = len(key), np.array([len(x) for x in sets])
    _, at = np.unique(np.concatenate(sets), return_inverse=True)
    of = np.repeat(np.arange(n), sizes)
    order = np.argsort(at, kind="stable")
    posted, ends = of[order], np.cumsum(np.bincount(at))
    starts, begins = np.concatenate([[0], ends[:-1]]), np.concatenate([[0], np.cumsum(sizes)])
    _, group = np.unique(root, return_inverse=True)
    one_side = (side == side[0]).all()
    largest = np.argmax(np.bincount(group))
    for i in np.flatnonzero(group != largest):
        open_ = (group != group[i]) & (one_side | (side != side[i]))
        if not open_.any():
            continue
        own = at[begins[i] : begins[i + 1]]
        lengths = ends[own] - starts[own]
        where = np.repeat(starts[own] - np.concatenate([[0], np.cumsum(lengths)[:-1]]), lengths) + np.arange(lengths.sum())
        both = np.bincount(posted[where], minlength=n)
        hits = np.flatnonzero(open_ & (both >= least * (sizes + sizes[i] - both) - 1e-9))
        for j in hits:
            if group[j] != group[i]:
                yield int(key[i]), int(key[j])
                group[group == group[j]] = group[i]
    return


def met(members: DataFrame, least: float) -> DataFrame:
    """Links (a, b) between components within buckets (components of candidates). members: value, i, j (groups that meet), side, key, root, grams."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def links(rows):
            key, root, side = (np.array(x, np.int64) for x in zip(*((r[3], r[4], r[5]) for r in rows)))
            if (root == root[0]).all():
                return
            found = list(across(key, root, side, [np.frombuffer(r[6], np.uint64) for r in rows], least))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*found)], names=["a", "b"])

        now, rows = None, []
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if row[:3] != now and rows:
                    yield from links(rows)
                    rows = []
                now = row[:3]
                rows.append(row)
        if rows:
            yield from links(rows)

    keys = ["value", "i", "j"]
    return members.select(*keys, "key", "root", "side", "grams").repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, LINK)


def links(rows: DataFrame, of_key: DataFrame, text: str, shingle: int, least: float, group_rows: int = GROUP_ROWS, group_shingles: int = GROUP_SHINGLES) -> DataFrame:
    """Pairs (a, b) of classes at ``least`` or more that span the components found."""
    members = written(candidate_groups(of_key).select(F.col("root").alias("value"), F.col("node").alias("key"), F.col("root").alias("low")), "buckets")
    wanted = written(of_key.join(members.select("key"), "key", "left_semi").select(F.col("best.rid").alias(HIDDEN + "rid")), "wanted")
    held = sets_of(rows, wanted, text, shingle)
    first = verified(members.where("key <> low").select(F.col("low").alias("a"), F.col("key").alias("b")), held, least)
    roots = components(first, "a", "b").withColumnRenamed("node", "key")
    placed = members.join(roots, "key", "left").withColumn("root", F.coalesce("root", "key")).join(held.select("key", "n"), "key")
    sizes = F.greatest(F.ceil(2 * F.count("*") / group_rows), F.ceil(2 * F.sum("n") / group_shingles)).cast("int").alias("cuts")
    mixed = placed.groupBy("value").agg(F.min("root").alias("x"), F.max("root").alias("y"), sizes).where("x <> y")
    mixed = written(mixed.select("value", F.when(F.col("cuts") > 2, F.col("cuts")).otherwise(1).alias("cuts")), "cuts")
    placed = written(placed.join(mixed, "value").withColumn("side", F.pmod(F.xxhash64("key"), F.col("cuts")).cast("long")), "mixed")
    meets = F.transform(F.sequence(F.lit(0), F.col("cuts") - 1), lambda x: F.struct(F.least(x, F.col("side")).alias("i"), F.greatest(x, F.col("side")).alias("j")))
    second = written(met(placed.select("value", "key", "root", "side", F.inline(meets)).join(held.select("key", "grams"), "key"), least), "links", arrow_rows=ROWS_AT_ONCE)
    return first.unionByName(second)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text: str = "text", shingle: int = SHINGLE, least: float = LEAST, group_rows: int = GROUP_ROWS) -> DataFrame:
    """``docs`` with ``component_id`` (smallest id that the row reaches over links) and ``representative`` (true for one
    row of each component: the first by id)."""
    need(docs, id_col, text)
    rid, key = HIDDEN + "rid", HIDDEN + "key"
    out = [c for c in docs.columns if c not in ("component_id", "representative")]
    rows = written(with_row_id(signed(docs.select(*dict.fromkeys([*out, id_col, text])), text, shingle, least), rid), "shingles", arrow_rows=ROWS_AT_ONCE)
    best = F.min(F.struct(F.col(id_col).isNull().alias("none"), F.col(id_col).alias("id"), F.col(rid).alias("rid"))).alias("best")
    of_key = written(rows.groupBy(F.col(key).alias("key")).agg(best, *[F.first(HIDDEN + x).alias(x) for x in ("prints", "heads")]), "classes")
    roots = components(links(rows, of_key, text, shingle, least, group_rows), "a", "b")
    linked = of_key.join(roots, of_key["key"] == roots["node"], "left").select("key", "best", F.coalesce("root", "key").alias("root"))
    of_root = linked.groupBy("root").agg(F.min("best").alias("best"))
    group = linked.select(F.col("key").alias(key), "root").join(of_root, "root").select(key, "best")
    got = rows.drop(HIDDEN + "prints", HIDDEN + "heads").join(group, key)
    return got.select(*out, F.col("best.id").alias("component_id"), (F.col("best.rid") == F.col(rid)).alias("representative"))
