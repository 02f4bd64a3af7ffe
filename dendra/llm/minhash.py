"""Near-duplicate groups by the Jaccard similarity of word shingles: MinHash bands, candidates judged by odd sketches, links confirmed on sets.

1. A text is the set of its shingles (XXH64 of the words in lower case). Texts with equal sets are one class, never expanded into pairs. A class
   has SAMPLES MinHash values: BANDS bands of ROWS, and an odd sketch of them (Mitzenmacher, Pagh, Pham 2014): each value flips one bit
   of SKETCH. Where two sets differ in d samples their sketches differ in 2d bits at most, and ``similarity`` estimates from that number.
2. Classes that share a band meet in its bucket. Inside a bucket every pair's sketches are compared, and a pair stays a candidate up to
   ``sketch_limit`` differing bits: beyond it lie pairs at the bound with a probability of MISS only. A task returns a spanning forest of its candidates.
3. Inside a connected group of candidates, pairs that the sketches don't rule out are confirmed on the full sets, and a task returns a spanning forest of
   the links that hold; components of these are the result. Sets are built again from the texts of candidates alone, so texts are read twice, never shuffled.

``joined`` deals groups to tasks: up to ``rows`` members are one task's work. A larger group is cut into parts, its first member is put in each, and
what that leaves outside the group's largest component visits every part. So a group of copies takes room in proportion to its members however large it is,
and no pair between different components goes unseen.

A pair of sets at exactly 0.85 is missed with a probability of 7e-9 by the bands and 1e-9 by the sketches; more similar ones less often.

Defined cases: null texts and texts without words have no shingle and are linked with nothing; a text shorter than a shingle is one shingle; very long
texts are taken whole; repeated rows stay rows; null ids are never the smallest while another is there; columns of the input that are named as a
result are replaced, others pass through; an empty table gives an empty result. Texts that change between the two reads are an error.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dendra.llm.common import HIDDEN, SEED, need, with_row_id, written
from dendra.llm.jaccard import shingles
from dendra.operators.components import components, roots_of

SHINGLE = 3
#: Link at this similarity or more, in hundredths.
PERCENT = 85
BANDS, ROWS = 32, 5
SAMPLES = BANDS * ROWS
#: Bits of a sketch, and of its words.
SKETCH, WORD = 512, 64
MISS = 1e-9
#: Shingles whose samples are taken at once.
BLOCK = 256
#: Members of a bucket, members of a group of candidates, and shingles of theirs, that a task compares at once.
BUCKET_ROWS, GROUP_ROWS, GROUP_SHINGLES = 1 << 12, 1 << 11, 1 << 21
#: Members of a bucket up to which its pairs are compared by their distance in the sorted rows.
SMALL = 16
#: Candidates of a member up to which sets are intersected one by one.
FEW = 4
#: Bits of the map of wanted texts per text, and the most.
BITS_EACH, BITS = 16, 1 << 28
_A = np.random.RandomState(SEED).randint(0, 1 << 62, SAMPLES + 1).astype(np.uint64) * np.uint64(4) + np.uint64(1)
LINK = "a long, b long"


# samples and sketches


def samples(hashes: np.ndarray) -> np.ndarray:
    """MinHash values of a set of hashes: the least of all under each of SAMPLES permutations."""
    least = np.full(SAMPLES, ~np.uint64(0))
    for a in range(0, len(hashes), BLOCK):
        np.minimum(least, (hashes[a : a + BLOCK, None] * _A[:SAMPLES]).min(axis=0), out=least)
    return least


def bands(values: np.ndarray) -> np.ndarray:
    """A hash per band, its number included."""
    own = values.reshape(BANDS, ROWS)
    return np.array([xxhash.xxh64_intdigest(own[i].tobytes(), i) for i in range(BANDS)], np.uint64)


def odd_sketch(values: np.ndarray, bits: int = SKETCH) -> np.ndarray:
    """Words of the parity bitmap: a bit is one where an odd number of values fall on it."""
    at = ((values ^ (values >> np.uint64(29))) * _A[SAMPLES]) >> np.uint64(64 - bits.bit_length() + 1)
    return np.packbits((np.bincount(at.astype(np.int64), minlength=bits) & 1).astype(np.uint8), bitorder="little").view("<u8")


def apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Differing bits of sketches, row by row."""
    return np.bitwise_count(a ^ b).sum(axis=-1, dtype=np.int64)


def similarity(differing: np.ndarray, bits: int = SKETCH, count: int = SAMPLES) -> np.ndarray:
    """The estimate from the number of differing bits, 0 at least."""
    share = np.clip(1 - 2 * np.asarray(differing) / bits, 1 / bits, 1)
    return np.maximum(0, 1 + bits / (4 * count) * np.log(share))


def sketch_limit(percent: int = PERCENT, bits: int = SKETCH, count: int = SAMPLES, miss: float = MISS) -> int:
    """The least number of differing bits that two sets at ``percent`` hundredths exceed with a probability of ``miss`` or less.

    The number of samples that differ is binomial; each flips a bit of either sketch, so the differing bits take two steps, up or down by one each.
    """
    p, total, odd = 1 - percent / 100, np.zeros(bits + 1), np.zeros(bits + 1)
    odd[0], at = 1.0, np.arange(bits + 1)
    for d in range(count + 1):
        total += comb(count, d) * p**d * (1 - p) ** (count - d) * odd
        for _ in range(2):
            up, down = odd * (bits - at) / bits, odd * at / bits
            odd = np.concatenate([[0], up[:-1]]) + np.concatenate([down[1:], [0]])
    beyond = 1 - np.cumsum(total)
    return int(np.flatnonzero(beyond <= miss)[0])


def signed(docs: DataFrame, text: str, shingle: int) -> DataFrame:
    """``docs`` without the text, with key (of the shingle set), n, bands and sketch. One pass, no shuffle."""
    kept = [c for c in docs.columns if c != text]
    added = {HIDDEN + "key": T.LongType(), "n_shingles": T.LongType(), HIDDEN + "bands": T.ArrayType(T.LongType()), HIDDEN + "sketch": T.ArrayType(T.LongType())}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            m = batch.num_rows
            keys, sizes, wide, odd = np.zeros(m, np.uint64), np.zeros(m, np.int64), np.zeros((m, BANDS), np.uint64), np.zeros((m, SKETCH // WORD), np.uint64)
            for i, x in enumerate(batch.column(batch.schema.get_field_index(text))):
                own = shingles(x.as_py(), shingle)
                keys[i], sizes[i] = xxhash.xxh64_intdigest(own.tobytes(), SEED), len(own)
                if len(own):
                    values = samples(own)
                    wide[i], odd[i] = bands(values), odd_sketch(values)
            lists = [pa.ListArray.from_arrays(pa.array(np.arange(m + 1) * x.shape[1], pa.int32()), pa.array(x.ravel().view(np.int64))) for x in (wide, odd)]
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(c)) for c in kept), pa.array(keys.view(np.int64)), pa.array(sizes), *lists], names=[*kept, *added])

    return docs.mapInArrow(run, T.StructType([*[docs.schema[c] for c in kept], *[T.StructField(k, v) for k, v in added.items()]]))


# tasks


class Members:
    """Rows of whole groups: key, label (of what is joined already), side, sketch, sets; ``of`` numbers the groups from 0."""

    def __init__(self, batch: pa.RecordBatch | pa.Table):
        take = lambda n: batch.column(n).to_numpy()
        marks = [take(n) for n in ("group", "i", "j")]
        cut = np.zeros(batch.num_rows, bool)
        for x in marks:
            cut[1:] |= x[1:] != x[:-1]
        self.of = np.cumsum(cut)
        self.key, self.label, self.side = (take(n) for n in ("key", "label", "side"))
        self.sketch = batch.column("sketch").combine_chunks().flatten().to_numpy().view(np.uint64).reshape(-1, SKETCH // WORD)
        self.grams = batch.column("grams") if "grams" in batch.schema.names else None

    def slices(self) -> Iterator[slice]:
        ends = np.append(np.flatnonzero(np.diff(self.of)) + 1, len(self.of)).tolist()
        yield from (slice(a, b) for a, b in zip([0, *ends], ends))


def whole_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[Members]:
    """Rows come sorted by group, i, j; what is yielded ends where a group does."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        now = held + [batch]
        marks = [batch.column(n).to_numpy() for n in ("group", "i", "j")]
        last = np.flatnonzero(np.logical_or.reduce([x[1:] != x[:-1] for x in marks]))
        first = held and any(held[-1].column(n)[-1].as_py() != x[0] for n, x in zip(("group", "i", "j"), marks))
        if len(last):
            at = int(last[-1]) + 1
            yield Members(pa.Table.from_batches([*held, batch.slice(0, at)]))
            held = [batch.slice(at)]
        elif first:
            yield Members(pa.Table.from_batches(held))
            held = [batch]
        else:
            held = now
    if held:
        yield Members(pa.Table.from_batches(held))


def forest(label: np.ndarray, side: np.ndarray, near: Callable[[int, np.ndarray], np.ndarray]) -> Iterator[tuple[int, int]]:
    """Pairs (a, b) of members near each other that join all labels so joined. Members of two sides are compared across sides only.
    near(a, others): which of the others are."""
    _, own = np.unique(label, return_inverse=True)
    two = side[0] != side[-1] or (side != side[0]).any()
    for a in np.flatnonzero(side) if two else range(len(own)):
        others = (own != own[a]) & (side != side[a]) if two else own != own[a]
        if not two:
            others[: a + 1] = False  # seen from the other end
        others = np.flatnonzero(others)
        if not len(others):
            continue
        hits = others[near(a, others)]
        groups, first = np.unique(own[hits], return_index=True)
        if len(groups):
            own[np.isin(own, groups)] = own[a]
            yield from ((a, int(b)) for b in hits[first])


def candidates(m: Members, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of keys that join all candidates of these groups."""
    sizes = np.bincount(m.of)
    small = (sizes <= SMALL)[m.of]
    out = []
    for d in range(1, min(SMALL, sizes.max(initial=0))):
        r = np.flatnonzero(small[:-d] & (m.of[d:] == m.of[:-d]) & (m.label[d:] != m.label[:-d]))
        r = r[apart(m.sketch[r], m.sketch[r + d]) <= limit]
        out.append((m.key[r], m.key[r + d]))
    for s in m.slices():
        if s.stop - s.start > SMALL:
            sketch, key = m.sketch[s], m.key[s]
            pairs = list(forest(m.label[s], m.side[s], lambda a, others: apart(sketch[others], sketch[a]) <= limit))
            if pairs:
                a, b = np.array(pairs).T
                out.append((key[a], key[b]))
    if not out:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    nodes, roots = roots_of(*(np.concatenate(x) for x in zip(*out)))
    return nodes[nodes != roots], roots[nodes != roots]


def confirmed(m: Members, limit: int, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of keys whose sets are similar, that join all such pairs of these groups."""
    out = []
    for s in m.slices():
        if (m.label[s] == m.label[s.start]).all():
            continue
        sets = [np.frombuffer(x.as_py(), np.uint64) for x in m.grams[s.start : s.stop]]
        sketch, key, sizes = m.sketch[s], m.key[s], np.array([len(x) for x in sets])
        posted: list = []

        def common(a: int, others: np.ndarray) -> np.ndarray:
            """Sizes of the intersections; for many others by an inverted index of the group's shingles."""
            if len(others) <= FEW:
                return np.array([len(np.intersect1d(sets[a], sets[b], assume_unique=True)) for b in others], np.int64)
            if not posted:
                _, at = np.unique(np.concatenate(sets), return_inverse=True)
                order = np.argsort(at, kind="stable")
                posted.extend([at, np.repeat(np.arange(len(sets)), sizes)[order], np.cumsum(np.bincount(at)), np.cumsum(sizes) - sizes])
            at, member, ends, begins = posted
            own = at[begins[a] : begins[a] + sizes[a]]
            starts = np.where(own > 0, ends[own - 1], 0)
            lengths = ends[own] - starts
            where = np.repeat(starts - (np.cumsum(lengths) - lengths), lengths) + np.arange(lengths.sum())
            return np.bincount(member[where], minlength=len(sets))[others]

        def near(a: int, others: np.ndarray) -> np.ndarray:
            hits = np.flatnonzero(apart(sketch[others], sketch[a]) <= limit)
            if len(hits):
                shared = common(a, others[hits])
                hits = hits[100 * shared >= percent * (sizes[a] + sizes[others[hits]] - shared)]
            return hits

        pairs = list(forest(m.label[s], m.side[s], near))
        if pairs:
            a, b = np.array(pairs).T
            out.append((key[a], key[b]))
    return tuple(np.concatenate(x) for x in zip(*out)) if out else (np.zeros(0, np.int64),) * 2


# joins


def joined(members: DataFrame, work: Callable[[Members], tuple[np.ndarray, np.ndarray]], rows: int, name: str) -> DataFrame:
    """(node, root) of the components of all pairs (a, b) that ``work`` finds in groups. members: group, parts (tasks that its size asks for), pivot
    (its first key), key, sketch, and grams where ``work`` wants them. See the module on groups of more parts than one."""
    more = [c for c in members.columns if c in ("sketch", "grams")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for m in whole_groups(batches):
            a, b = work(m)
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    def done(placed: DataFrame) -> DataFrame:
        dealt = placed.select("group", "i", "j", "side", "key", "label", *more).repartition("group", "i", "j").sortWithinPartitions("group", "i", "j")
        return written(dealt.mapInArrow(run, LINK), name)  # written first, as two Python functions in a task are two workers

    whole = lambda x: x.cast("long")
    home = F.pmod(F.xxhash64("key"), F.col("parts"))
    zero = F.lit(0).cast("long")
    place = F.when((F.col("parts") > 1) & (F.col("key") == F.col("pivot")), F.sequence(zero, F.col("parts") - 1)).otherwise(F.array(home))
    pairs = done(members.select("*", F.explode(place).alias("i"), zero.alias("j"), zero.alias("side"), F.col("key").alias("label")))
    found = components(pairs, "a", "b")
    large = members.where("parts > 1")
    if not large.take(1):
        return found
    labelled = large.join(found, large["key"] == found["node"], "left").withColumn("label", F.coalesce("root", "key"))
    each = labelled.groupBy("group", "label").agg(F.count("*").alias("n"))
    most = each.groupBy("group").agg(F.max(F.struct("n", "label"))["label"].alias("main"), (F.sum("n") - F.max("n")).alias("others"))
    most = most.where("others > 0").select("group", "main", whole(F.ceil(F.col("others") / rows)).alias("turns"))
    guest = F.pmod(F.xxhash64("key", F.lit(1)), F.col("turns"))
    spot = lambda i, j, side: F.struct(whole(i).alias("i"), whole(j).alias("j"), F.lit(side).cast("long").alias("side"))
    stays = F.transform(F.sequence(zero, F.col("turns") - 1), lambda j: spot(home, j, 0))
    visits = F.when(F.col("label") != F.col("main"), F.transform(F.sequence(zero, F.col("parts") - 1), lambda i: spot(i, guest, 1))).otherwise(F.slice(stays, 1, 0))
    again = done(labelled.join(most, "group").select("group", "key", "label", *more, F.inline(F.concat(stays, visits))))
    return components(pairs.unionByName(again), "a", "b")


def candidate_groups(classes: DataFrame, limit: int, rows: int = BUCKET_ROWS) -> DataFrame:
    """(node, root): classes connected by candidates. classes: key, bands, sketch."""
    dealt = classes.select("key", F.explode("bands").alias("group"))
    shared = dealt.groupBy("group").agg(F.count("*").alias("n"), F.min("key").alias("pivot")).where("n > 1")
    shared = shared.select("group", "pivot", F.ceil(F.col("n") / rows).cast("long").alias("parts"))
    met = dealt.join(shared, "group").groupBy("key").agg(F.collect_list(F.struct("group", "pivot", "parts")).alias("buckets"))  # BANDS at most
    return joined(met.join(classes.select("key", "sketch"), "key").select("key", "sketch", F.inline("buckets")), lambda m: candidates(m, limit), rows, "candidates")


def sets_of(docs: DataFrame, wanted: DataFrame, mark: str, text: str, shingle: int) -> DataFrame:
    """``wanted`` with the sets (n, grams) of its texts, found by ``mark``. Other texts are dropped, unshuffled, by a bitmap whose size follows the number
    wanted up to BITS bits; beyond that it drops fewer, and the join does the rest."""
    n = wanted.count()  # from the files' footers
    bits = min(BITS, max(1 << 16, 1 << (BITS_EACH * n).bit_length()))
    at = lambda c: F.pmod(F.xxhash64(c), F.lit(bits))
    spot = at(F.col(mark)) + 1
    parts = wanted.groupBy(F.bitmap_bucket_number(spot).alias("part")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(spot)).alias("bits")).collect()  # BITS / 8 bytes at most
    held = np.zeros(bits // 8, np.uint8)
    for p in parts:
        own = np.frombuffer(p["bits"], np.uint8)
        held[(p["part"] - 1) * len(own) :][: len(own)] = own[: bits // 8]
    shared = docs.sparkSession.sparkContext.broadcast(held)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, seen = shared.value, set()
        for batch in batches:
            at = batch.column(2).to_numpy()
            hits = np.flatnonzero(bits[at >> 3] >> (at & 7).astype(np.uint8) & 1).tolist()
            marks = batch.column(0).to_pylist()
            fresh = []
            for i in hits:
                if marks[i] not in seen:  # repeated rows
                    seen.add(marks[i])
                    fresh.append(i)
            if fresh:
                grams = [shingles(batch.column(1)[i].as_py(), shingle).tobytes() for i in fresh]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(fresh)), pa.array(grams, pa.binary())], names=["mark", "grams"])

    seen = docs.select(F.col(mark).alias("mark"), text, at(F.col(mark)).alias("at")).mapInArrow(run, "mark long, grams binary")
    got = written(seen.groupBy("mark").agg(F.first("grams").alias("grams")).join(wanted.withColumnRenamed(mark, "mark"), "mark").drop("mark"), "sets")
    if got.count() != n:
        raise RuntimeError("the documents changed between two reads")
    return got


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text: str = "text", shingle: int = SHINGLE, percent: int = PERCENT, keep: list[str] | None = None, bucket_rows: int = BUCKET_ROWS, group_rows: int = GROUP_ROWS) -> DataFrame:
    """One row per row of ``docs``: its columns (or those of ``keep``), ``n_shingles``, ``component_id`` (smallest id that it reaches) and
    ``representative`` (true for one row of each component: the first by id; always true without shingles)."""
    need(docs, id_col, text)
    rid, key, mark = (HIDDEN + x for x in ("rid", "key", "mark"))
    results = ["n_shingles", "component_id", "representative"]
    out = [c for c in (docs.columns if keep is None else keep) if c not in results]
    body, limit = HIDDEN + "text", sketch_limit(percent)
    given = docs.select(*dict.fromkeys([*out, id_col]), F.col(text).cast("string").alias(body)).withColumn(mark, F.xxhash64(id_col, body))
    rows = written(with_row_id(signed(given, body, shingle), rid), "samples")
    first = lambda c: F.first(HIDDEN + c).alias(c)
    best = F.min(F.struct(F.col(id_col).isNull().alias("none"), F.col(id_col).alias("id"), F.col(rid).alias("rid"))).alias("best")
    classes = written(rows.where("n_shingles > 0").groupBy(F.col(key).alias("key")).agg(best, F.first("n_shingles").alias("n"), F.min(mark).alias(mark), first("bands"), first("sketch")), "classes")
    groups = candidate_groups(classes, limit, bucket_rows).withColumnRenamed("node", "key")
    wanted = written(classes.join(groups, "key").select("key", F.col("root").alias("group"), "n", mark, "sketch"), "wanted")
    sets = sets_of(given, wanted, mark, body, shingle)
    parts = F.greatest(F.ceil(F.count("*") / group_rows), F.ceil(F.sum("n") / GROUP_SHINGLES)).cast("long").alias("parts")
    sized = wanted.groupBy("group").agg(parts, F.min("key").alias("pivot"))
    roots = joined(sets.join(sized, "group"), lambda m: confirmed(m, limit, percent), group_rows, "links")
    linked = classes.join(roots, classes["key"] == roots["node"], "left").select("key", "best", F.coalesce("root", "key").alias("root"))
    of_root = linked.groupBy("root").agg(F.min("best").alias("best"))
    group = linked.select(F.col("key").alias(key), "root").join(of_root, "root").select(key, "best")
    got = rows.drop(HIDDEN + "bands", HIDDEN + "sketch").join(group, key, "left")
    alone = F.col("n_shingles") == 0
    return got.select(*out, "n_shingles", F.when(alone, F.col(id_col)).otherwise(F.col("best.id")).alias("component_id"), (alone | (F.col("best.rid") == F.col(rid))).alias("representative"))
