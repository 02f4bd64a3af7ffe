"""SimHash near-duplicate groups through a Gray-order hierarchical index.

Fingerprints: 64 bits, a majority vote over the XXH64 (seed 42) of a text's word shingles.
Linking: distinct fingerprints are dealt out by bands. Two fingerprints that differ in at most
``max_bits`` bits agree in at least one of ``max_bits + 1`` bands, so a table per band holds every
link in some bucket. Inside each task the rows of a band are sorted by the Gray rank of the
fingerprint rotated to start with that band, which puts buckets and similar patterns side by side.
A hierarchy stands above them: a node keeps the bits that all its members share (mask and pattern).
The join walks pairs of nodes from the top, adds up the differences in the bits that each level
newly fixes, and drops a pair of whole groups once the sum passes the bound, once the shared band
differs, or once both groups are already one component. Each task returns a spanning forest of its
links, never all pairs.

Defined cases: a null text counts as empty; a text without words has fingerprint zero and links like any
other. Equal fingerprints are one entry of the index, so copies are never expanded into pairs. Null
ids take part in grouping but are never the smallest id while another is there; a group of null ids
alone has a null ``component_id``. Repeated rows stay rows. Very long texts are taken whole, their hashes counted in blocks. Columns of the input named ``fp``,
``component_id`` or ``representative`` are replaced, others pass through. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dendra.llm.common import HIDDEN, SEED, need, with_row_id, without, written
from dendra.operators.components import components

SHINGLE = 3
MAX_BITS = 3
#: Hashes whose bits are counted at once; bounds memory on very long texts.
BLOCK = 1 << 16
#: Children of a node.
FAN = 8
#: Pairs of nodes expanded at once.
FRONTIER = 1 << 14
#: Fingerprints in one bucket above which the bucket is dealt out again by the bits it doesn't share, and how often at most: three
#: times leaves one bit in four of those not shared to the last bands, so a larger bucket holds near copies in great number.
HOT_BUCKET = 1 << 14
DEALS = 3
#: Fingerprints of small buckets that share an index.
BATCH = 1 << 13
#: Entries of the index per task.
TASK_ROWS = 1 << 18
#: Fingerprints of a set in ``set_fingerprints``, and the differing bits that their candidates may have; quarters are the bands.
TURNS = 40
TURN_BITS = 9
QUARTERS = 4
#: Differing bits that another fingerprint of two candidates may have. Sets at 0.8 differ in 9.7 of 64 on average; unrelated ones stay within with a probability of 4e-5.
MORE_BITS = 16
#: Sets (as a power of two) up to which a quarter is a band. Beyond, each doubling adds a bit of another fingerprint, and bands in as many variants as it takes
#: for two sets at 0.8, which agree in a bit with a probability of AGREE, to meet as often.
BAND_POWER, AGREE = 26, 0.8485
#: Turns at which a round of ``candidate_groups`` begins: few first, so that a group is joined once and not by every turn.
ROUNDS = (0, 1, 4)
#: Hashes whose bits are counted at once in bytes.
VOTES = 255
#: Entries of a bucket of ``candidates`` above which it is cut into groups, and the share of sets (one in so many) that sizes are taken from.
HOT_QUARTER = 1 << 12
SAMPLE = 64
#: Entries of small buckets that share an index there, and pairs of its nodes expanded at once. A bound of
#: nine bits leaves more pairs open than one of three, hence smaller numbers.
QUARTER_BATCH = 1 << 11
QUARTER_FRONTIER = 1 << 12
_MIX = np.random.RandomState(SEED).randint(0, 1 << 62, TURNS + 1).astype(np.uint64) * np.uint64(4) + np.uint64(1)


# fingerprints


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """The contract's fingerprint of one text, as an unsigned number."""
    words = (text or "").encode().lower().split()  # on bytes: A-Z only, and the six ASCII separators only
    if not words:
        return 0
    joined = memoryview(b" ".join(words))
    starts = np.zeros(len(words) + 1, np.int64)
    np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1, out=starts[1:])
    n = max(1, len(words) - shingle + 1)
    ends = starts[min(shingle, len(words)) :] - 1
    ones = np.zeros(64, np.int64)
    for a in range(0, n, BLOCK):
        b = min(n, a + BLOCK)
        hashes = np.array([xxhash.xxh64_intdigest(joined[s:e], SEED) for s, e in zip(starts[a:b].tolist(), ends[a:b].tolist())], dtype="<u8")
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, text: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """``docs`` with ``fp`` (long: the 64 bits as a signed number). One pass, no shuffle."""
    need(docs, text)
    docs = without(docs, "fp")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index(text)
            values = np.array([fingerprint(x.as_py(), shingle) for x in batch.column(at)], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(values.view(np.int64))], names=[*batch.schema.names, "fp"])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField("fp", T.LongType())]))


def set_fingerprints(hashes: np.ndarray) -> np.ndarray:
    """TURNS fingerprints of a set of hashes, each a majority vote over the hashes mixed in another way."""
    counts = np.zeros((8, TURNS, 8), np.int64)  # bit of a byte, turn, byte
    lanes = np.zeros((8, TURNS), np.uint64)
    for a in range(0, len(hashes), VOTES):
        x = hashes[a : a + VOTES, None] * _MIX[:TURNS]
        x ^= x >> np.uint64(32)
        x *= _MIX[TURNS]
        x ^= x >> np.uint64(29)
        for bit in range(8):
            np.sum(x & np.uint64(0x0101010101010101), axis=0, out=lanes[bit])
            x >>= np.uint64(1)
        counts += lanes.view(np.uint8).reshape(8, TURNS, 8)
    return np.packbits((2 * counts > len(hashes)).transpose(1, 2, 0), axis=2, bitorder="little").reshape(TURNS, 8).view("<u8").ravel()


# index


def gray_rank(x: np.ndarray) -> np.ndarray:
    """Position of a 64-bit pattern in the reflected Gray code."""
    x = x.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        x ^= x >> np.uint64(shift)
    return x


def rotated(x: np.ndarray, by: int) -> np.ndarray:
    return x if by % 64 == 0 else (x << np.uint64(by % 64)) | (x >> np.uint64(64 - by % 64))


def find(parent: np.ndarray) -> np.ndarray:
    """Full path compression over all entries at once."""
    while True:
        up = parent[parent]
        if np.array_equal(up, parent):
            return parent
        parent = up


def union(parent: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Joins the sets of a[i] and b[i]; a set's root is its smallest entry."""
    while True:
        ra, rb = parent[a], parent[b]
        open_ = ra != rb
        if not open_.any():
            return parent
        a, b, ra, rb = a[open_], b[open_], ra[open_], rb[open_]
        np.minimum.at(parent, np.maximum(ra, rb), np.minimum(ra, rb))
        parent = find(parent)


class GrayIndex:
    """Hierarchy over fingerprints sorted by Gray rank; level 0 holds the fingerprints themselves."""

    def __init__(self, patterns: np.ndarray, shared: np.ndarray):
        """patterns: sorted by Gray rank. shared: mask of the bits in which partners must agree, one for all."""
        full = np.full(len(patterns), 0xFFFFFFFFFFFFFFFF, np.uint64)
        self.patterns, self.masks, self.must = [patterns], [full], shared
        while len(self.patterns[-1]) > 1:
            p, m = self.patterns[-1], self.masks[-1]
            cuts = np.arange(0, len(p), FAN)
            ones = np.bitwise_and.reduceat(p & m, cuts)
            zeros = np.bitwise_and.reduceat(~p & m, cuts)
            self.patterns.append(ones)
            self.masks.append(ones | zeros)

    def links(self, parent: np.ndarray, max_bits: int, frontier: int = FRONTIER, accept: Callable[[np.ndarray, np.ndarray], np.ndarray] | None = None) -> np.ndarray:
        """``parent`` with the sets of all pairs at ``max_bits`` or fewer differing bits joined; ``frontier``: pairs expanded at once; ``accept``:
        which of such pairs (a, b) count."""
        top = len(self.patterns) - 1
        one = np.zeros(1, np.int64)
        stack = [(top, one, one, np.zeros(1, np.int64), np.zeros(1, np.uint64))]
        while stack:
            level, a, b, total, done = stack.pop()
            if len(a) > frontier:
                half = len(a) // 2
                stack += [(level, a[half:], b[half:], total[half:], done[half:]), (level, a[:half], b[:half], total[:half], done[:half])]
                continue
            fixed = self.masks[level][a] & self.masks[level][b]
            fresh = (self.patterns[level][a] ^ self.patterns[level][b]) & fixed & ~done
            total = total + np.bitwise_count(fresh)
            stay = (total <= max_bits) & (fresh & self.must == 0)
            if level == 0:
                stay &= a < b
                a, b = a[stay], b[stay]
                if accept is not None and len(a):
                    good = accept(a, b)
                    a, b = a[good], b[good]
                parent = union(parent, a, b)
                continue
            stay &= ~self._joined(parent, level, a, b)
            a, b, total, fixed = a[stay], b[stay], total[stay], fixed[stay]
            if not len(a):
                continue
            k = np.arange(FAN)
            n = len(self.patterns[level - 1])
            ca = np.broadcast_to((a * FAN)[:, None, None] + k[:, None], (len(a), FAN, FAN)).ravel()
            cb = np.broadcast_to((b * FAN)[:, None, None] + k[None, :], (len(a), FAN, FAN)).ravel()
            real = (ca < n) & (cb < n) & (ca <= cb)
            of = np.repeat(np.arange(len(a)), FAN * FAN)[real]
            stack.append((level - 1, ca[real], cb[real], total[of], fixed[of]))
        return parent

    def _joined(self, parent: np.ndarray, level: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether the members of both nodes already are one set. Looks at each node once."""
        size = FAN**level
        nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
        first = np.minimum(nodes * size, len(parent) - 1)
        last = np.minimum(first + size, len(parent))
        uniform = np.array([bool((parent[f:l] == parent[f]).all()) for f, l in zip(first.tolist(), last.tolist())]) if size <= 4096 else np.zeros(len(nodes), bool)
        roots = np.where(uniform, parent[first], -1)[at]
        ra, rb = roots[: len(a)], roots[len(a) :]
        return (ra >= 0) & (ra == rb)


def bucket_links(fps: np.ndarray, shared: int, max_bits: int, frontier: int = FRONTIER) -> tuple[np.ndarray, np.ndarray]:
    """Spanning forest over the fingerprints, of which all agree in the bits of ``shared``. They are turned so that these come first."""
    shift = 64 - shared.bit_length() if shared else 0
    turned = np.unique(rotated(fps, shift))
    turned = turned[np.argsort(gray_rank(turned))]
    parent = GrayIndex(turned, rotated(np.array([shared], np.uint64), shift)[0]).links(np.arange(len(turned)), max_bits, frontier) if len(turned) else np.zeros(0, np.int64)
    child = np.flatnonzero(parent != np.arange(len(turned)))
    back = rotated(turned, 64 - shift)
    return back[parent[child]], back[child]


def quarter_links(fps: np.ndarray, more: np.ndarray, shared: int) -> tuple[np.ndarray, np.ndarray]:
    """Places (a, b) of entries that join all entries with equal ``fps``, and all that agree in the bits of ``shared``, differ in TURN_BITS or fewer bits
    and in MORE_BITS or fewer bits of ``more``, another fingerprint of their sets."""
    shift = 64 - shared.bit_length()
    turned = rotated(fps, shift)
    order = np.lexsort((more, gray_rank(turned)))
    turned, more = turned[order], more[order]
    fresh = np.append(True, turned[1:] != turned[:-1])
    parent = np.maximum.accumulate(np.where(fresh, np.arange(len(turned)), 0))  # equal ones are side by side
    index = GrayIndex(turned, rotated(np.array([shared], np.uint64), shift)[0])
    parent = index.links(parent, TURN_BITS, QUARTER_FRONTIER, lambda a, b: np.bitwise_count(more[a] ^ more[b]) <= MORE_BITS)
    child = np.flatnonzero(parent != np.arange(len(turned)))
    return order[parent[child]], order[child]


# links between all fingerprints


def bands(max_bits: int, bits: list[int]) -> list[int]:
    """Masks that split ``bits`` (bit numbers) into max_bits + 1 runs of near equal length."""
    k = max_bits + 1
    cut = [len(bits) * i // k for i in range(k + 1)]
    return [sum(1 << b for b in bits[cut[i] : cut[i + 1]]) for i in range(k)]


def links(fps: DataFrame, max_bits: int = MAX_BITS, hot: int = HOT_BUCKET, deals: int = DEALS) -> DataFrame:
    """Pairs (a, b) of distinct fingerprints of ``fps`` (column fp) that span every component of the link graph.

    A bucket with more than ``hot`` fingerprints is dealt out again by bands of the bits that its members needn't share, which keeps
    every link by the same argument, and again while it is too large, up to ``deals`` times in all. A bucket is known by the mask of
    its shared bits, their pattern, and the number of its bits dealt last.
    """
    signed = lambda x: x - (1 << 64) if x >= 1 << 63 else x
    mask_of = {0: 0}  # number of a mask (base max_bits + 2 digits, one per deal) to the mask: 4 + 16 + 64 at most

    def deal(rows: DataFrame, numbers: list[int]) -> DataFrame:
        """rows (fp, mask: number) with the mask's bands added and the pattern under the wider mask."""
        cases = None
        for number in numbers:
            old = mask_of[number]
            fresh = []
            for i, band in enumerate(bands(max_bits, [b for b in range(64) if not old >> b & 1])):
                wider = number * (max_bits + 2) + i + 1
                mask_of[wider] = old | band
                fresh.append(F.struct(F.lit(wider).alias("mask"), F.col("fp").bitwiseAND(F.lit(signed(old | band)).cast("long")).alias("pattern")))
            cases = F.when(F.col("mask") == number, F.array(*fresh)) if cases is None else cases.when(F.col("mask") == number, F.array(*fresh))
        return rows.select("fp", F.inline(cases))

    todo, done = deal(fps.select("fp", F.lit(0).alias("mask")), [0]), []
    for turn in range(1, deals + 1):
        todo = written(todo, "bands")
        large = todo.groupBy("mask", "pattern").agg(F.count("*").alias("n")).where(F.col("n") > hot).select("mask", "pattern")
        if turn == deals or not large.take(1):
            done.append(todo)
            break
        large = written(large, "large")  # at most one bucket per ``hot`` entries
        done.append(todo.join(large, ["mask", "pattern"], "left_anti"))
        numbers = [n for n in mask_of if (max_bits + 2) ** (turn - 1) <= n]
        todo = deal(todo.join(large, ["mask", "pattern"], "left_semi").select("fp", "mask"), numbers)
    rows = reduce(DataFrame.unionByName, [d.select("fp", "mask", "pattern") for d in done])
    tasks = max(1, -(-rows.count() // TASK_ROWS), int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by bucket. Buckets of one mask share an index up to BATCH fingerprints: it only links what agrees in the mask."""

        def linked(mask: int, own: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
            whole = np.concatenate(own).view(np.uint64)
            if len(whole) < 2:
                return
            a, b = bucket_links(whole, mask_of[mask], max_bits)
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])

        now, own, held = None, [], 0
        for batch in batches:
            fp, mask, pattern = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
            cuts = np.flatnonzero((mask[1:] != mask[:-1]) | (pattern[1:] != pattern[:-1])) + 1
            for a, b in zip(np.append(0, cuts).tolist(), np.append(cuts, len(fp)).tolist()):
                if a < b:
                    key = (mask[a], pattern[a])
                    if now is not None and now != key and (now[0] != key[0] or held > BATCH):
                        yield from linked(int(now[0]), own)
                        own, held = [], 0
                    now = key
                    own.append(fp[a:b])
                    held += b - a
        if own:
            yield from linked(int(now[0]), own)

    return rows.repartition(tasks, "mask", "pattern").sortWithinPartitions("mask", "pattern").mapInArrow(run, "a long, b long")


def candidate_groups(sets: DataFrame, hot: int = HOT_QUARTER, power: int = BAND_POWER) -> DataFrame:
    """(node, root) of every key of ``sets`` with a candidate: root is the smallest key that it reaches over candidates.

    sets: key, prints (``set_fingerprints``), heads. Two sets are candidates if some fingerprint agrees in one of its quarters and
    differs in TURN_BITS or fewer bits in all, and the fingerprint half the turns on in MORE_BITS or fewer; or if they have a head in common. Unrelated
    sets are candidates with a probability of 7e-13, so their number stays small beside the links' at any size. Later rounds only join what earlier ones left apart.
    """
    groups, n = None, sets.count()
    for start, end in zip(ROUNDS, (*ROUNDS[1:], TURNS)):
        part = sets.select("key", "prints", ("heads" if start == 0 else F.array().cast("array<long>").alias("heads")))
        if groups is None:
            found = candidates(part.withColumn("label", F.col("key")), start, end - start, n, hot, power)
        else:
            part = part.join(groups, part["key"] == groups["node"], "left").select("key", "prints", "heads", F.coalesce("root", "key").alias("label"))
            found = candidates(part, start, end - start, n, hot, power).unionByName(groups.select(F.col("node").alias("a"), F.col("root").alias("b")))
        groups = components(written(found, "pairs"), "a", "b")  # written first, as two Python functions in a task are two workers
    return groups


def candidates(sets: DataFrame, start: int, turns: int, n: int, hot: int, power: int = BAND_POWER) -> DataFrame:
    """Pairs (a, b) of labels that join the labels of all candidates among ``sets``: key, label, heads, prints; by ``turns`` turns from ``start``.
    n: how many sets there are.

    A bucket (turn, quarter, its pattern, and some bits of another turn where there are many sets) is searched by the index above. A bucket that the sample
    shows to be larger than ``hot`` is cut into groups, and each pair of groups is a bucket of its own; no entry is left out. A bucket is known by its band
    and 55 bits of a hash; two that share them would merely be searched together.
    """
    wide = 64 // QUARTERS
    low = (1 << wide) - 1
    extra = max(0, (n - 1).bit_length() - power)
    variants = int(np.ceil(AGREE**-extra))
    tag = lambda band, *what: F.shiftleft(band.cast("long"), 55).bitwiseOR(F.xxhash64(band.cast("long"), *what).bitwiseAND(F.lit((1 << 55) - 1)))
    of = lambda turn: F.element_at("prints", (F.pmod(turn, F.lit(TURNS)) + 1).cast("int"))

    def quarters(turn):
        def entry(i: int, variant: int):
            pattern = F.shiftrightunsigned(of(turn), wide * i).bitwiseAND(F.lit(low))
            besides = [of(turn + 1 + variant).bitwiseAND(F.lit((1 << extra) - 1)), F.lit(variant)] if extra else []
            return F.struct(tag(turn * QUARTERS + i, pattern, *besides).alias("bucket"), of(turn).alias("fp"), of(turn + TURNS // 2).alias("more"))

        return F.array(*[entry(i, v) for i in range(QUARTERS) for v in range(variants)])

    heads = F.transform("heads", lambda h: F.struct(tag(F.lit(TURNS * QUARTERS), h).alias("bucket"), h.alias("fp"), F.lit(0).cast("long").alias("more")))
    at = F.sequence(F.lit(start), F.lit(start + turns - 1))
    dealt = lambda df: df.select("key", "label", F.inline(F.concat(F.flatten(F.transform(at, quarters)), heads)))
    rows = dealt(sets)
    sample = dealt(sets.where(F.pmod(F.xxhash64("key"), F.lit(SAMPLE)) == 0)).groupBy("bucket").agg(F.count("*").alias("n"))
    large = written(sample.where(F.col("n") * SAMPLE > hot).select("bucket", F.ceil(2 * SAMPLE * F.col("n") / hot).cast("int").alias("cuts")), "large")
    if large.take(1):
        rows = rows.join(large, "bucket", "left").withColumn("side", F.pmod(F.xxhash64("key", F.lit(1)), F.coalesce("cuts", F.lit(1))))
        pair = lambda x: F.struct(F.least(x, F.col("side")).alias("i"), F.greatest(x, F.col("side")).alias("j"))
        meets = F.when(F.col("cuts").isNull(), F.array(F.struct(F.lit(0).alias("i"), F.lit(0).alias("j")))).otherwise(F.transform(F.sequence(F.lit(0), F.col("cuts") - 1), pair))
        band = F.shiftrightunsigned("bucket", 55)
        own = F.when(F.col("cuts").isNull(), F.col("bucket")).otherwise(tag(band, F.col("bucket"), F.col("i"), F.col("j")))
        rows = rows.select("bucket", "cuts", "fp", "more", "label", F.inline(meets)).select(own.alias("bucket"), "fp", "more", "label")
    tasks = max(1, -(-n * turns * QUARTERS * variants // TASK_ROWS), int(sets.sparkSession.conf.get("spark.sql.shuffle.partitions")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by bucket; buckets of one quarter share an index up to QUARTER_BATCH entries."""

        def linked(band: int, parts: list[tuple[np.ndarray, ...]]) -> Iterator[pa.RecordBatch]:
            fp, more, key = (np.concatenate(x) for x in zip(*parts))
            if len(fp) < 2:
                return
            if band < TURNS * QUARTERS:
                x, y = quarter_links(fp.view(np.uint64), more.view(np.uint64), low << wide * (band % QUARTERS))
                a, b = key[x], key[y]
            else:  # sets that share a head
                _, first, of = np.unique(fp, return_index=True, return_inverse=True)
                a, b = key[first[of]], key
            real = a != b
            if real.any():
                yield pa.RecordBatch.from_arrays([pa.array(a[real]), pa.array(b[real])], names=["a", "b"])

        now, parts, held = None, [], 0
        for batch in batches:
            bucket, *own = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
            band = bucket >> 55
            cuts = np.flatnonzero(bucket[1:] != bucket[:-1]) + 1
            for s, e in zip(np.append(0, cuts).tolist(), np.append(cuts, len(bucket)).tolist()):
                if s < e:
                    if now is not None and now[0] != bucket[s] and (now[1] != band[s] or held > QUARTER_BATCH):
                        yield from linked(int(now[1]), parts)
                        parts, held = [], 0
                    now = (bucket[s], band[s])
                    parts.append(tuple(x[s:e] for x in own))
                    held += e - s
        if parts:
            yield from linked(int(now[1]), parts)

    return rows.select("bucket", "fp", "more", "label").repartition(tasks, "bucket").sortWithinPartitions("bucket").mapInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text: str = "text", shingle: int = SHINGLE, max_bits: int = MAX_BITS, keep: list[str] | None = None, least: float | None = None) -> DataFrame:
    """One row per row of ``docs``: its columns (or those of ``keep``), ``fp``, ``component_id`` (smallest id
    that it reaches) and ``representative`` (true for one row of each component: the first by id).

    least: link by this Jaccard similarity of the shingle sets instead of ``max_bits`` (no ``fp`` then). One fingerprint can't find such
    pairs (at 0.8 the median distance is 7 bits), so ``candidate_groups`` takes many, with a wider bound: see ``jaccard``."""
    if least is not None:
        from dendra.llm import jaccard  # it builds on this module

        got = jaccard.near_duplicates(docs, id_col, text, shingle, least)
        return got if keep is None else got.select(*keep, "component_id", "representative")
    need(docs, id_col, text)
    rid = HIDDEN + "rid"
    out = list(docs.columns) if keep is None else keep
    marked = with_row_id(fingerprints(docs.select(*dict.fromkeys([*out, id_col, text])), text, shingle), rid)
    rows = written(marked.select(*dict.fromkeys([*[c for c in out if c not in ("fp", "component_id", "representative")], id_col, "fp", rid])), "fingerprints")
    best = F.min(F.struct(F.col(id_col).isNull().alias("none"), F.col(id_col).alias("id"), F.col(rid).alias("rid"))).alias("best")
    of_fp = rows.groupBy("fp").agg(best)
    roots = components(links(of_fp.select("fp"), max_bits), "a", "b")
    linked = of_fp.join(roots, of_fp["fp"] == roots["node"], "left").select("fp", "best", F.coalesce("root", "fp").alias("root"))
    of_root = linked.groupBy("root").agg(F.min("best").alias("best"))
    group = linked.select("fp", "root").join(of_root, "root").select("fp", "best")
    got = rows.join(group, "fp")
    got = got.withColumns({"component_id": F.col("best.id"), "representative": F.col("best.rid") == F.col(rid)})
    return got.select(*[c for c in out if c not in ("fp", "component_id", "representative")], "fp", "component_id", "representative")
