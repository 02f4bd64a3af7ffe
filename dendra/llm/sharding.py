"""Balanced shards by longest-processing-time scheduling.

Rows with equal texts form a group that stays together. Groups, sorted by size, go to the shard with the least bytes so far, through a heap. Groups of one size
are alike to the heap, so it is given sizes with their counts: a run of a size goes to the shards in closed form (``run_of``), with the loads that one step
a group would give, and the groups of a size are dealt to the shards by their rank. The sizes differ, so there are at most sqrt(2 * bytes) of
them, which bounds what the driver holds (16 bytes each): some 250,000 at 30 GB, and far fewer where texts have the usual lengths.

Ranks come from ranges of (size, group) that a task numbers each, after the ranges before. Groups that hold many rows are sent to the rows, others joined, so
no group is one task's rows.

Defined cases: a null text counts as empty and has size 1; all null and empty texts are one group. Very long texts are rows like any other. Repeated rows and null
ids are rows like any other. Columns of the input that are named as a result are replaced, others pass through. An empty table gives an empty result. Groups are
known by a 64-bit hash of the text: two texts that share one would merely stay together.
"""

from __future__ import annotations

import heapq
from itertools import accumulate

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from dendra.llm.common import HIDDEN, need, text_of, with_row_id, without, written

SHARDS = 16
#: Groups that hold more than this share of all rows are sent to the rows: at most as many.
HOT_SHARE = 1 << 12
#: Groups of a size up to which the heap takes them one by one.
FEW = 32
#: Rows that one task numbers within a shard.
SLOT_ROWS = 1 << 20
ADDED = ["size", "text_crc32", "law", "shard", "slot"]


def run_of(loads: list[int], size: int, count: int) -> list[int]:
    """How many of ``count`` groups of one size each shard gets, the least loaded first, ties to the lowest; ``loads`` are raised.

    The j-th group of a shard finds it at load + j * size, so the run takes the ``count`` smallest of these, and their largest is found by halving."""
    if count <= FEW:
        heap, out = [(load, s) for s, load in enumerate(loads)], [0] * len(loads)
        heapq.heapify(heap)
        for _ in range(count):
            load, s = heapq.heappop(heap)
            out[s] += 1
            heapq.heappush(heap, (load + size, s))
    else:
        up_to = lambda top: [max(0, (top - load) // size + 1) for load in loads]
        low, high = min(loads) - 1, min(loads) + count * size
        while high - low > 1:
            middle = (low + high) // 2
            low, high = (low, middle) if sum(up_to(middle)) >= count else (middle, high)
        out, rest = up_to(low), up_to(high)
        for s in range(len(loads)):
            if sum(out) < count and rest[s] > out[s]:
                out[s] += 1
    for s, n in enumerate(out):
        loads[s] += n * size
    return out


def schedule(items: list[tuple[int, int]], shards: int) -> list[list[int]]:
    """For each (size, count), sizes falling: how many of the groups of that size each shard gets."""
    loads = [0] * shards
    return [run_of(loads, size, count) for size, count in items]


def assign(docs: DataFrame, shards: int = SHARDS, text: str = "text", hot_share: int = HOT_SHARE, slot_rows: int = SLOT_ROWS, keep: list[str] | None = None) -> DataFrame:
    """``docs`` (or its columns ``keep``) with size, text_crc32, law ('bytes'), shard and slot."""
    need(docs, text)
    if shards < 1:
        raise ValueError("shards must be at least 1")
    spark = docs.sparkSession
    out = [c for c in (docs.columns if keep is None else keep) if c not in ADDED]
    rid, group, sub = (HIDDEN + x for x in ("rid", "group", "sub"))
    t = text_of(text)
    facts = {"size": F.octet_length(t).cast("long") + 1, "text_crc32": F.crc32(t.cast("binary")), group: F.xxhash64(t)}
    rows = without(docs, *[c for c in ADDED if c != text]).withColumns(facts)
    rows = written(with_row_id(rows.select(*dict.fromkeys([*out, "size", "text_crc32", group])), rid), "sizes")  # texts are read once

    n = rows.count()  # from the files' footers
    groups = rows.groupBy(group).agg(F.sum("size").alias("bytes"), F.count("*").alias("rows"))
    order = [F.desc("bytes"), F.asc(group)]
    ranged = written(groups.repartitionByRange(*order).withColumn("part", F.spark_partition_id()), "groups")
    runs = ranged.groupBy("bytes", "part").count().toPandas().sort_values(["bytes", "part"], ascending=[False, True], ignore_index=True)  # a row per size and range
    counts = runs.groupby("bytes", sort=False)["count"].sum()
    taken = dict(zip(counts.index.tolist(), schedule(list(zip(counts.index.tolist(), counts.tolist())), shards)))
    runs["before"] = runs.groupby("bytes", sort=False)["count"].cumsum() - runs["count"]
    runs["ends"] = [list(accumulate(taken[b])) for b in runs["bytes"].tolist()]
    plan = spark.createDataFrame(runs[["bytes", "part", "before", "ends"]], "bytes long, part int, before long, ends array<long>")
    rank = F.row_number().over(Window.partitionBy("bytes", "part").orderBy(group)) - 1 + F.col("before")
    dealt = ranged.join(plan, ["bytes", "part"]).withColumn("rank", rank)
    dealt = written(dealt.select(group, "rows", F.size(F.filter("ends", lambda e: e <= F.col("rank"))).alias("shard")), "dealt")

    hot = F.col("rows") > max(1, n // hot_share)  # so at most hot_share groups, or such as have one row
    large = dealt.where(hot & (F.col("rows") > 1)).select(group, F.col("shard").alias("hot"))
    rows = rows.join(F.broadcast(large), group, "left")
    rest = rows.where("hot IS NULL").drop("hot").join(dealt.where(~(hot & (F.col("rows") > 1))).select(group, "shard"), group)
    subs = max(1, -(-n // (shards * slot_rows)), min(64, n // 1000))
    placed = written(rows.where("hot IS NOT NULL").withColumnRenamed("hot", "shard").unionByName(rest).withColumn(sub, F.pmod(F.xxhash64(rid), F.lit(subs)).cast("int")), "placed")
    # Slots: number each (shard, sub) alone, then add the rows of the subs before it; no task sees a whole shard.
    counts = {(r["shard"], r[sub]): r["count"] for r in placed.groupBy("shard", sub).count().collect()}
    before = [(s, j, at) for s in range(shards) for j, at in enumerate(accumulate((counts.get((s, i), 0) for i in range(subs - 1)), initial=0))]
    offsets = spark.createDataFrame(before, f"shard int, {sub} int, before long")
    local = F.row_number().over(Window.partitionBy("shard", sub).orderBy(rid)) - 1
    return (
        placed.withColumn("slot", local)
        .join(F.broadcast(offsets), ["shard", sub])
        .withColumns({"slot": (F.col("slot") + F.col("before")).cast("long"), "law": F.lit("bytes")})
        .select(*out, "size", "text_crc32", "law", "shard", "slot")
    )
