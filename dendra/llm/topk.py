"""Exact top-k by inner product over whole-number vectors.

A first pass answers every query from the longest vectors alone and so knows a score that its k-th answer reaches at least (its
floor); a vector shorter than floor / |q| can't be an answer. Vectors are dealt into slots by falling length, queries into blocks by
that least length, both by histograms of fixed size, so a vector is copied only to the blocks whose queries it may answer
(Cauchy-Schwarz), and a block meets only slots of long enough vectors. Inside a slot vectors go by falling length, rotated by the right
singular vectors of the whole table so that the first coordinates hold most of the length. A run of vectors is skipped once |q| * |x|
can't reach the k-th score; a vector is dropped once the sum over the first coordinates plus |rest of q| * |rest of x| can't.
What is left is scored in whole numbers, so rotation and rounding decide only what is skipped, never a score; bounds carry a
margin over rounding. Only scores that reach the floor leave a task.

A block of ``QUERY_ROWS`` queries and a slot of ``SLOT_ROWS`` vectors are one task's work, neither grows with the table; a length that a
third of all vectors have fills many slots.

Defined cases: vectors that are null or empty, or that hold a null or non-finite component, take no part; nor do rows with a null id. Vectors
of several lengths are answered among those of their own length. Ties go to the smaller id. Only the query's own row is no answer: rows
that repeat its id are, and queries that repeat an id are answered each. Ids that aren't whole numbers, and components so large that a score
may exceed 64 bits, are an error. Other columns, whatever their names, are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dendra.llm.common import HIDDEN, need, whole_ids, with_row_id, written

K = 10
QUERY_ROWS = 2048
SLOT_ROWS = 16384
HEAD_ROWS = 4096
#: Vectors scored at once.
STEP = 1024
#: Coordinates summed before the rest is bounded.
FIRST = 24
#: Share of |q| * |x| added to every bound.
MARGIN = 1e-9
#: Stands for no score; its negative is a number too.
NONE = -(1 << 62)


def scaled(vector: str = "embedding", by: int = 1024) -> Column:
    """floor(by * x) of each component, x as double; null where the vector takes no part."""
    whole = F.transform(F.col(vector), lambda x: F.floor(F.lit(float(by)) * x.cast("double")).cast("long"))
    bad = F.exists(F.col(vector), lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == F.lit(float("inf"))))
    return F.when(F.col(vector).isNotNull() & ~bad & (F.size(vector) > 0), whole)


def rotation(vectors: DataFrame, dim: int) -> np.ndarray:
    """Right singular vectors (columns, by falling singular value) of all vectors, from their second moments.

    Each partition sums its moments; the sums are added up by cell, so the driver gets dim * dim numbers.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((dim, dim))
        for b in batches:
            if len(b):
                x = np.stack(b["x"].to_numpy()).astype(np.float64)
                total += x.T @ x
        yield pd.DataFrame({"cell": np.arange(dim * dim), "v": total.ravel()})

    cells = vectors.select("x").mapInPandas(run, "cell int, v double").groupBy("cell").agg(F.sum("v").alias("v")).collect()
    m = np.zeros(dim * dim)
    for r in cells:
        m[r["cell"]] = r["v"]
    return np.linalg.eigh(m.reshape(dim, dim))[1][:, ::-1].copy()


def exact(queries: np.ndarray, x: np.ndarray, qi: np.ndarray, xi: np.ndarray) -> np.ndarray:
    """Inner products of the pairs: by one matrix product of doubles where these hold every sum exactly, else pair by pair."""
    if queries.shape[1] * float(np.abs(queries).max()) * float(np.abs(x).max()) < 1 << 53:
        return (queries.astype(np.float64) @ x.astype(np.float64).T)[qi, xi].astype(np.int64)
    return np.concatenate([np.einsum("ij,ij->i", queries[qi[s : s + STEP]], x[xi[s : s + STEP]]) for s in range(0, len(qi), STEP)])


def best_of(queries: np.ndarray, q_rows: np.ndarray, floor: np.ndarray, x: np.ndarray, ids: np.ndarray, rows: np.ndarray, rot: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each query its up to k best of x (id, score) that reach its floor. q_rows, rows: row numbers; a query's own row is no answer."""
    first = min(FIRST, x.shape[1])
    order = np.argsort(-(x * x).sum(axis=1), kind="stable")
    x, ids, rows = x[order], ids[order], rows[order]
    xr, qr = x.astype(np.float64) @ rot, queries.astype(np.float64) @ rot
    length, q_length = np.sqrt((xr * xr).sum(axis=1)), np.sqrt((qr * qr).sum(axis=1))
    x_rest, q_rest = np.sqrt((xr[:, first:] ** 2).sum(axis=1)), np.sqrt((qr[:, first:] ** 2).sum(axis=1))
    least, floor = floor, floor.astype(np.float64)
    found_ids = np.full((len(queries), k), np.iinfo(np.int64).max)
    found, least_now = np.full((len(queries), k), NONE), least.astype(np.int64)
    for a in range(0, len(x), STEP):
        b = min(len(x), a + STEP)
        live = np.flatnonzero(q_length * length[a] * (1 + MARGIN) + 1 > floor)
        if not len(live):
            break  # all further vectors are shorter
        bound = qr[live, :first] @ xr[a:b, :first].T
        bound += np.outer(q_rest[live], x_rest[a:b])
        bound += MARGIN * np.outer(q_length[live], length[a:b]) + 1
        qi, xi = np.nonzero(bound >= floor[live][:, None])
        qi = live[qi]
        own = rows[a + xi] != q_rows[qi]
        qi, xi = qi[own], xi[own]
        if not len(qi):
            continue
        score = exact(queries, x[a:b], qi, xi)
        # what may still be among a query's k: all that reach its k-th score so far and the k-th of this step
        table = np.full((len(queries), b - a), NONE)
        table[qi, xi] = score
        kth = np.partition(table, max(0, b - a - k), axis=1)[:, max(0, b - a - k)]
        good = score >= np.maximum(kth, least_now)[qi]
        qi, xi, score = qi[good], xi[good], score[good]
        some = np.unique(qi)
        was = np.repeat(some, k)
        all_q, all_s, all_i = np.concatenate([was, qi]), np.concatenate([found[some].ravel(), score]), np.concatenate([found_ids[some].ravel(), ids[a + xi]])
        order = np.lexsort((all_i, -all_s, all_q))
        place = np.arange(len(order)) - np.searchsorted(all_q[order], all_q[order])
        order = order[place < k]
        found[some], found_ids[some] = all_s[order].reshape(-1, k), all_i[order].reshape(-1, k)
        least_now = np.maximum(least_now, found[:, -1])
        floor = np.maximum(floor, found[:, -1].astype(np.float64))
    for q in range(len(queries)):
        real = (found[q] > NONE) & (found[q] >= least[q])
        yield q, found_ids[q][real], found[q][real]


def bin_of(square: Column) -> Column:
    """Squared lengths in 64 bins for each doubling, a fixed number in all."""
    return F.floor(64 * F.log2(1 + square)).cast("int")


def dealt(counts: list[tuple[int, int]], size: int) -> list[tuple[int, int, int]]:
    """(bin, first group, groups) for (bin, rows) in the order given: groups of about ``size`` rows. A bin with more fills several of its own."""
    out, group, room = [], -1, 0
    for b, n in counts:
        if n > room:
            span = -(-n // size)
            out.append((b, group + 1, span))
            group, room = group + span, size - n if span == 1 else 0
        else:
            out.append((b, group, 1))
            room -= n
    return out


def top_k(vectors: DataFrame, queries: Column, k: int = K, id_col: str = "vec_id", vector: str = "embedding", by: int = 1024) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row where ``queries`` holds, the k rows with the highest inner product."""
    need(vectors, id_col, vector)
    whole_ids(vectors, id_col)
    rid = HIDDEN + "rid"
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.coalesce(queries, F.lit(False)).alias("asked"), scaled(vector, by).alias("x"))
    rows = written(with_row_id(rows.where(F.col("x").isNotNull() & F.col("id").isNotNull()), rid), "vectors")
    most = F.max(F.greatest(F.abs(F.array_max("x")), F.abs(F.array_min("x")))).alias("most")
    lengths = rows.groupBy(F.size("x").alias("d")).agg(F.count("*").alias("n"), F.sum(F.col("asked").cast("long")).alias("asked"), most).orderBy("d").collect()  # a row per vector length
    for g in lengths:
        if g["d"] * g["most"] ** 2 >= 1 << 62:
            raise ValueError(f"components up to {g['most']} make scores beyond 64 bits")
    found = [_of_length(rows.where(F.size("x") == g["d"]), g["d"], k) for g in lengths if g["asked"]]
    if not found:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    by_score = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    near = reduce(DataFrame.unionByName, found)
    return near.withColumn("rank", F.row_number().over(by_score)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int"), "vec_id", "score")


def _of_length(rows: DataFrame, dim: int, k: int) -> DataFrame:
    """(query, query_id, vec_id, score): up to k answers of each query from each slot that it meets."""
    spark, rid = rows.sparkSession, HIDDEN + "rid"
    slot, block, bin_ = (HIDDEN + x for x in ("slot", "block", "bin"))
    rows = rows.withColumn("x", F.col("x").cast("array<int>"))  # components that fit the bound on scores fit 32 bits
    rot = rotation(rows, dim)
    rows = rows.withColumn("square", F.aggregate("x", F.lit(0).cast("long"), lambda a, v: a + v.cast("long") * v))
    stacked = lambda x: np.stack(x.to_numpy()).astype(np.int64)

    head = rows.orderBy(F.desc("square"), "id").limit(HEAD_ROWS).select("id", "x", rid).toPandas()  # a fixed number of rows
    shared = spark.sparkContext.broadcast((rot, stacked(head["x"]), head["id"].to_numpy(), head[rid].to_numpy()))

    def seed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rot, hx, hi, hr = shared.value
        for b in batches:
            if len(b):
                low = np.full(len(b), NONE)
                for i, _, s in best_of(stacked(b["x"]), b[rid].to_numpy(), low, hx, hi, hr, rot, k):
                    if len(s) == k:
                        low[i] = s[-1]
                yield b.assign(floor=low)

    seeded = rows.where("asked").select("id", "x", "square", rid).mapInPandas(seed, f"id long, x {rows.schema['x'].dataType.simpleString()}, square long, {rid} long, floor long")
    least = F.greatest(F.col("floor").cast("double"), F.lit(0.0)) / F.greatest(F.sqrt("square"), F.lit(1.0))
    asked = written(seeded.withColumn(bin_, bin_of(least * least)), "queries")
    rows = rows.withColumn(bin_, bin_of(F.col("square")))
    counted = lambda df: [(r[bin_], r["count"]) for r in df.groupBy(bin_).count().collect()]  # noqa: E731  at most 4,033 bins
    slots, blocks = dealt(sorted(counted(rows), reverse=True), SLOT_ROWS), dealt(sorted(counted(asked)), QUERY_ROWS)
    # a block goes to the slots before the first whose vectors are too short, and the other way round; one bin's leeway covers rounding
    met_slots = [(b, first, span, max((f + n for s, f, n in slots if s + 1 >= b), default=0)) for b, first, span in blocks]
    met_blocks = [(s, first, span, max((f + n for b, f, n in blocks if b <= s + 1), default=0)) for s, first, span in slots]

    def placed(df: DataFrame, table: list[tuple], own: str, other: str) -> DataFrame:
        of = spark.createDataFrame(table, f"{bin_} int, first int, span int, met int")
        at = df.join(F.broadcast(of), bin_).where("met > 0")  # a row per bin
        return at.withColumn(own, (F.col("first") + F.pmod(F.xxhash64(rid), F.col("span"))).cast("int")).withColumn(other, F.explode(F.sequence(F.lit(0), F.col("met") - 1)))

    left = placed(asked, met_slots, block, slot).select("id", "x", "floor", rid, block, slot)
    right = placed(rows, met_blocks, slot, block).select("id", "x", F.col(rid).alias("row"), block, slot)

    def meet(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        got: list[np.ndarray] = []
        if len(a) and len(b):
            ids, own = a["id"].to_numpy(), a[rid].to_numpy()
            for i, vec, score in best_of(stacked(a["x"]), own, a["floor"].to_numpy(), stacked(b["x"]), b["id"].to_numpy(), b["row"].to_numpy(), shared.value[0], k):
                got.append(np.column_stack([np.full(len(vec), own[i]), np.full(len(vec), ids[i]), vec, score]))
        return pd.DataFrame(np.concatenate(got) if got else np.zeros((0, 4), np.int64), columns=["query", "query_id", "vec_id", "score"])

    return left.groupBy(block, slot).cogroup(right.groupBy(block, slot)).applyInPandas(meet, "query long, query_id long, vec_id long, score long")
