"""Corpus pipeline: quality rules, near-duplicate removal, secret redaction, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes each stage's rows as
Parquet in the shared folder and reads them again as the next stage's documents. All but the last
return the columns of ``documents``. A stage's own tables in the shared folder are deleted when the next stage begins, as its rows
are stored by then; those of ``run``'s last stage stay until ``release``.

Defined cases are those of the operators: null and empty texts fail the quality rules and go; of repeated rows
one stays; of near duplicates the one with the smallest id stays, of several with that id the first read; very long texts are taken whole by every
stage; an empty table gives an empty result; columns that only ``docs`` has are passed through up to packing.
"""

from __future__ import annotations

import threading
from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dendra.llm import packing, quality_rules, secrets_scan, simhash
from dendra.llm.common import table
from dendra.plans.scratch import drop, given, held, release, taken, written

POLICY = "prose-1"
_left = threading.local()


def _stage(work: Callable[[SparkSession, DataFrame, str], DataFrame]) -> Callable[[SparkSession, DataFrame, str], DataFrame]:
    @wraps(work)
    def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        drop(spark, getattr(_left, "paths", []))
        before = held()
        out = work(spark, docs, sf_dir)
        _left.paths = taken(before)
        return out

    return stage


@_stage
def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the policy keeps."""
    ledger = quality_rules.store_ledger(docs)
    return quality_rules.apply_policy(ledger, POLICY).where("kept").select(*docs.columns)


@_stage
def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group (five-word shingles, Jaccard 0.8 or more): the one with the smallest id."""
    return simhash.near_duplicates(docs, shingle=5, least=0.8).where("representative").select(*docs.columns)


@_stage
def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets in their texts replaced; n_chars follows the text."""
    clean = secrets_scan.redact(secrets_scan.scan(docs))
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        clean = clean.withColumn("n_chars", F.when(F.size("spans") > 0, F.length("text").cast(kind)).otherwise(F.col("n_chars")))
    return clean.select(*docs.columns)


@_stage
def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the packed sequences, with their token ids."""
    return packing.pack(docs)


STAGES = [("quality_rules", quality), ("near_duplicates", one_of_each), ("secret_scans", without_secrets), ("packing", packed)]

#: Fingerprints and tokens are beyond SQL; the tests hold ``run`` against a plain Python version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), held()
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
        release(spark, before, but_last=True)  # the rows before
    out = STAGES[-1][1](spark, docs, sf_dir)
    given(_left.paths)
    _left.paths = []
    return out
