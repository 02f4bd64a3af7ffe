"""What the operators of this subpackage share: table access, the shared folder, small schema helpers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dendra.plans.scratch import held, release, shared_folder, written  # noqa: F401  the operators take them from here

#: Separators of words: space and the control characters 9 to 13, nothing else.
SPACES = " \t\n\x0b\x0c\r"
#: Prefix of helper columns, dropped before an operator returns.
HIDDEN = "__dn_"
#: Of shingle hashes.
SEED = 42


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def need(df: DataFrame, *columns: str) -> None:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns {missing}; there are {df.columns}")


def whole_ids(df: DataFrame, column: str) -> None:
    """Raises where ids are not whole numbers: casting others would turn them into nulls."""
    kind = df.schema[column].dataType
    if not isinstance(kind, T.IntegralType | T.NullType):
        raise ValueError(f"{column} must hold whole numbers, not {kind.simpleString()}")


def without(df: DataFrame, *columns: str) -> DataFrame:
    """``df`` without columns that an operator is about to add; the operator's own values win."""
    return df.drop(*[c for c in columns if c in df.columns])


def text_of(column: str = "text"):
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def with_row_id(df: DataFrame, name: str = HIDDEN + "rid") -> DataFrame:
    """A number per row; write the result before joining on it."""
    return df.withColumn(name, F.monotonically_increasing_id())
