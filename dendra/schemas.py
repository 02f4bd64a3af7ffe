"""Frames of the engine and a check of their columns. One frame holds many neurons; NULL means missing."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Column names and types as DDL.
POINTS = "neuron_id string, idx int, x double, y double, z double"
SKELETON = "neuron_id string, idx int, class int, x double, y double, z double, r double, parent int"
SWC = "neuron_id string, id int, class int, x double, y double, z double, r double, parent int"
VECTORS = "neuron_id string, idx int, x double, y double, z double, vx double, vy double, vz double"
BLOCKS = "bz long, by long, bx long, nz int, ny int, nx int, labels binary, affinities binary, present binary"
VOXELS = "z int, y int, x int, label long, aff_x double, aff_y double, aff_z double"

#: In-band sentinel for a missing parent, child or sibling in arrays that leave the engine.
MISSING = -2
#: Names of the point classes.
POINT_CLASSES = {0: "undefined", 1: "soma", 2: "axon", 3: "dendrite", 4: "apical dendrite", 5: "fork", 6: "end", 7: "custom"}


def ensure_schema(df: DataFrame, ddl: str, cast: bool = True) -> DataFrame:
    """``df`` cut to the columns of ``ddl``, cast to its types; raises if a column is missing."""
    wanted = [c.strip().split(" ") for c in ddl.split(",")]
    missing = [n for n, _ in wanted if n not in df.columns]
    if missing:
        raise ValueError(f"missing columns {missing}; there are {df.columns}")
    return df.select(*[F.col(n).cast(t).alias(n) if cast else F.col(n) for n, t in wanted])


def reject_nan(df: DataFrame, *columns: str) -> DataFrame:
    """``df``, failing at run time on a NULL or NaN coordinate."""
    bad = F.lit(False)
    for c in columns:
        bad = bad | F.col(c).isNull() | F.isnan(c)
    first = columns[0]
    return df.withColumn(first, F.when(bad, F.raise_error(F.lit("a coordinate is missing or NaN")).cast("double")).otherwise(F.col(first)))
