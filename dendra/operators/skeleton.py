"""Tree operators over skeleton frames (neuron_id, idx, class, x, y, z, r, parent); parent is NULL at a root."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dendra.schemas import MISSING

KEY = ["neuron_id", "idx"]
AXES = ("x", "y", "z")


def reindex(nodes: DataFrame, id_col: str = "id", parent_col: str = "parent") -> DataFrame:
    """Sort each neuron's nodes by file id and number them from 0; parents are found by id, so gaps do no harm.

    A parent that is no node's id (such as -1) becomes NULL.
    """
    order = Window.partitionBy("neuron_id").orderBy(id_col)
    numbered = nodes.withColumn("idx", (F.row_number().over(order) - 1).cast("int"))
    up = numbered.select("neuron_id", F.col(id_col).alias("__up"), F.col("idx").alias("__parent"))
    joined = numbered.withColumnRenamed(parent_col, "__up").join(up, ["neuron_id", "__up"], "left")
    rest = [c for c in nodes.columns if c not in ("neuron_id", id_col, parent_col)]
    return joined.select("neuron_id", "idx", *rest, F.col("__parent").alias("parent"))


def is_root() -> Column:
    return F.col("parent").isNull() | (F.col("parent") < 0)


def child_counts(nodes: DataFrame) -> DataFrame:
    """(neuron_id, idx, n_children, first_child) of nodes that have children; the first child is the one with the largest index."""
    own = nodes.where(~is_root()).groupBy("neuron_id", F.col("parent").alias("idx"))
    return own.agg(F.count("*").alias("n_children"), F.max("idx").alias("first_child"))


def node_kinds(nodes: DataFrame) -> DataFrame:
    """``nodes`` with is_root, is_terminal, is_branching, n_children and first_child."""
    joined = nodes.join(child_counts(nodes), KEY, "left")
    n = F.coalesce("n_children", F.lit(0))
    return joined.withColumns({"n_children": n.cast("long"), "is_root": is_root(), "is_terminal": n == 0, "is_branching": n >= 2})


def roots(nodes: DataFrame) -> DataFrame:
    return nodes.where(is_root())


def terminals(nodes: DataFrame) -> DataFrame:
    """Nodes that no node names as its parent."""
    named = nodes.where(~is_root()).select("neuron_id", F.col("parent").alias("idx"))
    return nodes.join(named, KEY, "left_anti")


def branch_points(nodes: DataFrame) -> DataFrame:
    return nodes.join(child_counts(nodes).where("n_children >= 2").select(*KEY), KEY, "left_semi")


def topology(nodes: DataFrame) -> DataFrame:
    """``nodes`` with first_child and next_sibling (NULL: none). Siblings: the largest index first, then the others rising."""
    top = F.max("idx").over(Window.partitionBy("neuron_id", "parent"))
    chain = Window.partitionBy("neuron_id", "parent").orderBy(F.col("idx") != F.col("__top"), "idx")
    marked = nodes.withColumn("__top", top)
    marked = marked.withColumn("next_sibling", F.when(~is_root(), F.lead("idx").over(chain))).drop("__top")
    return marked.join(child_counts(nodes).select(*KEY, "first_child"), KEY, "left")


def attributes(nodes: DataFrame) -> DataFrame:
    """Class, parent, first child and next sibling as whole numbers with the sentinel for missing ones."""
    gap = F.lit(MISSING)
    t = topology(nodes)
    return t.select(*KEY, "class", *[F.coalesce(c, gap).cast("int").alias(c) for c in ("parent", "first_child", "next_sibling")])


def point_count(nodes: DataFrame) -> DataFrame:
    return nodes.groupBy("neuron_id").agg(F.count("*").alias("n_points"))


def edge_count(nodes: DataFrame) -> DataFrame:
    return nodes.groupBy("neuron_id").agg(F.sum((~is_root()).cast("long")).alias("n_edges"))


def edges(nodes: DataFrame) -> DataFrame:
    """(neuron_id, child, parent)."""
    return nodes.where(~is_root()).select("neuron_id", F.col("idx").alias("child"), "parent")


def children(nodes: DataFrame) -> DataFrame:
    """(neuron_id, idx, children): the list starts with the largest index, then rises."""
    own = nodes.where(~is_root()).groupBy("neuron_id", F.col("parent").alias("idx")).agg(F.sort_array(F.collect_list("idx")).alias("c"))
    last = F.element_at("c", -1)
    return own.select(*KEY, F.concat(F.array(last), F.slice("c", 1, F.size("c") - 1)).alias("children"))


def center(nodes: DataFrame, include_radius: bool = False) -> DataFrame:
    """Coordinates minus their neuron's mean; ``include_radius`` centres the radius too.

    The means are joined back, so a neuron's rows need not meet in one task.
    """
    cols = [*AXES, *(["r"] if include_radius else [])]
    means = nodes.groupBy("neuron_id").agg(*[F.avg(c).alias(f"__{c}") for c in cols])
    joined = nodes.join(means, "neuron_id")
    return joined.withColumns({c: F.col(c) - F.col(f"__{c}") for c in cols}).select(*nodes.columns)


def squared_distance(a: str = "", b: str = "p_") -> Column:
    """Between the points in columns a + axis and b + axis."""
    total = None
    for c in AXES:
        d = F.col(a + c) - F.col(b + c)
        total = d * d if total is None else total + d * d
    return total


def with_parent_point(nodes: DataFrame) -> DataFrame:
    """Nodes that have a parent, with its coordinates as p_x, p_y, p_z."""
    up = nodes.select("neuron_id", F.col("idx").alias("parent"), *[F.col(c).alias(f"p_{c}") for c in AXES])
    return nodes.where(~is_root()).join(up, ["neuron_id", "parent"])


def path_length(nodes: DataFrame) -> DataFrame:
    """(neuron_id, path_length): sum of the distances between nodes and their parents; 0 for a neuron without edges."""
    own = with_parent_point(nodes).select("neuron_id", F.sqrt(squared_distance()).alias("d"))
    none = nodes.where(is_root()).select("neuron_id", F.lit(0.0).alias("d"))
    return own.unionByName(none).groupBy("neuron_id").agg(F.sum("d").alias("path_length"))


def points(nodes: DataFrame, radius: bool = True) -> DataFrame:
    return nodes.select(*KEY, *AXES, *(["r"] if radius else []))


def set_points(nodes: DataFrame, new: DataFrame) -> DataFrame:
    """``nodes`` with the coordinates of ``new`` (neuron_id, idx, x, y, z, r)."""
    rest = [c for c in nodes.columns if c not in (*AXES, "r")]
    return nodes.select(*rest).join(new.select(*KEY, *AXES, "r"), KEY).select(*nodes.columns)


def equal(a: DataFrame, b: DataFrame, atol: float = 1e-3, rtol: float = 1e-5) -> DataFrame:
    """(neuron_id, equal): same nodes, coordinates and radii within atol + rtol * |b|, same class and parent."""
    side = lambda df, p: df.select(*KEY, *[F.col(c).alias(p + c) for c in (*AXES, "r", "class", "parent")], F.lit(True).alias(p + "in"))
    joined = side(a, "a_").join(side(b, "b_"), KEY, "full")
    same = F.col("a_in").isNotNull() & F.col("b_in").isNotNull()
    for c in (*AXES, "r"):
        same = same & F.coalesce(F.abs(F.col("a_" + c) - F.col("b_" + c)) <= atol + rtol * F.abs(F.col("b_" + c)), F.col("a_" + c).isNull() & F.col("b_" + c).isNull())
    for c in ("class", "parent"):
        same = same & F.col("a_" + c).eqNullSafe(F.col("b_" + c))
    return joined.groupBy("neuron_id").agg(F.bool_and(same).alias("equal"))


def initialize(n: int, spark, neuron_id: str = "0") -> DataFrame:
    """``n`` nodes at the origin without class, parent or radius."""
    zero = F.lit(0.0)
    return spark.range(n).select(F.lit(neuron_id).alias("neuron_id"), F.col("id").cast("int").alias("idx"), F.lit(0).alias("class"), *[zero.alias(c) for c in (*AXES, "r")], F.lit(None).cast("int").alias("parent"))


def initialize_all(sizes: DataFrame) -> DataFrame:
    """The same for many neurons: sizes (neuron_id, n_points)."""
    idx = F.explode(F.sequence(F.lit(0), F.col("n_points").cast("int") - 1)).alias("idx")
    return sizes.where("n_points > 0").select("neuron_id", idx).select("*", F.lit(0).alias("class"), *[F.lit(0.0).alias(c) for c in (*AXES, "r")], F.lit(None).cast("int").alias("parent"))


def plot_points(cloud: DataFrame, k: int = 600) -> DataFrame:
    """The first ``k`` points of each neuron."""
    return cloud.where(F.col("idx") < k).select("neuron_id", *AXES)


def sample_for_plot(cloud: DataFrame, k: int = 600):
    """``plot_points`` as a pandas frame, for a scatter plot of two clouds."""
    return plot_points(cloud, k).toPandas()
