"""Named queries over the driver's tables, one per operator or family of operators; each reads its whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from dendra.functions import linalg
from dendra.functions.score_table import ScoreTable, adp_bin, dist_bin
from dendra.operators import downsample as down
from dendra.operators import blocks, merge_tree, nblast, skeleton, spatial, tree
from dendra.operators import segmentation as seg
from dendra.operators.incremental import MatrixState
from dendra.plans import derive
from dendra.plans.scratch import fresh, written
from dendra.sources import arrivals, chunks, precomputed, swc, tables

K_NEAR = 10
STEP = 40.0
MIN_MEAN = 630.0
CUT = 700.0
CUTS = [640.0 + 20 * i for i in range(10)]
LEAF = 16
BLOCK = 8


def _r(*columns: str, digits: int = 4) -> list:
    """Rounded sums and roots: their last bits depend on the order of additions. Adding 0 makes -0 plain."""
    return [(F.round(c, digits) + 0.0).alias(c) for c in columns]


def k1_reindex(spark, d) -> DataFrame:
    n = derive.numbered_parts(spark, d)
    own = n.drop("idx").withColumn("parent", F.when(F.col("id") % 10 == 0, F.lit(-1).cast("long")).otherwise(F.col("id")))
    return skeleton.reindex(own).select("neuron_id", "idx", "x", "y", "parent")


def k2_first_child_sibling(spark, d) -> DataFrame:
    return skeleton.topology(derive.skeletons(spark, d)).select("neuron_id", "idx", "first_child", "next_sibling")


def k3_k4_k5_node_kind(spark, d) -> DataFrame:
    return skeleton.node_kinds(derive.skeletons(spark, d)).select("neuron_id", "idx", "is_root", "is_terminal", "is_branching", "n_children")


def k4_terminals(spark, d) -> DataFrame:
    return skeleton.terminals(derive.skeletons(spark, d)).select("neuron_id", "idx")


def k6_k7_counts(spark, d) -> DataFrame:
    s = derive.skeletons(spark, d)
    return skeleton.point_count(s).join(skeleton.edge_count(s), "neuron_id")


def k8_edges(spark, d) -> DataFrame:
    return skeleton.edges(derive.skeletons(spark, d))


def k9_children(spark, d) -> DataFrame:
    return skeleton.children(derive.skeletons(spark, d)).select("neuron_id", "idx", F.array_join("children", ",").alias("children"))


def k10_center(spark, d) -> DataFrame:
    c = skeleton.center(derive.skeletons(spark, d), include_radius=True)
    return c.select("neuron_id", "idx", *_r("x", "y", "z", "r"))


def k11_downsample(spark, d) -> DataFrame:
    return _sources(down.downsample(derive.skeletons(spark, d), STEP))


def _sources(out) -> DataFrame:
    up = out.select("neuron_id", F.col("idx").alias("parent"), F.col("source_idx").alias("source_parent"))
    return out.join(up, ["neuron_id", "parent"], "left").select("neuron_id", "source_idx", "class", *_r("x", "y", "z", "r"), "source_parent")


def k11_by_segments(spark, d) -> DataFrame:
    """The same, each segment a task's work."""
    return _sources(down.downsample(derive.skeletons(spark, d), STEP, task_nodes=0))


def k11_twofold(spark, d) -> DataFrame:
    """Ends that are the last node kept come twice: how often each node is there, with its parents by source."""
    out = _sources(down.downsample(derive.skeletons(spark, d), STEP, duplicate_junctions=True))
    return out.groupBy("neuron_id", "source_idx").agg(F.count("*").alias("n"), F.min("source_parent").alias("low_parent"), F.max("source_parent").alias("high_parent"))


def k12_path_length(spark, d) -> DataFrame:
    return skeleton.path_length(derive.skeletons(spark, d)).select("neuron_id", *_r("path_length"))


def k15_attributes(spark, d) -> DataFrame:
    return skeleton.attributes(derive.skeletons(spark, d))


def k17_equal(spark, d) -> DataFrame:
    s = derive.skeletons(spark, d)
    moved = s.withColumns({"x": F.col("x") + F.when(F.col("neuron_id").endswith("1"), 0.5).otherwise(0.0005)})
    return skeleton.equal(s, moved)


def k14_set_points(spark, d) -> DataFrame:
    s = derive.skeletons(spark, d)
    moved = skeleton.points(s).withColumns({"x": F.col("x") * 2, "y": F.col("y") + 1, "z": -F.col("z"), "r": F.col("r") / 2})
    return skeleton.set_points(s, moved).select("neuron_id", "idx", "class", *_r("x", "y", "z", "r"), "parent")


def k18_initialize(spark, d) -> DataFrame:
    """Empty neurons as large as those given, then with their points."""
    s = derive.skeletons(spark, d)
    empty = skeleton.initialize_all(skeleton.point_count(s))
    filled = skeleton.set_points(empty, skeleton.points(s).where("idx % 2 = 0"))
    return empty.join(filled.select(*skeleton.KEY, F.col("x").alias("new_x"), F.col("r").alias("new_r")), skeleton.KEY, "left").select(*_nodes(empty).columns, *_r("new_x", "new_r"))


def k19_plot_points(spark, d) -> DataFrame:
    return skeleton.plot_points(derive.points(spark, d))


def _nodes(df) -> DataFrame:
    return df.select("neuron_id", "idx", "class", *_r("x", "y", "z", "r"), "parent")


def s1_swc_lenient(spark, d) -> DataFrame:
    return _nodes(swc.read_swc(spark, derive.swc_folder(spark, d)))


def s2_swc_strict(spark, d) -> DataFrame:
    return _nodes(swc.read_swc(spark, derive.swc_folder(spark, d), strict=True))


def s1_arrivals(spark, d) -> DataFrame:
    """The same files as a stream of deliveries."""
    table, state = fresh(spark, "deliveries"), fresh(spark, "state")
    arrivals.swc_stream(spark, derive.swc_folder(spark, d), table, state, strict=True, files_a_batch=10).awaitTermination()
    return _nodes(arrivals.read_deliveries(spark, table))


def s3_swc_rows(spark, d) -> DataFrame:
    n = derive.numbered_parts(spark, d)
    up = F.when(F.col("id") % 10 == 0, -1).otherwise(F.col("id"))
    row = F.array(*[F.col(c).cast("double") for c in ("id", "class", *skeleton.AXES, "r")], up.cast("double"))
    return _nodes(tables.from_swc_rows(n.select("neuron_id", row.alias("row"))))


def _with_point(df) -> DataFrame:
    return df.withColumn("point", F.array(*skeleton.AXES, "r"))


def s4_attribute_rows(spark, d) -> DataFrame:
    s = derive.skeletons(spark, d)
    own = skeleton.attributes(s).select("neuron_id", "idx", F.array("class", "parent", "first_child", "next_sibling").alias("attributes"))
    return _nodes(tables.from_attribute_rows(_with_point(s).join(own, ["neuron_id", "idx"])))


def s5_point_rows(spark, d) -> DataFrame:
    s = _with_point(derive.skeletons(spark, d))
    return _nodes(tables.from_point_rows(s.select("neuron_id", "idx", F.slice("point", 1, 3).alias("point"), F.coalesce("parent", F.lit(-2)).alias("parent"))))


def s9_swc_files(spark, d) -> DataFrame:
    path = fresh(spark, "swc")
    swc.write_swc(derive.skeletons(spark, d), path)
    return _nodes(swc.read_swc(spark, path))


def s9_swc_text(spark, d) -> DataFrame:
    return swc.swc_text(derive.skeletons(spark, d), precision=0)


def s11_saved_skeletons(spark, d) -> DataFrame:
    path = fresh(spark, "skeletons")
    tables.save(derive.skeletons(spark, d), path)
    return _nodes(tables.load_skeletons(spark, path))


def s12_saved_vectors(spark, d) -> DataFrame:
    path = fresh(spark, "clouds")
    tables.save(_vectors(spark, d), path)
    return tables.load_vectors(spark, path).select("neuron_id", "idx", *_r("x", "y", "z", "vx", "vy", "vz"))


def s6_s7_precomputed(spark, d) -> DataFrame:
    back = precomputed.decode(precomputed.encode(derive.skeletons(spark, d)))
    return back.select("neuron_id", "idx", "class", "x", "y", "z", "r", "parent")


def s8_swc_lines(spark, d) -> DataFrame:
    return swc.lines(derive.skeletons(spark, d), precision=0).select("neuron_id", "idx", "line")


def m1_pca_group(spark, d) -> DataFrame:
    got = linalg.pca_first_component(derive.points(spark, d), ["neuron_id"])
    return got.select("neuron_id", *_r("vx", "vy", "vz"))


def m2_m4_bbox(spark, d) -> DataFrame:
    return spatial.bounding_box(derive.points(spark, d), ["neuron_id"])


def m5_box_distance(spark, d) -> DataFrame:
    """Each point's distance to the box of the neuron that follows by number."""
    p = derive.points(spark, d)
    box = spatial.bounding_box(p, ["neuron_id"]).select(F.col("neuron_id").alias("box_id"), *[f"{e}_{c}" for e in ("min", "max") for c in spatial.AXES])
    pairs = p.join(box, F.col("neuron_id").cast("int") + 1 == F.col("box_id").cast("int"))
    return pairs.select("neuron_id", "idx", "box_id", spatial.box_distance().alias("d2"))


def m9_knn(spark, d) -> DataFrame:
    p = derive.points(spark, d)
    near = spatial.knn(spatial.as_queries(p), spatial.as_targets(p), 5, "same")
    return near.select(F.col("query_id").alias("neuron_id"), "query_idx", "idx", "rank")


def m8_m9_tree(spark, d) -> DataFrame:
    """Neighbours in other neurons by a tree with small leaves that was written and read again."""
    p = derive.points(spark, d).withColumnRenamed("neuron_id", "id")
    path, own = fresh(spark, "tree"), tree.build(p, LEAF)
    tree.save(own, path)
    near = tree.nearest(own.leaves, tree.load(spark, path), 3, "other")
    best = near.withColumn("rank", F.row_number().over(Window.partitionBy("q", "idx0", "target").orderBy("d2", "idx"))).where("rank <= 3")
    return best.select(F.col("q").alias("query_id"), F.col("idx0").cast("int").alias("query_idx"), F.col("target").alias("target_id"), F.col("idx").cast("int").alias("idx"), "rank")


def m8_leaves(spark, d) -> DataFrame:
    """The points that a tree's leaves hold."""
    t = tree.build(derive.points(spark, d).withColumnRenamed("neuron_id", "id"), LEAF)
    return tree.points_of(t.leaves).select(F.col("id").alias("neuron_id"), F.col("idx").cast("int").alias("idx"), "x", "y", "z")


def n2_lookup(spark, d) -> DataFrame:
    p = derive.points(spark, d)
    near = spatial.knn(spatial.as_queries(p), spatial.as_targets(p), 1, "other")
    dist, adp = F.sqrt("d2"), (F.col("query_idx") % 11) / 10
    return near.select("query_id", "query_idx", "target_id", dist_bin(dist).alias("dist_bin"), adp_bin(adp).alias("adp_bin"), ScoreTable().score(dist, adp).alias("score"))


def _vectors(spark, d) -> DataFrame:
    return nblast.direction_vectors(derive.points(spark, d), K_NEAR)


def n4_table(spark, d) -> DataFrame:
    """Each point's distance from the origin, looked up in the table as rows."""
    t = ScoreTable().frame(spark)
    p = derive.points(spark, d).select("neuron_id", "idx", F.sqrt(F.col("x") * F.col("x") + F.col("y") * F.col("y") + F.col("z") * F.col("z")).alias("distance"))
    near = (F.col("distance") >= F.col("dist_lo")) & (F.col("distance") < F.col("dist_hi")) & (F.col("adp_bin") == F.col("idx") % 10)
    return p.join(F.broadcast(t), near).select("neuron_id", "idx", "dist_bin", "adp_bin", "score")  # 210 rows


def n6_sizes(spark, d) -> DataFrame:
    return skeleton.point_count(derive.points(spark, d))


def n10_neuron_count(spark, d) -> DataFrame:
    return nblast.self_scores(derive.points(spark, d), ScoreTable()).agg(F.countDistinct("query_id").alias("n_neurons"))


def n5_vectors(spark, d) -> DataFrame:
    return _vectors(spark, d).select("neuron_id", "idx", *_r("vx", "vy", "vz"))


def n7_self(spark, d) -> DataFrame:
    return nblast.self_scores(derive.points(spark, d), ScoreTable()).select("target_id", "query_id", *_r("raw"))


def n8_raw(spark, d) -> DataFrame:
    v = _vectors(spark, d)
    return nblast.raw_scores(v, v).select("target_id", "query_id", *_r("raw"))


def n9_matrix(spark, d) -> DataFrame:
    return nblast.score_matrix(_vectors(spark, d)).select("target_id", "query_id", *_r("raw"))


def n9_incremental(spark, d) -> DataFrame:
    """The matrix after three deliveries of neurons, by number."""
    p, state = derive.points(spark, d), MatrixState(spark, fresh(spark, "matrix"), K_NEAR)
    for version in range(3):
        state.add(p.where(F.col("neuron_id").cast("int") % 3 == version), version)
    return state.scores().select("target_id", "query_id", *_r("raw"))


def n11_normalized(spark, d) -> DataFrame:
    return nblast.normalized(nblast.score_matrix(_vectors(spark, d)), validate=True).select("target_id", "query_id", *_r("normalized", digits=6))


def n12_mean(spark, d) -> DataFrame:
    norm = nblast.normalized(nblast.score_matrix(_vectors(spark, d)))
    return nblast.mean_scores(norm, validate=True).select("target_id", "query_id", *_r("mean", digits=6))


def g1_region_graph(spark, d) -> DataFrame:
    return seg.region_graph(derive.voxels(spark, d))


def g2_neighbours(spark, d) -> DataFrame:
    rows = seg.neighbours(seg.region_graph(derive.voxels(spark, d)), 4)  # short rows, so that segments have several
    return rows.groupBy("seg").agg(F.array_join(F.flatten(F.array_sort(F.collect_list("neighbours"))), ",").alias("neighbours"))


def g4_dendrogram(spark, d) -> DataFrame:
    return seg.with_steps(seg.build_dendrogram(derive.voxels(spark, d), MIN_MEAN)).select("step", "seg0", "seg1", *_r("affinity"))


def g3_greedy(spark, d) -> DataFrame:
    return seg.greedy_dendrogram(seg.region_graph(derive.voxels(spark, d)), MIN_MEAN).select("root", "step", "seg0", "seg1", *_r("affinity"))


def g8_components(spark, d) -> DataFrame:
    v = derive.voxels(spark, d)
    roots = seg.segments(seg.build_dendrogram(v, MIN_MEAN), CUT)
    return seg.labels(v).join(roots, "label", "left").select("label", F.coalesce("root", "label").alias("root"))


def g8_merge_tree(spark, d) -> DataFrame:
    """The segments at ten thresholds, from one merge tree."""
    return merge_tree.segments(merge_tree.build(seg.build_dendrogram(derive.voxels(spark, d), MIN_MEAN)), CUTS)


def g10_blocks(spark, d) -> DataFrame:
    """Volume, graph and relabelled volume as blocks of arrays."""
    v = derive.voxels(spark, d)
    b = written(blocks.from_voxels(v, BLOCK), "blocks")
    roots = seg.segments(seg.dendrogram(seg.region_graph(b, BLOCK), MIN_MEAN), CUT)
    return blocks.to_voxels(blocks.relabel(b, roots), BLOCK).select("z", "y", "x", "label")


def s14_chunks(spark, d) -> DataFrame:
    """Volume to .npy chunks and back."""
    path = fresh(spark, "chunks")
    chunks.write_chunks(blocks.from_voxels(derive.voxels(spark, d), BLOCK), path)
    back = blocks.to_voxels(chunks.read_chunks(spark, path), BLOCK)
    return back.select("z", "y", "x", "label", *[F.col(f"aff_{a}").cast("long").alias(f"aff_{a}") for a in "xyz"])


def g9_merge_counts(spark, d) -> DataFrame:
    v = derive.voxels(spark, d)
    return seg.merge_counts(v, seg.build_dendrogram(v, MIN_MEAN), CUT)


def g10_relabel(spark, d) -> DataFrame:
    v = derive.voxels(spark, d)
    return seg.segment(v, seg.build_dendrogram(v, MIN_MEAN), CUT).select("z", "y", "x", "label")


def queries() -> dict:
    own = globals()
    names = [n for n in own if n[0] in "kgmns" and n[1:2].isdigit()]
    return {n: own[n] for n in names}
