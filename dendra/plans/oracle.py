"""The same queries as SQL (DuckDB), written over the driver's tables."""

from __future__ import annotations

from dendra.functions.score_table import DISTANCES, ScoreTable

POINTS = """p AS (SELECT label::VARCHAR AS neuron_id, (row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1)::INTEGER AS idx,
  embedding[1]::DOUBLE * 40000 AS x, embedding[2]::DOUBLE * 40000 AS y, embedding[3]::DOUBLE * 40000 AS z FROM embeddings)"""

NUMBERED = """m AS (SELECT p_brand AS neuron_id, p_partkey AS id, (row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) - 1)::INTEGER AS idx,
  (p_size % 8)::INTEGER AS class, p_size::DOUBLE AS x, p_retailprice - 900 AS y, (p_partkey % 100)::DOUBLE AS z, p_size / 10 AS r FROM part)"""

SKELETONS = f"""{NUMBERED},
s AS (SELECT neuron_id, idx, class, x, y, z, r, (CASE WHEN idx = 0 THEN NULL WHEN idx % 9 = 0 THEN idx // 3 ELSE idx - 1 END)::INTEGER AS parent FROM m),
c AS (SELECT neuron_id, parent AS idx, count(*) AS n, max(idx)::INTEGER AS top FROM s WHERE parent IS NOT NULL GROUP BY ALL)"""

VOXELS = """v AS (SELECT (event_id // 400)::INTEGER AS z, (event_id // 20 % 20)::INTEGER AS y, (event_id % 20)::INTEGER AS x,
  (CASE WHEN event_type = 'error' AND value < 5 THEN 0 ELSE 1 + (event_id // 400 // 5) * 16 + (event_id // 20 % 20 // 5) * 4 + event_id % 20 // 5 END)::BIGINT AS label,
  least(1000, floor(20 * value))::BIGINT AS aff FROM events)"""

GRAPH = f"""{VOXELS},
t AS (SELECT a.label AS la, b.label AS lb, a.aff FROM v a JOIN v b ON b.z = a.z - 1 AND b.y = a.y AND b.x = a.x
      UNION ALL SELECT a.label, b.label, a.aff FROM v a JOIN v b ON b.z = a.z AND b.y = a.y - 1 AND b.x = a.x
      UNION ALL SELECT a.label, b.label, a.aff FROM v a JOIN v b ON b.z = a.z AND b.y = a.y AND b.x = a.x - 1),
g AS (SELECT least(la, lb) AS seg0, greatest(la, lb) AS seg1, count(*) AS n, sum(aff)::BIGINT AS aff_sum FROM t WHERE la > 0 AND lb > 0 AND la <> lb GROUP BY ALL)"""

DENDROGRAM = f"""{GRAPH},
o AS (SELECT *, row_number() OVER (ORDER BY aff_sum DESC, seg0, seg1) - 1 AS step, max((aff_sum / n < 630)::INTEGER) OVER (ORDER BY aff_sum DESC, seg0, seg1) AS cut FROM g),
dd AS (SELECT step::BIGINT AS step, seg0, seg1, aff_sum / n AS affinity FROM o WHERE cut = 0)"""

COMPONENTS = f"""{DENDROGRAM},
e AS (SELECT seg0 AS a, seg1 AS b FROM dd WHERE affinity >= 700 UNION ALL SELECT seg1, seg0 FROM dd WHERE affinity >= 700),
l AS (SELECT DISTINCT label FROM v),
reach AS (SELECT label AS a, label AS r FROM l UNION SELECT reach.a, e.b FROM reach JOIN e ON e.a = reach.r),
roots AS (SELECT a AS label, min(r) AS root FROM reach GROUP BY a)"""

THRESHOLDS = f"""{DENDROGRAM},
h AS (SELECT 640.0::DOUBLE + 20 * unnest(range(0, 10)) AS threshold),
e AS (SELECT threshold, seg0 AS a, seg1 AS b FROM dd JOIN h ON affinity >= threshold UNION ALL SELECT threshold, seg1, seg0 FROM dd JOIN h ON affinity >= threshold),
reach AS (SELECT threshold, a AS label, a AS r FROM e UNION SELECT reach.threshold, reach.label, e.b FROM reach JOIN e ON e.threshold = reach.threshold AND e.a = reach.r)"""

_MOMENTS = "count(*)::DOUBLE AS n, sum(x) AS sx, sum(y) AS sy, sum(z) AS sz, sum(x*x) AS sxx, sum(y*y) AS syy, sum(z*z) AS szz, sum(x*y) AS sxy, sum(x*z) AS sxz, sum(y*z) AS syz"


def _component(source: str, key: str) -> str:
    """CTEs that turn coordinates x, y, z in ``source`` into (key, vx, vy, vz) named ``pc``: power iteration has no place in SQL, so
    the eigenvector comes from lambda and the longest cross product of rows."""
    return f"""s0 AS (SELECT {key}, {_MOMENTS} FROM {source} GROUP BY {key}),
s1 AS (SELECT {key}, (sxx-sx*sx/n)/(n-1) AS a, (syy-sy*sy/n)/(n-1) AS b, (szz-sz*sz/n)/(n-1) AS c, (sxy-sx*sy/n)/(n-1) AS d, (sxz-sx*sz/n)/(n-1) AS e, (syz-sy*sz/n)/(n-1) AS f FROM s0),
s2 AS (SELECT *, (a+b+c)/3 AS q, sqrt(((a-(a+b+c)/3)*(a-(a+b+c)/3) + (b-(a+b+c)/3)*(b-(a+b+c)/3) + (c-(a+b+c)/3)*(c-(a+b+c)/3) + 2*(d*d+e*e+f*f))/6) AS p FROM s1),
s3 AS (SELECT *, ((a-q)*((b-q)*(c-q)-f*f) - d*(d*(c-q)-f*e) + e*(d*f-(b-q)*e))/(p*p*p)/2 AS r FROM s2),
s4 AS (SELECT *, q + 2*p*cos(acos(greatest(-1.0, least(1.0, r)))/3) AS l FROM s3),
s5 AS (SELECT {key}, unnest([[d*f-e*(b-l), e*d-(a-l)*f, (a-l)*(b-l)-d*d], [d*(c-l)-e*f, e*e-(a-l)*(c-l), (a-l)*f-d*e], [(b-l)*(c-l)-f*f, f*e-d*(c-l), d*f-(b-l)*e]]) AS w FROM s4),
s6 AS (SELECT {key}, arg_max(w, w[1]*w[1]+w[2]*w[2]+w[3]*w[3]) AS w FROM s5 GROUP BY {key}),
s7 AS (SELECT {key}, w, sqrt(w[1]*w[1]+w[2]*w[2]+w[3]*w[3]) AS h,
  CASE WHEN abs(w[1]) >= abs(w[2]) AND abs(w[1]) >= abs(w[3]) THEN w[1] WHEN abs(w[2]) >= abs(w[3]) THEN w[2] ELSE w[3] END AS lead FROM s6),
pc AS (SELECT {key}, sign(lead)*w[1]/h AS vx, sign(lead)*w[2]/h AS vy, sign(lead)*w[3]/h AS vz FROM s7)"""


def _near(k: int, same: bool, name: str = "nn") -> str:
    on = "=" if same else "<>"
    return f"""{name} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, query_idx, target_id ORDER BY d2, idx)::INTEGER AS rank FROM (
  SELECT q.neuron_id AS query_id, q.idx AS query_idx, t.neuron_id AS target_id, t.idx, t.x - q.x AS x, t.y - q.y AS y, t.z - q.z AS z,
         (q.x-t.x)*(q.x-t.x) + (q.y-t.y)*(q.y-t.y) + (q.z-t.z)*(q.z-t.z) AS d2 FROM p q JOIN p t ON t.neuron_id {on} q.neuron_id)) WHERE rank <= {k})"""


def _scores() -> str:
    ends = [*DISTANCES[1:], "'inf'"]
    rows = ", ".join(f"({i}, {j}, {lo}::DOUBLE, {hi}::DOUBLE, {s!r}::DOUBLE)" for i, (lo, hi) in enumerate(zip(DISTANCES, ends)) for j, s in enumerate(ScoreTable().rows[i]))
    return f"st(dist_bin, adp_bin, lo, hi, score) AS (VALUES {rows})"


VECTORS = f"{POINTS}, {_near(10, True, 'nv')}, {_component('nv', 'query_id, query_idx')}, vec AS (SELECT query_id AS neuron_id, query_idx AS idx, vx, vy, vz FROM pc)"

RAW = f"""{VECTORS}, {_near(1, False)}, {_scores()},
mt AS (SELECT nn.query_id, nn.target_id, sqrt(nn.d2) AS dist, round(abs(a.vx*b.vx + a.vy*b.vy + a.vz*b.vz), 9) AS adp
       FROM nn JOIN vec a ON a.neuron_id = nn.query_id AND a.idx = nn.query_idx JOIN vec b ON b.neuron_id = nn.target_id AND b.idx = nn.idx),
own AS (SELECT neuron_id AS target_id, neuron_id AS query_id, count(*) * {ScoreTable().self_score!r}::DOUBLE AS raw FROM p GROUP BY neuron_id),
rawc AS (SELECT target_id, query_id, sum(score) AS raw FROM mt JOIN st ON dist >= lo AND dist < hi AND adp_bin = least(9, greatest(0, trunc(adp * 10 - 1e-4)))::INTEGER GROUP BY ALL),
mx AS (SELECT * FROM rawc UNION ALL SELECT * FROM own),
nm AS (SELECT m.target_id, m.query_id, m.raw / o.raw AS normalized FROM mx m JOIN own o ON o.query_id = m.query_id)"""


def _round(*columns: str, digits: int = 4, of: str = "") -> str:
    return ", ".join(f"round({of}{c}, {digits}) + 0.0 AS {c}" for c in columns)


NODES = f"SELECT neuron_id, idx, class, {_round('x', 'y', 'z', 'r')}, parent FROM s"


#: The walk of a segment: state is the node, where the node before it was put, and where the last kept one was put.
DOWNSAMPLE = f"""WITH RECURSIVE {SKELETONS},
k AS (SELECT s.*, coalesce(c.n, 0) AS n, c.top, f.x AS fx, f.y AS fy, f.z AS fz, f.r AS fr, coalesce(u.n, 0) AS pn FROM s
      LEFT JOIN c USING (neuron_id, idx) LEFT JOIN s f ON f.neuron_id = s.neuron_id AND f.idx = c.top LEFT JOIN c u ON u.neuron_id = s.neuron_id AND u.idx = s.parent),
w AS (SELECT neuron_id, idx AS seed, idx, n, top, class, x, y, z, r, x AS lx, y AS ly, z AS lz, TRUE AS kept, 0 AS pos FROM k WHERE parent IS NULL OR pn >= 2
  UNION ALL
  SELECT neuron_id, seed, idx, n, top, class, CASE WHEN far THEN mx ELSE x END, CASE WHEN far THEN my ELSE y END, CASE WHEN far THEN mz ELSE z END, CASE WHEN far THEN mr ELSE r END,
         CASE WHEN far THEN mx ELSE lx END, CASE WHEN far THEN my ELSE ly END, CASE WHEN far THEN mz ELSE lz END, far, pos FROM (
    SELECT k.neuron_id, w.seed, k.idx, k.n, k.top, k.class, k.x, k.y, k.z, k.r, w.lx, w.ly, w.lz, w.pos + 1 AS pos,
           (k.x-w.lx)*(k.x-w.lx) + (k.y-w.ly)*(k.y-w.ly) + (k.z-w.lz)*(k.z-w.lz) >= 1600 AS far,
           CASE WHEN k.top IS NULL THEN (w.x+k.x)/2 ELSE (w.x+k.x+k.fx)/3 END AS mx, CASE WHEN k.top IS NULL THEN (w.y+k.y)/2 ELSE (w.y+k.y+k.fy)/3 END AS my,
           CASE WHEN k.top IS NULL THEN (w.z+k.z)/2 ELSE (w.z+k.z+k.fz)/3 END AS mz, CASE WHEN k.top IS NULL THEN (w.r+k.r)/2 ELSE (w.r+k.r+k.fr)/3 END AS mr
    FROM w JOIN k ON k.neuron_id = w.neuron_id AND k.parent = w.idx WHERE w.n = 1)),
kw AS (SELECT * FROM w WHERE kept OR n <> 1)
SELECT neuron_id, idx AS source_idx, class, {_round('x', 'y', 'z', 'r')},
       coalesce(lag(idx) OVER (PARTITION BY neuron_id, seed ORDER BY pos), (SELECT s.parent FROM s WHERE s.neuron_id = kw.neuron_id AND s.idx = kw.seed)) AS source_parent FROM kw"""


def sql() -> dict[str, str]:
    sk, pts, vox = f"WITH {SKELETONS} ", f"WITH {POINTS} ", f"WITH {VOXELS} "
    return {
        "k1_reindex": f"WITH {NUMBERED} SELECT neuron_id, idx, x, y, CASE WHEN id % 10 <> 0 THEN idx END AS parent FROM m",
        "k2_first_child_sibling": sk + """SELECT s.neuron_id, s.idx, c.top AS first_child, CASE WHEN s.parent IS NOT NULL THEN
            lead(s.idx) OVER (PARTITION BY s.neuron_id, s.parent ORDER BY s.idx <> u.top, s.idx) END AS next_sibling
            FROM s LEFT JOIN c USING (neuron_id, idx) LEFT JOIN c u ON u.neuron_id = s.neuron_id AND u.idx = s.parent""",
        "k3_k4_k5_node_kind": sk + "SELECT neuron_id, idx, parent IS NULL AS is_root, n IS NULL AS is_terminal, coalesce(n, 0) >= 2 AS is_branching, coalesce(n, 0) AS n_children FROM s LEFT JOIN c USING (neuron_id, idx)",
        "k4_terminals": sk + "SELECT neuron_id, idx FROM s ANTI JOIN c USING (neuron_id, idx)",
        "k6_k7_counts": sk + "SELECT neuron_id, count(*) AS n_points, count(parent) AS n_edges FROM s GROUP BY neuron_id",
        "k8_edges": sk + "SELECT neuron_id, idx AS child, parent FROM s WHERE parent IS NOT NULL",
        "k9_children": sk + "SELECT s.neuron_id, parent AS idx, string_agg(s.idx::VARCHAR, ',' ORDER BY s.idx <> c.top, s.idx) AS children FROM s JOIN c ON c.neuron_id = s.neuron_id AND c.idx = s.parent GROUP BY s.neuron_id, parent",
        "k10_center": sk + "SELECT neuron_id, idx, " + ", ".join(f"round({a} - avg({a}) OVER (PARTITION BY neuron_id), 4) + 0.0 AS {a}" for a in "xyzr") + " FROM s",
        "k11_downsample": DOWNSAMPLE,
        "k11_by_segments": DOWNSAMPLE,
        # an end that is kept as a node of its segment comes twice, the second time as its own parent
        "k11_twofold": DOWNSAMPLE.split("SELECT neuron_id, idx AS source_idx")[0] + """, o AS (SELECT neuron_id, idx, seed, kept AND n <> 1 AS twice,
            coalesce(lag(idx) OVER (PARTITION BY neuron_id, seed ORDER BY pos), (SELECT s.parent FROM s WHERE s.neuron_id = kw.neuron_id AND s.idx = kw.seed)) AS up FROM kw),
            a AS (SELECT neuron_id, idx, up FROM o UNION ALL SELECT neuron_id, idx, idx FROM o WHERE twice)
            SELECT neuron_id, idx AS source_idx, count(*) AS n, min(up) AS low_parent, max(up) AS high_parent FROM a GROUP BY neuron_id, idx""",
        "k12_path_length": sk + "SELECT s.neuron_id, round(sum(sqrt((s.x-u.x)*(s.x-u.x) + (s.y-u.y)*(s.y-u.y) + (s.z-u.z)*(s.z-u.z))), 4) + 0.0 AS path_length FROM s JOIN s u ON u.neuron_id = s.neuron_id AND u.idx = s.parent GROUP BY s.neuron_id",
        "k15_attributes": sk + """SELECT neuron_id, idx, class, coalesce(parent, -2) AS parent, coalesce(top, -2) AS first_child, coalesce(sib, -2) AS next_sibling FROM (
            SELECT s.*, c.top, CASE WHEN s.parent IS NOT NULL THEN lead(s.idx) OVER (PARTITION BY s.neuron_id, s.parent ORDER BY s.idx <> u.top, s.idx) END AS sib
            FROM s LEFT JOIN c USING (neuron_id, idx) LEFT JOIN c u ON u.neuron_id = s.neuron_id AND u.idx = s.parent)""",
        "k17_equal": sk + "SELECT neuron_id, bool_and(d <= 0.001 + 1e-5 * abs(x + d)) AS equal FROM (SELECT *, CASE WHEN neuron_id LIKE '%1' THEN 0.5 ELSE 0.0005 END::DOUBLE AS d FROM s) GROUP BY neuron_id",
        "k14_set_points": sk + "SELECT neuron_id, idx, class, round(x * 2, 4) + 0.0 AS x, round(y + 1, 4) + 0.0 AS y, round(-z, 4) + 0.0 AS z, round(r / 2, 4) + 0.0 AS r, parent FROM s",
        "k18_initialize": sk + """SELECT neuron_id, idx, 0 AS class, 0.0::DOUBLE AS x, 0.0::DOUBLE AS y, 0.0::DOUBLE AS z, 0.0::DOUBLE AS r, NULL::INTEGER AS parent,
            CASE WHEN idx % 2 = 0 THEN round(s.x, 4) + 0.0 END AS new_x, CASE WHEN idx % 2 = 0 THEN round(s.r, 4) + 0.0 END AS new_r FROM s""",
        "k19_plot_points": pts + "SELECT neuron_id, x, y, z FROM p WHERE idx < 600",
        "s1_swc_lenient": f"""WITH {SKELETONS}, kept AS (SELECT *, (row_number() OVER (PARTITION BY neuron_id ORDER BY idx) - 1)::INTEGER AS own FROM s WHERE idx % 5 <> 0 AND idx % 7 <> 0)
            SELECT a.neuron_id, a.own AS idx, a.class, {_round('x', 'y', 'z', 'r', of='a.')}, b.own AS parent FROM kept a LEFT JOIN kept b ON b.neuron_id = a.neuron_id AND b.idx = a.parent""",
        "s2_swc_strict": sk + NODES,
        "s1_arrivals": sk + NODES,
        "s14_chunks": vox + "SELECT z, y, x, label, aff AS aff_x, aff AS aff_y, aff AS aff_z FROM v",
        "s3_swc_rows": f"WITH {NUMBERED} SELECT neuron_id, idx, class, {_round('x', 'y', 'z', 'r')}, CASE WHEN id % 10 <> 0 THEN idx END AS parent FROM m",
        "s4_attribute_rows": sk + NODES,
        "s5_point_rows": sk + f"SELECT neuron_id, idx, 0 AS class, {_round('x', 'y', 'z')}, 0.0::DOUBLE AS r, parent FROM s",
        "s9_swc_files": sk + NODES,
        "s9_swc_text": sk + """SELECT neuron_id, '# id class x y z r parent' || chr(10) || string_agg(format('{} {} {} {} {} {} {}', idx + 1, class, round(x)::BIGINT, round(y)::BIGINT, round(z)::BIGINT, round(r)::BIGINT, coalesce(parent + 1, -1)), chr(10) ORDER BY idx) || chr(10) AS swc
            FROM s GROUP BY neuron_id""",
        "s11_saved_skeletons": sk + NODES,
        "s12_saved_vectors": f"WITH {VECTORS} SELECT neuron_id, idx, {_round('x', 'y', 'z', 'vx', 'vy', 'vz')} FROM vec JOIN p USING (neuron_id, idx)",
        "n4_table": f"WITH {POINTS}, {_scores()}, o AS (SELECT *, sqrt(x*x + y*y + z*z) AS d FROM p) SELECT neuron_id, idx, dist_bin, adp_bin, score FROM o JOIN st ON d >= lo AND d < hi AND adp_bin = idx % 10",
        "n6_sizes": pts + "SELECT neuron_id, count(*) AS n_points FROM p GROUP BY neuron_id",
        "n10_neuron_count": pts + "SELECT count(DISTINCT neuron_id) AS n_neurons FROM p",
        "s6_s7_precomputed": sk + "SELECT neuron_id, idx, class, x::FLOAT::DOUBLE AS x, y::FLOAT::DOUBLE AS y, z::FLOAT::DOUBLE AS z, r::FLOAT::DOUBLE AS r, parent FROM s",
        "s8_swc_lines": sk + "SELECT neuron_id, idx, format('{} {} {} {} {} {} {}', idx + 1, class, round(x)::BIGINT, round(y)::BIGINT, round(z)::BIGINT, round(r)::BIGINT, coalesce(parent + 1, -1)) AS line FROM s",
        "m1_pca_group": f"WITH {POINTS}, ctr AS (SELECT p.neuron_id, x - avg(x) OVER w AS x, y - avg(y) OVER w AS y, z - avg(z) OVER w AS z FROM p WINDOW w AS (PARTITION BY neuron_id)), {_component('ctr', 'neuron_id')} SELECT neuron_id, {_round('vx', 'vy', 'vz')} FROM pc",
        "m2_m4_bbox": pts + """SELECT *, (CASE WHEN max_x - min_x >= max_y - min_y AND max_x - min_x >= max_z - min_z THEN 0 WHEN max_y - min_y >= max_z - min_z THEN 1 ELSE 2 END)::INTEGER AS dim FROM (
            SELECT neuron_id, min(x) AS min_x, min(y) AS min_y, min(z) AS min_z, max(x) AS max_x, max(y) AS max_y, max(z) AS max_z FROM p GROUP BY neuron_id)""",
        "m5_box_distance": f"""WITH {POINTS}, b AS (SELECT neuron_id AS box_id, min(x) AS x0, min(y) AS y0, min(z) AS z0, max(x) AS x1, max(y) AS y1, max(z) AS z1 FROM p GROUP BY neuron_id),
            o AS (SELECT neuron_id, idx, box_id, greatest(0.0, x0 - x, x - x1) AS dx, greatest(0.0, y0 - y, y - y1) AS dy, greatest(0.0, z0 - z, z - z1) AS dz FROM p JOIN b ON box_id::INT = neuron_id::INT + 1)
            SELECT neuron_id, idx, box_id, dx*dx + dy*dy + dz*dz AS d2 FROM o""",
        "m9_knn": f"WITH {POINTS}, {_near(5, True)} SELECT query_id AS neuron_id, query_idx, idx, rank FROM nn",
        "m8_m9_tree": f"WITH {POINTS}, {_near(3, False)} SELECT query_id, query_idx, target_id, idx, rank FROM nn",
        "m8_leaves": pts + "SELECT neuron_id, idx, x, y, z FROM p",
        "n2_lookup": f"""WITH {POINTS}, {_near(1, False)}, {_scores()} SELECT query_id, query_idx, target_id, dist_bin, adp_bin, score
            FROM nn JOIN st ON sqrt(d2) >= lo AND sqrt(d2) < hi AND adp_bin = greatest(0, trunc((query_idx % 11) / 10 * 10 - 1e-4))::INTEGER""",
        "n5_vectors": f"WITH {VECTORS} SELECT neuron_id, idx, {_round('vx', 'vy', 'vz')} FROM vec",
        "n7_self": f"WITH {RAW} SELECT target_id, query_id, {_round('raw')} FROM own",
        "n8_raw": f"""WITH {RAW}, alone AS (SELECT neuron_id AS target_id, neuron_id AS query_id, sum(score) AS raw FROM vec JOIN st
            ON dist_bin = 0 AND adp_bin = least(9, greatest(0, trunc(round(vx*vx + vy*vy + vz*vz, 9) * 10 - 1e-4)))::INTEGER GROUP BY neuron_id)
            SELECT target_id, query_id, {_round('raw')} FROM (SELECT * FROM rawc UNION ALL SELECT * FROM alone)""",
        "n9_matrix": f"WITH {RAW} SELECT target_id, query_id, {_round('raw')} FROM mx",
        "n9_incremental": f"WITH {RAW} SELECT target_id, query_id, {_round('raw')} FROM mx",
        "n11_normalized": f"WITH {RAW} SELECT target_id, query_id, {_round('normalized', digits=6)} FROM nm",
        "n12_mean": f"WITH {RAW} SELECT a.target_id, a.query_id, round(CASE WHEN a.target_id = a.query_id THEN 1.0::DOUBLE ELSE (a.normalized + b.normalized) / 2 END, 6) + 0.0 AS mean FROM nm a JOIN nm b ON b.target_id = a.query_id AND b.query_id = a.target_id",
        "g1_region_graph": f"WITH {GRAPH} SELECT * FROM g",
        "g2_neighbours": f"WITH {GRAPH}, b AS (SELECT seg0 AS seg, seg1 AS o FROM g UNION SELECT seg1, seg0 FROM g) SELECT seg, string_agg(o::VARCHAR, ',' ORDER BY o) AS neighbours FROM b GROUP BY seg",
        "g4_dendrogram": f"WITH {DENDROGRAM} SELECT step, seg0, seg1, {_round('affinity')} FROM dd",
        "g8_components": f"WITH RECURSIVE {COMPONENTS} SELECT label, root FROM roots",
        "g8_merge_tree": f"WITH RECURSIVE {THRESHOLDS} SELECT threshold, label, min(r) AS root FROM reach GROUP BY threshold, label",
        "g10_blocks": f"WITH RECURSIVE {COMPONENTS} SELECT z, y, x, root AS label FROM v JOIN roots USING (label)",
        "g9_merge_counts": f"WITH RECURSIVE {COMPONENTS} SELECT (SELECT count(*) FROM l) AS n_labels, (SELECT count(*) FROM dd WHERE affinity >= 700) AS n_merges, (SELECT count(DISTINCT root) FROM roots) AS n_segments",
        "g10_relabel": f"WITH RECURSIVE {COMPONENTS} SELECT z, y, x, root AS label FROM v JOIN roots USING (label)",
    }
