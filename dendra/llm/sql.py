"""SQL (DuckDB) of the queries that SQL can express over whole tables."""

QUALITY_RULES = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT rid, doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws,
             list_filter(string_split(t, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS ls FROM d),
win AS (SELECT rid, unnest(range(1, len(ws) - 3)) AS i, ws FROM w WHERE len(ws) >= 5),
keyed AS (SELECT rid, i, ws[i:i+4] AS k FROM win),
twice AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, k) AS c FROM keyed) WHERE c >= 2),
rep AS (SELECT rid, count(DISTINCT i + o) AS n FROM twice, (SELECT unnest(range(0, 5)) AS o) GROUP BY rid),
m AS (SELECT w.doc_id, len(ws)::BIGINT AS n_words, coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0)::BIGINT AS word_chars,
             len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols,
             (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(rep.n, 0)::BIGINT AS n_repeat_words,
             len(ls)::BIGINT AS n_lines, len(regexp_extract_all(t, '!'))::BIGINT AS n_bangs
      FROM w LEFT JOIN rep USING (rid)),
b AS (SELECT *, ((n_words < 10)::BIGINT + 2 * (100 * n_repeat_words > 20 * n_words)::BIGINT + 4 * (10 * n_symbols > n_words)::BIGINT
               + 8 * (2 * n_dup_lines > n_lines)::BIGINT + 16 * (word_chars < 2 * n_words)::BIGINT
               + 32 * (word_chars > 15 * n_words)::BIGINT + 64 * (2 * n_bangs > n_words)::BIGINT)::BIGINT AS fail_bits FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (fail_bits & 3) <> 0 AS base_failed, fail_bits = 0 AS kept,
       n_lines, n_bangs, fail_bits, 'prose-1' AS policy, (fail_bits & 3) = 0 AND bit_count(fail_bits & 124) <= 1 AS kept_leniently,
       CASE WHEN bit_count(fail_bits) = 1 THEN count(*) OVER (PARTITION BY fail_bits) ELSE 0 END::BIGINT AS n_kept_without_its_rule FROM b
"""

# Counts of the other documents: all counts less the document's own.
LM_SCORES = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
t AS (SELECT rid, i, ws[i] AS w, CASE WHEN i > 1 THEN ws[i - 1] END AS v, CASE WHEN i > 2 THEN ws[i - 2] END AS u FROM (SELECT rid, ws, unnest(range(1, len(ws) + 1)) AS i FROM d)),
g AS (SELECT rid, 1 AS n, [w] AS k FROM t UNION ALL SELECT rid, 2, [v, w] FROM t WHERE v IS NOT NULL UNION ALL SELECT rid, 3, [u, v, w] FROM t WHERE u IS NOT NULL),
own AS (SELECT rid, k, count(*) AS c FROM g GROUP BY rid, k),
others AS (SELECT rid, k, sum(c) OVER (PARTITION BY k) - c AS c FROM own),
x AS (SELECT t.rid, i, a.c AS c1, b.c AS c2, bc.c AS c2_context, c.c AS c3, cc.c AS c3_context FROM t
      LEFT JOIN others a ON a.rid = t.rid AND a.k = [w]
      LEFT JOIN others b ON b.rid = t.rid AND b.k = [v, w] LEFT JOIN others bc ON bc.rid = t.rid AND bc.k = [v]
      LEFT JOIN others c ON c.rid = t.rid AND c.k = [u, v, w] LEFT JOIN others cc ON cc.rid = t.rid AND cc.k = [u, v]),
y AS (SELECT x.rid, i, least(i, 3) - CASE WHEN i > 2 AND c3 > 0 THEN 3 WHEN i > 1 AND c2 > 0 THEN 2 ELSE 1 END AS steps,
             CASE WHEN i > 2 AND c3 > 0 THEN ln(c3) - ln(c3_context) WHEN i > 1 AND c2 > 0 THEN ln(c2) - ln(c2_context)
                  ELSE ln(greatest(c1, 1)) - ln(greatest((SELECT count(*) FROM t) - len(d.ws), 1)) END AS s FROM x JOIN d USING (rid)),
z AS (SELECT rid, sum((steps > 0)::BIGINT)::BIGINT AS n_backed_off, sum(s + steps * ln(0.4)) AS s FROM y GROUP BY rid)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_backed_off, 0)::BIGINT AS n_backed_off, round(s, 4) AS log_prob, round(s / len(ws), 6) AS lm_score FROM d LEFT JOIN z USING (rid)
"""

EXACT_TOP_K = """
WITH v AS (SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS e FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (SELECT q.rid, q.vec_id AS query_id, c.vec_id, list_dot_product(q.e, c.e)::BIGINT AS score FROM v q JOIN v c ON c.rid <> q.rid WHERE q.vec_id % 100 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY rid ORDER BY score DESC, vec_id)::INTEGER AS rank FROM p)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""

CHATS = r"""
WITH c AS (SELECT conv_id::BIGINT AS conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text, CASE WHEN conv_id IS NULL THEN row_number() OVER () END AS lone FROM conversations
           UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]', NULL UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]', NULL),
e AS (SELECT *, length(text) + len(regexp_extract_all(text, '\\|</?s>|\[/?INST\]|<</?SYS>>|\[/?ROLE\]')) AS t,
             length(role) + len(regexp_extract_all(role, '\\|</?s>|\[/?INST\]|<</?SYS>>|\[/?ROLE\]')) AS r FROM c)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       (3 + sum(CASE role WHEN 'user' THEN t + 13 WHEN 'assistant' THEN t + 4 WHEN 'system' THEN t + 15 ELSE r + t + 17 END))::BIGINT AS formatted_chars
FROM e GROUP BY conv_id, lone
"""

FILL_IN_MIDDLE = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS u, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
e AS (SELECT doc_id, t, u, len(u) AS n, ('0x' || h[1:8])::BIGINT AS h1, ('0x' || h[9:16])::BIGINT AS h2, ('0x' || h[17:24])::BIGINT AS h3, ('0x' || h[25:32])::BIGINT AS h4 FROM d),
f AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS lo, greatest(h1 % (n + 1), h2 % (n + 1)) AS hi,
             CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM e),
g AS (SELECT *, array_to_string(u[1:lo], '') AS p, array_to_string(u[lo + 1:hi], '') AS m, array_to_string(u[hi + 1:n], '') AS s FROM f)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN length(p) END::BIGINT AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END::BIGINT AS middle_chars,
       sha256(CASE form WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m WHEN 'spm' THEN '<S>' || s || '<P>' || p || '<M>' || m ELSE t END) AS output_sha256, sha256(t) AS restored_sha256 FROM g
"""
