"""SQL for the queries of this folder that SQL can express on whole tables, written apart from their code."""

WORD = r"[^\x20\x09-\x0D]+"

OP7 = """
WITH d AS (SELECT doc_id, source, text, string_split(text, chr(10)) AS ls FROM documents),
seen AS (SELECT source, line, count(DISTINCT text) AS n FROM (
    SELECT source, text, unnest(list_distinct(list_filter(list_transform(ls, lambda x: trim(x, ' ')), lambda x: x <> ''))) AS line FROM d) GROUP BY source, line),
totals AS (SELECT source, count(DISTINCT text) + max((text IS NULL)::INT) AS pages FROM documents GROUP BY source),
bad AS (SELECT s.source, list(line) AS bad FROM seen s JOIN totals t ON s.source IS NOT DISTINCT FROM t.source
    WHERE n >= 2 AND n / pages > 0.05 GROUP BY s.source),
kept AS (SELECT d.*, list_filter(ls, lambda x: NOT list_contains(coalesce(bad, []::VARCHAR[]), trim(x, ' '))) AS left_over
    FROM d LEFT JOIN bad b ON d.source IS NOT DISTINCT FROM b.source)
SELECT doc_id, source, coalesce(len(ls), 0)::INT AS n_lines, (coalesce(len(ls), 0) - coalesce(len(left_over), 0))::INT AS n_dropped,
    CASE WHEN text IS NOT NULL THEN coalesce(array_to_string(left_over, chr(10)), '') END AS text FROM kept
"""

OP8 = rf"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{WORD}')) AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS rank FROM d GROUP BY source),
w AS (SELECT *, [3, 1, 2][rank % 3 + 1]::DOUBLE AS weight, 2 * source_size AS most, (SELECT 1.5 * sum(size)::DOUBLE FROM d) AS budget FROM s),
c AS (SELECT *, (budget - coalesce(sum(most) OVER (ORDER BY most / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE)
    / sum(weight) OVER (ORDER BY most / weight, rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w),
v AS (SELECT coalesce(arg_min(level, (most / weight, rank)) FILTER (weight * level <= most), 0) AS level FROM c),
t AS (SELECT w.*, CASE WHEN weight * v.level > most THEN most::DOUBLE ELSE weight * v.level END AS target FROM w, v),
p AS (SELECT doc_id, size, t.source_size, t.target, t.rank, floor(t.target + 0.5)::BIGINT AS stop, (sum(size) OVER (PARTITION BY d.source
    ORDER BY md5(coalesce(doc_id::VARCHAR, '')), doc_id NULLS FIRST, size ROWS UNBOUNDED PRECEDING))::BIGINT - size AS before
    FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
q AS (SELECT *, greatest(0, least(size, stop - before)) AS once, greatest(0, least(size, stop - source_size - before)) AS twice FROM p),
y AS (SELECT *, (before + once / 2) / target AS y FROM q)
SELECT doc_id, size::BIGINT AS size, source_size, target, (once + twice)::BIGINT AS taken,
    CASE WHEN once > 0 THEN round(greatest(0, least(1, CASE rank % 3 WHEN 0 THEN (sqrt(y * -2 + 2.25) - 1.5) / -1
        WHEN 1 THEN (sqrt(y * 2 + 0.25) - 0.5) / 1 ELSE y END)), 6) END AS position FROM y
"""

OP9 = r"""
WITH m AS (SELECT row_number() OVER () AS rid, conv_id, turn, role, coalesce(text, '') AS text FROM conversations),
a AS (SELECT rid, conv_id, turn, regexp_split_to_array(text, '\r?\n') AS ls FROM m),
l AS (SELECT rid, conv_id, turn, unnest(ls) AS line, generate_subscripts(ls, 1) AS i FROM a),
k AS (SELECT *, regexp_extract(line, '^[ \t]*((?:>[ \t]?)*)', 1) AS marks FROM l),
b AS (SELECT rid, conv_id, turn, i, line, len(marks) - len(replace(marks, '>', '')) AS level,
    CASE WHEN marks LIKE '%>%' THEN regexp_replace(line, '^[ \t]*(?:>[ \t]?)*', '') ELSE line END AS body FROM k),
n AS (SELECT *, lag(level) OVER w AS prior, lead(level) OVER w AS later FROM b WINDOW w AS (PARTITION BY rid ORDER BY i)),
g AS (SELECT *, sum((prior IS DISTINCT FROM level)::INT) OVER (PARTITION BY rid ORDER BY i ROWS UNBOUNDED PRECEDING) AS run FROM n),
runs AS (SELECT rid, conv_id, turn, run, level, string_agg(body, chr(10) ORDER BY i) AS text FROM g GROUP BY rid, conv_id, turn, run, level),
own AS (SELECT rid, conv_id, turn, string_agg(text, chr(10) ORDER BY run) AS text FROM runs WHERE level = 0 GROUP BY rid, conv_id, turn),
spoken AS (
    SELECT conv_id, turn, text FROM own UNION ALL SELECT conv_id, turn, text FROM runs WHERE level = 0
    UNION ALL SELECT conv_id, turn, body FROM g WHERE level = 0
    UNION ALL SELECT conv_id, turn, unnest(regexp_split_to_array(text, '\n[ \t]*\n')) FROM runs WHERE level = 0),
said AS (SELECT conv_id, turn, trim(regexp_replace(lower(text), '[\x20\x09-\x0D]+', ' ', 'g'), ' ') AS t FROM spoken WHERE turn IS NOT NULL),
origins AS (SELECT conv_id, t, min(turn) AS origin FROM said WHERE t <> '' GROUP BY conv_id, t),
asked AS (SELECT DISTINCT conv_id, turn, trim(regexp_replace(lower(text), '[\x20\x09-\x0D]+', ' ', 'g'), ' ') AS t FROM runs WHERE level > 0),
found AS (SELECT a.conv_id, a.turn, max(origin) AS reply_to, count(DISTINCT a.t) AS n_linked FROM asked a
    JOIN origins o ON a.conv_id IS NOT DISTINCT FROM o.conv_id AND a.t = o.t WHERE origin < a.turn GROUP BY a.conv_id, a.turn),
place AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) AS position FROM (SELECT DISTINCT conv_id, turn FROM m)),
shape AS (SELECT rid, count(*) FILTER (level > 0) AS n_quoted, coalesce(string_agg(body, chr(10) ORDER BY i) FILTER (
    level = 0 AND NOT (regexp_matches(line, '(?i)\bwrote:[ \t]*$') AND coalesce(later > 0, false))), '') AS body FROM g GROUP BY rid)
SELECT m.conv_id, m.turn, m.role, p.position, f.reply_to, s.n_quoted::INT AS n_quoted, coalesce(f.n_linked, 0) AS n_linked,
    CASE WHEN s.n_quoted > 0 THEN trim(s.body, ' ') ELSE m.text END AS text
FROM m JOIN shape s ON m.rid = s.rid JOIN place p ON m.conv_id IS NOT DISTINCT FROM p.conv_id AND m.turn IS NOT DISTINCT FROM p.turn
LEFT JOIN found f ON m.conv_id IS NOT DISTINCT FROM f.conv_id AND m.turn IS NOT DISTINCT FROM f.turn
"""

#: Vectors as whole numbers, and scores of all pairs that a condition joins.
VECTORS = """
WITH u AS (SELECT vec_id, label, embedding FROM embeddings
    WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
v AS (SELECT vec_id, label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM u),
"""

OP12 = VECTORS + """
r AS (SELECT vec_id, e, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label FROM v WHERE label IS NOT NULL),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, list_dot_product(a.e, b.e)::BIGINT AS score
    FROM r a JOIN r b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
    QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5),
n AS (SELECT p.*, s.vec_id AS negative_id, s.score AS negative_score,
    row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY s.score DESC, s.vec_id)::INT AS rank
    FROM p JOIN s ON p.anchor_id = s.anchor_id AND NOT s.same AND 50 * positive_score <= 100 * s.score AND 100 * s.score <= 95 * positive_score)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 3
"""

OP13 = VECTORS + """
s AS (SELECT a.vec_id AS query_id, b.vec_id, list_dot_product(a.e, b.e)::BIGINT AS score FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id),
n AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM n WHERE rank <= 5
"""

OP11 = """
WITH t AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS pos, coalesce(role, '') AS role, coalesce(text, '') AS text
    FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT conv_id, conv_id - conv_id % 100 AS base, xor(4294967295, list_reduce([4294967295::BIGINT]
    || list_transform(string_split(conv_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT), lambda a, b: list_reduce([xor(a, b)] || [0::BIGINT, 0, 0, 0, 0, 0, 0, 0],
    lambda p, q: xor(p >> 1, 3988292384 * (p & 1))))) % 6 AS h FROM t GROUP BY conv_id),
r AS (SELECT c.conv_id, 0 AS part, pos, role, text FROM c JOIN t ON t.conv_id = c.base AND pos <= h
    UNION ALL SELECT c.conv_id, 1, pos, role, text FROM c JOIN t ON t.conv_id = c.conv_id AND pos > h),
d AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY part, pos) AS depth, role, text FROM r),
k AS (SELECT conv_id, depth, length(text) AS chars, md5(string_agg(length(role) || ':' || role || length(text) || ':' || text, '')
    OVER (PARTITION BY conv_id ORDER BY depth)) AS node FROM d),
p AS (SELECT conv_id, depth, chars, node, lag(node, 1, 'root') OVER (PARTITION BY conv_id ORDER BY depth) AS above FROM k
    UNION ALL SELECT conv_id, 0, 0, 'root', NULL FROM c),
n AS (SELECT node, depth, above, chars, count(*) AS n_convs, min(conv_id) AS conv_id FROM p GROUP BY ALL),
b AS (SELECT above AS node, count(*) AS n_children FROM n GROUP BY above),
s AS (SELECT a.node, count(*) FILTER (b.node IS NULL) AS n_leaves, sum((n_convs - 1) * n.chars) AS saved_tokens
    FROM n JOIN p a ON a.conv_id = n.conv_id AND a.depth <= n.depth LEFT JOIN b ON b.node = n.node GROUP BY a.node),
e AS (SELECT node, sha256(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id)) AS ends FROM (
    SELECT conv_id, node FROM p QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY depth DESC) = 1) GROUP BY node)
SELECT n.conv_id, n.depth::BIGINT AS depth, o.conv_id AS parent_conv_id, n.n_convs::BIGINT AS n_convs, coalesce(b.n_children, 0)::BIGINT AS n_children,
    s.n_leaves::BIGINT AS n_leaves, s.saved_tokens::BIGINT AS saved_tokens, coalesce(e.ends, sha256('')) AS ends_sha256
FROM n JOIN s ON n.node = s.node LEFT JOIN b ON n.node = b.node LEFT JOIN e ON n.node = e.node LEFT JOIN n o ON n.above = o.node
"""

STATEMENTS = {"op7_line_dedup": OP7, "op8_mixing": OP8, "op9_quotes": OP9, "op11_prefix_trie": OP11, "op12_hard_negatives": OP12, "op13_exact_topk": OP13}
