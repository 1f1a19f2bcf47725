"""SQL of the operators that SQL can express."""

MIXING = r"""
WITH docs AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         md5(coalesce(doc_id::VARCHAR, '') || '|' || coalesce(text, '')) AS turn
  FROM documents
), sizes AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM docs GROUP BY source
), weighed AS (
  SELECT *, 1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS weight FROM sizes
), levels AS (
  SELECT *, (3 * source_size) / weight AS full_at,
    ((SELECT sum(source_size) FROM sizes) - (sum(3 * source_size) OVER up - 3 * source_size))::BIGINT
      / (sum(weight) OVER down)::BIGINT AS level
  FROM weighed
  WINDOW up AS (ORDER BY 3 * source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
         down AS (ORDER BY 3 * source_size / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)
), targets AS (
  SELECT source, source_size,
    least((3 * source_size)::DOUBLE, coalesce((SELECT max(level) FROM levels WHERE full_at > level), 0) * weight) AS target
  FROM levels
), lines AS (
  SELECT source, turn, sum(size)::BIGINT AS size FROM docs GROUP BY source, turn
), queue AS (
  SELECT l.source, l.turn, l.size, r.round, t.target,
    r.round * t.source_size + (sum(l.size) OVER (PARTITION BY l.source, r.round ORDER BY l.turn))::BIGINT AS sent
  FROM lines l JOIN targets t ON l.source IS NOT DISTINCT FROM t.source, (SELECT unnest([0, 1, 2]) AS round) r
  WHERE t.target > 0
), served AS (
  SELECT *, sum(size) OVER (ORDER BY sent / target, source NULLS LAST, round, turn) AS run FROM queue WHERE sent - size < target
), taken AS (
  SELECT source, turn, count(*) AS copies FROM served WHERE run <= (SELECT sum(source_size) FROM sizes) GROUP BY source, turn
)
SELECT d.doc_id, d.size, t.source_size, t.target, (coalesce(k.copies, 0) * d.size)::BIGINT AS taken
FROM docs d
JOIN targets t ON d.source IS NOT DISTINCT FROM t.source
LEFT JOIN taken k ON d.source IS NOT DISTINCT FROM k.source AND d.turn = k.turn
"""

TOP_K = """
WITH ready AS (
  SELECT vec_id, list_transform(embedding, lambda v: floor(v::DOUBLE * 256)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda v: v IS NULL OR NOT isfinite(v))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, x.vec_id, list_dot_product(q.v, x.v)::BIGINT AS score
  FROM ready q JOIN ready x ON q.vec_id <> x.vec_id AND len(q.v) = len(x.v)
  WHERE q.vec_id % 50 = 0
), ranked AS (
  SELECT *, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INTEGER AS rank FROM scored
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
"""

HARD_NEGATIVES = """
WITH ready AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label::BIGINT + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda v: floor(v::DOUBLE * 256)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda v: v IS NULL OR NOT isfinite(v))) = 0
), scored AS (
  SELECT a.vec_id AS anchor_id, x.vec_id, x.label = a.label AS same, list_dot_product(a.v, x.v)::BIGINT AS score
  FROM ready a JOIN ready x ON a.vec_id <> x.vec_id AND len(a.v) = len(x.v)
  WHERE a.vec_id % 100 = 0
), positives AS (
  SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) AS place FROM scored WHERE same
), ranked AS (
  SELECT p.anchor_id, p.vec_id AS positive_id, n.vec_id AS negative_id, p.score AS positive_score, n.score AS negative_score,
         (row_number() OVER (PARTITION BY p.anchor_id, p.vec_id ORDER BY n.score DESC, n.vec_id))::INTEGER AS rank
  FROM positives p JOIN scored n ON n.anchor_id = p.anchor_id AND NOT n.same
  WHERE p.place <= 5 AND 30 * p.score <= 100 * n.score AND 100 * n.score <= 90 * p.score
)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM ranked WHERE rank <= 10
"""

CHAT = r"""
WITH RECURSIVE given AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), turns AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) - 1 AS i,
    len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) + 3 AS cost,
    14 + length(role) + length(text) + length(concat(role, text)) - length(replace(concat(role, text), '\', ''))
      + length(role) - length(replace(role, ':', '')) + (length(text) - length(replace(text, '</turn>', ''))) // 7
      + (length(role) - length(replace(role, '</turn>', ''))) // 7
      + coalesce(list_sum(list_transform(regexp_extract_all(text, '#+'), lambda x: length(x) - 1)), 0)
      + coalesce(list_sum(list_transform(regexp_extract_all(role, '#+'), lambda x: length(x) - 1)), 0) AS size
  FROM given
), summed AS (
  SELECT *, sum(cost) OVER up AS upto, sum(cost) OVER up - cost AS before,
    first_value(role = 'system') OVER up AS opens, first_value(cost) OVER up AS first_cost, first_value(size) OVER up AS first_size
  FROM turns WINDOW up AS (PARTITION BY conv_id ORDER BY i)
), roomy AS (
  SELECT *, opens AND i > 0 AS kept, 1024 - CASE WHEN opens AND i > 0 THEN first_cost ELSE 0 END AS room FROM summed
), reached AS (
  SELECT s.conv_id, s.i, any_value(s.room) AS room, any_value(s.kept) AS kept, any_value(s.first_size) AS first_size,
    min(h.i) AS old, min(h.before) AS old_before
  FROM roomy s JOIN summed h ON h.conv_id = s.conv_id AND (h.i = s.i OR h.i < s.i AND h.i >= CASE WHEN s.opens THEN 1 ELSE 0 END
    AND s.before - h.before <= greatest(0, least(256, s.room - s.cost)))
  GROUP BY s.conv_id, s.i
), spans AS (
  SELECT r.conv_id, r.i, r.kept, r.first_size, r.old, greatest(r.i + 1, max(n.i + 1) FILTER (n.upto - r.old_before <= r.room)) AS stop
  FROM reached r JOIN summed n ON n.conv_id = r.conv_id AND n.i >= r.i
  GROUP BY r.conv_id, r.i, r.kept, r.first_size, r.old
), cuts AS (
  SELECT conv_id, 0::BIGINT AS i FROM turns GROUP BY conv_id
  UNION ALL SELECT s.conv_id, s.stop FROM cuts c JOIN spans s ON s.conv_id = c.conv_id AND s.i = c.i
), written AS (
  SELECT s.conv_id, s.i, CASE WHEN any_value(s.kept) THEN any_value(s.first_size) ELSE 0 END + sum(t.size) AS chars
  FROM cuts c JOIN spans s ON s.conv_id = c.conv_id AND s.i = c.i JOIN turns t ON t.conv_id = s.conv_id AND t.i >= s.old AND t.i < s.stop
  GROUP BY s.conv_id, s.i
)
SELECT t.conv_id, count(*) AS n_turns, sha256(string_agg(concat(role, chr(10), text, chr(10)), '' ORDER BY i)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY i) FILTER (role = 'assistant'), '')) AS loss_sha256,
  any_value(w.chars)::BIGINT AS formatted_chars
FROM turns t JOIN (SELECT conv_id, sum(chars) AS chars FROM written GROUP BY conv_id) w ON w.conv_id = t.conv_id
GROUP BY t.conv_id
"""

TRIE = r"""
WITH placed AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) - 1 AS place,
    md5(concat(length(coalesce(role, '')), ':', role, text)) AS content, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS words
  FROM conversations WHERE conv_id IS NOT NULL
), convs AS (
  -- crc32, bit by bit: complement of the remainder of complemented input
  SELECT conv_id, conv_id - conv_id % 20 AS base, (4294967295 - list_reduce(
    list_prepend(4294967295::BIGINT, list_transform(string_split(conv_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
    lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)), lambda x, i: xor(x >> 1, (x & 1) * 3988292384)))) % 4 AS h
  FROM (SELECT DISTINCT conv_id FROM placed)
), rebuilt AS (
  SELECT c.conv_id, p.place, p.content, p.words FROM convs c JOIN placed p ON p.conv_id = c.base AND p.place < c.h
  UNION ALL SELECT c.conv_id, p.place, p.content, p.words FROM convs c JOIN placed p ON p.conv_id = c.conv_id AND p.place >= c.h
), paths AS (
  SELECT conv_id, row_number() OVER up AS depth, string_agg(content, '') OVER up AS key, words
  FROM rebuilt WINDOW up AS (PARTITION BY conv_id ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
  UNION ALL SELECT conv_id, 0, '', 0 FROM convs
), nodes AS (
  SELECT key, any_value(depth) AS depth, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(words) AS words,
    substr(key, 1, greatest(any_value(depth) - 1, 0) * 32) AS parent
  FROM paths GROUP BY key
), children AS (
  SELECT parent, count(*) AS n FROM nodes WHERE depth > 0 GROUP BY parent
), subtrees AS (
  SELECT u.key, count(*) FILTER (c.n IS NULL) AS n_leaves, sum((v.n_convs - 1) * v.words)::BIGINT AS saved_tokens
  FROM nodes u JOIN nodes v ON starts_with(v.key, u.key) LEFT JOIN children c ON c.parent = v.key GROUP BY u.key
), ends AS (
  SELECT key, string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) AS ids FROM (SELECT conv_id, arg_max(key, depth) AS key FROM paths GROUP BY conv_id) GROUP BY key
)
SELECT n.conv_id, n.depth, p.conv_id AS parent_conv_id, n.n_convs, coalesce(c.n, 0) AS n_children, s.n_leaves, s.saved_tokens,
  sha256(coalesce(e.ids, '')) AS ends_sha256
FROM nodes n JOIN subtrees s ON s.key = n.key LEFT JOIN nodes p ON p.key = n.parent AND n.depth > 0
LEFT JOIN children c ON c.parent = n.key LEFT JOIN ends e ON e.key = n.key
"""

SQL = {"op1_source_mixing": MIXING, "op10_exact_top_k": TOP_K, "op11_hard_negatives": HARD_NEGATIVES, "op12_chat_formatting": CHAT, "op13_prefix_trie": TRIE}
