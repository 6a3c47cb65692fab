"""DuckDB SQL for the queries that SQL can express."""

OP2 = r"""
WITH lines AS (
  SELECT doc_id, rid, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM (SELECT *, row_number() OVER () AS rid FROM documents)
), keyed AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM lines
), repeated AS (
  SELECT key, min(doc_id) AS owner FROM keyed WHERE length(key) >= 10
  GROUP BY key HAVING count(DISTINCT doc_id) >= 2
), marked AS (
  SELECT k.*, coalesce(r.owner <> k.doc_id, false) AS gone FROM keyed k LEFT JOIN repeated r USING (key)
)
SELECT doc_id, count(*) AS n_lines, CAST(count(*) FILTER (WHERE gone) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY rid, doc_id
"""

#: Links by counting shared shingles; components by recursion over the links.
OP6 = r"""
WITH RECURSIVE tokens AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''),
         'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM documents
), sets AS (
  SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [w]
         ELSE list_transform(range(1, len(w) - 2), lambda i: w[i : i + 3]) END) AS s
  FROM tokens
), items AS (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM sets),
links AS (
  SELECT a.doc_id AS u, b.doc_id AS v FROM items a JOIN items b ON a.x = b.x AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))
), reach AS (
  SELECT doc_id AS u, doc_id AS v FROM sets
  UNION
  SELECT r.u, l.v FROM reach r JOIN links l ON r.v = l.u
), found AS (SELECT u AS doc_id, min(v) AS component_id FROM reach GROUP BY u)
SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles, component_id, doc_id = component_id AS kept
FROM sets JOIN found USING (doc_id)
"""

#: SHA-1 comes from the queries' own digest only in hex here, so base32 is spelled out over its bits.
OP5 = r"""
WITH p AS (
  SELECT page_id, coalesce(html, '') AS html, octet_length(encode(coalesce(html, ''))) AS n FROM pages
), first AS (SELECT html, min(page_id) AS owner FROM p GROUP BY html),
bits AS (
  SELECT *, list_aggregate(list_transform(range(1, 41), lambda i:
           lpad(bin(CAST(('0x' || substr(sha1(html), CAST(i AS INT), 1)) AS INT)), 4, '0')), 'string_agg', '') AS b
  FROM p
)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes,
       list_aggregate(list_transform(range(0, 32), lambda j: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST(
         16 * CAST(substr(b, CAST(5 * j + 1 AS INT), 1) AS INT) + 8 * CAST(substr(b, CAST(5 * j + 2 AS INT), 1) AS INT)
         + 4 * CAST(substr(b, CAST(5 * j + 3 AS INT), 1) AS INT) + 2 * CAST(substr(b, CAST(5 * j + 4 AS INT), 1) AS INT)
         + CAST(substr(b, CAST(5 * j + 5 AS INT), 1) AS INT) AS INT), 1)), 'string_agg', '') AS payload_digest,
       CASE WHEN page_id = owner THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> owner THEN owner END AS refers_to
FROM bits JOIN first USING (html)
"""

#: What reading back must give: every turn and every assistant text unchanged.
OP10 = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '\### Assistant: </turn> ok'), (-7, 1, 'assistant', '\### Assistant: </turn> ok')
), spelled AS (
  SELECT *, regexp_replace(replace(text, '\', '\\'), '(<)(/?turn)', '\\\1\2', 'g') AS body FROM turns
)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(length('<turn>') + length(role) + 1 + length(body) + length('</turn>') + 1) AS BIGINT) AS formatted_chars
FROM spelled GROUP BY conv_id
"""

#: Rows with equal id and text are told apart by a number only.
OP11 = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
sized AS (
  SELECT doc_id, text, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, row_number() OVER (PARTITION BY text, doc_id) AS copy
  FROM d WINDOW w AS (PARTITION BY text)
)
SELECT doc_id, keep_id, group_size, copy = 1 AND doc_id IS NOT DISTINCT FROM keep_id AS kept, sha256(text) AS text_sha256 FROM sized
"""

#: The CRC is spelled out over its table; letters beyond ASCII become single bytes, as levenshtein counts bytes.
OP12 = r"""
WITH RECURSIVE crc_table AS (
  SELECT list(v ORDER BY i) AS t FROM (
    SELECT i, list_reduce(range(0, 8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(CAST(3988292384 AS BIGINT), c >> 1) ELSE c >> 1 END, CAST(i AS BIGINT)) AS v
    FROM range(0, 256) r(i))
), letters AS (
  SELECT string_agg(chr(CAST(192 + i AS INT)), '' ORDER BY i) AS wide, string_agg(chr(CAST(33 + i AS INT)), '' ORDER BY i) AS narrow FROM range(0, 64) r(i)
), runs AS (
  SELECT doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-z\x{00C0}-\x{00FF}]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run
  FROM documents
), counted AS (SELECT doc_id, run, count(*) AS n FROM runs WHERE length(run) >= 6 GROUP BY ALL),
hashed AS (
  SELECT run, n, xor(CAST(4294967295 AS BIGINT), list_reduce(
    flatten(list_transform(string_split(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run, ''), lambda ch: CASE WHEN unicode(ch) < 128 THEN [CAST(unicode(ch) AS BIGINT)]
            ELSE [CAST(192 + (unicode(ch) >> 6) AS BIGINT), CAST(128 + (unicode(ch) & 63) AS BIGINT)] END)),
    lambda c, b: xor(t[CAST(xor(c, b) & 255 AS INT) + 1], c >> 8), CAST(4294967295 AS BIGINT))) AS h
  FROM counted, crc_table
), spelled AS (
  SELECT n, CASE WHEN h % 199 = 0 THEN substr(run, 1, CAST(h % length(run) AS INT)) || substr(run, CAST(h % length(run) AS INT) + 2) ELSE run END AS word FROM hashed
), words AS (
  SELECT word, CAST(sum(n) AS BIGINT) AS n, translate(word, any_value(wide), any_value(narrow)) AS code
  FROM spelled, letters WHERE length(word) >= 6 GROUP BY word HAVING sum(n) >= 5
), near AS (
  SELECT a.word, a.n, b.word AS other, b.n AS other_n FROM words a JOIN words b
  ON abs(length(a.code) - length(b.code)) <= 1 AND a.code <> b.code AND levenshtein(a.code, b.code) = 1
), best AS (
  SELECT word, count(*) AS n_near, arg_min(other, (-other_n, encode(other))) AS other, max(other_n) AS other_n FROM near GROUP BY word
), forms AS (
  SELECT word, n, coalesce(n_near, 0) AS n_near, CASE WHEN other_n >= 5 * n THEN other END AS form, CASE WHEN other_n >= 5 * n THEN other_n END AS form_n
  FROM words LEFT JOIN best USING (word)
), chain AS (
  SELECT word, word AS at FROM forms
  UNION ALL
  SELECT c.word, f.form FROM chain c JOIN forms f ON f.word = c.at WHERE f.form IS NOT NULL
)
SELECT f.word, f.form, c.at AS root, f.n, f.n_near, f.form_n
FROM forms f JOIN chain c USING (word) JOIN forms l ON l.word = c.at WHERE l.form IS NULL
"""

OP13 = """
WITH q AS (
  SELECT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT a.id AS anchor, a.label AS own, b.id, b.label, CAST(list_sum(list_transform(range(1, len(a.v) + 1), lambda i: a.v[i] * b.v[i])) AS BIGINT) AS score
  FROM q a JOIN q b ON a.id % 50 = 0 AND a.id <> b.id AND len(a.v) = len(b.v)
), positives AS (
  SELECT anchor, id, score FROM scored WHERE label = own QUALIFY row_number() OVER (PARTITION BY anchor ORDER BY score DESC, id) <= 5
), inside AS (
  SELECT p.anchor, p.id AS positive, p.score AS ps, s.id, s.score, row_number() OVER (PARTITION BY p.anchor, p.id ORDER BY s.score DESC, s.id) AS r
  FROM positives p JOIN scored s ON s.anchor = p.anchor AND s.label <> s.own AND 50 * p.score <= 100 * s.score AND 100 * s.score <= 95 * p.score
)
SELECT anchor AS anchor_id, positive AS positive_id, CAST(r AS INT) AS rank, id AS negative_id, ps AS positive_score, score AS negative_score FROM inside WHERE r <= 3
"""

ORACLES = {"op5_warc": OP5, "op10_chat": OP10, "op2_line_dedup": OP2, "op6_near_dedup": OP6, "op11_exact_dedup": OP11, "op12_spelling": OP12, "op13_hard_negatives": OP13}
