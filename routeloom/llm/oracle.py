"""DuckDB SQL for the operators that SQL can express: n-gram join, repeated strings, quality rules, chat formatting, prefix trie."""

from __future__ import annotations

from routeloom.llm import quality_rules as q

WORD = r"[^\x20\x09-\x0D]+"

NGRAM_JOIN = rf"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{WORD}') AS w FROM documents
), placed AS (
  SELECT doc_id, len(w) AS n, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM words WHERE len(w) > 0
), runs AS (
  SELECT doc_id, n, i, word AS a, lead(word, 1) OVER d AS b, lead(word, 2) OVER d AS c, lead(word, 3) OVER d AS e
  FROM placed WINDOW d AS (PARTITION BY doc_id ORDER BY i)
), shingles AS (
  SELECT DISTINCT doc_id, concat_ws(' ', a, b, c, e) AS s FROM runs WHERE i <= greatest(n - 3, 1)
), sizes AS (
  SELECT doc_id, count(*) AS k FROM shingles GROUP BY doc_id
), shared AS (
  SELECT x.doc_id AS p, y.doc_id AS r, count(*) AS n FROM shingles x JOIN shingles y ON x.s = y.s AND x.doc_id < y.doc_id GROUP BY ALL
), links AS (
  SELECT p, r FROM shared JOIN sizes a ON a.doc_id = p JOIN sizes b ON b.doc_id = r WHERE 100 * n >= 85 * (a.k + b.k - n)
), ways AS (
  SELECT p, r FROM links UNION ALL SELECT r, p FROM links
), reach AS (
  SELECT doc_id AS p, doc_id AS r FROM documents UNION SELECT reach.p, ways.r FROM reach JOIN ways ON ways.p = reach.r
)
SELECT d.doc_id, coalesce(any_value(k), 0) AS n_shingles, min(r) AS component_id
FROM documents d LEFT JOIN sizes s ON s.doc_id = d.doc_id JOIN reach ON reach.p = d.doc_id GROUP BY d.doc_id
"""

# hexadecimal digits stand for bytes; texts are cut into overlapping pieces so that no window is sought in a long string
REPEATED_STRINGS = """
WITH bytes AS (
  SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents
), pieces AS (
  SELECT doc_id, len(h) // 2 AS n, c, substring(h, 2000 * c + 1, 2398) AS piece FROM bytes, LATERAL (SELECT unnest(range(len(h) // 2000 + 1)) AS c)
), windows AS (
  SELECT doc_id, 1000 * c + o AS pos, md5(substring(piece, 2 * o + 1, 400)) AS s FROM pieces, LATERAL (SELECT unnest(range(least(1000, n - 199 - 1000 * c))) AS o)
), hits AS (
  SELECT doc_id, pos FROM windows QUALIFY count(*) OVER (PARTITION BY s) > 1
), marks AS (
  SELECT doc_id, pos, CASE WHEN pos - lag(pos) OVER (PARTITION BY doc_id ORDER BY pos) <= 200 THEN 0 ELSE 1 END AS fresh FROM hits
), runs AS (
  SELECT doc_id, pos, sum(fresh) OVER (PARTITION BY doc_id ORDER BY pos) AS run FROM marks
), spans AS (
  SELECT doc_id, min(pos) AS lo, max(pos) + 200 AS hi FROM runs GROUP BY doc_id, run
), edges AS (
  SELECT doc_id, lo, hi FROM spans UNION ALL SELECT doc_id, len(h) // 2, len(h) // 2 FROM bytes
), gaps AS (
  SELECT doc_id, lo, hi, coalesce(lag(hi) OVER (PARTITION BY doc_id ORDER BY lo, hi), 0) AS since FROM edges
), kept AS (
  SELECT doc_id, string_agg(substring(h, 2 * since + 1, 2 * (lo - since)), '' ORDER BY lo, hi) AS k, sum(hi - lo) AS gone, count(*) - 1 AS n
  FROM gaps JOIN bytes USING (doc_id) GROUP BY doc_id
)
SELECT doc_id, len(h) // 2 AS n_bytes, CAST(gone AS BIGINT) AS n_removed, n AS n_spans, sha256(unhex(k)) AS kept_sha256 FROM kept JOIN bytes USING (doc_id)
"""

# the longest repeat is over its limit exactly where a string of the least number of words over it occurs twice
QUALITY_RULES = rf"""
WITH texts AS (
  SELECT doc_id, coalesce(text, '') AS t FROM documents
), lines AS (
  SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM texts
), dups AS (
  SELECT doc_id, count(*) - count(DISTINCT line) AS n_dup_lines FROM lines WHERE regexp_matches(line, '{WORD}') GROUP BY doc_id
), words AS (
  SELECT doc_id, regexp_extract_all(t, '{WORD}') AS w FROM texts
), placed AS (
  SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM words
), eights AS (
  SELECT doc_id, i, word, CASE WHEN lead(word, 7) OVER d IS NOT NULL THEN concat_ws(' ', word, lead(word, 1) OVER d, lead(word, 2) OVER d, lead(word, 3) OVER d,
    lead(word, 4) OVER d, lead(word, 5) OVER d, lead(word, 6) OVER d, lead(word, 7) OVER d) END AS s,
    sum(length(word) + 1) OVER d - length(word) AS from_char
  FROM placed WINDOW d AS (PARTITION BY doc_id ORDER BY i)
), twice AS (
  SELECT doc_id, i, word, from_char, CASE WHEN s IS NOT NULL AND count(*) OVER (PARTITION BY doc_id, s) > 1 THEN 1 ELSE 0 END AS hit FROM eights
), covered AS (
  SELECT *, max(hit) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 7 PRECEDING AND CURRENT ROW) AS inside FROM twice
), counts AS (
  SELECT doc_id, count(*) AS n_words, sum(length(word)) AS word_chars, sum(inside) AS n_repeat_words, sum(length(word) * inside) AS cover_chars FROM covered GROUP BY doc_id
), joined AS (
  SELECT doc_id, array_to_string(w, ' ') AS line, len(w) AS n, greatest({q.LONGEST_WORDS}, CAST(floor(len(w) * {round(q.LONGEST_FRACTION * 100)} / 100) AS BIGINT) + 1) AS least FROM words
), long AS (
  SELECT a.doc_id, md5(substring(line, CAST(a.from_char AS BIGINT), CAST(b.from_char + length(b.word) - a.from_char AS BIGINT))) AS s
  FROM covered a JOIN joined j ON j.doc_id = a.doc_id JOIN covered b ON b.doc_id = a.doc_id AND b.i = a.i + j.least - 1 WHERE a.hit = 1
), over AS (
  SELECT DISTINCT doc_id FROM (SELECT doc_id FROM long GROUP BY doc_id, s HAVING count(*) > 1)
), facts AS (
  SELECT t.doc_id, coalesce(n_words, 0) AS n_words, CAST(coalesce(word_chars, 0) AS BIGINT) AS word_chars, CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    coalesce(n_dup_lines, 0) AS n_dup_lines, CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words,
    CAST(coalesce(cover_chars, 0) AS DOUBLE) / CAST(greatest(coalesce(word_chars, 0), 1) AS DOUBLE) AS repeat_fraction, over.doc_id IS NOT NULL AS too_long
  FROM texts t LEFT JOIN dups ON dups.doc_id = t.doc_id LEFT JOIN counts ON counts.doc_id = t.doc_id LEFT JOIN over ON over.doc_id = t.doc_id
), base AS (
  SELECT *, n_words < {q.BASE_MIN_WORDS} OR 100 * n_repeat_words > {q.BASE_REPEAT_PERCENT} * n_words AS base_failed FROM facts
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND repeat_fraction <= {q.MAX_FRACTION} AND NOT too_long AS kept, repeat_fraction FROM base
"""

# a text or role is escaped where it holds a control string; each then takes one backslash more
CHAT_FORMAT = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), rendered AS (
  SELECT *, regexp_replace(text, '(<s>|</s>|\[INST\]|\[/INST\]|<<SYS>>|<</SYS>>|<\||\|>)', '\\\1', 'g') AS said,
    regexp_replace(role, '(<s>|</s>|\[INST\]|\[/INST\]|<<SYS>>|<</SYS>>|<\||\|>)', '\\\1', 'g') AS named FROM turns
), framed AS (
  SELECT *, CASE role WHEN 'user' THEN '[INST] ' || said || ' [/INST]' WHEN 'assistant' THEN ' ' || said || ' </s>' WHEN 'system' THEN '<<SYS>> ' || said || ' <</SYS>>'
    ELSE '<| ' || named || ' |> ' || said || ' </s>' END AS segment FROM rendered
)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, segment)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, segment) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(3 + sum(length(segment)) AS BIGINT) AS formatted_chars
FROM framed GROUP BY conv_id
"""

# crc32 bit by bit over the digits of the id; a prefix is named by the list of its turns' digests
PREFIX_TRIE = """
WITH own AS (
  SELECT conv_id, length(coalesce(text, '')) AS n, md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS m,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS pos FROM conversations WHERE conv_id IS NOT NULL
), ids AS (
  SELECT conv_id, conv_id - conv_id % 100 AS base, xor(list_reduce(list_concat([CAST(4294967295 AS BIGINT)], flatten(list_transform(string_split(CAST(conv_id AS VARCHAR), ''),
    lambda x: list_concat([CAST(ascii(x) AS BIGINT)], [CAST(0 AS BIGINT), 0, 0, 0, 0, 0, 0])))), lambda c, v: xor(xor(c, v) >> 1, 3988292384 * (xor(c, v) & 1))), 4294967295) % 6 AS h
  FROM (SELECT DISTINCT conv_id FROM own)
), rebuilt AS (
  SELECT i.conv_id, 0 AS part, o.pos, o.n, o.m FROM ids i JOIN own o ON o.conv_id = i.base AND o.pos <= i.h
  UNION ALL SELECT o.conv_id, 1, o.pos, o.n, o.m FROM own o JOIN ids i ON i.conv_id = o.conv_id WHERE o.pos > i.h
), placed AS (
  SELECT conv_id, n, row_number() OVER (PARTITION BY conv_id ORDER BY part, pos) AS d, list(m) OVER (PARTITION BY conv_id ORDER BY part, pos ROWS UNBOUNDED PRECEDING) AS path FROM rebuilt
), members AS (
  SELECT conv_id, n, d, array_to_string(path, ',') AS key, CASE WHEN d > 1 THEN array_to_string(path[1:d - 1], ',') ELSE '' END AS up, path FROM placed
  UNION ALL SELECT conv_id, 0, 0, '', NULL, [] FROM ids
), closed AS (
  SELECT *, d = max(d) OVER (PARTITION BY conv_id) AS last FROM members
), nodes AS (
  SELECT key, any_value(up) AS up, any_value(path) AS path, d AS depth, min(conv_id) AS conv_id, count(*) AS n_convs, max(n) AS n,
    sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE last), '')) AS ends_sha256 FROM closed GROUP BY key, d
), kids AS (
  SELECT up, count(*) AS n_children FROM nodes WHERE depth > 0 GROUP BY up
), full_nodes AS (
  SELECT x.*, p.conv_id AS parent_conv_id, coalesce(k.n_children, 0) AS n_children FROM nodes x LEFT JOIN nodes p ON p.key = x.up AND x.depth > 0 LEFT JOIN kids k ON k.up = x.key
), above AS (
  SELECT array_to_string(path[1:k], ',') AS key, k AS depth, n_children, (n_convs - 1) * n AS saved FROM (SELECT *, unnest(range(depth + 1)) AS k FROM full_nodes)
), below AS (
  SELECT key, depth, CAST(sum(CASE WHEN n_children = 0 THEN 1 ELSE 0 END) AS BIGINT) AS n_leaves, CAST(sum(saved) AS BIGINT) AS saved_tokens FROM above GROUP BY key, depth
)
SELECT conv_id, f.depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256 FROM full_nodes f JOIN below b ON b.key = f.key AND b.depth = f.depth
"""
