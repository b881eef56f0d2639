"""DuckDB SQL of the queries that SQL can express."""

from riskloom.llm.quality import STOP_WORDS

URL_FILTERS = r"""
WITH p AS (
  SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), s AS (
  SELECT page_id,
         translate(regexp_extract(coalesce(rest, ''), '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(coalesce(rest, ''), '^[^/?#]*([^?#]*)', 1) AS path
  FROM p
), r(rhost, rpath, verdict) AS (
  VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'),
         ('net', '/es/', 'block'), ('net', '/fr/', 'block')
), f AS (
  SELECT s.*, r.rhost || r.rpath AS rule, r.verdict,
         row_number() OVER (PARTITION BY page_id, host, path ORDER BY length(r.rhost || r.rpath) DESC NULLS LAST) AS k
  FROM s LEFT JOIN r ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath)
)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM f WHERE k = 1
"""

CHAT_FORMATTING = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), c AS (
  SELECT conv_id, count(*) AS n_turns,
         string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS told,
         coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn, role, text), '') AS loss,
         -- each of \, < and # takes one character more; a turn's frame takes 14
         sum(14 + length(role) + length(text) + length(regexp_replace(text, '[^\\<#]', '', 'g'))) AS formatted_chars
  FROM t GROUP BY conv_id
)
SELECT conv_id, n_turns, sha256(told) AS turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256,
       CAST(formatted_chars AS BIGINT) AS formatted_chars
FROM c
"""

QUALITY_RULES = r"""
WITH d AS (
  SELECT row_number() OVER () AS k, doc_id, coalesce(text, '') AS text FROM documents
), w AS (
  SELECT k, doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words,
         list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM d
), g AS (
  SELECT k, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] AS gram
  FROM (SELECT k, words, unnest(generate_series(1, len(words) - 2)) AS i FROM w WHERE len(words) >= 3)
), h AS (
  SELECT k, i FROM (SELECT k, i, count(*) OVER (PARTITION BY k, gram) AS c FROM g) WHERE c > 1
), r AS (
  SELECT k, count(DISTINCT p) AS n FROM (SELECT k, unnest([i, i + 1, i + 2]) AS p FROM h) GROUP BY k
), m AS (
  SELECT doc_id, len(words) AS n_words, length(array_to_string(words, '')) AS word_chars,
         length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
         len(lines) AS n_lines, len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(r.n, 0) AS n_repeat_words,
         len(list_intersect(string_split(lower(array_to_string(words, ' ')), ' '), [STOPS])) AS n_stop_words,
         len(list_filter(lines, lambda x: regexp_matches(x, '(\.\.\.|…)[\x20\x09-\x0D]*$'))) AS n_ellipsis_lines
  FROM w LEFT JOIN r USING (k)
), b AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m
)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols,
       CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed,
       NOT base_failed AND word_chars >= 2 * n_words AND word_chars <= 12 * n_words AND 100 * n_symbols <= 20 * n_words
         AND n_stop_words >= 1 AND 100 * n_dup_lines <= 50 * n_lines AND 100 * n_ellipsis_lines <= 50 * n_lines AS kept
FROM b
""".replace("STOPS", ", ".join(f"'{w}'" for w in STOP_WORDS))

SUBSTRING_DEDUP = r"""
WITH w AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents
), g AS (
  SELECT doc_id, i, array_to_string(words[i:i + 12], ' ') AS gram
  FROM (SELECT doc_id, words, unnest(generate_series(1, len(words) - 12)) AS i FROM w WHERE len(words) >= 13)
), h AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY gram) AS first FROM g) WHERE doc_id > first
), c AS (
  SELECT DISTINCT doc_id, p FROM (SELECT doc_id, unnest(generate_series(i, i + 12)) AS p FROM h)
), x AS (
  SELECT w.doc_id, p AS i, words[p] AS word FROM (SELECT doc_id, words, unnest(generate_series(1, len(words))) AS p FROM w) w
), k AS (
  SELECT x.doc_id, string_agg(word, ' ' ORDER BY i) AS kept, count(*) AS n FROM x ANTI JOIN c ON x.doc_id = c.doc_id AND x.i = c.p GROUP BY 1
)
SELECT w.doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(len(words) - coalesce(k.n, 0) AS BIGINT) AS n_removed,
       sha256(coalesce(k.kept, '')) AS kept_sha256
FROM w LEFT JOIN k USING (doc_id)
"""

_TERMS = r"""unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
  '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term"""
RANKED_SEARCH = f"""
WITH dt AS (SELECT doc_id, {_TERMS} FROM documents),
tf AS (SELECT doc_id, term, count(*) AS tf FROM dt GROUP BY ALL),
dl AS (SELECT doc_id, count(*) AS n FROM dt GROUP BY doc_id),
st AS (SELECT CAST(count(*) AS BIGINT) AS big_n, CAST(sum(n) AS BIGINT) AS big_l FROM dl),
it AS (SELECT DISTINCT item_id, {_TERMS} FROM benchmark),
w AS (SELECT term, CAST(floor(1000 * ln((2 * big_n + 2) / (2 * df + 1))) AS BIGINT) AS w FROM (SELECT term, count(*) AS df FROM tf GROUP BY term), st),
m AS (SELECT doc_id, 100 - 90 + (90 * n * big_n) // big_l AS m FROM dl, st),
s AS (SELECT item_id, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * m))) AS BIGINT) AS score
  FROM it JOIN w USING (term) JOIN tf USING (term) JOIN m USING (doc_id) GROUP BY ALL),
r AS (SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score
  FROM s WHERE score > 0)
SELECT * FROM r WHERE rank <= 10
"""

# crc32 of a short ASCII text: the polynomial's division, bit by bit.
_CRC = """xor(list_reduce(list_concat([4294967295::BIGINT], [ascii(c)::BIGINT FOR c IN string_split({0}, '')]),
  lambda s, b: list_reduce(list_concat([xor(s, b)], range(8)), lambda x, i: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384::BIGINT) ELSE x >> 1 END)), 4294967295::BIGINT)"""
CONVERSATION_REPAIR = rf"""
WITH RECURSIVE given AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         {_CRC.format("coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ')")} % 20 AS draw
  FROM conversations
), damaged AS (
  SELECT conv_id, turn, CASE WHEN draw = 4 THEN 'user' ELSE role END AS role,
         CASE WHEN draw = 1 THEN '' WHEN draw = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM given JOIN (VALUES (0), (1)) v(again) ON again = 0 OR draw = 3 WHERE draw <> 0
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text)) AS i FROM damaged
), r AS (
  SELECT conv_id, turn, role, text, i, substr(role, 1, 1) AS initial,
         CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'blank'
              WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'duplicate'
              WHEN right(regexp_replace(text, '[\x20\x09-\x0D]+$', ''), 1) NOT IN ('.', '!', '?') THEN 'truncated' END AS fault,
         substr(lag(role) OVER (PARTITION BY conv_id ORDER BY i), 1, 1) || substr(role, 1, 1) AS pair
  FROM placed
), ins(st, st1, ops, added) AS (
  VALUES (0, 0, '', ''), (1, 1, '', ''), (2, 2, '', ''), (3, 3, '', ''),
         (0, 2, 'I', chr(10) || 'user:'), (1, 2, 'I', chr(10) || 'user:'), (2, 3, 'I', chr(10) || 'assistant:'), (3, 2, 'I', chr(10) || 'user:'),
         (0, 3, 'II', chr(10) || 'user:' || chr(10) || 'assistant:'), (1, 3, 'II', chr(10) || 'user:' || chr(10) || 'assistant:'),
         (2, 2, 'II', chr(10) || 'assistant:' || chr(10) || 'user:'), (3, 3, 'II', chr(10) || 'user:' || chr(10) || 'assistant:')
), edit(op, st1, initial, st2, price, role) AS (
  VALUES ('D', 0, NULL, 0, 3, NULL), ('D', 1, NULL, 1, 3, NULL), ('D', 2, NULL, 2, 3, NULL), ('D', 3, NULL, 3, 3, NULL),
         ('K', 0, 's', 1, 0, NULL), ('K', 0, 'u', 2, 0, NULL), ('K', 1, 'u', 2, 0, NULL), ('K', 2, 'a', 3, 0, NULL), ('K', 3, 'u', 2, 0, NULL),
         ('R', 0, NULL, 2, 2, 'user'), ('R', 1, NULL, 2, 2, 'user'), ('R', 2, NULL, 3, 2, 'assistant'), ('R', 3, NULL, 2, 2, 'user')
), path AS (
  SELECT DISTINCT conv_id, CAST(0 AS BIGINT) AS i, 0 AS st, CAST(0 AS BIGINT) AS cost, '' AS audit, '' AS lines FROM conversations
  UNION ALL
  SELECT conv_id, i, st, cost, audit, lines FROM (
    SELECT p.conv_id, r.i, e.st2 AS st, p.cost + 2 * length(ins.ops) + e.price + CASE WHEN e.op <> 'D' AND r.fault = 'truncated' THEN 1 ELSE 0 END AS cost,
           p.audit || ins.ops || e.op AS audit,
           p.lines || ins.added || CASE WHEN e.op = 'D' THEN '' ELSE chr(10) || coalesce(e.role, r.role) || ':' || r.text END AS lines,
           row_number() OVER (PARTITION BY p.conv_id, e.st2 ORDER BY p.cost + 2 * length(ins.ops) + e.price + CASE WHEN e.op <> 'D' AND r.fault = 'truncated' THEN 1 ELSE 0 END,
                              p.audit || ins.ops || e.op) AS k
    FROM path p JOIN ins USING (st) JOIN r ON r.conv_id = p.conv_id AND r.i = p.i + 1
    JOIN edit e ON e.st1 = ins.st1 AND (e.initial IS NULL OR e.initial = r.initial) AND (e.op = 'D' OR coalesce(r.fault, '') NOT IN ('blank', 'duplicate'))
  ) z WHERE k = 1
), counts AS (
  SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
         count(*) FILTER (WHERE fault = 'blank') AS blank, count(*) FILTER (WHERE fault = 'duplicate') AS duplicate,
         count(*) FILTER (WHERE fault = 'truncated') AS truncated, count(*) FILTER (WHERE pair NOT IN ('su', 'ua', 'au')) AS illegal
  FROM r GROUP BY conv_id
), best AS (
  SELECT * FROM (
    SELECT p.conv_id, p.cost + 2 * length(ins.ops) AS cost, p.audit || ins.ops AS audit, p.lines || ins.added AS lines,
           row_number() OVER (PARTITION BY p.conv_id ORDER BY p.cost + 2 * length(ins.ops), p.audit || ins.ops) AS k
    FROM path p JOIN ins USING (st) LEFT JOIN counts c ON c.conv_id = p.conv_id
    WHERE p.i = coalesce(c.n, 0) AND ins.st1 IN (0, 3)) z WHERE k = 1
)
SELECT b.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, CAST(coalesce(blank, 0) AS BIGINT) AS blank, CAST(coalesce(duplicate, 0) AS BIGINT) AS duplicate,
       CAST(coalesce(truncated, 0) AS BIGINT) AS truncated, CAST(coalesce(illegal, 0) AS BIGINT) AS illegal, CAST(cost AS BIGINT) AS cost, audit,
       sha256(substr(lines, 2)) AS repaired_sha256
FROM best b LEFT JOIN counts USING (conv_id)
"""
