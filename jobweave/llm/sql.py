"""SQL twins of the operators that SQL can express on whole tables."""

WORD = r"[^\x20\x09-\x0D]+"

OP2 = """
WITH d AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256
FROM d
"""

OP6 = """
WITH replies AS (
 SELECT conv_id, CASE WHEN conv_id & 2 <> 0 THEN min(turn) ELSE max(turn) END AS at
 FROM conversations WHERE role = 'assistant' GROUP BY conv_id),
said AS (SELECT r.conv_id, r.at, max(c.text) AS reply FROM replies r JOIN conversations c ON c.conv_id = r.conv_id AND c.turn = r.at AND c.role = 'assistant' GROUP BY ALL),
t AS (
 SELECT c.conv_id AS pair_id, c.turn, c.role, c.text, coalesce(c.turn = o.at AND c.role = 'assistant', FALSE) AS is_reply,
        p.conv_id IS NOT NULL AS has_reply, p.reply
 FROM conversations c LEFT JOIN said o ON c.conv_id = o.conv_id LEFT JOIN said p ON p.conv_id = xor(c.conv_id, 1)),
sides AS (
 SELECT pair_id, turn, role, text, 'chosen' AS side FROM t
 UNION ALL SELECT pair_id, turn, role, CASE WHEN is_reply THEN reply ELSE text END, 'rejected' FROM t WHERE NOT is_reply OR has_reply),
per AS (
 SELECT pair_id, turn, list_sort(list({'role': role, 'text': text}) FILTER (side = 'chosen')) AS c, list_sort(list({'role': role, 'text': text}) FILTER (side = 'rejected')) AS r
 FROM sides GROUP BY ALL),
firsts AS (SELECT pair_id, min(turn) FILTER (c IS DISTINCT FROM r) AS f FROM per GROUP BY pair_id)
SELECT s.pair_id, CASE WHEN f IS NULL OR turn < f THEN 'prompt' ELSE side END AS side, turn, role,
       '<|' || coalesce(role, '') || '|>' || chr(10) || coalesce(text, '') || chr(10) AS rendered,
       f IS NOT NULL AND turn >= f AND coalesce(role = 'assistant', FALSE) AS in_loss, f IS NULL AS tie
FROM sides s JOIN firsts ON s.pair_id IS NOT DISTINCT FROM firsts.pair_id
WHERE side = 'chosen' OR (f IS NOT NULL AND turn >= f)
"""

OP8 = rf"""
WITH d AS (
 SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '{WORD}')) AS BIGINT) AS size, md5(coalesce(text, '')) AS h FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, (row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 + 1 AS weight, CAST(3 * source_size AS DOUBLE) AS cap FROM s),
r AS (
 SELECT *, 1.0::DOUBLE * sum(source_size) OVER () AS total,
        coalesce(sum(cap) OVER (ORDER BY cap / weight, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0) AS used,
        CAST(sum(weight) OVER (ORDER BY cap / weight, source IS NULL, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS DOUBLE) AS left_weight
 FROM w),
l AS (SELECT *, (total - used) / left_weight AS level FROM r),
chosen AS (SELECT min({{'at': cap / weight, 'level': level}}) FILTER (level * weight <= cap) AS c FROM l),
t AS (SELECT source, source_size, CASE WHEN c IS NULL THEN cap ELSE least(cap, c.level * weight) END AS target FROM l, chosen),
e AS (
 SELECT d.*, source_size, target, CASE WHEN source_size > 0 THEN target / source_size ELSE 0.0 END AS copies,
        (CAST('0x' || substr(md5('0|' || coalesce(CAST(doc_id AS VARCHAR), 'null') || '|' || h), 1, 13) AS BIGINT) + 0.5) / 4503599627370496.0::DOUBLE AS u
 FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
p AS (SELECT *, CAST(floor(copies) AS BIGINT) AS whole, copies - floor(copies) AS p FROM e),
o AS (SELECT *, CASE WHEN p > 0 THEN (u / (1 - u)) / (p / (1 - p)) END AS q FROM p),
g AS (SELECT source, round(sum(p * size), 6) AS goal FROM o GROUP BY source),
c AS (
 SELECT o.*, goal, sum(size) OVER (PARTITION BY o.source, q IS NULL ORDER BY q, doc_id, h ROWS UNBOUNDED PRECEDING) AS upto
 FROM o JOIN g ON o.source IS NOT DISTINCT FROM g.source)
SELECT doc_id, size, source_size, target,
       CAST((whole + CASE WHEN q IS NOT NULL AND upto - size / 2.0::DOUBLE <= goal THEN 1 ELSE 0 END) * size AS BIGINT) AS taken
FROM c
"""

OP9 = r"""
WITH rules(h, p, action) AS (VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'),
                                    ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
u AS (
 SELECT page_id, row_number() OVER () AS n,
        translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
        coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path
 FROM pages),
m AS (
 SELECT n, first({'rule': h || p, 'action': action} ORDER BY length(h || p) DESC, length(h) DESC) AS b
 FROM u JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY n)
SELECT page_id, host, path, b.rule AS rule, coalesce(b.action, 'allow') AS verdict FROM u LEFT JOIN m USING (n)
"""

OP10 = rf"""
WITH d AS (SELECT row_number() OVER () AS n, doc_id, source, text, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '{WORD}') AS words FROM d),
grams AS (SELECT n, unnest(range(1, len(words) - 3)) AS i, words FROM w WHERE len(words) >= 5),
named AS (SELECT n, i, array_to_string(words[i:i + 4], ' ') AS g FROM grams),
twice AS (SELECT n, i FROM (SELECT *, count(*) OVER (PARTITION BY n, g) AS c FROM named) WHERE c > 1),
covered AS (SELECT n, count(DISTINCT j) AS n_repeat_words FROM (SELECT n, unnest(range(i, i + 5)) AS j FROM twice) GROUP BY n),
plain AS (SELECT n, unnest(list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '{WORD}'))) AS line FROM d),
dups AS (SELECT n, count(*) - count(DISTINCT line) AS n_dup_lines FROM plain GROUP BY n),
texts AS (SELECT DISTINCT source, text, t FROM d),
lines AS (
 SELECT source, text, trim(unnest(string_split(regexp_replace(lower(t), '[\x20\x09\x0B-\x0D]+', ' ', 'g'), chr(10))), ' ') AS line FROM texts),
frequent AS (SELECT source, line FROM (SELECT DISTINCT * FROM lines WHERE line <> '') GROUP BY ALL HAVING count(*) >= 20),
lost AS (
 SELECT l.source, l.text, sum(len(string_split(l.line, ' '))) AS n_lost
 FROM lines l JOIN frequent f ON l.source IS NOT DISTINCT FROM f.source AND l.line = f.line GROUP BY ALL),
base AS (
 SELECT w.doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(length(array_to_string(words, '')) AS BIGINT) AS word_chars,
        CAST(len(regexp_extract_all(t, '[#*$%&|<>]')) AS BIGINT) AS n_symbols, CAST(coalesce(n_dup_lines, 0) AS BIGINT) AS n_dup_lines,
        CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words, lost.n_lost IS NOT NULL AS hit,
        CAST(len(words) - coalesce(lost.n_lost, 0) AS BIGINT) AS n_words_left
 FROM w LEFT JOIN covered USING (n) LEFT JOIN dups USING (n)
 LEFT JOIN lost ON w.source IS NOT DISTINCT FROM lost.source AND w.text IS NOT DISTINCT FROM lost.text)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words_left,
       n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
       NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words)
         AND NOT (hit AND (n_words_left < 10 OR n_words_left < 0.3::DOUBLE * n_words)) AS kept
FROM base
"""

# The CRC table is built by its rule; a text's CRC folds its bytes.
OP11 = """
WITH steps AS (
 SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END)) AS t),
runs AS (
 SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS id,
        unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-zÀ-ÿ]+')) AS run
 FROM documents),
marked AS (SELECT id, run, count(*) AS n, hex(encode(id || ':' || run)) AS h FROM runs GROUP BY id, run),
hashed AS (
 SELECT run, n, xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(range(len(h) // 2), lambda i: CAST('0x' || substr(h, CAST(2 * i + 1 AS BIGINT), 2) AS BIGINT))),
        lambda c, b: xor(c // 256, t[CAST(xor(c % 256, b) + 1 AS BIGINT)]))) AS h
 FROM marked, steps),
words AS (
 SELECT CASE WHEN h % 97 = 0 THEN substr(run, 1, CAST(h % length(run) AS BIGINT)) || substr(run, CAST(h % length(run) + 2 AS BIGINT)) ELSE run END AS word, CAST(sum(n) AS BIGINT) AS n
 FROM hashed GROUP BY 1 HAVING sum(n) >= 3 AND length(word) >= 5),
less AS (SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words)),
pairs AS (
 SELECT a.word, b.word AS near, b.n AS near_n FROM less a JOIN less b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
 UNION SELECT w.word, l.word, l.n FROM words w JOIN less l ON l.rest = w.word
 UNION SELECT l.word, w.word, w.n FROM words w JOIN less l ON l.rest = w.word),
best AS (SELECT word, count(*) AS n_near, min({'m': -near_n, 'near': near}) AS b FROM pairs GROUP BY word),
found AS (
 SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN -b.m >= 2 * w.n THEN b.near END AS form, CASE WHEN -b.m >= 2 * w.n THEN -b.m END AS form_n
 FROM words w LEFT JOIN best USING (word)),
ways AS (
 WITH RECURSIVE w AS (
  SELECT word, word AS root, form AS next FROM found
  UNION ALL SELECT w.word, f.word, f.form FROM w JOIN found f ON w.next = f.word)
 SELECT word, root FROM w WHERE next IS NULL)
SELECT word, form, root, n, n_near, form_n FROM found JOIN ways USING (word)
"""

OP12 = """
WITH r AS (
 SELECT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
        list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
 FROM (SELECT DISTINCT vec_id, label, embedding FROM embeddings)
 WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
 SELECT a.id AS anchor_id, a.label AS anchor_label, b.id, b.label, CASE WHEN len(a.v) = 0 THEN 0 ELSE CAST(list_inner_product(a.v, b.v) AS BIGINT) END AS score
 FROM r a JOIN r b ON a.id % 50 = 0 AND a.id <> b.id AND len(a.v) = len(b.v)),
p AS (
 SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE label = anchor_label
 QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5),
n AS (
 SELECT p.*, s.id AS negative_id, s.score AS negative_score,
        CAST(row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY s.score DESC, s.id) AS INTEGER) AS rank
 FROM p JOIN s ON p.anchor_id = s.anchor_id AND s.label <> s.anchor_label
 WHERE 50 * positive_score <= 100 * s.score AND 100 * s.score <= 95 * positive_score)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 3
"""
