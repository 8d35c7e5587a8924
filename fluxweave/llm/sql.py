"""DuckDB SQL for the queries that SQL can express."""

QUALITY = r"""
WITH d AS (
  SELECT doc_id, coalesce(source, chr(1) || 'null') AS host, coalesce(text, '') AS t,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls
  FROM documents),
win AS (SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g
        FROM d, LATERAL (SELECT unnest(range(1, len(w) - 1)) AS i)),
dup AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM win) WHERE c >= 2),
rep AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM dup, (SELECT unnest([0, 1, 2]) AS k) GROUP BY doc_id),
ln AS (SELECT doc_id, host, hash(t) AS h, raw, lower(regexp_replace(trim(raw, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '[\x20\x09-\x0D]+', ' ', 'g')) AS line
       FROM (SELECT doc_id, host, t, unnest(ls) AS raw FROM d)),
df AS (SELECT host, line, count(DISTINCT h) AS c FROM ln GROUP BY host, line HAVING count(DISTINCT h) >= 5),
hosts AS (SELECT host, count(DISTINCT hash(t)) AS n FROM d GROUP BY host),
above AS (SELECT host, line FROM df JOIN hosts USING (host) WHERE c >= 0.01 * n),
lost AS (SELECT doc_id, sum(length(regexp_replace(raw, '[\x20\x09-\x0D]', '', 'g'))) AS n FROM ln JOIN above USING (host, line) GROUP BY doc_id),
base AS (
  SELECT doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
         length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
         (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(rep.n, 0)::BIGINT AS n_repeat_words,
         coalesce(lost.n, 0)::BIGINT AS lost_chars
  FROM d LEFT JOIN rep USING (doc_id) LEFT JOIN lost USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed,
       NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND lost_chars <= 0.5 * word_chars AS kept, lost_chars
FROM base
"""

DECONTAMINATION = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, least(13, len(w)) AS n, array_to_string(w[i:i + least(13, len(w)) - 1], ' ') AS g
       FROM b, LATERAL (SELECT unnest(range(1, len(w) - least(13, len(w)) + 2)) AS i) WHERE len(w) > 0),
lens AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') AS g FROM d, lens, LATERAL (SELECT unnest(range(1, len(w) - n + 2)) AS i)),
hit AS (SELECT doc_id, i, n, item_id FROM dw JOIN bw USING (n, g)),
cov AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM (SELECT DISTINCT doc_id, i, n FROM hit)) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS s FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM hit) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN cov USING (doc_id) LEFT JOIN its USING (doc_id)
"""

NGRAM_JOIN = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, g FROM (
    SELECT doc_id, array_to_string(w[i:i + 4], ' ') AS g FROM d, LATERAL (SELECT unnest(range(1, len(w) - 3)) AS i) WHERE len(w) >= 5
    UNION ALL SELECT doc_id, array_to_string(w, ' ') FROM d WHERE len(w) BETWEEN 1 AND 4)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
df AS (SELECT g, count(*) AS c FROM s GROUP BY g),
-- of n shingles, rarest first, the first n - ceil(0.75 n) + 1 must meet those of any linked document
pre AS (SELECT doc_id, g FROM (SELECT doc_id, g, n, row_number() OVER (PARTITION BY doc_id ORDER BY c, g) AS r FROM s JOIN df USING (g) JOIN n USING (doc_id)) WHERE r <= n - (75 * n + 99) // 100 + 1),
cand AS (SELECT DISTINCT a.doc_id AS x, b.doc_id AS y FROM pre a JOIN pre b USING (g) WHERE a.doc_id < b.doc_id),
pair AS (SELECT x, y, count(*) AS c FROM cand JOIN s a ON a.doc_id = x JOIN s b ON b.doc_id = y AND b.g = a.g GROUP BY x, y),
e AS (SELECT x, y FROM pair JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * c >= 75 * (a.n + b.n - c)),
both_ways AS (SELECT x, y FROM e UNION ALL SELECT y, x FROM e),
reach AS (SELECT doc_id, doc_id AS m FROM d UNION SELECT b.y, r.m FROM reach r JOIN both_ways b ON b.x = r.doc_id WHERE r.m < b.y)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, min(m) AS component_id FROM d LEFT JOIN n USING (doc_id) JOIN reach USING (doc_id) GROUP BY d.doc_id, n.n
"""

URL_FILTER = r"""
WITH p AS (
  SELECT page_id, CASE WHEN instr(coalesce(url, ''), '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
q AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM p),
rules AS (SELECT * FROM (VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')) AS t(h, pre, v)),
best AS (
  SELECT page_id, arg_max(h || pre, length(h || pre)) AS rule, arg_max(v, length(h || pre)) AS v
  FROM q JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, pre) GROUP BY page_id)
SELECT page_id, host, path, rule,
       coalesce(v, CASE WHEN len(list_intersect(string_split(host, '.'), ['casino-win', 'cheap-pills', 'free-bets', 'spam-farm', 'ads-track', 'adult-x'])) > 0 THEN 'block' ELSE 'allow' END) AS verdict
FROM q LEFT JOIN best USING (page_id)
"""

FILL_IN_MIDDLE = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, ''))::BIGINT AS n, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS x FROM documents),
h AS (SELECT *, ('0x' || substr(x, 1, 8))::BIGINT AS h1, ('0x' || substr(x, 9, 8))::BIGINT AS h2, ('0x' || substr(x, 17, 8))::BIGINT AS h3, ('0x' || substr(x, 25, 8))::BIGINT AS h4 FROM d),
c AS (
  SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
         CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM h)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t
              WHEN 'psm' THEN '<P>' || substr(t, 1, a) || '<S>' || substr(t, b + 1) || '<M>' || substr(t, a + 1, b - a)
              ELSE '<S>' || substr(t, b + 1) || '<P>' || substr(t, 1, a) || '<M>' || substr(t, a + 1, b - a) END) AS output_sha256,
       sha256(t) AS restored_sha256
FROM c
"""

MERKLE_MANIFEST = r"""
WITH RECURSIVE t AS (
  SELECT doc_id, source,
         coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-') || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') AS head,
         text, CASE WHEN doc_id IS NULL OR 1 - (crc & 1) = 0 THEN replace(text, chr(10), '') ELSE text END AS other
  -- crc32 before its last inversion: a byte at a time, eight shifts each
  FROM (SELECT *, list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)), lambda x, b: list_reduce(list_concat([xor(x, b)], range(8)), lambda y, k: xor(y >> 1, (y & 1) * 3988292384))) AS crc FROM documents)),
l AS (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS tree, row_number() OVER () AS num
  FROM (SELECT doc_id, source, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf, sha256(head || coalesce(strlen(other) || ':' || other, '-')) AS given FROM t)),
up AS (
  SELECT tree, 0 AS lvl, i, leaf AS v, count(*) OVER (PARTITION BY tree) AS n FROM l
  UNION ALL
  SELECT tree, lvl + 1, i // 3, sha256(string_agg(v, '' ORDER BY i)), (any_value(n) + 2) // 3 FROM up WHERE n > 1 GROUP BY tree, lvl, i // 3),
sub AS (SELECT tree, v FROM up WHERE n = 1),
top AS (
  SELECT 0 AS lvl, tree AS i, v, (SELECT count(*) FROM sub) AS n FROM sub
  UNION ALL
  SELECT lvl + 1, i // 3, sha256(string_agg(v, '' ORDER BY i)), (any_value(n) + 2) // 3 FROM top WHERE n > 1 GROUP BY lvl, i // 3),
met AS (
  SELECT num, lvl AS step, up.i AS k, v, l.i // (3 ** lvl)::BIGINT AS own FROM l JOIN up ON up.tree = l.tree AND up.n > 1 AND up.i // 3 = l.i // (3 ** (lvl + 1))::BIGINT
  UNION ALL
  SELECT num, 1000 + lvl, top.i, v, l.tree // (3 ** lvl)::BIGINT FROM l JOIN top ON top.n > 1 AND top.i // 3 = l.tree // (3 ** (lvl + 1))::BIGINT),
steps AS (
  SELECT num, step, coalesce(string_agg(v, '' ORDER BY k) FILTER (k < own), '') AS lefts, coalesce(string_agg(v, '' ORDER BY k) FILTER (k > own), '') AS rights, count(*) - 1 AS others FROM met GROUP BY num, step),
ways AS (SELECT num, string_agg(lefts || rights, '' ORDER BY step) AS proof, list(lefts || '|' || rights ORDER BY step) AS way, sum(others) AS n_siblings FROM steps GROUP BY num),
folded AS (
  SELECT l.*, coalesce(proof, '') AS proof, coalesce(n_siblings, 0)::INTEGER AS n_siblings,
         list_reduce(list_concat([given], coalesce(way, [])), lambda x, y: sha256(split_part(y, '|', 1) || x || split_part(y, '|', 2))) AS folded_root
  FROM l LEFT JOIN ways USING (num))
SELECT doc_id, leaf, sub.v AS subroot, r.v AS root, sha256(proof) AS proof_sha256, folded_root, folded_root = r.v AS verified, n_siblings
FROM folded JOIN sub USING (tree), (SELECT v FROM top WHERE n = 1) AS r
"""

MINHASH_NEAR_DEDUP = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, g FROM (
    SELECT doc_id, array_to_string(w[i:i + 3], ' ') AS g FROM d, LATERAL (SELECT unnest(range(1, len(w) - 2)) AS i) WHERE len(w) >= 4
    UNION ALL SELECT doc_id, array_to_string(w, ' ') FROM d WHERE len(w) BETWEEN 1 AND 3)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
df AS (SELECT g, count(*) AS c FROM s GROUP BY g),
-- of n shingles, rarest first, the first n - ceil(0.8 n) + 1 must meet those of any linked document
pre AS (SELECT doc_id, g FROM (SELECT doc_id, g, n, row_number() OVER (PARTITION BY doc_id ORDER BY c, g) AS r FROM s JOIN df USING (g) JOIN n USING (doc_id)) WHERE r <= n - (80 * n + 99) // 100 + 1),
cand AS (SELECT DISTINCT a.doc_id AS x, b.doc_id AS y FROM pre a JOIN pre b USING (g) WHERE a.doc_id < b.doc_id),
pair AS (SELECT x, y, count(*) AS c FROM cand JOIN s a ON a.doc_id = x JOIN s b ON b.doc_id = y AND b.g = a.g GROUP BY x, y),
e AS (SELECT x, y FROM pair JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * c >= 80 * (a.n + b.n - c)),
both_ways AS (SELECT x, y FROM e UNION ALL SELECT y, x FROM e),
reach AS (SELECT doc_id, doc_id AS m FROM d UNION SELECT b.y, r.m FROM reach r JOIN both_ways b ON b.x = r.doc_id WHERE r.m < b.y)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, min(m) AS component_id, d.doc_id = min(m) AS kept FROM d LEFT JOIN n USING (doc_id) JOIN reach USING (doc_id) GROUP BY d.doc_id, n.n
"""
