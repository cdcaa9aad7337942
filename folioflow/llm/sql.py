"""DuckDB SQL for the queries that SQL can express: plain definitions over whole tables, none of the methods."""

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"
_LOWER_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+')"
_SHINGLES = "list_distinct(list_transform(range(1, greatest(len(w) - 4, least(len(w), 1)) + 1), lambda i: array_to_string(w[i:i+4], ' ')))"

SQL = {
    "op1_substring_dedup": f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
win AS (SELECT doc_id, i, array_to_string(w[i:i+49], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM d WHERE len(w) >= 50)),
least_doc AS (SELECT s, min(doc_id) AS m FROM win GROUP BY s),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS p FROM win JOIN least_doc USING (s) WHERE m < doc_id),
words AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS p FROM d),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS t FROM words ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id),
n AS (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id) LEFT JOIN n USING (doc_id)""",
    "op2_decontamination": f"""
WITH i AS (SELECT item_id, unnest(s) AS shingle, len(s) AS n_item FROM (SELECT item_id, {_SHINGLES} AS s FROM (SELECT item_id, {_LOWER_WORDS} AS w FROM benchmark))),
d AS (SELECT doc_id, unnest({_SHINGLES}) AS shingle FROM (SELECT doc_id, {_LOWER_WORDS} AS w FROM documents))
SELECT doc_id, item_id, n_item::BIGINT AS n_item, count(DISTINCT shingle)::BIGINT AS n_shared
FROM d JOIN i USING (shingle) GROUP BY doc_id, item_id, n_item HAVING 100 * count(DISTINCT shingle) >= 80 * n_item""",
    "op4_minhash_dedup": f"""
WITH RECURSIVE d AS (SELECT doc_id, {_SHINGLES} AS s FROM (SELECT doc_id, {_LOWER_WORDS} AS w FROM documents)),
e AS (SELECT doc_id, unnest(s) AS shingle FROM d),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM e a JOIN e b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id GROUP BY 1, 2),
link AS (SELECT pairs.a, pairs.b FROM pairs JOIN d x ON x.doc_id = pairs.a JOIN d y ON y.doc_id = pairs.b WHERE 100 * n >= 85 * (len(x.s) + len(y.s) - n)),
reach(a, b) AS (SELECT a, b FROM link UNION SELECT reach.a, link.b FROM reach JOIN link ON reach.b = link.a),
least_doc AS (SELECT a AS doc_id, min(b) AS m FROM reach GROUP BY a)
SELECT doc_id, len(s)::BIGINT AS n_shingles, least(doc_id, m) AS component_id, doc_id = least(doc_id, m) AS kept FROM d LEFT JOIN least_doc USING (doc_id)""",
    "op5_embedding_dedup": """
WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS x FROM embeddings),
ok AS (SELECT * FROM v WHERE label IS NOT NULL AND x IS NOT NULL AND len(list_filter(x, lambda c: c IS NULL OR NOT isfinite(c))) = 0 AND len(list_filter(x, lambda c: c <> 0)) > 0),
link AS (SELECT p.vec_id AS a, q.vec_id AS b FROM ok p JOIN ok q ON p.label = q.label AND p.vec_id <> q.vec_id WHERE len(p.x) = len(q.x) AND list_cosine_similarity(p.x, q.x) >= 0.98),
reach(a, b) AS (SELECT a, b FROM link UNION SELECT reach.a, link.b FROM reach JOIN link ON reach.b = link.a),
least_id AS (SELECT a AS vec_id, min(b) AS m FROM reach GROUP BY a),
n AS (SELECT a AS vec_id, count(*) AS n FROM link GROUP BY a)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, least(vec_id, m) AS component_id, vec_id = least(vec_id, m) AS kept
FROM v LEFT JOIN least_id USING (vec_id) LEFT JOIN n USING (vec_id)""",
    "op6_url_filters": r"""
WITH c AS (SELECT page_id, nullif(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?(\[[^\]/?#]*\]|[^/?#:\[\]]+)', 1)), '') AS host, DATE '2024-01-01' + (page_id % 366)::INT AS fetched_at FROM pages),
h AS (SELECT DISTINCT host FROM c WHERE host IS NOT NULL),
l AS (SELECT host AS domain, ('0x' || substr(md5(host), 5, 4))::BIGINT % 300 AS d FROM h WHERE ('0x' || substr(md5(host), 1, 4))::BIGINT % 3 = 0
  UNION SELECT p, ('0x' || substr(md5(p), 5, 4))::BIGINT % 300 FROM (SELECT DISTINCT regexp_extract(host, '([^.]+\.(?:(?:ac|co|com|edu|gov|net|org)\.[a-z][a-z]|[^.]*[^.0-9\]][^.]*))$', 1) AS p FROM h) WHERE p <> ''),
entry AS (SELECT domain, DATE '2024-01-01' + d::INT AS since, 'block' AS action FROM l UNION ALL SELECT domain, DATE '2024-01-01' + (d + 45)::INT, 'allow' FROM l),
met AS (SELECT page_id, entry.*, row_number() OVER (PARTITION BY page_id ORDER BY length(domain) DESC, since DESC) AS k
  FROM c JOIN entry ON (host = domain OR (ends_with(host, '.' || domain) AND NOT regexp_matches(host, '^[0-9.]+$|^\['))) AND since <= fetched_at)
SELECT page_id, host, fetched_at, domain, since AS valid_from, coalesce(action, 'allow') AS action FROM c LEFT JOIN (SELECT * FROM met WHERE k = 1) USING (page_id)""",
    "op7_line_dedup": r"""
WITH d AS (SELECT doc_id, string_split(text, chr(10)) AS raw, list_transform(string_split(regexp_replace(text, '[^\x09-\x0D 0-9]*[0-9][^\x09-\x0D ]*', '<*>', 'g'), chr(10)), lambda x: trim(x, ' ' || chr(9) || chr(13) || chr(11) || chr(12))) AS ls FROM documents),
l AS (SELECT doc_id, line, string_split(line, ' ') AS ts FROM (SELECT DISTINCT doc_id, unnest(ls) AS line FROM d) WHERE line <> ''),
leaf AS (SELECT len(ts) AS size, ts[1:3] AS lead FROM l GROUP BY 1, 2 HAVING count(*) >= 10),
k AS (SELECT line, any_value(ts) AS ts, count(*) AS n FROM l GROUP BY line HAVING (len(any_value(ts)), any_value(ts)[1:3]) IN (SELECT (size, lead) FROM leaf)),
u AS (SELECT line, len(ts) AS size, ts[1:3] AS lead, n, unnest(ts) AS token, generate_subscripts(ts, 1) AS p FROM k),
firm AS (SELECT size, lead, p, token FROM u WHERE token <> '<*>' GROUP BY size, lead, p, token HAVING sum(n) >= 10),
common AS (SELECT u.line, u.size, u.lead, list(coalesce(firm.token, '<*>') ORDER BY u.p) AS template FROM u LEFT JOIN firm USING (size, lead, p, token) GROUP BY u.line, u.size, u.lead HAVING count(firm.token) >= 0.6 * count(*)),
told AS (SELECT DISTINCT list(line ORDER BY line) AS same, sum(CASE WHEN common.line IS NULL THEN len(ts) ELSE 0 END) >= 0.3 * sum(len(ts)) AS speaks FROM l LEFT JOIN common USING (line) GROUP BY doc_id),
bad AS (SELECT size, lead, template FROM (SELECT DISTINCT size, lead, template, same, speaks FROM (SELECT unnest(same) AS line, same, speaks FROM told) JOIN common USING (line)) GROUP BY size, lead, template HAVING count(*) FILTER (speaks) >= 10 AND 2 * count(*) FILTER (speaks) >= count(*)),
gone AS (SELECT line FROM common SEMI JOIN bad USING (size, lead, template)),
z AS (SELECT doc_id, unnest(raw) AS line, generate_subscripts(raw, 1) AS p, unnest(ls) AS masked FROM d),
kept AS (SELECT doc_id, count(*) AS n, string_agg(line, chr(10) ORDER BY p) AS t FROM z WHERE masked NOT IN (SELECT line FROM gone) GROUP BY doc_id)
SELECT d.doc_id, coalesce(len(raw), 0)::BIGINT AS n_lines, (coalesce(len(raw), 0) - coalesce(n, 0))::BIGINT AS n_dropped, CASE WHEN raw IS NOT NULL THEN md5(coalesce(t, '')) END AS kept_md5
FROM d LEFT JOIN kept USING (doc_id)""",
    "op10_chat_formatting": r"""
WITH c AS (SELECT conv_id, list({'r': coalesce(role, 'unknown'), 't': coalesce("text", '')} ORDER BY turn NULLS FIRST, coalesce(role, 'unknown'), coalesce("text", '')) AS ts FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
kept AS (SELECT ts, min(conv_id) AS conv_id, count(*) AS n_copies FROM c GROUP BY ts)
SELECT conv_id, len(ts)::BIGINT AS n_turns, n_copies::BIGINT AS n_copies,
  array_to_string(list_transform(ts, lambda x: '<|' || regexp_replace(x.r, '<(\\*)\|', '<\1\\|', 'g') || '|>' || chr(10) || regexp_replace(x.t, '<(\\*)\|', '<\1\\|', 'g')), chr(10)) AS rendered
FROM kept WHERE NOT EXISTS (SELECT 1 FROM c WHERE len(c.ts) > len(kept.ts) AND c.ts[1:len(kept.ts)] = kept.ts)""",
    "op12_filter_audit": r"""
WITH RECURSIVE t AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS x, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
q AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY doc_id),
f AS (SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
  CASE WHEN len(w) < 50 THEN 'A' ELSE '' END || CASE WHEN 100 * len(list_distinct(w)) < 65 * len(w) THEN 'B' ELSE '' END ||
  CASE WHEN 100 * (length(x) - length(regexp_replace(x, '[A-Z]', '', 'g'))) > 5 * length(x) THEN 'C' ELSE '' END ||
  CASE WHEN regexp_matches(x, '[#$%&*|]') THEN 'D' ELSE '' END || CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY x) THEN 'E' ELSE '' END AS fails FROM t LEFT JOIN q USING (doc_id)),
m AS (SELECT part, fails, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM f GROUP BY ALL),
l AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS c),
o(filter_order) AS (SELECT c FROM l UNION SELECT filter_order || c FROM o, l WHERE NOT contains(filter_order, c)),
s AS (SELECT filter_order, unnest(range(1, 6))::INT AS step FROM o WHERE length(filter_order) = 5),
z AS (SELECT part, filter_order, step, filter_order[step] AS c, sum(n) AS total, coalesce(sum(n) FILTER (contains(fails, filter_order[step])), 0) AS failing, coalesce(sum(n) FILTER (fails = filter_order[step]), 0) AS unique_fails,
  coalesce(sum(n) FILTER (contains(fails, filter_order[step]) AND translate(filter_order[1:step - 1], fails, '') = filter_order[1:step - 1]), 0) AS removed,
  coalesce(sum(good) FILTER (contains(fails, filter_order[step]) AND translate(filter_order[1:step - 1], fails, '') = filter_order[1:step - 1]), 0) AS good_lost,
  coalesce(sum(toxic) FILTER (contains(fails, filter_order[step]) AND translate(filter_order[1:step - 1], fails, '') = filter_order[1:step - 1]), 0) AS toxic_lost
  FROM m, s GROUP BY ALL)
SELECT part, filter_order, step, (total - sum(removed) OVER (PARTITION BY part, filter_order ORDER BY step))::BIGINT AS kept, removed::BIGINT AS removed, (failing - removed)::BIGINT AS redundant,
  unique_fails::BIGINT AS unique_fails, good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost, (sum(removed) OVER (PARTITION BY part, c))::BIGINT AS shapley FROM z""",
    "op13_importance_resampling": r"""
WITH crc AS (SELECT list(v ORDER BY i) AS tab FROM (SELECT i, list_reduce(list_prepend(i, range(8)), lambda v, k: CASE WHEN v % 2 = 1 THEN xor(v // 2, 3988292384) ELSE v // 2 END) AS v FROM range(256) r(i))),
d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
i AS (SELECT unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS word FROM benchmark),
e AS (SELECT doc_id, unnest(w) AS word FROM d),
b AS (SELECT word, xor(list_reduce(list_prepend(4294967295, list_transform(range(octet_length(encode(word))), lambda k: ('0x' || substr(hex(encode(word)), 2 * k + 1, 2))::BIGINT)),
    lambda v, c: xor(v // 256, tab[xor(v % 256, c) + 1])), 4294967295) % 10000 AS bucket FROM (SELECT word FROM e UNION SELECT word FROM i), crc),
c AS (SELECT bucket, count(*) AS s FROM e JOIN b USING (word) GROUP BY bucket),
g AS (SELECT bucket, count(*) AS t FROM i JOIN b USING (word) GROUP BY bucket),
n AS (SELECT (SELECT count(*) FROM e) + 10000.0::DOUBLE AS s_all, (SELECT count(*) FROM i) + 10000.0::DOUBLE AS t_all),
gain AS (SELECT bucket, floor(1000 * ln((coalesce(t, 0) + 1.0::DOUBLE) * s_all / ((coalesce(s, 0) + 1.0::DOUBLE) * t_all)))::BIGINT AS gain FROM (SELECT DISTINCT bucket FROM b) LEFT JOIN c USING (bucket) LEFT JOIN g USING (bucket), n),
wt AS (SELECT doc_id, sum(gain)::BIGINT AS weight FROM e JOIN b USING (word) JOIN gain USING (bucket) GROUP BY doc_id),
x AS (SELECT doc_id, len(w)::BIGINT AS n_features, coalesce(weight, 0) AS weight, ('0x' || substr(sha256('2024:' || doc_id), 1, 8))::BIGINT AS h FROM d LEFT JOIN wt USING (doc_id)),
y AS (SELECT doc_id, n_features, weight, weight + floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score FROM x),
r AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS place, count(*) OVER () AS n FROM y WHERE n_features >= 20)
SELECT y.*, CASE WHEN place <= n * 10 // 100 THEN place END AS rank FROM y LEFT JOIN r USING (doc_id)""",
}
