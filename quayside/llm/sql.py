"""DuckDB SQL for the operators' queries that SQL can express, over whole tables whose doc_id and page_id are unique."""

WORDS = "regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')"

JACCARD = f"""WITH RECURSIVE w AS MATERIALIZED (SELECT doc_id, {WORDS} AS w FROM documents),
s AS MATERIALIZED (SELECT doc_id, len(w) AS n, array_to_string(w, ' ') AS whole FROM w),
spot AS (SELECT doc_id, w, unnest(generate_series(1, greatest(len(w) - 4, 1))) AS i FROM w WHERE len(w) > 0),
g AS MATERIALIZED (SELECT DISTINCT doc_id, array_to_string(list_slice(w, i, i + 4), ' ') AS gram FROM spot),
c AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS inter FROM g a JOIN g b ON a.gram = b.gram AND a.doc_id <> b.doc_id GROUP BY 1, 2),
link AS MATERIALIZED (SELECT a, b FROM p JOIN c x ON a = x.doc_id JOIN c y ON b = y.doc_id WHERE inter >= 0.8 * (x.n + y.n - inter)),
r AS (SELECT a AS doc_id, a AS other FROM link UNION SELECT r.doc_id, link.b FROM r JOIN link ON r.other = link.a)
SELECT s.doc_id, coalesce((SELECT min(other) FROM r WHERE r.doc_id = s.doc_id), s.doc_id) AS class_id, CASE WHEN n > 0 THEN min(s.doc_id) OVER (PARTITION BY whole) ELSE s.doc_id END AS copy_of,
  CASE WHEN n > 0 THEN count(*) OVER (PARTITION BY whole) ELSE 1 END AS n_copies, (SELECT count(*) FROM link WHERE a = s.doc_id) AS n_links FROM s"""

_FOLD = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"

CONTAMINATION = f"""WITH d AS MATERIALIZED (SELECT doc_id, {_FOLD} AS w FROM documents), b AS (SELECT DISTINCT CAST(item_id AS VARCHAR) AS item, {_FOLD} AS w FROM benchmark WHERE item_id IS NOT NULL),
ia AS (SELECT item, w, least(len(w), 13) AS n, unnest(generate_series(1, greatest(len(w) - 12, 1))) AS i FROM b WHERE len(w) > 0),
iw AS MATERIALIZED (SELECT DISTINCT item, n, array_to_string(list_slice(w, i, i + n - 1), ' ') AS win FROM ia),
da AS (SELECT doc_id, w, n, unnest(generate_series(1, len(w) - n + 1)) AS i FROM d, (SELECT DISTINCT n FROM iw) WHERE len(w) >= n),
dw AS (SELECT doc_id, n, i, array_to_string(list_slice(w, i, i + n - 1), ' ') AS win FROM da),
hit AS MATERIALIZED (SELECT doc_id, n, i, item FROM dw JOIN iw USING (n, win)),
pos AS (SELECT doc_id, unnest(generate_series(i, i + n - 1)) AS p FROM hit), h AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM pos GROUP BY doc_id),
it AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT doc_id, item FROM hit) GROUP BY doc_id)
SELECT d.doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit > 0 AND 20 * n_hit >= len(w), false) AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN it USING (doc_id)"""

REPEATED_BYTES = """WITH d AS MATERIALIZED (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
spot AS (SELECT doc_id, h, unnest(generate_series(0, len(h) // 2 - 50)) AS i FROM d WHERE len(h) >= 100),
win AS (SELECT doc_id, i, substr(h, 2 * i + 1, 100) AS s FROM spot),
again AS (SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY s) AS first FROM win) WHERE first < doc_id),
gone AS MATERIALIZED (SELECT DISTINCT doc_id, unnest(generate_series(i, i + 49)) AS p FROM again),
runs AS (SELECT doc_id, count(*) AS n_removed, count(*) FILTER (before IS NULL OR before < p - 1) AS n_spans FROM (SELECT doc_id, p, lag(p) OVER (PARTITION BY doc_id ORDER BY p) AS before FROM gone) GROUP BY doc_id),
byte AS (SELECT doc_id, h, unnest(generate_series(0, len(h) // 2 - 1)) AS p FROM d WHERE doc_id IN (SELECT doc_id FROM runs)),
kept AS (SELECT doc_id, string_agg(substr(h, 2 * p + 1, 2), '' ORDER BY p) AS k FROM byte WHERE NOT EXISTS (SELECT 1 FROM gone WHERE gone.doc_id = byte.doc_id AND gone.p = byte.p) GROUP BY doc_id)
SELECT d.doc_id, len(h) // 2 AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(CASE WHEN n_removed IS NULL THEN h ELSE coalesce(k, '') END)) AS kept_sha256
FROM d LEFT JOIN runs USING (doc_id) LEFT JOIN kept USING (doc_id)"""

REPEATED_WORDS = f"""WITH d AS MATERIALIZED (SELECT doc_id, {WORDS} AS w FROM documents),
spot AS (SELECT doc_id, w, unnest(generate_series(1, len(w) - 34)) AS i FROM d WHERE len(w) >= 35),
win AS (SELECT doc_id, i, array_to_string(list_slice(w, i, i + 34), ' ') AS s FROM spot),
again AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY s) AS n FROM win) WHERE n > 1),
gone AS MATERIALIZED (SELECT DISTINCT doc_id, unnest(generate_series(i, i + 34)) AS p FROM again), lost AS (SELECT doc_id, count(*) AS n_removed FROM gone GROUP BY doc_id),
each AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS p FROM d),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS k FROM each WHERE NOT EXISTS (SELECT 1 FROM gone WHERE gone.doc_id = each.doc_id AND gone.p = each.p) GROUP BY doc_id)
SELECT d.doc_id, len(w) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(k, '')) AS kept_sha256 FROM d LEFT JOIN lost USING (doc_id) LEFT JOIN kept USING (doc_id)"""

WARC = """WITH p AS (SELECT page_id, url, coalesce(html, '') AS html FROM pages), q AS (SELECT page_id, url, html, sha1(html) AS h, max(page_id) OVER (PARTITION BY html) AS first FROM p)
SELECT page_id, url, strlen(html) AS payload_bytes,
  array_to_string(list_transform(generate_series(0, 31), lambda j: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((CAST('0x' || substr(h, (j // 4) * 5 + 1, 5) AS BIGINT) >> (15 - 5 * (j % 4))) & 31) + 1, 1)), '') AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to FROM q"""

TEMPLATES = """WITH d AS MATERIALIZED (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS pos FROM d),
t AS MATERIALIZED (SELECT doc_id, pos, line, list_transform(regexp_extract_all(line, '[^\\x20\\x09-\\x0D]+'), lambda x: CASE WHEN regexp_matches(x, '[0-9]') THEN chr(1) ELSE x END) AS w FROM l),
u AS MATERIALIZED (SELECT doc_id, pos, w, len(w) AS n FROM t WHERE len(w) > 0),
lead AS (SELECT doc_id, n, unnest([1, 2, 3]) AS place, unnest(w[1:3] || list_transform(generate_series(1, greatest(3 - n, 0)), lambda k: NULL)) AS token FROM u),
known AS MATERIALIZED (SELECT n, place, token FROM lead WHERE token IS NOT NULL AND token <> chr(1) GROUP BY 1, 2, 3 HAVING count(DISTINCT doc_id) >= 10),
leaf AS MATERIALIZED (SELECT u.doc_id, u.pos, u.w, u.n, concat_ws(chr(2), u.n, CASE WHEN a.token IS NULL THEN chr(1) ELSE w[1] END, CASE WHEN u.n < 2 THEN '' WHEN b.token IS NULL THEN chr(1) ELSE w[2] END, CASE WHEN u.n < 3 THEN '' WHEN c.token IS NULL THEN chr(1) ELSE w[3] END) AS leaf
  FROM u LEFT JOIN known a ON a.n = u.n AND a.place = 1 AND a.token = w[1] LEFT JOIN known b ON b.n = u.n AND b.place = 2 AND b.token = w[2] LEFT JOIN known c ON c.n = u.n AND c.place = 3 AND c.token = w[3]),
big AS (SELECT leaf FROM leaf GROUP BY leaf HAVING count(DISTINCT doc_id) >= 10), k AS MATERIALIZED (SELECT * FROM leaf WHERE leaf IN (SELECT leaf FROM big)),
tok AS MATERIALIZED (SELECT doc_id, pos, leaf, n, unnest(w) AS token, generate_subscripts(w, 1) AS place FROM k),
const AS MATERIALIZED (SELECT leaf, place, token FROM tok WHERE token <> chr(1) GROUP BY 1, 2, 3 HAVING count(DISTINCT doc_id) >= 10),
made AS MATERIALIZED (SELECT doc_id, pos, t.leaf AS leaf, string_agg(coalesce(c.token, chr(1)), chr(2) ORDER BY t.place) AS template, count(c.token) AS fixed, any_value(n) AS n FROM tok t LEFT JOIN const c ON c.leaf = t.leaf AND c.place = t.place AND c.token = t.token GROUP BY doc_id, pos, t.leaf),
bad AS (SELECT leaf, template FROM made WHERE fixed >= 0.5 * n GROUP BY 1, 2 HAVING count(DISTINCT doc_id) >= 10), gone AS (SELECT doc_id, pos FROM made WHERE fixed >= 0.5 * n AND (leaf, template) IN (SELECT leaf, template FROM bad)),
r AS (SELECT l.doc_id, count(*) AS n_lines, count(g.pos) AS n_dropped, coalesce(string_agg(CASE WHEN g.pos IS NULL THEN line END, chr(10) ORDER BY l.pos), '') AS kept FROM l LEFT JOIN gone g ON g.doc_id = l.doc_id AND g.pos = l.pos GROUP BY l.doc_id)
SELECT doc_id, n_lines, n_dropped, length(kept) AS n_chars_kept, sha256(kept) AS kept_sha256 FROM r"""

_D = "list_sum(list_transform(list_zip(v.x, c.x), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"
_ROUNDS = "".join(
    f""", n{r} AS MATERIALIZED (SELECT v.nth, v.vec_id, v.x, arg_min(c.j, {{'d': {_D}, 'j': c.j}}) AS j, min({_D}) AS d FROM v CROSS JOIN c{r} c GROUP BY v.nth, v.vec_id, v.x),
p{r} AS (SELECT j, i, CAST(floor(CAST(sum(val) AS DOUBLE) / count(*)) AS BIGINT) AS y FROM (SELECT j, unnest(x) AS val, generate_subscripts(x, 1) AS i FROM n{r}) GROUP BY j, i),
c{r + 1} AS MATERIALIZED (SELECT c.j, coalesce(m.x, c.x) AS x FROM c{r} c LEFT JOIN (SELECT j, list(y ORDER BY i) AS x FROM p{r} GROUP BY j) m USING (j))"""
    for r in range(10)
)

KMEANS = f"""WITH v AS MATERIALIZED (SELECT row_number() OVER () AS nth, vec_id, list_transform(embedding, lambda e: CAST(floor(1024 * CAST(e AS DOUBLE)) AS BIGINT)) AS x FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda e: e IS NOT NULL AND isfinite(e))) = 64),
c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY key, x) - 1 AS j, x FROM (SELECT sha256('3:' || CAST(vec_id AS VARCHAR)) AS key, x FROM v ORDER BY key, x LIMIT 8)){_ROUNDS},
last AS MATERIALIZED (SELECT v.nth, v.vec_id, arg_min(c.j, {{'d': {_D}, 'j': c.j}}) AS j, min({_D}) AS d FROM v CROSS JOIN c10 c GROUP BY v.nth, v.vec_id)
SELECT vec_id, CAST(l.j AS INTEGER) AS cluster, CAST(d AS BIGINT) AS distance, CAST(sum(d) OVER (PARTITION BY l.j) AS BIGINT) AS cluster_inertia, CAST(sum(d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c.x, ',')) AS centroid_sha256 FROM last l JOIN c10 c USING (j)"""

_ESCAPED = "replace(replace(replace(coalesce({}, ''), '\\', '\\\\'), '###', '\\h'), '</turn>', '\\e')"
_ROLE, _TEXT = f"replace({_ESCAPED.format('role')}, ':', '\\c')", _ESCAPED.format("text")
CHATS = f"""WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations UNION ALL SELECT -7, unnest([0, 1]), unnest(['user', 'assistant']), '\\### Assistant: </turn> ok')
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn)) AS turns_sha256, CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn) FILTER (role = 'assistant'), '')) AS loss_sha256, CAST(sum(4 + length({_ROLE}) + 2 + length({_TEXT}) + 8) AS BIGINT) AS formatted_chars FROM c GROUP BY conv_id"""

ORACLES = {"op11_ball_tree": KMEANS, "op13_chat_format": CHATS, "op10_line_templates": TEMPLATES, "op1_minhash_forest": JACCARD, "op3_decontamination": CONTAMINATION, "op5_substring_dedup": REPEATED_BYTES, "op7_warc_packages": WARC, "op9_recompression_dedup": REPEATED_WORDS}
