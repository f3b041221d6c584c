"""The operators in SQL, for DuckDB, where it can express them."""

from __future__ import annotations

import string

_LOWER = f"translate(coalesce(text, ''), '{string.ascii_uppercase}', '{string.ascii_lowercase}')"
_WORD = r"'[^\x20\x09-\x0D]+'"
_ALNUM = r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'"

_REACH = """reach(a, b) AS (SELECT id, id FROM ids UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
low AS (SELECT a AS id, min(b) AS component_id FROM reach GROUP BY a)"""

OP1 = f"""WITH RECURSIVE d AS (SELECT doc_id AS id, regexp_extract_all({_LOWER}, {_WORD}) AS w FROM documents),
ids AS (SELECT id FROM d),
s AS (
  SELECT DISTINCT id, array_to_string(list_slice(w, i, i + 4), ' ') AS k FROM d, unnest(range(1, len(w) - 3)) t(i)
  UNION SELECT id, array_to_string(w, ' ') FROM d WHERE len(w) BETWEEN 1 AND 4
),
n AS (SELECT id, count(*) AS n FROM s GROUP BY id),
p AS (SELECT x.id AS a, y.id AS b, count(*) AS m FROM s x JOIN s y ON x.k = y.k AND x.id <> y.id GROUP BY 1, 2),
links AS (SELECT a, b FROM p JOIN n u ON u.id = a JOIN n v ON v.id = b WHERE 100 * m >= 85 * (u.n + v.n - m)),
{_REACH}
SELECT low.id AS doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, component_id, low.id = component_id AS kept FROM low LEFT JOIN n USING (id)"""

OP2 = f"""WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), {_WORD}) AS w FROM documents),
win AS (SELECT doc_id, i, array_to_string(list_slice(w, i, i + 19), ' ') AS k FROM d, unnest(range(1, len(w) - 18)) t(i)),
dup AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY k ORDER BY doc_id, i) AS r FROM win) WHERE r > 1),
gone AS (SELECT DISTINCT doc_id, i + j AS p FROM dup, range(0, 20) t(j)),
words AS (SELECT doc_id, p, w[p] AS x FROM d, unnest(range(1, len(w) + 1)) t(p)),
kept AS (SELECT words.doc_id, string_agg(x, ' ' ORDER BY words.p) AS x, count(*) AS n FROM words ANTI JOIN gone USING (doc_id, p) GROUP BY 1)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(x, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (doc_id)"""

OP3 = f"""WITH d AS (SELECT doc_id, regexp_extract_all({_LOWER}, {_ALNUM}) AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all({_LOWER}, {_ALNUM}) AS w FROM benchmark WHERE item_id IS NOT NULL),
bw AS (
  SELECT DISTINCT item, 10 AS n, array_to_string(list_slice(w, i, i + 9), ' ') AS k FROM b, unnest(range(1, len(w) - 8)) t(i)
  UNION SELECT item, len(w), array_to_string(w, ' ') FROM b WHERE len(w) BETWEEN 1 AND 9
),
dw AS (SELECT doc_id, n, i, array_to_string(list_slice(w, i, i + n - 1), ' ') AS k FROM d, (SELECT DISTINCT n FROM bw) s, unnest(range(1, CAST(len(w) - n + 2 AS BIGINT))) t(i)),
hits AS (SELECT doc_id, dw.n, i, item FROM dw JOIN bw ON dw.k = bw.k AND dw.n = bw.n),
covered AS (SELECT doc_id, count(DISTINCT i + j) AS n FROM (SELECT DISTINCT doc_id, n, i FROM hits) h, unnest(range(0, CAST(n AS BIGINT))) t(j) GROUP BY 1),
items AS (SELECT doc_id, count(*) AS n, string_agg(item, ',' ORDER BY item) AS s FROM (SELECT DISTINCT doc_id, item FROM hits) GROUP BY 1)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(covered.n, 0) AS BIGINT) AS n_hit, CAST(coalesce(items.n, 0) AS BIGINT) AS n_items,
  sha256(coalesce(s, '')) AS items_sha256, coalesce(covered.n, 0) > 0 AS contaminated
FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN items USING (doc_id)"""

OP6 = f"""WITH RECURSIVE e AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
ids AS (SELECT id FROM e),
good AS (SELECT id, v FROM e WHERE len(v) > 0 AND len(list_filter(v, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND list_aggregate(list_transform(v, lambda x: abs(x)), 'max') > 0),
links AS (SELECT x.id AS a, y.id AS b FROM good x JOIN good y ON x.id <> y.id AND len(x.v) = len(y.v) WHERE list_cosine_similarity(x.v, y.v) >= 0.9),
{_REACH},
n AS (SELECT a AS id, count(*) AS n FROM links GROUP BY a)
SELECT low.id AS vec_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_links, component_id, low.id = component_id AS kept FROM low LEFT JOIN n USING (id)"""

OP7 = f"""WITH l AS (SELECT doc_id, text, i, string_split(text, chr(10))[i] AS x FROM documents, unnest(range(1, len(string_split(text, chr(10))) + 1)) t(i)),
solid AS (SELECT doc_id, i, array_to_string(regexp_extract_all(x, {_WORD}), ' ') AS k, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS r FROM l WHERE regexp_matches(x, {_WORD})),
win AS (SELECT a.doc_id, a.r, concat(a.k, chr(10), b.k, chr(10), c.k) AS k FROM solid a JOIN solid b ON b.doc_id = a.doc_id AND b.r = a.r + 1 JOIN solid c ON c.doc_id = a.doc_id AND c.r = a.r + 2),
dup AS (SELECT doc_id, r FROM (SELECT doc_id, r, row_number() OVER (PARTITION BY k ORDER BY doc_id, r) AS o FROM win) WHERE o > 1),
gone AS (SELECT DISTINCT s.doc_id, s.i FROM dup JOIN solid s ON s.doc_id = dup.doc_id AND s.r BETWEEN dup.r AND dup.r + 2),
kept AS (SELECT doc_id, string_agg(x, chr(10) ORDER BY i) AS x FROM l ANTI JOIN gone USING (doc_id, i) GROUP BY 1),
n AS (SELECT doc_id, count(*) AS n FROM solid GROUP BY 1), g AS (SELECT doc_id, count(*) AS n FROM gone GROUP BY 1)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_lines, CAST(coalesce(g.n, 0) AS BIGINT) AS n_removed,
  CASE WHEN d.text IS NOT NULL THEN sha256(CASE WHEN n.n = g.n THEN '' ELSE coalesce(kept.x, '') END) END AS kept_sha256
FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN g USING (doc_id) LEFT JOIN kept USING (doc_id)"""

SQL = {"op1_minhash": OP1, "op2_substrings": OP2, "op3_decontamination": OP3, "op6_embeddings": OP6, "op7_lines": OP7}
