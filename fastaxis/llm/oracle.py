"""DuckDB SQL for the queries that SQL can express."""

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

#: Words are what is left between runs of ASCII characters other than letters and digits.
_WORDS = f"list_filter(regexp_split_to_array({_LOWER}, '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '')"

OP9 = f"""WITH it AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
iw AS (SELECT DISTINCT item_id, len(p) AS n, p FROM (SELECT item_id, unnest(list_transform(range(1, greatest(1, len(w) - 9) + 1), lambda j: array_to_string(w[j : least(j + 9, len(w))], ' '))) AS s, w FROM it WHERE len(w) > 0), LATERAL (SELECT string_split(s, ' ') AS p)),
lens AS (SELECT DISTINCT n FROM iw),
d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
dw AS (SELECT doc_id, n, j, array_to_string(w[j : j + n - 1], ' ') AS s FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS j FROM d, lens WHERE len(w) >= n)),
hit AS (SELECT doc_id, j, iw.n, item_id FROM dw JOIN iw ON dw.n = iw.n AND dw.s = array_to_string(iw.p, ' ')),
words AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(range(j, j + n)) AS k FROM hit) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS ids FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS i FROM hit) GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM d LEFT JOIN words ON d.doc_id = words.doc_id LEFT JOIN items ON d.doc_id = items.doc_id"""

_WHITE = f"list_filter(regexp_split_to_array({_LOWER}, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '')"

OP8 = f"""WITH RECURSIVE d AS (SELECT doc_id, {_WHITE} AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(list_transform(range(1, greatest(1, len(w) - 3) + 1), lambda j: array_to_string(w[j : least(j + 3, len(w))], ' '))) AS g FROM d WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
o AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS o FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM o JOIN n x ON a = x.doc_id JOIN n y ON b = y.doc_id WHERE 100 * o >= 85 * (x.n + y.n - o)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id AS x, doc_id AS y FROM documents UNION SELECT r.x, e.b FROM r JOIN e ON r.y = e.a)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id FROM d LEFT JOIN n ON d.doc_id = n.doc_id JOIN (SELECT x, min(y) AS component_id FROM r GROUP BY x) c ON c.x = d.doc_id"""

OP6 = r"""WITH l AS (SELECT doc_id, unnest(range(len(ls))) AS k, unnest(ls) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents WHERE text IS NOT NULL)),
t AS (SELECT *, list_transform(list_filter(regexp_split_to_array(line, '[\x20\x09-\x0D]+'), lambda x: x <> ''), lambda x: CASE WHEN regexp_matches(x, '[0-9]') THEN chr(1) ELSE x END) AS w FROM l),
u AS (SELECT doc_id, k, len(w) AS n, len(w) || ' ' || w[1] || ' ' || w[2] AS leaf, array_to_string(w, ' ') AS s FROM t WHERE len(w) >= 3),
c AS (SELECT leaf, n, s, count(DISTINCT doc_id) AS docs FROM u GROUP BY ALL),
lv AS (SELECT leaf FROM c GROUP BY leaf HAVING count(*) > 1 AND sum(docs) >= 3),
p AS (SELECT leaf, n, s, docs, unnest(range(n)) AS j, unnest(string_split(s, ' ')) AS x FROM c WHERE leaf IN (SELECT leaf FROM lv)),
sup AS (SELECT leaf, j, x, sum(docs) AS sup FROM p GROUP BY ALL),
m AS (SELECT p.*, x <> chr(1) AND sup >= 3 AS const FROM p JOIN sup USING (leaf, j, x)),
tem AS (SELECT s, 'T' || leaf || ' ' || string_agg(CASE WHEN const THEN x ELSE chr(2) END, ' ' ORDER BY j) AS tem FROM m GROUP BY leaf, n, s HAVING count(*) FILTER (const) >= 0.6 * n),
z AS (SELECT u.doc_id, u.k, coalesce(tem, 'L' || u.s) AS tem FROM u LEFT JOIN tem ON u.s = tem.s),
f AS (SELECT tem, min(struct_pack(d := doc_id, k := k)) AS f FROM z GROUP BY tem HAVING count(DISTINCT doc_id) >= 3),
g AS (SELECT doc_id, k FROM z JOIN f USING (tem) WHERE struct_pack(d := doc_id, k := k) <> f),
r AS (SELECT l.doc_id, count(*) AS n_lines, count(g.k) AS n_dropped, coalesce(string_agg(line, chr(10) ORDER BY l.k) FILTER (g.k IS NULL), '') AS kept FROM l LEFT JOIN g ON l.doc_id = g.doc_id AND l.k = g.k GROUP BY l.doc_id)
SELECT d.doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_dropped, 0) AS n_dropped, length(coalesce(kept, '')) AS kept_chars, sha256(coalesce(kept, '')) AS kept_sha256 FROM documents d LEFT JOIN r ON d.doc_id = r.doc_id"""

#: Bytes are pairs of hexadecimal digits; a window is 100 of them.
OP4 = """WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
w AS (SELECT doc_id, i, substr(h, 2 * i + 1, 200) AS s FROM (SELECT doc_id, h, unnest(range(0, n - 99)) AS i FROM d)),
f AS (SELECT s, min(struct_pack(d := doc_id, i := i)) AS f FROM w GROUP BY s HAVING count(*) > 1),
c AS (SELECT doc_id, i, lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS p FROM w JOIN f USING (s) WHERE struct_pack(d := doc_id, i := i) <> f),
g AS (SELECT doc_id, i, sum(CASE WHEN p IS NULL OR i > p + 100 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS k FROM c),
m AS (SELECT doc_id, min(i) AS a, max(i) + 100 AS b FROM g GROUP BY doc_id, k),
e AS (SELECT doc_id, lag(b, 1, 0::BIGINT) OVER (PARTITION BY doc_id ORDER BY a) AS lo, a AS hi FROM m UNION ALL SELECT d.doc_id, coalesce(max(b), 0), max(n) FROM d LEFT JOIN m ON d.doc_id = m.doc_id GROUP BY d.doc_id),
k AS (SELECT d.doc_id, string_agg(substr(h, 2 * lo + 1, 2 * (hi - lo)), '' ORDER BY lo) AS kept FROM d JOIN e ON d.doc_id = e.doc_id GROUP BY d.doc_id),
r AS (SELECT doc_id, sum(b - a)::BIGINT AS n_removed, count(*) AS n_spans FROM m GROUP BY doc_id)
SELECT d.doc_id, n AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(kept)) AS kept_sha256 FROM d JOIN k ON d.doc_id = k.doc_id LEFT JOIN r ON d.doc_id = r.doc_id"""


def _round(r: int) -> str:
    """The centroids after round r, from those before it."""
    return f"""a{r} AS MATERIALIZED (SELECT rn, v, arg_min(k, d * 64 + k) AS k FROM (SELECT rn, kept.v, c.k, list_sum(list_transform(list_zip(kept.v, c.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::HUGEINT AS d FROM kept, c{r - 1} c) GROUP BY rn, v),
s{r} AS (SELECT k, i, sum(x) AS s, count(*) AS n FROM (SELECT k, unnest(v) AS x, unnest(range(64)) AS i FROM a{r}) GROUP BY k, i),
m{r} AS (SELECT k, list(((s - ((s % n) + n) % n) // n)::BIGINT ORDER BY i) AS v FROM s{r} GROUP BY k),
c{r} AS MATERIALIZED (SELECT b.k, coalesce(m.v, b.v) AS v FROM c{r - 1} b LEFT JOIN m{r} m ON b.k = m.k)"""


OP11 = f"""WITH kept AS MATERIALIZED (SELECT row_number() OVER () AS rn, vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64),
c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('2:' || vec_id), v) - 1 AS k, v FROM kept ORDER BY k LIMIT 40),
{", ".join(_round(r) for r in range(1, 6))},
f AS MATERIALIZED (SELECT rn, vec_id, min(d * 64 + k) AS dk FROM (SELECT rn, vec_id, c.k, list_sum(list_transform(list_zip(kept.v, c.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::HUGEINT AS d FROM kept, c5 c) GROUP BY rn, vec_id),
g AS (SELECT vec_id, (dk % 64)::INTEGER AS cluster, (dk // 64)::BIGINT AS distance FROM f)
SELECT vec_id, cluster, distance, (sum(distance) OVER (PARTITION BY cluster))::BIGINT AS cluster_inertia, (sum(distance) OVER ())::BIGINT AS inertia, sha256(array_to_string(c5.v, ',')) AS centroid_sha256 FROM g JOIN c5 ON c5.k = g.cluster"""

SQL = {"op4_suffix_dedup": OP4, "op6_line_templates": OP6, "op8_ngram_jaccard": OP8, "op9_decontamination": OP9, "op11_centroids": OP11}
