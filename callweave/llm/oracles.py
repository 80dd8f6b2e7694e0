"""DuckDB SQL for the queries that SQL can express, written from their definitions and not from the operators.

Networks (op3, op7), XXH64 (op6) and merges of tokens (op10) are beyond it; tests compare those with
slow versions.
"""

from __future__ import annotations

from .license_scan import TEMPLATES

OP1 = r"""
WITH parts AS (
  SELECT page_id,
         coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
         coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages),
rules(verdict, r_host, r_path) AS (
  VALUES ('block', 'com', '/en/'), ('allow', 'example.com', '/en/7'), ('allow', 'net', '/de/'), ('block', 'example.net', '/de/8'), ('block', 'org', '/es/')),
hits AS (
  SELECT page_id, arg_max(r_host || r_path, length(r_host || r_path)) AS rule, arg_max(verdict, length(r_host || r_path)) AS verdict
  FROM parts JOIN rules ON (host = r_host OR ends_with(host, '.' || r_host)) AND starts_with(path, r_path)
  GROUP BY page_id)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM parts LEFT JOIN hits USING (page_id)
"""

#: All pairs, and for each vector all that links reach.
OP2 = r"""
WITH v AS (
  SELECT vec_id, CASE WHEN len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0 THEN embedding::DOUBLE[] END AS e
  FROM embeddings),
unit AS (SELECT row_number() OVER () AS r, vec_id, e, len(e) AS dim, sqrt(list_dot_product(e, e)) AS norm FROM v),
links AS (
  SELECT a.r AS x, b.r AS y, b.vec_id AS other FROM unit a JOIN unit b ON a.dim = b.dim AND a.r <> b.r
  WHERE list_dot_product(a.e, b.e) / (a.norm * b.norm) >= 0.9),
counts AS (SELECT x, count(*) AS n FROM links GROUP BY x),
reach AS (
  WITH RECURSIVE reached(x, y) AS (
    SELECT r, r FROM unit UNION SELECT reached.x, links.y FROM reached JOIN links ON links.x = reached.y)
  SELECT reached.x, min(unit.vec_id) AS component_id FROM reached JOIN unit ON unit.r = reached.y GROUP BY reached.x)
SELECT vec_id, coalesce(n, 0) AS n_links, component_id, vec_id = component_id AS kept
FROM unit JOIN reach ON reach.x = unit.r LEFT JOIN counts ON counts.x = unit.r
"""

#: The level at which sources are not full, slots by the golden ratio, and the words of each block of 64.
OP5 = r"""
WITH docs AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size, ('0x' || substr(md5(concat_ws('|', doc_id, source, text)), 1, 15))::BIGINT AS ord
  FROM documents),
sizes AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS place FROM docs GROUP BY source),
weighed AS (SELECT *, [3, 1, 2][(place - 1) % 3 + 1]::DOUBLE AS weight, 2 * source_size::DOUBLE AS most FROM sizes),
levels AS (
  SELECT a.most / a.weight AS fill, ((SELECT 1.5::DOUBLE * sum(source_size) FROM sizes) - coalesce(sum(b.most) FILTER (b.most / b.weight < a.most / a.weight), 0)) / sum(b.weight) FILTER (b.most / b.weight >= a.most / a.weight) AS level
  FROM weighed a CROSS JOIN weighed b GROUP BY a.place, a.most, a.weight),
targets AS (SELECT source, source_size, place, least(most, weight * coalesce((SELECT arg_min(level, fill) FROM levels WHERE fill >= level), 1e300)) AS target FROM weighed),
spans AS (SELECT *, sum(target) OVER (ORDER BY place) AS upper, sum(target) OVER () AS total, ceil(source_size / 64)::BIGINT AS blocks FROM targets),
slots AS (SELECT i, ((i + 1)::HUGEINT * 2850178704830799621) % 4611686018427387904 AS u FROM (SELECT unnest(range((SELECT ceil(round(max(total) / 64, 6))::BIGINT FROM spans))) AS i)),
bounds AS (SELECT place, blocks, CASE WHEN place = max(place) OVER () THEN 4611686018427387904::HUGEINT ELSE floor(upper / total * 4611686018427387904::DOUBLE)::HUGEINT END AS hi FROM spans WHERE target > 0),
pieces AS (SELECT *, coalesce(lag(hi) OVER (ORDER BY place), 0) AS lo FROM bounds),
ranked AS (SELECT place, blocks, row_number() OVER (PARTITION BY place ORDER BY i) - 1 AS n FROM slots JOIN pieces ON u >= lo AND u < hi),
uses AS (SELECT place, n % blocks AS block, count(*) AS uses FROM ranked WHERE n // blocks < 2 GROUP BY ALL),
laid AS (
  SELECT doc_id, size, source_size, target, place, coalesce(sum(size) OVER (PARTITION BY place ORDER BY ord, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS begin, row_number() OVER () AS r
  FROM docs JOIN spans ON docs.source IS NOT DISTINCT FROM spans.source),
parts AS (SELECT r, place, unnest(range(begin // 64, (begin + size - 1) // 64 + 1)) AS block, begin, size FROM laid WHERE size > 0),
taken AS (SELECT r, sum((least(begin + size, 64 * block + 64) - greatest(begin, 64 * block)) * uses)::BIGINT AS taken FROM parts JOIN uses USING (place, block) GROUP BY r)
SELECT doc_id, size, source_size, round(target + 1e-9::DOUBLE, 6) AS target, coalesce(taken, 0) AS taken FROM laid LEFT JOIN taken USING (r)
"""

#: Counts of every order are sums over the distinct quads of bytes, in hexadecimal digits.
_QUAD_PARTS = {
    "total": "''",
    "uni": "substr(quad, 7, 2)",
    "first": "substr(quad, 5, 2)",
    "bi": "substr(quad, 5, 4)",
    "second": "substr(quad, 3, 4)",
    "tri": "substr(quad, 3, 6)",
    "third": "substr(quad, 1, 6)",
    "quad": "quad",
}
_QUAD_SUMS = ", ".join(f"(sum({m}) OVER (PARTITION BY {key}))::DOUBLE AS {m}_{name}" for name, key in _QUAD_PARTS.items() for m in "ta")
_LOSSES = ", ".join(f"round(coalesce({x} / greatest(n, 1), 0) + 1e-9::DOUBLE, 6) AS loss_{name}" for name, x in (("target", "t"), ("background", "a"), ("difference", "(t - a)")))
OP4 = rf"""
WITH docs AS (
  SELECT row_number() OVER () AS r, doc_id, octet_length(encode(coalesce(text, ''))) AS n, '0A0A0A' || hex(encode(coalesce(text, ''))) AS h,
         coalesce(doc_id IN (SELECT doc_id FROM labels WHERE quality = 1), false) AS target
  FROM documents),
quads AS (
  SELECT r, target, substr(h, 2 * i + 1, 8) AS quad, count(*) AS n
  FROM (SELECT r, target, h, unnest(range(n)) AS i FROM docs) GROUP BY ALL),
counts AS (SELECT quad, coalesce(sum(n) FILTER (target), 0) AS t, sum(n) AS a FROM quads GROUP BY quad),
sums AS (
  SELECT quad, {_QUAD_SUMS} FROM counts),
p1 AS (SELECT *, (t_uni + 1) / (t_total + 256) AS t1, (a_uni + 1) / (a_total + 256) AS a1 FROM sums),
p2 AS (SELECT *, (t_bi + 4 * t1) / (t_first + 4) AS t2, (a_bi + 4 * a1) / (a_first + 4) AS a2 FROM p1),
p3 AS (SELECT *, (t_tri + 4 * t2) / (t_second + 4) AS t3, (a_tri + 4 * a2) / (a_second + 4) AS a3 FROM p2),
bits AS (SELECT quad, -log2((t_quad + 4 * t3) / (t_third + 4)) AS t, -log2((a_quad + 4 * a3) / (a_third + 4)) AS a FROM p3),
scored AS (SELECT r, sum(n * t) AS t, sum(n * a) AS a FROM quads JOIN bits USING (quad) GROUP BY r)
SELECT doc_id, n AS n_tokens, {_LOSSES}
FROM docs LEFT JOIN scored USING (r)
"""

#: Quartiles over values cut to six leading bits, by language and source, by language, and over all.
OP8 = r"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, lang, source, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
lines AS (
  SELECT r, count(*) - count(DISTINCT line) AS n_dup_lines
  FROM (SELECT r, unnest(string_split(text, chr(10))) AS line FROM docs) WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY r),
places AS (SELECT r, i, array_to_string(w[i : i + 4], ' ') AS five FROM (SELECT r, w, unnest(range(1, len(w) - 3)) AS i FROM docs)),
twice AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, five) AS n FROM places) WHERE n > 1),
covered AS (SELECT r, count(DISTINCT i + k) AS n_repeat_words FROM twice CROSS JOIN range(5) s(k) GROUP BY r),
counted AS (
  SELECT r, doc_id, lang, source, len(w)::BIGINT AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
         (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
         coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words
  FROM docs LEFT JOIN lines USING (r) LEFT JOIN covered USING (r)),
judged AS (
  SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
         CASE WHEN n_words > 0 THEN [1000 * n_symbols // n_words, 1000 * n_dup_lines // n_words, floor(greatest(0, 100 * word_chars / n_words - 400 / sqrt(n_words)))::BIGINT] END AS v
  FROM counted),
measured AS (
  SELECT lang, source, m, CASE WHEN x < 64 THEN x ELSE (x >> (floor(log2(x))::INT - 5)) << (floor(log2(x))::INT - 5) END AS x
  FROM (SELECT lang, source, unnest([1, 2, 3]) AS m, unnest(v) AS x FROM judged WHERE NOT base_failed)),
fences AS (
  SELECT *, q3 + 3 * (q3 - q1) + [100, 30, 100][m] AS fence FROM (
    SELECT lang, source, m, grouping(lang, source) AS level, count(*) AS n, quantile_disc(x, 0.25) AS q1, quantile_disc(x, 0.75) AS q3
    FROM measured GROUP BY GROUPING SETS ((lang, source, m), (lang, m), (m)))),
limits AS (
  SELECT j.r, f.m, arg_min(f.fence, f.level) FILTER (f.n >= 200 OR f.level = 3) AS fence
  FROM judged j JOIN fences f ON (f.level = 3 OR f.lang IS NOT DISTINCT FROM j.lang) AND (f.level > 0 OR f.source IS NOT DISTINCT FROM j.source) GROUP BY ALL),
inside AS (SELECT r, bool_and(v[m] <= fence) AS ok FROM judged JOIN limits USING (r) GROUP BY r)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND coalesce(ok, true) AS kept
FROM judged LEFT JOIN inside USING (r)
"""

_WORDS = "list_filter(string_split(regexp_replace(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^a-z0-9\\x{80}-\\x{10FFFF}]', ' ', 'g'), ' '), lambda x: x <> '')"


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


_TEMPLATES = ", ".join(f"({t}, {_quoted(name)}, {_quoted(text)})" for t, (name, text) in enumerate(TEMPLATES))
#: All stretches of texts with enough pairs of words that a template has.
OP9 = f"""
WITH templates AS (SELECT t, name, {_WORDS} AS w FROM (VALUES {_TEMPLATES}) v(t, name, text)),
sizes AS (SELECT t, name, len(w) - 1 AS size FROM templates),
bags AS (SELECT t, w[i] || ' ' || w[i + 1] AS pair, count(*) AS own FROM (SELECT t, w, unnest(range(1, len(w))) AS i FROM templates) GROUP BY ALL),
docs AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS w FROM documents),
pairs AS (SELECT r, n, i, w[i + 1] || ' ' || w[i + 2] AS pair FROM (SELECT r, w, len(w) - 1 AS n, unnest(range(len(w) - 1)) AS i FROM docs)),
hits AS (SELECT r, n, t, i, pair, own FROM pairs JOIN bags USING (pair)),
fits AS (SELECT r, t, size FROM hits JOIN sizes USING (t) GROUP BY ALL HAVING 3 * count(*) >= 2 * size),
starts AS (SELECT DISTINCT r, t, size, n, unnest(range(i - size + 1, i + 1)) AS s FROM hits JOIN fits USING (r, t)),
shared AS (SELECT r, t, size, s.n, s, pair, least(count(*), own) AS m FROM starts s JOIN hits USING (r, t) WHERE i >= s AND i < s + size GROUP BY r, t, size, s.n, s, pair, own),
found AS (SELECT r, t, size, greatest(s, 0) AS first_word, 2 * sum(m) / (least(s + size, n) - greatest(s, 0) + size) AS dice FROM shared GROUP BY r, t, size, n, s),
best AS (SELECT r, t, first_word, dice FROM found WHERE dice >= 0.8::DOUBLE QUALIFY row_number() OVER (PARTITION BY r ORDER BY dice DESC, size DESC, t, first_word) = 1)
SELECT doc_id, name AS license, round(coalesce(dice, 0) + 1e-9::DOUBLE, 6) AS dice, CAST(first_word AS BIGINT) AS first_word
FROM docs LEFT JOIN best USING (r) LEFT JOIN sizes USING (t)
"""

#: CRC32 has no function in DuckDB: its table of 256 entries by its rule, then one entry for each byte.
_CRC_TABLE = "crc_table AS MATERIALIZED (SELECT list(x ORDER BY i) AS tab FROM (SELECT i, list_reduce(list_concat([i], range(8)), lambda x, k: xor(x >> 1, 3988292384 * (x & 1))) AS x FROM range(256) r(i)))"


def _crc32(text: str) -> str:
    """SQL for the CRC32 of a text, where crc_table is joined."""
    octets = f"list_transform(range(octet_length(encode({text}))), lambda k: ('0x' || hex(encode({text}))[2 * k + 1 : 2 * k + 2])::BIGINT)"
    return f"xor(list_reduce(list_concat([4294967295], {octets}), lambda x, y: xor(x >> 8, tab[xor(x & 255, y) + 1])), 4294967295)"


#: Near words share what is left of them after a deletion at the same place, or one is what is left of the other.
OP11 = rf"""
WITH RECURSIVE {_CRC_TABLE},
runs AS (
  SELECT w, s, count(*) AS m FROM (
    SELECT w, coalesce(CAST(doc_id AS VARCHAR), '') || ':' || w AS s FROM (
      SELECT doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS w FROM documents))
  GROUP BY ALL),
hashed AS (SELECT w, m, {_crc32("s")} AS h FROM runs, crc_table),
slips AS (SELECT m, CASE WHEN h % 199 = 0 THEN substr(w, 1, h % length(w)) || substr(w, h % length(w) + 2) ELSE w END AS word FROM hashed),
words AS (SELECT word, CAST(sum(m) AS BIGINT) AS n FROM slips WHERE length(word) >= 6 GROUP BY word HAVING sum(m) >= 5),
cut AS (SELECT word, k, substr(word, 1, k) || substr(word, k + 2) AS rest FROM (SELECT word, unnest(range(length(word))) AS k FROM words)),
pairs AS (
  SELECT a.word AS a, b.word AS b FROM cut a JOIN cut b ON a.k = b.k AND a.rest = b.rest AND a.word <> b.word
  UNION SELECT cut.word, words.word FROM cut JOIN words ON cut.rest = words.word
  UNION SELECT words.word, cut.word FROM cut JOIN words ON cut.rest = words.word),
near AS (SELECT a, count(*) AS n_near, arg_min(b, struct_pack(x := -n, y := encode(b))) AS b FROM pairs JOIN words ON b = word GROUP BY a),
formed AS (
  SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN f.n >= 5 * w.n THEN f.word END AS form, CASE WHEN f.n >= 5 * w.n THEN f.n END AS form_n
  FROM words w LEFT JOIN near ON a = w.word LEFT JOIN words f ON f.word = b),
walk(word, reached) AS (SELECT word, word FROM formed UNION ALL SELECT walk.word, form FROM walk JOIN formed ON formed.word = walk.reached WHERE form IS NOT NULL)
SELECT formed.word, formed.n, formed.n_near, formed.form, formed.form_n, walk.reached AS root
FROM formed JOIN walk ON walk.word = formed.word JOIN formed l ON l.word = walk.reached AND l.form IS NULL
"""

_TURN = "md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))"
#: Every node is an ancestor of itself; ancestors are the prefixes of its smallest member.
OP12 = rf"""
WITH {_CRC_TABLE},
turns AS (SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, {_TURN}) AS pos, {_TURN} AS turn, length(coalesce(text, '')) AS tokens FROM conversations WHERE conv_id IS NOT NULL),
counts AS (SELECT c, CAST(c AS VARCHAR) AS s, count(*) AS n FROM turns GROUP BY c),
convs AS (SELECT c, n, c - c % 100 AS base, {_crc32("s")} % 6 AS h FROM counts, crc_table),
rebuilt AS (
  SELECT v.c, t.pos AS depth, turn, tokens FROM convs v JOIN turns t ON t.c = v.base AND t.pos <= h
  UNION ALL SELECT v.c, least(v.h, coalesce(b.n, 0)) + t.pos - v.h, turn, tokens FROM convs v JOIN turns t ON t.c = v.c AND t.pos > v.h LEFT JOIN convs b ON b.c = v.base),
paths AS (
  SELECT c, depth, tokens, md5(string_agg(turn, ',') OVER (PARTITION BY c ORDER BY depth)) AS node FROM rebuilt
  UNION ALL SELECT c, 0, 0, 'root' FROM convs),
nodes AS (SELECT depth, node, min(c) AS owner, count(*) AS n_convs, max(tokens) AS tokens FROM paths GROUP BY ALL),
edges AS (SELECT DISTINCT a.node, b.node AS parent FROM paths a JOIN paths b ON a.c = b.c AND b.depth = a.depth - 1),
children AS (SELECT parent, count(*) AS n_children FROM edges GROUP BY parent),
valued AS (SELECT depth, node, owner, n_convs, coalesce(n_children, 0) AS n_children, (n_convs - 1) * tokens AS saved FROM nodes LEFT JOIN children ON parent = node),
sums AS (
  SELECT p.node, CAST(sum(CASE WHEN n_children = 0 THEN 1 ELSE 0 END) AS BIGINT) AS n_leaves, CAST(sum(saved) AS BIGINT) AS saved_tokens
  FROM valued v JOIN paths p ON p.c = v.owner AND p.depth <= v.depth GROUP BY p.node),
ends AS (SELECT node, sha256(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c)) AS sha FROM (SELECT c, arg_max(node, depth) AS node FROM paths GROUP BY c) GROUP BY node)
SELECT v.owner AS conv_id, CAST(v.depth AS BIGINT) AS depth, p.owner AS parent_conv_id, v.n_convs, v.n_children, n_leaves, saved_tokens, coalesce(sha, sha256('')) AS ends_sha256
FROM valued v JOIN sums USING (node) LEFT JOIN ends USING (node) LEFT JOIN edges USING (node) LEFT JOIN nodes p ON p.node = edges.parent
"""

#: All pairs of a query with a row.
OP13 = """
WITH v AS (
  SELECT row_number() OVER () AS r, vec_id, embedding::DOUBLE[] AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
pairs AS (SELECT q.r, q.vec_id AS query_id, v.vec_id, list_dot_product(q.e, v.e) AS score FROM v q JOIN v ON q.vec_id % 20 = 0 AND q.r <> v.r AND len(q.e) = len(v.e))
SELECT query_id, CAST(row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id) AS INT) AS rank, vec_id, score FROM pairs
QUALIFY row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id) <= 20
"""

ORACLES = {"op1_url_filter": OP1, "op2_embedding_near_dedup": OP2, "op4_lm_scoring": OP4, "op5_source_mix": OP5, "op8_quality_rules": OP8, "op9_license_scan": OP9, "op11_spelling_variants": OP11, "op12_prefix_trie": OP12, "op13_nearest_neighbours": OP13}
