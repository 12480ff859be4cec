"""SQL of the text queries for DuckDB, over the same tables."""

from __future__ import annotations

ASCII = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"
LOWER = f"translate(coalesce(text, ''), {ASCII})"


def words(text: str) -> str:
    return rf"regexp_extract_all({text}, '[^\x20\x09-\x0D]+')"


def symbol_words(text: str) -> str:
    return rf"regexp_extract_all({text}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"


ORACLE = {}

ORACLE["op2_mixture"] = f"""
WITH d AS (SELECT doc_id, source, len({words("coalesce(text, '')")}) AS size FROM documents),
s AS (SELECT source, count(*) AS n_rows, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY 1),
w AS (SELECT *, ([5, 2, 1])[1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS weight, 3 * source_size AS cap FROM s),
o AS (SELECT *, sum(source_size) OVER () AS total, sum(weight) OVER () AS all_weight,
  coalesce(sum(cap) OVER f, 0) AS caps_before, coalesce(sum(weight) OVER f, 0) AS weight_before
  FROM w WINDOW f AS (ORDER BY CAST(cap AS DOUBLE) / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
l AS (SELECT *, (CAST(total AS DOUBLE) - CAST(caps_before AS DOUBLE)) / CAST(all_weight - weight_before AS DOUBLE) AS level FROM o),
f AS (SELECT arg_min(level, weight_before) AS level FROM l WHERE level * weight <= cap),
t AS (SELECT w.*, CASE WHEN source_size = 0 THEN 0.0 WHEN f.level IS NULL THEN CAST(cap AS DOUBLE) ELSE least(CAST(cap AS DOUBLE), f.level * weight) END AS target FROM w LEFT JOIN f ON true),
r AS (SELECT d.doc_id, d.size, t.source_size, t.target, CASE WHEN t.source_size > 0 THEN t.target / CAST(t.source_size AS DOUBLE) ELSE 0.0 END AS rate, md5('0|offset|' || coalesce(d.source, '')) AS u,
  row_number() OVER (PARTITION BY d.source ORDER BY (length(bin(d.size + 1)) - 1) * 4 + CAST(floor((d.size + 1) * 4 / pow(2.0, length(bin(d.size + 1)) - 1)) AS INTEGER), md5('0|' || coalesce(CAST(d.doc_id AS VARCHAR), '')), d.size) AS i FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
v AS (SELECT *, list_sum(list_transform(range(1, 9), lambda k: (strpos('0123456789abcdef', substr(u, k, 1)) - 1) * CAST(pow(16, 8 - k) AS BIGINT))) / 4294967296.0::DOUBLE AS x FROM r)
SELECT doc_id, size, source_size, target, CAST(size * least(3, floor(rate * i + x) - floor(rate * (i - 1) + x)) AS BIGINT) AS taken FROM v"""

ORACLE["op4_repeated_passages"] = f"""
WITH d AS (SELECT doc_id, md5(coalesce(text, '')) AS t, {words(LOWER)} AS w FROM documents),
x AS (SELECT t, any_value(w) AS w, count(*) AS n_rows FROM d GROUP BY 1),
g AS (SELECT t, n_rows, i, md5(array_to_string(w[i:i + 49], ' ')) AS h FROM x, unnest(range(1, len(w) - 48)) AS r(i)),
hit AS (SELECT t, i FROM g WHERE n_rows > 1 OR h IN (SELECT h FROM g GROUP BY h HAVING count(DISTINCT t) > 1)),
c AS (SELECT DISTINCT t, i + k - 1 AS p FROM hit, unnest(range(0, 50)) AS r(k)),
runs AS (SELECT t, p - row_number() OVER (PARTITION BY t ORDER BY p) AS run, p FROM c),
spans AS (SELECT t, min(p) AS a, max(p) + 1 AS b FROM runs GROUP BY t, run),
one AS (SELECT t, count(*) AS n, sum(b - a) AS covered, string_agg(a || '-' || b, ',' ORDER BY a) AS spans FROM spans GROUP BY t)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n, 0) AS n_spans, CAST(coalesce(covered, 0) AS BIGINT) AS n_repeated_words, coalesce(n, 0) > 0 AS repeated, coalesce(spans, '') AS spans
FROM d LEFT JOIN one USING (t)"""

ORACLE["op5_line_frequency"] = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, source, coalesce(text, '') AS text, {words("coalesce(text, '')")} AS w, list_filter(string_split(coalesce(text, ''), chr(10)), lambda l: len({words("l")}) > 0) AS lines FROM documents),
g AS (SELECT r, i, array_to_string(w[i:i + 7], ' ') AS h FROM d, unnest(range(1, len(w) - 6)) AS x(i)),
twice AS (SELECT r, i FROM g WHERE (r, h) IN (SELECT (r, h) FROM g GROUP BY r, h HAVING count(*) > 1)),
rep AS (SELECT r, count(DISTINCT i + k) AS n FROM twice, unnest(range(0, 8)) AS x(k) GROUP BY r),
norm AS (SELECT r, source, lines, list_transform(lines, lambda l: lower(array_to_string({words("l")}, ' '))) AS ls FROM d),
whole AS (SELECT *, array_to_string(list_sort(list_distinct(ls)), chr(10)) AS content FROM norm),
l AS (SELECT r, source, content, ls[i] AS line, len({words("lines[i]")}) AS n FROM whole, unnest(range(1, len(ls) + 1)) AS x(i)),
hosts AS (SELECT source, count(DISTINCT content) AS n_host FROM whole GROUP BY 1),
often AS (SELECT l.source, line FROM l JOIN hosts h ON l.source IS NOT DISTINCT FROM h.source GROUP BY l.source, line, n_host HAVING count(DISTINCT content) >= 20 AND count(DISTINCT content) > n_host * CAST(0.1 AS DOUBLE)),
gone AS (SELECT r, sum(n) AS n FROM l JOIN often o ON l.line = o.line AND l.source IS NOT DISTINCT FROM o.source GROUP BY r),
m AS (SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars, CAST(len(regexp_extract_all(text, '[#*$%&|<>]')) AS BIGINT) AS n_symbols,
  CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words, CAST(len(w) - coalesce(gone.n, 0) AS BIGINT) AS n_kept_words FROM d LEFT JOIN rep USING (r) LEFT JOIN gone USING (r))
SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed, NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AND n_kept_words >= 20 AS kept FROM m"""

ORACLE["op6_jaccard_classes"] = f"""
WITH RECURSIVE d AS (SELECT doc_id, {words(LOWER)} AS w FROM documents),
g AS (SELECT DISTINCT doc_id, md5(array_to_string(w[i:i + 3], ' ')) AS h FROM d, unnest(range(1, greatest(len(w) - 2, 2))) AS x(i) WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY 1),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM g a JOIN g b ON a.h = b.h AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM common JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
both_ways AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach AS (SELECT a, b FROM both_ways UNION SELECT r.a, e.b FROM reach r JOIN both_ways e ON r.b = e.a)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, least(d.doc_id, coalesce(min(r.b), d.doc_id)) AS component_id FROM d LEFT JOIN n USING (doc_id) LEFT JOIN reach r ON r.a = d.doc_id GROUP BY d.doc_id, n.n"""

ORACLE["op7_revisits"] = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages), q AS (SELECT *, strlen(h) AS n, max(page_id) OVER (PARTITION BY h) AS top FROM p)
SELECT page_id, n AS payload_bytes, sha1(h) AS payload_digest, CASE WHEN n >= 1000 AND page_id <> top THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN n >= 1000 AND page_id <> top THEN top END AS refers_to FROM q"""

ORACLE["op8_contamination"] = f"""
WITH b AS (SELECT CAST(item_id AS VARCHAR) AS item, {symbol_words(LOWER)} AS w FROM benchmark),
bw AS (SELECT DISTINCT item, array_to_string(w[i:i + least(10, len(w)) - 1], ' ') AS g, least(10, len(w)) AS n FROM b, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS x(i) WHERE len(w) > 0),
lens AS (SELECT DISTINCT n FROM bw),
d AS (SELECT doc_id, {symbol_words(LOWER)} AS w FROM documents),
dw AS (SELECT doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') AS g FROM d, lens, unnest(range(1, len(w) - n + 2)) AS x(i)),
hit AS (SELECT doc_id, i, n, item FROM dw JOIN bw USING (g, n)),
pos AS (SELECT doc_id, count(DISTINCT i + k) AS n_hit FROM (SELECT DISTINCT doc_id, i, n FROM hit), unnest(range(0, n)) AS x(k) GROUP BY 1),
its AS (SELECT doc_id, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS s FROM hit GROUP BY 1)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN pos USING (doc_id) LEFT JOIN its USING (doc_id)"""


ORACLE["op13_fill_in_middle"] = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, sha256('1:' || doc_id) AS h, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS w FROM documents),
v AS (SELECT *, [list_sum(list_transform(range(1, 9), lambda k: (strpos('0123456789abcdef', substr(h, 8 * g + k, 1)) - 1) * CAST(pow(16, 8 - k) AS BIGINT))) FOR g IN range(0, 4)] AS r FROM d),
c AS (SELECT *, CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR r[3] % 100 >= 90 THEN 'plain' WHEN r[4] % 100 < 20 THEN 'spm' ELSE 'psm' END AS form,
  CAST(least(r[1] % (len(w) + 1), r[2] % (len(w) + 1)) AS BIGINT) AS a, CAST(greatest(r[1] % (len(w) + 1), r[2] % (len(w) + 1)) AS BIGINT) AS b FROM v),
p AS (SELECT *, array_to_string(w[1:a], '') AS prefix, array_to_string(w[a + 1:b], '') AS middle, array_to_string(w[b + 1:], '') AS suffix FROM c)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256, sha256(text) AS restored_sha256
FROM p"""

ORACLE["op12_repeated_windows"] = f"""
WITH d AS (SELECT doc_id, {words("coalesce(text, '')")} AS w FROM documents),
g AS (SELECT doc_id, i, md5(array_to_string(w[i:i + 19], ' ')) AS h FROM d, unnest(range(1, len(w) - 18)) AS x(i)),
late AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY h ORDER BY doc_id, i) AS n FROM g) WHERE n > 1),
gone AS (SELECT doc_id, list(DISTINCT i + k) AS places FROM late, unnest(range(0, 20)) AS x(k) GROUP BY 1),
each AS (SELECT d.doc_id, p, w[p] AS word FROM d LEFT JOIN gone USING (doc_id), unnest(range(1, len(w) + 1)) AS x(p) WHERE NOT coalesce(list_contains(places, p), false)),
kept AS (SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY p) AS t FROM each GROUP BY 1)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (doc_id)"""
