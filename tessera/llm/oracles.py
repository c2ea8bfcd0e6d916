"""The corpus queries in DuckDB's SQL, where SQL can say them."""

from __future__ import annotations

OP1 = r"""
WITH lines AS (
  SELECT doc_id, i, l[i] AS line, CAST('0x' || left(md5(l[i]), 7) AS BIGINT) AS v, len(l) AS n_lines
  FROM (SELECT doc_id, l, unnest(range(1, len(l) + 1)) AS i FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents))
), cuts AS (
  SELECT *, coalesce((31 * lag(v) OVER w + v) % 3 = 0, false) AS is_end FROM lines WINDOW w AS (PARTITION BY doc_id ORDER BY i)
), numbered AS (
  SELECT *, coalesce(sum(CAST(is_end AS INT)) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS k FROM cuts
), chunks AS (
  SELECT doc_id, k, min(i) AS start, count(*) AS n, string_agg(line, chr(10) ORDER BY i) AS t FROM numbered GROUP BY doc_id, k
), gone AS (
  SELECT doc_id, k FROM (SELECT *, row_number() OVER (PARTITION BY t ORDER BY doc_id, start) AS r FROM chunks WHERE n >= 2) WHERE r > 1
)
SELECT doc_id, CAST(any_value(n_lines) AS BIGINT) AS n_lines, CAST(count(g.doc_id) AS BIGINT) AS n_removed,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (g.doc_id IS NULL), '')) AS kept_sha256
FROM numbered LEFT JOIN gone g USING (doc_id, k) GROUP BY doc_id
"""

_SHARE = """
  SELECT {path}, least(capacity, greatest(CAST(CASE WHEN is_full THEN capacity ELSE floor(weight * water) END AS BIGINT), 0)) AS given FROM (
    SELECT *, min(CASE WHEN NOT is_full THEN struct_pack(r := r, lv := lv) END) OVER (PARTITION BY {parent}).lv AS water FROM (
      SELECT *, capacity <= weight * lv AS is_full FROM (
        SELECT *, (given - coalesce(sum(capacity) OVER b, 0)) / CAST(sum(weight) OVER (PARTITION BY {parent}) - coalesce(sum(weight) OVER b, 0) AS DOUBLE) AS lv, row_number() OVER o AS r
        FROM ({nodes}) WHERE weight > 0
        WINDOW o AS (PARTITION BY {parent} ORDER BY CAST(capacity AS DOUBLE) / weight, {child}), b AS (PARTITION BY {parent} ORDER BY CAST(capacity AS DOUBLE) / weight, {child} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
      )
    )
  )
"""
OP2 = rf"""
WITH own AS (
  SELECT doc_id, coalesce(lang, '') AS lang, coalesce(source, '') AS source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS n_tokens,
    CASE WHEN num = '' THEN 'other' WHEN length(num) = 1 THEN CASE WHEN num < '5' THEN 'web' ELSE 'books' END WHEN num < '15' THEN 'code' ELSE 'news' END AS domain
  FROM (SELECT *, regexp_extract(coalesce(source, ''), '([0-9]+)$', 1) AS num FROM documents)
), leaves AS (SELECT domain, lang, source, sum(n_tokens)::BIGINT AS tokens FROM own GROUP BY ALL),
g0 AS (SELECT floor(sum(tokens) * 80 / 100)::BIGINT AS given FROM leaves),
g1 AS ({_SHARE.format(path="domain", parent="1", child="domain", nodes="SELECT domain, sum(tokens)::BIGINT * 2 AS capacity, CASE domain WHEN 'web' THEN 40 WHEN 'books' THEN 30 WHEN 'code' THEN 20 WHEN 'news' THEN 10 ELSE 1 END AS weight, any_value(g0.given) AS given FROM leaves, g0 GROUP BY domain")}),
g2 AS ({_SHARE.format(path="domain, lang", parent="domain", child="lang", nodes="SELECT domain, lang, sum(tokens)::BIGINT * 2 AS capacity, CASE lang WHEN 'en' THEN 50 WHEN 'de' THEN 20 WHEN 'fr' THEN 20 WHEN 'es' THEN 10 ELSE 1 END AS weight, any_value(g1.given) AS given FROM leaves JOIN g1 USING (domain) GROUP BY domain, lang")}),
g3 AS ({_SHARE.format(path="domain, lang, source", parent="domain, lang", child="source", nodes="SELECT domain, lang, source, sum(tokens)::BIGINT * 2 AS capacity, 1 AS weight, any_value(g2.given) AS given FROM leaves JOIN g2 USING (domain, lang) GROUP BY domain, lang, source")}),
allotted AS (SELECT domain, lang, source, given // tokens AS whole, given % tokens AS rest FROM leaves JOIN g3 USING (domain, lang, source) WHERE given > 0),
taken AS (
  SELECT o.*, whole, rest, sum(n_tokens) OVER (PARTITION BY domain, lang, source ORDER BY md5('1:' || whole || ':' || doc_id), doc_id ROWS UNBOUNDED PRECEDING) AS upto
  FROM own o JOIN allotted USING (domain, lang, source) WHERE n_tokens > 0
)
SELECT doc_id, o.domain, o.lang, o.source, CAST(o.n_tokens AS BIGINT) AS n_tokens, CAST(coalesce(t.whole + CASE WHEN upto <= rest THEN 1 ELSE 0 END, 0) AS BIGINT) AS copies
FROM own o LEFT JOIN taken t USING (doc_id)
"""

_JS = "sqrt(greatest(0, list_sum(list_transform(range(1, len({c}) + 1), lambda i: (CASE WHEN {c}[i] > 0 THEN ({c}[i] / {cs}) * log2(2 * ({c}[i] / {cs}) / ({c}[i] / {cs} + {r}[i] / {rs})) ELSE 0 END + CASE WHEN {r}[i] > 0 THEN ({r}[i] / {rs}) * log2(2 * ({r}[i] / {rs}) / ({c}[i] / {cs} + {r}[i] / {rs})) ELSE 0 END) / 2))))"
OP3 = rf"""
WITH lists(lang, l) AS (VALUES
  ('en', string_split('the of and to a in is that it for was on with as by be this are at from', ' ')), ('fr', string_split('de la le et les des en un du que une pour est dans qui pas par sur au avec', ' ')),
  ('de', string_split('der die und in den von zu das mit sich des auf für nicht ist im dem ein eine als', ' ')), ('es', string_split('de la que el en y los se las del con un por no su una para es al lo', ' '))
), docs AS (
  SELECT doc_id, d.lang, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w, lists.l,
    regexp_extract_all(translate(lower(coalesce(text, '')), '.,;:!?', '      '), '[^\x20\x09-\x0D]+') AS bare,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM documents d LEFT JOIN lists ON lists.lang = d.lang
), win AS (
  SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, k) AS c FROM (SELECT doc_id, i, array_to_string(w[i : i + 4], ' ') AS k FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM docs WHERE len(w) > 5))
), rep AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + 5)) AS p FROM win WHERE c > 1) GROUP BY doc_id),
r1 AS (SELECT *, regexp_replace(t, '[\p{{Ll}}\p{{Lm}}\p{{Lo}}\p{{Lt}}]+', '', 'g') AS a1 FROM docs),
r2 AS (SELECT *, regexp_replace(a1, '[\x20\x09-\x0D]+', '', 'g') AS a2 FROM r1), r3 AS (SELECT *, regexp_replace(a2, '\p{{Lu}}+', '', 'g') AS a3 FROM r2),
r4 AS (SELECT *, regexp_replace(a3, '[.,]+', '', 'g') AS a4 FROM r3), r5 AS (SELECT *, regexp_replace(a4, '[0-9]+', '', 'g') AS a5 FROM r4),
r6 AS (SELECT *, regexp_replace(a5, '[#*$%&|<>]+', '', 'g') AS a6 FROM r5),
h AS (
  SELECT doc_id, lang, w, l, lines, [length(t) - length(a1), length(a1) - length(a2), length(a2) - length(a3), length(a3) - length(a4), length(a4) - length(a5), length(a5) - length(a6), length(a6)] AS cls,
    length(t) - (length(a1) - length(a2)) AS word_chars, length(a5) - length(a6) AS n_symbols,
    CASE WHEN l IS NULL THEN NULL ELSE list_append(list_transform(l, lambda c: len(list_filter(bare, lambda x: x = c))), len(list_filter(bare, lambda x: NOT list_contains(l, x)))) END AS com, len(bare) AS listed
  FROM r6
), ref AS (
  SELECT lang, list(s ORDER BY i) AS v, kind FROM (
    SELECT lang, i, 'cls' AS kind, sum(cls[i]) AS s FROM h, range(1, 8) t(i) WHERE com IS NOT NULL AND listed >= 60 GROUP BY lang, i
    UNION ALL SELECT lang, i, 'com', sum(com[i]) FROM h, range(1, 22) t(i) WHERE com IS NOT NULL AND listed >= 60 GROUP BY lang, i) GROUP BY lang, kind
), both_ AS (
  SELECT h.*, a.v AS rc, b.v AS rw, coalesce(rep.n, 0) AS n_rep, CAST(list_sum(cls) AS DOUBLE) AS cs, CAST(listed AS DOUBLE) AS ws, CAST(list_sum(a.v) AS DOUBLE) AS rcs, CAST(list_sum(b.v) AS DOUBLE) AS rws
  FROM h LEFT JOIN ref a ON a.lang = h.lang AND a.kind = 'cls' LEFT JOIN ref b ON b.lang = h.lang AND b.kind = 'com' LEFT JOIN rep USING (doc_id)
), js AS (
  SELECT *, CASE WHEN com IS NOT NULL AND listed >= 60 THEN {_JS.format(c="cls", cs="cs", r="rc", rs="rcs")} END AS jc, CASE WHEN com IS NOT NULL AND listed >= 60 THEN {_JS.format(c="com", cs="ws", r="rw", rs="rws")} END AS jw,
    (len(w) < 10 OR 100 * n_rep > 20 * len(w)) AS base FROM both_
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols, CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
  CAST(n_rep AS BIGINT) AS n_repeat_words, base AS base_failed, round(jc, 4) AS js_chars, round(jw, 4) AS js_words, NOT base AND NOT coalesce(jc > 0.25 OR jw > 0.22 + 1.0 / sqrt(listed), false) AS kept
FROM js
"""

OP5 = r"""
WITH own AS (
  SELECT CAST(item_id AS VARCHAR) AS item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), items AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i : i + 9], ' ') AS win
  FROM (SELECT item_id, w, unnest(range(1, greatest(1, len(w) - 9) + 1)) AS i FROM own WHERE len(w) > 0)
), docs AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), lengths AS (SELECT DISTINCT n FROM items), seen AS (
  SELECT doc_id, i, n, array_to_string(w[i : i + n - 1], ' ') AS win
  FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM docs) CROSS JOIN lengths WHERE i + n - 1 <= len(w)
), hits AS (SELECT doc_id, i, seen.n, item_id FROM seen JOIN items ON seen.n = items.n AND seen.win = items.win),
places AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hits) GROUP BY doc_id),
found AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id, ',' ORDER BY item_id) AS names FROM hits GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM docs LEFT JOIN places USING (doc_id) LEFT JOIN found USING (doc_id)
"""

OP7 = r"""
WITH parts AS (
  SELECT page_id, coalesce(url, '') AS url, CASE WHEN strpos(coalesce(url, ''), '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest,
    CASE WHEN strpos(coalesce(url, ''), '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE coalesce(url, '') END AS bare FROM pages
), split AS (
  SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path,
    regexp_replace(regexp_replace(lower(bare), '[0-9]', '0', 'g'), '[^\x20-\x7E]', '~', 'g') AS folded FROM parts
), judged AS (
  SELECT page_id, host, path, folded, CASE
    WHEN (host = 'example.net' OR ends_with(host, '.example.net')) AND starts_with(path, '/en/') THEN 'example.net/en/'
    WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/de/') THEN 'example.com/de/'
    WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/fr/') THEN 'org/fr/'
    WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/') THEN 'net/' END AS rule FROM split
), labelled AS (
  SELECT *, CASE WHEN rule IN ('example.net/en/', 'org/fr/') THEN 'allow' WHEN rule IS NULL THEN '' ELSE 'block' END AS label FROM judged
), urls AS (SELECT folded, label, count(*) AS n FROM labelled GROUP BY folded, label),
steps AS (SELECT folded, label, n, substr('^^^' || folded, i, 4) AS gram FROM (SELECT *, unnest(range(1, length(folded) + 1)) AS i FROM urls)),
counts AS (SELECT gram, coalesce(sum(n) FILTER (label = 'allow'), 0) AS a, coalesce(sum(n) FILTER (label = 'block'), 0) AS r FROM steps GROUP BY gram),
seen AS (SELECT * FROM counts WHERE a + r > 0),
g AS (SELECT k, right(gram, k + 1) AS g, sum(a) AS ga, sum(r) AS gr FROM seen CROSS JOIN range(0, 4) t(k) GROUP BY ALL),
x AS (SELECT k, left(g, k) AS x, sum(ga) AS xa, sum(gr) AS xr, count(*) FILTER (ga > 0) AS ta, count(*) FILTER (gr > 0) AS tr FROM g GROUP BY ALL),
p AS (
  SELECT gram, list(struct_pack(ga := coalesce(ga, 0)::DOUBLE, gr := coalesce(gr, 0)::DOUBLE, xa := coalesce(xa, 0)::DOUBLE, xr := coalesce(xr, 0)::DOUBLE, ta := coalesce(ta, 0)::DOUBLE, tr := coalesce(tr, 0)::DOUBLE) ORDER BY t.k) AS l
  FROM counts CROSS JOIN range(0, 4) t(k) LEFT JOIN g ON g.k = t.k AND g.g = right(gram, (t.k + 1)) LEFT JOIN x ON x.k = t.k AND x.x = left(right(gram, (t.k + 1)), t.k) GROUP BY gram
), p0 AS (SELECT gram, l, 1.0::DOUBLE / 70 AS a, 1.0::DOUBLE / 70 AS r FROM p),
p1 AS (SELECT gram, l, CASE WHEN l[1].xa = 0 THEN a ELSE (l[1].ga + l[1].ta * a) / (l[1].xa + l[1].ta) END AS a, CASE WHEN l[1].xr = 0 THEN r ELSE (l[1].gr + l[1].tr * r) / (l[1].xr + l[1].tr) END AS r FROM p0),
p2 AS (SELECT gram, l, CASE WHEN l[2].xa = 0 THEN a ELSE (l[2].ga + l[2].ta * a) / (l[2].xa + l[2].ta) END AS a, CASE WHEN l[2].xr = 0 THEN r ELSE (l[2].gr + l[2].tr * r) / (l[2].xr + l[2].tr) END AS r FROM p1),
p3 AS (SELECT gram, l, CASE WHEN l[3].xa = 0 THEN a ELSE (l[3].ga + l[3].ta * a) / (l[3].xa + l[3].ta) END AS a, CASE WHEN l[3].xr = 0 THEN r ELSE (l[3].gr + l[3].tr * r) / (l[3].xr + l[3].tr) END AS r FROM p2),
p4 AS (SELECT gram, CASE WHEN l[4].xa = 0 THEN a ELSE (l[4].ga + l[4].ta * a) / (l[4].xa + l[4].ta) END AS a, CASE WHEN l[4].xr = 0 THEN r ELSE (l[4].gr + l[4].tr * r) / (l[4].xr + l[4].tr) END AS r FROM p3),
scored AS (SELECT folded, label, n, round(avg(ln(a) - ln(r)), 6) AS score FROM steps JOIN p4 USING (gram) GROUP BY folded, label, n),
bins AS (SELECT floor(score * 100) AS bin, coalesce(sum(n) FILTER (label = 'allow'), 0) AS a, coalesce(sum(n) FILTER (label = 'block'), 0) AS b FROM scored WHERE label <> '' GROUP BY 1),
errors AS (
  SELECT greatest(coalesce(lag(bin) OVER (ORDER BY bin) + 1, least(bin, 0)), least(bin, 0)) / 100 AS lim, coalesce(sum(a) OVER w, 0) AS lost, sum(b) OVER () - coalesce(sum(b) OVER w, 0) AS let, sum(a) OVER () AS all_a, sum(b) OVER () AS all_b
  FROM bins WINDOW w AS (ORDER BY bin ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), best AS (SELECT lim FROM errors WHERE all_a > 0 AND all_b > 0 ORDER BY round(lost / all_a + let / all_b, 9), abs(lim), lim LIMIT 1)
SELECT page_id, host, path, rule, CASE WHEN l.label <> '' THEN l.label WHEN coalesce(score, 0) >= coalesce((SELECT lim FROM best), 0) THEN 'allow' ELSE 'block' END AS verdict
FROM labelled l LEFT JOIN scored s ON s.label = '' AND s.folded = l.folded
"""

SQL = {"op1_line_dedup": OP1, "op2_source_mixing": OP2, "op7_url_filter": OP7, "op3_quality_rules": OP3, "op5_benchmark_decontamination": OP5}
