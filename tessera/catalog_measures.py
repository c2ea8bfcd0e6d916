"""Queries that measure answers and texts, beside those of the catalog, which imports this module last."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators import domains, metrics
from tessera.registry import QUERIES, query, table

_GAP = r"[ \t\n\r\f\x0B]+"
_TOK = rf"list_filter(regexp_split_to_array({{}}, '{_GAP}'), lambda w: w <> '')"


def _turns(spark, d):
    """(id, question, answer, context): each turn of a conversation, the one before it, and that before."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    rows = table(spark, d, "conversations").select(F.concat_ws("-", "conv_id", "turn").alias("id"), F.lag("text").over(w).alias("question"), F.col("text").alias("answer"), F.lag("text", 2).over(w).alias("context"))
    return rows.where("question IS NOT NULL").withColumn("context", F.coalesce("context", "question"))


_TURNS = "(SELECT id, question, answer, coalesce(context, question) AS context FROM (SELECT conv_id || '-' || turn AS id, lag(text) OVER w AS question, text AS answer, lag(text, 2) OVER w AS context FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)) WHERE question IS NOT NULL)"
_COMMON = "[" + ", ".join(f"'{w}'" for w in metrics.COMMON) + "]"


@query(rf"""WITH t AS (SELECT *, {_TOK.format('question')} AS q, {_TOK.format('answer')} AS a, list_distinct({_TOK.format('lower(question)')}) AS lq, list_distinct({_TOK.format('lower(answer)')}) AS la, list_distinct({_TOK.format('lower(context)')}) AS lc,
    list_filter(list_transform(regexp_split_to_array(answer, '[.!?]{_GAP}'), lambda s: trim(s)), lambda s: s <> '') AS sent FROM {_TURNS}),
  u AS (SELECT *, list_filter(la, lambda w: NOT list_contains({_COMMON}, w)) AS fa, list_filter(lc, lambda w: NOT list_contains({_COMMON}, w)) AS fc,
    list_filter(sent, lambda s: len(list_intersect(list_distinct({_TOK.format('lower(s)')}), lc)) / greatest(len(list_distinct({_TOK.format('lower(s)')})), 1) < 0.5) AS weak FROM t)
  SELECT id, round(CASE WHEN len(fa) = 0 OR len(fc) = 0 THEN 0 ELSE len(list_intersect(fa, fc)) / len(fa) END, 6) AS faithfulness,
    round(CASE WHEN len(list_distinct(list_concat(lq, la))) = 0 THEN 0 ELSE len(list_intersect(lq, la)) / len(list_distinct(list_concat(lq, la))) END, 6) AS relevance,
    round(CASE WHEN len(sent) = 0 THEN 0 ELSE len(weak) / len(sent) END, 6) AS hallucination,
    round(CASE WHEN answer = '' OR question = '' THEN 0 WHEN len(a) <= len(q) THEN 0.5 WHEN len(a) <= 3 * len(q) THEN 1 WHEN len(q) = 0 THEN 0 ELSE greatest(0, 1 - (len(a) - 3 * len(q)) / (10 * len(q))) END, 6) AS conciseness,
    round(CASE WHEN answer = '' THEN 0 ELSE least(1, 0.5 + 0.1 * len(a) / 100) END, 6) AS coherence FROM u""")
def generation_measures(spark, d):
    return metrics.generation(_turns(spark, d), "question", "answer", "context").select("id", "faithfulness", "relevance", "hallucination", "conciseness", "coherence")


def _grams(w: str, n: int) -> str:
    return f"list_transform(range(1, len({w}) - {n} + 2), lambda i: array_to_string({w}[i : i + {n - 1}], ' '))"


def _match(n: int) -> str:
    return f"coalesce(list_sum(list_transform(list_distinct(c{n}), lambda g: least(len(list_filter(c{n}, lambda x: x = g)), len(list_filter(r{n}, lambda x: x = g))))), 0)"


@query(rf"""WITH t AS (SELECT id, {_TOK.format('answer')} AS c, {_TOK.format('question')} AS r FROM {_TURNS}), g AS (SELECT id, c, r, {', '.join(f"{_grams('c', n)} AS c{n}, {_grams('r', n)} AS r{n}" for n in range(1, 5))} FROM t),
  m AS (SELECT id, len(c) AS nc, len(r) AS nr, {', '.join(f"{_match(n)} AS m{n}" for n in range(1, 5))} FROM g)
  SELECT id, round(CASE WHEN nc < 4 OR nr < 4 OR m1 = 0 OR m2 = 0 OR m3 = 0 OR m4 = 0 THEN 0 ELSE (CASE WHEN nc >= nr THEN 1 ELSE exp(1 - nr / nc) END) * exp((ln(m1 / nc) + ln(m2 / (nc - 1)) + ln(m3 / (nc - 2)) + ln(m4 / (nc - 3))) / 4) END, 6) AS bleu FROM m""")
def bleu_of_turns(spark, d):
    return _turns(spark, d).select("id", F.round(metrics.bleu(F.col("answer"), F.col("question")), 6).alias("bleu"))


@query()
def rouge_of_turns(spark, d):
    """Longest common subsequences; held against a plain table of lengths in the tests."""
    return metrics.rouge_l(_turns(spark, d), "id", "answer", "question")


_TERMS = r"regexp_extract_all(lower({}), '[\p{{L}}\p{{N}}_]{{2,}}')"


def _tfidf_sql(pairs: str, key: str) -> str:
    """key and s, the cosine, of pairs(key, a, b)."""
    return f"""w AS (SELECT {key}, t, count(*) FILTER (s = 0) AS x, count(*) FILTER (s = 1) AS y FROM (SELECT {key}, unnest({_TERMS.format('a')}) AS t, 0 AS s FROM {pairs} UNION ALL SELECT {key}, unnest({_TERMS.format('b')}), 1 FROM {pairs}) GROUP BY ALL),
      z AS (SELECT {key}, CASE WHEN sum(x) = 0 OR sum(y) = 0 THEN 0 ELSE sum(x * y) / sqrt(sum(x * x * i * i) * sum(y * y * i * i)) END AS s FROM (SELECT *, CASE WHEN x > 0 AND y > 0 THEN 1.0::DOUBLE ELSE 1 + ln(1.5::DOUBLE) END AS i FROM w) GROUP BY {key})"""


@query(f"WITH p AS (SELECT id, question AS a, answer AS b FROM {_TURNS}), {_tfidf_sql('p', 'id')} SELECT id, round(coalesce(s, 0), 6) AS similarity FROM p LEFT JOIN z USING (id)")
def tfidf_of_turns(spark, d):
    return _turns(spark, d).select("id", F.round(T.tfidf_cosine(F.col("question"), F.col("answer")), 6).alias("similarity"))


def _content_sql() -> str:
    from tessera.registry import SQL

    return f"""WITH a AS ({SQL['vec_topk_cosine']}), b AS ({SQL['vec_topk_dot']}), r AS (SELECT query_id, id AS r, text AS b FROM a JOIN documents ON doc_id = id WHERE rank <= 3 AND text <> ''),
      t AS (SELECT query_id, id AS t, text AS a FROM b JOIN documents ON doc_id = id WHERE rank <= 3 AND text <> ''), p AS (SELECT query_id || ':' || r || ':' || t AS k, query_id, r, t, a, b FROM r JOIN t USING (query_id)),
      {_tfidf_sql('p', 'k')}, s AS (SELECT p.query_id, r, t, coalesce(s, 0) AS s FROM p LEFT JOIN z USING (k)),
      br AS (SELECT query_id, avg(CAST(m >= 0.5 AS INT)) AS p FROM (SELECT query_id, r, max(s) AS m FROM s GROUP BY ALL) GROUP BY query_id), bt AS (SELECT query_id, avg(CAST(m >= 0.5 AS INT)) AS q, avg(m) AS o FROM (SELECT query_id, t, max(s) AS m FROM s GROUP BY ALL) GROUP BY query_id),
      x AS (SELECT query_id, coalesce(p, 0) AS p, coalesce(q, 0) AS q, coalesce(o, 0) AS o FROM (SELECT query_id FROM r UNION SELECT query_id FROM t) LEFT JOIN br USING (query_id) LEFT JOIN bt USING (query_id))
      SELECT query_id, round(p, 6) AS content_precision, round(q, 6) AS content_recall, round(CASE WHEN p + q = 0 THEN 0 ELSE 2 * p * q / (p + q) END, 6) AS content_f1, round(100 * o, 4) AS content_overlap_percentage FROM x"""


@query(_content_sql())
def overlap_by_content(spark, d):
    """Texts that the cosine finds against those that the inner product finds."""
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("content")).where("content <> ''")
    side = lambda name: QUERIES[name](spark, d).where("rank <= 3").join(docs, "id").select("query_id", "content")
    return metrics.overlap_by_content(side("vec_topk_cosine"), side("vec_topk_dot"))


# --- whole systems


@query("SELECT round(avg(CAST(lower(trim(l_returnflag)) = CASE WHEN l_linenumber % 2 = 0 THEN 'r' ELSE 'n' END AS INT)), 6) AS rate FROM lineitem")
def task_completion(spark, d):
    rows = table(spark, d, "lineitem").withColumn("expected", F.when(F.col("l_linenumber") % 2 == 0, " R ").otherwise("n"))
    return metrics.task_completion(rows, "expected", "l_returnflag")


@query("SELECT CAST(r AS INT) AS rating, round((SELECT count(*) FROM part WHERE p_size = r) / (SELECT count(p_size) FROM part), 6) AS share FROM range(0, 6) t(r)")
def rating_shares(spark, d):
    return metrics.rating_shares(table(spark, d, "part"), "p_size")


@query("SELECT count(value) AS n, round(avg(value), 6) AS average_latency, round(count(value) * 1e6 / (epoch_us(max(ts)) - epoch_us(min(ts))), 6) AS throughput, round(quantile_cont(value, 0.5), 6) AS latency_p50, round(quantile_cont(value, 0.9), 6) AS latency_p90, round(quantile_cont(value, 0.99), 6) AS latency_p99 FROM events")
def efficiency(spark, d):
    return metrics.efficiency(table(spark, d, "events"), "value", "ts", "ts")


@query("SELECT round(s, 6) AS standard_score, round(a, 6) AS adversarial_score, round(CASE WHEN s > 0 THEN a / s ELSE 0 END, 6) AS robustness_ratio FROM (SELECT avg(value) FILTER (event_type <> 'error') AS s, avg(value) FILTER (event_type = 'error') AS a FROM events)")
def robustness(spark, d):
    return metrics.robustness(table(spark, d, "events"), "value", F.col("event_type") == "error")


@query("SELECT event_type, round((0.4 * c + 0.4 * s + 0.2 * r) / (0.4 + 0.4 + 0.2), 6) AS overall, round((0.4 * c + 0.4 * s) / (0.4 + 0.4), 6) AS without_robustness FROM (SELECT event_type, avg(CAST(value > 10 AS INT)) AS c, least(1, avg(value) / 100) AS s, avg(CAST(value > 50 AS INT)) AS r FROM events GROUP BY 1)")
def overall_score(spark, d):
    per = table(spark, d, "events").groupBy("event_type").agg(
        F.avg((F.col("value") > 10).cast("int")).alias("c"), F.least(F.lit(1.0), F.avg("value") / 100).alias("s"), F.avg((F.col("value") > 50).cast("int")).alias("r")
    )
    return per.select("event_type", metrics.overall(F.col("c"), F.col("s"), F.col("r")).alias("overall"), metrics.overall(F.col("c"), F.col("s"), F.lit(None).cast("double")).alias("without_robustness"))


_VOTE = "CASE l_linenumber WHEN 1 THEN 'a' WHEN 2 THEN 'slight-a' WHEN 3 THEN 'equal' WHEN 4 THEN 'slight-b' WHEN 5 THEN 'b' WHEN 6 THEN 'other' END"


@query(f"""WITH v AS (SELECT CAST(l_quantity AS INT)::VARCHAR AS query, {_VOTE} AS vote FROM lineitem), p AS (SELECT query, vote, count(*) AS n, round(100 * count(*) / sum(count(*)) OVER (PARTITION BY query), 4) AS percentage, false AS is_winner FROM v GROUP BY 1, 2),
  k AS (SELECT vote, count(*) AS n FROM v WHERE vote IN ('a', 'slight-a', 'equal', 'slight-b', 'b') GROUP BY vote)
  SELECT * FROM p WHERE vote <> '' UNION ALL SELECT NULL, vote, n, round(100 * n / sum(n) OVER (), 4), row_number() OVER (ORDER BY n DESC, list_position(['a', 'slight-a', 'equal', 'slight-b', 'b'], vote)) = 1 FROM k""")
def preferences(spark, d):
    n = F.col("l_linenumber")
    vote = F.when(n == 1, "a").when(n == 2, "slight-a").when(n == 3, "equal").when(n == 4, "slight-b").when(n == 5, "b").when(n == 6, "other")
    return metrics.preferences(table(spark, d, "lineitem").select(F.col("l_quantity").cast("int").alias("query"), vote.alias("vote")), "query", "vote")


# --- duplicates within texts


@query(r"""SELECT doc_id, coalesce(string_agg(l, chr(10) ORDER BY i), '') AS text FROM (SELECT d.doc_id, l, i FROM documents d LEFT JOIN (SELECT doc_id, arg_max(l, i) AS l, max(i) AS i FROM (SELECT doc_id, unnest(p) AS l, generate_subscripts(p, 1) AS i
  FROM (SELECT doc_id, regexp_split_to_array(regexp_replace(coalesce(text, ''), '(\r\n|\n|\r)$', ''), '\r\n|[\n\r]') AS p FROM documents)) GROUP BY doc_id, lower(l)) USING (doc_id)) GROUP BY doc_id""")
def dedup_lines_last(spark, d):
    return table(spark, d, "documents").select("doc_id", T.dedup_parts(F.col("text"), "line", False, False).alias("text"))


@query(rf"""SELECT doc_id, string_agg(l, chr(10) || chr(10) ORDER BY i) AS text FROM (SELECT doc_id, l, min(i) AS i FROM (SELECT doc_id, unnest(p) AS l, generate_subscripts(p, 1) AS i
  FROM (SELECT doc_id, regexp_split_to_array(coalesce(text, ''), '\n[ \t\n\r\f\x0B]*\n') AS p FROM documents)) GROUP BY doc_id, l) GROUP BY doc_id""")
def dedup_paragraphs(spark, d):
    return table(spark, d, "documents").select("doc_id", T.dedup_parts(F.col("text"), "paragraph", True).alias("text"))


# --- kinds of texts, citations


def _count(patterns) -> str:
    quoted = [p.replace("'", "''") for p in patterns]
    return " + ".join(f"CAST(regexp_matches(text, '{p}') AS INT)" for p in quoted)


def _has(words) -> str:
    return "CAST(" + " OR ".join(f"contains(lower(text), '{w}')" for w in words) + " AS INT)"


_CITED = "2 * greatest(" + ", ".join(f"CAST(regexp_matches(text, '{p}') AS INT)" for p in domains.CITATION_MARKS) + ")"


@query(f"""SELECT conv_id, turn, CASE WHEN {_count(domains.STATUTE_MARKS)} + {_has(domains.STATUTE_WORDS)} >= 3 THEN 'statute' WHEN {_count(domains.CASE_MARKS)} + {_has(domains.CASE_WORDS)} + {_CITED} >= 3 THEN 'case_law'
  WHEN {_count(domains.CONTRACT_MARKS)} + {_has(domains.CONTRACT_WORDS)} >= 3 THEN 'contract' ELSE 'legal_document' END AS kind FROM (SELECT conv_id, turn, CASE turn % 4 WHEN 0 THEN 'Section 12 of the act: § 4 shall ' WHEN 1 THEN 'Smith v. Jones, 410 U.S. 113: ' WHEN 2 THEN 'This agreement between the parties and ' ELSE '' END || text AS text FROM conversations)""")
def legal_kinds(spark, d):
    turn = F.col("turn") % 4
    head = F.when(turn == 0, "Section 12 of the act: § 4 shall ").when(turn == 1, "Smith v. Jones, 410 U.S. 113: ").when(turn == 2, "This agreement between the parties and ").otherwise("")
    return table(spark, d, "conversations").select("conv_id", "turn", domains.kind_of_legal(F.concat(head, "text")).alias("kind"))


@query(f"SELECT conv_id, turn, CASE WHEN {' + '.join(f'''CAST(regexp_matches(t, '{p}') AS INT)''' for p in domains.PAPER_MARKS)} >= 3 THEN 'paper' WHEN regexp_matches(t, '(chief complaint|assessment|history of present|medications:)') THEN 'note' ELSE 'other' END AS kind FROM (SELECT conv_id, turn, CASE turn % 3 WHEN 0 THEN 'abstract methods et al ' WHEN 1 THEN 'abstracts and medications: ' ELSE '' END || lower(text) AS t FROM conversations)")
def medical_kinds(spark, d):
    turn = F.col("turn") % 3
    head = F.when(turn == 0, "Abstract Methods et al ").when(turn == 1, "Abstracts and Medications: ").otherwise("")
    return table(spark, d, "conversations").select("conv_id", "turn", domains.kind_of_medical(F.concat(head, "text")).alias("kind"))


def _words(names) -> str:
    return "'" + "|".join(names) + "'"


@query("SELECT page_id, CASE " + " ".join(f"WHEN regexp_matches(n, {_words(a)}) OR regexp_matches(f, {_words(b)}) THEN '{k}'" for k, (a, b) in domains.MEDICAL_FILES.items()) + " ELSE 'other' END AS category FROM (SELECT page_id, lower(regexp_extract(url, '([^/]*)$', 1)) AS n, lower(regexp_extract(url, '^(.*)/[^/]*$', 1)) AS f FROM (SELECT page_id, url || CASE page_id % 5 WHEN 0 THEN '/study.txt' WHEN 1 THEN '/notes/x' WHEN 2 THEN '/manual' WHEN 3 THEN '/standards/y' ELSE '' END AS url FROM pages))")
def file_categories(spark, d):
    k = F.col("page_id") % 5
    url = F.concat("url", F.when(k == 0, "/study.txt").when(k == 1, "/notes/x").when(k == 2, "/manual").when(k == 3, "/standards/y").otherwise(""))
    return table(spark, d, "pages").select("page_id", domains.category_of_file(url).alias("category"))
