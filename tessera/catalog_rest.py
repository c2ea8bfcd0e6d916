"""Queries of the retriever's other strategies, contextual scores, filters by list and date, cleaners, cache keys and tags, confidence of answers."""

from __future__ import annotations

from datetime import date, datetime

from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators import caching, domains, fusion, retrieval
from tessera.plans import retriever
from tessera.plans.predicates import where
from tessera.registry import SQL, query, table


def _register() -> None:
    """Queries whose SQL is made from that of the catalog's searches, which stand in the registry before."""
    cosine, euclidean, words = (SQL[n].strip() for n in ("vec_topk_cosine", "vec_topk_l2", "keyword_topk"))
    deep = lambda sql, k: sql.replace("rank <= 10", f"rank <= {k}")
    lists = f"a AS ({deep(cosine, 10)}), b AS ({deep(euclidean, 10)})"
    scaled = "(SELECT query_id, id, CASE WHEN hi = lo THEN score ELSE (score - lo) / (hi - lo) END AS score FROM (SELECT *, min(score) OVER (PARTITION BY query_id) AS lo, max(score) OVER (PARTITION BY query_id) AS hi FROM {}))"
    best = "SELECT query_id, id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM ({})) WHERE rank <= 5"

    def strategy(name: str, threshold: float | None = None):
        """A retriever of this strategy whose two searches are by cosine and by distance, twice the limit deep."""
        from tessera.catalog import vector_queries

        def run(spark, d):
            def by(metric):
                return lambda q, k: retrieval.vector_scores(vector_queries(spark, d), table(spark, d, "embeddings"), metric, k=k)

            slots = {"vector": by("cosine"), "bm25": by("euclidean"), "keyword": by("euclidean")}
            made = retriever.Retriever(table(spark, d, "documents"), table(spark, d, "embeddings"), name, weights=(0.6, 0.4), searches=slots, threshold=threshold)
            return made.retrieve(vector_queries(spark, d), 5)

        return run

    def joined(expr: str) -> str:
        return f"WITH {lists} " + best.format(f"SELECT query_id, id, round({expr}, 6) AS score FROM (SELECT query_id, id, score AS sa FROM {scaled.format('a')}) FULL JOIN (SELECT query_id, id, score AS sb FROM {scaled.format('b')}) USING (query_id, id)")

    linear = joined("0.6 * coalesce(sa, 0) + 0.4 * coalesce(sb, 0)")
    rrf = f"WITH {lists} " + best.format("SELECT query_id, id, round(coalesce(0.6 / (60 + ra), 0) + coalesce(0.4 / (60 + rb), 0), 6) AS score FROM (SELECT query_id, id, rank AS ra FROM a) FULL JOIN (SELECT query_id, id, rank AS rb FROM b) USING (query_id, id)")
    weighted = f"WITH {lists} " + best.format(f"SELECT query_id, id, round(sum(w * score) / sum(w), 6) AS score FROM (SELECT query_id, id, score, 0.6 AS w FROM {scaled.format('a')} UNION ALL SELECT query_id, id, score, 0.4 FROM {scaled.format('b')}) GROUP BY query_id, id")
    largest = joined("greatest(coalesce(sa, 0), coalesce(sb, 0))")
    for name, sql in (("bm25_vector", linear), ("vector_keyword", linear), ("rrf", rrf), ("weighted", weighted), ("contextual", largest)):
        run = strategy(name)
        run.__name__ = f"retrieve_{name}"
        query(sql)(run)
    run = strategy("bm25_vector", 0.5)
    run.__name__ = "retrieve_threshold"
    query(f"SELECT * FROM ({linear}) WHERE score >= 0.5")(run)

    @query(f"WITH {lists} SELECT query_id, id, score, rank FROM (SELECT query_id, id, round(0.6 * coalesce(sa, 0) + 0.4 * coalesce(sb, 0), 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY coalesce(sa, sb) DESC, sa IS NULL, coalesce(ra, rb), id) AS rank FROM (SELECT query_id, id, score AS sa, rank AS ra FROM a) FULL JOIN (SELECT query_id, id, score AS sb, rank AS rb FROM b) USING (query_id, id)) WHERE rank <= 8")
    def fuse_two_modal(spark, d):
        """Results of two kinds, scored together and ordered by the score that each came with."""
        from tessera.catalog import _lists

        return fusion.two_modal(*_lists(spark, d), 8, 0.4)

    answer = "'Score: ' || (id % 13) || CASE WHEN id % 3 = 0 THEN '.5' ELSE '' END || chr(10) || 'of 10'"
    given = "CASE WHEN v > 1 AND v <= 10 THEN v / 10 ELSE v END"

    @query(f"WITH a AS ({cosine}), s AS (SELECT query_id, id, CAST(regexp_replace(split_part({answer}, chr(10), 1), '[^0-9.]', '', 'g') AS DOUBLE) AS v FROM a) " + best.format(f"SELECT query_id, id, round({given}, 6) AS score FROM s"))
    def rerank_rated(spark, d):
        """Results in the order of a model's ratings; made answers stand for the model's."""
        from tessera.catalog import _vec

        found = _vec("cosine")(spark, d)
        said = F.concat(F.lit("Score: "), (F.col("id") % 13).cast("string"), F.when(F.col("id") % 3 == 0, ".5").otherwise(""), F.lit("\nof 10"))
        return retrieval.top_k(found.select("query_id", "id", F.round(T.rated(said), 6).alias("score")), 5)

    letters = "list_transform(range(97, 123), lambda i: length(lower({0})) - length(replace(lower({0}), chr(i::INT), '')))::DOUBLE[]"

    @query(f"""WITH r AS MATERIALIZED ({words}), v AS MATERIALIZED (SELECT doc_id AS id, {letters.format('text')} AS v FROM documents WHERE text <> '' AND doc_id IN (SELECT id FROM r)), q AS MATERIALIZED (SELECT item_id AS query_id, {letters.format("('query: ' || text)")} AS q FROM benchmark)
      SELECT query_id, id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM (SELECT r.query_id, r.id, round(coalesce(list_cosine_similarity(q, v), 0), 6) AS score FROM r JOIN v USING (id) JOIN q USING (query_id))) WHERE rank <= 5""")
    def contextual_rescored(spark, d):
        """Keyword results scored again by embeddings of whole contents; the embedding slot holds counts of letters."""
        from tessera.catalog import text_queries

        asked, docs = text_queries(spark, d), table(spark, d, "documents")
        return retrieval.rescored(retrieval.keyword(asked, docs, k=10), asked, docs, letter_counts, "query: {query}", 5)


def letter_counts(text):
    low = F.lower(text)
    return F.array(*((F.length(low) - F.length(F.replace(low, F.lit(chr(c))))).cast("double") for c in range(97, 123)))


@query("SELECT o_orderkey FROM orders WHERE o_orderdate >= TIMESTAMP '1995-01-02' AND o_orderdate < TIMESTAMP '1995-01-09' OR o_orderdate >= TIMESTAMP '1997-01-01' AND o_orderdate < TIMESTAMP '1998-01-01' OR CAST(o_orderdate AS DATE) IN (DATE '1994-05-05', DATE '1994-05-04', DATE '1994-05-06', DATE '1993-07-01')")
def filter_days(spark, d):
    """This week and year, today, yesterday, tomorrow and on a date."""
    now = datetime(1994, 5, 5, 12)
    p = where("o_orderdate", "this_week", now=datetime(1995, 1, 4)) | where("o_orderdate", "this_year", now=datetime(1997, 3, 1)) | where("o_orderdate", "on_date", date(1993, 7, 1))
    for name in ("today", "yesterday", "tomorrow"):
        p = p | where("o_orderdate", name, now=now)
    return table(spark, d, "orders").where(p.column()).select("o_orderkey")


@query("SELECT o_orderkey FROM orders WHERE o_orderdate >= TIMESTAMP '1995-03-31' - INTERVAL 1 MONTH AND o_orderdate <= TIMESTAMP '1995-03-31' + INTERVAL 2 WEEK OR o_orderdate >= TIMESTAMP '1998-02-28' AND o_orderdate > TIMESTAMP '1998-03-01'")
def filter_relative_days(spark, d):
    """In the last month and the next two weeks of a moment, by the calendar; after a date."""
    now = datetime(1995, 3, 31)
    near = where("o_orderdate", "in_last", n=1, unit="months", now=now) & where("o_orderdate", "in_next", n=2, unit="weeks", now=now)
    late = where("o_orderdate", "after", datetime(1998, 2, 28), inclusive=True) & where("o_orderdate", "after", datetime(1998, 3, 1))
    return table(spark, d, "orders").where((near | late).column()).select("o_orderkey")


@query("SELECT p_partkey FROM part WHERE p_size NOT IN (1, 5, 9) AND (p_retailprice < 950 OR p_retailprice > 1100) AND p_name LIKE '%e' OR abs(p_retailprice - 1000) <= 5 OR p_retailprice = floor(p_retailprice) AND p_retailprice > 0")
def filter_lists(spark, d):
    """Not in a list, not between, ending with, near, whole and positive numbers."""
    p = where("p_size", "not_in", [1, 5, 9]) & where("p_retailprice", "not_between", low=950, high=1100) & where("p_name", "ends_with", "e")
    p = p | where("p_retailprice", "near", 1000, tolerance=5) | (where("p_retailprice", "is_integer") & where("p_retailprice", "is_positive"))
    return table(spark, d, "part").where(p.column()).select("p_partkey")


_RULES = [(r"[0-9]{4}-[0-9]{2}-[0-9]{2}", "DATE"), (r"([aeiou])[aeiou]+", "$1"), (r" +", " ")]


@query(r"SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(text, '[0-9]{4}-[0-9]{2}-[0-9]{2}', 'DATE', 'g'), '([aeiou])[aeiou]+', '\1', 'g'), ' +', ' ', 'g') AS text FROM documents")
def clean_rules(spark, d):
    """A list of patterns, applied in order."""
    return table(spark, d, "documents").select("doc_id", T.regex_clean(F.col("text"), _RULES).alias("text"))


_SPACES = r"[ \t\n\r\f\x0B]+"
_MARKS = r"[!\"#$%&''()*+,./:;<=>?@\\^_`{|}~-]"


@query(rf"SELECT doc_id, trim(regexp_replace(regexp_replace(regexp_replace(lower(regexp_replace(regexp_replace(text, 'https?://[^ \t\n\r]+|www\.[^ \t\n\r]+', '[URL]', 'g'), '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{{2,}}', '[EMAIL]', 'g')), '{_MARKS}', '', 'g'), '[0-9]+', '', 'g'), '{_SPACES}', ' ', 'g')) AS text FROM documents")
def clean_normalized(spark, d):
    """Lower case, URLs and addresses as words, no punctuation and no numbers."""
    return table(spark, d, "documents").select("doc_id", T.normalize_text(F.col("text"), numbers=True).alias("text"))


@query("SELECT event_id, sha256(concat_ws(chr(1), coalesce(user_id::VARCHAR, chr(2)), coalesce(event_type, chr(2)), coalesce(props->>'missing', chr(2)))) AS key FROM events")
def cache_keys(spark, d):
    return table(spark, d, "events").select("event_id", caching.key_of(F.col("user_id"), F.col("event_type"), F.get_json_object("props", "$.missing")).alias("key"))


@query("SELECT event_id FROM events WHERE NOT (event_type = 'click' AND user_id % 3 = 0) AND NOT (user_id % 7 = 0)")
def cache_untagged(spark, d):
    """What two invalidations leave: of one type by a tag, and of all types by another."""
    tags = F.filter(F.array(F.when(F.col("user_id") % 3 == 0, "three"), F.when(F.col("user_id") % 7 == 0, "seven")), lambda t: t.isNotNull())
    entries = table(spark, d, "events").select("event_id", F.col("event_type").alias("type"), tags.alias("tags"))
    return caching.without_tag(caching.without_tag(entries, "three", "click"), "seven").select("event_id")


@query("SELECT doc_id, round(greatest(0, least(1, 0.4::DOUBLE * quality + 0.3::DOUBLE * toxic + 0.2::DOUBLE * (1 - toxic) + 0.1::DOUBLE * (doc_id % 5))), 6) AS confidence FROM labels")
def answer_confidences(spark, d):
    parts = (F.col("quality"), F.col("toxic"), 1 - F.col("toxic"), F.col("doc_id") % 5)
    return table(spark, d, "labels").select("doc_id", F.round(domains.answer_confidence(*parts), 6).alias("confidence"))


@query("SELECT a.event_id AS id, b.event_id AS target FROM events a JOIN events b ON b.event_id = a.event_id + 1 AND b.event_id % 4 <> 0")
def reasoning_edges(spark, d):
    """Edges of a graph of steps that hang on the one before."""
    parents = F.when(F.col("event_id") % 4 != 0, F.array(F.col("event_id") - 1)).otherwise(F.array().cast("array<bigint>"))
    steps = table(spark, d, "events").select(F.col("event_id").alias("id"), F.col("event_type").alias("kind"), F.col("props").alias("text"), parents.alias("parents"))
    ids = steps.select(F.col("id").alias("source"))
    return domains.graph(steps)[1].join(ids, "source", "left_semi").select(F.col("source").alias("id"), "target")


_register()
