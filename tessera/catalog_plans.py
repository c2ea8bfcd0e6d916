"""Queries of topic chunks, table functions, lifetimes and hops."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import tables
from tessera.operators import retrieval, topics
from tessera.plans import hops
from tessera.registry import query, table
from tessera.streaming import windows

_SENT = r"list_filter(list_transform(regexp_split_to_array(text, '[.!?]+'), lambda s: trim(regexp_replace(s, '[ \t\n\r\f\x0B]+', ' ', 'g'))), lambda s: s <> '')"


@query(rf"""WITH d AS (SELECT doc_id, {_SENT} AS s FROM documents), t AS (SELECT doc_id, s, list_transform(s, lambda x: list_distinct(regexp_extract_all(lower(x), '[\p{{L}}]{{4,}}'))) AS w FROM d),
  e AS (SELECT doc_id, unnest(s) AS s, unnest(range(1, len(s) + 1)) AS i, w FROM t WHERE len(s) > 0),
  b AS (SELECT doc_id, i, s, len(w) AS n, list_distinct(flatten(w[greatest(1, i - 2):i])) AS l, list_distinct(flatten(w[i + 1:i + 3])) AS r FROM e),
  c AS (SELECT doc_id, i, s, CASE WHEN i = n THEN NULL WHEN len(l) > 0 AND len(r) > 0 THEN round(len(list_intersect(l, r)) / sqrt(len(l) * len(r)), 6) ELSE 0.0::DOUBLE END AS c FROM b),
  m AS (SELECT *, coalesce(CAST(c > lag(c) OVER (PARTITION BY doc_id ORDER BY i) AS INT), 0) AS rise, coalesce(CAST(c > lead(c) OVER (PARTITION BY doc_id ORDER BY i) AS INT), 0) AS fall FROM c),
  u AS (SELECT *, sum(rise) OVER (PARTITION BY doc_id ORDER BY i) AS a, sum(fall) OVER (PARTITION BY doc_id ORDER BY i DESC) AS b FROM m),
  p AS (SELECT *, CASE WHEN c IS NOT NULL THEN round(max(c) OVER (PARTITION BY doc_id, a) + max(c) OVER (PARTITION BY doc_id, b) - 2 * c, 6) END AS depth FROM u),
  q AS (SELECT *, CAST(depth > 0 AND depth >= round(avg(depth) OVER (PARTITION BY doc_id) + 0.5::DOUBLE * stddev_pop(depth) OVER (PARTITION BY doc_id), 6) AS INT) AS cut FROM p),
  g AS (SELECT doc_id, i, s, CAST(coalesce(sum(coalesce(cut, 0)) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS INT) AS chunk_index FROM q)
  SELECT doc_id, chunk_index, CAST(count(*) OVER (PARTITION BY doc_id) AS INT) AS chunk_count, content FROM (SELECT doc_id, chunk_index, string_agg(s, '. ' ORDER BY i) AS content FROM g GROUP BY doc_id, chunk_index)""")
def chunk_topics(spark, d):
    return topics.topic_chunks(table(spark, d, "documents"))


@query("SELECT doc_id, CAST(generate_subscripts(c, 1) - 1 AS INT) AS chunk_index, CAST(len(c) AS INT) AS chunk_count, unnest(c) AS content FROM (SELECT doc_id, list_transform(range(1, length(text) + 1, 450), lambda i: substr(text, i, 500)) AS c FROM documents WHERE length(text) > 0)")
def chunk_fixed_lateral(spark, d):
    """The chunker as a table function, joined laterally in SQL."""
    tables.register(spark)
    return spark.sql("SELECT d.doc_id, c.* FROM {docs} d, LATERAL chunk_fixed(d.text, 500, 50) c", docs=table(spark, d, "documents"))


@query()
def chunk_recursive_lateral(spark, d):
    tables.register(spark)
    return spark.sql("SELECT d.doc_id, c.* FROM {docs} d, LATERAL chunk_recursive(d.text, 500, 50) c", docs=table(spark, d, "documents"))


_LIVES = "round(a / 1e6, 3) AS created, round(z / 1e6, 3) AS last, n"


@query(f"""WITH e AS (SELECT user_id, epoch_us(ts) AS t, lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts) AS p FROM events), s AS (SELECT user_id, t, sum(CAST(p IS NULL OR t - p > 7200000000 AS INT)) OVER (PARTITION BY user_id ORDER BY t) AS k FROM e)
  SELECT user_id, {_LIVES}, round((z + 7200000000) / 1e6, 3) AS expires FROM (SELECT user_id, min(t) AS a, max(t) AS z, count(*) AS n FROM s GROUP BY user_id, k)""")
def cache_lifetimes_sliding(spark, d):
    """Entries that live two hours after their last use, by user."""
    return _rounded(windows.lifetimes(table(spark, d, "events"), "user_id", "ts", 7200, "sliding"))


@query(f"""WITH RECURSIVE e AS MATERIALIZED (SELECT event_type, epoch_us(ts) AS t FROM events), f AS (SELECT event_type, min(t) AS a FROM e GROUP BY event_type
  UNION ALL SELECT f.event_type, (SELECT min(t) FROM e WHERE e.event_type = f.event_type AND e.t > f.a + 21600000000) FROM f WHERE EXISTS (SELECT 1 FROM e WHERE e.event_type = f.event_type AND e.t > f.a + 21600000000))
  SELECT event_type, {_LIVES}, round((a + 21600000000) / 1e6, 3) AS expires FROM (SELECT f.event_type, a, max(t) AS z, count(*) AS n FROM f JOIN e ON e.event_type = f.event_type AND t BETWEEN a AND a + 21600000000 GROUP BY f.event_type, a)""")
def cache_lifetimes_fixed(spark, d):
    """Entries that live six hours from their creation, five keys over many tasks."""
    return _rounded(windows.lifetimes(table(spark, d, "events"), "event_type", "ts", 21600, "fixed"))


def _rounded(lives):
    return lives.withColumns({c: F.round(c, 3) for c in ("created", "last", "expires")})


@query()
def multi_hop(spark, d):
    """Three hops from each benchmark item by shared words, without content seen before."""
    docs = table(spark, d, "documents")
    index = retrieval.term_counts(docs)
    asked = table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    return hops.hops(asked, docs, lambda q: retrieval.keyword(q, None, k=3, index=index), n_hops=3, width=2)
