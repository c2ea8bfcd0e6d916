"""Queries over the tables, each with the same rows in DuckDB's SQL where SQL can say them."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.functions import vectors as V
from tessera.operators import caching, chunking, corpus, domains, embeddings, fusion, isolation, metrics, neighbours, quantised, retrieval, telemetry
from tessera.plans import retriever, schema
from tessera.plans.predicates import Pred, where
from tessera.registry import QUERIES, SQL, query, table
from tessera.streaming import windows


# --- vectors. Queries are every vector whose id 50 divides, against all.


def vector_queries(spark, d) -> DataFrame:
    return table(spark, d, "embeddings").where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))


def _vec(metric):
    return lambda spark, d: retrieval.vector_scores(vector_queries(spark, d), table(spark, d, "embeddings"), metric, k=10)


_D = "list_transform(range(1, 65), lambda i: a.embedding[i]::DOUBLE - b.embedding[i]::DOUBLE)"
_SCORES = {
    "cosine": "list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[])",
    "euclidean": f"1.0 / (1.0 + sqrt(list_sum(list_transform({_D}, lambda x: x * x))))",
    "dot": "list_inner_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[])",
}


def _vec_sql(metric: str, k: int = 10, cond: str = "true") -> str:
    return f"""SELECT query_id, id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM (
      SELECT a.vec_id AS query_id, b.vec_id AS id, round({_SCORES[metric]}, 6) AS score FROM embeddings a, embeddings b WHERE a.vec_id % 50 = 0 AND {cond})) WHERE rank <= {k}"""


@query(_vec_sql("cosine"))
def vec_topk_cosine(spark, d):
    return _vec("cosine")(spark, d)


@query(_vec_sql("euclidean"))
def vec_topk_l2(spark, d):
    return _vec("euclidean")(spark, d)


@query(_vec_sql("dot"))
def vec_topk_dot(spark, d):
    return _vec("dot")(spark, d)


@query(_vec_sql("cosine", cond="b.label % 2 = 0"))
def vec_topk_filtered(spark, d):
    return retrieval.vector_scores(vector_queries(spark, d), table(spark, d, "embeddings"), "cosine", F.col("label") % 2 == 0, k=10)


@query("SELECT label, CAST(i - 1 AS INT) AS place, round(avg(embedding[i]::DOUBLE), 6) AS mean FROM embeddings, range(1, 65) t(i) GROUP BY label, i")
def vec_centroid_by_label(spark, d):
    return embeddings.centroids(table(spark, d, "embeddings"), "label")


@query("""SELECT (SELECT count(*) FROM embeddings) AS n, round(avg(c), 6) AS mean, round(stddev_pop(c), 6) AS std
  FROM (SELECT list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS c FROM embeddings a JOIN embeddings b ON a.vec_id < b.vec_id)""")
def vec_pair_stats(spark, d):
    return embeddings.pair_stats(table(spark, d, "embeddings"))


@query(f"SELECT a.vec_id AS a, b.vec_id AS b, round({_SCORES['cosine']}, 6) AS similarity FROM embeddings a, embeddings b WHERE a.vec_id <> b.vec_id AND round({_SCORES['cosine']}, 6) >= 0.3")
def vec_pairs_threshold(spark, d):
    v = table(spark, d, "embeddings")
    return embeddings.similar(v, v, 0.3)


_KNN = f"""SELECT vec_id, round(avg(d), 5) AS distance FROM (SELECT vec_id, d, row_number() OVER (PARTITION BY vec_id ORDER BY d, b) AS r FROM (
  SELECT a.vec_id, b.vec_id AS b, round(sqrt(list_sum(list_transform({_D}, lambda x: x * x))), 6) AS d FROM embeddings a, embeddings b WHERE a.vec_id <> b.vec_id)) WHERE r <= 5 GROUP BY vec_id"""


@query(f"WITH k AS ({_KNN}) SELECT vec_id, distance, distance > (SELECT quantile_cont(distance, 0.9) FROM k) AS is_outlier FROM k")
def vec_knn_outliers(spark, d):
    v = table(spark, d, "embeddings")
    return embeddings.outliers(embeddings.knn_distance(v, v, 5), 0.1)


@query("""SELECT label, list_transform(v, lambda x: round(x / greatest(sqrt(list_sum(list_transform(v, lambda y: y * y))), 1e-12), 6)) AS vector FROM (
  SELECT label, list(m ORDER BY i) AS v FROM (SELECT label, i, avg(embedding[i]::DOUBLE) AS m FROM embeddings, range(1, 65) t(i) GROUP BY label, i) GROUP BY label)""")
def vec_hyde_mean(spark, d):
    return retrieval.hyde(table(spark, d, "embeddings"), "label")


@query()
def vec_kmeans(spark, d):
    return embeddings.kmeans(table(spark, d, "embeddings"), 8).groupBy("cluster").agg(F.count("*").alias("n"))


@query()
def vec_pca(spark, d):
    return embeddings.pca(table(spark, d, "embeddings"), 8)[0].select("vec_id", "reduced")


@query()
def vec_ivf_recall(spark, d):
    """Recall of the inverted file against exact search."""
    v, q = table(spark, d, "embeddings"), vector_queries(spark, d)
    index, centres = embeddings.ivf(v, 8)
    return metrics.recall_against(embeddings.ivf_search(index, centres, q, 10, 6), vec_topk_cosine(spark, d), 10)


_DIST = f"round(sqrt(list_sum(list_transform({_D}, lambda x: x * x))), 6)"
_GRAPH = f"""g AS MATERIALIZED (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, id) AS rank FROM (
  SELECT a.vec_id AS query_id, b.vec_id AS id, {_DIST} AS distance FROM embeddings a, embeddings b WHERE a.vec_id <> b.vec_id)) WHERE rank <= {{k}})"""


@query(f"WITH {_GRAPH.format(k=5)} SELECT query_id, id, distance, rank FROM g")
def vec_knn_graph(spark, d):
    """The exact graph of all vectors' five nearest."""
    v = table(spark, d, "embeddings")
    return neighbours.nearest(v, v, 5)


@query(f"""WITH {_GRAPH.format(k=20)}, r AS (SELECT query_id AS id, max(distance) AS radius FROM g GROUP BY query_id),
  l AS (SELECT query_id, 1 / (avg(greatest(distance, radius)) + 1e-10) AS density FROM g JOIN r USING (id) GROUP BY query_id)
  SELECT g.query_id AS vec_id, round(avg(o.density) / any_value(l.density), 5) AS factor FROM g JOIN l USING (query_id) JOIN l o ON o.query_id = g.id GROUP BY g.query_id""")
def vec_lof(spark, d):
    return neighbours.local_outlier_factor(table(spark, d, "embeddings"), 20).withColumn("factor", F.round("factor", 5))


@query(f"""WITH RECURSIVE n AS MATERIALIZED (SELECT * FROM (SELECT a.vec_id AS a, b.vec_id AS b, {_DIST} AS d FROM embeddings a, embeddings b) WHERE d <= 1.15), core AS MATERIALIZED (SELECT a AS id FROM n GROUP BY a HAVING count(*) >= 5),
  e AS MATERIALIZED (SELECT a, b FROM n WHERE a IN (SELECT id FROM core) AND b IN (SELECT id FROM core)), r AS (SELECT id AS node, id AS label FROM core UNION SELECT e.b, r.label FROM r JOIN e ON e.a = r.node),
  lab AS MATERIALIZED (SELECT node, min(label) AS cluster FROM r GROUP BY node),
  edge AS (SELECT a, arg_min(b, (d, b)) AS b FROM n WHERE a NOT IN (SELECT id FROM core) AND b IN (SELECT id FROM core) GROUP BY a),
  f AS MATERIALIZED (SELECT vec_id, embedding, coalesce(l.cluster, m.cluster) AS cluster, l.node IS NOT NULL AS is_core FROM embeddings LEFT JOIN lab l ON l.node = vec_id LEFT JOIN edge ON edge.a = vec_id LEFT JOIN lab m ON m.node = edge.b),
  c AS MATERIALIZED (SELECT cluster, list(m ORDER BY i) AS centre FROM (SELECT cluster, i, avg(embedding[i]::DOUBLE) AS m FROM f, range(1, 65) t(i) WHERE cluster IS NOT NULL GROUP BY cluster, i) GROUP BY cluster),
  s AS (SELECT vec_id, min(sqrt(list_sum(list_transform(range(1, 65), lambda i: (f.embedding[i]::DOUBLE - c.centre[i]) ** 2)))) AS score FROM f JOIN c ON f.cluster IS NULL OR f.cluster = c.cluster GROUP BY vec_id)
  SELECT vec_id, cluster, is_core, round(score, 6) AS score FROM f LEFT JOIN s USING (vec_id)""")
def vec_dbscan(spark, d):
    """Clusters by density over all vectors, noise, and each vector's distance to a centre."""
    return neighbours.dbscan_outliers(table(spark, d, "embeddings"), 1.15, 5)


@query(f"""WITH c AS (SELECT embedding, min(vec_id) AS class_id FROM embeddings GROUP BY embedding), p AS (SELECT a.class_id, count(*) AS n FROM c a, c b WHERE a.class_id <> b.class_id AND round({_SCORES['cosine']}, 6) >= 0.8 GROUP BY a.class_id)
  SELECT vec_id, class_id, CAST(coalesce(n, 0) AS BIGINT) AS n_links FROM embeddings JOIN c USING (embedding) LEFT JOIN p USING (class_id)""")
def vec_similar_links(spark, d):
    """All vectors against all at 0.8, without pairs as rows."""
    return neighbours.similar_links(table(spark, d, "embeddings"), 0.8)


@query()
def vec_isolation(spark, d):
    """Outliers by an isolation forest over all vectors."""
    return isolation.isolation_outliers(table(spark, d, "embeddings"), 0.05)


def _quantised(spark, d):
    v = table(spark, d, "embeddings")
    books = quantised.fit(v, m=16)
    return quantised.search(quantised.encode(v, books), books, v, vector_queries(spark, d), 10, deep=200)


@query()
def vec_pq_topk(spark, d):
    """Ten nearest by cosine from codes of 16 bytes a vector, scored again from the 200 best of each query."""
    return _quantised(spark, d)


@query()
def vec_pq_recall(spark, d):
    """Recall of the quantised search against exact search."""
    exact = neighbours.nearest(table(spark, d, "embeddings"), vector_queries(spark, d).select(F.col("query_id").alias("vec_id"), F.col("vector").alias("embedding")), 10, "cosine", other=False)
    return metrics.recall_against(_quantised(spark, d), exact, 10)


@query("""SELECT label, count(*) AS n, CAST(floor((count(*) * 64 * 4 + count(*) * 16 * 8) * 1.1::DOUBLE) AS BIGINT) AS hnsw, CAST(floor((100 * 64 * 4 + count(*) * 64 * 4 + 100 * 100) * 1.05::DOUBLE) AS BIGINT) AS ivf,
  count(*) * 8 + 8 * 256 * 8 * 4 + count(*) * 8 AS pq FROM embeddings GROUP BY label""")
def index_memory_estimate(spark, d):
    return table(spark, d, "embeddings").groupBy("label").agg(F.count("*").alias("n")).select("label", "n", V.index_memory(F.col("n"), 64).alias("m")).select("label", "n", "m.*")


# --- text retrieval: the benchmark's items ask, the documents answer


def text_queries(spark, d) -> DataFrame:
    return table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))


_W = r"list_filter(regexp_split_to_array(lower({}), '[ \t\n\r\f\x0B]+'), lambda w: w <> '')"
_ITEMS = "SELECT item_id AS query_id, text AS query FROM benchmark"
_BM25 = f"""WITH d AS (SELECT doc_id AS id, {_W.format('text')} AS w FROM documents), st AS (SELECT count(*) AS n, avg(len(w)) AS avgdl FROM d),
q AS (SELECT query_id, term, count(*) AS qtf FROM (SELECT query_id, unnest({_W.format('query')}) AS term FROM ({{asked}})) GROUP BY ALL),
tf AS (SELECT id, term, count(*) AS tf, any_value(dl) AS dl FROM (SELECT id, len(w) AS dl, unnest(w) AS term FROM d) WHERE term IN (SELECT term FROM q) GROUP BY id, term),
df0 AS (SELECT term, any_value(n) AS n, any_value(avgdl) AS avgdl, count(*)::DOUBLE AS df FROM tf, st GROUP BY term), df1 AS (SELECT term, avgdl, {{idf}} AS idf FROM df0),
df AS (SELECT term, avgdl, {{fix}} AS idf FROM df1),
sc AS (SELECT query_id, id, sum(qtf * {{part}}) AS score FROM q JOIN df USING (term) JOIN tf USING (term) GROUP BY query_id, id), fl AS (SELECT query_id, sum(qtf * idf * 0.5) AS f FROM q JOIN df USING (term) GROUP BY query_id),
r AS (SELECT query_id, id, round(score + {{floor}}, 5) AS score FROM sc JOIN fl USING (query_id))
SELECT query_id, id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM r) WHERE rank <= {{k}}"""
_OK = "idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))"


@query(_BM25.format(asked=_ITEMS, k=10, idf="ln((n + 1) / df)", fix="idf", part=_OK, floor="f"))
def bm25_plus_topk(spark, d):
    return retrieval.bm25(text_queries(spark, d), table(spark, d, "documents"), "plus", k=10)


@query(_BM25.format(asked=_ITEMS, k=10, idf="ln((n - df + 0.5) / (df + 0.5))", fix="CASE WHEN idf < 0 THEN 0.25 * (SELECT avg(idf) FROM df1) ELSE idf END", part=_OK, floor="0"))
def bm25_okapi_topk(spark, d):
    return retrieval.bm25(text_queries(spark, d), table(spark, d, "documents"), "okapi", k=10)


@query(_BM25.format(asked=_ITEMS, k=10, idf="ln((n + 1) / (df + 0.5))", fix="idf", part="idf * 2.5 * (tf / (0.25 + 0.75 * dl / avgdl) + 0.5) / (1.5 + tf / (0.25 + 0.75 * dl / avgdl) + 0.5)", floor="0"))
def bm25_l_topk(spark, d):
    return retrieval.bm25(text_queries(spark, d), table(spark, d, "documents"), "l", k=10)


@query(f"""WITH q AS (SELECT item_id AS query_id, list_distinct({_W.format('text')}) AS w FROM benchmark), qt AS (SELECT query_id, len(w) AS size, unnest(w) AS term FROM q),
  dt AS (SELECT doc_id AS id, unnest(list_distinct({_W.format('text')})) AS term FROM documents), s AS (SELECT query_id, id, round(count(*) / any_value(size), 5) AS score FROM qt JOIN dt USING (term) GROUP BY query_id, id)
  SELECT query_id, id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM s) WHERE rank <= 10""")
def keyword_topk(spark, d):
    return retrieval.keyword(text_queries(spark, d), table(spark, d, "documents"), k=10)


# --- fusion: two vector searches as the lists


def _lists(spark, d):
    return _vec("cosine")(spark, d), _vec("euclidean")(spark, d)


_L = f"a AS ({_vec_sql('cosine')}), b AS ({_vec_sql('euclidean')})"
_RANKED = "SELECT query_id, id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM ({})) WHERE rank <= 10"
_MM = "(SELECT query_id, id, CASE WHEN hi = lo THEN score ELSE (score - lo) / (hi - lo) END AS score, rank FROM (SELECT *, min(score) OVER (PARTITION BY query_id) AS lo, max(score) OVER (PARTITION BY query_id) AS hi FROM {}))"


def _fused(expr: str) -> str:
    return f"WITH {_L} " + _RANKED.format(f"SELECT query_id, id, round({expr}, 6) AS score FROM (SELECT query_id, id, score AS sa FROM {_MM.format('a')}) FULL JOIN (SELECT query_id, id, score AS sb FROM {_MM.format('b')}) USING (query_id, id)")


def _combined(how):
    def run(spark, d):
        a, b = _lists(spark, d)
        return fusion.combine(fusion.min_max(a), fusion.min_max(b), 10, how, 0.7, 0.3)

    return run


@query(_fused("0.7 * coalesce(sa, 0) + 0.3 * coalesce(sb, 0)"))
def fuse_linear(spark, d):
    return _combined("linear")(spark, d)


@query(_fused("greatest(coalesce(sa, 0), coalesce(sb, 0))"))
def fuse_max(spark, d):
    return _combined("max")(spark, d)


@query(_fused("least(coalesce(sa, 0), coalesce(sb, 0))"))
def fuse_min(spark, d):
    return _combined("min")(spark, d)


def _rrf_sql(expr: str) -> str:
    return f"WITH {_L}, na AS (SELECT query_id, count(*) AS na FROM a GROUP BY query_id), nb AS (SELECT query_id, count(*) AS nb FROM b GROUP BY query_id) " + _RANKED.format(
        f"SELECT query_id, id, round({expr}, 6) AS score FROM (SELECT query_id, id, rank AS ra FROM a) FULL JOIN (SELECT query_id, id, rank AS rb FROM b) USING (query_id, id) LEFT JOIN na USING (query_id) LEFT JOIN nb USING (query_id)"
    )


@query(_rrf_sql("coalesce(0.6 / (60 + ra), 0) + coalesce(0.4 / (60 + rb), 0)"))
def fuse_rrf_missing_zero(spark, d):
    return fusion.rrf(_lists(spark, d), 10, weights=[0.6, 0.4])


@query(_rrf_sql("0.6 / (60 + coalesce(ra, na + 1)) + 0.4 / (60 + coalesce(rb, nb + 1))"))
def fuse_rrf_missing_last(spark, d):
    return fusion.rrf(_lists(spark, d), 10, weights=[0.6, 0.4], missing="last")


@query(_rrf_sql("coalesce(1.0 / (59 + ra), 0) + coalesce(1.0 / (59 + rb), 0)"))
def fuse_rrf_zero_based(spark, d):
    return fusion.rrf(_lists(spark, d), 10, first=0)


@query(_rrf_sql("(coalesce(0.6 / (60 + ra), 0) + coalesce(0.4 / (60 + rb), 0)) / ((CASE WHEN ra IS NULL THEN 0 ELSE 0.6 END) + (CASE WHEN rb IS NULL THEN 0 ELSE 0.4 END))"))
def fuse_rrf_weighted_mean(spark, d):
    return fusion.rrf(_lists(spark, d), 10, weights=[0.6, 0.4], mean=True)


@query(f"WITH {_L} " + _RANKED.format("SELECT query_id, id, round(max(score), 6) AS score FROM (SELECT query_id, id, score FROM a UNION ALL SELECT query_id, id, score * 0.9 FROM b) GROUP BY query_id, id"))
def fuse_weighted(spark, d):
    return fusion.keep_best(_lists(spark, d), 10)


@query(f"""WITH {_L}, t AS (SELECT query_id, id, arg_min(score, turn) AS score, min(turn) AS turn FROM (SELECT query_id, id, score, 2 * rank AS turn FROM a UNION ALL SELECT query_id, id, score, 2 * rank + 1 FROM b) GROUP BY query_id, id)
  SELECT query_id, id, round(score, 6) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY turn) AS rank FROM t) WHERE rank <= 10""")
def fuse_interleave(spark, d):
    return fusion.interleave(*_lists(spark, d), 10)


@query(f"WITH {_L} " + _RANKED.format("SELECT query_id, id, round(sum(w * score) / sum(w), 6) AS score FROM (SELECT query_id, id, score, 0.7 AS w FROM a UNION ALL SELECT query_id, id, score, 0.3 FROM b) GROUP BY query_id, id"))
def rerank_ensemble(spark, d):
    return fusion.ensemble(_lists(spark, d), 10, [0.7, 0.3])


@query(f"""WITH {_L}, n AS (SELECT query_id, id, round(-score, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(-score, 6) DESC, id) AS rank FROM a WHERE rank <= 6), c AS (SELECT * FROM n WHERE rank <= 3),
  o AS (SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS r FROM a ANTI JOIN c USING (query_id, id)),
  u AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY late, r) AS n FROM (SELECT query_id, id, score, rank AS r, 0 AS late FROM c UNION ALL SELECT query_id, id, score, r, 1 FROM o WHERE r <= 5))
  SELECT query_id, id, score, n AS rank FROM u WHERE late = 0 OR n <= 5""")
def rerank_cascade(spark, d):
    a, _ = _lists(spark, d)
    return fusion.cascade(a, [(F.col("score"), 6), (-F.col("score"), 3)], 5)


_ASKED = "SELECT vec_id AS query_id, text AS query FROM embeddings JOIN documents ON doc_id = vec_id WHERE vec_id % 50 = 0"
_PLUS = _BM25.format(asked=_ASKED, k=20, idf="ln((n + 1) / df)", fix="idf", part=_OK, floor="f")


@query(f"WITH a AS ({_vec_sql('cosine', 20)} AND query_id IN (SELECT query_id FROM ({_ASKED}))), b AS ({_PLUS}) " + _RANKED.format(f"SELECT query_id, id, round(0.5 * coalesce(sa, 0) + 0.5 * coalesce(sb, 0), 6) AS score FROM (SELECT query_id, id, score AS sa FROM {_MM.format('a')}) FULL JOIN (SELECT query_id, id, score AS sb FROM {_MM.format('b')}) USING (query_id, id)"))
def hybrid_retrieve(spark, d):
    """Vector and keyword search over documents and vectors of the same ids, fused."""
    docs = table(spark, d, "documents")
    vectors = table(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding")
    q = vectors.where("doc_id % 50 = 0").select(F.col("doc_id").alias("query_id"), F.col("embedding").alias("vector"))
    q = q.join(docs.select(F.col("doc_id").alias("query_id"), F.col("text").alias("query")), "query_id")
    return retriever.Retriever(docs, vectors).retrieve(q, 10)


# --- measures: vectors of the query's label are relevant


def _judged(spark, d):
    v = table(spark, d, "embeddings")
    queries = v.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "label")
    return metrics.judged_by_label(vec_topk_cosine(spark, d), queries, v.select(F.col("vec_id").alias("id"), "label"))


_TRUTH = "truth AS (SELECT q.vec_id AS query_id, v.vec_id AS id FROM embeddings q JOIN embeddings v USING (label) WHERE q.vec_id % 50 = 0)"
_J = f"WITH res AS ({_vec_sql('cosine')}), {_TRUTH}, j AS (SELECT r.*, CASE WHEN t.id IS NULL THEN 0 ELSE 1 END AS rel FROM res r LEFT JOIN truth t USING (query_id, id)), n AS (SELECT query_id, count(*) AS n FROM truth GROUP BY query_id)"


@query(f"{_J}, k AS (SELECT query_id, count(*) AS c, sum(rel) AS h FROM j WHERE rank <= 5 GROUP BY query_id), m AS (SELECT query_id, h / c AS p, h / n AS r, h FROM k JOIN n USING (query_id)) SELECT query_id, round(p, 6) AS precision, round(r, 6) AS recall, round(CASE WHEN p + r = 0 THEN 0 ELSE 2 * p * r / (p + r) END, 6) AS f1, CAST(h > 0 AS INT) AS hit FROM m")
def precision_recall_f1_at_k(spark, d):
    return metrics.at_k_of(*_judged(spark, d), 5)


_AP = f"{_J}, c AS (SELECT query_id, rank, rel, sum(rel) OVER (PARTITION BY query_id ORDER BY rank) AS h FROM j), ap AS (SELECT query_id, round(avg(h / rank), 6) AS ap FROM c WHERE rel = 1 GROUP BY query_id)"


@query(f"{_AP} SELECT round(avg(coalesce(ap, 0)), 6) AS map FROM n LEFT JOIN ap USING (query_id)")
def map_strict(spark, d):
    return metrics.mean_average_precision_of(*_judged(spark, d))


@query(f"{_AP} SELECT round(avg(ap), 6) AS map FROM ap")
def map_of_hits(spark, d):
    return metrics.mean_average_precision_of(*_judged(spark, d), False)


@query(f"{_J}, dcg AS (SELECT query_id, sum(rel / log2(rank + 1)) AS d FROM j GROUP BY query_id), ideal AS (SELECT query_id, list_sum(list_transform(range(1, least(n, 10) + 1), lambda i: 1 / log2(i + 1))) AS i FROM n) SELECT query_id, round(coalesce(d, 0) / i, 6) AS ndcg FROM ideal LEFT JOIN dcg USING (query_id)")
def ndcg_at_10(spark, d):
    return metrics.ndcg_of(*_judged(spark, d), 10)


@query(f"{_J} SELECT query_id, round(coalesce(1 / min(rank) FILTER (rel = 1), 0), 6) AS rr FROM n LEFT JOIN j USING (query_id) GROUP BY query_id")
def mrr_first_hit(spark, d):
    return metrics.reciprocal_rank_of(*_judged(spark, d))


@query(f"{_J} SELECT query_id, round(sum(CASE WHEN rel = 1 THEN 1 / rank ELSE 0 END) / any_value(n), 6) AS mrr FROM n LEFT JOIN j USING (query_id) GROUP BY query_id")
def mrr_per_truth(spark, d):
    return metrics.reciprocal_rank_per_truth_of(*_judged(spark, d))


# --- filters


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_quantity BETWEEN 10 AND 20 AND l_discount > 0.05 AND NOT l_returnflag = 'R' AND l_quantity % 2 = 0")
def filter_numeric(spark, d):
    p = where("l_quantity", "between", low=10, high=20) & where("l_discount", "gt", 0.05) & ~where("l_returnflag", "equals", "R") & where("l_quantity", "divisible_by", 2)
    return table(spark, d, "lineitem").where(Pred.from_dict(p.to_dict()).column()).select("l_orderkey", "l_linenumber")


@query("SELECT o_orderkey FROM orders WHERE o_orderdate >= TIMESTAMP '1996-03-01' AND o_orderdate < TIMESTAMP '1996-04-01' OR o_orderdate < TIMESTAMP '1993-01-01'")
def filter_date(spark, d):
    p = where("o_orderdate", "this_month", now=datetime(1996, 3, 15)) | where("o_orderdate", "before", datetime(1993, 1, 1))
    return table(spark, d, "orders").where(p.column()).select("o_orderkey")


@query("SELECT p_partkey FROM part WHERE p_size IN (1, 5, 9) AND (lower(p_name) LIKE '%a%' OR p_brand LIKE 'Brand#1%') AND p_retailprice IS NOT NULL")
def filter_composite(spark, d):
    p = where("p_size", "in", [1, 5, 9]) & (where("p_name", "contains", "A", case_sensitive=False) | where("p_brand", "starts_with", "Brand#1")) & where("p_retailprice", "exists")
    return table(spark, d, "part").where(p.column()).select("p_partkey")


@query("SELECT event_id FROM events WHERE CAST(props->>'k' AS BIGINT) >= 50 AND event_type <> 'view'")
def filter_metadata(spark, d):
    p = where("k", "gte", 50) & where("event_type", "not_equals", "view")
    of = lambda name: F.get_json_object("props", "$.k").cast("long") if name == "k" else F.col(name)
    return table(spark, d, "events").where(p.column(of)).select("event_id")


@query("SELECT event_id, CASE WHEN CAST(props->>'k' AS BIGINT) > 90 THEN 'k: out of range' END AS violation FROM events WHERE CAST(props->>'k' AS BIGINT) > 90")
def schema_violations(spark, d):
    found = schema.violations(lambda n: F.get_json_object("props", f"$.{n}"), [schema.Field("k", "integer", True, 0, 90)])
    return table(spark, d, "events").select("event_id", F.explode(found).alias("violation"))


@query("""WITH c AS (SELECT 'k' AS key, props->>'k' AS value, count(*) AS n FROM events GROUP BY ALL), w AS (SELECT *, sum(n) OVER ()::BIGINT AS present, row_number() OVER (ORDER BY n DESC, value) AS r FROM c)
  SELECT key, value, n, present FROM w WHERE r <= 5 AND n >= greatest(1, 0.005 * present)""")
def metadata_profile(spark, d):
    return schema.profile(table(spark, d, "events"), F.create_map(F.lit("k"), F.get_json_object("props", "$.k")), 5, 0.005)


# --- telemetry on events


def _events(spark, d):
    return telemetry.sessions(table(spark, d, "events"), "user_id", "ts")


_S = "(SELECT *, user_id || '_' || strftime(ts, '%Y%m%d') AS session_id FROM events)"
_FMT = {"hour": "'%Y-%m-%d %H:00'", "day": "'%Y-%m-%d'", "week": "'%Y-W%V'", "month": "'%Y-%m'"}


def _stats_sql(by: str, value: str = "value", source: str = "events") -> str:
    p = lambda q: f"round(list_sort(list({value}))[CAST(floor(count({value}) * {q}::DOUBLE) AS BIGINT) + 1], 4)"
    return f"SELECT {by}, count({value}) AS count, round(min({value}), 4) AS min, round(max({value}), 4) AS max, round(avg({value}), 4) AS mean, round(median({value}), 4) AS median, {p(0.9)} AS p90, {p(0.95)} AS p95, {p(0.99)} AS p99, round(coalesce(stddev_samp({value}), 0), 4) AS stddev FROM {source} GROUP BY {by}"


@query(_stats_sql("event_type"))
def latency_stats(spark, d):
    return telemetry.latency_stats(table(spark, d, "events").where("value IS NOT NULL"), "value", ["event_type"])


@query(_stats_sql("bucket", source="(SELECT *, CASE WHEN CAST(props->>'k' AS BIGINT) < 10 THEN '<10' WHEN CAST(props->>'k' AS BIGINT) < 100 THEN '10-99' ELSE '>=100' END AS bucket FROM events)"))
def latency_by_bucket(spark, d):
    rows = table(spark, d, "events").withColumn("bucket", telemetry.bucket(F.get_json_object("props", "$.k").cast("long"), telemetry.SIZES[:2], ">=100"))
    return telemetry.latency_stats(rows, "value", ["bucket"])


@query("SELECT event_type, count(*) AS count, round(avg(value), 4) AS mean, round(list_sort(list(value))[CAST(floor(count(*) * 0.9::DOUBLE) AS BIGINT) + 1], 4) AS p90, round(100 * count(DISTINCT user_id) / (SELECT count(DISTINCT user_id) FROM events), 2) AS operations, round(100 * sum(value) / (SELECT sum(value) FROM events), 2) AS time FROM events GROUP BY event_type")
def component_breakdown(spark, d):
    return telemetry.component_breakdown(table(spark, d, "events"), "event_type", "value", "user_id")


@query("WITH x AS (SELECT avg(CAST(h AS INT)) AS r, avg(value) FILTER (h) AS h, avg(value) FILTER (NOT h) AS m FROM (SELECT value, event_type = 'view' AS h FROM events)) SELECT round(100 * r, 1) AS hit_rate, round(h, 1) AS hit_mean, round(m, 1) AS miss_mean, round(m - h, 1) AS saved, round(100 * (m - h) / m, 1) AS saved_per_cent FROM x")
def cache_efficiency(spark, d):
    return telemetry.cache_efficiency(table(spark, d, "events"), F.col("event_type") == "view", "value")


def _bucket_query(unit):
    QUERIES[f"usage_time_buckets_{unit}"] = lambda spark, d: telemetry.time_distribution(table(spark, d, "events"), "ts", unit)
    SQL[f"usage_time_buckets_{unit}"] = f"SELECT strftime(ts, {_FMT[unit]}) AS period, count(*) AS n FROM events GROUP BY 1"


for _u in _FMT:
    _bucket_query(_u)


@query("WITH p AS (SELECT strftime(ts, '%Y-W%V') AS period, count(*) AS n, avg(value) AS m FROM events GROUP BY 1) SELECT period, n, round(m, 4) AS mean, round(m - lag(m) OVER (ORDER BY period), 4) AS change FROM p")
def perf_trend(spark, d):
    return telemetry.trend(table(spark, d, "events"), "ts", "value", "week")


@query("SELECT event_type, round(min(value), 4) AS min, round(max(value), 4) AS max, round(avg(value), 4) AS mean, count(value) AS count, round(sum(value), 2) AS sum, round(arg_max(value, event_id), 4) AS last FROM events GROUP BY event_type")
def tracker_last(spark, d):
    return telemetry.tracker(table(spark, d, "events"), "event_type", "value", "event_id")


@query("SELECT event_id FROM (SELECT event_id, row_number() OVER (PARTITION BY event_type ORDER BY event_id DESC) AS r FROM events) WHERE r <= 7")
def last_measurements(spark, d):
    return telemetry.last_n(table(spark, d, "events"), 7, "event_id", "event_type").select("event_id")


@query("SELECT event_id, round(count(*) OVER (PARTITION BY event_type ORDER BY ts RANGE BETWEEN INTERVAL 60 SECONDS PRECEDING AND CURRENT ROW) / 60, 6) AS rate FROM events")
def sliding_rate(spark, d):
    return telemetry.rate(table(spark, d, "events"), "ts", "event_type").select("event_id", "rate")


@query("SELECT event_type, count(*) AS uses, count(DISTINCT user_id) AS users, round(count(*) / count(DISTINCT user_id), 4) AS per_user FROM events GROUP BY event_type")
def feature_popularity(spark, d):
    return telemetry.popularity(table(spark, d, "events"), "event_type", "user_id")


@query(f"SELECT features, count(*) AS sessions FROM (SELECT array_to_string(list_sort(list(DISTINCT event_type)), '+') AS features FROM {_S} GROUP BY session_id HAVING count(DISTINCT event_type) >= 2) GROUP BY features ORDER BY sessions DESC, features LIMIT 10")
def feature_combos(spark, d):
    return telemetry.combinations(_events(spark, d), "event_type", 10)


@query(f"WITH s AS (SELECT DISTINCT session_id, event_type FROM {_S}) SELECT a.event_type AS a, b.event_type AS b, count(*) AS sessions FROM s a JOIN s b USING (session_id) WHERE a.event_type <> b.event_type GROUP BY 1, 2")
def feature_cooccurrence(spark, d):
    return telemetry.co_occurrence(_events(spark, d), "event_type")


@query("WITH u AS (SELECT user_id, count(*) AS n FROM events GROUP BY 1), m AS (SELECT avg(n) AS m FROM u) SELECT CASE WHEN n > 2 * m THEN 'high' WHEN n >= m THEN 'medium' ELSE 'low' END AS segment, event_type AS event_type, count(*) AS uses FROM events JOIN u USING (user_id), m GROUP BY 1, 2")
def user_segments(spark, d):
    return telemetry.segments(table(spark, d, "events"), "user_id", "event_type")


@query(f"""WITH s AS (SELECT count(*)::DOUBLE AS e, (epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6 AS t FROM {_S} GROUP BY session_id HAVING count(*) >= 2) SELECT count(*) AS sessions, round(min(t), 4) AS seconds_min, round(max(t), 4) AS seconds_max,
  round(avg(t), 4) AS seconds_mean, round(median(t), 4) AS seconds_median, round(min(e), 4) AS events_min, round(max(e), 4) AS events_max, round(avg(e), 4) AS events_mean, round(median(e), 4) AS events_median FROM s""")
def session_stats(spark, d):
    return telemetry.session_stats(_events(spark, d), "ts")


@query(f"SELECT a AS \"from\", b AS \"to\", count(*) AS n FROM (SELECT event_type AS a, lead(event_type) OVER (PARTITION BY session_id ORDER BY ts, event_id) AS b FROM {_S}) WHERE b IS NOT NULL GROUP BY 1, 2")
def session_transitions(spark, d):
    return telemetry.transitions(_events(spark, d), "ts", "event_type", "event_id")


@query(f"SELECT first, last, count(*) AS sessions FROM (SELECT arg_min(event_type, (ts, event_id)) AS first, arg_max(event_type, (ts, event_id)) AS last FROM {_S} GROUP BY session_id) GROUP BY 1, 2")
def session_ends(spark, d):
    return telemetry.ends(_events(spark, d), "ts", "event_type", "event_id")


@query(f"WITH s AS {_S} SELECT event_type, count(*) AS events, count(DISTINCT session_id) AS sessions, count(DISTINCT user_id) AS users FROM s GROUP BY 1")
def engagement(spark, d):
    return telemetry.engagement(_events(spark, d), "user_id", "ts", "event_type")


def _retention_query(name, days):
    QUERIES[f"retention_{name}"] = lambda spark, d: telemetry.retention(table(spark, d, "events"), "user_id", "ts", days)
    SQL[f"retention_{name}"] = f"""WITH a AS (SELECT DISTINCT user_id AS u, CAST(ts AS DATE) AS d FROM events), f AS (SELECT min(d) AS f FROM a), b AS (SELECT u, d AS c FROM a, f WHERE (d - f) % {days} = 0)
      SELECT c AS cohort, count(*) AS base, count(*) FILTER (EXISTS (SELECT 1 FROM a WHERE a.u = b.u AND a.d >= b.c + {days} AND a.d < b.c + {2 * days})) AS retained,
      round(count(*) FILTER (EXISTS (SELECT 1 FROM a WHERE a.u = b.u AND a.d >= b.c + {days} AND a.d < b.c + {2 * days})) / count(*), 4) AS rate FROM b GROUP BY c"""


for _n, _days in (("day", 1), ("week", 7), ("month", 30)):
    _retention_query(_n, _days)


# --- errors: the events of type error, with their kind made from k


def _errors(spark, d):
    rows = _events(spark, d).where("event_type = 'error'")
    k = F.get_json_object("props", "$.k").cast("long")
    message = F.when(k % 5 == 0, "Fatal: cannot fetch page").when(k % 5 == 1, "Severe: connection refused").when(k % 5 == 2, "Request timed out").when(k % 5 == 3, "Invalid schema").otherwise("Login is a minor problem")
    rows = rows.withColumns({"message": message, "code": F.when(k % 7 > 0, 300 + 3 * k)})
    return rows.withColumns({"severity": telemetry.severity(F.col("message"), F.col("code")), "category": telemetry.category(F.col("message"))})


_E = f"""(SELECT *, CASE k % 5 WHEN 0 THEN 'critical' WHEN 1 THEN 'high' WHEN 4 THEN 'low' ELSE CASE WHEN k % 7 = 0 THEN 'medium' WHEN 300 + 3 * k >= 500 THEN 'high' WHEN 300 + 3 * k >= 400 THEN 'medium' ELSE 'low' END END AS severity,
  CASE k % 5 WHEN 0 THEN 'retrieval' WHEN 1 THEN 'connection' WHEN 2 THEN 'timeout' WHEN 3 THEN 'validation' ELSE 'authentication' END AS category
  FROM (SELECT *, CAST(props->>'k' AS BIGINT) AS k FROM {_S} WHERE event_type = 'error'))"""


@query("SELECT strftime(ts, '%Y-%m-%d') AS period, count(*) FILTER (event_type = 'error') AS errors, count(*) AS \"all\", round(count(*) FILTER (event_type = 'error') / count(*), 6) AS rate FROM events GROUP BY 1")
def error_frequency(spark, d):
    return telemetry.error_frequency(table(spark, d, "events"), F.col("event_type") == "error", "ts", "day")


@query(f"SELECT 'severity' AS dimension, severity AS value, count(*) AS n FROM {_E} GROUP BY severity UNION ALL SELECT 'category', category, count(*) FROM {_E} GROUP BY category")
def error_severity(spark, d):
    return telemetry.error_counts(_errors(spark, d), ["severity", "category"])


@query(f"SELECT count(DISTINCT user_id) AS users, count(DISTINCT session_id) AS sessions, CAST(sum(CASE severity WHEN 'critical' THEN 100 WHEN 'high' THEN 50 WHEN 'medium' THEN 20 ELSE 5 END) AS BIGINT) AS score FROM {_E}")
def error_impact(spark, d):
    return telemetry.error_impact(_errors(spark, d), "user_id", "session_id", "severity")


@query(f"WITH m AS (SELECT CASE WHEN k % 3 > 0 THEN value END AS m FROM {_E}) SELECT count(*) AS errors, round(count(m) / count(*), 6) AS rate, round(min(round(m)), 4) AS min, round(max(round(m)), 4) AS max, round(avg(round(m)), 4) AS mean, round(median(round(m)), 4) AS median FROM m")
def error_resolution(spark, d):
    k = F.get_json_object("props", "$.k").cast("long")
    rows = _errors(spark, d).withColumn("closed", F.when(k % 3 > 0, F.col("ts").cast("timestamp") + F.make_interval(mins=F.round("value").cast("int"))))
    return telemetry.resolution(rows, "ts", "closed")


@query(f"SELECT CASE WHEN k % 2 = 0 THEN 'retry' ELSE 'restart' END AS method, count(*) AS n FROM {_E} WHERE k % 3 > 0 AND k % 11 > 0 GROUP BY 1")
def error_methods(spark, d):
    k = F.get_json_object("props", "$.k").cast("long")
    rows = _errors(spark, d).withColumns({"closed": F.when(k % 3 > 0, F.col("ts")), "method": F.when(k % 11 > 0, F.when(k % 2 == 0, "retry").otherwise("restart"))})
    return telemetry.resolution_methods(rows, "closed", "method")


@query("SELECT event_id, CAST(props->>'k' AS INT) AS level FROM events WHERE CAST(props->>'k' AS INT) >= 40 AND ts >= (SELECT min(ts) + INTERVAL 1 DAY FROM events) ORDER BY ts DESC, event_id LIMIT 50")
def error_log_newest(spark, d):
    log = table(spark, d, "events").select(F.col("event_id").alias("id"), F.col("ts").alias("timestamp"), F.get_json_object("props", "$.k").cast("int").alias("level"))
    start = log.agg(F.min("timestamp")).first()[0]
    return telemetry.errors_between(log, start=start + timedelta(days=1), level=40, limit=50).select(F.col("id").alias("event_id"), "level")


_WORDS = r"regexp_extract_all(lower(text), '[\p{L}\p{N}\p{M}_]+')"


@query(f"SELECT term, count(*) AS n FROM (SELECT unnest({_WORDS}) AS term FROM documents) WHERE length(term) >= 3 AND term NOT IN ({', '.join(repr(w) for w in T.STOPWORDS)}) GROUP BY term ORDER BY n DESC, term LIMIT 20")
def frequent_terms(spark, d):
    return telemetry.frequent_terms(table(spark, d, "documents"), "text", 20)


@query(f"SELECT phrase, count(*) AS n FROM (SELECT array_to_string(w[i : i + 2], ' ') AS phrase FROM (SELECT w, unnest(range(1, len(w) - 1)) AS i FROM (SELECT {_WORDS} AS w FROM conversations) WHERE len(w) >= 3)) GROUP BY phrase ORDER BY n DESC, phrase LIMIT 20")
def frequent_phrases(spark, d):
    return telemetry.frequent_phrases(table(spark, d, "conversations"), "text", 3, 20)


# --- cost: events as usage


PRICES = {"view": (3.0, 15.0), "click": (0.25, 1.25), "default": (1.0, 5.0)}
_USAGE = "(SELECT event_type AS model, CAST(props->>'k' AS BIGINT) * 100 AS input_tokens, CAST(props->>'k' AS BIGINT) * 10 AS output_tokens FROM events)"
_PRICE = "(VALUES ('view', 3.0, 15.0), ('click', 0.25, 1.25)) p(model, pi, po)"


def _usage(spark, d):
    k = F.get_json_object("props", "$.k").cast("long")
    rows = table(spark, d, "events").select(F.col("event_type").alias("model"), (k * 100).alias("input_tokens"), (k * 10).alias("output_tokens"))
    return rows, telemetry.price_table(PRICES, rows)


_COST = f"SELECT model, CAST(sum(input_tokens) AS BIGINT) AS input_tokens, CAST(sum(output_tokens) AS BIGINT) AS output_tokens, round((sum(input_tokens) * any_value(coalesce(pi, 1.0)) + sum(output_tokens) * any_value(coalesce(po, 5.0)))::DOUBLE / 1e6, 4) AS cost FROM {_USAGE} LEFT JOIN {_PRICE} USING (model) GROUP BY model"


@query(_COST)
def cost_per_model(spark, d):
    return telemetry.cost_per_model(*_usage(spark, d), "default")


@query(f"WITH m AS (SELECT model, sum(input_tokens) AS i, sum(output_tokens) AS o FROM {_USAGE} GROUP BY model), s AS (SELECT arg_max(model, (i + o, model)) AS model, sum(i) AS i, sum(o) AS o FROM m) SELECT model, CAST(i AS BIGINT) AS input_tokens, CAST(o AS BIGINT) AS output_tokens, round((i * coalesce(pi, 1.0) + o * coalesce(po, 5.0))::DOUBLE / 1e6, 4) AS cost FROM s LEFT JOIN {_PRICE} USING (model)")
def cost_dominant_model(spark, d):
    return telemetry.cost_dominant_model(*_usage(spark, d), "default")


@query(f"WITH c AS ({_COST}) SELECT coalesce(model, 'all') AS model, round(sum(cost), 4) AS cost FROM c GROUP BY ROLLUP (model)")
def cost_rollup(spark, d):
    return telemetry.cost_rollup(cost_per_model(spark, d), ["model"])


# --- texts


@query(r"""SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '\r\n?', chr(10), 'g'), ' +', ' ', 'g'), '\n{3,}', chr(10) || chr(10), 'g'), '^[ \t\n\r]+|[ \t\n\r]+$', '', 'g') AS text FROM documents""")
def clean_whitespace(spark, d):
    return table(spark, d, "documents").select("doc_id", T.normalize_whitespace(F.col("text")).alias("text"))


@query(r"""SELECT conv_id, turn, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, 'https?://[^ \t\n\r]+|www\.[^ \t\n\r]+', '', 'g'), '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}', '', 'g'), '\+?[0-9()-][0-9() -]{5,}[0-9]', '', 'g'), '@[A-Za-z0-9_]+', '', 'g'), '<[^>]+>', '', 'g'), '[ \t\n\r\f\x0B]+', ' ', 'g')) AS text FROM conversations""")
def clean_noise(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", T.remove_noise(F.col("text")).alias("text"))


@query(rf"SELECT conv_id, turn, array_to_string(list_filter(list_filter(regexp_split_to_array(text, '[ \t\n\r\f\x0B]+'), lambda w: w <> ''), lambda w: NOT list_contains(['{"', '".join(T.STOPWORDS)}'], lower(w)) AND length(w) >= 3), ' ') AS text FROM conversations")
def clean_stopwords(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", T.remove_stopwords(F.col("text"), min_length=3).alias("text"))


@query("SELECT doc_id, string_agg(l, chr(10) ORDER BY i) AS text FROM (SELECT doc_id, l, min(i) AS i FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS l, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents) GROUP BY doc_id, l) GROUP BY doc_id")
def dedup_lines(spark, d):
    return table(spark, d, "documents").select("doc_id", T.dedup_lines(F.col("text")).alias("text"))


@query("SELECT doc_id, min(doc_id) OVER (PARTITION BY sha256(text)) AS first FROM documents")
def dedup_exact(spark, d):
    return corpus.exact_duplicates(table(spark, d, "documents"), "doc_id", "text")


_TOK = r"list_filter(regexp_split_to_array({}, '[ \t\n\r\f\x0B]+'), lambda w: w <> '')"


@query(rf"SELECT doc_id, CAST(length(text) AS INT) AS n_chars, CAST(len({_TOK.format('text')}) AS INT) AS n_words, CAST(CASE WHEN length(text) = 0 THEN 0 ELSE len(string_split(regexp_replace(text, '\n$', ''), chr(10))) END AS INT) AS n_lines, round(len({_TOK.format('text')}) / 250.0::DOUBLE, 2) AS reading_minutes FROM documents")
def doc_stats(spark, d):
    return table(spark, d, "documents").select("doc_id", T.basic_metadata(F.col("text")).alias("m")).select("doc_id", "m.*")


_SENT = r"list_filter(list_transform(regexp_split_to_array(text, '[.!?]+'), lambda s: trim(regexp_replace(s, '[ \t\n\r\f\x0B]+', ' ', 'g'))), lambda s: s <> '')"


@query(rf"""WITH x AS (SELECT doc_id, {_TOK.format('text')} AS w, greatest(len({_SENT}), 1)::DOUBLE AS ns, length(regexp_replace(text, '[ \t\n\r\f\x0B]+', '', 'g')) AS letters, length(text) >= 50 AS is_long FROM documents),
  y AS (SELECT *, greatest(len(w), 1)::DOUBLE AS nw, coalesce(list_sum(list_transform(w, lambda t: greatest(1, len(regexp_extract_all(lower(t), '[aeiouy]+'))))), 0) AS syl FROM x)
  SELECT doc_id, CASE WHEN is_long THEN round(greatest(0, least(100, 206.835::DOUBLE - 1.015::DOUBLE * (nw / ns) - 84.6::DOUBLE * (syl / nw))), 4) END AS flesch, CASE WHEN is_long THEN round(greatest(0, least(18, 0.39::DOUBLE * (nw / ns) + 11.8::DOUBLE * (syl / nw) - 15.59::DOUBLE)), 4) END AS grade, CASE WHEN is_long THEN round(greatest(0, least(18, 4.71::DOUBLE * (letters / nw) + 0.5::DOUBLE * (nw / ns) - 21.43::DOUBLE)), 4) END AS ari FROM y""")
def readability(spark, d):
    return table(spark, d, "documents").select("doc_id", T.readability(F.col("text")).alias("r")).select("doc_id", "r.*")


@query(rf"WITH x AS (SELECT doc_id, {_TOK.format('lower(text)')} AS w, greatest(len({_SENT}), 1) AS ns FROM documents) SELECT doc_id, round((least(1.0, len(w) / ns / 25.0::DOUBLE) + least(1.0, 2.0 * len(list_distinct(w)) / greatest(len(w), 1))) / 2, 6) AS density FROM x")
def info_density(spark, d):
    return table(spark, d, "documents").select("doc_id", F.round(T.information_density(F.col("text")), 6).alias("density"))


@query(rf"SELECT conv_id, turn, round(length(text) / 100.0::DOUBLE + len(list_distinct({_TOK.format('lower(text)')})) / 10.0::DOUBLE * 1.5 + length(regexp_replace(text, '[A-Za-z0-9_ \t\n\r]|[^\x00-\x7F]', '', 'g')) * 0.5::DOUBLE, 4) AS complexity FROM conversations")
def query_complexity(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", F.round(T.query_complexity(F.col("text")), 4).alias("complexity"))


@query(r"""WITH x AS (SELECT conv_id, turn, lower(regexp_extract(text, '^[ \t\n]*([A-Za-z]+)', 1)) AS f FROM conversations) SELECT conv_id, turn, CASE WHEN f IN ('what', 'which', 'who', 'where', 'when') THEN 'fact' WHEN f = 'how' THEN 'method' WHEN f = 'why' THEN 'reason' WHEN f IN ('is', 'are', 'was', 'can', 'do', 'does', 'did', 'will') THEN 'polar' ELSE 'other' END AS kind FROM x""")
def question_type(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", T.question_type(F.col("text")).alias("kind"))


_DOUBT = "round(least(1.0, (" + " + ".join(f"CASE WHEN contains(lower(text), '{p.lower()}') THEN {w} ELSE 0 END" for w, ps in T.DOUBT.values() for p in ps) + ")::DOUBLE / 4), 6)"


@query(f"SELECT *, CASE WHEN doubt < 0.5 THEN 'none' WHEN doubt >= 0.8 THEN 'high' WHEN doubt >= 0.6 THEN 'medium' ELSE 'low' END AS severity FROM (SELECT conv_id, turn, {_DOUBT} AS doubt FROM conversations)")
def uncertainty_markers(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", T.uncertainty(F.col("text")).alias("u")).select("conv_id", "turn", "u.*")


@query(rf"WITH p AS (SELECT conv_id, turn, text, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS prev FROM conversations), t AS (SELECT conv_id, turn, list_distinct({_TOK.format('lower(text)')}) AS a, list_distinct({_TOK.format('lower(prev)')}) AS b FROM p WHERE prev IS NOT NULL) SELECT conv_id, turn, round(CASE WHEN len(list_distinct(list_concat(a, b))) = 0 THEN 0 ELSE len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))) END, 6) AS similarity FROM t")
def adjacent_similarity(spark, d):
    from pyspark.sql import Window

    rows = table(spark, d, "conversations").withColumn("prev", F.lag("text").over(Window.partitionBy("conv_id").orderBy("turn"))).where("prev IS NOT NULL")
    return rows.select("conv_id", "turn", F.round(T.jaccard(F.col("text"), F.col("prev")), 6).alias("similarity"))


@query("SELECT page_id, regexp_extract(html, '(?is)<title>(.*?)</title>', 1) AS title, CAST(len(regexp_extract_all(html, 'href=\"([^\"]*)\"', 1)) AS INT) AS links FROM pages")
def html_title_links(spark, d):
    return table(spark, d, "pages").select("page_id", T.html_title(F.col("html")).alias("title"), F.size(T.html_links(F.col("html"))).alias("links"))


def _stripped(html: str) -> str:
    text = rf"regexp_replace({html}, '(?is)<(script|style)\b[^>]*>.*?</(script|style)>', '', 'g')"
    text = rf"regexp_replace(regexp_replace({text}, '(?i)</?(p|div|br|h[1-6]|li|tr|ul|ol|table|article|section|nav|footer)\b[^>]*>', chr(10), 'g'), '<[^>]*>', '', 'g')"
    for k, v in T.ENTITIES.items():
        text = f"replace({text}, '{k}', '{v.replace(chr(39), chr(39) * 2)}')"
    return rf"regexp_replace(regexp_replace({text}, '\n+', chr(10), 'g'), '^\n|\n$', '', 'g')"


@query(f"SELECT page_id, {_stripped('html')} AS text FROM pages")
def html_strip(spark, d):
    return table(spark, d, "pages").select("page_id", T.strip_html(F.col("html")).alias("text"))


# --- chunks


_CHUNKED = "SELECT doc_id, CAST(generate_subscripts(c, 1) - 1 AS INT) AS chunk_index, CAST(len(c) AS INT) AS chunk_count, unnest(c) AS content FROM ({})"


@query(_CHUNKED.format("SELECT doc_id, list_transform(range(1, length(text) + 1, 450), lambda i: substr(text, i, 500)) AS c FROM documents WHERE length(text) > 0"))
def chunk_fixed(spark, d):
    return chunking.numbered(table(spark, d, "documents"), chunking.fixed(F.col("text"), 500, 50), ["doc_id"])


@query(_CHUNKED.format(rf"SELECT doc_id, list_transform(range(1, len(w) + 1, 80), lambda i: array_to_string(w[i : i + 99], ' ')) AS c FROM (SELECT doc_id, {_TOK.format('text')} AS w FROM documents) WHERE len(w) > 0"))
def chunk_token_window(spark, d):
    return chunking.numbered(table(spark, d, "documents"), chunking.token_windows(F.col("text"), 100, 20), ["doc_id"])


@query(_CHUNKED.format(rf"SELECT doc_id, list_transform(range(1, len(w) + 1, 4), lambda i: array_to_string(w[i : i + 4], '. ')) AS c FROM (SELECT doc_id, {_SENT} AS w FROM documents) WHERE len(w) > 0"))
def chunk_sentence_window(spark, d):
    return chunking.numbered(table(spark, d, "documents"), chunking.sentence_windows(F.col("text"), 5, 1), ["doc_id"])


@query()
def chunk_recursive(spark, d):
    return chunking.chunked(table(spark, d, "documents"), lambda t: chunking.split_recursive(t, 500, 50), "doc_id", "text")


@query()
def chunk_adaptive(spark, d):
    return chunking.chunked(table(spark, d, "documents"), lambda t: chunking.split_adaptive(t, 500), "doc_id", "text")


@query(rf"""WITH p AS (SELECT doc_id, unnest(ps) AS text, generate_subscripts(ps, 1) - 1 AS paragraph FROM (SELECT doc_id, regexp_split_to_array(text, '\n[ \t]*\n') AS ps FROM documents)),
  s AS (SELECT doc_id, paragraph, {_SENT} AS ss FROM p) SELECT doc_id, CAST(paragraph AS INT) AS paragraph, CAST(generate_subscripts(ss, 1) - 1 AS INT) AS sentence, unnest(ss) AS content FROM s""")
def chunk_hierarchy(spark, d):
    return chunking.hierarchy(table(spark, d, "documents"), "doc_id", "text")


def _prepared_sql() -> str:
    folded = r"regexp_replace(text, '[\x00-\x08\x0B-\x1F\x7F-\x9F\p{Cf}\p{Co}\p{Cs}]', '', 'g')"
    clean = _stripped(folded)
    clean = rf"regexp_replace(regexp_replace(regexp_replace(regexp_replace({clean}, '\r\n?', chr(10), 'g'), ' +', ' ', 'g'), '\n{{3,}}', chr(10) || chr(10), 'g'), '^[ \t\n\r]+|[ \t\n\r]+$', '', 'g')"
    facts = rf"CAST(length(t) AS INT) AS n_chars, CAST(len({_TOK.format('t')}) AS INT) AS n_words, CAST(CASE WHEN length(t) = 0 THEN 0 ELSE len(string_split(regexp_replace(t, '\n$', ''), chr(10))) END AS INT) AS n_lines, round(len({_TOK.format('t')}) / 250.0::DOUBLE, 2) AS reading_minutes"
    chunks = "list_transform(range(1, length(t) + 1, 360), lambda i: substr(t, i, 400)) AS c"
    return f"SELECT doc_id, n_chars, n_words, n_lines, reading_minutes, CAST(generate_subscripts(c, 1) - 1 AS INT) AS chunk_index, CAST(len(c) AS INT) AS chunk_count, unnest(c) AS content FROM (SELECT doc_id, {facts}, {chunks} FROM (SELECT doc_id, {clean} AS t FROM documents) WHERE length(t) > 0)"


@query(_prepared_sql())
def prepare_corpus(spark, d):
    return retriever.prepare(table(spark, d, "documents"))


@query()
def augment_swap(spark, d):
    return corpus.augment(table(spark, d, "conversations").select(F.concat_ws("-", "conv_id", "turn").alias("id"), "text"), "swap", 0.1, 2, "id", "text")


# --- results as text, pairs of statements


@query(f"WITH r AS ({_vec_sql('cosine', 3)}) SELECT query_id, string_agg('[' || n || '] ' || t, chr(10) ORDER BY n) AS context FROM (SELECT query_id, substr(d.text, 1, 80) AS t, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS n FROM r JOIN documents d ON d.doc_id = r.id) GROUP BY query_id")
def context_numbered(spark, d):
    found = retrieval.vector_scores(vector_queries(spark, d), table(spark, d, "embeddings"), k=3)
    return corpus.context(found.join(table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text"), "id"), "text", 80, "\n")


@query("""SELECT split_part(key, '-', 1) AS criterion, CAST(split_part(key, '-', 2) AS INT) AS query, count(value) AS n, round(avg(value), 6) AS mean, min(value) AS least, max(value) AS most
  FROM (SELECT 'relevance-1' AS key, l_quantity AS value FROM lineitem UNION ALL SELECT 'relevance-2', l_tax FROM lineitem UNION ALL SELECT 'accuracy-1', l_discount FROM lineitem) GROUP BY ALL""")
def human_eval_unpivot(spark, d):
    rows = table(spark, d, "lineitem").select("l_orderkey", F.col("l_quantity").alias("relevance-1"), F.col("l_tax").alias("relevance-2"), F.col("l_discount").alias("accuracy-1"))
    return metrics.human_evaluation(rows, "l_orderkey")


@query("SELECT count(*) AS n, round(avg(p_size), 6) AS mean, list_sort(list(p_size))[CAST(floor(count(*) / 2) AS INT) + 1] AS median, round(avg(p_size) / 5, 6) AS share FROM part")
def satisfaction(spark, d):
    return metrics.satisfaction(table(spark, d, "part"), "p_size")


# --- streams, here over the table as a batch


@query("SELECT time_bucket(INTERVAL 60 SECONDS, ts) AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def throughput_tumbling(spark, d):
    out = windows.throughput(table(spark, d, "events"), "ts", "event_type")
    return out.withColumn("start", F.col("start").cast("timestamp_ntz"))


@query("WITH RECURSIVE e AS (SELECT event_type, epoch_us(ts) AS t, event_id, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS r FROM events), f AS (SELECT event_type, t AS last, event_id, r FROM e WHERE r = 1 UNION ALL SELECT n.event_type, n.t, n.event_id, n.r FROM f, LATERAL (SELECT * FROM e WHERE e.event_type = f.event_type AND e.t - f.last >= 86400000000 ORDER BY e.r LIMIT 1) n) SELECT event_type, event_id FROM f")
def alert_cooldown(spark, d):
    return windows.alerts(table(spark, d, "events"), "ts", "event_type", "event_id", 86400).select("event_type", "event_id")


@query("""WITH x AS (SELECT user_id, min(epoch_us(ts)) / 1e6 AS created, max(epoch_us(ts)) / 1e6 AS last, count(*) AS n FROM events GROUP BY user_id)
  SELECT user_id, round(created, 3) AS created, round(last, 3) AS last, n, round(last + 3600 * least(2.0::DOUBLE, 1 + n / greatest(1.0::DOUBLE, (last - created) / 3600) / 10), 3) AS expires FROM x""")
def cache_expiry(spark, d):
    out = windows.expiry(table(spark, d, "events"), "user_id", "ts", 3600, "adaptive")
    return out.withColumns({c: F.round(c, 3) for c in ("created", "last")})


# --- particular kinds of texts, caches


@query(rf"""SELECT doc_id, term, n, rank FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, term) AS rank FROM (SELECT doc_id, term, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\p{{L}}]+')) AS term FROM documents)
  WHERE length(term) >= 4 AND term NOT IN ({', '.join(repr(w) for w in T.STOPWORDS)}) GROUP BY doc_id, term)) WHERE rank <= 5""")
def keywords(spark, d):
    return domains.keywords(table(spark, d, "documents"), "doc_id", "text", 5)


@query(r"SELECT doc_id, CAST(len(regexp_extract_all(text, '\b[0-9]{4}-[0-9]{2}-[0-9]{2}\b')) AS INT) AS iso, CASE WHEN length(regexp_extract(text, '^[ \t\r\n]*([^\r\n]+)', 1)) <= 100 THEN trim(regexp_extract(text, '^[ \t\r\n]*([^\r\n]+)', 1)) END AS title FROM documents WHERE NOT regexp_matches(text, '(?m)^# +(.+)$')")
def title_and_dates(spark, d):
    return table(spark, d, "documents").select("doc_id", F.size(F.regexp_extract_all("text", F.lit(f"({domains.DATES[0]})"), F.lit(1))).alias("iso"), domains.title(F.col("text")).alias("title"))


@query(r"SELECT doc_id, CAST(len(list_distinct(regexp_extract_all(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}'))) AS INT) AS emails, CAST(len(list_distinct(regexp_extract_all(text, '[A-Z][a-z]+(?: [A-Z][a-z]+)+'))) AS INT) AS names FROM documents")
def entity_counts(spark, d):
    return table(spark, d, "documents").select("doc_id", domains.entities(F.col("text")).alias("e")).select("doc_id", F.size("e.emails").alias("emails"), F.size("e.names").alias("names"))


@query("SELECT event_type, round(arg_max(value, ts), 4) AS current, round(avg(value), 4) AS mean, round(min(value), 4) AS min, round(max(value), 4) AS max, CASE WHEN arg_max(value, ts) > arg_min(value, ts) THEN 'up' WHEN arg_max(value, ts) < arg_min(value, ts) THEN 'down' ELSE 'flat' END AS trend, round((arg_max(value, ts) - arg_min(value, ts)) / count(*), 6) AS growth, round(avg(value) * 2592000 / ((epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6 / greatest(count(*) - 1, 1)), 2) AS monthly FROM events GROUP BY event_type")
def cache_dashboard(spark, d):
    return caching.dashboard(table(spark, d, "events"), "event_type", "ts", "value")


@query("SELECT day, round(r, 6) AS rate, round(avg(r) OVER (ORDER BY day ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 6) AS moving FROM (SELECT CAST(ts AS DATE) AS day, avg(CAST(event_type = 'view' AS INT)) AS r FROM events GROUP BY 1)")
def cache_hit_series(spark, d):
    return caching.hit_series(table(spark, d, "events"), "ts", F.col("event_type") == "view", 3)


@query("SELECT user_id FROM (SELECT user_id, max(ts) AS last FROM events GROUP BY user_id) ORDER BY last DESC, user_id LIMIT 20")
def cache_lru(spark, d):
    entries = table(spark, d, "events").groupBy("user_id").agg(F.max("ts").alias("last"))
    return caching.least_recently_used(entries, 20, "last", "user_id").select("user_id")


@query("WITH p AS (SELECT event_type, round(avg(value), 6) AS value, round(avg(CAST(props->>'k' AS BIGINT)), 6) AS k FROM events GROUP BY 1), o AS (SELECT *, round((value * 0.4 + k * 0.6) / 2, 6) AS overall FROM p) SELECT event_type, value, k, overall, row_number() OVER (ORDER BY overall DESC, event_type) = 1 AS is_best FROM o")
def system_comparison(spark, d):
    rows = table(spark, d, "events").select("event_type", "value", F.get_json_object("props", "$.k").cast("long").alias("k"))
    return domains.compared(rows, {"value": 0.4, "k": 0.6}, "event_type")


@query("SELECT l_orderkey, l_linenumber, round(greatest(l_quantity - 30, 0) * 0.065::DOUBLE, 4) AS cost FROM lineitem")
def cost_tiered(spark, d):
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", telemetry.tiered(F.col("l_quantity"), 30, 0.065).alias("cost"))


@query(r"""WITH l AS (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS n FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents)),
  h AS (SELECT *, regexp_matches(line, '^[A-Z][^|]{0,30}\.$') AS is_header FROM l),
  m AS (SELECT *, coalesce(last_value(CASE WHEN is_header THEN trim(line) END IGNORE NULLS) OVER w, 'preamble') AS section, coalesce(last_value(CASE WHEN is_header THEN n END IGNORE NULLS) OVER w, -1) AS start FROM h WINDOW w AS (PARTITION BY doc_id ORDER BY n)),
  t AS (SELECT doc_id, section, start, string_agg(line, chr(10) ORDER BY n) AS content FROM m GROUP BY ALL) SELECT doc_id, section, arg_max(content, start) AS content FROM t GROUP BY doc_id, section""")
def chunk_sections(spark, d):
    return chunking.sections(table(spark, d, "documents"), "doc_id", "text", r"^[A-Z][^|]{0,30}\.$")


from tessera import catalog_measures, catalog_plans, catalog_rest, catalog_usage  # noqa: E402, F401  they register queries of their own
