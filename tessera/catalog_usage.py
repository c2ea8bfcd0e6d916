"""Queries over usage, errors and costs, and over ranked lists, beside those of the catalog, which imports this module last."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators import embeddings, fusion, metrics, retrieval, statistics, telemetry
from tessera.registry import QUERIES, SQL, query, table

# --- distributions


def _lengths(unit: str, expr: str) -> str:
    return f"SELECT '{unit}' AS unit, v AS value, n, min(v) OVER () AS least, max(v) OVER () AS most, round(sum(v * n) OVER () / sum(n) OVER (), 6) AS mean FROM (SELECT {expr} AS v, count(*) AS n FROM conversations GROUP BY 1)"


_TOK = r"list_filter(regexp_split_to_array({}, '[ \t\n\r\f\x0B]+'), lambda w: w <> '')"


@query(_lengths("chars", "length(text)") + " UNION ALL " + _lengths("words", f"len({_TOK.format('text')})"))
def query_lengths(spark, d):
    rows = table(spark, d, "conversations").select(F.explode(F.array(
        F.struct(F.lit("chars").alias("unit"), F.length("text").alias("v")), F.struct(F.lit("words").alias("unit"), F.size(T.tokens(F.col("text"))).alias("v")),
    )).alias("x"))
    return statistics.distribution(rows.select("x.unit", "x.v"), F.col("v"), ["unit"])


@query(rf"SELECT value, count(*) AS n, min(value) OVER () AS least, max(value) OVER () AS most, round(sum(value * count(*)) OVER () / sum(count(*)) OVER (), 6) AS mean FROM (SELECT round(length(text) / 100.0::DOUBLE + len(list_distinct({_TOK.format('lower(text)')})) / 10.0::DOUBLE * 1.5 + length(regexp_replace(text, '[A-Za-z0-9_ \t\n\r]|[^\x00-\x7F]', '', 'g')) * 0.5::DOUBLE, 2) AS value FROM conversations) GROUP BY value")
def query_complexity_distribution(spark, d):
    return statistics.distribution(table(spark, d, "conversations"), F.round(T.query_complexity(F.col("text")), 2))


@query(r"""SELECT CASE WHEN regexp_matches(t, '\b(what|who|when|where|why|how)\b.*\?') THEN 'factual' WHEN regexp_matches(t, '\b(how to|steps|guide|tutorial|explain)\b') THEN 'instructional'
  WHEN regexp_matches(t, '\b(compare|versus|vs|difference|better|best)\b') THEN 'comparative' WHEN regexp_matches(t, '\b(opinion|think|feel|believe|recommend)\b') THEN 'opinion'
  WHEN regexp_matches(t, '\b(clarify|explain|elaborate|mean)\b') THEN 'clarification' ELSE 'other' END AS kind, count(*) AS n FROM (SELECT lower(text) AS t FROM conversations) GROUP BY 1""")
def query_kinds(spark, d):
    return table(spark, d, "conversations").groupBy(T.query_kind(F.col("text")).alias("kind")).agg(F.count("*").alias("n"))


def _list(words) -> str:
    return "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + "]"


@query(f"SELECT conv_id, turn, list_has_any({_TOK.format('lower(text)')}, {_list(T.NEGATIONS)}) AS has_negation, list_has_any({_TOK.format('lower(text)')}, {_list(T.COMPARISONS)}) AS has_comparison FROM conversations")
def query_flags(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", T.query_flags(F.col("text")).alias("f")).select("conv_id", "turn", "f.*")


@query("SELECT event_type, 'k' AS name, props->>'k' AS value, count(*) AS n FROM events WHERE props->>'k' IS NOT NULL GROUP BY 1, 3")
def parameter_values(spark, d):
    return statistics.parameter_usage(table(spark, d, "events"), "event_type", "props")


@query("SELECT event_type, coalesce(props->>'status', 'unknown') AS status, count(*) AS n FROM events GROUP BY 1, 2")
def result_status(spark, d):
    return statistics.result_status(table(spark, d, "events"), "event_type", "props")


@query("SELECT 'k' AS name, props->>'k' AS setting, count(cents) AS count, round(avg(cents), 4) AS mean, list_sort(list(cents))[CAST(floor(count(cents) * 0.9::DOUBLE) AS BIGINT) + 1] AS p90 FROM (SELECT *, CAST(round(value * 100) AS BIGINT) AS cents FROM events) WHERE props->>'k' IS NOT NULL GROUP BY 2")
def latency_by_setting(spark, d):
    return telemetry.settings_breakdown(table(spark, d, "events").withColumn("cents", F.round(F.col("value") * 100).cast("long")), "props", "cents")


@query("SELECT event_type, count(*) AS count, round(avg(value), 4) AS mean, round(list_sort(list(value))[CAST(floor(count(*) * 0.9::DOUBLE) AS BIGINT) + 1], 4) AS p90, round(sum(t) / sum(value), 4) AS tokens_per_second, round(avg(f), 4) AS first_mean, round(list_sort(list(f))[CAST(floor(count(*) * 0.9::DOUBLE) AS BIGINT) + 1], 4) AS first_p90 FROM (SELECT event_type, value, CAST(props->>'k' AS BIGINT) * 10 AS t, value / 4 AS f FROM events) GROUP BY event_type")
def generation_latency(spark, d):
    rows = table(spark, d, "events").withColumns({"t": F.get_json_object("props", "$.k").cast("long") * 10, "f": F.col("value") / 4})
    return telemetry.generation_stats(rows, "event_type", "value", "t", "f")


_S = "(SELECT *, user_id || '_' || strftime(ts, '%Y%m%d') AS session_id FROM events)"


@query(f"WITH s AS (SELECT session_id, arg_min(user_id, ts) AS u FROM {_S} GROUP BY session_id) SELECT count(DISTINCT u) AS users, count(*) AS sessions, round(count(*) / count(DISTINCT u), 4) AS sessions_per_user FROM s")
def sessions_per_user(spark, d):
    return telemetry.sessions_per_user(telemetry.sessions(table(spark, d, "events"), "user_id", "ts"), "user_id", "ts")


@query("""WITH u AS (SELECT l_orderkey * 10 + l_linenumber AS id, l_returnflag AS instance, l_quantity AS hours, CAST(floor(l_extendedprice / 10) AS BIGINT) AS iops, l_quantity * 5 AS throughput, l_partkey AS requests FROM lineitem),
  c AS (SELECT id, round(coalesce(CASE instance WHEN 'R' THEN 0.5 WHEN 'A' THEN 0.25 END, 0)::DOUBLE * hours, 4) AS compute_cost, round(greatest(iops - 3000, 0) * 0.005::DOUBLE, 4) AS iops_cost,
    round(greatest(throughput - 125, 0) * 0.04::DOUBLE, 4) AS throughput_cost, round(requests / 1000 * 0.4::DOUBLE, 4) AS request_cost FROM u)
  SELECT id, compute_cost, iops_cost, throughput_cost, request_cost, round(compute_cost + iops_cost + throughput_cost + request_cost, 4) AS total FROM c""")
def cost_cloud(spark, d):
    usage = table(spark, d, "lineitem").select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), F.col("l_returnflag").alias("instance"), F.col("l_quantity").alias("hours"), F.floor(F.col("l_extendedprice") / 10).alias("iops"),
        (F.col("l_quantity") * 5).alias("throughput"), F.col("l_partkey").alias("requests"),
    )
    prices = spark.createDataFrame([("R", 0.5), ("A", 0.25)], "instance string, price double")
    return telemetry.cloud_cost(usage, prices, "aws", 0.4)


# --- ranked lists


def _lists(spark, d):
    return QUERIES["vec_topk_cosine"](spark, d), QUERIES["vec_topk_l2"](spark, d)


def _both() -> str:
    return f"a AS ({SQL['vec_topk_cosine']}), b AS ({SQL['vec_topk_l2']})"


@query(f"WITH {_both()}, h AS (SELECT query_id, count(*) AS h FROM a SEMI JOIN b USING (query_id, id) GROUP BY query_id), m AS (SELECT query_id, coalesce(any_value(h.h), 0) / count(*) AS p FROM a LEFT JOIN h USING (query_id) GROUP BY query_id) SELECT query_id, round(p, 6) AS id_precision, round(p, 6) AS id_recall, round(p, 6) AS id_f1 FROM m")
def overlap_by_id(spark, d):
    a, b = _lists(spark, d)
    return metrics.overlap_by_id(a, b)


@query(f"WITH {_both()} SELECT query_id, count(*) AS n, round(avg(score), 6) AS mean, round(coalesce(stddev_samp(score), 0), 6) AS std, round(coalesce(var_samp(score), 0), 6) AS variance, max(score) AS max, min(score) AS min FROM a GROUP BY query_id")
def result_score_stats(spark, d):
    return statistics.score_stats(_lists(spark, d)[0])


_SIDE = "SELECT query_id, id, round(score, 6) AS {n}_raw, round(CASE WHEN hi = lo THEN score ELSE (score - lo) / (hi - lo) END, 6) AS {n}_score, rank AS {n}_rank, round({w} * CASE WHEN hi = lo THEN score ELSE (score - lo) / (hi - lo) END, 6) AS {n}_part FROM (SELECT *, min(score) OVER (PARTITION BY query_id) AS lo, max(score) OVER (PARTITION BY query_id) AS hi FROM {n})"


def _explained_sql() -> str:
    return f"WITH f AS ({SQL['fuse_linear']}), {_both()} SELECT * FROM f LEFT JOIN ({_SIDE.format(n='a', w=0.7)}) USING (query_id, id) LEFT JOIN ({_SIDE.format(n='b', w=0.3)}) USING (query_id, id)"


@query(_explained_sql())
def fuse_explained(spark, d):
    return fusion.explained(*_lists(spark, d), 10, 0.7, 0.3)


@query(f"""WITH {_both()}, g AS (SELECT *, count(*) FILTER (score >= 0.3) OVER (PARTITION BY query_id) AS good FROM (SELECT query_id, id, score, rank FROM a WHERE rank <= 6)),
  s AS (SELECT query_id, id, round(-score, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(-score, 6) DESC, id) AS rank FROM g WHERE good < 3)
  SELECT query_id, id, score, rank FROM g WHERE good >= 3 UNION ALL SELECT query_id, id, score, rank FROM s WHERE rank <= 3""")
def rerank_cascade_until(spark, d):
    return fusion.cascade_until(_lists(spark, d)[0], [(F.col("score"), 6), (-F.col("score"), 3)], 0.3, 3)


@query(f"""WITH {_both()}, s AS (SELECT query_id, id, CASE WHEN hi = lo THEN 1.0 ELSE (score - lo) / (hi - lo) END AS s FROM (SELECT *, min(score) OVER (PARTITION BY query_id) AS lo, max(score) OVER (PARTITION BY query_id) AS hi FROM a)),
  r AS (SELECT query_id, id, round(s, 6) AS score FROM s) SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM r""")
def rerank_scaled(spark, d):
    a, _ = _lists(spark, d)
    return fusion.rerank(a, fusion.scaled(a), 10)


@query(f"WITH {_both()}, e AS (SELECT query_id, id, exp(score - max(score) OVER (PARTITION BY query_id)) AS e FROM a), r AS (SELECT query_id, id, round(e / sum(e) OVER (PARTITION BY query_id), 6) AS score FROM e) SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM r")
def rerank_softmax(spark, d):
    a, _ = _lists(spark, d)
    return fusion.rerank(a, fusion.softmax(a), 10)


@query(f"""WITH {_both()}, c AS (SELECT a.*, CASE WHEN label % 3 = 0 THEN 'chart' WHEN label % 3 = 1 THEN 'diagram' ELSE 'general' END AS category FROM a JOIN embeddings ON vec_id = id),
  p AS (SELECT *, row_number() OVER (PARTITION BY query_id, category ORDER BY score DESC, id) AS place FROM c), o AS (SELECT * FROM p WHERE place <= CASE category WHEN 'general' THEN 4 ELSE 2 END)
  SELECT query_id, id, score, rank FROM (SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM o) WHERE rank <= 4""")
def topk_per_category(spark, d):
    label = F.col("label") % 3
    kinds = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.when(label == 0, "chart").when(label == 1, "diagram").otherwise("general").alias("category"))
    return retrieval.top_per_category(_lists(spark, d)[0], kinds, {"chart": 0.5, "diagram": 0.5, "general": 1.0}, 4)


# --- clusters of vectors

_CENTRE = "c AS (SELECT label, list(m ORDER BY i) AS c FROM (SELECT label, i, avg(embedding[i]::DOUBLE) AS m FROM embeddings, range(1, 65) t(i) GROUP BY label, i) GROUP BY label)"
_LENGTH = "sqrt(list_sum(list_transform(e, lambda x: x * x)))"


@query(f"""WITH {_CENTRE}, d AS (SELECT label, e, list_distance(e, c) AS d, list_transform(e, lambda x: x / greatest({_LENGTH}, 1e-12)) AS u FROM (SELECT label, embedding::DOUBLE[] AS e FROM embeddings) JOIN c USING (label)),
  s AS (SELECT label, sum(s * s) AS ss FROM (SELECT label, i, sum(u[i]) AS s FROM d, range(1, 65) t(i) GROUP BY label, i) GROUP BY label)
  SELECT label, count(*) AS size, round(avg(d), 5) AS mean_distance, round(max(d), 5) AS max_distance, round(CASE WHEN count(*) = 1 THEN 1.0 ELSE (any_value(ss) - count(*)) / (count(*) * count(*)) END, 5) AS internal_similarity FROM d JOIN s USING (label) GROUP BY label""")
def vec_cluster_stats(spark, d):
    return embeddings.cluster_stats(table(spark, d, "embeddings"), "label")


@query("""WITH e AS (SELECT label, i, embedding[i]::DOUBLE AS x FROM embeddings, range(1, 65) t(i)), p AS (SELECT label, i, count(*) AS n, avg(x) AS m, var_pop(x) * count(*) AS w FROM e GROUP BY ALL),
  a AS (SELECT i, avg(x) AS mean FROM e GROUP BY i), s AS (SELECT sum(n * (m - mean) ** 2) AS b, sum(w) AS w, count(DISTINCT label) AS k, sum(n) FILTER (i = 1) AS n FROM p JOIN a USING (i))
  SELECT round(b * (n - k) / (w * (k - 1)), 4) AS score FROM s""")
def vec_calinski_harabasz(spark, d):
    return embeddings.calinski_harabasz(table(spark, d, "embeddings"), "label")


@query("""WITH p AS (SELECT round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS c FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0)
  SELECT count(*) AS pairs, count(*) FILTER (c >= 0.2) AS close, min(c) AS min, max(c) AS max, round(avg(c), 5) AS mean, round(median(c), 5) AS median, round(stddev_pop(c), 5) AS std FROM p""")
def vec_similarity_profile(spark, d):
    v = table(spark, d, "embeddings")
    return embeddings.similarity_profile(v, v.where("vec_id % 50 = 0"), 0.2)
