"""Searches as products of matrices against searches by column expressions, and over odd vectors."""

import math
import random
import time
from collections import Counter

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessera import catalog
from tessera.functions import text as T
from tessera.functions.vectors import dot, l2, normalized
from tessera.operators import embeddings, fusion, neighbours, retrieval
from tessera.plans.hops import frequent_words


def rows_of(df):
    return sorted(tuple(repr(x) if isinstance(x, float) and math.isnan(x) else x for x in r) for r in df.collect())


@pytest.fixture(scope="module")
def made(spark):
    """Vectors on few points of a grid, so that ties, copies, zeros and halves of the sixth place are common."""
    rng = random.Random(11)
    rows = [(i, [rng.choice([-1.0, 0.0, 1 / 128, 1.0]) for _ in range(3)]) for i in range(2500)] + [(i, [rng.gauss(0, 1) for _ in range(3)]) for i in range(2500, 2600)]
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)


@pytest.mark.parametrize("metric", ["cosine", "euclidean", "dot"])
def test_top_of_products_is_that_of_expressions(spark, made, metric):
    q = made.where("vec_id % 7 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    want = retrieval.top_k(retrieval.vector_scores(q, made, metric), 6)
    assert rows_of(retrieval.vector_scores(q, made, metric, k=6).select(*want.columns)) == rows_of(want)
    named = made.withColumn("vec_id", F.concat(F.lit("k"), F.col("vec_id").cast("string")))
    want = retrieval.top_k(retrieval.vector_scores(q, named, metric), 6)
    assert rows_of(retrieval.vector_scores(q, named, metric, k=6).select(*want.columns)) == rows_of(want)


@pytest.mark.parametrize("metric", ["cosine", "euclidean", "dot"])
def test_odd_vectors_keep_their_scores(spark, made, metric):
    odd = spark.createDataFrame([(900, None), (901, [1.0, None, 2.0]), (902, [float("nan"), 1.0, 2.0]), (903, [float("inf"), 1.0, 2.0]), (904, [1.0]), (905, [])], "vec_id long, embedding array<double>")
    v = made.where("vec_id < 40").unionByName(odd)
    q = v.where("vec_id % 5 = 0 OR vec_id > 900").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    want = retrieval.top_k(retrieval.vector_scores(q, v, metric), 50)
    assert rows_of(retrieval.vector_scores(q, v, metric, k=50).select(*want.columns).fillna(-9.0, ["score"])) == rows_of(want.fillna(-9.0, ["score"]))
    none = retrieval.vector_scores(q, v.limit(0), metric, k=5)
    assert none.count() == 0 and retrieval.vector_scores(q.limit(0), v, metric, k=5).count() == 0


def pairs_as_rows(df):
    """Whether the plan makes a row of each pair: a join without a key."""
    text = df._jdf.queryExecution().executedPlan().toString()
    return "CartesianProduct" in text or "BroadcastNestedLoopJoin" in text


@pytest.mark.parametrize("name", ["vec_topk_cosine", "vec_topk_filtered", "fuse_min", "fuse_weighted", "rerank_ensemble", "retrieve_threshold", "retrieve_rrf", "result_score_stats"])
def test_searches_make_no_row_of_each_pair(spark, name):
    assert not pairs_as_rows(catalog.QUERIES[name](spark, "/root/testdata/sf0.001"))


@pytest.mark.parametrize("name", ["retrieve_bm25_vector", "retrieve_weighted", "fuse_rrf_missing_zero", "fuse_two_modal", "retrieve_contextual", "fuse_interleave", "retrieve_vector_keyword"])
def test_fused_searches_meet_as_blocks(spark, name):
    """Two searches, then a fusion of short lists: both are products of matrices, and no join makes a row of each pair."""
    df = catalog.QUERIES[name](spark, "/root/testdata/sf0.001")
    assert not pairs_as_rows(df) and df._jdf.queryExecution().executedPlan().toString().count("MapInArrow") >= 2


def test_inverted_file_meets_cells_as_blocks(spark, made):
    index, centres = embeddings.ivf(made, 4)
    q = made.where("vec_id % 9 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    found = embeddings.ivf_search(index, centres, q, 5, 4)
    want = retrieval.top_k(retrieval.vector_scores(q, made), 5)
    assert rows_of(found.select(*want.columns)) == rows_of(want)
    assert "MapInArrow" in found._jdf.queryExecution().executedPlan().toString()


def test_fused_halves_are_rounded_up(spark):
    a = spark.createDataFrame([(1, 2, 0.1, 1)], "query_id long, id long, score double, rank int")
    b = spark.createDataFrame([(1, 3, 0.466205, 1)], "query_id long, id long, score double, rank int")
    assert [r.score for r in fusion.keep_best([a, b], 2).collect()] == [0.419585, 0.1]


def plain_pairs(made, q, least):
    u = made.select("vec_id", normalized(F.col("embedding")).alias("u"))
    pairs = u.alias("x").join(u.alias("y"), F.col("x.vec_id") != F.col("y.vec_id")).where(f"x.vec_id {q}")
    return pairs.select(F.col("x.vec_id").alias("a"), F.col("y.vec_id").alias("b"), F.round(dot(F.col("x.u"), F.col("y.u")), 6).alias("similarity")).where(F.col("similarity") >= least)


def test_pairs_profile_and_distances_of_products(spark, made):
    v = made.where("vec_id % 4 = 0").unionByName(spark.createDataFrame([(9000, None), (9001, [1.0, None, 2.0]), (9002, [1.0])], "vec_id long, embedding array<double>"))
    q = v.where("vec_id % 9 = 0")
    assert rows_of(embeddings.similar(v, q, 0.9)) == rows_of(plain_pairs(v, "% 9 = 0", 0.9))
    got = embeddings.similarity_profile(v, q, 0.5).first()
    want = plain_pairs(v, "% 9 = 0", -2.0).agg(F.count("*").alias("n"), F.count_if(F.col("similarity") >= 0.5).alias("close"), F.min("similarity").alias("lo"), F.max("similarity").alias("hi"), F.median("similarity").alias("m")).first()
    assert (got.pairs, got.close, got.min, got.max, got.median) == (want.n, want.close, want.lo, want.hi, round(want.m, 5))
    e = v.where("size(embedding) = 3 AND NOT array_contains(transform(embedding, x -> x IS NULL), true)")
    q = e.where("vec_id % 9 = 0")
    d = e.alias("x").join(q.alias("y"), F.col("x.vec_id") != F.col("y.vec_id")).select(F.col("y.vec_id").alias("vec_id"), F.round(l2(F.col("x.embedding"), F.col("y.embedding")), 6).alias("d"))
    want = d.groupBy("vec_id").agg(F.round(F.avg("d"), 5).alias("any"), F.slice(F.sort_array(F.collect_list("d")), 1, 5).alias("s")).select("vec_id", F.round(F.aggregate("s", F.lit(0.0), lambda a, x: a + x) / 5, 5))
    assert rows_of(embeddings.knn_distance(e, q, 5)) == rows_of(want)


@pytest.mark.parametrize("name", ["vec_pairs_threshold", "vec_knn_outliers", "vec_similarity_profile"])
def test_pairs_of_vectors_are_no_rows(spark, name):
    text = catalog.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in text and "NestedLoopJoin BuildRight, Inner, NOT" not in text and "NestedLoopJoin BuildLeft, Inner, NOT" not in text


def test_words_of_kinds_end_at_letters_beyond_ascii(spark):
    asked = ["der bestä", "besten", "ébest", "what is it?", "what\nis it?", "_best"]
    rows = spark.createDataFrame(list(enumerate(asked)), "i long, t string").select("i", T.query_kind(F.col("t")).alias("k")).orderBy("i")
    assert [r.k for r in rows.collect()] == ["comparative", "other", "comparative", "factual", "other", "other"]


def test_distances_that_are_none_come_last(spark):
    v = spark.createDataFrame([(1, [0.0]), (2, [1.0]), (3, [3.0]), (4, None), (5, [float("nan")])], "vec_id long, embedding array<double>")
    assert [(r.vec_id, repr(r.distance)) for r in embeddings.knn_distance(v, v, 2).orderBy("vec_id").collect()] == [(1, "2.0"), (2, "1.5"), (3, "2.5"), (4, "None"), (5, "nan")]


def test_frequent_words_of_long_texts(spark):
    """Sixteen texts of 20,000 words, 10,000 of them different: counting each word by a scan of the text takes minutes."""
    rng = random.Random(3)
    words = ["".join(rng.choices("abcdefgh", k=7)) for _ in range(10000)]
    texts = [" ".join(rng.choices(words, k=20000) + ["tops"] * 99 + ["zzzzz"] * 50 + ["yyyyy"] * 50) for _ in range(16)]
    rows = spark.createDataFrame([(t,) for t in texts] + [("a b",), ("",), (None,)], "t string")
    start = time.monotonic()
    got = [r.w for r in rows.select(frequent_words(F.col("t"), 3).alias("w")).collect()]
    assert time.monotonic() - start < 30
    for t, w in zip(texts, got):
        counts = Counter(x for x in t.split() if len(x) >= 5)
        assert w == " ".join(sorted(counts, key=lambda x: (-counts[x], x))[:3])
    assert got[16:] == [None, None, None]


def test_pairs_of_copies_leave_in_parts():
    """A tile of copies makes a pair of each two: they leave a slice at a time, not as one result."""
    rows = lambda a, n: pa.StructArray.from_arrays([pa.array(range(a, a + n)), pa.array([[1.0, 2.0]] * n)], ["id", "v"])
    worker = neighbours.Pairs(0.9, "unit")
    worker.start(rows(0, 1500))
    parts = list(worker.take(rows(1000, 1000)))
    assert sum(len(a) for a, _, _ in parts) == 1500 * 1000 - 500 and max(len(a) for a, _, _ in parts) <= neighbours.SLICE
