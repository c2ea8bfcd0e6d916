"""Registered queries take whole texts and whole tables, also where the supplied tables don't show it."""

from tessera import catalog
from tessera.operators import embeddings


def test_hybrid_retrieve_asks_with_whole_texts(spark, tmp_path):
    late = " ".join(f"late{k}" for k in range(20))
    texts = {50: " ".join(f"early{k}" for k in range(60)) + " " + late, 1: late, 2: "early0 other words"}
    spark.createDataFrame([*texts.items()], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    vectors = [(50, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [0.0, 1.0])]
    spark.createDataFrame(vectors, "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    rows = catalog.hybrid_retrieve(spark, str(tmp_path)).collect()
    score = {r.id: r.score for r in rows if r.query_id == 50}
    assert score[1] > 0  # it shares only words behind the first 200 characters


def test_title_and_dates_of_every_row(spark, tmp_path):
    texts = [(1, "Lead on 2024-01-02.\n# The heading\nmore"), (2, None), (3, " First line\n2024-03-04 and 2024-05-06"), (4, "")]
    spark.createDataFrame(texts, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: (r.iso, r.title) for r in catalog.title_and_dates(spark, str(tmp_path)).collect()}
    assert got == {1: (1, "The heading"), 2: (None, None), 3: (2, "First line"), 4: (0, None)}


def test_outliers_are_looked_for_in_every_row(spark, tmp_path):
    vectors = [(i, [float(i % 5), float(i // 5)]) for i in range(1, 31)] + [(77, [500.0, 500.0])]
    spark.createDataFrame(vectors, "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    found = {r.vec_id: r.is_outlier for r in catalog.vec_knn_outliers(spark, str(tmp_path)).collect()}
    assert set(found) == {i for i, _ in vectors} and found[77]


def test_outliers_of_few_or_no_distances(spark):
    rows = spark.createDataFrame([(1, 0.5), (2, 1.5), (3, 4.0), (4, None)], "vec_id long, distance double")
    got = {r.vec_id: r.is_outlier for r in embeddings.outliers(rows, 0.5).collect()}
    assert got == {1: False, 2: False, 3: True, 4: None}
    assert [r.is_outlier for r in embeddings.outliers(rows.where("vec_id = 4"), 0.5).collect()] == [None]


def test_pairs_of_every_row_are_found(spark, tmp_path):
    vectors = [(1, [1.0, 0.0]), (2, [1.0, 0.1]), (3, [-1.0, 0.0]), (50, [0.0, -1.0])]
    spark.createDataFrame(vectors, "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    assert sorted((r.a, r.b) for r in catalog.vec_pairs_threshold(spark, str(tmp_path)).collect()) == [(1, 2), (2, 1)]
