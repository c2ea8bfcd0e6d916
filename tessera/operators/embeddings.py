"""Analysis of embeddings. Means over all pairs come from sums, not from pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.vectors import cosine, dot, l2, normalized
from tessera.operators import neighbours
from tessera.operators.retrieval import ID_TYPES, in_blocks, vector_top
from tessera.operators.statistics import at_ranks, beside
from tessera.session import ship
from tessera.tables import written


def centroids(vectors: DataFrame, by: str, vector: str = "embedding") -> DataFrame:
    """(by, place, mean) of the vectors of each group."""
    return vectors.select(by, F.posexplode(vector).alias("place", "x")).groupBy(by, "place").agg(F.round(F.avg(F.col("x").cast("double")), 6).alias("mean"))


def pair_stats(vectors: DataFrame, vector: str = "embedding") -> DataFrame:
    """One row: n, mean and population deviation of the cosine over all pairs.

    With unit vectors u, the sum over pairs is (|sum u|^2 - sum |u|^2) / 2 and that of squares (|U'U|^2 - sum |u|^4) / 2, so one pass that adds up a
    vector and a d x d matrix is enough, whatever the number of pairs. Each task adds up its own and passes on one row.
    """
    import numpy as np
    import pyarrow as pa

    def run(batches):
        n, total, gram = 0, None, None
        for batch in batches:
            column = batch.column(0).drop_null()
            if not len(column):
                continue
            x = column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(column), -1)
            x = x / np.maximum(np.sqrt((x * x).sum(axis=1, keepdims=True)), 1e-12)
            n, total, gram = n + len(x), x.sum(axis=0) + (0 if total is None else total), x.T @ x + (0 if gram is None else gram)
        if n:
            yield pa.RecordBatch.from_pydict({"n": [n], "s": [total.tolist()], "g": [gram.ravel().tolist()]})

    ship(vectors.sparkSession)
    parts = vectors.select(vector).mapInArrow(run, "n long, s array<double>, g array<double>")
    added = lambda c: parts.select(F.posexplode(c).alias("i", "x")).groupBy("i").agg(F.sum("x").alias("x"))
    d = F.sqrt(F.count("*").cast("double"))
    n = parts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"))
    total = added("s").agg(F.sum(F.col("x") * F.col("x")).alias("t"))
    gram = added("g")
    size = gram.agg(d.cast("long").alias("d"))
    square = gram.crossJoin(F.broadcast(size)).agg(F.sum(F.col("x") * F.col("x")).alias("q"), F.sum(F.when(F.col("i") % (F.col("d") + 1) == 0, F.col("x"))).alias("d"))
    pairs = F.col("n") * (F.col("n") - 1) / 2
    mean, squares = (F.col("t") - F.col("d")) / 2 / pairs, (F.col("q") - F.col("d")) / 2 / pairs
    one = n.crossJoin(square).crossJoin(total)  # a row each
    return one.select("n", F.round(mean, 6).alias("mean"), F.round(F.sqrt(F.greatest(F.lit(0.0), squares - mean * mean)), 6).alias("std"))


def _meeting(vectors: DataFrame, queries: DataFrame, id_col: str, vector: str):
    """Points and queries as neighbours.by_evenness() gives them. Ids of types that go into no matrix's task are all in the rest."""
    v, q = (df.select(F.col(id_col).alias("id"), F.col(vector).alias("v")) for df in (vectors, queries))
    if {t for df in (v, q) for t in dict(df.select("id").dtypes).values()} - set(ID_TYPES):
        return v.limit(0), q.limit(0), [(v, q)]
    return neighbours.by_evenness(v, q)


def _similar_each(v: DataFrame, q: DataFrame, threshold: float) -> DataFrame:
    """(a, b, similarity) of all pairs as column expressions."""
    q, v = q.select(F.col("id").alias("a"), normalized(F.col("v")).alias("u")), v.select(F.col("id").alias("b"), normalized(F.col("v")).alias("v"))
    return in_blocks(q, "a", lambda x: v.join(x, F.col("a") != F.col("b")).select("a", "b", F.round(dot(F.col("u"), F.col("v")), 6).alias("similarity")).where(F.col("similarity") >= threshold))


def similar(vectors: DataFrame, queries: DataFrame, threshold: float, id_col: str = "vec_id", vector: str = "embedding", top: int | None = None) -> DataFrame:
    """(a, b, similarity) of a stated set of queries(id_col, vector) against all rows, at the threshold or above, but for themselves; with top, the best of each query.

    Pairs are products of matrices, and only those at the threshold become rows.
    """
    points, asked, rest = _meeting(vectors, queries, id_col, vector)
    met = neighbours.pairs_from(points, asked, threshold) if top is None else neighbours.best(points, asked, top, "unit", True).where(F.col("score") >= threshold)
    found = met.select(F.col("query_id").alias("a"), F.col("id").alias("b"), F.col("score").alias("similarity"))
    for v, q in rest:
        found = found.unionByName(_similar_each(v, q, threshold))
    if top is None:
        return found
    best = F.row_number().over(Window.partitionBy("a").orderBy(F.desc("similarity"), "b"))
    return found.withColumn("_r", best).where(F.col("_r") <= top).drop("_r")


def similarity_profile(vectors: DataFrame, queries: DataFrame, threshold: float = 0.8, id_col: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """One row over the pairs of a stated set of queries with all other rows: pairs, mean, median, min, max, std (population) of the cosine, pairs at the threshold or above.

    As cosines have six places, each task counts them by value, two million at most, and all figures come from the written counts.
    """
    points, asked, rest = _meeting(vectors, queries, id_col, vector)
    counts = neighbours.cosine_counts(points, asked)
    for v, q in rest:
        counts = counts.unionByName(_similar_each(v, q, -2.0).select("similarity", F.lit(1).cast("long").alias("n")))
    values = written(counts.groupBy("similarity").agg(F.sum("n").alias("n")), "cosines")
    s, n = F.col("similarity"), F.col("n")
    pairs = F.sum("n")
    mean = F.sum(s * n) / pairs
    base = values.agg(
        F.coalesce(pairs, F.lit(0)).alias("pairs"), mean.alias("mean"), F.min("similarity").alias("min"), F.max("similarity").alias("max"),
        F.sqrt(F.greatest(F.lit(0.0), F.sum(s * s * n) / pairs - mean * mean)).alias("std"), F.coalesce(F.sum(F.when(s >= threshold, n)), F.lit(0)).alias("close"),
    )
    # the two middle values: first the thousandth of the range in which each lies, then the value in it
    bucket = F.floor(s * 1000)
    sums = values.groupBy(bucket.alias("b")).agg(F.sum("n").alias("n"))
    before = F.sum("n").over(Window.orderBy("b")) - F.col("n")  # two thousand rows
    placed = sums.withColumn("before", before).crossJoin(F.broadcast(base.select("pairs")))  # a row
    wanted = placed.select("b", "before", "n", F.explode(F.array(F.floor((F.col("pairs") - 1) / 2), F.floor(F.col("pairs") / 2))).alias("at")).where("at >= before AND at < before + n")
    inner = values.withColumn("b", bucket).join(F.broadcast(wanted.select("b", "at", (F.col("at") - F.col("before")).alias("left")).distinct()), "b")  # two rows at most
    upto = inner.withColumn("upto", F.sum("n").over(Window.partitionBy("at").orderBy("similarity")))
    middle = upto.where("left >= upto - n AND left < upto").agg(F.avg("similarity").alias("median"))
    out = base.crossJoin(middle)  # a row each
    return out.select("pairs", "close", "min", "max", *(F.round(c, 5).alias(c) for c in ("mean", "median", "std")))


def cluster_stats(vectors: DataFrame, by: str, vector: str = "embedding") -> DataFrame:
    """(by, size, mean_distance, max_distance, internal_similarity): distances to the mean of the cluster, and the mean over the matrix of its cosines whose
    diagonal counts as 0 (1 for a single vector). The latter comes from the sum of unit vectors, not from pairs."""
    unit = normalized(F.col(vector))
    own = vectors.select(by, F.col(vector).alias("v"), unit.alias("u"))
    sums = own.select(by, F.posexplode(F.arrays_zip("v", "u")).alias("i", "x")).groupBy(by, "i").agg(F.avg(F.col("x.v").cast("double")).alias("c"), F.sum("x.u").alias("s"), F.count("*").alias("n"))
    centre = sums.groupBy(by).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "c"))), lambda x: x["c"]).alias("centre"), F.sum(F.col("s") * F.col("s")).alias("ss"), F.first("n").alias("n"))  # a vector a cluster
    each = own.join(centre, by)
    out = each.groupBy(by).agg(F.first("n").alias("size"), F.round(F.avg(l2(F.col("v"), F.col("centre"))), 5).alias("mean_distance"), F.round(F.max(l2(F.col("v"), F.col("centre"))), 5).alias("max_distance"), F.first("ss").alias("ss"))
    inner = F.when(F.col("size") == 1, 1.0).otherwise((F.col("ss") - F.col("size")) / (F.col("size") * F.col("size")))
    return out.select(by, "size", "mean_distance", "max_distance", F.round(inner, 5).alias("internal_similarity"))


def calinski_harabasz(vectors: DataFrame, by: str, vector: str = "embedding") -> DataFrame:
    """One row, score: spread between the clusters over the spread within them, each by its degrees of freedom. Null for a single cluster."""
    each = vectors.select(by, F.posexplode(vector).alias("i", "x")).withColumn("x", F.col("x").cast("double"))
    per = each.groupBy(by, "i").agg(F.count("*").alias("n"), F.avg("x").alias("m"), (F.var_pop("x") * F.count("*")).alias("w"))
    whole = per.groupBy("i").agg((F.sum(F.col("n") * F.col("m")) / F.sum("n")).alias("mean"))
    sums = per.join(whole, "i").agg(
        F.sum(F.col("n") * (F.col("m") - F.col("mean")) * (F.col("m") - F.col("mean"))).alias("b"), F.sum("w").alias("w"), F.count_distinct(by).alias("k"), F.sum(F.when(F.col("i") == 0, F.col("n"))).alias("n")
    )
    value = F.when((F.col("k") > 1) & (F.col("w") > 0), F.col("b") * (F.col("n") - F.col("k")) / (F.col("w") * (F.col("k") - 1)))
    return sums.select(F.round(value, 4).alias("score"))


def knn_distance(vectors: DataFrame, queries: DataFrame, k: int, id_col: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(id_col, distance): mean distance of each query to its k nearest other rows."""
    points, asked, rest = _meeting(vectors, queries, id_col, vector)
    d = neighbours.best(points, asked, k, "distance", True).select(F.col("query_id").alias("a"), F.col("id").alias("b"), (-F.col("score")).alias("d"))
    for v, q in rest:
        q, v = q.select(F.col("id").alias("a"), F.col("v").alias("u")), v.select(F.col("id").alias("b"), "v")
        d = d.unionByName(in_blocks(q, "a", lambda x, v=v: v.join(x, F.col("a") != F.col("b")).select("a", "b", F.round(l2(F.col("u"), F.col("v")), 6).alias("d"))))
    near = d.withColumn("r", F.row_number().over(Window.partitionBy("a").orderBy(F.asc_nulls_last("d"), "b"))).where(F.col("r") <= k)
    return near.groupBy(F.col("a").alias(id_col)).agg((F.round(F.avg("d") * 1e5) / 1e5).alias("distance"))  # a mean of five has halves of the fifth place: rounded as SQL does, not by its digits


def outliers(distances: DataFrame, contamination: float) -> DataFrame:
    """distances with is_outlier: above the (1 - contamination) quantile, interpolated. Distances are written, as they are read again for the quantile."""
    own = written(distances, "distances")
    place = lambda n: (n - 1) * F.lit(1 - contamination)
    ends = at_ranks(own, "distance", [], {"low": lambda n: F.floor(place(n)), "high": lambda n: F.ceil(place(n))})
    n = own.agg(F.count("distance").alias("n"))
    part = place(F.col("n")) - F.floor(place(F.col("n")))
    limit = beside(n, ends, []).select((F.col("low") + (F.col("high") - F.col("low")) * part).alias("limit"))
    return own.crossJoin(F.broadcast(limit)).withColumn("is_outlier", F.col("distance") > F.col("limit")).drop("limit")  # limit is a row


def as_ml(vectors: DataFrame, vector: str = "embedding") -> DataFrame:
    from pyspark.ml.functions import array_to_vector

    return vectors.withColumn("features", array_to_vector(F.transform(vector, lambda x: x.cast("double"))))


def kmeans(vectors: DataFrame, k: int, seed: int = 42, vector: str = "embedding") -> DataFrame:
    """vectors with cluster."""
    from pyspark.ml.clustering import KMeans

    rows = as_ml(vectors, vector)
    return KMeans(k=k, seed=seed, predictionCol="cluster").fit(rows).transform(rows).drop("features")


def best_kmeans(vectors: DataFrame, least: int = 2, most: int = 6, vector: str = "embedding") -> DataFrame:
    """vectors with cluster, for the number of clusters with the best silhouette."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.evaluation import ClusteringEvaluator

    rows = as_ml(vectors, vector)
    fits = [KMeans(k=k, seed=42, predictionCol="cluster").fit(rows).transform(rows) for k in range(least, most + 1)]
    score = ClusteringEvaluator(predictionCol="cluster", featuresCol="features")
    return max(fits, key=score.evaluate).drop("features")


def pca(vectors: DataFrame, k: int, vector: str = "embedding") -> tuple[DataFrame, list[float]]:
    """vectors with `reduced`, and the share of variance of each component."""
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import vector_to_array

    rows = as_ml(vectors, vector)
    model = PCA(k=k, inputCol="features", outputCol="reduced_").fit(rows)
    return model.transform(rows).withColumn("reduced", vector_to_array("reduced_")).drop("features", "reduced_"), list(model.explainedVariance)


def svd(vectors: DataFrame, k: int, vector: str = "embedding") -> tuple[DataFrame, list[float]]:
    """vectors with `reduced` (projections on the first k right singular vectors, without centring), and the singular values. The d x d Gram matrix is what the driver sees."""
    from pyspark.mllib.linalg import Vectors
    from pyspark.mllib.linalg.distributed import RowMatrix

    ship(vectors.sparkSession)
    matrix = RowMatrix(vectors.select(vector).rdd.map(lambda r: Vectors.dense([float(x) for x in r[0]])))
    found = matrix.computeSVD(k)
    axes = found.V.toArray().T.tolist()
    value = F.array(*(dot(F.col(vector), F.array(*(F.lit(float(x)) for x in axis))) for axis in axes))
    return vectors.withColumn("reduced", value), [float(x) for x in found.s]


def ivf(vectors: DataFrame, nlist: int, seed: int = 42, vector: str = "embedding") -> tuple[DataFrame, list]:
    """An inverted file: vectors with `cell` (to be written partitioned by it), and the centres."""
    from pyspark.ml.clustering import KMeans

    rows = as_ml(vectors, vector)
    model = KMeans(k=nlist, seed=seed, predictionCol="cell").fit(rows)
    return model.transform(rows).drop("features"), [c.tolist() for c in model.clusterCenters()]


def ivf_search(index: DataFrame, centres: list, queries: DataFrame, k: int, nprobe: int, id_col: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query_id, id, score, rank) by cosine within the nprobe cells nearest to each query: blocks of queries meet the vectors of their cell alone."""
    spark = index.sparkSession
    cells = spark.createDataFrame([(i, c) for i, c in enumerate(centres)], "cell int, centre array<double>")
    near = queries.crossJoin(F.broadcast(cells)).withColumn("r", F.row_number().over(Window.partitionBy("query_id").orderBy(l2(F.col("vector"), F.col("centre")), "cell")))
    probes = near.where(F.col("r") <= nprobe).select("query_id", "vector", "cell")
    return vector_top(probes, index.select("cell", F.col(id_col).alias("id"), F.col(vector).alias("v")), "cosine", k)
