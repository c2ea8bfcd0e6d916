"""Retrieval: BM25 over an inverted list, keyword and vector top-k, all for many queries at once.

Every result is (query_id, id, score, rank). Ranks follow the rounded score downwards, then the id, so they don't depend on how a sum was split.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.text import GAP, WORD, let, tokens
from tessera.functions.vectors import dot, norm, score
from tessera.operators import lexical, neighbours
from tessera.tables import appended, bucketed, n_partitions, written


#: A block of queries, or of the words of queries with their weights, has so many rows and bytes at most, as it is broadcast.
MOST_QUERIES, MOST_TERMS, MOST_BYTES = 10_000, 200_000, 32 << 20


def top_k(scored: DataFrame, k: int, by: str = "query_id") -> DataFrame:
    """The k best of each query with their rank from 1. Spark keeps k rows a task before it shuffles."""
    order = Window.partitionBy(by).orderBy(F.desc("score"), "id")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def postings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(term, id, tf, dl): how often each lower-cased word is in each document, and the document's length. Written bucketed by term it serves as an index."""
    own = docs.select(F.col(id_col).alias("id"), tokens(F.lower(text_col)).alias("w"))
    return own.select("id", F.size("w").alias("dl"), F.explode("w").alias("term")).groupBy("term", "id").agg(F.count("*").alias("tf"), F.first("dl").alias("dl"))


def counted(words: Column) -> Column:
    """Array of struct(term, tf) of an array of words: each different word and how often it is there. Runs of the sorted words, so no shuffle is needed to count within a text."""

    def runs(x: Column) -> Column:
        starts = F.filter(F.sequence(F.lit(0), F.size(x) - 1), lambda i: (i == 0) | (F.get(x, i) != F.get(x, i - 1)))
        each = let(starts, lambda s: F.transform(s, lambda i, k: F.struct(F.get(x, i).alias("term"), (F.coalesce(F.get(s, k + 1), F.size(x)) - i).cast("long").alias("tf"))))
        return F.when(F.size(x) > 0, each).otherwise(F.array().cast("array<struct<term:string,tf:bigint>>"))

    return let(F.sort_array(words), runs)


def term_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, dl, terms): each document's number of words, and its different words with their counts, lower-cased. Documents are dealt by id, counted where they are, and written
    in buckets by id: an index that searches read instead of texts, with all that a document shares with a query in one task."""
    placed = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).repartition(n_partitions(docs.sparkSession), "id").select("id", F.array_remove(F.split(F.lower(F.coalesce("text", F.lit(""))), GAP), "").alias("w"))
    return bucketed(placed.select("id", F.size("w").alias("dl"), counted(F.col("w")).alias("terms")), "terms", "id")


def bm25(
    queries: DataFrame, docs: DataFrame | None, variant: str = "plus", k1: float = 1.5, b: float = 0.75, delta: float = 0.5, id_col: str = "doc_id", text_col: str = "text", most: int = MOST_TERMS,
    k: int | None = None, index: DataFrame | None = None,
) -> DataFrame:
    """(query_id, id, score) of documents that share a word with queries(query_id, query); variant okapi, l or plus. With k, the k best of each query and their rank.

    A word that a query repeats counts as often. With plus, documents without any hit would all score delta times the sum of idf; that
    constant is in the score of hits, and those documents are left out.

    Texts are read once, for the index of term_counts() (or none is made, with an index). With k, sums over shared words are products of matrices (see lexical), of which a task lets out k rows a query. Without k, and for
    ids that are null, repeated or of other types than ID_TYPES, words' weights are broadcast in blocks of `most` rows and MOST_BYTES at most, and all words that a document shares with a query meet in its own task.
    Pairs of queries and documents are never shuffled.
    """
    own = term_counts(docs, id_col, text_col) if index is None else index
    asked = written(queries.select("query_id", F.explode(tokens(F.lower("query"))).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("qtf")), "asked")
    stats = own.agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"))
    tf = own.select("id", "dl", F.inline("terms"))
    wanted = written(asked.select("term").distinct(), "wanted")
    if _light(wanted, F.octet_length("term") + 32):
        wanted = F.broadcast(wanted)
    df = tf.join(wanted, "term", "left_semi").groupBy("term").agg(F.count("*").alias("df")).crossJoin(F.broadcast(stats))  # stats is one row
    n, d = F.col("n"), F.col("df")
    idf = {"okapi": F.log((n - d + 0.5) / (d + 0.5)), "l": F.log((n + 1) / (d + 0.5)), "plus": F.log((n + 1) / d)}[variant]
    terms = df.select("term", "avgdl", idf.alias("idf"))
    if variant == "okapi":  # words in over half the documents would count against a document
        terms = written(terms, "idf")
        mean = terms.agg(F.avg("idf").alias("mean"))
        terms = terms.crossJoin(F.broadcast(mean)).withColumn("idf", F.when(F.col("idf") < 0, 0.25 * F.col("mean")).otherwise(F.col("idf"))).drop("mean")
    terms = written(terms.orderBy("term").withColumn("t", F.monotonically_increasing_id()), "words")  # numbers in the order of the words, as documents have them
    weights = written(asked.join(terms, "term"), "weights")
    length = 1 - b + b * F.col("dl") / F.col("avgdl")

    def plain(tf: DataFrame, weights: DataFrame) -> DataFrame:
        def scored(w: DataFrame) -> DataFrame:
            out = tf.join(w.drop("t"), "term").groupBy("query_id", "id").agg(F.sum(F.col("qtf") * lexical.parts(variant, F.col("idf"), F.col("tf"), length, k1, delta)).alias("score"))
            if variant == "plus":
                floor = w.groupBy("query_id").agg(F.sum(F.col("qtf") * F.col("idf") * delta).alias("floor"))
                out = out.join(F.broadcast(floor), "query_id").select("query_id", "id", (F.col("score") + F.col("floor")).alias("score"))  # a row for each query of the block
            return out.withColumn("score", F.round("score", 5))

        return in_blocks(weights, "query_id", scored, most, k, F.octet_length("term") + 64)

    if k is None or {dict(asked.dtypes)["query_id"], dict(own.dtypes)["id"]} - set(ID_TYPES):
        return plain(tf, weights)
    odd = own.groupBy("id").agg(F.count("*").alias("n")).where("n > 1 OR id IS NULL").select(F.col("id").alias("odd"))
    rest = []
    if not odd.isEmpty():
        odd = written(odd, "odd")
        is_odd = F.col("id").eqNullSafe(F.col("odd"))
        rest.append(plain(tf.join(odd, is_odd, "left_semi"), weights))
        tf = tf.join(odd, is_odd, "left_anti")
    unnamed = weights.where("query_id IS NULL")
    if not unnamed.isEmpty():
        rest.append(plain(tf, unnamed))
    light = _light(terms, F.octet_length("term") + 64)
    words = tf.join(F.broadcast(terms) if light else terms, "term").select("id", length.alias("length"), "t", "tf")
    if rest or not light:  # joins may have dealt words out; else those of a document still follow each other
        words = words.repartition(n_partitions(own.sparkSession), "id").sortWithinPartitions("id", "t")
    found = lexical.best(words, stats.first().n, weights.where("query_id IS NOT NULL"), k, variant, k1, delta)
    for part in rest:
        found = found.unionByName(part.drop("rank"))
    return top_k(found, k)


def _light(rows: DataFrame, cost: Column) -> bool:
    """Whether rows of so many bytes have MOST_BYTES at most, so that they can be broadcast."""
    return rows.agg(F.coalesce(F.sum(cost), F.lit(0)).alias("bytes")).first().bytes <= MOST_BYTES


def keyword(
    queries: DataFrame, docs: DataFrame | None, id_col: str = "doc_id", text_col: str = "text", most: int = MOST_TERMS, k: int | None = None, index: DataFrame | None = None
) -> DataFrame:
    """(query_id, id, score): share of the query's different words that the document has; with k, the k best of each query and their rank. Laid out like bm25(), over the same index."""
    own = term_counts(docs, id_col, text_col) if index is None else index
    asked = queries.select("query_id", F.array_distinct(tokens(F.lower("query"))).alias("w")).select("query_id", F.size("w").alias("size"), F.explode("w").alias("term"))
    each = own.select("id", F.inline("terms"))

    def scored(w: DataFrame) -> DataFrame:
        hits = each.join(w, "term").groupBy("query_id", "id").agg(F.count("*").alias("hits"), F.first("size").alias("size"))
        return hits.select("query_id", "id", F.round(F.col("hits") / F.col("size"), 5).alias("score"))

    return in_blocks(asked, "query_id", scored, most, k, F.octet_length("term") + 64)


def in_blocks(queries: DataFrame, id_col: str, run: Callable[[DataFrame], DataFrame], most: int = MOST_QUERIES, k: int | None = None, cost: Column | None = None) -> DataFrame:
    """run(broadcast queries) over a stated set of queries: at once while they have `most` rows and MOST_BYTES (by cost, bytes of a row) at most, else in blocks by the hash of id_col, each about half as large.

    With k, the k best of each query: blocks are then run one after another and their results added to one table, so the plan does not grow with the queries.
    """
    size = queries.agg(F.count("*").alias("n"), F.coalesce(F.sum(cost if cost is not None else F.lit(0)), F.lit(0)).alias("bytes")).first()
    best = (lambda out: out) if k is None else (lambda out: top_k(out, k))
    if size.n <= most and size.bytes <= MOST_BYTES:
        return best(run(F.broadcast(queries)))
    blocks = max(-(-2 * size.n // most), -(-2 * size.bytes // MOST_BYTES))
    parts = (best(run(F.broadcast(queries.where(F.pmod(F.xxhash64(id_col), F.lit(blocks)) == i)))) for i in range(blocks))
    if k is not None:
        return appended(parts, "found")
    out = next(parts)
    for part in parts:
        out = out.unionByName(part)
    return out


#: Types of ids that go into matrices' tasks.
ID_TYPES = ("tinyint", "smallint", "int", "bigint", "string")


def vector_scores(queries: DataFrame, vectors: DataFrame, metric: str = "cosine", where: Column | None = None, id_col: str = "vec_id", vector_col: str = "embedding", most: int = MOST_QUERIES, k: int | None = None) -> DataFrame:
    """(query_id, id, score): every vector that `where` lets pass, before top-k, against a stated set of queries(query_id, vector), in blocks of `most` at most; with k, the k best of each query and their rank, as
    vector_top() finds them."""
    rows = (vectors if where is None else vectors.where(where)).select(F.col(id_col).alias("id"), F.col(vector_col).alias("v"))
    asked = queries.select("query_id", "vector")
    return _each(asked, rows, metric, most) if k is None else vector_top(asked, rows, metric, k, most)


def _each(asked: DataFrame, rows: DataFrame, metric: str, most: int, k: int | None = None) -> DataFrame:
    """(query_id, id, score) of all pairs as column expressions."""
    value = score(metric, F.col("vector"), F.col("v"))
    if metric == "cosine":  # lengths once a vector, not once a pair
        rows, asked = rows.withColumn("nv", norm(F.col("v"))), asked.withColumn("nq", norm(F.col("vector")))
        size = F.col("nv") * F.col("nq")
        value = F.when(size == 0, 0.0).otherwise(dot(F.col("vector"), F.col("v")) / size)

    def met(q: DataFrame) -> DataFrame:
        both = rows.join(q, "cell") if "cell" in rows.columns else rows.join(q)
        return both.select("query_id", "id", F.round(value, 6).alias("score"))

    return in_blocks(asked, "query_id", met, most, k, 8 * F.coalesce(F.size("vector"), F.lit(0)) + 64)


def vector_top(asked: DataFrame, rows: DataFrame, metric: str, k: int, most: int = MOST_QUERIES) -> DataFrame:
    """(query_id, id, score, rank): the k best of rows(id, v) for each of asked(query_id, vector); with a column cell in both, within the query's cells.

    Pairs are products of matrices, a block of queries and a tile of rows at a time, and a task lets out k rows a query. Vectors that fit into no matrix (nulls, numbers that are not finite, other lengths) meet all others as column expressions.
    """
    if {dict(asked.dtypes)["query_id"], dict(rows.dtypes)["id"]} - set(ID_TYPES):
        return top_k(_each(asked, rows, metric, most, k).drop("rank"), k)
    points, queries, rest = neighbours.by_evenness(rows, asked.withColumnsRenamed({"query_id": "id", "vector": "v"}))
    found = neighbours.best(points, queries, k, metric)
    for v, q in rest:
        found = found.unionByName(_each(q.withColumnsRenamed({"id": "query_id", "v": "vector"}), v, metric, most, k).drop("rank"))
    return top_k(found, k)


def rescored(results: DataFrame, queries: DataFrame, docs: DataFrame, embed: Callable[[Column], Column], template: str = "{query}", k: int = 10, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Contextual scores of results: cosine of the embedded query, put into the template, and the embedded content of each result; contents that are null or empty drop out.

    embed: a column function text -> vector, such as a pandas UDF around a model.
    """
    from tessera.functions.vectors import cosine

    before, _, after = template.partition("{query}")
    asked = queries.select("query_id", embed(F.concat(F.lit(before), F.col("query"), F.lit(after))).alias("vector"))
    held = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("content")).where("content <> ''")
    pairs = results.select("query_id", "id").join(held, "id").join(asked, "query_id")
    scored = pairs.select("query_id", "id", F.round(cosine(F.col("vector"), embed(F.col("content"))), 6).alias("score"))
    return top_k(scored, k)


def top_per_category(results: DataFrame, categories: DataFrame, shares: dict[str, float], k: int) -> DataFrame:
    """The k best of each query after each category gave its share of k at most (rounded up); categories(id, category), those not named give none."""
    limit = F.lit(0)
    for name, share in shares.items():
        limit = F.when(F.col("category") == name, -int(-share * k // 1)).otherwise(limit)
    own = results.select("query_id", "id", "score").join(categories, "id")
    place = F.row_number().over(Window.partitionBy("query_id", "category").orderBy(F.desc("score"), "id"))
    once = own.withColumn("_place", place).where(F.col("_place") <= limit).groupBy("query_id", "id").agg(F.max("score").alias("score"))
    return top_k(once, k)


def hyde(vectors: DataFrame, by: str, vector_col: str = "embedding") -> DataFrame:
    """(by, vector): mean of the vectors of each group, scaled to length 1."""
    each = vectors.select(by, F.posexplode(vector_col).alias("i", "x")).groupBy(by, "i").agg(F.avg(F.col("x").cast("double")).alias("x"))
    mean = each.groupBy(by).agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("v"))
    size = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))
    return mean.select(by, F.transform("v", lambda x: F.round(x / F.greatest(size, F.lit(1e-12)), 6)).alias("vector"))
