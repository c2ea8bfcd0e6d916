"""Multi-hop retrieval: what a hop finds asks the next one, and no question sees the same content twice."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.text import let
from tessera.operators.retrieval import counted
from tessera.tables import written


def content_key(text: Column) -> Column:
    return F.sha2(text, 256)


def frequent_words(text: Column, n: int = 8, least: int = 5) -> Column:
    """A question of a text's n most frequent words of `least` letters or more, in order of their number, then the alphabet; null if it has none."""

    def of(words: Column) -> Column:
        each = F.transform(counted(words), lambda x: F.struct((-x["tf"]).alias("k"), x["term"].alias("w")))
        return F.array_join(F.transform(F.slice(F.array_sort(each), 1, n), lambda x: x["w"]), " ")

    out = let(F.regexp_extract_all(F.lower(text), F.lit(rf"[\p{{L}}]{{{least},}}"), F.lit(0)), of)
    return F.nullif(out, F.lit(""))


def hops(
    questions: DataFrame, docs: DataFrame, retrieve: Callable[[DataFrame], DataFrame], n_hops: int = 3, width: int = 2, follow_up: Callable[[Column, Column], Column] | None = None,
    id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """(question_id, hop, query, id, rank, score): the passages of questions(query_id, query) over docs, hop by hop.

    retrieve: a function of (query_id, query) to (query_id, id, score, rank), such as a Retriever's. Of what a hop finds, passages whose content a question has seen in an earlier hop go, and of equal contents of one hop the
    best stays (by rank, then query, then id). The best `width` new passages of a question ask the next hop: follow_up(query, content) gives a query or null, by default the passage's frequent words; a model stands there as a UDF. The
    frontier is so bounded by width questions each. Passages without text count as found, not as seen, and ask nothing. Frontier, findings and seen contents are written, so each hop's plan starts from tables.
    """
    ask = follow_up or (lambda query, content: frequent_words(content))
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("content"))
    frontier = written(questions.where(F.col("query").isNotNull()).select(F.col("query_id").alias("question_id"), F.col("query_id").cast("string").alias("asked"), "query"), "frontier")
    found, seen = None, None
    for hop in range(1, n_hops + 1):
        results = retrieve(frontier.select(F.col("asked").alias("query_id"), "query"))
        own = results.withColumnRenamed("query_id", "asked").join(frontier, "asked").join(texts, "id", "left").withColumn("key", content_key(F.col("content")))
        if seen is not None:
            own = own.join(seen, ["question_id", "key"], "left_anti")
        best = Window.partitionBy("question_id", F.coalesce("key", F.concat(F.lit("#"), F.col("id").cast("string")))).orderBy("rank", "query", "id")
        new = own.withColumn("_r", F.row_number().over(best)).where("_r = 1").drop("_r").withColumn("hop", F.lit(hop))
        new = written(new.select("question_id", "hop", "query", "id", "rank", "score", "key"), "hop")
        found = new if found is None else found.unionByName(new)
        if hop == n_hops:
            break
        keys = new.where("key IS NOT NULL").select("question_id", "key")
        seen = keys if seen is None else seen.unionByName(keys)
        order = Window.partitionBy("question_id").orderBy("rank", "query", "id")
        first = new.where("key IS NOT NULL").withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= width)
        asked = first.join(texts, "id").select("question_id", F.concat_ws("/", F.col("question_id").cast("string"), F.lit(str(hop + 1)), F.col("_n").cast("string")).alias("asked"), ask(F.col("query"), F.col("content")).alias("query"))
        frontier = written(asked.where("query IS NOT NULL"), "frontier")
    return found.drop("key")
