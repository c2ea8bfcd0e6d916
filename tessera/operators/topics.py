"""Topic chunking: a text is cut where the words of the sentences before and after a gap have least in common.

Each gap between sentences has a cohesion, the cosine of the word sets of the blocks on both sides. Its depth is how far it lies below the peaks beside it: going left, and going right, as long as
the cohesion rises. Gaps deeper than the text's mean depth plus `spread` deviations end a topic. Cohesions are made within a row; peaks, depths and cuts are window functions over a document's gaps.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.text import let, sentences


def word_set(sentence: Column, least: int = 4) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(sentence), F.lit(rf"[\p{{L}}]{{{least},}}"), F.lit(0)))


def cohesions(parts: Column, block: int = 3) -> Column:
    """Of an array of sentences the cohesion of each gap, one fewer than sentences, to six places; 0 where a side has no words."""

    def of(sets: Column) -> Column:
        def gap(g: Column) -> Column:
            left = F.array_distinct(F.flatten(F.slice(sets, F.greatest(F.lit(1), g - block + 1), F.least(F.lit(block), g))))
            right = F.array_distinct(F.flatten(F.slice(sets, g + 1, F.lit(block))))
            both = F.size(F.array_intersect(left, right))
            return F.when((F.size(left) > 0) & (F.size(right) > 0), F.round(both / F.sqrt(F.size(left) * F.size(right)), 6)).otherwise(0.0)

        return F.when(F.size(sets) > 1, F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(sets) - 1)), gap)).otherwise(F.array().cast("array<double>"))

    return let(F.transform(parts, lambda s: word_set(s)), of)


def topic_chunks(docs: DataFrame, id_col: str = "doc_id", text: str = "text", block: int = 3, spread: float = 0.5) -> DataFrame:
    """(id_col, chunk_index, chunk_count, content): sentences joined by ". " up to each gap that ends a topic; texts without sentences have no chunk.

    id_col has to name a document. One document's sentences are what a window holds; they move once.
    """
    own = docs.select(id_col, sentences(F.col(text)).alias("_s"))
    each = own.select(id_col, F.posexplode(F.arrays_zip(F.col("_s").alias("s"), cohesions(F.col("_s"), block).alias("c"))).alias("i", "x")).select(id_col, "i", "x.s", "x.c")
    order = Window.partitionBy(id_col).orderBy("i")
    back = Window.partitionBy(id_col).orderBy(F.desc("i"))
    # a peak is where a rise ends: the first gap of a falling run from the left, the last of a rising one to the right
    marked = each.withColumn("rise", (F.col("c") > F.lag("c").over(order)).cast("int")).withColumn("fall", (F.col("c") > F.lag("c").over(back)).cast("int"))
    runs = marked.withColumn("a", F.sum(F.coalesce("rise", F.lit(0))).over(order)).withColumn("b", F.sum(F.coalesce("fall", F.lit(0))).over(back))
    left = F.max("c").over(Window.partitionBy(id_col, "a"))
    right = F.max("c").over(Window.partitionBy(id_col, "b"))
    deep = runs.withColumn("depth", F.when(F.col("c").isNotNull(), F.round(left + right - 2 * F.col("c"), 6)))
    whole = Window.partitionBy(id_col)
    limit = F.round(F.avg("depth").over(whole) + spread * F.stddev_pop("depth").over(whole), 6)
    cut = deep.withColumn("cut", ((F.col("depth") > 0) & (F.col("depth") >= limit)).cast("int")).withColumn(
        "chunk", F.sum(F.coalesce("cut", F.lit(0))).over(order.rowsBetween(Window.unboundedPreceding, -1))
    )
    made = cut.groupBy(id_col, F.coalesce("chunk", F.lit(0)).cast("int").alias("chunk_index")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "s"))), lambda x: x["s"]), ". ").alias("content"))
    return made.select(id_col, "chunk_index", F.count("*").over(whole).cast("int").alias("chunk_count"), "content")
