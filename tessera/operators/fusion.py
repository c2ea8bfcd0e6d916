"""Fusion of ranked lists. A list is (query_id, id, score, rank); a result has the same columns.

Scores are rounded to 6 digits before they are ranked.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def min_max(results: DataFrame) -> DataFrame:
    """Scores of each query brought to 0..1; equal scores stay as they are."""
    w = Window.partitionBy("query_id")
    low, high = F.min("score").over(w), F.max("score").over(w)
    return results.withColumn("score", F.when(high == low, F.col("score")).otherwise((F.col("score") - low) / (high - low)))


def scaled(results: DataFrame) -> DataFrame:
    """A reranker's scores of each query brought to 0..1; equal scores all become 1."""
    w = Window.partitionBy("query_id")
    low, high = F.min("score").over(w), F.max("score").over(w)
    return results.withColumn("score", F.when(high == low, 1.0).otherwise((F.col("score") - low) / (high - low)))


def softmax(results: DataFrame) -> DataFrame:
    """exp(score) over the sum of it in the query, so the scores add up to 1."""
    w = Window.partitionBy("query_id")
    e = F.exp(F.col("score") - F.max("score").over(w))
    return results.withColumn("_e", e).withColumn("score", F.col("_e") / F.sum("_e").over(w)).drop("_e")


def ranked(scored: DataFrame, k: int) -> DataFrame:
    out = scored.withColumn("score", F.round(F.col("score") * 1e6) / 1e6)  # in doubles: 0.466205 * 0.9 is half a place by its product with 1e6, less by its digits
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return out.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "id", "score", "rank")


def _both(a: DataFrame, b: DataFrame) -> DataFrame:
    x = a.select("query_id", "id", F.col("score").alias("sa"), F.col("rank").alias("ra"))
    y = b.select("query_id", "id", F.col("score").alias("sb"), F.col("rank").alias("rb"))
    return x.join(y, ["query_id", "id"], "full_outer")


def combine(a: DataFrame, b: DataFrame, k: int, how: str = "linear", wa: float = 0.5, wb: float = 0.5, threshold: float | None = None) -> DataFrame:
    """linear: weighted sum; max, min: the greater or lesser score. A list that lacks an id counts 0. A threshold cuts before the limit."""
    sa, sb = F.coalesce("sa", F.lit(0.0)), F.coalesce("sb", F.lit(0.0))
    value: Column = {"linear": wa * sa + wb * sb, "max": F.greatest(sa, sb), "min": F.least(sa, sb)}[how]
    out = _both(a, b).select("query_id", "id", value.alias("score"))
    return ranked(out if threshold is None else out.where(F.col("score") >= threshold), k)


def rrf(lists: Sequence[DataFrame], k: int, constant: int = 60, weights: Sequence[float] | None = None, missing: str = "zero", first: int = 1, mean: bool = False) -> DataFrame:
    """Reciprocal rank fusion: sum of weight / (constant + rank).

    missing: a list without the id adds nothing ("zero") or ranks it behind its last ("last"). first: the rank of the best, 1 or 0. mean: divided by the weights
    of the lists that hold the id.
    """
    weights = weights or [1.0] * len(lists)
    rows = None
    for n, (x, w) in enumerate(zip(lists, weights)):
        part = x.select("query_id", "id", F.lit(n).alias("list"), F.lit(float(w)).alias("w"), (F.col("rank") - 1 + first).alias("r"))
        rows = part if rows is None else rows.unionByName(part)
    out = rows.groupBy("query_id", "id").agg(F.sum(F.col("w") / (constant + F.col("r"))).alias("score"), F.sum("w").alias("ws"), F.collect_set("list").alias("in"))
    if missing == "last":
        for n, (x, w) in enumerate(zip(lists, weights)):
            size = x.groupBy("query_id").agg(F.count("*").alias("n"))
            out = out.join(size, "query_id", "left").withColumn(
                "score", F.col("score") + F.when(F.array_contains("in", n), 0.0).otherwise(w / (constant + F.coalesce("n", F.lit(0)) + first))
            ).drop("n")
    return ranked(out.select("query_id", "id", (F.col("score") / F.col("ws") if mean else F.col("score")).alias("score")), k)


def keep_best(lists: Sequence[DataFrame], k: int, decay: float = 0.1, least: float = 0.2) -> DataFrame:
    """Lists weigh 1, 1 - decay, ... but least at least; an id keeps its best weighted score."""
    rows = None
    for n, x in enumerate(lists):
        part = x.select("query_id", "id", (F.col("score") * max(least, 1.0 - decay * n)).alias("score"))
        rows = part if rows is None else rows.unionByName(part)
    return ranked(rows.groupBy("query_id", "id").agg(F.max("score").alias("score")), k)


def interleave(a: DataFrame, b: DataFrame, k: int) -> DataFrame:
    """By turns from a and b, a first; an id stays where it comes first. A list that ends leaves its turns to the other."""
    rows = a.select("query_id", "id", "score", (2 * F.col("rank")).alias("turn")).unionByName(b.select("query_id", "id", "score", (2 * F.col("rank") + 1).alias("turn")))
    once = rows.groupBy("query_id", "id").agg(F.min_by("score", "turn").alias("score"), F.min("turn").alias("turn"))
    order = Window.partitionBy("query_id").orderBy("turn")
    return once.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "id", F.round("score", 6).alias("score"), "rank")


def ensemble(lists: Sequence[DataFrame], k: int, weights: Sequence[float] | None = None, how: str = "mean") -> DataFrame:
    """Rerankers' scores: mean weighted over the rerankers that scored the id, or the greatest."""
    weights = weights or [1.0] * len(lists)
    rows = None
    for x, w in zip(lists, weights):
        part = x.select("query_id", "id", "score", F.lit(float(w)).alias("w"))
        rows = part if rows is None else rows.unionByName(part)
    value = F.max("score") if how == "max" else F.sum(F.col("w") * F.col("score")) / F.sum("w")
    return ranked(rows.groupBy("query_id", "id").agg(value.alias("score")), k)


def cascade(results: DataFrame, stages: Sequence[tuple[Column, int]], min_results: int = 0) -> DataFrame:
    """Each stage (score, keep) scores what the one before kept and cuts; rows that the first stage saw fill up to min_results, behind."""
    now = results
    for value, keep in stages:
        now = ranked(now.withColumn("score", value), keep)
    if not min_results:
        return now
    rest = ranked(results.join(now, ["query_id", "id"], "left_anti"), min_results)
    rows = now.withColumn("late", F.lit(0)).unionByName(rest.withColumn("late", F.lit(1)))
    order = Window.partitionBy("query_id").orderBy("late", "rank")
    return rows.withColumn("n", F.row_number().over(order)).where((F.col("late") == 0) | (F.col("n") <= min_results)).select("query_id", "id", "score", F.col("n").alias("rank"))


def cascade_until(results: DataFrame, stages: Sequence[tuple[Column, int]], threshold: float, enough: int) -> DataFrame:
    """cascade() in which a query is done with the first stage that gives it `enough` scores at the threshold or above; its later stages are not applied."""
    now, done = results, None
    for k, (value, keep) in enumerate(stages):
        now = ranked(now.withColumn("score", value), keep)
        good = F.count_if(F.col("score") >= threshold).over(Window.partitionBy("query_id"))
        if k < len(stages) - 1:
            marked = now.withColumn("_good", good)
            out, now = marked.where(F.col("_good") >= enough).drop("_good"), marked.where(F.col("_good") < enough).drop("_good")
            done = out if done is None else done.unionByName(out)
    return now if done is None else done.unionByName(now)


def explained(a: DataFrame, b: DataFrame, k: int, wa: float = 0.5, wb: float = 0.5) -> DataFrame:
    """The k best of the weighted sum with what they are made of: (query_id, id, score, rank, raw and normalised score, rank and part of either list; null where a list lacks the id)."""
    def side(x: DataFrame, n: str, w: float) -> DataFrame:
        brought = min_max(x.withColumn(f"{n}_raw", F.col("score")))
        return brought.select("query_id", "id", F.round(f"{n}_raw", 6).alias(f"{n}_raw"), F.round("score", 6).alias(f"{n}_score"), F.col("rank").alias(f"{n}_rank"), F.round(w * F.col("score"), 6).alias(f"{n}_part"))

    best = combine(min_max(a), min_max(b), k, "linear", wa, wb)
    return best.join(side(a, "a", wa), ["query_id", "id"], "left").join(side(b, "b", wb), ["query_id", "id"], "left")


def rerank(results: DataFrame, scores: DataFrame, k: int) -> DataFrame:
    """New scores(query_id, id, score) in place of the old; ids without one are dropped."""
    return ranked(results.select("query_id", "id").join(scores.select("query_id", "id", "score"), ["query_id", "id"]), k)


def two_modal(texts: DataFrame, images: DataFrame, k: int, weight: float = 0.5) -> DataFrame:
    """(query_id, id, score, rank) of results by text and by image: score is their sum weighted 1 - weight and weight, a missing one 0.

    The order is not by that score: it is by the score that a result came with, by text if it is there, else by image, and of equal ones those by text, in their order, come first.
    """
    a = texts.select("query_id", "id", F.col("score").alias("_a"), F.col("rank").alias("_ra"))
    b = images.select("query_id", "id", F.col("score").alias("_b"), F.col("rank").alias("_rb"))
    both = a.join(b, ["query_id", "id"], "full")
    order = Window.partitionBy("query_id").orderBy(F.desc(F.coalesce("_a", "_b")), F.col("_a").isNull(), F.coalesce("_ra", "_rb"), "id")
    score = F.round((1 - weight) * F.coalesce("_a", F.lit(0.0)) + weight * F.coalesce("_b", F.lit(0.0)), 6)
    return both.select("query_id", "id", score.alias("score"), F.row_number().over(order).alias("rank")).where(F.col("rank") <= k)
