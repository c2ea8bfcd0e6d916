"""Measures of retrieval and of generated answers.

Results are (query_id, id, rank) with ranks from 1, truth is (query_id, id[, gain]). Every query of `queries` gets a row.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.text import jaccard, let, ngrams, tfidf_cosine, tokens
from tessera.operators.statistics import at_ranks, beside
from tessera.session import ship
from tessera.tables import n_partitions, written


def judged(results: DataFrame, truth: DataFrame) -> DataFrame:
    """results with gain: 1, or truth's, for relevant ids, else 0."""
    gains = truth.select("query_id", "id", (F.col("gain") if "gain" in truth.columns else F.lit(1.0)).alias("gain"))
    return results.join(gains, ["query_id", "id"], "left").fillna(0.0, ["gain"])


def relevant(truth: DataFrame) -> DataFrame:
    """(query_id, relevant): how many different ids are relevant."""
    return truth.groupBy("query_id").agg(F.count_distinct("id").alias("relevant"))


def judged_by_label(results: DataFrame, queries: DataFrame, items: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(results with gain, relevant counts) where an item is relevant to a query of its label: queries(query_id, label), items(id, label). No table of all relevant pairs is made."""
    own = results.join(queries.select("query_id", F.col("label").alias("_q")), "query_id").join(items.select("id", F.col("label").alias("_i")), "id")
    gain = F.coalesce((F.col("_q") == F.col("_i")).cast("double"), F.lit(0.0))
    per = items.groupBy("label").agg(F.count_distinct("id").alias("relevant"))
    return own.withColumn("gain", gain).drop("_q", "_i"), queries.join(per, "label", "left").select("query_id", F.coalesce("relevant", F.lit(0)).alias("relevant"))


def at_k(results: DataFrame, truth: DataFrame, k: int) -> DataFrame:
    """query_id, precision, recall, f1, hit_rate over the first k.

    Precision divides by k or the length of the list, whichever is less, and is 0 for an empty one; recall is 1 if nothing is relevant;
    F1 is 0 if both are.
    """
    return at_k_of(judged(results, truth), relevant(truth), k)


def at_k_of(gains: DataFrame, counts: DataFrame, k: int) -> DataFrame:
    """at_k() of results with gain and relevant counts."""
    near = gains.where(F.col("rank") <= k)
    found = near.groupBy("query_id").agg(F.count("*").alias("n"), F.count_if(F.col("gain") > 0).alias("hits"), F.count_distinct(F.when(F.col("gain") > 0, F.col("id"))).alias("different"))
    p = F.coalesce(F.col("hits") / F.col("n"), F.lit(0.0))
    r = F.when(F.coalesce("relevant", F.lit(0)) == 0, 1.0).otherwise(F.coalesce("different", F.lit(0)) / F.col("relevant"))
    out = found.join(counts, "query_id", "full_outer").select("query_id", p.alias("p"), r.alias("r"), F.coalesce(F.col("hits") > 0, F.lit(False)).cast("int").alias("hit"))
    return out.select("query_id", *(F.round(v, 6).alias(a) for v, a in ((F.col("p"), "precision"), (F.col("r"), "recall"), (harmonic("p", "r"), "f1"))), "hit")


def harmonic(p: str, r: str) -> Column:
    """0 if both are 0."""
    return F.when(F.col(p) + F.col(r) == 0, 0.0).otherwise(2 * F.col(p) * F.col(r) / (F.col(p) + F.col(r)))


def average_precision(results: DataFrame, truth: DataFrame) -> DataFrame:
    """query_id, ap: mean precision at the ranks of relevant results, of queries that have any."""
    return average_precision_of(judged(results, truth))


def average_precision_of(gains: DataFrame) -> DataFrame:
    w = Window.partitionBy("query_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rel = (F.col("gain") > 0).cast("int")
    upto = gains.select("query_id", "rank", rel.alias("rel"), F.sum(rel).over(w).alias("hits"))
    return upto.where("rel = 1").groupBy("query_id").agg(F.round(F.avg(F.col("hits") / F.col("rank")), 6).alias("ap"))


def mean_average_precision(results: DataFrame, truth: DataFrame, strict: bool = True) -> DataFrame:
    """One row, map. strict: queries without a hit count 0; otherwise they are left out."""
    return mean_average_precision_of(judged(results, truth), relevant(truth), strict)


def mean_average_precision_of(gains: DataFrame, counts: DataFrame, strict: bool = True) -> DataFrame:
    ap = average_precision_of(gains)
    if strict:
        ap = counts.where("relevant > 0").select("query_id").join(ap, "query_id", "left").fillna(0.0, ["ap"])
    return ap.agg(F.round(F.avg("ap"), 6).alias("map"))


def ndcg(results: DataFrame, truth: DataFrame, k: int) -> DataFrame:
    """query_id, ndcg: gains over log2(rank + 1), against the best order of all gains."""
    gains = truth.select("query_id", "id", (F.col("gain") if "gain" in truth.columns else F.lit(1.0)).alias("gain"))
    best = gains.withColumn("r", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("gain"), "id"))).where(F.col("r") <= k)
    ideal = best.groupBy("query_id").agg(F.sum(F.col("gain") / F.log2(F.col("r") + 1)).alias("ideal"))
    return _ndcg(judged(results, truth), ideal, k)


def ndcg_of(gains: DataFrame, counts: DataFrame, k: int) -> DataFrame:
    """ndcg() of results with gains of 0 and 1 and relevant counts."""
    each = F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.least(F.col("relevant"), F.lit(k)).cast("int"))), lambda i: 1 / F.log2(i + 1))
    ideal = counts.where("relevant > 0").select("query_id", F.aggregate(each, F.lit(0.0), lambda a, x: a + x).alias("ideal"))
    return _ndcg(gains, ideal, k)


def _ndcg(gains: DataFrame, ideal: DataFrame, k: int) -> DataFrame:
    dcg = gains.where(F.col("rank") <= k).groupBy("query_id").agg(F.sum(F.col("gain") / F.log2(F.col("rank") + 1)).alias("dcg"))
    return ideal.join(dcg, "query_id", "left").select("query_id", F.round(F.when(F.col("ideal") > 0, F.coalesce("dcg", F.lit(0.0)) / F.col("ideal")).otherwise(0.0), 6).alias("ndcg"))


def reciprocal_rank(results: DataFrame, truth: DataFrame) -> DataFrame:
    """query_id, rr: 1 over the rank of the first relevant result, 0 without one."""
    return reciprocal_rank_of(judged(results, truth), relevant(truth))


def reciprocal_rank_of(gains: DataFrame, counts: DataFrame) -> DataFrame:
    first = gains.where("gain > 0").groupBy("query_id").agg(F.min("rank").alias("rank"))
    return counts.where("relevant > 0").select("query_id").join(first, "query_id", "left").select("query_id", F.round(F.coalesce(1 / F.col("rank"), F.lit(0.0)), 6).alias("rr"))


def reciprocal_rank_per_truth(results: DataFrame, truth: DataFrame) -> DataFrame:
    """query_id, mrr: mean over all relevant ids of 1 over their rank, 0 for those not found."""
    return reciprocal_rank_per_truth_of(judged(results, truth), relevant(truth))


def reciprocal_rank_per_truth_of(gains: DataFrame, counts: DataFrame) -> DataFrame:
    first = gains.where("gain > 0").groupBy("query_id", "id").agg(F.min("rank").alias("rank"))
    hits = first.groupBy("query_id").agg(F.sum(1 / F.col("rank")).alias("s"))
    return counts.where("relevant > 0").join(hits, "query_id", "left").select("query_id", F.round(F.coalesce("s", F.lit(0.0)) / F.col("relevant"), 6).alias("mrr"))


def overlap_by_id(results: DataFrame, truth: DataFrame) -> DataFrame:
    """query_id, id_precision, id_recall, id_f1 of whole lists: results in truth over results, and over the rows of truth. Queries that lack either give 0."""
    n = results.groupBy("query_id").agg(F.count("*").alias("n"))
    t = truth.groupBy("query_id").agg(F.count("*").alias("t"))
    hits = results.join(truth.select("query_id", "id").distinct(), ["query_id", "id"], "left_semi").groupBy("query_id").agg(F.count("*").alias("hits"))
    out = n.join(t, "query_id", "full_outer").join(hits, "query_id", "left").select(
        "query_id", F.coalesce(F.coalesce("hits", F.lit(0)) / F.col("n"), F.lit(0.0)).alias("p"), F.coalesce(F.coalesce("hits", F.lit(0)) / F.col("t"), F.lit(0.0)).alias("r")
    )
    return out.select("query_id", F.round("p", 6).alias("id_precision"), F.round("r", 6).alias("id_recall"), F.round(harmonic("p", "r"), 6).alias("id_f1"))


def overlap_by_content(results: DataFrame, truth: DataFrame, threshold: float = 0.5, similarity: Callable[[Column, Column], Column] = tfidf_cosine) -> DataFrame:
    """query_id, content_precision, content_recall, content_f1, content_overlap_percentage of results(query_id, content) and truth(query_id, content).

    A result counts if its best match in truth reaches the threshold, and so for truth; the overlap is the mean best match of truth in per cent. Contents meet within
    a query. Null and empty contents are left out; a query that has either side only gives 0.
    """
    r = results.where("content <> ''").select("query_id", F.monotonically_increasing_id().alias("r"), F.col("content").alias("a"))
    t = truth.where("content <> ''").select("query_id", F.monotonically_increasing_id().alias("t"), F.col("content").alias("b"))
    dealt = lambda df: df.repartition(n_partitions(df.sparkSession), "query_id")  # noqa: E731  by number: the texts are few bytes for their work, so AQE would leave it to few tasks
    pairs = written(dealt(r).join(dealt(t), "query_id").select("query_id", "r", "t", similarity(F.col("b"), F.col("a")).alias("s")), "pairs")

    def best(side: str, name: str) -> DataFrame:
        per = pairs.groupBy("query_id", side).agg(F.max("s").alias("s"))
        return per.groupBy("query_id").agg(F.avg((F.col("s") >= threshold).cast("int")).alias(name), F.avg("s").alias(f"{name}_mean"))

    asked = results.select("query_id").union(truth.select("query_id")).distinct()
    found = asked.join(best("r", "p"), "query_id", "left").join(best("t", "q"), "query_id", "left").fillna(0.0)
    return found.select(
        "query_id", F.round("p", 6).alias("content_precision"), F.round("q", 6).alias("content_recall"), F.round(harmonic("p", "q"), 6).alias("content_f1"), F.round(100 * F.col("q_mean"), 4).alias("content_overlap_percentage")
    )


def recall_against(approximate: DataFrame, exact: DataFrame, k: int) -> DataFrame:
    """query_id, recall: share of the exact first k that the approximate first k hold."""
    a = approximate.where(F.col("rank") <= k).select("query_id", "id", F.lit(1).alias("hit"))
    return exact.where(F.col("rank") <= k).select("query_id", "id").join(a, ["query_id", "id"], "left").groupBy("query_id").agg(F.round(F.avg(F.coalesce("hit", F.lit(0))), 6).alias("recall"))


#: Words that say nothing about faithfulness (fixed values).
COMMON = ("the", "a", "an", "and", "or", "but", "in", "on", "at", "to", "of", "for", "with", "by", "is", "are", "was", "were")


def faithfulness(answer: Column, context: Column) -> Column:
    """Share of the answer's different words, without common ones, that the context has; 0 if either has none."""
    common = F.array(*(F.lit(w) for w in COMMON))
    own = lambda t: F.array_except(tokens(F.lower(t)), common)
    return let(
        F.struct(own(answer).alias("a"), own(context).alias("c")),
        lambda x: F.when((F.size(x["a"]) == 0) | (F.size(x["c"]) == 0), 0.0).otherwise(F.size(F.array_intersect(x["a"], x["c"])) / F.size(x["a"])),
    )


def hallucination(answer: Column, context: Column, least: float = 0.5) -> Column:
    """Share of the answer's sentences of whose words the context has less than `least`; 0 without sentences."""
    parts = F.filter(F.transform(F.split(answer, r"[.!?][ \t\n\r\f\x0B]+"), lambda x: F.trim(x)), lambda x: x != "")
    held = tokens(F.lower(context))

    def weak(s: Column, known: Column) -> Column:
        w = F.array_distinct(tokens(F.lower(s)))
        return F.size(F.array_intersect(w, known)) / F.greatest(F.size(w), F.lit(1)) < least

    return let(
        F.struct(parts.alias("p"), held.alias("k")),
        lambda x: F.when(F.size(x["p"]) <= 0, 0.0).otherwise(F.size(F.filter(x["p"], lambda s: weak(s, x["k"]))) / F.size(x["p"])),
    )


def conciseness(answer: Column, question: Column) -> Column:
    """0.5 for an answer no longer than the question, 1 up to three times as long, then falling to 0 at thirteen times; 0 if either is empty."""
    q, a = F.size(tokens(question)), F.size(tokens(answer))
    long = F.greatest(F.lit(0.0), 1 - (a - 3 * q) / (10 * q))
    empty = (F.coalesce(F.length(answer), F.lit(0)) == 0) | (F.coalesce(F.length(question), F.lit(0)) == 0)
    return F.when(empty, 0.0).when(a <= q, 0.5).when(a <= 3 * q, 1.0).when(q == 0, 0.0).otherwise(long)


def coherence(answer: Column) -> Column:
    """Without a model: a half and a tenth for each 100 words, 1 at most; 0 for an empty answer."""
    return F.when(F.coalesce(F.length(answer), F.lit(0)) == 0, 0.0).otherwise(F.least(F.lit(1.0), 0.5 + 0.1 * F.size(tokens(answer)) / 100))


def generation(rows: DataFrame, question: str, answer: str, context: str) -> DataFrame:
    """rows with faithfulness, relevance (Jaccard with the question), hallucination, conciseness, coherence."""
    q, a, c = F.col(question), F.col(answer), F.col(context)
    measures = {"faithfulness": faithfulness(a, c), "relevance": jaccard(q, a), "hallucination": hallucination(a, c), "conciseness": conciseness(a, q), "coherence": coherence(a)}
    return rows.withColumns({k: F.round(v, 6) for k, v in measures.items()})


def bleu(candidate: Column, reference: Column, most: int = 4) -> Column:
    """BLEU of white-space words against one reference: geometric mean of clipped n-gram precisions up to `most`, times the brevity penalty; 0 if any precision is."""

    def matched(c: Column, r: Column, n: int) -> Column:
        grams, other = ngrams(c, n), ngrams(r, n)
        count = lambda xs, g: F.size(F.filter(xs, lambda x: x == g))
        return let(
            F.struct(grams.alias("c"), other.alias("r")),
            lambda x: F.aggregate(F.array_distinct(x["c"]), F.lit(0), lambda a, g: a + F.least(count(x["c"], g), count(x["r"], g))),
        )

    def of(x: Column) -> Column:
        nc, nr = F.size(x["c"]), F.size(x["r"])
        logs = [F.log(matched(x["c"], x["r"], n) / (nc - n + 1)) for n in range(1, most + 1)]
        penalty = F.when(nc >= nr, 1.0).otherwise(F.exp(1 - nr / nc))
        return F.when((nc < most) | (nr < most), 0.0).otherwise(F.coalesce(penalty * F.exp(sum(logs[1:], logs[0]) / most), F.lit(0.0)))

    return let(F.struct(tokens(candidate).alias("c"), tokens(reference).alias("r")), of)


def rouge_l(pairs: DataFrame, id_col: str, candidate: str, reference: str) -> DataFrame:
    """(id_col, precision, recall, f): longest common subsequence of white-space words over the words of either side; 0 if a side has none.

    The subsequence is a fold over one side with a bit for each word of the other, so it runs beside the JVM, one pair at a time.
    """
    import pandas as pd

    def run(batches):
        for b in batches:
            rows = []
            for key, c, r in zip(b[id_col], b[candidate], b[reference]):
                c, r = (c or "").split(), (r or "").split()
                n = common_length(c, r)
                p, q = (n / len(c) if c else 0.0), (n / len(r) if r else 0.0)
                rows.append((key, round(p, 6), round(q, 6), round(2 * p * q / (p + q), 6) if p + q else 0.0))
            yield pd.DataFrame(rows, columns=[id_col, "precision", "recall", "f"])

    ship(pairs.sparkSession)
    kind = pairs.schema[id_col].dataType.simpleString()
    return pairs.select(id_col, candidate, reference).mapInPandas(run, f"{id_col} {kind}, precision double, recall double, f double")


def common_length(a: list, b: list) -> int:
    """Length of the longest common subsequence (bit-parallel: zeros of the mask are matches so far)."""
    places: dict = {}
    for k, x in enumerate(a):
        places[x] = places.get(x, 0) | 1 << k
    whole = (1 << len(a)) - 1
    mask = whole
    for x in b:
        m = places.get(x, 0)
        u = mask & m
        mask = ((mask + u) | (mask - u)) & whole
    return len(a) - mask.bit_count()


def agreement(pairs: DataFrame, expected: str, given: str) -> DataFrame:
    """One row: n, exact share of equal answers, mean Jaccard."""
    same = F.lower(F.trim(expected)) == F.lower(F.trim(given))
    return pairs.agg(F.count("*").alias("n"), F.round(F.avg(same.cast("int")), 6).alias("exact"), F.round(F.avg(jaccard(F.col(expected), F.col(given))), 6).alias("jaccard"))


def task_completion(pairs: DataFrame, expected: str, given: str, right: Callable[[Column, Column], Column] | None = None) -> DataFrame:
    """One row, rate: share of outputs that equal what was expected but for case and outer blanks, or that right(expected, given) accepts; 0 without pairs."""
    test = right or (lambda e, g: F.lower(F.trim(e)) == F.lower(F.trim(g)))
    return pairs.agg(F.round(F.coalesce(F.avg(F.coalesce(test(F.col(expected), F.col(given)), F.lit(False)).cast("int")), F.lit(0.0)), 6).alias("rate"))


def satisfaction(ratings: DataFrame, column: str) -> DataFrame:
    """One row: n, mean, median (the upper of two middle ones), share of the best mark 5."""
    base = ratings.agg(F.count(column).alias("n"), F.round(F.avg(column), 6).alias("mean"), F.round(F.avg(column) / 5, 6).alias("share"))
    return beside(base, at_ranks(ratings, column, [], {"median": lambda n: F.floor(n / 2)}), []).select("n", "mean", "median", "share")


def rating_shares(ratings: DataFrame, column: str) -> DataFrame:
    """(rating, share) of the marks 0 to 5 among all ratings, also of those that none gave."""
    counts = ratings.where(F.col(column).isNotNull()).groupBy(F.col(column).cast("double").alias("r")).agg(F.count("*").alias("n"))
    whole = counts.agg(F.sum("n").alias("all"))
    marks = ratings.sparkSession.range(6).select(F.col("id").cast("int").alias("rating"))
    out = marks.join(counts, F.col("rating").cast("double") == F.col("r"), "left").crossJoin(F.broadcast(whole))  # one row
    return out.select("rating", F.round(F.coalesce(F.col("n") / F.col("all"), F.lit(0.0)), 6).alias("share"))


def efficiency(rows: DataFrame, seconds: str, begin: str, end: str) -> DataFrame:
    """One row: mean latency, calls per second between the first begin and the last end, p50, p90, p99 (interpolated between neighbours)."""
    span = F.unix_micros(F.max(F.col(end).cast("timestamp"))) - F.unix_micros(F.min(F.col(begin).cast("timestamp")))
    base = rows.agg(F.count(seconds).alias("n"), F.avg(seconds).alias("mean"), span.alias("us"))
    spots = {}
    for name, q in (("p50", 0.5), ("p90", 0.9), ("p99", 0.99)):
        spots[f"{name}_a"] = lambda n, q=q: F.floor((n - 1) * F.lit(q))
        spots[f"{name}_b"] = lambda n, q=q: F.ceil((n - 1) * F.lit(q))
    out = beside(base, at_ranks(rows, seconds, [], spots), [])
    part = lambda q: (F.col("n") - 1) * F.lit(q) - F.floor((F.col("n") - 1) * F.lit(q))
    each = [F.round(F.col(f"{p}_a") + (F.col(f"{p}_b") - F.col(f"{p}_a")) * part(q), 6).alias(f"latency_{p}") for p, q in (("p50", 0.5), ("p90", 0.9), ("p99", 0.99))]
    return out.select("n", F.round("mean", 6).alias("average_latency"), F.round(F.when(F.col("us") > 0, F.col("n") * 1e6 / F.col("us")).otherwise(0.0), 6).alias("throughput"), *each)


def robustness(scores: DataFrame, score: str, adversarial: Column) -> DataFrame:
    """One row: mean scores of standard and adversarial queries and their ratio, 0 if the former is not above 0."""
    out = scores.agg(F.avg(F.when(~adversarial, F.col(score))).alias("s"), F.avg(F.when(adversarial, F.col(score))).alias("a")).fillna(0.0)
    ratio = F.when(F.col("s") > 0, F.col("a") / F.col("s")).otherwise(0.0)
    return out.select(F.round("s", 6).alias("standard_score"), F.round("a", 6).alias("adversarial_score"), F.round(ratio, 6).alias("robustness_ratio"))


def overall(completion: Column, satisfied: Column, robust: Column) -> Column:
    """Mean of task completion, satisfaction and robustness weighted .4, .4, .2 over those that are not null; 0 if none is there."""
    parts = [(completion, 0.4), (satisfied, 0.4), (robust, 0.2)]
    total = sum((F.coalesce(c * w, F.lit(0.0)) for c, w in parts), F.lit(0.0))
    weight = sum((F.when(c.isNotNull(), w).otherwise(0.0) for c, w in parts), F.lit(0.0))
    return F.round(F.when(weight > 0, total / weight).otherwise(0.0), 6)


#: Votes between two systems (fixed values).
VOTES = ("a", "slight-a", "equal", "slight-b", "b")


def preferences(votes: DataFrame, query: str, vote: str) -> DataFrame:
    """(query, vote, n, percentage): of each query's votes, null ones counted in the whole but not listed, and of all known votes (query null), with is_winner for the most
    frequent of the latter, of equals the first of VOTES."""
    own = votes.select(F.col(query).cast("string").alias("query"), F.col(vote).alias("vote"))
    per = own.groupBy("query", "vote").agg(F.count("*").alias("n"))
    per = per.withColumn("percentage", F.round(100 * F.col("n") / F.sum("n").over(Window.partitionBy("query")), 4)).where("vote <> ''").withColumn("is_winner", F.lit(False))
    place = F.lit(len(VOTES))
    for k, v in reversed(list(enumerate(VOTES))):
        place = F.when(F.col("vote") == v, k).otherwise(place)
    known = own.where(F.col("vote").isin(list(VOTES))).groupBy("vote").agg(F.count("*").alias("n"))  # five rows at most
    whole = known.select(
        F.lit(None).cast("string").alias("query"), "vote", "n", F.round(100 * F.col("n") / F.sum("n").over(Window.partitionBy()), 4).alias("percentage"),
        (F.row_number().over(Window.partitionBy().orderBy(F.desc("n"), place)) == 1).alias("is_winner"),
    )
    return per.unionByName(whole)


def human_evaluation(wide: DataFrame, id_col: str) -> DataFrame:
    """From columns `criterion-n`: criterion, query, n, mean, least, most."""
    names = [c for c in wide.columns if c != id_col]
    long = wide.unpivot([id_col], names, "key", "value")
    parts = F.split("key", "-")
    return long.select(parts[0].alias("criterion"), parts[1].cast("int").alias("query"), "value").groupBy("criterion", "query").agg(
        F.count("value").alias("n"), F.round(F.avg("value"), 6).alias("mean"), F.min("value").alias("least"), F.max("value").alias("most")
    )
