"""Exact order statistics, distributions and counters of groups of any size.

No group is collected or sorted as a whole: a value at a rank is found by counting, in three passes. The rows of a group are counted in buckets of their values
(some thousands, finer where values are small against the group's mean), the bucket in which each rank falls is looked up in the running counts, and only the
different values of those buckets are ordered.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Buckets for a factor of e of a value above the group's mean.
FINE = 1000


def bucket_of(value: Column, scale: Column) -> Column:
    """A whole number that never falls as value grows."""
    v = value.cast("double")
    size = F.floor(F.log1p(F.abs(v) / scale) * FINE)
    return F.when(F.isnan(v), F.lit(1 << 62)).when((scale > 0) & ~F.isnan(scale), F.when(v < 0, -size).otherwise(size)).otherwise(F.lit(0))


def at_ranks(rows: DataFrame, value: str, by: Sequence[str | Column], ranks: Mapping[str, Callable[[Column], Column]]) -> DataFrame:
    """(by..., names of ranks...): of each group the value at each rank, from 0, in ascending order; ranks say it from the number of values.

    Null values count for nothing; a group without values has no row. Null group keys are a group. A rank beyond the values gives null.
    """
    own = rows.select(*by, F.col(value).alias("__v")).where("__v IS NOT NULL")
    keys = own.columns[:-1]
    own = own.select((F.struct(*keys) if keys else F.struct(F.lit(0))).alias("__k"), "__v")
    sizes = own.groupBy("__k").agg(F.count("*").alias("__n"), F.avg(F.abs(F.col("__v").cast("double"))).alias("__scale"))
    cut = own.join(sizes, "__k").select("__k", "__v", "__n", bucket_of(F.col("__v"), F.col("__scale")).alias("__b"))
    counts = cut.groupBy("__k", "__b").agg(F.count("*").alias("__c"), F.first("__n").alias("__n"))
    before = F.sum("__c").over(Window.partitionBy("__k").orderBy("__b")) - F.col("__c")  # some thousands of rows a group
    wanted = F.explode(F.array(*(F.struct(F.lit(name).alias("name"), rank(F.col("__n")).cast("long").alias("r")) for name, rank in ranks.items())))
    target = counts.withColumn("__before", before).withColumn("__w", wanted)
    target = target.where("__w.r >= __before AND __w.r < __before + __c").select("__k", "__b", "__w.name", (F.col("__w.r") - F.col("__before")).alias("__at"))
    near = cut.join(target, ["__k", "__b"]).groupBy("__k", "name", "__at", "__v").agg(F.count("*").alias("__c"))
    upto = F.sum("__c").over(Window.partitionBy("__k", "name").orderBy("__v"))
    found = near.withColumn("__upto", upto).where("__at < __upto AND __at >= __upto - __c")
    out = found.groupBy("__k").agg(*(F.max(F.when(F.col("name") == name, F.col("__v"))).alias(name) for name in ranks))
    return out.select(*(F.col("__k")[k].alias(k) for k in keys), *ranks)


def index_rank(q: float) -> Callable[[Column], Column]:
    """The rank int(n * q): no interpolation."""
    return lambda n: F.floor(n * F.lit(q))


#: The two middle ranks, whose mean is the median.
MIDDLE: dict[str, Callable[[Column], Column]] = {"_low": lambda n: F.floor((n - 1) / 2), "_high": lambda n: F.floor(n / 2)}


def median() -> Column:
    return (F.col("_low") + F.col("_high")) / 2


def beside(groups: DataFrame, found: DataFrame, keys: Sequence[str]) -> DataFrame:
    """groups with the columns of found, row by row of equal keys; null keys are equal."""
    if not keys:
        return groups.join(found, F.lit(True), "left")  # a row each
    other = found.withColumnsRenamed({k: f"__{k}" for k in keys})
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"__{k}"))
    return groups.join(other, same, "left").drop(*(f"__{k}" for k in keys))


def distribution(rows: DataFrame, value: Column, by: Sequence[str] = ()) -> DataFrame:
    """(by..., value, n, least, most, mean): how often each value occurs, and the range and mean of all."""
    counts = rows.select(*by, value.alias("value")).where("value IS NOT NULL").groupBy(*by, "value").agg(F.count("*").alias("n"))
    whole = counts.groupBy(*by).agg(F.min("value").alias("least"), F.max("value").alias("most"), F.round(F.sum(F.col("value") * F.col("n")) / F.sum("n"), 6).alias("mean"))
    return beside(counts, whole, list(by))


def parameter_usage(rows: DataFrame, feature: str, parameters: str) -> DataFrame:
    """(feature, name, value, n) from JSON objects of parameters: how often each value is given; lists and objects count by their kind."""
    given = F.from_json(parameters, "map<string,string>")
    each = rows.select(feature, F.explode(given).alias("name", "v"))
    value = F.when(F.col("v").startswith("["), "list").when(F.col("v").startswith("{"), "dict").otherwise(F.col("v"))
    return each.groupBy(feature, "name", value.alias("value")).agg(F.count("*").alias("n"))


def result_status(rows: DataFrame, feature: str, result: str) -> DataFrame:
    """(feature, status, n) from JSON results; one without a status is 'unknown'."""
    status = F.coalesce(F.get_json_object(result, "$.status"), F.lit("unknown"))
    return rows.groupBy(feature, status.alias("status")).agg(F.count("*").alias("n"))


def score_stats(results: DataFrame, score: str = "score", by: str = "query_id") -> DataFrame:
    """(by, n, mean, std, variance, max, min) of each query's scores; sample deviation and variance, 0 for one result."""
    return results.groupBy(by).agg(
        F.count(score).alias("n"), F.round(F.avg(score), 6).alias("mean"), F.round(F.coalesce(F.stddev_samp(score), F.lit(0.0)), 6).alias("std"),
        F.round(F.coalesce(F.var_samp(score), F.lit(0.0)), 6).alias("variance"), F.round(F.max(score), 6).alias("max"), F.round(F.min(score), 6).alias("min"),
    )
