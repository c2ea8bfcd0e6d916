"""Caches as tables: entries are (key, value, type, tags, created, last, n)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def key_of(*parts: Column) -> Column:
    """One key of several parts; null parts keep their place."""
    return F.sha2(F.concat_ws("\u0001", *(F.coalesce(p.cast("string"), F.lit("\u0002")) for p in parts)), 256)


def least_recently_used(entries: DataFrame, room: int, last: str = "last", key: str = "key") -> DataFrame:
    """The entries that a cache of room entries keeps."""
    return entries.orderBy(F.desc(last), key).limit(room)


def expired(entries: DataFrame, now: Column, expires: str = "expires") -> DataFrame:
    return entries.where(F.col(expires) < now)


def without_tag(entries: DataFrame, tag: str, kind: str | None = None) -> DataFrame:
    """What an invalidation by tag, of one type or of all, leaves."""
    hit = F.array_contains("tags", tag)
    if kind is not None:
        hit = hit & (F.col("type") == kind)
    return entries.where(~F.coalesce(hit, F.lit(False)))


def dashboard(samples: DataFrame, by: str, ts: str, value: str, month_seconds: float = 30 * 86400) -> DataFrame:
    """Per cache: current, mean, min, max, trend (up, down, flat: last against first), growth a sample, and what a month costs at the mean."""
    at = F.unix_micros(F.col(ts).cast("timestamp")) / 1e6
    per = samples.groupBy(by).agg(
        F.max_by(value, ts).alias("current"), F.avg(value).alias("m"), F.min(value).alias("min"), F.max(value).alias("max"), F.min_by(value, ts).alias("first"), F.count("*").alias("n"), (F.max(at) - F.min(at)).alias("span")
    )
    trend = F.when(F.col("current") > F.col("first"), "up").when(F.col("current") < F.col("first"), "down").otherwise("flat")
    interval = F.col("span") / F.greatest(F.col("n") - 1, F.lit(1))
    return per.select(
        by, F.round("current", 4).alias("current"), F.round("m", 4).alias("mean"), F.round("min", 4).alias("min"), F.round("max", 4).alias("max"), trend.alias("trend"),
        F.round((F.col("current") - F.col("first")) / F.col("n"), 6).alias("growth"), F.round(F.when(interval > 0, F.col("m") * month_seconds / interval), 2).alias("monthly"),
    )


def hit_series(accesses: DataFrame, ts: str, is_hit: Column, window: int) -> DataFrame:
    """Each day's hit rate and its moving mean over `window` days."""
    per = accesses.groupBy(F.to_date(ts).alias("day")).agg(F.avg(is_hit.cast("int")).alias("r"))
    moving = F.avg("r").over(Window.orderBy("day").rowsBetween(-(window - 1), 0))  # a row for each day
    return per.select("day", F.round("r", 6).alias("rate"), F.round(moving, 6).alias("moving"))
