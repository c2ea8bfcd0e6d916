"""Usage, sessions, latency, errors and cost from event tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.text import STOPWORDS, ngrams
from tessera.operators.statistics import MIDDLE, at_ranks, beside, index_rank, median


def latency_stats(rows: DataFrame, value: str, by: Sequence[str | Column] = (), digits: int = 4) -> DataFrame:
    """count, min, max, mean, median, p90, p95, p99, stddev (sample; 0 for one value) of each group. Percentiles are the value at place int(n * q), from 0.

    Null values count for nothing; without by, an empty table gives one row of nulls. Groups may be of any size: see at_ranks().
    """
    own = rows.where(F.col(value).isNotNull()).select(*by, F.col(value).alias("_value"))
    keys = own.columns[:-1]
    base = own.groupBy(*keys).agg(
        F.count("_value").alias("count"), F.min("_value").alias("min"), F.max("_value").alias("max"), F.avg("_value").alias("mean"), F.coalesce(F.stddev_samp("_value"), F.lit(0.0)).alias("stddev")
    )
    found = beside(base, at_ranks(own, "_value", keys, {"p90": index_rank(0.9), "p95": index_rank(0.95), "p99": index_rank(0.99), **MIDDLE}), keys)
    columns = [F.col("count"), *((median() if c == "median" else F.col(c)).alias(c) for c in ("min", "max", "mean", "median", "p90", "p95", "p99", "stddev"))]
    return found.select(*keys, columns[0], *(F.round(c, digits).alias(n) for c, n in zip(columns[1:], ("min", "max", "mean", "median", "p90", "p95", "p99", "stddev"))))


def generation_stats(rows: DataFrame, model: str, seconds: str, tokens: str, first_token: str | None = None) -> DataFrame:
    """(model, count, mean, p90, tokens_per_second[, first_mean, first_p90]): latency of calls by model, tokens over all seconds, time to the first token."""
    own = rows.select(model, F.col(seconds).alias("_s"), F.col(tokens).alias("_t"), (F.col(first_token) if first_token else F.lit(None).cast("double")).alias("_f"))
    base = own.groupBy(model).agg(F.count("_s").alias("count"), F.avg("_s").alias("mean"), F.sum("_t").alias("t"), F.sum(F.when(F.col("_t").isNotNull(), F.col("_s"))).alias("s"), F.avg("_f").alias("first_mean"))
    found = beside(base, at_ranks(own, "_s", [model], {"p90": index_rank(0.9)}), [model])
    rate = F.when(F.col("s") > 0, F.col("t") / F.col("s"))
    columns = [model, "count", F.round("mean", 4).alias("mean"), F.round("p90", 4).alias("p90"), F.round(rate, 4).alias("tokens_per_second")]
    if not first_token:
        return found.select(*columns)
    found = beside(found, at_ranks(own, "_f", [model], {"first_p90": index_rank(0.9)}), [model])
    return found.select(*columns, F.round("first_mean", 4).alias("first_mean"), F.round("first_p90", 4).alias("first_p90"))


def bucket(value: Column, limits: Sequence[tuple[float, str]], rest: str) -> Column:
    """The name of the first limit that value is below."""
    out = F.lit(rest)
    for limit, name in reversed(limits):
        out = F.when(value < limit, name).otherwise(out)
    return out


SIZES = [(10, "<10"), (100, "10-99"), (1000, "100-999"), (10000, "1000-9999")]


def component_breakdown(rows: DataFrame, component: str, value: str, operation: str) -> DataFrame:
    """Per component: count, mean, p90, share of operations and of all time, in per cent."""
    whole = rows.agg(F.count_distinct(operation).alias("ops"), F.sum(value).alias("time"))
    per = rows.groupBy(component).agg(F.count("*").alias("count"), F.avg(value).alias("mean"), F.count_distinct(operation).alias("o"), F.sum(value).alias("t"))
    per = beside(per, at_ranks(rows, value, [component], {"p90": index_rank(0.9)}), [component])
    return per.crossJoin(F.broadcast(whole)).select(  # whole is one row
        component, "count", F.round("mean", 4).alias("mean"), F.round("p90", 4).alias("p90"),
        F.round(100 * F.col("o") / F.col("ops"), 2).alias("operations"), F.round(100 * F.col("t") / F.col("time"), 2).alias("time"),
    )


def settings_breakdown(rows: DataFrame, settings: str, value: str) -> DataFrame:
    """(name, setting, count, mean, p90) by each key and value of a JSON object of settings; also for sub-components, whose object holds their own values (value null: theirs)."""
    each = rows.select(value, F.explode(F.from_json(settings, "map<string,string>")).alias("name", "setting"))
    base = each.groupBy("name", "setting").agg(F.count(value).alias("count"), F.round(F.avg(value), 4).alias("mean"))
    found = beside(base, at_ranks(each, value, ["name", "setting"], {"p90": index_rank(0.9)}), ["name", "setting"])
    return found.withColumn("p90", F.round("p90", 4))


def cache_efficiency(rows: DataFrame, hit: Column, value: str) -> DataFrame:
    """One row: hit rate in per cent, mean latency of hits and misses, and the saving, absolute and in per cent."""
    out = rows.agg(F.avg(hit.cast("int")).alias("r"), F.avg(F.when(hit, F.col(value))).alias("h"), F.avg(F.when(~hit, F.col(value))).alias("m"))
    return out.select(
        F.round(100 * F.col("r"), 1).alias("hit_rate"), F.round("h", 1).alias("hit_mean"), F.round("m", 1).alias("miss_mean"),
        F.round(F.col("m") - F.col("h"), 1).alias("saved"), F.round(100 * (F.col("m") - F.col("h")) / F.col("m"), 1).alias("saved_per_cent"),
    )


#: Time buckets: how a timestamp is written in each.
PERIODS = {"hour": "yyyy-MM-dd HH:00", "day": "yyyy-MM-dd", "month": "yyyy-MM"}


def period(ts: Column, unit: str) -> Column:
    """hour, day and month as text; week as year, -W and the ISO week (the calendar year, so days around New Year keep their year)."""
    if unit == "week":
        return F.concat(F.date_format(ts, "yyyy"), F.lit("-W"), F.lpad(F.weekofyear(ts).cast("string"), 2, "0"))
    return F.date_format(ts, PERIODS[unit])


def time_distribution(rows: DataFrame, ts: str, unit: str) -> DataFrame:
    return rows.groupBy(period(F.col(ts), unit).alias("period")).agg(F.count("*").alias("n"))


def trend(rows: DataFrame, ts: str, value: str, unit: str) -> DataFrame:
    """Per period: count, mean, and the change of the mean from the period before."""
    per = rows.groupBy(period(F.col(ts), unit).alias("period")).agg(F.count("*").alias("n"), F.avg(value).alias("m"))
    before = F.lag("m").over(Window.orderBy("period"))  # a row for each period
    return per.select("period", "n", F.round("m", 4).alias("mean"), F.round(F.col("m") - before, 4).alias("change"))


def tracker(rows: DataFrame, label: str, value: str, order: str) -> DataFrame:
    """min, max, mean, count, sum and the last value of each label."""
    return rows.groupBy(label).agg(
        F.round(F.min(value), 4).alias("min"), F.round(F.max(value), 4).alias("max"), F.round(F.avg(value), 4).alias("mean"), F.count(value).alias("count"), F.round(F.sum(value), 2).alias("sum"), F.round(F.max_by(value, order), 4).alias("last")
    )


def last_n(rows: DataFrame, n: int, order: str, by: str) -> DataFrame:
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(by).orderBy(F.desc(order)))).where(F.col("_n") <= n).drop("_n")


def rate(rows: DataFrame, ts: str, by: str, seconds: int = 60, slice_seconds: int = 3600) -> DataFrame:
    """Each row with the number of rows of its group in the seconds up to it, per second. Rows without ts have none.

    A group's time is cut into slices, each a task's work of its own; rows near the end of a slice are shown to the next one as well, which counts but does not return them.
    """
    if slice_seconds < seconds:
        raise ValueError("a slice must be as long as the window or longer")
    t, long = F.unix_micros(F.col(ts).cast("timestamp")), slice_seconds * 1_000_000
    own = rows.withColumn("_t", t).withColumn("_slice", F.floor(F.col("_t") / F.lit(long)).cast("long"))
    seen = F.array(F.lit(0), F.lit(1))
    late = F.pmod(F.col("_t"), F.lit(long)) >= long - seconds * 1_000_000
    each = own.withColumn("_next", F.explode(F.when(late, seen).otherwise(F.array(F.lit(0))))).withColumn("_slice", F.col("_slice") + F.col("_next"))
    w = Window.partitionBy(by, "_slice").orderBy("_t").rangeBetween(-seconds * 1_000_000, 0)
    value = F.when(F.col("_t").isNotNull(), F.round(F.count("*").over(w) / seconds, 6))
    return each.withColumn("rate", value).where("_next = 0").drop("_t", "_slice", "_next")


# --- features and users


def popularity(events: DataFrame, feature: str, user: str) -> DataFrame:
    out = events.groupBy(feature).agg(F.count("*").alias("uses"), F.count_distinct(user).alias("users"))
    return out.withColumn("per_user", F.round(F.col("uses") / F.col("users"), 4))


def sessions(events: DataFrame, user: str, ts: str) -> DataFrame:
    """events with session_id: a user's day, unless the events carry one."""
    own = F.concat(F.col(user).cast("string"), F.lit("_"), F.date_format(ts, "yyyyMMdd"))
    return events.withColumn("session_id", F.coalesce("session_id", own) if "session_id" in events.columns else own)


def combinations(events: DataFrame, feature: str, n: int) -> DataFrame:
    """The n most frequent sets of two features or more used in one session(session_id)."""
    sets = events.groupBy("session_id").agg(F.array_join(F.sort_array(F.collect_set(feature)), "+").alias("features"), F.count_distinct(feature).alias("size"))
    return sets.where("size >= 2").groupBy("features").agg(F.count("*").alias("sessions")).orderBy(F.desc("sessions"), "features").limit(n)


def co_occurrence(events: DataFrame, feature: str) -> DataFrame:
    """(a, b, sessions) of features used in one session, both ways. A session holds each feature once, so pairs are few."""
    sets = events.groupBy("session_id").agg(F.collect_set(feature).alias("f"))
    a = sets.select("f", F.explode("f").alias("a"))
    return a.select("a", F.explode("f").alias("b")).where("a <> b").groupBy("a", "b").agg(F.count("*").alias("sessions"))


def segments(events: DataFrame, user: str, feature: str) -> DataFrame:
    """(segment, feature, uses): users above twice the mean of events are high, above the mean medium, else low."""
    per = events.groupBy(user).agg(F.count("*").alias("n"))
    mean = per.agg(F.avg("n").alias("mean"))
    named = per.crossJoin(F.broadcast(mean)).select(user, F.when(F.col("n") > 2 * F.col("mean"), "high").when(F.col("n") >= F.col("mean"), "medium").otherwise("low").alias("segment"))
    return events.join(named, user).groupBy("segment", feature).agg(F.count("*").alias("uses"))


def session_stats(events: DataFrame, ts: str, least: int = 2) -> DataFrame:
    """One row over sessions of `least` events or more: how many, seconds and events (min, max, mean, median)."""
    per = events.groupBy("session_id").agg(F.count("*").alias("e"), (F.unix_micros(F.max(ts).cast("timestamp")) - F.unix_micros(F.min(ts).cast("timestamp"))).alias("us"))
    per = per.where(F.col("e") >= least).select(F.col("e").cast("double").alias("events"), (F.col("us") / 1e6).alias("seconds"))
    out = per.agg(F.count("*").alias("sessions"), *(f(c).alias(f"{c}_{a}") for c in ("seconds", "events") for f, a in ((F.min, "min"), (F.max, "max"), (F.avg, "mean"))))
    for c in ("seconds", "events"):
        out = beside(out, at_ranks(per, c, [], MIDDLE), []).withColumn(f"{c}_median", median()).drop(*MIDDLE)
    return out.select("sessions", *(F.round(f"{c}_{a}", 4).alias(f"{c}_{a}") for c in ("seconds", "events") for a in ("min", "max", "mean", "median")))


def engagement(events: DataFrame, user: str, ts: str, kind: str) -> DataFrame:
    """Per event type: events, sessions that hold it, users of those sessions (a session's user is that of its first event)."""
    owner = events.groupBy("session_id").agg(F.min_by(user, ts).alias("owner"))
    return events.join(owner, "session_id").groupBy(kind).agg(F.count("*").alias("events"), F.count_distinct("session_id").alias("sessions"), F.count_distinct("owner").alias("users"))


def sessions_per_user(events: DataFrame, user: str, ts: str) -> DataFrame:
    """One row: users, sessions, sessions_per_user; a session's user is that of its first event."""
    owner = events.groupBy("session_id").agg(F.min_by(user, ts).alias("owner"))
    out = owner.agg(F.count_distinct("owner").alias("users"), F.count("*").alias("sessions"))
    return out.withColumn("sessions_per_user", F.round(F.col("sessions") / F.col("users"), 4))


def transitions(events: DataFrame, ts: str, kind: str, tie: str) -> DataFrame:
    """(from, to, n) of successive events of a session."""
    w = Window.partitionBy("session_id").orderBy(ts, tie)
    return events.select(F.col(kind).alias("from"), F.lead(kind).over(w).alias("to")).where("to IS NOT NULL").groupBy("from", "to").agg(F.count("*").alias("n"))


def ends(events: DataFrame, ts: str, kind: str, tie: str) -> DataFrame:
    """(first, last, sessions): the kinds that sessions begin and end with."""
    key = F.struct(ts, tie)
    per = events.groupBy("session_id").agg(F.min_by(kind, key).alias("first"), F.max_by(kind, key).alias("last"))
    return per.groupBy("first", "last").agg(F.count("*").alias("sessions"))


def retention(events: DataFrame, user: str, ts: str, days: int) -> DataFrame:
    """(cohort, base, retained, rate): from the first day in steps of days, the users of that very day, and those of them active
    from days to less than twice days later. Steps without users are left out."""
    active = events.select(F.col(user).alias("u"), F.to_date(ts).alias("d")).distinct()
    first = active.agg(F.min("d").alias("first"))
    base = active.crossJoin(F.broadcast(first)).where(F.datediff("d", "first") % days == 0).select("u", F.col("d").alias("cohort"))
    # a range join as an equi-join: user, and the step in which the later day lies
    later = active.crossJoin(F.broadcast(first)).select("u", F.expr(f"date_add(first, cast(floor(datediff(d, first) / {days}) * {days} - {days} as int))").alias("cohort")).distinct()
    found = base.join(later.withColumn("back", F.lit(1)), ["u", "cohort"], "left")
    out = found.groupBy("cohort").agg(F.count("*").alias("base"), F.count("back").alias("retained"))
    return out.withColumn("rate", F.round(F.col("retained") / F.col("base"), 4))


# --- errors


#: Words of a message that name its severity, in the order they are looked for (fixed values).
SEVERITIES = {"critical": "critical|fatal", "high": "high|severe", "medium": "medium|moderate", "low": "low|minor"}
#: Categories of errors by patterns, in the order they are looked for (fixed values).
CATEGORIES = {
    "retrieval": r"retriev|fetch|find|search",
    "generation": r"generat|creat|produc",
    "parsing": r"pars|extract|format",
    "authentication": r"auth|login|credential",
    "rate_limit": r"rate|limit|throttl",
    "timeout": r"timeout|timed out|too long",
    "connection": r"connect|network|server",
    "validation": r"valid|schema|format",
}


def first_match(text: Column, patterns: Mapping[str, str], other: str | Column) -> Column:
    """The name of the first pattern found in the lower-cased text."""
    out = other if isinstance(other, Column) else F.lit(other)
    for name, pattern in reversed(patterns.items()):
        out = F.when(F.lower(text).rlike(pattern), name).otherwise(out)
    return out


def severity(message: Column, code: Column | None = None) -> Column:
    """What the message says, or else by its code: 500 and above high, 400 and above medium, below low; without a code medium."""
    by_code = F.lit("medium")
    if code is not None:
        by_code = F.when(code >= 500, "high").when(code >= 400, "medium").when(code.isNotNull(), "low").otherwise("medium")
    return first_match(message, SEVERITIES, by_code)


def category(message: Column) -> Column:
    return first_match(message, CATEGORIES, "other")


def errors_between(log: DataFrame, start=None, end=None, level: int | None = None, limit: int = 100) -> DataFrame:
    """Rows of a log(timestamp, level, ...) from start to end (both included) of a level or above, newest first, limit at most; ties by id if there is one."""
    rows = log
    for given, condition in ((start, F.col("timestamp") >= F.lit(start)), (end, F.col("timestamp") <= F.lit(end)), (level, F.col("level") >= F.lit(level))):
        rows = rows if given is None else rows.where(condition)
    return rows.orderBy(F.desc("timestamp"), *(["id"] if "id" in log.columns else [])).limit(limit)


#: What an error of each severity weighs (fixed values).
WEIGHTS = {"critical": 100, "high": 50, "medium": 20, "low": 5}


def error_frequency(events: DataFrame, is_error: Column, ts: str, unit: str) -> DataFrame:
    """Per period: errors, all, rate."""
    out = events.groupBy(period(F.col(ts), unit).alias("period")).agg(F.count_if(is_error).alias("errors"), F.count("*").alias("all"))
    return out.withColumn("rate", F.round(F.col("errors") / F.col("all"), 6))


def error_counts(errors: DataFrame, dimensions: Sequence[str]) -> DataFrame:
    """(dimension, value, n) of each dimension alone: one pass with grouping sets."""
    rows = errors.select(F.explode(F.array(*(F.struct(F.lit(d).alias("dimension"), F.col(d).cast("string").alias("value")) for d in dimensions))).alias("x"))
    return rows.groupBy("x.dimension", "x.value").agg(F.count("*").alias("n"))


def error_impact(errors: DataFrame, user: str, session: str, severity_col: str) -> DataFrame:
    weight = F.lit(1)
    for k, v in WEIGHTS.items():
        weight = F.when(F.col(severity_col) == k, v).otherwise(weight)
    return errors.agg(F.count_distinct(user).alias("users"), F.count_distinct(session).alias("sessions"), F.sum(weight).alias("score"))


def frequent_terms(rows: DataFrame, text: str, n: int, least: int = 3, stopwords: Sequence[str] = STOPWORDS) -> DataFrame:
    """The n most frequent lower-cased words of letters and digits, `least` characters long or more."""
    each = rows.select(F.explode(F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}\p{M}_]+"), F.lit(0))).alias("term"))
    each = each.where((F.length("term") >= least) & ~F.col("term").isin(list(stopwords)))
    return each.groupBy("term").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "term").limit(n)


def frequent_phrases(rows: DataFrame, text: str, size: int, n: int) -> DataFrame:
    each = rows.select(F.explode(ngrams(F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}\p{M}_]+"), F.lit(0)), size)).alias("phrase"))
    return each.groupBy("phrase").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "phrase").limit(n)


def resolution(errors: DataFrame, opened: str, closed: str) -> DataFrame:
    """One row: errors, share resolved, minutes to it (min, max, mean, median); null closed counts as open."""
    minutes = (F.unix_micros(F.col(closed).cast("timestamp")) - F.unix_micros(F.col(opened).cast("timestamp"))) / 6e7
    own = errors.select(minutes.alias("m"))
    out = own.agg(F.count("*").alias("errors"), F.round(F.count("m") / F.count("*"), 6).alias("rate"), *(F.round(f("m"), 4).alias(a) for f, a in ((F.min, "min"), (F.max, "max"), (F.avg, "mean"))))
    out = beside(out, at_ranks(own, "m", [], MIDDLE), []).withColumn("median", F.round(median(), 4))
    return out.select("errors", "rate", "min", "max", "mean", "median")


def resolution_methods(errors: DataFrame, closed: str, method: str) -> DataFrame:
    """(method, n) of resolved errors that say how."""
    return errors.where(F.col(closed).isNotNull() & F.col(method).isNotNull()).groupBy(F.col(method).alias("method")).agg(F.count("*").alias("n"))


# --- cost


def cost_per_model(usage: DataFrame, prices: DataFrame, fallback: str) -> DataFrame:
    """(model, input_tokens, output_tokens, cost): prices(model, input, output) are per million tokens; models without one take the fallback's."""
    per = usage.groupBy("model").agg(F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"))
    other = prices.where(F.col("model") == fallback).select(F.col("input").alias("fi"), F.col("output").alias("fo"))
    priced = per.join(prices, "model", "left").crossJoin(F.broadcast(other.limit(1)))
    cost = (F.col("input_tokens") * F.coalesce("input", "fi") + F.col("output_tokens") * F.coalesce("output", "fo")) / 1e6
    return priced.select("model", "input_tokens", "output_tokens", F.round(cost, 4).alias("cost"))


def cost_dominant_model(usage: DataFrame, prices: DataFrame, fallback: str) -> DataFrame:
    """One row: all tokens at the prices of the model that has most of them."""
    per = usage.groupBy("model").agg(F.sum("input_tokens").alias("i"), F.sum("output_tokens").alias("o"))
    most = per.agg(F.sum("i").alias("i"), F.sum("o").alias("o"), F.max_by("model", F.struct(F.col("i") + F.col("o"), "model")).alias("model"))
    other = prices.where(F.col("model") == fallback).select(F.col("input").alias("fi"), F.col("output").alias("fo")).limit(1)
    priced = most.join(prices, "model", "left").crossJoin(F.broadcast(other))
    return priced.select("model", F.col("i").alias("input_tokens"), F.col("o").alias("output_tokens"), F.round((F.col("i") * F.coalesce("input", "fi") + F.col("o") * F.coalesce("output", "fo")) / 1e6, 4).alias("cost"))


def cost_rollup(costs: DataFrame, by: Sequence[str]) -> DataFrame:
    """Sums over all prefixes of by; 'all' stands for what is summed over."""
    return costs.rollup(*by).agg(F.round(F.sum("cost"), 4).alias("cost")).fillna("all", list(by))


def tiered(amount: Column, free: float, price: float, per: float = 1.0) -> Column:
    """Price of what goes beyond a free allowance."""
    return F.round(F.greatest(amount - free, F.lit(0)) / per * price, 4)


#: Requests that a price is for, by provider (fixed values).
REQUESTS = {"aws": 1_000, "gcp": 10_000, "azure": 10_000}


def cloud_cost(usage: DataFrame, instances: DataFrame, provider: str, request_price: float, disk: tuple[float, float] = (3000, 0.005), throughput: tuple[float, float] = (125, 0.04)) -> DataFrame:
    """usage(id, instance, hours, iops, throughput, requests) with the costs compute, iops, throughput, requests and total, each rounded to 4 digits.

    instances(instance, price) by the hour; an unknown one costs nothing. disk and throughput: (what is free, price of one beyond that).
    """
    per = usage.join(instances.select("instance", F.col("price").alias("_price")), "instance", "left")
    out = per.withColumns({
        "compute_cost": F.round(F.coalesce("_price", F.lit(0.0)) * F.col("hours"), 4), "iops_cost": tiered(F.col("iops"), *disk), "throughput_cost": tiered(F.col("throughput"), *throughput),
        "request_cost": F.round(F.col("requests") / REQUESTS[provider] * request_price, 4),
    })
    parts = ("compute_cost", "iops_cost", "throughput_cost", "request_cost")
    return out.select("id", *parts, F.round(sum((F.col(p) for p in parts[1:]), F.col(parts[0])), 4).alias("total"))


def price_table(prices: Mapping[str, tuple[float, float]], rows: DataFrame) -> DataFrame:
    return rows.sparkSession.createDataFrame([(k, *v) for k, v in prices.items()], "model string, input double, output double")
