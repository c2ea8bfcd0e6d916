"""Streams of events: windows with watermarks, alerts with a cool-down, caches with expiry.

Event times without a zone are cast to timestamps, as watermarks need them.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.session import ship
from tessera.tables import n_partitions, written


def timed(events: DataFrame, ts: str = "ts") -> DataFrame:
    return events.withColumn(ts, F.col(ts).cast("timestamp"))


def throughput(events: DataFrame, ts: str, by: str, length: str = "60 seconds", slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """(start, by, n) of tumbling or sliding windows; the same for a batch."""
    rows = timed(events, ts)
    rows = rows.withWatermark(ts, late) if rows.isStreaming else rows
    return rows.groupBy(F.window(ts, length, slide) if slide else F.window(ts, length), by).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), by, "n")


def gap_sessions(events: DataFrame, ts: str, user: str, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """(user, start, stop, n) of sessions that a pause ends."""
    rows = timed(events, ts)
    rows = rows.withWatermark(ts, late) if rows.isStreaming else rows
    return rows.groupBy(F.session_window(ts, gap).alias("w"), user).agg(F.count("*").alias("n")).select(user, F.col("w.start").alias("start"), F.col("w.end").alias("stop"), "n")


def distinct_events(events: DataFrame, ts: str, key: str, late: str = "10 minutes") -> DataFrame:
    """Each key once while it is within the watermark."""
    rows = timed(events, ts)
    return rows.withWatermark(ts, late).dropDuplicatesWithinWatermark([key]) if rows.isStreaming else rows.dropDuplicates([key])


def cool_down(times: list[float], seconds: float) -> list[bool]:
    """Which of the times, in order, raise an alert: those at least seconds after the last that did."""
    last, out = None, []
    for t in times:
        out.append(last is None or t - last >= seconds)
        last = t if out[-1] else last
    return out


def chain(times: DataFrame, key: str, t: str, wait: int) -> DataFrame:
    """(key, t) of a chain through times(key, t), whole numbers: the least t of each key, and after each link the least t that is `wait` (above 0) or more behind it.

    Time is cut into slices of `wait`. A link's follower lies in the next slice or is the first of a later one, so it is found by a range lookup within a slice: no key is ordered as a whole. The links are then marked by pointer doubling: round k
    adds as many links as there are, through pointers 2^k links long, so the rounds are the logarithm of the longest chain.
    """
    k = F.struct(key).alias("k")
    nodes = times.where(F.col(t).isNotNull()).select(k, F.col(t).alias("t")).distinct()
    nodes = written(nodes.withColumn("slice", ((F.col("t") - F.pmod("t", F.lit(wait))) / wait).cast("long")), "nodes")
    firsts = nodes.groupBy("k", "slice").agg(F.min("t").alias("first"))  # rows by the span of time, not by the events
    order = Window.partitionBy("k").orderBy("slice")
    firsts = written(firsts.select("k", "slice", F.lead("first").over(order).alias("beyond")), "firsts")
    # each node looks up t + wait in the next slice: the least node there that is not before it
    asked = nodes.select("k", (F.col("slice") + 1).alias("slice"), (F.col("t") + wait).alias("at"), F.col("t").alias("own"), F.lit(None).cast("long").alias("hit"))
    told = nodes.select("k", "slice", F.col("t").alias("at"), F.lit(None).cast("long").alias("own"), F.col("t").alias("hit"))
    falling = Window.partitionBy("k", "slice").orderBy(F.desc("at"), F.col("own").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0)
    looked = asked.unionByName(told).withColumn("next", F.last("hit", True).over(falling)).where("own IS NOT NULL").select("k", "slice", F.col("own").alias("t"), "next")
    # none there: the first of the slice behind it that has any
    rest = written(looked.where("next IS NULL").select("k", "slice", "t"), "rest")
    same = rest.join(firsts, ["k", "slice"]).select("k", "t", F.col("beyond").alias("next"))
    none = rest.join(firsts, ["k", "slice"], "left_anti").select("k", (F.col("slice") - 1).alias("slice"), "t")
    after = same.unionByName(none.join(firsts, ["k", "slice"]).select("k", "t", F.col("beyond").alias("next"))).where("next IS NOT NULL")
    hits = looked.where("next IS NOT NULL").select("k", "t", "next")
    jumps = written(hits.unionByName(after), "jumps")
    reached = written(nodes.groupBy("k").agg(F.min("t").alias("t")), "links")
    while True:
        new = written(reached.join(jumps, ["k", "t"]).select("k", F.col("next").alias("t")), "links")
        if new.isEmpty():
            return reached.select(F.col("k")[key].alias(key), F.col("t").alias(t))
        reached = reached.unionByName(new)
        on = jumps.select("k", F.col("t").alias("next"), F.col("next").alias("after"))
        jumps = written(jumps.join(on, ["k", "next"]).select("k", "t", F.col("after").alias("next")), "jumps")


def alerts(events: DataFrame, ts: str, key: str, tie: str, seconds: float) -> DataFrame:
    """(key, ts, tie) of the events that raise an alert, of a batch: the first of each key, and each that comes `seconds` or more after the last alert; of one moment the event with the least tie.

    Null keys are a key; events without a time raise none. Without a cool-down every event raises one. See chain() for how keys of any size are followed.
    """
    own = timed(events, ts).select(key, ts, tie)
    wait = round(seconds * 1e6)
    if wait <= 0:
        return own.where(F.col(ts).isNotNull())
    micros = F.unix_micros(ts)
    links = chain(own.select(key, micros.alias("_t")), key, "_t", wait).select(F.col(key).alias("_k"), "_t")
    first = own.where(F.col(ts).isNotNull()).groupBy(key, ts).agg(F.min(tie).alias(tie))
    return first.join(links, F.col(key).eqNullSafe(F.col("_k")) & (micros == F.col("_t")), "left_semi").select(key, ts, tie)


def alerting(log: DataFrame, level: int, types: Sequence[str] | None = None, patterns: Sequence[str] | None = None) -> DataFrame:
    """Rows of a log(level, error_type, message) that may raise an alert, before any cool-down: of the level or above, of one of the types, with a message that one of the patterns finds."""
    rows = log.where(F.col("level") >= level)
    rows = rows if types is None else rows.where(F.col("error_type").isin(list(types)))
    return rows if patterns is None else rows.where(F.exists(F.array(*map(F.lit, patterns)), lambda p: F.regexp(F.col("message"), p)))


def alerts_stream(events: DataFrame, ts: str, key: str, tie: str, seconds: float, late: str = "1 hour") -> DataFrame:
    """alerts() of a stream: the last alert of each key is its state. Events of one trigger are taken in order of time; late ones never move the last alert back."""
    from pyspark.sql.streaming.state import GroupStateTimeout

    def run(k: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else None
        rows = pd.concat(list(batches)).sort_values([ts, tie])
        keep = []
        for t in rows[ts]:
            at = t.timestamp()
            keep.append(last is None or at - last >= seconds)
            last = at if keep[-1] else last
        if last is not None:
            state.update((last,))
        yield rows[keep]

    ship(events.sparkSession)
    own = timed(events, ts).select(key, ts, tie).withWatermark(ts, late)
    return own.groupBy(key).applyInPandasWithState(run, own.schema, "last double", "append", GroupStateTimeout.NoTimeout)


POLICIES = ("fixed", "access", "sliding", "adaptive", "never")


def expires_at(created: float, last: float, n: int, ttl: float, policy: str) -> float | None:
    """When an entry that was created, last used and used n times (creation included) expires, in seconds; None for never.

    fixed, access: ttl after creation, which counts as the access that is meant; sliding: ttl after the last use; adaptive: after the last use, ttl times up to 2 the more it is used an hour, ttl after creation while it is not used again.
    """
    if policy == "never":
        return None
    if policy in ("fixed", "access"):
        return created + ttl
    factor = 1.0 if policy == "sliding" or n == 1 else min(2.0, 1 + (n - 1) / max(1.0, (last - created) / 3600) / 10)
    return last + ttl * factor


LIFE = "created double, last double, n long, expires double"


def _lives(key_type: pa.DataType, ttl: float, policy: str):
    """Over rows in order of key and time: one row an entry, with only the open entry held."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, life = None, None

        def row(k, x):
            return (k, *x, expires_at(*x, ttl, policy))

        for batch in batches:
            out = []
            for k, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if life is not None and (k != now or t > expires_at(*life, ttl, policy)):
                    out.append(row(now, life))
                    life = None
                now, life = k, (life[0], t, life[2] + 1) if life else (t, t, 1)
            yield _lives_batch(out, key_type)
        if life is not None:
            yield _lives_batch([row(now, life)], key_type)

    return run


def _lives_batch(rows: list[tuple], key_type: pa.DataType) -> pa.RecordBatch:
    kinds = (key_type, pa.float64(), pa.float64(), pa.int64(), pa.float64())
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)], ["key", "created", "last", "n", "expires"])


def lifetimes(accesses: DataFrame, key: str, ts: str, ttl: float, policy: str = "fixed") -> DataFrame:
    """(key, created, last, n, expires) of each entry of a cache, from its access log, times in seconds: an access after an entry has expired makes a new one (see expires_at()).

    never: one entry a key, by an aggregate. fixed and access: entries are a chain through each key's times, sliding: pauses longer than ttl part them; both keep no key together as a whole.
    adaptive: an entry's end depends on its whole past, so each key's times are followed in order, with one entry held at a time. Accesses without a time are left out.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    if policy not in POLICIES:
        raise ValueError(policy)
    own = accesses.where(F.col(ts).isNotNull()).select(key, F.unix_micros(F.col(ts).cast("timestamp")).alias("_t"))
    second = lambda c: F.col(c) / 1e6
    if policy == "adaptive":
        ship(accesses.sparkSession)
        kind = own.schema[key].dataType
        rows = own.select(F.col(key).alias("key"), second("_t").alias("t")).repartition(n_partitions(accesses.sparkSession), "key").sortWithinPartitions("key", "t")
        return rows.mapInArrow(_lives(to_arrow_type(kind), ttl, policy), f"key {kind.simpleString()}, {LIFE}").withColumnRenamed("key", key)
    if policy == "never":
        lives = own.groupBy(key).agg(F.min("_t").alias("_a"), F.max("_t").alias("_z"), F.count("*").alias("n"))
    elif policy == "sliding":
        lives = _by_pauses(own, key, round(ttl * 1e6))
    else:
        wait = round(ttl * 1e6) + 1
        starts = chain(own, key, "_t", wait).select(F.col(key).alias("_k"), F.col("_t").alias("_a"))
        # an entry's accesses lie in the slice of its creation or the next
        cut = lambda c: ((F.col(c) - F.pmod(c, F.lit(wait))) / wait).cast("long")
        spans = starts.select("_k", "_a", F.explode(F.array(cut("_a"), cut("_a") + 1)).alias("_s"))
        near = own.withColumn("_own", cut("_t")).join(spans, F.col(key).eqNullSafe(F.col("_k")) & (F.col("_own") == F.col("_s")) & F.col("_t").between(F.col("_a"), F.col("_a") + wait - 1))
        lives = near.groupBy(key, "_a").agg(F.max("_t").alias("_z"), F.count("*").alias("n"))
    end = {"never": F.lit(None).cast("double"), "sliding": second("_z") + ttl}.get(policy, second("_a") + ttl)
    return lives.select(key, second("_a").alias("created"), second("_z").alias("last"), "n", end.alias("expires"))


def _by_pauses(own: DataFrame, key: str, pause: int) -> DataFrame:
    """(key, _a, _z, n) of sessions that a pause longer than `pause` ends: Spark's session windows part times that are `gap` or more apart."""
    rows = own.select(key, F.timestamp_micros("_t").alias("_ts"), "_t")
    return rows.groupBy(F.session_window("_ts", f"{pause + 1} microseconds").alias("_w"), key).agg(F.min("_t").alias("_a"), F.max("_t").alias("_z"), F.count("*").alias("n")).drop("_w")


def lifetimes_stream(accesses: DataFrame, key: str, ts: str, ttl: float, policy: str = "fixed", late: str = "1 hour") -> DataFrame:
    """lifetimes() of a stream: a row for each entry once the watermark has passed its end, or an access behind it has come and the watermark has passed that access.

    State by key: the accesses that the watermark has not passed, and the open entry. A timer at the entry's end, moved as accesses come, closes it, so entries that are never used again are given as well; accesses
    may come in any order within the watermark, those behind it are dropped. Policy never gives no row, as no entry ends. Needs the RocksDB state store.
    """
    from tessera.streaming.entries import Entries

    ship(accesses.sparkSession)
    own = timed(accesses, ts).select(F.col(key).alias("key"), F.col(ts).alias("ts")).withWatermark("ts", late)
    kind = own.schema["key"].dataType.simpleString()
    found = own.groupBy("key").transformWithStateInPandas(Entries(ttl, policy), f"key {kind}, {LIFE}", "append", "eventTime")
    return found.withColumnRenamed("key", key)


def expiry(accesses: DataFrame, key: str, ts: str, ttl: float, policy: str = "fixed") -> DataFrame:
    """(key, created, last, n, expires) from an access log, times in seconds: when each cache entry expires.

    fixed: ttl after creation; sliding: after the last access; adaptive: after the last access, ttl times up to 2 the more it is used an hour.
    """
    t = F.unix_micros(F.col(ts).cast("timestamp")) / 1e6
    per = accesses.groupBy(key).agg(F.min(t).alias("created"), F.max(t).alias("last"), F.count("*").alias("n"))
    rate = F.col("n") / F.greatest(F.lit(1.0), (F.col("last") - F.col("created")) / 3600)
    at = {"fixed": F.col("created") + ttl, "sliding": F.col("last") + ttl, "adaptive": F.col("last") + ttl * F.least(F.lit(2.0), 1 + rate / 10), "never": F.lit(None).cast("double")}[policy]
    return per.withColumn("expires", F.round(at, 3))
