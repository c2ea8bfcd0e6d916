"""Periodic run detection: an all-lag scan of each document's word ids.

The array of word ids is compared with itself shifted by each lag p, up to n / EXPONENT, and true stretches are run-length coded: a stretch of L equal
pairs is a run of L + p words of period p. A run of EXPONENT periods needs (EXPONENT - 1) * p equal pairs in a row, so on the comb 0, p, 2p, ... at least EXPONENT - 1
neighbouring pairs are equal. The comb is looked at first, and only around such places are whole shifts compared; that loses no run and makes the scan of all lags
n log n instead of quadratic. A run counts at its smallest period: at a multiple of it the same stretch comes again and is passed over.

A document's lags are independent of each other, so Spark distributes documents, and of long documents ranges of lags: each (text, range of lags) is a row of its own, and
the runs of its ranges are put together again.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.shared import let, n_partitions, words
from tessera.session import ship

#: Periods that a run holds at least, and its words at least.
EXPONENT, LEAST = 4, 6
#: Lags of one task. A document of at most so many lags is scanned where it is read.
LAGS = 1 << 17

RUN = "struct<start:bigint,length:bigint,period:bigint>"


def word_ids(words: list[bytes]) -> np.ndarray:
    known: dict[bytes, int] = {}
    return np.fromiter((known.setdefault(w, len(known)) for w in words), dtype=np.int32, count=len(words))


def stretch(same, at: int, low: int, high: int, step: int = 64) -> tuple[int, int]:
    """The true stretch [start, end) of same(a, b), an array of booleans, around place `at` within [low, high). Steps double, so its cost is that of the stretch."""
    end, size = at, step
    while end < high:
        part = same(end, min(high, end + size))
        if not part.all():
            end += int(part.argmin())
            break
        end, size = end + len(part), 2 * size
    start, size = at, step
    while start > low:
        part = same(max(low, start - size), start)[::-1]
        if not part.all():
            start -= int(part.argmin())
            break
        start, size = start - len(part), 2 * size
    return start, end


def smallest(ids: np.ndarray, start: int, end: int, p: int) -> int:
    """The smallest period of ids[start:end], which has period p and at least two of them: a divisor of p."""
    q, rest, d = p, p, 2
    while rest > 1:
        if d * d > rest:
            d = rest
        if rest % d:
            d += 1
            continue
        while rest % d == 0:
            rest //= d
        while q % d == 0 and np.array_equal(ids[start : start + p - q // d], ids[start + q // d : start + p]) and np.array_equal(ids[start : end - q // d], ids[start + q // d : end]):
            q //= d
    return q


def runs_of(ids: np.ndarray, low: int = 1, high: int | None = None, exponent: int = EXPONENT, least: int = LEAST) -> list[tuple[int, int, int]]:
    """Runs (start, length, period) whose smallest period lies in [low, high), by start and period: maximal stretches of at least `least` words and `exponent` periods."""
    n = len(ids)
    last = n // exponent + 1
    high = last if high is None else min(high, last)
    found: list[tuple[int, int, int]] = []
    seen: dict[int, list[tuple[int, int]]] = {}  # smallest period: stretches, in order of their first sight
    teeth = exponent - 1

    def look(p: int, places: list[int]) -> None:
        """Measures the stretches of lag p around places of its comb."""
        passed = 0
        inside = [r for q, own in seen.items() if p % q == 0 for r in own] if seen else ()
        for at in places:
            if at < passed:  # in the stretch measured last
                continue
            known = next((e for s, e in inside if s <= at and at + teeth * p < e), None)
            if known is not None:
                passed = known - p
                continue
            start, end = stretch(lambda a, b: ids[a:b] == ids[a + p : b + p], at, 0, n - p)
            passed = end
            if end - start < max(teeth * p, least - p):
                continue
            q = smallest(ids, start, end + p, p)
            seen.setdefault(q, []).append((start, end + p))
            if q == p:
                found.append((start, end + p - start, p))

    middle = min(high, max(low, int(n**0.5) + 1))
    for p in range(low, middle):  # short lags: the whole comb of each
        comb = ids[::p]
        same = comb[1:] == comb[:-1]
        hit = same[: len(same) - teeth + 1].copy()
        for k in range(1, teeth):
            hit &= same[k : len(same) - teeth + 1 + k]
        if hit.any():
            look(p, (np.flatnonzero(hit) * p).tolist())
    if middle < high:  # long lags have short combs: the same tooth of all of them at once
        lags = np.arange(middle, high)
        places: dict[int, list[int]] = {}
        trail = [np.zeros(0, dtype=bool)] * teeth
        for k in range((n - 1) // middle):
            m = min(len(lags), (n - 1) // (k + 1) - middle + 1)  # lags whose tooth k + 1 lies in the text
            a, b = ids[k * middle :: k] if k else np.broadcast_to(ids[0], m), ids[(k + 1) * middle :: k + 1]
            trail = [*trail[1:], a[:m] == b[:m]]
            if k >= teeth - 1:
                hit = trail[-1].copy()
                for x in trail[:-1]:
                    hit &= x[:m]
                for j in np.flatnonzero(hit).tolist():
                    places.setdefault(middle + j, []).append((k - teeth + 1) * (middle + j))
        for p in sorted(places):
            look(p, places[p])
    return sorted(found, key=lambda r: (r[0], r[2]))


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words without those of runs after their first period, joined by one space."""
    if not runs:
        return b" ".join(words)
    keep = np.ones(len(words), dtype=bool)
    for start, length, period in runs:
        keep[start + period : start + length] = False
    return b" ".join([words[k] for k in np.flatnonzero(keep).tolist()])


def _rows(runs: list[list[tuple[int, int, int]]]) -> pa.Array:
    names = ("start", "length", "period")
    flat = [r for own in runs for r in own]
    values = pa.StructArray.from_arrays([pa.array([r[k] for r in flat], pa.int64()) for k in range(3)], names)
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, runs)]), pa.int32()), values)


def _scan(exponent: int, least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, runs, texts = [], [], []
            for t in batch.column(1):
                words = (t.as_py() or b"").split()
                own = runs_of(word_ids(words), exponent=exponent, least=least)
                n.append(len(words))
                runs.append(own)
                texts.append(collapsed(words, own))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), _rows(runs), pa.array(texts, pa.binary())], ["doc_id", "n_words", "runs", "collapsed"])

    return run


def _ranges(exponent: int, least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            runs = [runs_of(word_ids(t.as_py().split()), low, low + lags, exponent, least) for t, low, lags in zip(batch.column(1), batch.column(2).to_pylist(), batch.column(3).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), _rows(runs)], ["name", "runs"])

    return run


def _finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n, texts = [], []
        for t, own in zip(batch.column(1), batch.column(2).to_pylist()):
            words = t.as_py().split()
            n.append(len(words))
            texts.append(collapsed(words, [(r["start"], r["length"], r["period"]) for r in own]))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), batch.column(2), pa.array(texts, pa.binary())], ["doc_id", "n_words", "runs", "collapsed"])


def detect(docs: DataFrame, exponent: int = EXPONENT, least: int = LEAST, lags: int = LAGS) -> DataFrame:
    """doc_id, n_words, runs (array of start, length, period, by start and period) and collapsed of every row of docs(doc_id, text).

    A run is a maximal stretch of words with smallest period q that holds `exponent` periods and `least` words at least; collapsed is the text, words joined by one space,
    without the words of runs after their first period. Words are `[^\\x20\\x09-\\x0D]+`. Null and wordless texts have no words, no runs and an empty collapsed text.
    Repeated rows and ids, null ids too, each keep their row; other columns are ignored; an empty table gives none. Very long texts, of more lags than `lags`, are scanned as several
    rows of (text, range of lags), equal texts once.
    """
    spark = docs.sparkSession
    ship(spark)
    own = docs.select("doc_id", F.col("text").cast("binary").alias("text"))
    kind = own.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_words long, runs array<{RUN}>, collapsed binary"
    most = F.floor((F.octet_length("text") + 1) / 2 / exponent).cast("long")  # a word and its space take two bytes or more
    short = own.where(F.col("text").isNull() | (most <= lags)).mapInArrow(_scan(exponent, least), schema)
    long = own.where(most > lags)
    texts = long.select(F.sha2("text", 256).alias("name"), "text", most.alias("most")).dropDuplicates(["name"])
    ranges = texts.select("name", "text", F.explode(F.sequence(F.lit(1), F.col("most"), F.lit(lags).cast("long"))).alias("low"), F.lit(lags).cast("long").alias("lags"))
    parts = ranges.repartition(n_partitions(spark), "name", "low").mapInArrow(_ranges(exponent, least), f"name string, runs array<{RUN}>")
    whole = parts.groupBy("name").agg(F.array_sort(F.flatten(F.collect_list("runs")), _by_start).alias("runs"))  # the runs of one text
    joined = long.join(whole, F.sha2("text", 256) == F.col("name")).select("doc_id", "text", "runs")
    found = short.unionByName(joined.mapInArrow(_finish, schema))
    return found.withColumn("collapsed", F.col("collapsed").cast("string"))


def _by_start(a: Column, b: Column) -> Column:
    """For array_sort: by start, then by period."""
    return F.when(a["start"] < b["start"], -1).when(a["start"] > b["start"], 1).when(a["period"] < b["period"], -1).when(a["period"] > b["period"], 1).otherwise(0)


def strongest(runs: Column) -> Column:
    """The run with the greatest exact length / period, of those the smallest start, then period; null if there is none."""

    def better(a: Column, b: Column) -> Column:
        left, right = a["length"] * b["period"], b["length"] * a["period"]
        tie = (a["start"] < b["start"]) | ((a["start"] == b["start"]) & (a["period"] <= b["period"]))
        return F.when(a.isNull() | (left < right), b).when(left > right, a).when(tie, a).otherwise(b)

    return F.aggregate(runs, F.lit(None).cast(RUN), better)


def tail_repeated(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text) with the tail of a tenth of the texts, chosen by the checksum of the id, made periodic: a known truth to find. A null id chooses none."""
    h = F.crc32(F.col("doc_id").cast("string"))
    g = F.floor(h / 10).cast("long")

    def edited(w: Column) -> Column:
        n = F.size(w).cast("long")
        return let(
            F.struct(w.alias("w"), n.alias("n"), (g % n).alias("a")),
            lambda x: F.array_join(
                F.transform(x["w"], lambda _, i: F.get(x["w"], F.when(i < x["a"], i.cast("long")).otherwise(x["a"] + (i - x["a"]) % (1 + F.floor((x["n"] - x["a"]) / (3 + g % 8)).cast("long"))).cast("int"))), " "
            ),
        )

    split = let(words(F.col("text")), lambda w: F.when(F.size(w) > 0, edited(w)))
    return docs.select("doc_id", F.when(F.coalesce(h % 10 == 0, F.lit(False)), split).otherwise(F.col("text")).alias("text"))


def report(found: DataFrame) -> DataFrame:
    """One row for each of detect()'s: doc_id, n_runs, the strongest run and digests of the runs and of the collapsed text."""
    line = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string"))), "\n")
    best = found.select("doc_id", "n_words", "runs", F.col("collapsed"), strongest(F.col("runs")).alias("best"))
    return best.select(
        "doc_id", "n_words", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
        F.floor(F.lit(1000) * F.col("best.length") / F.col("best.period")).cast("long").alias("exponent_milli"),
        F.sha2(F.when(F.size("runs") > 0, F.concat(line, F.lit("\n"))).otherwise(""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
