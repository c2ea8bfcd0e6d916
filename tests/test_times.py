"""Alerts with a cool-down and lifetimes of cache entries, batch and stream, against plain folds."""

import random
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from tessera.streaming import windows

START = datetime(2024, 1, 1, tzinfo=timezone.utc)


def log(seed, n=300, keys=("a", "b", None), span=4000):
    rng = random.Random(seed)
    rows = [(rng.choice(keys), START + timedelta(seconds=rng.randint(0, span) if rng.random() < 0.8 else rng.randint(0, 50)), k) for k in range(n)]
    return rows + [rows[0], rows[1], ("late", START + timedelta(seconds=3 * span), n), ("none", None, n + 1)]


@pytest.mark.parametrize("seed,seconds", [(1, 60), (2, 1), (3, 500), (4, 7.5), (5, 0), (6, 100_000)])
def test_alerts_of_a_batch(spark, seed, seconds):
    rows = log(seed)
    events = spark.createDataFrame(rows, "kind string, ts timestamp, id long").repartition(4)
    want = set()
    for key in {r[0] for r in rows}:
        own = sorted({r for r in rows if r[0] == key and r[1] is not None}, key=lambda r: (r[1], r[2]))
        fired = windows.cool_down([r[1].timestamp() for r in own], seconds)
        want |= {(key, r[2]) for r, on in zip(own, fired) if on}
    got = [(r.kind, r.id) for r in windows.alerts(events, "ts", "kind", "id", seconds).collect()]
    assert set(got) == want and (seconds == 0 or len(got) == len(want))
    assert windows.alerts(events.limit(0), "ts", "kind", "id", 60).count() == 0


def test_alerts_use_no_task_a_key(spark):
    events = spark.createDataFrame(log(7), "kind string, ts timestamp, id long")
    plan = windows.alerts(events, "ts", "kind", "id", 60)._jdf.queryExecution().toString()
    assert "InPandas" not in plan and "Python" not in plan


def plain_lives(rows, ttl, policy):
    out = []
    for key in {r[0] for r in rows}:
        life = None
        for t in sorted(r[1].timestamp() for r in rows if r[0] == key and r[1] is not None):
            if life and (end := windows.expires_at(*life, ttl, policy)) is not None and t > end:
                out.append((key, *life, end))
                life = None
            life = (life[0], t, life[2] + 1) if life else (t, t, 1)
        if life:
            out.append((key, *life, windows.expires_at(*life, ttl, policy)))
    return out


def rounded(rows):
    return sorted(((k, round(a, 3), round(z, 3), n, e and round(e, 3)) for k, a, z, n, e in rows), key=repr)


@pytest.mark.parametrize("policy", windows.POLICIES)
@pytest.mark.parametrize("ttl", [5, 90])
def test_lifetimes_of_a_batch(spark, policy, ttl):
    rows = log(11)
    accesses = spark.createDataFrame(rows, "kind string, ts timestamp, id long").repartition(4)
    got = windows.lifetimes(accesses, "kind", "ts", ttl, policy)
    assert got.columns == ["kind", "created", "last", "n", "expires"]
    assert rounded(map(tuple, got.collect())) == rounded(plain_lives(rows, ttl, policy))
    assert windows.lifetimes(accesses.limit(0), "kind", "ts", ttl, policy).count() == 0


@pytest.fixture()
def rocksdb(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield
    spark.conf.unset(name)


@pytest.mark.parametrize("policy", windows.POLICIES)
def test_lifetimes_of_a_stream(spark, rocksdb, tmp_path, policy):
    """Files in order of time but for accesses up to 100 seconds late; a last access far ahead closes every entry but its own."""
    rows = [(k, t, i) for k, t, i in log(12, 60, ("a", "b")) if t is not None and k != "late"]
    rng = random.Random(3)
    rows.sort(key=lambda r: r[1] + timedelta(seconds=rng.randint(0, 100)))
    for part in range(3):
        own = rows[part * len(rows) // 3 : (part + 1) * len(rows) // 3]
        spark.createDataFrame(own, "kind string, ts timestamp, id long").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    end = [("end", START + timedelta(days=3), 1)]
    spark.createDataFrame(end, "kind string, ts timestamp, id long").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("kind string, ts timestamp, id long").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    name = f"lives_{policy}"
    q = windows.lifetimes_stream(stream, "kind", "ts", 60, policy, "10 minutes").writeStream.outputMode("append").format("memory").queryName(name).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(200)
    assert q.exception() is None
    want = [] if policy == "never" else plain_lives(rows, 60, policy)
    assert rounded(map(tuple, spark.table(name).collect())) == rounded(want)
