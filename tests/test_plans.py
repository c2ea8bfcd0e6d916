"""Table functions, hops, topics and sinks against plain versions."""

import hashlib
import json
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tessera import catalog
from tessera.functions import tables
from tessera.operators import chunking, retrieval, topics
from tessera.plans import hops
from tessera.streaming import sinks, windows

SF = "/root/testdata/sf0.001"

TEXTS = ["One two three. Four five!\n\nSix seven eight nine ten. " * 9, "", None, "short", "x" * 300, "a. b. c.", "def f():\n    return 1\n\nclass A:\n    pass\n"]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")


CALLS = {
    "chunk_recursive(d.text, 50, 10)": lambda t: chunking.split_recursive(t, 50, 10),
    "chunk_adaptive(d.text, 60)": lambda t: chunking.split_adaptive(t, 60),
    "chunk_code(d.text, 20)": lambda t: chunking.split_code(t, 20),
}


@pytest.mark.parametrize("call", list(CALLS))
def test_table_functions_give_what_the_dataframe_forms_give(spark, docs, call):
    assert set(tables.register(spark)) == set(tables.SPLITTERS)
    got = spark.sql(f"SELECT d.doc_id, c.* FROM {{docs}} d, LATERAL {call} c", docs=docs)
    want = chunking.chunked(docs, CALLS[call], "doc_id", "text")
    assert got.columns == want.columns and sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_table_functions_of_windows(spark, docs):
    tables.register(spark)
    for call, of in (("chunk_fixed(d.text, 40, 5)", chunking.fixed(F.col("text"), 40, 5)), ("chunk_sentences(d.text, 3, 1)", chunking.sentence_windows(F.col("text"), 3, 1))):
        got = spark.sql(f"SELECT d.doc_id, c.* FROM {{docs}} d, LATERAL {call} c", docs=docs)
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, chunking.numbered(docs, of, ["doc_id"]).collect()))


def test_table_functions_of_ones_own(spark, docs):
    assert tables.register(spark, {"chunk_lines": lambda t: t.splitlines()}) == ["chunk_lines"]
    got = spark.sql("SELECT c.content FROM {docs} d, LATERAL chunk_lines(d.text) c WHERE d.doc_id = 6", docs=docs)
    assert [r.content for r in got.collect()] == TEXTS[6].splitlines()


def test_lateral_query_equals_the_dataframe_query(spark):
    got, want = (sorted(map(tuple, f(spark, SF).collect())) for f in (catalog.QUERIES["chunk_recursive_lateral"], catalog.QUERIES["chunk_recursive"]))
    assert got == want and got


# --- hops


def words(t):
    return {w for w in re.split(r"[ \t\n\r\f\x0B]+", (t or "").lower()) if w}


def plain_keyword(query, docs, k):
    q = words(query)
    scored = [(round(len(q & words(t)) / len(q), 5), i) for i, t in docs if q and q & words(t)]
    return [(i, s, n) for n, (s, i) in enumerate(sorted(scored, key=lambda x: (-x[0], x[1]))[:k], 1)]


def plain_frequent(t, n=8, least=5):
    counts = Counter(re.findall(rf"[^\W\d_]{{{least},}}", (t or "").lower()))
    return " ".join(w for w, _ in sorted(counts.items(), key=lambda x: (-x[1], x[0]))[:n]) or None


def plain_hops(questions, docs, n_hops, width, k):
    text = dict(docs)
    out = []
    for qid, query in questions:
        if query is None:
            continue
        frontier, seen = [query], set()
        for hop in range(1, n_hops + 1):
            new = {}
            for q in frontier:
                for i, s, rank in plain_keyword(q, docs, k):
                    key = hashlib.sha256(text[i].encode()).hexdigest() if text[i] is not None else f"#{i}"
                    if key not in seen:
                        row = (rank, q, i, s)
                        new[key] = min(new.get(key, row), row)
            rows = sorted(new.values())
            out += [(qid, hop, q, i, rank, s) for rank, q, i, s in rows]
            seen |= set(new)
            frontier = [f for _, _, i, _ in rows[:width] if (f := plain_frequent(text[i]))]
    return out


def test_hops_equal_a_plain_version(spark):
    docs = [(i, t) for i, t in enumerate(["alpha bravo charlie delta echoes", "delta echoes foxtrot golfing hotels", "hotels india juliet kiloes", "alpha bravo charlie delta echoes", "kiloes limas mikes november", "x y z", None, "", "november oscar papas quebec", "quebec romeo sierra tango alpha"])]
    questions = [(1, "alpha bravo"), (2, "india"), (3, None), (4, "nothing there"), (5, "x")]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    q = spark.createDataFrame(questions, "query_id long, query string")
    got = hops.hops(q, d, lambda f: retrieval.top_k(retrieval.keyword(f, d), 2), 3, 2)
    want = plain_hops(questions, docs, 3, 2, 2)
    assert sorted((r.question_id, r.hop, r.query, r.id, r["rank"], r.score) for r in got.collect()) == sorted(want)
    per = Counter((i, docs[k][1]) for i, _, _, k, _, _ in want)
    assert max(per.values()) == 1 and {h for _, h, *_ in want} == {1, 2, 3}


def test_hops_with_a_follow_up_of_ones_own_and_nothing_to_ask(spark):
    d = spark.createDataFrame([(1, "a b"), (2, "b c"), (3, "c d")], "doc_id long, text string")
    q = spark.createDataFrame([("s", "a")], "query_id string, query string")
    search = lambda f: retrieval.top_k(retrieval.keyword(f, d), 5)
    got = hops.hops(q, d, search, 4, 1, lambda query, content: F.when(F.length(query) == 1, content)).collect()
    assert sorted((r.hop, r.id) for r in got) == [(1, 1), (2, 2)]
    assert hops.hops(q.limit(0), d, search, 2).count() == 0


def test_multi_hop_query_equals_a_plain_version(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    got = [(r.question_id, r.hop, r.query, r.id, r["rank"], round(r.score, 5)) for r in catalog.QUERIES["multi_hop"](spark, SF).collect()]
    assert sorted(got) == sorted(plain_hops(items, docs, 3, 2, 3)) and len(got) > len(items)


# --- topics


def plain_topics(text, block=3, spread=0.5):
    parts = [p for p in (" ".join(re.split(r"[ \t\n\r\f\x0B]+", s)).strip(" ") for s in re.split(r"[.!?]+", text or "")) if p]
    sets = [set(re.findall(r"[^\W\d_]{4,}", p.lower())) for p in parts]
    c = []
    for g in range(1, len(parts)):
        left, right = set().union(*sets[max(0, g - block) : g]), set().union(*sets[g : g + block])
        c.append(round(len(left & right) / (len(left) * len(right)) ** 0.5, 6) if left and right else 0.0)
    depth = []
    for k, x in enumerate(c):
        i = j = k
        while i and c[i - 1] >= c[i]:
            i -= 1
        while j + 1 < len(c) and c[j + 1] >= c[j]:
            j += 1
        depth.append(round(c[i] + c[j] - 2 * x, 6))
    mean = sum(depth) / len(depth) if depth else 0
    limit = round(mean + spread * (sum((x - mean) ** 2 for x in depth) / len(depth)) ** 0.5, 6) if depth else 0
    out = []
    for k, p in enumerate(parts):
        if k and depth[k - 1] > 0 and depth[k - 1] >= limit or not out:
            out.append([])
        out[-1].append(p)
    return [". ".join(x) for x in out]


def test_topic_chunks(spark):
    one, two = "Rivers carry water slowly. Water fills rivers after rain. Rain makes rivers carry more water. ", "Engines burn petrol quickly. Petrol drives engines in cars. Cars need engines and petrol. "
    texts = [one + two, one * 3 + two * 3 + one * 2, "", None, "Single sentence only", one, "! ? .", "word. " * 40]
    got = {}
    for r in topics.topic_chunks(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect():
        got.setdefault(r.doc_id, []).append((r.chunk_index, r.chunk_count, r.content))
    for k, t in enumerate(texts):
        want = plain_topics(t)
        assert sorted(got.get(k, [])) == [(i, len(want), c) for i, c in enumerate(want)]
    assert len(got[0]) == 2 and sorted(got[0])[1][2].startswith("Engines burn")


# --- sinks


def test_a_replayed_batch_adds_nothing(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a"), (2, "b")], "id long, message string")
    sink = sinks.table_sink(str(tmp_path / "t"))
    assert sinks.complete(spark, str(tmp_path / "t")) is None
    for batch_id in (0, 1, 1, 0):
        sink(rows, batch_id)
    assert sorted((r.id, r.batch_id) for r in sinks.complete(spark, str(tmp_path / "t")).collect()) == [(1, 0), (1, 1), (2, 0), (2, 1)]
    (tmp_path / "t" / "batch_id=1" / "_SUCCESS").unlink()  # as if it had been cut short
    assert {r.batch_id for r in sinks.complete(spark, str(tmp_path / "t")).collect()} == {0}
    sink(rows, 1)
    assert sinks.complete(spark, str(tmp_path / "t")).count() == 4


def test_a_stream_to_a_table_and_alerts_told_once(spark, tmp_path):
    (tmp_path / "told").mkdir()
    told = str(tmp_path / "told")

    def notify(batch_id, rows):
        import uuid

        with open(f"{told}/{batch_id}-{uuid.uuid4().hex}", "w") as f:
            json.dump([r.id for r in rows], f)

    for k in range(3):
        own = [(f"2024-01-01 00:0{k}:{s:02d}", "disk", 10 * k + j, 40) for j, s in enumerate((1, 5, 40))]
        spark.createDataFrame(own, "ts string, kind string, id long, level int").withColumn("ts", F.to_timestamp("ts")).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("ts timestamp, kind string, id long, level int").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    fired = windows.alerts_stream(stream.where("level >= 40"), "ts", "kind", "id", 30)
    to = sinks.fan_out(sinks.table_sink(str(tmp_path / "log")), sinks.alert_sink(notify, str(tmp_path / "alerts")))
    q = fired.writeStream.outputMode("append").foreachBatch(to).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert q.exception() is None
    want = sorted(r.id for r in windows.alerts(spark.read.parquet(str(tmp_path / "in")), "ts", "kind", "id", 30).collect())
    heard = lambda: sorted(i for f in (tmp_path / "told").iterdir() for i in json.loads(f.read_text()))
    assert heard() == want == sorted(r.id for r in sinks.complete(spark, str(tmp_path / "log")).collect())
    kept = sinks.complete(spark, str(tmp_path / "alerts"))
    for r in kept.select("batch_id").distinct().collect():  # every batch once more
        sinks.alert_sink(notify, str(tmp_path / "alerts"))(kept.where(F.col("batch_id") == r.batch_id).drop("batch_id"), r.batch_id)
    assert heard() == want
