"""BM25 by products of matrices: against sums over shared words, for every variant, with words that most texts have, copies, ids of text, and repeated or missing ids; and how tasks share the work."""

import math
import random
from collections import Counter, defaultdict

import pytest

from tessera.operators import lexical, neighbours, retrieval


def plainly(queries, docs, variant, k, k1=1.5, b=0.75, delta=0.5):
    words = [(i, Counter((t or "").lower().split())) for i, t in docs]
    n, avgdl = len(words), sum(sum(w.values()) for _, w in words) / len(words)
    asked = {q: Counter(t.lower().split()) for q, t in queries}
    df = Counter(t for _, w in words for t in w)
    known = {t for q in asked.values() for t in q if t in df}
    idf = {t: {"okapi": math.log((n - df[t] + 0.5) / (df[t] + 0.5)), "l": math.log((n + 1) / (df[t] + 0.5)), "plus": math.log((n + 1) / df[t])}[variant] for t in known}
    if variant == "okapi":
        mean = sum(idf.values()) / len(idf)
        idf = {t: 0.25 * mean if x < 0 else x for t, x in idf.items()}
    out = {}
    for q, own in asked.items():
        scores = defaultdict(float)
        for i, w in words:
            for t in own.keys() & w.keys():
                scores[i] += own[t] * lexical.parts(variant, idf[t], w[t], 1 - b + b * sum(w.values()) / avgdl, k1, delta)
        floor = delta * sum(c * idf[t] for t, c in own.items() if t in idf) if variant == "plus" else 0.0
        best = sorted(((-round(s + floor, 5), i) for i, s in scores.items()))[:k]
        out |= {(q, i, r + 1): pytest.approx(-s, abs=2e-5) for r, (s, i) in enumerate(best)}
    return out


@pytest.mark.parametrize("variant", ["plus", "okapi", "l"])
def test_best_documents_are_those_of_the_sums(spark, monkeypatch, variant):
    monkeypatch.setattr(lexical, "TILE", 7)
    monkeypatch.setattr(lexical, "ENTRIES", 50)
    monkeypatch.setattr(lexical, "AT_ONCE", 3)
    rng = random.Random(5)
    text = lambda n: " ".join(["Usual"] * (rng.random() < 0.9) + [f"w{int(rng.paretovariate(0.6)) % 300}" for _ in range(n)])
    docs = [(i, text(rng.choice([0, 1, 5, 40, 300]))) for i in range(120)]
    docs += [(1000 + i, docs[4][1]) for i in range(5)] + [(2000, None), (2001, " \n")]
    queries = [(i, docs[i][1]) for i in range(0, 120, 11)] + [(999, "nothing of it"), (998, "")]
    made = spark.createDataFrame(docs, "doc_id long, text string")
    rows = retrieval.bm25(spark.createDataFrame(queries, "query_id long, query string"), made, variant, k=6).collect()
    want = plainly(queries, docs, variant, 6)
    assert {(r.query_id, r.id, r["rank"]): r.score for r in rows} == want
    named = spark.createDataFrame([(f"q{i:04}", t) for i, t in queries], "query_id string, query string")
    rows = retrieval.bm25(named, made.selectExpr("lpad(doc_id, 6, '0') AS doc_id", "text"), variant, k=6).collect()
    assert {(int(r.query_id[1:]), int(r.id), r["rank"]): r.score for r in rows} == want


def test_repeated_and_missing_ids(spark):
    docs = [(1, "a b"), (1, "a c"), (None, "a d"), (2, "b c d"), (3, "e")]
    q = spark.createDataFrame([(7, "a b c"), (8, "d"), (None, "e")], "query_id long, query string")
    made = spark.createDataFrame(docs, "doc_id long, text string")
    key = lambda r: (str(r[0]), str(r[1]), r[2])
    whole = [tuple(r)[:3] for r in retrieval.bm25(q, made, "l").collect()]
    best = [tuple(r)[:3] for r in retrieval.bm25(q, made, "l", k=9).collect()]
    assert sorted(best, key=key) == sorted(whole, key=key)
    assert {r[:2] for r in best} == {(7, 1), (7, None), (7, 2), (8, None), (8, 2), (None, 3)}


def test_pairs_of_queries_and_documents_are_no_rows(spark):
    docs = spark.createDataFrame([(i, f"all of them w{i}") for i in range(3000)], "doc_id long, text string")
    asked = spark.createDataFrame([(i, f"all of them w{i}") for i in range(0, 3000, 10)], "query_id long, query string")
    out = retrieval.bm25(asked, docs, "plus", k=1)
    out.collect()
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "Generate" in plan
    assert {(r.query_id, r.id) for r in out.collect()} == {(i, i) for i in range(0, 3000, 10)}


def test_slices_of_a_block_go_to_tasks_by_turns(spark):
    points = spark.range(400).selectExpr("0 AS cell", "id", "array(cast(id AS double), 1.0D) AS v")
    asked, told = neighbours.packed(points.where("id < 10"), 100), neighbours.packed(points, 4)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    found = neighbours.meet(asked, told, n, lambda: neighbours.Top(3, "dot", False), "query_id long, id long, score double")
    sizes = found.rdd.mapPartitions(lambda rows: [len({r.query_id for r in rows})]).collect()
    assert sizes == [10] * n  # by the hash of four keys a task can be without any


def test_pairs_of_contents_are_scored_once(spark):
    from pyspark.sql import functions as F

    from tessera.operators import metrics

    rows = [(i, f"text {i % 3} of query {i}") for i in range(40)]
    results = spark.createDataFrame(rows, "query_id long, content string")
    n = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def likeness(a, b):
        n.add(1)
        return 1.0 if a == b else 0.0

    out = metrics.overlap_by_content(results, results, similarity=likeness).collect()
    assert {r.content_f1 for r in out} == {1.0} and len(out) == 40
    assert n.value == 40  # 80 when either side's best match scored the pairs anew


def test_blocks_hold_numbers_as_bytes(spark):
    """A block goes to many tasks: of 40 queries of 500 words each it has a few bytes a word, not a row."""
    rows = spark.range(20000).selectExpr("id % 40 AS query_id", "id div 40 * 3 AS t", "1 + id % 2 AS qtf", "1.0 / (1 + id div 40) AS idf")
    blocks = lexical._blocks(rows).collect()
    assert sorted(i for b in blocks for r in b.rows for i in r["ids"]) == list(range(40))
    assert sum(len(r[c]) for b in blocks for r in b.rows for c in ("n", "weight", "words", "code", "tf")) < 8 * 20000
    assert lexical._blocks(rows.limit(0)).count() == 0
