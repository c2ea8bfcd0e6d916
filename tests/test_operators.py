"""Small cases of the retrieval library: conventions for empty inputs, filters, sources, collections, streams, chunkers."""

import json
import random
from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.functions import vectors as V
from tessera.operators import chunking, corpus, embeddings, fusion, metrics, retrieval, telemetry
from tessera.plans import retriever, schema
from tessera.plans.predicates import Pred, where
from tessera.sources import readers
from tessera.sources.collections import Collection, migrate
from tessera.streaming import windows


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def results(spark, rows):
    return spark.createDataFrame(rows, "query_id long, id long, score double, rank int")


def test_text_functions(spark):
    lit = F.lit
    assert one(spark, T.normalize_whitespace(lit(" a  b\r\n\r\n\r\n\r\nc "))) == "a b\n\nc"
    assert one(spark, T.strip_html(lit("<p>a &amp; b</p><script>x</script><p>c</p>"))) == "a & b\nc"
    assert one(spark, T.remove_noise(lit("see https://a.b/c or mail me@x.org now @you <b>x</b>"))) == "see or mail now x"
    assert one(spark, T.dedup_lines(lit("a\nb\na"))) == "a\nb"
    assert one(spark, T.remove_stopwords(lit("The cat is on it"))) == "cat"
    assert one(spark, T.jaccard(lit("a b"), lit("b c"))) == pytest.approx(1 / 3) and one(spark, T.jaccard(lit(""), lit(""))) == 0
    assert one(spark, T.ngrams(T.tokens(lit("a b c")), 2)) == ["a b", "b c"] and one(spark, T.ngrams(T.tokens(lit("a")), 2)) == []
    assert one(spark, T.json_in(lit('x ```json\n{"a": 1}\n``` y'))) == '{"a": 1}' and one(spark, T.json_in(lit("none"))) is None
    assert one(spark, T.markdown_headers(lit("# A\ntext\n## B"))) == ["A", "B"]
    assert one(spark, T.citations(lit("see 410 U.S. 113 and 5 F.3d 20"))) == ["410 U.S. 113", "5 F.3d 20"]
    assert one(spark, T.language_of_file(lit("a/b.py"))) == "python" and one(spark, T.language_of_file(lit("a"))) == "unknown"
    assert one(spark, T.readability(lit("short"))) is None
    for clean in (T.clean_standard, T.clean_comprehensive, T.normalize_whitespace):
        once = one(spark, clean(lit("<p>A  b\n\n\n\nc</p> x")))
        assert one(spark, clean(lit(once))) == once


def test_vectors(spark):
    a, b = F.array(F.lit(3.0), F.lit(4.0)), F.array(F.lit(0.0), F.lit(0.0))
    assert one(spark, V.norm(a)) == 5 and one(spark, V.cosine(a, b)) == 0 and one(spark, V.l2(a, b)) == 5
    assert one(spark, V.normalized(a)) == [0.6, 0.8] and one(spark, V.normalized(a, "max")) == [0.75, 1.0]
    assert len(one(spark, V.resized(F.array(F.lit(1).cast("float")), 3))) == 3


def test_fusion_of_lists_that_lack_ids(spark):
    a, b = results(spark, [(1, 1, 0.9, 1), (1, 2, 0.5, 2)]), results(spark, [(1, 2, 0.8, 1), (1, 3, 0.7, 2)])
    got = lambda df: [(r.id, r.score) for r in df.orderBy("rank").collect()]
    assert got(fusion.combine(a, b, 3)) == [(2, 0.65), (1, 0.45), (3, 0.35)]
    assert got(fusion.combine(a, b, 3, "min")) == [(2, 0.5), (1, 0.0), (3, 0.0)]
    assert got(fusion.rrf([a, b], 1)) == [(2, round(1 / 62 + 1 / 61, 6))]
    assert got(fusion.rrf([a, b], 3, missing="last"))[1] == (1, round(1 / 61 + 1 / 63, 6))
    assert [i for i, _ in got(fusion.interleave(a, b, 3))] == [1, 2, 3]
    assert got(fusion.rerank(a, results(spark, [(1, 2, 5.0, 1)]), 5)) == [(2, 5.0)]
    assert got(fusion.cascade(a, [(F.col("score"), 1)], 2)) == [(1, 0.9), (2, 0.5)]
    same = results(spark, [(1, 1, 0.5, 1), (1, 2, 0.5, 2)])
    assert {r.score for r in fusion.min_max(same).collect()} == {0.5} and {r.score for r in fusion.softmax(same).collect()} == {0.5}


def test_metrics_conventions(spark):
    found = results(spark, [(1, 1, 1.0, 1), (1, 2, 0.9, 2), (1, 3, 0.8, 3), (2, 9, 1.0, 1)])
    truth = spark.createDataFrame([(1, 2), (1, 3), (1, 7), (2, 8)], "query_id long, id long")
    m = {r.query_id: r for r in metrics.at_k(found, truth, 5).collect()}
    assert (m[1].precision, m[1].recall, m[2].f1, m[2].hit) == (round(2 / 3, 6), round(2 / 3, 6), 0.0, 0)
    assert metrics.average_precision(found, truth).collect()[0].ap == round((1 / 2 + 2 / 3) / 2, 6)
    assert metrics.mean_average_precision(found, truth).first().map == pytest.approx(0.291667, abs=1e-6)
    assert metrics.mean_average_precision(found, truth, False).first().map == pytest.approx(0.583333)
    assert {r.query_id: r.rr for r in metrics.reciprocal_rank(found, truth).collect()} == {1: 0.5, 2: 0.0}
    assert {r.query_id: r.mrr for r in metrics.reciprocal_rank_per_truth(found, truth).collect()}[1] == round((1 / 2 + 1 / 3) / 3, 6)
    graded = spark.createDataFrame([(1, 2, 3.0), (1, 1, 1.0)], "query_id long, id long, gain double")
    assert 0 < metrics.ndcg(found, graded, 3).first().ndcg < 1
    rows = spark.createDataFrame([("what is a cat", "a cat is", "a cat is an animal")], "q string, a string, c string")
    g = metrics.generation(rows, "q", "a", "c").first()
    assert (g.faithfulness, g.hallucination, g.conciseness, g.relevance) == (1.0, 0.0, 0.5, 0.75)


def test_percentiles_differ(spark):
    rows = spark.createDataFrame([(float(v),) for v in range(1, 11)], "v double")
    s = telemetry.latency_stats(rows, "v").first()
    assert (s.p90, s.median, s["count"]) == (10.0, 5.5, 10) and telemetry.latency_stats(rows.limit(1), "v").first().stddev == 0
    assert metrics.satisfaction(rows, "v").first().median == 6.0
    assert telemetry.latency_stats(rows.where("false"), "v").first().min is None


def test_retention_by_hand(spark):
    days = [(1, "2024-01-01"), (2, "2024-01-01"), (1, "2024-01-08"), (1, "2024-01-15"), (2, "2024-01-16"), (3, "2024-01-08")]
    events = spark.createDataFrame(days, "user_id long, d string").select("user_id", F.to_timestamp("d").alias("ts"))
    got = {str(r.cohort): (r.base, r.retained) for r in telemetry.retention(events, "user_id", "ts", 7).collect()}
    assert got == {"2024-01-01": (2, 1), "2024-01-08": (2, 1), "2024-01-15": (1, 0)}


def test_predicates(spark):
    rows = spark.createDataFrame([(1, 4.0, "Alpha", datetime(2024, 1, 31, 12)), (2, 5.5, "beta", datetime(2024, 2, 29)), (3, None, None, None)], "i long, n double, s string, t timestamp")
    ids = lambda p: [r.i for r in rows.where(p.column()).orderBy("i").collect()]
    assert ids(Pred()) == [1, 2, 3] and ids(where("n", "is_integer")) == [1] and ids(where("n", "not_equals", 4.0)) == [2]
    assert ids(~where("n", "equals", 4.0)) == [2, 3] and ids(where("s", "contains", "ALPH", case_sensitive=False)) == [1]
    assert ids(where("t", "this_month", now=datetime(2024, 2, 1))) == [2] and ids(where("t", "on_date", date(2024, 1, 31))) == [1]
    assert ids(where("t", "in_last", n=1, unit="months", now=datetime(2024, 3, 31))) == [2]
    assert ids(where("t", "in_next", n=1, unit="days", now=datetime(2024, 1, 31))) == [1]
    assert ids(where("n", "near", 5.0, tolerance=0.5) | where("s", "not_exists")) == [2, 3] and ids(where("n", "divisible_by", 2) & where("n", "is_positive")) == [1]
    p = (where("n", "between", low=1, high=5) & ~where("t", "before", datetime(2024, 1, 1))) | where("s", "in", ["beta"])
    assert ids(Pred.from_dict(json.loads(p.json()))) == ids(p) == [1, 2]


def test_schema(spark):
    fields = [schema.Field("a", "integer", True, 0, 9), schema.Field("b", "string", values=("x", "y"))]
    rows = spark.createDataFrame([({"a": "5", "b": "x"},), ({"a": "50"},), ({"b": "z"},), ({"a": "1.5"},)], "m map<string,string>")
    got = [r.v for r in rows.select(schema.violations(lambda n: F.col("m")[n], fields).alias("v")).collect()]
    assert got == [[], ["a: out of range"], ["a: missing", "b: not allowed"], ["a: not integer"]]
    assert schema.compatible(fields, [*fields, schema.Field("c", required=True)]) == ["c: required but unknown"]
    assert schema.struct_of(fields).simpleString() == "struct<a:bigint,b:string>"


def test_chunkers(spark):
    rng = random.Random(1)
    text = "\n\n".join(" ".join("w" * rng.randint(1, 9) + rng.choice([".", ""]) for _ in range(40)) for _ in range(5))
    chunks = chunking.split_recursive(text, 120)
    assert "".join(chunks) == text and max(map(len, chunks)) <= 120
    assert all(b.startswith(a[-20:]) or len(b) <= 120 for a, b in zip(chunking.split_recursive(text, 120, 20), chunking.split_recursive(text, 120, 20)[1:]))
    assert chunking.split_recursive("", 10) == [] and all(len(c) <= 400 for c in chunking.split_adaptive(text, 200, most=400) if " " in c[:400])
    assert len(chunking.split_code("import os\nx = 1\ndef f():\n    pass\nclass A:\n    def g(self):\n        pass\n")) == 3
    assert chunking.split_code("def broken(:\n x")
    docs = spark.createDataFrame([(1, "a b c d e"), (2, ""), (3, None)], "id long, t string")
    got = [(r.id, r.chunk_index, r.chunk_count, r.content) for r in chunking.numbered(docs, chunking.token_windows(F.col("t"), 3, 1), ["id"]).orderBy("id", "chunk_index").collect()]
    assert got == [(1, 0, 3, "a b c"), (1, 1, 3, "c d e"), (1, 2, 3, "e")]
    parts = spark.createDataFrame([(1, "p\n# A\nx\n# B\ny\n# A\nz")], "id long, t string")
    assert {r.section: r.content for r in chunking.sections(parts, "id", "t", "^# ").collect()} == {"preamble": "p", "# A": "# A\nz", "# B": "# B\ny"}


def test_sources(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes("caf\u00e9".encode("latin-1"))
    (tmp_path / "b.md").write_text("---\ntitle: T\n---\n# H\nbody")
    (tmp_path / "c.html").write_text("<title>X</title><p>y</p>")
    (tmp_path / "d.json").write_text('[{"text": "one"}, {"text": "two"}]')
    (tmp_path / ".hidden.txt").write_text("no")
    (tmp_path / "m.py").write_text("x = 1")
    p = str(tmp_path)
    assert readers.text_files(spark, p, "a.txt", "ISO-8859-1").first().content == "caf\u00e9"
    md = readers.markdown_files(spark, p).first()
    assert md.content == "# H\nbody" and md.metadata["title"] == "T"
    assert readers.html_files(spark, p).first().metadata["title"] == "X"
    assert readers.json_documents(spark, f"{p}/d.json", "text", "concatenate").first().content == "one\n\ntwo"
    assert readers.json_documents(spark, f"{p}/d.json", "text").count() == 2
    assert readers.text_files(spark, p, "a.txt").first().content == "caf\u00e9"
    for name, data in (("u8.txt", "caf\u00e9".encode()), ("bom.txt", b"\xef\xbb\xbf" + "caf\u00e9".encode()), ("u16.txt", "caf\u00e9".encode("utf-16"))):
        (tmp_path / name).write_bytes(data)
        assert readers.text_files(spark, p, name).first().content == "caf\u00e9", name
    assert readers.text_files(spark, p, "a.txt", "UTF-8").first().content == "caf\ufffd"
    assert readers.directory(spark, p, limit=2).count() == 2 and readers.code_files(spark, p).where("language = 'python'").count() == 1
    assert readers.pdf_files(spark, p, lambda b: []).count() == 0
    (tmp_path / "e.json").write_text('[{"text": "one", "k": 1}, [{"text": "two", "k": "x"}, ["three", 4]], {"other": 5}]')
    e = lambda *a: [(r.content, r.metadata) for r in readers.json_documents(spark, f"{p}/e.json", "text", *a, metadata_keys=["k"]).orderBy("n").collect()]
    assert e("flatten") == [("one", {"k": "1"}), ("two", {"k": "x"}), ("three", {}), ("4", {}), ("", {})]
    assert len(e("separate")) == 3 and e("concatenate")[0][1] == {"k": "[1]"}
    (tmp_path / "page.html").write_text('<title>X</title><meta name="Author" content="A B"><meta content="d" name="description"><p>y</p>')
    page = readers.html_files(spark, p, "page.html").first()
    assert (page.metadata["title"], page.metadata["author"], page.metadata["description"], page.content) == ("X", "A B", "d", "X\ny")
    docs = readers.text_files(spark, p, "a.txt")
    for kind in ("json", "csv", "text"):
        readers.write_documents(docs, f"{p}/out-{kind}", kind)


def test_csv_has_a_column_for_every_key(spark, tmp_path):
    rows = spark.range(1200).select(F.concat(F.lit("p"), "id").alias("path"), F.lit("t").alias("content"), F.create_map(F.concat(F.lit("k"), F.lpad(F.col("id").cast("string"), 4, "0")), F.lit("v")).alias("metadata"))
    readers.write_documents(rows.coalesce(1), f"{tmp_path}/out", "csv")
    with open(next((tmp_path / "out").glob("*.csv"))) as f:
        assert len(f.readline().split(",")) == 1202


def test_more_sources(spark, tmp_path):
    import zipfile

    import numpy as np

    p = str(tmp_path)
    (tmp_path / "bench").mkdir()
    (tmp_path / "bench" / "b.json").write_text('[{"query": "q1", "answer": "a", "ground_truth": ["x", "y"]}, {"query": "q2", "ground_truth": "z"}, {"other": 1}]')
    got = {r.query: (r.answer, r.truth) for r in readers.benchmark_json(spark, f"{p}/bench").collect()}
    assert got == {"q1": ("a", ["x", "y"]), "q2": (None, ["z"])}
    (tmp_path / "emb").mkdir()
    (tmp_path / "emb" / "a.json").write_text('{"i": [1, 2.5]}')
    np.savez(tmp_path / "emb" / "b.npz", m=np.array([[1.0, 2.0], [3.0, 4.0]]))
    np.savez(tmp_path / "emb" / "c.npz", x=np.array([5.0]), y=np.array([6.0]))
    assert sorted((r.id, r.embedding) for r in readers.embedding_files(spark, f"{p}/emb").collect()) == [("0", [1.0, 2.0]), ("1", [3.0, 4.0]), ("i", [1.0, 2.5]), ("x", [5.0]), ("y", [6.0])]
    with zipfile.ZipFile(tmp_path / "d.docx", "w") as z:
        z.writestr("word/document.xml", '<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:p><w:r><w:t>One </w:t><w:t>two</w:t></w:r></w:p><w:p/><w:p><w:t>three</w:t></w:p></w:document>')
    (tmp_path / "e.docx").write_bytes(b"no archive")
    assert sorted((r.path[-6:], r.content) for r in readers.docx_files(spark, p).collect()) == [("d.docx", "One two\n\nthree"), ("e.docx", None)]
    (tmp_path / "x.pdf").write_bytes(b"a|b")
    parse = lambda b: b.decode().split("|")
    assert [(r.page, r.content) for r in readers.pdf_files(spark, p, parse).orderBy("page").collect()] == [(0, "a"), (1, "b")]
    assert [(r.page, r.content) for r in readers.pdf_files(spark, p, parse, whole=True).collect()] == [(0, "a\n\nb")]
    (tmp_path / "r.csv").write_text("evaluator,relevance-1,relevance-2\na,5,4\nb,3,\n")
    found = {(r.criterion, r["query"]): (r.n, r["mean"]) for r in metrics.human_evaluation(readers.evaluation_results(spark, f"{p}/r.csv"), "evaluator").collect()}
    assert found == {("relevance", 1): (2, 4.0), ("relevance", 2): (1, 4.0)}


def test_logs_and_metrics(spark, tmp_path):
    schema = "id string, timestamp timestamp, level int, message string"
    log = spark.createDataFrame([("a", datetime(2024, 1, 1), 20, "x"), ("b", datetime(2024, 1, 2), 40, "y"), ("c", datetime(2024, 1, 2), 50, "z"), ("d", datetime(2024, 1, 3), None, "w")], schema)
    ids = lambda **k: [r.id for r in telemetry.errors_between(log, **k).collect()]
    assert ids() == ["d", "b", "c", "a"] and ids(level=40) == ["b", "c"] and ids(start=datetime(2024, 1, 2), end=datetime(2024, 1, 2)) == ["b", "c"] and ids(limit=1) == ["d"]
    for _ in range(2):
        readers.append_errors(log, f"{tmp_path}/log")
    assert readers.error_log(spark, f"{tmp_path}/log").count() == 8
    rows = spark.createDataFrame([("m", 1.5, {"k": "v,\"w"})], "name string, value double, tags map<string,string>")
    readers.save_metrics(rows, f"{tmp_path}/m-json")
    readers.save_metrics(rows, f"{tmp_path}/m-csv", "csv")
    assert readers.load_metrics(spark, f"{tmp_path}/m-json", rows.schema.simpleString()[7:-1].replace("name:", "name ").replace("value:", "value ").replace("tags:", "tags ")).collect() == rows.collect()
    assert json.loads(readers.load_metrics(spark, f"{tmp_path}/m-csv", "name string, value double, tags string", "csv").first().tags) == {"k": 'v,"w'}


def test_order_statistics(spark):
    from tessera.operators import statistics

    rng = random.Random(3)
    values = [(g, v) for g, n in (("a", 500), (None, 7), ("b", 1)) for v in [rng.choice([0.0, -1.5, rng.lognormvariate(0, 3), -rng.random()]) for _ in range(n)]] + [("c", None), ("a", None), ("n", float("nan")), ("n", 1.0), ("n", float("inf"))]
    rows = spark.createDataFrame(values, "g string, v double").repartition(5)
    got = {r.g: r for r in statistics.at_ranks(rows, "v", ["g"], {"p90": statistics.index_rank(0.9), "least": lambda n: F.lit(0), "most": lambda n: n - 1, "none": lambda n: n, **statistics.MIDDLE}).collect()}
    for g in ("a", None, "b"):
        own = sorted(v for x, v in values if x == g and v is not None)
        r = got[g]
        assert (r.p90, r.least, r.most, r.none, r._low, r._high) == (own[int(len(own) * 0.9)], own[0], own[-1], None, own[(len(own) - 1) // 2], own[len(own) // 2])
    assert set(got) == {"a", None, "b", "n"} and got["n"].least == 1.0 and got["n"].most != got["n"].most
    ints = spark.createDataFrame([(i % 3,) for i in range(9)], "v int")
    assert statistics.at_ranks(ints, "v", [], {"m": lambda n: F.floor(n / 2)}).first().m == 1
    assert statistics.at_ranks(ints.where("false"), "v", [], statistics.MIDDLE).count() == 0
    usage = spark.createDataFrame([("f", '{"a": 1, "b": [1], "c": {"d": 2}}', '{"status": "ok"}'), ("f", '{"a": 1}', "[]"), ("f", "broken", None)], "f string, p string, r string")
    assert sorted(map(tuple, statistics.parameter_usage(usage, "f", "p").collect())) == [("f", "a", "1", 2), ("f", "b", "list", 1), ("f", "c", "dict", 1)]
    assert sorted(map(tuple, statistics.result_status(usage, "f", "r").collect())) == [("f", "ok", 1), ("f", "unknown", 2)]


def test_rate_over_slices(spark):
    rng = random.Random(4)
    rows = [(rng.choice("ab"), datetime.fromtimestamp(1_700_000_000 + rng.randint(0, 20000))) for _ in range(800)] + [("a", None)]
    got = telemetry.rate(spark.createDataFrame(rows, "k string, ts timestamp"), "ts", "k", 600, 900).collect()
    assert len(got) == len(rows)
    for r in got:
        n = sum(k == r.k and t is not None and r.ts is not None and 0 <= (r.ts - t).total_seconds() <= 600 for k, t in rows)
        assert r.rate == (None if r.ts is None else round(n / 600, 6))


def test_query_sets_in_blocks(spark):
    rng = random.Random(5)
    vectors = spark.createDataFrame([(i, [rng.gauss(0, 1) for _ in range(4)]) for i in range(120)], "vec_id long, embedding array<double>")
    q = vectors.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    for metric in ("cosine", "euclidean", "dot"):
        whole = retrieval.top_k(retrieval.vector_scores(q, vectors, metric), 5)
        assert sorted(map(tuple, retrieval.top_k(retrieval.vector_scores(q, vectors, metric, most=20), 5).collect())) == sorted(map(tuple, whole.collect()))
    assert retrieval.vector_scores(q, vectors, most=7).count() == 120 * 120
    assert embeddings.similar(vectors, vectors, 0.9, top=1).groupBy("a").count().where("count > 1").isEmpty()
    reduced, sizes = embeddings.svd(vectors, 2)
    assert len(sizes) == 2 and sizes[0] >= sizes[1] and len(reduced.first().reduced) == 2


def test_filter_compilers(spark):
    from tessera.plans import predicates

    rows = spark.createDataFrame([(1, "x", ["p", "q"], '{"n": 1, "s": "1"}'), (2, 'y"', ["p"], '{"n": 2}'), (3, None, None, None)], "i long, s string, a array<string>, m string")
    ids = lambda d: [r.i for r in rows.where(predicates.from_filter(d).column()).orderBy("i").collect()]
    leaf = lambda f, o, v: {"field": f, "operator": o, "value": v}
    assert ids({}) == [1, 2, 3] and ids(leaf("i", ">=", 2)) == [2, 3] and ids(leaf("i", "unknown", 2)) == [2] and ids(leaf("i", "in", [1, 3])) == [1, 3]
    both = {"AND": [leaf("s", "neq", "x"), {"or": [leaf("i", "==", 2), leaf("a", "contains", ["p", "q"])]}]}
    assert ids(both) == [2] and ids(leaf("a", "contains", ["p", "q"])) == [1]
    assert predicates.expression_of(both) == '(s != "x") && ((i == 2) || (a == ["p", "q"]))'.replace('(a == ["p", "q"])', "").replace(" || )", ")")
    assert predicates.expression_of(leaf("s", "eq", 'y"')) == 's == "y\\""' and predicates.expression_of(leaf("i", "not in", [1, 2])) == "i not in [1, 2]" and predicates.expression_of({}) == ""
    assert predicates.tree_of(both)["operands"][0] == {"path": ["s"], "operator": "NotEqual", "valueString": "x"}
    assert predicates.tree_of(leaf("b", "=", True)) == {"path": ["b"], "operator": "Equal", "valueBoolean": True}
    assert [r.i for r in rows.where(predicates.json_equals(F.col("m"), {"n": 1, "s": "1"})).collect()] == [1] and rows.where(predicates.json_equals(F.col("m"), {"n": "1"})).isEmpty()


def test_stores_and_schemas(spark, tmp_path):
    from tessera.sources.collections import Store

    store = Store(spark, str(tmp_path / "s"))
    c = store.create("a", 2, buckets=4)
    store.create("b", 2, namespace="other")
    assert store.list() == ["a"] and store.exists("a") and not store.exists("b") and store.exists("b", "other") and store.list("none") == []
    with pytest.raises(ValueError):
        store.create("a", 2)
    rows = spark.range(40).select(F.col("id").cast("string").alias("id"), F.array(F.lit(1.0), F.col("id").cast("double")).cast("array<float>").alias("embedding"), F.create_map(F.lit("k"), F.lit("v")).alias("metadata"), F.lit("d").alias("document"), F.current_timestamp().alias("updated_at"))
    c.upsert(rows)
    before = c._parts()
    c.upsert(rows.where("id = '7'").withColumn("document", F.lit("new")))
    after = store.open("a")._parts()
    assert sum(before[b] != after[b] for b in before) == 1 and c.count() == 40 and c.get(["7"]).first().document == "new"
    assert c.info()["count"] == 40 and c.info()["dimension"] == 2
    assert c.delete(F.lit(True)).count() == 0 and c.delete(F.lit(True)).count() == 0
    assert store.drop("a") and not store.exists("a") and not store.drop("a")
    fields = [schema.Field("a", "integer", True, 0, 9), schema.Field("o", "object", fields=(schema.Field("x", values=("u", "v")),))]
    schema.export(spark, {"one": fields, "two": []}, f"{tmp_path}/schemas")
    assert schema.imported(spark, f"{tmp_path}/schemas") == {"one": fields, "two": []}


def test_kinds_of_texts(spark):
    from tessera.operators import domains

    legal = {
        "Chapter 1. Section 2 says what a person shall do.": "statute", "Smith v. Jones, 410 U.S. 113 (1973): the plaintiff appealed": "case_law",
        "This agreement between A and B, the parties, provides for payment.": "contract", "Nothing of the kind": "legal_document", "The act of a factual article": "legal_document",
    }
    for text, kind in legal.items():
        assert one(spark, domains.kind_of_legal(F.lit(text))) == kind, text
    medical = {"Abstract. Methods. Results, p < 0.05": "paper", "abstracts introductions discussions": "other", "Chief complaint: cough": "note", "et al cite references": "paper"}
    for text, kind in medical.items():
        assert one(spark, domains.kind_of_medical(F.lit(text))) == kind, text
    assert domains.statute_parts("Section 1\n\naaa\n\nbbb\nSection 2\nshort\nSection 3\n" + "c" * 30, r"Section \d", 12, 16) == ["Section 1\n\naaa", "bbb", "Section 2\nshort", "Section 3\n" + "c" * 30]
    assert domains.medical_paragraphs("one\n\naaaa\nbbbb\ncc\n \n", 6) == ["one", "aaaa", "bbbb\ncc"]


def test_texts_of_measures(spark):
    low = "It is unclear, and perhaps not certain, what might be."
    u = one(spark, T.uncertainty(F.lit(low)))
    assert (u.doubt, u.severity) == (round((2 * 0.8 + 0.7 * 2 + 0.8) / 4, 6), "high") or u.severity in ("medium", "high")
    assert one(spark, T.uncertainty(F.lit(None).cast("string"))).severity == "none"
    assert one(spark, T.query_kind(F.lit("Compare a and b"))) == "comparative" and one(spark, T.query_kind(F.lit("What is it?"))) == "factual"
    flags = one(spark, T.query_flags(F.lit("I don't know the difference")))
    assert (flags.has_negation, flags.has_comparison) == (True, True)
    assert one(spark, T.tfidf_cosine(F.lit("a cat"), F.lit("A CAT"))) == pytest.approx(1) and one(spark, T.tfidf_cosine(F.lit("x"), F.lit(None).cast("string"))) == 0
    assert one(spark, T.dedup_parts(F.lit("A\nb\na\n"))) == "A\nb" and one(spark, T.dedup_parts(F.lit("A\nb\na"), keep_first=False)) == "b\na" and one(spark, T.dedup_parts(F.lit("A\nb\na"), case_sensitive=True)) == "A\nb\na"
    assert one(spark, T.dedup_parts(F.lit("One. Two! one. "), "sentence")) == "One. Two!" + " " or one(spark, T.dedup_parts(F.lit("One. Two! one."), "sentence")) == "One. Two!"
    assert one(spark, T.dedup_parts(F.lit(None).cast("string"), "paragraph")) == ""
    assert one(spark, T.normalize_unicode(F.lit("\ufb01n\u0007e cafe\u0301"))) == "fine caf\u00e9" and one(spark, T.normalize_unicode(F.lit("a\u00e9\u00e8b"), ascii_by="?")) == "a?b"


def test_contextual_scores(spark):
    docs = spark.createDataFrame([(1, "aa b"), (2, "b"), (3, ""), (4, None)], "doc_id long, text string")
    embed = lambda c: F.array(F.regexp_count(c, F.lit("a")).cast("double"), F.regexp_count(c, F.lit("b")).cast("double"))
    found = spark.createDataFrame([(1, i, 0.5, i) for i in (1, 2, 3, 4)], "query_id long, id long, score double, rank int")
    q = spark.createDataFrame([(1, "a")], "query_id long, query string")
    assert [(r.id, r.score) for r in retrieval.rescored(found, q, docs, embed).orderBy("rank").collect()] == [(1, 0.894427), (2, 0.0)]
    cache = spark.createDataFrame([("k", [1.0, 0.0], datetime(2024, 1, 1), 3), ("m", [0.0, 1.0], datetime(2024, 1, 1), 9)], "key string, embedding array<double>, created_at timestamp, access_count long")
    v = spark.createDataFrame([(1, "m", [1.0, 0.0]), (2, "none", [1.0, 0.0]), (3, "x", [-1.0, 0.0])], "query_id long, key string, vector array<double>")
    assert {r.query_id: r.key for r in corpus.semantic_cache(v, cache, F.lit(datetime(2024, 1, 1))).collect()} == {1: "m", 2: "k"}


def test_collections(spark, tmp_path):
    rows = lambda *x: spark.createDataFrame([(i, v, {"k": i}, i, datetime(2024, 1, n)) for i, v, n in x], "id string, embedding array<float>, metadata map<string,string>, document string, updated_at timestamp")
    c = Collection(spark, str(tmp_path / "c"), 2).create()
    c.upsert(rows(("a", [1.0, 0.0], 1), ("b", [0.0, 1.0], 1))).upsert(rows(("a", [0.0, 1.0], 2), ("a", [1.0, 1.0], 3)))
    assert c.count() == 2 and c.get(["a"]).first().embedding == [1.0, 1.0]
    q = spark.createDataFrame([(1, [1.0, 0.0])], "query_id long, vector array<double>")
    assert [r.id for r in c.search(q, 1).collect()] == ["a"] and [r.id for r in c.search(q, 1, F.col("metadata")["k"] == "b").collect()] == ["b"]
    with pytest.raises(ValueError):
        c.upsert(rows(("x", [1.0], 1)))
    assert migrate(rows(("a", [1.0, 0.0], 1), ("z", [1.0, 0.0], 1)), c.rows()).count() == 1
    assert c.delete(F.col("id") == "a").count() == 1


def test_streams(spark, tmp_path):
    rows = [(datetime(2024, 1, 1, 0, n // 60, n % 60), n % 3, n) for n in range(0, 600, 7)]
    events = spark.createDataFrame(rows, "ts timestamp, kind long, id long")
    events.coalesce(1).write.parquet(str(tmp_path / "in"))
    batch = {(r.start, r.kind): r.n for r in windows.throughput(events, "ts", "kind").collect()}
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    q = windows.throughput(stream, "ts", "kind").writeStream.outputMode("complete").format("memory").queryName("tp").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert {(r.start, r.kind): r.n for r in spark.table("tp").collect()} == batch
    assert windows.cool_down([0, 1, 5, 9, 10], 5) == [True, False, True, False, True]
    fired = {(r.kind, r.id) for r in windows.alerts(events, "ts", "kind", "id", 60).collect()}
    q = windows.alerts_stream(stream, "ts", "kind", "id", 60).writeStream.outputMode("append").format("memory").queryName("al").option("checkpointLocation", str(tmp_path / "cp2")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert {(r.kind, r.id) for r in spark.table("al").collect()} == fired
    assert windows.gap_sessions(events, "ts", "kind", "10 minutes").count() == 3 and windows.throughput(events, "ts", "kind", "60 seconds", "30 seconds").count() > len(batch)


def test_corpus(spark):
    docs = spark.createDataFrame([(1, "a b c d e f"), (2, "a b c d e f"), (3, None)], "id long, t string")
    assert {r.id: r.first for r in corpus.exact_duplicates(docs, "id", "t").collect()} == {1: 1, 2: 1, 3: 3}
    assert corpus.union_by_content([docs, docs], "t", "id").count() == 2
    for kind in corpus.AUGMENTATIONS:
        got = corpus.augment(docs, kind, 0.3, 2, "id", "t", ["new"], {"a": ["x"]}, seed=1)
        rows = sorted(map(tuple, got.collect()))
        assert len(rows) == 4 and rows == sorted(map(tuple, got.collect()))
        if kind == "swap":
            assert all(sorted(r[2].split()) == list("abcdef") for r in rows)
        if kind == "delete":
            assert all(3 <= len(r[2].split()) < 6 for r in rows)
    q = spark.createDataFrame([(1, "big cat and small dog")], "query_id long, query string")
    assert [r.query for r in corpus.expand(q, {"cat": ["feline"]}).orderBy("variant").collect()] == ["big cat and small dog", "big feline and small dog"]
    assert [r.query for r in corpus.decompose(q).orderBy("part").collect()] == ["big cat", "small dog"]
    s = spark.createDataFrame([(1, 1, "It is red"), (1, 2, "It is not red"), (1, 3, "It is blue")], "g long, i long, t string")
    assert [tuple(r) for r in corpus.contradictions(s, "g", "i", "t").collect()] == [(1, 2, 1)]
    st, so = spark.createDataFrame([(1, 1, "a b")], "g long, statement_id long, statement string"), spark.createDataFrame([(1, 5, "a"), (1, 6, "b a")], "g long, source_id long, source string")
    assert tuple(corpus.support(st, so, "g").first()) == (1, 6, 1.0)
    f = spark.createDataFrame([(1, 0.2, 0.0), (1, 0.6, 1.0), (2, 0.4, 0.0)], "id long, score double, confidence double")
    assert {r.id: r.score for r in corpus.detectors_combined(f).collect()} == {1: 0.6, 2: 0.4}
    assert one(spark, corpus.cite("apa", F.lit("A"), F.lit(2020), F.lit("T"), F.lit("S"))) == "A (2020). T. S."
    known = spark.createDataFrame([("410 U.S. 113", 2)], "name string, doc long")
    cites = spark.createDataFrame([(1, "see 410 U.S. 113"), (2, "410 U.S. 113")], "id long, t string")
    assert [tuple(r) for r in corpus.citation_edges(cites, "id", "t", known).collect()] == [(1, 2)]
    cache = spark.createDataFrame([("k", [1.0, 0.0], datetime(2024, 1, 1), 3), ("m", [0.0, 1.0], datetime(2024, 1, 1), 9)], "key string, embedding array<double>, created_at timestamp, access_count long")
    v = spark.createDataFrame([(1, [1.0, 0.0])], "query_id long, vector array<double>")
    assert corpus.semantic_cache(v, cache, F.lit(datetime(2024, 1, 1))).first().key == "k"
    r = spark.createDataFrame([(1, 1, "x", "g"), (1, 2, "y", None)], "query_id long, rank int, c string, g string")
    assert corpus.grouped_context(r, "g", "c").first().context == "## g\nx\n\n## other\ny"
    assert corpus.context(r, "c", source="rank").first().context == "[1] x\n\n[2] y\n\nSources:\n[1] 1\n[2] 2"


def test_retriever_strategies(spark):
    docs = spark.createDataFrame([(1, "red cat"), (2, "blue dog"), (3, "red dog")], "doc_id long, text string")
    vectors = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [0.7, 0.7])], "doc_id long, embedding array<double>")
    q = spark.createDataFrame([(1, "red cat", [1.0, 0.1])], "query_id long, query string, vector array<double>")
    for strategy in retriever.STRATEGIES:
        assert retriever.Retriever(docs, vectors, strategy).retrieve(q, 2).orderBy("rank").first().id == 1, strategy
    assert retriever.Retriever(docs, vectors, threshold=2.0).retrieve(q, 2).count() == 0
    assert sum(retriever.tuned({"a": 0.5, "b": 0.5}, {"a": 1.0}).values()) == pytest.approx(1)
    assert retriever.prepare(docs, size=4, overlap=1).count() == 9
    stats = embeddings.pair_stats(vectors).first()
    assert stats.mean == pytest.approx((0 + 2 * 0.707107) / 3, abs=1e-5)
    assert retrieval.hyde(vectors.withColumn("g", F.lit(1)), "g").count() == 1


def test_collections_grow_and_are_read_while_they_are_written(spark, tmp_path):
    import threading

    c = Collection(spark, str(tmp_path / "c"), 2, buckets=2, most=20).create()
    rows = lambda a, b: spark.createDataFrame([(f"k{i}", [float(i), 1.0], {"n": str(i)}, None) for i in range(a, b)], "id string, embedding array<float>, metadata map<string,string>, document string").withColumn("updated_at", F.current_timestamp())
    seen, failed, stop = [], [], threading.Event()

    def read():
        other = Collection(spark, str(tmp_path / "c"), 2)
        while not stop.is_set():
            try:
                seen.append(other.count())
            except Exception as e:  # noqa: BLE001
                failed.append(e)

    reader = threading.Thread(target=read)
    reader.start()
    try:
        for k in range(4):
            c.upsert(rows(30 * k, 30 * k + 30))
    finally:
        stop.set()
        reader.join()
    assert not failed and set(seen) <= {0, 30, 60, 90, 120} and seen == sorted(seen)
    assert c.info()["count"] == 120 and c.info()["buckets"] > 2
    assert sum(n for _, n in c._parts().values()) == 120
    again = Collection(spark, str(tmp_path / "c"), 2)
    again.upsert(rows(0, 10)).delete(F.col("metadata")["n"].cast("int") >= 100)
    assert sorted(r.id for r in c.rows().collect()) == sorted(f"k{i}" for i in range(100))
    stale, other = Collection(spark, str(tmp_path / "c"), 2), Collection(spark, str(tmp_path / "c"), 2)
    parts = stale._parts()
    other.delete(F.col("id") == "k1")
    with pytest.raises(RuntimeError, match="first"):
        stale._point([(b, f, n) for b, (f, n) in parts.items()])
    assert c.count() == 99
