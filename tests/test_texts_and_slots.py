"""Chunkers of code and particular texts, citations, contexts, variants of texts, and functions that callers plug in."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tessera.functions import text
from tessera.functions import vectors as V
from tessera.operators import chunking, corpus, domains
from tessera.plans import retriever
from tessera.streaming import windows


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


JS = """import {a} from 'a';
const b = require('b');
// class Not { }
class One extends Two {
  m(x) { if (x) { return "}"; } }
  get n() { return `{`; }
}
async function f(a, b) { /* } */ return 1; }
const g = async (x) => {
  return {x};
};
export {f};
"""


def test_javascript_chunks():
    head, cls, f, g = chunking.split_javascript(JS)
    assert head == "import {a} from 'a';\nconst b = require('b');\nexport {f};" and cls.startswith("class One") and cls.endswith("`{`; }\n}")
    assert f == "async function f(a, b) { /* } */ return 1; }" and g == "const g = async (x) => {\n  return {x};\n}"
    assert [x.split("(")[0] for x in chunking.split_javascript(JS, 20)[2:4]] == ["m", "get n"]
    assert chunking.split_javascript("let x = 1") == ["let x = 1"] and chunking.split_javascript("") == [] and chunking.split_javascript("class A {")[0] == "class A {"


def test_slots_of_chunkers(spark):
    text = "One two. Three four. Five six."
    assert chunking.split_adaptive(text, 0, 0.5, 100, lambda a, b: float("Three" in b)) == ["One two. Three four.", "Five six."]
    assert chunking.split_tokens("abcdef", list, 4, 1) == ["abcd", "def"] and chunking.split_tokens("a b c", str.split, 2, 0, " ") == ["a b", "c"] and chunking.split_tokens("", list, 4) == []
    with pytest.raises(ValueError):
        chunking.split_tokens("a", list, 2, 2)
    docs = spark.createDataFrame([(1, "p. q\n# A\nx. y\n\nz"), (2, None)], "id long, t string")
    got = [tuple(r) for r in chunking.section_hierarchy(docs, "id", "t", "^# ").orderBy("section", "paragraph", "sentence").collect()]
    assert got == [(1, "# A", 0, 0, "# A x"), (1, "# A", 0, 1, "y"), (1, "# A", 1, 0, "z"), (1, "preamble", 0, 0, "p"), (1, "preamble", 0, 1, "q")]
    legal = "Section 1 " + "a" * 20 + "\nSection 2 " + "b" * 20 + "\nSection 3"
    assert chunking.split_legal(legal, 15) == ["Section 1 " + "a" * 20, "Section 2 " + "b" * 20] and chunking.split_legal("plain") == ["plain"]
    assert chunking.split_medical("Abstract\nabc\n\nMethods\n" + "line\n" * 3, 12) == ["Abstract\nabc", "Methods\nline", "line\nline"]


def test_citations_and_formulas(spark):
    text = "See 410 U.S. 113, 93 S. Ct.  705 and 93 S. Ct. 705; 42 U.S.C. § 1983; 24 CFR § 100.204; 83 Fed. Reg. 12,345; 347 F.2d 394; 765 F. Supp. 2d 1123"
    got = [tuple(r) for r in one(spark, domains.legal_citations(F.lit(text)))]
    assert got == [
        ("us_reports", "410 U.S. 113"), ("supreme_court", "93 S. Ct. 705"), ("federal_reporter", "347 F.2d 394"), ("federal_supplement", "765 F. Supp. 2d 1123"), ("us_code", "42 U.S.C. § 1983"),
        ("federal_regulations", "24 CFR § 100.204"), ("federal_register", "83 Fed. Reg. 12,345"),
    ]
    assert one(spark, domains.formulas(F.lit(r"a $x+1$ b $$y^2$$ c \[z\] d \begin{equation}w\end{equation} $x+1$"))) == ["y^2", "z", "w", "x+1"]
    assert one(spark, domains.formula_text(F.lit(r"x_{ij}^{2n} \ne \neq \eta \notin \Leftrightarrow \zetas"))) == r"x_ij^2n ≠ ≠ η ∉ ⇔ \zetas" and len(domains.SIGNS) == 63
    assert one(spark, domains.formula_text(F.lit(r"\frac{a}{b} \leq \alpha_{1} \inx"))) == r"(a)/(b) ≤ α_1 \inx"
    lit = F.lit
    assert one(spark, corpus.cite("bluebook", lit("A"), lit(1973), lit("Roe v. Wade"), lit("Cir."), lit("410 U.S."), lit(113))) == "Roe v. Wade, 410 U.S. 113 (Cir. 1973)."
    assert one(spark, corpus.cite("alwd", lit("A"), lit(1973), lit("Roe v. Wade"), lit("Cir."), lit("410 U.S."), lit(113))).startswith("*Roe v. Wade*, ")
    assert one(spark, corpus.cite_by_template("{who}: {what}{none}.", {"who": lit("A"), "what": lit(1)})) == "A: 1."
    assert one(spark, corpus.cite_by_template("{who}", {"who": lit(None).cast("string")}, ["who", "when"])) == "[Incomplete citation - missing: who, when]"
    kinds = {"/d/papers/x.txt": "research_papers", "/d/patient_1.txt": "clinical_notes", "/d/handbooks/x": "medical_textbooks", "/d/protocol.md": "guidelines", "/d/x": "other"}
    for path, kind in kinds.items():
        assert one(spark, domains.category_of_file(F.lit(path))) == kind, path


def test_contexts(spark):
    r = spark.createDataFrame([(1, 1, "x", "g", "h", "s1"), (1, 2, "y", None, "h", None), (1, 3, "z", "g", None, "s3")], "query_id long, rank int, c string, a string, b string, s string")
    assert corpus.two_level_context(r, "a", "b", "c").first().context == "## g\n### h\nx\n\n### other\nz\n\n## other\n### h\ny"
    assert corpus.attributed_context(r, "c", "s", "both").first().context == "[1] x [1]\n\n[2] y [2]\n\n[3] z [3]\n\nSources:\n[1] s1\n[3] s3"
    assert corpus.attributed_context(r.where("rank = 2"), "c", "s", "suffix").first().context == "y [1]"
    found = spark.createDataFrame([(1, 2, 0, 5, "b"), (1, 1, 0, 5, "a"), (1, 3, 5, 9, "c")], "id long, `order` int, start int, end int, who string")
    assert sorted(x.who for x in corpus.distinct_findings(found).collect()) == ["a", "c"]
    known = spark.createDataFrame([(1, "s", "text"), (2, "t", "text")], "id long, section string, text string")
    search = lambda chunks: chunks.select(F.lit(1).alias("query_id"), "id", F.lit(1.0).alias("score"), F.lit(1).alias("rank"))
    assert [x.id for x in domains.search_in_section(search, known, "t", 5).collect()] == [2]


def test_variants_of_texts(spark):
    q = spark.createDataFrame([(1, "please find  cats"), (2, "please")], "query_id long, query string")
    assert {r.query_id: r.rewritten for r in corpus.rewritten(q, [("please", ""), ("find", "search")]).collect()} == {1: "search cats", 2: "please"}
    got = corpus.varied(q.where("query_id = 2"), lambda c: F.array(F.upper(c), c, F.concat(c, F.lit("?"))))
    assert [r["query"] for r in got.orderBy("variant").collect()] == ["please", "PLEASE", "please?"]
    docs = spark.createDataFrame([(1, "a b c d e f"), (2, "a")], "id long, t string")
    assert [r.content for r in corpus.augment_by(docs, F.upper, "id", "t", lambda c: F.replace(c, F.lit("B"), F.lit("b"))).orderBy("id").collect()] == ["A b C D E F", "A"]
    assert corpus.augment_by(docs, F.upper, "id", "t", F.lower).count() == 0
    chain = corpus.augment_chain(docs, ["swap", "delete"], 0.3, "id", "t").where("id = 1").first().content.split()
    assert set(chain) <= set("abcdef") and 3 <= len(chain) < 6
    s = spark.createDataFrame([(1, 1, "Sales increased"), (1, 2, "The sales decreased."), (1, 3, "Costs decreased"), (2, 4, "sales decreased")], "g long, i long, t string")
    assert [tuple(r) for r in corpus.opposed(s, "g", "i", "t", [("increased", "decreased")]).collect()] == [(1, 1, 2, "increased", "decreased")]


def test_linear_maps(spark):
    a = F.array(F.lit(1.0), F.lit(2.0))
    assert one(spark, V.standardized(a, [0.0, 2.0], [2.0, 0.0])) == [0.5, 0.0]
    assert one(spark, V.projected(a, [[1.0, 1.0], [0.0, 2.0], [1.0, 0.0]], [0.0, 1.0, 0.0])) == [3.0, 5.0, 1.0]


def test_alert_conditions(spark):
    rows = [(datetime(2024, 1, 1, 0, 0, k), lv, t, m, k) for k, (lv, t, m) in enumerate([(40, "A", "disk full"), (30, "A", "disk full"), (50, "B", "disk full"), (50, "A", "net"), (50, "A", "disk gone")])]
    log = spark.createDataFrame(rows, "ts timestamp, level int, error_type string, message string, id int")
    ids = lambda df: sorted(r.id for r in df.collect())
    assert ids(windows.alerting(log, 40)) == [0, 2, 3, 4] and ids(windows.alerting(log, 40, ["A"], ["^disk", "none"])) == [0, 4]
    fired = windows.alerts(windows.alerting(log, 40).withColumn("all", F.lit(1)), "ts", "all", "id", 3)
    assert ids(fired) == [0, 3]


def test_retriever_with_functions_of_the_caller(spark):
    docs = spark.createDataFrame([(1, "red cat"), (2, "blue dog"), (3, "red dog")], "doc_id long, text string")
    vectors = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [0.7, 0.7])], "doc_id long, embedding array<double>")
    q = spark.createDataFrame([(1, "dog", [1.0, 0.1])], "query_id long, query string, vector array<double>")
    own = lambda queries, k: queries.select("query_id", F.lit(2).cast("long").alias("id"), F.lit(9.0).alias("score"), F.lit(1).alias("rank"))
    assert retriever.Retriever(docs, vectors, "bm25", searches={"bm25": own}).retrieve(q, 3).first().id == 2
    embed = lambda c: F.array(F.regexp_count(c, F.lit("dog")).cast("double"), F.regexp_count(c, F.lit("cat")).cast("double"))
    got = retriever.Retriever(docs, vectors, "contextual", weights=(0.0, 1.0), embed=embed, template="about {query}").retrieve(q, 2)
    assert [r.id for r in got.orderBy("rank").collect()] == [2, 3]


def test_ratings_of_a_model(spark):
    cases = [
        ("direct", " 8\nas said", 0.8), ("direct", "Score: 0.75", 0.75), ("direct", "about 12", 12.0), ("direct", "none", 0.0), ("direct", "1.2.3", 0.0), ("direct", None, 0.0), ("direct", "", 0.0), ("direct", "\n\n7/10", 0.0 + 710),
        ("json", 'well: {"score": 7, "why": "x"} so', 0.7), ("json", '{"relevance": "0.4"}', 0.4), ("json", '{"relevance_score": 11}', 11.0), ("json", '{"other": 1}', 0.0), ("json", "{broken", 0.0), ("json", "no", 0.0),
        ("scale_1_10", "I say 7.", 0.7), ("scale_1_10", "7 of 10", 0.0), ("scale_1_10", "0.5", 0.0), ("scale_1_5", "4", 0.8), ("scale_1_5", "6", 0.0),
    ]
    for method, answer, want in cases:
        assert spark.createDataFrame([(answer,)], "a string").select(text.rated(F.col("a"), method).alias("s")).first().s == pytest.approx(want), (method, answer)
