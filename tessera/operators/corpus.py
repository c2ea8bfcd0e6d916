"""Duplicates and variants of texts, hashes, result sets, context strings, citations."""

from __future__ import annotations

import re
from collections.abc import Callable, Mapping, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.text import tokens
from tessera.session import ship


def exact_duplicates(docs: DataFrame, id_col: str, text: str) -> DataFrame:
    """(id_col, first): for each text the least id that has it. Only hashes are dealt out; equal hashes are 256 bits long."""
    h = docs.select(id_col, F.sha2(F.coalesce(text, F.lit("")), 256).alias("h"))
    first = h.groupBy("h").agg(F.min(id_col).alias("first"))
    return h.join(first, "h").select(id_col, "first")


def union_by_content(parts: Sequence[DataFrame], content: str, id_col: str) -> DataFrame:
    """Rows of all parts, of equal contents the one with the least id."""
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    return rows.groupBy(F.sha2(content, 256).alias("h")).agg(F.min_by(F.struct(*rows.columns), id_col).alias("r")).select("r.*")


def context(results: DataFrame, content: str, limit: int = 200, separator: str = "\n\n", source: str | None = None) -> DataFrame:
    """(query_id, context): each query's results in order of rank, numbered, cut to limit characters; with source, a list of sources at the end."""
    fields = ["rank", F.substring(content, 1, limit).alias("c"), *([F.col(source).alias("s")] if source else [])]
    rows = results.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("r"))
    body = F.array_join(F.transform("r", lambda x, i: F.concat(F.lit("["), (i + 1).cast("string"), F.lit("] "), x["c"])), separator)
    if source:
        refs = F.array_join(F.transform("r", lambda x, i: F.concat(F.lit("["), (i + 1).cast("string"), F.lit("] "), x["s"].cast("string"))), "\n")
        body = F.concat(body, F.lit(separator + "Sources:\n"), refs)
    return rows.select("query_id", body.alias("context"))


def grouped_context(results: DataFrame, group: str, content: str, header: str = "## ") -> DataFrame:
    """(query_id, context): results under a header for each group, groups by name, results by rank."""
    per = results.groupBy("query_id", F.coalesce(group, F.lit("other")).alias("g")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", F.col(content).alias("c")))), lambda x: x["c"]), "\n").alias("t"))
    blocks = per.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("g", "t"))).alias("b"))
    return blocks.select("query_id", F.array_join(F.transform("b", lambda x: F.concat(F.lit(header), x["g"], F.lit("\n"), x["t"])), "\n\n").alias("context"))


def two_level_context(results: DataFrame, first: str, second: str, content: str, header: str = "## ", inner: str = "### ", default: str = "other") -> DataFrame:
    """(query_id, context): results under headers of two fields, names in order, results by rank; a missing field counts as default."""
    named = results.select("query_id", F.coalesce(first, F.lit(default)).alias("a"), F.coalesce(second, F.lit(default)).alias("b"), "rank", F.col(content).alias("c"))
    low = named.groupBy("query_id", "a", "b").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "c"))), lambda x: x["c"]), "\n").alias("t"))
    mid = low.groupBy("query_id", "a").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("b", "t"))), lambda x: F.concat(F.lit(inner), x["b"], F.lit("\n"), x["t"])), "\n\n").alias("t"))
    top = mid.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("a", "t"))).alias("x"))
    return top.select("query_id", F.array_join(F.transform("x", lambda x: F.concat(F.lit(header), x["a"], F.lit("\n"), x["t"])), "\n\n").alias("context"))


def attributed_context(results: DataFrame, content: str, source: str, place: str = "prefix", separator: str = "\n\n") -> DataFrame:
    """(query_id, context): results in order of rank, marked [n] before, behind or on both sides of each, and a list of sources; a result without a source keeps its number but is not listed."""
    rows = results.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", F.col(content).alias("c"), F.col(source).cast("string").alias("s")))).alias("r"))

    def marked(x: Column, i: Column) -> Column:
        mark = F.concat(F.lit("["), (i + 1).cast("string"), F.lit("]"))
        return F.concat_ws(" ", *([mark] if place in ("prefix", "both") else []), x["c"], *([mark] if place in ("suffix", "both") else []))

    refs = F.array_compact(F.transform("r", lambda x, i: F.when(x["s"].isNotNull(), F.concat(F.lit("["), (i + 1).cast("string"), F.lit("] "), x["s"]))))
    body = F.array_join(F.transform("r", marked), separator)
    return rows.select("query_id", F.when(F.size(refs) == 0, body).otherwise(F.concat(body, F.lit(separator + "Sources:\n"), F.array_join(refs, "\n"))).alias("context"))


def cite(style: str, author: Column, year: Column, title: Column, source: Column, reporter: Column | None = None, page: Column | None = None) -> Column:
    """A reference in apa, mla, chicago or harvard style; bluebook and alwd take a case's volume and reporter, and its page."""
    y = year.cast("string")
    if style in ("bluebook", "alwd"):
        name = title if style == "bluebook" else F.concat(F.lit("*"), title, F.lit("*"))
        return F.concat(name, F.lit(", "), reporter, F.lit(" "), page.cast("string"), F.lit(" ("), source, F.lit(" "), y, F.lit(")."))
    return {
        "apa": F.concat(author, F.lit(" ("), y, F.lit("). "), title, F.lit(". "), source, F.lit(".")),
        "mla": F.concat(author, F.lit('. "'), title, F.lit('." '), source, F.lit(", "), y, F.lit(".")),
        "chicago": F.concat(author, F.lit(". "), title, F.lit(". "), source, F.lit(", "), y, F.lit(".")),
        "harvard": F.concat(author, F.lit(", "), y, F.lit(". "), title, F.lit(", "), source, F.lit(".")),
    }[style]


def cite_by_template(template: str, fields: Mapping[str, Column], required: Sequence[str] = ()) -> Column:
    """A template's {name} places filled with the fields, missing ones with nothing; a row that lacks required ones says which."""
    parts = re.split(r"\{(\w+)\}", template)
    whole = F.concat(*(F.lit(x) if k % 2 == 0 else F.coalesce(fields[x].cast("string"), F.lit("")) if x in fields else F.lit("") for k, x in enumerate(parts)))
    missing = F.array_compact(F.array(*(F.when(fields[x].isNull() if x in fields else F.lit(True), x) for x in required))) if required else F.array().cast("array<string>")
    return F.when(F.size(missing) > 0, F.concat(F.lit("[Incomplete citation - missing: "), F.array_join(missing, ", "), F.lit("]"))).otherwise(whole)


def citation_edges(docs: DataFrame, id_col: str, text: str, known: DataFrame) -> DataFrame:
    """(source, target): documents that a document cites; known(name, doc) gives the document of each citation."""
    from tessera.functions.text import citations

    each = docs.select(F.col(id_col).alias("source"), F.explode(F.array_distinct(citations(F.col(text)))).alias("name"))
    return each.join(known, "name").select("source", F.col("doc").alias("target")).where("source <> target").distinct()


def semantic_cache(queries: DataFrame, cache: DataFrame, now: Column, threshold: float = 0.92, decay: float = 0.01) -> DataFrame:
    """(query_id, key, score): the entry of cache(key, embedding, created_at, access_count) with the query's own key, if queries have one and it is there (score 1), or else the
    best at the threshold of cosine or above. score: .6 similarity + .3 exp(-decay * age in days) + .1 log1p(accesses) / 10.
    """
    from tessera.functions.vectors import cosine
    from tessera.operators.retrieval import in_blocks

    sim = cosine(F.col("vector"), F.col("embedding"))
    age = (F.unix_timestamp(now) - F.unix_timestamp(F.col("created_at").cast("timestamp"))) / 86400
    value = F.round(0.6 * F.col("sim") + 0.3 * F.exp(-decay * age) + 0.1 * F.log1p("access_count") / 10, 6)
    best = F.max(F.struct(value.alias("score"), F.col("key").alias("key")))
    rows = cache.select("key", "embedding", "created_at", "access_count")
    exact = queries.select("query_id", "key").join(cache.select("key"), "key").select("query_id", "key", F.lit(1.0).alias("score")).distinct() if "key" in queries.columns else None
    rest = queries if exact is None else queries.join(exact.select("query_id"), "query_id", "left_anti")
    pairs = in_blocks(rest.select("query_id", "vector"), "query_id", lambda q: rows.join(q).withColumn("sim", sim).where(F.col("sim") >= threshold))
    near = pairs.groupBy("query_id").agg(best.alias("b")).select("query_id", "b.key", "b.score")
    return near if exact is None else exact.unionByName(near)


def expand(queries: DataFrame, thesaurus: Mapping[str, Sequence[str]]) -> DataFrame:
    """(query_id, variant, query): the query and one variant for each synonym of a word it has, in order of word and synonym."""
    pairs = [(w, s) for w in sorted(thesaurus) for s in sorted(thesaurus[w])]
    variants = F.array(F.col("query"), *(F.when(F.array_contains(tokens(F.lower("query")), w), F.regexp_replace("query", rf"(?i)\b{w}\b", s)) for w, s in pairs))
    return queries.select("query_id", F.posexplode(F.array_distinct(F.array_compact(variants))).alias("variant", "query"))


def decompose(queries: DataFrame) -> DataFrame:
    """(query_id, part, query): what stands between conjunctions, question marks and semicolons."""
    parts = F.filter(F.transform(F.split("query", r"(?i)\b(?:and|or|then)\b|[?;]"), lambda x: F.trim(x)), lambda x: x != "")
    return queries.select("query_id", F.posexplode(parts).alias("part", "query"))


def contradictions(statements: DataFrame, by: str, id_col: str, text: str) -> DataFrame:
    """(by, a, b): pairs of statements of one group that differ by a negation alone. Equi-join on the words without it, so other pairs never meet."""
    low = tokens(F.lower(text))
    negations = ["not", "no", "never", "n't"]
    own = statements.select(by, F.col(id_col).alias("i"), F.array_join(F.filter(low, lambda w: ~w.isin(negations)), " ").alias("k"), F.exists(low, lambda w: w.isin(negations)).alias("neg"))
    a, b = own.where("neg").select(by, "k", F.col("i").alias("a")), own.where("NOT neg").select(by, "k", F.col("i").alias("b"))
    return a.join(b, [by, "k"]).select(by, "a", "b")


def support(statements: DataFrame, sources: DataFrame, by: str) -> DataFrame:
    """(statement_id, source_id, score): for each statement the source of its group that holds most of its words."""
    from tessera.functions.text import overlap

    pairs = statements.join(sources, by).withColumn("score", F.round(overlap(F.col("statement"), F.col("source")), 6))
    return pairs.groupBy("statement_id").agg(F.max_by(F.struct("source_id", "score"), F.struct("score", -F.col("source_id"))).alias("b")).select("statement_id", "b.source_id", "b.score")


def detectors_combined(findings: DataFrame) -> DataFrame:
    """(id, score, confidence) from findings(id, score, confidence): mean weighted by confidence, plain if all are 0."""
    w = F.sum("confidence")
    value = F.when(w == 0, F.avg("score")).otherwise(F.sum(F.col("score") * F.col("confidence")) / w)
    return findings.groupBy("id").agg(F.round(value, 6).alias("score"), F.round(F.avg("confidence"), 6).alias("confidence"))


def distinct_findings(findings: DataFrame) -> DataFrame:
    """findings(id, order, start, end, ...): of those of one id and span the first by order stays."""
    place = F.row_number().over(Window.partitionBy("id", "start", "end").orderBy("order"))
    return findings.withColumn("_n", place).where("_n = 1").drop("_n")


def opposed(statements: DataFrame, by: str, id_col: str, text: str, pairs: Sequence[tuple[str, str]]) -> DataFrame:
    """(by, a, b, term, opposite): pairs of statements of one group of which one has a term and the other its opposite, while they share another word of four letters or more."""
    sides = F.array(*(F.struct(F.lit(k).alias("k"), F.lit(x).alias("t"), F.lit(o).alias("side")) for k, p in enumerate(pairs) for o, x in enumerate(p)))
    words = F.array_distinct(tokens(F.lower(F.regexp_replace(text, r"[^\p{L}\p{N} \t\n\r\f\x0B-]", " "))))
    own = statements.select(by, F.col(id_col).alias("i"), words.alias("w"))
    terms = [x for p in pairs for x in p]
    held = own.select(by, "i", F.filter("w", lambda x: (F.length(x) >= 4) & ~x.isin(terms)).alias("c"), F.explode(F.filter(sides, lambda s: F.array_contains("w", s["t"]))).alias("s"))
    each = held.select(by, "i", F.explode("c").alias("word"), "s.*")
    a, b = each.where("side = 0"), each.where("side = 1")
    x = a.select(by, "word", "k", F.col("i").alias("a"), F.col("t").alias("term"))
    return x.join(b.select(by, "word", "k", F.col("i").alias("b"), F.col("t").alias("opposite")), [by, "word", "k"]).where("a <> b").select(by, "a", "b", "term", "opposite").distinct()


def rewritten(queries: DataFrame, rules: Sequence[tuple[str, str]]) -> DataFrame:
    """(query_id, query, rewritten): replacements applied in order, white space closed up; a query that becomes empty stays as it was."""
    from tessera.functions.text import GAP, regex_clean

    new = F.trim(F.regexp_replace(regex_clean(F.col("query"), rules), GAP, " "))
    return queries.select("query_id", "query", F.when(new == "", F.col("query")).otherwise(new).alias("rewritten"))


def varied(queries: DataFrame, variants: Callable[[Column], Column]) -> DataFrame:
    """(query_id, variant, query): the query and what any column function query -> array of queries makes of it (a model behind a pandas UDF, a translation), each once."""
    whole = F.array_distinct(F.concat(F.array("query"), F.coalesce(variants(F.col("query")), F.array().cast("array<string>"))))
    return queries.select("query_id", F.posexplode(whole).alias("variant", "query"))


def augment_by(docs: DataFrame, change: Callable[[Column], Column], id_col: str, text: str, inverse: Callable[[Column], Column] | None = None) -> DataFrame:
    """(id_col, content): texts through a column function, such as a model's contextual replacement, or a translation and, as inverse, the way back; texts that come back the same are left out."""
    new = change(F.col(text))
    new = inverse(new) if inverse else new
    return docs.select(id_col, F.col(text).alias("_old"), new.alias("content")).where("content <> _old").drop("_old")


def augment_chain(docs: DataFrame, kinds: Sequence[str], fraction: float, id_col: str, text: str, **options) -> DataFrame:
    """(id_col, variant, content): one variant by each kind in turn, applied to what the one before made."""
    now = docs.select(id_col, F.col(text).alias("content"))
    for k, kind in enumerate(kinds):
        now = augment(now, kind, fraction, 1, id_col, "content", seed=k, **options)
    return now


AUGMENTATIONS = ("delete", "swap", "insert", "replace")


def augment(docs: DataFrame, kind: str, fraction: float, variants: int, id_col: str, text: str, words: Sequence[str] = (), thesaurus: Mapping[str, Sequence[str]] | None = None, least: int = 3, seed: int = 0) -> DataFrame:
    """(id_col, variant, content): words deleted (least stay), swapped, inserted from words, or replaced by synonyms. A variant depends on seed, id and number alone."""
    import random

    def change(t: str, r: random.Random) -> str:
        w = t.split()
        n = max(1, int(fraction * len(w)))
        if kind == "delete":
            gone = set(r.sample(range(len(w)), min(n, max(0, len(w) - least))))
            w = [x for i, x in enumerate(w) if i not in gone]
        elif kind == "swap":
            for _ in range(n if len(w) > 1 else 0):
                i, j = r.sample(range(len(w)), 2)
                w[i], w[j] = w[j], w[i]
        elif kind == "insert":
            for _ in range(n if words else 0):
                w.insert(r.randint(0, len(w)), r.choice(list(words)))
        else:
            at = [i for i, x in enumerate(w) if x.lower() in (thesaurus or {})]
            for i in r.sample(at, min(len(at), max(1, int(fraction * len(at))))) if at else []:
                w[i] = r.choice(list(thesaurus[w[i].lower()]))
        return " ".join(w)

    def run(batches):
        for b in batches:
            rows = [(i, k, change(t, random.Random(f"{seed}:{i}:{k}"))) for i, t in zip(b[id_col], b[text]) if t is not None for k in range(variants)]
            yield pd.DataFrame(rows, columns=[id_col, "variant", "content"])

    ship(docs.sparkSession)
    kind_of = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text).mapInPandas(run, f"{id_col} {kind_of}, variant int, content string")
