"""Quality rules by distribution divergence.

A document's histogram of character classes and its histogram of common words are compared with those of its language
by Jensen-Shannon distance (the root of the divergence to base 2). The references are the sums over all documents of the language that
are long enough; documents that are shorter, or whose language has no word list, are not judged by distance. Symbol noise and shouting show in the
classes, menus and word lists in the common words.

All is column expressions: one pass over the texts counts, into a written table of small rows, from which the references (a row for each
listed language) are summed and the documents judged.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.shared import SPACE, dealt, identity, let, packed, split_words, words, written

#: Twenty frequent words of each language that is judged (fixed values).
COMMON = {
    "en": "the of and to a in is that it for was on with as by be this are at from",
    "fr": "de la le et les des en un du que une pour est dans qui pas par sur au avec",
    "de": "der die und in den von zu das mit sich des auf für nicht ist im dem ein eine als",
    "es": "de la que el en y los se las del con un por no su una para es al lo",
}
#: Marks that words are freed of before they are compared with the list (fixed values).
MARKS = ".,;:!?"
#: Character classes, each counted in what the ones before leave; all others count as one more class.
CLASSES = {
    "lower": r"[\p{Ll}\p{Lm}\p{Lo}\p{Lt}]+",
    "space": rf"[{SPACE}]+",
    "upper": r"\p{Lu}+",
    "stop": r"[.,]+",
    "digit": r"[0-9]+",
    "symbol": r"[#*$%&|<>]+",
}


@dataclass(frozen=True)
class Rules:
    """Limits. An item below the least number of words isn't judged by distance."""

    least_words: int = 10
    most_repeated: int = 20  # per cent of the words
    window: int = 5
    judged_words: int = 60
    char_distance: float = 0.25
    word_distance: float = 0.22  # for a long text; a text of n words is allowed length_allowance / sqrt(n) more
    length_allowance: float = 1.0
    common: dict[str, str] = field(default_factory=lambda: COMMON)


def class_counts(text: Column) -> Column:
    """Code points of text in each of CLASSES and in none."""

    def chain(before: Column, patterns: list[str], sizes: list[Column]) -> Column:
        if not patterns:
            return F.array(*(a - b for a, b in zip(sizes, sizes[1:])), sizes[-1])
        return let(F.regexp_replace(before, patterns[0], ""), lambda x: chain(x, patterns[1:], [*sizes, F.length(x)]))

    return F.transform(chain(text, list(CLASSES.values()), [F.length(text)]), lambda n: n.cast("long"))


def repeat_words(own: Column, hashes: Column, window: int) -> Column:
    """Words that lie in windows found twice or more, the first included. own: the words; hashes: of each of their windows.

    Both should be columns that are computed already.
    """

    def from_pairs(p: Column) -> Column:
        def hit(x: Column, i: Column) -> Column:
            before = F.when(i > 0, F.get(p, i - 1)["h"] == x["h"]).otherwise(False)
            after = F.when(i < F.size(p) - 1, F.get(p, i + 1)["h"] == x["h"]).otherwise(False)
            return before | after

        at = F.sort_array(F.transform(F.filter(p, hit), lambda x: x["i"]))
        return let(
            at,
            lambda a: F.aggregate(
                F.zip_with(F.slice(a, 2, F.size(a) - 1), F.slice(a, 1, F.size(a) - 1), lambda x, y: F.least(F.lit(window), x - y)),
                F.lit(window),
                lambda s, x: s + x,
            ),
        )

    pairs = F.sort_array(F.transform(hashes, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
    unique = F.size(F.array_distinct(hashes)) == F.size(hashes)
    return F.when((F.size(own) <= window) | unique, 0).otherwise(let(pairs, from_pairs)).cast("long")


def dup_lines(text: Column) -> Column:
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(f"[^{SPACE}]"))
    return let(lines, lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long"))


def distance(counts: Column, reference: Column) -> Column:
    """Jensen-Shannon distance between two arrays of counts of equal length, both with a positive sum."""

    def total(x: Column) -> Column:
        return F.aggregate(x, F.lit(0.0), lambda a, b: a + b.cast("double"))

    def part(p: Column, q: Column) -> Column:
        return F.when(p > 0, p * F.log2(2 * p / (p + q))).otherwise(F.lit(0.0))

    def of(sums: Column) -> Column:
        terms = F.zip_with(counts, reference, lambda c, r: F.struct((c / sums["c"]).alias("p"), (r / sums["r"]).alias("q")))
        each = F.transform(terms, lambda t: (part(t["p"], t["q"]) + part(t["q"], t["p"])) / 2)
        return F.sqrt(F.greatest(F.lit(0.0), F.aggregate(each, F.lit(0.0), lambda a, b: a + b)))

    return let(F.struct(total(counts).alias("c"), total(reference).alias("r")), of)


def features(docs: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """doc_id, lang, row (identity() of doc_id, text and lang), the counts of the contract, and the histograms classes and common.

    common: how often each word of the language's list is in the text, and the number of its other words; null without a list.
    """
    text = F.coalesce("text", F.lit(""))
    cut = docs.select(
        "doc_id", "lang", identity(F.struct("doc_id", "text", "lang")).alias("row"), words(text).alias("w"),
        split_words(F.lower(text), f"[{SPACE}{MARKS}]+").alias("bare"), class_counts(text).alias("classes"), dup_lines(text).alias("n_dup_lines"),
    ).withColumn("own", F.transform("w", lambda x: F.xxhash64(x)))
    # each step reads the arrays of the one before more than once, so they are computed once; a word is hashed once, a window from its words' hashes
    windows = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("w") - rules.window + 1))
    listed = F.array().cast("array<string>")
    for name, own in rules.common.items():
        listed = F.when(F.col("lang") == name, F.filter("bare", lambda x: x.isin(own.split()))).otherwise(listed)  # noqa: B023
    hashed = cut.select(
        "doc_id", "lang", "row", "w", "classes", "n_dup_lines", F.size("bare").cast("long").alias("n_bare"),
        F.transform(windows, lambda i: F.xxhash64(*(F.get("own", i - 1 + k) for k in range(rules.window)))).alias("h"),
        F.concat(F.lit("|"), F.array_join(listed, "||"), F.lit("|")).alias("hits"),
    )
    common = F.lit(None).cast("array<long>")
    for name, own in rules.common.items():
        counts = [((F.length("hits") - F.length(F.replace("hits", F.lit(f"|{x}|"), F.lit("")))) / (len(x) + 2)).cast("long") for x in own.split()]
        common = F.when(F.col("lang") == name, F.array(*counts)).otherwise(common)
    order = list(CLASSES)
    found = hashed.select(
        "doc_id", "lang", "row", F.size("w").cast("long").alias("n_words"), "n_dup_lines", repeat_words(F.col("w"), F.col("h"), rules.window).alias("n_repeat_words"),
        "classes", F.col("classes")[order.index("symbol")].alias("n_symbols"), common.alias("c"), "n_bare",
    )
    chars = F.aggregate("classes", F.lit(0).cast("long"), lambda a, b: a + b) - F.col("classes")[order.index("space")]
    rest = F.col("n_bare") - F.aggregate("c", F.lit(0).cast("long"), lambda a, b: a + b)
    return found.select(*(x for x in found.columns if x not in ("c",)), chars.alias("word_chars"), F.concat("c", F.array(rest)).alias("common"))


def references(found: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """From features(): lang and the summed histograms of its documents of rules.judged_words words or more; at most a row for each listed language."""
    sizes = {"classes": len(CLASSES) + 1, "common": len(next(iter(rules.common.values())).split()) + 1}
    long = found.where(F.col("lang").isin(list(rules.common)) & (F.col("n_bare") >= rules.judged_words))
    return long.groupBy("lang").agg(*(F.array(*(F.sum(F.col(k)[i]) for i in range(n))).alias(k) for k, n in sizes.items()))


def judge(docs: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """For each row of docs(doc_id, text, lang): doc_id, row (identity() of doc_id, text and lang), n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, js_chars, js_words, kept.

    Null text counts as empty: no words, hence base_failed. A null or unlisted language, and a text of fewer than rules.judged_words
    words, has null distances and is kept unless base_failed. Every row is judged for itself; repeated rows get the same values;
    other columns are ignored. An empty table gives none.
    """
    found = written(features(docs, rules), "features")
    # as many rows as there are word lists at most
    refs = references(found, rules).select(F.col("lang").alias("_lang"), F.col("classes").alias("_classes"), F.col("common").alias("_common"))
    judged = F.col("_lang").isNotNull() & (F.col("n_bare") >= rules.judged_words)
    base = (F.col("n_words") < rules.least_words) | (100 * F.col("n_repeat_words") > rules.most_repeated * F.col("n_words"))
    found = found.join(F.broadcast(refs), F.col("lang") == F.col("_lang"), "left").select(
        "doc_id", "row", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base.alias("base_failed"), "n_bare",
        F.when(judged, distance(F.col("classes"), F.col("_classes"))).alias("js_chars"),
        F.when(judged, distance(F.col("common"), F.col("_common"))).alias("js_words"),
    )
    limit = rules.word_distance + rules.length_allowance / F.sqrt(F.greatest("n_bare", F.lit(1)))
    far = F.coalesce((F.col("js_chars") > rules.char_distance) | (F.col("js_words") > limit), F.lit(False))
    return found.withColumn("kept", ~F.col("base_failed") & ~far).drop("n_bare")


def keep(docs: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """The rows of docs that judge() keeps, with all their columns."""
    gone = judge(docs, rules).where("NOT kept").select("row").distinct()
    return packed(docs).join(dealt(written(gone, "rejected")), identity(F.struct(*(F.col("doc").getField(c).alias(c) for c in ("doc_id", "text", "lang")))) == F.col("row"), "left_anti").select("doc.*")
