"""Benchmark decontamination: windows of training words against a hash set of the benchmark's windows.

Both sides are normalised alike (A-Z lower-cased, words of ASCII letters, digits and non-ASCII characters). Each benchmark item gives its
windows of `size` words, or, if it is shorter, one window of all its words. They are broadcast with their hashes while their texts take up `most_broadcast` bytes
or less and joined by shuffle beyond that. Documents are scanned window by window in one generated stage; a hit is verified word for word
before it counts. Rows are known by a hash of doc_id and text, so repeated ids keep apart.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.shared import dealt, let, packed, split_words, written

SIZE = 10
#: Bytes of distinct windows (UTF-8, and 64 for the hash and numbers of each) that are broadcast at most.
MOST_BROADCAST = 32 << 20
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def lower_ascii(text: Column) -> Column:
    """text with A-Z lower-cased and all else as it is. lower() does that for texts of ASCII alone; translate() is slow, so others take a replacement for each letter."""
    other = text
    for c in _UPPER:
        other = F.replace(other, F.lit(c), F.lit(c.lower()))
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(other)


def normal_words(text: Column) -> Column:
    """The normalised words of a text; of null, none."""
    return split_words(lower_ascii(F.coalesce(text, F.lit(""))), BETWEEN)


def benchmark_windows(benchmark: DataFrame, size: int = SIZE) -> DataFrame:
    """(item_id string, n, window): the distinct windows of each item, n words joined by spaces; items without words have none."""
    own = benchmark.select(F.col("item_id").cast("string").alias("item_id"), normal_words(F.col("text")).alias("w")).where(F.size("w") > 0)
    windows = let(
        F.col("w"),
        lambda w: F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(w) - size + 1)), lambda i: F.array_join(F.slice(w, i, size), " ")),
    )
    return own.select("item_id", F.least(F.size("w"), F.lit(size)).alias("n"), F.explode(windows).alias("window")).distinct()


def candidates(docs: DataFrame, benchmark: DataFrame, size: int = SIZE, most_broadcast: int = MOST_BROADCAST) -> DataFrame:
    """(row, hits): for rows of docs (by xxhash64 of doc_id and text) with windows whose hash the benchmark has, an array of struct(at, n, window, item_id).

    `at` counts the document's words from 0. An item without an id goes by the id ''.
    """
    items = written(benchmark_windows(benchmark, size).fillna("", ["item_id"]), "windows")
    lengths = sorted(r.n for r in items.select("n").distinct().collect())  # at most `size` numbers
    small = (items.agg(F.sum(F.octet_length("window") + F.octet_length("item_id") + 64)).first()[0] or 0) <= most_broadcast

    def prints(w: Column) -> Column:
        """Of each place and window length a hash; those of one length follow each other."""
        each = [
            F.transform(
                F.when(F.size(w) >= n, F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(w) - n + 1))).otherwise(F.array().cast("array<int>")),
                lambda i: F.xxhash64(F.slice(w, i, n)),  # noqa: B023
            )
            for n in lengths
        ]
        return F.array(*each) if each else F.array().cast("array<array<bigint>>")

    # hashes are made row by row and exploded as numbers; the outer form keeps Spark from making them a second time to filter on their size
    made = docs.select(F.xxhash64("doc_id", "text").alias("row"), let(normal_words(F.col("text")), prints).alias("ps"))
    lists = made.select("row", F.posexplode_outer("ps").alias("k", "p")) if len(lengths) != 1 else made.select("row", F.lit(0).alias("k"), F.col("ps")[0].alias("p"))
    seen = lists.select("row", "k", F.posexplode_outer("p").alias("at", "print"))
    words = F.split("window", " ")
    own = F.lit(None).cast("long")
    for n in lengths:
        own = F.when(F.col("n") == n, F.xxhash64(F.slice(words, 1, n))).otherwise(own)
    order = F.lit(None).cast("int")
    for k, n in enumerate(lengths):
        order = F.when(F.col("n") == n, k).otherwise(order)
    known = items.select("n", "window", "item_id", own.alias("known"), order.alias("of"))
    found = seen.join(F.broadcast(known) if small else known, (F.col("print") == F.col("known")) & (F.col("k") == F.col("of")))
    return written(found.groupBy("row").agg(F.collect_set(F.struct("at", "n", "window", "item_id")).alias("hits")), "hits")


def marked(docs: DataFrame, benchmark: DataFrame, size: int = SIZE, most_broadcast: int = MOST_BROADCAST) -> DataFrame:
    """Each row of docs as struct doc, with the struct hit: n_words, at (positions of hit words), items (ids), both sorted and of verified hits alone."""
    found = candidates(docs, benchmark, size, most_broadcast)
    out = packed(docs).join(dealt(found), F.xxhash64("doc.doc_id", "doc.text") == F.col("row"), "left")

    def verified(w: Column) -> Column:
        real = F.filter(F.col("hits"), lambda h: F.array_join(F.slice(w, h["at"] + 1, h["n"]), " ") == h["window"])

        def parts(r: Column) -> Column:
            at = F.array_distinct(F.flatten(F.transform(r, lambda h: F.sequence(h["at"], h["at"] + h["n"] - 1))))
            items = F.array_distinct(F.transform(r, lambda h: h["item_id"]))
            return F.struct(
                F.size(w).cast("long").alias("n_words"), F.sort_array(F.coalesce(at, F.array().cast("array<int>"))).alias("at"),
                F.sort_array(F.coalesce(items, F.array().cast("array<string>"))).alias("items"),
            )

        return let(real, parts)

    return out.select("doc", let(normal_words(F.col("doc.text")), verified).alias("hit"))


def report(docs: DataFrame, benchmark: DataFrame, size: int = SIZE, most_broadcast: int = MOST_BROADCAST) -> DataFrame:
    """Per row of docs(doc_id, text): doc_id, n_words, n_hit, n_items, items_sha256, contaminated, and the arrays hit_words (positions) and items.

    Null and wordless texts have no words and are clean; so is all of an empty table and all if the benchmark has no words. Rows are judged each
    for itself, whatever their doc_id (which may be null); other columns are ignored.
    """
    out = marked(docs.select("doc_id", "text"), benchmark, size, most_broadcast)
    n_hit = F.size("hit.at").cast("long")
    return out.select(
        "doc.doc_id", F.col("hit.n_words").alias("n_words"), n_hit.alias("n_hit"), F.size("hit.items").cast("long").alias("n_items"),
        F.sha2(F.array_join("hit.items", ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"),
        F.col("hit.at").alias("hit_words"), F.col("hit.items").alias("items"),
    )


def keep(docs: DataFrame, benchmark: DataFrame, size: int = SIZE) -> DataFrame:
    """The rows of docs that no benchmark window hits, with all their columns; null and wordless texts stay, repeated rows are judged each for itself."""
    return marked(docs, benchmark, size).where(F.size("hit.at") == 0).select("doc.*")


def cut(docs: DataFrame, benchmark: DataFrame, size: int = SIZE) -> DataFrame:
    """docs with the hit words, and what stands between each and the next word, taken out of text; clean rows, null texts among them, stay as they are."""
    words, between = F.regexp_extract_all("doc.text", F.lit(WORD), F.lit(0)), F.split("doc.text", WORD)
    rest = let(
        F.struct(words.alias("w"), between.alias("b"), F.col("hit.at").alias("at")),
        lambda x: F.concat(
            F.get(x["b"], F.lit(0)),
            F.array_join(F.transform(x["w"], lambda w, i: F.when(F.array_contains(x["at"], i), "").otherwise(F.concat(w, F.coalesce(F.get(x["b"], i + 1), F.lit(""))))), ""),
        ),
    )
    kept = F.when(F.size("hit.at") == 0, F.col("doc.text")).otherwise(rest)
    return marked(docs, benchmark, size).select(*((kept if c == "text" else F.col("doc").getField(c)).alias(c) for c in docs.columns))
