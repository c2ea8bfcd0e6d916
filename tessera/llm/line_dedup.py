"""Line dedup by content-defined chunks of lines.

A text is cut behind each line where a rolling hash over the hashes of the last `window` lines is a multiple of `divisor`, so
an insertion shifts boundaries only nearby. Chunks of two lines or more that stand elsewhere too are removed but for their first occurrence. Chunks are
matched by a 64-bit hash first; then the texts of all chunks of a hash are compared byte by byte (their least and greatest
are equal, or else they are grouped by the text itself), so a collision removes nothing.

Only positions and hashes of chunks are dealt out at first. The documents move once, to meet the list of their repeated chunks, and are written; the
texts of repeated chunks follow from there, each once per map task, to be compared. Unless a hash differs, the result is then a scan of what was written.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.shared import dealt, let, packed, written

WINDOW = 2
DIVISOR = 3
BASE = 31


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


def chunks(lines: Column, window: int = WINDOW, divisor: int = DIVISOR) -> Column:
    """Array of struct(start, n): the chunks of an array of lines."""
    value = F.transform(lines, lambda x: F.conv(F.substring(F.md5(x), 1, 7), 16, 10).cast("long"))

    def ends(v: Column) -> Column:
        def last(i: Column) -> Column:
            rolling = F.aggregate(F.slice(v, i - window + 2, window), F.lit(0).cast("long"), lambda a, x: a * BASE + x)
            return (i == F.size(v) - 1) | F.when(i >= window - 1, rolling % divisor == 0).otherwise(False)

        return F.filter(F.sequence(F.lit(0), F.size(v) - 1), last)

    def between(e: Column) -> Column:
        def chunk(end: Column, k: Column) -> Column:
            start = F.when(k == 0, 0).otherwise(F.get(e, k - 1) + 1)
            return F.struct(start.alias("start"), (end - start + 1).alias("n"))

        return F.transform(e, chunk)

    return let(let(value, ends), between)


def row_hash() -> Column:
    """Tells rows apart, together with doc_id."""
    return F.xxhash64("doc_id", "text")


def chunk_hash(text: Column) -> Column:
    return F.xxhash64(text)


def chunk_text(lines: Column, start: Column, n: Column) -> Column:
    return F.array_join(F.slice(lines, start + 1, n), "\n")


def repeated(docs: DataFrame, window: int = WINDOW, divisor: int = DIVISOR, least: int = 2) -> DataFrame:
    """(doc_id, row, cs): for each row of docs (row: hash of doc_id and text) its chunks whose hash stands elsewhere too, as structs (hash, start, n, is_first).

    is_first: of all places of the hash this one has the least doc_id, row and start. No text moves.
    """
    own = docs.select("doc_id", row_hash().alias("row"), "text")
    cut = let(
        lines_of(F.col("text")),
        lambda x: F.transform(
            F.filter(chunks(x, window, divisor), lambda c: c["n"] >= least),
            lambda c: F.struct(c["start"].alias("start"), c["n"].alias("n"), chunk_hash(chunk_text(x, c["start"], c["n"])).alias("hash")),
        ),
    )
    # the outer form keeps Spark from computing the array a second time to filter on its size
    places = written(own.select("doc_id", "row", F.inline_outer(cut)).where("hash IS NOT NULL"), "chunks")
    owner = F.struct("doc_id", "row", "start")
    many = written(places.groupBy("hash").agg(F.count("*").alias("c"), F.min(owner).alias("first")).where("c > 1").select("hash", "first"), "hashes")
    found = places.join(many, "hash").withColumn("is_first", owner == F.col("first"))
    return written(found.groupBy("doc_id", "row").agg(F.collect_set(F.struct("hash", "start", "n", "is_first")).alias("cs")), "repeated")


def dedup(docs: DataFrame, window: int = WINDOW, divisor: int = DIVISOR) -> DataFrame:
    """docs with repeated chunks taken out of text, and the columns n_lines and n_removed (lines; long).

    Of each chunk the occurrence with the least doc_id and place stays; rows without doc_id come before all. A null text stays null and has
    one empty line, as an empty text has. Rows equal in doc_id and text are one document: what goes from one goes from the other.
    Other columns pass through (docs' own n_lines or n_removed give way). An empty table gives none.
    """
    gone = repeated(docs, window, divisor)
    own = packed(docs).withColumn("own", F.xxhash64("doc.doc_id", "doc.text"))
    same_row = (F.col("own") == F.col("row")) & F.col("doc.doc_id").eqNullSafe(F.col("doc_id"))
    held = written(own.join(dealt(gone), same_row, "left").select("doc", "own", "cs"), "held")
    lines = lines_of(F.col("doc.text"))
    texts = held.where("cs IS NOT NULL").select(
        "doc.doc_id", F.col("own").alias("row"), F.inline(let(lines, lambda x: F.transform("cs", lambda c: c.withField("t", chunk_text(x, c["start"], c["n"])))))
    )
    differ = written(texts.groupBy("hash").agg((F.min("t") == F.max("t")).alias("same")).where("NOT same").select("hash"), "differ")
    at = F.transform(F.filter("cs", lambda c: ~c["is_first"]), lambda c: F.struct(c["start"].alias("start"), c["n"].alias("n")))
    if differ.isEmpty():
        out = held.withColumn("at", at)
    else:  # hashes that differing texts share: these chunks are told apart by the texts themselves
        mixed = texts.join(differ, "hash").select("doc_id", "row", "start", "n", F.col("hash").alias("h"), F.col("t").alias("u"))
        owner = F.struct("doc_id", "row", "start")
        firsts = mixed.groupBy("h", "u").agg(F.min(owner).alias("first"))
        place = F.struct("start", "n")
        rest = mixed.join(firsts, ["h", "u"]).groupBy("doc_id", "row").agg(
            F.collect_set(place).alias("mixed"), F.collect_set(F.when(owner != F.col("first"), place)).alias("later")
        )
        found = held.join(dealt(written(rest, "mixed")), same_row, "left")
        none = F.array().cast("array<struct<start:int,n:int>>")
        out = found.withColumn("at", F.array_union(F.array_except(at, F.coalesce("mixed", none)), F.coalesce("later", none)))

    def kept(x: Column) -> Column:
        return F.array_join(F.filter(x, lambda line, i: ~F.exists("at", lambda c: (i >= c["start"]) & (i < c["start"] + c["n"]))), "\n")

    text = F.when(F.coalesce(F.size("at"), F.lit(0)) <= 0, F.col("doc.text")).otherwise(let(lines, kept))
    removed = F.coalesce(F.aggregate("at", F.lit(0).cast("long"), lambda a, c: a + c["n"]), F.lit(0).cast("long"))
    names = [c for c in docs.columns if c not in ("n_lines", "n_removed")]
    return out.select(*((text if c == "text" else F.col("doc").getField(c)).alias(c) for c in names), F.size(lines).cast("long").alias("n_lines"), removed.alias("n_removed"))
