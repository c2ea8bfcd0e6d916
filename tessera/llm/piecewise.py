"""Document fingerprints by context-triggered piecewise hashing.

A rolling hash over the last WINDOW bytes decides where a chunk ends: at a block size b, a power of two, where its lowest bits are all zero, so about every b bytes, and the same
words end a chunk wherever they stand. Each chunk gives one of 64 signs by its own hash. The block size is the smallest at which a text has at most SIGNS chunks, and a fingerprint holds that size,
the signature, and the signature at twice the size, so texts whose block sizes differ by one step can be compared too. Likeness is one minus the edit distance of the signatures, by the longer one.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.shared import let, n_partitions, written
from tessera.session import ship

#: Bytes that the rolling hash sees, chunks of a signature at most, the smallest block size, bytes hashed at once.
WINDOW, SIGNS, SMALLEST, PIECE = 7, 64, 4, 1 << 20
#: Signatures without this many neighbouring signs in common (or as many as the shorter has) are not alike.
COMMON = 4
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"


def ends(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Where chunks of the smallest block size end (exclusive), and the rolling hash there. Each hash depends on the bytes of its window alone."""
    at, hashes = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.uint32)]
    whole = np.frombuffer(data, dtype=np.uint8)
    for low in range(0, len(whole), PIECE):
        start = max(0, low - WINDOW + 1)
        part = whole[start : low + PIECE].astype(np.uint32) + np.uint32(1)
        h, factor = part.copy(), 1
        for k in range(1, min(WINDOW, len(part))):
            factor = factor * 0x01000193 & 0xFFFFFFFF
            h[k:] += part[: len(part) - k] * np.uint32(factor)
        h ^= h >> np.uint32(15)
        h *= np.uint32(0x2C1B3C6D)
        h ^= h >> np.uint32(13)
        h = h[low - start :]
        hit = np.flatnonzero((h & np.uint32(SMALLEST - 1)) == 0)
        at.append(hit + low + 1)
        hashes.append(h[hit])
    return np.concatenate(at), np.concatenate(hashes)


def signature(data: bytes, cuts: np.ndarray) -> str:
    starts = [0, *cuts.tolist()]
    return "".join([ALPHABET[crc32(data[a:b]) * 0x9E3779B1 >> 26 & 63] for a, b in zip(starts, [*starts[1:], len(data)]) if a < b])


def fingerprint(data: bytes) -> str:
    """`block size:signature:signature at twice the size` of a text's bytes."""
    at, hashes = ends(data)
    size = SMALLEST
    while True:
        if len(at) + (len(at) == 0 or int(at[-1]) < len(data)) <= SIGNS:
            break
        size *= 2
        on = (hashes & np.uint32(size - 1)) == 0
        at, hashes = at[on], hashes[on]
    twice = at[(hashes & np.uint32(2 * size - 1)) == 0]
    return f"{size}:{signature(data, at)}:{signature(data, twice)}"


def likeness(a: Column, b: Column) -> Column:
    """How alike two fingerprints are, 0 to 1: 1 for equal ones, 0 if their block sizes differ by more than one step or their signatures have no COMMON neighbouring signs."""

    def grams(s: Column, n: Column) -> Column:
        return F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(s) - n + 1)), lambda i: F.substr(s, i, n))

    def of(x: Column, y: Column) -> Column:
        n = F.least(F.lit(COMMON), F.greatest(F.lit(1), F.least(F.length(x), F.length(y))))
        near = 1 - F.levenshtein(x, y) / F.greatest(F.length(x), F.length(y), F.lit(1))
        return F.when(F.arrays_overlap(grams(x, n), grams(y, n)), near).otherwise(0.0)

    def compared(p: Column) -> Column:
        x, y = p["a"], p["b"]
        m, n = x[0].cast("long"), y[0].cast("long")
        return F.when(m == n, of(x[1], y[1])).when(m == 2 * n, of(x[1], y[2])).when(n == 2 * m, of(x[2], y[1])).otherwise(0.0)

    parts = F.struct(F.split(a, ":").alias("a"), F.split(b, ":").alias("b"))
    return F.when(a == b, 1.0).otherwise(let(parts, compared))


def fingerprints(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text)' doc_id and fingerprint. Null texts count as empty; equal texts have equal fingerprints; each row is taken for itself, whole."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([fingerprint(t.as_py() or b"") for t in batch.column(1)], pa.string())], ["doc_id", "fingerprint"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col("text").cast("binary").alias("text")).mapInArrow(run, f"doc_id {kind}, fingerprint string")


def quarter_of_next(text: str, following: str) -> str:
    """The edit that the report makes: the last quarter of a text replaced by as many code points of the next one's beginning, or by all of it."""
    k = len(text) // 4
    return text[: len(text) - k] + following[:k]


DONE = "doc_id {kind}, part int, place int, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, next_fingerprint string, text binary"
#: A row of a partition: one with all it needs, the partition's first, its last (whose next document stands in another partition).
WHOLE, FIRST, LAST = 0, 1, 2


def _walk(edit: Callable[[str, str], str], most: int = 1 << 12):
    """Over a partition in order: each document meets the one before it, so only two are held."""
    from hashlib import sha256

    names = ["doc_id", "part", "place", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "next_fingerprint", "text"]

    def paired(i, part, text, mark, following, other):
        edited = edit(text.decode(), following.decode()).encode()
        return (i, part, WHOLE, len(text.decode()), sha256(edited).hexdigest(), mark, mark if edited == text else fingerprint(edited), other, None)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, held, schema = [], None, None

        def out():
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], schema[k]) for k in range(len(names))], names)

        for batch in batches:
            schema = [batch.column(0).type, pa.int32(), pa.int32(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.binary()]
            for i, part, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                text = t.as_py() or b""
                mark = held[3] if held and held[2] == text else fingerprint(text)
                if held:
                    rows.append(paired(*held, text, mark))
                else:
                    rows.append((None, part, FIRST, None, None, mark, None, None, text))
                held = (i, part, text, mark)
                if len(rows) >= most:
                    yield out()
                    rows.clear()
        if held:
            rows.append((held[0], held[1], LAST, len(held[2].decode()), None, held[3], None, None, held[2]))
            yield out()

    return run


def beside_next(docs: DataFrame, edit: Callable[[str, str], str] = quarter_of_next) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint and next_fingerprint of every row of docs(doc_id, text).

    The next document is that of the next doc_id (rows without one come first; of equal ones the order goes by a hash of the text), the first one after the last; a single row
    follows itself. Null texts are empty ones. Repeated rows each keep their row; other columns are ignored; an empty table gives none.

    The documents are sorted by ranges once and each partition is walked in order; only its last row has its next document in another
    partition. Those two rows a partition are written with their texts and joined by the partitions' numbers.
    """
    spark = docs.sparkSession
    ship(spark)
    kind = docs.schema["doc_id"].dataType.simpleString()
    own = docs.select("doc_id", F.coalesce("text", F.lit("")).cast("binary").alias("text")).withColumn("tie", F.xxhash64("text"))
    order = own.repartitionByRange(n_partitions(spark), "doc_id", "tie").sortWithinPartitions("doc_id", "tie")
    walked = written(order.select("doc_id", F.spark_partition_id().alias("part"), "text").mapInArrow(_walk(edit), DONE.format(kind=kind)), "walked")
    parts = sorted(r.part for r in walked.where(F.col("place") == FIRST).select("part").collect())  # a number for each partition at most
    after = spark.createDataFrame(list(zip(parts, [*parts[1:], *parts[:1]])), "part int, next_part int")
    last = walked.where(F.col("place") == LAST).select("doc_id", "part", "n_chars", "fingerprint", "text").join(after, "part")
    first = walked.where(F.col("place") == FIRST).select(F.col("part").alias("next_part"), F.col("fingerprint").alias("next_fingerprint"), F.col("text").alias("following"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from hashlib import sha256

        for batch in batches:
            edited = [edit(a.as_py().decode(), b.as_py().decode()).encode() for a, b in zip(batch.column("text"), batch.column("following"))]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("n_chars"), pa.array([sha256(e).hexdigest() for e in edited], pa.string()), batch.column("fingerprint"), pa.array([fingerprint(e) for e in edited], pa.string()), batch.column("next_fingerprint")],
                ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "next_fingerprint"],
            )

    columns = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "next_fingerprint"]
    ends_of = last.join(first, "next_part").mapInArrow(run, f"doc_id {kind}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, next_fingerprint string")
    return walked.where(F.col("place") == WHOLE).select(columns).unionByName(ends_of)


def report(docs: DataFrame) -> DataFrame:
    """beside_next() with the likeness of each fingerprint to the edited text's (near_edited) and to the next document's (near_next)."""
    found = beside_next(docs)
    mark = F.col("fingerprint")
    return found.select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", likeness(mark, F.col("edited_fingerprint")).alias("near_edited"), likeness(mark, F.col("next_fingerprint")).alias("near_next"))
