"""SimHash near-dedup: a byte-position inverted index with count filtering.

Two 64-bit fingerprints that differ in at most 3 bits agree in at least 5 of their 8 bytes. Each fingerprint is posted
under positional bytes; pairs of a posting list are kept if their tally of shared positional bytes reaches 5 and are
then verified bit by bit. A list for one byte would hold 1/256 of all fingerprints, so a posting is three positional
bytes of the same half: 5 shared bytes put at least 3 into one half, hence every such pair meets in one of the
8 triples, and a list is 65,536 times shorter.

A list is not expanded into its pairs. Its fingerprints are
visited in waves: the fingerprints that one of them reaches are linked to it and leave the rest, so links that join what is joined already are
never made, while every fingerprint is still held against all that are not joined to it. A dense list, of more than DENSE fingerprints, is first parted into lists of five
positional bytes: pairs of it that share 5 bytes share, beside the three of the list, two of the other five positions.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.shared import components, dealt, identity, n_partitions, packed, written
from tessera.session import ship

SEED = 42
SHINGLE = 3
BITS = 3
#: Bytes that fingerprints with at most BITS differing bits must share.
LEAST = 8 - BITS
#: Fingerprints of a posting list beyond which it is parted by two more bytes.
DENSE = 4096
#: Triples of byte positions within each half.
TRIPLES = [tuple(half + i for i in range(4) if i != left) for half in (0, 4) for left in range(4)]


def fingerprint(text: bytes | None, size: int = SHINGLE, block: int = 1 << 15) -> int:
    """SimHash of one text as an unsigned integer: lower-cased ASCII, words, shingles with repeats, majority of XXH64 bits."""
    from xxhash import xxh64_intdigest

    words = text.lower().split() if text else []
    if not words:
        return 0
    if len(words) < size:
        words = [b" ".join(words)]
        size = 1
    n = len(words) - size + 1
    counts = np.zeros(64, dtype=np.int64)
    for at in range(0, n, block):
        part = words[at : at + block + size - 1]
        grams = map(b" ".join, zip(*(part[i:] for i in range(size)))) if size > 1 else part
        hashes = np.fromiter((xxh64_intdigest(g, SEED) for g in grams), dtype="<u8")
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
    return int(np.packbits(2 * counts > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, keep: list[str] = ("doc_id",)) -> DataFrame:
    """keep columns and fingerprint (long, the 64 bits as a signed number) of docs' text. Null and wordless texts give 0."""
    ship(docs.sparkSession)
    keep = list(keep)
    fields = [docs.schema[c] for c in keep]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(len(keep)).cast(pa.binary())
            prints = np.fromiter((fingerprint(t.as_py()) for t in texts), dtype=np.uint64, count=len(texts)).view(np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(prints)], [*keep, "fingerprint"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields) + ", fingerprint long"
    return docs.select(*keep, "text").mapInArrow(run, schema)


def linked(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links that span the groups of one posting list: pairs (a, b) of its distinct uint64 values."""
    a, b = [], []
    rest = values
    while len(rest) > 1:
        wave, rest = rest[:1], rest[1:]
        while len(wave) and len(rest):
            reached = []
            for v in wave:
                if not len(rest):
                    break
                other = rest ^ v
                near = (other.view(np.uint8).reshape(-1, 8) == 0).sum(axis=1) >= LEAST  # the tally of shared positional bytes
                near[near] = np.bitwise_count(other[near]) <= BITS
                if near.any():
                    b.append(found := rest[near])
                    a.append(np.full(len(found), v))
                    reached.append(found)
                    rest = rest[~near]
            wave = np.concatenate(reached) if reached else rest[:0]
    none = np.zeros(0, dtype=np.uint64)
    return (np.concatenate(a), np.concatenate(b)) if a else (none, none)


def _pairs(keys: np.ndarray, prints: np.ndarray, dense: int = DENSE) -> tuple[np.ndarray, np.ndarray]:
    """Links of whole posting lists that lie one after another. Lists of two, by far the most, are compared all at once."""
    starts = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    sizes = np.diff(np.append(starts, len(keys)))
    two = starts[sizes == 2]
    a, b = prints[two], prints[two + 1]
    near = ((a ^ b).view(np.uint8).reshape(-1, 8) == 0).sum(axis=1) >= LEAST
    near &= np.bitwise_count(a ^ b) <= BITS
    out = [(a[near], b[near])]
    for s, n in zip(starts[sizes > 2].tolist(), sizes[sizes > 2].tolist()):
        own = prints[s : s + n]
        out += [linked(own)] if n <= dense else [linked(x) for x in parted(own, TRIPLES[int(keys[s]) >> 24])]
    return np.concatenate([x for x, _ in out]), np.concatenate([y for _, y in out])


def parted(prints: np.ndarray, triple: tuple[int, ...]) -> Iterator[np.ndarray]:
    """Lists of two or more fingerprints that share two byte positions beside the triple."""
    others = [p for p in range(8) if p not in triple]
    data = prints.astype("<u8").view(np.uint8).reshape(-1, 8)
    for i, p in enumerate(others):
        for q in others[i + 1 :]:
            key = data[:, p].astype(np.int32) << 8 | data[:, q]
            order = np.argsort(key, kind="stable")
            cuts = np.flatnonzero(np.diff(key[order])) + 1
            yield from (x for x in np.split(prints[order], cuts) if len(x) > 1)


def links(prints: DataFrame) -> DataFrame:
    """(a, b): links that span the groups of the distinct fingerprints in prints(fingerprint)."""
    spark = prints.sparkSession
    ship(spark)

    def bytes_of(triple: tuple[int, ...]):
        return F.struct(*(F.shiftrightunsigned("fingerprint", 8 * p).bitwiseAND(F.lit(255)).alias(f"b{i}") for i, p in enumerate(triple)))

    posted = prints.select(
        "fingerprint", F.posexplode(F.array(*(bytes_of(t) for t in TRIPLES))).alias("slot", "b")
    ).select(
        (F.col("slot").cast("long") * (1 << 24) + F.col("b.b0") * 65536 + F.col("b.b1") * 256 + F.col("b.b2")).alias("posting"), "fingerprint"
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, prints = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint64)

        def done(k, p):
            a, b = _pairs(k, p)
            return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])

        for batch in batches:
            keys = np.concatenate((keys, batch.column(0).to_numpy(zero_copy_only=False)))
            prints = np.concatenate((prints, batch.column(1).to_numpy(zero_copy_only=False).view(np.uint64)))
            cut = int(np.searchsorted(keys, keys[-1])) if len(keys) else 0  # the last list may go on
            if cut:
                yield done(keys[:cut], prints[:cut])
                keys, prints = keys[cut:], prints[cut:]
        if len(keys):
            yield done(keys, prints)

    lists = posted.repartition(n_partitions(spark), "posting").sortWithinPartitions("posting", "fingerprint")
    return lists.mapInArrow(run, "a long, b long")


def _named(classes: DataFrame) -> DataFrame:
    """classes(fingerprint, first), written, and the label of each one's group."""
    labels = components(links(classes.select("fingerprint")))
    named = classes.join(labels.withColumnRenamed("node", "fingerprint"), "fingerprint", "left").withColumn(
        "label", F.coalesce("label", "fingerprint")
    )
    return written(named, "named")


def cluster(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (long) and component_id of every row of docs(doc_id, text).

    component_id is the smallest doc_id that links of at most 3 differing bits reach, the row's own included (null only
    if no row of the group has a doc_id). Wordless, empty and null texts have fingerprint 0 and link like any other.
    Repeated rows and doc_ids each keep their row. An empty table gives none.
    """
    prints = written(fingerprints(docs), "fingerprints")
    classes = written(prints.groupBy("fingerprint").agg(F.min("doc_id").alias("first")), "classes")
    named = _named(classes)
    least = written(named.groupBy("label").agg(F.min("first").alias("component_id")), "least")
    of_class = written(named.join(least, "label").select("fingerprint", "component_id"), "components")
    return prints.join(of_class, "fingerprint").select("doc_id", "fingerprint", "component_id")


def keep_one(docs: DataFrame) -> DataFrame:
    """One row of each group of docs: that of the smallest doc_id (rows without one come last), and of several such rows the one whose identity() of all columns is least.

    Rows are told apart by that identity, so rows that share a doc_id are judged one by one, and of exact repeats one stays. Columns are docs'.
    """
    named = docs.select("doc_id", identity(F.struct("*")).alias("_row"), "text").toDF("doc_id", "row", "text")
    prints = written(fingerprints(named, ["doc_id", "row"]), "fingerprints")
    first = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")
    classes = written(prints.groupBy("fingerprint").agg(F.min(first).alias("first")), "classes")
    kept = written(_named(classes).groupBy("label").agg(F.min("first").alias("first")).select("first.row"), "kept")
    own = packed(docs).withColumn("own", identity(F.col("doc")))
    return own.join(dealt(kept), F.col("own") == F.col("row")).dropDuplicates(["own"]).select("doc.*")
