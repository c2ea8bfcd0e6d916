"""What several corpus operators need: written tables and components (those of the library), row identities, word columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.tables import components, n_partitions, shared_dir, sweep, written  # noqa: F401  the operators take them from here

#: The six ASCII white space characters; everything else belongs to a word.
SPACE = r"\x20\x09-\x0D"


def packed(docs: DataFrame) -> DataFrame:
    """Each row as one struct, doc, so that no other column can clash with its names."""
    return docs.select(F.struct("*").alias("doc"))


def identity(row: Column) -> Column:
    """A name that tells rows apart: SHA-256 of a struct's fields as JSON, nulls and microseconds included."""
    stamp = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"
    return F.sha2(F.to_json(row, {"ignoreNullFields": "false", "timestampFormat": stamp + "XXX", "timestampNTZFormat": stamp}), 256)


def dealt(df: DataFrame) -> DataFrame:
    """A side of a join with documents: both sides are dealt out by the key and this one is hashed, at every size, so plans and costs grow alike."""
    return df.hint("shuffle_hash")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once a row, though body's lambda functions may read it for each element."""
    return F.element_at(F.transform(F.array(value), body), 1)


def split_words(text: Column, between: str) -> Column:
    """What stands between matches of a pattern of separators (which matches no empty text); of null or an empty text, nothing."""

    def inner(parts: Column) -> Column:
        first = F.when(F.get(parts, F.lit(0)) == "", 2).otherwise(1)
        last = F.when((F.size(parts) > 1) & (F.element_at(parts, -1) == ""), F.size(parts) - 1).otherwise(F.size(parts))
        return F.slice(parts, first, F.greatest(F.lit(0), last - first + 1))

    return let(F.split(F.coalesce(text, F.lit("")), between), inner)


def words(text: Column) -> Column:
    """Words `[^\\x20\\x09-\\x0D]+` of a text; of null or an empty text, none."""
    return split_words(text, f"[{SPACE}]+")
