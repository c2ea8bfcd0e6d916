"""Schemas of metadata: rules for fields, violations of rows, compatibility of collections."""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import asdict, dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


@dataclass(frozen=True)
class Field:
    """type: string, integer, float, boolean, date, object, array, vector or any."""

    name: str
    type: str = "any"
    required: bool = False
    least: float | None = None
    most: float | None = None
    values: tuple = ()
    item: str = "any"
    fields: tuple[Field, ...] = ()
    dimension: int | None = None


_PATTERN = {"integer": r"^[+-]?[0-9]+$", "float": r"^[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?$", "boolean": "^(true|false)$", "date": r"^[0-9]{4}-[0-9]{2}-[0-9]{2}([T ].*)?$"}
_SPARK = {"string": T.StringType(), "integer": T.LongType(), "float": T.DoubleType(), "boolean": T.BooleanType(), "date": T.TimestampType(), "any": T.StringType()}


def spark_type(f: Field) -> T.DataType:
    if f.type == "array":
        return T.ArrayType(_SPARK[f.item])
    if f.type == "vector":
        return T.ArrayType(T.FloatType())
    return struct_of(f.fields) if f.type == "object" else _SPARK[f.type]


def struct_of(fields: Sequence[Field]) -> T.StructType:
    return T.StructType([T.StructField(f.name, spark_type(f), not f.required) for f in fields])


def violations(value_of, fields: Sequence[Field]) -> Column:
    """Array of messages for a row; value_of(name) gives a field as text (of a map or JSON), null if missing."""
    out = []
    for f in fields:
        v = value_of(f.name)
        if f.required:
            out.append(F.when(v.isNull(), f"{f.name}: missing"))
        if f.type in _PATTERN:
            out.append(F.when(~v.rlike(_PATTERN[f.type]), f"{f.name}: not {f.type}"))
        if f.least is not None or f.most is not None:
            n = v.try_cast("double")
            low = n < f.least if f.least is not None else F.lit(False)
            high = n > f.most if f.most is not None else F.lit(False)
            out.append(F.when(low | high, f"{f.name}: out of range"))
        if f.values:
            out.append(F.when(~v.isin([str(x) for x in f.values]), f"{f.name}: not allowed"))
    return F.array_compact(F.array(*out))


def compatible(old: Sequence[Field], new: Sequence[Field]) -> list[str]:
    """Why data of the old schema doesn't fit the new one; empty if it does. One way only."""
    have = {f.name: f for f in old}
    out = [f"{f.name}: required but unknown" for f in new if f.required and f.name not in have]
    return out + [f"{f.name}: {have[f.name].type} is not {f.type}" for f in new if f.name in have and "any" not in (f.type, have[f.name].type) and have[f.name].type != f.type]


def to_json(fields: Sequence[Field]) -> str:
    """A schema as text; from_json() gives it back."""
    return json.dumps([asdict(f) for f in fields], sort_keys=True)


def from_json(text: str) -> list[Field]:
    def field(d: dict) -> Field:
        return Field(**d | {"values": tuple(d["values"]), "fields": tuple(map(field, d["fields"]))})

    return [field(d) for d in json.loads(text)]


def export(spark: SparkSession, schemas: dict[str, Sequence[Field]], path: str) -> None:
    """Write a registry (name: fields) as JSON lines, in place of what is there."""
    spark.createDataFrame([(k, to_json(v)) for k, v in schemas.items()], "name string, fields string").coalesce(1).write.mode("overwrite").json(path)


def imported(spark: SparkSession, path: str) -> dict[str, list[Field]]:
    return {r.name: from_json(r.fields) for r in spark.read.schema("name string, fields string").json(path).collect()}


def profile(rows: DataFrame, metadata: Column, top: int = 5, share: float = 0.3) -> DataFrame:
    """(key, value, n, present): for each key of a map the most frequent values that share of its rows has, top at most."""
    from pyspark.sql import Window

    each = rows.select(F.explode(metadata).alias("key", "value"))
    counts = each.groupBy("key", "value").agg(F.count("*").alias("n"))
    w = Window.partitionBy("key")
    out = counts.withColumns({"present": F.sum("n").over(w), "r": F.row_number().over(w.orderBy(F.desc("n"), "value"))})
    return out.where((F.col("r") <= top) & (F.col("n") >= F.greatest(F.lit(1.0), share * F.col("present")))).drop("r")
