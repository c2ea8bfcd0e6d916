"""Embedding whitening: MLlib's RowMatrix over exactly centred rows, a local eigendecomposition, broadcast whitening in mapInPandas.

Vectors become whole numbers first, so sums and n * x - S are exact; a centred row is that number over n, rounded once. The Gram matrix of the centred rows over n is the
covariance. Only it, the sums and counts, d and d * d numbers, come to the driver; the d x k whitening matrix goes back as a broadcast. The whitened vectors are written, and their own
covariance is taken from there the same way, after subtraction of their mean.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.shared import written
from tessera.session import ship

#: Entries are taken as floor(SCALE * c) + SHIFT.
SCALE, SHIFT = 1024, 100_000


def usable(vector: Column) -> Column:
    """Neither null nor with null or non-finite entries."""
    ends = F.lit(float("inf"))
    return F.coalesce(vector.isNotNull() & F.forall(vector, lambda c: F.coalesce(~F.isnan(c) & (F.abs(c) < ends), F.lit(False))), F.lit(False))


def whole_numbers(vector: Column) -> Column:
    return F.transform(vector, lambda c: F.floor(c.cast("double") * SCALE).cast("long") + F.lit(SHIFT).cast("long"))


@dataclass
class Fit:
    """What the fit list gives: its number of vectors, their sums by place, and the components: values falling, vectors as columns."""

    n: int
    sums: list[int]
    values: np.ndarray
    vectors: np.ndarray
    trace: float


def gramian(rows: DataFrame, vector: str) -> np.ndarray:
    """Sum of v v' over rows' arrays of doubles, added up by RowMatrix in a tree over the partitions. rows must not be empty."""
    from pyspark.ml.functions import array_to_vector
    from pyspark.mllib.linalg.distributed import RowMatrix
    from pyspark.mllib.util import MLUtils

    dense = MLUtils.convertVectorColumnsFromML(rows.select(array_to_vector(vector).alias("v")), "v")
    return RowMatrix(dense).computeGramianMatrix().toArray()


def centred(x: Column, n: int, sums: list[int]) -> Column:
    """n * x - S of each place, exact."""
    return F.zip_with(x, F.array(*(F.lit(s).cast("long") for s in sums)), lambda a, s: F.lit(n).cast("long") * a - s)


def fit(rows: DataFrame) -> Fit | None:
    """The components of rows(x array<long>), all of one length; None if there are no rows or no places."""
    first = rows.select(F.size("x").alias("d")).head()
    if first is None or not first.d:
        return None
    total = rows.agg(F.count("*").alias("n"), *(F.sum(F.get("x", F.lit(i))).alias(f"s{i}") for i in range(first.d))).first()
    n, sums = total.n, [int(s) for s in total[1:]]
    v = gramian(rows.select(F.transform(centred(F.col("x"), n, sums), lambda c: c.cast("double") / n).alias("c")), "c") / n
    values, vectors = np.linalg.eigh((v + v.T) / 2)
    return Fit(n, sums, values[::-1], vectors[:, ::-1], float(np.trace(v)))


def _whiten(n: int, sums: list[int], matrix):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        s, w = np.array(sums, dtype=np.int64), matrix.value
        for batch in batches:
            if not len(batch):
                continue
            c = n * np.stack(batch["x"].to_numpy()) - s
            large = np.abs(c).max(axis=1).astype(float) ** 2 * len(sums) >= 2.0**62
            spread = (c * c).sum(axis=1)
            exact = [int(sum(int(v) ** 2 for v in row)) if big else int(d) for row, big, d in zip(c, large, spread)] if large.any() else spread.tolist()
            deviation = pd.array([d if d < 1 << 63 else None for d in exact], dtype="Int64")
            yield pd.DataFrame({"vec_id": batch["vec_id"], "deviation": deviation, "z": list((c / n) @ w)})

    return run


def whiten(vectors: DataFrame, k: int = 8, id_col: str = "vec_id", vector: str = "embedding") -> tuple[DataFrame, Fit | None, float | None]:
    """(vec_id, deviation, z) of every usable row of vectors, what it was fitted on, and the largest absolute entry of z's covariance minus the identity.

    z holds the vector's projections on the first k components, each over the root of its eigenvalue. A component without variance, that is
    with an eigenvalue of no more than d times the rounding of the largest, has null in its place and no part in the last number. deviation is the exact sum of (n * x - S)^2, null if
    it doesn't fit a long. Rows whose vector is null or holds null or non-finite entries go, and those that are not as long as most (of equally many, the longest): they share no
    covariance. Repeated rows and ids, null ids too, each count. Other columns are ignored. Entries have to stay below 2^63 / 1024 / n in size; else the arithmetic stops with an error. Without usable rows the
    result is an empty table.
    """
    spark = vectors.sparkSession
    ship(spark)
    rows = vectors.select(F.col(id_col).alias("vec_id"), F.col(vector).alias("e")).where(usable(F.col("e"))).select("vec_id", whole_numbers(F.col("e")).alias("x"))
    commonest = rows.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).head()
    kind = rows.schema["vec_id"].dataType.simpleString()
    schema = f"vec_id {kind}, deviation long, z array<double>"
    found = fit(rows.where(F.size("x") == commonest.d)) if commonest else None
    if found is None:
        return spark.createDataFrame([], schema), None, None
    rows = rows.where(F.size("x") == commonest.d)
    values = found.values[:k]
    sound = values > max(found.values[0], 0.0) * len(found.sums) * np.finfo(float).eps
    matrix = spark.sparkContext.broadcast(found.vectors[:, : len(values)] / np.sqrt(np.where(sound, values, 1.0)))
    out = written(rows.mapInPandas(_whiten(found.n, found.sums, matrix), schema), "whitened")
    flags = F.array(*(F.lit(bool(s)) for s in sound))
    m = int(sound.sum())  # components with variance come first
    if not m:
        return out.withColumn("z", F.zip_with("z", flags, lambda z, s: F.when(s, z))), found, None
    mean = out.agg(*(F.avg(F.get("z", F.lit(i))) for i in range(m))).first()
    apart = out.select(F.zip_with(F.slice("z", 1, m), F.array(*(F.lit(float(x)) for x in mean)), lambda z, a: z - a).alias("c"))
    error = float(np.abs(gramian(apart, "c") / found.n - np.eye(m)).max())
    return out.withColumn("z", F.zip_with("z", flags, lambda z, s: F.when(s, z))), found, error


def report(vectors: DataFrame, k: int = 8) -> DataFrame:
    """vec_id, component (from 1), n, deviation, whitened, explained (the component's share of the variance) and identity_error of each usable row and component up to k."""
    rows, found, error = whiten(vectors, k)
    n, shares = (found.n, [float(e) / found.trace if found.trace else None for e in found.values[:k]]) if found else (0, [])
    own = rows.select("vec_id", "deviation", F.posexplode("z").alias("at", "whitened"))
    explained = F.get(F.array(*(F.lit(s).cast("double") for s in shares)).cast("array<double>"), F.col("at"))
    return own.select(
        "vec_id", (F.col("at") + 1).alias("component"), F.lit(n).cast("long").alias("n"), "deviation", "whitened", explained.alias("explained"), F.lit(error).cast("double").alias("identity_error")
    )
