"""Vectors (arrays of numbers) as column expressions. Sums run in double."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _sum(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda a, b: a + b)


def dot(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def norm(a: Column) -> Column:
    return F.sqrt(_sum(F.transform(a, lambda x: x.cast("double") * x.cast("double"))))


def cosine(a: Column, b: Column) -> Column:
    """0 if either has no length."""
    size = norm(a) * norm(b)
    return F.when(size == 0, 0.0).otherwise(dot(a, b) / size)


def l2(a: Column, b: Column) -> Column:
    return F.sqrt(_sum(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double")))))


def score(metric: str, a: Column, b: Column) -> Column:
    """Higher is closer: cosine, 1 / (1 + distance), or the inner product."""
    return {"cosine": cosine, "euclidean": lambda x, y: 1.0 / (1.0 + l2(x, y)), "dot": dot}[metric](a, b)


def normalized(a: Column, kind: str = "l2") -> Column:
    """Scaled to length 1 by the l1, l2 or max norm; lengths below 1e-12 count as that."""
    size = {"l1": _sum(F.transform(a, lambda x: F.abs(x.cast("double")))), "l2": norm(a), "max": F.array_max(F.transform(a, lambda x: F.abs(x.cast("double"))))}[kind]
    return F.transform(a, lambda x: x.cast("double") / F.greatest(size, F.lit(1e-12)))


def resized(a: Column, n: int) -> Column:
    """Cut or filled with zeros to n places."""
    return F.slice(F.concat(a, F.array_repeat(F.lit(0).cast("float"), n)), 1, n)


def index_memory(n: Column, d: int, m: int = 16, nlist: int = 100, pq_m: int = 8, bits: int = 8) -> Column:
    """struct(hnsw, ivf, pq): bytes that an index of n vectors of d places takes, by the usual estimates."""
    return F.struct(
        F.floor((n * d * 4 + n * m * 8) * 1.1).alias("hnsw"), F.floor((nlist * d * 4 + n * d * 4 + nlist * 100) * 1.05).alias("ivf"),
        (n * ((pq_m * bits + 7) // 8) + pq_m * 2**bits * (d // pq_m) * 4 + n * 8).alias("pq"),
    )


def standardized(a: Column, mean: list[float], std: list[float]) -> Column:
    """Each place less its mean, over its deviation (a deviation below 1e-12 counts as 1)."""
    m, d = F.array(*map(F.lit, mean)), F.array(*(F.lit(x if x >= 1e-12 else 1.0) for x in std))
    return F.zip_with(F.zip_with(a, m, lambda x, y: x.cast("double") - y), d, lambda x, y: x / y)


def projected(a: Column, matrix: list[list[float]], bias: list[float] | None = None) -> Column:
    """A linear map: the product with each row of the matrix, plus bias."""
    rows = [dot(a, F.array(*map(F.lit, row))) for row in matrix]
    return F.array(*(r + F.lit(b) for r, b in zip(rows, bias or [0.0] * len(rows))))
