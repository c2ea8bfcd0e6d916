"""Product quantisation: vectors as a byte for each sub-space, searched by distance tables and scored again exactly.

A vector is cut into m parts, and each part is named by the nearest of up to 256 centres of its sub-space. The codebooks are fitted on a bounded sample, all vectors are encoded. A query makes a table of
its distance to every centre, so a code's distance is a sum of m entries; the best of those sums, `deep` of each query, are scored again from the vectors themselves.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.vectors import score
from tessera.operators.neighbours import AT_ONCE, Metric, Nearest, matrix, meetings
from tessera.operators.retrieval import top_k
from tessera.session import ship

#: Vectors that codebooks are fitted on at most: those with the least hash of their id.
SAMPLE = 10_000


@dataclass
class Codebooks:
    """centres: one array (codes, width) for each sub-space. With unit, vectors are scaled to length 1 before they are cut."""

    centres: list[np.ndarray]
    unit: bool

    def parts(self, x: np.ndarray) -> list[np.ndarray]:
        if self.unit:
            size = np.sqrt((x * x).sum(axis=1, keepdims=True))
            x = np.divide(x, size, out=np.zeros_like(x), where=size > 0)
        cuts = np.cumsum([c.shape[1] for c in self.centres])[:-1]
        return np.split(x, cuts, axis=1)

    def encode(self, x: np.ndarray) -> np.ndarray:
        """(n, m) bytes."""
        return np.stack([nearest_centre(p, c) for p, c in zip(self.parts(x), self.centres)], axis=1).astype(np.uint8)

    def decode(self, codes: np.ndarray) -> np.ndarray:
        return np.concatenate([c[codes[:, j]] for j, c in enumerate(self.centres)], axis=1)

    def tables(self, q: np.ndarray, metric: str) -> np.ndarray:
        """(n, m, codes): what each part of each query adds to the distance, for each centre."""
        most = max(len(c) for c in self.centres)
        out = np.zeros((len(q), len(self.centres), most))
        for j, (p, c) in enumerate(zip(self.parts(q), self.centres)):
            out[:, j, : len(c)] = ((p[:, None, :] - c) ** 2).sum(axis=2) if metric == "euclidean" else -(p @ c.T)
        return out


def nearest_centre(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return ((centres * centres).sum(axis=1) - 2 * (x @ centres.T)).argmin(axis=1)


def fit(vectors: DataFrame, m: int = 16, codes: int = 256, metric: str = "cosine", sample: int = SAMPLE, rounds: int = 25, seed: int = 1, id_col: str = "vec_id", vector: str = "embedding") -> Codebooks:
    """Codebooks by k-means in each of m sub-spaces, on `sample` vectors at most. Fewer different vectors than codes give as many codes."""
    if not 1 <= codes <= 256:
        raise ValueError("a code is one byte")
    rows = vectors.where(F.col(vector).isNotNull()).select(vector, F.xxhash64(id_col, F.lit(seed)).alias("_o"), F.col(id_col).alias("_i")).orderBy("_o", "_i").limit(sample).select(vector).collect()
    x = np.array([r[0] for r in rows], dtype=float)
    if not len(x):
        raise ValueError("there are no vectors to fit on")
    bounds = np.linspace(0, x.shape[1], min(m, x.shape[1]) + 1).astype(int)
    books = Codebooks([np.zeros((1, b - a)) for a, b in zip(bounds, bounds[1:])], metric == "cosine")
    rng = np.random.default_rng(seed)
    for j, p in enumerate(books.parts(x)):
        different = np.unique(p, axis=0)
        centres = different[np.sort(rng.choice(len(different), min(codes, len(different)), replace=False))]
        for _ in range(rounds):
            own = nearest_centre(p, centres)
            n = np.bincount(own, minlength=len(centres))
            sums = np.stack([np.bincount(own, p[:, k], len(centres)) for k in range(p.shape[1])], axis=1)
            new = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], centres)
            if np.allclose(new, centres, atol=1e-9):
                break
            centres = new
        books.centres[j] = centres
    return books


def encode(vectors: DataFrame, books: Codebooks, id_col: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(id, code): each vector as one byte a sub-space, to be written as the index. Rows without a vector are left out."""
    ship(vectors.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                found = books.encode(matrix(batch.to_struct_array(), "v"))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([c.tobytes() for c in found], pa.binary())], ["id", "code"])

    rows = vectors.where(F.col(vector).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(vector).alias("v"))
    return rows.mapInArrow(run, "id long, code binary")


class Coded(Nearest):
    """The codes of least distance to each query, by sums of its table's entries."""

    def __init__(self, k: int, books: Codebooks, metric: str):
        super().__init__(k, Metric(self.summed), False)
        self.books, self.kind = books, metric

    def start(self, rows) -> None:
        super().start(rows)
        self.q = self.books.tables(self.q, self.kind)

    def points(self, rows) -> np.ndarray:
        return np.frombuffer(b"".join(rows.field("code").to_pylist()), dtype=np.uint8).reshape(len(rows), -1)

    def summed(self, tables: np.ndarray, codes: np.ndarray) -> np.ndarray:
        out = np.zeros((len(tables), len(codes)))
        for j in range(codes.shape[1]):
            out += tables[:, j, :][:, codes[:, j]]
        return out


def search(index: DataFrame, books: Codebooks, vectors: DataFrame, queries: DataFrame, k: int, metric: str = "cosine", deep: int = 200, id_col: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query_id, id, score, rank) of a stated set of queries(query_id, vector): the `deep` codes of the index(id, code) nearest to each, scored again from the vectors, and of those the k best.

    Blocks of queries meet tiles of codes, a task holding one block; only `deep` rows of each query and task leave it, and only those are joined with vectors.
    """
    asked = queries.where("vector IS NOT NULL").select(F.lit(0).alias("cell"), F.col("query_id").cast("long").alias("id"), F.col("vector").alias("v"))
    told = index.select(F.lit(0).alias("cell"), "id", "code")
    near = meetings(asked, told, lambda: Coded(deep, books, metric), "query_id long, id long, distance double", block=AT_ONCE, tile=8192)
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("distance", "id"))
    found = near.withColumn("_r", place).where(F.col("_r") <= deep).select("query_id", "id")
    own = vectors.select(F.col(id_col).alias("id"), F.col(vector).alias("v"))
    pairs = found.join(own, "id").join(queries.select("query_id", "vector"), "query_id")
    return top_k(pairs.select("query_id", "id", F.round(score(metric, F.col("vector"), F.col("v")), 6).alias("score")), k)
