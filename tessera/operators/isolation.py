"""Isolation forest: vectors that few random cuts set apart are outliers.

The trees are grown on the driver from a bounded sample, go to the tasks as arrays, and every vector is led down all of them where it lies.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.neighbours import matrix
from tessera.operators.statistics import at_ranks
from tessera.session import ship
from tessera.tables import written


def average_depth(n: float) -> float:
    """The mean depth of an unsuccessful search in a random binary tree of n: what a leaf of n vectors would go on for."""
    return 0.0 if n <= 1 else 1.0 if n <= 2 else 2 * (math.log(n - 1) + 0.5772156649015329) - 2 * (n - 1) / n


@dataclass
class Tree:
    """Nodes as arrays: place and value of the cut (vectors below it go left), children, and the depth that a leaf stands for; place is -1 for leaves."""

    place: np.ndarray
    cut: np.ndarray
    left: np.ndarray
    right: np.ndarray
    depth: np.ndarray

    def depths(self, x: np.ndarray) -> np.ndarray:
        at = np.zeros(len(x), dtype=np.int64)
        while (live := np.flatnonzero(self.place[at] >= 0)).size:
            node = at[live]
            below = x[live, self.place[node]] < self.cut[node]
            at[live] = np.where(below, self.left[node], self.right[node])
        return self.depth[at]


def grow(x: np.ndarray, rng: np.random.Generator) -> Tree:
    """A tree over the sample x: cuts at random places of random places' ranges, up to log2 of the sample deep. Places without spread are not cut."""
    most = math.ceil(math.log2(max(2, len(x))))
    nodes: list[list] = [[-1, 0.0, 0, 0, 0.0]]
    open_ = [(0, np.arange(len(x)), 0)]
    while open_:
        node, rows, depth = open_.pop()
        low, high = (x[rows].min(axis=0), x[rows].max(axis=0)) if len(rows) else (np.zeros(0), np.zeros(0))
        spread = np.flatnonzero(high > low)
        if depth >= most or len(rows) <= 1 or not len(spread):
            nodes[node][4] = depth + average_depth(len(rows))
            continue
        p = int(rng.choice(spread))
        cut = float(rng.uniform(low[p], high[p]))
        below = x[rows, p] < cut
        nodes[node][:4] = [p, cut, len(nodes), len(nodes) + 1]
        open_ += [(len(nodes), rows[below], depth + 1), (len(nodes) + 1, rows[~below], depth + 1)]
        nodes += [[-1, 0.0, 0, 0, 0.0], [-1, 0.0, 0, 0, 0.0]]
    place, cut, left, right, depth = (np.array(c) for c in zip(*nodes))
    return Tree(place, cut, left, right, depth)


def isolation_scores(vectors: DataFrame, trees: int = 100, sample: int = 256, seed: int = 42, id_col: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(id_col, score) of every row with a vector: 2 to the power of minus its mean depth over that of a random tree; near 1 for outliers, below 0.5 inside.

    Each tree is grown from `sample` vectors drawn from the trees * sample rows with the least hash of their id, which is all that comes to the driver; all rows are scored.
    """
    ship(vectors.sparkSession)
    rows = vectors.where(F.col(vector).isNotNull()).select(id_col, F.col(vector).alias("v"))
    drawn = rows.select("v", F.xxhash64(id_col, F.lit(seed)).alias("_o"), F.col(id_col).alias("_i")).orderBy("_o", "_i").limit(trees * sample).select("v").collect()
    x = np.array([r.v for r in drawn], dtype=float)
    kind = rows.schema[id_col].dataType.simpleString()
    rng = np.random.default_rng(seed)
    forest = [grow(x[rng.choice(len(x), min(sample, len(x)), replace=False)], rng) for _ in range(trees)] if len(x) else []
    usual = average_depth(min(sample, len(x))) or 1.0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                v = matrix(batch.to_struct_array(), "v")
                depth = sum(t.depths(v) for t in forest) / len(forest)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(2.0 ** (-depth / usual))], [id_col, "score"])

    return rows.mapInArrow(run, f"{id_col} {kind}, score double")


def isolation_outliers(vectors: DataFrame, contamination: float = 0.05, trees: int = 100, sample: int = 256, seed: int = 42, id_col: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """isolation_scores() with is_outlier: above the quantile, interpolated, that leaves the share `contamination`."""
    found = written(isolation_scores(vectors, trees, sample, seed, id_col, vector), "isolation")
    place = lambda n: (n - 1) * F.lit(1 - contamination)
    ends = at_ranks(found, "score", [], {"low": lambda n: F.floor(place(n)), "high": lambda n: F.ceil(place(n))})
    n = found.agg(F.count("*").alias("n"))
    part = place(F.col("n")) - F.floor(place(F.col("n")))
    limit = ends.crossJoin(n).select((F.col("low") + (F.col("high") - F.col("low")) * part).alias("limit"))
    return found.crossJoin(F.broadcast(limit)).select(id_col, "score", (F.col("score") > F.col("limit")).alias("is_outlier"))  # limit is a row
