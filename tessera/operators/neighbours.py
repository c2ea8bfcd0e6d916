"""Neighbourhoods of vectors: exact nearest neighbours, the local outlier factor, DBSCAN, and similar pairs by hyperplane blocking.

All of them let blocks of query vectors meet tiles of points (see meetings()): rows are packed into matrices, a task holds one block and streams the tiles that it meets, and what
comes out is linear in the block: the best few of each query, a count, or links that span groups. Pairs never become rows unless they are asked for. Where a tile can be
far from a block, cells keep them apart: a grid of projections for DBSCAN (exact), keys of random hyperplanes for similar pairs (with a stated recall).
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.vectors import l2
from tessera.session import ship
from tessera.tables import components, n_partitions, written

#: Query vectors that a task holds, points of a tile, and rows of the block that are compared with a tile at once.
BLOCK, TILE, AT_ONCE = 8192, 1024, 1024
#: Points that a task takes at least before a block's tiles are dealt over more tasks.
SLICE = 1 << 16


def matrix(rows: pa.StructScalar | pa.Array, name: str) -> np.ndarray:
    """The vectors in a field of a packed list, as doubles."""
    column = rows.field(name)
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(column), -1)


def packed(rows: DataFrame, size: int) -> DataFrame:
    """(cell, h, rows): rows(cell, id, ...) of each cell dealt by the hash of their id into lists of about `size` rows."""
    counts = rows.groupBy("cell").agg(F.count("*").alias("_n"))
    own = rows.join(counts, "cell").withColumn("h", F.pmod(F.xxhash64("id"), F.ceil(F.col("_n") / size).cast("long")))
    return own.groupBy("cell", "h").agg(F.collect_list(F.struct(*(c for c in rows.columns if c != "cell"))).alias("rows"))


#: Types of results that an empty array doesn't tell.
_ARROW = {"tinyint": pa.int8(), "smallint": pa.int16(), "int": pa.int32(), "bigint": pa.int64(), "long": pa.int64(), "double": pa.float64(), "string": pa.string()}


def meetings(queries: DataFrame, points: DataFrame, worker: Callable, schema: str, near: Callable[[Column], Column] = F.array, block: int = BLOCK, tile: int = TILE) -> DataFrame:
    """What workers make of each block of queries(cell, id, v, ...) and the tiles of points(cell, id, v, ...) in the cells near(cell).

    worker() gives an object with start(rows) for a block, take(rows) for each tile, finish() for the arrays of its result; what take() returns, if anything, are such arrays one after another, results at once. A block's tiles are dealt over several tasks, each with SLICE points or more, where there are
    fewer blocks than partitions, so a worker's results are to be merged by id.
    """
    asked = written(packed(queries, block), "blocks")
    told = written(packed(points, tile), "tiles")
    slices = max(1, min(-(-n_partitions(queries.sparkSession) // max(1, asked.count())), told.count() * tile // SLICE))
    return meet(asked, told, slices, worker, schema, near)


def meet(asked: DataFrame, told: DataFrame, slices: int, worker: Callable, schema: str, near: Callable[[Column], Column] = F.array) -> DataFrame:
    """meetings() of blocks asked(cell, h, rows) and tiles told(cell, h, rows), each block's tiles dealt over so many tasks."""
    spark = asked.sparkSession
    ship(spark)
    parts = n_partitions(spark)
    where = asked.select(F.col("cell").alias("to"), F.col("h").alias("qh"))
    sent = told.select(F.explode(near(F.col("cell"))).alias("to"), F.pmod(F.xxhash64("cell", "h"), F.lit(slices)).cast("int").alias("slice"), "rows").join(where, "to")
    each = asked.select(F.col("cell").alias("to"), F.col("h").alias("qh"), F.explode(F.sequence(F.lit(0), F.lit(slices - 1))).alias("slice"), F.lit(0).alias("kind"), F.col("rows").alias("asked"))
    both = each.unionByName(sent.select("to", "qh", "slice", F.lit(1).alias("kind"), F.col("rows").alias("told")), allowMissingColumns=True)
    both = both.select(F.xxhash64("to", "qh", "slice").alias("key"), "kind", F.struct("to", "qh", "slice").alias("at"), "asked", "told")
    names = [x.split()[0] for x in schema.split(", ")]
    types = [_ARROW.get(x.split()[1]) for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, own = None, None

        def made(arrays):
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(arrays, types)], names)

        for batch in batches:
            keys, kinds, told = batch.column(2).to_pylist(), batch.column(1).to_pylist(), batch.column(4)
            for i, (key, kind) in enumerate(zip(keys, kinds)):
                if kind == 0:
                    if own is not None:
                        yield made(own.finish())
                    now, own = key, worker()
                    own.start(batch.column(3)[i].values)
                elif own is not None and key == now:
                    for part in own.take(told[i].values) or ():
                        yield made(part)
        if own is not None:
            yield made(own.finish())

    place = F.pmod(F.pmod(F.xxhash64("at.to"), F.lit(parts)) + F.col("at.qh") * slices + F.col("at.slice"), F.lit(parts)).cast("int")  # by turns: a few keys dealt by a hash leave tasks without any
    return both.repartitionById(parts, place).sortWithinPartitions("at", "kind").mapInArrow(run, schema)


def squares(q: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Squared distances of all rows of q and p."""
    return np.maximum((q * q).sum(axis=1)[:, None] + (p * p).sum(axis=1) - 2 * (q @ p.T), 0.0)


class Metric:
    """raw(q, p): a number for each pair that grows with the distance; micro(raw): the distance in micro-units, rounded; bound(micro): raw values above it have greater distances."""

    def __init__(self, raw: Callable[[np.ndarray, np.ndarray], np.ndarray], squared: bool = False):
        self.raw, self.squared = raw, squared

    def micro(self, raw: np.ndarray) -> np.ndarray:
        return np.rint((np.sqrt(raw) if self.squared else raw) * 1e6).astype(np.int64)

    def bound(self, micro: np.ndarray) -> np.ndarray:
        at = (micro + 0.5) / 1e6
        return at * np.abs(at) * (1 + 1e-12) if self.squared else at


#: Stands for no point yet.
NONE = np.iinfo(np.int64).max


class Nearest:
    """The k points of least distance (micro-units, rounded) to each query, of equal ones those of the smallest id.

    Only points of a tile that are no farther than a query's k-th best so far are looked at again, so after the first tiles a tile costs its matrix product.
    """

    def __init__(self, k: int, metric: Metric, other: bool):
        self.k, self.metric, self.other = k, metric, other

    def start(self, rows) -> None:
        self.ids, self.q = rows.field("id").to_numpy(zero_copy_only=False), matrix(rows, "v")
        n = len(self.ids)
        self.best, self.found = np.full((n, self.k), NONE), np.full((n, self.k), -1)

    def take(self, rows) -> None:
        ids, p = rows.field("id").to_numpy(zero_copy_only=False), self.points(rows)
        for a in range(0, len(self.ids), AT_ONCE):
            b = min(len(self.ids), a + AT_ONCE)
            raw = self.metric.raw(self.q[a:b], p)
            last = self.best[a:b, -1]
            on = raw <= np.where(last < NONE, self.metric.bound(last), np.inf)[:, None]
            if self.other:
                on &= self.ids[a:b, None] != ids
            if len(ids) > self.k and np.count_nonzero(on) > 8 * self.k * len(on):  # the tile's own k-th best of each query first
                kth = np.partition(np.where(on, raw, np.inf), self.k - 1, axis=1)[:, self.k - 1]
                full = np.isfinite(kth)
                on &= raw <= np.where(full, self.metric.bound(self.metric.micro(np.where(full, kth, 0.0))), np.inf)[:, None]
            i, j = np.nonzero(on)
            if len(i):
                self.merge(a, i, self.metric.micro(raw[i, j]), ids[j])

    def merge(self, a: int, i: np.ndarray, micro: np.ndarray, ids: np.ndarray) -> None:
        """Takes candidates of rows a + i (in order of i) into the rows' best."""
        rows = np.unique(i)
        row = np.concatenate((np.repeat(rows, self.k), i))
        near, who = np.concatenate((self.best[a + rows].ravel(), micro)), np.concatenate((self.found[a + rows].ravel(), ids))
        order = np.lexsort((who, near, row))
        first = np.searchsorted(row[order], rows)
        at = order[first[:, None] + np.arange(self.k)]
        self.best[a + rows], self.found[a + rows] = near[at], who[at]

    def points(self, rows) -> np.ndarray:
        return matrix(rows, "v")

    def finish(self):
        q, j = np.nonzero(self.best < NONE)
        return self.ids[q], self.found[q, j], self.best[q, j] / 1e6


def _metric(name: str) -> Metric:
    def unit(x):
        size = np.sqrt((x * x).sum(axis=1, keepdims=True))
        return np.divide(x, size, out=np.zeros_like(x), where=size > 0)

    return {"l2": Metric(squares, True), "cosine": Metric(lambda q, p: -(unit(q) @ unit(p).T)), "dot": Metric(lambda q, p: -(q @ p.T))}[name]


def nearest(points: DataFrame, queries: DataFrame, k: int, metric: str = "l2", id_col: str = "vec_id", vector: str = "embedding", other: bool = True) -> DataFrame:
    """(query_id, id, distance, rank): the k nearest points of each query, exactly; metric l2, or cosine or dot with their negative as distance.

    Distances are rounded to six places; equal ones go by the smaller id. other: a query is not its own neighbour. Rows without a vector take no part. Fewer than k points give as many ranks.
    Each task holds a block of queries and streams tiles of points, so the work is that of all pairs, done as matrix products, while no pair becomes a row.
    """
    if k < 1:
        raise ValueError("k must be positive")
    rows = lambda df: df.where(F.col(vector).isNotNull()).select(F.lit(0).alias("cell"), F.col(id_col).cast("long").alias("id"), F.col(vector).alias("v"))
    found = meetings(rows(queries), rows(points), lambda: Nearest(k, _metric(metric), other), "query_id long, id long, distance double")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("distance", "id"))
    return found.withColumn("rank", place).where(F.col("rank") <= k)


def local_outlier_factor(vectors: DataFrame, k: int = 20, id_col: str = "vec_id", vector: str = "embedding", graph: DataFrame | None = None) -> DataFrame:
    """(id_col, factor): how much thinner the vectors stand around a vector than around its k nearest others; about 1 inside a cluster.

    The reachability distance from p to o is the larger of their distance and o's distance to its own k-th neighbour; density is one over the mean reachability of the neighbours (plus 1e-10), and the
    factor the mean of the neighbours' densities over one's own. graph: another (query_id, id, distance, rank), such as one from an index; else it is exact. The graph is written and joined twice. A vector
    without others has no row.
    """
    own = written(nearest(vectors, vectors, k, "l2", id_col, vector) if graph is None else graph.where(F.col("rank") <= k), "graph")
    reach = own.groupBy(F.col("query_id").alias("id")).agg(F.max("distance").alias("radius"))
    density = own.join(reach, "id").groupBy("query_id").agg((1 / (F.avg(F.greatest("distance", "radius")) + 1e-10)).alias("density"))
    density = written(density, "density")
    around = own.join(density.select(F.col("query_id").alias("id"), F.col("density").alias("theirs")), "id").groupBy("query_id").agg(F.avg("theirs").alias("theirs"))
    return around.join(density, "query_id").select(F.col("query_id").alias(id_col), (F.col("theirs") / F.col("density")).alias("factor"))


# --- scores, higher is closer, as vectors.score() has them


#: More than the products of matrices err beside the sum of one pair, relative to the lengths.
SLACK = 1e-12
#: Numbers up to this in a vector; their squares are finite.
LARGEST = 1e100


def micro(x: np.ndarray) -> np.ndarray:
    """Six places, halves away from zero; numbers too large to have six places stay."""
    return np.where(np.abs(x) < 4e9, np.trunc(x * 1e6 + np.copysign(0.5, x)) / 1e6, x) + 0.0


class Score:
    """A score of pairs of vectors: cosine, euclidean (1 / (1 + distance)), dot, distance (its negative) or unit (dot of vectors scaled to length 1, lengths below 1e-12 counting as that).

    rough(): a number for each pair that grows with the score, from one product of matrices, and how far it may be off; exact(): the score of chosen pairs; of(): the score of a rough number; least():
    the rough number below which scores, rounded, are lower than a rounded one.
    """

    def __init__(self, metric: str):
        self.metric, self.far = metric, metric in ("euclidean", "distance")

    def held(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Vectors as they are multiplied, and their squared lengths."""
        squared = (x * x).sum(axis=1)
        if self.metric in ("cosine", "unit"):
            size = np.sqrt(squared)[:, None]
            x = x / np.maximum(size, 1e-12) if self.metric == "unit" else np.divide(x, size, out=np.zeros_like(x), where=size > 0)
        return x, squared

    def rough(self, q: tuple, p: tuple) -> tuple[np.ndarray, np.ndarray]:
        out = q[0] @ p[0].T
        if self.far:
            out *= 2
            out -= q[1][:, None]
            out -= p[1]
            return out, SLACK * (q[1] + p[1].max(initial=0.0))
        return out, SLACK * (np.sqrt(q[1] * p[1].max(initial=0.0)) if self.metric == "dot" else np.ones(len(q[1])))

    def exact(self, q: np.ndarray, p: np.ndarray) -> np.ndarray:
        if not self.far:
            return (q * p).sum(axis=1)
        return self.of(-((q - p) ** 2).sum(axis=1))

    def of(self, rough: np.ndarray) -> np.ndarray:
        if not self.far:
            return rough
        away = np.sqrt(np.maximum(-rough, 0.0))
        return -away if self.metric == "distance" else 1.0 / (1.0 + away)

    def least(self, score: np.ndarray) -> np.ndarray:
        at = score - 0.5e-6 - SLACK * np.abs(score)
        if self.metric == "euclidean":
            at = np.where(at > 0, 1.0 - 1.0 / np.where(at > 0, at, 1.0), -np.inf)  # the negative distance
        return -(at * at) * (1 + SLACK) if self.far else at


class Top:
    """The k points of highest score (six places) with each query, of equal ones those of the smallest id. Beyond the first tiles only points that can be among them are looked at again."""

    def __init__(self, k: int, metric: str, other: bool):
        self.k, self.score, self.other = k, Score(metric), other

    def start(self, rows) -> None:
        self.ids, self.q = rows.field("id").to_numpy(zero_copy_only=False), self.score.held(matrix(rows, "v"))
        self.best, self.found = np.full((len(self.ids), self.k), -np.inf), None

    def take(self, rows) -> None:
        ids, p = rows.field("id").to_numpy(zero_copy_only=False), self.score.held(matrix(rows, "v"))
        if self.found is None:
            self.found = np.full(self.best.shape, "" if ids.dtype == object else -1, dtype=ids.dtype)
        for a in range(0, len(self.ids), AT_ONCE):
            q = tuple(x[a : a + AT_ONCE] for x in self.q)
            rough, off = self.score.rough(q, p)
            last = self.best[a : a + AT_ONCE, -1]
            full = np.isfinite(last)
            on = rough >= np.where(full, self.score.least(np.where(full, last, 0.0)) - off, -np.inf)[:, None]
            if self.other:
                on &= self.ids[a : a + AT_ONCE, None] != ids
            if len(ids) > self.k and np.count_nonzero(on) > 8 * self.k * len(on):  # the tile's own k-th best of each query first
                kth = np.partition(np.where(on, rough, -np.inf), len(ids) - self.k, axis=1)[:, len(ids) - self.k]
                full = np.isfinite(kth)
                own = micro(self.score.of(np.where(full, kth, 0.0) - 2 * off))
                on &= rough >= np.where(full, self.score.least(own) - off, -np.inf)[:, None]
            i, j = np.nonzero(on)
            for c in range(0, len(i), SLICE):  # many if most are copies; a query's may come in two parts
                row, col = i[c : c + SLICE], j[c : c + SLICE]
                self.merge(a, row, micro(self.score.exact(q[0][row], p[0][col])), ids[col])

    def merge(self, a: int, i: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        """Takes candidates of rows a + i (in order of i) into the rows' best."""
        rows = np.unique(i)
        row = np.concatenate((np.repeat(rows, self.k), i))
        near, who = np.concatenate((self.best[a + rows].ravel(), score)), np.concatenate((self.found[a + rows].ravel(), ids))
        order = np.lexsort((np.unique(who, return_inverse=True)[1] if who.dtype == object else who, -near, row))
        first = np.searchsorted(row[order], rows)
        at = order[first[:, None] + np.arange(self.k)]
        self.best[a + rows], self.found[a + rows] = near[at], who[at]

    def finish(self):
        q, j = np.nonzero(self.best > -np.inf)
        return self.ids[q], [] if self.found is None else self.found[q, j], self.best[q, j]


class Pairs:
    """The pairs of queries and other points at the threshold or above, by the score to six places; they leave with each tile, SLICE at most at once."""

    def __init__(self, threshold: float, metric: str):
        self.threshold, self.score = threshold, Score(metric)

    def start(self, rows) -> None:
        self.ids, self.q = rows.field("id").to_numpy(zero_copy_only=False), self.score.held(matrix(rows, "v"))

    def take(self, rows) -> Iterator[tuple]:
        ids, p = rows.field("id").to_numpy(zero_copy_only=False), self.score.held(matrix(rows, "v"))
        for a in range(0, len(self.ids), AT_ONCE):
            q, own = tuple(x[a : a + AT_ONCE] for x in self.q), self.ids[a : a + AT_ONCE]
            rough, off = self.score.rough(q, p)
            i, j = np.nonzero((rough >= (self.score.least(np.float64(self.threshold)) - off)[:, None]) & (own[:, None] != ids))
            for c in range(0, len(i), SLICE):
                row, col = i[c : c + SLICE], j[c : c + SLICE]
                score = micro(self.score.exact(q[0][row], p[0][col]))
                on = score >= self.threshold
                yield own[row[on]], ids[col[on]], score[on]

    def finish(self):
        return [], [], []


class Counts:
    """How often each dot of unit vectors, in millionths, is there between queries and other points: two million counts at most."""

    def start(self, rows) -> None:
        self.score = Score("unit")
        self.ids, self.q = rows.field("id").to_numpy(zero_copy_only=False), self.score.held(matrix(rows, "v"))
        self.n = np.zeros(2 * 10**6 + 3, dtype=np.int64)

    def take(self, rows) -> None:
        ids, p = rows.field("id").to_numpy(zero_copy_only=False), self.score.held(matrix(rows, "v"))
        for a in range(0, len(self.ids), AT_ONCE):
            x = self.score.rough(tuple(x[a : a + AT_ONCE] for x in self.q), p)[0]
            x *= 1e6
            x += np.copysign(0.5, x)
            at = x.astype(np.int64) + (10**6 + 1)
            self.n += np.bincount(at.ravel(), minlength=len(self.n))
            np.subtract.at(self.n, at[self.ids[a : a + AT_ONCE, None] == ids], 1)

    def finish(self):
        at = np.flatnonzero(self.n)
        return (at - (10**6 + 1)) / 1e6, self.n[at]


def even(id_col: str, vector: str, places: int) -> Column:
    """Whether a row can be in a matrix: an id, and a vector of so many finite numbers."""
    v = F.col(vector)
    return F.coalesce(F.col(id_col).isNotNull() & (F.size(v) == places) & F.forall(v, lambda x: x.isNotNull() & (F.abs(x.cast("double")) <= LARGEST)), F.lit(False))


def by_evenness(points: DataFrame, queries: DataFrame) -> tuple[DataFrame, DataFrame, list[tuple[DataFrame, DataFrame]]]:
    """points(id, v, ...) and queries(id, v, ...) that fit into matrices, and pairs of tables with all meetings of others: vectors that lack places or numbers, or have another length than most."""
    most = points.where(F.size("v") > 0).groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "d").first()
    fits = even("id", "v", 0 if most is None else most.d)
    odd_points, odd_queries = points.where(~fits), queries.where(~fits)
    rest = [] if odd_points.isEmpty() else [(odd_points, queries)]
    if not odd_queries.isEmpty():
        rest.append((points.where(fits), odd_queries))
    return points.where(fits), queries.where(fits), rest


def _in_a_cell(rows: DataFrame) -> DataFrame:
    return rows if "cell" in rows.columns else rows.select(F.lit(0).alias("cell"), *rows.columns)


def best(points: DataFrame, queries: DataFrame, k: int, metric: str, other: bool = False) -> DataFrame:
    """(query_id, id, score): at least the k best points(id, v) of each of queries(id, v), exactly and to six places, if both are even; equal ones go by the smaller id. With a column cell in both, those of the query's
    cells. What leaves a task is k rows a query, so the rest is a top-k over a few such lists."""
    types = dict(points.dtypes), dict(queries.dtypes)
    return meetings(_in_a_cell(queries), _in_a_cell(points), lambda: Top(k, metric, other), f"query_id {types[1]['id']}, id {types[0]['id']}, score double")


def pairs_from(points: DataFrame, queries: DataFrame, threshold: float, metric: str = "unit") -> DataFrame:
    """(query_id, id, score) of all even queries(id, v) and other even points(id, v) at the threshold or above."""
    types = dict(points.dtypes), dict(queries.dtypes)
    return meetings(_in_a_cell(queries), _in_a_cell(points), lambda: Pairs(threshold, metric), f"query_id {types[1]['id']}, id {types[0]['id']}, score double")


def cosine_counts(points: DataFrame, queries: DataFrame) -> DataFrame:
    """(similarity, n): how often each cosine, to six places, is there between even queries(id, v) and other even points(id, v); a value may come in several rows."""
    return meetings(_in_a_cell(queries), _in_a_cell(points), Counts, "similarity double, n long")


# --- DBSCAN


class Degrees:
    """The weight of the points within eps of each query, its own included."""

    def __init__(self, eps: float):
        self.eps = eps

    def start(self, rows) -> None:
        self.ids, self.q = rows.field("id").to_numpy(zero_copy_only=False), matrix(rows, "v")
        self.n = np.zeros(len(self.ids), dtype=np.int64)

    def take(self, rows) -> None:
        p, w = matrix(rows, "v"), rows.field("w").to_numpy(zero_copy_only=False)
        for a in range(0, len(self.ids), AT_ONCE):
            self.n[a : a + AT_ONCE] += within(self.q[a : a + AT_ONCE], p, self.eps) @ w

    def finish(self):
        return self.ids, self.n


def within(q: np.ndarray, p: np.ndarray, eps: float) -> np.ndarray:
    """Whether rows of q and p are at most eps apart, by their distance rounded to six places: no root is taken, so the bound is half a place beyond eps."""
    return squares(q, p) <= ((round(eps * 1e6) + 0.5) / 1e6) ** 2


class Links:
    """For a block of core points: links that span what its tiles join, and for each other point the nearest core within eps."""

    def __init__(self, eps: float):
        self.eps = eps

    def start(self, rows) -> None:
        self.ids, self.q = rows.field("id").to_numpy(zero_copy_only=False), matrix(rows, "v")
        self.label = np.arange(len(self.ids))  # the place of the group's first member
        self.out: list[tuple[np.ndarray, np.ndarray]] = []  # core points met, a member of the block each joins
        self.border: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def take(self, rows) -> None:
        ids, p, core = rows.field("id").to_numpy(zero_copy_only=False), matrix(rows, "v"), rows.field("core").to_numpy(zero_copy_only=False).astype(bool)
        best, who = np.full(len(ids), np.iinfo(np.int64).max), np.full(len(ids), -1)
        rows, cols = [], []
        for a in range(0, len(self.ids), AT_ONCE):
            q = self.q[a : a + AT_ONCE]
            near = within(q, p, self.eps)
            i, j = np.nonzero(near & core)
            rows.append((i + a).astype(np.int32))
            cols.append(j.astype(np.int32))
            at = np.flatnonzero(~core & near.any(axis=0))
            if len(at):  # the nearest core of each border point, of equal ones that of the smallest id
                part = np.where(near[:, at], np.rint(np.sqrt(squares(q, p[at])) * 1e6).astype(np.int64), np.iinfo(np.int64).max)
                least = part.min(axis=0)
                first = np.where(part == least, self.ids[a : a + AT_ONCE, None], np.iinfo(np.int64).max).min(axis=0)
                better = (least < best[at]) | ((least == best[at]) & (first < who[at]))
                at = at[better]
                best[at], who[at] = least[better], first[better]
        self.join(np.concatenate(rows), np.concatenate(cols), ids)
        on = who >= 0
        self.border.append((ids[on], who[on], best[on]))

    def join(self, i: np.ndarray, j: np.ndarray, ids: np.ndarray) -> None:
        """Points j of a tile join the members i of the block near them into one group: labels fall to the least of the group until none changes. Each point is given once."""
        if not len(i):
            return
        met, first = np.unique(j, return_index=True)
        self.out.append((ids[met], i[first]))
        while True:
            through = np.full(len(ids), len(self.ids))
            np.minimum.at(through, j, self.label[i])
            new = through[j]
            if (new >= self.label[i]).all():
                return
            np.minimum.at(self.label, self.label[i], new)  # the old group's first member goes along
            np.minimum.at(self.label, i, new)
            while not np.array_equal(up := self.label[self.label], self.label):
                self.label = up

    def finish(self):
        moved = np.flatnonzero(self.label != np.arange(len(self.ids)))
        a = [self.ids[moved], *(x for x, _ in self.out), *(x for x, _, _ in self.border)]
        b = [self.ids[self.label[moved]], *(self.ids[self.label[y]] for _, y in self.out), *(y for _, y, _ in self.border)]
        links = len(moved) + sum(len(x) for x, _ in self.out)
        d = np.concatenate([np.full(links, -1), *(z for _, _, z in self.border)]) / 1e6
        return np.concatenate(a), np.concatenate(b), d


def grid(v: Column, axes: np.ndarray, width: float) -> Column:
    """The cell of a vector: its projections on orthonormal axes, which are no further apart than the vectors, in steps of width."""
    from tessera.functions.vectors import dot

    return F.array(*(F.floor(dot(v, F.array(*map(F.lit, a.tolist()))) / F.lit(width)).cast("long") for a in axes))


def beside(cell: Column, n: int) -> Column:
    """A cell and those that touch it."""
    steps = F.array(*map(F.lit, (-1, 0, 1)))
    out = F.array(F.array().cast("array<bigint>"))
    for k in range(n):
        out = F.flatten(F.transform(out, lambda c: F.transform(steps, lambda s: F.array_append(c, F.get(cell, F.lit(k)) + s))))  # noqa: B023
    return out


def dbscan(vectors: DataFrame, eps: float, least: int = 5, id_col: str = "vec_id", vector: str = "embedding", axes: int = 2, seed: int = 1) -> DataFrame:
    """(id_col, cluster, is_core) of every vector: cluster is the smallest id of a core vector of its cluster, null for noise.

    A vector is core with `least` vectors within eps, itself included; cores within eps of each other share a cluster; another vector within eps of a core joins the nearest core's (of equally near
    ones that of the smallest id), by distances rounded to six places. Equal vectors count as often as they are there but meet others once. Rows without a vector are noise.

    Vectors meet only those in the same or a touching cell of a grid of `axes` random orthonormal projections, eps wide; it loses nothing, and parts as much as the vectors spread beyond eps.
    """
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector).alias("v"))
    members = written(rows.where("v IS NOT NULL"), "vectors")
    first = members.select(F.size("v").alias("d")).head()
    if first is None:
        return rows.select(F.col("id").alias(id_col), F.lit(None).cast("long").alias("cluster"), F.lit(False).alias("is_core"))
    directions = np.linalg.qr(np.random.default_rng(seed).normal(size=(first.d, min(axes, first.d))))[0].T
    classes = members.groupBy("v").agg(F.min("id").alias("id"), F.count("*").alias("w"))
    placed = written(classes.select(grid(F.col("v"), directions, eps).alias("cell"), "id", "v", "w"), "classes")
    near = lambda c: beside(c, len(directions))
    degree = meetings(placed.select("cell", "id", "v"), placed, lambda: Degrees(eps), "id long, n long", near).groupBy("id").agg(F.sum("n").alias("n"))
    known = written(placed.join(degree, "id").select("cell", "id", "v", (F.col("n") >= least).alias("core")), "cores")
    links = written(meetings(known.where("core").select("cell", "id", "v"), known, lambda: Links(eps), "a long, b long, d double", near), "links")
    labels = components(links.where("d < 0").select("a", "b"))
    cores = known.where("core").select("id").join(labels.withColumnRenamed("node", "id"), "id", "left").select("id", F.coalesce("label", "id").alias("cluster"))
    border = links.where("d >= 0").groupBy("a").agg(F.min(F.struct("d", "b")).alias("m")).select("a", F.col("m.b").alias("id"))
    named = cores.select("id", "cluster", F.lit(True).alias("is_core")).unionByName(border.join(cores, "id").select(F.col("a").alias("id"), "cluster", F.lit(False).alias("is_core")))
    own = placed.select(F.col("id").alias("first"), "v").join(named.withColumnRenamed("id", "first"), "first", "left")
    found = members.join(own, "v", "left").select(F.col("id").alias(id_col), "cluster", F.coalesce("is_core", F.lit(False)).alias("is_core"))
    return found.unionByName(rows.where("v IS NULL").select(F.col("id").alias(id_col), F.lit(None).cast("long").alias("cluster"), F.lit(False).alias("is_core")))


def dbscan_outliers(vectors: DataFrame, eps: float, least: int = 5, id_col: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(id_col, cluster, is_core, score) of dbscan(): score is the distance to the centre of one's cluster, for noise to the nearest centre; null where there is no centre or no vector."""
    found = written(dbscan(vectors, eps, least, id_col, vector), "clusters")
    own = vectors.select(id_col, F.col(vector).alias("_v")).join(found, id_col)
    places = own.where("cluster IS NOT NULL").select("cluster", F.posexplode("_v").alias("i", "x")).groupBy("cluster", "i").agg(F.avg(F.col("x").cast("double")).alias("x"))
    centres = written(places.groupBy("cluster").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("centre")), "centres")
    inside = own.join(centres, "cluster").select(id_col, "cluster", "is_core", l2(F.col("_v"), F.col("centre")).alias("score"))
    noise = own.where("cluster IS NULL")
    near = nearest(centres.select(F.col("cluster").alias("id"), F.col("centre").alias("v")), noise.select(F.col(id_col).alias("id"), F.col("_v").alias("v")), 1, "l2", "id", "v", other=False)
    beyond = noise.select(id_col, "cluster", "is_core").join(near.select(F.col("query_id").alias(id_col), F.col("distance").alias("score")), id_col, "left")
    return inside.unionByName(beyond).withColumn("score", F.round("score", 6))


# --- similar pairs by hyperplane blocking


def tables_for(n: int, threshold: float, recall: float, bucket: int = 512) -> tuple[int, int]:
    """Bits of a key, so that a bucket of n unrelated vectors has about `bucket`, and tables, so that a pair at the threshold meets in one of them with the given probability.

    The signs of a random projection agree for two vectors with probability 1 - angle / pi.
    """
    bits = max(2, min(30, math.ceil(math.log2(max(2, n / bucket)))))
    agree = (1 - math.acos(max(-1.0, min(1.0, threshold))) / math.pi) ** bits
    return bits, max(1, math.ceil(math.log(1 - recall) / math.log(1 - agree))) if agree < 1 else 1


class Similar:
    """Counts, or lists, the pairs of a bucket at the threshold or above that share no earlier table's key."""

    def __init__(self, threshold: float, listed: bool):
        self.threshold, self.listed = threshold, listed

    def start(self, rows) -> None:
        self.ids, self.q, self.keys = rows.field("id").to_numpy(zero_copy_only=False), matrix(rows, "v"), self.of(rows)
        self.table = rows.field("t").to_numpy(zero_copy_only=False)[0]
        self.n, self.out = np.zeros(len(self.ids), dtype=np.int64), []

    def of(self, rows) -> np.ndarray:
        keys = rows.field("keys")
        return keys.flatten().to_numpy(zero_copy_only=False).reshape(len(keys), -1)

    def take(self, rows) -> None:
        ids, p, keys = rows.field("id").to_numpy(zero_copy_only=False), matrix(rows, "v"), self.of(rows)
        for a in range(0, len(self.ids), AT_ONCE):
            score = np.rint((self.q[a : a + AT_ONCE] @ p.T) * 1e6)
            i, j = np.nonzero((score >= round(self.threshold * 1e6)) & (self.ids[a : a + AT_ONCE, None] != ids))
            for b in range(0, len(i), 1 << 18):  # so many pairs at once
                x, y = i[b : b + (1 << 18)], j[b : b + (1 << 18)]
                fresh = ~(self.keys[a + x, : self.table] == keys[y, : self.table]).any(axis=1)
                x, y = x[fresh], y[fresh]
                self.n[a : a + AT_ONCE] += np.bincount(x, minlength=len(self.n[a : a + AT_ONCE]))
                if self.listed:
                    up = self.ids[a + x] < ids[y]
                    self.out.append((self.ids[a + x][up], ids[y][up], score[x, y][up] / 1e6))

    def finish(self):
        if self.listed:
            return [np.concatenate(x) for x in zip(*self.out)] if self.out else [np.zeros(0, dtype=np.int64)] * 2 + [np.zeros(0)]
        on = self.n > 0
        return self.ids[on], self.n[on]


def _cells(batches: Iterator[pa.RecordBatch], cell: int = 0) -> Iterator[pa.StructArray]:
    """The rows of each cell, of batches in order of cells."""
    rest: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        values = batch.column(cell).to_numpy(zero_copy_only=False)
        cuts = [0, *(np.flatnonzero(np.diff(values)) + 1).tolist(), len(values)]
        for k, (i, j) in enumerate(zip(cuts, cuts[1:])):
            if rest and (k or rest[-1].column(cell)[-1].as_py() != values[0]):
                yield pa.concat_arrays([x.to_struct_array() for x in rest])
                rest = []
            rest.append(batch.slice(i, j - i))
    if rest:
        yield pa.concat_arrays([x.to_struct_array() for x in rest])


def _met(vectors: DataFrame, threshold: float, recall: float, listed: bool, seed: int, id_col: str, vector: str, most: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    spark = vectors.sparkSession
    ship(spark)
    parts = n_partitions(spark)
    members = written(vectors.where(F.col(vector).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(vector).alias("v")), "vectors")
    classes = written(members.groupBy("v").agg(F.min("id").alias("id")), "classes")
    bits, tables = tables_for(classes.count(), threshold, recall)

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes = None
        for batch in batches:
            if not batch.num_rows:
                continue
            v = matrix(batch.to_struct_array(), "v")
            size = np.sqrt((v * v).sum(axis=1, keepdims=True))
            v = np.divide(v, size, out=np.zeros_like(v), where=size > 0)
            if planes is None:
                planes = np.random.default_rng(seed).normal(size=(v.shape[1], tables * bits))
            keys = ((v @ planes) > 0).reshape(len(v), tables, bits) @ (1 << np.arange(bits))
            lists = lambda x, kind: pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * x.shape[1], pa.int32()), pa.array(x.ravel(), kind))
            yield pa.RecordBatch.from_arrays([batch.column(0), lists(v, pa.float64()), lists(keys, pa.int32())], ["id", "v", "keys"])

    def alone(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, n = [], 0
        for rows in _cells(batches):
            worker = Similar(threshold, listed)
            worker.start(rows)
            worker.take(rows)
            out.append(worker.finish())
            n += len(out[-1][0])
            if n > 1 << 16:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out)], names)
                out, n = [], 0
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out)], names)

    schema = "a long, b long, similarity double" if listed else "id long, n long"
    names = [x.split()[0] for x in schema.split(", ")]
    made = written(classes.select("id", "v").mapInArrow(keyed, "id long, v array<double>, keys array<int>"), "keyed")
    cell = (F.col("t").cast("long") * (1 << 32) + F.col("key")).alias("cell")
    sizes = made.select(F.posexplode("keys").alias("t", "key")).groupBy(cell).agg(F.count("*").alias("n")).where("n > 1")
    sizes = written(sizes, "sizes")  # a bucket of one meets nobody
    rows = made.select("id", "v", "keys", F.posexplode("keys").alias("t", "key")).select(cell, "id", "v", "keys", "t")
    # both sides dealt by cell, so that the rows move once and lie together
    dealt = rows.repartition(parts, "cell").join(sizes.where(F.col("n") <= most).repartition(parts, "cell").hint("shuffle_hash"), "cell")
    found = dealt.drop("n").sortWithinPartitions("cell").mapInArrow(alone, schema)
    large = sizes.where(F.col("n") > most)
    if not large.isEmpty():  # buckets of many close vectors: parted into blocks
        hot = written(rows.join(large.select("cell"), "cell"), "hot")
        found = found.unionByName(meetings(hot, hot.drop("t"), lambda: Similar(threshold, listed), schema, block=TILE))
    return members.join(classes.withColumnRenamed("id", "class_id"), "v").select(F.col("id").alias(id_col), "class_id"), found


def similar_pairs(vectors: DataFrame, threshold: float, recall: float = 0.95, seed: int = 7, id_col: str = "vec_id", vector: str = "embedding") -> tuple[DataFrame, DataFrame]:
    """Pairs (a, b, similarity) of different vectors with a cosine (rounded to six places) at the threshold or above, a < b, and the membership (id_col, class_id) of equal vectors.

    Equal vectors are one class, named by its smallest id; pairs are between classes. Vectors meet where the signs of their projections on random hyperplanes agree in one of several tables, so many that a pair
    at the threshold is found with probability `recall`, closer ones more surely; with n vectors some n^1.3 pairs are compared. A pair is given once, by the first table that has it.
    """
    members, found = _met(vectors, threshold, recall, True, seed, id_col, vector)
    return found, members


def similar_links(vectors: DataFrame, threshold: float, recall: float = 0.95, seed: int = 7, id_col: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(id_col, class_id, n_links): each vector's class of equal vectors and the number of other classes that similar_pairs() links it with. Links are counted where they are found; large groups of close
    vectors give no row a pair."""
    members, found = _met(vectors, threshold, recall, False, seed, id_col, vector)
    links = found.groupBy("id").agg(F.sum("n").alias("n_links")).withColumnRenamed("id", "class_id")
    return members.join(links, "class_id", "left").select(id_col, "class_id", F.coalesce("n_links", F.lit(0)).alias("n_links"))
