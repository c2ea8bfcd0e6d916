"""Sums over the words that queries and documents share, as products of matrices.

Words have numbers. Documents lie in tiles, one row each: the numbers and counts of their words, one document after another. A task holds a block of queries, streams tiles (see neighbours.meet()) and lets out k
rows a query. Queries lie in such tiles as well, of which a block has some. In a tile, words that many of its documents and many of the queries have are columns of two dense matrices; each other word adds its few pairs alone. No pair becomes a row.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators import neighbours
from tessera.session import ship
from tessera.tables import n_partitions, written

#: Words of a tile, its documents, and its queries.
ENTRIES, TILE, AT_ONCE = 1 << 19, 1024, 1024
#: A pair of a word that adds its pairs alone costs as much as so many products of a matrix; most columns of a matrix; pairs added at once.
ALONE, COLUMNS, PAIRS = 64, 4096, 1 << 19


def parts(variant: str, idf, tf, length, k1: float, delta: float):
    """What one occurrence of a word in the query adds to a document's score; for columns as for arrays."""
    if variant == "l":
        return idf * (k1 + 1) * (tf / length + delta) / (k1 + tf / length + delta)
    return idf * tf * (k1 + 1) / (tf + k1 * length)


def five(x: np.ndarray) -> np.ndarray:
    """Five places, halves away from zero."""
    return np.trunc(x * 1e5 + np.copysign(0.5, x)) / 1e5 + 0.0


class Asked:
    """Some queries by word: the words' numbers in order, and of each the queries that have it and how often."""

    def __init__(self, n: int, words: np.ndarray, idf: np.ndarray, q: np.ndarray, at: np.ndarray, qtf: np.ndarray, delta: float):
        order = np.argsort(at, kind="stable")
        self.words, self.idf, self.q, self.qtf = words.astype(np.int64), idf, q[order], qtf[order].astype(float)
        self.having = np.bincount(at, minlength=len(words))
        self.start = np.cumsum(self.having) - self.having
        self.n, self.floor = n, delta * np.bincount(q, qtf * idf[at], minlength=n)

    def pairs(self, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For words at places `of`, one after another: which of them each pair with a query is of, and the pair's place in q and qtf."""
        many = self.having[of]
        who = np.repeat(np.arange(len(of)), many)
        return who, np.arange(len(who)) + np.repeat(self.start[of] - np.cumsum(many) + many, many)

    def sums(self, doc: np.ndarray, at: np.ndarray, value: np.ndarray, n_docs: int) -> np.ndarray:
        """The sum of qtf * value over shared words for each query and document, of documents' words at places `at`."""
        met = np.bincount(at, minlength=len(self.words)) * self.having
        dense = np.flatnonzero(met * ALONE > n_docs * self.n)
        dense = dense[np.argsort(-met[dense], kind="stable")[:COLUMNS]]
        column = np.full(len(self.words), -1)
        column[dense] = np.arange(len(dense))
        own = column[at]
        on = own >= 0
        theirs, ours = np.zeros((len(dense), n_docs)), np.zeros((self.n, len(dense)))
        theirs[own[on], doc[on]] = value[on]
        who, place = self.pairs(dense)
        ours[self.q[place], who] = self.qtf[place]
        out = ours @ theirs
        doc, at, value = doc[~on], at[~on], value[~on]
        ends = np.cumsum(self.having[at])
        a = 0
        while a < len(at):
            b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + PAIRS, "right")))
            who, place = self.pairs(at[a:b])
            out += np.bincount(self.q[place] * n_docs + doc[a:b][who], self.qtf[place] * value[a:b][who], minlength=out.size).reshape(out.shape)
            a = b
        return out


class Best(neighbours.Top):
    """The k documents of highest score (five places) with each query among those that share a word with it, of equal ones those of the smallest id."""

    def __init__(self, k: int, variant: str, k1: float, delta: float):
        self.k, self.variant, self.k1, self.delta = k, variant, k1, delta

    def start(self, rows) -> None:
        ids = rows.field("ids")
        self.ids = ids.flatten().to_numpy(zero_copy_only=False)
        self.best, self.found, self.asked = np.full((len(self.ids), self.k), -np.inf), None, []
        for tile, size in enumerate(ids.value_lengths().to_pylist()):
            n, idf, words, code, qtf = (numbers(rows, c, tile) for c in ("n", "weight", "words", "code", "tf"))
            self.asked.append(Asked(size, words, idf, np.repeat(np.arange(size), n), code, qtf, self.delta if self.variant == "plus" else 0.0))

    def take(self, rows) -> None:
        ids, (n, length, words, code, tf) = rows.field("ids").flatten().to_numpy(zero_copy_only=False), (numbers(rows, c) for c in ("n", "weight", "words", "code", "tf"))
        if self.found is None:
            self.found = np.full(self.best.shape, "" if ids.dtype == object else -1, dtype=ids.dtype)
        doc = np.repeat(np.arange(len(ids)), n)
        b = 0
        for asked in self.asked:
            a, b = b, b + asked.n
            place = np.minimum(np.searchsorted(asked.words, words), len(asked.words) - 1)
            at = np.where(asked.words[place] == words, place, -1)[code]
            on = at >= 0
            at, own = at[on], doc[on]
            value = parts(self.variant, asked.idf[at], tf[on].astype(float), length[own], self.k1, self.delta)
            scores = asked.sums(own, at, value, len(ids))
            shared = scores > 0 if (value > 0).all() else asked.sums(own, at, np.ones(len(at)), len(ids)) > 0
            scores += asked.floor[:, None]
            on = shared & (scores >= self.best[a:b, -1][:, None] - 1e-5)  # rounding moves half of that
            if len(ids) > self.k and np.count_nonzero(on) > 8 * self.k * len(on):  # the tile's own k-th best of each query first
                kth = np.partition(np.where(on, scores, -np.inf), len(ids) - self.k, axis=1)[:, len(ids) - self.k]
                on &= scores >= kth[:, None] - 1e-5
            i, j = np.nonzero(on)
            for s in range(0, len(i), neighbours.SLICE):
                row, col = i[s : s + neighbours.SLICE], j[s : s + neighbours.SLICE]
                self.merge(a, row, five(scores[row, col]), ids[col])


def numbers(rows: pa.StructArray, name: str, tile: int = 0) -> np.ndarray:
    """The numbers in a tile's field, whose bytes come after a letter for their type."""
    held = rows.field(name)[tile].as_buffer()
    return np.frombuffer(held, chr(held[0]), offset=8)


def held(x: np.ndarray) -> pa.Array:
    """Numbers as numbers() reads them; whole ones in as few bytes as the largest needs. Bytes go through Spark as they are, lists number by number."""
    if x.dtype.kind in "iu":
        x = x.astype(np.min_scalar_type(int(x.max(initial=0))))
    return pa.array([x.dtype.char.encode().ljust(8) + x.tobytes()], pa.binary())


def tiles(words: DataFrame, by_word: bool = False) -> DataFrame:
    """(rows): words(id, weight, t, tf), in which the words of an id follow each other, as tiles of TILE documents (by_word: AT_ONCE queries) and ENTRIES words at most, or one document: the documents' ids, numbers of words and weights (by_word: the
    words' weights), the tile's different words, and of each document's words which of them it is and how often it is there."""
    kind, most = dict(words.dtypes)["id"], AT_ONCE if by_word else TILE
    names = ["n", "weight", "words", "code", "tf"]
    schema = f"rows array<struct<ids:array<{kind}>,{','.join(f'{c}:binary' for c in names)}>>"

    def tile(ids, *columns: np.ndarray) -> pa.RecordBatch:
        own = [pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids), *(held(x) for x in columns)]
        return pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array([0, 1], pa.int32()), pa.StructArray.from_arrays(own, ["ids", *names]))], ["rows"])

    def cut(rows: pa.Table, last: bool) -> Iterator[pa.RecordBatch | pa.Table]:
        """Tiles of whole documents, and then the rows of the last one, which may go on."""
        ids, (weight, t, tf) = rows.column(0).combine_chunks(), (c.to_numpy() for c in rows.columns[1:])
        key = ids.to_numpy(zero_copy_only=False)
        first = np.concatenate(([0], np.flatnonzero(key[1:] != key[:-1]) + 1))
        ends = np.append(first[1:], rows.num_rows)
        whole = len(first) if last else len(first) - 1
        for a in range(0, whole, most):
            b = min(whole, a + most)
            s, e = first[a], ends[b - 1]
            own, at, code = np.unique(t[s:e], return_index=True, return_inverse=True)
            yield tile(ids.take(pa.array(first[a:b])), (ends - first)[a:b], weight[s + at if by_word else first[a:b]], own, code, tf[s:e])
        if not last:
            yield rows.slice(first[whole])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting, n, full = [], 0, ENTRIES
        for batch in batches:
            waiting.append(batch)
            n += batch.num_rows
            if n >= full:
                *made, rest = cut(pa.Table.from_batches(waiting), False)
                yield from made
                waiting, n = rest.to_batches(), rest.num_rows
                full = n + ENTRIES
        if n:
            yield from cut(pa.Table.from_batches(waiting), True)

    ship(words.sparkSession)
    return words.mapInArrow(run, schema)


def _blocks(queries: DataFrame) -> DataFrame:
    """(cell, h, rows): queries(query_id, t, qtf, idf) as blocks of tiles, of neighbours.BLOCK queries or so. Numbers in bytes are a fraction of the words as rows, and a block goes to many tasks."""
    size = queries.agg(F.count("*").alias("words"), F.count_distinct("query_id").alias("n")).first()
    parts = max(1, -(-size.words // ENTRIES), -(-5 * size.n // (4 * AT_ONCE)))  # of less than a tile each, mostly
    rows = queries.select(F.col("query_id").alias("id"), "idf", "t", F.col("qtf").alias("tf")).repartition(parts, "id").sortWithinPartitions("id", "t")
    lain = written(tiles(rows, True), "asked_tiles")
    blocks = max(1, -(-size.n // neighbours.BLOCK))
    h = F.pmod(F.xxhash64(F.col("rows")[0]["ids"][0]), F.lit(blocks))
    return lain.groupBy(F.lit(0).alias("cell"), h.alias("h")).agg(F.flatten(F.collect_list("rows")).alias("rows"))


def best(words: DataFrame, n_docs: int, queries: DataFrame, k: int, variant: str, k1: float, delta: float) -> DataFrame:
    """(query_id, id, score): at least the k best documents of words(id, length, t, tf) for each of queries(query_id, t, qtf, idf); score as retrieval.bm25() has it, to five places. The words of an id follow each other."""
    spark = words.sparkSession
    types = dict(queries.dtypes)["query_id"], dict(words.dtypes)["id"]
    asked = written(_blocks(queries), "blocks")
    told = tiles(words).select(F.lit(0).alias("cell"), F.xxhash64(F.col("rows")[0]["ids"][0]).alias("h"), "rows")
    slices = max(1, min(-(-n_partitions(spark) // max(1, asked.count())), -(-n_docs // TILE)))
    make: Callable = lambda: Best(k, variant, k1, delta)
    return neighbours.meet(asked, told, slices, make, f"query_id {types[0]}, id {types[1]}, score double")
