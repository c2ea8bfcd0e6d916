"""Whole plans: hybrid retrieval for a batch of queries, and preparation of a corpus."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators import chunking, fusion, retrieval

STRATEGIES = ("vector", "bm25", "keyword", "bm25_vector", "vector_keyword", "rrf", "weighted", "contextual")


@dataclass
class Retriever:
    """Eight strategies over documents(doc_id, text) and vectors(doc_id, embedding). Queries are (query_id, query, vector).

    where: a condition on documents or vectors that holds before anything is ranked. threshold: applied after the limit.
    rerank: any function of results to (query_id, id, score), such as a model behind a pandas UDF.
    """

    docs: DataFrame
    vectors: DataFrame
    strategy: str = "bm25_vector"
    metric: str = "cosine"
    weights: tuple[float, float] = (0.5, 0.5)
    threshold: float | None = None
    rerank: Callable[[DataFrame], DataFrame] | None = None
    id_col: str = "doc_id"
    #: Searches by name (vector, bm25, keyword) that take the place of the built-in ones: functions of (queries, k) to (query_id, id, score, rank).
    searches: dict[str, Callable[[DataFrame, int], DataFrame]] = field(default_factory=dict)
    #: For the contextual strategy: a column function text -> vector, and a template for queries.
    embed: Callable[[Column], Column] | None = None
    template: str = "{query}"

    def _vector(self, queries: DataFrame, k: int) -> DataFrame:
        return retrieval.vector_scores(queries.select("query_id", "vector"), self.vectors, self.metric, None, self.id_col, k=k)

    def _bm25(self, queries: DataFrame, k: int) -> DataFrame:
        return retrieval.bm25(queries, self.docs, id_col=self.id_col, k=k)

    def _keyword(self, queries: DataFrame, k: int) -> DataFrame:
        return retrieval.keyword(queries, self.docs, self.id_col, k=k)

    def retrieve(self, queries: DataFrame, limit: int) -> DataFrame:
        """(query_id, id, score, rank). Fused strategies take twice the limit of each list first."""
        single = {"vector": self._vector, "bm25": self._bm25, "keyword": self._keyword} | self.searches
        if self.strategy in single:
            out = fusion.ranked(single[self.strategy](queries, limit), limit)
        else:
            v = single["vector"](queries, 2 * limit)
            if self.strategy == "contextual" and self.embed:  # what the vector search found, scored again by content
                other = retrieval.rescored(v, queries, self.docs, self.embed, self.template, 2 * limit, self.id_col)
            else:
                other = single["keyword" if self.strategy == "vector_keyword" else "bm25"](queries, 2 * limit)
            if self.strategy == "rrf":
                out = fusion.rrf([v, other], limit, weights=self.weights)
            elif self.strategy == "weighted":
                out = fusion.ensemble([fusion.min_max(v), fusion.min_max(other)], limit, self.weights)
            elif self.strategy == "contextual":
                out = fusion.combine(fusion.min_max(v), fusion.min_max(other), limit, *(("linear", *self.weights) if self.embed else ("max",)))
            else:
                out = fusion.combine(fusion.min_max(v), fusion.min_max(other), limit, "linear", *self.weights)
        if self.threshold is not None:
            out = out.where(F.col("score") >= self.threshold)
        return fusion.rerank(out, self.rerank(out), limit) if self.rerank else out


def prepare(docs: DataFrame, id_col: str = "doc_id", text: str = "text", clean: Callable[[Column], Column] = T.clean_standard, size: int = 400, overlap: int = 40) -> DataFrame:
    """Clean, describe and chunk: id_col, n_chars, n_words, n_lines, reading_minutes, chunk_index, chunk_count, content. One pass, no shuffle."""
    made = T.let(clean(F.col(text)), lambda t: F.struct(T.basic_metadata(t).alias("m"), chunking.fixed(t, size, overlap).alias("c")))
    described = docs.select(id_col, made.alias("_d")).select(id_col, "_d.m.*", F.col("_d.c").alias("_c"))
    return chunking.numbered(described, F.col("_c"), [id_col, "n_chars", "n_words", "n_lines", "reading_minutes"])


def tuned(weights: dict[str, float], gains: dict[str, float], rate: float = 0.1, least: float = 0.1, most: float = 0.9) -> dict[str, float]:
    """Weights moved by rate times each one's measure, kept in range, summing to 1 again."""
    moved = {k: min(most, max(least, w + rate * gains.get(k, 0.0))) for k, w in weights.items()}
    return {k: v / sum(moved.values()) for k, v in moved.items()}
