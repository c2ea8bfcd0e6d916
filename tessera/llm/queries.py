"""The queries of the corpus operators: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import decontaminate, html_extract, line_dedup, mixing, periodic, piecewise, quality, simhash, substring_dedup, suffix_dedup, token_records, url_filter, whitening


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = line_dedup.dedup(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def mixture() -> list[mixing.Level]:
    """The tree of the query and the pipeline: a domain by the source's number, the language, the source."""
    number = F.regexp_extract(F.coalesce("source", F.lit("")), "([0-9]+)$", 1)
    domain = F.when(number == "", "other").when(F.length(number) == 1, F.when(number < "5", "web").otherwise("books")).when(number < "15", "code").otherwise("news")
    return [
        mixing.Level("domain", domain, {"web": 40, "books": 30, "code": 20, "news": 10}, 1),
        mixing.Level("lang", F.col("lang"), {"en": 50, "de": 20, "fr": 20, "es": 10}, 1),
        mixing.Level("source", F.col("source"), {}, 1),
    ]


def op2_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.plan(_table(spark, sf_dir, "documents"), mixture(), per_cent=80, epochs=2, seed=1).drop("row")


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality.judge(_table(spark, sf_dir, "documents")).drop("row")
    return found.withColumns({c: F.round(c, 4) for c in ("js_chars", "js_words")})


def op4_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extracted(_table(spark, sf_dir, "pages"))


def op5_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.report(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return found.drop("hit_words", "items")


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.dedup(_table(spark, sf_dir, "documents"), texts=False)


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(_table(spark, sf_dir, "pages")).drop("score")


def op8_token_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return token_records.read(spark, token_records.write(docs, tokenizer_path(), end_id=1))


def op9_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.cluster(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")


def op10_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.dedup(_table(spark, sf_dir, "documents"), texts=False)


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic.report(periodic.detect(periodic.tail_repeated(_table(spark, sf_dir, "documents"))))


def op12_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.report(_table(spark, sf_dir, "embeddings"), k=8)


def op13_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piecewise.report(_table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_line_dedup, op2_source_mixing, op3_quality_rules, op4_html_extraction, op5_benchmark_decontamination, op6_substring_dedup, op7_url_filter, op8_token_records, op9_simhash_near_dedup, op10_suffix_array_dedup, op11_periodic_runs, op12_embedding_whitening, op13_document_fingerprints)}


def oracle_sql() -> dict[str, str]:
    from tessera.llm import oracles

    return oracles.SQL
