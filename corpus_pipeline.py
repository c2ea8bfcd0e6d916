"""A training-corpus pipeline: five of the corpus operators, one after another, each written to Parquet and read again.

1. quality: documents that the quality rules reject go
2. near_duplicates: of each SimHash group one document stays
3. decontaminate: documents that hold a window of a benchmark item go
4. mix: documents are left out or repeated so that domains, languages and sources come near their weights
5. tokens: the texts become token records; the result says where each record lies
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessera.llm import decontaminate, mixing, quality, simhash, token_records
from tessera.llm.queries import mixture, tokenizer_path
from tessera.llm.shared import written


def _quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep(docs)


def _near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.keep_one(docs)


def _decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.keep(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def _mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs, mixture(), per_cent=80, epochs=2, seed=1)


def _tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return token_records.read(spark, token_records.write(docs, tokenizer_path(), end_id=1))


STAGES = [("quality", _quality), ("near_duplicates", _near_duplicates), ("decontaminate", _decontaminate), ("mix", _mix), ("tokens", _tokens)]
#: SQL has no XXH64 with a seed, and no tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every record that comes of sf_dir's documents.

    Documents without a text or with fewer than ten words are rejected by the first stage; those without an id pass like any other and have a null doc_id in the result, where
    they come first. Of exact repeats and near copies one row stays. A null language is not judged by distance; null languages and sources are leaves of their own in the mixture. Columns beyond those
    of documents pass through all stages but the last, whatever their names. Null and wordless benchmark items hit nothing. Empty tables give no record.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
