"""A training corpus from `documents`, stage by stage.

1. language: documents whose language the compression classifier rejects go.
2. near duplicates: of each group linked by word shingles (5 words, similarity 0.8) the smallest id stays.
3. decontamination: documents that hold a benchmark window go.
4. secrets: what the ledger's rules find is redacted, and n_chars follows.
5. encoding: ids of the SentencePiece vocabulary.

Every stage reads all that its predecessor kept. No SQL: language and encoding cannot be expressed in it.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetlens.llm import decontaminate, jaccardjoin, langid, secretledger, sentencepieces
from fleetlens.llm.batches import aside, named_back
from fleetlens.session import cut_lineage, scratch


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return langid.keep_identified(docs, langid.fit(docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccardjoin.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    docs, names = aside(docs, ["spans", "blob"])
    ledger = secretledger.Ledger(spark, scratch(spark, "ledger"))
    ledger.update(docs)
    clean = secretledger.redact(ledger.of_paths(docs))
    n_chars = F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text").cast("bigint"))
    return named_back(clean.withColumn("n_chars", n_chars), names)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return sentencepieces.encode(docs, public_tokenizers.path("piece_bpe_32k.model"), keep=["doc_id"])


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language", language), ("near_duplicates", near_duplicates), ("decontamination", decontamination),
    ("secrets", secrets), ("encoding", encoding),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to documents; each result is written as Parquet and read again by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = cut_lineage(stage(spark, docs, sf_dir), name)
    return docs
