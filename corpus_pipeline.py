"""A training-data pipeline over the table documents: each stage works on all that the one before it kept."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.llm import decontamination, packing, quality_classifier, secret_scan, simhash, token_counts
from quillstone.llm.common import documents, materialise, tuned


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go."""
    tuned(spark)
    model = quality_classifier.train(documents(spark, sf_dir), documents(spark, sf_dir, "labels"))
    return quality_classifier.reject_low_quality(docs, model)


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates one document stays, that with the least doc_id."""
    tuned(spark)
    return simhash.dedup(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain a benchmark item go."""
    tuned(spark)
    return decontamination.drop_contaminated(docs, documents(spark, sf_dir, "benchmark"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are cut from the texts; every document stays."""
    tuned(spark)
    return secret_scan.redact(docs, F.concat_ws("/", "source", "lang"), F.col("source"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each chunk of each document with its bin; lengths are tokens of a public tokenizer, and one end for a text that has any."""
    tuned(spark)
    counted = token_counts.count_tokens(docs, public_tokenizers.path("piece_bpe_32k.model"))
    return packing.pack(counted.select("doc_id", (F.col("n_tokens") + (F.col("n_tokens") > 0).cast("bigint")).alias("n_tokens")))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality classifier", keep_quality),
    ("SimHash near-dedup", keep_one_of_each_group),
    ("benchmark decontamination", drop_contaminated),
    ("secret scans", redact_secrets),
    ("best-fit packing", pack),
]

#: Learned models and near-duplicate groups cannot be put into SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to documents; each one's rows are written and read again."""
    docs = documents(spark, sf_dir)
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialise(docs, name.replace(" ", "-"))
    return docs
