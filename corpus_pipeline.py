"""A corpus from raw documents to tokens, in five stages.

Each stage takes (spark, docs, sf_dir), where docs is what the stage before
it kept, and returns a DataFrame. All but the last return the columns of
documents. Mixing orders and drops nothing: documents beyond the schedule
follow those in it. SQL can't express the trained stages, so there is no ORACLE_SQL.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quadloom.llm import bpe, common, jaccard, mixing, quality, toxicity


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def remove_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.keep(docs, toxicity.fit(docs, _labels(spark, sf_dir)))


def remove_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep(docs, quality.fit(docs, _labels(spark, sf_dir)))


def remove_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard.keep_one(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.order_documents(docs, rest=True)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.encode(docs)


STAGES = [
    ("toxicity", remove_toxic),
    ("quality rules", remove_low_quality),
    ("n-gram Jaccard join", remove_near_copies),
    ("mixing sources to target weights", mix_sources),
    ("byte-level BPE encoding and decoding", tokenize),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each one's result written as Parquet and read again for the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    scratch = common.Scratch(spark)
    for k, (_, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if k == len(STAGES) - 1:
            return out
        before, docs = docs, scratch.table(out)
        scratch.drop(before)
        common.release(out)
