"""A corpus pipeline: five stages over documents, each over all that the one before has kept.

STAGES lists (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame. All but the last return the
columns of documents. Between stages the rows are written as Parquet in the shared folder and read again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sitequarry.llm import decontaminate, jaccard, langid, pieces, quality
from sitequarry.llm.queries import piece_model
from sitequarry.plans.lineage import drop_cut, settled

#: Bits within which the SimHash search proposes near copies.
NEAR_BITS = 3


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents whose language is identified."""
    return langid.keep_identified(docs)


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents that the quality classifier accepts."""
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest id of each group of near copies: SimHash over five-word shingles, verified and completed by exact Jaccard similarity of 0.8 or more."""
    return jaccard.keep_one(docs, words=5, least=0.8, radius=NEAR_BITS)


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents in which no benchmark item occurs."""
    return decontaminate.keep_clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Encodes and decodes: doc_id, n_tokens and digests of ids, decoded text and spans."""
    return pieces.op3(docs, piece_model())


STAGES = [("language", language), ("quality", good), ("near_copies", near_copies), ("decontaminate", clean), ("tokens", tokens)]

#: SQL can express neither the classifiers nor the tokenizer; the pipeline is tested against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        before = docs
        docs = settled(lambda stage=stage, docs=docs: stage(spark, docs, sf_dir))
        drop_cut(before)
    return STAGES[-1][1](spark, docs, sf_dir)
