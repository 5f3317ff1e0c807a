"""The corpus pipeline: stages over `documents`, each written as Parquet and reread by the next.

Toxic documents go; one document of each group of near-duplicates stays;
personal data is masked; the sources are mixed to their target weights along
the curriculum; what is left is packed into training sequences.

Edge cases are those of the operators: each stage takes what its predecessor
kept, an empty table passes through as an empty one, and rows with a null text
stay until the mix, which takes words and so takes nothing of them.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from plantlens.llm.common import saved, shared_dir, table
from plantlens.llm.mixing import mixed_documents
from plantlens.llm.ngram_join import one_of_each
from plantlens.llm.packing import pack
from plantlens.llm.pii import redacted_documents
from plantlens.llm.toxicity import without_toxic
from plantlens.sources.scratch import scratch


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return without_toxic(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return one_of_each(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return redacted_documents(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixed_documents(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("toxicity", toxicity), ("near_duplicates", near_duplicates), ("personal_data", personal_data), ("mixing", mixing), ("packing", packing)]

#: No SQL expresses a trained network or a vocabulary's merges; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        kept = shared_dir(spark)
        # a stage's own intermediate tables go once its result is written
        with scratch(spark):
            docs = saved(stage(spark, docs, sf_dir), kept)
    return STAGES[-1][1](spark, docs, sf_dir)
