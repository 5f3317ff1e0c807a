"""One query per operator, over its whole table, in the form of its contract."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from plantlens.llm.collocations import COLLOCATION_SQL, collocations
from plantlens.llm.common import table
from plantlens.llm.fill_in_middle import FIM_SQL, digests
from plantlens.llm.metric_join import metric_join
from plantlens.llm.mixing import MIX_SQL, mix
from plantlens.llm.ngram_join import ngram_join
from plantlens.llm.packing import pack
from plantlens.llm.pii import pii
from plantlens.llm.quality_classifier import quality_classifier
from plantlens.llm.quality_rules import quality_rules
from plantlens.llm.token_counts import token_counts
from plantlens.llm.top_search import TOP_SQL, top_search
from plantlens.llm.toxicity import toxicity
from plantlens.llm.warc import WARC_SQL, warc_round_trip

VOCAB = public_tokenizers.path("word_bpe_49k.json")


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"), VOCAB)


def op2_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join(table(spark, sf_dir, "documents"))


def op3_quality_bayes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_classifier(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii(table(spark, sf_dir, "documents"))


def op5_hilbert_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), VOCAB)


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc_round_trip(table(spark, sf_dir, "pages"))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_curriculum_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_metric_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metric_join(table(spark, sf_dir, "embeddings"))


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"))


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))


def op13_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_search(table(spark, sf_dir, "embeddings"))


QUERIES = {f.__name__: f for f in (op1_token_counts, op2_ngram_join, op3_quality_bayes, op4_pii, op5_hilbert_packing, op6_warc, op7_quality_rules, op8_curriculum_mix, op9_toxicity, op10_metric_join, op11_fill_in_middle, op12_collocations, op13_topk_search)}

#: What plain SQL can say over whole tables; tests/llm holds the others against brute force.
ORACLE_SQL: dict[str, str] = {"op6_warc": WARC_SQL, "op8_curriculum_mix": MIX_SQL, "op11_fill_in_middle": FIM_SQL, "op12_collocations": COLLOCATION_SQL, "op13_topk_search": TOP_SQL}
