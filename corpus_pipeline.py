"""Training-data pipeline: classify, apply quality rules, deduplicate, mix to target weights, pack.

Every stage takes (spark, docs, sf_dir), works on all that the stage before kept and returns a DataFrame,
which is written as Parquet and read again as the next one's docs. All but the last keep the columns of
documents. The steps are not SQL (fitted models, sketches, tokenizers), so there is no SQL twin; the tests
hold each stage against a plain version.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sparkloom.llm import gam, kneser_ney, mixing, near_dedup, packing
from sparkloom.llm.common import store
from sparkloom.llm.queries import MIXTURE, table
from sparkloom.llm.tokens import tokenizer_path

ORACLE_SQL = None


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the additive model, fitted on ``labels``, gives a score of at least 0.3."""
    return gam.keep_good(docs, table(spark, sf_dir, "labels"))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the text rules and lie within the perplexity limits of their language."""
    return kneser_ney.keep_fluent(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by a similarity of 0.8 on runs of five words."""
    return near_dedup.keep_one(docs, size=5, percent=80)


def mixing_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token-prefixes of seeded epochs; a document taken in several epochs comes several times."""
    return mixing.mixed_rows(docs, MIXTURE)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Boundary records of the sequences of 2048 tokens."""
    return packing.pack(docs, tokenizer_path("byte_bpe_50k.json"))


STAGES = [("quality_classifier", quality_classifier), ("quality_rules", quality_rules), ("near_duplicates", near_duplicates),
          ("mixing_weights", mixing_weights), ("packing", pack_sequences)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = store(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
