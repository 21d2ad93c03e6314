"""Registered queries of this package, each over its whole table, with SQL twins where SQL can express them."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from sparkloom.llm import gam, kneser_ney, lexical_search, mixing, near_dedup, packing, pivot_search, suffix_tree, token_counts, token_files, url_filter, warc, whitening
from sparkloom.llm.common import folder
from sparkloom.llm.tokens import tokenizer_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

URL_RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"),
             ("allow", "com", "/fr/"), ("block", "com", "/de/")]


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


@query("op2_url_filter", url_filter.verdict_sql(URL_RULES))
def op2_url_filter(spark, sf_dir):
    return url_filter.judge_urls(table(spark, sf_dir, "pages"), URL_RULES)


@query("op8_quality_gam")
def op8_quality_gam(spark, sf_dir):
    return gam.score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op4_token_counts")
def op4_token_counts(spark, sf_dir):
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))


@query("op6_token_files")
def op6_token_files(spark, sf_dir):
    path = f"{folder(spark)}/token-files-{uuid.uuid4().hex}"
    token_files.write_token_files(table(spark, sf_dir, "documents"), path, tokenizer_path("word_bpe_49k.json"))
    return token_files.token_digest(token_files.with_start(token_files.read_token_files(spark, path)))


@query("op7_packing")
def op7_packing(spark, sf_dir):
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))


@query("op1_suffix_tree")
def op1_suffix_tree(spark, sf_dir):
    return suffix_tree.score_documents(table(spark, sf_dir, "documents"))


@query("op10_kneser_ney")
def op10_kneser_ney(spark, sf_dir):
    return kneser_ney.judge_documents(table(spark, sf_dir, "documents"))


@query("op5_pivot_search")
def op5_pivot_search(spark, sf_dir):
    return pivot_search.top_k(table(spark, sf_dir, "embeddings"), F.col("id") % 100 == 0)


MIXTURE = mixing.Mixture(
    weights={("crawl",): 1.0, ("collections",): 3.0, ("crawl", "en"): 2.0, ("collections", "en"): 2.0, ("collections", "es"): 0.5},
    domains={"src0": "crawl"}, share=1.0, max_epochs=2, seed=7)


@query("op9_mixing", mixing.mixture_sql(MIXTURE))
def op9_mixing(spark, sf_dir):
    return mixing.mix_documents(table(spark, sf_dir, "documents"), MIXTURE)


@query("op3_setsketch_dedup")
def op3_setsketch_dedup(spark, sf_dir):
    return near_dedup.link_documents(table(spark, sf_dir, "documents"), size=4).drop("class_id", "row")


@query("op11_warc_zstd", warc.archive_sql())
def op11_warc_zstd(spark, sf_dir):
    path = f"{folder(spark)}/archives-{uuid.uuid4().hex}"
    warc.write_archives(table(spark, sf_dir, "pages"), path)
    records = warc.read_archives(spark, path, strict=True, with_payload=False)
    return records.select(warc.page_of(F.col("record_id")).alias("page_id"), "payload_bytes", "payload_digest", "record_type",
                          warc.page_of(F.col("refers_to")).alias("refers_to"))


@query("op12_lexical_search", lexical_search.search_sql())
def op12_lexical_search(spark, sf_dir):
    return lexical_search.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op13_feast_whitening")
def op13_feast_whitening(spark, sf_dir):
    return whitening.whiten(table(spark, sf_dir, "embeddings"))
