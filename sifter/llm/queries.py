"""The registered queries of the training-data operators, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sifter.llm import chat_tools, language_id, merge_dropout, near_dedup, packing, quality_rules, secret_scan, suffix_tree, topk_search, warc
from sifter.llm.common import shared_dir


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, rules = _table(spark, sf_dir, "documents"), quality_rules.QualityRules()
    weights = quality_rules.fit(docs, _table(spark, sf_dir, "labels"), rules)
    return quality_rules.score(docs, weights, rules)


def op1_merge_dropout(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merge_dropout.encode_documents(_table(spark, sf_dir, "documents"))


def op2_suffix_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_tree.score(_table(spark, sf_dir, "documents"))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(_table(spark, sf_dir, "documents"))


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.digest(secret_scan.scan_secrets(_table(spark, sf_dir, "documents")))


def op6_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk_search.search(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed_documents(_table(spark, sf_dir, "documents"))


def op7_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.classes(_table(spark, sf_dir, "documents"))


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_dir(spark)
    warc.write(warc.records(_table(spark, sf_dir, "pages")), path)
    return warc.round_trip(spark, path)


def op9_chat_tools(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls, results = chat_tools.from_turns(_table(spark, sf_dir, "conversations"))
    return chat_tools.link(calls, results, chat_tools.TURN_SCHEMAS)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_merge_dropout": op1_merge_dropout,
        "op2_suffix_tree": op2_suffix_tree,
        "op3_language_id": op3_language_id,
        "op4_secret_scan": op4_secret_scan,
        "op5_quality_rules": op5_quality_rules,
        "op6_topk_search": op6_topk_search,
        "op7_near_dedup": op7_near_dedup,
        "op8_warc": op8_warc,
        "op9_chat_tools": op9_chat_tools,
        "op10_best_fit_packing": op10_best_fit_packing,
    }


def oracle_sql() -> dict[str, str]:
    return {"op4_secret_scan": secret_scan.sql(), "op6_topk_search": topk_search.sql(), "op8_warc": warc.sql(), "op9_chat_tools": chat_tools.sql()}
