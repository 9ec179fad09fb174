"""A corpus pipeline of five stages, each one operator of sifter.llm.

Language ID drops documents without a language or with a doubtful one, quality rules drop those
that fail, near-dedup keeps one document of each class, the secret scan replaces every secret in
the text by a mark, and packing places the tokens of what is left in sequences. All stages but
the last return the columns of documents. run() writes each stage's rows to the shared folder.

What a stage leaves in the shared folder is deleted when the next one starts, as its rows have been
written by then; tables that the next one's docs still read stay.

Defined cases, for every stage: rows with nulls in any column, repeated rows and repeated ids each
count as rows of their own; null and empty texts have no language and go in the first stage; very
long texts are taken whole; an empty table gives no rows; columns that documents does not have are
left out. See the operators for theirs.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sifter.llm import language_id, near_dedup, packing, quality_rules, secret_scan
from sifter.llm.common import released, staged, watched

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Documents whose language scores less than this are rejected.
MIN_LANGUAGE_SCORE = 0.5


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
_LEFT: list[str] = []


def _tidy(stage: Stage) -> Stage:
    """The stage, before which what earlier ones left is deleted."""

    @wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        _LEFT[:] = released(_LEFT, docs)
        with watched() as made:
            out = stage(spark, docs, sf_dir)
        _LEFT.extend(made)
        return out

    return run


def _columns(df: DataFrame, prefix: str) -> list:
    return [F.col(f"{prefix}{c}").alias(c) for c in COLUMNS]


@_tidy
def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told with some certainty."""
    labelled = language_id.identify(docs, carry=COLUMNS)
    kept = labelled.filter((F.col("lang_pred") != language_id.UNKNOWN) & (F.col("score") >= MIN_LANGUAGE_SCORE))
    return kept.select(*_columns(kept, "carried_"))


@_tidy
def apply_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the counted rules and the likelihood ratio keep."""
    rules = quality_rules.QualityRules()
    weights = quality_rules.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), rules)
    # Written before it is filtered: a filter would be pushed below the scores and repeat them.
    kept = staged(quality_rules.score(docs, weights, rules, carry=COLUMNS)).filter("kept")
    return kept.select(*_columns(kept, "carried."))


@_tidy
def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class, that with the smallest id."""
    return near_dedup.keep_one(docs).select(*COLUMNS)


@_tidy
def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with a secret get the mark in its place, and their length anew; others stay as they are."""
    found = secret_scan.scan_secrets(docs, carry=COLUMNS)
    hit = (F.size("base") > 0) | (F.size("extra") > 0)
    clean = found.withColumn("clean", F.when(hit, secret_scan.redacted(found)).otherwise(F.col("carried.text")))
    return clean.select(
        F.col("carried.doc_id").alias("doc_id"),
        F.col("clean").alias("text"),
        F.col("carried.lang").alias("lang"),
        F.col("carried.source").alias("source"),
        F.when(hit, F.length("clean").cast("long")).otherwise(F.col("carried.n_chars")).alias("n_chars"),
    )


@_tidy
def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their places in sequences."""
    return packing.packed_documents(docs)


STAGES = [
    ("language_id", identify_language),
    ("quality_rules", apply_quality),
    ("near_dedup", drop_near_duplicates),
    ("secret_scan", redact_secrets),
    ("best_fit_packing", pack_sequences),
]

#: Language models, signatures and tokens are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir))
    return docs
