"""Quality rules: counted base rules and a hashed n-gram log-likelihood ratio.

Every document is hashed to word unigrams and bigrams in ``buckets`` buckets. Two
multinomials over the buckets are fitted: of a trusted sample (target) and of all documents
(raw). A document's score is the mean of log p_target - log p_raw over its n-grams, and it is
kept when the base rules pass and the score reaches a fixed threshold. DataFrame functions only.

Defined cases: a null or blank text has no words, fails the base rules and scores 0; repeated
rows each get a row; with no trusted document all weights are 0, so only the base rules speak;
other columns of the input are ignored unless named in ``carry``; very long texts are taken whole; a
score at the threshold is kept; a document that several labels trust counts once; an empty table
gives no rows.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sifter.llm.common import words_of

#: Words of a window whose repeats count; three doublings of a word.
WINDOW = 8


@dataclass(frozen=True)
class QualityRules:
    """Parameters; the defaults are those of the registered query."""

    buckets: int = 1 << 14
    smoothing: float = 1.0
    threshold: float = -0.06
    min_words: int = 20
    max_repeat_percent: int = 30
    #: The most trusted documents that the target is fitted on, taken in order of a hash of the id.
    max_trusted: int = 20_000


def _hashed(words: Column) -> Column:
    return F.transform(words, lambda w: F.xxhash64(w))


def _joined(hashes: Column, step: int) -> Column:
    """Hashes of runs twice as long: each with the one `step` places on."""
    after = F.slice(hashes, step + 1, F.size(hashes))
    return F.slice(F.zip_with(hashes, after, lambda a, b: F.xxhash64(a, b)), 1, F.greatest(F.size(hashes) - step, F.lit(0)))


def trusted_ids(labels: DataFrame, rules: QualityRules, id_col: str = "doc_id") -> DataFrame:
    """At most rules.max_trusted ids of quality 1, so that they can be broadcast."""
    return (
        labels.filter((F.col("quality") == 1) & F.col(id_col).isNotNull())
        .select(F.col(id_col).alias("trusted_id"))
        .distinct()
        .orderBy(F.xxhash64("trusted_id"), "trusted_id")
        .limit(rules.max_trusted)
    )


def fit(docs: DataFrame, labels: DataFrame, rules: QualityRules, id_col: str = "doc_id", text_col: str = "text") -> list[float]:
    """The log-likelihood ratio of each bucket; raw counts cover every document."""
    trusted = F.broadcast(trusted_ids(labels, rules, id_col))
    rows = (
        docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
        .join(trusted, F.col("id") == F.col("trusted_id"), "left")
        .select(F.col("trusted_id").isNotNull().cast("long").alias("t"), _hashed(words_of(F.col("text"))).alias("wh"))
        .select("t", F.explode(F.concat("wh", _joined(F.col("wh"), 1))).alias("h"))
        .select("t", F.pmod("h", F.lit(rules.buckets)).cast("int").alias("bucket"))
        .groupBy("bucket")
        .agg(F.count(F.lit(1)).alias("raw"), F.sum("t").alias("target"))
        .collect()  # one row a bucket at most
    )
    raw, target = [0] * rules.buckets, [0] * rules.buckets
    for r in rows:
        raw[r.bucket], target[r.bucket] = r.raw, r.target
    n_raw, n_target, a = sum(raw), sum(target), rules.smoothing
    if not n_target:
        return [0.0] * rules.buckets
    # The target is smoothed towards the raw distribution, so that a small sample says little.
    prior = a * rules.buckets
    p_raw = [(r + a) / (n_raw + prior) for r in raw]
    return [math.log((t + prior * p) / (n_target + prior)) - math.log(p) for t, p in zip(target, p_raw, strict=True)]


def _shifted(h: Column, bits: str) -> Column:
    """h with its low bits cleared."""
    return F.call_function("shiftleft", F.call_function("shiftright", h, F.col(bits)), F.col(bits))


def _repeat_words() -> Column:
    """Words that some window found twice or more covers, from `win`, hashes by position."""
    ordered = F.col("ordered")
    return F.when(
        F.size(ordered) > 0,
        F.aggregate(
            F.sequence(F.lit(0), F.size(ordered) - 1),
            F.lit(0).cast("long"),
            lambda acc, k: acc + F.least(F.lit(WINDOW), F.coalesce(F.get(ordered, k + 1) - F.get(ordered, k), F.lit(WINDOW))).cast("long"),
        ),
    ).otherwise(F.lit(0).cast("long"))


def score(
    docs: DataFrame,
    weights: list[float],
    rules: QualityRules,
    id_col: str = "doc_id",
    text_col: str = "text",
    carry: tuple[str, ...] = (),
) -> DataFrame:
    """Counts, score and verdict of every document; `carry` columns are passed on as they are.

    Write the result before filtering on it: Catalyst would push a filter below the columns that
    build on each other, and plan for very long.
    """
    table = F.split(F.lit(",".join(repr(x) for x in weights)), ",").cast("array<double>")  # folded to a constant
    text = F.coalesce(F.col("text"), F.lit(""))

    def total(hashes: str) -> Column:
        return F.aggregate(hashes, F.lit(0.0), lambda acc, h: acc + F.element_at(table, (F.pmod(h, F.lit(rules.buckets)) + 1).cast("int")))

    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    out = docs.select(
        F.col(id_col).alias(id_col),
        F.col(text_col).alias("text"),
        F.struct(*[F.col(c) for c in carry]).alias("carried") if carry else F.lit(None).cast("string").alias("carried"),
    )
    out = out.select("*", words_of(F.col("text")).alias("words"), lines.alias("lines"))
    out = out.withColumn("wh", _hashed(F.col("words")))
    out = out.select(
        "*",
        F.size("wh").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        F.length(F.regexp_replace(text, "[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        _joined(F.col("wh"), 1).alias("pairs"),
    ).drop("lines", "text", "words")
    # Each doubling is a column of its own, as its input is used more than once.
    out = out.withColumn("quads", _joined(F.col("pairs"), 2))
    out = out.withColumn("win", _joined(F.col("quads"), 4)).drop("quads")
    # Positions matter only where some window occurs twice. Sorted are longs: a hash's high
    # bits, then the position in as few bits as it needs; neighbours compare whole hashes.
    bits = F.ceil(F.log2(F.size("win") + 1)).cast("int")
    out = out.withColumn("bits", F.when(F.size(F.array_distinct("win")) < F.size("win"), bits))
    keyed = F.transform("win", lambda h, i: _shifted(h, "bits").bitwiseOR(i.cast("long")))
    out = out.withColumn("sorted", F.when(F.col("bits").isNotNull(), F.sort_array(keyed)))
    out = out.withColumn("places", F.transform("sorted", lambda x: (x - _shifted(x, "bits")).cast("int"))).drop("sorted")
    same = lambda k: F.coalesce(F.get("win", F.get("places", k)) == F.get("win", F.get("places", k + 1)), F.lit(False))
    out = out.withColumn("ordered", F.sort_array(F.filter("places", lambda x, k: same(k - 1) | same(k)))).drop("places", "win")
    out = out.withColumns(
        {
            "n_repeat_words": _repeat_words(),
            "n_grams": (F.size("wh") + F.size("pairs")).cast("long"),
            "total": total("wh") + total("pairs"),
        }
    )
    out = out.withColumns(
        {
            "base_failed": (F.col("n_words") < rules.min_words)
            | (100 * F.col("n_repeat_words") > rules.max_repeat_percent * F.col("n_words")),
            "score": F.when(F.col("n_grams") > 0, F.col("total") / F.col("n_grams")).otherwise(F.lit(0.0)),
        }
    )
    return out.select(
        id_col,
        *([F.col("carried")] if carry else []),
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        "base_failed",
        (~F.col("base_failed") & (F.col("score") >= rules.threshold)).alias("kept"),
        "score",
    )
