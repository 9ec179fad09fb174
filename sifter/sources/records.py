"""Stored text records: written and read as JSON, used only while their file is unchanged."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = (
    "path string, modified timestamp_ntz, size long, text string, pages int, limited boolean, identity string, "
    "spans array<struct<page:int,text:string,x:double,y:double,w:double,h:double>>"
)


def save(records: DataFrame, base: str) -> None:
    """Store records by path: those of the same path are replaced, all others stay.

    Folders go by two digits of the path's hash, so that only those with a changed record are
    rewritten. What stays of them is read before it is overwritten, by a checkpoint.
    """
    keyed = records.withColumn("shard", F.substring(F.sha2("path", 256), 1, 2))
    _rewrite(records.sparkSession, keyed, keyed.select("path", "shard"), base)


def remove(spark: SparkSession, paths: DataFrame, base: str) -> None:
    """Delete the records of paths (path)."""
    _rewrite(spark, None, paths.select("path", F.substring(F.sha2("path", 256), 1, 2).alias("shard")), base)


def clear(spark: SparkSession, base: str) -> None:
    """Delete all records."""
    spark.createDataFrame([], SCHEMA + ", shard string").write.mode("overwrite").option("partitionOverwriteMode", "static").partitionBy("shard").json(base)


def _stored(spark: SparkSession, base: str) -> DataFrame | None:
    from pyspark.errors import AnalysisException

    try:
        return spark.read.schema(SCHEMA + ", shard string").option("mode", "DROPMALFORMED").json(base)
    except AnalysisException:
        return None


def _rewrite(spark: SparkSession, new: DataFrame | None, gone: DataFrame, base: str) -> None:
    stored = _stored(spark, base)
    if stored is not None:
        kept = stored.join(gone.select("shard").distinct(), "shard", "left_semi").join(gone.select("path").distinct(), "path", "left_anti")
        if spark.sparkContext.getCheckpointDir() is None:
            spark.sparkContext.setCheckpointDir(spark.conf.get("spark.checkpoint.dir"))
        # A folder all of whose records go is written with one that is no record, which load() drops.
        marks = gone.select("shard").distinct().withColumns({f.name: F.lit(None).cast(f.dataType) for f in stored.schema if f.name != "shard"})
        both = kept.unionByName(marks, allowMissingColumns=True)
        new = (both if new is None else both.unionByName(new, allowMissingColumns=True)).checkpoint()
    if new is not None:
        new.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("shard").json(base)


def load(spark: SparkSession, base: str) -> DataFrame:
    """All records; lines that are none are left out."""
    found = _stored(spark, base)
    found = spark.createDataFrame([], SCHEMA) if found is None else found.filter("path is not null")
    return found.select("path", "modified", "size", "text", "pages", "limited", "identity", "spans")


def current(records: DataFrame, files: DataFrame) -> DataFrame:
    """Records whose file is there with the same time and size."""
    return records.join(files.select("path", "modified", "size"), ["path", "modified", "size"], "left_semi")


def export(records: DataFrame, files: DataFrame, target: str, identity: str | None = None) -> None:
    """The texts of current records; refused where the target is one of the sources, by path or by identity."""
    same = F.col("path") == target
    if identity is not None and "identity" in files.columns:
        same = same | (F.col("identity") == identity)
    if files.filter(same).take(1):
        raise ValueError("the target is a source")
    current(records, files).select("text").write.text(target)


def rebase(rows: DataFrame, columns: list[str], old: str, new: str) -> DataFrame:
    """Home-path rewriting of string and array columns when settings move to another machine."""
    move = lambda c: F.when((c == old) | c.startswith(old + "/"), F.concat(F.lit(new), F.substring(c, len(old) + 1, 1 << 20))).otherwise(c)
    kinds = dict(rows.dtypes)
    return rows.withColumns({c: F.transform(c, move) if kinds[c].startswith("array") else move(F.col(c)) for c in columns})


def joined_paths(rows: DataFrame) -> DataFrame:
    """path, one a row, in order: written as text they are the lines of the copy."""
    return rows.select("path").orderBy("path")
