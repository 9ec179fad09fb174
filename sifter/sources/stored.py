"""Tables that are written once and read by many queries: folded catalogs, and rows numbered in an order."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_STORED: dict[tuple[str, str], DataFrame] = {}


def shared_folder(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir; a local session without that setting gets a temporary one."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = tempfile.mkdtemp(prefix="sifter-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/stored-{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    """The rows of df, written to a new table and read back."""
    path = shared_folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def stored(spark: SparkSession, name: str, make: Callable[[], DataFrame]) -> DataFrame:
    """The table of this name, made at its first use in the application; a snapshot until forget()."""
    key = (spark.sparkContext.applicationId, name)
    if key not in _STORED:
        _STORED[key] = written(make())
    return _STORED[key]


def forget(spark: SparkSession, prefix: str = "") -> None:
    """Tables whose name begins so are made anew at their next use."""
    for key in [k for k in _STORED if k[0] == spark.sparkContext.applicationId and k[1].startswith(prefix)]:
        del _STORED[key]


def placed(rows: DataFrame, order: list[Column]) -> DataFrame:
    """All rows with place, from 1, in an order; sorted by ranges, not in one task.

    Rows are numbered within their partition of the sorted table, which is written, and moved on by
    the counts of the partitions before, of which there are few.
    """
    numbered = written(rows.orderBy(*order).withColumn("at__", F.monotonically_increasing_id()))
    part = F.shiftright("at__", 33)
    counts = sorted((r.part, r.n) for r in numbered.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n")).collect())
    before, base = 0, F.lit(None).cast("long")
    for k, n in counts:
        base = F.when(part == k, F.lit(before)).otherwise(base)
        before += n
    inside = F.col("at__") - F.shiftleft(part, 33)
    return numbered.withColumn("place", (base + inside + 1).cast("long")).drop("at__")
