"""What the operators share: folds, staged tables and small expression helpers."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space that separates words: space and \t to \r.
WORD_GAP = r"[\x20\x09-\x0D]+"


def held_out(id_col: str, modulus: int) -> Column:
    """True where crc32 of the id as text leaves no remainder; a null id is never held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % modulus == 0, F.lit(False))


def shared_dir(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir, which driver and executors share.

    Only where that setting is missing (as in tests) one is set, for a local session.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = tempfile.mkdtemp(prefix="sifter-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/sifter-{uuid.uuid4().hex}"


_WATCHED: list[list[str]] = []


def staged(df: DataFrame) -> DataFrame:
    """The rows of df, written once to a table in the shared folder and read back.

    This cuts the lineage: a lost executor costs only the tasks that it ran.
    """
    spark = df.sparkSession
    path = shared_dir(spark)
    for made in _WATCHED:
        made.append(path)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def watched() -> Iterator[list[str]]:
    """The folders of all tables that are staged meanwhile."""
    made: list[str] = []
    _WATCHED.append(made)
    try:
        yield made
    finally:
        _WATCHED.remove(made)


def released(made: list[str], keep: DataFrame) -> list[str]:
    """Deletes those of the staged tables that `keep` doesn't read; gives the others."""
    read = " ".join(keep.inputFiles())
    jvm, conf = keep.sparkSession._jvm, keep.sparkSession._jsc.hadoopConfiguration()
    left = []
    for folder in made:
        if folder.rsplit("/", 1)[1] in read:
            left.append(folder)
        else:
            path = jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(conf).delete(path, True)
    return left


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """What an action shuffles goes when it ends, while the body runs; else only once the driver collects garbage."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)


@contextmanager
def arrow_rows(spark: SparkSession, most: int) -> Iterator[None]:
    """Batches of so many rows for Python while the body runs, where rows carry whole texts."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(min(most, int(before)) if int(before) > 0 else most))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once for the row, also inside lambdas."""
    return F.transform(F.array(value), body)[0]


def words_of(text: Column) -> Column:
    """The words of a text as an array; null has none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), WORD_GAP, -1), "")
