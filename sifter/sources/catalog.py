"""A catalog of files as a Python data source, and catalog snapshots.

Format ``catalog``, options: ``roots`` (JSON list), ``exclude`` (JSON list of folders), ``depth``
(how far partitions are planned: one for each folder found so deep). Rows are files and folders;
hidden ones, what lies in skipped folders or packages, and symbolic links' targets are left out.
"""

from __future__ import annotations

import datetime as dt
import hashlib
import json
import os
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from sifter.functions.text import inside
from sifter.operators.files import SKIPPED

SCHEMA = "path string, is_dir boolean, size long, modified timestamp_ntz, created timestamp_ntz, identity string, tags array<string>"
#: Folders with one of these extensions count as files.
PACKAGES = (".app", ".bundle", ".framework", ".photoslibrary", ".xcodeproj", ".rtfd")


def _row(path: str) -> tuple | None:
    try:
        st = os.lstat(path)
    except OSError:
        return None
    is_dir = os.path.isdir(path) and not os.path.islink(path) and not path.lower().endswith(PACKAGES)
    at = lambda s: dt.datetime.fromtimestamp(s, dt.UTC).replace(tzinfo=None)
    return (path, is_dir, 0 if is_dir else st.st_size, at(st.st_mtime), at(st.st_ctime), f"{st.st_dev}:{st.st_ino}", [])


def _children(folder: str) -> list[str]:
    try:
        with os.scandir(folder) as found:
            return sorted(e.path for e in found if not e.name.startswith(".") and e.name not in SKIPPED)
    except OSError:
        return []


def _entered(path: str, exclude: list[str]) -> bool:
    return os.path.isdir(path) and not os.path.islink(path) and not path.lower().endswith(PACKAGES) and not _out(path, exclude)


def _out(path: str, exclude: list[str]) -> bool:
    return any(path == x or path.startswith(x + "/") for x in exclude)


def walk(folder: str, exclude: list[str], depth: int | None = None) -> Iterator[str]:
    """Paths below a folder, itself left out; down to depth levels."""
    stack = [(folder, 0)]
    while stack:
        at, level = stack.pop()
        for path in _children(at):
            if _out(path, exclude):
                continue
            yield path
            if _entered(path, exclude) and (depth is None or level + 1 < depth):
                stack.append((path, level + 1))


class Subtree(InputPartition):
    def __init__(self, folder: str, whole: bool) -> None:
        self.folder, self.whole = folder, whole


class CatalogReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        roots = sorted({os.path.realpath(r) for r in json.loads(options["roots"])})
        self.roots = [r for r in roots if not any(r.startswith(o + "/") for o in roots)]  # the rest lies in these
        self.exclude = [os.path.realpath(x) for x in json.loads(options.get("exclude", "[]"))]
        self.depth = int(options.get("depth", "1"))

    def partitions(self) -> list[InputPartition]:
        out: list[InputPartition] = []
        for root in self.roots:
            out.append(Subtree(root, False))
            out += [Subtree(p, True) for p in walk(root, self.exclude, self.depth) if p.count("/") - root.rstrip("/").count("/") == self.depth and _entered(p, self.exclude)]
        return out

    def read(self, partition: Subtree) -> Iterator[tuple]:
        for path in walk(partition.folder, self.exclude, None if partition.whole else self.depth):
            if (row := _row(path)) is not None:
                yield row


class CatalogSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "catalog"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> CatalogReader:
        return CatalogReader(self.options)


def scan(spark: SparkSession, roots: list[str], exclude: list[str] | None = None, depth: int = 1) -> DataFrame:
    spark.dataSource.register(CatalogSource)
    return spark.read.format("catalog").option("roots", json.dumps(roots)).option("exclude", json.dumps(exclude or [])).option("depth", depth).load()


# Snapshots: a folder for each set of roots, with the versions written so far and a manifest that
# names the current one. A version is written whole before the manifest gets its row, so a write
# that fails, or one that reads the version before, loses nothing.

VERSION = 1
_MANIFEST = "turn long, folder string, version int"


def snapshot_path(base: str, roots: list[str]) -> str:
    return f"{base.rstrip('/')}/{hashlib.sha256(json.dumps(sorted(roots)).encode()).hexdigest()}"


def _manifest(spark: SparkSession, path: str) -> list:
    from pyspark.errors import AnalysisException

    try:
        return spark.read.schema(_MANIFEST).json(f"{path}/manifest").orderBy(F.desc("turn")).limit(1).collect()
    except AnalysisException:
        return []


def _point(spark: SparkSession, path: str, folder: str | None) -> None:
    last = _manifest(spark, path)
    row = [(last[0].turn + 1 if last else 1, folder, VERSION)]
    spark.createDataFrame(row, _MANIFEST).coalesce(1).write.mode("append").json(f"{path}/manifest")


def save_snapshot(catalog: DataFrame, base: str, roots: list[str]) -> str:
    path, folder = snapshot_path(base, roots), f"version-{uuid.uuid4().hex}"
    catalog.write.option("compression", "zstd").parquet(f"{path}/{folder}")
    _point(catalog.sparkSession, path, folder)
    return path


def load_snapshot(spark: SparkSession, base: str, roots: list[str]) -> DataFrame | None:
    """None where there is no snapshot of these roots, it was invalidated, or it is of another version."""
    path = snapshot_path(base, roots)
    last = _manifest(spark, path)
    if not last or last[0].folder is None or last[0].version != VERSION:
        return None
    return spark.read.parquet(f"{path}/{last[0].folder}")


def invalidate(spark: SparkSession, base: str, roots: list[str]) -> None:
    """From now on there is no snapshot of these roots."""
    if load_snapshot(spark, base, roots) is not None:
        _point(spark, snapshot_path(base, roots), None)


def save_by_root(catalog: DataFrame, base: str, roots: list[str]) -> list[str]:
    """A snapshot for each root of a merged catalog; a row goes to every root that it lies in."""
    return [save_snapshot(catalog.filter(inside(F.col("path"), r)), base, [r]) for r in roots]


def rebuilt(catalog: DataFrame, root: str, fresh: DataFrame) -> DataFrame:
    """A merged catalog with what lies below a root replaced by a new scan of it."""
    below = inside(F.col("path"), root) & (F.col("path") != root)
    return catalog.filter(~below).unionByName(fresh.filter(below).select(*catalog.columns))


def limited(catalog: DataFrame, maximum: int | None = None) -> tuple[DataFrame, bool]:
    """The catalog's first `maximum` paths, if given, and whether that left any out."""
    if maximum is None:
        return catalog, False
    return catalog.orderBy("path").limit(maximum), catalog.limit(maximum + 1).count() > maximum
