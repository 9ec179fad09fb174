"""Operators over whole catalogs: duplicates, change sets, rename plans, histories, diagnosis."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sifter.functions.text import ancestors, fold, fold_value, inside, name_of, natural_key, parent_of
from sifter.operators.query import parse
from sifter.operators.search import extension_filter, hidden, name_filter, name_score, natural_filter, type_filter

#: Folders that a catalog scan leaves out.
SKIPPED = ("node_modules", "Library", ".git", "build", "DerivedData")


# Duplicates


def duplicate_candidates(files: DataFrame) -> DataFrame:
    """Files whose size another file has, too: sizes are counted first, contents not read."""
    sizes = files.groupBy("size").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("size")
    return files.join(sizes, "size", "left_semi")


def digests(files: DataFrame, content: str = "content") -> DataFrame:
    """path, size, identity, digest: contents are hashed where they are read, and don't travel."""
    return files.select("path", "size", "identity", F.sha2(F.col(content).cast("binary"), 256).alias("digest"))


def duplicate_members(files: DataFrame) -> DataFrame:
    """path, size, digest, identity of files that share size and digest with another.

    files: path, size, content, identity (what tells physical files apart). Sizes and digests are
    counted with partial sums, then joined back; only paths and digests are shuffled.
    """
    return repeated(digests(files))


def repeated(hashed: DataFrame) -> DataFrame:
    """Rows (path, size, digest, identity) whose size and digest another row has, too."""
    groups = hashed.groupBy("size", "digest").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("size", "digest")
    return hashed.join(groups, ["size", "digest"], "left_semi")


def duplicate_groups(members: DataFrame) -> DataFrame:
    """A row a group: its paths' count, distinct physical files, bytes to save and first path."""
    out = members.groupBy("digest", "size").agg(
        F.count(F.lit(1)).alias("paths"), F.count_distinct("identity").alias("files"), F.min("path").alias("first_path")
    )
    return out.withColumn("extra_bytes", F.greatest(F.lit(0), F.col("files") - 1) * F.col("size"))


def duplicate_order() -> list[Column]:
    return [F.col("extra_bytes").desc(), F.col("size").desc(), F.col("first_path").asc()]


def duplicate_filter(members: DataFrame, needle: str) -> DataFrame:
    """Whole groups of which some path holds the needle."""
    hit = members.filter(fold(F.col("path")).contains(fold_value(needle))).select("digest", "size").distinct()
    return members.join(hit, ["digest", "size"], "left_semi")


# Change sets


def minimal_cover(changed: DataFrame) -> DataFrame:
    """Changed paths that no other changed path stands above."""
    paths = changed.select("path").distinct()
    covered = paths.select("path", F.explode(ancestors(F.col("path"))).alias("above")).join(paths.withColumnRenamed("path", "above"), "above", "left_semi")
    return paths.join(covered.select("path").distinct(), "path", "left_anti")


def without_subtrees(catalog: DataFrame, tops: DataFrame) -> DataFrame:
    """Catalog rows that are none of the tops nor below one."""
    tops = tops.select(F.col("path").alias("top")).distinct()
    self_and_above = F.concat(F.array("path"), ancestors(F.col("path")))
    gone = catalog.select("path", F.explode(self_and_above).alias("top")).join(tops, "top", "left_semi").select("path").distinct()
    return catalog.join(gone, "path", "left_anti")


def scannable(path: Column) -> Column:
    """Neither hidden nor in a folder that a scan leaves out."""
    return ~hidden("path") & ~F.arrays_overlap(F.split(path, "/"), F.array(*[F.lit(x) for x in SKIPPED]))


def apply_changes(catalog: DataFrame, changed: DataFrame, present: DataFrame) -> DataFrame:
    """The catalog after changes: subtrees of changed paths go, and what is there now comes in.

    present: rows with path and what else the catalog has, for the changed paths and below.
    Equals a full scan of the new state.
    """
    tops = minimal_cover(changed)
    rows = present.filter(scannable(F.col("path")))
    back = rows.select("*", F.explode(F.concat(F.array("path"), ancestors(F.col("path")))).alias("top")).join(tops.withColumnRenamed("path", "top"), "top", "left_semi").drop("top")
    return without_subtrees(catalog, tops).unionByName(back.dropDuplicates(["path"]).select(*catalog.columns))


def moved(old: DataFrame, new: DataFrame) -> DataFrame:
    """old_path, path of files with the same identity, size and time at another path."""
    o = old.select(F.col("path").alias("old_path"), "identity", "size", "modified")
    return new.join(o, ["identity", "size", "modified"]).filter("path <> old_path").select("old_path", "path")


# Renaming


@dataclass(frozen=True)
class Rename:
    prefix: str = ""
    suffix: str = ""
    find: str = ""
    replace: str = ""
    numbered: bool = False
    start: int = 1
    digits: int = 3


def rename_plan(selection: DataFrame, rule: Rename) -> DataFrame:
    """ord, original, target of the rows that change; selection: ord (from 1), path, is_dir."""
    name = name_of(F.col("path"))
    dotted = ~F.col("is_dir") & name.rlike(r".\.[^.]+$")
    stem = F.when(dotted, F.regexp_replace(name, r"\.[^.]+$", "")).otherwise(name)
    ext = F.when(dotted, F.regexp_extract(name, r"(\.[^.]+)$", 1)).otherwise("")
    if rule.find:
        stem = F.replace(stem, F.lit(rule.find), F.lit(rule.replace))
    start, digits = min(max(rule.start, 0), 10**9), min(max(rule.digits, 1), 9)
    n = (F.col("ord") - 1 + start).cast("string")
    number = F.concat(F.lit("-"), F.lpad(n, F.greatest(F.length(n), F.lit(digits)), "0")) if rule.numbered else F.lit("")
    target = F.concat(F.lit(rule.prefix), stem, F.lit(rule.suffix), number, ext)
    folder = parent_of(F.col("path"))
    out = selection.select("ord", F.col("path").alias("original"), F.concat(F.when(folder == "/", "/").otherwise(F.concat(folder, F.lit("/"))), target).alias("target"))
    return out.filter("original <> target")


def rename_violations(plan: DataFrame, existing: DataFrame) -> DataFrame:
    """original, problem: bad names, targets that meet or exist already, and sources below other sources."""
    name = name_of(F.col("target"))
    bad = plan.filter((name == "") | name.isin(".", "..") | name.rlike("[:\\x00]") | (F.octet_length(name) > 255)).select("original", F.lit("name").alias("problem"))
    key = fold(F.col("target"))
    twice = plan.groupBy(key.alias("key")).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("key")
    meet = plan.withColumn("key", key).join(twice, "key", "left_semi").select("original", F.lit("collision").alias("problem"))
    others = existing.select(F.col("path")).join(plan.select(F.col("original").alias("path")), "path", "left_anti").select(fold(F.col("path")).alias("key")).distinct()
    taken = plan.withColumn("key", key).join(others, "key", "left_semi").select("original", F.lit("exists").alias("problem"))
    sources = plan.select(F.col("original").alias("above"))
    nested = plan.select("original", F.explode(ancestors(F.col("original"))).alias("above")).join(sources, "above", "left_semi").select("original", F.lit("nested").alias("problem"))
    return bad.unionByName(meet).unionByName(taken).unionByName(nested).distinct()


# Histories


def usage(opens: DataFrame, most: int | None = None) -> DataFrame:
    """path, n, last of opens (path, ts); the most opened first."""
    out = opens.groupBy("path").agg(F.count(F.lit(1)).alias("n"), F.max("ts").alias("last"))
    return out.orderBy(F.col("n").desc(), F.col("path")).limit(most) if most else out


def merge_history(rows: DataFrame) -> DataFrame:
    """Equal fingerprints as one row: the oldest id, newest time, and pinned if any was."""
    return rows.groupBy("fingerprint").agg(
        F.min_by("id", F.struct("created", "id")).alias("id"),
        F.max("created").alias("created"),
        F.bool_or("pinned").alias("pinned"),
        F.max("bytes").alias("bytes"),
    )


def retained(rows: DataFrame, as_of: dt.datetime, days: int = 30, max_rows: int = 200, max_bytes: int = 24_000_000, per: str | None = None) -> DataFrame:
    """Pinned rows, and the newest others within the limits of age, rows and bytes that they leave.

    With `per`, each of its values has a history of its own. Without, all rows are one history, of
    which no more than `max_rows` can stay: those are taken first, so that the running sums are over
    few rows. Pinned rows always stay.
    """
    limit = F.lit(as_of.isoformat(sep=" ")).cast("timestamp_ntz") - F.make_dt_interval(F.lit(days))
    fresh = rows.filter(F.col("pinned") | (F.col("created") >= limit))
    order = [F.col("pinned").desc(), F.col("created").desc(), F.col("fingerprint")]
    if per is None:
        others = fresh.filter(~F.col("pinned")).orderBy(*order[1:]).limit(max_rows)
        fresh = fresh.filter("pinned").unionByName(others)
    w = Window.partitionBy(*([per] if per else [F.lit(0)])).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    out = fresh.withColumns({"place": F.count(F.lit(1)).over(w), "held": F.sum("bytes").over(w)})
    return out.filter(F.col("pinned") | ((F.col("place") <= max_rows) & (F.col("held") <= max_bytes))).drop("place", "held")


def double_taps(events: DataFrame, key: str, hold: float = 0.45, gap: float = 0.5) -> DataFrame:
    """Second releases of two quick taps; events: key column, time, press (boolean), other (boolean).

    A tap is a press and the next event its release within `hold`; the second press comes within
    `gap` of the first release, with no other event between.
    """
    w = Window.partitionBy(key).orderBy("time")
    back = lambda c, n: F.lag(c, n).over(w)
    out = events.select(
        "*",
        *[back("press", n).alias(f"p{n}") for n in (1, 2, 3)],
        *[back("other", n).alias(f"o{n}") for n in (1, 2, 3)],
        *[back("time", n).alias(f"t{n}") for n in (1, 2, 3)],
    )
    quiet = ~F.col("other") & ~F.col("o1") & ~F.col("o2") & ~F.col("o3")
    shape = ~F.col("press") & F.col("p1") & ~F.col("p2") & F.col("p3")
    quick = (F.col("time") - F.col("t1") <= hold) & (F.col("t1") - F.col("t2") <= gap) & (F.col("t2") - F.col("t3") <= hold)
    return out.filter(quiet & shape & quick).select(key, "time")


# Explanations


def diagnose(
    catalog: DataFrame,
    targets: DataFrame,
    text: str,
    roots: list[str],
    exclusions: list[str],
    as_of: dt.datetime,
    precision: str = "path",
    *,
    live: DataFrame | None = None,
    local_roots: list[str] | None = None,
    records: DataFrame | None = None,
) -> DataFrame:
    """Why each target is found or not: one row of booleans. targets: path.

    With `live` (path) also whether it exists, with `local_roots` whether a local catalog covers it,
    without which it can't be repaired, and with `records` (path, state) its text record's state. A
    folder that is gone is repaired from the one above.
    """
    q = parse(text)
    known = catalog.withColumn("indexed", F.lit(True))
    rows = targets.select("path").distinct().join(known, "path", "left")
    scope = F.lit(False)
    for r in roots:
        scope = scope | inside(F.col("path"), r)
    out = F.lit(None).cast("string")
    for x in reversed(exclusions):
        out = F.when(inside(F.col("path"), x), F.lit(x)).otherwise(out)
    ok = lambda c: F.coalesce(c, F.lit(False))
    skipped = F.arrays_overlap(F.split("path", "/"), F.array(*[F.lit(x) for x in SKIPPED]))
    more = []
    if live is not None:
        rows = rows.join(live.select("path", F.lit(True).alias("exists__")).distinct(), "path", "left")
        more.append(ok(F.col("exists__")).alias("exists"))
    if records is not None:
        rows = rows.join(records.select("path", F.col("state").alias("record_state")), "path", "left")
        more.append(F.coalesce("record_state", F.lit("none")).alias("record_state"))
    covered = F.lit(True)
    if local_roots is not None:
        covered = F.lit(False)
        for r in local_roots:
            covered = covered | inside(F.col("path"), r)
        more.append(covered.alias("local_coverage"))
    return rows.select(
        "path",
        ok(F.col("indexed")).alias("indexed"),
        scope.alias("in_scope"),
        out.alias("excluded_by"),
        hidden("path").alias("hidden"),
        skipped.alias("skipped_dir"),
        ok(type_filter(q.type)).alias("type_ok"),
        ok(natural_filter(q, as_of)).alias("detail_ok"),
        ok(extension_filter(q) & name_filter(q, precision) & name_score(q.words, precision).isNotNull()).alias("name_ok"),
        (scope & out.isNull() & ~F.coalesce("indexed", F.lit(False)) & ~skipped & covered).alias("can_repair"),
        parent_of(F.col("path")).alias("repair_dir"),
        *more,
    )


def attrition(catalog: DataFrame, text: str, as_of: dt.datetime, precision: str = "path") -> DataFrame:
    """One row: how many rows are left after each filter in turn."""
    q = parse(text)
    steps = [("type", type_filter(q.type)), ("extension", extension_filter(q)), ("detail", natural_filter(q, as_of)), ("name", name_filter(q, precision) & name_score(q.words, precision).isNotNull())]
    left, counts = F.lit(q.valid), [F.count(F.lit(1)).alias("n_all")]
    for name, condition in steps:
        left = left & F.coalesce(condition, F.lit(False))
        counts.append(F.count_if(left).alias(f"n_{name}"))
    return catalog.agg(*counts)


def natural_order(rows: DataFrame, column: str) -> DataFrame:
    return rows.orderBy(natural_key(F.col(column)), column)
