"""Views of a catalog beside the search: folders, collections, summaries, saved searches, and the pieces of a result list."""

from __future__ import annotations

import datetime as dt
import json
from dataclasses import asdict, dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sifter.functions.text import fold_value, inside, match_offsets, natural_key, parent_of
from sifter.operators.search import between_days, compact_location, days_filter, in_scope, search, size_band, type_filter

# Folders and collections


def browse(catalog: DataFrame, folder: str) -> DataFrame:
    """What lies directly in a folder and isn't hidden: folders first, then by natural name."""
    rows = catalog.filter((parent_of(F.col("path")) == folder) & ~F.col("name").startswith("."))
    return rows.orderBy(F.col("is_dir").desc(), natural_key(F.col("name")), "path")


def recent(catalog: DataFrame, since: dt.datetime, limit: int | None = 80) -> DataFrame:
    """Files modified since then, newest first."""
    at = F.lit(since.isoformat(sep=" ")).cast("timestamp_ntz")
    rows = catalog.filter(~F.col("is_dir") & (F.col("modified") >= at)).orderBy(F.desc("modified"), "path")
    return rows.limit(limit) if limit else rows


def opened(opens: DataFrame, roots: list[str], most: int | None = None) -> DataFrame:
    """path, last of what was opened (path, ts) below the roots, the latest first."""
    out = opens.filter(in_scope(roots)).groupBy("path").agg(F.max("ts").alias("last")).orderBy(F.desc("last"), "path")
    return out.limit(most) if most else out


def pinned(pins: DataFrame, catalog: DataFrame, roots: list[str]) -> DataFrame:
    """ord, path, present of pins (ord, path) below the roots, in the list's order; a missing file keeps its row."""
    there = catalog.select("path").distinct().withColumn("present", F.lit(True))
    rows = pins.filter(in_scope(roots)).join(there, "path", "left")
    return rows.select("ord", "path", F.coalesce("present", F.lit(False)).alias("present")).orderBy("ord")


def summary(catalog: DataFrame, unreadable: DataFrame, most: int = 10) -> DataFrame:
    """One row: items, unreadable folders (path), and the first of those in order."""
    bad = unreadable.select("path").distinct()
    rows = catalog.select(F.lit("item").alias("kind"), F.lit("").alias("path"))
    rows = rows.unionByName(bad.select(F.lit("bad").alias("kind"), "path")).unionByName(bad.orderBy("path").limit(most).select(F.lit("first").alias("kind"), "path"))
    return rows.agg(
        F.count_if(F.col("kind") == "item").alias("items"),
        F.count_if(F.col("kind") == "bad").alias("unreadable"),
        F.array_sort(F.collect_list(F.when(F.col("kind") == "first", F.col("path")))).alias("first_unreadable"),
    )


def outside_library(home: str) -> Column:
    """Not in the library folder, but for what is synchronised from a cloud: what a recent list over all scopes shows."""
    path = F.col("path")
    cloud = [path.startswith(f"{home}/Library/{x}/") for x in ("Mobile Documents", "CloudStorage")]
    return ~path.startswith(f"{home}/Library/") | cloud[0] | cloud[1]


def places(catalog: DataFrame, home: str) -> DataFrame:
    """path, place: as compact_location, with the cloud folder by its name and the home folder as ~."""
    cloud = f"{home}/Library/Mobile Documents/com~apple~CloudDocs"
    parent = parent_of(F.col("path"))
    after = lambda c, n: F.substring(c, n + 1, 1 << 20)
    short = F.when(F.col("place") == home, "~").when(F.col("place").startswith(home + "/"), F.concat(F.lit("~"), after(F.col("place"), len(home)))).otherwise(F.col("place"))
    in_cloud = F.when(parent == cloud, "iCloud").when(parent.startswith(cloud + "/"), F.concat(F.lit("iCloud/"), after(parent, len(cloud) + 1)))
    return compact_location(catalog).select("path", F.coalesce(in_cloud, short).alias("place"))


# Result lists


def highlights(text: Column, folded: Column, words: list[str]) -> Column:
    """(at, length) of what each word marks in a text: its hits, or else its letters in order, leftmost."""
    spans = "array<struct<at:int,length:int>>"
    none = F.array().cast(spans)
    out = []
    for word in dict.fromkeys(fold_value(w) for w in words if w):
        hits = match_offsets(folded, [word])
        start = F.struct(F.lit(0).alias("at"), none.alias("out"))

        def step(acc: Column, c: Column) -> Column:
            at = F.when(acc["at"] >= 0, F.call_function("locate", c, folded, acc["at"] + 1)).otherwise(0)
            span = F.array(F.struct((at - 1).alias("at"), F.lit(1).alias("length")))
            return F.when(at > 0, F.struct(at.alias("at"), F.concat(acc["out"], span).alias("out"))).otherwise(F.struct(F.lit(-1).alias("at"), none.alias("out")))

        letters = F.aggregate(F.array(*[F.lit(c) for c in word]), start, step, lambda acc: acc["out"]) if len(word) > 1 and word.isascii() else none
        out.append(F.when(F.size(hits) > 0, hits).otherwise(letters))
    return F.when(text.isNotNull(), F.sort_array(F.concat(*out)) if out else none)


def assembled(*sources: DataFrame) -> DataFrame:
    """One row a path of several lists of results: that of the last list that has it."""
    rows = sources[0].withColumn("turn", F.lit(0))
    for k, s in enumerate(sources[1:], 1):
        rows = rows.unionByName(s.withColumn("turn", F.lit(k)))
    columns = [c for c in rows.columns if c not in ("path", "turn")]
    last = rows.groupBy("path").agg(F.max_by(F.struct(*columns), "turn").alias("row"))
    return last.select("path", "row.*").select(*sources[0].columns)


def with_targets(rows: DataFrame, catalog: DataFrame, targets: list[str], roots: list[str]) -> DataFrame:
    """Rows and, where they exist and lie in scope, an alias' or a manual choice's path."""
    extra = catalog.filter(F.col("path").isin(*targets) & in_scope(roots)) if targets else catalog.limit(0)
    return assembled(rows, extra.select(*rows.columns))


# Saved searches


@dataclass(frozen=True)
class SavedSearch:
    """All that a search depends on, as it is stored."""

    name: str
    query: str
    all: bool = True
    folder: str = ""
    roots: tuple[str, ...] = field(default_factory=tuple)
    type: str = "all"
    #: 0 any, 1 today, 2 the last 7 days, 3 the last 30 days, 4 custom; field 0 modified, 1 created.
    date: int = 0
    date_field: int = 0
    start: str | None = None
    end: str | None = None
    size: int = 0
    precision: str = "path"
    mode: str = "filename"


def capture(saved: SavedSearch) -> str:
    return json.dumps(asdict(saved), ensure_ascii=False, sort_keys=True)


def restore(text: str) -> SavedSearch:
    """A stored search; what is missing or out of bounds takes its default."""
    raw = json.loads(text)
    known = {k: v for k, v in raw.items() if k in SavedSearch.__dataclass_fields__ and v is not None}
    known["roots"] = tuple(known.get("roots", ()))
    for k, most in (("date", 4), ("date_field", 1), ("size", 3)):
        known[k] = min(most, max(0, int(known.get(k, 0))))
    return SavedSearch(**known)


def panel(saved: SavedSearch, as_of: dt.datetime) -> Column:
    """The type, date and size filters of a saved search."""
    column = ("modified", "created")[saved.date_field]
    keep = type_filter(saved.type)
    if saved.date in (1, 2, 3):
        keep = keep & days_filter(column, as_of, (1, 7, 30)[saved.date - 1])
    if saved.date == 4 and saved.start and saved.end:
        keep = keep & between_days(column, dt.date.fromisoformat(saved.start[:10]), dt.date.fromisoformat(saved.end[:10]))
    return keep & size_band(saved.size) if saved.size else keep


def run_saved(catalog: DataFrame, saved: SavedSearch, as_of: dt.datetime, **options) -> DataFrame:
    """The search as it was saved; one in a folder that is no longer there has no rows."""
    roots = list(saved.roots) if saved.all else [saved.folder]
    if not saved.all and catalog.filter(inside(F.col("path"), saved.folder)).isEmpty():
        return search(catalog.limit(0), saved.query, mode=saved.mode, precision=saved.precision, as_of=as_of, **options)
    return search(catalog, saved.query, mode=saved.mode, precision=saved.precision, as_of=as_of, roots=roots or None, panel=panel(saved, as_of), **options)


# Renaming in two phases


def phases(plan: DataFrame, marker: str = ".sifter-rename-") -> DataFrame:
    """phase, source, destination: all files first go to temporary names beside them, then to their targets.

    A plan (ord, original, target) may so swap names. The temporary name is told by the original's
    digest, so that a plan made again names it alike. Undoing takes the rows in reverse order.
    """
    folder = parent_of(F.col("original"))
    at = F.concat(F.when(folder == "/", "").otherwise(folder), F.lit("/" + marker), F.sha2("original", 256))
    rows = plan.withColumn("temporary", at)
    first = rows.select(F.lit(1).alias("phase"), "ord", F.col("original").alias("source"), F.col("temporary").alias("destination"))
    second = rows.select(F.lit(2).alias("phase"), "ord", F.col("temporary").alias("source"), F.col("target").alias("destination"))
    return first.unionByName(second)


def undo(steps: DataFrame, done: DataFrame) -> DataFrame:
    """turn, source, destination: how the steps (phase, ord) that were done are taken back, the last one first."""
    from pyspark.sql import Window

    back = steps.join(done.select("phase", "ord"), ["phase", "ord"], "left_semi")
    turn = F.row_number().over(Window.partitionBy("phase").orderBy(F.desc("ord"))) + F.when(F.col("phase") == 1, 1 << 40).otherwise(0)
    return back.select(turn.cast("long").alias("turn"), F.col("destination").alias("source"), F.col("source").alias("destination"))
