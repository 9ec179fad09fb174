"""Text-record jobs: which files need one, how their states change, counts, filter and order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sifter.functions.text import fold, fold_value, natural_key
from sifter.operators.search import in_scope, type_filter
from sifter.sources.catalog import load_snapshot, save_snapshot

WAITING, RUNNING, DONE, FAILED, CHANGED, CANCELLED = "waiting", "running", "done", "failed", "changed", "cancelled"
#: What an event makes of a state; a state that isn't named stays.
TRANSITIONS = {
    "queue": {None: WAITING, DONE: WAITING, FAILED: WAITING, CHANGED: WAITING, CANCELLED: WAITING},
    "start": {WAITING: RUNNING},
    "finish": {RUNNING: DONE},
    "fail": {RUNNING: FAILED},
    "change": {RUNNING: WAITING, DONE: CHANGED},  # a file that changes while it is read is queued again
    "cancel": {WAITING: CANCELLED, RUNNING: CANCELLED},
    "resume": {CANCELLED: WAITING, CHANGED: WAITING},
    "retry": {FAILED: WAITING},
}


def next_state(state: str | None, event: str) -> str | None:
    return TRANSITIONS.get(event, {}).get(state, state)


def _next(state: Column, event: Column) -> Column:
    out = state
    for name, moves in TRANSITIONS.items():
        for a, b in moves.items():
            out = F.when((event == name) & (state.isNull() if a is None else state == a), F.lit(b)).otherwise(out)
    return out


def states(events: DataFrame) -> DataFrame:
    """path, state after all of its events (path, at, event) in order; equal to what the stream reaches."""
    ordered = F.array_sort(F.collect_list(F.struct("at", "event")))
    folded = F.aggregate("events", F.lit(None).cast("string"), lambda s, e: _next(s, e["event"]))
    return events.groupBy("path").agg(ordered.alias("events")).select("path", folded.alias("state"))


def eligible(exclusions: list[str], store: str) -> Column:
    """PDFs and images that are neither excluded nor in the store's own folder; needs norm_name."""
    out = (type_filter("pdf") | type_filter("images")) & ~in_scope([store])
    return out & ~in_scope(exclusions) if exclusions else out


def enqueue(files: DataFrame, records: DataFrame) -> DataFrame:
    """path, state, note, follows of every file: done where a record with spans is current, or follows the
    file from another path by identity, size and time; else waiting.

    records: path, modified, size, identity, spans. A record that several files could follow is
    taken by the first path.
    """
    usable = records.filter(F.col("spans").isNotNull())
    current = usable.select("path", "modified", "size", F.lit(True).alias("current"))
    live = files.select("path", "modified", "size", "identity").join(current, ["path", "modified", "size"], "left")
    old = usable.select(F.col("path").alias("old"), "modified", "size", "identity")
    moved = live.filter("current is null").join(old, ["identity", "size", "modified"]).filter("path <> old")
    moved = moved.groupBy("old").agg(F.min("path").alias("path")).groupBy("path").agg(F.min("old").alias("follows"))
    out = live.join(moved, "path", "left")
    state = F.when(F.col("current") | F.col("follows").isNotNull(), DONE).otherwise(WAITING)
    note = F.when(F.col("current"), "cached").when(F.col("follows").isNotNull(), "followed").otherwise("")
    return out.select("path", state.alias("state"), note.alias("note"), "follows")


def counts(jobs: DataFrame) -> DataFrame:
    """One row: jobs in each state."""
    return jobs.agg(*[F.count_if(F.col("state") == s).alias(f"n_{s}") for s in (WAITING, RUNNING, DONE, FAILED, CHANGED, CANCELLED)])


def matching(jobs: DataFrame, needle: str) -> DataFrame:
    """Jobs whose folded path, state and note hold the needle."""
    return jobs.filter(fold(F.concat_ws(" ", "path", "state", "note")).contains(fold_value(needle)))


def save_jobs(jobs: DataFrame, base: str) -> None:
    """The next version of the stored jobs; those before stay until it is whole."""
    save_snapshot(jobs, base, ["jobs"])


def load_jobs(spark: SparkSession, base: str) -> DataFrame | None:
    """The stored jobs; those that were running when they were stored wait again."""
    found = load_snapshot(spark, base, ["jobs"])
    return None if found is None else found.withColumn("state", F.when(F.col("state") == RUNNING, WAITING).otherwise(F.col("state")))


def job_order() -> list[Column]:
    return [F.col("state").asc(), natural_key(F.col("path")).asc(), F.col("path").asc()]
