"""Stateful streams: a history with upserts, key taps, catalog changes, and jobs."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from sifter.operators.clipboard import acceptable
from sifter.operators.files import apply_changes
from sifter.operators.jobs import next_state

__all__ = ["acceptable", "double_tap_stream", "job_states", "job_stream", "maintain_catalog", "upsert_stream"]


def upsert_stream(rows: DataFrame) -> DataFrame:
    """fingerprint, id, created, pinned after each batch: the first id and any pin stay, the time moves on.

    Unlike dropping duplicates, a repeat refreshes its row.
    """

    def step(key: tuple[Any, ...], batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        kept = state.get if state.exists else None
        first, last, pinned = None, None, False  # of this micro-batch, which may come in several parts
        for pdf in batches:
            row = pdf.sort_values(["created", "id"]).iloc[0]
            at = (row["created"], int(row["id"]))
            first = at if first is None else min(first, at)
            last = pdf["created"].max() if last is None else max(last, pdf["created"].max())
            pinned = pinned or bool(pdf["pinned"].any())
        last = last.to_pydatetime()
        kept = (first[1], last, pinned) if kept is None else (kept[0], max(kept[1], last), kept[2] or pinned)
        state.update(kept)
        yield pd.DataFrame({"fingerprint": [key[0]], "id": [kept[0]], "created": [kept[1]], "pinned": [kept[2]]})

    return rows.groupBy("fingerprint").applyInPandasWithState(
        step,
        "fingerprint string, id long, created timestamp, pinned boolean",
        "id long, created timestamp, pinned boolean",
        "update",
        GroupStateTimeout.NoTimeout,
    )


def double_tap_stream(events: DataFrame, hold: float = 0.45, gap: float = 0.5) -> DataFrame:
    """user, time of every second release of two quick taps; events: user, time, press, other."""

    def step(key: tuple[Any, ...], batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        # stage: 0 idle, 1 pressed, 2 released once, 3 pressed again; at: the last event's time
        stage, at = state.get if state.exists else (0, 0.0)
        fired = []
        # A key's events of a micro-batch may come in several parts, so they are sorted together.
        for e in pd.concat(list(batches)).sort_values("time", kind="stable").itertuples():
            if e.other:
                stage = 0
            elif e.press:
                stage = 3 if stage == 2 and e.time - at <= gap else 1
            elif stage in (1, 3) and e.time - at <= hold:
                if stage == 3:
                    fired.append(e.time)
                stage = 2 if stage == 1 else 0
            else:
                stage = 0
            at = e.time
        state.update((stage, float(at)))
        yield pd.DataFrame({"user": [key[0]] * len(fired), "time": fired})

    return events.groupBy("user").applyInPandasWithState(step, "user string, time double", "stage int, at double", "append", GroupStateTimeout.NoTimeout)


def job_stream(events: DataFrame) -> DataFrame:
    """path, state after each micro-batch's events (path, at, event), in order of their time."""

    def step(key: tuple[Any, ...], batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now = state.get[0] if state.exists else None
        for e in pd.concat(list(batches)).sort_values(["at", "event"]).itertuples():
            now = next_state(now, e.event)
        if now is not None:
            state.update((now,))
            yield pd.DataFrame({"path": [key[0]], "state": [now]})

    return events.groupBy("path").applyInPandasWithState(step, "path string, state string", "state string", "update", GroupStateTimeout.NoTimeout)


def maintain_catalog(
    changes: DataFrame,
    present: Callable[[DataFrame], DataFrame],
    read: Callable[[], DataFrame],
    write: Callable[[DataFrame], None],
    rescan: Callable[[], DataFrame] | None = None,
    full_scan_above: int = 2048,
):
    """A stream writer that applies each batch of changed paths (path) to a catalog.

    present(paths) gives what is there now for the changed paths and below; read() and write(df)
    load the catalog and store its next version. With more than `full_scan_above` distinct paths in
    a batch, or a null one (the source lost track), rescan() gives the whole catalog instead.
    """

    def apply(batch: DataFrame, epoch: int) -> None:
        paths = batch.select("path").distinct()
        seen = paths.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("path").isNull()).alias("lost")).first()
        if not seen.n:
            return
        if rescan is not None and (seen.n > full_scan_above or seen.lost):
            write(rescan())
        else:
            known = paths.filter("path is not null")
            write(apply_changes(read(), known, present(known)))

    return changes.writeStream.foreachBatch(apply).trigger(availableNow=True)


def job_states(records: DataFrame, files: DataFrame, runs: DataFrame) -> DataFrame:
    """path and state of every file's text record: done, changed, failed, cancelled or waiting.

    runs: path, outcome ('failed', 'cancelled'), at, of which each path's last one counts.
    """
    r = records.select("path", F.col("modified").alias("r_modified"), F.col("size").alias("r_size"), F.lit(True).alias("stored"))
    last = runs.groupBy("path").agg(F.max_by("outcome", "at").alias("outcome"))
    same: Column = (F.col("modified") == F.col("r_modified")) & (F.col("size") == F.col("r_size"))
    state = F.when(F.col("stored") & same, "done").when(F.col("stored"), "changed").otherwise(F.coalesce("outcome", F.lit("waiting")))
    return files.select("path", "modified", "size").join(r, "path", "left").join(last, "path", "left").select("path", state.alias("state"))
