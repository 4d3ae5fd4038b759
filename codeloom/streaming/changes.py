"""File-change streams: distilled events, debounced batches with a greatest age, merged paths."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from codeloom.runtime import prepare
from codeloom.sources.tree import excluded

#: More changed paths than this in one batch become a full walk.
MOST_PATHS = 256


def distill(events: DataFrame, rules: list[str] | None = None) -> DataFrame:
    """Change events without mere accesses and excluded paths."""
    return events.where((F.col("event_kind") != "access") & ~excluded(F.col("path"), rules or []))


def merge(paths: list[str], rescan: bool, more: list[str]) -> tuple[list[str], bool]:
    """Union of paths; a full walk absorbs them, and so do too many."""
    every = sorted(set(paths) | set(more))
    return ([], True) if rescan or len(every) > MOST_PATHS else (every, False)


def debounced_changes(events: DataFrame, quiet_seconds: float, most_seconds: float = 30, late: str = "5 seconds") -> DataFrame:
    """A stream of events(root, ts, path) as (root, began, ended, n, paths, rescan), in append mode.

    A batch ends after quiet_seconds without a change, or most_seconds after it began. State per
    root is one batch of at most MOST_PATHS paths. Of two events in one trigger the earlier is
    taken first; one that is late, but not beyond the watermark, joins the open batch.
    """
    prepare(events.sparkSession)
    schema = "root string, began timestamp, ended timestamp, n long, paths array<string>, rescan boolean"

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        out: list[tuple] = []
        began, ended, n, paths, rescan = state.get if state.exists else (0, 0, 0, [], False)

        def close() -> None:
            out.append((key[0], pd.Timestamp(began, unit="us"), pd.Timestamp(ended, unit="us"), n, list(paths), rescan))

        if state.hasTimedOut:
            close()
            state.remove()
        else:
            rows = sorted((int(t.value // 1000), p) for f in frames for t, p in zip(f["ts"], f["path"], strict=True))
            for at, path in rows:
                if n and at >= min(ended + quiet_seconds * 1e6, began + most_seconds * 1e6):
                    close()
                    n, paths, rescan = 0, [], False
                began, ended = (min(began, at), max(ended, at)) if n else (at, at)
                n += 1
                paths, rescan = merge(list(paths), rescan, [path])
            state.update((began, ended, n, list(paths), rescan))
            due = int(min(ended + quiet_seconds * 1e6, began + most_seconds * 1e6) // 1000)
            state.setTimeoutTimestamp(max(due, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=["root", "began", "ended", "n", "paths", "rescan"])

    stream = events.select("root", "ts", "path").withWatermark("ts", late).groupBy("root")
    return stream.applyInPandasWithState(run, schema, "began long, ended long, n long, paths array<string>, rescan boolean", "append", GroupStateTimeout.EventTimeTimeout)
