"""Progress events as streams: replay, deduplication, snapshots that only rise, counters, windows."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

TERMINAL = ("succeeded", "succeeded_partial", "failed", "cancelled")


def replay(events: DataFrame, cursor: int) -> DataFrame:
    """Events after the cursor; a streaming source's own checkpoint keeps it between runs."""
    return events.where(F.col("seq") > cursor)


def deduplicated(events: DataFrame, time: str = "created_at", delay: str = "10 minutes") -> DataFrame:
    """One event per (job_id, seq) within the watermark, whatever the order of arrival."""
    return events.withWatermark(time, delay).dropDuplicatesWithinWatermark(["job_id", "seq"])


SNAPSHOT = "job_id string, status string, progress int, stage string, n_events long"


def snapshots(events: DataFrame) -> DataFrame:
    """The state of each job after each batch of events (job_id, seq, stage, status, level, progress).

    Progress rises only, and only by events of level info; a job that has ended stays as it
    ended, whatever arrives later. Events of one batch count in the order of seq.
    """

    def fold(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        status, progress, stage, n = state.get if state.exists else ("queued", 0, "", 0)
        for e in pd.concat(list(batches)).sort_values("seq").itertuples():
            n += 1
            if status in TERMINAL:
                continue
            stage = e.stage or stage
            if e.level == "info" and e.progress is not None and not pd.isna(e.progress):
                progress = max(progress, int(e.progress))
            if e.status in TERMINAL or (e.status and status == "queued"):
                status = e.status
        state.update((status, progress, stage, n))
        yield pd.DataFrame({"job_id": [key[0]], "status": [status], "progress": [progress], "stage": [stage], "n_events": [n]})

    return events.groupBy("job_id").applyInPandasWithState(fold, SNAPSHOT, "status string, progress int, stage string, n long", "update", GroupStateTimeout.NoTimeout)


def counters(observations: DataFrame, labels: list[str], bounds: tuple[float, ...] = (0.1, 0.5, 1.0, 5.0)) -> DataFrame:
    """Count, sum and cumulative buckets of the observed values by label; the same plan for tables and streams."""
    buckets = [F.count_if(F.col("value") <= b).alias(f"le_{str(b).replace('.', '_')}") for b in bounds]
    return observations.groupBy(*labels).agg(F.count("*").alias("n"), F.sum("value").alias("total"), *buckets)


def windowed(events: DataFrame, keys: list[str], size: str, slide: str | None = None, time: str = "ts", delay: str = "1 hour", value: str = "value") -> DataFrame:
    """Extra: counts and sums in tumbling or sliding windows of event time; later than `delay` is dropped."""
    w = F.window(time, size, slide) if slide else F.window(time, size)
    g = events.withWatermark(time, delay).groupBy(w.alias("w"), *keys).agg(F.count("*").alias("n"), F.sum(value).alias("total"))
    return g.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *keys, "n", "total")


def sessions(events: DataFrame, keys: list[str], gap: str, time: str = "ts", delay: str = "1 hour") -> DataFrame:
    """Extra: sessions that a gap ends."""
    g = events.withWatermark(time, delay).groupBy(*keys, F.session_window(time, gap).alias("w")).agg(F.count("*").alias("n"))
    return g.select(*keys, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")
