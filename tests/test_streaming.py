"""Streams over files, run to completion."""

import datetime as dt

from pyspark.sql import functions as F

from corpuscle.streaming import progress

SCHEMA = "job_id string, seq long, stage string, status string, level string, progress int, created_at timestamp"


def run(spark, stream, name, mode):
    q = stream.writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return spark.table(name).collect()


def test_snapshots_rise_and_freeze(spark, tmp_path):
    at = dt.datetime(2024, 1, 1)
    rows = [("j", 2, "b", "running", "info", 40, at), ("j", 1, "a", "running", "info", 60, at), ("j", 3, "b", "running", "error", 90, at), ("j", 4, "c", "failed", "info", 70, at), ("j", 5, "d", "running", "info", 99, at), ("k", 1, "a", None, "info", None, at)]
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(str(tmp_path / "e"))
    stream = spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "e"))
    got = {r.job_id: (r.status, r.progress, r.stage, r.n_events) for r in run(spark, progress.snapshots(progress.replay(stream, 0)), "snap", "update")}
    assert got == {"j": ("failed", 70, "c", 5), "k": ("queued", 0, "a", 1)}


def test_deduplication_and_counters(spark, tmp_path):
    at = dt.datetime(2024, 1, 1)
    rows = [("j", 1, "a", None, "info", 1, at), ("j", 1, "a", None, "info", 1, at + dt.timedelta(seconds=5)), ("j", 2, "a", None, "info", 1, at)]
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(str(tmp_path / "e"))
    stream = spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "e"))
    assert sorted(r.seq for r in run(spark, progress.deduplicated(stream), "dedup", "append")) == [1, 2]
    totals = run(spark, progress.counters(stream.withColumn("value", F.col("progress").cast("double")), ["stage"]), "counts", "complete")
    assert [(r.n, r.total, r.le_0_5, r.le_1_0) for r in totals] == [(3, 3.0, 0, 3)]


def test_windows_over_events(spark, sf):
    batch = spark.read.parquet(f"{sf}/events.parquet")
    assert progress.windowed(batch, ["event_type"], "1 day").agg(F.sum("n")).first()[0] == batch.count()
    assert progress.windowed(batch, [], "2 hours", "1 hour").agg(F.sum("n")).first()[0] == 2 * batch.count()
    assert progress.sessions(batch, ["user_id"], "30 hours").agg(F.sum("n")).first()[0] == batch.count()
