"""The streams run to the end over copies of the test events and equal their batch form."""

import pytest
from pyspark.sql import functions as F

from sitegauge.streaming import progress, sightings

EVENTS = "/root/testdata/sf0.001/events.parquet"


@pytest.fixture
def stream(spark, tmp_path):
    batch = spark.read.parquet(EVENTS).withColumn("ts", F.col("ts").cast("timestamp"))
    for i, part in enumerate(("ts < '2024-01-11'", "ts >= '2024-01-11' and ts < '2024-01-21'", "ts >= '2024-01-21'")):
        batch.where(part).coalesce(1).write.parquet(str(tmp_path / "in" / f"p{i}"))
    live = spark.readStream.schema(batch.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "*"))
    return batch, live, tmp_path


def run(df, mode, tmp_path, name):
    q = (df.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", str(tmp_path / f"ck_{name}"))
         .trigger(availableNow=True).start())
    assert q.awaitTermination(120)
    return df.sparkSession.table(name)


def test_throughput_stream(stream):
    batch, live, tmp = stream
    got = run(progress.throughput(live, every="1 hour"), "update", tmp, "thr").groupBy("start").agg(F.max("n").alias("n"))
    want = progress.throughput(batch, every="1 hour")
    assert {(r["start"], r["n"]) for r in got.collect()} == {(r["start"], r["n"]) for r in want.collect()}


def test_quota_stream(stream):
    batch, live, tmp = stream
    log = lambda d: d.select(F.col("event_type").alias("api"), "ts", F.lit(1).alias("n"))
    got = run(progress.quota_warnings(log(live), warn=150), "update", tmp, "quota").groupBy("api").agg(F.max("used").alias("used"), F.max("warning").alias("warning"))
    want = progress.quota_warnings(log(batch), warn=150)
    assert {(r["api"], r["used"], r["warning"]) for r in got.collect()} == {(r["api"], r["used"], r["warning"]) for r in want.collect()}


def test_sessions_stream_emits_closed_sessions(stream):
    batch, live, tmp = stream
    got = run(progress.sessions(live, "3 hours", keys=("event_type",)), "append", tmp, "sess")
    want = {(r["start"], r["n"]) for r in progress.sessions(batch, "3 hours", keys=("event_type",)).collect()}
    rows = {(r["start"], r["n"]) for r in got.collect()}
    assert rows <= want


def test_failure_stream(stream):
    batch, live, tmp = stream
    f = lambda d: progress.failure_windows(d, F.col("event_type") == "error", every="1 day", least=5, share=0.1)
    got = run(f(live), "update", tmp, "fail").groupBy("start").agg(F.max("n").alias("n"), F.max("failed").alias("failed"))
    assert {(r["start"], r["n"], r["failed"]) for r in got.collect()} == {(r["start"], r["n"], r["failed"]) for r in f(batch).collect()}


def test_sightings_stream_merges_to_the_batch_result(stream, spark):
    batch, live, tmp = stream
    at, ctx, facts = ("ts", "event_id"), ("event_type",), ("value", "props")
    clean = sightings.deduplicated(live, "event_id", "ts")
    q = sightings.start(clean, str(tmp / "parts"), str(tmp / "ck"), "user_id", at, ctx, facts, available_now=True)
    assert q.awaitTermination(120)
    got = sightings.current(sightings.read_parts(spark, str(tmp / "parts")), "user_id", "ts")
    want = sightings.current(sightings.reduce_batch(batch, "user_id", at, ctx, facts), "user_id", "ts")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_compaction_changes_nothing(stream, spark):
    batch, live, tmp = stream
    at, ctx, facts = ("ts", "event_id"), ("event_type",), ("value", "props")
    q = sightings.start(live, str(tmp / "parts"), str(tmp / "ck"), "user_id", at, ctx, facts, available_now=True)
    assert q.awaitTermination(120)
    rows = lambda *a: sorted(map(tuple, sightings.current(sightings.read_parts(spark, *a), "user_id", "ts").collect()))
    want = rows(str(tmp / "parts"))
    sightings.compact(spark, str(tmp / "parts"), str(tmp / "c1"), "user_id")
    assert rows(str(tmp / "parts"), str(tmp / "c1")) == want
    assert spark.read.parquet(str(tmp / "c1")).count() == batch.select("user_id").distinct().count()
    # More batches after the compaction, and a second one on top of it.
    sightings.reduce_batch(batch, "user_id", at, ctx, facts).write.parquet(str(tmp / "parts" / "batch=7"))
    later = rows(str(tmp / "parts"))
    assert later != want and rows(str(tmp / "parts"), str(tmp / "c1")) == later
    sightings.compact(spark, str(tmp / "parts"), str(tmp / "c2"), "user_id", str(tmp / "c1"))
    assert rows(str(tmp / "parts"), str(tmp / "c2")) == later


def test_a_stream_that_stops_raises_the_alarm(stream, spark):
    """No event comes to close a window; the alarm comes from the clock."""
    batch, live, tmp = stream
    q = progress.record(live, str(tmp / "seen"), str(tmp / "ck"), ("event_type",), available_now=True)
    assert q.awaitTermination(120)
    seen = spark.read.parquet(str(tmp / "seen"))
    newest = {r["event_type"]: r["ts"] for r in progress.last_seen(batch, ("event_type",)).collect()}
    latest = F.lit(max(newest.values()))
    early = progress.silent(seen, latest, ("event_type",), polls=60 * 24 * 365)
    assert early.count() == 0
    alarm = progress.silent(seen, latest + F.expr("INTERVAL 10 MINUTES"), ("event_type",), polls=10).collect()
    assert {r["event_type"]: r["last_progress"] for r in alarm} == newest and all(r["idle"] >= 10 for r in alarm)
