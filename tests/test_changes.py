"""Upserts that leave the state where it is, alarms of a stream, and rows that come late."""

import time

import pytest
from pyspark.sql import functions as F

from sitegauge.operators import merge
from sitegauge.streaming import alarm


@pytest.fixture
def tables(spark, tmp_path):
    old = spark.range(2000).select(F.concat(F.lit("p"), "id").alias("place_id"), F.lit(1).alias("at"), F.lit("old").alias("v"), F.when(F.col("id") % 2 == 0, "proof").alias("proof"))
    old.write.parquet(str(tmp_path / "old"))
    new = spark.range(1990, 2030).select(
        F.concat(F.lit("p"), "id").alias("place_id"), F.explode(F.array(F.lit(5), F.lit(7))).alias("at"), F.lit("x").alias("v"), F.lit(None).cast("string").alias("proof")
    ).withColumn("v", F.concat(F.lit("new"), "at"))
    return spark.read.parquet(str(tmp_path / "old")), new


@pytest.mark.parametrize("most_rows", [1000, 0])
def test_both_ways_give_the_same_state(spark, tables, most_rows):
    old, new = tables
    newest = {r["place_id"]: (r["at"], r["v"], r["proof"]) for r in merge.upsert_newest(old, new, "place_id", "at", most_rows).collect()}
    sticky = {r["place_id"]: (r["at"], r["v"], r["proof"]) for r in merge.upsert_audits(old, new, "place_id", "at", "proof", most_rows).collect()}
    for i in range(2030):
        had = "proof" if i < 2000 and i % 2 == 0 else None
        changed = i >= 1990
        assert newest[f"p{i}"] == ((7, "new7", None) if changed else (1, "old", had))
        assert sticky[f"p{i}"] == ((7, "new7", had) if changed else (1, "old", had))
    assert len(newest) == len(sticky) == 2030
    places = old.select("place_id", F.lit("c").alias("metro_key"), "v", F.lit("kept").alias("bucket"), F.lit("audited").alias("stage"))
    got = merge.upsert_places(places, new.withColumn("metro_key", F.lit("other")), ("at",), ("metro_key",), ("v",), most_rows)
    rows = {r["place_id"]: (r["metro_key"], r["v"], r["bucket"], r["stage"], r["is_new"]) for r in got.collect()}
    assert rows["p1995"] == ("c", "new7", "kept", "audited", False) and rows["p2005"] == ("other", "new7", "pending", "discovered", True)
    assert rows["p5"] == ("c", "old", "kept", "audited", False) and len(rows) == 2030


def test_the_state_is_not_shuffled(spark, tables):
    old, new = tables
    for out in (
        merge.upsert_newest(old, new, "place_id", "at"), merge.upsert_audits(old, new, "place_id", "at", "proof"),
        merge.upsert_places(old.select("place_id", "v"), new, ("at",), (), ("v",)),
    ):
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "FileScan" in plan and "hashpartitioning" not in plan and "SortMergeJoin" not in plan, plan


def wait_for(test, seconds=90):
    end = time.time() + seconds
    while time.time() < end:
        if test():
            return True
        time.sleep(0.5)
    return False


def test_a_silent_source_raises_the_alarm_once(spark, tmp_path):
    """No job beside the stream and no further input: the alarm comes out of the stream's own timers."""
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", alarm.STATE_STORE)
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    try:
        spark.range(30).select(F.when(F.col("id") % 3 == 0, "a").otherwise("b").alias("source"), "id").write.parquet(str(tmp_path / "in" / "p0"))
        live = spark.readStream.schema("source string, id long").parquet(str(tmp_path / "in" / "*"))
        query = (
            alarm.silence_alarm(live, ("source",), polls=3, poll_seconds=1).writeStream.outputMode("update").format("memory").queryName("silent")
            .option("checkpointLocation", str(tmp_path / "ck")).trigger(processingTime="500 milliseconds").start()
        )
        try:
            rows = lambda state: {(r["source"], r["n"]) for r in spark.table("silent").where(F.col("state") == state).collect()}
            assert wait_for(lambda: rows("silent") == {("a", 10), ("b", 20)}), spark.table("silent").collect()
            time.sleep(4)
            assert spark.table("silent").count() == 2  # Once each, not again and again.
            spark.range(4).select(F.lit("a").alias("source"), "id").write.parquet(str(tmp_path / "in" / "p1"))
            assert wait_for(lambda: rows("resumed") == {("a", 14)})
            assert wait_for(lambda: rows("silent") == {("a", 10), ("b", 20), ("a", 14)})
            assert all(r["idle_seconds"] >= 3 for r in spark.table("silent").where("state = 'silent'").collect())
        finally:
            query.stop()
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
        spark.conf.set("spark.sql.shuffle.partitions", "8")


def test_late_rows_are_counted(spark, tmp_path):
    record = alarm.StateRecord(spark, str(tmp_path / "record"), every=1)
    spark.streams.addListener(record)
    try:
        for i, times in enumerate((["2024-01-01 00:00", "2024-01-01 01:00"], ["2024-01-01 05:00"], ["2024-01-01 00:10", "2024-01-01 00:20", "2024-01-01 05:01"])):
            spark.createDataFrame([(t,) for t in times], "ts string").select(F.col("ts").cast("timestamp")).coalesce(1).write.parquet(str(tmp_path / "in" / f"p{i}"))
            live = spark.readStream.schema("ts timestamp").parquet(str(tmp_path / "in" / "*"))
            counts = live.withWatermark("ts", "10 minutes").groupBy(F.window("ts", "5 minutes")).count()
            q = (counts.writeStream.outputMode("append").format("noop").queryName("late").option("checkpointLocation", str(tmp_path / "ck"))
                 .trigger(availableNow=True).start())
            assert q.awaitTermination(120)

        def totals():
            record.flush()
            rows = alarm.dropped_rows(spark.read.parquet(str(tmp_path / "record"))).collect() if (tmp_path / "record").exists() else []
            return rows and rows[0]["query"] == "late" and rows[0]["dropped"] == 2 and rows[0]["state_rows"] >= 1

        assert wait_for(totals, 30), spark.read.parquet(str(tmp_path / "record")).collect()
    finally:
        spark.streams.removeListener(record)
