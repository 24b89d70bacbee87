"""Incremental sightings to merged places.

Each micro-batch is reduced to one row per place and appended under its batch id;
merging is associative, so the current state is the merge of all parts and a
compaction is the same merge written to a new path.  Nothing is rewritten while
the stream runs, and a repeated batch overwrites only its own folder.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def deduplicated(stream: DataFrame, key: str, at: str, delay: str = "1 hour") -> DataFrame:
    """Drop repeated deliveries of one sighting."""
    return stream.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, delay).dropDuplicatesWithinWatermark([key])


def reduce_batch(batch: DataFrame, key: str, at: Sequence[str], context: Sequence[str],
                 facts: Sequence[str]) -> DataFrame:
    """One part row per key that can be merged again: first context, newest facts, their times."""
    order = F.struct(*at)
    return batch.groupBy(key).agg(
        F.min(F.struct(order.alias("at"), F.struct(*context).alias("v"))).alias("first"),
        F.max(F.struct(order.alias("at"), F.struct(*facts).alias("v"))).alias("last"),
        F.count("*").alias("sightings"),
    )


def merge_parts(parts: DataFrame, key: str) -> DataFrame:
    return parts.groupBy(key).agg(
        F.min("first").alias("first"), F.max("last").alias("last"), F.sum("sightings").alias("sightings")
    )


def current(parts: DataFrame, key: str, at: str) -> DataFrame:
    """Merged places as plain columns."""
    merged = merge_parts(parts, key)
    return merged.select(
        key, "first.v.*", "last.v.*", F.col("first.at")[at].alias("created_at"),
        F.col("last.at")[at].alias("updated_at"), "sightings",
    )


def start(stream: DataFrame, out: str, checkpoint: str, key: str, at: Sequence[str], context: Sequence[str],
          facts: Sequence[str], available_now: bool = False):
    """Run the stream; parts go to ``out/batch=N``."""

    def write(batch: DataFrame, batch_id: int) -> None:
        reduce_batch(batch, key, at, context, facts).write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    writer = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def read_parts(spark: SparkSession, out: str, compacted: str | None = None) -> DataFrame:
    """All parts, or those that a compaction holds already and the parts after it."""
    parts = spark.read.parquet(out)
    if compacted is None:
        return parts.drop("batch")
    held = spark.read.parquet(compacted)
    upto = held.agg(F.max("upto")).first()[0]
    return held.drop("upto").unionByName(parts.where(F.col("batch") > upto).drop("batch"))


def compact(spark: SparkSession, out: str, to: str, key: str, previous: str | None = None) -> None:
    """Merge the parts written so far, and a previous compaction, to one row per key in the new folder ``to``.

    Parts stay where they are; those up to the newest batch seen now can be removed once no reader needs them. A batch
    that is still being written has a higher number and is read as a part.
    """
    newest = spark.read.parquet(out).agg(F.max("batch")).first()[0]
    seen = spark.read.parquet(out).where(F.col("batch") <= newest)
    rows = seen.drop("batch")
    if previous is not None:
        held = spark.read.parquet(previous)
        upto = held.agg(F.max("upto")).first()[0]
        rows = held.drop("upto").unionByName(seen.where(F.col("batch") > upto).drop("batch"))
    merge_parts(rows, key).withColumn("upto", F.lit(newest)).write.parquet(to)
