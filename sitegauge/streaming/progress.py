"""Progress of running jobs: throughput, stalls, failure share, quota warnings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# --- fixed values -----------------------------------------------------------
STALL_POLLS = 3
FAILURE_LEAST_ROWS, FAILURE_SHARE = 300, 0.35
QUOTA_WARN, QUOTA_LIMIT = 900, 1000
# --- end of fixed values ----------------------------------------------------


def _timed(events: DataFrame, at: str, delay: str) -> DataFrame:
    """Event time with a watermark; times without a zone are read in the session's."""
    if not events.isStreaming:
        return events
    return events.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, delay)


def throughput(events: DataFrame, at: str = "ts", every: str = "5 minutes", delay: str = "10 minutes",
               keys: tuple[str, ...] = ()) -> DataFrame:
    """Rows per interval (and key)."""
    return (
        _timed(events, at, delay)
        .groupBy(F.window(at, every), *keys)
        .agg(F.count("*").alias("n"))
        .select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), *keys, "n")
    )


def failure_windows(events: DataFrame, failed: Column, at: str = "ts", every: str = "1 hour",
                    delay: str = "10 minutes", least: int = FAILURE_LEAST_ROWS,
                    share: float = FAILURE_SHARE) -> DataFrame:
    """Share of failures per interval and whether it calls for an alarm."""
    return (
        _timed(events, at, delay)
        .groupBy(F.window(at, every))
        .agg(F.count("*").alias("n"), F.count_if(failed).alias("failed"))
        .select(
            F.col("window.start").alias("start"), "n", "failed",
            ((F.col("n") > least) & (F.col("failed") / F.col("n") > share)).alias("alarm"),
        )
    )


def sessions(events: DataFrame, gap: str, at: str = "ts", keys: tuple[str, ...] = (),
             delay: str = "10 minutes", poll: str = "1 minute") -> DataFrame:
    """Stretches of steady progress; each ends where nothing came for ``gap``.

    A stream needs at least one key.

    Rows are first counted per poll interval, which combines before the shuffle, so a
    source with a third of all rows sends one row per interval and task.
    """
    polls = (
        _timed(events, at, delay).groupBy(F.window(at, poll), *keys).agg(F.count("*").alias("_n"))
    )
    return (
        polls.groupBy(F.session_window(F.window_time("window"), gap), *keys)
        .agg(F.sum("_n").alias("n"), F.count("*").alias("polls"))
        .select(
            F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), *keys, "n", "polls"
        )
    )


def stalls(events: DataFrame, at: str = "ts", keys: tuple[str, ...] = (), polls: int = STALL_POLLS,
           poll: str = "minute") -> DataFrame:
    """Batch form of the stall alarm: gaps of at least ``polls`` polls without a row."""
    ticks = events.select(*keys, F.date_trunc(poll, F.col(at)).alias("tick")).distinct()
    w = Window.partitionBy(*keys).orderBy("tick")
    gap = (F.unix_timestamp("tick") - F.unix_timestamp("prev")) / 60 - 1
    return (
        ticks.withColumn("prev", F.lag("tick").over(w))
        .withColumn("idle", gap.cast("long"))
        .where(F.col("idle") >= polls)
        .select(*keys, F.col("prev").alias("last_progress"), F.col("tick").alias("resumed"), "idle")
    )


def last_seen(events: DataFrame, keys: tuple[str, ...], at: str = "ts") -> DataFrame:
    """Newest time per source; the newest of several such tables is the same of all their rows."""
    return events.groupBy(*keys).agg(F.max(at).alias(at))


def record(stream: DataFrame, out: str, checkpoint: str, keys: tuple[str, ...], at: str = "ts", available_now: bool = False):
    """Keep :func:`last_seen` of every micro-batch under ``out/batch=N``, for :func:`silent`."""

    def write(batch: DataFrame, batch_id: int) -> None:
        last_seen(batch, keys, at).write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    writer = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def silent(seen: DataFrame, as_of: Column, keys: tuple[str, ...], at: str = "ts", polls: int = STALL_POLLS) -> DataFrame:
    """The stall alarm: sources from which nothing came for ``polls`` minutes before ``as_of``.

    A stalled source sends nothing that could move a watermark, so the clock comes from outside: this is a small
    batch over the recorded times, run as often as an alarm may be late.
    """
    idle = F.floor((F.unix_timestamp(as_of) - F.unix_timestamp(at)) / 60).cast("long")
    return last_seen(seen, keys, at).select(*keys, F.col(at).alias("last_progress"), idle.alias("idle")).where(F.col("idle") >= polls)


def quota_warnings(log: DataFrame, at: str = "ts", warn: int = QUOTA_WARN, limit: int = QUOTA_LIMIT) -> DataFrame:
    """Running calls per (api, month) with the warning flags; use output mode ``update``."""
    return (
        log.groupBy("api", F.date_format(at, "yyyy-MM").alias("month"))
        .agg(F.sum("n").alias("used"))
        .withColumn("warning", F.col("used") >= warn)
        .withColumn("left", F.greatest(F.lit(0).cast("long"), F.lit(limit) - F.col("used")))
    )
