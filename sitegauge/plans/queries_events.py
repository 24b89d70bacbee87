"""Registered queries over ``events``: merges, change logs, usage, and the batch form of the monitors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sitegauge.operators import merge, notes, reports, tasks
from sitegauge.operators.ranking import global_running_sum
from sitegauge.plans.inputs import prelude, table
from sitegauge.streaming import progress, sightings

HALF = "2024-01-16"
CAPS = {"text_search": 980, "place_details": 950, "psi": 25_000}
FACTS = ("value", "props")
CONTEXT = ("event_type",)


def _sightings(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").withColumn("place_id", F.concat(F.lit("u"), F.col("user_id").cast("string")))


def merge_sightings(spark, sf):
    """First event gives the context of a user, the newest one the facts."""
    return merge.merge_sightings(_sightings(spark, sf), "place_id", ("ts", "event_id"), CONTEXT, FACTS)


def merged_parts(spark, sf):
    """The same by daily parts that are merged again, as the stream does it."""
    rows = _sightings(spark, sf).withColumn("day", F.to_date("ts"))
    order = F.struct("ts", "event_id")
    parts = rows.groupBy("place_id", "day").agg(
        F.min(F.struct(order.alias("at"), F.struct(*CONTEXT).alias("v"))).alias("first"),
        F.max(F.struct(order.alias("at"), F.struct(*FACTS).alias("v"))).alias("last"), F.count("*").alias("sightings"),
    )
    return sightings.current(parts.drop("day"), "place_id", "ts")


def upsert_places(spark, sf):
    """State of the first half of the month, then the sightings of the second half."""
    rows = _sightings(spark, sf)
    at = ("ts", "event_id")
    old = merge.merge_sightings(rows.where(F.col("ts") < HALF), "place_id", at, CONTEXT, FACTS).select(
        "place_id", *CONTEXT, *FACTS, F.lit("audited").alias("stage"), F.lit("leads").alias("bucket")
    )
    return merge.upsert_places(old, rows.where(F.col("ts") >= HALF), at, CONTEXT, FACTS)


def _signals(spark, sf):
    """One row per user and day: a signal table with a value that is sometimes missing."""
    e = table(spark, sf, "events")
    return e.select(
        "user_id", "value", F.struct("ts", "event_id").alias("at"), F.when(F.col("event_type") == "signup", F.col("props")).alias("proof")
    )


def upsert_newest(spark, sf):
    rows = _signals(spark, sf)
    old = rows.where(F.col("at.ts") < HALF).groupBy("user_id").agg(F.max_by(F.struct("value", "at", "proof"), "at").alias("r")).select("user_id", "r.*")
    out = merge.upsert_newest(old, rows.where(F.col("at.ts") >= HALF), "user_id", "at")
    return out.select("user_id", "value", F.col("at.event_id").alias("event_id"), "proof")


def upsert_sticky(spark, sf):
    """As above, but a missing proof does not wipe an older one."""
    rows = _signals(spark, sf)
    old = rows.where(F.col("at.ts") < HALF).groupBy("user_id").agg(
        F.max_by(F.struct("value", "at"), "at").alias("r"), F.max_by("proof", F.when(F.col("proof").isNotNull(), F.col("at"))).alias("proof")
    ).select("user_id", "r.value", "r.at", "proof")
    # The sticky value of the old table is as old as its row says.
    out = merge.upsert_audits(old, rows.where(F.col("at.ts") >= HALF), "user_id", "at", "proof")
    return out.select("user_id", "value", F.col("at.event_id").alias("event_id"), "proof")


def status_changes(spark, sf):
    """Change log per user: purchases set a status, errors set a note, everybody is a writer."""
    e = table(spark, sf, "events").select(
        F.col("user_id").alias("place_id"), "ts", "event_id", F.col("event_type").alias("writer"),
        F.when(F.col("event_type") == "purchase", F.col("props")).alias("status"),
        F.when(F.col("event_type") == "error", F.concat(F.lit("e"), F.col("event_id").cast("string"))).alias("note"),
    )
    return notes.status_changes(e)


def usage_by_month(spark, sf):
    return tasks.usage_by_month(table(spark, sf, "usage_log"), {"text_search": 980, "place_details": 950, "psi": 25000})


def quota_cut(spark, sf):
    cut = tasks.quota_cut(table(spark, sf, "usage_log"), CAPS)
    return cut.groupBy("api", "month", "admitted").agg(F.count("*").alias("calls"), F.max("event_id").alias("last_event"))


def silent_sources(spark, sf):
    """Users of whom nothing was heard for a day at the end of January."""
    seen = table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return progress.silent(seen, F.lit("2024-01-31 00:00:00").cast("timestamp"), ("user_id",), polls=24 * 60).select("user_id", "idle")


def quota_warnings(spark, sf):
    return progress.quota_warnings(table(spark, sf, "usage_log"))


def running_usage(spark, sf):
    """Running calls per interface over the whole log."""
    log = table(spark, sf, "usage_log").select("api", "ts", "event_id", "n")
    return global_running_sum(log, ["api"], [F.col("ts"), F.col("event_id")], "n", "used").select("api", "event_id", "used")


def fresh_counts(spark, sf):
    return reports.freshness(table(spark, sf, "events"), "ts", F.lit("2024-01-20 12:00:00").cast("timestamp"))


def throughput(spark, sf):
    return progress.throughput(table(spark, sf, "events"), every="15 minutes", keys=("event_type",))


def failure_windows(spark, sf):
    return progress.failure_windows(table(spark, sf, "events"), F.col("event_type") == "error", least=8, share=0.25)


def stall_gaps(spark, sf):
    return progress.stalls(table(spark, sf, "events"), keys=("event_type",), polls=30)


def work_sessions(spark, sf):
    return progress.sessions(table(spark, sf, "events"), "30 minutes", keys=("event_type",)).select("event_type", "start", "end", "n", "polls")


QUERIES = {
    f.__name__: f
    for f in (
        merge_sightings, merged_parts, upsert_places, upsert_newest, upsert_sticky, status_changes, usage_by_month, quota_cut, silent_sources,
        quota_warnings, running_usage, fresh_counts, throughput, failure_windows, stall_gaps, work_sessions,
    )
}

_AT = "(ts, event_id)"
_MERGED = f"SELECT 'u' || user_id AS place_id, arg_min(event_type, {_AT}) AS event_type, arg_max(value, {_AT}) AS value, arg_max(props, {_AT}) AS props, min(ts) AS created_at, max(ts) AS updated_at, count(*) AS sightings FROM events GROUP BY user_id"
_LOG = prelude("usage_log")
_TICKS = "ticks AS (SELECT event_type, date_trunc('minute', ts) AS tick, count(*) AS n FROM events GROUP BY 1, 2)"

ORACLES = {
    "merge_sightings": _MERGED,
    "merged_parts": _MERGED,
    "upsert_places": f"""WITH o AS (SELECT user_id, arg_min(event_type, {_AT}) AS event_type, arg_max(value, {_AT}) AS value, arg_max(props, {_AT}) AS props FROM events WHERE ts < '{HALF}' GROUP BY user_id),
        n AS (SELECT user_id, arg_min(event_type, {_AT}) AS event_type, arg_max(value, {_AT}) AS value, arg_max(props, {_AT}) AS props FROM events WHERE ts >= '{HALF}' GROUP BY user_id)
        SELECT 'u' || coalesce(o.user_id, n.user_id) AS place_id, coalesce(o.event_type, n.event_type) AS event_type, coalesce(n.value, o.value) AS value, coalesce(n.props, o.props) AS props,
          CASE WHEN o.user_id IS NULL THEN 'discovered' ELSE 'audited' END AS stage, CASE WHEN o.user_id IS NULL THEN 'pending' ELSE 'leads' END AS bucket, o.user_id IS NULL AS is_new FROM o FULL JOIN n ON o.user_id = n.user_id""",
    "upsert_newest": f"SELECT user_id, arg_max(value, {_AT}) AS value, arg_max(event_id, {_AT}) AS event_id, CASE WHEN arg_max(event_type, {_AT}) = 'signup' THEN arg_max(props, {_AT}) END AS proof FROM events GROUP BY user_id",
    "upsert_sticky": f"SELECT user_id, arg_max(value, {_AT}) AS value, arg_max(event_id, {_AT}) AS event_id, arg_max(props, {_AT}) FILTER (event_type = 'signup') AS proof FROM events GROUP BY user_id",
    "status_changes": f"SELECT user_id AS place_id, arg_max(props, {_AT}) FILTER (event_type = 'purchase') AS status, arg_max(event_type, {_AT}) AS owner, max(ts) AS date, 'e' || arg_max(event_id, {_AT}) FILTER (event_type = 'error') AS note FROM events GROUP BY user_id",
    "usage_by_month": f"{_LOG}, u AS (SELECT api, strftime(ts, '%Y-%m') AS month, CAST(sum(n) AS BIGINT) AS used, CASE api WHEN 'text_search' THEN 980 WHEN 'place_details' THEN 950 ELSE 25000 END AS cap FROM usage_log GROUP BY 1, 2) SELECT *, used >= cap AS exhausted FROM u",
    "quota_cut": f"""{_LOG}, r AS (SELECT *, strftime(ts, '%Y-%m') AS month, row_number() OVER (PARTITION BY api, strftime(ts, '%Y-%m') ORDER BY ts, event_id) AS i FROM usage_log)
        SELECT api, month, i <= CASE api WHEN 'text_search' THEN 980 WHEN 'place_details' THEN 950 WHEN 'psi' THEN 25000 ELSE 1000000000 END AS admitted, count(*) AS calls, max(event_id) AS last_event FROM r GROUP BY 1, 2, 3""",
    "silent_sources": "SELECT user_id, CAST(floor((epoch(TIMESTAMP '2024-01-31 00:00:00') - floor(epoch(max(ts)))) / 60) AS BIGINT) AS idle FROM events GROUP BY user_id HAVING floor((epoch(TIMESTAMP '2024-01-31 00:00:00') - floor(epoch(max(ts)))) / 60) >= 1440",
    "quota_warnings": f"{_LOG}, u AS (SELECT api, strftime(ts, '%Y-%m') AS month, CAST(sum(n) AS BIGINT) AS used FROM usage_log GROUP BY 1, 2) SELECT *, used >= 900 AS warning, greatest(0, 1000 - used) AS left FROM u",
    "running_usage": f"{_LOG} SELECT api, event_id, CAST(sum(n) OVER (PARTITION BY api ORDER BY ts, event_id) AS BIGINT) AS used FROM usage_log",
    "fresh_counts": "SELECT count(*) FILTER (ts > TIMESTAMP '2024-01-20 11:55:00') AS last_5, count(*) FILTER (ts > TIMESTAMP '2024-01-20 11:45:00') AS last_15, count(*) FILTER (ts > TIMESTAMP '2024-01-20 11:00:00') AS last_60, count(*) AS total, max(ts) AS latest FROM events",
    "throughput": "SELECT time_bucket(INTERVAL 15 MINUTE, ts) AS start, time_bucket(INTERVAL 15 MINUTE, ts) + INTERVAL 15 MINUTE AS \"end\", event_type, count(*) AS n FROM events GROUP BY 1, 2, 3",
    "failure_windows": "SELECT date_trunc('hour', ts) AS start, count(*) AS n, count(*) FILTER (event_type = 'error') AS failed, count(*) > 8 AND count(*) FILTER (event_type = 'error') / count(*) > 0.25 AS alarm FROM events GROUP BY 1",
    "stall_gaps": f"WITH {_TICKS}, g AS (SELECT event_type, lag(tick) OVER (PARTITION BY event_type ORDER BY tick) AS last_progress, tick AS resumed FROM ticks) SELECT *, date_diff('minute', last_progress, resumed) - 1 AS idle FROM g WHERE date_diff('minute', last_progress, resumed) - 1 >= 30",
    "work_sessions": f"""WITH {_TICKS}, t AS (SELECT *, tick + INTERVAL 59999999 MICROSECOND AS wt FROM (SELECT event_type, tick, n FROM ticks)), f AS (SELECT *, CASE WHEN lag(wt) OVER w IS NULL OR wt > lag(wt) OVER w + INTERVAL 30 MINUTE THEN 1 ELSE 0 END AS fresh FROM t WINDOW w AS (PARTITION BY event_type ORDER BY wt)),
        s AS (SELECT *, sum(fresh) OVER (PARTITION BY event_type ORDER BY wt) AS sid FROM f) SELECT event_type, min(wt) AS start, max(wt) + INTERVAL 30 MINUTE AS "end", CAST(sum(n) AS BIGINT) AS n, count(*) AS polls FROM s GROUP BY event_type, sid""",
}
