"""Search tasks: expansion, what is left to do, budget preflight, metered usage."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitegauge.functions.text import short_id
from sitegauge.operators.ranking import global_row_number
from sitegauge.params import DEFAULT, FREE_TIER, Preset

# --- fixed values -----------------------------------------------------------
GEO_PAGES, OTHER_PAGES = 2.2, 1.3
# --- end of fixed values ----------------------------------------------------


@dataclass(frozen=True)
class Niche:
    key: str
    tier: str
    label: str
    text_query: str
    included_type: str | None = None


def _niche_array(niches: Sequence[Niche]) -> Column:
    return F.array(*[
        F.struct(
            F.lit(n.key).alias("key"), F.lit(n.tier).alias("tier"), F.lit(n.text_query).alias("query"),
            F.lit(n.included_type).cast("string").alias("type"),
        )
        for n in niches
    ])


def _strings(values: Sequence[str]) -> Column:
    return F.array(*[F.lit(v) for v in values])


def expand_tasks(metros: DataFrame, hoods: DataFrame, niches: Sequence[Niche], markers: Sequence[str],
                 standalone: Sequence[str], preset: Preset = DEFAULT) -> DataFrame:
    """Search tasks of three kinds.

    The short lists of the configuration are exploded as literals on each metro or
    hood row, so nothing is cross-joined or shuffled.
    ``metros``: metro_key, label, lat, lng, radius_m.  ``hoods``: metro_key, hood_name, lat, lng, radius_m.
    """
    d = preset.discovery
    active = [n for n in niches if n.tier in preset.tiers]
    wide = [n for n in active if n.tier in d.marker_tiers]
    dense = [n for n in active if n.tier in d.geo_tiers]
    null = F.lit(None).cast("string")
    columns = ("task_id", "metro_key", "mode", "text_query", "included_type", "niche_key", "hood_name", "bias")

    def bias() -> Column:
        return F.struct("lat", "lng", "radius_m")

    branches = []
    if d.marker_mode and standalone:
        rows = metros.withColumn("_q", F.explode(_strings(standalone)))
        query = F.concat("_q", F.lit(" in "), "label")
        branches.append(rows.select(
            short_id(F.lit("standalone"), F.col("metro_key"), query), "metro_key", F.lit("ethnic-standalone"),
            query, null, null, null, bias(),
        ).toDF(*columns))
    if d.marker_mode and wide and markers:
        rows = metros.withColumn("_n", F.explode(_niche_array(wide))).withColumn(
            "_m", F.explode(_strings(list(markers)[: d.marker_limit]))
        )
        query = F.concat("_m", F.lit(" "), F.col("_n")["query"], F.lit(" in "), "label")
        branches.append(rows.select(
            short_id(F.lit("ethnic"), F.col("metro_key"), F.col("_m"), F.col("_n")["key"]), "metro_key",
            F.lit("ethnic"), query, null, F.col("_n")["key"], null, bias(),
        ).toDF(*columns))
    if d.geo_dense_mode and dense:
        rows = hoods.withColumn("_n", F.explode(_niche_array(dense)))
        branches.append(rows.select(
            short_id(F.lit("geo"), F.col("metro_key"), F.col("hood_name"), F.col("_n")["key"]), "metro_key",
            F.lit("geo-dense"), F.concat(F.col("_n")["query"], F.lit(" near "), "hood_name"),
            F.col("_n")["type"], F.col("_n")["key"], "hood_name", bias(),
        ).toDF(*columns))
    out = branches[0]
    for b in branches[1:]:
        out = out.unionByName(b)
    return out


def pending_tasks(tasks: DataFrame, runs: DataFrame) -> DataFrame:
    return tasks.join(runs.select("task_id"), "task_id", "left_anti")


def niche_labels(df: DataFrame, niches: Sequence[Niche], key: str = "niche_key") -> DataFrame:
    """Add tier and label of the niche; the list is configuration, so it is a map literal."""
    tiers = F.create_map(*[F.lit(x) for n in niches for x in (n.key, n.tier)])
    labels = F.create_map(*[F.lit(x) for n in niches for x in (n.key, n.label)])
    return df.withColumn("niche_tier", tiers[F.col(key)]).withColumn("niche_label", labels[F.col(key)])


def preflight(tasks: DataFrame, runs: DataFrame, left: int, preset: Preset = DEFAULT) -> DataFrame:
    """Does the rest of the plan fit: expected calls, calls needed, tasks that fit."""
    pages = F.when(
        F.col("mode") == "geo-dense", F.lit(min(preset.discovery.max_pages_per_query, GEO_PAGES))
    ).otherwise(F.lit(OTHER_PAGES))
    flagged = tasks.join(runs.select("task_id").distinct().withColumn("_done", F.lit(True)), "task_id", "left")
    sums = flagged.agg(
        F.count("*").alias("tasks"),
        F.floor(F.sum(F.round(pages * 10).cast("long")) / 10 + F.lit(0.5)).cast("long").alias("expected"),
        F.count_if(F.col("_done").isNull()).alias("todo"),
    )
    per_task = F.col("expected") / F.greatest("tasks", F.lit(1))
    needed = F.ceil(F.col("todo") * per_task)
    return sums.select(
        "tasks", "todo", "expected", needed.cast("long").alias("needed"),
        F.greatest(F.lit(0), F.floor(F.lit(left) / F.greatest(per_task, F.lit(0.1)))).cast("long").alias("fits"),
        (needed <= left).alias("start"),
    )


def usage_by_month(log: DataFrame, caps: dict[str, int] | None = None) -> DataFrame:
    """Calls per (api, month) from the event log, with the cap and whether it is used up."""
    caps = caps or FREE_TIER
    cap = F.create_map(*[F.lit(x) for kv in caps.items() for x in kv])[F.col("api")]
    return (
        log.groupBy("api", F.date_format("ts", "yyyy-MM").alias("month"))
        .agg(F.sum("n").alias("used"))
        .withColumn("cap", cap)
        .withColumn("exhausted", F.coalesce(F.col("used") >= F.col("cap"), F.lit(False)))
    )


def quota_cut(log: DataFrame, caps: dict[str, int], key: str = "event_id") -> DataFrame:
    """Which calls a monthly cap lets through: the first ``cap`` of each (api, month), whatever the cap.

    Capped calls are numbered over range partitions, so no task holds a whole (api, month).
    """
    free = {api: min(cap, FREE_TIER.get(api, cap)) for api, cap in caps.items()}
    calls = log.withColumn("month", F.date_format("ts", "yyyy-MM")).withColumn(
        "cap", F.create_map(*[F.lit(x) for kv in free.items() for x in kv])[F.col("api")]
    )
    capped = calls.where(F.col("cap").isNotNull())
    numbered = global_row_number(capped, ["api", "month"], [F.col("ts"), F.col(key)], "_number")
    admitted = numbered.withColumn("admitted", F.col("_number") <= F.col("cap")).drop("_number")
    return admitted.unionByName(calls.where(F.col("cap").isNull()).withColumn("admitted", F.lit(True)))


def remaining(used: Column, cap: int, api: str) -> Column:
    return F.greatest(F.lit(0), F.lit(min(cap, FREE_TIER.get(api, cap))) - used)
