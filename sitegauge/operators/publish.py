"""Publication: tabs, order, row numbers, what moved, what to clear, run metadata."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitegauge import texts
from sitegauge.operators.notes import keep_worked
from sitegauge.operators.ranking import global_row_number


def tab_of(bucket: Column, with_rejected: bool = False) -> Column:
    """Tab title of a bucket; several buckets share a tab; null is not published."""
    out = None
    for title, buckets, _ in texts.TABS:
        if title == "Rejected" and not with_rejected:
            continue
        cond = bucket.isin(*buckets)
        out = F.when(cond, title) if out is None else out.when(cond, title)
    return out


def publish_keys() -> list[Column]:
    """Order inside a tab: worst site first where there is a site, surest owner first elsewhere."""
    by_owner = F.col("tab").isin(*[title for title, _, how in texts.TABS if how == "owner"])
    lead = F.when(by_owner, -F.coalesce(F.col("owner_score"), F.lit(0))).otherwise(F.coalesce(F.col("site_score"), F.lit(5)))
    return [lead.asc(), F.coalesce(F.col("user_rating_count"), F.lit(0)).desc(), F.col("place_id").asc()]


def assign_tabs(state: DataFrame, with_rejected: bool = False) -> DataFrame:
    return state.withColumn("tab", tab_of(F.col("bucket"), with_rejected)).where(F.col("tab").isNotNull())


def publish_order(state: DataFrame, with_rejected: bool = False) -> DataFrame:
    """(tab, position, place_id ...) numbered per tab over any number of rows."""
    narrow = assign_tabs(state, with_rejected).select(
        "place_id", "tab", "owner_score", "site_score", "user_rating_count"
    )
    return global_row_number(narrow, ["tab"], publish_keys(), "position")


def publication(state: DataFrame, notes: DataFrame, placement: DataFrame, with_rejected: bool = False) -> DataFrame:
    """(place_id, tab, kept_for_notes): current tabs plus the rows kept because of notes."""
    target = assign_tabs(state, with_rejected).select("place_id", "tab")
    kept = keep_worked(state, notes, placement, target, with_rejected)
    return target.withColumn("kept_for_notes", F.lit(False)).unionByName(kept)


def place_rows(target: DataFrame, placement: DataFrame, order: list[Column]) -> DataFrame:
    """Row index per place: known rows of the same tab keep theirs, new ones continue after the last."""
    old = placement.select("place_id", "tab", "row_index")
    joined = target.join(old, ["place_id", "tab"], "left")
    last = old.groupBy("tab").agg(F.max("row_index").alias("_last"))
    fresh = joined.where(F.col("row_index").isNull()).drop("row_index")
    numbered = global_row_number(fresh, ["tab"], order, "_n").join(last, "tab", "left")
    added = numbered.select(
        *target.columns, (F.coalesce("_last", F.lit(0)) + F.col("_n")).alias("row_index"), F.lit(True).alias("inserted")
    )
    kept = joined.where(F.col("row_index").isNotNull()).select(
        *target.columns, "row_index", F.lit(False).alias("inserted")
    )
    return kept.unionByName(added)


def moved_rows(placement: DataFrame, target: DataFrame) -> DataFrame:
    """Rows whose place is now in another tab or in none."""
    now = target.select("place_id", F.col("tab").alias("now_tab"))
    return placement.join(now, "place_id", "left").where(~F.col("tab").eqNullSafe(F.col("now_tab")))


def stale_rows(present: DataFrame, target: DataFrame) -> DataFrame:
    """Rows found in a tab that are not expected there, or that carry the old leftover mark."""
    marked = F.coalesce(F.col("name"), F.lit("")).startswith(texts.ORPHAN_MARKER)
    expected = target.select("place_id", "tab").withColumn("_expected", F.lit(True))
    filled = F.trim(F.coalesce("place_id", F.lit(""))) != ""
    return (
        present.join(expected, ["place_id", "tab"], "left")
        .where(marked | (filled & F.col("_expected").isNull()))
        .drop("_expected")
    )


def unify_payloads(tabs: dict[str, DataFrame]) -> DataFrame:
    """Tabs of old and new layouts as one table with a ``tab`` column; old titles are renamed."""
    out = None
    for title, df in tabs.items():
        named = df.withColumn("tab", F.lit(texts.OLD_TAB_TITLES.get(title, title)))
        out = named if out is None else out.unionByName(named, allowMissingColumns=True)
    return out


def tab_list(rows: DataFrame) -> DataFrame:
    """Tabs that have rows, without the service tabs."""
    return rows.where(~F.col("tab").isin(*texts.SERVICE_TABS)).groupBy("tab").agg(F.count("*").alias("rows"))


def migrate_columns(rows: DataFrame, layout: list[str]) -> DataFrame:
    """Rows in a newer layout: known columns by name, new ones empty, nothing dropped."""
    have = {c: F.col(f"`{c}`") for c in rows.columns}
    extra = [c for c in rows.columns if c not in layout]
    return rows.select(
        *[have.get(c, F.lit(None).cast("string")).alias(c) for c in layout], *[have[c] for c in extra]
    )


def write_tabs(rows: DataFrame, path: str) -> None:
    """Publication sink: one folder per tab under a new version path."""
    rows.write.mode("errorifexists").partitionBy("tab").parquet(path)


def run_metadata(state: DataFrame, usage: DataFrame, facts: dict[str, str]) -> DataFrame:
    """(key, value) lines about a run: given facts, counts per bucket, one line per usage row."""
    counts = state.agg(
        F.count("*").alias("places"),
        F.count_if(F.col("bucket") == "leads").alias("leads"),
        F.count_if(F.col("bucket").isin("manual", "pending")).alias("manual"),
        F.count_if(F.col("bucket") == "no_site").alias("no_site"),
        F.count_if(F.col("bucket") == "rejected").alias("rejected"),
    )
    lines = counts.select(
        F.expr(
            "stack(5, 'Місць у базі всього', string(places), 'Leads', string(leads), "
            "'Manual review', string(manual), 'NO_SITE', string(no_site), 'Rejected', string(rejected)) "
            "as (key, value)"
        )
    )
    given = counts.select(
        F.explode(F.create_map(*[F.lit(x) for kv in facts.items() for x in kv])).alias("key", "value")
    ) if facts else None
    spent = usage.select(
        F.concat(F.lit("API "), "api", F.lit(" ("), "month", F.lit(")")).alias("key"),
        F.col("used").cast("string").alias("value"),
    )
    out = lines.unionByName(spent)
    return given.unionByName(out) if given is not None else out
