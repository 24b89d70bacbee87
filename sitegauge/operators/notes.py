"""Notes that people keep on published rows.  No scoring job writes them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitegauge import texts

FIELDS = ("status", "owner", "date", "note")


def tab_position(tab: Column) -> Column:
    titles = F.array(*[F.lit(title) for title, _, _ in texts.TABS])
    return F.array_position(titles, tab)


def _filled() -> Column:
    out = F.lit(False)
    for f in FIELDS:
        out = out | (F.trim(F.coalesce(F.col(f), F.lit(""))) != "")
    return out


def collect_notes(rows: DataFrame) -> DataFrame:
    """One note per place over all tabs: the last tab in order that says anything wins."""
    clean = rows.where(F.trim(F.coalesce("place_id", F.lit(""))) != "").select(
        F.trim("place_id").alias("place_id"), "tab",
        *[F.trim(F.coalesce(F.col(f), F.lit(""))).alias(f) for f in FIELDS],
    )
    picked = clean.where(_filled()).groupBy("place_id").agg(
        F.max_by(F.struct(*FIELDS), F.struct(tab_position(F.col("tab")), "tab")).alias("_n")
    )
    return picked.select("place_id", *[F.col("_n")[f].alias(f) for f in FIELDS])


def attach_notes(published: DataFrame, notes: DataFrame) -> DataFrame:
    """Notes follow the row to whatever tab it is in now."""
    return published.join(notes, "place_id", "left")


def status_changes(events: DataFrame, key: str = "place_id") -> DataFrame:
    """Current status per place from the change log: for each field the last writer wins.

    Owner and date always come from the newest event; status and note only from events
    that set them.
    """
    order = F.struct("ts", "event_id")
    last = lambda c: F.max(F.when(F.col(c).isNotNull(), F.struct(order.alias("o"), F.col(c).alias("v"))))
    picked = events.groupBy(key).agg(
        last("status").alias("_s"), last("note").alias("_n"),
        F.max_by(F.col("writer"), order).alias("owner"), F.max("ts").alias("date"),
    )
    return picked.select(key, F.col("_s")["v"].alias("status"), "owner", "date", F.col("_n")["v"].alias("note"))


def serial_number(x: Column) -> Column:
    return x.try_cast("double")


def is_serial_date(x: Column) -> Column:
    n = serial_number(x)
    return F.coalesce((n > 20_000) & (n < 100_000), F.lit(False))


def repair_shifted(rows: DataFrame) -> DataFrame:
    """Rows whose status holds a name and whose owner holds a serial date are shifted by one:
    the name goes back to the owner, the lost status stays empty."""
    status = F.trim(F.coalesce("status", F.lit("")))
    shifted = (status != "") & ~status.isin(*texts.STATUSES) & is_serial_date(F.col("owner"))
    return (
        rows.withColumn("shifted", shifted)
        .withColumn("owner", F.when(F.col("shifted"), F.trim("status")).otherwise(F.col("owner")))
        .withColumn("status", F.when(F.col("shifted"), "").otherwise(F.col("status")))
    )


def clear_notes(rows: DataFrame) -> DataFrame:
    out = rows
    for f in FIELDS:
        out = out.withColumn(f, F.lit(None).cast("string"))
    return out


def clear_preview(rows: DataFrame) -> DataFrame:
    """How many rows per tab a clearing would touch."""
    return rows.where(_filled()).groupBy("tab").agg(F.count("*").alias("rows"))


def keep_worked(places: DataFrame, notes: DataFrame, placement: DataFrame, target: DataFrame,
                with_rejected: bool = False) -> DataFrame:
    """Places people worked on that would drop out: they stay in the tab they were in.

    ``target`` is ``(place_id, tab)`` of the coming publication.
    """
    live = [title for title, _, _ in texts.TABS if with_rejected or title != "Rejected"]
    orphan = notes.select("place_id").join(target.select("place_id"), "place_id", "left_anti")
    kept = (
        orphan.join(placement.where(F.col("tab").isin(*live)).select("place_id", "tab"), "place_id")
        .join(places.select("place_id"), "place_id", "left_semi")
    )
    return kept.select("place_id", "tab", F.lit(True).alias("kept_for_notes"))


def warning_note(bucket: Column, reason: Column) -> Column:
    """What the row of a rejected but worked-on place says; else its plain reason."""
    return F.when(
        bucket == "rejected",
        F.concat(
            F.lit("увага: пайплайн відхилив цей запис ("), F.coalesce(reason, F.lit("без причини")),
            F.lit("), але рядок лишено, бо з ним уже працювали"),
        ),
    ).otherwise(reason)
