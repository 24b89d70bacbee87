"""Reports over the state.

Counts over fixed bands are one aggregation of ``count_if`` columns that is turned
into rows afterwards: one pass, one tiny shuffle, and empty bands come out as zero.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitegauge import texts
from sitegauge.functions.address import city_of, state_of
from sitegauge.functions.structure import SHOP_MARKUP
from sitegauge.params import DEFAULT, MAX_REVIEW_BOOST, Preset

# --- fixed values -----------------------------------------------------------
OWNER_BANDS = ((85, 100), (70, 84), (55, 69), (40, 54), (20, 39), (0, 19))
NEED_BANDS = ((55, 69), (40, 54), (25, 39), (10, 24), (0, 9))
QUEUE_BANDS = (("55+", 55), ("40-54", 40), ("25-39", 25), ("10-24", 10), ("0-9", None))
REVIEW_BANDS = (("200+", 200), ("100-199", 100), ("50-99", 50), ("20-49", 20), ("5-19", None))
WHAT_IF = (70, 65, 60, 55, 50, 45, 40)
FRESH_MINUTES = (5, 15, 60)
LABEL_CHARS = 24
PHONE_RU = r"\+?\s?7[\s\-(]?9\d{2}[\s\-)]?\d{3}"
PHONE_UA = r"\+?\s?380[\s\-(]?\d{2}"
# --- end of fixed values ----------------------------------------------------


def _rows(wide: DataFrame, names: Sequence[str], key: str, value: str, key_values: Sequence) -> DataFrame:
    """One row per (key value, column) from a one-row frame."""
    pairs = F.array(*[
        F.struct(F.lit(k).alias(key), F.col(n).alias(value)) for k, n in zip(key_values, names)
    ])
    return wide.select(F.inline(pairs))


def count_per_value(df: DataFrame, conds: dict, key: str, value: str = "n") -> DataFrame:
    names = [f"c{i}" for i in range(len(conds))]
    wide = df.agg(*[F.count_if(c).alias(n) for n, c in zip(names, conds.values())])
    return _rows(wide, names, key, value, list(conds))


def band(value: Column, steps: Sequence[tuple[str, int | None]]) -> Column:
    out = None
    for label, least in steps:
        if least is None:
            return out.otherwise(label)
        out = F.when(value >= least, label) if out is None else out.when(value >= least, label)
    return out


# A1, A2, A5, A27
def count_by(df: DataFrame, key: str, top: int | None = None, where: Column | None = None) -> DataFrame:
    """Rows per value, most first; ties by value."""
    rows = df if where is None else df.where(where)
    out = rows.groupBy(key).agg(F.count("*").alias("n"))
    return out if top is None else out.orderBy(F.col("n").desc(), F.col(key).asc()).limit(top)


def bucket_counts(state: DataFrame) -> DataFrame:
    return count_by(state, "bucket")


def site_score_histogram(audits: DataFrame) -> DataFrame:
    return count_by(audits, "site_score", where=F.col("site_score").isNotNull())


def reject_reasons(state: DataFrame, top: int = 10) -> DataFrame:
    return count_by(
        state, "reject_reason", top, (F.col("bucket") == "rejected") & F.col("reject_reason").isNotNull()
    )


# A3
def owner_bands(scores: DataFrame, score: str = "owner_score") -> DataFrame:
    conds = {
        f"{low}-{high}": (F.col(score) >= low) & ((F.col(score) <= high) if low else F.col(score).isNotNull())
        for low, high in OWNER_BANDS
    }
    conds["0-19"] = F.col(score) < 20
    return count_per_value(scores, conds, "band").where(F.col("n") > 0)


# A4
def evidence_frequency(scored: DataFrame, column: str = "evidence", top: int = 12) -> DataFrame:
    rows = scored.select(F.explode(column).alias("e")).where(F.col("e.weight") > 0)
    return (
        rows.groupBy(F.col("e.signal").alias("signal")).agg(F.count("*").alias("n"))
        .orderBy(F.col("n").desc(), "signal").limit(top)
    )


# A7
def by_region(state: DataFrame, targets: Sequence[str]) -> DataFrame:
    """Places and leads per region of the address, and whether the region is wanted."""
    rows = state.where(F.col("bucket") != "rejected")
    region = F.coalesce(state_of(F.col("address")), F.lit("??"))
    return (
        rows.groupBy(region.alias("region"))
        .agg(F.count("*").alias("total"), F.count_if(F.col("bucket") == "leads").alias("leads"))
        .withColumn("wanted", F.col("region").isin(*targets))
    )


def region_share(state: DataFrame, targets: Sequence[str]) -> DataFrame:
    totals = by_region(state, targets).agg(
        F.sum("total").alias("places"), F.sum(F.when(F.col("wanted"), F.col("total")).otherwise(0)).alias("inside")
    )
    return totals.withColumn("share", F.floor(F.col("inside") * 100 / F.col("places") + F.lit(0.5)).cast("long"))


# A10
def threshold_what_if(state: DataFrame, thresholds: Sequence[int] = WHAT_IF, base: int = 70) -> DataFrame:
    rows = state.where(F.col("bucket").isin("leads", "manual"))
    names = [f"t{t}" for t in thresholds]
    wide = rows.agg(
        *[F.count_if(F.col("owner_score") >= t).alias(n) for t, n in zip(thresholds, names)],
        F.count_if(F.col("owner_score") >= base).alias("_base"),
    )
    pairs = F.array(*[
        F.struct(F.lit(t).alias("threshold"), F.col(n).alias("leads"), (F.col(n) - F.col("_base")).alias("gain"))
        for t, n in zip(thresholds, names)
    ])
    return wide.select(F.inline(pairs))


# O4
def newly_admitted(state: DataFrame, low: int = 55, high: int = 70, top: int = 12) -> DataFrame:
    return (
        state.where(F.col("bucket").isin("leads", "manual") & (F.col("owner_score") >= low) & (F.col("owner_score") < high))
        .orderBy(F.coalesce("user_rating_count", F.lit(0)).desc(), "place_id").limit(top)
    )


# A11
def need_bands(state: DataFrame, preset: Preset = DEFAULT) -> DataFrame:
    """Pending places per score band: how much is missing to a lead and whether reviews can give it."""
    rows = state.where(F.col("bucket") == "pending")
    score = F.coalesce(F.col("owner_score"), F.lit(0))
    lead = preset.thresholds.lead
    wide = rows.agg(*[F.count_if(score.between(low, high)).alias(f"b{low}") for low, high in NEED_BANDS])

    def label(hard: int) -> str:
        return next(text for most, text in texts.FEASIBILITY if most is None or hard <= most)

    pairs = F.array(*[
        F.struct(
            F.lit(f"{low}-{high}").alias("band"), F.col(f"b{low}").alias("n"),
            F.lit(lead - high).alias("need_easy"), F.lit(lead - low).alias("need_hard"),
            F.lit(label(lead - low)).alias("feasibility"), F.lit(lead - low <= 60).alias("worth_it"),
        )
        for low, high in NEED_BANDS
    ])
    return wide.select(F.inline(pairs))


# J4
def unreviewed_potential(state: DataFrame, reviews: DataFrame, least: int = 10) -> DataFrame:
    return state.where(
        (F.col("bucket") == "pending") & (F.coalesce("owner_score", F.lit(0)) >= least)
    ).join(reviews.select("place_id"), "place_id", "left_anti")


# A12
def marker_frequency(audited: DataFrame) -> DataFrame:
    # The outer form: the plain one adds a size filter that repeats the whole page
    # computation below this point.
    rows = audited.select(F.explode_outer("dated_markers").alias("marker"))
    return rows.where(F.col("marker").isNotNull()).groupBy("marker").agg(F.count("*").alias("n"))


def marker_coverage(audited: DataFrame) -> DataFrame:
    sums = audited.agg(F.count("*").alias("sites"), F.count_if(F.size("dated_markers") > 0).alias("with_marker"))
    return sums.withColumn(
        "share", F.floor(F.col("with_marker") * 100 / F.col("sites") + F.lit(0.5)).cast("long")
    )


# A13
def queue_profile(state: DataFrame) -> DataFrame:
    """Long form: what the manual queue consists of, by part, score band and review band."""
    rows = state.where(F.col("bucket").isin("manual", "pending"))
    parts = {
        "total": F.lit(True), "with_site": F.col("website").isNotNull(), "audited": F.col("has_audit"),
        "with_review_signal": F.col("has_reviews"), "with_psi": F.col("psi_done"), "with_cache": F.col("has_cache"),
    }
    score = band(F.coalesce("owner_score", F.lit(0)), QUEUE_BANDS)
    count = band(F.coalesce("user_rating_count", F.lit(0)), REVIEW_BANDS)
    marked = rows.select(
        *[c.alias(f"part:{k}") for k, c in parts.items()],
        *[(score == label).alias(f"score:{label}") for label, _ in QUEUE_BANDS],
        *[(count == label).alias(f"reviews:{label}") for label, _ in REVIEW_BANDS],
    )
    wide = marked.agg(*[F.count_if(F.col(f"`{c}`")).alias(c) for c in marked.columns])
    pairs = F.array(*[
        F.struct(
            F.lit(c.split(":")[0]).alias("kind"), F.lit(c.split(":")[1]).alias("item"), F.col(f"`{c}`").alias("n")
        )
        for c in marked.columns
    ])
    return wide.select(F.inline(pairs))


# A14
def panel_figures(rows: DataFrame) -> DataFrame:
    return rows.agg(
        F.count("*").alias("rows"),
        F.count_if(F.trim(F.coalesce("status", F.lit(""))) == "").alias("untouched"),
        F.count_if(F.col("site_score") <= 3).alias("hot"),
        (F.floor(F.avg("site_score") * 10 + F.lit(0.5)) / 10).alias("mean_score"),
    )


# A15
def top_labels(rows: DataFrame, key: Column, top: int = 8) -> DataFrame:
    label = F.coalesce(F.nullif(F.trim(key), F.lit("")), F.lit(texts.DASH))
    counted = rows.groupBy(label.alias("label")).agg(F.count("*").alias("n"))
    cut = F.when(
        F.length("label") > LABEL_CHARS, F.concat(F.left("label", F.lit(LABEL_CHARS - 1)), F.lit("…"))
    ).otherwise(F.col("label"))
    return counted.orderBy(F.col("n").desc(), "label").limit(top).select(cut.alias("label"), F.col("label").alias("full_label"), "n")


# A16
def score_histogram(rows: DataFrame, score: str = "site_score") -> DataFrame:
    return count_per_value(rows, {s: F.col(score) == s for s in range(1, 11)}, "score")


# A17
def status_funnel(rows: DataFrame, statuses: Sequence[str] = texts.STATUSES) -> DataFrame:
    status = F.trim(F.coalesce("status", F.lit("")))
    conds = {texts.NOT_STARTED: status == ""}
    conds.update({s: status == s for s in statuses})
    return count_per_value(rows, conds, "status").where(F.col("n") > 0)


# A18, A20
def signal_precision(rows: DataFrame, signal: Column, proof: Column) -> DataFrame:
    sums = rows.agg(F.count_if(signal).alias("fired"), F.count_if(signal & proof).alias("proved"))
    return sums.withColumn("unproved", F.col("fired") - F.col("proved")).withColumn(
        "false_share",
        F.floor(F.col("unproved") * 100 / F.greatest("fired", F.lit(1)) + F.lit(0.5)).cast("long"),
    )


def phone_pattern_hits(rows: DataFrame, phone: Column) -> DataFrame:
    """How often the foreign-number patterns fire on numbers known to be domestic."""
    sums = rows.where(phone.isNotNull()).agg(
        F.count("*").alias("phones"), F.count_if(phone.rlike(PHONE_RU)).alias("ru_hits"),
        F.count_if(phone.rlike(PHONE_UA)).alias("ua_hits"),
    )
    return sums.withColumn(
        "ru_share", F.floor(F.col("ru_hits") * 100 / F.greatest("phones", F.lit(1)) + F.lit(0.5)).cast("long")
    )


# A22
def freshness(rows: DataFrame, at: str, now: Column) -> DataFrame:
    """Rows newer than 5, 15 and 60 minutes before ``now``, all rows, and the latest time."""
    return rows.agg(
        *[
            F.count_if(F.col(at) > now - F.make_dt_interval(mins=F.lit(m))).alias(f"last_{m}")
            for m in FRESH_MINUTES
        ],
        F.count("*").alias("total"), F.max(at).alias("latest"),
    )


# A23
def no_site_potential(rows: DataFrame, name_score: Column, area_pattern: str) -> DataFrame:
    """Bands of name score plus 10 for an address in a wanted area."""
    area = F.concat_ws(" ", F.coalesce("hood_name", F.lit("")), F.coalesce("address", F.lit(""))).rlike(
        "(?i)" + area_pattern
    )
    total = name_score + F.when(area, 10).otherwise(0)
    label = F.when(total >= 30, "30+").when(total >= 15, "15-29").when(total > 0, "1-14").otherwise("0")
    return rows.where(F.col("bucket") == "no_site").groupBy(label.alias("band")).agg(
        F.count("*").alias("n"), F.count_if(name_score > 0).alias("by_name"), F.count_if(area).alias("by_area")
    )


# A24
def kept_by_marker(rows: DataFrame, preset: Preset = DEFAULT) -> DataFrame:
    most = preset.thresholds.site_score_max_for_lead
    return rows.where((F.col("bucket") == "leads") & F.col("website").isNotNull()).agg(
        F.count_if(F.col("site_score") <= most).alias("passed_by_score"),
        F.count_if((F.col("site_score") > most) & (F.size("dated_markers") > 0)).alias("kept_by_marker"),
    )


# A25
def at_risk(rows: DataFrame, preset: Preset = DEFAULT) -> DataFrame:
    most = preset.thresholds.site_score_max_for_lead
    return rows.where((F.col("bucket") == "leads") & F.col("site_score").isNotNull()).agg(
        F.count_if(F.col("site_score") <= most).alias("safe"),
        F.count_if(F.col("site_score") > most).alias("at_risk"),
    )


# A26
def label_recheck(rows: DataFrame, had: Column, html: Column, pattern: str = SHOP_MARKUP) -> DataFrame:
    """How many rows with a label keep it under the stricter rule."""
    now = F.coalesce(html.rlike(pattern), F.lit(False))
    return rows.where(had).agg(
        F.count("*").alias("was"), F.count_if(now).alias("stays"), F.count_if(~now).alias("drops")
    )


# A28
def address_coverage(rows: DataFrame) -> DataFrame:
    city, state = city_of(F.col("address")), state_of(F.col("address"))
    both = city.isNotNull() & (city != "") & state.isNotNull()
    parsed = rows.withColumn("_ok", F.coalesce(both, F.lit(False)))
    return parsed.agg(F.count("*").alias("rows"), F.count_if("_ok").alias("parsed"), F.count_if(~F.col("_ok")).alias("failed"))


# A29
def signal_overlap(rows: DataFrame, has_reviews: Column, by_language: Column, by_author: Column) -> DataFrame:
    return rows.agg(
        F.count_if(has_reviews).alias("with_reviews"),
        F.count_if(has_reviews & by_language).alias("by_language"),
        F.count_if(has_reviews & by_author).alias("by_author"),
        F.count_if(has_reviews & (by_language | by_author)).alias("either"),
        F.count_if(has_reviews & by_author & ~by_language).alias("author_only"),
        F.count_if(~has_reviews).alias("none"),
    )


# O2
def manual_candidates(state: DataFrame, least: int = 40, top: int = 50) -> DataFrame:
    score = F.coalesce(F.col("owner_score"), F.lit(0))
    return (
        state.where(F.col("bucket").isin("manual", "pending") & (score >= least))
        .orderBy(score.desc(), F.coalesce("user_rating_count", F.lit(0)).desc(), "place_id").limit(top)
    )


# O5
def rejected_despite_score(state: DataFrame, least: int = 70, top: int = 20) -> DataFrame:
    return (
        state.where((F.col("owner_score") >= least) & (F.col("bucket") == "rejected"))
        .orderBy(F.coalesce("user_rating_count", F.lit(-1)).desc(), "place_id").limit(top)
    )


def destinations(state: DataFrame, least: int = 70) -> DataFrame:
    """Where places with a high score ended up, with the reason."""
    return state.where(F.col("owner_score") >= least).groupBy("bucket", "reject_reason").agg(F.count("*").alias("n"))


# J6
def lead_listing(state: DataFrame, scores: DataFrame, audits: DataFrame, top: int = 15) -> DataFrame:
    return (
        state.where(F.col("bucket") == "leads")
        .join(scores, "place_id")
        .join(audits, "place_id", "left")
        .orderBy(F.col("owner_score").desc(), F.coalesce("user_rating_count", F.lit(-1)).desc(), "place_id")
        .limit(top)
    )


# O3
def sorted_rows(rows: DataFrame, key: str, top: int | None = None) -> DataFrame:
    """All rows in one of the five panel orders, or the first ``top`` of them."""
    orders = {
        "site_score": F.coalesce("site_score", F.lit(0)).asc(),
        "reviews": F.coalesce("user_rating_count", F.lit(0)).desc(),
        "owner_score": F.coalesce("owner_score", F.lit(0)).desc(),
        "difficulty": F.coalesce("stars", F.lit(0)).desc(),
        "name": F.coalesce("name", F.lit("")).asc(),
    }
    ordered = rows.orderBy(orders[key], "place_id")
    return ordered if top is None else ordered.limit(top)
