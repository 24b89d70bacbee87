"""Cheap filters on records, the cheap verdict, and candidate selections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitegauge import texts
from sitegauge.functions.address import is_us_address
from sitegauge.functions.text import phrase
from sitegauge.functions.urls import host_of
from sitegauge.params import DEFAULT, Preset

# --- fixed values -----------------------------------------------------------
NON_COMMERCIAL_WORDS = (
    "church", "cathedral", "parish", "orthodox", "catholic", "synagogue", "temple", "mosque",
    "consulate", "embassy", "ministry", "foundation", "association", "society", "scouting",
    "youth organization", "community center", "nonprofit", "non-profit", "charity", "museum",
    "diocese", "eparchy", "shrine",
)
CHALLENGE_TITLE = (
    r"(?i)challenge|checking your browser|403|forbidden|just a moment|human verification"
    r"|attention required|verifying you are human"
)
PLATFORM_HOST = r"(?i)instagram\.com|facebook\.com|ebay\.com|linktr\.ee"
# --- end of fixed values ----------------------------------------------------


def not_operational(status: Column) -> Column:
    return status.isNotNull() & (status != "") & (status != "OPERATIONAL")


def excluded_type(types: Column, excluded: tuple[str, ...]) -> Column:
    """First of the record's own types that is on the list; null if none is."""
    return F.get(F.filter(types, lambda t: t.isin(*excluded)), F.lit(0))


def all_types(primary: Column, types: Column, with_primary: bool = True) -> Column:
    """The record's types, the primary one in front when it counts."""
    listed = F.coalesce(types, F.array().cast("array<string>"))
    if not with_primary:
        return listed
    return F.concat(F.array_compact(F.array(F.nullif(primary, F.lit("")))), listed)


def too_few_reviews(count: Column, least: int) -> Column:
    return F.coalesce(count, F.lit(0)) < least


def excluded_host(website: Column, suffixes: tuple[str, ...]) -> Column:
    host = host_of(website)
    out = F.lit(False)
    for suffix in suffixes:
        out = out | host.endswith(suffix)
    return (host != "") & out


def excluded_phone(phone: Column, prefixes: tuple[str, ...]) -> Column:
    bare = F.regexp_replace(F.coalesce(phone, F.lit("")), r"\s", "")
    out = F.lit(False)
    for prefix in prefixes:
        out = out | bare.startswith(prefix)
    return out


def _verdict(bucket: str, reason: Column | None, rule: int) -> Column:
    reason = F.lit(None).cast("string") if reason is None else reason
    return F.struct(
        F.lit(bucket).alias("bucket"), reason.alias("reason"), F.lit(rule).alias("rule_no")
    )


def cheap_verdict(preset: Preset = DEFAULT) -> Column:
    """``struct(bucket, reason, rule_no)`` over the place columns; first match wins.

    The rules run cheapest first, and ``when`` stops at the first that holds.
    """
    f = preset.filters
    kind = excluded_type(all_types(F.col("primary_type"), F.col("types"), f.primary_type_counts), f.excluded_types)
    status, reviews = F.col("business_status"), F.col("user_rating_count")
    website = F.col("website")
    out = (
        F.when(not_operational(status), _verdict("rejected", phrase(texts.NOT_OPERATIONAL, status), 1))
        .when(kind.isNotNull(), _verdict("rejected", phrase(texts.EXCLUDED_TYPE, kind), 2))
        .when(
            too_few_reviews(reviews, f.min_review_count),
            _verdict("rejected", phrase(texts.TOO_FEW_REVIEWS, F.coalesce(reviews, F.lit(0)), F.lit(f.min_review_count)), 3),
        )
    )
    if f.require_us_address:
        out = out.when(~is_us_address(F.col("address")), _verdict("rejected", F.lit(texts.FOREIGN_ADDRESS), 4))
    return (
        out.when(
            excluded_host(website, f.excluded_host_suffixes),
            _verdict("rejected", phrase(texts.EXCLUDED_HOST, host_of(website)), 5),
        )
        .when(
            excluded_phone(F.col("phone"), f.excluded_phone_prefixes),
            _verdict("rejected", F.lit(texts.EXCLUDED_PHONE), 6),
        )
        .when(website.isNull() | (website == ""), _verdict("no_site", None, 7))
        .otherwise(_verdict("pending", None, 8))
    )


def apply_cheap_filter(places: DataFrame, preset: Preset = DEFAULT) -> DataFrame:
    v = F.col("_cheap")
    return (
        places.withColumn("_cheap", cheap_verdict(preset))
        .withColumn("bucket", v["bucket"])
        .withColumn("reject_reason", v["reason"])
        .withColumn("rule_no", v["rule_no"])
        .drop("_cheap")
    )


def refilter(state: DataFrame, preset: Preset = DEFAULT, force: bool = False) -> DataFrame:
    """New rules over old places, demotion only.

    A new verdict replaces the old one if it rejects, if the place has not been
    worked on yet, or when forced; otherwise the old bucket stays.
    """
    v = F.col("_cheap")
    take = F.lit(force) | (v["bucket"] == "rejected") | (F.col("stage") == "discovered")
    return (
        state.withColumn("_cheap", cheap_verdict(preset))
        .withColumn("old_bucket", F.col("bucket"))
        .withColumn("reject_reason", F.when(take, v["reason"]).otherwise(F.col("reject_reason")))
        .withColumn("bucket", F.when(take, v["bucket"]).otherwise(F.col("bucket")))
        .drop("_cheap")
    )


def audit_candidates(state: DataFrame, force: bool = False) -> DataFrame:
    if force:
        return state.where(F.col("website").isNotNull())
    return state.where(
        F.col("bucket").isin("pending", "manual") & F.col("website").isNotNull() & (F.col("stage") == "discovered")
    )


def enrich_candidates(state: DataFrame, psi: DataFrame, include_manual: bool = False) -> DataFrame:
    """Leads (and the manual queue when asked) with a site and no speed measure yet."""
    wanted = ("leads", "manual") if include_manual else ("leads",)
    return state.where(F.col("bucket").isin(*wanted) & F.col("website").isNotNull()).join(
        psi.select("place_id"), "place_id", "left_anti"
    )


def panel_filter(rows: DataFrame, search: str = "", city: str = "", status: str | None = None) -> DataFrame:
    """Substring over the descriptive columns, exact city, exact or empty status.

    ``status=""`` asks for rows nobody has touched; ``None`` does not filter.
    """
    fields = ("name", "type_label", "website", "evidence_text", "phone", "brief", "stack")
    out = rows
    if search.strip():
        hay = F.lower(F.concat_ws(" ", *[F.coalesce(F.col(c), F.lit("")) for c in fields if c in rows.columns]))
        out = out.where(hay.contains(search.strip().lower()))
    if city:
        out = out.where(F.col("location") == city)
    if status is not None:
        out = out.where(F.trim(F.coalesce(F.col("status"), F.lit(""))) == status)
    return out


def suspicious_name(name: Column) -> Column:
    return name.rlike("(?i)" + "|".join(NON_COMMERCIAL_WORDS))


def is_challenge_title(title: Column) -> Column:
    return F.coalesce(title.rlike(CHALLENGE_TITLE), F.lit(False))


def on_third_party_platform(host: Column) -> Column:
    return F.coalesce(host.rlike(PLATFORM_HOST), F.lit(False))


def retry_candidates(state: DataFrame, limit: int) -> DataFrame:
    """Sites that could not be read, except the ones that said 404 or 400; most reviewed first."""
    return (
        state.where(
            F.col("bucket").isin("manual", "pending")
            & F.col("website").isNotNull()
            & F.col("fetch_error").isNotNull()
            & ~F.col("fetch_error").rlike("http-40[04]")
        )
        .orderBy(F.coalesce(F.col("user_rating_count"), F.lit(0)).desc(), "place_id")
        .limit(limit)
    )


def slow_sites(state: DataFrame, lcp_over: int = 6000, top: int = 12) -> DataFrame:
    return state.where(F.col("lcp_ms") > lcp_over).orderBy(F.col("lcp_ms").desc(), "place_id").limit(top)
