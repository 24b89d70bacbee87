"""Review metadata to one signal per place.  Only counts and ratios leave these operators."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitegauge.functions.evidence import evidence, item_when
from sitegauge.functions.text import count_class, phrase, round_half_up
from sitegauge.params import DEFAULT, MAX_REVIEW_BOOST, LanguageProfile, Preset

# --- fixed values -----------------------------------------------------------
RATIO_POINTS = ((0.8, 25), (0.6, 20), (0.4, 15), (0.25, 10))
RECENT_BONUS, RECENT_LEAST = 5, 2
RECENT_DAYS = 3 * 365
AUTHOR_POINTS = ((0.6, 45), (0.4, 35), (0.2, 18))
AUTHOR_SCRIPT_POINTS = ((2, 15), (1, 8))
AUTHOR_CAP = 60
# --- end of fixed values ----------------------------------------------------


def language_counts(reviews: DataFrame, codes: tuple[str, ...], as_of: dt.date) -> DataFrame:
    """Per place: reviews, reviews per target code, target ratio, recent target reviews."""
    code = F.lower(F.coalesce(F.col("language_code"), F.lit("und")))
    target = code.isin(*codes)
    recent = F.col("publish_time") > F.lit(str(as_of - dt.timedelta(days=RECENT_DAYS))).cast("timestamp")
    counted = reviews.groupBy("place_id").agg(
        F.count("*").alias("sample_size"),
        *[F.count_if(code == c).alias(f"n_{c}") for c in codes],
        F.count_if(target).alias("n_target"),
        F.count_if(target & recent).alias("recent_target"),
    )
    return counted.withColumn("ratio", F.col("n_target") / F.col("sample_size"))


def author_stats(reviews: DataFrame, matched: Column, profile: LanguageProfile) -> DataFrame:
    """Per place: authors, matches of the caller's test, authors in the script, majority language.

    ``matched`` is the caller's boolean over the review columns.  The author token itself
    is used per row and dropped by the aggregation.
    """
    token = F.col("author_token")
    valid = token.isNotNull() & (F.length(F.trim(token)) > 1)
    in_script = count_class(token, profile.script) > 0
    excluded = F.lit(False)
    for glyphs, _, _ in profile.excluded_glyphs:
        excluded = excluded | token.rlike(f"[{glyphs}]")
    script_ok = in_script & ~excluded
    rows = reviews.where(valid)
    agg = rows.groupBy("place_id").agg(
        F.count("*").alias("authors"),
        F.count_if(script_ok | (~in_script & matched)).alias("matched"),
        F.count_if(script_ok).alias("in_script"),
        *[
            F.sum(F.when(script_ok, count_class(token, t.glyphs)).otherwise(0)).alias(f"glyphs_{t.code}")
            for t in profile.targets
        ],
    )
    most = F.greatest(*[F.col(f"glyphs_{c}") for c in profile.codes]) if len(profile.codes) > 1 else F.col(f"glyphs_{profile.codes[0]}")
    lang = None
    for t in reversed(profile.targets):
        cond = (F.col(f"glyphs_{t.code}") == most) & (most > 0)
        lang = F.when(cond, t.code) if lang is None else lang.when(cond, t.code)
    return agg.withColumn("author_ratio", F.col("matched") / F.col("authors")).withColumn("author_lang", lang)


def _steps(value: Column, steps) -> Column:
    out = F.when(value >= steps[0][0], steps[0][1])
    for least, points in steps[1:]:
        out = out.when(value >= least, points)
    return out.otherwise(0)


def language_points(ratio: Column, recent: Column) -> Column:
    base = _steps(ratio, RATIO_POINTS)
    fresh = F.when(recent >= RECENT_LEAST, base + RECENT_BONUS).when(recent == 0, round_half_up(base * 0.5)).otherwise(base)
    return F.when(base > 0, fresh).otherwise(0)


def author_points(authors: Column, ratio: Column, in_script: Column) -> Column:
    points = _steps(ratio, AUTHOR_POINTS) + _steps(in_script, AUTHOR_SCRIPT_POINTS)
    return F.when(F.coalesce(authors, F.lit(0)) == 0, 0).otherwise(F.least(points, F.lit(AUTHOR_CAP)))


def review_signal(counts: DataFrame, authors: DataFrame, preset: Preset = DEFAULT) -> DataFrame:
    """One row per place: capped score, ratios, preferred language, evidence."""
    profile = preset.language
    rows = counts.join(authors, "place_id", "left")
    by_language = language_points(F.col("ratio"), F.col("recent_target"))
    by_author = author_points(F.col("authors"), F.col("author_ratio"), F.coalesce("in_script", F.lit(0)))
    most = F.greatest(*[F.col(f"n_{c}") for c in profile.codes]) if len(profile.codes) > 1 else F.col(f"n_{profile.codes[0]}")
    major = None
    for t in profile.targets:
        cond = F.col(f"n_{t.code}") == most
        major = F.when(cond, t.code) if major is None else major.when(cond, t.code)
    scored = rows.withColumn("_l", by_language).withColumn("_a", by_author)
    seen = F.concat(
        phrase("%s/%s відгуків ", F.col("n_target"), F.col("sample_size")), major,
        F.when(F.col("recent_target") > 0, phrase(", %s за 3 роки", F.col("recent_target"))).otherwise(", усі старі"),
    )
    by_whom = F.concat(
        phrase("%s/%s рецензентів за списком", F.col("matched"), F.col("authors")),
        F.when(F.col("in_script") > 0, phrase(", %s кирилицею", F.col("in_script"))).otherwise(""),
    )
    return scored.select(
        "place_id",
        F.least(F.col("_l") + F.col("_a"), F.lit(MAX_REVIEW_BOOST)).cast("int").alias("score"),
        "ratio", "sample_size", "recent_target",
        F.when(F.col("n_target") > 0, major).otherwise(F.col("author_lang")).alias("preferred_lang"),
        "author_ratio", F.coalesce("in_script", F.lit(0)).alias("author_script"),
        evidence(
            item_when(F.col("_l") > 0, "review_language", F.col("_l"), seen),
            item_when(F.col("_a") > 0, "review_author_names", F.col("_a"), by_whom),
        ).alias("evidence"),
    )


def review_queue(state: DataFrame, budget: int) -> DataFrame:
    """The first ``budget`` pending places: score, then reviews, then the worst site."""
    return (
        state.where(F.col("bucket") == "pending")
        .orderBy(*queue_order())
        .limit(budget)
    )


def queue_order() -> list[Column]:
    return [
        F.coalesce(F.col("owner_score"), F.lit(0)).desc(),
        F.coalesce(F.col("user_rating_count"), F.lit(0)).desc(),
        F.coalesce(F.col("site_score"), F.lit(5)).asc(),
        F.col("place_id").asc(),
    ]
