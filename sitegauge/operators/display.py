"""Published row: display cells, their parse-back, and type labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitegauge import texts
from sitegauge.functions.evidence import as_text
from sitegauge.functions.address import city_of, location_label, state_of
from sitegauge.functions.text import capitalize
from sitegauge.functions.urls import maps_url, report_cell
from sitegauge.operators.brief import brief
from sitegauge.operators.effort import difficulty, stars_text
from sitegauge.operators.notes import warning_note
from sitegauge.params import DEFAULT, Preset


def _map(values: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for kv in values.items() for x in kv])


def type_label(raw: Column) -> Column:
    trimmed = F.trim(F.coalesce(raw, F.lit("")))
    return F.coalesce(_map(texts.TYPE_LABELS)[F.lower(trimmed)], trimmed)


def is_retail(raw: Column) -> Column:
    return F.lower(F.trim(F.coalesce(raw, F.lit("")))).isin(*texts.RETAIL_TYPES)


def number_text(x: Column) -> Column:
    """A double without a trailing ``.0``."""
    return F.regexp_replace(x.cast("string"), r"\.0$", "")


def speed_cell(mobile: Column, desktop: Column, website: Column) -> Column:
    known = mobile.isNotNull() | desktop.isNotNull()
    part = lambda x: F.coalesce(x.cast("string"), F.lit("?"))
    return (
        F.when(known, F.concat(part(mobile), F.lit(" / "), part(desktop)))
        .when(website.isNotNull(), "не заміряно").otherwise(texts.DASH)
    )


def yes_no_cell(has_audit: Column, fetch_error: Column, flag: Column, failed: str) -> Column:
    return (
        F.when(~has_audit, texts.DASH).when(fetch_error.isNotNull(), failed)
        .when(F.coalesce(flag, F.lit(False)), "так").otherwise("НІ")
    )


def stack_cell(a: Column, website: Column) -> Column:
    names = F.array_distinct(F.array_compact(F.concat(F.array(a["builder"], a["cms"]), a["tech_stack"])))
    listed = F.coalesce(F.nullif(F.array_join(names, ", "), F.lit("")), F.lit(texts.DASH))
    return F.when(a.isNotNull(), listed).when(website.isNotNull(), "не вдалось прочитати").otherwise(texts.DASH)


def rating_cell(rating: Column, reviews: Column) -> Column:
    return F.concat(
        F.coalesce(number_text(rating), F.lit(texts.DASH)), F.lit(" / "),
        F.coalesce(reviews, F.lit(0)).cast("string"),
    )


def parse_rating(cell: Column) -> Column:
    pattern = r"^\s*([\d.]+|—)\s*/\s*(\d+)"
    return F.struct(
        F.regexp_extract(cell, pattern, 1).try_cast("double").alias("rating"),
        F.coalesce(F.regexp_extract(cell, pattern, 2).try_cast("int"), F.lit(0)).alias("reviews"),
    )


def parse_speed(cell: Column) -> Column:
    pattern = r"(\d+|\?)\s*/\s*(\d+|\?)"
    return F.struct(
        F.regexp_extract(cell, pattern, 1).try_cast("int").alias("mobile"),
        F.regexp_extract(cell, pattern, 2).try_cast("int").alias("desktop"),
    )


def count_stars(cell: Column) -> Column:
    return F.regexp_count(F.coalesce(cell, F.lit("")), F.lit("★"))


def difficulty_label(cell: Column) -> Column:
    return F.trim(F.regexp_replace(F.coalesce(cell, F.lit("")), "[★☆]", ""))


def sheet_date(cell: Column) -> Column:
    """Serial day numbers become dates; other texts stay."""
    text = F.trim(F.coalesce(cell, F.lit("")))
    n = text.try_cast("double")
    date = F.date_add(F.lit("1899-12-30").cast("date"), F.floor(n).cast("int"))
    return F.when((n > 20_000) & (n < 100_000), F.date_format(date, "dd.MM.yyyy")).otherwise(text)


def export_rows(state: DataFrame, preset: Preset = DEFAULT, language_notes: dict[str, str] | None = None) -> DataFrame:
    """The 23 machine columns of a publication.

    ``state`` is the assembled place: audit struct ``audit``, ``quality`` struct, ``effort``
    struct, ``owner`` struct, speed columns and ``preferred_lang`` of the reviews.
    """
    a, q, owner = F.col("audit"), F.col("quality"), F.col("owner")
    website = F.col("website")
    city, region = city_of(F.col("address")), state_of(F.col("address"))
    location = location_label(city, region, F.col("hood_name"), F.col("metro_key"))
    lang = F.coalesce(owner["lang"], F.col("preferred_lang"))
    raw_label = F.coalesce(F.col("primary_type_label"), F.col("niche_label"), F.col("primary_type"), F.lit(""))
    hard = difficulty(F.col("effort")["hours_min"], F.col("effort")["hours_max"])
    dash = lambda c: F.coalesce(F.nullif(c, F.lit("")), F.lit(texts.DASH))
    notes = _map(language_notes)[lang] if language_notes else F.lit(None).cast("string")
    has_audit = a.isNotNull()
    label = type_label(raw_label)
    known = F.when((label != "") & (label != texts.DASH), label)
    place = F.when(location != texts.DASH, F.regexp_replace(location, r"\s*\(.*\)$", ""))
    text = brief(
        a,
        {
            "kind": capitalize(F.coalesce(known, F.lit(texts.SOME_BUSINESS))), "retail": is_retail(raw_label), "location": place,
            "rating": number_text(F.col("rating")), "reviews": F.col("user_rating_count"), "website": website, "site_status": q["status"],
            "dated_markers": q["dated_markers"], "mobile_score": F.col("mobile_score"), "desktop_score": F.col("desktop_score"),
            "lcp_ms": F.col("lcp_ms"), "note": F.coalesce(warning_note(F.col("bucket"), F.col("reject_reason")), F.lit("")),
            "language_note": notes,
        },
        preset.year,
    )
    cells = (
        F.col("place_id"), F.col("name"),
        F.coalesce(F.nullif(type_label(F.col("primary_type_label")), F.lit("")), F.col("niche_label"), dash(F.col("primary_type"))),
        dash(F.col("tier")), location, dash(website), maps_url(F.col("place_id")), dash(F.col("phone")),
        dash(F.get(a["emails"], F.lit(0))),
        dash(F.array_join(F.map_values(a["socials"]), " ")),
        F.when(has_audit, q["score10"].cast("string")).when(website.isNull(), "1").otherwise(""),
        F.when(has_audit, F.array_join(q["reasons"], "; ")).when(website.isNull(), texts.NO_SITE_REASON).otherwise(""),
        F.when(hard.isNotNull() & has_audit, F.concat(stars_text(hard["stars"]), F.lit(" "), hard["label"])).otherwise(texts.DASH),
        F.coalesce(owner["score"].cast("string"), F.lit("")),
        F.coalesce(_map(texts.LANGUAGE_LABELS)[lang], F.lit(texts.DASH)),
        dash(as_text(owner["evidence"])),
        stack_cell(a, website),
        speed_cell(F.col("mobile_score"), F.col("desktop_score"), website),
        yes_no_cell(has_audit, a["fetch_error"], a["has_viewport"], "сайт не відкрився"),
        yes_no_cell(has_audit, a["fetch_error"], a["https"], texts.DASH),
        rating_cell(F.col("rating"), F.col("user_rating_count")),
        report_cell(website, F.coalesce(F.col("has_screenshot"), F.lit(False))),
        text,
    )
    return state.select(*[c.alias(name) for c, name in zip(cells, texts.MACHINE_COLUMNS)])
