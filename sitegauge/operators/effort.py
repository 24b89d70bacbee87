"""Hours range of a rebuild and the difficulty in stars."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sitegauge import texts
from sitegauge.functions.text import phrase, round_half_up

# --- fixed values -----------------------------------------------------------
BASE_HOURS = 10
HOURS_WITHOUT_AUDIT = 26
HOURS_PER_TYPE, MAX_TYPES = 3, 8
CATALOG_HOURS, SHOP_HOURS, LANGUAGE_HOURS, FORM_HOURS, QA_HOURS = 6, 8, 4, 3, 4
MAX_PAGES, PAGES_PER_STEP, HOURS_PER_STEP = 60, 5, 1.5
LOW_FACTOR, HIGH_FACTOR = 0.85, 1.25
# --- end of fixed values ----------------------------------------------------


def _flag(cond: Column, hours: int) -> Column:
    return F.when(F.coalesce(cond, F.lit(False)), hours).otherwise(0)


def migration_hours(pages: Column) -> Column:
    steps = F.ceil(F.least(pages, F.lit(MAX_PAGES)) / PAGES_PER_STEP)
    return round_half_up(steps * HOURS_PER_STEP)


def total_hours(a: Column) -> Column:
    """Sum of all parts; an unreadable page counts as a typical small site."""
    counted = (
        F.lit(BASE_HOURS)
        + HOURS_PER_TYPE * F.least(a["unique_page_types"], F.lit(MAX_TYPES))
        + _flag(a["has_catalog"], CATALOG_HOURS)
        + _flag(a["has_ecommerce"], SHOP_HOURS)
        + _flag(a["languages"] > 1, LANGUAGE_HOURS)
        + _flag(a["has_forms"], FORM_HOURS)
        + F.lit(QA_HOURS)
        + migration_hours(a["page_count"])
    )
    return F.when(a.isNull() | a["fetch_error"].isNotNull(), HOURS_WITHOUT_AUDIT).otherwise(counted)


def effort(a: Column) -> Column:
    """``struct(hours_min, hours_max, breakdown)``."""
    total = total_hours(a)
    unread = a.isNull() | a["fetch_error"].isNotNull()
    line = lambda label, hours: F.concat(label, F.lit(": "), hours.cast("string"), F.lit("г"))
    types = F.least(a["unique_page_types"], F.lit(MAX_TYPES))
    base = F.lit(f"база (setup, layout, header/footer, деплой): {BASE_HOURS}г")
    unread_lines = F.array(
        base, F.lit("типова структура (3 сторінки): 9г"), F.lit("адаптив + QA: 4г"), F.lit("контент з нуля: 3г")
    )
    lines = F.array_compact(
        F.array(
            base,
            line(phrase("типи сторінок (%s унікальних макетів)", types), types * HOURS_PER_TYPE),
            F.when(a["has_catalog"], f"каталог / меню / прайс: {CATALOG_HOURS}г"),
            F.when(a["has_ecommerce"], f"e-commerce (кошик, checkout): {SHOP_HOURS}г"),
            F.when(a["languages"] > 1, phrase(f"мультимовність (%s мови): {LANGUAGE_HOURS}г", a["languages"])),
            F.when(a["has_forms"], f"форми / інтеграції: {FORM_HOURS}г"),
            F.lit(f"адаптив 3 брейкпоінти + QA: {QA_HOURS}г"),
            line(
                phrase("контент-міграція (~%s сторінок)", F.least(a["page_count"], F.lit(MAX_PAGES))),
                migration_hours(a["page_count"]),
            ),
        )
    )
    return F.struct(
        round_half_up(total * LOW_FACTOR).alias("hours_min"),
        round_half_up(total * HIGH_FACTOR).alias("hours_max"),
        F.when(unread, unread_lines).otherwise(lines).alias("breakdown"),
    )


def difficulty(hours_min: Column, hours_max: Column) -> Column:
    """``struct(stars, label)`` from the middle of the range; null without a range."""
    mid = (hours_min + hours_max) / 2
    out = None
    for up_to, stars, label in texts.DIFFICULTY:
        value = F.struct(F.lit(stars).alias("stars"), F.lit(label).alias("label"))
        if up_to is None:
            out = out.when(mid.isNotNull(), value)
        else:
            out = F.when(mid <= up_to, value) if out is None else out.when(mid <= up_to, value)
    return out


def stars_text(stars: Column) -> Column:
    return F.concat(F.repeat(F.lit("★"), stars), F.repeat(F.lit("☆"), F.lit(5) - stars))
