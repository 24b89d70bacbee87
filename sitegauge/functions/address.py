"""Address parsing: country test, state, city, location label."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sitegauge.params import US_REGION_CODES

STATE_ZIP = r",\s*([A-Z]{2})\s+\d{5}(?:-\d{4})?\b"
STATE_TAIL = r",\s*([A-Z]{2})\s*$"
COUNTRY = r"(?i)\bUSA\b|\bUnited States\b"


def is_us_address(address: Column) -> Column:
    text = F.coalesce(address, F.lit(""))
    return (
        text.rlike(COUNTRY)
        | F.regexp_extract(text, STATE_ZIP, 1).isin(*US_REGION_CODES)
        | F.regexp_extract(F.trim(text), STATE_TAIL, 1).isin(*US_REGION_CODES)
    )


def state_of(address: Column) -> Column:
    with_zip = F.regexp_extract(address, STATE_ZIP, 1)
    code = F.when(with_zip != "", with_zip).otherwise(F.regexp_extract(F.trim(address), STATE_TAIL, 1))
    return F.when(code.isin(*US_REGION_CODES), code)


def city_of(address: Column) -> Column:
    """Component before the last one that looks like ``ST 12345`` or ``ST``."""
    parts = F.transform(F.split(address, ","), lambda p: F.trim(p))
    marks = F.transform(
        parts, lambda p, i: F.when(p.rlike(r"^[A-Z]{2}\s+\d{5}") | p.rlike(r"^[A-Z]{2}$"), i)
    )
    at = F.array_max(marks)
    return F.when(at >= 1, F.try_element_at(parts, at))


def location_label(city: Column, state: Column, hood: Column, metro: Column) -> Column:
    """Place from the address, plus the query area when that names another place."""
    real = F.nullif(F.concat_ws(", ", F.nullif(city, F.lit("")), state), F.lit(""))
    via = F.coalesce(hood, metro)
    differs = real.isNotNull() & via.isNotNull() & (city != "") & ~F.lower(via).contains(F.lower(city))
    return F.when(
        differs, F.concat(real, F.lit("  (знайдено через "), via, F.lit(")"))
    ).otherwise(F.coalesce(real, via, F.lit("—")))
