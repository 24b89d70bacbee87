"""The brief of a place: templates with conditions, put together by one function.

A line is a condition on the facts and a template with its values. A section takes the first line that holds, or
joins all that hold; a missing value drops its line. The wording is a table (``texts.BRIEF``); another one, in any
language, may be given in its place.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from sitegauge import texts
from sitegauge.functions.text import phrase

#: Flaws named in a brief, in order of the table.
MOST_FLAWS = 3


@dataclass(frozen=True)
class Line:
    name: str
    holds: Column
    values: tuple[Column, ...] = ()


def _said(line: Line, wording: Mapping[str, str]) -> Column:
    return F.when(F.coalesce(line.holds, F.lit(False)), phrase(wording[line.name], *line.values))


def first_of(lines: list[Line], wording: Mapping[str, str]) -> Column:
    return F.coalesce(*[_said(x, wording) for x in lines])


def all_of(name: str, lines: list[Line], wording: Mapping[str, str], most: int | None = None) -> Column:
    """The lines that hold, joined and put into the template ``name``; null if there are none."""
    held = F.array_compact(F.array(*[_said(x, wording) for x in lines]))
    cut = held if most is None else F.slice(held, 1, most)
    return F.when(F.size(held) > 0, phrase(wording[name], F.array_join(cut, wording["between"])))


def brief(a: Column, p: Mapping[str, Column], year: int, wording: Mapping[str, str] = texts.BRIEF) -> Column:
    """What is known of a place, for the person who calls it.

    ``a``: the audit. ``p``: kind, retail, location, rating, reviews, website, site_status, dated_markers,
    mobile_score, desktop_score, lcp_ms, note, language_note.
    """
    given = lambda x: F.coalesce(x, F.lit("")) != ""
    none, measured = p["website"].isNull(), p["mobile_score"].isNotNull() | p["desktop_score"].isNotNull()
    blocked = ~none & F.coalesce(p["site_status"] == "blocked", F.lit(False))
    failed = ~none & (a["fetch_error"].isNotNull() | F.coalesce(a["http_status"] >= 500, F.lit(False)))
    read = a.isNotNull() & a["fetch_error"].isNull()
    seen = read & ~none & ~blocked
    lacks = lambda x: seen & ~F.coalesce(x, F.lit(False))
    platform = F.coalesce(a["builder"], a["cms"], a["modern_framework"])
    stack = F.nullif(F.array_join(F.slice(F.coalesce(a["tech_stack"], F.array().cast("array<string>")), 1, 2), ", "), F.lit(""))
    markers = F.when(measured, F.filter(p["dated_markers"], lambda m: ~m.contains(texts.DEAD_SITE_WORD))).otherwise(p["dated_markers"])
    seconds = F.format_string("%.1f", p["lcp_ms"] / 1000)

    about = F.concat_ws(" ", first_of([Line("place_at", given(p["location"]), (p["kind"], p["location"])), Line("place", F.lit(True), (p["kind"],))], wording),
                        first_of([Line("rated", p["reviews"] > 0, (p["rating"], p["reviews"])), Line("counted", p["reviews"] > 0, (p["reviews"],))], wording),
                        p["language_note"])
    state = first_of([
        Line("no_site", none), Line("blocked", blocked), Line("not_stored", a.isNull()), Line("only_measured", failed & measured), Line("dead", failed),
    ], wording)
    makeup = F.concat_ws(
        " ",
        first_of([Line("platform", platform.isNotNull(), (platform,)), Line("platform", stack.isNotNull(), (stack,))], wording),
        first_of([Line("pages", a["page_count"] > 1, (a["page_count"], a["unique_page_types"])), Line("single", F.lit(True))], wording),
        all_of("offers", [
            Line("shop", a["has_ecommerce"] & p["retail"]), Line("shop_module", a["has_ecommerce"] & ~p["retail"]),
            Line("catalog", a["has_catalog"] & ~F.coalesce(a["has_ecommerce"], F.lit(False))), Line("forms", a["has_forms"]),
            Line("versions", a["languages"] > 1, (a["languages"],)),
        ], wording),
    )
    flaws = all_of("flaws", [
        Line("no_viewport", lacks(a["has_viewport"])), Line("no_https", lacks(a["https"])), Line("tls_expired", seen & a["tls_expired"]),
        Line("mixed_content", seen & a["mixed_content"]), Line("flash", seen & a["has_flash"]), Line("tables", seen & a["table_layout"]),
        Line("jquery", seen & a["jquery_version"].startswith("1."), (a["jquery_version"],)),
        Line("old_year", seen & (F.lit(year) - a["footer_year"] >= 3), (a["footer_year"],)),
        Line("no_preview", seen & ~given(a["meta_description"]) & ~F.coalesce(a["og_tags"], F.lit(False))),
        Line("slow", ~none & ~blocked & (p["lcp_ms"] > 4000), (seconds,)), Line("low_score", ~none & ~blocked & (p["mobile_score"] < 40), (p["mobile_score"],)),
    ], wording, MOST_FLAWS)
    by_hand = first_of([
        Line("decided", p["note"].startswith(texts.BY_HAND), (F.regexp_replace(p["note"], f"^{texts.BY_HAND}:?\\s*", ""),)),
        Line("warned", p["note"].startswith(texts.WARNING), (F.regexp_replace(p["note"], f"^{texts.WARNING}:?\\s*", ""),)),
    ], wording)
    opening = first_of([
        Line("open_no_site", none), Line("open_blocked", blocked), Line("open_dead", failed & ~measured), Line("open_phone", lacks(a["has_viewport"])),
        Line("open_slow", p["lcp_ms"] > 8000, (seconds,)), Line("open_builder", a["builder"].isNotNull(), (a["builder"],)),
        Line("open_marker", F.size(markers) > 0, (F.get(markers, F.lit(0)),)), Line("open_design", F.lit(True)),
    ], wording)
    return F.concat_ws(" ", about, F.coalesce(state, makeup), flaws, by_hand, opening)
