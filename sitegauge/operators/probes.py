"""Comparison of stored answers of one site: language routes and language negotiation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitegauge.functions.evidence import evidence, item_when
from sitegauge.functions.text import count_class, fingerprint, html_to_text, phrase
from sitegauge.params import DEFAULT, LanguageProfile, Preset
from sitegauge.session import reliable, spread

# --- fixed values -----------------------------------------------------------
SOFT_404 = (
    r"(?iu)page not found|404 error|nothing found|no results found|страница не найдена"
    r"|сторінку не знайдено|oops"
)
ROUTE_WEIGHT, NEGOTIATED_WEIGHT = 32, 35
LEAST_LENGTH_CHANGE = 200
LEAST_ROUTE_CHARS, LEAST_NEGOTIATED_CHARS = 150, 100
# --- end of fixed values ----------------------------------------------------


def answer_facts(responses: DataFrame, profile: LanguageProfile) -> DataFrame:
    """Everything the comparison needs, so that no page body is shuffled."""
    html = F.col("html")
    return responses.select(
        "place_id", "role", "final_url", "http_status",
        fingerprint(html).alias("fp"), F.length(html).alias("len"),
        html_to_text(html).rlike(SOFT_404).alias("soft_404"),
        count_class(html, profile.script).alias("script_chars"),
        F.struct(*[count_class(html, t.glyphs).alias(t.code) for t in profile.targets]).alias("glyphs"),
    )


def _language(glyphs: Column, profile: LanguageProfile) -> Column:
    out = F.lit(profile.targets[-1].code)
    for t in profile.targets[:-1]:
        others = [glyphs[c] for c in profile.codes if c != t.code]
        most = F.greatest(*others) if len(others) > 1 else others[0]
        out = F.when(glyphs[t.code] > most, t.code).otherwise(out)
    return out


def baselines(facts: DataFrame) -> DataFrame:
    """Home page and junk page of every site on one row."""
    pick = lambda role, c: F.max(F.when(F.col("role") == role, F.col(c)))
    return facts.where(F.col("role").isin("home", "junk")).groupBy("place_id").agg(
        pick("home", "fp").alias("home_fp"),
        pick("junk", "fp").alias("junk_fp"),
        pick("junk", "len").alias("junk_len"),
        F.max(F.when(F.col("role") == "junk", F.col("http_status") == 404)).alias("honest_404"),
    )


def stored_answers(responses: DataFrame, preset: Preset = DEFAULT) -> DataFrame:
    """:func:`answer_facts`, written once: comparisons join these narrow rows, and no body is read twice."""
    return reliable(answer_facts(spread(responses), preset.language))


def confirmed_routes(facts: DataFrame, preset: Preset = DEFAULT) -> DataFrame:
    """Candidate routes that really serve another version in the target script, of :func:`stored_answers`."""
    profile = preset.language
    honest = F.coalesce(F.col("honest_404"), F.lit(False))
    junk_len = F.coalesce(F.col("junk_len"), F.lit(0))
    return (
        facts.where((F.col("role") == "candidate") & (F.col("http_status") == 200))
        .join(baselines(facts), "place_id", "left")
        .where(honest | F.col("junk_fp").isNull() | (F.col("fp") != F.col("junk_fp")))
        .where(~F.col("fp").eqNullSafe(F.col("home_fp")))
        .where(honest | (F.abs(F.col("len") - junk_len) >= LEAST_LENGTH_CHANGE))
        .where(~F.col("soft_404"))
        .where(F.col("script_chars") >= LEAST_ROUTE_CHARS)
        .select(
            "place_id", F.col("final_url").alias("url"), _language(F.col("glyphs"), profile).alias("lang"),
            "script_chars",
        )
    )


def route_evidence(routes: DataFrame) -> DataFrame:
    """One evidence list per site; the first route by address is named."""
    return routes.groupBy("place_id").agg(F.min(F.struct("url", "lang")).alias("_r"), F.count("*").alias("routes")).select(
        "place_id",
        evidence(
            item_when(
                F.col("routes") > 0, "lang_route_confirmed", ROUTE_WEIGHT,
                phrase("робоча %s версія: %s", F.col("_r")["lang"], F.col("_r")["url"]),
            )
        ).alias("evidence"),
    )


def negotiated(facts: DataFrame, preset: Preset = DEFAULT) -> DataFrame:
    """Sites that answer a language preference with another page in the target script."""
    profile = preset.language
    return (
        facts.where(F.col("role") == "negotiated")
        .join(baselines(facts).select("place_id", "home_fp"), "place_id")
        .where((F.col("fp") != F.col("home_fp")) & (F.col("script_chars") >= LEAST_NEGOTIATED_CHARS))
        .select(
            "place_id", _language(F.col("glyphs"), profile).alias("lang"),
        )
        .withColumn(
            "evidence",
            evidence(
                item_when(
                    F.lit(True), "accept_language_negotiation", NEGOTIATED_WEIGHT,
                    phrase("сайт віддає %s за Accept-Language", F.col("lang")),
                )
            ),
        )
    )
