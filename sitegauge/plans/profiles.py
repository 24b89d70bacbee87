"""Settings for running the operators on the driver's invented test tables."""

from __future__ import annotations

import dataclasses

from sitegauge.operators.rules import Rule, TextRules
from sitegauge.operators.tasks import Niche
from sitegauge.params import DEFAULT, Filters, GlyphLanguage, LanguageProfile, Thresholds

# The test texts are in four languages of Latin script: two of them are the targets.
ACCENTS = LanguageProfile(
    targets=(
        GlyphLanguage("fr", "french", "éèêçàùâîôûëïœ", 40, 0.02),
        GlyphLanguage("de", "german", "äöüß", 35, 0.01),
    ),
    script="\\u00C0-\\u024F",
    script_code="lat",
    script_label="accent",
    alternate_signal="hreflang",
    aliases={"at": "de"},
    excluded_glyphs=(("ñ¿¡", "spanish_marks", "spanish marks"),),
    excluded_host=("(?i)\\.(org)$", "org_domain"),
    patterns=(
        ("mail_contact", 20, "mail on page", "(?i)@[a-z]", "text", ("@",)),
        ("plus_phone", 45, "phone with country code", "\\+\\s?\\d{2}", "text", ("+",)),
    ),
    companion=("mail_combo", 5, "mail and list", "(?i)<li>", "mail_contact"),
    host_pattern=("net_domain", 50, "(?i)\\.net$"),
    flag_names=("fr", "de"),
)

TRIAL = dataclasses.replace(
    DEFAULT, language=ACCENTS, filters=Filters(), thresholds=Thresholds(lead=55, manual=35)
)

NAME_RULES = TextRules(
    exclusions=(Rule("(?i)000013", 0, "excluded number"),),
    markers=(
        Rule("(?i)machinery", 12, "machinery"), Rule("(?i)household", 28, "household"),
        Rule("(?i)00001", 20, "low number"), Rule("(?i)building", 28, "building"),
    ),
    endings=(Rule("(?i)ture$", 18, "-ture"), Rule("(?i)ery$", 14, "-ery")),
)
CATEGORY_RULES = (
    Rule("^auto", 26, "vehicles"), Rule("^furniture", 16, "furniture"), Rule("^(building|house)", 10, "homes"),
)

PART_RULES = (
    Rule("(?i)\\bred\\b", 10, "red"), Rule("(?i)\\bsmall\\b", 22, "small"), Rule("(?i)widget", 22, "widget"),
    Rule("(?i)ring$", 5, "ring"),
)

NICHES = (
    Niche("auto_repair", "A", "Auto repair", "auto repair shop", "car_repair"),
    Niche("roofing", "A", "Roofing", "roofing contractor", "roofing_contractor"),
    Niche("dental", "B", "Dental office", "dental office", "dentist"),
    Niche("bakery", "C", "Bakery", "bakery", "bakery"),
)
MARKERS = ("bilingual", "family", "local", "downtown", "night")
STANDALONE = ("business services", "food store")
