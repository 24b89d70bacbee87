"""Parameters of a run: thresholds, filters, budgets, and the language profile.

Everything that is time dependent takes ``as_of`` from here, so that a run can
be repeated and compared.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping
from dataclasses import dataclass, field

# --- fixed values -----------------------------------------------------------
# Types whose records never become leads.
EXCLUDED_TYPES = (
    "church", "place_of_worship", "synagogue", "mosque", "hindu_temple",
    "embassy", "local_government_office", "city_hall", "courthouse", "police",
    "cemetery", "park", "tourist_attraction", "museum", "library",
    "primary_school", "secondary_school", "university", "school_district",
    "public_bath", "national_park", "historical_landmark", "monument",
    "non_profit_organization", "association_or_organization", "community_center",
    "cultural_center",
)

# Two-letter region codes accepted in an address.
US_REGION_CODES = (
    "AL", "AK", "AZ", "AR", "CA", "CO", "CT", "DE", "FL", "GA", "HI", "ID", "IL", "IN",
    "IA", "KS", "KY", "LA", "ME", "MD", "MA", "MI", "MN", "MS", "MO", "MT", "NE", "NV",
    "NH", "NJ", "NM", "NY", "NC", "ND", "OH", "OK", "OR", "PA", "RI", "SC", "SD", "TN",
    "TX", "UT", "VT", "VA", "WA", "WV", "WI", "WY", "DC", "PR", "VI", "GU", "AS", "MP",
)

# Monthly free allowance per metered interface.
FREE_TIER = {"text_search": 1000, "place_details": 1000, "psi": 25_000}

# The most a review stage can add to a score.
MAX_REVIEW_BOOST = 70
# --- end of fixed values ----------------------------------------------------


@dataclass(frozen=True)
class Filters:
    min_review_count: int = 5
    require_us_address: bool = True
    excluded_host_suffixes: tuple[str, ...] = (".ru", ".by", ".su")
    excluded_phone_prefixes: tuple[str, ...] = ("+7",)
    excluded_types: tuple[str, ...] = EXCLUDED_TYPES
    modern_stack_is_rejection: bool = True
    primary_type_counts: bool = True


@dataclass(frozen=True)
class Thresholds:
    lead: int = 55
    manual: int = 35
    site_score_max_for_lead: int = 6


@dataclass(frozen=True)
class Discovery:
    marker_mode: bool = True
    geo_dense_mode: bool = True
    max_pages_per_query: int = 2
    marker_limit: int = 4
    marker_tiers: tuple[str, ...] = ("A", "B")
    geo_tiers: tuple[str, ...] = ("A",)


@dataclass(frozen=True)
class GlyphLanguage:
    """A language told from its neighbours by the letters only it uses."""

    code: str
    label: str
    glyphs: str
    weight: int
    min_ratio: float


@dataclass(frozen=True)
class LanguageProfile:
    """What counts as evidence that a *site* addresses readers of the target languages.

    ``script`` and ``glyphs`` are the inside of a regex character class.
    ``aliases`` maps path segments that stand for another code (``ua`` for ``uk``).
    """

    targets: tuple[GlyphLanguage, ...]
    script: str
    script_code: str
    script_label: str = "script"
    alternate_signal: str = "hreflang"
    aliases: Mapping[str, str] = field(default_factory=dict)
    excluded_glyphs: tuple[tuple[str, str, str], ...] = ()
    excluded_pattern: tuple[str, str, str] | None = None
    excluded_host: tuple[str, str] | None = None
    # (signal, weight, detail, pattern, field, needed words) with field "html" or "text"
    patterns: tuple[tuple[str, int, str, str, str, tuple[str, ...]], ...] = ()
    companion: tuple[str, int, str, str, str] | None = None
    host_pattern: tuple[str, int, str] | None = None
    flag_names: tuple[str, ...] = ()

    @property
    def codes(self) -> tuple[str, ...]:
        return tuple(t.code for t in self.targets)

    @property
    def segments(self) -> tuple[str, ...]:
        return self.codes + tuple(self.aliases)


# --- fixed values: the default profile ---------------------------------------
EAST_SLAVIC_SITES = LanguageProfile(
    targets=(
        GlyphLanguage("uk", "ukrainian", "іїєґІЇЄҐ", 40, 0.02),
        GlyphLanguage("ru", "russian", "ыэъёЫЭЪЁ", 35, 0.01),
    ),
    script="\\u0400-\\u04FF",
    script_code="cyr",
    script_label="cyrillic",
    alternate_signal="hreflang_slavic",
    aliases={"ua": "uk"},
    excluded_glyphs=(("ђјљњћџЂЈЉЊЋЏ", "serbian_glyphs", "сербські гліфи ђјљњћџ"),),
    excluded_pattern=("\\p{Ll}ъ\\p{Ll}", "bulgarian", "болгарський патерн ъ"),
    excluded_host=("(?i)\\.(ru|by|su)$", "ru_by_domain"),
    patterns=(
        ("viber_contact", 35, "Viber у контактах",
         "(?i)viber://|(?:href|data-href)=[\"'][^\"']*viber[^\"']*[\"']|(?:chat\\.)?viber\\.com/[a-z0-9]", "html", ("viber",)),
        ("telegram_contact", 20, "Telegram у контактах",
         "(?i)t\\.me/[a-z0-9_]|telegram\\.me/[a-z0-9_]|tg://|(?:href|data-href)=[\"'][^\"']*t\\.me/[^\"']*[\"']", "html", ("t.me/", "telegram.me/", "tg://")),
        ("ua_phone", 45, "телефон +380", "\\+\\s?380[\\s\\-(]?\\d{2}", "text", ("+",)),
        ("ru_phone", 15, "телефон +7", "\\+\\s?7[\\s\\-(]?9\\d{2}[\\s\\-)]?\\d{3}", "text", ("+",)),
        ("uah_currency", 25, "ціни в гривні", "(?iu)₴|(?<!\\p{L})грн(?!\\p{L})", "text", ("₴", "грн", "Грн", "ГРН")),
    ),
    companion=("messenger_combo", 5, "Viber + WhatsApp",
               "(?i)wa\\.me/\\d|api\\.whatsapp\\.com/send", "viber_contact"),
    host_pattern=("ua_domain", 50, "(?i)\\.(ua|com\\.ua|kiev\\.ua|kyiv\\.ua|lviv\\.ua)$"),
    flag_names=("ua", "ukr", "ukraine", "rus", "russia"),
)
# --- end of fixed values ------------------------------------------------------


@dataclass(frozen=True)
class Preset:
    as_of: dt.date = dt.date(2026, 8, 5)
    filters: Filters = field(default_factory=Filters)
    thresholds: Thresholds = field(default_factory=Thresholds)
    discovery: Discovery = field(default_factory=Discovery)
    language: LanguageProfile = EAST_SLAVIC_SITES
    max_text_search: int = 980
    max_place_details: int = 950
    tiers: tuple[str, ...] = ("A", "B", "C")
    # The page foot is where a copyright year is looked for.

    @property
    def year(self) -> int:
        return self.as_of.year


DEFAULT = Preset()
