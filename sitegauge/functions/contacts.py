"""E-mail addresses and social profiles on a page or in a text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sitegauge.functions.text import bind

# --- fixed values -----------------------------------------------------------
# A whole run of what an address may hold, with an at sign in it; then the parts before and after that.
WITH_AT_SIGN = r"(?<![A-Za-z0-9._%+@\-])[A-Za-z0-9._%+\-]*+@[A-Za-z0-9._%+@\-]*+"
LOCAL_LEAD = r"^[.%+\-]+"
DOMAIN = r"^(?:[A-Za-z0-9\-]+\.)+[A-Za-z]{2,}(?![A-Za-z0-9_])"
# What a spelled-out address must contain (on lower-cased text).
SPELLED_OUT = r"[ \t\n\x0B\f\r(]at\s*[\s)]\s*[a-z0-9\-]++(?:\s*\(\s*dot|\s+dot|\.)"
MAILTO = r"""(?i)mailto:([^"'?>\s]{3,})"""
OBFUSCATED = r"""(?i)data-cfemail=["']([0-9a-f]+)["']"""
EMAIL_BLOCKED = (
    r"(?i)@(?:example|sentry|wixpress|squarespace|godaddy|schema|w3|sentry\.io|2x|domain)\."
    r"|\.(?:png|jpg|jpeg|gif|svg|webp|css|js)$"
    r"|^(?:info|email|your|name|user)@(?:email|domain|website|company|yoursite)\."
)
EMAIL_RANKS = (
    (0, r"(?i)^(info|contact|office|hello|sales|admin)@"),
    (1, r"(?i)^(support|help|service)@"),
    (9, r"(?i)^(no-?reply|donotreply)@"),
)
EMAIL_RANK_OTHER = 5
SOCIAL = (
    ("facebook", "facebook.com", r"(?i)https?://(?:www\.|m\.)?facebook\.com/[A-Za-z0-9._%-]+"),
    ("instagram", "instagram.com", r"(?i)https?://(?:www\.)?instagram\.com/[A-Za-z0-9._%-]+"),
    ("telegram", "t.me/", r"(?i)https?://t\.me/[A-Za-z0-9_]+"),
    ("youtube", "youtube.com", r"(?i)https?://(?:www\.)?youtube\.com/(?:c/|channel/|@)[A-Za-z0-9._%-]+"),
    ("tiktok", "tiktok.com", r"(?i)https?://(?:www\.)?tiktok\.com/@[A-Za-z0-9._%-]+"),
    ("linkedin", "linkedin.com", r"(?i)https?://(?:www\.)?linkedin\.com/(?:company|in)/[A-Za-z0-9._%-]+"),
    ("yelp", "yelp.com", r"(?i)https?://(?:www\.)?yelp\.com/biz/[A-Za-z0-9._%-]+"),
)
SOCIAL_SERVICE_PATH = (
    r"(?i)/(tr|sharer|share|dialog|plugins|widgets|intent|login|oauth|v\d+\.\d+|tr\.js|embed|badge"
    r"|profile\.php)\b"
)
# --- end of fixed values ----------------------------------------------------


def strip_binary(text: Column) -> Column:
    """Embedded base64 data out of the way of the address search."""
    out = F.regexp_replace(text, r"(?i)data:[a-z+/\-]+;base64,[A-Za-z0-9+/=]+", "data:stripped")
    return F.regexp_replace(out, r"(?<![A-Za-z0-9+/])[A-Za-z0-9+/]{200,}+={0,2}", " ")


def xor_decode(hex_text: Column) -> Column:
    """Hex pairs XOR-ed with the first pair, as characters, in lower case."""
    key = F.conv(F.substring(hex_text, 1, 2), 16, 10).cast("int")
    starts = F.sequence(F.lit(3), F.greatest(F.lit(3), F.length(hex_text) - 1), F.lit(2))
    chars = F.transform(
        starts,
        lambda at: F.char(F.conv(F.substr(hex_text, at, F.lit(2)), 16, 10).cast("int").bitwiseXOR(key)),
    )
    return F.when(F.length(hex_text) >= 4, F.lower(F.array_join(chars, "")))


def _valid(address: Column) -> Column:
    return address.contains("@") & ~address.rlike(EMAIL_BLOCKED)


def email_rank(address: Column) -> Column:
    out = F.when(address.rlike(EMAIL_RANKS[0][1]), EMAIL_RANKS[0][0])
    for rank, pattern in EMAIL_RANKS[1:]:
        out = out.when(address.rlike(pattern), rank)
    return out.otherwise(EMAIL_RANK_OTHER)


def plain_addresses(text: Column) -> Column:
    """Addresses in a text: the runs with an at sign between what no address may hold are cut at their at signs.

    Each part is looked at once, whatever its length.
    """

    def of_piece(piece: Column) -> Column:
        def joined(parts: Column) -> Column:
            pairs = F.arrays_zip(F.slice(parts, 1, F.size(parts) - 1).alias("local"), F.slice(parts, 2, F.size(parts) - 1).alias("domain"))
            both = F.transform(
                pairs,
                lambda p: F.struct(
                    F.regexp_replace(p["local"], LOCAL_LEAD, "").alias("local"), F.regexp_extract(p["domain"], DOMAIN, 0).alias("domain")
                ),
            )
            return F.transform(
                F.filter(both, lambda p: (p["local"] != "") & (p["domain"] != "")),
                lambda p: F.lower(F.concat(p["local"], F.lit("@"), p["domain"])),
            )

        return bind(F.split(piece, "@", -1), joined)

    pieces = F.regexp_extract_all(text, F.lit(WITH_AT_SIGN), F.lit(0))
    return F.filter(F.flatten(F.transform(pieces, of_piece)), _valid)


def spelled_out(text: Column) -> Column:
    """``name (at) host (dot) com`` turned into an address."""
    out = F.regexp_replace(text, r"(?i)\s*\(\s*at\s*\)\s*|\s+at\s+", "@")
    return F.regexp_replace(out, r"(?i)\s*\(\s*dot\s*\)\s*|\s+dot\s+", ".")


def emails_found(html: Column, low: Column | None = None) -> Column:
    """All addresses: links, obfuscated attributes, plain text; spelled-out ones if there is none.

    ``low`` is the lower-cased text, if the caller has it already.
    """
    low = F.lower(html) if low is None else low
    none = F.array().cast("array<string>")
    links = F.transform(
        F.regexp_extract_all(html, F.lit(MAILTO), F.lit(1)),
        lambda m: F.trim(F.lower(F.try_url_decode(F.replace(m, F.lit("+"), F.lit("%2B"))))),
    )
    hidden = F.transform(F.regexp_extract_all(html, F.lit(OBFUSCATED), F.lit(1)), xor_decode)
    sure = F.concat(
        F.when(low.contains("mailto:"), F.filter(links, _valid)).otherwise(none),
        F.when(low.contains("data-cfemail"), F.filter(hidden, _valid)).otherwise(none),
        F.when(html.contains("@"), plain_addresses(strip_binary(html))).otherwise(none),
    )
    guessed = F.when(
        low.rlike(SPELLED_OUT), plain_addresses(spelled_out(strip_binary(html)))
    ).otherwise(none)
    return bind(sure, lambda found: F.array_distinct(F.when(F.size(found) > 0, found).otherwise(guessed)))


def best_emails(found: Column) -> Column:
    """All addresses, contact addresses before chance finds; equals keep their order."""
    ranked = F.transform(
        found, lambda e, i: F.struct(email_rank(e).alias("r"), i.alias("i"), e.alias("e"))
    )
    return F.transform(F.array_sort(ranked), lambda s: s["e"])


def social_url(html: Column, low: Column, marker: str, pattern: str) -> Column:
    """First profile address of a network that is not one of its service paths."""
    urls = F.filter(
        F.regexp_extract_all(html, F.lit(pattern), F.lit(0)), lambda u: ~u.rlike(SOCIAL_SERVICE_PATH)
    )
    return F.when(low.contains(marker), F.get(urls, F.lit(0)))


def social_profiles(html: Column, low: Column | None = None) -> Column:
    """Map from network to profile address; networks without one are left out."""
    low = F.lower(html) if low is None else low
    found = F.create_map(
        *[
            part
            for name, marker, pattern in SOCIAL
            for part in (F.lit(name), social_url(html, low, marker, pattern))
        ]
    )
    return F.map_filter(found, lambda _, url: url.isNotNull())
