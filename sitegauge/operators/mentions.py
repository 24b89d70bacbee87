"""Words on a page that stand where a contact person is usually named.

Finds candidates and scores them by source.  Which candidates count is decided by
the lexicon and the rules the caller gives; only scores leave these operators.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitegauge.functions.evidence import evidence, item_when
from sitegauge.functions.text import clamp, collapse, drop_tags, phrase
from sitegauge.session import reliable

# --- fixed values -----------------------------------------------------------
LD_JSON = r"""(?is)<script[^>]+type=["']application/ld\+json["'][^>]*>(.*?)</script>"""
PERSON_KEYS = ("founder", "employee", "author", "member", "owner", "director", "creator")
NAME_PAIR = r"[A-Z][a-z'’\-]{2,19}\s+[A-Z][a-z'’\-]{3,24}"
WINDOW = 40
COPYRIGHT_WORD = (
    r"(?:©|&copy;|copyright)\s*(?:\d{4}(?:\s*[-–]\s*\d{4})?)?\s*([A-Z][A-Za-z'’\-]{2,24})"
)
SURE_SOURCES = ("structured", "script")
SURE_SCORE, OTHER_SCORE = 30, 25
# --- end of fixed values ----------------------------------------------------

_SOURCE_ORDER = ("structured", "role", "copyright", "email", "script")


def structured_blocks(html: Column) -> Column:
    return F.regexp_extract_all(html, F.lit(LD_JSON), F.lit(1))


def structured_names(pages: DataFrame, key: str, html: str = "html") -> DataFrame:
    """Names in the person nodes of structured data."""
    return names_in_blocks(pages.select(key, structured_blocks(F.col(html)).alias("_b")), key)


def names_in_blocks(blocks: DataFrame, key: str) -> DataFrame:
    """(key, candidate): the names of person nodes in blocks (key, _b) of structured data.

    A node is a person's by its type, or because it stands under one of PERSON_KEYS. The blocks become variants, and
    each round opens one level of all of them; nodes of the deepest block give as many rounds. A block that is no JSON
    has no nodes.
    """
    spark = blocks.sparkSession
    nodes = blocks.select(key, F.explode("_b").alias("_t")).select(key, F.try_parse_json("_t").alias("_v"), F.lit(False).alias("_inside"))
    nodes = reliable(nodes.where("_v is not null"))
    found = []
    while not nodes.isEmpty():
        kind = F.to_json(F.try_variant_get("_v", "$['@type']", "variant"))
        person = F.col("_inside") | F.coalesce(F.lower(kind).contains("person"), F.lit(False))
        name = F.try_variant_get("_v", "$.name", "variant")
        text = F.when(F.schema_of_variant(name) == "STRING", name.try_cast("string"))
        found.append(nodes.where(person & F.length(text).between(4, 59)).select(key, text.alias("candidate")))
        opened = nodes.lateralJoin(spark.tvf.variant_explode(F.col("_v").outer())).where("key is null or key <> 'name'")
        below = F.when(F.col("key").isNull(), F.col("_inside")).otherwise(F.lower("key").isin(*PERSON_KEYS))
        complex_ = F.schema_of_variant("value").startswith("OBJECT") | F.schema_of_variant("value").startswith("ARRAY")
        nodes = reliable(opened.where(complex_).select(nodes[key], F.col("value").alias("_v"), below.alias("_inside")))
    out = blocks.select(key, F.lit("").alias("candidate")).limit(0)
    for names in found:
        out = out.unionByName(names)
    return out


#: Marks that text has no use for, put around what the one search for pairs finds.
_AROUND, _BETWEEN = "\x01", "\x02"


def near_role(text: Column, role_pattern: str) -> Column:
    """Capitalised word pairs with a role word within 40 characters on either side.

    The look-behind and look-ahead capture the surroundings without consuming them,
    so neighbouring pairs keep their full context. The text is searched once: each find is
    put between marks together with its surroundings, and cut out along them.
    """
    clean = F.translate(text, _AROUND + _BETWEEN, "  ")
    padded = F.concat(F.lit(" " * WINDOW), clean)
    pattern = (
        rf"(?<![A-Za-z0-9_])(?=[A-Z][a-z'’\-]{{2}})(?<=((?s:.){{{WINDOW}}}))({NAME_PAIR})"
        rf"(?:(?<=[a-z])(?![A-Za-z0-9_])|(?<=['’\-])(?=[A-Za-z0-9_]))(?=((?s:.){{0,{WINDOW}}}))"
    )
    marked = F.regexp_replace(padded, pattern, f"{_AROUND}$1{_BETWEEN}$2{_BETWEEN}$3{_AROUND}")
    # Every second piece is a find.
    finds = F.filter(F.split(marked, _AROUND), lambda p, i: i % 2 == 1)
    cut = F.transform(finds, lambda p: F.split(p, _BETWEEN))
    kept = F.filter(cut, lambda z: F.concat(z[0], F.lit(" | "), z[2]).rlike(f"(?i){role_pattern}"))
    return F.transform(kept, lambda z: z[1])


def without_stop_words(candidates: Column, stop_words: Sequence[str]) -> Column:
    if not stop_words:
        return candidates
    stops = F.array(*[F.lit(w.lower()) for w in stop_words])
    return F.filter(
        candidates, lambda c: ~F.arrays_overlap(F.split(F.lower(c), r"[\s'’.\-]+"), stops)
    )


def copyright_words(html: Column) -> Column:
    return F.regexp_extract_all(drop_tags(html, " "), F.lit(COPYRIGHT_WORD), F.lit(1))


def email_words(emails: Column) -> Column:
    """Words of four letters and more in the local parts of the addresses."""
    words = F.flatten(F.transform(emails, lambda e: F.split(F.split(e, "@")[0], r"[._\-+\d]+")))
    return F.filter(words, lambda w: F.length(w) >= 4)


def script_near_role(text: Column, roles: str, script: str) -> Column:
    """Two capitalised words of another script straight after a role word."""
    upper, rest = f"[{script}&&\\p{{Lu}}]", f"[{script}&&\\p{{Ll}}']"
    pattern = rf"(?iu:{roles})[\s:,\-]{{1,4}}({upper}{rest}{{2,}}\s+{upper}{rest}{{2,}})"
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(1))


def candidates(pages: DataFrame, key: str, role_pattern: str, stop_words: Sequence[str] = (),
               script_roles: str | None = None, script: str | None = None) -> DataFrame:
    """(key, source, candidate) of a table with ``html``, ``text`` and ``emails``; each word once, from its first source.

    The pages are read once: what is found is stored, and the structured blocks are opened from there.
    """
    listed = [
        ("role", without_stop_words(near_role(collapse(F.col("text")), role_pattern), stop_words)),
        ("copyright", without_stop_words(copyright_words(F.col("html")), stop_words)),
        ("email", without_stop_words(email_words(F.col("emails")), stop_words)),
    ]
    if script_roles and script:
        listed.append(("script", script_near_role(F.col("text"), script_roles, script)))
    def tag(source: str, found: Column) -> Column:
        return F.transform(
            F.coalesce(found, F.array().cast("array<string>")),
            lambda x: F.struct(F.lit(source).alias("source"), x.alias("candidate")),
        )

    found = F.flatten(F.array(*[tag(source, c) for source, c in listed]))
    read = reliable(pages.select(key, F.array_distinct(found).alias("_inline"), structured_blocks(F.col("html")).alias("_b")))
    inline = read.select(key, F.explode("_inline").alias("_c")).select(key, "_c.source", "_c.candidate")
    tagged = names_in_blocks(read, key).select(key, F.lit("structured").alias("source"), "candidate")
    rank = F.array_position(F.array(*[F.lit(s) for s in _SOURCE_ORDER]), F.col("source"))
    return tagged.unionByName(inline).groupBy(key, "candidate").agg(F.min_by("source", rank).alias("source")).select(
        key, "source", "candidate"
    )


def mention_score(hits: DataFrame, key: str) -> DataFrame:
    """Score per page from classified candidates ``(key, source, ok, strong)``.

    The first strong hit in source order decides: 30 for structured or script
    sources, 25 for the others, 0 without one.
    """
    rank = F.array_position(F.array(*[F.lit(s) for s in _SOURCE_ORDER]), F.col("source"))
    scored = hits.where("ok").groupBy(key).agg(
        F.min(F.when(F.col("strong"), rank)).alias("_first"),
        F.count("*").alias("mentions"),
    )
    sure = [i + 1 for i, s in enumerate(_SOURCE_ORDER) if s in SURE_SOURCES]
    return scored.select(
        key, "mentions",
        F.when(F.col("_first").isNull(), 0).when(F.col("_first").isin(*sure), SURE_SCORE)
        .otherwise(OTHER_SCORE).alias("mention_score"),
    )


def with_mentions(signal: Column, mention_score: Column, mentions: Column) -> Column:
    """Add the mention evidence to a site signal; an excluded site is left alone."""
    score = F.coalesce(mention_score, F.lit(0))
    extra = evidence(item_when(score > 0, "contact_word_on_site", score, phrase("збігів на сайті: %s", mentions)))
    keep = signal["hard_exclusion"].isNotNull()
    return F.struct(
        F.when(keep, signal["score"]).otherwise(clamp(signal["score"] + score, 0, 100)).alias("score"),
        signal["lang"].alias("lang"),
        signal["hard_exclusion"].alias("hard_exclusion"),
        F.when(keep, signal["evidence"]).otherwise(F.concat(signal["evidence"], extra)).alias("evidence"),
    )
