"""Language evidence of a site: what it declares and what its text shows."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sitegauge.functions.evidence import evidence, item, item_when, total
from sitegauge.functions.text import beyond_ascii, bind, clamp, count_class, phrase
from sitegauge.params import LanguageProfile

# --- fixed values -----------------------------------------------------------
ALTERNATE_TAG = r"""(?i)<link[^>]+rel=["']alternate["'][^>]*>"""
HREFLANG = r"""(?i)hreflang=["']([a-z]{2})(?:[-_][A-Za-z]{2})?["']"""
HREF = r"""(?i)href=["']([^"']+)["']"""
# A path segment closed by a slash, or a query value; then the end of the address or of its path.
ROUTE_CODE = (
    r"""href=["'][^"']*(?:/(?=[a-z]{2}/)|[?&](?:lang|language|locale)=)([a-z]{2})"""
    r"""(?:(?<=/[a-z]{2})/)?+(?:["'?#]|/)"""
)
OG_LOCALE = r"""(?i)property=["']og:locale:alternate["'][^>]*content=["']([a-z]{2})[_-]"""
IN_LANGUAGE = r'(?i)"inLanguage"\s*:\s*"([a-z]{2})'
HTML_LANG = r"""(?i)<html[^>]+lang=["']([a-z]{2})"""
WEIGHTS = {
    "hreflang": 45, "og_locale": 30, "jsonld": 25, "html_lang": 30, "switcher": 35, "flags": 15,
}
# --- end of fixed values ----------------------------------------------------


def version_weight(base: int, languages: Column) -> Column:
    """Full weight up to 3 languages, 0.4 of it up to 5, then a flat 5."""
    return (
        F.when(languages <= 3, base).when(languages <= 5, int(base * 0.4 + 0.5)).otherwise(5)
    )


def html_lang(html: Column) -> Column:
    return F.nullif(F.lower(F.regexp_extract(html, HTML_LANG, 1)), F.lit(""))


def _codes(html: Column, pattern: str) -> Column:
    found = F.regexp_extract_all(html, F.lit(pattern), F.lit(1))
    return F.array_distinct(F.filter(F.transform(found, lambda c: F.lower(c)), lambda c: c != ""))


def declared(html: Column, low: Column, profile: LanguageProfile) -> Column:
    """Struct of the six declared sources; feeds :func:`declared_signal`.

    Kept apart from the weighing so that each pattern runs once per page.
    """
    none = F.array().cast("array<string>")
    only_if = lambda word, c: F.when(low.contains(word), c).otherwise(none)
    tags = only_if("hreflang", F.regexp_extract_all(html, F.lit(ALTERNATE_TAG), F.lit(0)))
    pairs = F.filter(
        F.transform(
            tags,
            lambda t: F.struct(
                F.lower(F.regexp_extract(t, HREFLANG, 1)).alias("lang"),
                (F.regexp_extract(t, HREF, 1) != "").alias("linked"),
            ),
        ),
        lambda p: p["lang"] != "",
    )
    segment = "|".join(profile.segments)
    switch = (
        rf"""(?i)href=["']([^"']*(?:/(?:{segment})(?:/|["'?#])|[?&](?:lang|language|locale)=(?:{segment})))"""
    )
    flags = "|".join(profile.flag_names)
    flag = rf"""(?i)src=["'][^"']*(?:flags?[/_-])?(?:{flags})(?:[-_]?flag)?\.(?:png|gif|svg|jpe?g)"""
    return F.struct(
        F.transform(pairs, lambda p: p["lang"]).alias("alternates"),
        F.transform(F.filter(pairs, lambda p: p["linked"]), lambda p: p["lang"]).alias("linked"),
        only_if("href=", _codes(low, ROUTE_CODE)).alias("routes"),
        only_if("og:locale", _codes(html, OG_LOCALE)).alias("og"),
        only_if("inlanguage", _codes(html, IN_LANGUAGE)).alias("jsonld"),
        html_lang(html).alias("html_lang"),
        only_if("href=", F.regexp_extract_all(html, F.lit(switch), F.lit(1))).alias("switches"),
        ((low.contains("src=") & html.rlike(flag)) if flags else F.lit(False)).alias("flag_icons"),
    )


def declared_signal(d: Column, profile: LanguageProfile) -> Column:
    """Languages found, number of languages the site has, and the weighted evidence."""
    targets = F.array(*[F.lit(c) for c in profile.codes])
    everything = F.array_union(
        F.array_distinct(d["alternates"]), F.filter(d["routes"], lambda c: c != "js")
    )
    languages = F.greatest(F.lit(1), F.size(everything))
    by_link = F.array_intersect(F.array_distinct(d["linked"]), targets)

    by_og = F.array_except(F.array_intersect(d["og"], targets), by_link)
    seen_og = F.array_union(by_link, by_og)
    by_jsonld = F.array_except(F.array_intersect(d["jsonld"], targets), seen_og)
    seen_jsonld = F.array_union(seen_og, by_jsonld)
    lang_hit = F.coalesce(F.array_contains(targets, d["html_lang"]), F.lit(False))
    seen_lang = F.when(lang_hit, F.array_union(seen_jsonld, F.array(d["html_lang"]))).otherwise(seen_jsonld)

    segment = "|".join(profile.segments)
    raw = F.transform(
        d["switches"],
        lambda h: F.lower(
            F.coalesce(
                F.nullif(F.regexp_extract(h, rf"""(?i)/({segment})(?:/|["'?#])""", 1), F.lit("")),
                F.regexp_extract(h, rf"(?i)[?&](?:lang|language|locale)=({segment})", 1),
            )
        ),
    )
    canonical = raw
    if profile.aliases:
        codes = F.create_map(*[F.lit(x) for kv in profile.aliases.items() for x in kv])
        canonical = F.transform(raw, lambda c: F.coalesce(codes[c], c))
    hits = F.size(raw)
    found = F.array_union(seen_lang, F.array_distinct(canonical))

    many = F.when(
        languages > 3, phrase(" (але сайт має %s мов — типовий i18n, не діаспора)", languages)
    ).otherwise("")
    total_note = F.when(languages > 3, phrase(", всього %s мов", languages)).otherwise("")
    parts = F.concat(
        evidence(
            item_when(
                F.size(by_link) > 0, profile.alternate_signal, version_weight(WEIGHTS["hreflang"], languages),
                F.concat(F.lit("hreflang: "), F.array_join(by_link, ", "), many),
            )
        ),
        F.transform(by_og, lambda c: item("og_locale_alternate", WEIGHTS["og_locale"], F.concat(F.lit("og:locale "), c))),
        F.transform(by_jsonld, lambda c: item("jsonld_inlanguage", WEIGHTS["jsonld"], F.concat(F.lit("inLanguage "), c))),
        evidence(
            item_when(lang_hit, "html_lang", WEIGHTS["html_lang"], phrase('<html lang="%s">', d["html_lang"])),
            item_when(
                hits > 0, "lang_switcher_link", version_weight(WEIGHTS["switcher"], languages),
                F.concat(phrase("перемикач мови на сторінці (%s посил.)", hits), total_note),
            ),
            item_when(d["flag_icons"], "flag_icons", WEIGHTS["flags"], F.lit("іконки прапорів UA/RU")),
        ),
    )
    return F.struct(
        found.alias("found"), languages.alias("languages"), d["html_lang"].alias("html_lang"),
        parts.alias("evidence"),
    )


def glyph_counts(text: Column, profile: LanguageProfile) -> Column:
    """Letter counts per class, done once for all rules that need them.

    One search tells whether the script occurs at all; only then are the classes counted, those without ASCII characters
    in what is left of the text without these.
    """
    present = text.rlike(f"[{profile.script}]")

    def counts(foreign: Column) -> Column:
        def counted(char_class: str) -> Column:
            if beyond_ascii(char_class):
                return count_class(foreign, char_class)
            return F.when(present, count_class(text, char_class)).otherwise(0)

        fields = [counted(t.glyphs).alias(t.code) for t in profile.targets]
        fields.append(counted(profile.script).alias("script"))
        fields.append(F.length(text).alias("chars"))
        if profile.excluded_pattern:
            found = F.regexp_count(text, F.lit(profile.excluded_pattern[0]))
            fields.append(F.when(present, found).otherwise(0).alias("excluded"))
        return F.struct(*fields)

    return bind(F.when(present, F.regexp_replace(text, r"[\x00-\x7F]+", "")).otherwise(""), counts)


def percent(x: Column, digits: int) -> Column:
    return F.format_string(f"%.{digits}f", x * 100)


def site_exclusion(text: Column, host: Column, counts: Column, profile: LanguageProfile) -> Column:
    """``struct(code, detail)`` of the first exclusion that holds, else null."""
    out = None

    def add(cond: Column, code: str, detail: Column):
        nonlocal out
        value = F.struct(F.lit(code).alias("code"), detail.alias("detail"))
        out = F.when(cond, value) if out is None else out.when(cond, value)

    for glyphs, code, label in profile.excluded_glyphs:
        add((counts["script"] > 0) & text.rlike(f"[{glyphs}]"), code, F.lit(label))
    if profile.excluded_pattern:
        _, code, label = profile.excluded_pattern
        spared = profile.targets[-1].code
        add((counts["excluded"] > 5) & (counts[spared] == 0), code, F.concat(F.lit(label), phrase(" (%s×)", counts["excluded"])))
    if profile.excluded_host:
        pattern, code = profile.excluded_host
        add(host.rlike(pattern), code, F.concat(F.lit("домен "), host))
    if out is None:
        return F.lit(None).cast("struct<code:string,detail:string>")
    return out


def observed_signal(html: Column, low: Column, text: Column, host: Column, counts: Column,
                    exclusion: Column, profile: LanguageProfile) -> Column:
    """``struct(score, lang, hard_exclusion, evidence)`` from letters, links and numbers on the page."""
    script = counts["script"]
    script_ratio = script / F.greatest(counts["chars"], F.lit(1))
    few = F.lit(True)
    items: list[Column] = []
    for t in profile.targets:
        hits = counts[t.code]
        ratio = hits / F.greatest(script, F.lit(1))
        few = few & (hits <= 3)
        letters = "/".join(t.glyphs[: max(1, len(t.glyphs) // 2)])
        items.append(
            F.when(
                (hits > 3) & (ratio >= t.min_ratio),
                item(f"{t.label}_glyphs", t.weight,
                     phrase(f"%s× {letters} (%s%%)".replace("%%", "% кирилиці"), hits, percent(ratio, 1))),
            ).when(
                hits > 3,
                item(f"{t.label}_glyphs_trace", 8,
                     phrase("поодинокі гліфи (%s×, лише %s%)", hits, percent(ratio, 1))),
            )
        )
    items.append(
        F.when(
            (script_ratio > 0.15) & few,
            item(f"{profile.script_label}_content", 20, F.concat(percent(script_ratio, 0), F.lit("% тексту кирилиця"))),
        ).when(
            (script >= 30) & (script_ratio <= 0.15) & few,
            item(f"{profile.script_label}_fragments", 15, phrase("кирилиця фрагментами (%s символів)", script)),
        )
    )
    for signal, weight, label, pattern, field, needs in profile.patterns:
        source = html if field == "html" else text
        matches = source.rlike(pattern)
        # Every match holds one of the needed words: a byte search spares the regex.
        worded = F.lit(not needs)
        for word in needs:
            worded = worded | (low if field == "html" else text).contains(word)
        matches = worded & matches
        items.append(item_when(matches, signal, weight, F.lit(label)))
        if profile.companion and profile.companion[4] == signal:
            other, extra, extra_label, other_pattern, _ = profile.companion
            items.append(
                item_when(matches & html.rlike(other_pattern), other, extra, F.lit(extra_label))
            )
    if profile.host_pattern:
        signal, weight, pattern = profile.host_pattern
        items.append(item_when(host.rlike(pattern), signal, weight, F.concat(F.lit("домен "), host)))

    excluded = evidence(item("exclusion", 0, exclusion["detail"]))
    listed = F.when(exclusion.isNotNull(), excluded).otherwise(evidence(*items))
    most = F.greatest(*[counts[c] for c in profile.codes]) if len(profile.codes) > 1 else counts[profile.codes[0]]
    lang = None
    for t in reversed(profile.targets):
        cond = (counts[t.code] == most) & (most > 0)
        lang = F.when(cond, t.code) if lang is None else lang.when(cond, t.code)
    lang = lang.when(script > 30, profile.script_code)
    return F.struct(
        listed.alias("evidence"),
        F.when(exclusion.isNull(), lang).alias("lang"),
        exclusion["code"].alias("hard_exclusion"),
    )


def with_score(signal: Column) -> Column:
    """Add the clamped sum of the weights."""
    return F.struct(
        clamp(total(signal["evidence"]), 0, 100).alias("score"),
        signal["lang"].alias("lang"),
        signal["hard_exclusion"].alias("hard_exclusion"),
        signal["evidence"].alias("evidence"),
    )
