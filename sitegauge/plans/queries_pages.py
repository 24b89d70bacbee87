"""Registered queries over ``pages`` and ``documents``, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sitegauge.functions import contacts, languages, markup
from sitegauge.functions.text import count_class, fingerprint, html_to_text
from sitegauge.functions.urls import host_of, safe_url
from sitegauge.operators import reports
from sitegauge.operators.effort import difficulty, effort, stars_text
from sitegauge.operators.quality import score_band, site_quality
from sitegauge.plans import checks
from sitegauge.plans.inputs import table
from sitegauge.plans.profiles import ACCENTS, TRIAL
from sitegauge.plans.rescore import page_columns, page_facts
from sitegauge.session import reliable, spread

def responses(spark: SparkSession, sf: str) -> DataFrame:
    """Stored home pages in the shape of the job's input, with the mark-up that the table lacks."""
    return table(spark, sf, "pages").select(
        F.col("page_id"), F.concat(F.lit("p"), F.col("page_id").cast("string")).alias("place_id"),
        F.col("url").alias("final_url"), F.expr(checks.RICH_HTML).alias("html"),
    )


def columns(spark: SparkSession, sf: str) -> DataFrame:
    return page_columns(spread(responses(spark, sf)), TRIAL, keep=("page_id",))


def with_quality(spark: SparkSession, sf: str) -> DataFrame:
    # Only what the score reads is computed and stored.
    audit = F.col("audit").dropFields("emails", "socials").alias("audit")
    facts = reliable(page_facts(spread(responses(spark, sf)), TRIAL).select("place_id", audit))
    return site_quality(facts.withColumn("page_id", F.substr("place_id", F.lit(2)).cast("long")), TRIAL.year, name="q")


def page_quality(spark: SparkSession, sf: str) -> DataFrame:
    q = F.col("q")
    return with_quality(spark, sf).select(
        "page_id", q["status"].alias("status"), q["raw"].alias("raw"), q["score10"].alias("score10"),
        F.array_join(q["dated_markers"], "; ").alias("markers"),
    )


def quality_histogram(spark: SparkSession, sf: str) -> DataFrame:
    rows = with_quality(spark, sf).select(F.col("q")["score10"].alias("site_score"))
    return reports.score_histogram(rows)


def quality_counts(spark: SparkSession, sf: str) -> DataFrame:
    rows = with_quality(spark, sf).select(F.col("q")["score10"].alias("site_score"))
    counted = reports.site_score_histogram(rows)
    return counted.withColumn("colour", score_band(F.col("site_score")))


def marker_report(spark: SparkSession, sf: str) -> DataFrame:
    return reports.marker_frequency(with_quality(spark, sf).select(F.col("q")["dated_markers"].alias("dated_markers")))


def marker_coverage(spark: SparkSession, sf: str) -> DataFrame:
    return reports.marker_coverage(with_quality(spark, sf).select(F.col("q")["dated_markers"].alias("dated_markers")))


def page_metadata(spark: SparkSession, sf: str) -> DataFrame:
    return columns(spark, sf).select(
        "page_id", *[F.col(c) for c in (
            "title", "h1", "meta_description", "has_viewport", "og_tags", "favicon", "charset_declared", "https",
            "mixed_content",
        )],
    )


def technology(spark: SparkSession, sf: str) -> DataFrame:
    return columns(spark, sf).select(
        "page_id", *[F.col(c) for c in (
            "cms", "builder", "modern_framework", "jquery_version", "bootstrap_major", "has_flash", "table_layout",
            "footer_year",
        )],
    )


def page_structure(spark: SparkSession, sf: str) -> DataFrame:
    return columns(spark, sf).select(
        "page_id", *[F.col(c) for c in (
            "page_count", "unique_page_types", "has_catalog", "has_ecommerce", "has_forms",
        )],
    )


def page_text(spark: SparkSession, sf: str) -> DataFrame:
    """Visible text; every page ends in entities.

    A character in two halves, a high one, half a one, none, some that give the beginning of another one, and one of its own.
    """
    entities = "<p>&#55357;&#56832; &#128512; &#55357;x &#1234567890; &#169; &#38;#60; &#60; &amp;#60; &#&#65; &#"
    own = (F.col("page_id") % 5000 + 1000).cast("string")
    text = html_to_text(F.concat("html", F.lit(entities), own, F.lit(";</p>")))
    base = table(spark, sf, "pages").select("page_id", text.alias("t"), "html")
    return base.select(
        "page_id", F.length("t").alias("chars"), F.md5("t").alias("text_md5"),
        markup.empty_shell(F.col("html"), F.col("t")).alias("empty_shell"),
    )


def page_fingerprint(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "pages").select("page_id", fingerprint(F.col("html")).alias("fp"))


def declared_languages(spark: SparkSession, sf: str) -> DataFrame:
    v = F.col("versions")
    ev = v["evidence"]
    return columns(spark, sf).select(
        "page_id", v["html_lang"].alias("html_lang"), v["languages"].alias("languages"),
        F.array_join(F.transform(ev, lambda e: F.concat(e["signal"], F.lit("+"), e["weight"])), ";").alias("signals"),
        F.array_join(F.transform(ev, lambda e: e["detail"]), ";").alias("details"),
    )


def site_signal(spark: SparkSession, sf: str) -> DataFrame:
    s = F.col("s")
    return columns(spark, sf).select("page_id", languages.with_score(F.col("observed")).alias("s")).select(
        "page_id", s["score"].alias("score"), s["lang"].alias("lang"), s["hard_exclusion"].alias("hard_exclusion"),
        F.array_join(F.transform(s["evidence"], lambda e: F.concat(e["signal"], F.lit("+"), e["weight"])), ";").alias("signals"),
    )


def host_counts(spark: SparkSession, sf: str) -> DataFrame:
    return reports.top_labels(table(spark, sf, "pages").select("url"), host_of(F.col("url")))


def https_share(spark: SparkSession, sf: str) -> DataFrame:
    url = F.col("url")
    return reports.signal_precision(
        table(spark, sf, "pages"), safe_url(url).isNotNull(), F.lower(url).startswith("https:")
    )


def page_type_counts(spark: SparkSession, sf: str) -> DataFrame:
    """First path segment of the page addresses."""
    path = F.regexp_extract("url", r"^[a-zA-Z][a-zA-Z0-9+.\-]*://[^/?#]+([^?#]*)", 1)
    return reports.count_by(table(spark, sf, "pages").select(F.split(path, "/")[1].alias("segment")), "segment")


def _found(rows: DataFrame, key: str, text: str) -> DataFrame:
    """Rows with addresses. The exploded array keeps the filter behind the search, which so is done once."""
    found = rows.select(key, F.explode(F.array(contacts.emails_found(F.col(text)))).alias("found"))
    return found.where(F.size("found") > 0)


def email_extract(spark: SparkSession, sf: str) -> DataFrame:
    found = _found(table(spark, sf, "documents"), "doc_id", "text")
    return found.select(
        "doc_id", F.array_join(contacts.best_emails(F.col("found")), ",").alias("emails"),
        F.size("found").cast("long").alias("total"),
    )


def page_emails(spark: SparkSession, sf: str) -> DataFrame:
    found = _found(responses(spark, sf), "page_id", "html")
    return found.select(
        "page_id", F.array_join(contacts.best_emails(F.col("found")), ",").alias("emails"),
        F.size("found").cast("long").alias("total"),
    )


def social_links(spark: SparkSession, sf: str) -> DataFrame:
    """Profiles per network over all pages, documents and suppliers (whose names become profile links)."""
    linked = table(spark, sf, "supplier").select(
        F.concat(
            F.lit('<a href="https://facebook.com/tr?id=1"><a href="https://www.'),
            F.when(F.col("s_nationkey") > 12, "facebook.com/s").otherwise("instagram.com/i"), F.col("s_suppkey").cast("string"), F.lit('">'),
        ).alias("html")
    )
    both = table(spark, sf, "pages").select("html").unionByName(
        table(spark, sf, "documents").select(F.col("text").alias("html"))
    ).unionByName(linked)
    kinds = both.select(F.explode(contacts.social_profiles(F.col("html"))).alias("network", "profile"))
    return kinds.groupBy("network").agg(F.count("*").alias("pages"), F.min("profile").alias("first_profile"))


def phone_flags(spark: SparkSession, sf: str) -> DataFrame:
    text = F.col("text")
    return table(spark, sf, "documents").groupBy("lang").agg(
        F.count("*").alias("docs"),
        F.count_if(text.rlike(r"\+\s?380[\s\-(]?\d{2}")).alias("ua"),
        F.count_if(text.rlike(r"\+\s?7[\s\-(]?9\d{2}[\s\-)]?\d{3}[\s\-)]?\d{3}")).alias("ru"),
        F.count_if(text.rlike(r"\+\s?\d{1,3}[\s\-(]?\d{2}")).alias("any_plus"),
    )


def glyph_ratio(spark: SparkSession, sf: str) -> DataFrame:
    text = F.col("text")
    counts = languages.glyph_counts(text, ACCENTS)
    return table(spark, sf, "documents").select("doc_id", counts.alias("c")).select(
        "doc_id", "c.fr", "c.de", "c.script", "c.chars",
        F.floor(F.col("c.script") * 1000 / F.greatest("c.chars", F.lit(1))).cast("long").alias("per_mille"),
    )


def effort_hours(spark: SparkSession, sf: str) -> DataFrame:
    parts = ("fetch_error", "unique_page_types", "has_catalog", "has_ecommerce", "languages", "has_forms", "page_count")
    audits = columns(spark, sf).select("page_id", F.struct(*parts).alias("audit"))
    rows = audits.select("page_id", effort(F.col("audit")).alias("e"))
    d = difficulty(F.col("e")["hours_min"], F.col("e")["hours_max"])
    return rows.select(
        "page_id", F.col("e")["hours_min"].alias("hours_min"), F.col("e")["hours_max"].alias("hours_max"),
        d["stars"].alias("stars"), stars_text(d["stars"]).alias("stars_text"), d["label"].alias("label"),
    )


def shop_recheck(spark: SparkSession, sf: str) -> DataFrame:
    """Catalogue label by path words against the stricter shop rule."""
    from sitegauge.functions.structure import CATALOG

    rows = table(spark, sf, "pages")
    return reports.label_recheck(rows, F.col("html").rlike("(?i)/(the|and)"), F.col("html"), "(?i)/and\\b|" + CATALOG[4:])


def accent_classes(spark: SparkSession, sf: str) -> DataFrame:
    text = F.col("text")
    return table(spark, sf, "documents").groupBy("source").agg(
        F.sum(count_class(text, "éèê")).alias("e_accents"), F.sum(count_class(text, "äöü")).alias("umlauts"),
        F.sum(F.length(text)).alias("chars"),
    )


QUERIES = {
    f.__name__: f
    for f in (
        page_quality, quality_histogram, quality_counts, marker_report, marker_coverage, page_metadata, technology,
        page_structure, page_text, page_fingerprint, declared_languages, site_signal, host_counts, https_share,
        page_type_counts, email_extract, page_emails, social_links, phone_flags, glyph_ratio, effort_hours,
        shop_recheck, accent_classes,
    )
}

_Q = "WITH " + checks.PAGE_FACTS + "," + checks.quality()
_PATHS = "WITH " + checks.PAGE_PATHS
_TEXT = checks.visible_text()
_ENDED = (
    f"trim({checks.visible_text("(html || '<p>')")} || ' ' || chr(128512) || ' ' || chr(128512) || ' ' || chr(65533) || 'x ' || chr(65533)"
    " || ' © &#60; < < &#A ' || chr(CAST(page_id % 5000 + 1000 AS INTEGER)))"
)
_SWITCH = """(?i)href=["'']([^"'']*(?:/(?:fr|de|at)(?:/|["''?#])|[?&](?:lang|language|locale)=(?:fr|de|at)))"""
_ROUTE = """(?i)href=["''][^"'']*(?:/([a-z]{2})/|[?&](?:lang|language|locale)=([a-z]{2}))(?:["''?#]|/)"""

DECLARED = f"""
tags AS (
  SELECT page_id, html, url, nullif(lower(regexp_extract(html, '(?i)<html[^>]+lang=["'']([a-z]{{2}})', 1)), '') AS html_lang,
    list_filter(list_transform(regexp_extract_all(html, '(?i)<link[^>]+rel=["'']alternate["''][^>]*>'),
       lambda t: lower(regexp_extract(t, '(?i)hreflang=["'']([a-z]{{2}})(?:[-_][A-Za-z]{{2}})?["'']', 1))), lambda c: c <> '') AS alternates,
    list_filter(list_distinct(list_concat(list_transform(regexp_extract_all(html, '{_ROUTE}', 1), lambda c: lower(c)),
       list_transform(regexp_extract_all(html, '{_ROUTE}', 2), lambda c: lower(c)))), lambda c: c <> '' AND c <> 'js') AS routes,
    len(regexp_extract_all(html, '{_SWITCH}', 1)) AS switches,
    regexp_matches(html, '(?i)src=["''][^"'']*(?:flags?[/_-])?(?:fr|de)(?:[-_]?flag)?\\.(?:png|gif|svg|jpe?g)') AS flags
  FROM {checks.RICH_PAGES}),
declared AS (
  SELECT *, greatest(1, len(list_distinct(list_concat(alternates, routes)))) AS languages FROM tags),
versions AS (
  SELECT page_id, html_lang, languages,
    list_filter([
      CASE WHEN len(list_filter(alternates, lambda c: c IN ('fr', 'de'))) > 0 THEN {{'s': 'hreflang', 'w': CASE WHEN languages <= 3 THEN 45 WHEN languages <= 5 THEN 18 ELSE 5 END, 'd': 'hreflang: ' || array_to_string(list_filter(list_filter(alternates, lambda c: c IN ('fr', 'de')), lambda x, i: list_position(list_filter(alternates, lambda c: c IN ('fr', 'de')), x) = i), ', ')}} END,
      CASE WHEN html_lang IN ('fr', 'de') THEN {{'s': 'html_lang', 'w': 30, 'd': '<html lang="' || html_lang || '">'}} END,
      CASE WHEN switches > 0 THEN {{'s': 'lang_switcher_link', 'w': CASE WHEN languages <= 3 THEN 35 WHEN languages <= 5 THEN 14 ELSE 5 END,
           'd': 'перемикач мови на сторінці (' || switches || ' посил.)' || CASE WHEN languages > 3 THEN ', всього ' || languages || ' мов' ELSE '' END}} END,
      CASE WHEN flags THEN {{'s': 'flag_icons', 'w': 15, 'd': 'іконки прапорів UA/RU'}} END], lambda e: e IS NOT NULL) AS ev
  FROM declared)
"""

_HITS = "len(regexp_extract_all(t, '[%s]'))"
SIGNALS = f"""
seen AS (SELECT page_id, host, html, {_TEXT} AS t FROM pg),
glyphs AS (SELECT *, {_HITS % 'éèêçàùâîôûëïœ'} AS fr, {_HITS % 'äöüß'} AS de, {_HITS % 'À-ɏ'} AS script FROM seen),
excl AS (SELECT *, CASE WHEN script > 0 AND regexp_matches(t, '[ñ¿¡]') THEN 'spanish_marks' WHEN regexp_matches(host, '(?i)\\.(org)$') THEN 'org_domain' END AS hard_exclusion FROM glyphs),
observed AS (
  SELECT page_id, hard_exclusion,
    CASE WHEN hard_exclusion IS NULL THEN CASE WHEN fr > de THEN 'fr' WHEN de > 0 THEN 'de' WHEN script > 30 THEN 'lat' END END AS lang,
    CASE WHEN hard_exclusion IS NOT NULL THEN [{{'s': 'exclusion', 'w': 0}}] ELSE list_filter([
      CASE WHEN fr > 3 AND fr / greatest(script, 1) >= 0.02 THEN {{'s': 'french_glyphs', 'w': 40}} WHEN fr > 3 THEN {{'s': 'french_glyphs_trace', 'w': 8}} END,
      CASE WHEN de > 3 AND de / greatest(script, 1) >= 0.01 THEN {{'s': 'german_glyphs', 'w': 35}} WHEN de > 3 THEN {{'s': 'german_glyphs_trace', 'w': 8}} END,
      CASE WHEN script / greatest(length(t), 1) > 0.15 AND fr <= 3 AND de <= 3 THEN {{'s': 'accent_content', 'w': 20}}
           WHEN script >= 30 AND script / greatest(length(t), 1) <= 0.15 AND fr <= 3 AND de <= 3 THEN {{'s': 'accent_fragments', 'w': 15}} END,
      CASE WHEN regexp_matches(t, '(?i)@[a-z]') THEN {{'s': 'mail_contact', 'w': 20}} END,
      CASE WHEN regexp_matches(t, '(?i)@[a-z]') AND regexp_matches(html, '(?i)<li>') THEN {{'s': 'mail_combo', 'w': 5}} END,
      CASE WHEN regexp_matches(t, '\\+\\s?\\d{{2}}') THEN {{'s': 'plus_phone', 'w': 45}} END,
      CASE WHEN regexp_matches(host, '(?i)\\.net$') THEN {{'s': 'net_domain', 'w': 50}} END], lambda e: e IS NOT NULL) END AS ev
  FROM excl)
"""
_JOINED = "array_to_string(list_transform(ev, lambda e: e.s || '+' || e.w), ';') AS signals"

ORACLES = {
    "page_quality": _Q + " SELECT page_id, status, raw, score10, markers FROM quality",
    "quality_histogram": _Q + " SELECT s AS score, count(q.page_id) AS n FROM (SELECT unnest(range(1, 11)) AS s) LEFT JOIN quality q ON q.score10 = s GROUP BY s",
    "quality_counts": _Q + " SELECT score10 AS site_score, count(*) AS n, CASE WHEN score10 <= 3 THEN 'green' WHEN score10 <= 6 THEN 'yellow' WHEN score10 >= 8 THEN 'grey' END AS colour FROM quality GROUP BY score10",
    "marker_report": _Q + " SELECT marker, count(*) AS n FROM (SELECT unnest(dated) AS marker FROM quality WHERE NOT stub) GROUP BY marker",
    "marker_coverage": _Q + " SELECT count(*) AS sites, count(*) FILTER (markers <> '') AS with_marker, CAST(floor(count(*) FILTER (markers <> '') * 100 / count(*) + 0.5) AS BIGINT) AS share FROM quality",
    "page_metadata": "WITH " + checks.PAGE_FACTS + " SELECT page_id, title, trim(regexp_replace(h1, '\\s+', ' ', 'g')) AS h1, meta_description, has_viewport, og_tags, favicon, charset_declared, https, mixed_content FROM facts",
    "technology": "WITH " + checks.PAGE_FACTS + " SELECT page_id, cms, builder, modern_framework, jquery_version, bootstrap_major, has_flash, table_layout, footer_year FROM facts",
    "page_structure": _PATHS + " SELECT page_id, page_count, unique_page_types, has_catalog, has_ecommerce, has_forms FROM structure",
    "page_text": f"SELECT page_id, length(t) AS chars, md5(t) AS text_md5, length(t) < 250 AND length(html) > 500 AS empty_shell FROM (SELECT page_id, html, {_ENDED} AS t FROM pages)",
    "page_fingerprint": f"SELECT page_id, sha1({checks.normalized()}) AS fp FROM pages",
    "declared_languages": f"WITH {DECLARED} SELECT page_id, html_lang, languages, {_JOINED}, array_to_string(list_transform(ev, lambda e: e.d), ';') AS details FROM versions",
    "site_signal": f"WITH {checks.PAGE_BASE}, {SIGNALS} SELECT page_id, CASE WHEN len(ev) = 0 THEN 0 ELSE least(100, list_sum(list_transform(ev, lambda e: e.w))) END AS score, lang, hard_exclusion, {_JOINED} FROM observed",
    "host_counts": "WITH " + checks.PAGE_BASE + " SELECT CASE WHEN length(host) > 24 THEN left(host, 23) || '…' ELSE host END AS label, host AS full_label, count(*) AS n FROM pg GROUP BY host ORDER BY n DESC, host LIMIT 8",
    "https_share": "SELECT count(*) AS fired, count(*) FILTER (starts_with(lower(url), 'https:')) AS proved, count(*) FILTER (NOT starts_with(lower(url), 'https:')) AS unproved, CAST(floor(count(*) FILTER (NOT starts_with(lower(url), 'https:')) * 100 / count(*) + 0.5) AS BIGINT) AS false_share FROM pages WHERE regexp_matches(url, '(?i)^https?://[^/?#\\s]+')",
    "page_type_counts": "SELECT split_part(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.\\-]*://[^/?#]+([^?#]*)', 1), '/', 2) AS segment, count(*) AS n FROM pages GROUP BY 1",
    "email_extract": "WITH " + checks.email_ctes("documents", "doc_id", "text") + " SELECT doc_id, emails, total FROM best",
    "page_emails": "WITH " + checks.email_ctes(checks.RICH_PAGES, "page_id", "html") + " SELECT page_id, emails, total FROM best",
    "phone_flags": "SELECT lang, count(*) AS docs, count(*) FILTER (regexp_matches(text, '\\+\\s?380[\\s\\-(]?\\d{2}')) AS ua, count(*) FILTER (regexp_matches(text, '\\+\\s?7[\\s\\-(]?9\\d{2}[\\s\\-)]?\\d{3}[\\s\\-)]?\\d{3}')) AS ru, count(*) FILTER (regexp_matches(text, '\\+\\s?\\d{1,3}[\\s\\-(]?\\d{2}')) AS any_plus FROM documents GROUP BY lang",
    "social_links": """WITH b AS (SELECT html FROM pages UNION ALL SELECT text FROM documents UNION ALL SELECT '<a href="https://facebook.com/tr?id=1"><a href="https://www.' || CASE WHEN s_nationkey > 12 THEN 'facebook.com/s' ELSE 'instagram.com/i' END || s_suppkey || '">' FROM supplier),
        p(network, pattern) AS (VALUES ('facebook', '(?i)https?://(?:www\\.|m\\.)?facebook\\.com/[A-Za-z0-9._%-]+'), ('instagram', '(?i)https?://(?:www\\.)?instagram\\.com/[A-Za-z0-9._%-]+'),
          ('telegram', '(?i)https?://t\\.me/[A-Za-z0-9_]+'), ('youtube', '(?i)https?://(?:www\\.)?youtube\\.com/(?:c/|channel/|@)[A-Za-z0-9._%-]+'),
          ('tiktok', '(?i)https?://(?:www\\.)?tiktok\\.com/@[A-Za-z0-9._%-]+'), ('linkedin', '(?i)https?://(?:www\\.)?linkedin\\.com/(?:company|in)/[A-Za-z0-9._%-]+'),
          ('yelp', '(?i)https?://(?:www\\.)?yelp\\.com/biz/[A-Za-z0-9._%-]+')),
        u AS (SELECT network, list_filter(regexp_extract_all(html, pattern), lambda x: NOT regexp_matches(x, '(?i)/(tr|sharer|share|dialog|plugins|widgets|intent|login|oauth|v\\d+\\.\\d+|tr\\.js|embed|badge|profile\\.php)\\b')) AS us FROM b CROSS JOIN p)
        SELECT network, count(*) AS pages, min(us[1]) AS first_profile FROM u WHERE len(us) > 0 GROUP BY network""",
    "glyph_ratio": "WITH g AS (SELECT doc_id, len(regexp_extract_all(text, '[éèêçàùâîôûëïœ]')) AS fr, len(regexp_extract_all(text, '[äöüß]')) AS de, len(regexp_extract_all(text, '[À-ɏ]')) AS script, length(text) AS chars FROM documents) SELECT *, CAST(floor(script * 1000 / greatest(chars, 1)) AS BIGINT) AS per_mille FROM g",
    "effort_hours": _PATHS + """, """ + DECLARED + """, h AS (SELECT s.page_id, 10 + 3 * least(unique_page_types, 8) + CASE WHEN has_catalog THEN 6 ELSE 0 END + CASE WHEN has_ecommerce THEN 8 ELSE 0 END
          + CASE WHEN s.languages > 1 OR html_lang IN ('fr', 'de') OR switches > 0 THEN 4 ELSE 0 END + CASE WHEN has_forms THEN 3 ELSE 0 END + 4
          + CAST(floor(ceil(least(page_count, 60) / 5) * 1.5 + 0.5) AS INTEGER) AS total FROM structure s JOIN declared d ON d.page_id = s.page_id),
        r AS (SELECT page_id, CAST(floor(CAST(total AS DOUBLE) * CAST(0.85 AS DOUBLE) + 0.5) AS INTEGER) AS hours_min, CAST(floor(CAST(total AS DOUBLE) * CAST(1.25 AS DOUBLE) + 0.5) AS INTEGER) AS hours_max FROM h),
        m AS (SELECT *, (hours_min + hours_max) / 2 AS mid FROM r),
        st AS (SELECT *, CASE WHEN mid <= 28 THEN 1 WHEN mid <= 45 THEN 2 WHEN mid <= 62 THEN 3 WHEN mid <= 75 THEN 4 ELSE 5 END AS stars FROM m)
        SELECT page_id, hours_min, hours_max, stars, repeat('★', stars) || repeat('☆', 5 - stars) AS stars_text,
          CASE stars WHEN 1 THEN 'односторінковий лендінг' WHEN 2 THEN 'простий сайт-візитівка' WHEN 3 THEN 'кілька типів сторінок' WHEN 4 THEN 'великий сайт з каталогом' ELSE 'складний проєкт' END AS label FROM st""",
    "shop_recheck": "WITH r AS (SELECT regexp_matches(html, '(?i)/and\\b|/(menu|shop|store|catalog|catalogue|products?|services?|prices?|pricing|portfolio|gallery)\\b') AS now FROM pages WHERE regexp_matches(html, '(?i)/(the|and)')) SELECT count(*) AS was, count(*) FILTER (now) AS stays, count(*) FILTER (NOT now) AS drops FROM r",
    "accent_classes": "SELECT source, CAST(sum(len(regexp_extract_all(text, '[éèê]'))) AS BIGINT) AS e_accents, CAST(sum(len(regexp_extract_all(text, '[äöü]'))) AS BIGINT) AS umlauts, CAST(sum(length(text)) AS BIGINT) AS chars FROM documents GROUP BY source",
}
