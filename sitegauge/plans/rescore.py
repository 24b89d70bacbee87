"""The main job: stored pages to facts, facts to scores, scores to verdicts.

The page body is read once, turned into a narrow row of facts inside the scan
stage, and dropped.  Only that row takes part in the joins by ``place_id``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitegauge.functions import contacts, languages, markup, structure, technology
from sitegauge.functions.evidence import or_empty
from sitegauge.functions.text import html_to_text
from sitegauge.functions.urls import host_of
from sitegauge.operators import probes
from sitegauge.operators.effort import effort
from sitegauge.operators.mentions import with_mentions
from sitegauge.operators.quality import site_quality
from sitegauge.operators.verdict import apply_verdict, owner_score, with_pins
from sitegauge.params import DEFAULT, Preset
from sitegauge.session import bounded, reliable, spread

# Facts a re-score reads anew from the page; the others are kept from the first audit.
FROM_HTML = (
    "has_viewport", "title", "meta_description", "h1", "og_tags", "favicon", "jquery_version",
    "bootstrap_major", "has_flash", "table_layout", "modern_framework", "cms", "builder", "tech_stack",
    "footer_year", "emails", "socials",
)
FROM_FETCH = (
    "final_url", "http_status", "fetch_error", "redirected", "tls_expired", "html_bytes", "rendered", "https",
    "mixed_content", "charset_declared", "page_count", "unique_page_types", "has_catalog", "has_ecommerce",
    "has_forms", "languages",
)
AUDIT_FIELDS = FROM_FETCH + FROM_HTML

def page_texts(responses: DataFrame) -> DataFrame:
    """Lower-cased page, visible text and host: computed once, used by all features."""
    html = F.coalesce(F.col("html"), F.lit(""))
    return responses.select(
        *[c for c in responses.columns if c != "html"],
        html.alias("html"), F.lower(html).alias("low"), html_to_text(html).alias("text"),
        host_of(F.col("final_url")).alias("host"),
    )


def page_columns(responses: DataFrame, preset: Preset = DEFAULT, keep: tuple[str, ...] = ()) -> DataFrame:
    """Every fact of a stored home page as a column of its own.

    No shuffle: scan and projections; what a query does not select is not computed.
    A column ``sitemap_pages`` (array of addresses),
    if present, is used in place of the page's own links.
    """
    profile = preset.language
    html, low, text, url = F.col("html"), F.col("low"), F.col("text"), F.col("final_url")
    base = page_texts(responses)
    found_pages = structure.page_links(html, url)
    if "sitemap_pages" in responses.columns:
        found_pages = F.when(F.size("sitemap_pages") > 0, F.col("sitemap_pages")).otherwise(found_pages)
    counts = languages.glyph_counts(text, profile)
    tech = base.select(
        "*",
        technology.first_rule(low, technology.CMS).alias("cms"),
        technology.first_rule(low, technology.BUILDERS).alias("builder"),
        technology.first_rule(low, technology.MODERN).alias("modern_framework"),
        technology.jquery_version(low).alias("jquery_version"),
        technology.bootstrap_major(low).alias("bootstrap_major"),
        technology.has_flash(low).alias("has_flash"),
        technology.table_layout(low).alias("table_layout"),
        structure.paths(found_pages).alias("paths"),
        counts.alias("glyphs"),
        languages.declared(html, low, profile).alias("declared"),
        contacts.emails_found(html, low).alias("found_emails"),
    )
    signal = languages.declared_signal(F.col("declared"), profile)
    facts = tech.select(
        "*",
        signal.alias("versions"),
        structure.structure(html, low, F.col("paths")).alias("structure"),
        languages.site_exclusion(text, F.col("host"), F.col("glyphs"), profile).alias("exclusion"),
    )
    s, v = F.col("structure"), F.col("versions")
    have = set(responses.columns)

    def given(name: str, default: Column) -> Column:
        return F.col(name) if name in have else default

    null = F.lit(None)
    audit = {
        "final_url": url,
        "http_status": given("http_status", F.lit(200)).cast("int"),
        "fetch_error": given("fetch_error", null).cast("string"),
        "redirected": given("redirected", F.lit(False)).cast("boolean"),
        "tls_expired": given("tls_expired", F.lit(False)).cast("boolean"),
        "html_bytes": given("html_bytes", F.octet_length(html)).cast("bigint"),
        "rendered": given("rendered", F.lit(False)).cast("boolean"),
        "https": markup.is_https(url),
        "mixed_content": markup.mixed_content(url, html),
        "charset_declared": markup.declares_charset(html),
        "page_count": s["page_count"], "unique_page_types": s["unique_page_types"],
        "has_catalog": s["has_catalog"], "has_ecommerce": s["has_ecommerce"], "has_forms": s["has_forms"],
        "languages": F.greatest(
            s["languages"], F.when(F.size(v["found"]) > 0, F.size(v["found"]) + 1).otherwise(1)
        ),
        "has_viewport": markup.has_viewport(html), "title": markup.title(html),
        "meta_description": markup.meta_description(html), "h1": markup.first_heading(html),
        "og_tags": markup.has_open_graph(html), "favicon": markup.has_favicon(html),
        "jquery_version": F.col("jquery_version"), "bootstrap_major": F.col("bootstrap_major"),
        "has_flash": F.col("has_flash"), "table_layout": F.col("table_layout"),
        "modern_framework": F.col("modern_framework"), "cms": F.col("cms"), "builder": F.col("builder"),
        "tech_stack": technology.stack_names(
            low, F.col("cms"), F.col("builder"), F.col("modern_framework"), F.col("jquery_version"),
            F.col("bootstrap_major"), F.col("table_layout"),
        ),
        "footer_year": technology.footer_year(low, preset.year),
        "emails": contacts.best_emails(F.col("found_emails")),
        "socials": contacts.social_profiles(html, low),
    }
    observed = languages.observed_signal(html, low, text, F.col("host"), F.col("glyphs"), F.col("exclusion"), profile)
    return facts.select(
        "place_id", *keep, "versions", *[c.alias(n) for n, c in audit.items()], observed.alias("observed")
    )


def page_facts(responses: DataFrame, preset: Preset = DEFAULT, keep: tuple[str, ...] = ()) -> DataFrame:
    """(place_id, audit, site_signal, declared_evidence) per stored home page."""
    v = F.col("versions")
    return page_columns(responses, preset, keep).select(
        "place_id", *keep, F.struct(*[F.col(n) for n in AUDIT_FIELDS]).alias("audit"),
        languages.with_score(F.col("observed")).alias("site_signal"),
        v["evidence"].alias("declared_evidence"), v["languages"].alias("declared_languages"),
        F.size(v["found"]).alias("declared_found"), v["html_lang"].alias("html_lang"),
    )


def stored_facts(responses: DataFrame, preset: Preset = DEFAULT) -> DataFrame:
    """:func:`page_facts` written to the checkpoint folder.

    Facts are a table of their own: what follows filters on scores and verdicts, and
    without this boundary the optimizer moves such a filter, with all the patterns it
    stands for, down to the scan.  The rows are a small part of the pages' size.
    """
    return reliable(page_facts(spread(responses), preset))


def without_places(responses: DataFrame, gone: DataFrame) -> DataFrame:
    """Stored answers but for those of the places of ``gone`` (place_id); answers without a place stay.

    Only keys are shuffled: those that stay are listed first, and the bodies are looked up in that list where they are.
    """
    staying = responses.select("place_id").join(gone.select("place_id"), "place_id", "left_anti").distinct()
    staying = bounded(reliable(staying.select(F.col("place_id").alias("_staying"))))
    return responses.join(staying, F.col("place_id").eqNullSafe(F.col("_staying")), "left_semi")


def with_probe_evidence(facts: DataFrame, responses: DataFrame, preset: Preset = DEFAULT) -> DataFrame:
    """Add the evidence of stored probe answers, cheapest source first.

    A negotiated answer counts only where the page declares no target language, and
    routes only where there is neither. The bodies are read once, for narrow facts; only
    those are joined.
    """
    answers = probes.stored_answers(responses, preset)
    open_sites = facts.where(F.col("declared_found") == 0).select("place_id")
    asked = answers.join(open_sites, "place_id", "left_semi")
    spoken = probes.negotiated(asked, preset).select("place_id", F.col("evidence").alias("_negotiated"))
    still_open = asked.join(spoken, "place_id", "left_anti")
    routed = probes.route_evidence(probes.confirmed_routes(still_open, preset)).select(
        "place_id", F.col("evidence").alias("_routes")
    )
    return (
        facts.join(spoken, "place_id", "left").join(routed, "place_id", "left")
        .withColumn(
            "declared_evidence",
            F.concat("declared_evidence", or_empty(F.col("_negotiated")), or_empty(F.col("_routes"))),
        )
        .drop("_negotiated", "_routes")
    )


def refreshed(old: Column, new: Column) -> Column:
    """Old audit with the facts of the page read anew; without a page the old one stands."""
    merged = F.struct(
        *[old[f].alias(f) for f in FROM_FETCH], *[new[f].alias(f) for f in FROM_HTML]
    )
    return F.when(old.isNull(), new).when(new.isNull(), old).otherwise(merged)


def assemble(state: DataFrame, facts: DataFrame | None, reviews: DataFrame, psi: DataFrame, pins: DataFrame,
             old_audits: DataFrame | None = None) -> DataFrame:
    """Everything the verdict reads, one row per place.  All joins are on ``place_id``,
    so the places are partitioned once.  ``facts`` of stored pages, ``old_audits``
    ``(place_id, audit, site_signal, version_evidence)``, or both."""
    if facts is None:
        rows = state.join(old_audits.select("place_id", "audit", "site_signal", "version_evidence"), "place_id", "left")
        return _with_sources(rows, reviews, psi, pins)
    rows = state.join(
        facts.select("place_id", F.col("audit").alias("_new"), F.col("site_signal").alias("_signal"),
                     F.col("declared_evidence").alias("_declared")),
        "place_id", "left",
    )
    if old_audits is None:
        rows = rows.withColumn("audit", F.col("_new")).withColumn("site_signal", F.col("_signal")).withColumn(
            "version_evidence", F.col("_declared")
        )
    else:
        rows = rows.join(
            old_audits.select("place_id", F.col("audit").alias("_old"), F.col("site_signal").alias("_old_signal"),
                              F.col("version_evidence").alias("_old_versions")),
            "place_id", "left",
        )
        rows = (
            rows.withColumn("audit", refreshed(F.col("_old"), F.col("_new")))
            .withColumn("site_signal", F.coalesce("_signal", "_old_signal"))
            .withColumn("version_evidence", F.coalesce("_old_versions", "_declared"))
            .drop("_old", "_old_signal", "_old_versions")
        )
    return _with_sources(rows.drop("_new", "_signal", "_declared"), reviews, psi, pins)


def _with_sources(rows: DataFrame, reviews: DataFrame, psi: DataFrame, pins: DataFrame) -> DataFrame:
    rows = rows.join(
        reviews.select("place_id", F.struct("preferred_lang", "evidence").alias("reviews")), "place_id", "left"
    )
    rows = rows.join(
        psi.select("place_id", F.struct("mobile_score", "desktop_score", "lcp_ms", "cls").alias("psi")),
        "place_id", "left",
    )
    return with_pins(rows, pins)


def score(rows: DataFrame, preset: Preset = DEFAULT) -> DataFrame:
    """Quality, effort and owner score of assembled rows (which carry ``name_signal``)."""
    a = F.col("audit")
    rated = site_quality(rows, preset.year, "audit", "psi", F.col("website"))
    owned = owner_score(rated, "site_signal", "reviews", "name_signal", "version_evidence", preset)
    return (
        owned.withColumn("effort", effort(a))
        .withColumn("has_audit", a.isNotNull())
        .withColumn("fetch_error", a["fetch_error"])
        .withColumn("modern_framework", a["modern_framework"])
        .withColumn("site_status", F.col("quality")["status"])
        .withColumn("site_score", F.col("quality")["score10"])
        .withColumn("dated_markers", F.col("quality")["dated_markers"])
        .withColumn("psi_done", F.col("psi").isNotNull())
        .withColumn("has_reviews", F.col("reviews").isNotNull())
    )


def rescore(state: DataFrame, responses: DataFrame, reviews: DataFrame, psi: DataFrame, pins: DataFrame,
            preset: Preset = DEFAULT, old_audits: DataFrame | None = None,
            mentions: DataFrame | None = None, use_probes: bool = False, facts_at: str | None = None) -> DataFrame:
    """Next verdict of every place from its stored page; places without one are judged by name.

    ``state`` carries the column ``name_signal`` (see :mod:`sitegauge.operators.rules`).
    ``mentions`` is ``(place_id, mention_score, mentions)`` of
    :func:`sitegauge.operators.mentions.mention_score`.  ``use_probes`` also reads the
    stored answers with the roles junk, candidate and negotiated. ``facts_at`` is the folder of
    a facts store (see :mod:`sitegauge.plans.facts`): pages in it are not parsed again.
    """
    home = responses.where(F.col("role") == "home").drop("role") if "role" in responses.columns else responses
    if facts_at is None:
        facts = stored_facts(home, preset)
    else:
        from sitegauge.plans.facts import facts_by_content

        facts = facts_by_content(home, facts_at, preset)
    if use_probes:
        facts = with_probe_evidence(facts, responses, preset)
    if mentions is not None:
        facts = facts.join(mentions, "place_id", "left").withColumn(
            "site_signal", with_mentions(F.col("site_signal"), F.col("mention_score"), F.col("mentions"))
        )
    rows = assemble(state, facts, reviews, psi, pins, old_audits)
    return apply_verdict(score(rows, preset), preset)


def audits_of(facts: DataFrame) -> DataFrame:
    """Facts of pages in the shape of stored audits."""
    return facts.select("place_id", "audit", "site_signal", F.col("declared_evidence").alias("version_evidence"))


def reverdict(state: DataFrame, changed: DataFrame, audits: DataFrame, reviews: DataFrame, psi: DataFrame, pins: DataFrame,
              preset: Preset = DEFAULT) -> DataFrame:
    """Next verdict of the places of ``changed`` only, after new speed or review data, from stored audits.

    No page is read: ``audits`` is the table (place_id, audit, site_signal, version_evidence) of the last
    :func:`rescore`, see :func:`audits_of`.
    """
    places = changed.select("place_id").distinct()
    rows = assemble(state.join(places, "place_id", "left_semi"), None, reviews, psi, pins, audits)
    return apply_verdict(score(rows, preset), preset)
