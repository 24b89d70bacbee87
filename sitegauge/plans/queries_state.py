"""Registered queries over the scored state: filters, joins, reports, publication."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sitegauge.functions.address import city_of, location_label, state_of
from sitegauge.functions.text import plural
from sitegauge.functions.urls import host_of, maps_url, report_cell
from sitegauge.operators import display, filters, merge, notes, publish, quality, reports, tasks, verdict
from sitegauge.params import US_REGION_CODES
from sitegauge.operators.reviews import review_queue as queue_of
from sitegauge.plans.inputs import prelude, table, with_types
from sitegauge.plans.profiles import MARKERS, NICHES, STANDALONE, TRIAL
from sitegauge.session import reliable


def places(spark: SparkSession, sf: str) -> DataFrame:
    return with_types(table(spark, sf, "places"))


def state(spark: SparkSession, sf: str) -> DataFrame:
    return with_types(table(spark, sf, "state"))


# --- filters ---------------------------------------------------------------------
def cheap_filter(spark, sf):
    out = filters.apply_cheap_filter(places(spark, sf), TRIAL)
    return out.select("place_id", "bucket", "reject_reason", "rule_no")


def refilter(spark, sf):
    out = filters.refilter(state(spark, sf), TRIAL)
    return out.select("place_id", "old_bucket", "bucket", "reject_reason")


def audit_candidates(spark, sf):
    return filters.audit_candidates(state(spark, sf)).select("place_id", "bucket")


def enrich_candidates(spark, sf):
    return filters.enrich_candidates(state(spark, sf), table(spark, sf, "psi"), True).select("place_id", "bucket")


def panel_filter(spark, sf):
    rows = state(spark, sf).withColumn("location", F.col("metro_key"))
    return filters.panel_filter(rows, search="machinery", status="").select("place_id", "name", "location")


def suspicious_names(spark, sf):
    parts = table(spark, sf, "part")
    words = parts.withColumn("name", F.concat("p_name", F.lit(" "), F.when(F.col("p_size") > 40, "Society").otherwise("store")))
    return words.where(filters.suspicious_name(F.col("name"))).select("p_partkey", "name")


def challenge_titles(spark, sf):
    title = F.regexp_extract("html", r"(?i)<title[^>]*>([\s\S]*?)</title>", 1)
    return table(spark, sf, "pages").groupBy(filters.is_challenge_title(title).alias("challenge")).agg(F.count("*").alias("n"))


def platform_profiles(spark, sf):
    host = F.concat(host_of(F.col("website")), F.when(F.col("c_custkey") % 4 == 0, ".ebay.com").otherwise(""))
    rows = places(spark, sf).where(F.col("website").isNotNull())
    return rows.groupBy(filters.on_third_party_platform(host).alias("platform")).agg(F.count("*").alias("n"))


def retry_queue(spark, sf):
    return filters.retry_candidates(state(spark, sf), 30).select("place_id", "fetch_error", "user_rating_count")


def slow_sites(spark, sf):
    rows = state(spark, sf).join(table(spark, sf, "psi"), "place_id")
    return filters.slow_sites(rows).select("place_id", "lcp_ms", "mobile_score", "site_score")


# --- joins -----------------------------------------------------------------------
def export_assembly(spark, sf):
    """Place with audit, owner score, review signal, speed and screenshots."""
    base = places(spark, sf).select("place_id", "name")
    s = state(spark, sf)
    audits = s.where(F.col("site_score").isNotNull()).select("place_id", "site_score")
    owners = s.where(F.col("owner_score") >= 15).select("place_id", "owner_score")
    reviews = table(spark, sf, "reviews").groupBy("place_id").agg(F.count("*").alias("sample_size"))
    psi = table(spark, sf, "psi").select("place_id", "mobile_score")
    shots = table(spark, sf, "placement").select("place_id", F.concat("place_id", F.lit(".png")).alias("mobile_path"))
    out = base
    for t in (audits, owners, reviews, psi, shots):
        out = out.join(t, "place_id", "left")
    return out


def review_queue(spark, sf):
    return queue_of(state(spark, sf), 100).select("place_id", "owner_score", "user_rating_count", "site_score")


def unreviewed_potential(spark, sf):
    reviewed = table(spark, sf, "reviews").where(F.col("language_code") == "UK").select("place_id").distinct()
    return reports.unreviewed_potential(state(spark, sf), reviewed).select("place_id", "owner_score")


def lead_listing(spark, sf):
    s = state(spark, sf)
    return reports.lead_listing(
        s.select("place_id", "name", "user_rating_count", "bucket"), s.select("place_id", "owner_score"),
        s.where(F.col("site_score").isNotNull()).select("place_id", "site_score"),
    ).select("place_id", "name", "owner_score", "user_rating_count", "site_score")


def lead_site_scores(spark, sf):
    """Inner join of places and audits, counted per score (reports join family)."""
    s = state(spark, sf)
    joined = s.where(F.col("bucket") == "leads").select("place_id").join(
        s.where(F.col("site_score").isNotNull()).select("place_id", "site_score"), "place_id"
    )
    return reports.site_score_histogram(joined)


def _metros(spark, sf):
    return table(spark, sf, "nation").select(
        F.lower("n_name").alias("metro_key"), F.col("n_name").alias("label"), F.col("n_nationkey").cast("double").alias("lat"),
        F.col("n_regionkey").cast("double").alias("lng"), F.lit(45000).alias("radius_m"),
    )


def _hoods(spark, sf):
    return table(spark, sf, "supplier").join(table(spark, sf, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).select(
        F.lower("n_name").alias("metro_key"), F.col("s_name").alias("hood_name"), F.col("n_nationkey").cast("double").alias("lat"),
        F.col("n_regionkey").cast("double").alias("lng"), F.lit(2500).alias("radius_m"),
    )


def _tasks(spark, sf):
    return tasks.expand_tasks(_metros(spark, sf), _hoods(spark, sf), NICHES, MARKERS, STANDALONE, TRIAL)


def _runs(spark, sf):
    """Tasks that were run: the ones whose id starts with a low digit."""
    return _tasks(spark, sf).where(F.col("task_id") < "8").select("task_id")


def task_expansion(spark, sf):
    return _tasks(spark, sf).select(
        "task_id", "metro_key", "mode", "text_query", "included_type", "niche_key", "hood_name",
        F.col("bias")["radius_m"].alias("radius_m"),
    )


def pending_tasks(spark, sf):
    return tasks.pending_tasks(_tasks(spark, sf), _runs(spark, sf)).groupBy("mode").agg(F.count("*").alias("n"))


def budget_preflight(spark, sf):
    return tasks.preflight(_tasks(spark, sf), _runs(spark, sf), 200, TRIAL)


def niche_dimension(spark, sf):
    keys = F.element_at(F.array(*[F.lit(n.key) for n in NICHES]), (F.col("c_custkey") % 4 + 1).cast("int"))
    rows = places(spark, sf).select(keys.alias("niche_key"))
    return tasks.niche_labels(rows, NICHES).groupBy("niche_key", "niche_tier", "niche_label").agg(F.count("*").alias("n"))


PICKS = [("Customer#0000001", "known from the trade fair"), ("customer#00000002", "called last year")]


def name_picks(spark, sf):
    s = state(spark, sf).withColumn("has_audit", F.col("site_score").isNotNull())
    return verdict.pick_by_prefix(s, PICKS).select("place_id", "why", "passes", "state")


def _target(spark, sf):
    return publish.assign_tabs(state(spark, sf)).select("place_id", "tab")


def moved_rows(spark, sf):
    return publish.moved_rows(table(spark, sf, "placement"), _target(spark, sf)).select("place_id", "tab", "now_tab")


def stale_rows(spark, sf):
    present = table(spark, sf, "placement").join(places(spark, sf).select("place_id", "name"), "place_id")
    return publish.stale_rows(present, _target(spark, sf)).select("place_id", "tab")


def orphan_notes(spark, sf):
    written = notes.collect_notes(table(spark, sf, "notes"))
    return notes.keep_worked(state(spark, sf), written, table(spark, sf, "placement"), _target(spark, sf)).select("place_id", "tab")


def publication(spark, sf):
    """Rows and kept rows per tab of the coming publication."""
    written = notes.collect_notes(table(spark, sf, "notes"))
    out = publish.publication(state(spark, sf), written, table(spark, sf, "placement"))
    return out.groupBy("tab").agg(F.count("*").alias("rows"), F.count_if("kept_for_notes").alias("kept"))


def publish_order(spark, sf):
    return publish.publish_order(state(spark, sf), with_rejected=True).select("tab", "position", "place_id")


def placement(spark, sf):
    rows = publish.assign_tabs(state(spark, sf)).select("place_id", "tab", "owner_score", "site_score", "user_rating_count")
    placed = publish.place_rows(rows, table(spark, sf, "placement"), publish.publish_keys())
    return placed.select("place_id", "tab", "row_index", "inserted")


def notes_collected(spark, sf):
    return notes.collect_notes(table(spark, sf, "notes"))


def notes_follow(spark, sf):
    """Notes on the rows of the tab each place is in now."""
    written = notes.collect_notes(table(spark, sf, "notes"))
    out = notes.attach_notes(_target(spark, sf), written)
    return out.groupBy("tab").agg(
        F.count("*").alias("rows"), F.count_if(F.col("status") != "").alias("with_status"),
        F.count_if(F.col("owner") != "").alias("with_owner"), F.count_if(F.col("note") != "").alias("with_note"),
    )


def _shifted(spark, sf):
    return state(spark, sf).select(
        "place_id", F.when(F.col("c_custkey") % 5 == 0, F.col("metro_key")).otherwise(F.col("status")).alias("status"),
        F.when(F.col("c_custkey") % 2 == 0, (F.col("c_custkey") + 40000).cast("string")).otherwise("seller").alias("owner"),
    )


def repair_shifted(spark, sf):
    return notes.repair_shifted(_shifted(spark, sf)).select("place_id", "status", "owner", "shifted")


def clear_preview(spark, sf):
    return notes.clear_preview(table(spark, sf, "notes"))


def tab_list(spark, sf):
    rows = table(spark, sf, "placement").select(F.when(F.col("row_index") % 5 == 4, "Meta").otherwise(F.col("tab")).alias("tab"))
    return publish.tab_list(rows)


def payload_union(spark, sf):
    """Old layout without a score and new layout with one, under the new tab names."""
    s = state(spark, sf)
    old = s.where(F.col("bucket") == "upsell").select("place_id", "name")
    new = s.where(F.col("bucket") == "leads").select("place_id", "name", "owner_score")
    return publish.unify_payloads({"Свої з сайтом": old, "Leads": new}).select("place_id", "name", "owner_score", "tab")


def layout_migration(spark, sf):
    rows = state(spark, sf).select("place_id", "name", "status")
    return publish.migrate_columns(rows, ["place_id", "name", "brief", "status"])


def run_metadata(spark, sf):
    usage = tasks.usage_by_month(table(spark, sf, "usage_log"))
    return publish.run_metadata(state(spark, sf), usage, {"Пресет": "trial", "Поріг мовного скору (Leads)": "55"})


# --- reports ---------------------------------------------------------------------
def bucket_counts(spark, sf):
    return reports.bucket_counts(state(spark, sf))


def owner_bands(spark, sf):
    return reports.owner_bands(state(spark, sf))


def reject_reasons(spark, sf):
    return reports.reject_reasons(state(spark, sf))


def region_counts(spark, sf):
    return reports.by_region(state(spark, sf), ("IL", "CA", "NY"))


def region_share(spark, sf):
    return reports.region_share(state(spark, sf), ("IL", "CA", "NY"))


def threshold_whatif(spark, sf):
    return reports.threshold_what_if(state(spark, sf))


def newly_admitted(spark, sf):
    return reports.newly_admitted(state(spark, sf)).select("place_id", "owner_score", "user_rating_count")


def need_bands(spark, sf):
    return reports.need_bands(state(spark, sf), TRIAL)


def queue_profile(spark, sf):
    reviewed = table(spark, sf, "reviews").select("place_id").distinct().withColumn("_r", F.lit(True))
    speeds = table(spark, sf, "psi").select("place_id", F.lit(True).alias("_p"))
    cached = table(spark, sf, "pages").select(F.concat(F.lit("p"), F.col("page_id").cast("string")).alias("place_id"), F.lit(True).alias("_c"))
    rows = state(spark, sf)
    for t in (reviewed, speeds, cached):
        rows = rows.join(t, "place_id", "left")
    rows = (
        rows.withColumn("has_audit", F.col("site_score").isNotNull()).withColumn("has_reviews", F.col("_r").isNotNull())
        .withColumn("psi_done", F.col("_p").isNotNull()).withColumn("has_cache", F.col("_c").isNotNull())
    )
    return reports.queue_profile(rows)


def panel_figures(spark, sf):
    return reports.panel_figures(state(spark, sf).where(F.col("site_score").isNotNull()))


def top_metros(spark, sf):
    label = F.concat(F.col("metro_key"), F.lit(" metropolitan area of "), F.col("hood_name"))
    return reports.top_labels(state(spark, sf), label)


def state_score_histogram(spark, sf):
    return reports.score_histogram(state(spark, sf))


def status_funnel(spark, sf):
    return reports.status_funnel(state(spark, sf))


def phone_patterns(spark, sf):
    return reports.phone_pattern_hits(places(spark, sf), F.col("phone"))


def transitions(spark, sf):
    return merge.transitions(filters.refilter(state(spark, sf), TRIAL))


def no_site_potential(spark, sf):
    score = F.when(F.col("name").rlike("(?i)machinery"), 28).when(F.col("name").rlike("(?i)building"), 12).otherwise(0)
    return reports.no_site_potential(state(spark, sf), score, "asia|europe|africa")


def _with_markers(spark, sf):
    marker = F.when(F.col("c_custkey") % 3 == 0, F.array(F.lit("old"))).otherwise(F.array().cast("array<string>"))
    return state(spark, sf).withColumn("dated_markers", marker)


def kept_by_marker(spark, sf):
    return reports.kept_by_marker(_with_markers(spark, sf), TRIAL)


def at_risk(spark, sf):
    return reports.at_risk(state(spark, sf), TRIAL)


def type_frequency(spark, sf):
    return reports.count_by(state(spark, sf), "primary_type", 25, F.col("bucket").isin("leads", "pending"))


def lead_types(spark, sf):
    """Best leads with all their types."""
    rows = state(spark, sf).where(F.col("bucket") == "leads")
    return rows.orderBy(F.col("owner_score").desc(), "place_id").limit(25).select(
        "place_id", "primary_type", F.array_join("types", ", ").alias("types")
    )


def address_coverage(spark, sf):
    return reports.address_coverage(places(spark, sf))


def address_parts(spark, sf):
    city, region = city_of(F.col("address")), state_of(F.col("address"))
    return places(spark, sf).select(
        "place_id", city.alias("city"), region.alias("region"),
        location_label(city, region, F.col("hood_name"), F.col("metro_key")).alias("location"),
    )


def signal_overlap(spark, sf):
    s = state(spark, sf)
    return reports.signal_overlap(
        s, F.coalesce(F.col("user_rating_count"), F.lit(0)) > 0, F.col("owner_score") % 2 == 0, F.col("owner_score") % 3 == 0
    )


def manual_candidates(spark, sf):
    return reports.manual_candidates(state(spark, sf)).select("place_id", "owner_score", "user_rating_count")


def rejected_despite_score(spark, sf):
    rows = state(spark, sf).withColumn("owner_score", 100 - F.col("owner_score"))
    return reports.rejected_despite_score(rows).select("place_id", "owner_score", "user_rating_count", "reject_reason")


def destinations(spark, sf):
    return reports.destinations(state(spark, sf), 50)


def panel_sorted(spark, sf):
    rows = reliable(state(spark, sf).select("place_id", "site_score", "user_rating_count", "owner_score", "name"))
    out = None
    for key in ("site_score", "reviews", "owner_score", "difficulty", "name"):
        part = reports.sorted_rows(rows.withColumn("stars", F.col("site_score") % 6), key, 20).select(F.lit(key).alias("sort_key"), "place_id")
        out = part if out is None else out.unionByName(part)
    return out


# --- state changes ---------------------------------------------------------------
def stage_of_place(spark, sf):
    s = state(spark, sf)
    audits = s.where(F.col("site_score").isNotNull())
    reviewed = table(spark, sf, "reviews").where(F.col("language_code") == "UK")
    out = merge.derive_stage(places(spark, sf), audits, reviewed, table(spark, sf, "psi"), table(spark, sf, "placement"))
    return out.groupBy("stage").agg(F.count("*").alias("n"))


DECISIONS = [
    merge.Decision("Customer#000000007", "rejected", "modern site"),
    merge.Decision("Customer#00000001", "leads", "fits more than one"),
    merge.Decision("by key", "no_site", "profile on a platform", place_id="p11"),
    merge.Decision("nobody of this name", "leads", "gone"),
]


def decisions(spark, sf):
    return merge.resolve_decisions(places(spark, sf), DECISIONS)


def pins_override(spark, sf):
    """Pins from the decision log: the last decision per place, joined to the state."""
    pins = table(spark, sf, "orders").where(F.col("o_orderpriority") == "1-URGENT").select(
        F.concat(F.lit("p"), F.col("o_custkey").cast("string")).alias("place_id"),
        F.when(F.col("o_orderstatus") == "F", "rejected").otherwise("leads").alias("verdict"),
        F.concat(F.lit("order "), F.col("o_orderkey").cast("string")).alias("reason"),
        F.struct("o_orderdate", "o_orderkey").alias("at"),
    )
    out = verdict.with_pins(state(spark, sf), pins)
    return out.select("place_id", F.coalesce("pin_verdict", "bucket").alias("bucket"), "pin_reason")


def no_site_promotion(spark, sf):
    return verdict.promote_without_site(state(spark, sf), ("customer#00000002", "customer#00000003"))


# --- display ---------------------------------------------------------------------
def display_cells(spark, sf):
    rows = state(spark, sf).join(table(spark, sf, "psi"), "place_id", "left")
    rating = (F.col("rating_steps") / 10).cast("double")
    cells = rows.select(
        "place_id", display.speed_cell(F.col("mobile_score"), F.col("desktop_score"), F.col("website")).alias("speed"),
        display.rating_cell(rating, F.col("user_rating_count")).alias("rating_cell"),
        display.yes_no_cell(F.col("site_score").isNotNull(), F.col("fetch_error"), F.col("site_score") > 4, "сайт не відкрився").alias("adaptive"),
        maps_url(F.col("place_id")).alias("maps"), report_cell(F.col("website"), F.col("c_custkey") % 2 == 0).alias("report"),
    )
    speed, rated = display.parse_speed(F.col("speed")), display.parse_rating(F.col("rating_cell"))
    return cells.select(
        "*", speed["mobile"].alias("mobile"), speed["desktop"].alias("desktop"), rated["rating"].alias("rating"),
        rated["reviews"].alias("reviews"),
    )


def type_labels(spark, sf):
    kinds = F.element_at(
        F.array(*[F.lit(t) for t in ("Lawyer", " bakery ", "Deli", "Rare kind", "gift shop")]), (F.col("c_custkey") % 5 + 1).cast("int")
    )
    rows = places(spark, sf).select(kinds.alias("raw"))
    return rows.groupBy("raw", display.type_label(F.col("raw")).alias("label"), display.is_retail(F.col("raw")).alias("retail")).agg(
        F.count("*").alias("n")
    )


def plural_forms(spark, sf):
    n = F.coalesce(F.col("user_rating_count"), F.lit(0))
    return state(spark, sf).select(n.alias("n"), plural(n, "рік", "роки", "років").alias("word")).groupBy("n", "word").agg(
        F.count("*").alias("places")
    )


def sheet_dates(spark, sf):
    cell = F.when(F.col("c_custkey") % 2 == 0, (F.col("c_custkey") + F.lit(45000.25)).cast("string")).otherwise("not a date")
    return places(spark, sf).select("place_id", display.sheet_date(cell).alias("date"))


# --- design age ------------------------------------------------------------------
def _probes(spark, sf):
    p = F.col("p_partkey")
    return table(spark, sf, "part").select(
        "p_partkey", "p_name", (p % 2 == 0).alias("css_vars"), (p % 3 == 0).alias("css_clamp"), (p % 5).alias("grid_used"),
        (p % 30).alias("flex_used"), (p % 40).alias("float_layout"),
        F.when(p % 4 == 0, "1.11.1").when(p % 4 == 1, "2.2").when(p % 4 == 2, "3.6").alias("jquery"),
        (p % 7 == 0).alias("bootstrap3"), (p % 6 == 0).alias("font_awesome4"), (p % 9).alias("tables"), (p % 2).alias("webp"),
        (p % 3).alias("lazy_imgs"), F.when(p % 5 > 0, 2017 + p % 10).alias("copyright_year"), (p % 8 == 0).alias("fixed_width"),
    )


def design_age(spark, sf):
    return quality.design_age(_probes(spark, sf)).select("p_partkey", "design_score", F.size("design_why").alias("reasons"))


def review_plan(spark, sf):
    p = F.col("p_partkey")
    rows = quality.design_age(_probes(spark, sf)).select(
        "design_score", F.when(p % 11 == 0, "x.facebook.com").otherwise("site.example").alias("final_host"),
        F.lit("https://site.example/").alias("website"), F.when(p % 13 == 0, "403 Forbidden").otherwise(F.col("p_name")).alias("title"),
        F.when(p % 17 == 0, "timeout").alias("error"),
    )
    return quality.review_plan(rows).groupBy("decision").agg(F.count("*").alias("n"))


def label_agreement(spark, sf):
    """Length of a document as a measured score against the labels people gave."""
    scored = table(spark, sf, "documents").select("doc_id", F.least(F.lit(100), F.floor(F.col("n_chars") / 20)).alias("design_score"))
    seen = table(spark, sf, "labels").select("doc_id", F.when(F.col("quality") == 1, "modern").otherwise("dated").alias("label"))
    return quality.label_agreement(scored, seen, "doc_id")


_LOCAL = {k: v for k, v in dict(globals()).items() if callable(v) and getattr(v, "__module__", "") == __name__}
QUERIES = {k: v for k, v in _LOCAL.items() if not k.startswith("_") and k not in ("places", "state")}

# --- SQL ---------------------------------------------------------------------------
_US = "('" + "','".join(US_REGION_CODES) + "')"
_CITY_STATE = f"""
addr AS (SELECT *, CASE WHEN regexp_extract(address, ',\\s*([A-Z]{{2}})\\s+\\d{{5}}(?:-\\d{{4}})?\\b', 1) <> '' THEN regexp_extract(address, ',\\s*([A-Z]{{2}})\\s+\\d{{5}}(?:-\\d{{4}})?\\b', 1)
                        ELSE regexp_extract(trim(address), ',\\s*([A-Z]{{2}})\\s*$', 1) END AS code,
                list_transform(string_split(address, ','), lambda p: trim(p)) AS parts FROM %s),
marks AS (SELECT *, CASE WHEN code IN {_US} THEN code END AS region,
             list_max(list_filter(list_transform(range(1, len(parts) + 1), lambda i: CASE WHEN regexp_matches(parts[i], '^[A-Z]{{2}}\\s+\\d{{5}}') OR regexp_matches(parts[i], '^[A-Z]{{2}}$') THEN i END), lambda i: i IS NOT NULL)) AS spot FROM addr),
located AS (SELECT *, CASE WHEN spot >= 2 THEN parts[spot - 1] END AS city FROM marks)"""
_TAB = """CASE WHEN bucket = 'leads' THEN 'Leads' WHEN bucket = 'no_site_lead' THEN 'Ліди без сайту' WHEN bucket = 'upsell' THEN 'З хорошим сайтом'
          WHEN bucket IN ('manual', 'pending') THEN 'Manual review' WHEN bucket = 'no_site' THEN 'NO_SITE' {rejected} END"""
_TAB_ALL = _TAB.format(rejected="WHEN bucket = 'rejected' THEN 'Rejected'")
_TARGET = f"target AS (SELECT place_id, {_TAB.format(rejected='')} AS tab, owner_score, site_score, user_rating_count FROM state WHERE bucket <> 'rejected')"
_ORDER = "CASE WHEN tab IN ('Ліди без сайту', 'З хорошим сайтом') THEN -coalesce(owner_score, 0) ELSE coalesce(site_score, 5) END, coalesce(user_rating_count, 0) DESC, place_id"
_CLEAN = """clean AS (SELECT place_id, tab, trim(coalesce(status, '')) AS status, trim(coalesce(owner, '')) AS owner, trim(coalesce(date, '')) AS date, trim(coalesce(note, '')) AS note FROM notes),
  collected AS (SELECT place_id, status, owner, date, note FROM clean WHERE status <> '' OR owner <> '' OR date <> '' OR note <> '')"""
_TASKS = """
niche(k, tier, label, q, t) AS (VALUES ('auto_repair', 'A', 'Auto repair', 'auto repair shop', 'car_repair'), ('roofing', 'A', 'Roofing', 'roofing contractor', 'roofing_contractor'), ('dental', 'B', 'Dental office', 'dental office', 'dentist'), ('bakery', 'C', 'Bakery', 'bakery', 'bakery')),
tasks AS (
  SELECT substr(sha1('standalone|' || lower(n_name) || '|' || s || ' in ' || n_name), 1, 16) AS task_id, lower(n_name) AS metro_key, 'ethnic-standalone' AS mode, s || ' in ' || n_name AS text_query,
         NULL AS included_type, NULL AS niche_key, NULL AS hood_name, 45000 AS radius_m FROM nation, (VALUES ('business services'), ('food store')) v(s)
  UNION ALL SELECT substr(sha1('ethnic|' || lower(n_name) || '|' || m || '|' || k), 1, 16), lower(n_name), 'ethnic', m || ' ' || q || ' in ' || n_name, NULL, k, NULL, 45000
    FROM nation, niche, (VALUES ('bilingual'), ('family'), ('local'), ('downtown')) v(m) WHERE tier IN ('A', 'B')
  UNION ALL SELECT substr(sha1('geo|' || lower(n_name) || '|' || s_name || '|' || k), 1, 16), lower(n_name), 'geo-dense', q || ' near ' || s_name, t, k, s_name, 2500
    FROM supplier JOIN nation ON s_nationkey = n_nationkey, niche WHERE tier = 'A')"""
_S = prelude("state")
_P = prelude("places")
_CHEAP = f"""
cheap AS (SELECT *, CASE
   WHEN business_status IS NOT NULL AND business_status <> 'OPERATIONAL' THEN {{'b': 'rejected', 'r': 'бізнес не працює (' || business_status || ')', 'n': 1}}
   WHEN types_csv LIKE '%church%' THEN {{'b': 'rejected', 'r': 'некомерційний заклад (church)', 'n': 2}}
   WHEN types_csv LIKE '%museum%' THEN {{'b': 'rejected', 'r': 'некомерційний заклад (museum)', 'n': 2}}
   WHEN coalesce(user_rating_count, 0) < 5 THEN {{'b': 'rejected', 'r': 'мало відгуків (' || coalesce(user_rating_count, 0) || ' < 5)', 'n': 3}}
   WHEN NOT (regexp_matches(address, '(?i)\\bUSA\\b|\\bUnited States\\b') OR code IN {_US}) THEN {{'b': 'rejected', 'r': 'адреса не в США', 'n': 4}}
   WHEN website LIKE 'https://www.shop.ru%' THEN {{'b': 'rejected', 'r': 'домен shop.ru — виключена країна', 'n': 5}}
   WHEN phone LIKE '+7%' THEN {{'b': 'rejected', 'r': 'телефон виключеної країни', 'n': 6}}
   WHEN website IS NULL THEN {{'b': 'no_site', 'r': NULL, 'n': 7}} ELSE {{'b': 'pending', 'r': NULL, 'n': 8}} END AS v FROM addr)"""
_ADJ = """
pr AS (SELECT p_partkey AS p, p_name, p_partkey % 5 AS g, p_partkey % 30 AS fl, CASE WHEN p_partkey % 5 > 0 THEN 2017 + p_partkey % 10 END AS y FROM part),
pts AS (SELECT *, [CASE WHEN p % 2 = 0 THEN 12 END, CASE WHEN p % 3 = 0 THEN 10 END, CASE WHEN g >= 3 THEN 12 WHEN g >= 1 THEN 5 END, CASE WHEN fl >= 20 THEN 8 WHEN fl >= 5 THEN 4 END,
   CASE WHEN p % 2 > 0 THEN 8 END, CASE WHEN p % 3 > 0 THEN 5 END, CASE p % 4 WHEN 0 THEN -18 WHEN 1 THEN -12 WHEN 2 THEN -4 END, CASE WHEN p % 7 = 0 THEN -12 END, CASE WHEN p % 6 = 0 THEN -8 END,
   CASE WHEN p % 8 = 0 THEN -8 END, CASE WHEN p % 40 > 25 THEN -10 END, CASE WHEN p % 9 > 3 THEN -6 END, CASE WHEN y >= 2025 THEN 6 WHEN y <= 2021 THEN -10 WHEN y <= 2023 THEN -5 END] AS a FROM pr),
aged AS (SELECT *, greatest(0, least(100, 50 + coalesce(list_sum(a), 0))) AS design_score, len(list_filter(a, lambda x: x IS NOT NULL)) AS reasons FROM pts)"""

ORACLES = {
    "cheap_filter": f"{_P}, {_CITY_STATE % 'places'}, {_CHEAP} SELECT place_id, v.b AS bucket, v.r AS reject_reason, v.n AS rule_no FROM cheap",
    "refilter": f"{_S}, {_CITY_STATE % 'state'}, {_CHEAP} SELECT place_id, bucket AS old_bucket, CASE WHEN v.b = 'rejected' OR stage = 'discovered' THEN v.b ELSE bucket END AS bucket, CASE WHEN v.b = 'rejected' OR stage = 'discovered' THEN v.r ELSE reject_reason END AS reject_reason FROM cheap",
    "transitions": f"{_S}, {_CITY_STATE % 'state'}, {_CHEAP}, t AS (SELECT bucket AS a, CASE WHEN v.b = 'rejected' OR stage = 'discovered' THEN v.b ELSE bucket END AS b FROM cheap) SELECT a AS from_bucket, b AS to_bucket, count(*) AS n FROM t WHERE a <> b GROUP BY a, b",
    "audit_candidates": f"{_S} SELECT place_id, bucket FROM state WHERE bucket IN ('pending', 'manual') AND website IS NOT NULL AND stage = 'discovered'",
    "enrich_candidates": f"{prelude('state', 'psi')} SELECT place_id, bucket FROM state WHERE bucket IN ('leads', 'manual') AND website IS NOT NULL AND place_id NOT IN (SELECT place_id FROM psi)",
    "panel_filter": f"{_S} SELECT place_id, name, metro_key AS location FROM state WHERE contains(lower(concat_ws(' ', name, website, phone)), 'machinery') AND trim(coalesce(status, '')) = ''",
    "suspicious_names": "SELECT p_partkey, p_name || ' Society' AS name FROM part WHERE p_size > 40",
    "challenge_titles": "SELECT regexp_matches(regexp_extract(html, '(?i)<title[^>]*>([\\s\\S]*?)</title>', 1), '(?i)challenge|checking your browser|403|forbidden|just a moment|human verification|attention required|verifying you are human') AS challenge, count(*) AS n FROM pages GROUP BY 1",
    "platform_profiles": f"{_P} SELECT c_custkey % 4 = 0 AS platform, count(*) AS n FROM places WHERE website IS NOT NULL GROUP BY 1",
    "retry_queue": f"{_S} SELECT place_id, fetch_error, user_rating_count FROM state WHERE bucket IN ('manual', 'pending') AND website IS NOT NULL AND fetch_error = 'http-403' ORDER BY coalesce(user_rating_count, 0) DESC, place_id LIMIT 30",
    "slow_sites": f"{prelude('state', 'psi')} SELECT place_id, lcp_ms, mobile_score, site_score FROM state JOIN psi USING (place_id) WHERE lcp_ms > 6000 ORDER BY lcp_ms DESC, place_id LIMIT 12",
    "export_assembly": f"""{prelude('state', 'psi', 'reviews', 'placement')} SELECT p.place_id, p.name, s.site_score, CASE WHEN s.owner_score >= 15 THEN s.owner_score END AS owner_score, r.sample_size, psi.mobile_score, CASE WHEN l.place_id IS NOT NULL THEN p.place_id || '.png' END AS mobile_path
        FROM places p JOIN state s USING (place_id) LEFT JOIN (SELECT place_id, count(*) AS sample_size FROM reviews GROUP BY place_id) r USING (place_id) LEFT JOIN psi USING (place_id) LEFT JOIN placement l USING (place_id)""",
    "review_queue": f"{_S} SELECT place_id, owner_score, user_rating_count, site_score FROM state WHERE bucket = 'pending' ORDER BY coalesce(owner_score, 0) DESC, coalesce(user_rating_count, 0) DESC, coalesce(site_score, 5), place_id LIMIT 100",
    "unreviewed_potential": f"{prelude('state', 'reviews')} SELECT place_id, owner_score FROM state WHERE bucket = 'pending' AND coalesce(owner_score, 0) >= 10 AND place_id NOT IN (SELECT place_id FROM reviews WHERE language_code = 'UK')",
    "lead_listing": f"{_S} SELECT place_id, name, owner_score, user_rating_count, site_score FROM state WHERE bucket = 'leads' ORDER BY owner_score DESC, coalesce(user_rating_count, -1) DESC, place_id LIMIT 15",
    "lead_site_scores": f"{_S} SELECT site_score, count(*) AS n FROM state WHERE bucket = 'leads' AND site_score IS NOT NULL GROUP BY site_score",
    "task_expansion": f"WITH {_TASKS} SELECT * FROM tasks",
    "pending_tasks": f"WITH {_TASKS} SELECT mode, count(*) AS n FROM tasks WHERE task_id >= '8' GROUP BY mode",
    "budget_preflight": f"""WITH {_TASKS}, s AS (SELECT count(*) AS tasks, count(*) FILTER (task_id >= '8') AS todo, CAST(floor(sum(CASE WHEN mode = 'geo-dense' THEN 20 ELSE 13 END) / 10 + 0.5) AS BIGINT) AS expected FROM tasks)
        SELECT tasks, todo, expected, CAST(ceil(todo * (expected / tasks)) AS BIGINT) AS needed, CAST(greatest(0, floor(200 / greatest(expected / tasks, 0.1))) AS BIGINT) AS fits, ceil(todo * (expected / tasks)) <= 200 AS start FROM s""",
    "niche_dimension": f"{_P}, {_TASKS.split('tasks AS')[0].strip().rstrip(',')}, k AS (SELECT ['auto_repair', 'roofing', 'dental', 'bakery'][c_custkey % 4 + 1] AS niche_key FROM places) SELECT niche_key, tier AS niche_tier, label AS niche_label, count(*) AS n FROM k JOIN niche ON niche_key = niche.k GROUP BY 1, 2, 3",
    "name_picks": f"""{_S}, x AS (SELECT *, CASE WHEN lower(name) LIKE 'customer#0000001%' THEN 'known from the trade fair' WHEN lower(name) LIKE 'customer#00000002%' THEN 'called last year' END AS why, site_score IS NULL OR fetch_error IS NOT NULL AS unread FROM state WHERE bucket IN ('manual', 'pending'))
        SELECT place_id, why, unread OR coalesce(site_score, 10) <= 6 AS passes, CASE WHEN unread THEN 'сайт не прочитано' ELSE 'сайт ' || coalesce(site_score, 10) || '/10' END AS state FROM x WHERE why IS NOT NULL""",
    "moved_rows": f"{prelude('state', 'placement')}, {_TARGET} SELECT l.place_id, l.tab, t.tab AS now_tab FROM placement l LEFT JOIN target t USING (place_id) WHERE l.tab IS DISTINCT FROM t.tab",
    "stale_rows": f"{prelude('state', 'placement')}, {_TARGET} SELECT l.place_id, l.tab FROM placement l LEFT JOIN target t ON t.place_id = l.place_id AND t.tab = l.tab WHERE t.place_id IS NULL",
    "orphan_notes": f"{prelude('state', 'notes')}, {_TARGET}, {_CLEAN} SELECT l.place_id, l.tab FROM collected c JOIN placement l USING (place_id) WHERE l.tab <> 'Rejected' AND c.place_id NOT IN (SELECT place_id FROM target)",
    "publication": f"{prelude('state', 'notes')}, {_TARGET}, {_CLEAN}, u AS (SELECT tab, false AS kept FROM target UNION ALL SELECT l.tab, true FROM collected c JOIN placement l USING (place_id) WHERE l.tab <> 'Rejected' AND c.place_id NOT IN (SELECT place_id FROM target)) SELECT tab, count(*) AS rows, count(*) FILTER (kept) AS kept FROM u GROUP BY tab",
    "publish_order": f"{_S}, t AS (SELECT place_id, {_TAB_ALL} AS tab, owner_score, site_score, user_rating_count FROM state) SELECT tab, row_number() OVER (PARTITION BY tab ORDER BY {_ORDER}) AS position, place_id FROM t",
    "placement": f"""{prelude('state', 'placement')}, {_TARGET}, j AS (SELECT t.*, l.row_index FROM target t LEFT JOIN placement l ON l.place_id = t.place_id AND l.tab = t.tab), last AS (SELECT tab, max(row_index) AS m FROM placement GROUP BY tab)
        SELECT place_id, tab, row_index, false AS inserted FROM j WHERE row_index IS NOT NULL
        UNION ALL SELECT place_id, j.tab, coalesce(m, 0) + row_number() OVER (PARTITION BY j.tab ORDER BY {_ORDER.replace('tab IN', 'j.tab IN')}), true FROM j LEFT JOIN last ON last.tab = j.tab WHERE row_index IS NULL""",
    "notes_collected": f"{prelude('notes')}, {_CLEAN} SELECT * FROM collected",
    "notes_follow": f"{prelude('state', 'notes')}, {_TARGET}, {_CLEAN} SELECT tab, count(*) AS rows, count(*) FILTER (status <> '') AS with_status, count(*) FILTER (owner <> '') AS with_owner, count(*) FILTER (note <> '') AS with_note FROM target LEFT JOIN collected USING (place_id) GROUP BY tab",
    "repair_shifted": f"""{_S}, r AS (SELECT place_id, CASE WHEN c_custkey % 5 = 0 THEN metro_key ELSE status END AS status, CASE WHEN c_custkey % 2 = 0 THEN CAST(c_custkey + 40000 AS VARCHAR) ELSE 'seller' END AS owner, c_custkey FROM state),
        f AS (SELECT *, c_custkey % 5 = 0 AND c_custkey % 2 = 0 AND c_custkey + 40000 < 100000 AS shifted FROM r) SELECT place_id, CASE WHEN shifted THEN '' ELSE status END AS status, CASE WHEN shifted THEN trim(status) ELSE owner END AS owner, shifted FROM f""",
    "clear_preview": f"{prelude('notes')}, {_CLEAN} SELECT tab, count(*) AS rows FROM clean WHERE status <> '' OR owner <> '' OR date <> '' OR note <> '' GROUP BY tab",
    "tab_list": f"{prelude('placement')} SELECT tab, count(*) AS rows FROM placement WHERE row_index % 5 <> 4 GROUP BY tab",
    "payload_union": f"{_S} SELECT place_id, name, NULL AS owner_score, 'З хорошим сайтом' AS tab FROM state WHERE bucket = 'upsell' UNION ALL SELECT place_id, name, owner_score, 'Leads' FROM state WHERE bucket = 'leads'",
    "layout_migration": f"{_S} SELECT place_id, name, NULL AS brief, status FROM state",
    "run_metadata": f"""{prelude('state', 'usage_log')} SELECT 'Пресет' AS key, 'trial' AS value UNION ALL SELECT 'Поріг мовного скору (Leads)', '55'
        UNION ALL SELECT 'Місць у базі всього', CAST(count(*) AS VARCHAR) FROM state UNION ALL SELECT 'Leads', CAST(count(*) AS VARCHAR) FROM state WHERE bucket = 'leads'
        UNION ALL SELECT 'Manual review', CAST(count(*) AS VARCHAR) FROM state WHERE bucket IN ('manual', 'pending') UNION ALL SELECT 'NO_SITE', CAST(count(*) AS VARCHAR) FROM state WHERE bucket = 'no_site'
        UNION ALL SELECT 'Rejected', CAST(count(*) AS VARCHAR) FROM state WHERE bucket = 'rejected'
        UNION ALL SELECT 'API ' || api || ' (' || strftime(ts, '%Y-%m') || ')', CAST(CAST(sum(n) AS BIGINT) AS VARCHAR) FROM usage_log GROUP BY api, strftime(ts, '%Y-%m')""",
    "bucket_counts": f"{_S} SELECT bucket, count(*) AS n FROM state GROUP BY bucket",
    "owner_bands": f"{_S} SELECT CASE WHEN owner_score >= 85 THEN '85-100' WHEN owner_score >= 70 THEN '70-84' WHEN owner_score >= 55 THEN '55-69' WHEN owner_score >= 40 THEN '40-54' WHEN owner_score >= 20 THEN '20-39' ELSE '0-19' END AS band, count(*) AS n FROM state GROUP BY 1",
    "reject_reasons": f"{_S} SELECT reject_reason, count(*) AS n FROM state WHERE bucket = 'rejected' AND reject_reason IS NOT NULL GROUP BY 1 ORDER BY n DESC, reject_reason LIMIT 10",
    "region_counts": f"{_S}, {_CITY_STATE % 'state'} SELECT coalesce(region, '??') AS region, count(*) AS total, count(*) FILTER (bucket = 'leads') AS leads, coalesce(region, '??') IN ('IL', 'CA', 'NY') AS wanted FROM located WHERE bucket <> 'rejected' GROUP BY 1, 4",
    "region_share": f"{_S}, {_CITY_STATE % 'state'} SELECT count(*) AS places, count(*) FILTER (region IN ('IL', 'CA', 'NY')) AS inside, CAST(floor(count(*) FILTER (region IN ('IL', 'CA', 'NY')) * 100 / count(*) + 0.5) AS BIGINT) AS share FROM located WHERE bucket <> 'rejected'",
    "threshold_whatif": f"{_S}, r AS (SELECT owner_score AS o FROM state WHERE bucket IN ('leads', 'manual')) SELECT t AS threshold, count(*) FILTER (o >= t) AS leads, count(*) FILTER (o >= t) - count(*) FILTER (o >= 70) AS gain FROM r, (VALUES (70), (65), (60), (55), (50), (45), (40)) v(t) GROUP BY t",
    "newly_admitted": f"{_S} SELECT place_id, owner_score, user_rating_count FROM state WHERE bucket IN ('leads', 'manual') AND owner_score >= 55 AND owner_score < 70 ORDER BY coalesce(user_rating_count, 0) DESC, place_id LIMIT 12",
    "need_bands": f"""{_S}, b(band, lo, hi) AS (VALUES ('55-69', 55, 69), ('40-54', 40, 54), ('25-39', 25, 39), ('10-24', 10, 24), ('0-9', 0, 9))
        SELECT band, count(s.place_id) AS n, 55 - hi AS need_easy, 55 - lo AS need_hard, CASE WHEN 55 - lo <= 25 THEN 'дуже висока' WHEN 55 - lo <= 45 THEN 'висока' WHEN 55 - lo <= 60 THEN 'середня' ELSE 'низька — лише ідеальні відгуки' END AS feasibility, 55 - lo <= 60 AS worth_it
        FROM b LEFT JOIN state s ON s.bucket = 'pending' AND coalesce(s.owner_score, 0) BETWEEN lo AND hi GROUP BY band, lo, hi""",
    "queue_profile": f"""{prelude('state', 'psi', 'reviews')}, q AS (SELECT s.*, s.place_id IN (SELECT place_id FROM reviews) AS r, s.place_id IN (SELECT place_id FROM psi) AS p, s.place_id IN (SELECT 'p' || page_id FROM pages) AS c FROM state s WHERE bucket IN ('manual', 'pending')),
        m AS (SELECT *, CASE WHEN owner_score >= 55 THEN '55+' WHEN owner_score >= 40 THEN '40-54' WHEN owner_score >= 25 THEN '25-39' WHEN owner_score >= 10 THEN '10-24' ELSE '0-9' END AS sb,
             CASE WHEN user_rating_count >= 200 THEN '200+' WHEN user_rating_count >= 100 THEN '100-199' WHEN user_rating_count >= 50 THEN '50-99' WHEN user_rating_count >= 20 THEN '20-49' ELSE '5-19' END AS rb FROM q)
        SELECT 'part' AS kind, 'total' AS item, count(*) AS n FROM m UNION ALL SELECT 'part', 'with_site', count(*) FROM m WHERE website IS NOT NULL UNION ALL SELECT 'part', 'audited', count(*) FROM m WHERE site_score IS NOT NULL
        UNION ALL SELECT 'part', 'with_review_signal', count(*) FROM m WHERE r UNION ALL SELECT 'part', 'with_psi', count(*) FROM m WHERE p UNION ALL SELECT 'part', 'with_cache', count(*) FROM m WHERE c
        UNION ALL SELECT 'score', v.l, count(m.place_id) FROM (VALUES ('55+'), ('40-54'), ('25-39'), ('10-24'), ('0-9')) v(l) LEFT JOIN m ON m.sb = v.l GROUP BY v.l
        UNION ALL SELECT 'reviews', v.l, count(m.place_id) FROM (VALUES ('200+'), ('100-199'), ('50-99'), ('20-49'), ('5-19')) v(l) LEFT JOIN m ON m.rb = v.l GROUP BY v.l""",
    "panel_figures": f"{_S} SELECT count(*) AS rows, count(*) FILTER (trim(coalesce(status, '')) = '') AS untouched, count(*) FILTER (site_score <= 3) AS hot, floor(avg(site_score) * 10 + 0.5) / 10 AS mean_score FROM state WHERE site_score IS NOT NULL",
    "top_metros": f"{_S}, l AS (SELECT metro_key || ' metropolitan area of ' || hood_name AS label, count(*) AS n FROM state GROUP BY 1 ORDER BY n DESC, label LIMIT 8) SELECT left(label, 23) || '…' AS label, label AS full_label, n FROM l",
    "state_score_histogram": f"{_S} SELECT s AS score, count(state.place_id) AS n FROM (SELECT unnest(range(1, 11)) AS s) LEFT JOIN state ON site_score = s GROUP BY s",
    "status_funnel": f"{_S} SELECT CASE WHEN trim(coalesce(status, '')) = '' THEN 'Не опрацьовано' ELSE trim(status) END AS status, count(*) AS n FROM state GROUP BY 1",
    "phone_patterns": f"{_P} SELECT count(*) AS phones, count(*) FILTER (regexp_matches(phone, '\\+?\\s?7[\\s\\-(]?9\\d{{2}}[\\s\\-)]?\\d{{3}}')) AS ru_hits, count(*) FILTER (regexp_matches(phone, '\\+?\\s?380[\\s\\-(]?\\d{{2}}')) AS ua_hits, CAST(floor(count(*) FILTER (regexp_matches(phone, '\\+?\\s?7[\\s\\-(]?9\\d{{2}}[\\s\\-)]?\\d{{3}}')) * 100 / count(*) + 0.5) AS BIGINT) AS ru_share FROM places",
    "no_site_potential": f"""{_S}, x AS (SELECT CASE WHEN regexp_matches(name, '(?i)machinery') THEN 28 WHEN regexp_matches(name, '(?i)building') THEN 12 ELSE 0 END AS s, regexp_matches(concat_ws(' ', hood_name, address), '(?i)asia|europe|africa') AS a FROM state WHERE bucket = 'no_site'),
        y AS (SELECT *, s + CASE WHEN a THEN 10 ELSE 0 END AS t FROM x) SELECT CASE WHEN t >= 30 THEN '30+' WHEN t >= 15 THEN '15-29' WHEN t > 0 THEN '1-14' ELSE '0' END AS band, count(*) AS n, count(*) FILTER (s > 0) AS by_name, count(*) FILTER (a) AS by_area FROM y GROUP BY 1""",
    "kept_by_marker": f"{_S} SELECT count(*) FILTER (site_score <= 6) AS passed_by_score, count(*) FILTER (site_score > 6 AND c_custkey % 3 = 0) AS kept_by_marker FROM state WHERE bucket = 'leads' AND website IS NOT NULL",
    "at_risk": f"{_S} SELECT count(*) FILTER (site_score <= 6) AS safe, count(*) FILTER (site_score > 6) AS at_risk FROM state WHERE bucket = 'leads'",
    "type_frequency": f"{_S} SELECT primary_type, count(*) AS n FROM state WHERE bucket IN ('leads', 'pending') GROUP BY 1 ORDER BY n DESC, 1 LIMIT 25",
    "lead_types": f"{_S} SELECT place_id, primary_type, replace(types_csv, ',', ', ') AS types FROM state WHERE bucket = 'leads' ORDER BY owner_score DESC, place_id LIMIT 25",
    "address_coverage": f"{_P}, {_CITY_STATE % 'places'} SELECT count(*) AS rows, count(*) FILTER (city <> '' AND region IS NOT NULL) AS parsed, count(*) - count(*) FILTER (city <> '' AND region IS NOT NULL) AS failed FROM located",
    "address_parts": f"{_P}, {_CITY_STATE % 'places'}, z AS (SELECT *, nullif(concat_ws(', ', nullif(city, ''), region), '') AS real FROM located) SELECT place_id, city, region, CASE WHEN real IS NOT NULL AND city <> '' AND NOT contains(lower(hood_name), lower(city)) THEN real || '  (знайдено через ' || hood_name || ')' ELSE coalesce(real, hood_name) END AS location FROM z",
    "signal_overlap": f"{_S}, x AS (SELECT coalesce(user_rating_count, 0) > 0 AS h, owner_score % 2 = 0 AS l, owner_score % 3 = 0 AS a FROM state) SELECT count(*) FILTER (h) AS with_reviews, count(*) FILTER (h AND l) AS by_language, count(*) FILTER (h AND a) AS by_author, count(*) FILTER (h AND (l OR a)) AS either, count(*) FILTER (h AND a AND NOT l) AS author_only, count(*) FILTER (NOT h) AS none FROM x",
    "manual_candidates": f"{_S} SELECT place_id, owner_score, user_rating_count FROM state WHERE bucket IN ('manual', 'pending') AND owner_score >= 40 ORDER BY owner_score DESC, coalesce(user_rating_count, 0) DESC, place_id LIMIT 50",
    "rejected_despite_score": f"{_S} SELECT place_id, 100 - owner_score AS owner_score, user_rating_count, reject_reason FROM state WHERE bucket = 'rejected' AND 100 - owner_score >= 70 ORDER BY coalesce(user_rating_count, -1) DESC, place_id LIMIT 20",
    "destinations": f"{_S} SELECT bucket, reject_reason, count(*) AS n FROM state WHERE owner_score >= 50 GROUP BY 1, 2",
    "panel_sorted": f"""{_S} SELECT * FROM (SELECT 'site_score' AS sort_key, place_id FROM state ORDER BY coalesce(site_score, 0), place_id LIMIT 20) UNION ALL SELECT * FROM (SELECT 'reviews', place_id FROM state ORDER BY coalesce(user_rating_count, 0) DESC, place_id LIMIT 20)
        UNION ALL SELECT * FROM (SELECT 'owner_score', place_id FROM state ORDER BY owner_score DESC, place_id LIMIT 20) UNION ALL SELECT * FROM (SELECT 'difficulty', place_id FROM state ORDER BY coalesce(site_score % 6, 0) DESC, place_id LIMIT 20) UNION ALL SELECT * FROM (SELECT 'name', place_id FROM state ORDER BY name, place_id LIMIT 20)""",
    "stage_of_place": f"""{prelude('state', 'reviews', 'psi', 'placement')}, s AS (SELECT CASE WHEN place_id IN (SELECT place_id FROM placement) THEN 'exported' WHEN place_id IN (SELECT place_id FROM psi) THEN 'enriched' WHEN place_id IN (SELECT place_id FROM reviews WHERE language_code = 'UK') THEN 'reviewed' WHEN site_score IS NOT NULL THEN 'audited' ELSE 'discovered' END AS stage FROM state) SELECT stage, count(*) AS n FROM s GROUP BY stage""",
    "decisions": f"""{_P}, d(idx, name, verdict, reason, key) AS (VALUES (0, 'Customer#000000007', 'rejected', 'modern site', NULL), (1, 'Customer#00000001', 'leads', 'fits more than one', NULL), (2, 'by key', 'no_site', 'profile on a platform', 'p11'), (3, 'nobody of this name', 'leads', 'gone', NULL)),
        m AS (SELECT d.idx, count(p.place_id) AS matches, min(p.place_id) AS one FROM d LEFT JOIN places p ON CASE WHEN d.key IS NOT NULL THEN p.place_id = d.key ELSE starts_with(lower(p.name), lower(d.name)) END GROUP BY d.idx)
        SELECT idx, name, verdict, reason, matches, CASE WHEN matches = 1 THEN one END AS place_id FROM d JOIN m USING (idx)""",
    "pins_override": f"""{_S}, k AS (SELECT 'p' || o_custkey AS place_id, arg_max(CASE WHEN o_orderstatus = 'F' THEN 'rejected' ELSE 'leads' END, (o_orderdate, o_orderkey)) AS verdict, 'order ' || arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS reason FROM orders WHERE o_orderpriority = '1-URGENT' GROUP BY o_custkey)
        SELECT place_id, coalesce(verdict, bucket) AS bucket, reason AS pin_reason FROM state LEFT JOIN k USING (place_id)""",
    "no_site_promotion": f"{_S} SELECT place_id, CASE WHEN lower(name) LIKE 'customer#00000002%' OR lower(name) LIKE 'customer#00000003%' THEN 'rejected' ELSE 'no_site_lead' END AS verdict, CASE WHEN lower(name) LIKE 'customer#00000002%' OR lower(name) LIKE 'customer#00000003%' THEN 'організація або топонім, не комерційний бізнес' ELSE 'мова підтверджена за назвою (скор ' || owner_score || ')' END AS reason FROM state WHERE bucket = 'no_site' AND owner_score >= 26",
    "display_cells": f"""{prelude('state', 'psi')}, c AS (SELECT s.place_id, CASE WHEN psi.place_id IS NOT NULL THEN mobile_score || ' / ' || desktop_score WHEN website IS NOT NULL THEN 'не заміряно' ELSE '—' END AS speed,
          coalesce(regexp_replace(CAST(CAST(rating_steps AS DOUBLE) / 10 AS VARCHAR), '\\.0$', ''), '—') || ' / ' || coalesce(user_rating_count, 0) AS rating_cell,
          CASE WHEN site_score IS NULL THEN '—' WHEN fetch_error IS NOT NULL THEN 'сайт не відкрився' WHEN site_score > 4 THEN 'так' ELSE 'НІ' END AS adaptive,
          'https://www.google.com/maps/place/?q=place_id:' || s.place_id AS maps,
          CASE WHEN website IS NULL THEN '—' ELSE '=HYPERLINK("https://pagespeed.web.dev/analysis?url=' || url_encode(website) || '","' || CASE WHEN c_custkey % 2 = 0 THEN 'PSI звіт + скрін' ELSE 'PSI звіт' END || '")' END AS report,
          mobile_score AS mobile, desktop_score AS desktop, CAST(rating_steps AS DOUBLE) / 10 AS rating, coalesce(user_rating_count, 0) AS reviews FROM state s LEFT JOIN psi USING (place_id)) SELECT * FROM c""",
    "type_labels": f"{_P}, r AS (SELECT ['Lawyer', ' bakery ', 'Deli', 'Rare kind', 'gift shop'][c_custkey % 5 + 1] AS raw FROM places) SELECT raw, CASE trim(lower(raw)) WHEN 'lawyer' THEN 'юрист' WHEN 'bakery' THEN 'пекарня' WHEN 'deli' THEN 'делікатеси' WHEN 'gift shop' THEN 'магазин подарунків' ELSE trim(raw) END AS label, trim(lower(raw)) IN ('bakery', 'deli', 'gift shop') AS retail, count(*) AS n FROM r GROUP BY 1, 2, 3",
    "plural_forms": f"{_S}, x AS (SELECT coalesce(user_rating_count, 0) AS n FROM state) SELECT n, CASE WHEN n % 100 BETWEEN 11 AND 14 THEN 'років' WHEN n % 10 = 1 THEN 'рік' WHEN n % 10 BETWEEN 2 AND 4 THEN 'роки' ELSE 'років' END AS word, count(*) AS places FROM x GROUP BY 1, 2",
    "sheet_dates": f"{_P} SELECT place_id, CASE WHEN c_custkey % 2 = 0 THEN CASE WHEN c_custkey + 45000.25 < 100000 THEN strftime(DATE '1899-12-30' + CAST(c_custkey + 45000 AS INTEGER), '%d.%m.%Y') ELSE CAST(c_custkey AS VARCHAR) END ELSE 'not a date' END AS date FROM places",
    "design_age": f"WITH {_ADJ} SELECT p AS p_partkey, CAST(design_score AS INTEGER) AS design_score, reasons FROM aged",
    "review_plan": f"WITH {_ADJ} SELECT CASE WHEN p % 11 = 0 THEN 'no_site' WHEN p % 17 = 0 OR p % 13 = 0 THEN 'keep' WHEN design_score <= 45 THEN 'lead' WHEN design_score >= 76 THEN 'reject' ELSE 'keep' END AS decision, count(*) AS n FROM aged GROUP BY 1",
    "label_agreement": "WITH x AS (SELECT CASE WHEN least(100, floor(n_chars / 20)) >= 60 THEN 'modern' ELSE 'dated' END AS measured, CASE WHEN quality = 1 THEN 'modern' ELSE 'dated' END AS seen FROM documents JOIN labels USING (doc_id)) SELECT measured, seen, count(*) AS n, measured = seen AS agrees FROM x GROUP BY 1, 2",
}
