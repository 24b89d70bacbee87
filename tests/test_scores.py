"""Status, quality, effort, owner score and the verdict cascade on literal rows."""

import datetime as dt
import re

import pytest
from pyspark.sql import functions as F

from sitegauge import texts
from sitegauge.functions.evidence import evidence, item
from sitegauge.operators import effort, quality, reviews, rules, verdict
from sitegauge.params import DEFAULT
from sitegauge.plans.rescore import audits_of, rescore, reverdict, stored_facts
from sitegauge.session import reliable

AUDIT = (
    "struct<http_status:int,fetch_error:string,html_bytes:bigint,title:string,meta_description:string,h1:string,"
    "has_viewport:boolean,https:boolean,mixed_content:boolean,tls_expired:boolean,jquery_version:string,has_flash:boolean,"
    "table_layout:boolean,bootstrap_major:int,charset_declared:boolean,footer_year:int,og_tags:boolean,favicon:boolean,"
    "modern_framework:string,builder:string,page_count:int,unique_page_types:int,has_catalog:boolean,has_ecommerce:boolean,"
    "has_forms:boolean,languages:int>"
)
GOOD = dict(
    http_status=200, fetch_error=None, html_bytes=90_000, title="t", meta_description="d", h1="h", has_viewport=True, https=True,
    mixed_content=False, tls_expired=False, jquery_version=None, has_flash=False, table_layout=False, bootstrap_major=None,
    charset_declared=True, footer_year=2026, og_tags=True, favicon=True, modern_framework=None, builder=None, page_count=1,
    unique_page_types=1, has_catalog=False, has_ecommerce=False, has_forms=False, languages=1,
)


def rated(spark, audits, psi=None):
    rows = [(i, None if a is None else tuple({**GOOD, **a}.values())) for i, a in enumerate(audits)]
    df = spark.createDataFrame(rows, f"i int, audit {AUDIT}")
    df = df.withColumn("psi", F.lit(None).cast(quality.NO_SPEED) if psi is None else F.struct(
        *[F.lit(v).alias(k) for k, v in psi.items()]).cast(quality.NO_SPEED))
    return [r["quality"] for r in quality.site_quality(df, 2026, "audit", "psi").orderBy("i").collect()]


def test_status_order(spark):
    got = rated(spark, [{}, {"http_status": 403, "fetch_error": "http-403"}, {"http_status": 404, "fetch_error": "http-404"},
                        {"http_status": 202, "html_bytes": 168, "title": None}, {"http_status": 500}, None])
    assert [q["status"] for q in got] == ["ok", "blocked", "dead", "blocked", "dead", "dead"]
    assert [(q["score10"], q["raw"]) for q in got] == [(10, 100), (5, 50), (1, 0), (5, 50), (1, 0), (1, 0)]
    assert got[2]["reasons"] == ["сайт не відкривається (http-404)"] and got[5]["dated_markers"] == [texts.DEAD_MARKER]


def test_penalties_add_up(spark):
    old = {"has_viewport": False, "https": False, "jquery_version": "1.11", "bootstrap_major": 3, "footer_year": 2016, "table_layout": True}
    q = rated(spark, [old])[0]
    assert q["raw"] == 100 - 25 - 15 - 8 - 6 - 10 - 10 and q["score10"] == 3
    assert q["reasons"][0] == "−25 нема viewport meta — не адаптивний"
    assert q["dated_markers"] == ["не адаптивний", "верстка таблицями", "нема HTTPS", "jQuery 1.11", "Bootstrap 3", "копірайт 2016"]


def test_speed_bands_and_modern_bonus(spark):
    slow = rated(spark, [{}], {"mobile_score": 25, "desktop_score": 50, "lcp_ms": 18_700, "cls": 0.6})[0]
    assert slow["raw"] == 100 - 25 - 30 - 10 and "LCP 18.7s — сайт практично не відкривається" in slow["reasons"][1]
    assert rated(spark, [{"has_viewport": False, "modern_framework": "Nuxt"}])[0]["raw"] == 100


def test_effort_and_difficulty(spark):
    rows = [(0, tuple({**GOOD, "unique_page_types": 12, "page_count": 90, "has_catalog": True, "languages": 2}.values())), (1, None)]
    df = spark.createDataFrame(rows, f"i int, audit {AUDIT}").withColumn("e", effort.effort(F.col("audit")))
    d = effort.difficulty(F.col("e.hours_min"), F.col("e.hours_max"))
    got = df.select("e.*", d["stars"].alias("stars"), effort.stars_text(d["stars"]).alias("text")).orderBy("i").collect()
    total = 10 + 24 + 6 + 4 + 4 + 18
    assert got[0]["hours_min"] == int(total * 0.85 + 0.5) and got[0]["hours_max"] == int(total * 1.25 + 0.5)
    assert (got[1]["hours_min"], got[1]["hours_max"], got[1]["stars"], got[1]["text"]) == (22, 33, 1, "★☆☆☆☆")


def owner(spark, **parts):
    site = parts.get("site", {})
    df = spark.range(1).select(
        F.struct(F.lit(site.get("lang")).cast("string").alias("lang"), F.lit(site.get("excluded")).cast("string").alias("hard_exclusion"),
                 evidence(*[item(*e) for e in site.get("ev", [])]).alias("evidence")).alias("site"),
        F.struct(F.lit(None).cast("string").alias("preferred_lang"), evidence(*[item(*e) for e in parts.get("rev", [])]).alias("evidence")).alias("rev"),
        F.struct(F.lit(parts.get("name_excluded")).cast("string").alias("exclusion"), evidence(*[item(*e) for e in parts.get("name", [])]).alias("evidence")).alias("name"),
        evidence(*[item(*e) for e in parts.get("versions", [])]).alias("versions"),
    )
    return verdict.owner_score(df, "site", "rev", "name", "versions").collect()[0]["owner"]


def e(signal, weight, detail="x"):
    return signal, weight, F.lit(detail)


def test_only_the_strongest_version_counts(spark):
    o = owner(spark, versions=[e("a", 30), e("b", 45, "hreflang: uk"), e("c", 35)], site={"ev": [e("v", 20)]})
    assert o["score"] == 65 and o["bucket"] == "leads" and o["lang"] == "uk"
    assert [x["weight"] for x in o["evidence"]] == [45, 0, 0, 20]


def test_part_scores_are_summed_without_their_own_caps(spark):
    assert owner(spark, name=[e("a", 35), e("b", 28)], rev=[e("r", 30), e("s", 60)])["score"] == 100
    assert owner(spark, name=[e("a", 35), e("b", 28)])["score"] == 63


def test_exclusions_give_zero(spark):
    o = owner(spark, site={"excluded": "serbian_glyphs", "ev": [e("exclusion", 0)]}, name=[e("a", 40)])
    assert (o["score"], o["exclusion"], o["bucket"], o["lang"]) == (0, "serbian_glyphs", "rejected", None)
    assert owner(spark, name_excluded="listed", name=[e("name_exclusion", 0)])["exclusion"] == "listed"


BASE = dict(pin_verdict=None, pin_reason=None, primary_type="bakery", types=["store"], user_rating_count=20, score=60, exclusion=None,
            has_audit=True, fetch_error=None, modern_framework=None, site_status="ok", site_score=4, dated_markers=["old"], psi_done=False,
            has_reviews=True)
CASES = [
    (dict(pin_verdict="leads", types=["church"]), 1, "leads"), (dict(types=["store", "church"]), 2, "rejected"),
    (dict(primary_type="museum"), 2, "rejected"), (dict(user_rating_count=3), 3, "rejected"), (dict(exclusion="x"), 4, "rejected"),
    (dict(site_status="blocked"), 5, "manual"), (dict(site_status="blocked", score=20), 11, "manual"), (dict(modern_framework="Nuxt"), 6, "rejected"),
    (dict(modern_framework="Nuxt", fetch_error="timeout"), 8, "leads"), (dict(dated_markers=[], psi_done=True, site_score=8), 7, "upsell"),
    (dict(dated_markers=[], psi_done=False, site_score=8), 8, "leads"), (dict(psi_done=True, site_score=8), 8, "leads"), (dict(), 8, "leads"),
    (dict(user_rating_count=None), 8, "leads"), (dict(score=0, has_reviews=False), 9, "pending"), (dict(score=40), 10, "manual"),
    (dict(score=10, has_audit=False), 11, "manual"), (dict(score=10), 12, "rejected"),
]


def test_verdict_cascade(spark):
    names = "pin_verdict string, pin_reason string, primary_type string, types array<string>, user_rating_count int, score int, exclusion string, has_audit boolean, fetch_error string, modern_framework string, site_status string, site_score int, dated_markers array<string>, psi_done boolean, has_reviews boolean"
    rows = [(i, *{**BASE, **c}.values()) for i, (c, _, _) in enumerate(CASES)]
    df = spark.createDataFrame(rows, "i int, " + names).withColumn("owner", F.struct("score", "exclusion"))
    got = df.select("i", verdict.decide().alias("v")).orderBy("i").collect()
    assert [(r["v"]["rule_no"], r["v"]["bucket"]) for r in got] == [(n, b) for _, n, b in CASES]
    assert all(r["v"]["reason"] for r in got if r["v"]["bucket"] == "rejected")


def name_signal():
    return F.struct(F.lit(0).alias("score"), F.lit(None).cast("string").alias("exclusion"), evidence(item("brand_marker", 28, F.lit("m"))).alias("evidence"))
EV = "array<struct<signal:string,weight:int,detail:string>>"


@pytest.fixture(scope="module")
def job(spark):
    places = spark.createDataFrame(
        [("a", "https://a.com/", "leads", 30), ("b", None, "no_site", 30), ("c", "https://c.com/", "manual", 30), ("d", "https://d.com/", "leads", 2)],
        "place_id string, website string, bucket string, user_rating_count int",
    ).withColumn("name", F.col("place_id")).withColumn("primary_type", F.lit("bakery")).withColumn("types", F.array(F.lit("store"))).withColumn("name_signal", name_signal())
    pages = spark.createDataFrame([("a", "home", "https://a.com/", "<title>t</title><p>привіт їжак єнот ґава</p>" + "x" * 3000), ("a", "junk", "https://a.com/j", "x")],
                                  "place_id string, role string, final_url string, html string")
    rev = spark.createDataFrame([("a", "uk", [("review_language", 30, "r")])], f"place_id string, preferred_lang string, evidence {EV}")
    psi = spark.createDataFrame([("a", 20, 30, 9000.0, 0.1)], "place_id string, mobile_score int, desktop_score int, lcp_ms double, cls double")
    pins = spark.createDataFrame([("c", "rejected", "seen by a person", dt.datetime(2026, 1, 2)), ("c", "leads", "older", dt.datetime(2026, 1, 1))],
                                 "place_id string, verdict string, reason string, at timestamp")
    return places, pages, rev, psi, pins


def test_rescore_keeps_pins_and_covers_every_place_once(job):
    out = {r["place_id"]: r for r in rescore(*job).collect()}
    assert set(out) == {"a", "b", "c", "d"}
    assert (out["c"]["bucket"], out["c"]["reject_reason"], out["c"]["rule_no"]) == ("rejected", "seen by a person", 1)
    assert out["a"]["owner"]["score"] == 28 + 30 + 40 and out["a"]["rule_no"] == 8
    assert out["d"]["rule_no"] == 3 and out["d"]["owner_score"] is None
    assert out["b"]["site_status"] == "no_site" and out["b"]["rule_no"] == 9


def test_rescore_is_idempotent_and_reads_old_audits_without_a_page(job):
    first = rescore(*job)
    again = rescore(first.select("place_id", "website", "bucket", "user_rating_count", "name", "primary_type", "types", "name_signal"), *job[1:])
    assert again.where(~F.col("old_bucket").eqNullSafe(F.col("bucket"))).count() == 0
    old = first.select("place_id", "audit", "site_signal", "version_evidence")
    places, pages, rev, psi, pins = job
    stored = rescore(places, pages.where("false"), rev, psi, pins, old_audits=old)
    assert {r["place_id"]: r["owner"]["score"] for r in stored.collect()}["a"] == 98


def test_reverdict_touches_changed_places_only_and_no_page(job, spark):
    changed = spark.createDataFrame([("a",)], "place_id string")
    state, pages, rev, psi, pins = job
    audits = reliable(audits_of(stored_facts(pages.where("role = 'home'") if "role" in pages.columns else pages)))
    again = reverdict(state, changed, audits, rev, psi, pins)
    assert not re.search(r"\bhtml#", again._jdf.queryExecution().optimizedPlan().toString())
    full = {r["place_id"]: r for r in rescore(state, pages, rev, psi, pins).collect()}
    (row,) = again.collect()
    assert row["place_id"] == "a" and (row["bucket"], row["owner_score"], row["site_score"]) == (full["a"]["bucket"], full["a"]["owner_score"], full["a"]["site_score"])


def test_review_points(one):
    F_ = one.F
    lang = [reviews.language_points(F_.lit(r), F_.lit(n)) for r, n in ((1.0, 3), (0.6, 1), (0.4, 0), (0.25, 0), (0.2, 5))]
    assert one(*lang) == (30, 20, 8, 5, 0)
    authors = [reviews.author_points(F_.lit(t), F_.lit(r), F_.lit(s)) for t, r, s in ((5, 0.6, 0), (5, 0.6, 3), (5, 0.0, 0), (0, 0.0, 0), (5, 0.2, 1))]
    assert one(*authors) == (45, 60, 0, 0, 26)


def test_author_tokens_do_not_leave_the_aggregation(spark):
    rows = [("p", t) for t in ("Zorba Quix", "Мяв", "Ђоке", "x", None, "Plain One")]
    df = spark.createDataFrame(rows, "place_id string, author_token string")
    out = reviews.author_stats(df, F.col("author_token").contains("Zorba"), DEFAULT.language)
    r = out.collect()[0]
    assert (r["authors"], r["matched"], r["in_script"]) == (4, 2, 1) and "author_token" not in out.columns


def test_heaviest_rule_wins_and_first_of_equals(one):
    F_ = one.F
    table = [rules.Rule("a", 22, "first"), rules.Rule("b", 28, "second"), rules.Rule("c", 28, "third")]
    got = one(*[rules.best_match(F_.lit(t), table)["label"] for t in ("ab", "cb", "a", "zzz")])
    assert got == ("second", "second", "first", None)


def test_rule_tables_are_read_whole_and_in_order(spark):
    big = spark.range(2500).select((-F.col("id")).alias("pos"), F.lit("x").alias("pattern"), F.lit(1).alias("weight"), F.col("id").cast("string").alias("label"))
    made = rules.rules_from(big)
    assert len(made) == 2500 and made[0].label == "2499"


def test_mentions_and_probes_add_evidence(job, spark):
    places, pages, rev, psi, pins = job
    found = spark.createDataFrame([("a", 30, 1)], "place_id string, mention_score int, mentions long")
    other = "<p>" + "їжак " * 60 + "</p>"
    extra = spark.createDataFrame([("c", "home", "https://c.com/", "<title>c</title><p>plain</p>" + "x" * 3000), ("c", "candidate", "https://c.com/uk/", other),
                                   ("a", "candidate", "https://a.com/uk/", other), ("a", "negotiated", "https://a.com/", other)],
                                  "place_id string, role string, final_url string, html string")
    answers = pages.unionByName(extra).withColumn("http_status", F.lit(200))
    out = {r["place_id"]: r for r in rescore(places, answers, rev, psi, pins, mentions=found, use_probes=True).collect()}
    signals = {k: [x["signal"] for x in r["owner"]["evidence"]] for k, r in out.items()}
    assert "accept_language_negotiation" in signals["a"] and "lang_route_confirmed" not in signals["a"]
    assert "contact_word_on_site" in signals["a"] and out["a"]["owner"]["score"] == 100
    assert "lang_route_confirmed" in signals["c"] and out["c"]["rule_no"] == 1
