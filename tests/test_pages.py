import time

import pytest
from pyspark.sql import functions as F

from sitegauge.functions import languages
from sitegauge.params import DEFAULT
from sitegauge.plans.rescore import page_columns, page_facts

FULL = """<!DOCTYPE html><html lang="uk"><head><meta content='width=device-width' name='viewport'>
<title> My &amp; Shop </title><meta content="About us" name="description"><link href="/i.ico" rel="shortcut icon">
<meta property="og:title" content="x"><link rel="alternate" hreflang="ru" href="/ru/">
<script src="/js/jquery-1.11.3.min.js"></script><link href="/wp-content/bootstrap/3.3/b.css">
<link href="https://fonts.googleapis.com/css?family=X"></head><body><h1>Head <b>line</b></h1>
<a href="/services/roof">r</a><a href="/services/tile">t</a><a href="about.html">a</a><a href="https://other.com/x">o</a>
<a href="/pic.jpg">p</a><a href="mailto:info@firm.com">m</a><form action="/s"><input name=q></form>
<a href="viber://chat?number=1">v</a><footer>&copy; 2012-2016 Firm</footer></body></html>"""


@pytest.fixture(scope="module")
def audits(spark):
    pages = {
        "full": ("https://www.firm.com/", FULL),
        "bare": ("http://bare.org/a", "<p>hello</p>"),
        "nested": ("https://n.com/", "<table><tr><td><table></table><table></table></td></tr></table>"),
        "flat": ("https://f.com/", "<table></table><table></table><table></table>"),
        "modern": ("https://m.com/", '<script id="__NEXT_DATA__"></script><div class="p md:flex">'),
        "script_cart": ("https://c.com/", '<script src="https://pay.example/checkout.js"></script>'),
        "shop": ("https://s.com/", '<a href="/cart">c</a><button class="add-to-cart">'),
        "icon": ("https://i.com/", '<i class="fa fa-viber"></i> our telegram channel'),
        "phone": ("https://p.com/", "<p>call 312-755-9123 or 7 912 345 67 89</p>"),
        "serbian": ("https://q.com/", "<p>ђаче " + "привіт " * 20 + "</p>"),
        "many": ("https://l.com/", '<html lang="en">' + "".join(
            f'<link rel="alternate" hreflang="{c}" href="/{c}/">' for c in ("uk", "de", "fr", "es", "it", "pl"))),
    }
    rows = [(k, u, h) for k, (u, h) in pages.items()]
    df = page_facts(spark.createDataFrame(rows, "place_id string, final_url string, html string"), DEFAULT)
    return {r["place_id"]: r for r in df.collect()}


def test_metadata_with_any_attribute_order(audits):
    a = audits["full"]["audit"]
    assert (a["title"], a["meta_description"], a["h1"]) == ("My & Shop", "About us", "Head line")
    assert a["has_viewport"] and a["og_tags"] and a["favicon"] and a["https"] and not a["mixed_content"]
    b = audits["bare"]["audit"]
    assert not any(b[k] for k in ("has_viewport", "og_tags", "favicon", "https", "charset_declared")) and b["title"] is None


def test_technology(audits):
    a = audits["full"]["audit"]
    assert (a["cms"], a["jquery_version"], a["bootstrap_major"], a["footer_year"]) == ("WordPress", "1.11.3", 3, 2016)
    assert a["tech_stack"] == ["WordPress", "jQuery 1.11.3", "Bootstrap 3", "Google Fonts (legacy)"]
    assert audits["modern"]["audit"]["modern_framework"] == "Next.js"


def test_table_layout_needs_nesting(audits):
    assert audits["nested"]["audit"]["table_layout"] and not audits["flat"]["audit"]["table_layout"]


def test_structure(audits):
    a = audits["full"]["audit"]
    assert a["page_count"] == 5 and a["unique_page_types"] == 4 and a["has_catalog"] and a["has_forms"]
    assert not audits["script_cart"]["audit"]["has_ecommerce"] and audits["shop"]["audit"]["has_ecommerce"]
    assert a["emails"] == ["info@firm.com"]


def test_declared_languages(audits):
    ev = {e["signal"]: e["weight"] for e in audits["full"]["declared_evidence"]}
    assert ev == {"hreflang_slavic": 45, "html_lang": 30, "lang_switcher_link": 35}
    many = {e["signal"]: e["weight"] for e in audits["many"]["declared_evidence"]}
    assert many["hreflang_slavic"] == 5


def test_messengers_need_a_link(audits):
    signals = {e["signal"] for e in audits["full"]["site_signal"]["evidence"]}
    assert "viber_contact" in signals
    assert audits["icon"]["site_signal"]["evidence"] == []


def test_domestic_numbers_are_no_evidence(audits):
    assert audits["phone"]["site_signal"]["evidence"] == []


def test_excluded_letters(audits):
    s = audits["serbian"]["site_signal"]
    assert s["hard_exclusion"] == "serbian_glyphs" and s["score"] == 0 and s["lang"] is None


def test_observed_language(spark):
    rows = [("uk", "Їжак і єнот їдять ґрунт " * 5), ("ru", "Это мы и съел объявление ёж " * 5), ("en", "plain words")]
    df = spark.createDataFrame([(k, "https://a.com/", f"<p>{t}</p>") for k, t in rows], "place_id string, final_url string, html string")
    got = {r["place_id"]: r["site_signal"] for r in page_facts(df).collect()}
    assert got["uk"]["lang"] == "uk" and got["ru"]["lang"] == "ru" and got["en"]["lang"] is None
    assert [e["signal"] for e in got["uk"]["evidence"]] == ["ukrainian_glyphs"]
    assert got["ru"]["evidence"][0]["weight"] == 35


def test_currency_word_keeps_its_bounds(one):
    pattern = [p for p in DEFAULT.language.patterns if p[0] == "uah_currency"][0][3]
    got = one(*[F.lit(t).rlike(pattern) for t in ("100 грн", "100грн.", "загрнути", "₴5")])
    assert got == (True, True, False, True)


def test_pathological_page_stays_fast(spark):
    """Long runs of one kind of character must not make a pattern backtrack."""
    n = 500_000
    bodies = ["a" * n, "A+/=" * (n // 4), "<" * n, "<table " * (n // 7), 'href="' * (n // 6), "a." * (n // 2) + "@", " at" * (n // 3)]
    rows = [(f"p{i}", "https://a.com/", b) for i, b in enumerate(bodies)]
    df = spark.createDataFrame(rows, "place_id string, final_url string, html string").repartition(7)
    started = time.time()
    page_facts(df).write.format("noop").mode("overwrite").save()
    assert time.time() - started < 90


def test_features_need_no_shuffle_and_only_asked_columns_are_computed(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet").select(
        F.col("page_id").cast("string").alias("place_id"), F.col("url").alias("final_url"), "html"
    )
    plan = page_columns(pages).select("place_id", "https")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "html" not in plan.split("ReadSchema")[1]


def test_declared_codes_are_read_from_routes(one):
    html = F.lit('<a href="/de/"><a href="/fr/about"><a href="/x?lang=es"><a href="/it/?p">')
    got = one(languages.declared(html, F.lower(html), DEFAULT.language))
    assert sorted(got["routes"]) == ["de", "es", "it"]


def test_rows_are_dealt_out_evenly(spark):
    from sitegauge.session import spread

    sizes = spread(spark.range(0, 8000, 1, 1)).groupBy(F.spark_partition_id()).count().collect()
    assert len(sizes) == 8 and {r["count"] for r in sizes} == {1000}
