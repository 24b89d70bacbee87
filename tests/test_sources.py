import json

from pyspark.sql import functions as F

from sitegauge.sources import readers


def test_places_and_defaults(spark, tmp_path):
    body = {"places": [{"id": "a", "displayName": {"text": "A"}, "location": {"latitude": 1.5, "longitude": 2.5}, "types": ["x"], "userRatingCount": 3},
                       {"id": "b"}], "nextPageToken": "t"}
    (tmp_path / "r.json").write_text(json.dumps(body))
    rows = {r["place_id"]: r for r in readers.read_places(spark, str(tmp_path)).collect()}
    assert rows["a"]["lat"] == 1.5 and rows["a"]["types"] == ["x"]
    assert (rows["b"]["name"], rows["b"]["lat"], rows["b"]["types"], rows["b"]["website"]) == ("", 0.0, [], None)


def test_reviews_carry_no_text(spark, tmp_path):
    body = {"id": "a", "reviews": [{"originalText": {"languageCode": "uk", "text": "secret"}, "rating": 5, "publishTime": "2025-01-02T03:04:05Z"}]}
    (tmp_path / "r.json").write_text(json.dumps(body))
    df = readers.read_reviews(spark, str(tmp_path))
    r = df.collect()[0]
    assert r["language_code"] == "uk" and r["publish_time"].year == 2025 and "secret" not in str(r)


def test_page_speed_prefers_mobile(spark):
    answer = lambda s, l: json.dumps({"lighthouseResult": {"categories": {"performance": {"score": s}}, "audits": {"largest-contentful-paint": {"numericValue": l}}}})  # noqa: E731, E741
    df = spark.createDataFrame([("a", answer(0.235, 4000.0), answer(0.9, 1000.0)), ("b", None, answer(0.5, 1500.0))], "place_id string, mobile string, desktop string")
    got = {r["place_id"]: (r["mobile_score"], r["desktop_score"], r["lcp_ms"]) for r in readers.page_speed_from(df).collect()}
    assert got == {"a": (24, 90, 4000.0), "b": (None, 50, 1500.0)}


def test_cached_pages_tolerate_a_broken_file(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"finalUrl": "https://a.com/", "fetchedAt": "2026-01-01T00:00:00Z", "html": "<p>"}))
    (tmp_path / "b.json").write_text("{broken")
    (tmp_path / "c.json").write_text("")
    (tmp_path / "d.json").write_text('{"finalUrl": "https://d.com/"}')
    (tmp_path / "e.json").write_text('[1]')
    got = {r["place_id"]: (r["html"], r["state"]) for r in readers.read_cached_pages(spark, str(tmp_path)).collect()}
    assert got.pop("a") == ("<p>", "page") and got.pop("d") == (None, "no page") and got.keys() <= {"b", "c", "e"}
    assert got["b"] == (None, "broken") and all(html is None for html, _ in got.values())


def test_ten_thousand_small_files_are_a_few_tasks(spark, tmp_path):
    for i in range(10_000):
        (tmp_path / f"k{i}.json").write_text("{" if i % 1000 == 7 else '{"html": "<p>%d"}' % i)
    pages = readers.read_cached_pages(spark, str(tmp_path))
    assert pages.rdd.getNumPartitions() <= 8
    by_state = {r["state"]: r["count"] for r in pages.groupBy("state").count().collect()}
    assert by_state == {"page": 9990, "broken": 10}


def test_site_maps_are_read_once(spark, tmp_path):
    rows = [("a", "https://a/sitemap.xml", "<sitemapindex><loc>https://a/m.xml</loc></sitemapindex>"), ("a", "https://a/m.xml", "<urlset><loc>https://a/p</loc></urlset>")]
    spark.createDataFrame(rows, "place_id string, url string, xml string").write.parquet(str(tmp_path / "maps"))
    out = readers.sitemap_urls(spark.read.parquet(str(tmp_path / "maps")))
    assert "FileScan" not in out._jdf.queryExecution().executedPlan().toString() and [r["page_url"] for r in out.collect()] == ["https://a/p"]


def test_keyed_config_skips_comments_and_the_byte_order_mark(spark, tmp_path):
    body = {"_comment": "x", "chicago": {"label": "Chicago IL", "_note": "y", "hoods": [{"name": "A", "radiusM": 5}]}}
    (tmp_path / "m.json").write_text("﻿" + json.dumps(body), encoding="utf-8")
    rows = readers.read_keyed_config(spark, str(tmp_path / "m.json"), "label string, hoods array<struct<name:string,radiusM:int>>", "metro_key").collect()
    assert [(r["metro_key"], r["label"], r["hoods"][0]["radiusM"]) for r in rows] == [("chicago", "Chicago IL", 5)]


def test_lexicon_files(spark, tmp_path):
    (tmp_path / "l.json").write_text(json.dumps({"category": "c", "role": "minor", "keys": ["Zelph", "Two Words", "ab"]}))
    assert [(r["lexicon"], r["role"], r["key"]) for r in readers.read_lexicon(spark, str(tmp_path)).collect()] == [("c", "minor", "zelph")]


def test_legacy_charsets(spark, tmp_path):
    text = "Привіт"
    for name, charset, label in (("a", "cp1251", "windows-1251"), ("b", "utf-8", "utf-8"), ("c", "koi8-r", "koi8-r"), ("d", "utf-8", "nonsense")):
        body = text.replace("і", "и") if charset == "koi8-r" else text
        (tmp_path / f"{name}.html").write_bytes(b'<meta charset="' + label.encode() + b'">' + body.encode(charset))
    got = {r["path"][-6]: r["html"].split(">")[1] for r in readers.read_raw_pages(spark, str(tmp_path)).collect()}
    assert got == {"a": text, "b": text, "c": "Привит", "d": text}


def test_notes_and_placement_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([("a", "Leads", 1)], "place_id string, tab string, row_index long")
    readers.write_placement(rows.withColumn("extra", F.lit(1)), str(tmp_path / "p"))
    assert spark.read.parquet(str(tmp_path / "p")).columns == ["place_id", "tab", "row_index"]
    rows.select("place_id", "tab").withColumn("note", F.lit("n")).write.parquet(str(tmp_path / "n"))
    assert readers.read_notes(spark, str(tmp_path / "n")).collect()[0]["note"] == "n"
