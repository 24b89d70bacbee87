"""Merges, notes, publication and lexicons on literal rows; brute-force checks of the skew-safe operators."""

import datetime as dt

from pyspark.sql import functions as F

from sitegauge import texts
from sitegauge.operators import brief, lexicon, mentions, merge, notes, probes, publish, ranking, tasks
from sitegauge.params import DEFAULT


def test_row_numbers_of_a_hot_group_match_a_window(spark):
    rows = spark.range(5000).select(F.when(F.col("id") % 3 < 2, "hot").otherwise((F.col("id") % 7).cast("string")).alias("g"), (F.col("id") * 7919 % 101).alias("v"), "id")
    got = ranking.global_row_number(rows, ["g"], [F.col("v").desc(), F.col("id")], "n", slices=16)
    seen = {(r["g"], r["id"]): r["n"] for r in got.collect()}
    groups = {}
    for r in rows.collect():
        groups.setdefault(r["g"], []).append((-r["v"], r["id"]))
    for g, members in groups.items():
        for i, (_, key) in enumerate(sorted(members), start=1):
            assert seen[(g, key)] == i
    assert len(seen) == 5000


def test_hot_group_is_spread_over_slices(spark):
    rows = spark.range(4000).select(F.lit("hot").alias("g"), "id")
    slices = ranking._sliced(rows, ["g"], [F.col("id")], 8).groupBy("_slice").count().collect()
    assert len(slices) >= 6 and max(r["count"] for r in slices) < 1500


def test_running_sum_matches_brute_force(spark):
    rows = spark.range(1000).select((F.col("id") % 2).alias("g"), "id", (F.col("id") % 5).alias("v"))
    got = {r["id"]: r["s"] for r in ranking.global_running_sum(rows, ["g"], [F.col("id")], "v", "s", slices=8).collect()}
    for g in (0, 1):
        total = 0
        for i in range(g, 1000, 2):
            total += i % 5
            assert got[i] == total


def test_salted_lookup_equals_plain_lookup(spark):
    texts_df = spark.createDataFrame([(i, "zor blik " + ("mek" if i % 3 else "tok")) for i in range(60)], "id int, text string")
    words = spark.createDataFrame([("l", "target_a", "zor"), ("l", "major_a", "zor"), ("l", "target_b", "mek")], "lexicon string, role string, key string")
    plain = {r["id"]: (r["verdict"], r["matched"]) for r in lexicon.text_verdicts(texts_df, "id", "text", words, False).collect()}
    salted = {r["id"]: (r["verdict"], r["matched"]) for r in lexicon.text_verdicts(texts_df, "id", "text", words, False, most_rows=0).collect()}
    assert plain == salted and plain[1] == ("exclusive", "mek") and plain[0] == ("shared", "zor")


def test_exclusivity_rules(spark):
    held = {"ax": ["target_a"], "bx": ["target_a", "major_b"], "cx": ["target_a", "major_a"], "dx": ["target_b", "major_a"], "ex": ["target_b"],
            "fx": ["target_b", "major_b"], "gx": ["major_b"], "hx": ["minor"], "ix": ["target_b", "minor"], "jx": ["negative"]}
    rows = [("l", role, key) for key, roles in held.items() for role in roles]
    got = {r["key"]: r["verdict"] for r in lexicon.key_verdicts(spark.createDataFrame(rows, "lexicon string, role string, key string")).collect()}
    assert got == {"ax": "exclusive", "bx": "exclusive", "cx": "shared", "dx": "foreign", "ex": "exclusive", "fx": "shared", "gx": "foreign",
                   "hx": "foreign", "ix": "exclusive", "jx": "unknown"}


def test_classification_cascade(spark):
    titles = [("l", r, t) for r, t in (("curated", "Blimko"), ("negative", "Blimko"), ("negative", "Narvo"), ("target_a", "Zelph"), ("target_b", "Quark"),
                                       ("major_b", "Quark"), ("major_a", "Smolt"), ("curated_second", "Petrona"))]
    words = lexicon.prepare_lexicon(spark.createDataFrame(titles, "lexicon string, role string, title string"))
    cases = ["Ann Blimko", "Ann Narvo", "Ann Zelph", "Ann Quark", "Ann Trumpenko", "Smolt", "Petrona Doe", "Garden", "ab", "x" * 80, "Ann Trumpov"]
    df = spark.createDataFrame(list(enumerate(cases)), "id int, text string")
    person = lexicon.Cascade(strong_suffix="(?i)enko$", weak_suffix="(?i)ov$", negative_patterns=("(?i)garden",))
    got = {cases[r["id"]]: (r["ok"], r["strong"], r["via"]) for r in lexicon.classify_texts(df, "id", "text", words, person).collect()}
    assert got["Ann Blimko"] == (True, True, "list") and got["Ann Narvo"] == (False, False, "none")
    assert got["Ann Zelph"] == (True, True, "lexicon") and got["Ann Quark"] == (True, False, "lexicon-shared")
    assert got["Ann Trumpenko"] == (True, True, "suffix") and got["Ann Trumpov"] == (True, False, "suffix-weak")
    assert got["Petrona Doe"][2] == "list" and not any(got[c][0] for c in ("Smolt", "Garden", "ab", "x" * 80))
    firm = lexicon.Cascade(business=True, block_words=("trumpenko",), strong_suffix="(?i)enko$", weak_suffix="(?i)ov$")
    names = spark.createDataFrame([(0, "Trumpenko"), (1, "Trumpov"), (2, "Petrona")], "id int, text string")
    assert not any(r["ok"] for r in lexicon.classify_texts(names, "id", "text", words, firm).collect())


def test_prepared_lexicon_drops_phrases_and_service_pages(spark):
    rows = [("l", "minor", t) for t in ("Zelph", "zelph ", "Zélph", "Two Words", "Category:Zelphs", "ab")]
    keys = lexicon.prepare_lexicon(spark.createDataFrame(rows, "lexicon string, role string, title string"))
    assert [r["key"] for r in keys.collect()] == ["zelph"]


def test_mentions_near_a_role(spark, one):
    text = F.lit("Zed Quorbin, owner of the shop. " + "word " * 20 + "Some Customer said it was fine. " + "word " * 20 + "attorney Mira Valtor and Gorn Pelk")
    got = one(mentions.near_role(text, "(?:owner|attorney)"))
    assert got == ["Zed Quorbin", "Mira Valtor", "Gorn Pelk"]
    html = '<script type="application/ld+json">{"@type":"Person","name":"Zed Quorbin","knows":[{"founder":{"name":"Mira Valtor"}},{"name":"Not This"}]}</script>'
    df = spark.createDataFrame([(1, html), (2, '<script type="application/ld+json">broken</script>')], "id int, html string")
    assert sorted(r["candidate"] for r in mentions.structured_names(df, "id").collect()) == ["Mira Valtor", "Zed Quorbin"]
    assert one(mentions.email_words(F.array(F.lit("zed.quorbin99@a.com")))) == ["quorbin"]
    assert one(mentions.copyright_words(F.lit("x &copy; 2015 - 2020 Quorbin Ltd"))) == ["Quorbin"]
    hits = spark.createDataFrame([(1, "role", True, True), (1, "structured", True, False), (2, "role", True, False), (3, "structured", True, True)],
                                 "id int, source string, ok boolean, strong boolean")
    assert {r["id"]: r["mention_score"] for r in mentions.mention_score(hits, "id").collect()} == {1: 25, 2: 0, 3: 30}


def test_notes_survive_a_rejection_and_a_move(spark):
    """A worked-on row that is rejected stays where it was, with its note and a warning."""
    state = spark.createDataFrame([("a", "leads", None), ("b", "rejected", "weak"), ("c", "manual", None), ("d", "rejected", "weak")],
                                  "place_id string, bucket string, reject_reason string")
    placed = spark.createDataFrame([("b", "Leads", 4), ("c", "Leads", 5), ("d", "Leads", 6)], "place_id string, tab string, row_index long")
    written = spark.createDataFrame(
        [("b", "Leads", "Угода", "olga", "1", "call"), ("c", "Leads", "", "", "", "moved"), ("c", "Manual review", "", " ", None, ""), ("d", "Leads", "", "", "", "")],
        "place_id string, tab string, status string, owner string, date string, note string")
    kept = notes.collect_notes(written)
    out = notes.attach_notes(publish.publication(state, kept, placed), kept)
    got = {r["place_id"]: r for r in out.collect()}
    assert (got["b"]["tab"], got["b"]["kept_for_notes"], got["b"]["note"]) == ("Leads", True, "call")
    assert (got["c"]["tab"], got["c"]["note"]) == ("Manual review", "moved") and "d" not in got
    warning = state.select("place_id", notes.warning_note(F.col("bucket"), F.col("reject_reason")).alias("w")).where("place_id = 'b'").collect()[0]["w"]
    assert warning.startswith("увага:") and "weak" in warning


def test_clear_and_repair(spark):
    rows = spark.createDataFrame([("a", "Leads", "olga", "45123", "x", "n"), ("b", "Leads", "Угода", "olga", None, None)],
                                 "place_id string, tab string, status string, owner string, date string, note string")
    fixed = {r["place_id"]: (r["status"], r["owner"]) for r in notes.repair_shifted(rows).collect()}
    assert fixed == {"a": ("", "olga"), "b": ("Угода", "olga")}
    assert notes.clear_preview(rows).collect()[0]["rows"] == 2
    assert all(r[f] is None for r in notes.clear_notes(rows).collect() for f in notes.FIELDS)


def test_written_tabs_read_back(spark, tmp_path):
    rows = spark.createDataFrame([("a", "Leads"), ("b", "Rejected")], "place_id string, tab string")
    publish.write_tabs(rows, str(tmp_path / "v1"))
    assert spark.read.parquet(str(tmp_path / "v1")).where("tab = 'Leads'").collect()[0]["place_id"] == "a"


def test_pins_are_set_replaced_and_cleared(spark):
    pins = spark.createDataFrame([("a", "leads", "old", dt.datetime(2026, 1, 1))], "place_id string, verdict string, reason string, at timestamp")
    new = spark.createDataFrame([("a", "rejected", "new"), ("b", "leads", "x")], "place_id string, verdict string, reason string")
    out = merge.set_pins(pins, new, F.lit("2026-02-01").cast("timestamp"))
    assert {r["place_id"]: r["verdict"] for r in out.collect()} == {"a": "rejected", "b": "leads"}
    assert [r["place_id"] for r in merge.clear_pins(out, spark.createDataFrame([("a",)], "place_id string")).collect()] == ["b"]


def test_quota_lets_the_first_calls_through(spark):
    log = spark.range(50).select(F.col("id").alias("event_id"), F.lit("place_details").alias("api"),
                                 (F.lit("2026-01-01").cast("timestamp") + F.make_dt_interval(mins=F.col("id"))).alias("ts"), F.lit(1).alias("n"))
    cut = tasks.quota_cut(log, {"place_details": 20})
    assert sorted(r["event_id"] for r in cut.where("admitted").collect()) == list(range(20))


def test_route_must_differ_from_home_and_junk(spark):
    other = "<p>" + "їжак " * 60 + "</p>"
    rows = [("s", "home", "u/", 200, "<p>home</p>"), ("s", "junk", "u/zz", 200, "<p>nothing here</p>"), ("s", "candidate", "u/uk/", 200, other),
            ("s", "candidate", "u/ru/", 200, "<p>home</p>"), ("s", "candidate", "u/ua/", 200, "<p>nothing here</p>"),
            ("s", "candidate", "u/x/", 200, "<h1>Сторінку не знайдено</h1>" + other), ("s", "candidate", "u/y/", 404, other), ("s", "negotiated", "u/", 200, other)]
    df = spark.createDataFrame(rows, "place_id string, role string, final_url string, http_status int, html string")
    df = probes.stored_answers(df, DEFAULT)
    assert [(r["url"], r["lang"]) for r in probes.confirmed_routes(df, DEFAULT).collect()] == [("u/uk/", "uk")]
    assert [r["lang"] for r in probes.negotiated(df, DEFAULT).collect()] == ["uk"]


def test_brief_says_nothing_about_a_site_nobody_saw(spark):
    a = F.struct(*[F.lit(v).cast(t).alias(k) for k, v, t in (
        ("builder", "Wix", "string"), ("cms", None, "string"), ("modern_framework", None, "string"), ("tech_stack", None, "array<string>"),
        ("page_count", 7, "int"), ("unique_page_types", 3, "int"), ("has_ecommerce", True, "boolean"), ("has_catalog", True, "boolean"),
        ("has_forms", True, "boolean"), ("languages", 1, "int"), ("fetch_error", None, "string"), ("http_status", 200, "int"),
        ("has_viewport", False, "boolean"), ("https", True, "boolean"), ("tls_expired", False, "boolean"), ("mixed_content", False, "boolean"),
        ("has_flash", False, "boolean"), ("table_layout", False, "boolean"), ("jquery_version", "1.9", "string"), ("footer_year", 2016, "int"),
        ("meta_description", None, "string"), ("og_tags", False, "boolean"))])
    base = dict(kind=F.lit("Пекарня"), retail=F.lit(True), location=F.lit("Reno, NV"), rating=F.lit("4.5"), reviews=F.lit(212), website=F.lit("https://a.com"),
                site_status=F.lit("ok"), dated_markers=F.array(F.lit("m")), mobile_score=F.lit(None).cast("int"), desktop_score=F.lit(None).cast("int"),
                lcp_ms=F.lit(None).cast("int"), note=F.lit(""), language_note=F.lit(None).cast("string"))
    say = lambda **kw: spark.range(1).select(brief.brief(a, {**base, **kw}, 2026).alias("b")).collect()[0]["b"]
    assert say() == (
        "Пекарня, Reno, NV. Рейтинг 4.5, відгуків: 212. Основа: Wix. Сторінок 7, різних видів 3. Має: продаж онлайн, форму запиту. "
        "Недоліки: незручний на телефоні, стара jQuery 1.9, останній рік унизу сторінки: 2016. Перша тема: вигляд на телефоні."
    )
    blocked = say(site_status=F.lit("blocked"))
    assert "Недоліки" not in blocked and "Wix" not in blocked
    assert "Власної сторінки не має" in say(website=F.lit(None).cast("string"))
    assert "Людина вже дивилась: float." in say(note=F.lit("ручний розбір: float"))
    other = {k: f"{k} %s %s"[: len(k) + 3 * v.count("%s")] for k, v in texts.BRIEF.items()}
    said = spark.range(1).select(brief.brief(a, base, 2026, other).alias("b")).collect()[0]["b"]
    assert said.startswith("place_at Пекарня Reno, NV rated 4.5 212") and said.endswith("open_phone")


def test_published_texts_have_every_column(spark):
    assert len(texts.MACHINE_COLUMNS) == 23 and len(set(texts.MACHINE_COLUMNS)) == 23
