"""Patterns over whole pages: any character is a dot that takes line ends too, and addresses are found in one search."""

import re

from pyspark.sql import functions as F

from sitegauge.functions import contacts, languages, markup, technology, text
from sitegauge.operators import mentions
from sitegauge.params import GlyphLanguage, LanguageProfile
from sitegauge.plans import rescore

# Ends of lines that a plain dot does not take, beside characters of two halves.
ENDS = "\n\r\u0085  \t😀 é"
PAGES = [
    f"a{ENDS}<script>1{ENDS}</SCRIPT>b<Script x>2</script >c</script>{ENDS}d<script>open{ENDS}e",
    f"<style>{ENDS}</style><STYLE>x</Style>k<noscript>{ENDS}</noscript><p{ENDS}>t<{ENDS}u",
    "</script><script></style><style>>", "<script", "x</script>", "", "<!--a--><!--b-->--><!--c", f"<!--{ENDS}-->z<!--y",
]


def cut(page, closing, opening, to):
    front = (re.match(rf"(?i)[\s\S]*{closing}", page) or [""])[0]
    return re.sub(opening, to, front) + page[len(front):]


def block(page, tag, to):
    return cut(page, f"</{tag}>", rf"(?i)<{tag}[\s\S]*?</{tag}>", to)


def test_blocks_are_dropped_over_all_line_ends(spark):
    html = F.col("html")
    got = spark.createDataFrame([(i, p) for i, p in enumerate(PAGES)], "i int, html string").select(
        "i", text.drop_blocks(html, "script", " ").alias("script"), text.drop_blocks(html, "style", "").alias("style"),
        text.drop_tags(html, "|").alias("tags"), text.normalize_html(html).alias("plain"),
    )
    for r in got.collect():
        page = PAGES[r["i"]]
        assert r["script"] == block(page, "script", " ") and r["style"] == block(page, "style", "")
        assert r["tags"] == cut(page, ">", r"<[^>]+>", "|")
        bare = cut(block(block(page, "script", ""), "style", ""), "-->", r"<!--[\s\S]*?-->", "")
        assert r["plain"] == re.sub(r"[ \t\n\x0b\f\r]+", " ", bare).strip(" ")


def test_titles_and_structured_blocks_span_line_ends(one):
    page = f"<TITLE x>a{ENDS}b</title><h1>c{ENDS}d</H1><script type='application/ld+json'>{{{ENDS}}}</script>"
    title, blocks = one(markup.title(F.lit(page)), mentions.structured_blocks(F.lit(page)))
    assert title == f"a{ENDS}b" and blocks == [f"{{{ENDS}}}"]
    assert one(mentions.near_role(F.lit(f"boss\n  Anna Berger{ENDS}"), "boss")) == ["Anna Berger"]


def test_no_pattern_of_a_page_takes_a_class_for_any_character(spark):
    html = F.col("html")
    df = spark.createDataFrame([("x",)], "html string").select(
        text.html_to_text(html), text.fingerprint(html), markup.title(html), markup.first_heading(html),
        mentions.structured_blocks(html), mentions.near_role(html, "boss"),
    )
    spark.conf.set("spark.sql.maxPlanStringLength", 10_000_000)
    try:
        assert r"[\s\S]" not in df._jdf.queryExecution().analyzed().toString()
    finally:
        spark.conf.unset("spark.sql.maxPlanStringLength")


def test_addresses_in_runs(one):
    told = lambda t: one(contacts.plain_addresses(F.lit(t)))
    assert told("x.a@b.com, é<c.d@e.org>f@g.net;@h.com i@ j@k@l.com m@n.com@o.net .%p@q.com") == [
        "x.a@b.com", "c.d@e.org", "f@g.net", "k@l.com", "m@n.com", "n.com@o.net", "p@q.com",
    ]
    assert told("no address") == [] and told("") == [] and told(None) is None
    run = "A" * 199
    packed = f"a {run} {run}B== {run}BCD===x/{run}+{run}== {run}B={run}C é{run}+/"
    assert one(contacts.strip_binary(F.lit(packed))) == re.sub(r"[A-Za-z0-9+/]{200,}+={0,2}", " ", packed)


def test_copyright_marks(one):
    for mark in ("©", "&copy;", "copyright", "(c)"):
        assert one(technology.footer_year(F.lit(f"c ( & {mark} 2011 <p> {mark} of 2014 c"), 2024)) == 2014
    assert one(technology.footer_year(F.lit("(d) 2011 &cop; 2012 copy 2013"), 2024)) is None


def test_blanks_are_collapsed_as_runs(one):
    for t in ("a  b\tc \n d e\x0b\x0cf\r\ng", " x ", "\t", "", "\u00a0 \u2003  y", "é \u0085\n"):
        assert one(text.collapse(F.lit(t))) == re.sub(r"[ \t\n\x0b\f\r]+", " ", t).strip(" ")


def test_years_in_ranges(one):
    found = one(F.regexp_extract_all(F.lit("2011 - 2013 1999–2001 2911-2012 1011-2013 219-2014 12005—2006"), F.lit(technology.YEAR_RANGE), F.lit(2)))
    assert found == ["2013", "2001", "2006"]


def test_letters_are_counted_without_the_plain_ones(one, spark):
    """Classes with plain letters are counted in the whole text, the others in what is left without ASCII characters."""
    profile = LanguageProfile(
        targets=(GlyphLanguage("fr", "french", "éœ", 40, 0.1), GlyphLanguage("xx", "mixed", "aé", 40, 0.1), GlyphLanguage("nn", "other", "^a", 40, 0.1)),
        script="\\u00C0-\\u024F", script_code="lat", excluded_pattern=("\\p{Ll}œ\\p{Ll}", "c", "l"),
    )
    for t, want in (("banané œuf aœb 😀é", (4, 5, 14, 4, 17, 1)), ("banana", (0, 0, 0, 0, 6, 0)), (None, (0, 0, 0, 0, None, 0))):
        assert tuple(one(languages.glyph_counts(F.lit(t).cast("string"), profile))) == want
    counts = languages.glyph_counts(F.col("text"), profile)
    plan = spark.createDataFrame([("x",)], "text string").select(counts)._jdf.queryExecution().analyzed().toString()
    assert plan.count("regexp_replace") >= 1


def test_pages_stay_where_they_are_while_places_are_left_out(spark):
    pages = spark.createDataFrame([("a", "1"), ("b", "2"), ("b", "3"), ("c", "4"), (None, "5"), (None, "6"), ("c", "7")], "place_id string, html string")
    gone = spark.createDataFrame([("b", 1), (None, 2), ("b", 3), ("z", 4)], "place_id string, n int")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        left = rescore.without_places(pages, gone)
        plan = left._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" not in plan and "hashpartitioning" not in plan
        assert left.columns == pages.columns and sorted(r["html"] for r in left.collect()) == ["1", "4", "5", "6", "7"]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
