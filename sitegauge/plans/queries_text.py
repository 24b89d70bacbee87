"""Registered queries: lexicons, rules, reviews, evidence, the re-score job, probes, sources."""

from __future__ import annotations

import dataclasses
import datetime as dt
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sitegauge.functions.evidence import as_text, evidence, item_when
from sitegauge.functions.text import KEY_RULES, html_to_text
from sitegauge.functions.urls import host_of
from sitegauge.operators import display, lexicon, mentions, probes, reports, reviews, rule_index, rules, verdict
from sitegauge.params import DEFAULT, GlyphLanguage, LanguageProfile
from sitegauge.plans import checks
from sitegauge.plans.export_sql import export_sql
from sitegauge.plans.facts import facts_by_content
from sitegauge.plans.inputs import prelude, table, with_types
from sitegauge.plans.profiles import CATEGORY_RULES, NAME_RULES, PART_RULES, TRIAL
from sitegauge.plans.queries_pages import DECLARED, SIGNALS, responses
from sitegauge.plans.rescore import audits_of, stored_facts, without_places
from sitegauge.plans.rescore import rescore as rescore_job
from sitegauge.plans.rescore import reverdict as reverdict_job
from sitegauge.session import ensure_checkpoint_dir, reliable, spread
from sitegauge.schemas import REVIEW_RESPONSE, SEARCH_RESPONSE
from sitegauge.sources import readers

# Reviews of the test data end in the nineties.
REVIEW_PRESET = dataclasses.replace(DEFAULT, as_of=dt.date(1999, 6, 1))
# Letters of the order status and priority stand for scripts and languages.
LETTERS = LanguageProfile(
    targets=(GlyphLanguage("uk", "first", "U", 1, 0.0), GlyphLanguage("ru", "second", "M", 1, 0.0)),
    script="F", script_code="f", excluded_glyphs=(("L", "low", "low"),),
)
LANG_ROLES = (("fr", "target_a"), ("de", "target_b"), ("en", "major_a"), ("es", "major_b"))
SPLIT = lexicon.TOKEN_SPLIT


# --- lexicons --------------------------------------------------------------------
def _titles(spark: SparkSession, sf: str) -> DataFrame:
    """Blank-separated words of every document as titles, its language as the role."""
    docs = table(spark, sf, "documents")
    return docs.select(
        F.col("source").alias("lexicon"), F.col("lang").alias("role"), F.explode(F.split("text", r"\s+")).alias("title")
    )


def lexicon_prepare(spark, sf):
    keys = lexicon.prepare_lexicon(_titles(spark, sf))
    return keys.groupBy("role").agg(
        F.count_distinct("key").alias("keys"), F.min("key").alias("first_key"), F.max("key").alias("last_key"),
        F.count("*").alias("entries"),
    )


def _word_lists(spark: SparkSession, sf: str) -> DataFrame:
    """Word lists by language out of all documents."""
    role = F.when(F.lit(False), "")
    for code, name in LANG_ROLES:
        role = role.when(F.col("lang") == code, name)
    words = table(spark, sf, "documents").select(F.col("lang").alias("lexicon"), role.alias("role"), F.explode(F.split(F.lower("text"), SPLIT)).alias("key"))
    return words.where(F.length("key") >= 3).distinct()


def key_verdicts(spark, sf):
    return lexicon.key_verdicts(_word_lists(spark, sf)).groupBy("verdict").agg(F.count("*").alias("n"))


def _turns(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), "text")


def text_verdicts(spark, sf):
    return lexicon.text_verdicts(_turns(spark, sf), "id", "text", _word_lists(spark, sf), normalise=False)


def text_verdicts_salted(spark, sf):
    """Same result by the join that spreads measured hot words, for lexicons that cannot be broadcast."""
    return lexicon.text_verdicts(_turns(spark, sf), "id", "text", _word_lists(spark, sf), normalise=False, most_rows=0).groupBy(
        "verdict"
    ).agg(F.count("*").alias("n"))


CASCADE = lexicon.Cascade(
    max_len=10**7, negative_patterns=(r"(?i)eauou",), strong_suffix="(?i)(?:ent|tion|ung)$", weak_suffix="(?i)[aeiou]$"
)


def text_classes(spark, sf):
    """The ordered cascade over conversation turns with word lists of the benchmark items."""
    items = table(spark, sf, "benchmark")
    role = (
        F.when(F.col("item_id") % 4 == 0, "curated").when(F.col("item_id") % 4 == 1, "major_a")
        .when(F.col("item_id") % 4 == 2, "target_b").otherwise("negative")
    )
    words = items.select(role.alias("role"), F.explode(F.split("text", r"\s+")).alias("title"), F.lit("b").alias("lexicon"))
    long_words = words.where(F.length("title") >= 12)
    out = lexicon.classify_texts(_turns(spark, sf), "id", "text", lexicon.prepare_lexicon(long_words), CASCADE)
    return out.groupBy("ok", "strong", "via").agg(F.count("*").alias("n"))


# --- rules -----------------------------------------------------------------------
def rule_best_match(spark, sf):
    """The heaviest rule of a table that matches a part's name; null where none does."""
    parts = table(spark, sf, "part")
    found = rule_index.rule_matches(parts, "p_partkey", "p_name", rule_index.rule_table(spark, PART_RULES))
    return parts.select("p_partkey").join(rule_index.strongest(found, "p_partkey"), "p_partkey", "left")


def rule_join(spark, sf):
    """How many conversation turns each rule matches; every long word of the benchmark is a rule, with some of other kinds."""
    words = table(spark, sf, "benchmark").select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{7,}"), F.lit(0))).alias("w")).distinct()
    other = F.when(F.length("w") % 3 == 0, F.concat(F.lit("(?i)(?:"), "w", F.lit("|no such thing)"))).otherwise(
        F.concat(F.lit("(?i)(?:^|[^a-z])"), F.substring("w", 1, 5), F.lit("[a-z]*"))
    )
    pattern = F.when(F.length("w") % 2 == 0, F.concat(F.lit("(?i)(?:^|[^a-z])"), "w", F.lit("(?:$|[^a-z])"))).otherwise(other)
    made = words.select(F.col("w").alias("pos"), pattern.alias("pattern"), F.length("w").alias("weight"), F.col("w").alias("label"))
    bare = spark.range(1).select(F.lit("~").alias("pos"), F.lit("[0-9]{3}").alias("pattern"), F.lit(1).alias("weight"), F.lit("three digits").alias("label"))
    found = rule_index.rule_matches(_turns(spark, sf), "id", "text", made.unionByName(bare))
    return found.groupBy("label").agg(F.count("*").alias("hits"), F.min("id").alias("first_id"))


def rule_hits(spark, sf):
    return rules.rule_hits(table(spark, sf, "part"), "p_partkey", F.col("p_name"), PART_RULES)


def _with_names(rows: DataFrame) -> DataFrame:
    texts = rules.text_signal(rows, F.col("name"), host_of(F.col("website")), NAME_RULES, "text_signal")
    kinds = rules.category_signal(texts, F.col("primary_type"), CATEGORY_RULES, "category")
    return verdict.combine_name_and_type(kinds, "text_signal", "category", "name_signal").drop("text_signal", "category")


def name_signals(spark, sf):
    s = F.col("name_signal")
    return _with_names(with_types(table(spark, sf, "places"))).select(
        "place_id", s["score"].alias("score"), s["exclusion"].alias("exclusion"),
        F.array_join(F.transform(s["evidence"], lambda e: F.concat(e["signal"], F.lit("+"), e["weight"])), ";").alias("signals"),
    )


# --- reviews ---------------------------------------------------------------------
def _counts(spark, sf):
    return reviews.language_counts(table(spark, sf, "reviews"), ("uk", "ru"), REVIEW_PRESET.as_of)


def _authors(spark, sf):
    return reviews.author_stats(table(spark, sf, "reviews"), F.col("author_token").startswith("O"), LETTERS)


def review_languages(spark, sf):
    return _counts(spark, sf).select("place_id", "sample_size", "n_uk", "n_ru", "n_target", "recent_target", "ratio")


def author_totals(spark, sf):
    return _authors(spark, sf).select("place_id", "authors", "matched", "in_script", "author_ratio", "author_lang")


def _review_signal(spark, sf):
    preset = dataclasses.replace(REVIEW_PRESET, language=LETTERS)
    return reviews.review_signal(_counts(spark, sf), _authors(spark, sf), preset)


def review_signal(spark, sf):
    ev = F.transform(F.col("evidence"), lambda e: F.concat(e["signal"], F.lit("+"), e["weight"]))
    return _review_signal(spark, sf).select(
        "place_id", "score", "preferred_lang", "recent_target", "author_script", F.array_join(ev, ";").alias("signals")
    )


# --- evidence and scores ---------------------------------------------------------
def _evidence(spark, sf):
    """Evidence lists per place out of its key and counts."""
    k = F.col("c_custkey")
    rows = _with_names(with_types(table(spark, sf, "state")))
    versions = evidence(
        item_when(k % 2 == 0, "alternate", 18, F.lit("alternate fr")), item_when(k % 3 == 0, "route", 32, F.lit("route de")),
        item_when(k % 5 == 0, "switch", 32, F.lit("switch fr")),
    )
    site = F.struct(
        F.when(k % 4 == 0, "fr").alias("lang"), F.when(k % 29 == 0, "org_domain").alias("hard_exclusion"),
        evidence(item_when(k % 7 < 3, "phone", 45, F.lit("phone")), item_when(k % 31 == 0, "note", 0, F.lit(None).cast("string"))).alias("evidence"),
    )
    seen = F.struct(
        F.when(k % 6 == 0, "de").alias("preferred_lang"),
        evidence(item_when(k % 11 < 4, "review_language", 25, F.lit("5/5"))).alias("evidence"),
    )
    rows = rows.withColumn("site", site).withColumn("seen", seen).withColumn("versions", versions)
    return verdict.owner_score(rows, "site", "seen", "name_signal", "versions", TRIAL)


def owner_scores(spark, sf):
    o = F.col("owner")
    return _evidence(spark, sf).select(
        "place_id", o["score"].alias("score"), o["lang"].alias("lang"), o["exclusion"].alias("exclusion"),
        o["bucket"].alias("bucket"), as_text(o["evidence"]).alias("evidence_text"),
    )


def evidence_top(spark, sf):
    return reports.evidence_frequency(_evidence(spark, sf).select(F.col("owner")["evidence"].alias("evidence")))


def no_site_scores(spark, sf):
    out = verdict.score_without_site(_with_names(with_types(table(spark, sf, "state"))), "name_signal", TRIAL)
    return out.groupBy("band").agg(F.count("*").alias("n"), F.sum(F.col("owner")["score"]).alias("points"))


# --- the job ---------------------------------------------------------------------
def _pins(spark, sf):
    return table(spark, sf, "orders").where(F.col("o_totalprice") > 480000).select(
        F.concat(F.lit("p"), F.col("o_custkey").cast("string")).alias("place_id"),
        F.when(F.col("o_orderstatus") == "F", "rejected").otherwise("leads").alias("verdict"),
        F.concat(F.lit("ручний розбір: "), F.col("o_orderkey").cast("string")).alias("reason"),
        F.struct("o_orderdate", "o_orderkey").alias("at"),
    )


def _named_state(spark, sf):
    return _with_names(with_types(table(spark, sf, "state")).drop("owner_score", "site_score", "fetch_error"))


def _rescored(spark, sf):
    return rescore_job(
        _named_state(spark, sf), responses(spark, sf).drop("page_id"), _review_signal(spark, sf), table(spark, sf, "psi"), _pins(spark, sf), TRIAL
    )


_VERDICT = ("place_id", "bucket", "reject_reason", "rule_no", "owner_score", "site_score", "site_status")


def reverdict(spark, sf):
    """Places with a speed measurement get their verdict anew from stored audits; no page is read for it."""
    audits = reliable(audits_of(stored_facts(responses(spark, sf).drop("page_id"), TRIAL)))
    psi = table(spark, sf, "psi")
    return reverdict_job(
        _named_state(spark, sf), psi, audits, _review_signal(spark, sf), psi, _pins(spark, sf), TRIAL
    ).select(*_VERDICT)


def rescore_with_history(spark, sf):
    """The job with old audits: places whose page is gone keep what was found before, the others are refreshed."""
    pages = responses(spark, sf).drop("page_id")
    old = reliable(audits_of(stored_facts(pages, TRIAL)))
    psi = reliable(table(spark, sf, "psi"))
    return rescore_job(
        _named_state(spark, sf), without_places(pages, psi), _review_signal(spark, sf), psi, _pins(spark, sf), TRIAL, old_audits=old,
    ).select(*_VERDICT)


def _site_answers(spark, sf):
    """Home pages, and of every four pages three as answers of a site: to a junk address, a route and a preference."""
    home = responses(spark, sf).select("place_id", F.lit("home").alias("role"), "final_url", F.lit(200).alias("http_status"), "html")
    others = _answers(spark, sf).where(F.col("role") != "home").withColumn("place_id", F.concat(F.lit("p"), F.substr("place_id", F.lit(2))))
    return home.unionByName(others)


def rescore_with_all(spark, sf):
    """The job with everything it can use: probe answers, mentions, a store of facts, and old audits of pages that are gone."""
    store = f"{ensure_checkpoint_dir(spark)}/facts-{uuid4().hex}"
    answers = _site_answers(spark, sf)
    psi = reliable(table(spark, sf, "psi"))
    gone = psi.select("place_id")
    homes = answers.where(F.col("role") == "home").drop("role")
    old = reliable(audits_of(facts_by_content(homes.join(gone, "place_id", "left_semi"), store, TRIAL)))
    named = mention_scores(spark, sf).select(F.concat(F.lit("p"), F.col("page_id").cast("string")).alias("place_id"), "mentions", "mention_score")
    return rescore_job(
        _named_state(spark, sf), without_places(answers, gone), _review_signal(spark, sf), psi, _pins(spark, sf),
        TRIAL, old_audits=old, mentions=named, use_probes=True, facts_at=store,
    ).select(*_VERDICT)


def rescore(spark, sf):
    return _rescored(spark, sf).select(*_VERDICT)


def rescore_transitions(spark, sf):
    from sitegauge.operators.merge import transitions

    # The new verdicts are a table of their own before anything filters on them.
    return transitions(reliable(_rescored(spark, sf).select("place_id", "old_bucket", "bucket")))


def export_rows(spark, sf):
    """The 23 published columns of every place."""
    wanted = (
        "place_id", "name", "address", "website", "phone", "primary_type", "niche_key", "hood_name", "metro_key", "c_custkey",
        "rating_steps", "user_rating_count", "bucket", "reject_reason", "audit", "quality", "effort", "owner", "psi", "reviews",
    )
    rows = (
        reliable(_rescored(spark, sf).select(*wanted)).withColumn("rating", (F.col("rating_steps") / 10).cast("double"))
        .withColumn("preferred_lang", F.col("reviews")["preferred_lang"])
        .withColumn("mobile_score", F.col("psi")["mobile_score"]).withColumn("desktop_score", F.col("psi")["desktop_score"])
        .withColumn("lcp_ms", F.col("psi")["lcp_ms"]).withColumn("primary_type_label", F.col("primary_type"))
        .withColumn("niche_label", F.col("niche_key")).withColumn("tier", F.lit("A"))
        .withColumn("has_screenshot", F.col("c_custkey") % 2 == 0)
    )
    return display.export_rows(rows, TRIAL)


# --- mentions --------------------------------------------------------------------
def mention_candidates(spark, sf):
    """Words of addresses and copyright lines in the documents."""
    docs = table(spark, sf, "documents")
    from sitegauge.functions import contacts

    rows = docs.select("doc_id", F.col("text").alias("html"), contacts.best_emails(contacts.emails_found(F.col("text"))).alias("emails"))
    by_mail = rows.select("doc_id", F.lit("email").alias("source"), F.explode(mentions.email_words(F.col("emails"))).alias("candidate"))
    by_line = rows.select("doc_id", F.lit("copyright").alias("source"), F.explode(mentions.copyright_words(F.col("html"))).alias("candidate"))
    return by_mail.unionByName(by_line)


#: Pages with structured data, nested and broken, a name in another script, and an address.
_MENTION_HTML = """(html || CASE CAST(page_id % 4 AS INT)
  WHEN 1 THEN '<script type="application/ld+json">{"@graph":[{"@type":["Person","Thing"],"name":"Ana Belora"},{"@type":"Firm","name":"No One Here","Founder":{"name":"Mira Valt' || CAST(page_id AS STRING) || '"}},{"employee":[{"x":{"name":"Not Inside"}},{"name":"Zed Quorb"},{"name":7}]}]}</script>'
  WHEN 2 THEN '<script type="application/ld+json">{"name": broken</script>'
  WHEN 3 THEN '<p>Inhaber: Éèàç Öüßä</p>'
  ELSE '<a href="mailto:mark.solter' || CAST(page_id AS STRING) || '@firm.example.org">m</a>' END)"""


def mention_scores(spark, sf):
    """Words on pages where people are named, classified by a word list, to a score per page; all five sources."""
    from sitegauge.functions import contacts

    html = F.col("html")
    pages = spread(table(spark, sf, "pages").select("page_id", F.expr(_MENTION_HTML).alias("html"))).select(
        "page_id", "html", html_to_text(html).alias("text"), contacts.best_emails(contacts.emails_found(html)).alias("emails")
    )
    found = mentions.candidates(pages, "page_id", "(?:the|les|der|una)", ("menu", "search"), script_roles="inhaber", script="À-ɏ")
    judged = found.withColumn("ok", F.length("candidate") % 2 == 0).withColumn("strong", F.length("candidate") % 4 == 0)
    return mentions.mention_score(judged, "page_id")


# --- probes ----------------------------------------------------------------------
def _answers(spark, sf):
    """Four pages make one site: its home, a junk address, a route and a negotiated answer."""
    p = F.col("page_id")
    role = F.element_at(F.array(*[F.lit(r) for r in ("home", "junk", "candidate", "negotiated")]), (p % 4 + 1).cast("int"))
    return table(spark, sf, "pages").select(
        F.concat(F.lit("s"), F.floor(p / 4).cast("string")).alias("place_id"), role.alias("role"), F.col("url").alias("final_url"),
        F.when((p % 4 == 1) & (p % 8 == 1), 404).otherwise(200).alias("http_status"), "html",
    )


def language_routes(spark, sf):
    found = probes.confirmed_routes(probes.stored_answers(_answers(spark, sf), TRIAL), TRIAL)
    told = probes.route_evidence(found).select("place_id", as_text(F.col("evidence")).alias("told"))
    return found.join(told, "place_id")


def negotiated_language(spark, sf):
    return probes.negotiated(probes.stored_answers(_answers(spark, sf), TRIAL), TRIAL).select("place_id", "lang", as_text(F.col("evidence")).alias("told"))


# --- sources ---------------------------------------------------------------------
def search_answers(spark, sf):
    """Customers packed into search answers, one per nation page, and read back."""
    c = table(spark, sf, "customer")
    packed = c.select(
        F.to_json(F.struct(F.array(F.struct(
            F.concat(F.lit("p"), F.col("c_custkey").cast("string")).alias("id"),
            F.struct(F.when(F.col("c_custkey") % 3 > 0, F.col("c_name")).alias("text")).alias("displayName"),
            F.when(F.col("c_nationkey") > 3, F.struct(F.col("c_acctbal").alias("latitude"), F.lit(1.5).alias("longitude"))).alias("location"),
            F.when(F.col("c_nationkey") % 2 == 0, F.array(F.lit("store"), F.col("c_mktsegment"))).alias("types"),
            F.col("c_nationkey").alias("userRatingCount"),
        )).alias("places"))).alias("body")
    )
    read = packed.select(F.from_json("body", SEARCH_RESPONSE).alias("r")).select("r.*")
    return readers.places_from(read).select(
        "place_id", "name", "address", "lat", "lng", F.array_join("types", ",").alias("types"), "website", "user_rating_count"
    )


def review_answers(spark, sf):
    """Orders packed into review answers and read back without their texts."""
    o = table(spark, sf, "orders")
    packed = o.select(
        F.to_json(F.struct(
            F.concat(F.lit("p"), F.col("o_custkey").cast("string")).alias("id"),
            F.array(F.struct(
                F.struct(F.lower(F.substring("o_orderpriority", 3, 2)).alias("languageCode")).alias("originalText"),
                F.struct(F.col("o_orderstatus").alias("displayName")).alias("authorAttribution"),
                (F.col("o_orderkey") % 5 + 1).cast("double").alias("rating"),
                F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("publishTime"),
            )).alias("reviews"),
        )).alias("body")
    )
    read = packed.select(F.from_json("body", REVIEW_RESPONSE).alias("r")).select("r.*")
    out = readers.reviews_from(read)
    return out.groupBy("language_code", "author_token").agg(
        F.count("*").alias("n"), F.min("publish_time").alias("first_time"), F.max("rating").alias("best")
    )


def speed_answers(spark, sf):
    """Parts packed into page-speed answers; a third has no mobile figures."""
    p = F.col("p_partkey")

    def answer(score, lcp):
        return F.to_json(F.struct(F.struct(
            F.struct(F.struct(score.alias("score")).alias("performance")).alias("categories"),
            F.create_map(F.lit("largest-contentful-paint"), F.struct(lcp.alias("numericValue"))).alias("audits"),
        ).alias("lighthouseResult")))

    raw = table(spark, sf, "part").select(
        p.alias("place_id"),
        F.when(p % 3 > 0, answer((p % 100) / 100.0, p * 1.5)).alias("mobile"), answer((p % 50) / 100.0, p * 0.5).alias("desktop"),
    )
    return readers.page_speed_from(raw)


def sitemap_pages(spark, sf):
    """Site maps of suppliers: every second one is an index of four parts."""
    s = table(spark, sf, "supplier").select(F.concat(F.lit("https://s"), F.col("s_suppkey").cast("string"), F.lit(".example")).alias("site"), "s_suppkey")
    loc = lambda path: F.concat(F.lit("<loc> "), "site", F.lit(path), F.lit("</loc>"))
    top = s.select(
        F.col("s_suppkey").alias("place_id"), F.concat("site", F.lit("/sitemap.xml")).alias("url"),
        F.when(
            F.col("s_suppkey") % 2 == 0, F.concat(F.lit("<urlset>"), loc("/a"), loc("/b"), F.lit("</urlset>"))
        ).otherwise(F.concat(F.lit("<sitemapindex>"), *[loc(f"/part{i}.xml") for i in range(4)], F.lit("</sitemapindex>"))).alias("xml"),
    )
    parts = s.select("*", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("i")).select(
        F.col("s_suppkey").alias("place_id"), F.concat("site", F.lit("/part"), F.col("i").cast("string"), F.lit(".xml")).alias("url"),
        F.concat(F.lit("<urlset><loc>"), "site", F.lit("/p"), F.col("i").cast("string"), F.lit("</loc></urlset>")).alias("xml"),
    )
    return readers.sitemap_urls(top.unionByName(parts))


def decoded_pages(spark, sf):
    """Documents as bytes with a charset line, read back as text; where it is UTF-8, with broken bytes behind."""
    latin = F.col("text").rlike(r"^[\x00-\xFF]*$")
    raw = table(spark, sf, "documents").select(
        "doc_id",
        F.when(latin, F.encode(F.concat(F.lit("<meta charset=iso-8859-1>"), "text"), "ISO-8859-1"))
        .otherwise(F.concat(F.encode(F.concat(F.lit("<meta charset=unknown-8>"), "text"), "UTF-8"), F.unhex(F.lit("FFFE80")))).alias("content"),
    )
    return readers.decode_pages(raw).select("doc_id", "charset", F.length("html").alias("chars"), F.md5("html").alias("digest"))


QUERIES = {
    f.__name__: f
    for f in (
        lexicon_prepare, key_verdicts, text_verdicts, text_verdicts_salted, text_classes, rule_best_match, rule_join, rule_hits,
        name_signals, review_languages, author_totals, review_signal, owner_scores, evidence_top, no_site_scores, rescore,
        reverdict, rescore_with_history, rescore_with_all, rescore_transitions, export_rows, mention_candidates, mention_scores, language_routes, negotiated_language,
        search_answers, review_answers, speed_answers, sitemap_pages, decoded_pages,
    )
}

# --- SQL ---------------------------------------------------------------------------
_WORDS = "regexp_split_to_array({}, '[\\s''’,.\\-]+')"


def _key_sql(word: str) -> str:
    """Spelling key of a Latin word: accents off, letters only, rewrite rules, doubles collapsed."""
    out = f"regexp_replace(strip_accents(replace(replace(replace(replace(lower(trim({word})), 'š', 'sh'), 'č', 'ch'), 'ž', 'zh'), 'ć', 'ts')), '[^a-z]', '', 'g')"
    for pattern, to in KEY_RULES[:-1]:
        pattern = pattern.replace("sch(?=[aeiouy])", "sch([aeiouy])").replace("j(?=[aeiou])", "j([aeiou])")
        back = "\\1" if "([" in pattern else ""
        out = f"regexp_replace({out}, '{pattern}', '{to}{back}', 'g')"
    for letter in "abcdefghijklmnopqrstuvwxyzX":
        out = f"regexp_replace({out}, '{letter}{letter}+', '{letter}', 'g')"
    return out


_LISTS = f"""
wl AS (SELECT DISTINCT lang, key FROM (SELECT lang, unnest({_WORDS.format('lower(text)')}) AS key FROM documents) WHERE length(key) >= 3),
kv AS (SELECT key, CASE WHEN a AND NOT m1 THEN 'exclusive' WHEN a AND m1 THEN 'shared' WHEN b AND m1 THEN 'foreign' WHEN b AND NOT m2 THEN 'exclusive' WHEN b AND m2 THEN 'shared' ELSE 'foreign' END AS verdict
       FROM (SELECT key, bool_or(lang = 'fr') AS a, bool_or(lang = 'de') AS b, bool_or(lang = 'en') AS m1, bool_or(lang = 'es') AS m2 FROM wl GROUP BY key)),
turns AS (SELECT conv_id * 1000 + turn AS id, text FROM conversations),
tok AS (SELECT id, unnest(ws) AS w, generate_subscripts(ws, 1) AS pos FROM (SELECT id, {_WORDS.format('text')} AS ws FROM turns)),
hit AS (SELECT id, pos, lower(w) AS key, verdict FROM tok JOIN kv ON kv.key = lower(w) WHERE length(w) >= 3),
best AS (SELECT id, arg_min(key, pos) FILTER (verdict = 'exclusive') AS e, arg_max(key, pos) FILTER (verdict = 'shared') AS s, arg_min(key, pos) FILTER (verdict = 'foreign') AS f FROM hit GROUP BY id),
tv AS (SELECT t.id, CASE WHEN e IS NOT NULL THEN 'exclusive' WHEN s IS NOT NULL THEN 'shared' WHEN f IS NOT NULL THEN 'foreign' ELSE 'unknown' END AS verdict, coalesce(e, s, f) AS matched FROM turns t LEFT JOIN best USING (id))
"""
_CLASSES = f"""
turns AS (SELECT conv_id * 1000 + turn AS id, trim(text) AS text FROM conversations),
lx AS (SELECT DISTINCT item_id % 4 AS r, {_key_sql('w')} AS key FROM (SELECT item_id, unnest(regexp_split_to_array(text, '\\s+')) AS w FROM benchmark) WHERE length(w) >= 12 AND NOT contains(w, ':')),
roles AS (SELECT key, bool_or(r = 0) AS curated, bool_or(r = 1) AS major, bool_or(r = 2) AS target_b, bool_or(r = 3) AS negative FROM lx WHERE length(key) >= 3 GROUP BY key),
tok AS (SELECT id, pos, {_key_sql('w')} AS key FROM (SELECT id, unnest(ws) AS w, generate_subscripts(ws, 1) AS pos FROM (SELECT id, {_WORDS.format('text')} AS ws FROM turns))),
good AS (SELECT * FROM tok WHERE length(key) >= 3),
ends AS (SELECT id, max(pos) AS last_pos FROM good GROUP BY id),
h AS (SELECT id, bool_or(curated) AS curated, bool_or(negative) AS negative, bool_or(target_b AND NOT major) AS exclusive, max(pos) AS last_hit, arg_max(major, pos) AS last_major FROM good JOIN roles USING (key) GROUP BY id),
c AS (SELECT turns.id, CASE WHEN length(text) < 3 THEN 'none' WHEN curated THEN 'list' WHEN regexp_matches(text, '(?i)eauou') THEN 'none' WHEN negative THEN 'none' WHEN exclusive THEN 'lexicon'
        WHEN NOT (coalesce(last_major, false) AND coalesce(last_hit = last_pos, false)) AND regexp_matches(lw, '(?i)(?:ent|tion|ung)$') THEN 'suffix'
        WHEN NOT (coalesce(last_major, false) AND coalesce(last_hit = last_pos, false)) AND regexp_matches(lw, '(?i)[aeiou]$') THEN 'suffix-weak' ELSE 'none' END AS via
      FROM (SELECT *, list_filter({_WORDS.format('text')}, lambda w: length(w) >= 3)[-1] AS lw FROM turns) turns LEFT JOIN h USING (id) LEFT JOIN ends USING (id))
"""
_PARTS = "CASE WHEN regexp_matches(p_name, '(?i)\\bsmall\\b') THEN {'w': 22, 'l': 'small'} WHEN regexp_matches(p_name, '(?i)widget') THEN {'w': 22, 'l': 'widget'} WHEN regexp_matches(p_name, '(?i)\\bred\\b') THEN {'w': 10, 'l': 'red'} WHEN regexp_matches(p_name, '(?i)ring$') THEN {'w': 5, 'l': 'ring'} END"
_FIRST = "CASE WHEN regexp_matches(p_name, '(?i)\\bred\\b') THEN 'red' WHEN regexp_matches(p_name, '(?i)\\bsmall\\b') THEN 'small' WHEN regexp_matches(p_name, '(?i)widget') THEN 'widget' WHEN regexp_matches(p_name, '(?i)ring$') THEN 'ring' END"

_HOST = "regexp_replace(lower(regexp_extract(coalesce(website, ''), '^[a-zA-Z][a-zA-Z0-9+.\\-]*://(?:[^/?#@]*@)?([^/?#:]+)', 1)), '^www\\.', '')"


def _names(source: str) -> str:
    return f"""
nm0 AS (SELECT *, name || ' ' || regexp_replace({_HOST}, '[.-]', ' ', 'g') AS hay FROM {source}),
nm1 AS (SELECT *, regexp_matches(hay, '(?i)000013') AS ex,
   CASE WHEN regexp_matches(hay, '(?i)household') THEN {{'w': 28, 'l': 'household'}} WHEN regexp_matches(hay, '(?i)building') THEN {{'w': 28, 'l': 'building'}} WHEN regexp_matches(hay, '(?i)00001') THEN {{'w': 20, 'l': 'low number'}} WHEN regexp_matches(hay, '(?i)machinery') THEN {{'w': 12, 'l': 'machinery'}} END AS mk,
   CASE WHEN regexp_matches(name, '(?i)ture$') THEN {{'w': 18, 'l': '-ture'}} WHEN regexp_matches(name, '(?i)ery$') THEN {{'w': 14, 'l': '-ery'}} END AS en,
   CASE WHEN regexp_matches(primary_type, '^auto') THEN {{'w': 26, 'l': 'vehicles'}} WHEN regexp_matches(primary_type, '^furniture') THEN {{'w': 16, 'l': 'furniture'}} WHEN regexp_matches(primary_type, '^(building|house)') THEN {{'w': 10, 'l': 'homes'}} END AS ct FROM nm0),
nm AS (SELECT *, CASE WHEN ex THEN 0 ELSE least(40, least(40, coalesce(mk.w, 0) + coalesce(en.w, 0)) + coalesce(ct.w, 0)) END AS name_score, CASE WHEN ex THEN 'excluded number' END AS name_exclusion,
   CASE WHEN ex THEN [{{'s': 'name_exclusion', 'w': 0, 'd': 'excluded number'}}] ELSE list_filter([CASE WHEN mk IS NOT NULL THEN {{'s': 'brand_marker', 'w': mk.w, 'd': 'назва: ' || mk.l}} END, CASE WHEN en IS NOT NULL THEN {{'s': 'ending_pattern', 'w': en.w, 'd': en.l}} END,
     CASE WHEN ct IS NOT NULL THEN {{'s': 'category_type', 'w': ct.w, 'd': ct.l || ' (' || primary_type || ')'}} END], lambda e: e IS NOT NULL) END AS name_ev FROM nm1)"""


_REV = """
rl AS (SELECT place_id, count(*) AS sample_size, count(*) FILTER (lower(language_code) = 'uk') AS n_uk, count(*) FILTER (lower(language_code) = 'ru') AS n_ru, count(*) FILTER (lower(language_code) IN ('uk', 'ru')) AS n_target,
   count(*) FILTER (lower(language_code) IN ('uk', 'ru') AND publish_time > TIMESTAMP '1999-06-01' - INTERVAL 1095 DAY) AS recent_target FROM reviews GROUP BY place_id),
ra0 AS (SELECT place_id, author_token AS a, contains(author_token, 'F') AND NOT contains(author_token, 'L') AS sc, contains(author_token, 'F') AS f FROM reviews WHERE length(trim(author_token)) > 1),
ra1 AS (SELECT place_id, count(*) AS authors, count(*) FILTER (sc OR (NOT f AND a LIKE 'O%')) AS matched, count(*) FILTER (sc) AS in_script,
   coalesce(sum(CASE WHEN sc THEN len(regexp_extract_all(a, 'U')) END), 0) AS gu, coalesce(sum(CASE WHEN sc THEN len(regexp_extract_all(a, 'M')) END), 0) AS gm FROM ra0 GROUP BY place_id),
ra AS (SELECT *, matched / authors AS author_ratio, CASE WHEN gu > gm THEN 'uk' WHEN gm > 0 THEN 'ru' END AS author_lang FROM ra1),
rp0 AS (SELECT rl.*, ra.* EXCLUDE (place_id), n_target / sample_size AS ratio, CASE WHEN n_target / sample_size >= 0.8 THEN 25 WHEN n_target / sample_size >= 0.6 THEN 20 WHEN n_target / sample_size >= 0.4 THEN 15 WHEN n_target / sample_size >= 0.25 THEN 10 ELSE 0 END AS base,
   CASE WHEN author_ratio >= 0.6 THEN 45 WHEN author_ratio >= 0.4 THEN 35 WHEN author_ratio >= 0.2 THEN 18 ELSE 0 END + CASE WHEN in_script >= 2 THEN 15 WHEN in_script = 1 THEN 8 ELSE 0 END AS ap FROM rl LEFT JOIN ra USING (place_id)),
rp AS (SELECT *, CASE WHEN base = 0 THEN 0 WHEN recent_target >= 2 THEN base + 5 WHEN recent_target = 0 THEN CAST(floor(base * 0.5 + 0.5) AS INTEGER) ELSE base END AS lp, CASE WHEN authors IS NULL THEN 0 ELSE least(60, ap) END AS app FROM rp0),
rs AS (SELECT place_id, least(70, lp + app) AS score, CASE WHEN n_target > 0 THEN CASE WHEN n_uk >= n_ru THEN 'uk' ELSE 'ru' END ELSE author_lang END AS preferred_lang, recent_target, coalesce(in_script, 0) AS author_script,
   list_filter([CASE WHEN lp > 0 THEN {'s': 'review_language', 'w': lp} END, CASE WHEN app > 0 THEN {'s': 'review_author_names', 'w': app} END], lambda e: e IS NOT NULL) AS ev FROM rp)"""

_OWN = f"""
ev AS (SELECT *, c_custkey AS k FROM nm),
vs AS (SELECT *, list_filter([CASE WHEN k % 2 = 0 THEN {{'w': 18, 'd': 'alternate fr'}} END, CASE WHEN k % 3 = 0 THEN {{'w': 32, 'd': 'route de'}} END, CASE WHEN k % 5 = 0 THEN {{'w': 32, 'd': 'switch fr'}} END], lambda e: e IS NOT NULL) AS v FROM ev),
vb AS (SELECT *, CASE WHEN k % 3 = 0 THEN 'route de' WHEN k % 5 = 0 THEN 'switch fr' WHEN k % 2 = 0 THEN 'alternate fr' END AS top, CASE WHEN k % 3 = 0 OR k % 5 = 0 THEN 32 WHEN k % 2 = 0 THEN 18 ELSE 0 END AS top_w FROM vs),
own AS (SELECT *, CASE WHEN k % 29 = 0 THEN 'org_domain' ELSE name_exclusion END AS exclusion,
   least(100, top_w + CASE WHEN k % 7 < 3 THEN 45 ELSE 0 END + CASE WHEN k % 11 < 4 THEN 25 ELSE 0 END + coalesce(list_sum(list_transform(name_ev, lambda e: e.w)), 0)) AS s FROM vb),
txt AS (SELECT *, list_concat(CASE WHEN top IS NULL THEN [] ELSE [top || ' (+' || top_w || ')'] END, list_transform(list_filter(v, lambda e: e.d <> top), lambda e: e.d),
   CASE WHEN k % 7 < 3 THEN ['phone (+45)'] ELSE [] END, CASE WHEN k % 11 < 4 THEN ['5/5 (+25)'] ELSE [] END, list_transform(name_ev, lambda e: CASE WHEN e.w > 0 THEN e.d || ' (+' || e.w || ')' ELSE e.d END)) AS lines FROM own)"""
_OWN_SCORE = "CASE WHEN exclusion IS NOT NULL THEN 0 ELSE s END"

_QUALITY_BY_PAGE = checks.quality("facts", "psi_pages")
_JOB = f"""{prelude('state', 'psi', 'reviews')}, {_REV}, {checks.PAGE_FACTS},
psi_pages AS (SELECT CAST(substr(place_id, 2) AS BIGINT) AS page_id, * EXCLUDE (place_id) FROM psi),
{_QUALITY_BY_PAGE}, {DECLARED}, {SIGNALS}, {_names('state')},
pin AS (SELECT 'p' || o_custkey AS place_id, arg_max(CASE WHEN o_orderstatus = 'F' THEN 'rejected' ELSE 'leads' END, (o_orderdate, o_orderkey)) AS verdict, 'ручний розбір: ' || arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS reason FROM orders WHERE o_totalprice > 480000 GROUP BY o_custkey),
allv AS (SELECT nm.place_id, nm.bucket AS old_bucket, nm.types_csv, nm.user_rating_count AS n, nm.website, nm.name_exclusion, nm.name_ev, q.page_id, q.modern_framework,
   CASE WHEN website IS NULL THEN 'no_site' WHEN q.page_id IS NULL THEN 'dead' ELSE q.status END AS site_status,
   CASE WHEN website IS NULL OR q.page_id IS NULL THEN 1 ELSE q.score10 END AS site_score,
   CASE WHEN website IS NULL OR q.page_id IS NULL THEN 1 ELSE len(q.dated) * CASE WHEN q.stub THEN 0 ELSE 1 END END AS n_markers,
   o.hard_exclusion, coalesce(list_sum(list_transform(o.ev, lambda e: e.w)), 0) AS site_w, coalesce(list_max(list_transform(v.ev, lambda e: e.w)), 0) AS top_w,
   rs.place_id IS NOT NULL AS has_reviews, coalesce(list_sum(list_transform(rs.ev, lambda e: e.w)), 0) AS rev_w, p.place_id IS NOT NULL AS psi_done, pin.verdict AS pin_verdict, pin.reason AS pin_reason
   FROM nm LEFT JOIN quality q ON nm.place_id = 'p' || q.page_id LEFT JOIN observed o ON o.page_id = q.page_id LEFT JOIN versions v ON v.page_id = q.page_id LEFT JOIN rs ON rs.place_id = nm.place_id LEFT JOIN psi p ON p.place_id = nm.place_id LEFT JOIN pin ON pin.place_id = nm.place_id),
sc AS (SELECT *, coalesce(hard_exclusion, name_exclusion) AS exclusion, CASE WHEN coalesce(hard_exclusion, name_exclusion) IS NOT NULL THEN 0 ELSE least(100, top_w + site_w + rev_w + coalesce(list_sum(list_transform(name_ev, lambda e: e.w)), 0)) END AS score, page_id IS NULL OR site_status = 'blocked' AS unread FROM allv),
vd AS (SELECT *, CASE WHEN pin_verdict IS NOT NULL THEN {{'b': pin_verdict, 'r': pin_reason, 'n': 1}}
   WHEN types_csv LIKE '%church%' THEN {{'b': 'rejected', 'r': 'некомерційний заклад (church)', 'n': 2}} WHEN types_csv LIKE '%museum%' THEN {{'b': 'rejected', 'r': 'некомерційний заклад (museum)', 'n': 2}}
   WHEN n < 5 THEN {{'b': 'rejected', 'r': 'мало відгуків (' || n || ' < 5)', 'n': 3}} WHEN exclusion IS NOT NULL THEN {{'b': 'rejected', 'r': 'виключення: ' || exclusion, 'n': 4}}
   WHEN site_status = 'blocked' AND score >= 35 THEN {{'b': 'manual', 'r': 'сайт закритий bot-protection — що там насправді, видно лише очима', 'n': 5}}
   WHEN NOT unread AND modern_framework IS NOT NULL THEN {{'b': 'rejected', 'r': 'сучасний стек (' || modern_framework || ')', 'n': 6}}
   WHEN NOT unread AND n_markers = 0 AND psi_done AND site_score > 6 AND score >= 55 THEN {{'b': 'upsell', 'r': 'мова підтверджена (скор ' || score || '), але сайт ' || site_score || '/10 — переробляти нема чого, заходити з інших послуг', 'n': 7}}
   WHEN score >= 55 THEN {{'b': 'leads', 'r': NULL, 'n': 8}} WHEN NOT has_reviews AND (unread OR score + 70 >= 35) THEN {{'b': 'pending', 'r': NULL, 'n': 9}}
   WHEN score >= 35 THEN {{'b': 'manual', 'r': NULL, 'n': 10}} WHEN unread THEN {{'b': 'manual', 'r': 'сайт не прочитано (no response)', 'n': 11}} ELSE {{'b': 'rejected', 'r': 'слабкий мовний сигнал (' || score || ')', 'n': 12}} END AS v FROM sc)"""

_ANSWERS = f"""
an AS (SELECT 's' || CAST(floor(page_id / 4) AS BIGINT) AS place_id, page_id % 4 AS role, url, CASE WHEN page_id % 4 = 1 AND page_id % 8 = 1 THEN 404 ELSE 200 END AS st, sha1({checks.normalized()}) AS fp, length(html) AS n,
   regexp_matches({checks.visible_text()}, '(?i)page not found|404 error|nothing found|no results found|страница не найдена|сторінку не знайдено|oops') AS soft,
   len(regexp_extract_all(html, '[À-ɏ]')) AS script, CASE WHEN len(regexp_extract_all(html, '[éèêçàùâîôûëïœ]')) > len(regexp_extract_all(html, '[äöüß]')) THEN 'fr' ELSE 'de' END AS lang FROM pages),
base AS (SELECT place_id, max(fp) FILTER (role = 0) AS home_fp, max(fp) FILTER (role = 1) AS junk_fp, max(n) FILTER (role = 1) AS junk_n, coalesce(bool_or(st = 404) FILTER (role = 1), false) AS honest FROM an WHERE role IN (0, 1) GROUP BY place_id)"""

_PAIR = "\\b[A-Z][a-z''’\\-]{2,19}\\s+[A-Z][a-z''’\\-]{3,24}\\b"
_MENTIONS = f"""
rich AS (SELECT page_id, {_MENTION_HTML} AS html FROM pages),
{checks.email_ctes('rich', 'page_id', 'html').strip()},
t AS (SELECT page_id, html, {checks.visible_text()} AS t FROM rich),
p AS (SELECT page_id, t, regexp_extract_all(t, '{_PAIR}') AS ps, string_split_regex(t, '{_PAIR}') AS ss FROM t),
i AS (SELECT page_id, t, ps[k] AS c, CAST(list_sum(list_transform(ss[1:k], lambda x: length(x))) + coalesce(list_sum(list_transform(ps[1:k-1], lambda x: length(x))), 0) AS BIGINT) AS off
      FROM (SELECT *, unnest(range(1, len(ps) + 1)) AS k FROM p)),
r AS (SELECT page_id, 2 AS source, c FROM i WHERE regexp_matches(substr(repeat(' ', 40) || t, off + 1, 40) || ' | ' || substr(t, off + length(c) + 1, 40), '(?i)(?:the|les|der|una)')
      UNION ALL SELECT page_id, 3, unnest(regexp_extract_all(regexp_replace(html, '<[^>]+>', ' ', 'g'), '(?:©|&copy;|copyright)\\s*(?:\\d{{4}}(?:\\s*[-–]\\s*\\d{{4}})?)?\\s*([A-Z][A-Za-z''’\\-]{{2,24}})', 1)) FROM t
      UNION ALL SELECT page_id, 4, w FROM (SELECT page_id, unnest(regexp_split_to_array(split_part(e, '@', 1), '[._\\-+0-9]+')) AS w FROM (SELECT page_id, unnest(string_split(emails, ',')) AS e FROM best)) WHERE length(w) >= 4),
n AS (SELECT page_id, source, c FROM r WHERE NOT list_has_any(regexp_split_to_array(lower(c), '[\\s''’.\\-]+'), ['menu', 'search'])
      UNION ALL SELECT page_id, 1, unnest(['Ana Belora', 'Mira Valt' || page_id, 'Zed Quorb']) FROM pages WHERE page_id % 4 = 1
      UNION ALL SELECT page_id, 5, unnest(regexp_extract_all(t, '(?i:inhaber)[\\s:,\\-]{{1,4}}([À-ÖØ-Þ][ß-öø-ÿ]{{2,}}\\s+[À-ÖØ-Þ][ß-öø-ÿ]{{2,}})', 1)) FROM t),
d AS (SELECT page_id, c, min(source) AS source FROM n GROUP BY page_id, c)"""

_SCORED_MENTIONS = """g AS (SELECT page_id, count(*) AS mentions, min(source) FILTER (length(c) % 4 = 0) AS first FROM d WHERE length(c) % 2 = 0 GROUP BY page_id),
ms AS (SELECT page_id, mentions, CASE WHEN first IS NULL THEN 0 WHEN first IN (1, 5) THEN 30 ELSE 25 END AS mention_score FROM g)"""

# The job with probe answers and mentions for the places whose page is still there.
_PROBED = f"""
an AS (SELECT 'p' || CAST(floor(page_id / 4) AS BIGINT) AS place_id, page_id % 4 AS role, url, CASE WHEN page_id % 4 = 1 AND page_id % 8 = 1 THEN 404 ELSE 200 END AS st, sha1({checks.normalized()}) AS fp, length(html) AS n,
   regexp_matches({checks.visible_text()}, '(?i)page not found|404 error|nothing found|no results found|страница не найдена|сторінку не знайдено|oops') AS soft,
   len(regexp_extract_all(html, '[À-ɏ]')) AS script FROM pages WHERE page_id % 4 > 0),
home AS (SELECT 'p' || page_id AS place_id, sha1({checks.normalized()}) AS home_fp FROM {checks.RICH_PAGES}),
junk AS (SELECT place_id, fp AS junk_fp, n AS junk_n, st = 404 AS honest FROM an WHERE role = 1),
asked AS (SELECT an.*, home_fp, junk_fp, coalesce(junk_n, 0) AS junk_n, coalesce(honest, false) AS honest FROM an LEFT JOIN home USING (place_id) LEFT JOIN junk USING (place_id)),
probe AS (SELECT place_id, max(CASE WHEN role = 3 AND fp <> home_fp AND script >= 100 THEN 35
   WHEN role = 2 AND st = 200 AND (honest OR junk_fp IS NULL OR fp <> junk_fp) AND fp IS DISTINCT FROM home_fp AND (honest OR abs(n - junk_n) >= 200) AND NOT soft AND script >= 150 THEN 32 ELSE 0 END) AS w FROM asked GROUP BY place_id)"""
_TOP, _SITE = "coalesce(list_max(list_transform(v.ev, lambda e: e.w)), 0)", "coalesce(list_sum(list_transform(o.ev, lambda e: e.w)), 0)"
_PIN = "LEFT JOIN pin ON pin.place_id = nm.place_id"
_JOB_WITH_ALL = _JOB.replace("allv AS (", f"{_MENTIONS}, {_SCORED_MENTIONS}, {_PROBED},\nallv AS (").replace(
    f"{_TOP} AS top_w", f"greatest({_TOP}, CASE WHEN p.place_id IS NULL AND q.page_id IS NOT NULL AND len(list_filter(v.ev, lambda e: e.s <> 'flag_icons')) = 0 THEN coalesce(probe.w, 0) ELSE 0 END) AS top_w"
).replace(
    f"{_SITE} AS site_w", f"{_SITE} + CASE WHEN p.place_id IS NULL AND q.page_id IS NOT NULL AND o.hard_exclusion IS NULL THEN coalesce(ms.mention_score, 0) ELSE 0 END AS site_w"
).replace(_PIN, f"{_PIN} LEFT JOIN probe ON probe.place_id = nm.place_id LEFT JOIN ms ON 'p' || ms.page_id = nm.place_id")

ORACLES = {
    "mention_scores": f"WITH {_MENTIONS}, {_SCORED_MENTIONS} SELECT * FROM ms",
    "lexicon_prepare": f"WITH t AS (SELECT source, lang, unnest(regexp_split_to_array(text, '\\s+')) AS w FROM documents), k AS (SELECT DISTINCT source, lang, {_key_sql('w')} AS key FROM t WHERE NOT contains(w, ':')) SELECT lang AS role, count(DISTINCT key) AS keys, min(key) AS first_key, max(key) AS last_key, count(*) AS entries FROM k WHERE length(key) >= 3 GROUP BY lang",
    "key_verdicts": f"WITH {_LISTS} SELECT verdict, count(*) AS n FROM kv GROUP BY verdict",
    "text_verdicts": f"WITH {_LISTS} SELECT id, verdict, matched FROM tv",
    "text_verdicts_salted": f"WITH {_LISTS} SELECT verdict, count(*) AS n FROM tv GROUP BY verdict",
    "text_classes": f"WITH {_CLASSES} SELECT via <> 'none' AS ok, via IN ('list', 'lexicon', 'suffix') AS strong, via, count(*) AS n FROM c GROUP BY 1, 2, 3",
    "rule_best_match": f"SELECT p_partkey, r.w AS weight, r.l AS label FROM (SELECT p_partkey, {_PARTS} AS r FROM part)",
    "rule_join": """WITH w AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z]{7,}')) AS w FROM benchmark),
        t AS (SELECT conv_id * 1000 + turn AS id, text, lower(text) AS low FROM conversations),
        m AS (SELECT w AS label, id FROM w JOIN t ON CASE WHEN length(w) % 2 = 0 THEN contains(low, w) AND regexp_matches(low, '(?:^|[^a-z])' || w || '(?:$|[^a-z])')
          WHEN length(w) % 3 = 0 THEN contains(low, w) OR contains(low, 'no such thing') ELSE contains(low, substr(w, 1, 5)) AND regexp_matches(low, '(?:^|[^a-z])' || substr(w, 1, 5) || '[a-z]*') END
          UNION ALL SELECT 'three digits', id FROM t WHERE regexp_matches(text, '[0-9]{3}'))
        SELECT label, count(*) AS hits, min(id) AS first_id FROM m GROUP BY label""",
    "rule_hits": f"WITH r AS (SELECT p_partkey, {_FIRST} AS rule FROM part), x AS (SELECT *, row_number() OVER (PARTITION BY rule ORDER BY p_partkey) AS i FROM r WHERE rule IS NOT NULL) SELECT rule, count(*) AS hits, string_agg(p_partkey, ',' ORDER BY p_partkey) FILTER (i <= 6) AS samples FROM x GROUP BY rule",
    "name_signals": f"{prelude('places')}, {_names('places')} SELECT place_id, name_score AS score, name_exclusion AS exclusion, array_to_string(list_transform(name_ev, lambda e: e.s || '+' || e.w), ';') AS signals FROM nm",
    "review_languages": f"{prelude('reviews')}, {_REV} SELECT place_id, sample_size, n_uk, n_ru, n_target, recent_target, n_target / sample_size AS ratio FROM rl",
    "author_totals": f"{prelude('reviews')}, {_REV} SELECT place_id, authors, matched, in_script, author_ratio, author_lang FROM ra",
    "review_signal": f"{prelude('reviews')}, {_REV} SELECT place_id, score, preferred_lang, recent_target, author_script, array_to_string(list_transform(ev, lambda e: e.s || '+' || e.w), ';') AS signals FROM rs",
    "owner_scores": f"""{prelude('state')}, {_names('state')}, {_OWN} SELECT place_id, {_OWN_SCORE} AS score, CASE WHEN exclusion IS NULL THEN CASE WHEN k % 4 = 0 THEN 'fr' WHEN k % 6 = 0 THEN 'de' WHEN top LIKE '%fr%' THEN 'fr' WHEN top LIKE '%de%' THEN 'de' END END AS lang, exclusion,
        CASE WHEN {_OWN_SCORE} >= 55 THEN 'leads' WHEN {_OWN_SCORE} >= 35 THEN 'manual' ELSE 'rejected' END AS bucket,
        CASE WHEN k % 29 = 0 THEN CASE WHEN k % 7 < 3 THEN 'phone (+45)' ELSE '' END WHEN name_exclusion IS NOT NULL THEN 'excluded number' ELSE array_to_string(lines, '; ') END AS evidence_text FROM txt""",
    "evidence_top": f"""{prelude('state')}, {_names('state')}, {_OWN}, s AS (
        SELECT CASE top WHEN 'route de' THEN 'route' WHEN 'switch fr' THEN 'switch' ELSE 'alternate' END AS signal FROM own WHERE exclusion IS NULL AND top IS NOT NULL
        UNION ALL SELECT 'phone' FROM own WHERE (exclusion IS NULL OR k % 29 = 0) AND k % 7 < 3 UNION ALL SELECT 'review_language' FROM own WHERE exclusion IS NULL AND k % 11 < 4
        UNION ALL SELECT unnest(list_transform(name_ev, lambda e: e.s)) FROM own WHERE exclusion IS NULL) SELECT signal, count(*) AS n FROM s GROUP BY signal ORDER BY n DESC, signal LIMIT 12""",
    "no_site_scores": f"""{prelude('state')}, {_names('state')}, x AS (SELECT CASE WHEN types_csv LIKE '%church%' OR types_csv LIKE '%museum%' THEN NULL WHEN ex THEN 0 ELSE coalesce(list_sum(list_transform(name_ev, lambda e: e.w)), 0) END AS s FROM nm WHERE bucket = 'no_site')
        SELECT CASE WHEN s IS NULL THEN 'excluded' WHEN s >= 30 THEN '30+' WHEN s >= 20 THEN '20-29' WHEN s >= 10 THEN '10-19' WHEN s > 0 THEN '1-9' ELSE '0' END AS band, count(*) AS n, CAST(sum(s) AS BIGINT) AS points FROM x GROUP BY 1""",
    "rescore": f"{_JOB} SELECT place_id, v.b AS bucket, v.r AS reject_reason, v.n AS rule_no, CASE WHEN v.n > 3 THEN score END AS owner_score, site_score, site_status FROM vd",
    "reverdict": f"{_JOB} SELECT place_id, v.b AS bucket, v.r AS reject_reason, v.n AS rule_no, CASE WHEN v.n > 3 THEN score END AS owner_score, site_score, site_status FROM vd WHERE psi_done",
    "rescore_with_history": f"{_JOB} SELECT place_id, v.b AS bucket, v.r AS reject_reason, v.n AS rule_no, CASE WHEN v.n > 3 THEN score END AS owner_score, site_score, site_status FROM vd",
    "export_rows": export_sql(_JOB),
    "rescore_with_all": f"{_JOB_WITH_ALL} SELECT place_id, v.b AS bucket, v.r AS reject_reason, v.n AS rule_no, CASE WHEN v.n > 3 THEN score END AS owner_score, site_score, site_status FROM vd",
    "rescore_transitions": f"{_JOB} SELECT old_bucket AS from_bucket, v.b AS to_bucket, count(*) AS n FROM vd WHERE old_bucket <> v.b GROUP BY 1, 2",
    "mention_candidates": f"""WITH {checks.email_ctes('documents', 'doc_id', 'text')}, lp AS (SELECT doc_id, split_part(unnest(string_split(emails, ',')), '@', 1) AS l FROM best), w AS (SELECT doc_id, unnest(regexp_split_to_array(l, '[._\\-+0-9]+')) AS candidate FROM lp)
        SELECT doc_id, 'email' AS source, candidate FROM w WHERE length(candidate) >= 4
        UNION ALL SELECT doc_id, 'copyright', unnest(regexp_extract_all(regexp_replace(text, '<[^>]+>', ' ', 'g'), '(?:©|&copy;|copyright)\\s*(?:\\d{{4}}(?:\\s*[-–]\\s*\\d{{4}})?)?\\s*([A-Z][A-Za-z''’\\-]{{2,24}})', 1)) FROM documents""",
    "language_routes": f"""WITH {_ANSWERS}, ok AS (SELECT an.place_id, url, lang, script FROM an LEFT JOIN base USING (place_id) WHERE role = 2 AND st = 200 AND (coalesce(honest, false) OR junk_fp IS NULL OR fp <> junk_fp) AND fp IS DISTINCT FROM home_fp AND (coalesce(honest, false) OR abs(n - coalesce(junk_n, 0)) >= 200) AND NOT soft AND script >= 150)
        SELECT place_id, url, lang, script AS script_chars, 'робоча ' || lang || ' версія: ' || url || ' (+32)' AS told FROM ok""",
    "negotiated_language": f"WITH {_ANSWERS} SELECT an.place_id, lang, 'сайт віддає ' || lang || ' за Accept-Language (+35)' AS told FROM an JOIN base USING (place_id) WHERE role = 3 AND fp <> home_fp AND script >= 100",
    "search_answers": "SELECT 'p' || c_custkey AS place_id, CASE WHEN c_custkey % 3 > 0 THEN c_name ELSE '' END AS name, '' AS address, CASE WHEN c_nationkey > 3 THEN c_acctbal ELSE 0.0 END AS lat, CAST(CASE WHEN c_nationkey > 3 THEN 1.5 ELSE 0 END AS DOUBLE) AS lng, CASE WHEN c_nationkey % 2 = 0 THEN 'store,' || c_mktsegment ELSE '' END AS types, NULL AS website, c_nationkey AS user_rating_count FROM customer",
    "review_answers": "SELECT lower(substr(o_orderpriority, 3, 2)) AS language_code, o_orderstatus AS author_token, count(*) AS n, min(o_orderdate) AS first_time, CAST(max(o_orderkey % 5 + 1) AS DOUBLE) AS best FROM orders GROUP BY 1, 2",
    "speed_answers": "SELECT p_partkey AS place_id, CASE WHEN p_partkey % 3 > 0 THEN p_partkey % 100 END AS mobile_score, p_partkey % 50 AS desktop_score, CAST(CASE WHEN p_partkey % 3 > 0 THEN p_partkey * 1.5 ELSE p_partkey * 0.5 END AS DOUBLE) AS lcp_ms, NULL AS cls FROM part",
    "sitemap_pages": "WITH s AS (SELECT s_suppkey AS k, 'https://s' || s_suppkey || '.example' AS site FROM supplier) SELECT k AS place_id, site || p AS page_url FROM s, (VALUES ('/a'), ('/b')) v(p) WHERE k % 2 = 0 UNION ALL SELECT k, site || '/p' || i FROM s, (VALUES (0), (1), (2), (3)) v(i) WHERE k % 2 = 1",
    "decoded_pages": "WITH d AS (SELECT doc_id, regexp_matches(text, '^[\\x00-\\x{FF}]*$') AS l, text FROM documents), h AS (SELECT doc_id, l, CASE WHEN l THEN '<meta charset=iso-8859-1>' || text ELSE '<meta charset=unknown-8>' || text || repeat(chr(65533), 3) END AS t FROM d) SELECT doc_id, CASE WHEN l THEN 'latin-1' ELSE 'utf-8' END AS charset, length(t) AS chars, md5(t) AS digest FROM h",
}
