"""Stored inputs as DataFrames, always with a declared schema."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sitegauge.functions.markup import sitemap_locations
from sitegauge.functions.text import round_half_up
from sitegauge.operators.lexicon import prepare_lexicon
from sitegauge.schemas import CACHED_PAGE, PAGE_SPEED_RESPONSE, REVIEW_RESPONSE, SEARCH_RESPONSE
from sitegauge.session import packed, reliable

# --- fixed values -----------------------------------------------------------
CHARSET_ALIASES = {
    "utf-8": "utf-8", "utf8": "utf-8", "windows-1251": "cp1251", "cp1251": "cp1251", "x-cp1251": "cp1251",
    "koi8-r": "koi8-r", "koi8-u": "koi8-r", "iso-8859-5": "iso8859-5", "windows-1252": "latin-1",
    "iso-8859-1": "latin-1", "ascii": "utf-8",
}
SITEMAP_CANDIDATES = ("/sitemap.xml", "/sitemap_index.xml", "/sitemap-index.xml")
# --- end of fixed values ----------------------------------------------------


def places_from(responses: DataFrame) -> DataFrame:
    """One row per place of a search answer, with the defaults for what is missing."""
    p = F.col("p")
    return responses.select(F.explode("places").alias("p")).select(
        p["id"].alias("place_id"),
        F.coalesce(p["displayName"]["text"], F.lit("")).alias("name"),
        F.coalesce(p["formattedAddress"], F.lit("")).alias("address"),
        F.coalesce(p["location"]["latitude"], F.lit(0.0)).alias("lat"),
        F.coalesce(p["location"]["longitude"], F.lit(0.0)).alias("lng"),
        p["primaryType"].alias("primary_type"),
        p["primaryTypeDisplayName"]["text"].alias("primary_type_label"),
        F.coalesce(p["types"], F.array().cast("array<string>")).alias("types"),
        p["websiteUri"].alias("website"), p["nationalPhoneNumber"].alias("phone"), p["rating"].alias("rating"),
        p["userRatingCount"].alias("user_rating_count"), p["businessStatus"].alias("business_status"),
    )


def read_places(spark: SparkSession, path: str) -> DataFrame:
    return places_from(spark.read.schema(SEARCH_RESPONSE).json(path))


def reviews_from(responses: DataFrame) -> DataFrame:
    """Review metadata without any text."""
    r = F.col("r")
    return responses.select(F.col("id").alias("place_id"), F.explode("reviews").alias("r")).select(
        "place_id", r["originalText"]["languageCode"].alias("language_code"),
        r["authorAttribution"]["displayName"].alias("author_token"), r["rating"].alias("rating"),
        F.try_to_timestamp(r["publishTime"]).alias("publish_time"),
    )


def read_reviews(spark: SparkSession, path: str) -> DataFrame:
    return reviews_from(spark.read.schema(REVIEW_RESPONSE).json(path))


def _speed(raw: Column) -> Column:
    parsed = F.from_json(raw, PAGE_SPEED_RESPONSE)["lighthouseResult"]
    return F.struct(
        round_half_up(parsed["categories"]["performance"]["score"] * 100).alias("score"),
        parsed["audits"]["largest-contentful-paint"]["numericValue"].alias("lcp"),
        parsed["audits"]["cumulative-layout-shift"]["numericValue"].alias("cls"),
    )


def page_speed_from(raw: DataFrame) -> DataFrame:
    """(place_id, mobile, desktop) JSON texts to one row of figures; mobile first, else desktop."""
    m, d = F.col("m"), F.col("d")
    return raw.withColumn("m", _speed(F.col("mobile"))).withColumn("d", _speed(F.col("desktop"))).select(
        "place_id", m["score"].alias("mobile_score"), d["score"].alias("desktop_score"),
        F.coalesce(m["lcp"], d["lcp"]).alias("lcp_ms"), F.coalesce(m["cls"], d["cls"]).alias("cls"),
    )


def read_cached_pages(spark: SparkSession, path: str) -> DataFrame:
    """One JSON file per key as (place_id, final_url, fetched_at, html, state); a broken file gives a row without a page.

    `state` is ``page``, ``no page`` (JSON without one) or ``broken``. The names of the files are their keys; many small
    files are read by few tasks.
    """
    files = packed(spark.read.text(path, wholetext=True).select("value", F.col("_metadata.file_name").alias("_file")))
    parsed = F.from_json("value", CACHED_PAGE, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"})
    read = files.select(F.regexp_replace("_file", r"\.json$", "").alias("place_id"), parsed.alias("p"), (F.trim("value") == "").alias("_blank"))
    p = F.col("p")
    return read.select(
        "place_id", p["finalUrl"].alias("final_url"), F.try_to_timestamp(p["fetchedAt"]).alias("fetched_at"), p["html"].alias("html"),
        F.when(F.col("_blank") | p.isNull() | p["_corrupt_record"].isNotNull(), "broken").when(p["html"].isNull(), "no page").otherwise("page").alias("state"),
    )


def read_keyed_config(spark: SparkSession, path: str, value_schema: str, key: str = "key") -> DataFrame:
    """A JSON object keyed by name as rows ``(key, value...)``.

    A byte order mark is stripped and keys that start with ``_`` are comments; below the
    top level the declared schema names the wanted fields, so comments fall away there.
    """
    # Comment keys may hold any type, so values are parsed one by one.
    raw = spark.read.text(path, wholetext=True).select(F.regexp_replace("value", "^﻿", "").alias("v"))
    entries = raw.select(F.explode(F.from_json("v", "map<string,string>")).alias("k", "text")).where(
        ~F.col("k").startswith("_")
    )
    return entries.select(F.col("k").alias(key), F.from_json("text", value_schema).alias("s")).select(key, "s.*")


def read_lexicon(spark: SparkSession, path: str) -> DataFrame:
    """Files ``{category, role, keys[]}`` to distinct prepared keys."""
    raw = spark.read.schema("category string, role string, keys array<string>").json(path)
    return prepare_lexicon(
        raw.select(F.col("category").alias("lexicon"), "role", F.explode("keys").alias("title"))
    )


def sitemap_urls(maps: DataFrame) -> DataFrame:
    """Page addresses per site from stored site maps ``(place_id, url, xml)``.

    The first of the usual addresses that holds a map wins; an index file leads to all its children. The addresses
    are taken out in one scan and stored; the mark-up goes no further.
    """
    xml = F.col("xml")
    rank = F.lit(None).cast("int")
    for i, suffix in reversed(list(enumerate(SITEMAP_CANDIDATES))):
        rank = F.when(F.col("url").endswith(suffix), i).otherwise(rank)
    read = reliable(maps.select(
        "place_id", "url", rank.alias("_rank"), xml.rlike("(?i)<(?:urlset|sitemapindex)").alias("_valid"),
        xml.rlike("(?i)<sitemapindex").alias("is_index"), sitemap_locations(xml).alias("locs"),
    ))
    chosen = read.where(F.col("_valid") & F.col("_rank").isNotNull()).groupBy("place_id").agg(
        F.min_by(F.struct("is_index", "locs"), "_rank").alias("c")
    )
    listed = chosen.select("place_id", "c.is_index", F.explode("c.locs").alias("url"))
    direct = listed.where(~F.col("is_index")).select("place_id", F.col("url").alias("page_url"))
    nested = listed.where("is_index").select("place_id", "url").join(read.select("place_id", "url", "locs"), ["place_id", "url"])
    return direct.unionByName(nested.select("place_id", F.explode("locs").alias("page_url"))).distinct()


def _decode_udf():
    """Decoding of legacy charsets as a pandas UDF; nested, so that it travels with the task."""

    def decode(raw: pd.Series, charset: pd.Series) -> pd.Series:
        return pd.Series([
            None if b is None else bytes(b).decode(c, errors="replace") for b, c in zip(raw, charset)
        ])

    return F.pandas_udf(decode, T.StringType())


def decode_pages(files: DataFrame, content: str = "content") -> DataFrame:
    """Raw bytes to text by the first charset named anywhere in them, else UTF-8, in one pass.

    UTF-8 and Latin-1 stay in the JVM; only the rare legacy charsets go to Python. Bytes that are no text in their
    charset become U+FFFD.
    """
    raw = F.col(content)
    named = F.lower(F.regexp_extract(F.decode(raw, "ISO-8859-1"), r"""(?i)charset\s*=\s*["']?\s*([\w-]+)""", 1))
    aliases = F.create_map(*[F.lit(x) for kv in CHARSET_ALIASES.items() for x in kv])
    known = files.withColumn("charset", F.coalesce(aliases[named], F.lit("utf-8")))
    charset = F.col("charset")
    legacy = _decode_udf()(F.when(~charset.isin("utf-8", "latin-1"), raw), charset)
    return known.withColumn("_legacy", legacy).withColumn(
        "html",
        F.when(charset == "latin-1", F.decode(raw, "ISO-8859-1"))
        .when(charset == "utf-8", F.make_valid_utf8(raw.cast("string")))
        .otherwise(F.col("_legacy")),
    ).drop("_legacy")


def read_raw_pages(spark: SparkSession, path: str) -> DataFrame:
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return decode_pages(files)


def read_notes(spark: SparkSession, path: str) -> DataFrame:
    """The table people write to: one row per published row, with its tab."""
    from sitegauge.schemas import NOTES

    return spark.read.schema(NOTES).parquet(path)


def write_placement(placed: DataFrame, path: str) -> None:
    """Snapshot of what was published where; the next publication reads it."""
    placed.select("place_id", "tab", "row_index").write.mode("errorifexists").parquet(path)
