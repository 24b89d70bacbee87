"""Page facts read from tags.  A tag is cut out first and its attribute after that,
so attribute order and the kind of quote do not matter."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sitegauge.functions.text import bind, collapse, decode_named_entities, decode_numeric_entities

VIEWPORT = r"""(?i)<meta[^>]*\sname\s*=\s*["']?viewport["'\s/>]"""
DESCRIPTION_TAG = r"""(?i)<meta[^>]*\sname\s*=\s*["']?description["'\s/>][^>]*>?"""
OG_TAG = r"""(?i)<meta[^>]*\sproperty\s*=\s*["']?og:"""
ICON = r"""(?i)<link[^>]*\srel\s*=\s*(?:"[^"]*icon|'[^']*icon|[^\s"'>]*icon)"""
CHARSET = r"(?i)<meta[^>]+charset"
TITLE = r"(?is)<title[^>]*>(.*?)</title>"
H1 = r"(?is)<h1[^>]*>(.*?)</h1>"
MIXED = r"""(?i)(?:src|href)=["']http://(?!localhost)"""


def attribute(tag: Column, name: str) -> Column:
    """Value of an attribute inside one tag; null when absent or blank."""
    double = F.regexp_extract(tag, rf'(?i)\s{name}\s*=\s*"([^"]*)"', 1)
    single = F.regexp_extract(tag, rf"(?i)\s{name}\s*=\s*'([^']*)'", 1)
    bare = F.regexp_extract(tag, rf"(?i)\s{name}\s*=\s*([^\s\"'>]+)", 1)
    value = F.when(double != "", double).when(single != "", single).otherwise(bare)
    return F.nullif(F.trim(value), F.lit(""))


def _inner_text(html: Column, pattern: str) -> Column:
    inner = F.regexp_replace(F.regexp_extract(html, pattern, 1), r"<[^>]+>", "")
    plain = F.trim(decode_numeric_entities(decode_named_entities(inner)))
    return bind(plain, lambda t: F.when(t != "", t))


def title(html: Column) -> Column:
    return _inner_text(html, TITLE)


def first_heading(html: Column) -> Column:
    return collapse(_inner_text(html, H1))


def meta_description(html: Column) -> Column:
    tag = F.regexp_extract(html, DESCRIPTION_TAG, 0)
    return bind(tag, lambda t: F.when(t != "", attribute(t, "content")))


def has_viewport(html: Column) -> Column:
    return html.rlike(VIEWPORT)


def has_open_graph(html: Column) -> Column:
    return html.rlike(OG_TAG)


def has_favicon(html: Column) -> Column:
    return html.rlike(ICON)


def declares_charset(html: Column) -> Column:
    return html.rlike(CHARSET)


def is_https(url: Column) -> Column:
    return F.coalesce(F.lower(url).startswith("https:"), F.lit(False))


def mixed_content(url: Column, html: Column) -> Column:
    return is_https(url) & html.contains("://") & html.rlike(MIXED)


def empty_shell(html: Column, text: Column) -> Column:
    """Much mark-up and hardly any text: a page filled in by script."""
    return (F.length(text) < 250) & (F.length(html) > 500)


def sitemap_locations(xml: Column) -> Column:
    return F.regexp_extract_all(xml, F.lit(r"(?i)<loc>\s*([^<]+?)\s*</loc>"), F.lit(1))
