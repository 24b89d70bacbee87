"""Site structure from a page's own links or from a site map."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sitegauge.functions.text import bind
from sitegauge.functions.urls import origin_of, path_of, resolve

# --- fixed values -----------------------------------------------------------
CATALOG = r"(?i)/(menu|shop|store|catalog|catalogue|products?|services?|prices?|pricing|portfolio|gallery)\b"
SHOP_PATH = r"(?i)/(cart|checkout|basket)\b"
SHOP_MARKUP = (
    r"(?i)add[- _]?to[- _]?cart|woocommerce-cart|wc-block-cart|data-product-id|snipcart"
    r"|shopping[- _]?cart|plugins/woocommerce"
)
FILE_SUFFIX = r"(?i)\.(jpg|jpeg|png|gif|svg|webp|pdf|zip|doc|docx|xls|mp4|css|js)$"
NOT_A_PAGE = r"(?i)^(mailto:|tel:|javascript:|data:)"
LANGUAGE_SEGMENT = r"(?i)^/(ru|uk|ua|en|es|pl)(?:/|$)"
HREF = r"""(?i)href=["']([^"'#]+)["']"""
# --- end of fixed values ----------------------------------------------------


def page_links(html: Column, base_url: Column) -> Column:
    """Distinct page addresses of the same origin that the page links to."""
    hrefs = F.filter(
        F.regexp_extract_all(html, F.lit(HREF), F.lit(1)), lambda h: ~h.rlike(NOT_A_PAGE)
    )
    absolute = F.transform(F.array_distinct(hrefs), lambda h: resolve(h, base_url))
    rooted = F.transform(
        absolute, lambda u: F.regexp_replace(u, r"^([a-zA-Z][a-zA-Z0-9+.\-]*://[^/?#]+)$", "$1/")
    )
    own = F.filter(
        rooted,
        lambda u: u.isNotNull() & (origin_of(u) == origin_of(base_url)) & ~path_of(u).rlike(FILE_SUFFIX),
    )
    return F.array_distinct(own)


def paths(urls: Column) -> Column:
    return F.transform(urls, path_of)


def first_segments(path_list: Column) -> Column:
    """Page types: the first path segment, one template each."""
    return F.array_distinct(F.transform(path_list, lambda p: F.element_at(F.split(p, "/"), 2)))


def language_segments(path_list: Column) -> Column:
    codes = F.transform(path_list, lambda p: F.lower(F.regexp_extract(p, LANGUAGE_SEGMENT, 1)))
    return F.array_distinct(F.filter(codes, lambda c: c != ""))


def shop_markup(html: Column, low: Column) -> Column:
    """Marks of a shop system; a page without these words skips the pattern."""
    worded = low.contains("cart") | low.contains("woocommerce") | low.contains("product-id")
    return worded & html.rlike(SHOP_MARKUP)


def has_form(low: Column) -> Column:
    """A form with a field between its tags; an unclosed one reaches to the next form or the end."""

    def with_field(part: Column) -> Column:
        inside = F.substring_index(F.substring_index(part, "</form", 1), "<form", 1)
        return (F.instr(inside, ">") > 0) & (inside.contains("<input") | inside.contains("<textarea"))

    def any_of(parts: Column) -> Column:
        return F.exists(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))), with_field)

    return low.contains("<form") & bind(F.split(low, "<form", -1), any_of)


def structure(html: Column, low: Column, path_list: Column) -> Column:
    """Counts and flags; ``path_list`` comes from the site map or from the page's links."""
    return F.struct(
        F.greatest(F.lit(1), F.size(path_list)).alias("page_count"),
        F.greatest(F.lit(1), F.size(first_segments(path_list))).alias("unique_page_types"),
        (F.exists(path_list, lambda p: p.rlike(CATALOG)) | html.rlike(CATALOG)).alias("has_catalog"),
        (F.exists(path_list, lambda p: p.rlike(SHOP_PATH)) | shop_markup(html, low)).alias("has_ecommerce"),
        has_form(low).alias("has_forms"),
        F.greatest(F.lit(1), F.size(language_segments(path_list))).alias("languages"),
    )
