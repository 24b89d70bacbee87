"""URL helpers written as regular expressions, so that bad input gives null and never raises."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ABSOLUTE = r"^[a-zA-Z][a-zA-Z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]+)"
ORIGIN = r"^([a-zA-Z][a-zA-Z0-9+.\-]*://[^/?#]+)"


def host_of(url: Column) -> Column:
    """Lower-case host without a leading ``www.``; empty when the URL is not absolute."""
    host = F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), ABSOLUTE, 1))
    return F.regexp_replace(host, r"^www\.", "")


def origin_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, ORIGIN, 1))


def path_of(url: Column) -> Column:
    """Path of an absolute URL without trailing slashes, ``/`` when nothing is left."""
    path = F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.\-]*://[^/?#]+([^?#]*)", 1)
    bare = F.regexp_replace(path, "/+$", "")
    return F.when(bare == "", "/").otherwise(bare)


def safe_url(raw: Column) -> Column:
    """Add ``https://`` where no scheme is given; only http and https pass."""
    full = F.when(raw.startswith("http"), raw).otherwise(F.concat(F.lit("https://"), raw))
    return F.when((raw != "") & full.rlike(r"^(?i)https?://[^/?#\s]+"), full)


def resolve(href: Column, base: Column) -> Column:
    """Absolute form of ``href`` on a page at ``base``; null when neither is absolute."""
    origin = F.regexp_extract(base, ORIGIN, 1)
    folder = F.regexp_replace(F.regexp_extract(base, r"^([^?#]*)", 1), r"(://[^/]+.*/)[^/]*$", "$1")
    folder = F.when(folder.rlike(r"://[^/]+$"), F.concat(folder, F.lit("/"))).otherwise(folder)
    return (
        F.when(href.rlike(r"^[a-zA-Z][a-zA-Z0-9+.\-]*:"), href)
        .when(origin == "", F.lit(None).cast("string"))
        .when(href.startswith("//"), F.concat(F.regexp_extract(origin, r"^([^/]+:)", 1), href))
        .when(href.startswith("/"), F.concat(origin, href))
        .when(href.startswith("?"), F.concat(F.regexp_extract(base, r"^([^?#]*)", 1), href))
        .otherwise(F.concat(folder, href))
    )


def maps_url(place_id: Column) -> Column:
    return F.concat(F.lit("https://www.google.com/maps/place/?q=place_id:"), place_id)


def report_cell(website: Column, has_screenshot: Column) -> Column:
    """Spreadsheet link to the page-speed report; a dash without a website."""
    label = F.when(has_screenshot, "PSI звіт + скрін").otherwise("PSI звіт")
    link = F.concat(
        F.lit('=HYPERLINK("https://pagespeed.web.dev/analysis?url='),
        F.replace(F.url_encode(website), F.lit("+"), F.lit("%20")),
        F.lit('","'), label, F.lit('")'),
    )
    return F.when(website.isNotNull(), link).otherwise("—")
