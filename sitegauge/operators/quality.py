"""Page status, quality score with reasons, dated markers, design-age score."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitegauge import texts
from sitegauge.functions.text import clamp, phrase, round_half_up

# --- fixed values -----------------------------------------------------------
BLOCKED_STATUSES = (401, 403, 406, 429, 451)
STUB_BYTES = 2000
DATED_BUILDER = r"(?i)GoDaddy|Weebly|Site123|Jimdo|Web\.com|Network Solutions|Wix"
OLD_YEARS = 3
# --- end of fixed values ----------------------------------------------------

NO_SPEED = "struct<mobile_score:bigint,desktop_score:bigint,lcp_ms:bigint,cls:double>"


def _no(x: Column) -> Column:
    return ~F.coalesce(x, F.lit(False))


def _yes(x: Column) -> Column:
    return F.coalesce(x, F.lit(False))


def _blank(x: Column) -> Column:
    return F.coalesce(x, F.lit("")) == ""


def page_status(a: Column, has_site: Column) -> Column:
    """no_site, blocked, dead or ok, in this order.

    ``blocked`` comes before ``dead``: a refused request says nothing about the site,
    and a tiny answer without a title is a challenge page even with a 2xx code.
    """
    stub = a["fetch_error"].isNull() & (a["html_bytes"] > 0) & (a["html_bytes"] < STUB_BYTES) & _blank(a["title"])
    return (
        F.when(~has_site, "no_site")
        .when(_yes(a["http_status"].isin(*BLOCKED_STATUSES)), "blocked")
        .when(a.isNotNull() & _yes(stub), "blocked")
        .when(
            a.isNull() | a["fetch_error"].isNotNull() | a["http_status"].isNull()
            | (a["http_status"] == 0) | (a["http_status"] >= 500),
            "dead",
        )
        .otherwise("ok")
    )


def jquery_major(a: Column) -> Column:
    return F.split(a["jquery_version"], r"\.")[0].try_cast("int")


def penalties(a: Column, psi: Column, year: int) -> list[tuple[Column, int, Column]]:
    """(condition, points, why) for every penalty, in reporting order."""
    mobile, lcp, cls = psi["mobile_score"], psi["lcp_ms"], psi["cls"]
    mobile_text = phrase("PSI mobile %s", mobile)
    lcp_text = F.concat(F.lit("LCP "), F.format_string("%.1f", lcp / 1000), F.lit("s"))
    cls_text = F.concat(F.lit("CLS "), F.format_string("%.2f", cls))
    return [
        (_no(a["has_viewport"]), 25, F.lit(texts.NO_VIEWPORT)),
        (_no(a["https"]), 15, F.lit(texts.NO_HTTPS)),
        (_yes(a["mixed_content"]), 8, F.lit("mixed content")),
        (_yes(a["tls_expired"]), 10, F.lit(texts.EXPIRED_TLS)),
        (_yes(mobile < 30), 25, F.concat(mobile_text, F.lit(" — критично"))),
        (_yes((mobile >= 30) & (mobile < 50)), 18, mobile_text),
        (_yes((mobile >= 50) & (mobile < 80)), 8, mobile_text),
        (_yes(lcp > 10_000), 30, F.concat(lcp_text, F.lit(" — сайт практично не відкривається"))),
        (_yes((lcp > 6000) & (lcp <= 10_000)), 20, lcp_text),
        (_yes((lcp > 4000) & (lcp <= 6000)), 12, lcp_text),
        (_yes((lcp > 2500) & (lcp <= 4000)), 5, lcp_text),
        (_yes(cls > 0.5), 10, F.concat(cls_text, F.lit(" — верстка стрибає"))),
        (_yes((cls > 0.25) & (cls <= 0.5)), 5, cls_text),
        (_yes(jquery_major(a) <= 2), 8, phrase("jQuery %s", a["jquery_version"])),
        (_yes(a["has_flash"]), 15, F.lit("Flash / Silverlight")),
        (_yes(a["table_layout"]), 10, F.lit(texts.TABLES)),
        (_yes(a["bootstrap_major"] <= 3), 6, phrase("Bootstrap %s", a["bootstrap_major"])),
        (_no(a["charset_declared"]), 3, F.lit(texts.NO_CHARSET)),
        (_yes(year - a["footer_year"] >= OLD_YEARS), 10, phrase(texts.COPYRIGHT, a["footer_year"])),
        (_blank(a["title"]) | _blank(a["meta_description"]), 5, F.lit(texts.NO_TITLE_OR_DESCRIPTION)),
        (_blank(a["h1"]), 3, F.lit(texts.NO_H1)),
        (_no(a["og_tags"]), 4, F.lit(texts.NO_OPEN_GRAPH)),
        (_no(a["favicon"]), 2, F.lit(texts.NO_FAVICON)),
    ]


def dated_markers(a: Column, year: int) -> Column:
    """Signs of age that hold however fast the page loads."""
    return F.array_compact(
        F.array(
            F.when(_no(a["has_viewport"]), texts.NOT_RESPONSIVE),
            F.when(_yes(a["table_layout"]), texts.TABLES),
            F.when(_yes(a["has_flash"]), "Flash"),
            F.when(_no(a["https"]), texts.NO_HTTPS),
            F.when(_yes(jquery_major(a) <= 2), phrase("jQuery %s", a["jquery_version"])),
            F.when(_yes(a["bootstrap_major"] <= 3), phrase("Bootstrap %s", a["bootstrap_major"])),
            F.when(_yes(year - a["footer_year"] >= OLD_YEARS), phrase(texts.COPYRIGHT, a["footer_year"])),
            F.when(_yes(a["tls_expired"]), texts.EXPIRED_TLS),
            F.when(_yes(a["builder"].rlike(DATED_BUILDER)), phrase(texts.BUILDER, a["builder"])),
            F.when(_no(a["charset_declared"]), texts.NO_CHARSET),
        )
    )


def site_quality(df: DataFrame, year: int, audit: str = "audit", psi: str | None = None,
                 website: Column | None = None, name: str = "quality") -> DataFrame:
    """Add ``struct(score10, raw, reasons, status, dated_markers)``; 1 is the worst site.

    Every field is its own expression over the status, so a report that asks for the
    score only does not build the reasons.
    """
    a = F.col(audit)
    speed = F.col(psi) if psi else F.lit(None).cast(NO_SPEED)
    has_site = F.lit(True) if website is None else website.isNotNull()
    rules = penalties(a, speed, year)
    points = F.lit(100)
    for cond, pts, _ in rules:
        points = points - F.when(cond, pts).otherwise(0)
    modern = ~_blank(a["modern_framework"])
    points = points + F.when(modern, 25).otherwise(0)
    reasons = F.array_compact(
        F.array(
            *[F.when(cond, F.concat(F.lit(f"−{pts} "), why)) for cond, pts, why in rules],
            F.when(modern, phrase(texts.MODERN_STACK_BONUS, a["modern_framework"])),
        )
    )
    refused = _yes(a["http_status"].isin(*BLOCKED_STATUSES))
    blocked_reason = F.when(refused, phrase(texts.BLOCKED_STATUS, a["http_status"])).otherwise(
        phrase(texts.BLOCKED_STUB, a["html_bytes"], F.coalesce(a["http_status"].cast("string"), F.lit("null")))
    )
    dead_reason = phrase(
        texts.DEAD_REASON, F.coalesce(a["fetch_error"], a["http_status"].cast("string"), F.lit("no response"))
    )
    status, raw = F.col("_status"), F.col("_raw")
    none = F.array().cast("array<string>")

    def by_status(ok: Column, blocked: Column, dead: Column, no_site: Column) -> Column:
        return (
            F.when(status == "ok", ok).when(status == "blocked", blocked).when(status == "dead", dead).otherwise(no_site)
        )

    staged = df.withColumn("_status", page_status(a, has_site)).withColumn("_raw", clamp(points, 0, 100))
    return staged.withColumn(
        name,
        F.struct(
            by_status(clamp(round_half_up(raw / 10), 1, 10), F.lit(5), F.lit(1), F.lit(1)).alias("score10"),
            by_status(raw, F.lit(50), F.lit(0), F.lit(0)).alias("raw"),
            by_status(
                reasons, F.array(blocked_reason), F.array(dead_reason), F.array(F.lit(texts.NO_SITE_REASON))
            ).alias("reasons"),
            status.alias("status"),
            by_status(
                dated_markers(a, year), none, F.array(F.lit(texts.DEAD_MARKER)), F.array(F.lit(texts.NO_SITE_MARKER))
            ).alias("dated_markers"),
        ),
    ).drop("_status", "_raw")


def score_band(score: Column) -> Column:
    """Colour band of a score for display."""
    return F.when(score <= 3, "green").when(score <= 6, "yellow").when(score >= 8, "grey")


# --- design age -----------------------------------------------------------------
def _adjustments() -> list[tuple[Column, int, Column]]:
    c = F.col
    n = lambda name: F.coalesce(c(name), F.lit(0))
    year = c("copyright_year")
    return [
        (_yes(c("css_vars")), 12, F.lit("CSS-змінні")),
        (_yes(c("css_clamp")), 10, F.lit("clamp/min/max")),
        (n("grid_used") >= 3, 12, phrase("grid ×%s", c("grid_used"))),
        ((n("grid_used") >= 1) & (n("grid_used") < 3), 5, F.lit("grid місцями")),
        (n("flex_used") >= 20, 8, F.lit("flex скрізь")),
        ((n("flex_used") >= 5) & (n("flex_used") < 20), 4, F.lit("flex місцями")),
        (n("webp") > 0, 8, phrase("webp/avif ×%s", c("webp"))),
        (n("lazy_imgs") > 0, 5, F.lit("lazy-loading")),
        (_yes(c("jquery").startswith("1.")), -18, phrase("jQuery %s", c("jquery"))),
        (_yes(c("jquery").startswith("2.")), -12, phrase("jQuery %s", c("jquery"))),
        (_yes(c("jquery").startswith("3.")), -4, phrase("jQuery %s", c("jquery"))),
        (_yes(c("bootstrap3")), -12, F.lit("сітка Bootstrap 3")),
        (_yes(c("font_awesome4")), -8, F.lit("FontAwesome 4")),
        (_yes(c("fixed_width")), -8, F.lit("фікс. ширина 960-1170px")),
        (n("float_layout") > 25, -10, phrase("float-верстка ×%s", c("float_layout"))),
        (n("tables") > 3, -6, phrase("таблиць %s", c("tables"))),
        (_yes(year >= 2025), 6, phrase(texts.COPYRIGHT, year)),
        (_yes(year <= 2021), -10, phrase(texts.COPYRIGHT, year)),
        (_yes((year > 2021) & (year <= 2023)), -5, phrase(texts.COPYRIGHT, year)),
    ]


def design_age(probes: DataFrame) -> DataFrame:
    """Design-age score 0-100 (50 is neutral, more is newer) with its reasons."""
    score = F.lit(50)
    why = []
    for cond, pts, label in _adjustments():
        score = score + F.when(cond, pts).otherwise(0)
        why.append(F.when(cond, F.concat(F.lit(f"{pts:+d} "), label)))
    return probes.withColumn("design_score", clamp(score, 0, 100)).withColumn(
        "design_why", F.array_compact(F.array(*why))
    )


def review_plan(scored: DataFrame) -> DataFrame:
    """Decision per probed site: profile on a platform, closed, dated, modern, or undecided.

    Needs ``design_score``, ``final_host``, ``website``, ``title`` and ``error``.
    """
    from sitegauge.operators.filters import is_challenge_title, on_third_party_platform

    social = on_third_party_platform(F.col("final_host")) | on_third_party_platform(F.col("website"))
    closed = F.col("error").isNotNull() | is_challenge_title(F.col("title"))
    return scored.withColumn(
        "decision",
        F.when(social, "no_site")
        .when(closed, "keep")
        .when(F.col("design_score") <= 45, "lead")
        .when(F.col("design_score") >= 76, "reject")
        .otherwise("keep"),
    )


def label_agreement(scored: DataFrame, labels: DataFrame, key: str, cut: int = 60) -> DataFrame:
    """Confusion counts of the measured score against labels given by people."""
    measured = F.when(F.col("design_score") >= cut, "modern").otherwise("dated")
    return (
        scored.join(labels, key)
        .groupBy(measured.alias("measured"), F.col("label").alias("seen"))
        .agg(F.count("*").alias("n"))
        .withColumn("agrees", F.col("measured") == F.col("seen"))
    )
