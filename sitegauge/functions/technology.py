"""Technology and mark-up age, read from lower-cased HTML.

Rules that are plain words use ``contains`` (a byte search); only the rest are
regular expressions.  Lower-casing once replaces a case-folding flag per rule.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from sitegauge import texts
from sitegauge.functions.text import bind


@dataclass(frozen=True)
class TechRule:
    name: str
    words: tuple[str, ...] = ()
    pattern: str | None = None
    # Every match of ``pattern`` contains one of these: the byte search spares the regex on most pages.
    needs: tuple[str, ...] = ()

    def test(self, low: Column) -> Column:
        tests = [low.contains(w) for w in self.words]
        if self.pattern and self.needs:
            worded = low.contains(self.needs[0])
            for word in self.needs[1:]:
                worded = worded | low.contains(word)
            tests.append(worded & low.rlike(self.pattern))
        elif self.pattern:
            tests.append(low.rlike(self.pattern))
        out = tests[0]
        for t in tests[1:]:
            out = out | t
        return out


# --- fixed values: fingerprints, first match wins in the first three lists -----
CMS = (
    TechRule("WordPress", ("wp-content/", "wp-includes/"), "<meta[^>]+generator[^>]+wordpress", ("wordpress",)),
    TechRule("Joomla", ("/media/jui/",), "<meta[^>]+generator[^>]+joomla", ("joomla",)),
    TechRule("Drupal", ("/sites/default/files/", "drupal.settings"), "<meta[^>]+generator[^>]+drupal", ("drupal",)),
    TechRule("Magento", ("/skin/frontend/", "mage.cookies"), r"static/version\d+/frontend", ("static/version",)),
    TechRule("PrestaShop", ("prestashop",)),
    TechRule("DotNetNuke", ("dnncore", "dnn_", "dotnetnuke")),
    TechRule("Bitrix", ("bitrix/js", "bitrix/templates", "bitrix/cache")),
)
BUILDERS = (
    TechRule("Wix", ("static.wixstatic.com", "wix-code", "_wixcssstates", "x-wix-")),
    TechRule("Squarespace", ("squarespace.com", "static1.squarespace", "static.squarespace_context")),
    TechRule("GoDaddy Website Builder", ("websitebuilder.godaddy", "img1.wsimg.com")),
    TechRule("Weebly", ("weebly.com", "editmysite.com")),
    TechRule("Shopify", ("cdn.shopify.com", "shopify.theme")),
    TechRule("Tilda", ("tildacdn", "tilda.cc")),
    TechRule("Duda", ("dudamobile", "dudaone", "irp-cdn.multiscreensite")),
    TechRule("Webflow", ("webflow.com", "webflow.io", "data-wf-page")),
    TechRule("Site123", ("site123.me",)),
    TechRule("Jimdo", ("jimdo.com", "jimdostatic.com")),
    TechRule("Web.com / Network Solutions", ("web.com/builder", "netsol")),
)
MODERN = (
    TechRule("Next.js", ("/_next/static/", "__next_data__")),
    TechRule("Nuxt", ("/_nuxt/", "__nuxt__")),
    TechRule("Astro", ("astro-island", "data-astro-cid")),
    TechRule("Remix", ("__remixcontext", "/build/manifest-")),
    TechRule("SvelteKit", ("/_app/immutable/", "__sveltekit")),
    TechRule("Gatsby", ("___gatsby", "page-data.json")),
    TechRule(
        "Tailwind (JIT build)", (), r"""class=["'][^"']*\b(?:md|lg):(?:flex|grid|hidden|w-|px-|py-)""", ("md:", "lg:")
    ),
)
FLASH_PATTERN = r"\.swf\b|<embed[^>]+swf"
OLD_STACK = (
    TechRule("AngularJS 1.x", ("angular.min.js", "ng-app=")),
    TechRule("Prototype.js", ("prototype.js",)),
    TechRule("MooTools", ("mootools",)),
    TechRule("Flash", ("application/x-shockwave-flash",), FLASH_PATTERN, ("swf",)),
    TechRule("Silverlight", ("application/x-silverlight",), r"\.xap\b", (".xap",)),
    TechRule("Font Awesome 4", ("font-awesome/4.",), """fa-fw["' ]""", ("fa-fw",)),
    TechRule("Google Fonts (legacy)", ("fonts.googleapis.com/css?family=",)),
    TechRule("jQuery UI", ("jquery-ui",)),
)
JQUERY_VERSION = (
    r"jquery[.-](\d+\.\d+(?:\.\d+)?)(?:\.min)?\.js",
    r"jquery\s+v?(\d+\.\d+(?:\.\d+)?)",
    r"jquery/(\d+\.\d+(?:\.\d+)?)/",
)
JQUERY_FILE = r"jquery(\.min)?\.js"
BOOTSTRAP_VERSION = (
    r"bootstrap[.-](\d+)\.\d+(?:\.\d+)?(?:\.min)?\.(?:js|css)",
    r"bootstrap\s+v(\d+)\.",
    r"bootstrap/(\d+)\.\d+",
)
# Here and below the first character, a class of its own, rejects most positions.
COPYRIGHT_MARK = r"[©&c(](?:(?<=©)|(?<=&)copy;|(?<=c)opyright|(?<=\()c\))"
MARKED_YEAR = r"^[^<>]*?((?:19|20)\d{2})"
YEAR_RANGE = r"([12](?:(?<=1)9|(?<=2)0)\d{2})\s*(?:—|-|–)\s*((?:19|20)\d{2})"
# --- end of fixed values --------------------------------------------------------

TABLE_OPEN = r"<table\b"
TABLE_CLOSE = r"</table\s*>"


def first_rule(low: Column, rules: tuple[TechRule, ...]) -> Column:
    """Name of the first rule that holds; ``when`` stops at it."""
    out = F.when(rules[0].test(low), rules[0].name)
    for rule in rules[1:]:
        out = out.when(rule.test(low), rule.name)
    return out


def all_rules(low: Column, rules: tuple[TechRule, ...]) -> list[Column]:
    return [F.when(rule.test(low), rule.name) for rule in rules]


def _first_group(low: Column, patterns: tuple[str, ...]) -> Column:
    return F.coalesce(*[F.nullif(F.regexp_extract(low, p, 1), F.lit("")) for p in patterns])


def jquery_version(low: Column) -> Column:
    return F.when(low.contains("jquery"), _first_group(low, JQUERY_VERSION))


def jquery_unversioned(low: Column) -> Column:
    return low.contains("jquery") & low.rlike(JQUERY_FILE)


def bootstrap_major(low: Column) -> Column:
    return F.when(low.contains("bootstrap"), _first_group(low, BOOTSTRAP_VERSION).try_cast("int"))


def has_flash(low: Column) -> Column:
    return OLD_STACK[3].test(low)


def table_layout(low: Column) -> Column:
    """At least three tables, with a second one opened before the first is closed.

    Counting opens in front of the first close needs one pass and no lazy pattern.
    """
    closed_at = F.regexp_instr(low, F.lit(TABLE_CLOSE))
    before = F.left(low, closed_at - 1)
    return (
        low.contains("<table")
        & (F.regexp_count(low, F.lit(TABLE_OPEN)) >= 3)
        & (closed_at > 0)
        & (F.regexp_count(before, F.lit(TABLE_OPEN)) >= 2)
    )


def footer_year(low: Column, this_year: int) -> Column:
    """Latest plausible copyright year of the (lower-cased) page.

    The page is cut at the copyright marks; of each part, the first year in front of a tag counts, so the work is
    linear however many marks there are.
    """
    none = F.array().cast("array<string>")
    marked = low.contains("©") | low.contains("&copy;") | low.contains("copyright") | low.contains("(c)")
    dashed = low.contains("-") | low.contains("–") | low.contains("—")
    after = lambda parts: F.transform(
        F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))), lambda t: F.regexp_extract(t, MARKED_YEAR, 1)
    )
    years = F.concat(
        F.when(marked, bind(F.split(low, COPYRIGHT_MARK, -1), after)).otherwise(none),
        F.when(dashed, F.regexp_extract_all(low, F.lit(YEAR_RANGE), F.lit(2))).otherwise(none),
    )
    numbers = F.transform(years, lambda y: y.try_cast("int"))
    return F.array_max(F.filter(numbers, lambda y: y.between(1995, this_year + 1)))


def stack_names(low: Column, cms: Column, builder: Column, modern: Column, jquery: Column,
                bootstrap: Column, tables: Column) -> Column:
    """Names of everything found, in detection order, without repeats."""
    items = [
        cms, builder, modern,
        F.when(jquery.isNotNull(), F.concat(F.lit("jQuery "), jquery)).when(
            jquery_unversioned(low), texts.JQUERY_UNKNOWN
        ),
        F.when(bootstrap > 0, F.concat(F.lit("Bootstrap "), bootstrap.cast("string"))),
        *all_rules(low, OLD_STACK),
        F.when(tables, texts.TABLES),
    ]
    return F.array_distinct(F.array_compact(F.array(*items)))
