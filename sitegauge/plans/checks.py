"""SQL building blocks of the DuckDB checks, written independently of the operators.

Regular expressions are RE2: ASCII ``\\b``, no look-around.
"""

from __future__ import annotations

# Mark-up that the stored pages lack, added by key, so that every detector finds something and nothing somewhere.
# Both engines read this expression.
RICH_HTML = """(html || CASE CAST(page_id % 7 AS INT)
  WHEN 0 THEN '<meta name="viewport" content="width=device-width"><link rel="icon" href="/i.png"><meta property="og:title" content="t">'
  WHEN 1 THEN '<form action="/a"><p>x</p><input name=q></form><script src="/js/jquery-1.' || CAST(page_id % 12 AS STRING) || '.1.min.js"></script>'
  WHEN 2 THEN '<table><tr><td><table></table></td></tr></table><table></table><div>Copyright of all parts ' || CAST(2005 + page_id % 22 AS STRING) || '</div>'
  WHEN 3 THEN '<link rel="alternate" hreflang="fr" href="/fr/"><link rel="alternate" hreflang="de-AT" href="/de/"><a href="/fr/about">fr</a>'
  WHEN 4 THEN '<link href="/wp-content/themes/x.css"><link href="/css/bootstrap-3.3.' || CAST(page_id % 8 AS STRING) || '.min.css"><img src="http://pics.example/a.png">'
  WHEN 5 THEN '<a href="/shop/cart">Add to cart</a><script id="__NEXT_DATA__"></script><a href="/shop/a">a</a><a href="/blog/b?lang=de">b</a>'
  ELSE '<meta name="description" content="about ' || CAST(page_id AS STRING) || '"><embed src="a.swf"><meta charset="utf-8">' END
  || CASE WHEN page_id % 5 = 0 THEN '<a href="mailto:Info' || CAST(page_id AS STRING) || '@firm' || CAST(page_id % 9 AS STRING) || '.international?subject=x">m</a>' ELSE '' END
  || CASE WHEN page_id % 10 = 0 THEN '<p>or sales@firm.example.org</p>' ELSE '' END
  || CASE WHEN page_id % 11 = 3 THEN '<img src="https://static.wixstatic.com/x.png">' WHEN page_id % 11 = 4 THEN '<script src="https://cdn.shopify.com/s.js"></script>' ELSE '' END
  || CASE WHEN page_id % 13 = 2 THEN '<form><textarea></textarea></form><form></form><footer>(c) 2011 - 2024</footer>' ELSE '' END)"""
RICH_PAGES = f"(SELECT * REPLACE ({RICH_HTML} AS html) FROM pages) AS rich"

PAGE_BASE = """
pg AS (SELECT page_id, url, html, lower(html) AS low,
              regexp_replace(lower(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.\\-]*://(?:[^/?#@]*@)?([^/?#:]+)', 1)), '^www\\.', '') AS host
       FROM @PAGES@)
"""

_TITLE = """nullif(trim(replace(replace(replace(replace(regexp_replace(regexp_extract(html, '(?i)<title[^>]*>([\\s\\S]*?)</title>', 1), '<[^>]+>', '', 'g'), '&nbsp;', ' '), '&amp;', '&'), '&lt;', '<'), '&gt;', '>')), '')"""
_H1 = _TITLE.replace("title", "h1")

PAGE_FACTS = PAGE_BASE + f""",
facts AS (
  SELECT page_id, url, host, html, low,
    regexp_matches(html, '(?i)<meta[^>]*\\sname\\s*=\\s*["'']?viewport["''\\s/>]') AS has_viewport,
    starts_with(lower(url), 'https:') AS https,
    starts_with(lower(url), 'https:') AND
      len(regexp_extract_all(html, '(?i)(?:src|href)=["'']http://')) > len(regexp_extract_all(html, '(?i)(?:src|href)=["'']http://localhost')) AS mixed_content,
    regexp_matches(html, '(?i)<meta[^>]+charset') AS charset_declared,
    {_TITLE} AS title,
    {_H1} AS h1,
    nullif(trim(regexp_extract(regexp_extract(html, '(?i)<meta[^>]*\\sname\\s*=\\s*["'']?description["''\\s/>][^>]*>?'), '(?i)\\scontent\\s*=\\s*"([^"]*)"', 1)), '') AS meta_description,
    regexp_matches(html, '(?i)<meta[^>]*\\sproperty\\s*=\\s*["'']?og:') AS og_tags,
    regexp_matches(html, '(?i)<link[^>]*\\srel\\s*=\\s*["'']?[^"''>]*icon') AS favicon,
    nullif(coalesce(nullif(regexp_extract(low, 'jquery[.-](\\d+\\.\\d+(?:\\.\\d+)?)(?:\\.min)?\\.js', 1), ''),
             nullif(regexp_extract(low, 'jquery\\s+v?(\\d+\\.\\d+(?:\\.\\d+)?)', 1), ''),
             regexp_extract(low, 'jquery/(\\d+\\.\\d+(?:\\.\\d+)?)/', 1)), '') AS jquery_version,
    TRY_CAST(coalesce(nullif(regexp_extract(low, 'bootstrap[.-](\\d+)\\.\\d+(?:\\.\\d+)?(?:\\.min)?\\.(?:js|css)', 1), ''),
             nullif(regexp_extract(low, 'bootstrap\\s+v(\\d+)\\.', 1), ''),
             regexp_extract(low, 'bootstrap/(\\d+)\\.\\d+', 1)) AS INTEGER) AS bootstrap_major,
    regexp_matches(low, '\\.swf\\b|application/x-shockwave-flash|<embed[^>]+swf') AS has_flash,
    len(regexp_extract_all(low, '<table\\b')) >= 3 AND regexp_matches(low, '</table\\s*>') AND
      len(regexp_extract_all(string_split_regex(low, '</table\\s*>')[1], '<table\\b')) >= 2 AS table_layout,
    CASE WHEN regexp_matches(low, 'wp-content/|wp-includes/|<meta[^>]+generator[^>]+wordpress') THEN 'WordPress'
         WHEN regexp_matches(low, '/media/jui/|<meta[^>]+generator[^>]+joomla') THEN 'Joomla'
         WHEN regexp_matches(low, '/sites/default/files/|drupal\\.settings|<meta[^>]+generator[^>]+drupal') THEN 'Drupal'
         WHEN regexp_matches(low, '/skin/frontend/|mage\\.cookies|static/version\\d+/frontend') THEN 'Magento'
         WHEN regexp_matches(low, 'prestashop') THEN 'PrestaShop'
         WHEN regexp_matches(low, 'dnn(core|_)|dotnetnuke') THEN 'DotNetNuke'
         WHEN regexp_matches(low, 'bitrix/(js|templates|cache)') THEN 'Bitrix' END AS cms,
    CASE WHEN regexp_matches(low, 'static\\.wixstatic\\.com|wix-code|_wixcssstates|x-wix-') THEN 'Wix'
         WHEN regexp_matches(low, 'squarespace\\.com|static1\\.squarespace|static\\.squarespace_context') THEN 'Squarespace'
         WHEN regexp_matches(low, 'websitebuilder\\.godaddy|img1\\.wsimg\\.com') THEN 'GoDaddy Website Builder'
         WHEN regexp_matches(low, 'weebly\\.com|editmysite\\.com') THEN 'Weebly'
         WHEN regexp_matches(low, 'cdn\\.shopify\\.com|shopify\\.theme') THEN 'Shopify'
         WHEN regexp_matches(low, 'tilda(cdn|\\.cc)') THEN 'Tilda'
         WHEN regexp_matches(low, 'dudamobile|dudaone|irp-cdn\\.multiscreensite') THEN 'Duda'
         WHEN regexp_matches(low, 'webflow\\.(com|io)|data-wf-page') THEN 'Webflow'
         WHEN regexp_matches(low, 'site123\\.me') THEN 'Site123'
         WHEN regexp_matches(low, 'jimdo(static)?\\.com') THEN 'Jimdo'
         WHEN regexp_matches(low, 'web\\.com/builder|netsol') THEN 'Web.com / Network Solutions' END AS builder,
    CASE WHEN regexp_matches(low, '/_next/static/|__next_data__') THEN 'Next.js'
         WHEN regexp_matches(low, '/_nuxt/|__nuxt__') THEN 'Nuxt'
         WHEN regexp_matches(low, 'astro-island|data-astro-cid') THEN 'Astro'
         WHEN regexp_matches(low, '__remixcontext|/build/manifest-') THEN 'Remix'
         WHEN regexp_matches(low, '/_app/immutable/|__sveltekit') THEN 'SvelteKit'
         WHEN regexp_matches(low, '___gatsby|page-data\\.json') THEN 'Gatsby'
         WHEN regexp_matches(low, 'class=["''][^"'']*\\b(?:md|lg):(?:flex|grid|hidden|w-|px-|py-)') THEN 'Tailwind (JIT build)' END AS modern_framework,
    list_max(list_filter(list_transform(list_concat(
        regexp_extract_all(html, '(?i)(?:©|&copy;|copyright|\\(c\\))[^<>]*?((?:19|20)\\d{{2}})', 1),
        regexp_extract_all(html, '((?:19|20)\\d{{2}})\\s*(?:—|-|–)\\s*((?:19|20)\\d{{2}})', 2)),
      lambda y: CAST(y AS INTEGER)), lambda y: y BETWEEN 1995 AND 2027)) AS footer_year
  FROM pg)
"""

# Links of the same origin, as paths.
PAGE_PATHS = """
links AS (
  SELECT page_id, url, html, regexp_extract(url, '^([a-zA-Z][a-zA-Z0-9+.\\-]*://[^/?#]+)', 1) AS origin,
         regexp_extract(url, '^([^?#]*)', 1) AS bare,
         list_filter(list_distinct(regexp_extract_all(html, '(?i)href=["'']([^"''#]+)["'']', 1)),
                     lambda h: NOT regexp_matches(h, '(?i)^(mailto:|tel:|javascript:|data:)')) AS hrefs
  FROM @PAGES@),
urls AS (
  SELECT page_id, url, html, list_distinct(list_filter(list_transform(hrefs, lambda h:
      regexp_replace(CASE WHEN regexp_matches(h, '^[a-zA-Z][a-zA-Z0-9+.\\-]*:') THEN h
           WHEN starts_with(h, '//') THEN regexp_extract(origin, '^([^/]+:)', 1) || h
           WHEN starts_with(h, '/') THEN origin || h
           WHEN starts_with(h, '?') THEN bare || h
           ELSE CASE WHEN regexp_matches(bare, '://[^/]+$') THEN bare || '/' ELSE regexp_replace(bare, '(://[^/]+.*/)[^/]*$', '\\1') END || h END,
        '^([a-zA-Z][a-zA-Z0-9+.\\-]*://[^/?#]+)$', '\\1/')),
      lambda u: lower(regexp_extract(u, '^([a-zA-Z][a-zA-Z0-9+.\\-]*://[^/?#]+)', 1)) = lower(origin)
                AND NOT regexp_matches(regexp_extract(u, '^[a-zA-Z][a-zA-Z0-9+.\\-]*://[^/?#]+([^?#]*)', 1), '(?i)\\.(jpg|jpeg|png|gif|svg|webp|pdf|zip|doc|docx|xls|mp4|css|js)/*$'))) AS us
  FROM links),
paths AS (
  SELECT page_id, url, html, list_transform(us, lambda u:
      coalesce(nullif(regexp_replace(regexp_extract(u, '^[a-zA-Z][a-zA-Z0-9+.\\-]*://[^/?#]+([^?#]*)', 1), '/+$', ''), ''), '/')) AS ps
  FROM urls),
structure AS (
  SELECT page_id, url, html, ps, greatest(1, len(ps)) AS page_count,
         greatest(1, len(list_distinct(list_transform(ps, lambda p: split_part(p, '/', 2))))) AS unique_page_types,
         len(list_filter(ps, lambda p: regexp_matches(p, '(?i)/(menu|shop|store|catalog|catalogue|products?|services?|prices?|pricing|portfolio|gallery)\\b'))) > 0
           OR regexp_matches(html, '(?i)/(menu|shop|store|catalog|catalogue|products?|services?|prices?|pricing|portfolio|gallery)\\b') AS has_catalog,
         len(list_filter(ps, lambda p: regexp_matches(p, '(?i)/(cart|checkout|basket)\\b'))) > 0
           OR regexp_matches(html, '(?i)add[- _]?to[- _]?cart|woocommerce-cart|wc-block-cart|data-product-id|snipcart|shopping[- _]?cart|plugins/woocommerce') AS has_ecommerce,
         len(list_filter(string_split(lower(html), '<form')[2:], lambda p: contains(split_part(p, '</form', 1), '>') AND regexp_matches(split_part(p, '</form', 1), '<(?:input|textarea)'))) > 0 AS has_forms,
         greatest(1, len(list_distinct(list_filter(list_transform(ps, lambda p: lower(regexp_extract(p, '(?i)^/(ru|uk|ua|en|es|pl)(?:/|$)', 1))), lambda c: c <> '')))) AS languages
  FROM paths)
"""


def quality(facts: str = "facts", psi: str | None = None) -> str:
    """CTE ``quality`` (page_id, raw, score10, dated) from ``facts``; ``psi`` has one row per page_id."""
    speed = """
      + CASE WHEN mobile_score < 30 THEN 25 WHEN mobile_score < 50 THEN 18 WHEN mobile_score < 80 THEN 8 ELSE 0 END
      + CASE WHEN lcp_ms > 10000 THEN 30 WHEN lcp_ms > 6000 THEN 20 WHEN lcp_ms > 4000 THEN 12 WHEN lcp_ms > 2500 THEN 5 ELSE 0 END
      + CASE WHEN cls > 0.5 THEN 10 WHEN cls > 0.25 THEN 5 ELSE 0 END""" if psi else ""
    join = f"LEFT JOIN {psi} USING (page_id)" if psi else ""
    return f"""
scored AS (
  SELECT {facts}.*, {'mobile_score, desktop_score, lcp_ms, cls,' if psi else ''}
    octet_length(encode(html)) > 0 AND octet_length(encode(html)) < 2000 AND title IS NULL AS stub,
    100 - (CASE WHEN has_viewport THEN 0 ELSE 25 END + CASE WHEN https THEN 0 ELSE 15 END
      + CASE WHEN mixed_content THEN 8 ELSE 0 END {speed}
      + CASE WHEN TRY_CAST(split_part(jquery_version, '.', 1) AS INTEGER) <= 2 THEN 8 ELSE 0 END
      + CASE WHEN has_flash THEN 15 ELSE 0 END + CASE WHEN table_layout THEN 10 ELSE 0 END
      + CASE WHEN bootstrap_major <= 3 THEN 6 ELSE 0 END + CASE WHEN charset_declared THEN 0 ELSE 3 END
      + CASE WHEN 2026 - footer_year >= 3 THEN 10 ELSE 0 END
      + CASE WHEN title IS NULL OR meta_description IS NULL THEN 5 ELSE 0 END
      + CASE WHEN h1 IS NULL THEN 3 ELSE 0 END + CASE WHEN og_tags THEN 0 ELSE 4 END
      + CASE WHEN favicon THEN 0 ELSE 2 END) + CASE WHEN modern_framework IS NOT NULL THEN 25 ELSE 0 END AS points,
    list_filter([CASE WHEN NOT has_viewport THEN 'не адаптивний' END, CASE WHEN table_layout THEN 'верстка таблицями' END,
      CASE WHEN has_flash THEN 'Flash' END, CASE WHEN NOT https THEN 'нема HTTPS' END,
      CASE WHEN TRY_CAST(split_part(jquery_version, '.', 1) AS INTEGER) <= 2 THEN 'jQuery ' || jquery_version END,
      CASE WHEN bootstrap_major <= 3 THEN 'Bootstrap ' || bootstrap_major END,
      CASE WHEN 2026 - footer_year >= 3 THEN 'копірайт ' || footer_year END,
      CASE WHEN regexp_matches(builder, '(?i)GoDaddy|Weebly|Site123|Jimdo|Web\\.com|Network Solutions|Wix') THEN 'конструктор ' || builder END,
      CASE WHEN NOT charset_declared THEN 'нема meta charset' END], lambda m: m IS NOT NULL) AS dated
  FROM {facts} {join}),
quality AS (
  SELECT *, CASE WHEN stub THEN 'blocked' ELSE 'ok' END AS status,
         CASE WHEN stub THEN 50 ELSE greatest(0, least(100, points)) END AS raw,
         CASE WHEN stub THEN 5 ELSE greatest(1, least(10, CAST(floor(greatest(0, least(100, points)) / 10.0 + 0.5) AS INTEGER))) END AS score10,
         CASE WHEN stub THEN '' ELSE array_to_string(dated, '; ') END AS markers
  FROM scored)
"""


# Visible text; the test pages hold no numeric entities.
def visible_text(html: str = "html") -> str:
    out = html
    for tag in ("script", "style", "noscript"):
        out = f"regexp_replace({out}, '(?i)<{tag}[\\s\\S]*?</{tag}>', ' ', 'g')"
    out = f"regexp_replace({out}, '<[^>]+>', ' ', 'g')"
    for name, char in (("&nbsp;", " "), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">")):
        out = f"replace({out}, '{name}', '{char}')"
    return f"trim(regexp_replace({out}, '\\s+', ' ', 'g'))"


def normalized(html: str = "html") -> str:
    out = html
    for pattern in ("(?i)<script[\\s\\S]*?</script>", "(?i)<style[\\s\\S]*?</style>", "<!--[\\s\\S]*?-->"):
        out = f"regexp_replace({out}, '{pattern}', '', 'g')"
    return f"trim(regexp_replace({out}, '\\s+', ' ', 'g'))"


EMAIL = "[A-Za-z0-9_][A-Za-z0-9._%+\\-]*@(?:[A-Za-z0-9\\-]+\\.)+[A-Za-z]{2,}\\b"
BLOCKED = (
    "(?i)@(?:example|sentry|wixpress|squarespace|godaddy|schema|w3|sentry\\.io|2x|domain)\\."
    "|\\.(?:png|jpg|jpeg|gif|svg|webp|css|js)$"
    "|^(?:info|email|your|name|user)@(?:email|domain|website|company|yoursite)\\."
)


def addresses(text: str) -> str:
    """Valid plain addresses of a text, lower case, in order."""
    found = f"list_transform(regexp_extract_all({text}, '\\b{EMAIL}'), lambda e: lower(e))"
    return f"list_filter({found}, lambda e: NOT regexp_matches(e, '{BLOCKED}'))"


def stripped(text: str) -> str:
    out = f"regexp_replace({text}, '(?i)data:[a-z+/\\-]+;base64,[A-Za-z0-9+/=]+', 'data:stripped', 'g')"
    return f"regexp_replace({out}, '[A-Za-z0-9+/]{{200,}}={{0,2}}', ' ', 'g')"


def spelled(text: str) -> str:
    out = f"regexp_replace({text}, '(?i)\\s*\\(\\s*at\\s*\\)\\s*|\\s+at\\s+', '@', 'g')"
    return f"regexp_replace({out}, '(?i)\\s*\\(\\s*dot\\s*\\)\\s*|\\s+dot\\s+', '.', 'g')"


RANK = (
    "CASE WHEN regexp_matches(e, '^(info|contact|office|hello|sales|admin)@') THEN 0 "
    "WHEN regexp_matches(e, '^(support|help|service)@') THEN 1 "
    "WHEN regexp_matches(e, '^(no-?reply|donotreply)@') THEN 9 ELSE 5 END"
)


def email_ctes(source: str, key: str, text: str) -> str:
    """CTE ``best`` (key, emails) of the addresses per row, best first."""
    return f"""
sure AS (SELECT {key}, {text} AS body, list_concat(
            list_filter(list_transform(regexp_extract_all({text}, '(?i)mailto:([^"''?>\\s]{{3,}})', 1), lambda m: trim(lower(url_decode(m)))),
                        lambda e: contains(e, '@') AND NOT regexp_matches(e, '{BLOCKED}')),
            {addresses(stripped(text))}) AS found FROM {source}),
picked AS (SELECT {key}, CASE WHEN len(found) > 0 THEN found ELSE {addresses(spelled(stripped('body')))} END AS found FROM sure),
each AS (SELECT {key}, e, min(i) AS i FROM (SELECT {key}, unnest(found) AS e, generate_subscripts(found, 1) AS i FROM picked) GROUP BY {key}, e),
best AS (SELECT {key}, string_agg(e, ',' ORDER BY r) AS emails, CAST(max(total) AS BIGINT) AS total FROM (
            SELECT {key}, e, row_number() OVER (PARTITION BY {key} ORDER BY {RANK}, i) AS r,
                   count(*) OVER (PARTITION BY {key}) AS total FROM each) GROUP BY {key})
"""

PAGE_BASE, PAGE_FACTS, PAGE_PATHS = (x.replace("@PAGES@", RICH_PAGES) for x in (PAGE_BASE, PAGE_FACTS, PAGE_PATHS))
