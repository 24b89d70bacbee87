"""The published row in DuckDB SQL: all 23 columns, with the brief, on top of the CTEs of the re-score."""

from __future__ import annotations

from sitegauge.plans import checks
from sitegauge.texts import MACHINE_COLUMNS

_TENTHS = "CAST(({n} * 2000 + {d}) // (2 * {d}) AS BIGINT)"


def _percent(n: str, d: str) -> str:
    """One decimal, halves up."""
    t = _TENTHS.format(n=n, d=d)
    return f"(({t}) // 10 || '.' || ({t}) % 10)"


_SECONDS = "(((lcp_ms + 50) // 100) // 10 || '.' || ((lcp_ms + 50) // 100) % 10)"
_SOCIAL = (
    ("facebook", "(?i)https?://(?:www\\.|m\\.)?facebook\\.com/[A-Za-z0-9._%-]+"), ("instagram", "(?i)https?://(?:www\\.)?instagram\\.com/[A-Za-z0-9._%-]+"),
    ("telegram", "(?i)https?://t\\.me/[A-Za-z0-9_]+"), ("youtube", "(?i)https?://(?:www\\.)?youtube\\.com/(?:c/|channel/|@)[A-Za-z0-9._%-]+"),
    ("tiktok", "(?i)https?://(?:www\\.)?tiktok\\.com/@[A-Za-z0-9._%-]+"), ("linkedin", "(?i)https?://(?:www\\.)?linkedin\\.com/(?:company|in)/[A-Za-z0-9._%-]+"),
    ("yelp", "(?i)https?://(?:www\\.)?yelp\\.com/biz/[A-Za-z0-9._%-]+"),
)
_SERVICE = "(?i)/(tr|sharer|share|dialog|plugins|widgets|intent|login|oauth|v\\d+\\.\\d+|tr\\.js|embed|badge|profile\\.php)\\b"
_PROFILES = ", ".join(f"list_filter(regexp_extract_all(html, '{p}'), lambda x: NOT regexp_matches(x, '{_SERVICE}'))[1]" for _, p in _SOCIAL)
_SWITCHED = """(?i)href=["'']([^"'']*(?:/(?:fr|de|at)(?:/|["''?#])|[?&](?:lang|language|locale)=(?:fr|de|at)))"""
_PRESENT = "lambda x: x IS NOT NULL"
_LINES = "list_transform(list_filter({0}, lambda e: coalesce(e.d, '') <> ''), lambda e: CASE WHEN e.w > 0 THEN e.d || ' (+' || e.w || ')' ELSE e.d END)"

#: On top of state, psi, reviews, facts, quality, declared, versions, observed and the rest of the re-score.
DETAILS = f"""
{checks.PAGE_PATHS},
{checks.email_ctes(checks.RICH_PAGES, "page_id", "html").strip()},
codes AS (SELECT page_id, len(list_distinct(list_filter(list_concat(list_filter(alternates, lambda c: c IN ('fr', 'de')), [CASE WHEN html_lang IN ('fr', 'de') THEN html_lang END],
    list_transform(regexp_extract_all(html, '{_SWITCHED}', 1), lambda h: replace(lower(coalesce(nullif(regexp_extract(h, '(?i)/(fr|de|at)(?:/|["''?#])', 1), ''), regexp_extract(h, '(?i)[?&](?:lang|language|locale)=(fr|de|at)', 1))), 'at', 'de'))),
    {_PRESENT}))) AS found FROM declared),
told AS (SELECT page_id, host, hard_exclusion, CASE WHEN hard_exclusion IS NOT NULL THEN [{{'w': 0, 'd': CASE hard_exclusion WHEN 'spanish_marks' THEN 'spanish marks' ELSE 'домен ' || host END}}] ELSE list_filter([
    CASE WHEN fr > 3 AND fr / greatest(script, 1) >= 0.02 THEN {{'w': 40, 'd': fr || '× é/è/ê/ç/à/ù (' || {_percent('fr', 'greatest(script, 1)')} || '% кирилиці)'}} WHEN fr > 3 THEN {{'w': 8, 'd': 'поодинокі гліфи (' || fr || '×, лише ' || {_percent('fr', 'greatest(script, 1)')} || '%)'}} END,
    CASE WHEN de > 3 AND de / greatest(script, 1) >= 0.01 THEN {{'w': 35, 'd': de || '× ä/ö (' || {_percent('de', 'greatest(script, 1)')} || '% кирилиці)'}} WHEN de > 3 THEN {{'w': 8, 'd': 'поодинокі гліфи (' || de || '×, лише ' || {_percent('de', 'greatest(script, 1)')} || '%)'}} END,
    CASE WHEN script / greatest(length(t), 1) > 0.15 AND fr <= 3 AND de <= 3 THEN {{'w': 20, 'd': CAST((script * 200 + length(t)) // (2 * length(t)) AS BIGINT) || '% тексту кирилиця'}}
         WHEN script >= 30 AND script / greatest(length(t), 1) <= 0.15 AND fr <= 3 AND de <= 3 THEN {{'w': 15, 'd': 'кирилиця фрагментами (' || script || ' символів)'}} END,
    CASE WHEN regexp_matches(t, '(?i)@[a-z]') THEN {{'w': 20, 'd': 'mail on page'}} END,
    CASE WHEN regexp_matches(t, '(?i)@[a-z]') AND regexp_matches(html, '(?i)<li>') THEN {{'w': 5, 'd': 'mail and list'}} END,
    CASE WHEN regexp_matches(t, '\\+\\s?\\d{{2}}') THEN {{'w': 45, 'd': 'phone with country code'}} END,
    CASE WHEN regexp_matches(host, '(?i)\\.net$') THEN {{'w': 50, 'd': 'домен ' || host}} END], lambda e: e IS NOT NULL) END AS ev FROM excl),
seen_reviews AS (SELECT place_id, list_filter([
    CASE WHEN lp > 0 THEN {{'w': lp, 'd': n_target || '/' || sample_size || ' відгуків ' || CASE WHEN n_uk >= n_ru THEN 'uk' ELSE 'ru' END || CASE WHEN recent_target > 0 THEN ', ' || recent_target || ' за 3 роки' ELSE ', усі старі' END}} END,
    CASE WHEN app > 0 THEN {{'w': app, 'd': matched || '/' || authors || ' рецензентів за списком' || CASE WHEN in_script > 0 THEN ', ' || in_script || ' кирилицею' ELSE '' END}} END], lambda e: e IS NOT NULL) AS ev FROM rp),
stacks AS (SELECT page_id, list_filter([cms, builder, modern_framework,
    CASE WHEN jquery_version IS NOT NULL THEN 'jQuery ' || jquery_version WHEN regexp_matches(low, 'jquery(\\.min)?\\.js') THEN 'jQuery (версія невідома)' END,
    CASE WHEN bootstrap_major > 0 THEN 'Bootstrap ' || bootstrap_major END,
    CASE WHEN contains(low, 'angular.min.js') OR contains(low, 'ng-app=') THEN 'AngularJS 1.x' END, CASE WHEN contains(low, 'prototype.js') THEN 'Prototype.js' END,
    CASE WHEN contains(low, 'mootools') THEN 'MooTools' END, CASE WHEN has_flash THEN 'Flash' END,
    CASE WHEN contains(low, 'application/x-silverlight') OR regexp_matches(low, '\\.xap\\b') THEN 'Silverlight' END,
    CASE WHEN contains(low, 'font-awesome/4.') OR regexp_matches(low, 'fa-fw["'' ]') THEN 'Font Awesome 4' END,
    CASE WHEN contains(low, 'fonts.googleapis.com/css?family=') THEN 'Google Fonts (legacy)' END, CASE WHEN contains(low, 'jquery-ui') THEN 'jQuery UI' END,
    CASE WHEN table_layout THEN 'верстка таблицями' END], {_PRESENT}) AS names, array_to_string(list_filter([{_PROFILES}], {_PRESENT}), ' ') AS socials FROM facts),
why AS (SELECT q.page_id, CASE WHEN stub THEN ['сайт віддав ' || octet_length(encode(html)) || ' байт без заголовка (HTTP 200) — схоже на заглушку bot-protection, потрібна ручна перевірка'] ELSE list_filter([
    CASE WHEN NOT has_viewport THEN '−25 нема viewport meta — не адаптивний' END, CASE WHEN NOT https THEN '−15 нема HTTPS' END, CASE WHEN mixed_content THEN '−8 mixed content' END,
    CASE WHEN mobile_score < 30 THEN '−25 PSI mobile ' || mobile_score || ' — критично' WHEN mobile_score < 50 THEN '−18 PSI mobile ' || mobile_score WHEN mobile_score < 80 THEN '−8 PSI mobile ' || mobile_score END,
    CASE WHEN lcp_ms > 10000 THEN '−30 LCP ' || {_SECONDS} || 's — сайт практично не відкривається' WHEN lcp_ms > 6000 THEN '−20 LCP ' || {_SECONDS} || 's' WHEN lcp_ms > 4000 THEN '−12 LCP ' || {_SECONDS} || 's' WHEN lcp_ms > 2500 THEN '−5 LCP ' || {_SECONDS} || 's' END,
    CASE WHEN cls > 0.5 THEN '−10 CLS 0.' || lpad(CAST(CAST(round(cls * 100) AS BIGINT) AS VARCHAR), 2, '0') || ' — верстка стрибає' WHEN cls > 0.25 THEN '−5 CLS 0.' || lpad(CAST(CAST(round(cls * 100) AS BIGINT) AS VARCHAR), 2, '0') END,
    CASE WHEN TRY_CAST(split_part(jquery_version, '.', 1) AS INTEGER) <= 2 THEN '−8 jQuery ' || jquery_version END, CASE WHEN has_flash THEN '−15 Flash / Silverlight' END,
    CASE WHEN table_layout THEN '−10 верстка таблицями' END, CASE WHEN bootstrap_major <= 3 THEN '−6 Bootstrap ' || bootstrap_major END, CASE WHEN NOT charset_declared THEN '−3 нема meta charset' END,
    CASE WHEN 2026 - footer_year >= 3 THEN '−10 копірайт ' || footer_year END, CASE WHEN title IS NULL OR meta_description IS NULL THEN '−5 нема title або description' END,
    CASE WHEN h1 IS NULL THEN '−3 нема H1' END, CASE WHEN NOT og_tags THEN '−4 нема OpenGraph' END, CASE WHEN NOT favicon THEN '−2 нема favicon' END,
    CASE WHEN modern_framework IS NOT NULL THEN '+25 сучасний стек (' || modern_framework || ') — НЕ наш лід' END], {_PRESENT}) END AS reasons FROM quality q),
work AS (SELECT s.page_id, s.page_count, s.unique_page_types, s.has_catalog, s.has_ecommerce, s.has_forms, greatest(s.languages, CASE WHEN found > 0 THEN found + 1 ELSE 1 END) AS languages,
    10 + 3 * least(unique_page_types, 8) + CASE WHEN has_catalog THEN 6 ELSE 0 END + CASE WHEN has_ecommerce THEN 8 ELSE 0 END + CASE WHEN s.languages > 1 OR found > 0 THEN 4 ELSE 0 END + CASE WHEN has_forms THEN 3 ELSE 0 END + 4
      + CAST(floor(ceil(least(page_count, 60) / 5) * 1.5 + 0.5) AS INTEGER) AS hours FROM structure s JOIN codes USING (page_id)),
rated AS (SELECT *, (floor(hours * CAST(0.85 AS DOUBLE) + 0.5) + floor(hours * CAST(1.25 AS DOUBLE) + 0.5)) / 2 AS mid FROM work),
starred AS (SELECT *, CASE WHEN mid <= 28 THEN 1 WHEN mid <= 45 THEN 2 WHEN mid <= 62 THEN 3 WHEN mid <= 75 THEN 4 ELSE 5 END AS stars FROM rated),
row0 AS (SELECT vd.place_id, vd.v, vd.score, st.name, st.website, st.phone, st.primary_type, st.hood_name, st.c_custkey, st.user_rating_count AS reviews, st.c_custkey % 2 = 0 AS pictured,
    CASE WHEN st.rating_steps % 10 = 0 THEN CAST(st.rating_steps // 10 AS VARCHAR) ELSE st.rating_steps // 10 || '.' || st.rating_steps % 10 END AS rating,
    nullif(regexp_extract(st.address, ', (NATION_\\d+)', 1), '') AS nation, CASE WHEN contains(st.address, ', IL') THEN 'IL' WHEN contains(st.address, ', NY') THEN 'NY' WHEN contains(st.address, ', CA') AND NOT contains(st.address, 'Canada') THEN 'CA' END AS region,
    contains(st.address, 'Toronto') AS abroad, p.mobile_score, p.desktop_score, p.lcp_ms, q.page_id, q.stub, q.score10, q.dated, q.has_viewport, q.https, q.mixed_content, q.has_flash, q.table_layout, q.jquery_version, q.footer_year, q.meta_description, q.og_tags,
    q.builder, q.cms, q.modern_framework, why.reasons, stacks.names, stacks.socials, string_split(best.emails, ',')[1] AS email, s.page_count, s.unique_page_types, s.has_catalog, s.has_ecommerce, s.has_forms, s.languages, s.stars,
    told.hard_exclusion, nm.name_exclusion, told.ev AS site_ev, nm.name_ev, seen_reviews.ev AS review_ev, o.lang AS site_lang, rs.preferred_lang, versions.ev AS version_ev
    FROM vd JOIN state st ON st.place_id = vd.place_id JOIN nm ON nm.place_id = vd.place_id LEFT JOIN psi p ON p.place_id = vd.place_id LEFT JOIN quality q ON vd.place_id = 'p' || q.page_id LEFT JOIN why ON why.page_id = q.page_id
    LEFT JOIN stacks ON stacks.page_id = q.page_id LEFT JOIN best ON best.page_id = q.page_id LEFT JOIN starred s ON s.page_id = q.page_id LEFT JOIN told ON told.page_id = q.page_id LEFT JOIN observed o ON o.page_id = q.page_id
    LEFT JOIN versions ON versions.page_id = q.page_id LEFT JOIN seen_reviews ON seen_reviews.place_id = vd.place_id LEFT JOIN rs ON rs.place_id = vd.place_id),
row1 AS (SELECT *, page_id IS NOT NULL AS has_audit, website IS NULL AS none, website IS NOT NULL AND coalesce(stub, false) AS blocked, coalesce(hard_exclusion, name_exclusion) AS exclusion, mobile_score IS NOT NULL OR desktop_score IS NOT NULL AS measured,
    CASE WHEN abroad THEN hood_name ELSE nation || coalesce(', ' || region, '') END AS place, list_max(list_transform(coalesce(version_ev, []), lambda e: e.w)) AS top_w,
    CASE WHEN website IS NULL THEN ['сайту нема'] WHEN page_id IS NULL THEN ['сайт не відкривається'] WHEN stub THEN [] ELSE dated END AS markers FROM row0),
row2 AS (SELECT *, list_filter(coalesce(version_ev, []), lambda e: e.w = top_w)[1] AS top, has_audit AND NOT none AND NOT blocked AS seen,
    CASE WHEN v.b = 'rejected' THEN 'увага: пайплайн відхилив цей запис (' || coalesce(v.r, 'без причини') || '), але рядок лишено, бо з ним уже працювали' ELSE coalesce(v.r, '') END AS note FROM row1),
row3 AS (SELECT *, CASE WHEN exclusion IS NULL THEN list_concat(CASE WHEN top IS NULL THEN [] ELSE [top.d || ' (+' || top.w || ')'] END, list_transform(list_filter(coalesce(version_ev, []), lambda e: e.s <> top.s), lambda e: e.d),
      {_LINES.format('coalesce(site_ev, [])')}, {_LINES.format('coalesce(review_ev, [])')}, {_LINES.format('coalesce(name_ev, [])')})
    WHEN hard_exclusion IS NOT NULL THEN {_LINES.format('site_ev')} ELSE {_LINES.format('name_ev')} END AS proof,
    CASE WHEN exclusion IS NULL THEN coalesce(site_lang, preferred_lang, CASE WHEN regexp_matches(top.d, '(?i)\\bfr\\b') THEN 'fr' WHEN regexp_matches(top.d, '(?i)\\bde\\b') THEN 'de' END) ELSE preferred_lang END AS lang,
    list_filter([CASE WHEN seen AND NOT has_viewport THEN 'незручний на телефоні' END, CASE WHEN seen AND NOT https THEN 'з''єднання не захищене' END, CASE WHEN seen AND mixed_content THEN 'частина вмісту без захисту' END,
      CASE WHEN seen AND has_flash THEN 'потребує Flash' END, CASE WHEN seen AND table_layout THEN 'розмітка з таблиць' END, CASE WHEN seen AND starts_with(jquery_version, '1.') THEN 'стара jQuery ' || jquery_version END,
      CASE WHEN seen AND 2026 - footer_year >= 3 THEN 'останній рік унизу сторінки: ' || footer_year END, CASE WHEN seen AND meta_description IS NULL AND NOT og_tags THEN 'без опису для пошуку й посилань' END,
      CASE WHEN NOT none AND NOT blocked AND lcp_ms > 4000 THEN 'вміст з''являється за ' || {_SECONDS} || ' с' END, CASE WHEN NOT none AND NOT blocked AND mobile_score < 40 THEN 'мобільна оцінка ' || mobile_score END], {_PRESENT})[1:3] AS flaws,
    list_filter([CASE WHEN has_ecommerce THEN 'модуль продажу, можливо, вимкнений' WHEN has_catalog THEN 'перелік товарів чи страв' END, CASE WHEN has_forms THEN 'форму запиту' END, CASE WHEN languages > 1 THEN 'мовних версій: ' || languages END], {_PRESENT}) AS offers,
    CASE WHEN measured THEN list_filter(markers, lambda m: NOT contains(m, 'не відкривається')) ELSE markers END AS open_markers FROM row2)
"""

_FIRST_TWO = "nullif(array_to_string(list_filter(names, lambda x, i: list_position(names, x) = i)[1:2], ', '), '')"
_STACK = "array_to_string(list_filter(list_concat([builder, cms], names), lambda x, i: x IS NOT NULL AND list_position(list_concat([builder, cms], names), x) = i), ', ')"
_BRIEF = f"""array_to_string(list_filter([
    upper(primary_type[1]) || primary_type[2:] || coalesce(', ' || place, '') || '.',
    CASE WHEN reviews > 0 THEN coalesce('Рейтинг ' || rating || ', відгуків: ' || reviews || '.', 'Відгуків: ' || reviews || '.') END,
    CASE WHEN none THEN 'Власної сторінки не має.' WHEN blocked THEN 'До сайту не пустив захист; його стан невідомий.' WHEN NOT has_audit THEN 'Копії сайту немає.' END,
    CASE WHEN seen THEN 'Основа: ' || coalesce(builder, cms, modern_framework, {_FIRST_TWO}) || '.' END,
    CASE WHEN seen THEN CASE WHEN page_count > 1 THEN 'Сторінок ' || page_count || ', різних видів ' || unique_page_types || '.' ELSE 'Одна сторінка.' END END,
    CASE WHEN seen AND len(offers) > 0 THEN 'Має: ' || array_to_string(offers, ', ') || '.' END,
    CASE WHEN len(flaws) > 0 THEN 'Недоліки: ' || array_to_string(flaws, ', ') || '.' END,
    CASE WHEN starts_with(note, 'ручний розбір') THEN 'Людина вже дивилась: ' || regexp_replace(note, '^ручний розбір:?\\s*', '') || '.' WHEN starts_with(note, 'увага') THEN 'Застереження: ' || regexp_replace(note, '^увага:?\\s*', '') || '.' END,
    CASE WHEN none THEN 'Перша тема: людям з карти нікуди перейти.' WHEN blocked THEN 'Перша дія: подивитися сайт у браузері.' WHEN seen AND NOT has_viewport THEN 'Перша тема: вигляд на телефоні.'
      WHEN lcp_ms > 8000 THEN 'Перша тема: ' || {_SECONDS} || ' с очікування.' WHEN builder IS NOT NULL THEN 'Перша тема: щомісячна плата за ' || builder || '.'
      WHEN len(open_markers) > 0 THEN 'Перша тема: ' || open_markers[1] || '.' ELSE 'Перша тема: оновити вигляд.' END], {_PRESENT}), ' ')"""

_CELLS = (
    "place_id", "name", "primary_type", "'A'", "place || CASE WHEN abroad THEN '' ELSE '  (знайдено через ' || hood_name || ')' END", "coalesce(website, '—')",
    "'https://www.google.com/maps/place/?q=place_id:' || place_id", "phone", "coalesce(nullif(email, ''), '—')", "coalesce(nullif(socials, ''), '—')",
    "CASE WHEN has_audit THEN CAST(score10 AS VARCHAR) WHEN none THEN '1' ELSE '' END", "CASE WHEN has_audit THEN array_to_string(reasons, '; ') WHEN none THEN 'сайту нема взагалі' ELSE '' END",
    "CASE WHEN has_audit THEN repeat('★', stars) || repeat('☆', 5 - stars) || ' ' || CASE stars WHEN 1 THEN 'односторінковий лендінг' WHEN 2 THEN 'простий сайт-візитівка' WHEN 3 THEN 'кілька типів сторінок' WHEN 4 THEN 'великий сайт з каталогом' ELSE 'складний проєкт' END ELSE '—' END",
    "CAST(score AS VARCHAR)", "CASE lang WHEN 'uk' THEN 'українська' WHEN 'ru' THEN 'російська' ELSE '—' END", "coalesce(nullif(array_to_string(proof, '; '), ''), '—')",
    f"CASE WHEN has_audit THEN coalesce(nullif({_STACK}, ''), '—') WHEN NOT none THEN 'не вдалось прочитати' ELSE '—' END",
    "CASE WHEN measured THEN coalesce(CAST(mobile_score AS VARCHAR), '?') || ' / ' || coalesce(CAST(desktop_score AS VARCHAR), '?') WHEN NOT none THEN 'не заміряно' ELSE '—' END",
    "CASE WHEN NOT has_audit THEN '—' WHEN has_viewport THEN 'так' ELSE 'НІ' END", "CASE WHEN NOT has_audit THEN '—' WHEN https THEN 'так' ELSE 'НІ' END",
    "coalesce(rating, '—') || ' / ' || coalesce(reviews, 0)",
    """CASE WHEN none THEN '—' ELSE '=HYPERLINK("https://pagespeed.web.dev/analysis?url=' || url_encode(website) || '","' || CASE WHEN pictured THEN 'PSI звіт + скрін' ELSE 'PSI звіт' END || '")' END""",
    _BRIEF,
)


def export_sql(job: str) -> str:
    """``job``: the WITH clause of the re-score, up to the CTE ``vd``."""
    cells = ", ".join(f'{cell} AS "{name}"' for cell, name in zip(_CELLS, MACHINE_COLUMNS, strict=True))
    return f"{job}, {DETAILS} SELECT {cells} FROM row3"
