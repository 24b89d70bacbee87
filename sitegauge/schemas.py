"""Declared schemas (Spark DDL) of the tables the operators read and write."""

EVIDENCE = "array<struct<signal:string,weight:int,detail:string>>"

PLACES = (
    "place_id string, name string, address string, lat double, lng double, primary_type string, "
    "primary_type_label string, types array<string>, website string, phone string, rating double, "
    "user_rating_count int, business_status string"
)

PLACE_STATE = PLACES + (
    ", fetched_at timestamp, metro_key string, hood_name string, niche_key string, tier string, "
    "found_via string, stage string, bucket string, reject_reason string"
)

RESPONSES = (
    "place_id string, role string, final_url string, http_status int, fetch_error string, "
    "redirected boolean, html string, html_bytes long, tls_expired boolean, rendered boolean, "
    "fetched_at timestamp"
)

REVIEWS = (
    "place_id string, language_code string, author_token string, rating double, publish_time timestamp"
)

PSI = (
    "place_id string, mobile_score int, desktop_score int, lcp_ms double, cls double, fetched_at timestamp"
)

NOTES = "place_id string, tab string, status string, owner string, date string, note string"
PLACEMENT = "place_id string, tab string, row_index long"
PINS = "place_id string, verdict string, reason string, at timestamp"
RUNS = "task_id string, pages int, results int, ran_at timestamp"
USAGE = "api string, ts timestamp, n int"
LEXICON = "lexicon string, role string, key string"

PROBE = (
    "place_id string, css_vars boolean, css_clamp boolean, grid_used int, flex_used int, "
    "float_layout int, jquery string, bootstrap3 boolean, font_awesome4 boolean, tables int, "
    "webp int, lazy_imgs int, copyright_year int, fixed_width boolean"
)

SEARCH_RESPONSE = (
    "places array<struct<id:string,displayName:struct<text:string>,formattedAddress:string,"
    "location:struct<latitude:double,longitude:double>,primaryType:string,"
    "primaryTypeDisplayName:struct<text:string>,types:array<string>,websiteUri:string,"
    "nationalPhoneNumber:string,rating:double,userRatingCount:int,businessStatus:string>>, "
    "nextPageToken string"
)

REVIEW_RESPONSE = (
    "id string, reviews array<struct<originalText:struct<languageCode:string>,"
    "authorAttribution:struct<displayName:string>,rating:double,publishTime:string>>"
)

PAGE_SPEED_RESPONSE = (
    "struct<lighthouseResult:struct<categories:struct<performance:struct<score:double>>,"
    "audits:map<string,struct<numericValue:double>>>>"
)

CACHED_PAGE = "finalUrl string, fetchedAt string, html string, _corrupt_record string"
