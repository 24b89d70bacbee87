"""Pipeline inputs derived from the driver's tables.

The tables hold customers, orders, pages and events, not businesses and reviews, so
the queries read them through these projections.  They are plain SQL that Spark and
DuckDB both run (``{name}`` stands for a table), so the check sees the same inputs.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
    "embeddings", "pages", "benchmark", "labels", "conversations",
)

DERIVED = {
    # One row per customer: a business with an address, a site for some, counts from its orders.
    "places": """
        SELECT 'p' || CAST(c.c_custkey AS STRING) AS place_id, c.c_custkey,
               c.c_name || ' ' || c.c_mktsegment AS name,
               CAST(c.c_custkey AS STRING) || ' Main St, ' || n.n_name ||
                 CASE n.n_regionkey WHEN 0 THEN ', IL 60622' WHEN 1 THEN ', NY 11235-1234'
                      WHEN 2 THEN ', CA' WHEN 3 THEN ', Toronto, Canada' ELSE ', ZZ 12345, USA' END AS address,
               lower(c.c_mktsegment) AS primary_type,
               CASE WHEN c.c_nationkey = 3 THEN 'church,store' WHEN c.c_nationkey = 7 THEN 'store,museum'
                    ELSE 'store,point_of_interest' END AS types_csv,
               CASE WHEN p.url IS NOT NULL THEN p.url WHEN c.c_acctbal < 0 THEN NULL
                    WHEN c.c_nationkey = 5 THEN 'https://www.shop.ru/a'
                    ELSE 'https://shop' || CAST(c.c_custkey AS STRING) || '.example.org/' END AS website,
               CASE WHEN c.c_nationkey = 9 THEN '+7 9' ELSE '(555) 01' END || CAST(c.c_custkey AS STRING) AS phone,
               CAST(floor(o.max_price / 1000) AS BIGINT) % 50 AS rating_steps,
               o.n_orders AS user_rating_count,
               CASE WHEN c.c_acctbal > 9500 THEN 'CLOSED_TEMPORARILY' WHEN c.c_acctbal > 9000 THEN NULL
                    ELSE 'OPERATIONAL' END AS business_status,
               n.n_name AS metro_key, r.r_name AS hood_name, c.c_mktsegment AS niche_key
        FROM {customer} c
        JOIN {nation} n ON c.c_nationkey = n.n_nationkey
        JOIN {region} r ON n.n_regionkey = r.r_regionkey
        LEFT JOIN {pages} p ON p.page_id = c.c_custkey
        LEFT JOIN (SELECT o_custkey, CAST(count(*) AS BIGINT) AS n_orders, max(o_totalprice) AS max_price
                   FROM {orders} GROUP BY o_custkey) o ON o.o_custkey = c.c_custkey
    """,
    # Speed figures of the places that have orders.
    "psi": """
        SELECT 'p' || CAST(o_custkey AS STRING) AS place_id,
               CAST(floor(max(o_totalprice)) AS BIGINT) % 101 AS mobile_score,
               CAST(floor(min(o_totalprice)) AS BIGINT) % 101 AS desktop_score,
               CAST(floor(max(o_totalprice)) AS BIGINT) % 13000 AS lcp_ms,
               CAST(CAST(floor(min(o_totalprice)) AS BIGINT) % 80 AS DOUBLE) / CAST(100 AS DOUBLE) AS cls
        FROM {orders} WHERE o_orderpriority <> '5-LOW' GROUP BY o_custkey
    """,
    # A scored state: scores from the balance, sites from the key.
    "state": """
        SELECT s.*,
               CASE WHEN website IS NULL THEN 'no_site'
                    WHEN owner_score >= 75 AND site_score > 7 THEN 'upsell'
                    WHEN owner_score >= 55 THEN 'leads' WHEN owner_score >= 35 THEN 'manual'
                    WHEN owner_score >= 15 THEN 'pending' ELSE 'rejected' END AS bucket,
               CASE WHEN website IS NOT NULL AND owner_score < 5 THEN 'weak ' || primary_type
                    WHEN website IS NOT NULL AND owner_score < 15 THEN 'weak' END AS reject_reason,
               CASE WHEN site_score IS NULL THEN 'discovered' ELSE 'audited' END AS stage
        FROM (SELECT p.*,
                     CAST(floor(abs(c.c_acctbal)) AS BIGINT) % 101 AS owner_score,
                     CASE WHEN p.website IS NOT NULL AND c.c_nationkey <> 11 THEN 1 + c.c_custkey % 10 END AS site_score,
                     CASE WHEN c.c_nationkey = 11 THEN 'http-403' WHEN c.c_nationkey = 12 THEN 'http-404' END AS fetch_error,
                     CASE WHEN c.c_custkey % 3 = 0 THEN 'Новий' WHEN c.c_custkey % 3 = 1 THEN ' ' END AS status
              FROM {places} p JOIN {customer} c ON c.c_custkey = p.c_custkey) s
    """,
    # Orders as reviews: priority stands for the language, the date for the time.
    "reviews": """
        SELECT 'p' || CAST(o_custkey AS STRING) AS place_id, o_orderkey,
               CASE o_orderpriority WHEN '1-URGENT' THEN 'UK' WHEN '2-HIGH' THEN 'ru' WHEN '3-MEDIUM' THEN NULL
                    ELSE 'en' END AS language_code,
               o_orderstatus || o_orderpriority AS author_token, o_orderdate AS publish_time
        FROM {orders}
    """,
    # Events as the usage log of metered interfaces.
    "usage_log": """
        SELECT event_id, ts,
               CASE WHEN event_type IN ('view', 'click') THEN 'text_search'
                    WHEN event_type = 'purchase' THEN 'place_details' ELSE 'psi' END AS api, CAST(1 AS BIGINT) AS n
        FROM {events}
    """,
    # Where each place was published last.
    "placement": """
        SELECT place_id, CASE WHEN c_custkey % 5 = 0 THEN 'Leads' WHEN c_custkey % 5 = 1 THEN 'Manual review'
                              WHEN c_custkey % 5 = 2 THEN 'NO_SITE' ELSE 'Rejected' END AS tab,
               c_custkey AS row_index
        FROM {places} WHERE user_rating_count > 8
    """,
    # What people wrote on published rows.
    "notes": """
        SELECT place_id, tab, CASE WHEN row_index % 2 = 0 THEN 'В роботі' ELSE '' END AS status,
               CASE WHEN row_index % 3 = 0 THEN 'seller' END AS owner, CAST(NULL AS STRING) AS date,
               CASE WHEN row_index % 7 = 0 THEN ' call back ' ELSE ' ' END AS note
        FROM {placement}
    """,
}

_ORDER = ("places", "psi", "state", "reviews", "usage_log", "placement", "notes")


def _needs(sql: str) -> list[str]:
    return re.findall(r"\{(\w+)\}", sql)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table, or one of the derived inputs."""
    if name in TABLES:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    sql = DERIVED[name]
    return spark.sql(sql, **{n: table(spark, sf_dir, n) for n in set(_needs(sql))})


def prelude(*names: str) -> str:
    """``WITH`` clause that defines derived inputs, and what they need, for DuckDB."""
    wanted: set[str] = set()

    def add(name: str) -> None:
        if name in DERIVED and name not in wanted:
            wanted.add(name)
            for n in _needs(DERIVED[name]):
                add(n)

    for n in names:
        add(n)
    ctes = [f"{n} AS ({reduce(lambda q, t: q.replace('{' + t + '}', t), _needs(DERIVED[n]), DERIVED[n])})"
            for n in _ORDER if n in wanted]
    return "WITH " + ", ".join(ctes) if ctes else ""


def with_types(places: DataFrame) -> DataFrame:
    """Type list as an array and counts as the pipeline declares them."""
    from pyspark.sql import functions as F

    return places.withColumn("types", F.split("types_csv", ",")).withColumn(
        "user_rating_count", F.col("user_rating_count").cast("int")
    )
