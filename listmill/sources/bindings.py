"""Listing tables derived from the test schema: every view grows with the tables it reads.

SQL is valid for Spark and for the oracle engine; names in braces are filled with DataFrames here and with names there.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

BASE = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "pages", "conversations", "labels"]

VIEWS = {
    "listings_v": """SELECT o.o_orderkey AS id, lower(c.c_mktsegment) AS source_partner,
 CASE WHEN o.o_orderkey % 50 = 7 THEN NULL ELSE concat('https://ex.test/p/', CAST(o.o_orderkey % 14000 AS STRING)) END AS source_url,
 concat('R', CAST(o.o_orderkey % 9000 AS STRING)) AS partner_id,
 concat(o.o_orderpriority, ' T', CAST(o.o_custkey % 6 AS STRING)) AS title,
 CASE WHEN o.o_orderstatus = 'P' THEN 'rent' ELSE 'sale' END AS business_type,
 CASE WHEN o.o_orderkey % 9 = 0 THEN NULL ELSE o.o_orderpriority END AS property_type,
 concat('T', CAST(o.o_custkey % 6 AS STRING)) AS typology, CAST(o.o_custkey % 6 AS INT) AS bedrooms,
 CASE WHEN o.o_orderkey % 11 = 0 THEN NULL ELSE CAST(o.o_totalprice AS DECIMAL(12,2)) END AS price_amount,
 CAST(20 + o.o_orderkey % 180 AS DOUBLE) AS area_useful_m2, r.r_name AS district, n.n_name AS county,
 o.o_orderkey % 3 = 0 AS is_enriched, o.o_custkey % 40 AS scrape_job_id,
 CAST(o.o_orderdate AS DATE) AS created_at, CAST(o.o_orderdate + INTERVAL 5 DAY AS DATE) AS updated_at
FROM {orders} o JOIN {customer} c ON o.o_custkey = c.c_custkey
JOIN {nation} n ON c.c_nationkey = n.n_nationkey JOIN {region} r ON n.n_regionkey = r.r_regionkey""",
    "raw_v": """SELECT o_orderkey AS id, CASE o_orderkey % 6
 WHEN 0 THEN concat(CAST(CAST(floor(o_totalprice / 1000) AS BIGINT) AS STRING), ' ', lpad(CAST(CAST(floor(o_totalprice) AS BIGINT) % 1000 AS STRING), 3, '0'), ' €')
 WHEN 1 THEN 'Preço sob consulta'
 WHEN 2 THEN concat('$', CAST(CAST(floor(o_totalprice / 1000) AS BIGINT) AS STRING), ',', lpad(CAST(CAST(floor(o_totalprice) AS BIGINT) % 1000 AS STRING), 3, '0'))
 WHEN 3 THEN concat(CAST(CAST(floor(o_totalprice / 1000) AS BIGINT) AS STRING), '.', lpad(CAST(CAST(floor(o_totalprice) AS BIGINT) % 1000 AS STRING), 3, '0'), ',50 EUR')
 WHEN 4 THEN '950 €' ELSE NULL END AS price,
 CASE o_orderkey % 5 WHEN 0 THEN concat(CAST(20 + o_orderkey % 180 AS STRING), ' m²') WHEN 1 THEN concat(CAST(20 + o_orderkey % 180 AS STRING), ',5 m2')
 WHEN 2 THEN '2.408 m²' WHEN 3 THEN 'not available' ELSE NULL END AS area,
 CASE o_orderkey % 7 WHEN 0 THEN 'Sim' WHEN 1 THEN 'no' WHEN 2 THEN '3' WHEN 3 THEN '0' WHEN 4 THEN 'talvez' ELSE NULL END AS garage,
 concat('T', CAST(o_custkey % 6 AS STRING)) AS typology FROM {orders}""",
    "sites_v": """SELECT key, concat('Site ', key) AS name, key <> 'machinery' AS is_active
FROM (SELECT DISTINCT lower(c_mktsegment) AS key FROM {customer} UNION ALL SELECT 'nolistings' AS key) s""",
    "jobs_v": """SELECT o.o_orderkey AS job_id, lower(c.c_mktsegment) AS site_key,
 CASE o.o_orderstatus WHEN 'P' THEN 'running' WHEN 'O' THEN 'completed' ELSE 'failed' END AS status,
 CAST(o.o_orderdate AS DATE) AS created_at, CAST(o.o_orderkey % 37 AS INT) AS listings_found, CAST(o.o_orderkey % 31 AS INT) AS listings_scraped
FROM {orders} o JOIN {customer} c ON o.o_custkey = c.c_custkey""",
    "ledger_v": """SELECT o_orderkey AS listing_id, concat('R', CAST(o_orderkey % 9000 AS STRING)) AS partner_id, o_orderkey + 1000 AS remote_id,
 CASE o_orderkey % 16 WHEN 0 THEN 'published' WHEN 4 THEN 'updated' WHEN 8 THEN 'failed' ELSE 'pending' END AS status
FROM {orders} WHERE o_orderstatus <> 'O'""",
    "crm_v": """SELECT concat('R', CAST(k AS STRING)) AS reference, CASE WHEN k % 15 = 0 THEN k + 5000 ELSE k + 1000 END AS property_id
FROM (SELECT o_orderkey AS k FROM {orders} WHERE o_orderpriority <> '5-LOW') x""",
    "media_v": """SELECT l_orderkey AS listing_id, concat('https://img.test/', CAST(l_partkey AS STRING), '.jpg') AS url,
 CASE WHEN l_linenumber = 7 THEN NULL ELSE CAST(l_linenumber AS INT) END AS position FROM {lineitem}""",
    "prices_v": """SELECT l_partkey AS listing_id, CAST(l_shipdate AS DATE) AS recorded_at, l_orderkey * 10 + l_linenumber AS seq, CAST(l_extendedprice AS DECIMAL(12,2)) AS price_amount FROM {lineitem}""",
    "incoming_v": """SELECT concat('https://ex.test/p/', CAST(o_orderkey % 14000 + CASE WHEN o_orderkey % 4 = 1 THEN 7000 ELSE 0 END AS STRING)) AS source_url, o_orderkey AS ord,
 CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE concat('New ', o_orderpriority) END AS title,
 CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE 2 * CAST(o_totalprice AS DECIMAL(12,2)) END AS price_amount FROM {orders} WHERE o_orderstatus <> 'F'""",
    "current_v": """SELECT concat('https://ex.test/p/', CAST(o_orderkey % 14000 AS STRING)) AS source_url, min(o_orderkey) AS id, min(o_orderpriority) AS title,
 min(CAST(o_totalprice AS DECIMAL(12,2))) AS price_amount FROM {orders} GROUP BY 1""",
    "events_v": """SELECT user_id AS job_id, CAST(ts AS TIMESTAMP) AS ts, event_id, CASE event_type WHEN 'view' THEN 'page' WHEN 'click' THEN 'found'
 WHEN 'purchase' THEN 'scraped' WHEN 'error' THEN 'error' ELSE 'new' END AS kind FROM {events}""",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A derived table."""
    sql = VIEWS[name]
    return spark.sql(sql, **{t: table(spark, sf_dir, t) for t in set(re.findall(r"{(\w+)}", sql))})


def with_views(sql: str) -> str:
    """`sql` for the oracle engine, with the views it names as common table expressions."""
    named = [v for v in VIEWS if re.search(rf"\b{v}\b", sql)]
    views = ", ".join(f"{v} AS ({re.sub(r'{(\w+)}', r'\1', VIEWS[v])})" for v in named)
    return (f"WITH {views}\n" if views else "") + sql
