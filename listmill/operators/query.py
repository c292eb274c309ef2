"""Read path: dynamic filters, text search, semi and anti joins, details, sorting, paging."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CONTAINS = ["district", "county", "parish", "property_type"]
EQUALS = ["source_partner", "typology", "bedrooms", "business_type", "scrape_job_id", "energy_certificate"]
RANGES = {"price": "price_amount", "area": "area_useful_m2", "bedrooms": "bedrooms", "bathrooms": "bathrooms", "created": "created_at"}
FLAGS = ["has_garage", "has_elevator", "has_balcony", "has_air_conditioning", "has_pool"]
#: Column that is set once a listing has been enriched.
ENRICHED = "enriched_translations"
SEARCHED = ["title", "district", "county", "source_partner"]
SORT_KEYS = ["price_amount", "area_useful_m2", "bedrooms", "created_at", "updated_at", "district", "title"]
EXPORTED = ["published", "updated"]


def apply_filters(df: DataFrame, **f) -> DataFrame:
    """Conjunction of the given filters only: contains, equals, inclusive ranges (<name>_min, <name>_max), booleans.

    is_enriched tests whether the column ENRICHED is null, or a flag of that name where a table has one instead.
    """
    terms = [F.col(c).ilike(f"%{f[c]}%") for c in CONTAINS if f.get(c) is not None]
    terms += [F.col(c) == f[c] for c in (*EQUALS, *FLAGS) if f.get(c) is not None]
    if f.get("is_enriched") is not None:
        there = F.col(ENRICHED).isNotNull() if ENRICHED in df.columns else F.col("is_enriched")
        terms.append(there if f["is_enriched"] else ~there)
    for name, c in RANGES.items():
        if f.get(f"{name}_min") is not None:
            terms.append(F.col(c) >= f[f"{name}_min"])
        if f.get(f"{name}_max") is not None:
            terms.append(F.col(c) <= f[f"{name}_max"])
    return df.where(reduce(and_, terms)) if terms else df


def fts(df: DataFrame, tokens: Column, query: list[str]) -> DataFrame:
    """Rows whose token array has all tokens of the query."""
    return df.where(F.forall(F.array(*map(F.lit, query)), lambda t: F.array_contains(tokens, t)))


def ilike_any(df: DataFrame, q: str, columns: list[str]) -> DataFrame:
    terms = [F.coalesce(F.col(c).ilike(f"%{q.strip()}%"), F.lit(False)) for c in columns]
    return df.where(reduce(lambda a, b: a | b, terms))


def search(df: DataFrame, ledger: DataFrame, q: str | None = None, is_exported: bool | None = None, **filters) -> DataFrame:
    """Search box: the trimmed text in one of SEARCHED, with filters and the state of export; newest update first."""
    out = apply_filters(ilike_any(df, q, SEARCHED) if q and q.strip() else df, **filters)
    if is_exported is not None:
        out = exported(out, ledger) if is_exported else not_exported(out, ledger)
    return recent(out, "updated_at", "id")


def lookup(df: DataFrame, **keys) -> DataFrame:
    """Rows with the given values of columns (an id, a url, a key, a status); the tests reach the scan."""
    return df.where(reduce(and_, [F.col(c) == v for c, v in keys.items()]))


def recent(df: DataFrame, by: str = "created_at", *ties: str) -> DataFrame:
    """Newest first, rows without a time before all others."""
    return df.orderBy(F.col(by).desc_nulls_first(), *ties)


def page_rows(df: DataFrame, by: list[Column], number: int, size: int) -> DataFrame:
    """A page of a table by an order, each row with the number of all rows as `total_count`; that number is counted apart from the sort."""
    total = df.agg(F.count("*").alias("total_count"))  # one row
    return df.orderBy(*by).offset((number - 1) * size).limit(size).join(F.broadcast(total))


def by_ids(df: DataFrame, ids: DataFrame) -> DataFrame:
    return df.join(ids.select("id").distinct(), "id", "left_semi")


def exported(df: DataFrame, ledger: DataFrame) -> DataFrame:
    done = ledger.where(F.col("status").isin(EXPORTED)).select(F.col("listing_id").alias("id"))
    return df.join(done, "id", "left_semi")


def not_exported(df: DataFrame, ledger: DataFrame) -> DataFrame:
    done = ledger.where(F.col("status").isin(EXPORTED)).select(F.col("listing_id").alias("id"))
    return df.join(done, "id", "left_anti")


def admit(requests: DataFrame, jobs: DataFrame) -> DataFrame:
    """Requests for sites that have no pending or running job."""
    return requests.join(jobs.where("status IN ('pending', 'running')").select("site_key"), "site_key", "left_anti")


def valid_jobs(jobs: DataFrame, sites: DataFrame) -> DataFrame:
    """Jobs with their state after the check that the site exists and is active."""
    own = jobs.join(sites.select(F.col("key").alias("site_key"), "is_active"), "site_key", "left")
    return own.withColumn("checked", F.when(F.col("is_active").isNull(), "not_found").when(~F.col("is_active"), "inactive").otherwise("ok")).drop("is_active")


def stale_jobs(jobs: DataFrame, heartbeat: str, now: Column, seconds: int = 120) -> DataFrame:
    old = F.col(heartbeat).isNull() | (F.col(heartbeat) < now - F.make_interval(secs=F.lit(seconds)))
    return jobs.withColumn("status", F.when((F.col("status") == "running") & old, "failed").otherwise(F.col("status")))


def thumbnails(listings: DataFrame, media: DataFrame) -> DataFrame:
    first = media.groupBy(F.col("listing_id").alias("id")).agg(F.min_by("url", F.struct(F.coalesce("position", F.lit(999)), "url")).alias("thumbnail"))
    return listings.join(first, "id", "left")


def listing_detail(listings: DataFrame, media: DataFrame, prices: DataFrame) -> DataFrame:
    """Listings with nested media and price history: children are grouped before the join, so rows do not multiply."""
    m = media.groupBy(F.col("listing_id").alias("id")).agg(F.array_sort(F.collect_list(F.struct("position", "url"))).alias("media"))
    p = prices.groupBy(F.col("listing_id").alias("id")).agg(F.array_sort(F.collect_list(F.struct("recorded_at", "seq", "price_amount"))).alias("history"))
    return listings.join(m, "id", "left").join(p, "id", "left")


def sort_by(df: DataFrame, key: str, descending: bool = True) -> DataFrame:
    """By a known key (else created_at); nulls last ascending, first descending; ties by id."""
    c = F.col(key if key in SORT_KEYS else "created_at")
    return df.orderBy(c.desc_nulls_first() if descending else c.asc_nulls_last(), "id")


def page(df: DataFrame, number: int, size: int) -> tuple[DataFrame, dict]:
    """A page of a sorted table, and paging facts; the true total is counted apart."""
    total = df.count()
    return df.offset((number - 1) * size).limit(size), {"page": number, "size": size, "total": total, "pages": -(-total // size)}


def work_queue(df: DataFrame, n: int) -> DataFrame:
    return df.orderBy(F.col("created_at").asc_nulls_last(), "id").limit(n)


def latest(df: DataFrame, key: str, by: list[Column]) -> DataFrame:
    w = Window.partitionBy(key).orderBy(*by)
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def cap_per_bucket(df: DataFrame, keys: list[str], order: list[str], n: int) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def change_feed(snapshots: DataFrame, key: str, order: list[str], value: list[str]) -> DataFrame:
    """Snapshots that differ from the one before."""
    now, w = F.struct(*value), Window.partitionBy(key).orderBy(*order)
    return snapshots.withColumn("_b", F.lag(now).over(w)).where(F.col("_b").isNull() | ~F.col("_b").eqNullSafe(now)).drop("_b")


def price_changes(prices: DataFrame) -> DataFrame:
    w = Window.partitionBy("listing_id").orderBy("recorded_at", "seq")
    out = prices.withColumn("previous", F.lag("price_amount").over(w))
    return out.where("previous IS NOT NULL AND previous <> price_amount")
