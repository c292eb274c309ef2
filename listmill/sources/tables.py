"""Readers and writers: raw pages, relational tables, sitemaps, configuration tables, export files."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def read_pages(pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(pages with a body, pages whose body is missing or empty)."""
    ok = F.coalesce(F.length("html") > 0, F.lit(False))
    return pages.where(ok), pages.where(~ok)


#: Schemas of the tables of a store of listings.
TABLES = {
    "listings": "id long, partner_id string, source_partner string, source_url string, title string, business_type string, property_type string, typology string, bedrooms int, bathrooms int, floor string, price_amount decimal(12,2), price_currency string, price_per_m2 decimal(12,2), area_useful_m2 double, area_gross_m2 double, area_land_m2 double, district string, county string, parish string, full_address string, latitude double, longitude double, description string, scrape_job_id long, created_at timestamp, updated_at timestamp",
    "media": "id long, listing_id long, url string, alt_text string, type string, position int",
    "prices": "id long, listing_id long, price_amount decimal(12,2), price_currency string, recorded_at timestamp",
    "jobs": "job_id long, site_key string, status string, config string, progress string, created_at timestamp, started_at timestamp, finished_at timestamp",
    "sites": "key string, name string, base_url string, mode string, selectors map<string,string>, patterns map<string,string>, link_pattern string, is_active boolean",
    "ledger": "listing_id long, partner_id string, remote_id long, status string, last_error string, last_exported_at timestamp",
}


def read_table(spark: SparkSession, name: str, path: str) -> DataFrame:
    """A table of TABLES from Parquet under `path`, by its schema: files are not asked for theirs, columns they lack are null, further ones left out."""
    return spark.read.schema(TABLES[name]).parquet(f"{path}/{name}")


def read_jdbc(spark: SparkSession, name: str, url: str, column: str, parts: int, properties: dict[str, str] | None = None) -> DataFrame:
    """A table of TABLES from a relational database, read in parallel by ranges of a whole-number column.

    The ranges come from the column's least and greatest values, which the database is asked for; rows without a value are read
    with the first range. Tests and columns that are asked of the result reach the database. Columns that a database has no type
    for (maps) are texts in it, of JSON.
    """
    properties = properties or {}
    names = spark.read.jdbc(url, name, properties=properties).columns  # as the database writes them
    own = {f.name: next((c for c in names if c.lower() == f.name.lower()), None) for f in spark.createDataFrame([], TABLES[name]).schema.fields}
    kinds = {f.name: f.dataType.simpleString() for f in spark.createDataFrame([], TABLES[name]).schema.fields}
    quote = spark._jvm.org.apache.spark.sql.jdbc.JdbcDialects.get(url).quoteIdentifier
    ends = spark.read.jdbc(url, f"(SELECT min({quote(own[column])}) AS low, max({quote(own[column])}) AS high FROM {name}) ends", properties=properties).first()
    low, high = (int(x) if x is not None else 0 for x in ends)
    nested = {c for c, kind in kinds.items() if kind.startswith(("map", "array", "struct"))}
    typed = ", ".join(f"`{own[c]}` {'string' if c in nested else kind}" for c, kind in kinds.items() if own[c])  # no casts, which would keep tests from the database
    rows = spark.read.jdbc(url, name, column=own[column], lowerBound=low, upperBound=high + 1, numPartitions=parts, properties=properties | {"customSchema": typed})
    value = lambda c: F.lit(None).cast(kinds[c]) if own[c] is None else F.from_json(F.col(own[c]), kinds[c]) if c in nested else F.col(own[c])
    return rows.select(*[value(c).alias(c) for c in kinds])


#: What is read of a sitemap: urls, or sitemaps of an index; any namespace will do. A document that is not well-formed has neither.
SITEMAP = "url array<struct<loc:string>>, sitemap array<struct<loc:string>>, broken string"


def _locations(sitemaps: DataFrame, kind: str) -> DataFrame:
    """(sitemap, loc): the trimmed texts of the documents' elements of one kind; entities and CDATA are read as text."""
    xml = F.from_xml("xml", SITEMAP, {"ignoreNamespace": "true", "columnNameOfCorruptRecord": "broken"})
    rows = sitemaps.select("sitemap", xml.alias("x")).where("x.broken IS NULL")
    own = F.filter(F.col(f"x.{kind}.loc"), lambda loc: loc.isNotNull())
    # an index lists sitemaps only
    own = own if kind == "sitemap" else F.when(F.coalesce(F.size("x.sitemap"), F.lit(0)) <= 0, own)
    return rows.select("sitemap", F.explode(F.transform(own, lambda loc: F.regexp_replace(loc, r"^\s+|\s+$", ""))).alias("loc")).where("loc <> ''")


def sitemap_urls(sitemaps: DataFrame, pattern: str | None = None) -> DataFrame:
    """sitemaps(sitemap, xml) -> (sitemap, url): page urls of url sets, trimmed, blanks dropped, filtered by a pattern."""
    urls = _locations(sitemaps, "url").withColumnRenamed("loc", "url")
    return urls.where(F.col("url").rlike(pattern)) if pattern else urls


def expand_sitemaps(sitemaps: DataFrame, roots: DataFrame) -> DataFrame:
    """sitemaps(sitemap, xml) reachable from roots(sitemap) through sitemap indexes, level by level until one brings nothing new."""
    children = written(_locations(sitemaps, "sitemap").withColumnRenamed("loc", "child"))
    seen = level = written(roots.select("sitemap").distinct())
    while not level.isEmpty():
        found = level.join(children, "sitemap").select(F.col("child").alias("sitemap")).distinct()
        level = written(found.join(seen, "sitemap", "left_anti"))
        seen = seen.unionByName(level)
    return sitemaps.join(seen, "sitemap", "left_semi")


def active_sites(sites: DataFrame, scheduled: bool = False, include_inactive: bool = False) -> DataFrame:
    out = sites if include_inactive else sites.where("is_active")
    return out.where("schedule_enabled") if scheduled else out


def mapping_dim(rows: DataFrame, kind: str, site: str | None = None, defaults: Mapping[str, str] | None = None) -> DataFrame:
    """One target for each lower-cased source name: rows of the site first, then higher priority, then smaller id.

    If no row of the kind is active for the site, the `defaults` (source name -> target) are the table.
    """
    own = F.when(F.col("site_key") == F.lit(site), 0).when(F.col("site_key").isNull(), 1)
    rows = rows.where((F.col("mapping_type") == kind) & F.col("is_active")).withColumn("own", own).where("own IS NOT NULL")
    w = Window.partitionBy("key").orderBy("own", F.desc("priority"), "id")
    rows = rows.withColumn("key", F.lower("source_name")).withColumn("n", F.row_number().over(w))
    out = rows.where("n = 1").select("key", "target_field")
    if not defaults:
        return out
    static = rows.sparkSession.createDataFrame([(k.lower(), v) for k, v in defaults.items()], "key string, target_field string")
    return static if out.isEmpty() else out


def export_rows(listings: DataFrame) -> DataFrame:
    """Listings as plain export columns: decimals as double, dates as ISO text, ids as text."""
    kinds: Mapping[str, str] = dict(listings.dtypes)

    def plain(c: str):
        if kinds[c].startswith("decimal"):
            return F.col(c).cast("double").alias(c)
        if kinds[c] in ("timestamp", "timestamp_ntz"):
            return F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss").alias(c)
        return F.col(c).cast("string").alias(c) if kinds[c] == "date" or c == "id" else F.col(c)

    return listings.select(*map(plain, listings.columns))


def export_feed(listings: DataFrame, most: int = 5000) -> DataFrame:
    """Listings that passed the filters as export rows, newest first; an error beyond `most`."""
    return export_rows(guard_rows(listings, most)).orderBy(F.col("created_at").desc_nulls_first(), "id")


def crm_requests(payloads: DataFrame, ledger: DataFrame) -> DataFrame:
    """payloads(id, payload) as one request a listing: create or update, images and translations apart from the property."""
    own = ledger.groupBy(F.col("listing_id").alias("id")).agg(F.max("remote_id").alias("remote_id"))
    part = lambda k: F.get_json_object("payload", f"$.{k}")
    body = F.from_json("payload", "map<string,string>")
    rest = F.to_json(F.map_filter(body, lambda k, v: ~k.isin("images", "translations")))
    rows = payloads.select("id", "payload").join(own, "id", "left")
    return rows.select("id", F.when(F.col("remote_id").isNull(), "create").otherwise("update").alias("action"), "remote_id", rest.alias("property"), part("images").alias("images"), part("translations").alias("translations"))


def write_requests(requests: DataFrame, path: str) -> None:
    """One JSON line for each request."""
    write_json(requests, path)


def guard_rows(df: DataFrame, most: int = 5000) -> DataFrame:
    """df, or an error if it has more than `most` rows; reads one row beyond the cap."""
    if df.limit(most + 1).count() > most:
        raise ValueError(f"more than {most} rows to export")
    return df


def write_csv(df: DataFrame, path: str) -> None:
    df.write.option("header", True).csv(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.option("ignoreNullFields", False).json(path)


def shared_folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names; a local one only where that is unset."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        folder = tempfile.mkdtemp(prefix="spark-written-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def written(df: DataFrame) -> DataFrame:
    """`df` written once as Parquet in the shared folder and read back."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
