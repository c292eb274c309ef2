"""A listing table in hash buckets that takes batches of listings, rewriting only the buckets that a batch touches.

`store`/listings is partitioned by bucket: the url's host decides a range of PARTS buckets, the whole url one of them, so that a crawl
of one site touches its own few buckets and a large site is spread over PARTS of them. A batch is worked out in two steps. Its buckets'
new content, and its price history, are written to `store`/staged/<batch>, and then replace these buckets (dynamic partition
overwrite); a mark in `store`/done ends it. A batch that runs again after a failure finds its staged rows and replaces the same buckets
by the same content; after its mark it changes nothing. Staged rows go when a later batch begins.

Batch ids are whole numbers or names; one writer works on a store at a time. Rows without a url are left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from listmill.operators import merge

#: Hosts' ranges, and buckets of one range. Both belong to a store for good.
RANGES, PARTS = 256, 16
#: Columns of the table beside `bucket`; those of FIELDS are merged, a null never replacing a value.
SCHEMA = "source_url string, id long, source_partner string, title string, price_amount decimal(18,2), price_currency string, area_useful_m2 double, images array<string>, scrape_job_id long, created_at timestamp, updated_at timestamp, bucket int"
FIELDS = ["source_partner", "title", "price_amount", "price_currency", "area_useful_m2", "images"]
COLUMNS = ["source_url", "id", *FIELDS, "scrape_job_id", "created_at", "updated_at", "bucket"]


def host(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, "^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1))


def bucket(url: Column) -> Column:
    return (F.pmod(F.xxhash64(host(url)), F.lit(RANGES)) * PARTS + F.pmod(F.xxhash64(url), F.lit(PARTS))).cast("int")


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def _remove(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def read_listings(spark: SparkSession, store: str, buckets: list[int] | None = None) -> DataFrame:
    """The listing table, or of it these buckets alone; empty if there is none yet."""
    if not _exists(spark, f"{store}/listings"):
        return spark.createDataFrame([], SCHEMA)
    rows = spark.read.schema(SCHEMA).parquet(f"{store}/listings")
    return rows if buckets is None else rows.where(F.col("bucket").isin(buckets))


def read_prices(spark: SparkSession, store: str) -> DataFrame:
    """All recorded prices: batch, id, source_url, old_price, old_currency, new_price."""
    return spark.read.parquet(f"{store}/prices")


def _replace(spark: SparkSession, store: str, batch: str) -> None:
    """Staged buckets into the table: each is replaced as a whole, and an empty one emptied."""
    staged = spark.read.schema(SCHEMA).parquet(f"{store}/staged/{batch}")
    staged.repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(f"{store}/listings")
    for r in spark.read.schema("bucket int").parquet(f"{store}/emptied/{batch}").collect():  # buckets of one batch without a row
        _remove(spark, f"{store}/listings/bucket={r['bucket']}")


def _commit(spark: SparkSession, store: str, batch: str, after: DataFrame, touched: list[int], prices: DataFrame | None) -> None:
    after.select(*COLUMNS).write.mode("overwrite").parquet(f"{store}/staged/{batch}")
    held = spark.read.schema(SCHEMA).parquet(f"{store}/staged/{batch}").select("bucket").distinct()
    spark.createDataFrame([(b,) for b in touched], "bucket int").join(held, "bucket", "left_anti").write.mode("overwrite").parquet(f"{store}/emptied/{batch}")
    if prices is not None:
        prices.write.mode("overwrite").parquet(f"{store}/prices/batch={batch}")
    _mark(spark, f"{store}/ready/{batch}")


def _mark(spark: SparkSession, path: str) -> None:
    spark.range(0).write.mode("overwrite").parquet(path)


def _finish(spark: SparkSession, store: str, batch: str) -> None:
    _replace(spark, store, batch)
    _mark(spark, f"{store}/done/{batch}")
    for part in ("staged", "emptied", "ready"):
        _remove(spark, f"{store}/{part}/{batch}")


def merge_batch(store: str, incoming: DataFrame, batch: int | str, now: Column | None = None) -> None:
    """incoming(source_url, FIELDS, scrape_job_id, ord) merged into the table: new urls are added, of known ones values replaced by
    those that are not null (images: not empty).

    Of several rows of a url in a batch that of the largest `ord` counts. id and created_at stay, updated_at and scrape_job_id are
    those of the batch. Where both prices are known and differ, the old one is recorded.
    """
    spark, batch = incoming.sparkSession, str(batch)
    if _exists(spark, f"{store}/done/{batch}"):
        return
    if not _exists(spark, f"{store}/ready/{batch}"):
        rows = incoming.where("source_url IS NOT NULL").withColumns({"bucket": bucket(F.col("source_url")), "images": F.when(F.size("images") > 0, F.col("images"))}).persist()
        try:
            touched = [r["bucket"] for r in rows.select("bucket").distinct().collect()]  # at most RANGES * PARTS
            current = read_listings(spark, store, touched)
            dated = merge.upsert_dated(current, rows, [*FIELDS, "bucket", "scrape_job_id"], F.current_timestamp() if now is None else now)
            dated = dated.withColumn("id", F.coalesce("id", F.xxhash64("source_url")))
            _commit(spark, store, batch, dated, touched, merge.price_history_rows(current, rows))
        finally:
            rows.unpersist()
    _finish(spark, store, batch)


def prune_batch(store: str, seen: DataFrame, batch: int | str, least: int = 10, most: float = 0.3) -> None:
    """Drops listings of the partners in seen(source_partner, source_url) whose url was not seen, where merge.prune() finds that safe.

    seen holds all urls that a crawl of these partners found; only their hosts' buckets are read and rewritten.
    """
    spark, batch = seen.sparkSession, str(batch)
    if _exists(spark, f"{store}/done/{batch}"):
        return
    if not _exists(spark, f"{store}/ready/{batch}"):
        ranges = [r[0] for r in seen.select(F.pmod(F.xxhash64(host(F.col("source_url"))), F.lit(RANGES)).cast("int").alias("r")).where("r IS NOT NULL").distinct().collect()]  # at most RANGES
        own = read_listings(spark, store, [r * PARTS + p for r in ranges for p in range(PARTS)])
        partners = seen.select("source_partner").distinct()
        marked = merge.prune(own.join(partners, "source_partner", "left_semi"), seen, least, most).where("gone").select("source_url", "bucket")
        marked = marked.persist()
        try:
            touched = [r["bucket"] for r in marked.select("bucket").distinct().collect()]  # at most RANGES * PARTS
            _commit(spark, store, batch, read_listings(spark, store, touched).join(marked.select("source_url"), "source_url", "left_anti"), touched, None)
        finally:
            marked.unpersist()
    _finish(spark, store, batch)
