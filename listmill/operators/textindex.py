"""An inverted index: which rows have a token, as a table partitioned by the token's bucket and sorted by token.

A search reads the buckets of its tokens alone, and in their files the row groups whose range of tokens may hold them. A bucket's rows
are dealt to SPREAD files by their id, so that no task writes a frequent token alone. An update rewrites the buckets whose tokens
change, from a staged copy; running it again after a failure gives the same table, as it removes and adds sets of rows.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from listmill.sources.tables import shared_folder, written

#: Buckets of an index, for good, and files that a bucket is dealt to at most.
BUCKETS, SPREAD = 256, 8
#: What becomes of a row of the index; 0 stands for nothing.
ADDED, REMOVED = 1, 2
SCHEMA = "token string, id long, bucket int"


def _bucket(token):
    return F.pmod(F.xxhash64(token), F.lit(BUCKETS)).cast("int")


def postings(rows: DataFrame) -> DataFrame:
    """rows(id, tokens array) as (token, id, bucket); null and repeated tokens of a row and null ids are left out."""
    each = rows.where("id IS NOT NULL").select(F.explode(F.array_distinct("tokens")).alias("token"), F.col("id").cast("long").alias("id"))
    return each.where("token IS NOT NULL").withColumn("bucket", _bucket(F.col("token")))


def _dealt(rows: DataFrame) -> DataFrame:
    """rows(token, id, bucket) as they are written: a shuffle that also brings repeated rows together, so that they need none of their own."""
    return rows.withColumn("spread", F.pmod(F.xxhash64("id"), F.lit(SPREAD))).repartition("bucket", "spread")


def _write(rows: DataFrame, path: str) -> None:
    dealt = _dealt(rows).dropDuplicates(["bucket", "spread", "token", "id"]).select("token", "id", "bucket").sortWithinPartitions("bucket", "token", "id")
    dealt.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path)


def build_index(rows: DataFrame, path: str) -> None:
    """The index of rows(id, tokens) at a new `path`."""
    _write(postings(rows), path)


def read_index(spark: SparkSession, path: str, buckets: list[int]) -> DataFrame:
    return spark.read.schema(SCHEMA).parquet(path).where(F.col("bucket").isin(buckets))


def buckets_of(spark: SparkSession, tokens: list[str]) -> list[int]:
    return sorted({r[0] for r in spark.createDataFrame([(t,) for t in tokens], "t string").select(_bucket(F.col("t"))).collect()})


def search_index(spark: SparkSession, path: str, tokens: list[str]) -> DataFrame:
    """(id) of the rows that have all the tokens; without tokens none."""
    asked = sorted(set(tokens))
    if not asked:
        return spark.createDataFrame([], "id long")
    rows = read_index(spark, path, buckets_of(spark, asked)).where(F.col("token").isin(asked))
    return rows.groupBy("id").agg(F.count("*").alias("n")).where(F.col("n") == len(asked)).select("id")


def update_index(path: str, before: DataFrame, after: DataFrame) -> None:
    """Brings the index to the new tokens of changed rows: before(id, tokens) are these rows as indexed, after as they are now.

    New rows stand in `after` alone, removed ones in `before` alone.
    """
    spark = before.sparkSession
    both = postings(before).withColumn("now", F.lit(0)).unionByName(postings(after).withColumn("now", F.lit(1)))
    changed = both.groupBy("token", "id", "bucket").agg(F.min("now").alias("was"), F.max("now").alias("now"))
    changed = written(changed.where("was = now").select("token", "id", "bucket", F.when(F.col("now") == 1, ADDED).otherwise(REMOVED).alias("change")))
    touched = [r["bucket"] for r in changed.select("bucket").distinct().collect()]  # at most BUCKETS
    if not touched:
        return
    every = read_index(spark, path, touched).withColumn("change", F.lit(0)).unionByName(changed)
    every = _dealt(every).groupBy("bucket", "spread", "token", "id").agg(F.max("change").alias("change")).where(F.col("change") != REMOVED)
    staged = f"{shared_folder(spark)}/index-{uuid.uuid4().hex}"
    every.select("token", "id", "bucket").write.parquet(staged)
    rows = spark.read.schema(SCHEMA).parquet(staged)
    _write(rows, path)
    left = {r["bucket"] for r in rows.select("bucket").distinct().collect()}  # at most BUCKETS
    fs_path = spark._jvm.org.apache.hadoop.fs.Path
    for b in set(touched) - left:  # a bucket without rows is not overwritten
        p = fs_path(f"{path}/bucket={b}")
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
