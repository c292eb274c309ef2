"""Typed tables from files and from a database, and a table sink that holds each row once."""

import pytest
from pyspark.sql import functions as F

from listmill.sources import tables
from listmill.streaming import jobs


def plan_of(df):
    df.sparkSession.conf.set("spark.sql.maxMetadataStringLength", "10000")
    return df._jdf.queryExecution().executedPlan().toString()


def test_typed_table_reads_what_is_asked(spark, tmp_path):
    rows = spark.range(100).select("id", F.lit("p").alias("source_partner"), (F.col("id") * 10).cast("decimal(12,2)").alias("price_amount"), F.lit(1).alias("extra"))
    rows.write.parquet(str(tmp_path / "listings"))
    df = tables.read_table(spark, "listings", str(tmp_path))
    assert df.columns[:4] == ["id", "partner_id", "source_partner", "source_url"] and "extra" not in df.columns
    some = df.where("price_amount >= 900 AND source_partner = 'p'").select("id", "title")
    assert [(r.id, r.title) for r in some.orderBy("id").collect()] == [(i, None) for i in range(90, 100)]
    text = plan_of(some)
    assert "GreaterThanOrEqual(price_amount,900.00)" in text and "EqualTo(source_partner,p)" in text
    assert "ReadSchema: struct<id:bigint,source_partner:string,title:string,price_amount:decimal(12,2)>" in text
    with pytest.raises(KeyError):
        tables.read_table(spark, "unheard", str(tmp_path))


def test_typed_table_from_a_database(spark):
    url = "jdbc:derby:memory:listmill;create=true"
    conn = spark._jvm.java.sql.DriverManager.getConnection(url)
    ask = conn.createStatement()
    ask.execute("CREATE TABLE jobs (job_id BIGINT, site_key VARCHAR(20), status VARCHAR(20), config VARCHAR(200))")
    rows = [(i, f"'s{i % 3}'", "'running'" if i % 2 else "NULL") for i in range(50)] + [("NULL", "'none'", "'failed'")]
    ask.execute("INSERT INTO jobs VALUES " + ", ".join(f"({i}, {k}, {s}, '{{}}')" for i, k, s in rows))
    conn.close()
    df = tables.read_jdbc(spark, "jobs", url, "job_id", 4, {"driver": "org.apache.derby.iapi.jdbc.AutoloadedDriver"})
    assert df.schema.simpleString() == spark.createDataFrame([], tables.TABLES["jobs"]).schema.simpleString()
    assert df.rdd.getNumPartitions() == 4 and df.count() == 51
    counts = [r["count"] for r in df.groupBy(F.spark_partition_id().alias("p")).count().orderBy("p").collect()]
    assert len(counts) == 4 and max(counts) <= 14
    some = df.where("site_key = 's1' AND job_id > 20").select("job_id")
    assert sorted(r.job_id for r in some.collect()) == [i for i in range(21, 50) if i % 3 == 1]
    text = plan_of(some)
    assert "EqualTo(" in text and "s1" in text and "GreaterThan(" in text  # they reach the database


def test_sink_holds_each_row_once(spark, tmp_path):
    schema, path, checkpoint = "event_id long, kind string", str(tmp_path / "out"), str(tmp_path / "cp")
    for k in range(3):
        spark.createDataFrame([(10 * k + i, "ab"[i % 2]) for i in range(5)], schema).coalesce(1).write.parquet(str(tmp_path / "in" / str(k)))
    stream = lambda: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    failed = []

    def fails_once(batch, k):
        batch.write.mode("overwrite").parquet(f"{path}/batch={k}")
        if k == 1 and not failed:
            failed.append(k)
            raise RuntimeError("after the rows were written, before the batch was noted")

    with pytest.raises(Exception, match="before the batch was noted"):
        jobs.ingest(stream(), fails_once, checkpoint).awaitTermination()
    jobs.sink_table(stream(), path, checkpoint).awaitTermination()
    jobs.sink_table(stream(), path, checkpoint).awaitTermination()  # nothing new
    out = jobs.read_sink(spark, path, schema)
    assert sorted(r.event_id for r in out.collect()) == [10 * k + i for k in range(3) for i in range(5)]
    assert out.select("batch").distinct().count() == 3
    other = str(tmp_path / "by")
    jobs.sink_table(stream(), other, str(tmp_path / "cp2"), "kind").awaitTermination()
    assert jobs.read_sink(spark, other, schema).where("kind = 'b'").count() == 6
