"""Streams whose state ends: equal to their batch twins, and idle keys hold nothing."""

import pytest
from pyspark.sql import functions as F

from listmill.streaming import jobs

REQUESTS, EVENTS = "key long, t double, id long", "job_id long, ts timestamp, event_id long, action string"


def streamed(spark, tmp_path, name, parts, schema, job, mode="append"):
    """Rows that `job` gives for a stream of one file for each part, and the state rows held at its end."""
    for k, rows in enumerate(parts):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in" / str(k)))
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    run = job(source).writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    run.awaitTermination()
    held = spark.read.format("statestore").option("stateVarName", {"append": "held", "update": "job"}[mode]).load(str(tmp_path / "cp"))
    return spark.table(name).collect(), {r.key[0] for r in held.select("key").distinct().collect()}


def requests(keys, starts):
    """Bursts of five requests of every key at every start, ids in order."""
    return [[(k, 1e6 + s + 7.0 * i, 1000 * int(s) + 10 * k + i) for k in keys for i in range(5)] for s in starts]


@pytest.mark.parametrize(("name", "job"), [("limited", lambda df: jobs.rate_limit(df, 2, 20.0)), ("reused", lambda df: jobs.ttl_reuse(df, 20.0)), ("free", lambda df: jobs.rate_limit(df, 0, 20.0))])
def test_requests(spark, tmp_path, name, job):
    parts = requests(range(40), [0.0, 30.0]) + requests([1, 2], [5000.0, 9000.0, 13000.0])
    out, held = streamed(spark, tmp_path, name, parts, REQUESTS, job)
    batch = job(spark.createDataFrame([r for p in parts for r in p], REQUESTS)).collect()
    assert sorted(map(tuple, out)) == sorted(map(tuple, batch)) and len(out) == 430
    assert held <= {1, 2}  # 40 keys had state once


def test_lifecycle(spark, tmp_path):
    at = lambda j, s, e, a: (j, s, e, a)
    raw = [
        [at(j, 10 * j, j, "start") for j in range(30)],
        [at(j, 400 + j, 100 + j, "complete" if j % 3 else "cancel") for j in range(30)],
        [at(1, 20_000, 200, "start"), at(3, 20_001, 201, "complete"), at(2, 20_002, 202, "cancel")],  # 1 and 2 had been forgotten
        [at(1, 40_000, 300, "tick")], [at(1, 40_010, 400, "fail")],
    ]
    parts = [[(j, spark.sql(f"SELECT timestamp_seconds(1000000 + {s})").first()[0], e, a) for j, s, e, a in p] for p in raw]
    out, held = streamed(spark, tmp_path, "moved", parts, EVENTS, lambda df: jobs.lifecycle(df, 3600), "update")
    last = {r["job_id"]: r["state"] for r in out}
    batch = jobs.lifecycle(spark.createDataFrame([r for p in parts for r in p], EVENTS), 3600).collect()
    assert last == {r["job_id"]: r["state"] for r in batch}
    assert (last[1], last[2], last[3], last[4], last[6]) == ("failed", "cancelled", "cancelled", "completed", "running")
    assert held == {j for j in range(30) if j % 3 == 0 and j != 3} | {1}  # running jobs, and the one that ended last


def test_lifecycle_without_an_end_keeps_all(spark):
    rows = [(1, 0, 1, "start"), (1, 1, 2, "complete"), (1, 10**9, 3, "start"), (None, 5, 4, "cancel"), (2, 5, 5, None)]
    out = jobs.lifecycle(spark.createDataFrame(rows, "job_id long, ts long, event_id long, action string"))
    assert {r["job_id"]: r["state"] for r in out.collect()} == {1: "completed", None: "cancelled", 2: "pending"}


def test_first_seen_stream(spark, tmp_path):
    at = lambda s: spark.sql(f"SELECT timestamp_seconds(1000000 + {s})").first()[0]
    parts = [[(1, "a", at(0)), (1, "a", at(1)), (2, "a", at(2))], [(1, "a", at(3)), (1, "b", at(4))]]
    for k, rows in enumerate(parts):
        spark.createDataFrame(rows, "job_id long, url string, ts timestamp").coalesce(1).write.parquet(str(tmp_path / "in" / str(k)))
    source = spark.readStream.schema("job_id long, url string, ts timestamp").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    run = jobs.first_seen(source).writeStream.format("memory").queryName("seen").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    run.awaitTermination()
    batch = jobs.first_seen(spark.createDataFrame([r for p in parts for r in p], "job_id long, url string, ts timestamp"))
    assert sorted((r.job_id, r.url) for r in spark.table("seen").collect()) == sorted((r.job_id, r.url) for r in batch.collect()) == [(1, "a"), (1, "b"), (2, "a")]


def test_evict(spark):
    rows = [(1, "running", 0), (2, "failed", 0), (3, "completed", 6400), (4, "cancelled", 6399), (5, "failed", None), (6, None, 0)]
    df = spark.createDataFrame(rows, "job_id long, status string, s long").withColumn("finished_at", F.timestamp_seconds("s"))
    assert sorted(r.job_id for r in jobs.evict(df, F.timestamp_seconds(F.lit(10_000))).collect()) == [1, 3, 5, 6]
    assert jobs.evict(df.limit(0), F.current_timestamp()).count() == 0
