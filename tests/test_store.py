"""The listing table in buckets: what a batch writes, batches that run again, pruning."""

import os

import pytest
from pyspark.sql import functions as F

from listmill.streaming import store

ROWS = "source_url string, source_partner string, title string, price_amount decimal(18,2), price_currency string, area_useful_m2 double, images array<string>, scrape_job_id long, ord long"


def rows_of(spark, hosts, urls, price, job):
    own = spark.range(len(hosts) * len(urls)).select((F.col("id") / len(urls)).cast("int").alias("h"), (F.col("id") % len(urls)).cast("int").alias("u"))
    url = F.concat(F.lit("https://"), F.element_at(F.array(*map(F.lit, hosts)), F.col("h") + 1), F.lit(".test/p/"), F.element_at(F.array(*map(F.lit, urls)), F.col("u") + 1))
    return own.select(url.alias("source_url"), F.element_at(F.array(*map(F.lit, hosts)), F.col("h") + 1).alias("source_partner"), F.repeat(F.lit("some title "), 20).alias("title"), F.lit(price).cast("decimal(18,2)").alias("price_amount"),
                      F.lit("EUR").alias("price_currency"), F.lit(80.0).alias("area_useful_m2"), F.array(F.lit("i.jpg")).alias("images"), F.lit(job).cast("long").alias("scrape_job_id"), F.lit(1).cast("long").alias("ord"))


def files(path):
    return {os.path.join(d, n): os.path.getsize(os.path.join(d, n)) for d, _, names in os.walk(path) for n in names if n.endswith(".parquet")}


def at(day):
    return F.lit(f"2024-01-0{day} 00:00:00").cast("timestamp")


def test_small_batch_writes_little(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(store, "PARTS", 4)
    path = str(tmp_path / "s")
    hosts = [f"host{k}" for k in range(100)]
    store.merge_batch(path, rows_of(spark, hosts, list(range(100)), 100, 1), 0, at(1))
    before = files(f"{path}/listings")
    batch = rows_of(spark, ["host7"], list(range(50, 149)) + [1000], 90, 2)
    store.merge_batch(path, batch, 1, at(2))
    after = files(f"{path}/listings")
    assert sum(after[f] for f in after.keys() - before.keys()) < 0.05 * sum(after.values())
    out = store.read_listings(spark, path)
    got = out.groupBy("source_partner", "scrape_job_id", "price_amount", "created_at", "updated_at").count()
    by = {(r.source_partner == "host7", r.scrape_job_id, float(r.price_amount), r.created_at.day, r.updated_at.day): r["count"] for r in got.where("source_partner IN ('host7', 'host8')").collect()}
    assert by == {(False, 1, 100.0, 1, 1): 100, (True, 1, 100.0, 1, 1): 50, (True, 2, 90.0, 1, 2): 50, (True, 2, 90.0, 2, 2): 50}
    assert out.count() == 10_050 == out.select("source_url").distinct().count() and store.read_prices(spark, path).count() == 50
    store.merge_batch(path, batch.withColumn("price_amount", F.lit(1).cast("decimal(18,2)")), 1, at(3))  # the same batch again
    assert files(f"{path}/listings") == after


@pytest.mark.parametrize("step", ["_replace", "_mark"])
def test_batch_that_failed_runs_again(spark, tmp_path, monkeypatch, step):
    path, hosts = str(tmp_path / "s"), ["a", "b"]
    store.merge_batch(path, rows_of(spark, hosts, [1, 2, 3], 100, 1), "first", at(1))
    batch, own = rows_of(spark, ["a"], [3, 4], 90, 2), getattr(store, step)

    def fails(*args):
        if step == "_replace" or "/done/" in args[1]:
            own(*args) if step == "_replace" else None  # the table may have been changed already
            raise RuntimeError
        own(*args)

    monkeypatch.setattr(store, step, fails)
    with pytest.raises(RuntimeError):
        store.merge_batch(path, batch, "second", at(2))
    monkeypatch.undo()
    store.merge_batch(path, batch, "second", at(5))
    out = {(r.source_url, float(r.price_amount), r.created_at.day, r.updated_at.day) for r in store.read_listings(spark, path).collect()}
    want = {(f"https://{h}.test/p/{k}", 100.0, 1, 1) for h in hosts for k in (1, 2, 3)} - {("https://a.test/p/3", 100.0, 1, 1)}
    assert out == want | {("https://a.test/p/3", 90.0, 1, 2), ("https://a.test/p/4", 90.0, 2, 2)}
    assert [(r.source_url, float(r.old_price), r.old_currency) for r in store.read_prices(spark, path).collect()] == [("https://a.test/p/3", 100.0, "EUR")]


def test_nulls_and_ties(spark, tmp_path):
    path, none = str(tmp_path / "s"), [None] * 6
    rows = [("https://x/1", "p", "t", 5, "EUR", 1.0, ["i"], 1, 1), ("https://x/1", "p", "later", None, None, None, [], 2, 2), (None, "p", "no url", *none), ("not a url", None, None, *none), ("", "p", None, *none)]
    for k in range(2):
        store.merge_batch(path, spark.createDataFrame([(*r[:3], None if r[3] is None else __import__("decimal").Decimal(r[3]), *r[4:]) for r in rows[k:]], ROWS), k, at(1))
        store.merge_batch(path, spark.createDataFrame([], ROWS), f"empty {k}", at(2))
    out = {r.source_url: (r.title, r.price_amount, r.images, r.scrape_job_id) for r in store.read_listings(spark, path).collect()}
    assert out == {"https://x/1": ("later", None, None, 2), "not a url": (None, None, None, None), "": (None, None, None, None)}


def test_pruning_reads_and_writes_its_partners_alone(spark, tmp_path):
    path = str(tmp_path / "s")
    store.merge_batch(path, rows_of(spark, ["a", "b", "c"], list(range(20)), 100, 1), 0, at(1))
    before = files(f"{path}/listings")
    seen = rows_of(spark, ["a"], list(range(16)), 1, 1).unionByName(rows_of(spark, ["b"], list(range(5)), 1, 1)).select("source_partner", "source_url")
    for _ in range(2):
        store.prune_batch(path, seen, "prune 1")
    left = {r.source_partner: r["count"] for r in store.read_listings(spark, path).groupBy("source_partner").count().collect()}
    assert left == {"a": 16, "b": 20, "c": 20}  # of b too few urls were seen
    gone = before.keys() - files(f"{path}/listings").keys()
    assert gone and not {r[0].removeprefix("file://") for r in spark.read.parquet(f"{path}/listings").where("source_partner <> 'a'").select(F.input_file_name()).distinct().collect()} - before.keys() - files(f"{path}/listings").keys()
    store.prune_batch(path, rows_of(spark, ["a"], list(range(16)), 1, 1).select("source_partner", "source_url"), "prune 2", most=1.0)
    assert store.read_listings(spark, path).count() == 56


def test_a_bucket_may_become_empty(spark, tmp_path):
    path = str(tmp_path / "s")
    store.merge_batch(path, rows_of(spark, ["a"], list(range(40)), 100, 1), 0, at(1))
    store.prune_batch(path, rows_of(spark, ["a"], [0, 1], 1, 1).select("source_partner", "source_url"), 1, least=1, most=1.0)
    assert sorted(r.source_url for r in store.read_listings(spark, path).collect()) == ["https://a.test/p/0", "https://a.test/p/1"]
