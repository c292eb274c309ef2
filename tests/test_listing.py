"""Ported scalar cases, whole queries against SQL, and streams against their batch twins."""

import os

import duckdb
import pytest
from pyspark.sql import functions as F

from listmill.functions import columns as C
from listmill.operators import extract, merge, query
from listmill.plans import registry
from listmill.sources import tables
from listmill.streaming import jobs, store

from .conftest import DATA


def values(spark, column, rows, kind="string"):
    return [r[0] for r in spark.createDataFrame([(i, x) for i, x in enumerate(rows)], f"i int, x {kind}").orderBy("i").select(column(F.col("x"))).collect()]


def test_price(spark):
    rows = ["250 000 €", "1.250.000 €", "250.000,50 €", "$500,000", None, "Price on request", "sob consulta", "950 €", "1234,56", "1,234,567", "250 000 €"]
    amounts = values(spark, lambda c: C.price_amount(c).cast("double"), rows)
    assert amounts == [250000, 1250000, 250000.5, 500000, None, None, None, None, 1234.56, 1234567, 250000]
    assert values(spark, C.currency, rows)[:5] == ["EUR", "EUR", "EUR", "USD", None]
    assert values(spark, C.on_request, rows)[5:8] == [True, True, False]


def test_area_int_bool_typology(spark):
    assert values(spark, C.area, ["120 m²", "120,5 m²", None, "not available", "2.408 m²"]) == [120.0, 120.5, None, None, 2408.0]
    assert values(spark, C.first_int, ["2", "T3", None]) == [2, 3, None]
    assert values(spark, C.tri_bool, ["Yes", "Sim", "No", None, "3", "0", "maybe"]) == [True, True, False, None, True, False, None]
    assert values(spark, C.bedrooms, ["T3", "T0", None, "V4"]) == [3, 0, None, 4]


def test_price_per_m2(spark):
    row = spark.sql("SELECT CAST(250000 AS DECIMAL(12,2)) AS p").select(
        C.price_per_m2(F.col("p"), F.lit(100.0), F.lit(80.0)), C.price_per_m2(F.col("p"), F.lit(0.0), F.lit(0.0)), C.price_per_m2(F.lit(None), F.lit(100.0), F.lit(1.0))
    )
    assert tuple(row.first()) == (2500.0, None, None)


def test_description(spark):
    text = "DescriçãoS. Pedro da Cova.Gondomar. Moradia V3 com garagem para 2 carros."
    rows = [text, "Descrição - Casa", "DESCRICAO: a,b ; c", "Description  x !y", "descriçãoA 1.5 m", " ", None, "Descrição"]
    assert values(spark, C.clean_description, rows) == ["S. Pedro da Cova. Gondomar. Moradia V3 com garagem para 2 carros.", "Casa", "DESCRICAO: a,b; c", "x! y", "A 1. 5 m", None, None, None]


def test_urls(spark):
    allowed = ["https://example.com/a", "http://localhost/", "http://10.0.0.1/", "ftp://x", "https://db.internal/x", "http://172.20.1.1", None]
    assert values(spark, C.url_allowed, allowed) == [True, False, False, False, False, False, False]
    joined = values(spark, lambda c: C.url_join(F.lit("https://a.test/x/y.html?q=1"), c), ["/p", "z", "https://b/", "//c/d"])
    assert joined == ["https://a.test/p", "https://a.test/x/z", "https://b/", "https://c/d"]


HTML = """<html><head><title>Casa</title></head><body><h1 class="title">T3 Lisboa</h1><span class="price">250 000 €</span>
<section id="details"><ul><li class="detail"><b class="name">Preço</b><span class="value">500 000 €</span></li><li class="detail"><b class="name">Tipologia</b><span class="value">T4</span></li></ul></section>
<a class="property-link" href="/property/1">one</a><a class="property-link" href="/property/2">two</a><a href="/property/1">again</a><p>open<p>next</body></html>"""


def test_extraction(spark):
    pages = spark.createDataFrame([(1, "https://e.test/list", HTML), (2, "https://e.test/x", ""), (3, "https://e.test/y", None)], "page_id long, url string, html string")
    ok, failed = tables.read_pages(pages)
    assert (ok.count(), failed.count()) == (1, 2)
    nodes = extract.dom_nodes(pages)
    assert extract.select_nodes(nodes, "p").count() == 2
    wide = extract.extract_direct(nodes, {"title": "h1.title", "price": ".price", "first": "#details > ul > li:nth-of-type(1) .value"}).first()
    assert (wide["title"], wide["price"], wide["first"]) == ("T3 Lisboa", "250 000 €", "500 000 €")
    dim = spark.createDataFrame([("preço", "price", 0), ("tipologia", "typology", 1)], "key string, field string, rank int")
    pairs = {r["field"]: r["value"] for r in extract.label_pairs(nodes, "li.detail", ".name", ".value", dim).collect()}
    assert pairs == {"price": "500 000 €", "typology": "T4"}
    assert [r["url"] for r in extract.listing_links(nodes, ok, "a", "/property/").orderBy("ord").collect()] == ["https://e.test/property/1", "https://e.test/property/2"]
    with pytest.raises(ValueError):
        extract.select_nodes(nodes, "a:hover")


def test_sitemaps(spark):
    rows = [("root", "<sitemapindex><sitemap><loc> a </loc></sitemap></sitemapindex>"), ("a", "<urlset><url><loc> https://e/1 </loc></url><url><loc></loc></url></urlset>"), ("b", "<urlset><url><loc>https://e/2</loc></url></urlset>")]
    maps = spark.createDataFrame(rows, "sitemap string, xml string")
    found = tables.sitemap_urls(tables.expand_sitemaps(maps, maps.where("sitemap = 'root'")))
    assert [r["url"] for r in found.collect()] == ["https://e/1"]


def test_guard_and_sinks(spark, tmp_path):
    df = spark.range(2)
    with pytest.raises(ValueError):
        tables.guard_rows(df, 1)
    tables.write_csv(tables.guard_rows(df, 2), str(tmp_path / "csv"))
    tables.write_json(spark.sql("SELECT 'é' AS a, CAST(NULL AS STRING) AS b"), str(tmp_path / "json"))
    assert spark.read.text(str(tmp_path / "json")).first()[0] == '{"a":"é","b":null}'


def test_upsert_is_idempotent(spark):
    current = spark.createDataFrame([("u1", 1, "a", 5.0), ("u2", 2, "b", 6.0)], "source_url string, id long, title string, price_amount double")
    new = spark.createDataFrame([("u1", 1, None, 7.0), ("u1", 2, "z", None), ("u3", 3, "c", 1.0)], "source_url string, ord long, title string, price_amount double")
    once = merge.upsert(current, new, ["title", "price_amount"]).drop("state")
    twice = merge.upsert(once, new, ["title", "price_amount"]).drop("state")
    assert sorted(map(str, once.collect())) == sorted(map(str, twice.collect()))
    assert query.page(query.sort_by(once.withColumnRenamed("id", "id"), "title"), 2, 2)[1] == {"page": 2, "size": 2, "total": 3, "pages": 2}


def test_rate_and_ttl(spark):
    rows = lambda ts: spark.createDataFrame([(1, float(t), i) for i, t in enumerate(ts)], "key long, t double, id long")
    assert [r["admitted"] for r in jobs.rate_limit(rows([0, 1, 2]), 2, 60).orderBy("id").collect()] == [True, True, False]
    assert [r["admitted"] for r in jobs.rate_limit(rows([0, 10.1]), 1, 10).orderBy("id").collect()] == [True, True]
    assert [r["hit"] for r in jobs.ttl_reuse(rows([50, 61]), 10).orderBy("id").collect()] == [False, False]
    assert [r["hit"] for r in jobs.ttl_reuse(rows([100, 100]), 300).orderBy("id").collect()] == [False, True]


def test_lifecycle(spark):
    moves = {1: ["start", "complete"], 2: ["cancel", "start"], 3: ["start", "cancel", "complete"], 4: ["complete"], 5: ["start", "fail", "complete"]}
    rows = [(j, i, i, a) for j, acts in moves.items() for i, a in enumerate(acts)]
    out = {r["job_id"]: r["state"] for r in jobs.lifecycle(spark.createDataFrame(rows, "job_id long, ts long, event_id long, action string")).collect()}
    assert out == {1: "completed", 2: "cancelled", 3: "cancelled", 4: "pending", 5: "failed"}


def test_lifecycle_and_logs_hold_no_job_as_a_whole(spark):
    """One job of most events: no array of them, neither in the life cycle nor in the flattened logs."""
    action = F.expr("CASE WHEN id = 70000 THEN 'start' WHEN id = 80000 THEN 'cancel' WHEN id = 90000 THEN 'complete' ELSE 'tick' END")
    events = spark.range(100_000).select(F.when(F.col("id") % 1000 > 0, 1).when(F.col("id") < 95_000, 1).otherwise(F.col("id")).cast("long").alias("job_id"), F.col("id").alias("ts"), F.col("id").alias("event_id"), action.alias("action"))
    out = jobs.lifecycle(events.orderBy(F.desc("ts")))
    assert {r["job_id"]: r["state"] for r in out.collect()} == {1: "cancelled"} | {i: "pending" for i in range(95_000, 100_000, 1000)}
    for df in (out, registry.QUERIES["c38_flatten_logs"](spark, DATA)):
        assert "collect_list" not in df._jdf.queryExecution().toString()


def test_stream_equals_batch(spark, tmp_path):
    kinds = ["view", "click"]
    os.makedirs(tmp_path / "in")
    os.symlink(f"{DATA}/events.parquet", tmp_path / "in" / "events.parquet")
    shape = lambda df: df.select(F.col("user_id").alias("job_id"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("kind"))
    stream = jobs.counters(shape(jobs.read_job_events(spark, str(tmp_path / "in"))), kinds)
    run = stream.writeStream.outputMode("complete").format("memory").queryName("counted").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    run.awaitTermination()
    batch = jobs.counters(shape(spark.read.parquet(f"{DATA}/events.parquet")), kinds)
    assert sorted(spark.sql("SELECT * FROM counted").collect()) == sorted(batch.collect())


def streamed(spark, tmp_path, name, rows, order, job, mode="append"):
    """Rows that `job` gives for `rows` as a stream of three files in order."""
    rows = rows.toPandas().sort_values(order)
    schema, cut = job[1], len(rows) // 3
    for k, part in enumerate((rows[:cut], rows[cut : 2 * cut], rows[2 * cut :])):
        spark.createDataFrame(part, schema).coalesce(1).write.parquet(str(tmp_path / "in" / str(k)))
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    run = job[0](source).writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    run.awaitTermination()
    return spark.table(name)


@pytest.mark.parametrize("name, job", [("limited", lambda df: jobs.rate_limit(df, 2, 86400.0)), ("reused", lambda df: jobs.ttl_reuse(df, 86400.0))])
def test_requests_stream_equals_batch(spark, tmp_path, name, job):
    rows = spark.read.parquet(f"{DATA}/events.parquet").select(F.col("user_id").alias("key"), F.unix_timestamp(F.col("ts").cast("timestamp")).cast("double").alias("t"), F.col("event_id").alias("id"))
    batch = sorted(map(tuple, job(rows).collect()))
    assert {x[3] for x in batch} == {True, False}
    assert sorted(map(tuple, streamed(spark, tmp_path, name, rows, ["t", "id"], (job, rows.schema)).collect())) == batch


def test_lifecycle_stream_equals_batch(spark, tmp_path):
    action = F.expr("CASE event_id % 5 WHEN 0 THEN 'start' WHEN 1 THEN 'cancel' WHEN 2 THEN 'complete' WHEN 3 THEN 'fail' ELSE 'tick' END")
    rows = spark.read.parquet(f"{DATA}/events.parquet").select(F.col("user_id").alias("job_id"), F.col("ts").cast("timestamp").alias("ts"), "event_id", action.alias("action"))
    out = streamed(spark, tmp_path, "moved", rows, ["ts", "event_id"], (jobs.lifecycle, rows.schema), "update").collect()
    batch = {r["job_id"]: r["state"] for r in jobs.lifecycle(rows).collect()}
    assert len(set(batch.values())) > 2 and {r["job_id"]: r["state"] for r in out} == batch


def test_stale_stream_equals_batch(spark, tmp_path):
    rows = spark.read.parquet(f"{DATA}/events.parquet").select(F.col("user_id").alias("job_id"), F.col("ts").cast("timestamp").alias("ts"), "event_id")
    batch = sorted(map(tuple, jobs.stale(rows, 86400).select("job_id", "event_id").collect()))
    out = streamed(spark, tmp_path, "stale", rows, ["ts", "event_id"], (lambda df: jobs.stale(df, 86400), rows.schema))
    assert batch and sorted(map(tuple, out.select("job_id", "event_id").collect())) == batch


def test_ingest_listings(spark, tmp_path):
    html = lambda title, price: f"<h1>{title}</h1><b class='price'>{price}</b><i class='area'>80 m²</i>"
    batches = [[(1, "https://a/1", html(" Flat  one ", "250 000 €") + "<img src=/p.jpg>"), (2, "https://a/2", html("Two", "100 000 €")), (3, "https://a/2", html("Two again", "110 000 €"))], [(4, "https://a/1", html("Flat", "240 000 €")), (5, "https://b/3", html("Three", "sob consulta")), (6, None, html("No url", "1 000 €"))], [(7, "https://b/3", "")]]
    schema = "page_id long, url string, html string"
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in" / str(k)))
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    path = str(tmp_path / "store")
    jobs.ingest_listings(source, {"title": "h1", "price": "b.price", "area": "i.area", "images": "img"}, path, str(tmp_path / "cp")).awaitTermination()
    out = {r["source_url"]: (r["title"], r["price_amount"], r["price_currency"], r["area_useful_m2"], r["images"]) for r in store.read_listings(spark, path).collect()}
    assert out == {"https://a/1": ("Flat", 240000, "EUR", 80, ["https://a/p.jpg"]), "https://a/2": ("Two again", 110000, "EUR", 80, None), "https://b/3": ("Three", None, None, 80, None)}
    prices = [(r["batch"], r["source_url"], r["old_price"], r["old_currency"], r["new_price"]) for r in store.read_prices(spark, path).collect()]
    assert prices == [(1, "https://a/1", 250000, "EUR", 240000)]


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query_equals_sql(spark, name):
    rows = registry.QUERIES[name](spark, DATA)
    if name not in registry.ORACLES:
        assert rows.count() >= 0
        return
    db = duckdb.connect()
    for t in ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations").split():
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    cursor = db.execute(registry.ORACLES[name])
    names = [c[0] for c in cursor.description]
    order = sorted(names)
    assert sorted(rows.columns) == order
    theirs = sorted(str([dict(zip(names, r, strict=True))[c] for c in order]) for r in cursor.fetchall())
    assert theirs or name == "g6_duplicates"  # the smallest tables have none
    assert sorted(str([r[c] for c in order]) for r in rows.collect()) == theirs
