"""Queries of sources, exports, normalisation by fixed words, search, lookups and progress."""

from __future__ import annotations

from pyspark.sql import functions as F

from listmill.functions import columns as C
from listmill.operators import extract, query, stats
from listmill.plans.registry import NOW, q
from listmill.sources import tables
from listmill.sources.bindings import table, view


def _pick(values: list[str | None], key: str = "doc_id"):
    """One of some texts for each row, by its key."""
    return F.element_at(F.array(*[F.lit(v).cast("string") for v in values]), (F.col(key) % len(values) + 1).cast("int"))


def _sql(values: list[str | None], key: str = "doc_id") -> str:
    """The same as SQL."""
    texts = ", ".join("NULL" if v is None else "'" + v.replace("'", "''") + "'" for v in values)
    return f"[{texts}][{key} % {len(values)} + 1]"


@q("SELECT page_id, html IS NOT NULL AND length(html) > 0 AS body FROM pages")
def a1_read_pages(spark, d):
    good, bad = tables.read_pages(table(spark, d, "pages"))
    return good.select("page_id", F.lit(True).alias("body")).unionByName(bad.select("page_id", F.lit(False).alias("body")))


@q("SELECT concat('m', CAST(c_custkey AS VARCHAR)) AS sitemap, concat('https://ex.test/', CAST(c_custkey AS VARCHAR), '/', x) AS url FROM customer, (SELECT unnest(['a', 'b']) AS x) y")
def a3_sitemap_urls(spark, d):
    loc = "<url><loc>\n https://ex.test/', CAST(c_custkey AS STRING), '/{} </loc></url>"
    xml = f"concat('<urlset>{loc.format('a')}<url><loc> </loc></url><url><lastmod>x</lastmod><loc>https://ex.test/', CAST(c_custkey AS STRING), '/b</loc></url></urlset>')"
    maps = table(spark, d, "customer").select(F.expr("concat('m', CAST(c_custkey AS STRING))").alias("sitemap"), F.expr(xml).alias("xml"))
    return tables.sitemap_urls(maps)


@q("""SELECT o_orderkey AS sitemap, unnest(CASE o_orderkey % 6 WHEN 0 THEN ['https://e/?a=1&b=' || k, 'https://e/<' || k || '>'] WHEN 1 THEN ['https://sm/' || k] WHEN 2 THEN ['https://c/' || k || '?x&y'] WHEN 5 THEN ['ab' || k] ELSE [] END) AS url
FROM (SELECT o_orderkey, CAST(o_orderkey AS VARCHAR) AS k FROM orders) o""")
def a3_sitemap_forms(spark, d):
    """Entities, prefixed tags, CDATA, a broken document, an index with urls, and text cut by a comment."""
    forms = [
        "<?xml version='1.0'?><urlset xmlns='http://www.sitemaps.org/schemas/sitemap/0.9'><url><loc>https://e/?a=1&amp;b=#</loc></url><url><loc> https://e/&lt;#&gt; </loc></url></urlset>",
        "<sm:urlset xmlns:sm='s'><sm:url><sm:loc>https://sm/#</sm:loc><i:image xmlns:i='i'><i:loc>https://image/#</i:loc></i:image></sm:url></sm:urlset>",
        "<urlset><url><loc><![CDATA[https://c/#?x&y]]></loc></url><url><loc><![CDATA[ ]]></loc></url></urlset>", "<urlset><url><loc>https://broken/#</loc></url>",
        "<sitemapindex><sitemap><loc>m#</loc></sitemap><url><loc>https://index/#</loc></url></sitemapindex>", "<urlset><url><loc>a<!-- x -->b#</loc></url><url/></urlset>",
    ]
    xml = F.replace(F.element_at(F.array(*map(F.lit, forms)), (F.col("o_orderkey") % 6 + 1).cast("int")), F.lit("#"), F.col("o_orderkey").cast("string"))
    maps = table(spark, d, "orders").select(F.col("o_orderkey").alias("sitemap"), xml.alias("xml"))
    return tables.sitemap_urls(maps)


@q("""SELECT k AS sitemap FROM (WITH RECURSIVE r AS (SELECT CAST(1 AS BIGINT) AS k UNION ALL SELECT CAST(c_custkey AS BIGINT) FROM customer JOIN r ON c_custkey // 2 = r.k WHERE c_custkey > 1)
SELECT DISTINCT k FROM r) x WHERE k IN (SELECT c_custkey FROM customer)""")
def a4_expand_sitemaps(spark, d):
    """An index of each customer names two others, so that the deepest is as many levels down as the count doubles."""
    two = "concat('<sitemapindex><sitemap><loc>', CAST(2 * c_custkey AS STRING), '</loc></sitemap><sitemap><loc> ', CAST(2 * c_custkey + 1 AS STRING), ' </loc></sitemap></sitemapindex>')"
    maps = table(spark, d, "customer").select(F.col("c_custkey").cast("string").alias("sitemap"), F.expr(two).alias("xml"))
    out = tables.expand_sitemaps(maps, maps.where("sitemap = '1'"))
    return out.select(F.col("sitemap").cast("long").alias("sitemap"))


_RULES = """SELECT c_custkey AS id, 'field' AS mapping_type, CASE c_custkey % 3 WHEN 0 THEN 's' WHEN 1 THEN 'other' END AS site_key, concat(c_mktsegment, ' ', CAST(c_nationkey AS {text})) AS source_name,
 concat('t', CAST(c_custkey AS {text})) AS target_field, c_custkey % 7 AS priority, c_custkey % 5 <> 0 AS is_active FROM {customer}"""


@q(f"""SELECT key, target_field FROM (SELECT lower(source_name) AS key, target_field, row_number() OVER (PARTITION BY lower(source_name) ORDER BY CASE WHEN site_key = 's' THEN 0 ELSE 1 END, priority DESC, id) AS n
FROM ({_RULES.format(text='VARCHAR', customer='customer')}) r WHERE is_active AND (site_key = 's' OR site_key IS NULL)) x WHERE n = 1""")
def a6_mapping_dim(spark, d):
    return tables.mapping_dim(spark.sql(_RULES.replace("{text}", "STRING"), customer=table(spark, d, "customer")), "field", "s")


@q("SELECT 'preço' AS key, 'price' AS target_field UNION ALL SELECT 'quartos', 'bedrooms'")
def a6_default_mapping(spark, d):
    """No row is of the kind asked for, so that the defaults count."""
    rows = spark.sql(_RULES.replace("{text}", "STRING"), customer=table(spark, d, "customer"))
    return tables.mapping_dim(rows, "feature", "s", {"Preço": "price", "quartos": "bedrooms"})


@q("SELECT CAST(id AS VARCHAR) AS id, CAST(price_amount AS DOUBLE) AS price_amount, CAST(created_at AS VARCHAR) AS created_at FROM listings_v WHERE county ILIKE '%nation_1%' AND price_amount >= 20000")
def a12_export_feed(spark, d):
    feed = tables.export_feed(query.apply_filters(view(spark, d, "listings_v"), county="nation_1", price_min=20000), most=(1 << 31) - 2)
    return feed.select("id", "price_amount", "created_at")


@q("""SELECT l.id, CASE WHEN g.remote_id IS NULL THEN 'create' ELSE 'update' END AS action, g.remote_id, l.partner_id AS reference, '["a.jpg"]' AS images, title AS english, false AS mixed
FROM listings_v l LEFT JOIN ledger_v g ON g.listing_id = l.id""")
def a11_crm_requests(spark, d):
    told = F.struct(F.struct("title").alias("en")).alias("translations")
    payloads = view(spark, d, "listings_v").select("id", F.to_json(F.struct(F.col("partner_id").alias("reference"), F.array(F.lit("a.jpg")).alias("images"), told)).alias("payload"))
    at = lambda c, p: F.get_json_object(c, f"$.{p}")
    out = tables.crm_requests(payloads, view(spark, d, "ledger_v"))
    return out.select("id", "action", "remote_id", at("property", "reference").alias("reference"), "images", at("translations", "en.title").alias("english"), F.contains("property", F.lit("a.jpg")).alias("mixed"))


@q("""SELECT job, url, f.page_id AS page_id, f.ord AS ord FROM (SELECT job, url, min({'page_id': page_id, 'ord': ord}) AS f
FROM (SELECT l_suppkey AS job, concat('u', CAST(l_partkey AS VARCHAR)) AS url, l_orderkey AS page_id, l_linenumber AS ord FROM lineitem) x GROUP BY 1, 2) y""")
def b32_new_links(spark, d):
    links = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("job"), F.concat(F.lit("u"), "l_partkey").alias("url"), F.col("l_orderkey").alias("page_id"), F.col("l_linenumber").alias("ord"))
    return extract.new_links(links, "job")


@q("""SELECT c_custkey AS site, CAST(n AS INTEGER) AS n, CASE c_custkey % 3 WHEN 0 THEN concat('https://ex.test/', c_custkey, '/', n) WHEN 1 THEN concat('https://ex.test/', c_custkey, '/?page=', n) ELSE concat('https://ex.test/?c=', c_custkey, '&page=', n) END AS page_url
FROM customer, range(2, 6) r(n)""")
def b34_page_urls(spark, d):
    k = F.col("c_custkey")
    start = F.when(k % 3 == 2, F.concat(F.lit("https://ex.test/?c="), k)).otherwise(F.concat(F.lit("https://ex.test/"), k, F.lit("/")))
    sites = table(spark, d, "customer").select(k.alias("site"), start.alias("start_url"), F.when(k % 3 > 0, "page").alias("pagination_param"))
    return extract.page_urls(sites, 5).select("site", "n", "page_url")


_HREFS = ["/p", "z?a=1", "?page=2", "#top", "../w", "./v/../u.html", "//c.test/d", "https://b.test/", "../../../r/", "", "mailto:x@y.z", "a/b/.."]
_JOINED = ["https://a.test/p", "https://a.test/x/y/z?a=1", "https://a.test/x/y/q.html?page=2", "https://a.test/x/y/q.html?k=1#top", "https://a.test/x/w", "https://a.test/x/y/u.html", "https://c.test/d", "https://b.test/", "https://a.test/r/", "https://a.test/x/y/q.html?k=1", "mailto:x@y.z", "https://a.test/x/y/a/"]


@q(f"SELECT doc_id, {_sql(_JOINED)} AS url FROM documents")
def b53_url_join(spark, d):
    return table(spark, d, "documents").select("doc_id", C.url_join(F.lit("https://a.test/x/y/q.html?k=1"), _pick(_HREFS)).alias("url"))


_PRICES = ["Preço a definir 250000", "sob  pedido", "¥ 250000", "250 000 euros", "R$ 1.250.000,00", "1.234,56 USD", "12.500 £", "CHF 90000", "1,250,000", "999 €", "abc", None]


@q("""SELECT doc_id, [NULL, NULL, 250000, 250000, 1250000, 1234.56, 12500, 90000, 1250000, NULL, NULL, NULL][doc_id % 12 + 1]::DOUBLE AS amount,
 [NULL, NULL, 'JPY', 'EUR', 'BRL', 'USD', 'GBP', 'EUR', 'EUR', NULL, NULL, NULL][doc_id % 12 + 1] AS currency, [true, true, false, false, false, false, false, false, false, false, false, false][doc_id % 12 + 1] AS on_request FROM documents""")
def c2_currencies(spark, d):
    p = _pick(_PRICES)
    return table(spark, d, "documents").select("doc_id", C.price_amount(p).cast("double").alias("amount"), C.currency(p).alias("currency"), C.on_request(p).alias("on_request"))


@q(f"SELECT doc_id, {_sql(['3', '12', None, '0', None])}::INTEGER AS n FROM documents")
def c4_first_int(spark, d):
    return table(spark, d, "documents").select("doc_id", C.first_int(_pick(["T3", "12 quartos, 4 wc", "none", "0", None])).alias("n"))


_TIMES = ["2024-05-01", "2024-05-01T10:00:00", "2024-05-01T10:00:00.25", "31/12/2023", "01-02-2023", "2023/4/5", "12.05.2023", "05/31/2023", "soon", None]


@q("""SELECT doc_id, strftime(CAST([DATE '2024-05-01', TIMESTAMP '2024-05-01 10:00:00', TIMESTAMP '2024-05-01 10:00:00.25', DATE '2023-12-31', DATE '2023-02-01', DATE '2023-04-05', NULL, NULL, NULL, NULL][doc_id % 10 + 1] AS TIMESTAMP), '%Y-%m-%d %H:%M:%S') AS at FROM documents""")
def c7_times(spark, d):
    return table(spark, d, "documents").select("doc_id", F.date_format(C.parse_time(_pick(_TIMES)), "yyyy-MM-dd HH:mm:ss").alias("at"))


_PLACES = ["Rua  das Flores 3", "Casa. Com vista", "Esta casa é boa", "moradia com jardim", "Onde: Lisboa", "Foi vendida", "Lisboa foi ontem", "", None, "x" * 101]


@q(f"SELECT doc_id, {_sql(['Rua das Flores 3', None, None, None, None, 'Foi vendida', None, None, None, None])} AS address FROM documents")
def c11_address(spark, d):
    return table(spark, d, "documents").select("doc_id", C.address_or_null(_pick(_PLACES)).alias("address"))


@q(f"SELECT doc_id, {_sql(['rent', 'rent', 'sale', 'sale', 'rent', 'sale', 'rent'])} AS kind FROM documents")
def c21_business_type(spark, d):
    kind, url = _pick(["Arrendamento", "for rent", "Venda", None, None, None, "Aluguer"]), _pick([None, "/x", "/current/1", "/rent/1", "https://x.test/Arrendamento/9", "/arrendamento/1", None])
    return table(spark, d, "documents").select("doc_id", C.business_type(kind, url).alias("kind"))


@q("SELECT doc_id, [true, true, true, true, NULL, NULL, NULL][doc_id % 7 + 1] AS fresh FROM documents")
def c22_is_new(spark, d):
    return table(spark, d, "documents").select("doc_id", C.is_new(_pick(["Novo", "as NEW", "Em construção", "em planta", "usado", "", None])).alias("fresh"))


@q("SELECT doc_id, concat_ws(',', CASE WHEN lang <> '' THEN 'lang' END, CASE WHEN source <> '' THEN 'source' END) AS names FROM documents")
def c23_drop_empty(spark, d):
    kept = C.drop_empty({"lang": F.col("lang"), "blank": F.lit(""), "source": F.col("source"), "none": F.lit(None).cast("string")})
    return table(spark, d, "documents").select("doc_id", F.array_join(F.map_keys(kept), ",").alias("names"))


@q("""SELECT id FROM listings_v l WHERE (title ILIKE '%urgent%' OR district ILIKE '%urgent%' OR county ILIKE '%urgent%' OR source_partner ILIKE '%urgent%') AND is_enriched
AND NOT EXISTS (SELECT 1 FROM ledger_v g WHERE g.listing_id = l.id AND g.status IN ('published', 'updated'))""")
def d5_search(spark, d):
    return query.search(view(spark, d, "listings_v"), view(spark, d, "ledger_v"), q=" Urgent ", is_exported=False, is_enriched=True).select("id")


@q("SELECT id, title FROM listings_v WHERE source_url = 'https://ex.test/p/33' UNION ALL SELECT job_id, status FROM jobs_v WHERE status = 'running' AND site_key = 'building'")
def d6_lookup(spark, d):
    jobs = query.lookup(view(spark, d, "jobs_v"), status="running", site_key="building").select(F.col("job_id").alias("id"), F.col("status").alias("title"))
    return query.lookup(view(spark, d, "listings_v"), source_url="https://ex.test/p/33").select("id", "title").unionByName(jobs)


@q("SELECT id, title FROM listings_v WHERE id IN (SELECT listing_id FROM ledger_v WHERE status = 'failed')")
def d7_by_ids(spark, d):
    ids = view(spark, d, "ledger_v").where("status = 'failed'").select(F.col("listing_id").alias("id"))
    return query.by_ids(view(spark, d, "listings_v"), ids.unionByName(ids)).select("id", "title")


@q(f"""SELECT job_id, CASE WHEN status = 'running' AND (beat IS NULL OR beat < TIMESTAMP '{NOW} 00:00:00' - INTERVAL 120 SECOND) THEN 'failed' ELSE status END AS status
FROM (SELECT *, CASE WHEN job_id % 4 > 0 THEN TIMESTAMP '{NOW} 00:00:00' - INTERVAL (job_id % 240) SECOND END AS beat FROM jobs_v) x""")
def d9_stale_jobs(spark, d):
    now = F.lit(f"{NOW} 00:00:00").cast("timestamp_ntz")
    jobs = view(spark, d, "jobs_v").withColumn("beat", F.when(F.col("job_id") % 4 > 0, now - F.make_interval(secs=F.col("job_id") % 240)))
    return query.stale_jobs(jobs, "beat", now).select("job_id", "status")


@q("""SELECT id, CAST(count(*) OVER () AS BIGINT) AS total_count FROM listings_v ORDER BY updated_at DESC NULLS FIRST, id LIMIT 20 OFFSET 40""")
def f2_page_total(spark, d):
    return query.page_rows(view(spark, d, "listings_v"), [F.col("updated_at").desc_nulls_first(), F.col("id")], 3, 20).select("id", "total_count")


@q("SELECT job_id, status, created_at FROM jobs_v ORDER BY created_at DESC NULLS FIRST, job_id LIMIT 50")
def s4_recent(spark, d):
    return query.recent(view(spark, d, "jobs_v"), "created_at", "job_id").limit(50).select("job_id", "status", "created_at")


_FIELDS = """SELECT scrape_job_id, 'price' AS field, price_amount IS NOT NULL AS ok FROM listings_v UNION ALL SELECT scrape_job_id, 'title', coalesce(trim(title), '') <> '' FROM listings_v
 UNION ALL SELECT scrape_job_id, 'area', area_useful_m2 IS NOT NULL FROM listings_v UNION ALL SELECT scrape_job_id, 'rooms', bedrooms IS NOT NULL FROM listings_v
 UNION ALL SELECT scrape_job_id, 'location', true FROM listings_v UNION ALL SELECT scrape_job_id, 'images', false FROM listings_v UNION ALL SELECT scrape_job_id, 'property_type', false FROM listings_v
 UNION ALL SELECT scrape_job_id, 'typology', true FROM listings_v UNION ALL SELECT scrape_job_id, 'condition', false FROM listings_v UNION ALL SELECT scrape_job_id, 'business_type', true FROM listings_v
 UNION ALL SELECT scrape_job_id, 'land_area', false FROM listings_v"""
_SCORES = f"SELECT scrape_job_id AS job_id, field, round_even(avg(CASE WHEN ok THEN 1.0::DOUBLE ELSE 0.0 END), 2) AS score FROM ({_FIELDS}) x GROUP BY 1, 2"


def _scores(spark, d):
    listings = view(spark, d, "listings_v")
    return stats.confidence(listings, "scrape_job_id", stats.field_rules(listings.columns)).withColumnRenamed("scrape_job_id", "job_id")


@q(_SCORES)
def g8_field_rules(spark, d):
    return _scores(spark, d)


@q(f"""SELECT s.key, j.job_id, CAST(j.listings_found AS BIGINT) AS samples, p.score AS price FROM sites_v s LEFT JOIN (SELECT site_key, arg_max(job_id, (created_at, job_id)) AS job_id, arg_max(listings_found, (created_at, job_id)) AS listings_found
 FROM (SELECT site_key, job_id % 40 AS job_id, listings_found, created_at FROM jobs_v) k GROUP BY 1) j ON j.site_key = s.key LEFT JOIN ({_SCORES}) p ON p.job_id = j.job_id AND p.field = 'price'""")
def g10_site_confidence(spark, d):
    """Of jobs of one number and day the first stands for all, as in the order of the table."""
    jobs = view(spark, d, "jobs_v").groupBy("site_key", (F.col("job_id") % 40).alias("number"), F.col("created_at").alias("at"))
    jobs = jobs.agg(F.min_by(F.col("listings_found").cast("long"), "job_id").alias("samples")).withColumnRenamed("number", "job_id")
    out = stats.site_confidence(_scores(spark, d), view(spark, d, "sites_v"), jobs)
    return out.select("key", "meta.job_id", "meta.samples", F.try_element_at("confidence", F.lit("price")).alias("price"))


@q("""SELECT j.job_id, CASE WHEN total = 0 THEN 100.0 ELSE round_even((done + failed) * 100.0::DOUBLE / total, 1) END AS percent, e.errors FROM
(SELECT job_id, count(*) FILTER (kind = 'scraped') AS done, count(*) FILTER (kind = 'error') AS failed, count(*) FILTER (kind <> 'page') AS total FROM events_v GROUP BY 1) j
LEFT JOIN (SELECT job_id, string_agg(CAST(event_id AS VARCHAR), ',' ORDER BY event_id) AS errors FROM (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY event_id DESC) AS n FROM events_v WHERE kind = 'error') x WHERE n <= 20 GROUP BY 1) e ON e.job_id = j.job_id""")
def g12_progress(spark, d):
    events = view(spark, d, "events_v")
    n = lambda test: F.count_if(test)
    jobs = events.groupBy("job_id").agg(n(F.col("kind") == "scraped").alias("done"), n(F.col("kind") == "error").alias("failed"), F.lit(0).alias("skipped"), n(F.col("kind") != "page").alias("total"))
    errors = events.where("kind = 'error'").select("job_id", F.col("event_id").alias("seq"), F.col("event_id").cast("string").alias("error"))
    return stats.progress(jobs, errors).select("job_id", "percent", F.array_join("errors", ",").alias("errors"))
