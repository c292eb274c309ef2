"""All registered queries of the listing engine and the SQL that gives the same rows."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from listmill.functions import columns as C
from listmill.operators import extract, merge, query, stats, textindex
from listmill.sources import tables
from listmill.sources.bindings import table, view, with_views
from listmill.sources.tables import written
from listmill.streaming import jobs as streams
from listmill.streaming import store

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

NOW = "2001-08-01"
KINDS = ["page", "found", "scraped", "error", "new"]
FIELDS = ["title", "price_amount"]
TYPES = ["URGENT", "HIGH", "MEDIUM", "LOW"]
STOP = ["der", "die", "the", "and", "of", "de", "la"]
GROUPS = [(["the", "der"], 30), (["and", "und", "et"], 30), (["garage", "ation", "keit"], 60)]


def q(sql: str | None = None):
    """Registers a query under its function's name."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = with_views(sql)
        return f

    return add


# --- statistics ---------------------------------------------------------------------------------------------------


@q(f"""SELECT s.key, s.name, coalesce(p.total, 0) AS total, coalesce(p.updated_7d, 0) AS updated_7d, p.avg_price, p.min_price, p.max_price,
 coalesce(p.enriched, 0) AS enriched, p.last_update, j.job_id AS last_job, j.status AS last_status, j.listings_scraped AS last_scraped
FROM sites_v s LEFT JOIN (SELECT source_partner, count(*) AS total, count(*) FILTER (updated_at >= DATE '{NOW}' - 7) AS updated_7d,
  round(avg(CAST(price_amount AS DOUBLE)), 2) AS avg_price, round(min(CAST(price_amount AS DOUBLE)), 2) AS min_price, round(max(CAST(price_amount AS DOUBLE)), 2) AS max_price,
  count(*) FILTER (is_enriched) AS enriched, CAST(max(updated_at) AS VARCHAR) AS last_update FROM listings_v GROUP BY 1) p ON s.key = p.source_partner
LEFT JOIN (SELECT * FROM jobs_v QUALIFY row_number() OVER (PARTITION BY site_key ORDER BY created_at DESC, job_id DESC) = 1) j ON s.key = j.site_key""")
def g4_partner_stats(spark, d):
    return stats.partner_stats(view(spark, d, "sites_v"), view(spark, d, "listings_v"), view(spark, d, "jobs_v"), F.lit(NOW).cast("date"))


@q("""SELECT count(*) AS total, round(avg(CAST(price_amount AS DOUBLE)), 2) AS avg_price, round(min(CAST(price_amount AS DOUBLE)), 2) AS min_price,
 round(max(CAST(price_amount AS DOUBLE)), 2) AS max_price, round(avg(area_useful_m2), 4) AS avg_area FROM listings_v""")
def g1_listing_stats(spark, d):
    return stats.listing_stats(view(spark, d, "listings_v"))


@q("""SELECT * FROM (SELECT 'district' AS dimension, district AS value, count(*) AS n FROM listings_v GROUP BY 2 UNION ALL SELECT 'property_type', property_type, count(*) FROM listings_v GROUP BY 2
UNION ALL SELECT 'source_partner', source_partner, count(*) FROM listings_v GROUP BY 2 UNION ALL SELECT 'typology', typology, count(*) FROM listings_v GROUP BY 2) x
WHERE value IS NOT NULL OR dimension = 'source_partner'""")
def g2_breakdowns(spark, d):
    return stats.breakdowns(view(spark, d, "listings_v"), ["district", "property_type", "source_partner", "typology"], ["source_partner"])


@q("SELECT count(*) AS n FROM listings_v WHERE district ILIKE '%asia%' AND CAST(price_amount AS DOUBLE) >= 50000")
def g3_count_where(spark, d):
    return query.apply_filters(view(spark, d, "listings_v"), district="asia", price_min=50000).agg(F.count("*").alias("n"))


@q(f"""SELECT CAST(k AS INTEGER) AS week, count(*) FILTER (created_at BETWEEN DATE '{NOW}' - CAST(7 * k + 7 AS INTEGER) AND DATE '{NOW}' - CAST(7 * k AS INTEGER)) AS captured,
 count(*) FILTER (created_at <= DATE '{NOW}' - CAST(7 * k AS INTEGER)) AS cumulative FROM listings_v, range(6) w(k) GROUP BY k""")
def g5_weekly_stats(spark, d):
    return stats.weekly_stats(view(spark, d, "listings_v"), F.lit(NOW).cast("date"))


@q("SELECT source_url, count(*) AS n FROM listings_v WHERE source_url IS NOT NULL GROUP BY 1 HAVING count(*) > 1")
def g6_duplicates(spark, d):
    return stats.duplicates(view(spark, d, "listings_v"))


@q("""SELECT source_partner, count(*) AS total, count(*) FILTER (is_enriched) AS enriched, count(*) - count(*) FILTER (is_enriched) AS missing,
 round_even(count(*) FILTER (is_enriched) * 100.0::DOUBLE / count(*), 2) AS percent FROM listings_v GROUP BY 1""")
def g7_enrichment_stats(spark, d):
    return stats.enrichment_stats(view(spark, d, "listings_v"))


CONFIDENCE_SQL = """SELECT scrape_job_id, field, round_even(avg(CASE WHEN ok THEN 1.0::DOUBLE ELSE 0.0 END), 2) AS score FROM (
 SELECT scrape_job_id, 'price' AS field, coalesce(price_amount > 0, false) AS ok FROM listings_v UNION ALL SELECT scrape_job_id, 'title', title IS NOT NULL FROM listings_v
 UNION ALL SELECT scrape_job_id, 'property_type', property_type IS NOT NULL FROM listings_v UNION ALL SELECT scrape_job_id, 'url', source_url IS NOT NULL FROM listings_v) x GROUP BY 1, 2"""


def _confidence(spark, d):
    rules = {"price": F.col("price_amount") > 0, "title": F.col("title").isNotNull(), "property_type": F.col("property_type").isNotNull(), "url": F.col("source_url").isNotNull()}
    return stats.confidence(view(spark, d, "listings_v"), "scrape_job_id", rules)


@q(CONFIDENCE_SQL)
def g8_confidence(spark, d):
    return _confidence(spark, d)


@q(f"SELECT * FROM (SELECT scrape_job_id, field, score FROM ({CONFIDENCE_SQL}) c) z WHERE score < 0.9")
def g9_low_confidence(spark, d):
    return stats.low_confidence(_confidence(spark, d), 0.9)


@q(f"SELECT scrape_job_id, bool_and(score >= 0.85) AS stable FROM ({CONFIDENCE_SQL}) c GROUP BY 1")
def g16_onboarding_gate(spark, d):
    return stats.onboarding_gate(_confidence(spark, d), "scrape_job_id", 0.85)


@q(f"SELECT scrape_job_id, bool_and(score >= 0.5) AND scrape_job_id NOT IN (SELECT scrape_job_id FROM listings_v WHERE property_type IS NULL AND typology = 'T1') AS stable FROM ({CONFIDENCE_SQL}) c GROUP BY 1")
def g16_gate_with_warnings(spark, d):
    """Jobs with a warning of a missing critical field are not stable, whatever their scores."""
    warned = view(spark, d, "listings_v").where("property_type IS NULL AND typology = 'T1'").select("scrape_job_id")
    return stats.onboarding_gate(_confidence(spark, d), "scrape_job_id", 0.5, warned)


@q("""SELECT count(*) AS total, count(*) FILTER (status IN ('published', 'updated')) AS done, count(*) FILTER (status = 'failed') AS failed, count(*) FILTER (status = 'pending') AS skipped,
 count(*) FILTER (status = 'published') AS created, count(*) FILTER (status = 'updated') AS updated, CASE WHEN count(*) FILTER (status IN ('published', 'updated')) = 0 AND count(*) FILTER (status = 'failed') > 0 THEN 'failed' ELSE 'completed' END AS status FROM ledger_v""")
def g11_batch_summary(spark, d):
    results = view(spark, d, "ledger_v")
    return stats.batch_summary(results.withColumn("action", F.when(F.col("status") == "published", "created").when(F.col("status") == "updated", "updated")))


@q("SELECT job_id, " + ", ".join(f"count(*) FILTER (kind = '{k}') AS n_{k}" for k in KINDS) + " FROM events_v GROUP BY 1")
def g13_job_counters(spark, d):
    return stats.job_counters(view(spark, d, "events_v"), KINDS)


@q("""SELECT job_id, success, CASE WHEN ended IS NULL THEN '\u2014' ELSE t END AS duration, CASE WHEN ended IS NULL THEN t END AS elapsed FROM (SELECT *, CASE WHEN n >= 3600 THEN concat(n // 3600, 'h ', n // 60 % 60, 'm ', n % 60, 's') WHEN n >= 60 THEN concat(n // 60, 'm ', n % 60, 's') ELSE concat(n, 's') END AS t
FROM (SELECT job_id, CASE WHEN listings_found > 0 THEN CAST(floor(listings_scraped * 100 / listings_found) AS INTEGER) ELSE 0 END AS success, CASE WHEN status <> 'running' THEN 1 END AS ended, CASE WHEN status = 'running' THEN 90061 ELSE job_id * 7 % 10000 END AS n FROM jobs_v) j) x""")
def c39_job_report(spark, d):
    """Jobs last so many seconds by their id; running ones began a day, an hour, a minute and a second ago."""
    now = F.lit(NOW).cast("timestamp")
    began = F.when(F.col("status") == "running", F.expr(f"TIMESTAMP '{NOW}' - INTERVAL 90061 SECOND")).otherwise(F.timestamp_seconds(F.lit(1_000_000_000)))
    ended = F.when(F.col("status") != "running", F.timestamp_seconds(F.lit(1_000_000_000) + F.col("job_id") * 7 % 10000))
    return stats.job_report(view(spark, d, "jobs_v").withColumns({"started_at": began, "finished_at": ended}), now).select("job_id", "success", "duration", "elapsed")


# --- read path ----------------------------------------------------------------------------------------------------

SMALL = "id, source_partner, typology, CAST(price_amount AS DOUBLE) AS price"


def _small(df):
    return df.select("id", "source_partner", "typology", F.col("price_amount").cast("double").alias("price"))


@q(f"SELECT {SMALL} FROM listings_v WHERE county ILIKE '%nation_1%' AND typology = 'T3' AND price_amount >= 20000 AND price_amount <= 90000 AND is_enriched")
def d1_filters(spark, d):
    return _small(query.apply_filters(view(spark, d, "listings_v"), county="nation_1", typology="T3", price_min=20000, price_max=90000, is_enriched=True))


@q(f"SELECT {SMALL} FROM listings_v WHERE id % 3 = 1 AND area_useful_m2 BETWEEN 30 AND 90 AND bedrooms BETWEEN 1 AND 4 AND created_at >= DATE '1995-01-01' AND business_type = 'sale'")
def d2_null_translations(spark, d):
    """Not enriched are rows whose translations are null; with ranges of area, bedrooms and time."""
    rows = view(spark, d, "listings_v").withColumn(query.ENRICHED, F.when(F.col("id") % 3 != 1, F.create_map(F.lit("en"), F.lit("x"))))
    return _small(query.apply_filters(rows, is_enriched=False, area_min=30, area_max=90, bedrooms_min=1, bedrooms_max=4, created_min="1995-01-01", business_type="sale"))


@q(f"SELECT {SMALL} FROM listings_v WHERE coalesce(title ILIKE '%urgent%', false) OR coalesce(county ILIKE '%urgent%', false)")
def d4_ilike_search(spark, d):
    return _small(query.ilike_any(view(spark, d, "listings_v"), " urgent ", ["title", "county"]))


@q(f"SELECT {SMALL} FROM listings_v l WHERE EXISTS (SELECT 1 FROM ledger_v g WHERE g.listing_id = l.id AND g.status IN ('published', 'updated'))")
def j1_exported(spark, d):
    return _small(query.exported(view(spark, d, "listings_v"), view(spark, d, "ledger_v")))


@q(f"SELECT {SMALL} FROM listings_v l WHERE NOT EXISTS (SELECT 1 FROM ledger_v g WHERE g.listing_id = l.id AND g.status IN ('published', 'updated'))")
def j2_not_exported(spark, d):
    return _small(query.not_exported(view(spark, d, "listings_v"), view(spark, d, "ledger_v")))


@q("SELECT s.key AS site_key FROM sites_v s WHERE NOT EXISTS (SELECT 1 FROM jobs_v j WHERE j.site_key = s.key AND j.status IN ('pending', 'running'))")
def d8_admission(spark, d):
    return query.admit(view(spark, d, "sites_v").select(F.col("key").alias("site_key")), view(spark, d, "jobs_v"))


@q("SELECT j.job_id, j.site_key, CASE WHEN s.is_active IS NULL THEN 'not_found' WHEN NOT s.is_active THEN 'inactive' ELSE 'ok' END AS checked FROM jobs_v j LEFT JOIN sites_v s ON s.key = j.site_key")
def j8_valid_jobs(spark, d):
    return query.valid_jobs(view(spark, d, "jobs_v").select("job_id", "site_key"), view(spark, d, "sites_v")).select("job_id", "site_key", "checked")


@q("""SELECT l.id, m.thumbnail FROM listings_v l LEFT JOIN (SELECT listing_id, url AS thumbnail FROM media_v
 QUALIFY row_number() OVER (PARTITION BY listing_id ORDER BY coalesce(position, 999), url) = 1) m ON m.listing_id = l.id""")
def j5_thumbnails(spark, d):
    return query.thumbnails(view(spark, d, "listings_v").select("id"), view(spark, d, "media_v"))


@q("""SELECT l.id, coalesce(m.n, 0) AS n_media, coalesce(p.n, 0) AS n_prices FROM listings_v l LEFT JOIN (SELECT listing_id, count(*) AS n FROM media_v GROUP BY 1) m ON m.listing_id = l.id
LEFT JOIN (SELECT listing_id, count(*) AS n FROM prices_v GROUP BY 1) p ON p.listing_id = l.id""")
def j4_listing_detail(spark, d):
    out = query.listing_detail(view(spark, d, "listings_v").select("id"), view(spark, d, "media_v"), view(spark, d, "prices_v"))
    return out.select("id", F.coalesce(F.size("media"), F.lit(0)).cast("long").alias("n_media"), F.coalesce(F.size("history"), F.lit(0)).cast("long").alias("n_prices"))


@q("""SELECT id, CAST(price_amount AS DOUBLE) AS price, row_number() OVER (ORDER BY price_amount DESC NULLS FIRST, id) AS pos FROM listings_v
ORDER BY price_amount DESC NULLS FIRST, id LIMIT 20 OFFSET 40""")
def s2_page(spark, d):
    """Third page of 20 by price; the position is counted on the page alone."""
    rows, facts = query.page(query.sort_by(view(spark, d, "listings_v"), "price_amount"), 3, 20)
    w = Window.orderBy(F.col("price_amount").desc_nulls_first(), "id")
    return rows.withColumn("pos", (F.row_number().over(w) + (facts["page"] - 1) * facts["size"]).cast("long")).select("id", F.col("price_amount").cast("double").alias("price"), "pos")


@q("SELECT id FROM listings_v WHERE NOT is_enriched ORDER BY created_at, id LIMIT 50")
def s3_work_queue(spark, d):
    return query.work_queue(view(spark, d, "listings_v").where("NOT is_enriched"), 50).select("id")


@q("SELECT site_key, job_id, status FROM jobs_v QUALIFY row_number() OVER (PARTITION BY site_key ORDER BY created_at DESC, job_id DESC) = 1")
def f1_latest_jobs(spark, d):
    return query.latest(view(spark, d, "jobs_v"), "site_key", [F.desc("created_at"), F.desc("job_id")]).select("site_key", "job_id", "status")


@q("SELECT * FROM (SELECT job_id, kind, event_id, CAST(row_number() OVER (PARTITION BY job_id, kind ORDER BY ts, event_id) AS INTEGER) AS rank FROM events_v) x WHERE rank <= 5")
def f3_capped_log(spark, d):
    return query.cap_per_bucket(view(spark, d, "events_v"), ["job_id", "kind"], ["ts", "event_id"], 5).select("job_id", "kind", "event_id", "rank")


@q("SELECT job_id, event_id, kind FROM (SELECT *, lag(kind) OVER (PARTITION BY job_id ORDER BY ts, event_id) AS b FROM events_v) x WHERE b IS NULL OR b <> kind")
def f4_change_feed(spark, d):
    return query.change_feed(view(spark, d, "events_v"), "job_id", ["ts", "event_id"], ["kind"]).select("job_id", "event_id", "kind")


@q("""SELECT listing_id, seq, CAST(previous AS DOUBLE) AS previous, CAST(price_amount AS DOUBLE) AS price FROM (SELECT *, lag(price_amount) OVER (PARTITION BY listing_id ORDER BY recorded_at, seq) AS previous FROM prices_v) x
WHERE previous IS NOT NULL AND previous <> price_amount""")
def f5_price_changes(spark, d):
    return query.price_changes(view(spark, d, "prices_v")).select("listing_id", "seq", F.col("previous").cast("double").alias("previous"), F.col("price_amount").cast("double").alias("price"))


# --- normalisation ------------------------------------------------------------------------------------------------

@q("""SELECT id, price LIKE '%consulta%' AS on_request, CASE id % 6 WHEN 0 THEN v WHEN 2 THEN v WHEN 3 THEN v + 0.5 END AS amount, CASE WHEN v IS NULL THEN NULL WHEN id % 6 = 2 THEN 'USD' ELSE 'EUR' END AS currency
FROM (SELECT id, price, CASE WHEN w >= CASE WHEN id % 6 = 3 THEN 999.5 ELSE 1000 END AND id % 6 IN (0, 2, 3) THEN w END AS v FROM
 (SELECT id, price, CAST(nullif(regexp_replace(replace(price, ',50 EUR', ''), '[^0-9]', '', 'g'), '') AS DOUBLE) AS w FROM raw_v) a) b""")
def c1_price(spark, d):
    p = F.col("price")
    return view(spark, d, "raw_v").select("id", F.when(p.isNotNull(), C.on_request(p)).alias("on_request"), C.price_amount(p).cast("double").alias("amount"), C.currency(p).alias("currency"))


@q("""SELECT id, CASE id % 5 WHEN 0 THEN CAST(20 + id % 180 AS DOUBLE) WHEN 1 THEN 20.5 + id % 180 WHEN 2 THEN 2408.0 END AS area,
 CASE id % 7 WHEN 0 THEN true WHEN 1 THEN false WHEN 2 THEN true WHEN 3 THEN false END AS garage, CAST(substr(typology, 2) AS INTEGER) AS bedrooms FROM raw_v""")
def c3_area_bool_rooms(spark, d):
    return view(spark, d, "raw_v").select("id", C.area(F.col("area")).alias("area"), C.tri_bool(F.col("garage")).alias("garage"), C.bedrooms(F.col("typology")).alias("bedrooms"))


@q("""SELECT id, (k + CASE WHEN 2 * r > a OR (2 * r = a AND k % 2 = 1) THEN 1 ELSE 0 END) / 100.0::DOUBLE AS ppm
FROM (SELECT id, a, p // a AS k, p % a AS r FROM (SELECT id, CAST(area_useful_m2 AS BIGINT) AS a, CAST(price_amount * 100 AS BIGINT) AS p FROM listings_v) x) y""")
def c9_price_per_m2(spark, d):
    return view(spark, d, "listings_v").select("id", C.price_per_m2(F.col("price_amount"), F.lit(None).cast("double"), F.col("area_useful_m2")).alias("ppm"))


@q("""SELECT id, regexp_extract(title, '\\b([TV][0-9]+)\\b', 1) AS typology, CASE WHEN title ILIKE '%urgent%' THEN 'URGENT' WHEN title ILIKE '%high%' THEN 'HIGH' WHEN title ILIKE '%medium%' THEN 'MEDIUM' WHEN title ILIKE '%low%' THEN 'LOW' END AS kind FROM listings_v""")
def c18_title_types(spark, d):
    return view(spark, d, "listings_v").select("id", C.typology_from_title(F.col("title")).alias("typology"), C.type_from_list(F.col("title"), TYPES).alias("kind"))


@q("SELECT id, CASE WHEN title ILIKE '1%' THEN '1' WHEN title ILIKE '2-h%' THEN '2-H' WHEN title ILIKE '3%' THEN '3-' END AS kind FROM listings_v")
def c19_title_begins(spark, d):
    return view(spark, d, "listings_v").select("id", C.type_from_list(F.concat(F.lit("  "), "title"), ["1", "2-H", "igh", "3-"], begins=True).alias("kind"))


_LABELLED = "concat(['Descrição - ', 'DESCRIPTION:', 'description', ''][doc_id % 4 + 1], regexp_replace(trim(regexp_replace(text, '\\s+', ' ', 'g')), '^', [' ', ''][doc_id % 2 + 1]))"


@q(f"""SELECT doc_id, nullif(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(trim({_LABELLED}), '^(?i)(descriç[aã]o|description)\\s*[:\\-]?\\s*', ''), '\\s+([,.;:!?])', '\\1', 'g'), '([.!?;:])(\\S)', '\\1 \\2', 'g'), '\\s+', ' ', 'g')), '') AS clean FROM documents""")
def c10_description(spark, d):
    """Whole texts behind labels with a dash, a colon and neither."""
    label = F.element_at(F.array(*map(F.lit, ["Descrição - ", "DESCRIPTION:", "description", ""])), (F.col("doc_id") % 4 + 1).cast("int"))
    text = F.concat(label, F.when(F.col("doc_id") % 2 == 0, " ").otherwise(""), F.trim(F.regexp_replace("text", r"\s+", " ")))
    return table(spark, d, "documents").select("doc_id", C.clean_description(text).alias("clean"))


@q("SELECT doc_id, nullif(trim(regexp_replace(replace(text, chr(160), ' '), '\\s+', ' ', 'g')), '') AS clean FROM documents")
def c6_clean_text(spark, d):
    return table(spark, d, "documents").select("doc_id", C.clean_text(F.col("text")).alias("clean"))


@q(f"""SELECT doc_id, CAST(greatest(0, least(100, {" + ".join("CASE WHEN " + " OR ".join(f"contains(lower(text), '{w}')" for w in ws) + f" THEN {k} ELSE 0 END" for ws, k in GROUPS)}
 - CASE WHEN length(text) < 100 THEN 20 ELSE 0 END)) AS INTEGER) AS score FROM documents""")
def c28_quality_score(spark, d):
    return table(spark, d, "documents").select("doc_id", C.quality_score(F.col("text"), GROUPS).alias("score"))


#: A configuration row of descriptions: keywords of each group, weights, penalties, lengths, and the least score of each grade.
QUALITY = {
    "keywords": {"location": ["the", "der"], "rooms": ["and", "und"], "condition": ["ation"], "amenity": ["keit", "aux"], "area": ["ing", "ung"], "marketing": ["ment"]}, "weights": {"location": 15, "rooms": 10, "condition": 10, "amenity": 10, "area": 10, "length_bonus": 5, "marketing_penalty": -5},
    "penalties": {"short_description": -20, "no_location": -15, "no_area": -10, "all_caps": -10, "contact_info": -5}, "short_length": 100, "good_length": 300, "base": 40, "grades": {"A+": 90, "A": 80, "B": 70, "C": 60, "D": 50, "E": 30, "F": 0},
}


def _graded_sql() -> str:
    hit = lambda g: "(" + " OR ".join(f"contains(lower(text), '{w}')" for w in QUALITY["keywords"][g]) + ")"
    plus = " + ".join(f"CASE WHEN {hit(g)} THEN {QUALITY['weights'][g]} ELSE 0 END" for g in ("location", "rooms", "condition", "amenity", "area"))
    bad = {"short_description": "length(text) < 100", "no_location": f"NOT {hit('location')}", "no_area": f"NOT {hit('area')}", "all_caps": "regexp_matches(text, '\\p{Lu}') AND NOT regexp_matches(text, '\\p{Ll}')", "contact_info": "regexp_matches(text, '[\\w.+-]+@[\\w-]+\\.\\w|\\+?\\d[\\d ]{7,}\\d')"}
    minus = " + ".join(f"CASE WHEN {bad[k]} THEN {v} ELSE 0 END" for k, v in QUALITY["penalties"].items())
    score = f"CAST(greatest(0, least(100, 40 + {plus} + CASE WHEN length(text) >= 300 THEN 5 ELSE 0 END + CASE WHEN {hit('marketing')} THEN -5 ELSE 0 END + {minus})) AS INTEGER)"
    return f"SELECT doc_id, score, CASE WHEN score >= 90 THEN 'A+' WHEN score >= 80 THEN 'A' WHEN score >= 70 THEN 'B' WHEN score >= 60 THEN 'C' WHEN score >= 50 THEN 'D' WHEN score >= 30 THEN 'E' ELSE 'F' END AS grade FROM (SELECT doc_id, {score} AS score FROM documents) x"


@q(_graded_sql())
def c28_graded_quality(spark, d):
    return table(spark, d, "documents").select("doc_id", C.graded_quality(F.col("text"), QUALITY).alias("q")).select("doc_id", "q.*")


_FOLD = f"translate(text, '{C.ACCENTS[0]}', '{C.ACCENTS[1]}')"


@q(f"""SELECT doc_id, CAST(len(list_filter(list_distinct(string_split(trim(regexp_replace(lower({_FOLD}), '[^a-z0-9]+', ' ', 'g')), ' ')), lambda w: w <> '' AND NOT list_contains({STOP}, w))) AS INTEGER) AS n_tokens FROM documents""")
def c41_search_tokens(spark, d):
    return table(spark, d, "documents").select("doc_id", F.size(C.search_tokens(F.col("text"), STOP)).alias("n_tokens"))


@q(f"SELECT doc_id FROM documents WHERE list_contains(string_split(trim(regexp_replace(lower({_FOLD}), '[^a-z0-9]+', ' ', 'g')), ' '), 'with') AND list_contains(string_split(trim(regexp_replace(lower({_FOLD}), '[^a-z0-9]+', ' ', 'g')), ' '), 'was')")
def d3_full_text(spark, d):
    docs = table(spark, d, "documents")
    return query.fts(docs, C.search_tokens(F.col("text"), STOP), ["with", "was"]).select("doc_id")


_TOKENS = f"list_distinct(string_split(trim(regexp_replace(lower({_FOLD}), '[^a-z0-9]+', ' ', 'g')), ' '))"


@q(f"""SELECT doc_id, 'built' AS stage FROM documents WHERE list_contains({_TOKENS}, 'with') AND list_contains({_TOKENS}, 'was')
UNION ALL SELECT doc_id, 'updated' FROM documents WHERE doc_id % 10 <> 3 AND (list_contains({_TOKENS}, 'with') OR doc_id % 10 = 4) AND (list_contains({_TOKENS}, 'was') OR doc_id % 10 = 4)""")
def d3_index_search(spark, d):
    """All documents in an index; then every tenth is removed and every tenth gets both tokens."""
    path = f"{tables.shared_folder(spark)}/search-{uuid.uuid4().hex}"
    rows = table(spark, d, "documents").select(F.col("doc_id").alias("id"), C.search_tokens(F.col("text"), STOP).alias("tokens"))
    textindex.build_index(rows, path)
    built = written(textindex.search_index(spark, path, ["was", "with"]))
    more = rows.where("id % 10 = 4").withColumn("tokens", F.array_union("tokens", F.array(F.lit("was"), F.lit("with"))))
    textindex.update_index(path, rows.where("id % 10 IN (3, 4)"), more)
    updated = textindex.search_index(spark, path, ["was", "with"])
    return built.select(F.col("id").alias("doc_id"), F.lit("built").alias("stage")).unionByName(updated.select(F.col("id").alias("doc_id"), F.lit("updated").alias("stage")))


@q("""SELECT id, CAST(price_amount AS DOUBLE) AS price_amount, CAST(created_at AS VARCHAR) AS created_at, CAST(id AS VARCHAR) AS key FROM listings_v""")
def a7_export_rows(spark, d):
    out = tables.export_rows(view(spark, d, "listings_v").select("id", "price_amount", "created_at"))
    return out.select(F.col("id").cast("long").alias("id"), "price_amount", "created_at", F.col("id").alias("key"))


@q("SELECT key, 'scheduled' AS list FROM sites_v WHERE is_active AND length(key) % 2 = 0 UNION ALL SELECT key, 'all' FROM sites_v")
def a5_scheduled_sites(spark, d):
    sites = view(spark, d, "sites_v").withColumn("schedule_enabled", F.length("key") % 2 == 0)
    lists = {"scheduled": tables.active_sites(sites, scheduled=True), "all": tables.active_sites(sites, include_inactive=True)}
    return lists["scheduled"].select("key", F.lit("scheduled").alias("list")).unionByName(lists["all"].select("key", F.lit("all").alias("list")))


@q("SELECT key, name FROM sites_v WHERE is_active")
def a5_active_sites(spark, d):
    return tables.active_sites(view(spark, d, "sites_v")).select("key", "name")


# --- write path ---------------------------------------------------------------------------------------------------

_WON = "(SELECT * FROM incoming_v QUALIFY row_number() OVER (PARTITION BY source_url ORDER BY ord DESC) = 1)"


@q(f"""SELECT coalesce(c.source_url, i.source_url) AS source_url, c.id, coalesce(i.title, c.title) AS title, CAST(coalesce(i.price_amount, c.price_amount) AS DOUBLE) AS price,
 CASE WHEN c.source_url IS NULL THEN 'new' WHEN i.source_url IS NOT NULL THEN 'updated' ELSE 'kept' END AS state FROM current_v c FULL JOIN {_WON} i ON c.source_url = i.source_url""")
def w1_upsert(spark, d):
    out = merge.upsert(view(spark, d, "current_v"), view(spark, d, "incoming_v"), FIELDS)
    return out.select("source_url", "id", "title", F.col("price_amount").cast("double").alias("price"), "state")


@q(f"""SELECT coalesce(c.source_url, i.source_url) AS source_url, coalesce(i.title, c.title) AS title, CASE WHEN i.ord IS NULL THEN 7 ELSE coalesce(i.ord % 9, 7) END AS scrape_job_id,
 CASE WHEN c.source_url IS NULL THEN '2001-08-01' ELSE '1999-01-01' END AS created_at, CASE WHEN i.source_url IS NULL THEN '1999-01-01' ELSE '2001-08-01' END AS updated_at FROM current_v c FULL JOIN {_WON} i ON c.source_url = i.source_url""")
def w1_upsert_dated(spark, d):
    """Dates and job of the table's rows: those of the batch for what it brings, else as they were."""
    old = F.lit("1999-01-01").cast("date")
    current = view(spark, d, "current_v").withColumns({"created_at": old, "updated_at": old, "scrape_job_id": F.lit(7).cast("long")})
    incoming = view(spark, d, "incoming_v").withColumn("scrape_job_id", F.col("ord") % 9)
    out = merge.upsert_dated(current, incoming, [*FIELDS, "scrape_job_id"], F.lit(NOW).cast("date"))
    return out.select("source_url", "title", "scrape_job_id", F.col("created_at").cast("string").alias("created_at"), F.col("updated_at").cast("string").alias("updated_at"))


@q(f"SELECT c.id, c.source_url, CASE WHEN c.id % 3 > 0 THEN 'EUR' END AS old_currency, CAST(c.price_amount AS DOUBLE) AS old_price, CAST(i.price_amount AS DOUBLE) AS new_price FROM current_v c JOIN {_WON} i ON c.source_url = i.source_url WHERE c.price_amount <> i.price_amount")
def w2_price_history(spark, d):
    current = view(spark, d, "current_v").withColumn("price_currency", F.when(F.col("id") % 3 > 0, "EUR"))
    out = merge.price_history_rows(current, view(spark, d, "incoming_v"))
    return out.select("id", "source_url", "old_currency", F.col("old_price").cast("double").alias("old_price"), F.col("new_price").cast("double").alias("new_price"))


@q("""SELECT listing_id, url, position FROM media_v WHERE listing_id % 5 <> 0 UNION ALL SELECT listing_id, concat(url, '?v=2'), position FROM media_v WHERE listing_id % 5 = 0 AND position = 1""")
def w3_replace_media(spark, d):
    media = view(spark, d, "media_v")
    new = media.where("listing_id % 5 = 0 AND position = 1").select("listing_id", F.concat("url", F.lit("?v=2")).alias("url"), "position")
    touched = media.where("listing_id % 5 = 0").select("listing_id")
    return merge.replace_media(merge.delete(media, touched.select(F.col("listing_id").alias("id")), "listing_id"), new)


@q("""SELECT l.id, (l.source_url IS NOT NULL AND s.source_url IS NULL AND coalesce(g.safe, false)) AS gone FROM listings_v l LEFT JOIN (SELECT DISTINCT source_url FROM listings_v WHERE id % 17 <> 3 AND NOT (source_partner = 'building' AND id % 2 = 0)) s ON l.source_url = s.source_url
LEFT JOIN (SELECT l.source_partner, count(s.source_url) >= 10 AND count(*) FILTER (l.source_url IS NOT NULL AND s.source_url IS NULL) <= 0.3 * count(*) AS safe FROM listings_v l
 LEFT JOIN (SELECT DISTINCT source_url FROM listings_v WHERE id % 17 <> 3 AND NOT (source_partner = 'building' AND id % 2 = 0)) s ON l.source_url = s.source_url GROUP BY 1) g ON g.source_partner = l.source_partner""")
def w4_prune(spark, d):
    rows = view(spark, d, "listings_v")
    seen = rows.where("id % 17 <> 3 AND NOT (source_partner = 'building' AND id % 2 = 0)").select("source_url")
    return merge.prune(rows.select("id", "source_url", "source_partner"), seen).select("id", "gone")


@q("""SELECT i.source_url, i.ord, n = 1 AND NOT EXISTS (SELECT 1 FROM current_v c WHERE c.source_url = i.source_url) AS accepted
FROM (SELECT *, row_number() OVER (PARTITION BY source_url ORDER BY ord) AS n FROM incoming_v) i""")
def w6_insert_unique(spark, d):
    ok, bad = merge.insert_unique(view(spark, d, "current_v"), view(spark, d, "incoming_v").select("source_url", "ord"))
    return ok.withColumn("accepted", F.lit(True)).unionByName(bad.withColumn("accepted", F.lit(False)))


@q("SELECT listing_id, url, position FROM media_v m WHERE NOT EXISTS (SELECT 1 FROM listings_v l WHERE l.id = m.listing_id AND l.typology = 'T0')")
def j10_cascade(spark, d):
    return merge.delete(view(spark, d, "media_v"), view(spark, d, "listings_v").where("typology = 'T0'"), "listing_id")


_RESULTS = "SELECT o_orderkey AS listing_id, CASE WHEN o_orderkey % 3 = 0 THEN 'failed' ELSE 'published' END AS status, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_orderkey + 2000 END AS remote_id, concat('e', CAST(o_orderkey % 5 AS STRING)) AS error FROM {orders} WHERE o_orderpriority < '3'"


@q(f"""SELECT coalesce(g.listing_id, r.listing_id) AS listing_id, g.partner_id, coalesce(r.remote_id, g.remote_id) AS remote_id, coalesce(r.status, g.status) AS status, CASE WHEN r.status = 'failed' THEN r.error END AS last_error
FROM ledger_v g FULL JOIN ({_RESULTS.replace("{orders}", "orders")}) r ON g.listing_id = r.listing_id""")
def w9_upsert_ledger(spark, d):
    return merge.upsert_ledger(view(spark, d, "ledger_v"), spark.sql(_RESULTS, orders=table(spark, d, "orders")))


@q("""SELECT coalesce(g.listing_id, r.listing_id) AS listing_id, coalesce(r.remote_id, g.remote_id) AS remote_id, coalesce(r.status, g.status) AS status, CASE WHEN r.status = 'failed' THEN r.error END AS last_error,
 CASE WHEN r.status = 'published' THEN r.at ELSE CASE WHEN g.listing_id IS NOT NULL THEN '1999-01-01' END END AS last_exported_at FROM ledger_v g FULL JOIN (SELECT l_orderkey AS listing_id, arg_max(CASE WHEN l_linenumber % 2 = 0 THEN 'failed' ELSE 'published' END, l_linenumber) AS status,
 arg_max(CASE WHEN l_linenumber % 2 = 0 THEN -1 ELSE l_orderkey END, l_linenumber) AS x, CASE WHEN max(l_linenumber) % 2 = 1 THEN max(l_orderkey) + max(l_linenumber) END AS remote_id, concat('e', CAST(max(l_linenumber) AS VARCHAR)) AS error, concat('2000-01-0', CAST(max(l_linenumber) AS VARCHAR)) AS at FROM lineitem GROUP BY 1) r ON r.listing_id = g.listing_id""")
def w9_ledger_times(spark, d):
    """Several results of a listing, one for each line of an order, of which the last counts; failures keep the time of before."""
    n = F.col("l_linenumber")
    results = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("listing_id"), F.when(n % 2 == 0, "failed").otherwise("published").alias("status"), F.when(n % 2 == 1, F.col("l_orderkey") + n).alias("remote_id"),
                                                 F.concat(F.lit("e"), n.cast("string")).alias("error"), n.alias("seq"), F.concat(F.lit("2000-01-0"), n.cast("string")).alias("at"))
    ledger = view(spark, d, "ledger_v").withColumn("last_exported_at", F.lit("1999-01-01"))
    return merge.upsert_ledger(ledger, results).drop("partner_id")


@q("SELECT l.id, CASE WHEN g.remote_id IS NULL THEN 'create' ELSE 'update' END AS action FROM listings_v l LEFT JOIN ledger_v g ON g.listing_id = l.id")
def w11_export_action(spark, d):
    return merge.export_action(view(spark, d, "listings_v").select("id"), view(spark, d, "ledger_v")).select("id", "action")


_BOTH = """SELECT coalesce(o.reference, c.reference) AS reference, CASE WHEN c.property_id IS NULL THEN 'only_in_db' WHEN o.remote_id IS NULL THEN 'only_in_crm' ELSE 'in_both' END AS grp, coalesce(o.remote_id <> c.property_id, false) AS mismatch
FROM (SELECT partner_id AS reference, arg_max(remote_id, listing_id) AS remote_id FROM ledger_v GROUP BY 1) o FULL JOIN (SELECT reference, max(property_id) AS property_id FROM crm_v GROUP BY 1) c ON o.reference = c.reference"""


@q(_BOTH)
def j6_reconcile(spark, d):
    return merge.reconcile(view(spark, d, "ledger_v"), view(spark, d, "crm_v")).select("reference", "grp", "mismatch")


@q(f"SELECT grp, count(*) AS n, count(*) FILTER (mismatch) AS mismatches FROM ({_BOTH}) b GROUP BY 1")
def g14_reconcile_summary(spark, d):
    return merge.reconcile(view(spark, d, "ledger_v"), view(spark, d, "crm_v")).groupBy("grp").agg(F.count("*").alias("n"), F.count_if("mismatch").alias("mismatches"))


@q("SELECT id, partner_id FROM listings_v l WHERE NOT EXISTS (SELECT 1 FROM ledger_v g WHERE g.partner_id = l.partner_id)")
def j7_never_exported(spark, d):
    return merge.never_exported(view(spark, d, "listings_v"), view(spark, d, "ledger_v")).select("id", "partner_id")


@q("SELECT l.id, x.locale, CASE WHEN (l.id % 3 = 0) OR (l.id % 3 = 1 AND x.locale <> 'pt') THEN 'generate' ELSE 'cached' END AS action FROM listings_v l, (SELECT unnest(['pt', 'en']) AS locale) x")
def w13_plan_locales(spark, d):
    none = F.create_map().cast("map<string,string>")
    have = F.when(F.col("id") % 3 == 0, none).when(F.col("id") % 3 == 1, F.create_map(F.lit("pt"), F.lit("x"))).otherwise(F.create_map(F.lit("pt"), F.lit("x"), F.lit("en"), F.lit("y")))
    return merge.plan_locales(view(spark, d, "listings_v").withColumn("stored", have), ["pt", "en"], "stored")


# --- extraction ---------------------------------------------------------------------------------------------------

@q("SELECT page_id, nullif(trim(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)), '') AS title FROM pages WHERE html <> ''")
def b23_seo_title(spark, d):
    return tables.read_pages(table(spark, d, "pages"))[0].select("page_id", extract.seo_title().alias("title"))


@q("""SELECT page_id, CAST(len(regexp_extract_all(html, '(?is)<h1[^>]*>(.*?)</h1>', 1)) AS INTEGER) AS n_h1, regexp_extract(html, '(?is)<h1[^>]*>(.*?)</h1>', 1) AS first_h1 FROM pages WHERE regexp_matches(html, '(?is)<h1[^>]*>(.*?)</h1>')""")
def b24_headings(spark, d):
    h = table(spark, d, "pages").select("page_id", "html", F.filter(extract.headings(), lambda x: x["level"] == 1).alias("h"))
    return h.where(F.size("h") > 0).select("page_id", F.size("h").alias("n_h1"), F.regexp_extract("html", "(?is)<h1[^>]*>(.*?)</h1>", 1).alias("first_h1"))


_HREFS = "SELECT page_id, url, unnest(l) AS x, generate_subscripts(l, 1) AS n FROM (SELECT page_id, url, regexp_extract_all(html, '<a[^>]*href=\"([^\"]+)\"', 1) AS l FROM pages) p"
_HREF = "replace(replace(replace(replace(x, '&lt;', '<'), '&gt;', '>'), '&quot;', chr(34)), '&amp;', '&')"
#: Links of each page as SQL: absolute urls, and where each is seen first.
LINKS = f"SELECT page_id, u, min(n) AS n FROM (SELECT page_id, n, CASE WHEN regexp_matches(h, '^[a-z]+:') THEN h WHEN starts_with(h, '//') THEN concat(regexp_extract(url, '^(https?:)', 1), h) ELSE concat(regexp_extract(url, '^(https?://[^/?#]+)', 1), h) END AS u FROM (SELECT page_id, url, n, {_HREF} AS h FROM ({_HREFS}) a) b) c GROUP BY 1, 2"


def requoted(pages: DataFrame) -> DataFrame:
    """Pages of which every other has its links in single quotes, upper-case tags and blanks around the sign."""
    return pages.withColumn("html", F.when(F.col("page_id") % 2 == 1, F.regexp_replace("html", '<a([^>]*) href="([^"\']*)"', "<A$1 href = '$2'")).otherwise(F.col("html")))


@q(f"SELECT page_id, u AS link, CAST(row_number() OVER (PARTITION BY page_id ORDER BY n) AS INTEGER) AS place FROM ({LINKS}) x")
def b31_listing_links(spark, d):
    pages = requoted(table(spark, d, "pages"))
    links = extract.listing_links(extract.page_nodes(pages), pages)
    return links.select("page_id", F.col("url").alias("link"), F.row_number().over(Window.partitionBy("page_id").orderBy("ord")).alias("place"))


@q(f"SELECT page_id, u AS link FROM (SELECT l.page_id, u, length(regexp_extract(p.url, '^https?://([^/?#]+)', 1)) AS k FROM ({LINKS}) l JOIN pages p ON p.page_id = l.page_id) x WHERE k % 3 = 0 OR (k % 3 = 1 AND regexp_matches(u, '/[a-m][^/]*$'))")
def b31_site_links(spark, d):
    """Each host has a selector and a pattern of its own; of a third of them the selector matches nothing."""
    pages = requoted(table(spark, d, "pages")).withColumn("site_key", F.regexp_extract("url", "^https?://([^/?#]+)", 1))
    k = F.length("site_key") % 3
    sites = pages.select("site_key").distinct().select("site_key", F.when(k == 1, "nav a[href], article a, footer a").when(k == 2, "table a").alias("link_selector"), F.when(k == 1, "/[a-m][^/]*$").alias("link_pattern"))
    return extract.site_links(extract.page_nodes(pages), pages, sites).select("page_id", F.col("url").alias("link"))


@q()
def b1_dom_nodes(spark, d):
    return extract.dom_nodes(table(spark, d, "pages")).groupBy("page_id", "tag").agg(F.count("*").alias("n"), F.max("depth").alias("depth"))


# --- streams and their batch twins --------------------------------------------------------------------------------


@q("SELECT strftime(time_bucket(INTERVAL 1 DAY, ts), '%Y-%m-%d') AS day, kind, count(*) AS n FROM events_v GROUP BY 1, 2")
def r1_windowed_counts(spark, d):
    return streams.windowed(view(spark, d, "events_v")).select(F.date_format("start", "yyyy-MM-dd").alias("day"), "kind", "n")


@q("SELECT DISTINCT job_id, kind AS url FROM events_v")
def r6_first_seen(spark, d):
    return streams.first_seen(view(spark, d, "events_v").withColumn("url", F.col("kind"))).select("job_id", "url")


@q(f"""SELECT url AS source_url, arg_max(title, k) FILTER (title IS NOT NULL) AS title, arg_max(page_id, k) AS scrape_job_id, CAST(arg_max(page_id, k) * 10 + 1000 AS DOUBLE) AS price, 'EUR' AS price_currency, regexp_extract(url, '^https?://([^/?#]+)', 1) AS source_partner
FROM (SELECT page_id, url, page_id % 3 * 1000000000 + page_id AS k, nullif(trim(regexp_replace({_HREF}, '\\s+', ' ', 'g')), '') AS title FROM (SELECT page_id, url, regexp_extract(html, '<h1>(.*?)</h1>', 1) AS x FROM pages WHERE url IS NOT NULL) p) q GROUP BY url""")
def r9_ingest_pages(spark, d):
    """All pages in three batches through extraction, normalisation and merge into a table in buckets."""
    path = f"{tables.shared_folder(spark)}/store-{uuid.uuid4().hex}"
    price = F.concat(F.lit("<b class=price>"), F.col("page_id") * 10 + 1000, F.lit(" €</b>"))
    pages = table(spark, d, "pages").select("page_id", "url", F.concat("html", price).alias("html"), F.col("page_id").alias("job_id"))
    for k in range(3):
        store.merge_batch(path, streams.page_listings(pages.where(F.col("page_id") % 3 == k), {"title": "article > h1", "price": "b.price"}), k)
    out = store.read_listings(spark, path)
    return out.select("source_url", "title", "scrape_job_id", F.col("price_amount").cast("double").alias("price"), "price_currency", "source_partner")


#: Folds of a key's rows in order, as recursive SQL: {rows} numbers them, {start} is the state before them, {next} the state after one more.
_FOLD = """SELECT {out} FROM (WITH RECURSIVE e AS ({rows}), s AS (SELECT key, CAST(0 AS BIGINT) AS n, CAST(NULL AS DOUBLE) AS t, CAST(NULL AS BIGINT) AS id, {start} FROM (SELECT DISTINCT key FROM e) k
 UNION ALL SELECT s.key, e.n, e.t, e.id, {next} FROM s JOIN e ON e.key = s.key AND e.n = s.n + 1) SELECT * FROM s) x WHERE {where}"""
_REQUESTS = "SELECT job_id AS key, CAST(floor(epoch(ts)) AS DOUBLE) AS t, event_id AS id, row_number() OVER (PARTITION BY job_id ORDER BY CAST(floor(epoch(ts)) AS DOUBLE), event_id) AS n FROM events_v"
_HELD = "list_filter(s.held, lambda h: h > e.t - 86400)"
_ACTIONS = "SELECT job_id AS key, CAST(NULL AS DOUBLE) AS t, event_id AS id, row_number() OVER (PARTITION BY job_id ORDER BY ts, event_id) AS n, CASE kind WHEN 'new' THEN 'start' WHEN 'error' THEN 'cancel' WHEN 'scraped' THEN 'complete' ELSE 'tick' END AS action, count(*) OVER (PARTITION BY job_id) AS of FROM events_v"


@q(_FOLD.format(out="key, t, id, admitted", where="n > 0", rows=_REQUESTS, start="CAST([] AS DOUBLE[]) AS held, false AS admitted",
    next=f"CASE WHEN len({_HELD}) < 2 THEN list_append({_HELD}, e.t) ELSE {_HELD} END, len({_HELD}) < 2"))
def r3_rate_limit(spark, d):
    e = view(spark, d, "events_v").select(F.col("job_id").alias("key"), F.unix_timestamp("ts").cast("double").alias("t"), F.col("event_id").alias("id"))
    return streams.rate_limit(e, 2, 86400.0)


@q(_FOLD.format(out="key, t, id, hit", where="n > 0", rows=_REQUESTS, start="CAST(NULL AS DOUBLE) AS since, false AS hit",
    next="CASE WHEN e.t - s.since < 86400 THEN s.since ELSE e.t END, coalesce(e.t - s.since < 86400, false)"))
def r4_ttl_reuse(spark, d):
    e = view(spark, d, "events_v").select(F.col("job_id").alias("key"), F.unix_timestamp("ts").cast("double").alias("t"), F.col("event_id").alias("id"))
    return streams.ttl_reuse(e, 86400.0)


@q("""SELECT job_id, event_id, CAST(gap AS BIGINT) AS gap FROM (SELECT *, CAST(floor(epoch(ts)) AS BIGINT) - CAST(floor(epoch(lag(ts) OVER (PARTITION BY job_id ORDER BY ts, event_id))) AS BIGINT) AS gap FROM events_v) x WHERE gap > 86400""")
def r5_heartbeats(spark, d):
    return streams.heartbeats(view(spark, d, "events_v"), 86400).select("job_id", "event_id", "gap")


@q("""SELECT job_id, event_id FROM (SELECT job_id, event_id, ts, lead(ts) OVER (PARTITION BY job_id ORDER BY ts, event_id) AS next, (SELECT max(ts) FROM events_v) - INTERVAL 10 MINUTE AS last FROM events_v) x
 WHERE epoch_ms(coalesce(next, last)) - epoch_ms(ts) > 86400000""")
def r5_stale(spark, d):
    return streams.stale(view(spark, d, "events_v"), 86400).select("job_id", "event_id")


@q(_FOLD.format(out="key AS job_id, state", where="n = of", rows=_ACTIONS, start="'pending' AS state, false AS asked, CAST(-1 AS BIGINT) AS of",
    next="""CASE WHEN s.state = 'pending' AND e.action = 'start' THEN 'running' WHEN s.state = 'pending' AND e.action = 'cancel' THEN 'cancelled'
 WHEN s.state = 'running' AND e.action = 'complete' THEN CASE WHEN s.asked THEN 'cancelled' ELSE 'completed' END WHEN s.state = 'running' AND e.action = 'fail' THEN 'failed' ELSE s.state END,
 s.asked OR (s.state = 'running' AND e.action = 'cancel'), e.of"""))
def r7_lifecycle(spark, d):
    e = view(spark, d, "events_v").select("job_id", "ts", "event_id", F.expr("CASE kind WHEN 'new' THEN 'start' WHEN 'error' THEN 'cancel' WHEN 'scraped' THEN 'complete' ELSE 'tick' END").alias("action"))
    return streams.lifecycle(e)


_NOW = "CASE WHEN s.state IN ('completed', 'failed', 'cancelled') AND e.t - s.t > 3600000 THEN 'pending' ELSE s.state END"
_ASKED = "(s.asked AND NOT (s.state IN ('completed', 'failed', 'cancelled') AND e.t - s.t > 3600000))"


@q(_FOLD.format(out="key AS job_id, state", where="n = of", rows=_ACTIONS.replace("CAST(NULL AS DOUBLE) AS t", "CAST(epoch_ms(ts) AS DOUBLE) AS t"), start="'pending' AS state, false AS asked, CAST(-1 AS BIGINT) AS of",
    next=f"""CASE WHEN {_NOW} = 'pending' AND e.action = 'start' THEN 'running' WHEN {_NOW} = 'pending' AND e.action = 'cancel' THEN 'cancelled'
 WHEN {_NOW} = 'running' AND e.action = 'complete' THEN CASE WHEN {_ASKED} THEN 'cancelled' ELSE 'completed' END WHEN {_NOW} = 'running' AND e.action = 'fail' THEN 'failed' ELSE {_NOW} END,
 {_ASKED} OR ({_NOW} = 'running' AND e.action = 'cancel'), e.of"""))
def r7_forgotten(spark, d):
    """Jobs that have ended are forgotten an hour after their last event; a later one begins anew."""
    e = view(spark, d, "events_v").select("job_id", "ts", "event_id", F.expr("CASE kind WHEN 'new' THEN 'start' WHEN 'error' THEN 'cancel' WHEN 'scraped' THEN 'complete' ELSE 'tick' END").alias("action"))
    return streams.lifecycle(e, streams.KEPT)
