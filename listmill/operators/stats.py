"""Statistics: listing figures, breakdowns, partner dashboard, growth, duplicates, confidence, roll-ups."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .query import latest

#: Share of rows below which a field's extraction counts as unreliable.
LOW = 0.7


def _money(c: Column) -> Column:
    return F.round(c.cast("double"), 2)


def listing_stats(df: DataFrame) -> DataFrame:
    p = F.col("price_amount").cast("double")
    return df.agg(F.count("*").alias("total"), _money(F.avg(p)).alias("avg_price"), _money(F.min(p)).alias("min_price"), _money(F.max(p)).alias("max_price"), F.round(F.avg("area_useful_m2"), 4).alias("avg_area"))


def breakdowns(df: DataFrame, columns: list[str], keep_null: list[str]) -> DataFrame:
    """(dimension, value, n) for each column in one pass over the rows: counts are combined before the shuffle."""
    pairs = F.array(*[F.struct(F.lit(c).alias("dimension"), F.col(c).cast("string").alias("value")) for c in columns])
    out = df.select(F.explode(pairs).alias("p")).groupBy("p.dimension", "p.value").agg(F.count("*").alias("n"))
    return out.where(F.col("value").isNotNull() | F.col("dimension").isin(keep_null))


def partner_stats(sites: DataFrame, listings: DataFrame, jobs: DataFrame, now: Column) -> DataFrame:
    """A row for each site: counts, prices, last update and latest job; listings are grouped before they meet the sites."""
    p = F.col("price_amount").cast("double")
    per = listings.groupBy(F.col("source_partner").alias("key")).agg(
        F.count("*").alias("total"),
        F.count_if(F.col("updated_at") >= F.date_sub(now, 7)).alias("updated_7d"),
        _money(F.avg(p)).alias("avg_price"), _money(F.min(p)).alias("min_price"), _money(F.max(p)).alias("max_price"),
        F.count_if("is_enriched").alias("enriched"), F.max("updated_at").cast("string").alias("last_update"),
    )
    last = latest(jobs, "site_key", [F.col("created_at").desc(), F.col("job_id").desc()])
    last = last.select(F.col("site_key").alias("key"), F.col("job_id").alias("last_job"), F.col("status").alias("last_status"), F.col("listings_scraped").alias("last_scraped"))
    out = sites.select("key", "name").join(per, "key", "left").join(last, "key", "left")
    return out.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("total", "updated_7d", "enriched")})


def weekly_stats(df: DataFrame, now: Column, weeks: int = 6) -> DataFrame:
    """(week, captured, cumulative) for windows that end now - k weeks, closed at both ends; one scan."""
    ends = [F.date_sub(now, 7 * k) for k in range(weeks)]
    found = df.agg(*[x for k, e in enumerate(ends) for x in (F.count_if(F.col("created_at").between(F.date_sub(e, 7), e)).alias(f"a{k}"), F.count_if(F.col("created_at") <= e).alias(f"b{k}"))])
    rows = F.array(*[F.struct(F.lit(k).alias("week"), F.col(f"a{k}").alias("captured"), F.col(f"b{k}").alias("cumulative")) for k in range(weeks)])
    return found.select(F.inline(rows))


def duplicates(df: DataFrame, key: str = "source_url") -> DataFrame:
    return df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("n")).where("n > 1")


def enrichment_stats(df: DataFrame) -> DataFrame:
    out = df.groupBy("source_partner").agg(F.count("*").alias("total"), F.count_if("is_enriched").alias("enriched"))
    share = F.when(F.col("total") > 0, F.bround(F.col("enriched") * 100 / F.col("total"), 2)).otherwise(0.0)
    return out.withColumn("missing", F.col("total") - F.col("enriched")).withColumn("percent", share)


def confidence(df: DataFrame, key: str, rules: dict[str, Column]) -> DataFrame:
    """(key, field, score): share of rows with a valid value for each field."""
    wide = df.groupBy(key).agg(*[F.bround(F.avg(F.when(ok, 1.0).otherwise(0.0)), 2).alias(f) for f, ok in rules.items()])
    rows = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("score")) for f in rules])
    return wide.select(key, F.inline(rows))


# Patterns that a value must hold to count (fixed values).
VALID = {
    "property_type": r"(?i)\b(?:moradia|apartamento|terreno|loja|armaz[eé]m|escrit[oó]rio|garagem|quintinha|quinta|vivenda)\b",
    "typology": r"(?i)\bT\d+(?:\+\d+)?\b",
    "condition": r"(?i)\b(?:usado|novo|renovado|recuperado|excelente|bom\s+estado|em\s+construcao|na\s+planta|para\s+recuperar)\b",
    "business_type": r"(?i)\b(?:venda|comprar|arrendar|arrendamento|sale|rent|buy)\b",
}


def field_rules(columns: list[str]) -> dict[str, Column]:
    """Whether a listing has a value of each scored field; a column that the table lacks counts as null."""
    c = lambda name: F.col(name) if name in columns else F.lit(None).cast("string")
    there = lambda *names: reduce(or_, [c(n).isNotNull() for n in names])
    said = lambda *names: F.coalesce(reduce(or_, [F.coalesce(F.trim(c(n).cast("string")) != "", F.lit(False)) for n in names]), F.lit(False))
    rules = {
        "price": there("price_amount"), "title": said("title"), "area": there("area_useful_m2", "area_gross_m2", "area_land_m2"), "rooms": there("bedrooms", "bathrooms"),
        "location": said("full_address", "district", "county", "parish"), "images": F.size(F.coalesce(c("images") if "images" in columns else F.lit(None).cast("array<string>"), F.array().cast("array<string>"))) > 0,
    }
    rules |= {f: F.coalesce(c(f).rlike(p), F.lit(False)) for f, p in VALID.items()}
    return rules | {"land_area": there("area_land_m2")}


def site_confidence(scores: DataFrame, sites: DataFrame, jobs: DataFrame) -> DataFrame:
    """sites(key) with `confidence` (field -> score) and `meta` (job, rows looked at, time) of the site's latest job in jobs(site_key, job_id, samples, at).

    scores: (job_id, field, score). Sites without a job keep nulls.
    """
    each = scores.groupBy("job_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("field", "score")))).alias("confidence"))  # a row for each field
    last = jobs.groupBy(F.col("site_key").alias("key")).agg(F.max_by(F.struct("job_id", "samples", "at"), F.struct("at", "job_id")).alias("meta"))
    return sites.join(last, "key", "left").join(each, F.col("meta.job_id") == each.job_id, "left").drop("job_id")


def progress(jobs: DataFrame, errors: DataFrame, most: int = 20) -> DataFrame:
    """jobs(job_id, done, failed, skipped, total) with `percent` (100 for an empty job) and the last `most` errors of errors(job_id, seq, error)."""
    ended = F.col("done") + F.col("failed") + F.col("skipped")
    percent = F.when(F.col("total") == 0, 100.0).otherwise(F.bround(ended * 100 / F.col("total"), 1))
    late = errors.withColumn("n", F.row_number().over(Window.partitionBy("job_id").orderBy(F.desc("seq")))).where(F.col("n") <= most)
    late = late.groupBy("job_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("seq", "error"))), lambda x: x["error"]).alias("errors"))
    return jobs.withColumn("percent", percent).join(late, "job_id", "left")


def low_confidence(scores: DataFrame, least: float = LOW) -> DataFrame:
    return scores.where(F.col("score") < least)


def onboarding_gate(scores: DataFrame, key: str, least: float = LOW, warnings: DataFrame | None = None) -> DataFrame:
    """Whether every score of a key reaches `least` and there is no critical-field warning of it in warnings(key)."""
    out = scores.groupBy(key).agg(F.bool_and(F.col("score") >= least).alias("stable"))
    if warnings is None:
        return out
    bad = warnings.select(key, F.lit(True).alias("_bad")).distinct()
    return out.join(bad, key, "left").select(key, (F.col("stable") & F.col("_bad").isNull()).alias("stable"))


def job_counters(events: DataFrame, kinds: list[str]) -> DataFrame:
    return events.groupBy("job_id").agg(*[F.count_if(F.col("kind") == k).alias(f"n_{k}") for k in kinds])


def batch_summary(results: DataFrame) -> DataFrame:
    """One row of counts; with a column `action` also created and updated. It failed if nothing was done and something failed."""
    ok = F.count_if(F.col("status").isin("published", "updated"))
    bad = F.count_if(F.col("status") == "failed")
    acted = [F.count_if(F.col("action") == a).alias(a) for a in ("created", "updated")] if "action" in results.columns else []
    counts = results.agg(F.count("*").alias("total"), ok.alias("done"), bad.alias("failed"), F.count_if(F.col("status") == "pending").alias("skipped"), *acted)
    return counts.withColumn("status", F.when((F.col("done") == 0) & (F.col("failed") > 0), "failed").otherwise("completed"))


def duration(begun: Column, ended: Column) -> Column:
    """Time between as text, `1h 2m 3s` without leading parts that are 0; a dash if either is null."""
    total = F.floor((F.unix_micros(ended.cast("timestamp")) - F.unix_micros(begun.cast("timestamp"))) / 1_000_000)
    h, m, s = (F.floor(total / 3600), F.floor(total / 60) % 60, total % 60)
    part = lambda x, unit: F.concat(x.cast("long").cast("string"), F.lit(unit))
    text = F.when(h != 0, F.concat_ws(" ", part(h, "h"), part(m, "m"), part(s, "s"))).when(m != 0, F.concat_ws(" ", part(m, "m"), part(s, "s"))).otherwise(part(s, "s"))
    return F.coalesce(F.when(total.isNotNull(), text), F.lit("\u2014"))


def job_report(jobs: DataFrame, now: Column | None = None) -> DataFrame:
    """jobs with `success` in percent; with started_at and finished_at also `duration`, and with `now` the time `elapsed` of those that still run."""
    share = F.when(F.col("listings_found") > 0, F.floor(F.col("listings_scraped") * 100 / F.col("listings_found")).cast("int")).otherwise(0)
    out = jobs.withColumn("success", share)
    if "started_at" not in jobs.columns:
        return out
    out = out.withColumn("duration", duration(F.col("started_at"), F.col("finished_at")))
    return out if now is None else out.withColumn("elapsed", F.when(F.col("finished_at").isNull(), duration(F.col("started_at"), now)))
