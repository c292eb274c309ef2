"""Write path as whole-table operators: upsert, price history, media, pruning, ledger, reconciliation.

Each returns the new table (or side table) as a DataFrame; the caller writes it to a new version directory.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def winners(incoming: DataFrame, key: str = "source_url", order: str = "ord") -> DataFrame:
    """One row for each key: the last by `order`."""
    rest = [c for c in incoming.columns if c != key]
    return incoming.groupBy(key).agg(F.max_by(F.struct(*rest), order).alias("w")).select(key, "w.*")


def upsert(current: DataFrame, incoming: DataFrame, fields: list[str], key: str = "source_url") -> DataFrame:
    """current with incoming merged on the key: non-null incoming values win, new keys are added; `state` says which."""
    new = winners(incoming, key).select(key, *[F.col(f).alias(f"_{f}") for f in fields], F.lit(True).alias("_in"))
    both = current.withColumn("_cur", F.lit(True)).join(new, key, "full")
    state = F.when(F.col("_cur").isNull(), "new").when(F.col("_in"), "updated").otherwise("kept")
    rest = [c for c in current.columns if c not in (key, *fields)]
    return both.select(key, *rest, *[F.coalesce(f"_{f}", f).alias(f) for f in fields], state.alias("state"))


def upsert_dated(current: DataFrame, incoming: DataFrame, fields: list[str], now: Column, key: str = "source_url") -> DataFrame:
    """upsert() of rows with created_at, which stays, and updated_at: both `now` for new keys, updated_at for updated ones too."""
    out = upsert(current, incoming, fields, key)
    created = F.when(F.col("state") == "new", now).otherwise(F.col("created_at"))
    return out.withColumns({"created_at": created, "updated_at": F.when(F.col("state") != "kept", now).otherwise(F.col("updated_at"))})


def price_history_rows(current: DataFrame, incoming: DataFrame, key: str = "source_url") -> DataFrame:
    """The old price (and currency, if the table has it) of every listing whose price changes."""
    new = winners(incoming, key).select(key, F.col("price_amount").alias("new_price"))
    old = [F.col("price_currency").alias("old_currency")] if "price_currency" in current.columns else []
    return current.join(new, key).where("price_amount <> new_price").select("id", key, F.col("price_amount").alias("old_price"), *old, "new_price")


def replace_media(media: DataFrame, incoming: DataFrame) -> DataFrame:
    """All media of touched listings replaced by the incoming ones."""
    return media.join(incoming.select("listing_id").distinct(), "listing_id", "left_anti").unionByName(incoming)


def prune(current: DataFrame, seen: DataFrame, least: int = 10, most: float = 0.3) -> DataFrame:
    """Listings with `gone`: their url was not seen and the partner's guards hold (enough urls seen, not too many gone).

    Rows without a url are never pruned.
    """
    mark = current.join(seen.select("source_url", F.lit(True).alias("_seen")).distinct(), "source_url", "left")
    missing = F.col("_seen").isNull() & F.col("source_url").isNotNull()
    guard = mark.groupBy("source_partner").agg(F.count("*").alias("total"), F.count_if(missing).alias("lost"), F.count_if(F.col("_seen")).alias("found"))
    guard = guard.select("source_partner", ((F.col("found") >= least) & (F.col("lost") <= most * F.col("total"))).alias("safe"))
    return mark.join(guard, "source_partner", "left").select(*current.columns, (missing & F.coalesce("safe", F.lit(False))).alias("gone"))


def insert_unique(current: DataFrame, new: DataFrame, key: str = "source_url", order: str = "ord") -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected) rows of new: rejected are those whose key exists, or came earlier among the new ones."""
    first = F.row_number().over(Window.partitionBy(key).orderBy(order)) == 1
    rows = new.withColumn("_first", first | F.col(key).isNull()).join(current.select(key, F.lit(True).alias("_has")).distinct(), key, "left")
    good = F.col("_first") & F.col("_has").isNull()
    return rows.where(good).select(*new.columns), rows.where(~good).select(*new.columns)


def delete(current: DataFrame, ids: DataFrame, column: str = "id") -> DataFrame:
    """Rows (or, with the foreign key as `column`, child rows) of other ids."""
    return current.join(ids.select(F.col("id").alias(column)).distinct(), column, "left_anti")


def upsert_ledger(ledger: DataFrame, results: DataFrame) -> DataFrame:
    """results(listing_id, status, remote_id, error[, seq]): kept remote ids when the new one is null; errors only of failures.

    Of several results of a listing the last by `seq` counts (without that column the greatest), of several ledger rows the
    one with the greatest remote id. A column `at` of results becomes last_exported_at where the result is no failure.
    """
    own = ledger.groupBy("listing_id").agg(F.max_by(F.struct(*[c for c in ledger.columns if c != "listing_id"]), F.coalesce("remote_id", F.lit(-1))).alias("l")).select("listing_id", "l.*")
    given = [c for c in ("status", "remote_id", "error", "at") if c in results.columns]
    order = F.col("seq") if "seq" in results.columns else F.struct(*given)
    new = results.groupBy("listing_id").agg(F.max_by(F.struct(*[F.col(c).alias(f"_{c}") for c in given]), order).alias("r")).select("listing_id", "r.*")
    failed = F.col("_status") == "failed"
    out = [F.coalesce("_remote_id", "remote_id").alias("remote_id"), F.coalesce("_status", "status").alias("status"), F.when(failed, F.col("_error")).alias("last_error")]
    if "at" in given:
        before = F.col("last_exported_at") if "last_exported_at" in ledger.columns else F.lit(None)
        out.append(F.coalesce(F.when(~failed, F.col("_at")), before).alias("last_exported_at"))
    return own.join(new, "listing_id", "full").select("listing_id", "partner_id", *out)


def export_action(listings: DataFrame, ledger: DataFrame) -> DataFrame:
    own = ledger.groupBy(F.col("listing_id").alias("id")).agg(F.max("remote_id").alias("remote_id"))
    return listings.join(own, "id", "left").withColumn("action", F.when(F.col("remote_id").isNull(), "create").otherwise("update"))


def reconcile(ledger: DataFrame, crm: DataFrame) -> DataFrame:
    """Ledger against the remote snapshot by reference: in_both (with a mismatch flag), only_in_db, only_in_crm."""
    own = ledger.groupBy(F.col("partner_id").alias("reference")).agg(F.max_by("remote_id", "listing_id").alias("remote_id"))
    far = crm.groupBy("reference").agg(F.max("property_id").alias("property_id"))
    both = own.join(far, "reference", "full")
    group = F.when(F.col("property_id").isNull(), "only_in_db").when(F.col("remote_id").isNull(), "only_in_crm").otherwise("in_both")
    return both.withColumn("grp", group).withColumn("mismatch", F.coalesce(F.col("remote_id") != F.col("property_id"), F.lit(False)))


def never_exported(listings: DataFrame, ledger: DataFrame) -> DataFrame:
    return listings.join(ledger.select("partner_id").distinct(), "partner_id", "left_anti")


def map_merge(a, b):
    """Map b over map a: right values win unless null."""
    return F.map_zip_with(a, b, lambda k, x, y: F.coalesce(y, x))


def plan_locales(listings: DataFrame, locales: list[str], stored: str, force: bool = False) -> DataFrame:
    """(id, locale, action): generate where forced or nothing is stored, else cached."""
    rows = listings.withColumn("locale", F.explode(F.array(*map(F.lit, locales))))
    have = F.coalesce(F.element_at(F.col(stored), F.col("locale")) != "", F.lit(False))
    return rows.select("id", "locale", F.when(F.lit(force) | ~have, "generate").otherwise("cached").alias("action"))


def patch(current: DataFrame, patches: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows, price history): patches(id, given, price_amount, area_useful_m2) set the columns named in the array `given`.

    Price per m2 is reckoned anew where one of its inputs is given; the old price is recorded where a given one differs.
    """
    fields = ["price_amount", "area_useful_m2"]
    both = current.join(patches.select("id", "given", *[F.col(f).alias(f"_{f}") for f in fields]), "id", "left")
    asked = lambda f: F.coalesce(F.array_contains("given", f), F.lit(False))
    new = {f: F.when(asked(f), F.col(f"_{f}")).otherwise(F.col(f)) for f in fields}
    history = both.where(asked("price_amount") & (F.col("price_amount") != F.col("_price_amount"))).select("id", F.col("price_amount").alias("old_price"))
    touched = asked("price_amount") | asked("area_useful_m2")
    rows = both.select(*[c for c in current.columns if c not in (*fields, "price_per_m2")], "price_per_m2", *[new[f].alias(f) for f in fields], touched.alias("_t"))
    ratio = F.bround(F.col("price_amount").cast("decimal(14,2)") / F.when(F.col("area_useful_m2") != 0, F.col("area_useful_m2")).cast("decimal(14,4)"), 2).cast("double")
    return rows.withColumn("price_per_m2", F.when(F.col("_t"), ratio).otherwise(F.col("price_per_m2"))).drop("_t"), history


def drop_sold(current: DataFrame, raw: DataFrame, sold) -> tuple[DataFrame, DataFrame]:
    """(current without sold urls, raw rows to ingest)."""
    marked = raw.withColumn("_sold", sold)
    urls = marked.where("_sold").select("source_url").distinct()
    return current.join(urls, "source_url", "left_anti"), marked.where("NOT _sold").drop("_sold")


def reset_ledger(ledger: DataFrame, ids: DataFrame | None) -> DataFrame:
    """The ledger without the given ids(id); None empties it."""
    return ledger.limit(0) if ids is None else delete(ledger, ids, "listing_id")


def apply_site_changes(sites: DataFrame, changes: DataFrame) -> DataFrame:
    """sites(key, name, is_active) after changes(key, action, new_name), one a key; `result` tells what happened.

    create: new, or reactivated if inactive, else a duplicate; delete: deactivated, an error if inactive; purge: row removed.
    """
    both = sites.withColumn("_has", F.lit(True)).join(changes, "key", "full")
    has, active, action = F.col("_has").isNotNull(), F.coalesce("is_active", F.lit(False)), F.col("action")
    result = (
        F.when(action.isNull(), "kept").when((action == "create") & ~has, "created").when((action == "create") & ~active, "reactivated").when(action == "create", "duplicate")
        .when(~has, "not_found").when(action == "purge", "purged").when(active, "deactivated").otherwise("already_inactive")
    )
    out = both.withColumn("result", result)
    made = F.col("result").isin("created", "reactivated")
    out = out.withColumn("name", F.when(made, F.col("new_name")).otherwise(F.col("name")))
    return out.select("key", "name", F.when(made, True).when(F.col("result") == "deactivated", False).otherwise(F.col("is_active")).alias("is_active"), "result")


def ingest_rows(classified: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(log, urls) of classified(source_url, outcome[, missing, error]): entries for the job's log (level, message, url), and the state of each url.

    Sold listings leave an entry and no state; missing critical fields, a text array, are told of listings that were taken; pages
    that could not be fetched are warnings, those that failed later (`error` is set) errors.
    """
    have = lambda c, kind: F.col(c) if c in classified.columns else F.lit(None).cast(kind)
    outcome, error, missing = F.col("outcome"), have("error", "string"), have("missing", "array<string>")
    entry = lambda level, message: F.struct(F.lit(level).alias("level"), message.alias("message"))
    found = F.array_compact(F.array(
        F.when((outcome == "errored") & error.isNull(), entry("warning", F.lit("Failed to fetch listing page"))), F.when((outcome == "errored") & error.isNotNull(), entry("error", F.concat(F.lit("Error processing listing: "), error))),
        F.when(outcome == "sold", entry("info", F.lit("Listing marked as sold/reserved \u2014 skipped"))),
        F.when(~outcome.isin("errored", "sold") & (F.size(missing) > 0), entry("warning", F.concat(F.lit("Critical parser fields missing: "), F.array_join(missing, ", ")))),
    ))
    log = classified.select("source_url", F.explode(found).alias("e")).select("e.level", "e.message", F.col("source_url").alias("url"))
    return log, classified.where(outcome != "sold").select(F.when(outcome == "errored", "failed").otherwise("scraped").alias("state"), F.col("source_url").alias("url"))


def classify(found: DataFrame, current: DataFrame, raw: DataFrame) -> DataFrame:
    """found(source_url) with `outcome`: errored (no raw row), sold, warned (no price), scraped_updated or scraped_new.

    raw(source_url, sold, price_amount) has one row for each url that could be read.
    """
    own = current.select("source_url", F.lit(True).alias("_known")).distinct()
    rows = found.join(raw.withColumn("_read", F.lit(True)), "source_url", "left").join(own, "source_url", "left")
    outcome = F.when(F.col("_read").isNull(), "errored").when(F.col("sold"), "sold").when(F.col("price_amount").isNull(), "warned").when(F.col("_known"), "scraped_updated").otherwise("scraped_new")
    return rows.select("source_url", outcome.alias("outcome"))
