"""Relational extraction over the nodes table beyond single fields: lists, flags, images, reports, embedded data."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from listmill.functions import columns as C
from listmill.operators import extract

SOURCES = ["src", "data-src", "data-lazy-src", "data-imgthumb", "data-original"]


def list_items(nodes: DataFrame, selector: str) -> DataFrame:
    """(page_id, items): non-empty texts of the matching nodes in document order."""
    rows = extract.select_nodes(nodes, selector).where("text <> ''")
    return rows.groupBy("page_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("node_id", "text"))), lambda x: x["text"]).alias("items"))


def first_long(nodes: DataFrame, selectors: list[str], least: int = 50) -> DataFrame:
    """(page_id, text): the first selector whose first match has more than `least` characters."""
    rows = extract.select_firsts(nodes, {str(rank): s for rank, s in enumerate(selectors)}).where(F.length("text") > least)
    return rows.groupBy("page_id").agg(F.min_by("text", F.col("field").cast("int")).alias("text"))


def reference_value() -> Column:
    """Property id: text, else a telling attribute."""
    return F.coalesce(C.nullif_blank(F.col("text")), *[C.nullif_blank(F.col("attrs")[a]) for a in ("reference", "data-reference", "data-id", "content")])


def feature_flags(nodes: DataFrame, selector: str, features: dict[str, list[str]]) -> DataFrame:
    """A column "Yes" or null for each feature, for pages with items: any keyword within any item's text."""
    low = F.lower("text")
    hit = lambda words: F.max(F.greatest(*[low.contains(w) for w in words], F.lit(False)))
    return extract.select_nodes(nodes, selector).groupBy("page_id").agg(*[F.when(hit(words), "Yes").alias(name) for name, words in features.items()])


def characteristics(nodes: DataFrame, selector: str, keywords: dict[str, str]) -> DataFrame:
    """(page_id, field, value): each item goes to the field of the first keyword it contains; the last item wins."""
    return characteristic_values(extract.select_nodes(nodes, selector), keywords)


def characteristic_values(items: DataFrame, keywords: dict[str, str]) -> DataFrame:
    field = F.lit(None).cast("string")
    for word, name in reversed(keywords.items()):
        field = F.when(F.lower("text").contains(word), name).otherwise(field)
    rows = items.withColumn("field", field).where("field IS NOT NULL")
    return rows.groupBy("page_id", "field").agg(F.max_by("text", "node_id").alias("value"))


def area_kind(label: Column) -> Column:
    low = F.lower(label)
    return F.when(low.rlike("useful|útil"), "useful_area").when(low.rlike("gross|bruta"), "gross_area").when(low.rlike("land|terreno"), "land_area")


def images(nodes: DataFrame, pages: DataFrame, selector: str = "img", include: str | None = None, exclude: str | None = None) -> DataFrame:
    """(page_id, images, alts): absolute urls in document order, repeats kept, and their alternative texts.

    A link gives its href, unless that is a script or an anchor; then, and for its text, the first image inside counts.
    """
    found = extract.select_nodes(nodes, selector)
    source = lambda attrs: F.coalesce(*[F.when((attrs[a] != "") & ~attrs[a].startswith("data:"), F.trim(attrs[a])) for a in SOURCES])
    inner = nodes.where("tag = 'img'").select("page_id", F.explode("ancestors").alias("up"), F.struct(source(F.col("attrs")).alias("src"), F.col("attrs")["alt"].alias("alt")).alias("i"), F.col("node_id").alias("n"))
    inner = inner.groupBy("page_id", F.col("up").alias("node_id")).agg(F.min_by("i", "n").alias("inner"))
    href, link = F.col("attrs")["href"], F.col("tag") == "a"
    target = F.when((href != "") & ~href.rlike("^(javascript:|#)"), F.trim(href))
    listed = F.element_at(F.split(F.trim(F.element_at(F.split(F.coalesce(F.col("attrs")["srcset"], F.col("attrs")["data-srcset"]), ","), 1)), " "), 1)
    src = F.when(link, F.coalesce(target, F.col("inner.src"))).otherwise(F.coalesce(source(F.col("attrs")), F.when(F.col("tag") == "source", listed)))
    rows = found.join(inner, ["page_id", "node_id"], "left").join(pages.select("page_id", F.col("url").alias("base")), "page_id")
    rows = rows.select("page_id", "node_id", C.url_join(F.col("base"), src).alias("url"), F.coalesce(F.when(link, F.col("inner.alt")).otherwise(F.col("attrs")["alt"]), F.lit("")).alias("alt")).where("url IS NOT NULL")
    if include:
        rows = rows.where(F.col("url").rlike(include))
    if exclude:
        rows = rows.where(~F.col("url").rlike(exclude))
    both = F.array_sort(F.collect_list(F.struct("node_id", "url", "alt")))
    return rows.groupBy("page_id").agg(both.alias("b")).select("page_id", F.col("b.url").alias("images"), F.col("b.alt").alias("alts"))


def next_page(nodes: DataFrame, pages: DataFrame, selector: str) -> DataFrame:
    """(page_id, next): the absolute target of the first match."""
    hit = extract.select_one(nodes, selector).select("page_id", F.col("attrs")["href"].alias("href")).where("href <> ''")
    return pages.select("page_id", "url").join(hit, "page_id").select("page_id", C.url_join(F.col("url"), F.col("href")).alias("next"))


def visited_prefix(visits: DataFrame, job: str, order: list[str], url: str) -> DataFrame:
    """Visits of each job before its first repeated url."""
    again = (F.row_number().over(Window.partitionBy(job, url).orderBy(*order)) > 1).cast("int")
    return visits.withColumn("_r", again).withColumn("_r", F.max("_r").over(Window.partitionBy(job).orderBy(*order))).where("_r = 0").drop("_r")


def link_report(nodes: DataFrame, pages: DataFrame, selector: str = "a", pattern: str = "", thumbnail: str | None = None, next_page_selector: str | None = None, show: int = 5) -> DataFrame:
    """A row for each page: links found and matched, the first matching and rejected urls, thumbnails of the first elements, the next page."""
    rows = extract.listing_links(nodes, pages, selector).withColumn("ok", F.col("url").rlike(pattern))
    some = lambda keep: F.slice(F.transform(F.array_sort(F.collect_list(F.when(keep, F.struct("ord", "url")))), lambda x: x["url"]), 1, show)
    own = rows.groupBy("page_id").agg(F.count("*").alias("found"), F.count_if("ok").alias("matched"), some(F.col("ok")).alias("accepted"), some(~F.col("ok")).alias("rejected"))
    none = F.array().cast("array<string>")
    out = pages.select("page_id").join(own, "page_id", "left")
    out = out.select("page_id", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("found", "matched")], *[F.coalesce(c, none).alias(c) for c in ("accepted", "rejected")])
    thumbs = thumbnails(nodes, pages, thumbnail, show) if thumbnail else pages.select("page_id", none.alias("thumbnails")).where("false")
    ahead = next_page(nodes, pages, next_page_selector) if next_page_selector else pages.select("page_id", F.lit("").alias("next")).where("false")
    return out.join(thumbs, "page_id", "left").join(ahead, "page_id", "left").withColumn("thumbnails", F.coalesce("thumbnails", none))


def thumbnails(nodes: DataFrame, pages: DataFrame, selector: str, show: int = 5) -> DataFrame:
    """(page_id, thumbnails): absolute sources of the first `show` matching elements, those without one left out."""
    first = extract.select_nodes(nodes, selector).withColumn("_n", F.row_number().over(Window.partitionBy("page_id").orderBy("node_id"))).where(F.col("_n") <= show)
    source = F.coalesce(*[F.when(F.col("attrs")[a] != "", F.col("attrs")[a]) for a in SOURCES[:3]])
    rows = first.select("page_id", "node_id", source.alias("src")).where("src IS NOT NULL").join(pages.select("page_id", F.col("url").alias("_base")), "page_id")
    urls = F.array_sort(F.collect_list(F.struct("node_id", C.url_join(F.col("_base"), F.col("src")).alias("url"))))
    return rows.groupBy("page_id").agg(F.transform(urls, lambda x: x["url"]).alias("thumbnails"))


def validate_selectors(nodes: DataFrame, pages: DataFrame, selectors: dict[str, str], samples: int = 3, most: int = 200) -> DataFrame:
    """(page_id, field, valid, matches, samples) for each page and selector; bad syntax is not valid, no match is a count of 0."""
    good = {}
    for name, selector in selectors.items():
        try:
            for steps in extract._steps(selector):
                for _, part in steps:
                    extract.compound(part)
            good[name] = selector
        except ValueError:
            continue
    names = F.array(*[F.struct(F.lit(n).alias("field"), F.lit(n in good).alias("valid")) for n in selectors])
    base = pages.select("page_id", F.inline(names))
    if not good:
        return base.select("page_id", "field", "valid", F.lit(0).cast("long").alias("matches"), F.lit(None).cast("array<string>").alias("samples"))
    hits = extract.select_many(nodes, good).groupBy("page_id", "field").agg(F.count("*").alias("matches"), F.array_sort(F.collect_list(F.struct("node_id", F.substring("text", 1, most).alias("text")))).alias("h"))
    out = base.join(hits, ["page_id", "field"], "left")
    return out.select("page_id", "field", "valid", F.coalesce("matches", F.lit(0)).cast("long").alias("matches"), F.slice(F.col("h.text"), 1, samples).alias("samples"))
