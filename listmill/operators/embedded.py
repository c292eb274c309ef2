"""Embedded data of pages: ld+json blocks of any shape as VARIANT, page titles and descriptions, and the gaps that they fill.

Nested lists and graphs are taken apart level by level, as many levels as there are; an object comes before the members of its graph.
Text of a value: that of the first of url, contentUrl, name and value of an object, or of the first item of a list, that has one; white
space collapsed, at most 160 characters. Broken blocks, JSON nulls and empty texts give nothing.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from listmill.functions import columns as C
from listmill.operators import pairs, records
from listmill.sources.tables import written

BLOCK = r"""(?is)<script\b[^>]*?\btype\s*=\s*["']?\s*application/ld\+json\s*["']?[^>]*>(.*?)</script\s*>"""
# Types of objects that tell of a listing, members that are read for each field in order, and members that are an object's text (fixed values).
TYPES = ["realestatelisting", "offer", "product", "singlefamilyresidence", "residence", "house", "apartment"]
MEMBERS = {
    "title": ["name", "headline", "title"], "price": ["price", "offers.price"], "area": ["floorSize.value", "floorSize", "floorSize.name"],
    "land_area": ["lotSize.value", "lotSize", "lotSize.name"], "rooms": ["numberOfRooms", "numberOfBedrooms"], "bathrooms": ["numberOfBathroomsTotal", "numberOfBathrooms"],
    "property_type": ["additionalType", "category"], "condition": ["itemCondition", "condition"], "business_type": ["businessFunction", "offers.businessFunction"],
    "district": ["address.addressRegion"], "county": ["address.addressLocality"], "parish": ["address.name"], "description": ["description"],
}
TEXT_MEMBERS = ["url", "contentUrl", "name", "value"]
#: Fields that gaps are filled in, from embedded objects or sharing tags.
FILLED = ["title", "price", "area", "land_area", "property_type", "typology", "condition", "business_type", "district", "county", "parish"]
# Names of a page's description, first by name and then by property (fixed values).
DESCRIPTIONS = ["description", "og:description", "twitter:description"]
MOST = 160


def _get(v: Column, path: str, kind: str = "variant") -> Column:
    return F.try_variant_get(v, "$" + "".join(f"['{p}']" for p in path.split(".") if p), kind)


def _list(v: Column) -> Column:
    return _get(v, "", "array<variant>")


def _object(v: Column) -> Column:
    return _get(v, "", "map<string,variant>").isNotNull()


def _clean(text: Column) -> Column:
    return F.substring(F.trim(F.regexp_replace(text, r"\s+", " ")), 1, MOST)


def ld_objects(pages: DataFrame) -> DataFrame:
    """(page_id, path, v): every object of the pages' blocks, lists and graphs taken apart; `path` sorts them as they are written."""
    texts = pages.select("page_id", F.posexplode(F.regexp_extract_all("html", F.lit(BLOCK), F.lit(1))).alias("n", "text"))
    level = written(texts.select("page_id", F.array("n").alias("path"), F.try_parse_json("text").alias("v")).where("v IS NOT NULL"))
    levels = []
    while not level.isEmpty():
        levels.append(level.where(_object(F.col("v"))))
        members = F.coalesce(_list(F.col("v")), _get(F.col("v"), "@graph", "array<variant>"))
        level = written(level.select("page_id", "path", F.posexplode(members).alias("n", "v")).select("page_id", F.array_append("path", F.col("n")).alias("path"), "v").where("v IS NOT NULL"))
    return reduce(DataFrame.unionByName, levels) if levels else level


def _texts(values: DataFrame) -> DataFrame:
    """values(page_id, path, field, item, rank, v) with the text that their v gives in place of it."""
    level, levels = written(values.where("v IS NOT NULL AND NOT is_variant_null(v)")), []
    while not level.isEmpty():
        v = F.col("v")
        plain = F.when(F.schema_of_variant(v) == "BOOLEAN", F.initcap(_get(v, "", "string"))).otherwise(_get(v, "", "string"))
        levels.append(level.where(_list(v).isNull() & ~_object(v)).select("page_id", "path", "field", "item", "rank", _clean(plain).alias("text")))
        below = F.coalesce(_list(v), F.when(_object(v), F.array(*[_get(v, m) for m in TEXT_MEMBERS])))
        level = level.select("page_id", "path", "field", "item", "rank", F.posexplode(below).alias("n", "v")).withColumn("rank", F.array_append("rank", F.col("n"))).drop("n")
        level = written(level.where("v IS NOT NULL AND NOT is_variant_null(v)"))
    if not levels:
        return level.select("page_id", "path", "field", "item", "rank", F.lit("").alias("text"))
    return reduce(DataFrame.unionByName, levels)


def jsonld_values(pages: DataFrame) -> DataFrame:
    """(page_id, field, values): of 14 fields the distinct values of all supported objects, in the order of the page.

    An object is supported if one of its types is, in any case of letters, or if it has none. Of a list of offers the first with a
    value counts. Types: the field itself, else the first known @type; typology from title, then description; images are all kept.
    """
    v = F.col("v")
    listed = F.coalesce(_list(_get(v, "@type")), F.array(_get(v, "@type")))
    types = F.transform(F.filter(listed, lambda t: F.schema_of_variant(t) == "STRING"), lambda t: F.lower(_get(t, "", "string")))
    own = ld_objects(pages).select("page_id", "path", "v", types.alias("types"))
    own = written(own.where((F.size("types") == 0) | F.arrays_overlap("types", F.array(*map(F.lit, TYPES)))))
    cell = lambda field, item, rank, x: F.struct(F.lit(field).alias("field"), item.alias("item"), rank.alias("rank"), x.alias("v"))
    zero = F.lit(0)
    cells, lists = [], []
    for field, members in MEMBERS.items():
        for k, m in enumerate(members):
            cells.append(cell(field, zero, F.array(F.lit(k), zero), _get(v, m)))
            if m.startswith("offers."):
                lists.append(F.transform(_list(_get(v, "offers")), _offer(cell, field, k, m.split(".")[1])))
    image = _get(v, "image")
    lists.append(F.transform(F.coalesce(_list(image), F.array(image)), lambda x, n: cell("images", n, F.array(zero, zero), x)))
    every = F.flatten(F.array(F.array(*cells), *[F.coalesce(x, F.array().cast(_CELLS)) for x in lists]))
    texts = _texts(own.select("page_id", "path", F.explode(every).alias("c")).select("page_id", "path", "c.*")).where("text <> ''")
    best = written(texts.groupBy("page_id", "path", "field", "item").agg(F.min_by("text", "rank").alias("text")))
    told = best.where("field IN ('title', 'description')").groupBy("page_id", "path").agg(*[F.max(F.when(F.col("field") == f, F.col("text"))).alias(f) for f in ("title", "description")])
    typology = told.select("page_id", "path", F.lit("typology").alias("field"), pairs.typology_from(F.col("title"), F.col("description")).alias("text"))
    named = own.select("page_id", "path", F.lit("property_type").alias("field"), pairs.type_from_jsonld(F.col("types")).alias("text"))
    named = named.join(best.where("field = 'property_type'"), ["page_id", "path"], "left_anti")
    address = pairs.address_from(F.when(F.schema_of_variant(_get(v, "address")) == "STRING", _get(v, "address", "string")))
    placed = own.select("page_id", "path", address.alias("a")).select("page_id", "path", F.expr("stack(3, 'district', a.district, 'county', a.county, 'parish', a.parish) AS (field, text)"))
    rows = best.where("field <> 'description'")
    for more in (typology, named, placed):
        rows = rows.unionByName(more.where("text <> ''").select("page_id", "path", "field", F.lit(0).alias("item"), F.substring("text", 1, MOST).alias("text")))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("path", "item", "text"))), lambda x: x["text"])
    return rows.groupBy("page_id", "field").agg(F.array_distinct(ordered).alias("values"))


_CELLS = "array<struct<field:string,item:int,rank:array<int>,v:variant>>"


def _offer(cell, field: str, k: int, member: str):
    def one(x: Column, n: Column) -> Column:
        return cell(field, F.lit(0), F.array(F.lit(k), n), _get(x, member))

    return one


def seo_meta(nodes: DataFrame) -> DataFrame:
    """(page_id, page_title, meta_description) of pages that have either: the title element, else og:title; the first description of DESCRIPTIONS.

    Of several elements of one name the first counts, even if it is empty; names go before properties.
    """
    name, prop = F.col("attrs")["name"], F.col("attrs")["property"]
    ranks = [F.when(F.col("tag") == "title", 0), F.when(prop == "og:title", 1)]
    ranks += [F.when(attr == d, 10 + k) for k, (attr, d) in enumerate((a, d) for a in (name, prop) for d in DESCRIPTIONS)]
    rows = nodes.where("tag IN ('title', 'meta')").select("page_id", "node_id", F.explode(F.array_compact(F.array(*ranks))).alias("rank"), F.when(F.col("tag") == "title", F.col("text")).otherwise(F.col("attrs")["content"]).alias("text"))
    first = rows.groupBy("page_id", "rank").agg(F.min_by("text", "node_id").alias("text")).where("text <> ''")
    pick = lambda cond: F.expr(f"min_by(text, rank) FILTER (WHERE {cond})")
    return first.groupBy("page_id").agg(pick("rank < 10").alias("page_title"), pick("rank >= 10").alias("meta_description"))


def fill_missing(raw: DataFrame, values: DataFrame, meta: DataFrame, seo: DataFrame) -> DataFrame:
    """raw(page_id, any of FILLED, images, raw_description, location as far as it has them; the rest is added) with its gaps filled.

    Blank fields: the first of jsonld_values(), else the first of the sharing tags of meta (meta_values()), for the type then that
    told by the title; images with as many empty alternative texts; the description from seo (seo_meta()), which also brings
    page_title and meta_description; the location from district, county and parish.
    """
    have = lambda c: F.col(c) if c in raw.columns else F.lit(None).cast("array<string>" if c in ("images", "alt_texts") else "string")
    wide = values.groupBy("page_id").agg(F.map_from_entries(F.collect_list(F.struct("field", "values"))).alias("_v"))  # at most 14 fields
    rows = raw.join(wide, "page_id", "left").join(meta.select("page_id", F.col("titles").alias("_titles"), F.col("prices").alias("_prices")), "page_id", "left")
    rows = rows.join(seo.select("page_id", F.col("page_title").alias("_page_title"), F.col("meta_description").alias("_meta_description")), "page_id", "left")
    shared = {"title": F.get("_titles", F.lit(0)), "price": F.get("_prices", F.lit(0))}
    out = {f: F.coalesce(C.nullif_blank(have(f)), F.get(F.col("_v")[f], F.lit(0)), *([shared[f]] if f in shared else [])) for f in FILLED}
    none = F.coalesce(F.size(have("images")), F.lit(0)) <= 0
    out |= {"images": F.when(none, F.coalesce(F.col("_v")["images"], have("images"))).otherwise(have("images"))}
    out |= {"alt_texts": F.when(none & F.col("_v")["images"].isNotNull(), F.array_repeat(F.lit(""), F.size(F.col("_v")["images"]))).otherwise(have("alt_texts"))}
    out |= {"raw_description": F.coalesce(C.nullif_blank(have("raw_description")), F.col("_meta_description")), "page_title": F.col("_page_title"), "meta_description": F.col("_meta_description")}
    rows = rows.withColumns(out)
    rows = rows.withColumn("property_type", F.coalesce("property_type", records.type_from_title(F.col("title"))))
    place = C.nullif_blank(F.concat_ws(", ", *[C.nullif_blank(F.col(c)) for c in ("district", "county", "parish")]))
    place = F.coalesce(C.nullif_blank(F.col("location")), place) if "location" in raw.columns else place
    return rows.withColumn("location", place).drop("_v", "_titles", "_prices", "_page_title", "_meta_description")
