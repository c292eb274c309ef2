"""Labelled values, section mode and fallbacks, relational over the nodes table.

Long results are (page_id, field, value). Everything is grouped by page, so a site's size never lands in one task.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from listmill.functions import columns as C
from listmill.operators import extract, matching, sections
from listmill.sources.tables import written

# Labels of detail rows in order of precedence; the first one contained in a label names its field (fixed values).
FIELD_MAP = {
    "objectivo": "business_type", "objetivo": "business_type", "price": "price", "preço": "price", "valor": "price", "business type": "business_type", "business state": "business_state",
    "tipo de negócio": "business_type", "tipo negócio": "business_type",
    "typology": "typology", "tipologia": "typology", "tipo": "typology", "bedrooms": "bedrooms", "quartos": "bedrooms", "assoalhadas": "bedrooms",
    "bathrooms": "bathrooms", "casas de banho": "bathrooms", "wc": "bathrooms", "living rooms": "living_rooms", "salas": "living_rooms",
    "floor": "floor", "andar": "floor", "piso": "floor", "energy certificate": "energy_certificate", "certificado energético": "energy_certificate",
    "classe energética": "energy_certificate", "energy class": "energy_certificate", "construction year": "construction_year", "ano de construção": "construction_year",
    "property type": "property_type", "tipo de imóvel": "property_type", "natureza": "property_type", "district": "district", "distrito": "district",
    "county": "county", "concelho": "county", "parish": "parish", "freguesia": "parish", "reference": "property_id", "referência": "property_id", "ref": "property_id",
    "venda": "business_type", "arrendamento": "business_type", "trespasse": "business_type",
}
# Labels of summary rows, which must be equal (fixed values).
SUMMARY_MAP = {
    "objectivo": "business_type", "objetivo": "business_type", "tipo de negócio": "business_type", "estado": "condition", "tipo": "property_type",
    "tipo de imóvel": "property_type", "tipologia": "typology", "tipologia do imóvel": "typology", "distrito": "district", "concelho": "county",
    "freguesia": "parish", "zona": "zone", "venda": "business_type", "arrendamento": "business_type", "trespasse": "business_type",
}
# Labels that are themselves the value (fixed values).
SELF_LABELS = ["venda", "arrendamento", "trespasse", "sale", "rent"]
# Words that tell a feature (fixed values).
FEATURE_MAP = {
    "garage": ["garage", "garagem", "parking", "estacionamento", "box"], "elevator": ["elevator", "elevador", "lift"],
    "balcony": ["balcony", "varanda", "terraço", "terrace", "marquise"], "air_conditioning": ["air conditioning", "ar condicionado", "a/c", "climatização"],
    "swimming_pool": ["pool", "piscina", "swimming"],
}
#: Order in which the parts of section mode win.
PRECEDENCE = ["characteristics", "patterns", "single", "summary", "details", "areas", "divisions"]


def select_safe(nodes: DataFrame, selector: str) -> DataFrame:
    """First match; where the selector is not supported, the last match of it without pseudo-classes, or nothing."""
    try:
        return extract.select_one(nodes, selector)
    except ValueError:
        plain = re.sub(r":[a-z-]+(\([^)]*\))?", "", selector).strip()
    try:
        rows = extract.select_nodes(nodes, plain)
    except ValueError:
        return nodes.where("false")
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy("page_id").orderBy(F.desc("node_id")))).where("_n = 1").drop("_n")


def within(nodes: DataFrame, section: str | None) -> DataFrame:
    """Nodes below the first match of `section` on each page; all nodes without one."""
    if not section:
        return nodes
    top = select_safe(nodes, section).select("page_id", F.col("node_id").alias("_top"))
    return nodes.join(top, "page_id").where(F.array_contains("ancestors", F.col("_top"))).drop("_top")


def item_parts(nodes: DataFrame, item: str, **parts: str) -> DataFrame:
    """page_id, item, item_text and, for each named selector, its first match inside the item (text, attrs, classes) or null."""
    items = extract.select_nodes(nodes, item).select("page_id", F.col("node_id").alias("item"), F.col("text").alias("item_text"))
    found = extract.select_many(nodes, parts).select("page_id", F.explode("ancestors").alias("item"), F.col("field").alias("part"), "node_id", F.struct("text", "attrs", "classes").alias("at"))
    rows = items.join(found, ["page_id", "item"], "left")
    firsts = [F.expr(f"min_by(at, node_id) FILTER (WHERE part = '{name}')").alias(name) for name in parts]
    return rows.groupBy("page_id", "item").agg(F.first("item_text").alias("item_text"), *firsts)


def _last_wins(rows: DataFrame) -> DataFrame:
    """rows(page_id, item, field, value): the last item of each field with a value."""
    return rows.where("field IS NOT NULL AND value <> ''").groupBy("page_id", "field").agg(F.max_by("value", "item").alias("value"))


def _first_key(label: Column, field_map: dict[str, str]) -> Column:
    """Struct (key, field) of the first key, in the order of the map, that the label contains."""
    hits = [F.when(label.contains(k), F.struct(F.lit(k).alias("key"), F.lit(f).alias("field"))) for k, f in field_map.items()]
    return F.coalesce(*hits)


def energy_letter(c: Column) -> Column:
    """The first letter A to G that stands alone."""
    return C.nullif_blank(F.upper(F.regexp_extract(c, r"(?i)\b([A-G])\b", 1)))


def name_value_pairs(nodes: DataFrame, item: str = ".detail", name: str = ".name", value: str = ".value", field_map: dict[str, str] | None = None, self_labels: list[str] = SELF_LABELS) -> DataFrame:
    """Detail rows: an empty value is read from the energy image; a label such as a business type is its own value."""
    rows = item_parts(nodes, item, name=name, value=value, img="img").where("name IS NOT NULL")
    source = F.coalesce(F.col("img.attrs")["src"], F.col("img.attrs")["data-src"])
    image = F.coalesce(energy_letter(F.col("img.attrs")["alt"]), C.nullif_blank(F.upper(F.regexp_extract(source, "(?i)energy[-_]([a-g])", 1))))
    rows = rows.withColumns({"hit": _first_key(F.lower("name.text"), field_map or FIELD_MAP), "own": F.coalesce(C.nullif_blank(F.col("value.text")), image)}).where("own IS NOT NULL")
    text = F.when(F.col("hit.key").isin(self_labels), F.initcap("hit.key")).otherwise(F.col("own"))
    return _last_wins(rows.select("page_id", "item", F.col("hit.field").alias("field"), text.alias("value")))


def divisions(nodes: DataFrame, item: str = "div.division", name: str = "div.name", value: str = "div.value", field_map: dict[str, str] | None = None) -> DataFrame:
    """Rows that need both a label and a value."""
    rows = item_parts(nodes, item, name=name, value=value)
    return _last_wins(rows.select("page_id", "item", _first_key(F.lower("name.text"), field_map or FIELD_MAP)["field"].alias("field"), F.col("value.text").alias("value")))


def area_pairs(nodes: DataFrame, item: str = ".area", name: str = ".name", value: str = ".value") -> DataFrame:
    rows = item_parts(nodes, item, name=name, value=value)
    return _last_wins(rows.select("page_id", "item", sections.area_kind(F.col("name.text")).alias("field"), F.col("value.text").alias("value")))


def summary_pairs(nodes: DataFrame, item: str = "li", name: str = "b,.name,.icon_label", value: str = ".value,.lbl_valor", field_map: dict[str, str] | None = None, self_labels: list[str] = SELF_LABELS) -> DataFrame:
    """Rows whose label without colon equals a key; without a value element the text behind the label counts."""
    rows = item_parts(nodes, item, name=name, value=value).where("name IS NOT NULL")
    label = F.lower(F.rtrim(F.regexp_replace("name.text", ":+$", "")))
    fields = F.create_map(*[F.lit(x) for pair in (field_map or SUMMARY_MAP).items() for x in pair])
    behind = F.expr("substring(item_text, locate(name.text, item_text) + length(name.text))")
    text = F.when(F.col("label").isin(self_labels), F.initcap("label")).when(F.col("value").isNotNull(), F.col("value.text")).otherwise(F.regexp_replace(behind, r"^[\s:]+|[\s:]+$", ""))
    return _last_wins(rows.withColumn("label", label).select("page_id", "item", fields[F.col("label")].alias("field"), text.alias("value")))


def element_values(nodes: DataFrame, selector: str, energy: bool = False) -> DataFrame:
    """(page_id, value) of the first match: own text, a telling attribute, the first image inside; for energy, its class."""
    return field_values(nodes, {"": selector}, {""} if energy else set()).drop("field")


def field_values(nodes: DataFrame, selectors: dict[str, str], energy: set[str]) -> DataFrame:
    """(page_id, field, value) of the first match of each field's selector, read as element_values() says; fields in `energy` as classes."""
    top = extract.select_firsts(nodes, selectors).select("page_id", "field", "node_id", F.struct("tag", "text", "attrs", "classes").alias("e"))
    inner = nodes.where("tag IN ('img', 'i')").select("page_id", F.explode(F.array_append("ancestors", F.col("node_id"))).alias("top"), "tag", "attrs", "classes", F.col("node_id").alias("n"))
    inner = inner.join(top.select("page_id", F.col("node_id").alias("top")), ["page_id", "top"], "left_semi")
    inner = inner.groupBy("page_id", F.col("top").alias("node_id")).agg(
        F.expr("min_by(attrs, n) FILTER (WHERE tag = 'img')").alias("img"), F.expr("min_by(classes, n) FILTER (WHERE tag = 'i' AND attrs['class'] LIKE '%energyClass%')").alias("marks")
    )
    rows = top.join(inner, ["page_id", "node_id"], "left")
    telling = [C.nullif_blank(F.trim(F.col("e.attrs")[a])) for a in ("content", "value", "alt", "title", "aria-label", "data-value")]
    image = [C.nullif_blank(F.trim(F.col("img")[a])) for a in ("alt", "title", "src", "data-src")]
    text = C.nullif_blank(F.col("e.text"))
    plain = F.coalesce(text, *telling, *image)
    letter = lambda c: F.coalesce(energy_letter(c), c)
    pictured = lambda c: F.coalesce(energy_letter(c), C.nullif_blank(F.upper(F.regexp_extract(c, "(?i)energy[-_]?([a-g])", 1))), c)
    named = F.create_map(*[F.lit(x) for k in "abcdefg" for x in (k, k.upper())], F.lit("aplus"), F.lit("A+"), F.lit("bminus"), F.lit("B-"), F.lit("b-"), F.lit("B-"))
    mark = F.get(F.filter(F.transform("marks", lambda c: named[F.lower(c)]), lambda c: c.isNotNull()), F.lit(0))
    classed = F.coalesce(letter(text), *map(letter, telling), *map(pictured, image), mark)
    return rows.select("page_id", "field", F.when(F.col("field").isin(*energy), classed).otherwise(plain).alias("value") if energy else plain.alias("value"))


def feature_values(nodes: DataFrame, selectors: dict[str, str]) -> DataFrame:
    """The first match's value of each feature's selector, else Yes."""
    return extract.select_firsts(nodes, selectors).select("page_id", "field", F.coalesce(extract.element_value(), F.lit("Yes")).alias("value"))


def feature_fallback(raw: DataFrame, text: str, features: dict[str, list[str]] | None = None) -> DataFrame:
    """Feature columns of `raw` that are blank become Yes if the page text has one of their words."""
    features = features or FEATURE_MAP
    return raw.withColumns({f: F.coalesce(C.nullif_blank(F.col(f)), F.when(C.contains_any(F.lower(text), words), "Yes")) for f, words in features.items()})


def layout_fallback(nodes: DataFrame, markers: list[str], candidates: dict[str, list[str]], description: list[str], features: dict[str, list[str]] | None = None) -> DataFrame:
    """Values of pages that have an element whose id contains a marker.

    Of each field the first candidate selector with a value counts; then features and the energy class from the
    description; then features from the text of the whole page.
    """
    features = features or FEATURE_MAP
    known = nodes.where(reduce(lambda a, b: a | b, [F.col("id").contains(m) for m in markers])).select("page_id").distinct()
    own = nodes.join(known, "page_id", "left_semi")
    ways = {f"{f} {k}": s for f, options in candidates.items() for k, s in enumerate(options)} | {f"description {k}": s for k, s in enumerate(description)}
    values = field_values(own, ways, {w for w in ways if w.startswith("energy_certificate ")}).where("value <> ''")
    values = values.select("page_id", F.substring_index("field", " ", 1).alias("field"), "value", F.substring_index("field", " ", -1).cast("int").alias("rank"))
    rows = [values.where("field <> 'description'")]
    told = values.where("field = 'description'").groupBy("page_id").agg(F.min_by("value", "rank").alias("text"))
    whole = own.where("parent_id IS NULL").groupBy("page_id").agg(F.min_by("text", "node_id").alias("text"))
    for rank, source in ((100, told), (200, whole)):
        hits = F.array_compact(F.array(*[F.when(C.contains_any(F.lower("text"), words), f) for f, words in features.items()]))
        rows.append(source.select("page_id", F.explode(hits).alias("field"), F.lit("Yes").alias("value"), F.lit(rank).alias("rank")))
    rows.append(told.select("page_id", F.lit("energy_certificate").alias("field"), energy_letter(F.col("text")).alias("value"), F.lit(100).alias("rank")).where("value IS NOT NULL"))
    return reduce(DataFrame.unionByName, rows).groupBy("page_id", "field").agg(F.min_by("value", "rank").alias("value"))


def extract_section(nodes: DataFrame, pages: DataFrame, site: dict) -> DataFrame:
    """Section mode of one site: each part gives values, and the part that comes first in PRECEDENCE wins a field."""
    parts: dict[str, list[DataFrame]] = {}
    put = lambda part, df: parts.setdefault(part, []).append(df.select("page_id", "field", "value"))
    single = {f: site[f"{f}_selector"] for f in ("title", "location", "condition") if site.get(f"{f}_selector")}
    if single:
        put("single", extract.select_firsts(nodes, single).select("page_id", "field", F.col("text").alias("value")))
    if site.get("description_selector"):
        long = sections.first_long(nodes, [s.strip() for s in site["description_selector"].split(",")])
        put("single", long.select("page_id", F.lit("raw_description").alias("field"), F.col("text").alias("value")))
    for field, pattern in site.get("text_patterns", {}).items():
        put("patterns", pages.select("page_id", F.lit(field).alias("field"), extract.text_pattern(pattern, "html").alias("value")))
    for part, pairs in (("summary", summary_pairs), ("details", name_value_pairs), ("areas", area_pairs), ("divisions", divisions)):
        if site.get(f"{part}_section"):
            put(part, pairs(within(nodes, site[f"{part}_section"])))
    if site.get("characteristics_section"):
        inside = within(nodes, site["characteristics_section"])
        words = {w: f for f, all_words in FEATURE_MAP.items() for w in all_words}
        put("characteristics", sections.characteristics(inside, site.get("characteristics_item_selector", "li"), words))
    if not parts:
        return nodes.select("page_id", F.lit("").alias("field"), F.lit("").alias("value")).where("false")
    ranked = [df.withColumn("rank", F.lit(PRECEDENCE.index(part))) for part, dfs in parts.items() for df in dfs]
    return reduce(DataFrame.unionByName, ranked).where("value <> ''").groupBy("page_id", "field").agg(F.min_by("value", "rank").alias("value"))


def extract_direct_long(nodes: DataFrame, site: dict) -> DataFrame:
    """Direct mode of one site: the first match of each `<field>_selector`."""
    selectors = {k.removesuffix("_selector"): s for k, s in site.items() if k.endswith("_selector") and not k.endswith("item_selector")}
    if not selectors:
        return nodes.select("page_id", F.lit("").alias("field"), F.lit("").alias("value")).where("false")
    return extract.select_firsts(nodes, selectors).select("page_id", "field", extract.element_value().alias("value")).where("value <> ''")


def extract_sites(nodes: DataFrame, pages: DataFrame, sites: DataFrame) -> DataFrame:
    """(page_id, site_key, field, value) of pages(page_id, site_key, html) by the settings of their site, in one plan for all sites.

    sites(site_key, mode, selectors map<string,string>, patterns map<string,string>): in section mode the keys of selectors are those
    of extract_section(), in any other mode each `<field>_selector` gives a field. Pages of unknown sites, and sites without settings,
    give nothing; a null map is empty; a pattern that is null gives nothing.
    """
    own = nodes.join(pages.select("page_id", "site_key"), "page_id")
    named = sites.select("site_key", F.coalesce(F.col("mode") == "section", F.lit(False)).alias("section"), F.explode("selectors").alias("name", "selector"))
    stem = lambda end: F.expr(f"left(name, length(name) - {len(end)})")
    ends = lambda end: F.endswith("name", F.lit(end))
    kind = (
        F.when(~F.col("section"), F.when(ends("_selector") & ~ends("item_selector"), F.concat(F.lit("direct:"), stem("_selector"))))
        .when(F.col("name").isin("title_selector", "location_selector", "condition_selector"), F.concat(F.lit("single:"), stem("_selector")))
        .when(ends("_section"), F.concat(F.lit("part:"), stem("_section"))).when(F.col("name") == "characteristics_item_selector", "item:")
    )
    plain = named.select("site_key", kind.alias("field"), "selector").where("field IS NOT NULL")
    long = named.where("section AND name = 'description_selector'").select("site_key", F.posexplode(F.split("selector", ",")).alias("rank", "selector"))
    listed = named.where("section AND name = 'characteristics_section'").select("site_key").join(named.where("name = 'characteristics_item_selector'"), "site_key", "left_anti")
    asked = plain.unionByName(long.select("site_key", F.concat(F.lit("long:"), "rank").alias("field"), "selector")).unionByName(listed.select("site_key", F.lit("item:").alias("field"), F.lit("li").alias("selector")))
    found = written(matching.matches(own, asked))
    of = lambda rows, kind: rows.where(F.startswith("field", F.lit(kind))).withColumn("field", F.substring("field", len(kind) + 1, 1000))
    firsts = matching.first_matches(found)
    values = firsts.where("field RLIKE '^(direct|single|long):'").join(nodes.select("page_id", "node_id", "text", "attrs"), ["page_id", "node_id"])
    direct = of(values, "direct:").select("page_id", "field", extract.element_value().alias("value"), F.lit(0).alias("rank"))
    parts: dict[str, list[DataFrame]] = {}
    put = lambda part, df: parts.setdefault(part, []).append(df.select("page_id", "field", "value"))
    put("single", of(values, "single:").select("page_id", "field", F.col("text").alias("value")))
    told = of(values, "long:").where("length(text) > 50").groupBy("page_id").agg(F.min_by("text", F.col("field").cast("int")).alias("value"))
    put("single", told.withColumn("field", F.lit("raw_description")))
    patterns = sites.where("mode = 'section'").select("site_key", F.explode("patterns").alias("field", "pattern"))
    text = C.nullif_blank(F.trim(F.call_function("regexp_extract", F.col("html"), F.concat(F.lit("(?isU)"), "pattern"), F.lit(1))))
    put("patterns", pages.join(patterns, "site_key").select("page_id", "field", text.alias("value")))
    tops = of(firsts, "part:").select("page_id", F.col("field").alias("_part"), F.col("node_id").alias("_top"))
    inside = lambda rows, part: rows.join(tops.where(F.col("_part") == part), "page_id").where(F.array_contains("ancestors", F.col("_top"))).drop("_part", "_top")
    for part, pairs in (("summary", summary_pairs), ("details", name_value_pairs), ("areas", area_pairs), ("divisions", divisions)):
        put(part, pairs(inside(nodes, part)))
    items = nodes.join(of(found, "item:").select("page_id", "node_id"), ["page_id", "node_id"])
    put("characteristics", sections.characteristic_values(inside(items, "characteristics"), {w: f for f, words in FEATURE_MAP.items() for w in words}))
    ranked = [direct, *[df.withColumn("rank", F.lit(PRECEDENCE.index(part))) for part, dfs in parts.items() for df in dfs]]
    best = reduce(DataFrame.unionByName, ranked).where("value <> ''").groupBy("page_id", "field").agg(F.min_by("value", "rank").alias("value"))
    return best.join(pages.select("page_id", "site_key"), "page_id").select("page_id", "site_key", "field", "value")


def card_fields(nodes: DataFrame, selectors: dict[str, str]) -> DataFrame:
    """Text of the first match of each field on a card, wide."""
    return extract.select_firsts(nodes, selectors).groupBy("page_id").pivot("field", list(selectors)).agg(F.first("text"))


def meta_values(nodes: DataFrame, most: int = 160) -> DataFrame:
    """(page_id, titles, prices): distinct contents of the sharing tags in document order, white space collapsed, cut at `most`."""
    kind, name = F.col("attrs")["property"], F.col("attrs")["name"]
    field = F.when((kind == "og:title") | (name == "twitter:title"), "title").when(kind.isin("product:price:amount", "og:price:amount", "og:price"), "price")
    text = F.substring(F.trim(F.regexp_replace(F.col("attrs")["content"], r"\s+", " ")), 1, most)
    rows = nodes.where("tag = 'meta'").select("page_id", "node_id", field.alias("field"), text.alias("value")).where("field IS NOT NULL AND value <> ''")
    listed = lambda f: F.array_distinct(F.transform(F.array_sort(F.collect_list(F.when(F.col("field") == f, F.struct("node_id", "value")))), lambda x: x["value"]))
    return rows.groupBy("page_id").agg(listed("title").alias("titles"), listed("price").alias("prices"))


def type_from_jsonld(types: Column) -> Column:
    """Property type of an array of type names; the first known name counts."""
    known = F.create_map(*[F.lit(x) for pair in (("house", "House"), ("singlefamilyresidence", "House"), ("residence", "Residence"), ("apartment", "Apartment")) for x in pair])
    return F.get(F.filter(F.transform(types, lambda t: known[F.lower(t)]), lambda t: t.isNotNull()), F.lit(0))


def typology_from(*texts: Column) -> Column:
    return F.coalesce(*[C.nullif_blank(F.upper(F.regexp_extract(t, r"(?i)\bT\d+(?:\+\d+)?\b", 0))) for t in texts])


def address_from(text: Column) -> Column:
    """District, county and parish: the first three parts of a comma list, blank parts left out."""
    parts = F.filter(F.transform(F.split(text, ","), lambda p: F.trim(F.regexp_replace(p, r"\s+", " "))), lambda p: p != "")
    return F.struct(*[F.get(parts, F.lit(k)).alias(n) for k, n in enumerate(("district", "county", "parish"))])


def dry_run(raw: DataFrame, canonical: dict[str, Column], critical: list[str], chars: int = 300, items: int = 10) -> DataFrame:
    """`raw` with long strings and lists cut, and `missing_critical`: critical fields blank in it and in the normalised columns."""
    cut = {}
    for name, kind in raw.dtypes:
        if kind == "string":
            cut[name] = F.substring(name, 1, chars)
        elif kind == "array<string>":
            cut[name] = F.transform(F.slice(name, 1, items), lambda x: F.substring(x, 1, chars))
    filled = lambda c: F.coalesce(F.trim(c.cast("string")), F.lit("")) != ""
    gone = [F.when(~filled(F.col(c)) & ~(filled(canonical[c]) if c in canonical else F.lit(False)), c) for c in critical]
    return raw.withColumn("missing_critical", F.array_compact(F.array(*gone))).withColumns(cut)
