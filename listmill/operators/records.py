"""Records: partner rules, canonical and flat listings, validation, CRM payloads, model output, logs."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from listmill.functions import columns as C
from listmill.sources.tables import written

# Codes of the remote system (fixed values).
BUSINESS = {"sale": "To Buy", "rent": "To Rent"}
PROPERTY = {
    "apartment": "Apartment", "apartamento": "Apartment", "house": "House", "moradia": "House", "moradia geminada": "House", "land": "Land", "terreno": "Lot",
    "commercial": "Commercial", "loja": "Commercial", "escritório": "Commercial", "office": "Office", "garage": "Garage", "garagem": "Garage",
}
CONDITION = {"new": "New", "novo": "New", "used": "Used", "usado": "Used", "renovated": "Renovated", "renovado": "Renovated"}
# Level of each key of a stored log, and words of a title that tell the property type, in order (fixed values).
LEVELS = {"errors": "error", "error": "error", "warnings": "warning", "warning": "warning", "info": "info", "infos": "info"}
TITLE_TYPES = {"moradia": "Moradia", "apartamento": "Apartamento", "loja": "Loja", "escrit[oó]rio": "Escritório", "armaz[eé]m": "Armazém", "terreno": "Terreno", "garagem": "Garagem", "quinta|quintinha": "Quintinha"}

OUTPUT = "struct<title:string,description:string,meta_description:string>"
MAX_IMAGES = 20

#: Address rule of each partner family: location text and page url -> struct of district, county and parish.
FAMILIES: dict[str, Callable[[Column, Column], Column]] = {}


def partner_rules(family: str):
    """Registers the address rule of a family."""

    def add(f):
        FAMILIES[family] = f
        return f

    return add


def _place(district: Column, county: Column, parish: Column) -> Column:
    return F.struct(district.alias("district"), county.alias("county"), parish.alias("parish"))


@partner_rules("comma")
def _comma(location: Column, url: Column) -> Column:
    parts = C.address_parts(location, ",")
    return _place(F.get(parts, F.lit(0)), F.get(parts, F.lit(1)), F.get(parts, F.lit(2)))


@partner_rules("hierarchy")
def _hierarchy(location: Column, url: Column) -> Column:
    a = C.addr_hier(location)
    return _place(a["region"], a["city"], a["area"])


@partner_rules("mixed")
def _mixed(location: Column, url: Column) -> Column:
    """Hierarchical with `>`, else by commas, else the whole text as county."""
    plain = _place(F.lit(None).cast("string"), C.nullif_blank(F.trim(location)), F.lit(None).cast("string"))
    return F.when(location.contains(">"), _hierarchy(location, url)).when(location.contains(","), _comma(location, url)).otherwise(plain)


@partner_rules("url")
def _url(location: Column, url: Column) -> Column:
    """Folders of the url; else the first part as parish and the last as county."""
    a, parts = C.addr_url(url), C.address_parts(location, ",")
    county = F.try_element_at(parts, F.lit(-1))
    return F.when(a["district"].isNotNull(), _place(a["district"], a["county"], a["parish"])).otherwise(_place(F.lit(None).cast("string"), county, F.when(F.size(parts) > 1, F.get(parts, F.lit(0)))))


def normalize(raw: DataFrame, rules: DataFrame) -> DataFrame:
    """raw(source_partner, location, source_url, ...) with `address` by the partner's family and `error` for unknown partners.

    rules(source_partner, family) is a mapping table of tens of rows.
    """
    out = raw.join(F.broadcast(rules), "source_partner", "left")
    address = None
    for family, rule in FAMILIES.items():
        one = rule(F.col("location"), F.col("source_url"))
        address = F.when(F.col("family") == family, one) if address is None else address.when(F.col("family") == family, one)
    known = F.coalesce(F.col("family").isin(list(FAMILIES)), F.lit(False))
    return out.withColumn("address", address).withColumn("error", F.when(~known, F.concat(F.lit("unknown partner: "), F.col("source_partner"))))


def build_canonical(raw: DataFrame) -> DataFrame:
    """raw(id, price, area, typology, garage, ...) -> nested record."""
    price = F.struct(C.price_amount(F.col("price")).alias("amount"), C.currency(F.col("price")).alias("currency"), C.on_request(F.col("price")).alias("on_request"))
    return raw.select(
        "id", price.alias("price"), F.struct(C.area(F.col("area")).alias("useful_m2")).alias("areas"), F.col("typology"), C.bedrooms(F.col("typology")).alias("bedrooms"),
        C.type_from_code(F.col("typology")).alias("property_type"), F.struct(C.tri_bool(F.col("garage")).alias("garage")).alias("features"),
    )


def to_listing(canonical: DataFrame, job: Column) -> DataFrame:
    """Nested record -> flat row; the currency is EUR by default."""
    amount, useful = F.col("price.amount"), F.col("areas.useful_m2")
    return canonical.select(
        "id", job.alias("scrape_job_id"), amount.alias("price_amount"), F.coalesce("price.currency", F.lit("EUR")).alias("price_currency"), F.col("price.on_request").alias("price_on_request"),
        useful.alias("area_useful_m2"), "typology", "bedrooms", "property_type", F.col("features.garage").alias("has_garage"),
        C.price_per_m2(amount, F.lit(None).cast("double"), useful).alias("price_per_m2"),
    )


def validation_errors() -> Column:
    """Names of the columns that break a rule, in order; null values pass, but for the partner."""
    low = {"bedrooms": 0, "bathrooms": 0, "construction_year": 1800, "area_useful_m2": 0}
    between = {"latitude": (-90, 90), "longitude": (-180, 180), "quality_score": (0, 100)}
    bad = {c: F.col(c) < least for c, least in low.items()} | {c: ~F.col(c).between(*ends) for c, ends in between.items()}
    bad["price_currency"] = F.length("price_currency") != 3
    bad["business_type"] = ~F.col("business_type").isin("sale", "rent")
    bad["source_partner"] = ~F.coalesce(F.regexp_replace("source_partner", "[-_]", "").rlike(r"^[\p{L}\p{N}]+$"), F.lit(False))
    return F.array_compact(F.array(*[F.when(b, F.lit(c)) for c, b in bad.items()]))


def validate(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid, quarantined with `reasons`)."""
    checked = rows.withColumn("reasons", validation_errors())
    return checked.where(F.size("reasons") == 0).drop("reasons"), checked.where(F.size("reasons") > 0)


def overlay_enriched(rows: DataFrame, translations: str, locale: str, fields: list[str]) -> DataFrame:
    """Stored translations of a locale over the fields where not blank; `is_enriched` if any translation is stored."""
    tr = F.try_element_at(F.col(translations), F.lit(locale))
    new = {f: F.coalesce(F.when(tr[f] != "", tr[f]), F.col(f)) for f in fields}
    return rows.withColumns(new | {"is_enriched": F.coalesce(F.size(translations) > 0, F.lit(False))})


def _code(c: Column, codes: dict[str, str]) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in codes.items() for x in pair]), F.lower(F.trim(c)))


def crm_codes(business: Column, kind: Column, condition: Column) -> Column:
    """Unknown business types are purchases, unknown property types stay, unknown conditions are null."""
    kind = F.when(kind != "", kind)
    sale = F.try_element_at(F.create_map(*[F.lit(x) for pair in BUSINESS.items() for x in pair]), business)
    return F.struct(F.coalesce(sale, F.lit("To Buy")).alias("business"), F.coalesce(_code(kind, PROPERTY), kind).alias("kind"), _code(condition, CONDITION).alias("state"))


def crm_payload(listings: DataFrame, media: DataFrame) -> DataFrame:
    """(id, payload): JSON for the remote system; null and empty members are left out, at most MAX_IMAGES images by position.

    Columns that listings lack count as null. Translations are those stored; without one for en, it is made of the listing's own texts.
    """
    order = F.array_sort(F.collect_list(F.struct(F.coalesce("position", F.lit(999)).alias("p"), "url")))
    images = media.where("url <> ''").groupBy(F.col("listing_id").alias("id")).agg(F.slice(F.transform(order, lambda m: m["url"]), 1, MAX_IMAGES).alias("images"))
    have = lambda c, kind="string": F.col(c) if c in listings.columns else F.lit(None).cast(kind)
    some = lambda c: F.when(have(c) != "", have(c))
    codes = crm_codes(F.col("business_type"), F.col("property_type"), have("condition"))
    price = F.when(F.col("price_amount").isNotNull(), F.struct(F.col("price_amount").cast("double").alias("price"), F.lit(True).alias("publishPrice")))
    lat, lng = have("latitude", "double"), have("longitude", "double")
    place = F.when(lat.isNotNull() & lng.isNotNull(), F.struct(lat.cast("string").alias("lat"), lng.cast("string").alias("lng"), F.lit(True).alias("publish")))
    held = lambda cells: F.when(F.coalesce(*[c.cast("string") for c, _ in cells]).isNotNull(), F.struct(*[c.alias(n) for c, n in cells]))
    areas = held([(have(f"area_{k}_m2", "double"), k) for k in ("useful", "gross", "land")])
    rooms = held([(have(k, "int"), k) for k in ("bedrooms", "bathrooms")])
    entry = lambda title, text, meta: F.struct(title.alias("title"), text.alias("description"), meta.alias("shortDescription"))
    stored = F.transform_values("translations", lambda k, v: entry(*[C.nullif_blank(v[f]) for f in ("title", "description", "meta_description")]))
    none = F.create_map().cast("map<string,struct<title:string,description:string,shortDescription:string>>")
    own = F.coalesce(F.map_filter(stored, lambda k, v: F.coalesce(v["title"], v["description"], v["shortDescription"]).isNotNull()), none)
    texts = entry(some("title"), some("description"), some("meta_description"))
    english = F.when(F.coalesce(*[some(c) for c in ("title", "description", "meta_description")]).isNotNull(), F.create_map(F.lit("en"), texts)).otherwise(none)
    told = F.when(F.map_contains_key(own, "en"), own).otherwise(F.map_concat(own, english))
    body = F.struct(
        codes["business"].alias("businessType"), F.lit("Available").alias("availability"), F.lit(True).alias("isActive"), some("partner_id").alias("reference"), some("title").alias("title"), some("description").alias("description"),
        some("meta_description").alias("shortDescription"), codes["kind"].alias("propertyType"), F.struct(F.lit("Portugal").alias("country"), some("district").alias("district"), some("county").alias("county"), some("parish").alias("parish")).alias("location"),
        price.alias("pricing"), place.alias("coordinates"), codes["state"].alias("state"), areas.alias("areas"), rooms.alias("rooms"), F.when(some("energy_certificate").isNotNull(), F.struct(some("energy_certificate").alias("class"))).alias("energy"),
        "images", F.when(F.size(told) > 0, told).alias("translations"),
    )
    return listings.join(images, "id", "left").select("id", F.to_json(body).alias("payload"))


def infer_keywords(*parts: Column) -> Column:
    """Trimmed values, the first of those equal but for case, in order."""
    given = F.filter(F.array_compact(F.transform(F.array(*parts), lambda x: F.trim(x))), lambda x: x != "")
    return F.aggregate(given, F.array().cast("array<string>"), lambda acc, x: F.when(F.exists(acc, lambda y: F.lower(y) == F.lower(x)), acc).otherwise(F.array_append(acc, x)))


def type_from_title(c: Column) -> Column:
    """The first of TITLE_TYPES whose word occurs, else null.

    The codes T2 and V3 are looked for in the lower-cased title with capitals and so never decide, as in the data model.
    """
    low, out = F.lower(c), F.lit(None).cast("string")
    for word, kind in reversed(TITLE_TYPES.items()):
        out = F.when(low.rlike(rf"(?U)\b({word})\b"), kind).otherwise(out)
    return out


def parse_model_output(c: Column) -> Column:
    """map locale -> OUTPUT of a model's answer: a fence is stripped, prose around the object cut; a list is keyed by its locale.

    Blank fields are null; an answer without JSON gives null.
    """
    text = F.trim(c)
    bare = F.trim(F.regexp_replace(F.regexp_replace(text, "^`+|`+$", ""), "^((?s).*?)json", "$1"))
    text = F.when(text.startswith("```"), bare).otherwise(text)
    kind = f"map<string,{OUTPUT}>"
    listed = F.from_json(text, f"array<struct<locale:string,{OUTPUT.removeprefix('struct<')}>")
    body = lambda x: F.struct(*[C.nullif_blank(x[f]).alias(f) for f in ("title", "description", "meta_description")])
    keyed = F.aggregate(
        F.filter(listed, lambda x: x["locale"].isNotNull()), F.create_map().cast(kind),
        lambda acc, x: F.map_zip_with(acc, F.create_map(x["locale"], F.struct(x["title"].alias("title"), x["description"].alias("description"), x["meta_description"].alias("meta_description"))), lambda k, a, b: F.coalesce(b, a)),
    )
    inner = F.from_json(F.regexp_extract(text, r"(?s)(\{.*\})", 1), kind)
    return F.transform_values(F.when(text.startswith("["), keyed).otherwise(F.coalesce(F.from_json(text, kind), inner)), lambda k, v: body(v))


def word_count(c: Column) -> Column:
    return F.size(F.filter(F.split(c, "[ \t\n\r\f]+"), lambda w: w != ""))


def output_faults(title: Column, description: Column, meta: Column) -> Column:
    """Rules that a generated text breaks: 250 to 400 words, a title of at most 60 characters, 140 to 155 characters of meta text."""
    return F.array_compact(F.array(
        F.when(~word_count(description).between(250, 400), F.lit("description")), F.when(F.length(title) > 60, F.lit("title")), F.when(~F.length(meta).between(140, 155), F.lit("meta_description")),
    ))


def flatten_logs(jobs: DataFrame, logs: str = "logs") -> DataFrame:
    """One row for each entry of a job's log map, with its level; unknown keys are dropped."""
    rows = jobs.select("job_id", F.explode(logs).alias("key", "entries")).withColumn("level", _code(F.col("key"), LEVELS))
    return rows.where("level IS NOT NULL").select("job_id", "level", F.explode("entries").alias("entry"))


def split_meta(c: Column) -> Column:
    """A score map -> struct of the scores and the entry _meta."""
    return F.struct(F.map_filter(c, lambda k, v: k != "_meta").alias("scores"), F.try_element_at(c, F.lit("_meta")).alias("meta"))


def strip_quotes(c: Column) -> Column:
    """Text that was once stored as a JSON string, without the quotes around it."""
    return F.when(c.rlike('(?s)^".*"$') & (F.length(c) > 1), c.substr(F.lit(2), F.length(c) - 2)).otherwise(c)


def migrate(df: DataFrame, steps: list[tuple]) -> DataFrame:
    """df after repairs in order: ("rename", old, new), ("unquote", column), ("cut", column, most), ("tail", column, last),
    ("to_json", column) for nested values to JSON text, ("from_json", column, type) back, ("cast", column, type; null where it fails),
    ("default", column, value) for nulls, ("drop", column)."""
    for kind, column, *rest in steps:
        c = F.col(column)
        if kind == "rename":
            df = df.withColumnRenamed(column, rest[0])
        elif kind == "drop":
            df = df.drop(column)
        else:
            new = {
                "unquote": lambda: F.expr(f"trim(BOTH '\"' FROM CAST(`{column}` AS STRING))"), "cut": lambda: F.left(c, F.lit(rest[0])), "tail": lambda: F.right(c, F.lit(rest[0])), "to_json": lambda: F.to_json(c),
                "from_json": lambda: F.from_json(c, rest[0]), "cast": lambda: c.try_cast(rest[0]), "default": lambda: F.coalesce(c, F.lit(rest[0])),
            }[kind]
            df = df.withColumn(column, new())
    return df


def bulk_enrich(listings: DataFrame, generate: Callable[[str], str], locales: list[str], prompt: Column, stored: str = "enriched_translations", ids: DataFrame | None = None, most: int | None = None, force: bool = False) -> tuple[DataFrame, DataFrame]:
    """(listings with new translations, results(id, status, locales, error)).

    Chosen are the rows of ids(id), or those without translations, oldest first, at most `most` (null: all). Of each the locales
    that are missing (all, with force) are asked for in one call; what comes back is laid over what is stored. Listings of which
    nothing is missing are skipped, ids that do not exist too; an answer without any of the locales, or an exception, is an error.
    """
    none = F.create_map().cast(f"map<string,{OUTPUT}>")
    if ids is not None:
        chosen = ids.select("id").distinct()
    else:
        todo = listings.where(F.coalesce(F.size(stored), F.lit(0)) <= 0).orderBy("created_at", "id")
        chosen = (todo.limit(most) if most is not None else todo).select("id")
    chosen = written(chosen)
    kept = F.coalesce(F.col(stored), none)
    wanted = F.filter(F.array(*map(F.lit, locales)), lambda x: F.lit(force) | F.coalesce(F.try_element_at(kept, x)["title"], F.lit("")).eqNullSafe(""))
    plan = listings.join(chosen, "id").select("id", wanted.alias("wanted"), prompt.alias("prompt"))
    asked = enrich(plan.where(F.size("wanted") > 0), generate)
    parsed = F.coalesce(parse_model_output(F.col("answer")), none)
    new = F.map_filter(parsed, lambda k, v: F.array_contains("wanted", k) & (F.coalesce(v["title"], v["description"], v["meta_description"]).isNotNull()))
    done = asked.select("id", new.alias("_new"), F.coalesce("error", F.when(F.size(new) == 0, "no translation in the answer")).alias("error"))
    done = written(done)
    results = chosen.join(done, "id", "left").join(listings.select("id", F.lit(True).alias("_there")), "id", "left")
    status = F.when(F.col("_there").isNull() | F.col("_new").isNull(), "skipped").when(F.col("error").isNotNull(), "error").otherwise("enriched")
    results = results.select("id", status.alias("status"), F.when(status == "enriched", F.array_sort(F.map_keys("_new"))).otherwise(F.array().cast("array<string>")).alias("locales"), F.when(F.col("_there").isNull(), "not found").otherwise(F.col("error")).alias("error"))
    after = listings.join(done.where("error IS NULL").select("id", "_new"), "id", "left")
    merged = F.when(F.col("_new").isNotNull(), F.map_zip_with(kept, F.coalesce("_new", none), lambda k, a, b: F.coalesce(b, a))).otherwise(F.col(stored))
    return after.withColumn(stored, merged).drop("_new"), results


def enrich(rows: DataFrame, generate: Callable[[str], str], prompt: str = "prompt") -> DataFrame:
    """rows with `answer` and `error`: the caller's provider on each prompt; its exceptions become the row's error."""
    kept = [c for c in rows.columns if c != prompt]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def one(text):
            try:
                return generate(text), None
            except Exception as e:  # noqa: BLE001  a provider may raise anything
                return None, str(e)

        for batch in batches:
            both = [one(t) for t in batch[prompt]]
            yield batch[kept].assign(answer=[b[0] for b in both], error=[b[1] for b in both])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name in kept)
    return rows.mapInPandas(run, f"{schema}, answer string, error string")


# Names of languages in a prompt (fixed values).
LANGUAGES = {"en": "English", "pt": "European Portuguese", "es": "Spanish", "fr": "French", "de": "German"}


def build_prompt(columns: list[str], keywords: Column, locales: list[str]) -> Column:
    """Thirteen labelled lines of a listing, its keywords and the languages asked for; null, missing columns and 0 read as blank."""
    have = lambda c: F.col(c).cast("string") if c in columns else F.lit(None).cast("string")
    of = lambda c: F.coalesce(F.when(have(c).try_cast("double").eqNullSafe(0.0), F.lit("")).otherwise(have(c)), F.lit(""))
    flag = lambda c: F.concat(F.lit(f"{c}="), F.coalesce(F.initcap(have(f"has_{c}")), F.lit("None")))
    line = lambda label, *parts: F.concat(F.lit(f"{label}: "), *parts)
    lines = [line(k, of(c)) for k, c in {"Title": "title", "Property type": "property_type", "Typology": "typology", "Bedrooms": "bedrooms", "Bathrooms": "bathrooms"}.items()]
    lines += [line("Price", of("price_amount"), F.lit(" "), of("price_currency")), line("Area (useful)", of("area_useful_m2"), F.lit(" m²"))]
    lines += [line(k, of(c)) for k, c in {"District": "district", "County": "county", "Parish": "parish", "Energy certificate": "energy_certificate"}.items()]
    lines.append(line("Features", F.concat_ws(", ", *[flag(c) for c in ("garage", "pool", "elevator", "balcony")])))
    lines.append(line("Description", F.coalesce(F.when(have("description") != "", have("description")), of("raw_description"))))
    rest = F.array_join(F.slice(keywords, 2, F.greatest(F.size(keywords), F.lit(1))), ", ")
    none = "None provided"
    lines += [line("Primary keyword", F.coalesce(F.get(keywords, F.lit(0)), F.lit(none))), line("Secondary keywords", F.when(F.size(keywords) > 1, rest).otherwise(none))]
    lines.append(F.lit("Locales: " + ", ".join(f"{x} ({LANGUAGES.get(x, x)})" for x in locales)))
    return F.concat_ws("\n", *lines)
