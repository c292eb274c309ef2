"""The whole canonical record of a listing, from raw fields by the rules of its partner's family, and the flat listing row.

raw holds text columns of RAW (arrays: images, alt_texts) and source_partner; those that are missing count as null, further ones go
along in the payload only. Blank texts count as missing. partners(source_partner, family) says which family a partner is of; rows of
partners without a known family have a null record and an `error`.

Families differ in what they read: `plain` has its places as fields; `hierarchy` splits a location at >, and takes a missing district
from the county; `comma` splits it at commas, and turns down places that read like a sentence; `mixed` splits at either; `url` takes
places from folders of the url, and cuts its location out of the title.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from listmill.functions import columns as C
from listmill.sources import tables

RAW = [
    "url", "title", "price", "business_type", "business_state", "property_type", "typology", "bedrooms", "bathrooms", "floor", "construction_year", "area", "useful_area", "gross_area", "land_area", "district", "county", "parish",
    "location", "full_address", "property_id", "reference", "condition", "energy_certificate", "garage", "elevator", "balcony", "air_conditioning", "swimming_pool", "raw_description", "page_title", "meta_description", "headers",
    "advertiser", "contacts",
]
LISTS = ["images", "alt_texts"]
FAMILIES = ["plain", "hierarchy", "comma", "mixed", "url"]
COUNTRY = "Portugal"
# Property types that titles begin with (hierarchy, comma) or hold (mixed), in order (fixed values).
TYPES = {
    "hierarchy": ["Moradia Geminada", "Moradia", "Apartamento", "Loja", "Escritório", "Armazém", "Terreno", "Garagem", "Lote", "Quintal", "Quinta"],
    "comma": ["Moradia Geminada", "Moradia", "Apartamento", "Loja", "Escritório", "Armazém", "Terreno", "Garagem", "Quintal"],
    "mixed": ["Moradia Geminada", "Moradia", "Apartamento", "Loja", "Escritório", "Armazém", "Terreno", "Garagem"],
}
# Most partners that are sent to every task.
MOST = 100_000
# Most characters of the listing row's texts (fixed values).
LIMITS = {
    "partner_id": 255, "source_partner": 50, "source_url": 2048, "title": 500, "business_type": 20, "property_type": 50, "typology": 10, "floor": 20, "price_currency": 3, "district": 100, "county": 100, "parish": 100,
    "full_address": 500, "energy_certificate": 20, "advertiser": 255, "contacts": 500, "page_title": 500,
}
FLAGS = {"has_garage": "garage", "has_elevator": "elevator", "has_balcony": "balcony", "has_air_conditioning": "air_conditioning", "has_pool": "swimming_pool"}
# Columns of an export, in order (fixed values).
EXPORTED = [
    "id", "partner_id", "source_partner", "source_url", "title", "business_type", "property_type", "typology", "bedrooms", "bathrooms", "floor", "price_amount", "price_currency", "price_per_m2", "area_useful_m2", "area_gross_m2",
    "area_land_m2", "district", "county", "parish", "full_address", "latitude", "longitude", "has_garage", "has_elevator", "has_balcony", "has_air_conditioning", "has_pool", "energy_certificate", "construction_year", "advertiser",
    "contacts", "description", "description_quality_score", "meta_description", "created_at", "updated_at",
]


def _text(c: str) -> Column:
    return F.when(F.col(c) != "", F.col(c))


def _collapsed(c: Column, most: int | None = None) -> Column:
    return C.clean_text(c, most)


def _at(parts: Column, k: int) -> Column:
    """The k-th part of a split text, from behind if k is negative; a blank one counts as missing."""
    return C.nullif_blank(F.trim(F.try_element_at(parts, F.lit(k))))


def _by_arrows(area: Column) -> tuple[Column, Column, Column]:
    """Region, city and area of a location split at >; of fewer than three parts the first is the city."""
    parts, n = F.col("_arrows"), F.size("_arrows")
    return F.when(n >= 3, _at(parts, 1)), F.when(n >= 3, _at(parts, 2)).otherwise(_at(parts, 1)), F.coalesce(area, F.when(n > 1, _at(parts, -1)))


#: What several rules read of a raw row, made once for each row.
COMMON = {
    "_location": lambda: _collapsed(F.col("location")), "_district": lambda: _collapsed(_text("district"), 100), "_county": lambda: _collapsed(_text("county"), 100), "_parish": lambda: _collapsed(_text("parish"), 100), "_folders": lambda: C.addr_url(F.col("url")),
    "_amount": lambda: C.price_amount(F.col("price")), "_asked": lambda: C.on_request(F.col("price")), "_gross": lambda: C.area(F.col("gross_area")),
}
#: The same, made of those.
COMMON_PARTS = {
    "_arrows": lambda: F.split("_location", ">"), "_commas": lambda: F.split("_location", ","), "_clean_title": lambda: C.title_without(F.col("title"), F.col("_location")),
    "_currency": lambda: F.when(F.col("_amount").isNotNull(), C.currency(F.col("price"))),
}


def _address(family: str) -> Column:
    """Region, city, area and full address of a raw row with COMMON."""
    location = F.col("_location")
    region, city, area = (_text(c) for c in ("district", "county", "parish"))
    full = F.left(location, F.lit(500))
    if family == "plain":
        full = F.lit(None).cast("string")
    elif family == "hierarchy":
        region, city, area = F.col("_district"), F.col("_county"), F.col("_parish")
        read = city.isNull() & location.isNotNull()
        r, c, a = _by_arrows(area)
        r = F.when(F.size("_arrows") >= 3, r).otherwise(region)
        region, city, area = (F.left(F.when(read, x).otherwise(old), F.lit(100)) for x, old in ((r, region), (c, city), (a, area)))
        region = F.coalesce(region, city)
    elif family == "comma":
        parts = C.address_parts(location, ",")
        region, city = F.coalesce(F.col("_district"), F.left(_at(parts, 1), F.lit(100))), F.coalesce(F.col("_county"), F.left(_at(parts, 2), F.lit(100)))
        area = F.when(~C.contains_any(F.lower("_parish"), C.SENTENCE), F.col("_parish"))
        full = _collapsed(F.col("full_address"), 500)
    elif family == "mixed":
        neither, no_city = region.isNull() & city.isNull(), city.isNull() & location.isNotNull()
        r, c, a = _by_arrows(area)
        by_comma = neither & location.contains(",")
        by_arrow = (neither | no_city) & location.contains(">") & ~by_comma
        new_region = F.when(by_comma, _at(F.col("_commas"), 1)).when(by_arrow & (F.size("_arrows") >= 3), r).otherwise(region)
        new_city = F.when(by_comma, _at(F.col("_commas"), -1)).when(by_arrow, c).when(neither | no_city, location).otherwise(city)
        region, city, area = new_region, new_city, F.when(by_arrow, a).otherwise(area)
    else:
        found, listed = F.col("_folders.district").isNotNull(), location.contains(",")
        region = F.col("_folders.district")
        city = F.when(found, F.col("_folders.county")).when(listed, _at(F.col("_commas"), -1)).otherwise(location)
        area = F.when(found, F.col("_folders.parish")).when(listed, _at(F.col("_commas"), 1))
    return F.struct(F.lit(COUNTRY).alias("country"), region.alias("region"), city.alias("city"), area.alias("area"), full.alias("full_address"))


def _type_by_title(family: str) -> Column:
    """Property type that the title tells, for the families that ask it."""
    told = [C.type_from_list(F.col("title"), TYPES[family], begins=family != "mixed")]
    if family == "hierarchy":
        told += [F.when(F.col("title").rlike(rf"(?iU)\b{letter}\d+\b"), kind) for letter, kind in (("T", "Apartamento"), ("V", "Moradia"))]
    return F.coalesce(*told)


def _unlabelled(c: str) -> Column:
    return C.nullif_blank(F.trim(F.regexp_replace(c, r"^[^:]+:\s*", "")))


def _parts(family: str) -> dict[str, Column]:
    """What a family reads in its own way."""
    none, is_url = F.lit(None).cast("string"), family == "url"
    own_id = F.coalesce(_text("property_id"), _text("reference")) if family in ("plain", "hierarchy") else _text("property_id")
    if family == "hierarchy":
        own_id = C.nullif_blank(F.trim(F.regexp_replace(own_id, r"^Ref\.\s*", "")))
    kept = family in ("plain", "comma")
    title = F.col("_clean_title") if is_url else F.col("title")
    by_title = C.typology_from_title(F.col("_clean_title"))
    beds = C.bedrooms(F.coalesce(F.col("_clean_title"), F.col("title")) if is_url else F.col("typology"))
    seo = C.drop_empty({c: F.col(c) for c in ("page_title", "meta_description", "headers")})
    return {
        "partner_id": _unlabelled("property_id") if is_url else own_id,
        "business_type": C.business_type(F.coalesce(_text("business_type"), _text("business_state")), F.col("url") if is_url else none),
        "property_type": F.coalesce(_text("property_type"), _type_by_title(family)) if family in TYPES else _text("property_type"),
        "title": title, "bedrooms": F.coalesce(C.first_int(F.col("bedrooms")), beds), "floor": F.col("floor") if family in ("plain", "hierarchy", "comma") else none,
        "construction_year": F.lit(None).cast("int") if family == "mixed" else C.first_int(F.col("construction_year")),
        "area_useful_m2": C.area(F.coalesce(_text("area"), _text("useful_area")) if family == "hierarchy" else F.col("useful_area")),
        "address": _address(family), "advertiser": F.col("advertiser") if kept else none, "contacts": F.col("contacts") if kept else none,
        "is_new_construction": C.is_new(F.col("condition")) if family == "comma" else F.lit(None).cast("boolean"),
        "seo": F.when(F.size(seo) > 0, seo) if family == "comma" else F.lit(None).cast("map<string,string>"),
        "payload_condition": F.coalesce(_unlabelled("condition"), F.when(F.coalesce(_text("typology"), by_title).isNull(), F.col("condition"))) if is_url else F.col("condition"),
        "payload_typology": F.coalesce(_text("typology"), by_title) if is_url else F.col("typology"),
    }


def _small(partners: DataFrame) -> DataFrame:
    """Broadcast if counted as small: a shuffle by partner would leave the rows of one to one task."""
    return F.broadcast(partners) if partners.limit(MOST + 1).count() <= MOST else partners


def _known() -> Column:
    return F.coalesce(F.col("family").isin(FAMILIES), F.lit(False))


def _made(raw: DataFrame, partners: DataFrame) -> tuple[list[str], DataFrame, Column]:
    """Key columns, raw rows with what the rules of their family make of them, and the record as a column of these."""
    keys = [c for c in raw.columns if c not in (*RAW, *LISTS, "source_partner")]
    rows = raw.select(*keys, "source_partner", *[F.col(c).cast("string").alias(c) if c in raw.columns else F.lit(None).cast("string").alias(c) for c in RAW],
                      *[F.col(c) if c in raw.columns else F.lit(None).cast("array<string>").alias(c) for c in LISTS])
    rows = rows.join(_small(partners.select("source_partner", "family")), "source_partner", "left")
    rows = rows.withColumns({c: make() for c, make in COMMON.items()})
    rows = rows.withColumns({c: make() for c, make in COMMON_PARTS.items()})
    by_family = {f: _parts(f) for f in FAMILIES}

    def own(name: str) -> Column:
        return F.coalesce(*[F.when(F.col("family") == f, parts[name]) for f, parts in by_family.items()])

    rows = rows.withColumns({f"_{name}": own(name) for name in by_family["plain"]})
    amount, currency, gross = F.col("_amount"), F.col("_currency"), F.col("_gross")
    ratio = C.price_per_m2(amount, gross, F.col("_area_useful_m2"))
    texts = C.drop_empty({"raw": F.col("raw_description"), "pt": C.clean_description(F.col("raw_description"))})
    payload = [F.col(f"_payload_{c}").alias(c) if c in ("condition", "typology") else F.col(c) for c in (*RAW, *LISTS)]
    flags = [C.tri_bool(F.col(c)).alias(name) for name, c in FLAGS.items()]
    record = F.struct(
        F.col("_partner_id").alias("partner_id"), "source_partner", F.col("url").alias("source_url"), F.col("_title").alias("title"), F.col("_business_type").alias("business_type"), F.col("_property_type").alias("property_type"),
        "typology", F.col("_bedrooms").alias("bedrooms"), C.first_int(F.col("bathrooms")).alias("bathrooms"), F.col("_floor").alias("floor"), F.col("_construction_year").alias("construction_year"),
        F.struct(amount.alias("amount"), currency.alias("currency")).alias("price"), F.when(ratio.isNotNull(), F.struct(ratio.alias("amount"), currency.alias("currency"))).alias("price_per_m2"),
        F.coalesce("_asked", F.lit(False)).alias("price_on_request"), F.col("_area_useful_m2").alias("area_useful_m2"), gross.alias("area_gross_m2"), C.area(F.col("land_area")).alias("area_land_m2"),
        F.col("_address").alias("address"), F.lit(None).cast("double").alias("latitude"), F.lit(None).cast("double").alias("longitude"), C.media_array(F.coalesce("images", F.array().cast("array<string>")), F.coalesce("alt_texts", F.array().cast("array<string>"))).alias("media"),
        F.struct(*flags, F.col("_is_new_construction").alias("is_new_construction")).alias("features"), texts.alias("descriptions"), F.lit(None).cast("int").alias("description_quality_score"), F.col("_seo").alias("seo"), "energy_certificate",
        F.col("_advertiser").alias("advertiser"), F.col("_contacts").alias("contacts"), F.to_json(F.struct(*payload)).alias("raw_partner_payload"),
    )
    return keys, rows, record


def build_canonical(raw: DataFrame, partners: DataFrame) -> DataFrame:
    """Raw rows as nested records: (key columns of raw beyond RAW, LISTS and source_partner), source_partner, record, error."""
    keys, rows, record = _made(raw, partners)
    error = F.when(~_known(), F.concat(F.lit("unknown partner: "), F.coalesce("source_partner", F.lit(""))))
    return rows.select(*keys, "source_partner", F.when(_known(), record).alias("record"), error.alias("error"))


def listing_rows(raw: DataFrame, partners: DataFrame, job: Column) -> DataFrame:
    """to_listing() of build_canonical(); members of the record that no column reads are not made."""
    keys, rows, record = _made(raw, partners)
    return _flat(rows.where(_known()).select(*keys, record.alias("record")), keys, job)


def to_listing(canonical: DataFrame, job: Column) -> DataFrame:
    """Records as flat listing rows with all columns of the table; texts of LIMITS collapsed and cut; rows without a record are left out."""
    keys = [c for c in canonical.columns if c not in ("record", "error", "source_partner")]
    # behind the explosion a record stands made; else each column would make its own
    return _flat(canonical.where("error IS NULL").select(*keys, F.explode(F.array("record")).alias("record")), keys, job)


def _flat(records: DataFrame, keys: list[str], job: Column) -> DataFrame:
    r = lambda path: F.col(f"record.{path}")
    seo = lambda c: F.try_element_at(r("seo"), F.lit(c))
    columns = {c: r(c) for c in ("partner_id", "source_partner", "source_url", "title", "business_type", "property_type", "typology", "bedrooms", "bathrooms", "floor")}
    columns |= {"price_amount": F.when(r("price.amount") != 0, r("price.amount")), "price_currency": F.coalesce(r("price.currency"), F.lit("EUR")), "price_per_m2": r("price_per_m2.amount")}
    columns |= {c: r(c) for c in ("price_on_request", "area_useful_m2", "area_gross_m2", "area_land_m2")}
    columns |= {"district": r("address.region"), "county": r("address.city"), "parish": r("address.area"), "full_address": r("address.full_address"), "latitude": r("latitude"), "longitude": r("longitude")}
    columns |= {c: r(f"features.{c}") for c in FLAGS} | {c: r(c) for c in ("energy_certificate", "construction_year", "advertiser", "contacts")}
    told = lambda c: F.try_element_at(r("descriptions"), F.lit(c))
    columns |= {"raw_description": told("raw"), "description": told("pt"), "description_quality_score": r("description_quality_score"), "page_title": seo("page_title"), "headers": seo("headers"), "meta_description": seo("meta_description")}
    columns |= {"raw_payload": r("raw_partner_payload"), "scrape_job_id": job}
    columns |= {c: _collapsed(columns[c], most) for c, most in LIMITS.items()}
    return records.select(*keys, *[v.alias(c) for c, v in columns.items()])


def export_listings(listings: DataFrame) -> DataFrame:
    """The columns of an export, in order, as plain values; those that the table lacks are null."""
    rows = tables.export_rows(listings.select(*[c for c in EXPORTED if c in listings.columns]))
    return rows.select(*[F.col(c) if c in rows.columns else F.lit(None).cast("string").alias(c) for c in EXPORTED])
