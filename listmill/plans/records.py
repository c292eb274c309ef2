"""Queries of records: partner rules, canonical rows, validation, CRM, model output, logs, and further writes."""

from __future__ import annotations

from pyspark.sql import functions as F

from listmill.functions import columns as C
from listmill.operators import canonical, merge, query, records
from listmill.plans.registry import STOP, q
from listmill.sources.bindings import table, view
from listmill.streaming import jobs

# Expressions that both engines read, on listings_v.
RAW_KIND = "CASE id % 6 WHEN 0 THEN ' Apartamento ' WHEN 1 THEN 'TERRENO' WHEN 2 THEN 'loja' WHEN 3 THEN 'castle' WHEN 4 THEN '' END"
FAMILY = "CASE source_partner WHEN 'building' THEN 'comma' WHEN 'automobile' THEN 'hierarchy' WHEN 'furniture' THEN 'mixed' WHEN 'household' THEN 'url' END"
LOCATION = """CASE WHEN source_partner = 'building' OR (source_partner = 'furniture' AND id % 3 = 0) THEN concat(district, ' , ', county, ',', typology)
 WHEN source_partner = 'automobile' OR (source_partner = 'furniture' AND id % 3 = 1) THEN concat(district, ' > ', county, ' > ', typology) WHEN source_partner = 'household' THEN concat(typology, ', ', county) ELSE concat(' ', county) END"""
URL = "CASE WHEN id % 2 = 0 THEN concat('https://x.test/Imovel/a/b/', replace(district, ' ', '-'), '/', replace(county, ' ', '-'), '/', typology, '/', CAST(id AS STRING)) ELSE 'https://x.test/p' END"


@q(f"""SELECT id, CASE WHEN f IS NULL THEN NULL WHEN f = 'url' AND id % 2 = 1 THEN NULL WHEN f = 'mixed' AND id % 3 = 2 THEN NULL ELSE district END AS district, CASE WHEN f IS NOT NULL THEN county END AS county,
 CASE WHEN f IS NULL OR (f = 'mixed' AND id % 3 = 2) THEN NULL ELSE typology END AS parish, CASE WHEN f IS NULL THEN concat('unknown partner: ', source_partner) END AS error
FROM (SELECT *, {FAMILY} AS f FROM listings_v) x""")
def c26_partner_rules(spark, d):
    rows = view(spark, d, "listings_v").select("id", "source_partner", F.expr(LOCATION).alias("location"), F.expr(URL).alias("source_url"))
    rules = view(spark, d, "sites_v").select(F.col("key").alias("source_partner"), F.expr(FAMILY.replace("source_partner", "key")).alias("family"))
    return records.normalize(rows, rules).select("id", "address.*", "error")


@q("""SELECT id, CASE WHEN id % 3 = 0 THEN county ELSE district END AS region, county AS city, CASE WHEN id % 3 = 0 THEN typology ELSE typology END AS area FROM listings_v""")
def c13_addr_hier(spark, d):
    text = F.expr("CASE WHEN id % 3 = 0 THEN concat(county, ' > ', typology) ELSE concat(district, '>', county, ' >', typology) END")
    a = C.addr_hier(text)
    return view(spark, d, "listings_v").select("id", a["region"].alias("region"), a["city"].alias("city"), a["area"].alias("area"))


@q("SELECT id, partner_id AS ref, typology AS label, title AS plain, typology AS short FROM listings_v")
def c16_prefix_and_title(spark, d):
    rows = view(spark, d, "listings_v")
    short = C.title_without(F.concat_ws(" ", "typology", "county"), F.col("county"))
    return rows.select("id", C.strip_prefix(F.concat(F.lit("Ref. "), "partner_id")).alias("ref"), C.strip_prefix(F.concat(F.lit("Tipo:  "), "typology")).alias("label"), C.strip_prefix(F.col("title")).alias("plain"), short.alias("short"))


@q("SELECT listing_id, CAST(count(*) AS INTEGER) AS n, CAST(count(*) FILTER (NOT starts_with(a, 'https://img.test/1')) AS INTEGER) AS named FROM (SELECT listing_id, url AS a FROM media_v) m GROUP BY 1")
def c24_media_array(spark, d):
    """Every listing has one blank url more, which is dropped."""
    rows = view(spark, d, "media_v").groupBy("listing_id").agg(F.sort_array(F.collect_list("url")).alias("urls"))
    urls = F.array_append("urls", F.lit(""))
    alts = F.transform(urls, lambda u: F.when(~u.startswith("https://img.test/1"), u))
    out = rows.select("listing_id", C.media_array(urls, alts).alias("m"))
    return out.select("listing_id", F.size("m").alias("n"), F.size(F.filter("m", lambda m: m["alt_text"].isNotNull())).alias("named"))


@q("SELECT doc_id, md5(replace(replace(text, 'é', 'è'), 'ç', 'é')) AS fixed FROM documents")
def c27_mojibake(spark, d):
    broken = F.replace(F.replace("text", F.lit("é"), F.lit("Ã¨")), F.lit("ç"), F.lit("Ã©"))
    return table(spark, d, "documents").select("doc_id", F.md5(C.fix_mojibake(broken, {"Ã": "A", "Ã¨": "è", "Ã©": "é"})).alias("fixed"))


_CANON = """SELECT id, CASE id % 5 WHEN 0 THEN CAST(20 + id % 180 AS DOUBLE) WHEN 1 THEN 20.5 + id % 180 WHEN 2 THEN 2408.0 END AS area_useful_m2, typology, CAST(substr(typology, 2) AS INTEGER) AS bedrooms, 'Apartamento' AS property_type,
 CASE id % 7 WHEN 0 THEN true WHEN 1 THEN false WHEN 2 THEN true WHEN 3 THEN false END AS has_garage, CAST(id % 40 AS BIGINT) AS scrape_job_id,
 CASE WHEN id % 6 = 2 AND CAST(nullif(regexp_replace(price, '[^0-9]', '', 'g'), '') AS DOUBLE) >= 1000 THEN 'USD' ELSE 'EUR' END AS price_currency FROM raw_v"""


@q(_CANON)
def c30_canonical_to_listing(spark, d):
    flat = records.to_listing(records.build_canonical(view(spark, d, "raw_v")), (F.col("id") % 40).cast("long"))
    return flat.select("id", "area_useful_m2", "typology", "bedrooms", "property_type", "has_garage", "scrape_job_id", "price_currency")


_RAW_LISTINGS = """SELECT k AS id, concat('p', CAST(k % 6 AS STRING)) AS source_partner,
 concat('https://x.test/', CASE WHEN k % 6 = 4 AND k % 2 = 0 THEN 'Imovel/Arrendamento/b/Dis-trito/Con-celho/Par-te/' ELSE 'p/' END, CAST(k AS STRING)) AS url,
 CASE k % 4 WHEN 0 THEN 'Moradia T3 em Lisboa' WHEN 1 THEN 'Bela loja V2' WHEN 2 THEN 'Vista  T1, Bairro, Cidade' END AS title,
 CASE WHEN k % 7 = 0 THEN 'Sob consulta' WHEN k % 7 = 1 THEN NULL ELSE concat(CAST(100 + k % 900 AS STRING), ' 000 €') END AS price, CASE WHEN k % 5 = 0 THEN 'Arrendamento' WHEN k % 5 = 1 THEN '' END AS business_type, CASE WHEN k % 5 = 1 THEN 'Rent' END AS business_state,
 CASE WHEN k % 9 = 0 THEN 'Casa' WHEN k % 9 = 1 THEN '' END AS property_type, CASE WHEN k % 8 = 0 THEN 'T5' END AS typology, CASE WHEN k % 10 = 0 THEN '2 quartos' END AS bedrooms, '3 wc' AS bathrooms, ' 1º  Dto ' AS floor, concat('em ', CAST(1950 + k % 70 AS STRING)) AS construction_year,
 concat(CAST(20 + k % 100 AS STRING), ' m²') AS useful_area, CASE WHEN k % 3 = 0 THEN concat(CAST(50 + k % 100 AS STRING), ' m²') END AS area, CASE WHEN k % 4 = 0 THEN concat(CAST(200 + k % 100 AS STRING), ' m²') END AS gross_area, '1.500 m²' AS land_area,
 CASE WHEN k % 11 = 0 THEN 'Braga  Norte' WHEN k % 11 = 1 THEN '' END AS district, CASE WHEN k % 13 = 0 THEN 'Maia' END AS county, CASE WHEN k % 3 = 0 THEN 'Centro. Muito bom' WHEN k % 3 = 1 THEN 'Sé' END AS parish,
 CASE (k // 6) % 5 WHEN 0 THEN 'Porto > Gaia > Canidelo' WHEN 1 THEN 'Gaia > Afurada' WHEN 2 THEN 'Bairro, Cidade' WHEN 3 THEN 'Aveiro' END AS location, ' Rua  1 ' AS full_address,
 CASE WHEN k % 2 = 0 THEN concat('Ref. ', CAST(k AS STRING)) ELSE '' END AS property_id, concat('r', CAST(k AS STRING)) AS reference, CASE WHEN k % 2 = 0 THEN 'Estado: Novo' END AS condition, 'B-' AS energy_certificate, 'Sim' AS garage, 'no' AS elevator,
 concat(repeat('x', 600), CAST(k AS STRING)) AS page_title, 'told' AS meta_description, 'Agency' AS advertiser, '+351' AS contacts, concat('Descrição: casa', CAST(k AS STRING), ' ,boa.Sim') AS raw_description FROM (SELECT o_orderkey AS k FROM {orders}) o"""


def _raw_listings(spark, d):
    """The keys alone are dealt to all cores, as the table has fewer row groups than a cluster has cores."""
    keys = table(spark, d, "orders").select("o_orderkey").repartition(4 * spark.sparkContext.defaultParallelism)
    return spark.sql(_RAW_LISTINGS.replace("(k // 6) % 5", "k DIV 6 % 5"), orders=keys)


_TOLD = "CASE k % 4 WHEN 0 THEN 'Moradia' WHEN 1 THEN {one} WHEN 2 THEN {two} END"
_AREA = "CASE WHEN f = 1 THEN CAST(CASE WHEN k % 3 = 0 THEN 50 ELSE 20 END + k % 100 AS DOUBLE) ELSE CAST(20 + k % 100 AS DOUBLE) END"
_GROSS = "CASE WHEN k % 4 = 0 THEN CAST(200 + k % 100 AS DOUBLE) END"
_AMOUNT = "CASE WHEN k % 7 > 1 THEN 1000 * (100 + k % 900) END"
_CUT = "CASE WHEN f = 4 AND k % 4 = 2 AND l = 2 THEN 'Vista  T1,' ELSE t END"
_DISTRICT, _COUNTY = "CASE WHEN k % 11 = 0 THEN {d} END", "CASE WHEN k % 13 = 0 THEN 'Maia' END"
_PARISH = "CASE WHEN k % 3 = 0 THEN 'Centro. Muito bom' WHEN k % 3 = 1 THEN 'Sé' END"


@q(f"""WITH x AS (SELECT o_orderkey AS k, o_orderkey % 6 AS f, (o_orderkey // 6) % 5 AS l, CASE o_orderkey % 4 WHEN 0 THEN 'Moradia T3 em Lisboa' WHEN 1 THEN 'Bela loja V2' WHEN 2 THEN 'Vista  T1, Bairro, Cidade' END AS t FROM orders),
y AS (SELECT *, {_DISTRICT.format(d="'Braga Norte'")} AS d, {_COUNTY} AS c, {_PARISH} AS p, {_AREA} AS useful, {_GROSS} AS gross, {_AMOUNT} AS amount, f = 4 AND k % 2 = 0 AS folders FROM x)
SELECT k AS id, concat('p', CAST(f AS VARCHAR)) AS source_partner,
 CASE WHEN f = 0 AND k % 2 = 0 THEN concat('Ref. ', CAST(k AS VARCHAR)) WHEN f IN (0, 1) AND k % 2 = 1 THEN concat('r', CAST(k AS VARCHAR)) WHEN f = 1 THEN CAST(k AS VARCHAR) WHEN k % 2 = 0 THEN concat('Ref. ', CAST(k AS VARCHAR)) END AS partner_id,
 trim(regexp_replace({_CUT}, '\\s+', ' ', 'g')) AS title, CASE WHEN k % 5 < 2 OR folders THEN 'rent' ELSE 'sale' END AS business_type,
 CASE WHEN k % 9 = 0 THEN 'Casa' WHEN f = 1 THEN {_TOLD.format(one="'Moradia'", two="'Apartamento'")} WHEN f = 2 THEN {_TOLD.format(one="NULL", two="NULL")} WHEN f = 3 THEN {_TOLD.format(one="'Loja'", two="NULL")} END AS property_type,
 CASE WHEN k % 8 = 0 THEN 'T5' END AS typology, CAST(CASE WHEN k % 10 = 0 THEN 2 WHEN f = 4 THEN CASE k % 4 WHEN 0 THEN 3 WHEN 1 THEN 2 WHEN 2 THEN 1 END WHEN k % 8 = 0 THEN 5 END AS INTEGER) AS bedrooms, 3 AS bathrooms, CASE WHEN f IN (0, 1, 2) THEN '1º Dto' END AS floor,
 CAST(amount AS DOUBLE) AS price_amount, 'EUR' AS price_currency, round_even(amount / coalesce(gross, useful), 2) AS price_per_m2, k % 7 = 0 AS price_on_request, useful AS area_useful_m2, gross AS area_gross_m2, CAST(1500 AS DOUBLE) AS area_land_m2,
 CASE f WHEN 0 THEN d WHEN 1 THEN CASE WHEN c IS NULL AND l = 0 THEN 'Porto' ELSE coalesce(d, c, CASE l WHEN 1 THEN 'Gaia' WHEN 2 THEN 'Bairro, Cidade' WHEN 3 THEN 'Aveiro' END) END
  WHEN 2 THEN coalesce(d, CASE l WHEN 0 THEN 'Porto > Gaia > Canidelo' WHEN 1 THEN 'Gaia > Afurada' WHEN 2 THEN 'Bairro' WHEN 3 THEN 'Aveiro' END)
  WHEN 3 THEN CASE WHEN d IS NULL AND c IS NULL AND l = 2 THEN 'Bairro' WHEN c IS NULL AND l = 0 THEN 'Porto' ELSE d END WHEN 4 THEN CASE WHEN folders THEN 'Dis trito' END END AS district,
 CASE f WHEN 0 THEN c WHEN 1 THEN coalesce(c, CASE l WHEN 0 THEN 'Gaia' WHEN 1 THEN 'Gaia' WHEN 2 THEN 'Bairro, Cidade' WHEN 3 THEN 'Aveiro' END) WHEN 2 THEN coalesce(c, CASE l WHEN 2 THEN 'Cidade' END)
  WHEN 3 THEN coalesce(c, CASE l WHEN 0 THEN 'Gaia' WHEN 1 THEN 'Gaia' WHEN 2 THEN CASE WHEN d IS NULL THEN 'Cidade' ELSE 'Bairro, Cidade' END WHEN 3 THEN 'Aveiro' END)
  WHEN 4 THEN CASE WHEN folders THEN 'Con celho' ELSE CASE l WHEN 0 THEN 'Porto > Gaia > Canidelo' WHEN 1 THEN 'Gaia > Afurada' WHEN 2 THEN 'Cidade' WHEN 3 THEN 'Aveiro' END END END AS county,
 CASE f WHEN 0 THEN p WHEN 1 THEN CASE WHEN c IS NOT NULL THEN p ELSE coalesce(p, CASE l WHEN 0 THEN 'Canidelo' WHEN 1 THEN 'Afurada' END) END WHEN 2 THEN CASE WHEN k % 3 = 1 THEN 'Sé' END
  WHEN 3 THEN CASE WHEN c IS NOT NULL OR l NOT IN (0, 1) THEN p ELSE coalesce(p, CASE l WHEN 0 THEN 'Canidelo' ELSE 'Afurada' END) END WHEN 4 THEN CASE WHEN folders THEN 'Par te' WHEN l = 2 THEN 'Bairro' END END AS parish,
 CASE f WHEN 0 THEN NULL WHEN 2 THEN 'Rua 1' ELSE CASE l WHEN 0 THEN 'Porto > Gaia > Canidelo' WHEN 1 THEN 'Gaia > Afurada' WHEN 2 THEN 'Bairro, Cidade' WHEN 3 THEN 'Aveiro' END END AS full_address,
 true AS has_garage, false AS has_elevator, NULL::BOOLEAN AS has_balcony, NULL::BOOLEAN AS has_air_conditioning, NULL::BOOLEAN AS has_pool, 'B-' AS energy_certificate, CAST(CASE WHEN f <> 3 THEN 1950 + k % 70 END AS INTEGER) AS construction_year,
 CASE WHEN f IN (0, 2) THEN 'Agency' END AS advertiser, CASE WHEN f IN (0, 2) THEN '+351' END AS contacts, concat('Descrição: casa', CAST(k AS VARCHAR), ' ,boa.Sim') AS raw_description, concat('casa', CAST(k AS VARCHAR), ',boa. Sim') AS description,
 CASE WHEN f = 2 THEN repeat('x', 500) END AS page_title, CASE WHEN f = 2 THEN 'told' END AS meta_description, CAST(k % 40 AS BIGINT) AS scrape_job_id FROM y WHERE f < 5""")
def c30_listing_rows(spark, d):
    """Raw rows of five families, and of a partner of none, through the whole record to the flat row."""
    partners = spark.createDataFrame([(f"p{k}", f) for k, f in enumerate(canonical.FAMILIES)], "source_partner string, family string")
    out = canonical.listing_rows(_raw_listings(spark, d), partners, (F.col("id") % 40).cast("long"))
    return out.drop("latitude", "longitude", "description_quality_score", "headers", "raw_payload", "source_url").withColumn("price_amount", F.col("price_amount").cast("double"))


@q("""SELECT o_orderkey AS id, CASE WHEN o_orderkey % 6 = 5 THEN 'unknown partner: p5' END AS error, CASE WHEN o_orderkey % 6 < 5 THEN 'Portugal' END AS country, CASE WHEN o_orderkey % 6 = 2 AND o_orderkey % 2 = 0 THEN true END AS is_new,
 CASE WHEN o_orderkey % 6 = 5 THEN NULL WHEN o_orderkey % 6 = 4 THEN CASE WHEN o_orderkey % 2 = 0 THEN 'Novo' END ELSE CASE WHEN o_orderkey % 2 = 0 THEN 'Estado: Novo' END END AS condition,
 CASE WHEN o_orderkey % 6 < 5 THEN concat('casa', CAST(o_orderkey AS VARCHAR), ',boa. Sim') END AS told FROM orders""")
def c25_canonical(spark, d):
    """Members of the record that the flat row has not."""
    partners = spark.createDataFrame([(f"p{k}", f) for k, f in enumerate(canonical.FAMILIES)], "source_partner string, family string")
    out = canonical.build_canonical(_raw_listings(spark, d), partners)
    return out.select("id", "error", F.col("record.address.country").alias("country"), F.col("record.features.is_new_construction").alias("is_new"), F.get_json_object("record.raw_partner_payload", "$.condition").alias("condition"), F.col("record.descriptions")["pt"].alias("told"))


_FAULTY = """SELECT id, CAST(bedrooms - 1 AS INT) AS bedrooms, CAST(1 AS INT) AS bathrooms, CAST(1790 + id % 40 AS INT) AS construction_year, area_useful_m2, CAST(id % 200 - 100 AS DOUBLE) AS latitude, CAST(id % 400 - 200 AS DOUBLE) AS longitude,
 CAST(id % 120 AS INT) AS quality_score, CASE WHEN id % 13 = 0 THEN 'EURO' ELSE 'EUR' END AS price_currency, CASE WHEN id % 17 = 0 THEN 'swap' ELSE business_type END AS business_type,
 CASE WHEN id % 19 = 0 THEN 'a b' WHEN id % 19 = 1 THEN 'a-b_c' ELSE source_partner END AS source_partner FROM {rows}"""


@q(f"""SELECT id, concat_ws(',', CASE WHEN bedrooms < 0 THEN 'bedrooms' END, CASE WHEN construction_year < 1800 THEN 'construction_year' END, CASE WHEN latitude < -90 OR latitude > 90 THEN 'latitude' END,
 CASE WHEN longitude < -180 OR longitude > 180 THEN 'longitude' END, CASE WHEN quality_score > 100 THEN 'quality_score' END, CASE WHEN length(price_currency) <> 3 THEN 'price_currency' END,
 CASE WHEN business_type NOT IN ('sale', 'rent') THEN 'business_type' END, CASE WHEN contains(source_partner, ' ') THEN 'source_partner' END) AS reasons FROM ({_FAULTY.replace("{rows}", "listings_v")}) x""")
def c29_validate(spark, d):
    good, bad = records.validate(spark.sql(_FAULTY, rows=view(spark, d, "listings_v")))
    return good.select("id", F.lit("").alias("reasons")).unionByName(bad.select("id", F.array_join("reasons", ",").alias("reasons")))


def _translated(df):
    """No translation, a blank English title, or one that counts, by id."""
    kind = f"map<string,{records.OUTPUT}>"
    entry = F.struct(F.when(F.col("id") % 3 == 1, "").otherwise(F.concat(F.lit("EN "), "title")).alias("title"), F.lit(None).cast("string").alias("description"), F.lit("m").alias("meta_description"))
    return df.withColumn("translations", F.when(F.col("id") % 3 == 0, F.create_map().cast(kind)).otherwise(F.create_map(F.lit("en"), entry)))


@q("SELECT id, CASE WHEN id % 3 = 2 THEN concat('EN ', title) ELSE title END AS title, id % 3 <> 0 AS is_enriched FROM listings_v")
def c31_overlay(spark, d):
    rows = _translated(view(spark, d, "listings_v"))
    return records.overlay_enriched(rows, "translations", "en", ["title"]).select("id", "title", "is_enriched")


@q(f"SELECT id, CASE business_type WHEN 'rent' THEN 'To Rent' ELSE 'To Buy' END AS business, CASE id % 6 WHEN 0 THEN 'Apartment' WHEN 1 THEN 'Lot' WHEN 2 THEN 'Commercial' WHEN 3 THEN 'castle' END AS kind, CASE id % 4 WHEN 0 THEN 'New' WHEN 1 THEN 'Used' END AS state FROM listings_v")
def c32_crm_codes(spark, d):
    codes = records.crm_codes(F.col("business_type"), F.expr(RAW_KIND), F.expr("CASE id % 4 WHEN 0 THEN 'Novo ' WHEN 1 THEN 'used' WHEN 2 THEN 'ruin' END"))
    return view(spark, d, "listings_v").select("id", codes.alias("c")).select("id", "c.*")


@q("""SELECT l.id, CASE l.business_type WHEN 'rent' THEN 'To Rent' ELSE 'To Buy' END AS business, CAST(l.price_amount AS DOUBLE) AS price, l.district, CASE WHEN l.id % 3 = 2 THEN concat('EN ', l.title) WHEN l.id % 3 = 0 THEN l.title END AS en_title,
 CAST(CASE WHEN m.n > 20 THEN 20 ELSE m.n END AS INTEGER) AS n_images, l.partner_id AS reference, CASE WHEN l.id % 2 = 0 THEN '{"lat":"38.5","lng":"-9.0","publish":true}' END AS coordinates, CASE WHEN l.id % 4 = 0 THEN '{"class":"B-"}' END AS energy,
 concat('{"useful":', CAST(area_useful_m2 AS VARCHAR), ',"land":7.5}') AS areas, CASE WHEN l.id % 5 = 0 THEN 'New' END AS state, concat('{"bedrooms":', CAST(bedrooms AS VARCHAR), ',"bathrooms":2}') AS rooms, CASE WHEN l.id % 3 = 0 AND l.id % 2 = 1 THEN 'told' END AS en_description, CASE WHEN l.id % 2 = 1 THEN 'told' END AS description
FROM listings_v l LEFT JOIN (SELECT listing_id, count(*) AS n FROM media_v GROUP BY 1) m ON m.listing_id = l.id""")
def c33_crm_payload(spark, d):
    rows = _translated(view(spark, d, "listings_v"))
    even = F.col("id") % 2 == 0
    rows = rows.withColumns({"latitude": F.when(even, 38.5), "longitude": F.lit(-9.0), "energy_certificate": F.when(F.col("id") % 4 == 0, "B-").otherwise(""), "area_land_m2": F.lit(7.5), "bathrooms": F.lit(2), "condition": F.when(F.col("id") % 5 == 0, " novo"), "description": F.when(~even, "told")})
    out = records.crm_payload(rows, view(spark, d, "media_v"))
    at = lambda p: F.get_json_object("payload", f"$.{p}")
    return out.select("id", at("businessType").alias("business"), at("pricing.price").cast("double").alias("price"), at("location.district").alias("district"), at("translations.en.title").alias("en_title"), F.json_array_length(at("images")).alias("n_images"), at("reference").alias("reference"),
                      *[at(c).alias(c) for c in ("coordinates", "energy", "areas", "state", "rooms", "description")], at("translations.en.description").alias("en_description"))


@q("SELECT id, concat_ws('|', property_type, typology, district, county) AS keywords FROM listings_v")
def c34_keywords(spark, d):
    words = records.infer_keywords(F.col("property_type"), F.concat(F.lit(" "), "typology"), F.col("district"), F.col("county"), F.initcap("county"))
    return view(spark, d, "listings_v").select("id", F.array_join(words, "|").alias("keywords"))


@q("""SELECT conv_id, turn, CASE WHEN turn % 5 = 4 THEN NULL ELSE md5(trim(text, ' ')) END AS title, CASE WHEN turn % 5 = 4 THEN NULL ELSE role END AS meta FROM conversations WHERE trim(text, ' ') <> ''""")
def c36_model_output(spark, d):
    """Answers fenced, bare, within prose, as a list, and broken, by turn."""
    body = F.struct(F.col("text").alias("title"), F.lit(" ").alias("description"), F.col("role").alias("meta_description"))
    bare = F.to_json(F.create_map(F.lit("pt"), body))
    listed = F.to_json(F.array(F.struct(F.lit("pt").alias("locale"), F.col("text").alias("title"), F.col("role").alias("meta_description"))))
    turn = F.col("turn") % 5
    answer = F.when(turn == 0, F.concat(F.lit("```json\n"), bare, F.lit("\n```"))).when(turn == 1, bare).when(turn == 2, F.concat(F.lit("Here: "), bare, F.lit(" Done."))).when(turn == 3, listed).otherwise("no answer")
    out = table(spark, d, "conversations").where("trim(text) <> ''").select("conv_id", "turn", F.try_element_at(records.parse_model_output(answer), F.lit("pt")).alias("o"))
    return out.select("conv_id", "turn", F.md5("o.title").alias("title"), F.col("o.meta_description").alias("meta"))


@q("""SELECT doc_id, concat_ws(',', CASE WHEN n NOT BETWEEN 250 AND 400 THEN 'description' END, CASE WHEN length(t) > 60 THEN 'title' END, CASE WHEN length(text) NOT BETWEEN 140 AND 155 THEN 'meta_description' END) AS faults
FROM (SELECT *, string_split(text, '.')[1] AS t, len(list_filter(regexp_split_to_array(text, '[ \\t\\n\\r\\f]+'), lambda w: w <> '')) AS n FROM documents) x""")
def c37_output_faults(spark, d):
    out = records.output_faults(F.substring_index("text", ".", 1), F.col("text"), F.col("text"))
    return table(spark, d, "documents").select("doc_id", F.array_join(out, ",").alias("faults"))


@q("SELECT job_id, CASE kind WHEN 'error' THEN 'error' WHEN 'scraped' THEN 'warning' ELSE 'info' END AS level, event_id AS entry FROM events_v WHERE kind <> 'new'")
def c38_flatten_logs(spark, d):
    key = F.expr("CASE kind WHEN 'error' THEN 'errors' WHEN 'scraped' THEN 'warnings' WHEN 'page' THEN 'info' WHEN 'found' THEN 'infos' ELSE 'junk' END")
    return records.flatten_logs(view(spark, d, "events_v").select("job_id", F.create_map(key, F.array("event_id")).alias("logs")))


@q("SELECT job_id, CAST(1 AS INTEGER) AS n, listings_found AS found, CASE WHEN job_id % 20 = 1 THEN listings_scraped END AS meta FROM jobs_v")
def c40_split_meta(spark, d):
    scores = F.map_filter(F.create_map(F.lit("found"), "listings_found", F.lit("_meta"), "listings_scraped"), lambda k, v: (k != "_meta") | (F.col("job_id") % 20 == 1))
    out = view(spark, d, "jobs_v").select("job_id", records.split_meta(scores).alias("s"))
    return out.select("job_id", F.size("s.scores").alias("n"), F.element_at("s.scores", F.lit("found")).alias("found"), "s.meta")


@q("""SELECT id, title AS name, right(county, 5) AS county, CASE WHEN id % 4 = 0 THEN NULL ELSE CAST(id AS INTEGER) END AS number, left(district, 3) AS district, coalesce(property_type, 'none') AS property_type,
 CAST(bedrooms AS INTEGER) AS rooms FROM listings_v""")
def c42_repairs(spark, d):
    """Quotes, renames, cuts from either side, casts, defaults, and nested values to text and back."""
    rows = view(spark, d, "listings_v").select("id", F.expr("CASE WHEN id % 2 = 0 THEN concat('\"', title, '\"') ELSE title END").alias("title"), "county", F.expr("CASE WHEN id % 4 = 0 THEN 'x' ELSE CAST(id AS STRING) END").alias("number"), "district", "property_type", F.struct("bedrooms").alias("nested"), F.lit(1).alias("old"))
    steps = [("unquote", "title"), ("rename", "title", "name"), ("tail", "county", 5), ("cast", "number", "int"), ("cut", "district", 3), ("default", "property_type", "none"), ("to_json", "nested"), ("from_json", "nested", "struct<bedrooms:int>"), ("drop", "old")]
    return records.migrate(rows, steps).withColumn("rooms", F.col("nested.bedrooms")).drop("nested")


# --- writes -------------------------------------------------------------------------------------------------------

_PATCH = "SELECT id, CASE id % 5 WHEN 0 THEN array('price_amount') WHEN 1 THEN array('area_useful_m2') ELSE array() END AS given, CASE WHEN id % 10 = 0 THEN NULL ELSE CAST(1000 + id AS DECIMAL(12,2)) END AS price_amount, CAST(id % 3 AS DOUBLE) AS area_useful_m2 FROM {rows} WHERE id % 5 < 3"


@q("""SELECT id, CAST(p AS DOUBLE) AS price, a AS area, CASE WHEN id % 5 > 1 THEN -1.0 WHEN p IS NULL OR a = 0 THEN NULL ELSE (k + CASE WHEN 2 * r > a OR (2 * r = a AND k % 2 = 1) THEN 1 ELSE 0 END) / 100.0::DOUBLE END AS ppm, recorded
FROM (SELECT *, CAST(p * 100 AS BIGINT) // nullif(CAST(a AS BIGINT), 0) AS k, CAST(p * 100 AS BIGINT) % nullif(CAST(a AS BIGINT), 0) AS r FROM
 (SELECT id, CASE WHEN id % 10 = 0 THEN NULL WHEN id % 5 = 0 THEN CAST(1000 + id AS DECIMAL(12,2)) ELSE price_amount END AS p, CASE WHEN id % 5 = 1 THEN CAST(id % 3 AS DOUBLE) ELSE area_useful_m2 END AS a,
  CASE WHEN id % 5 = 0 AND id % 10 <> 0 AND price_amount <> 1000 + id THEN CAST(price_amount AS DOUBLE) END AS recorded FROM listings_v) x) y""")
def w5_patch(spark, d):
    current = view(spark, d, "listings_v").select("id", F.lit(-1.0).alias("price_per_m2"), "price_amount", "area_useful_m2")
    rows, history = merge.patch(current, spark.sql(_PATCH, rows=view(spark, d, "listings_v")))
    out = rows.join(history.select("id", F.col("old_price").cast("double").alias("recorded")), "id", "left")
    return out.select("id", F.col("price_amount").cast("double").alias("price"), F.col("area_useful_m2").alias("area"), F.col("price_per_m2").alias("ppm"), "recorded")


@q("SELECT c.source_url, 'kept' AS state FROM current_v c WHERE NOT EXISTS (SELECT 1 FROM incoming_v i WHERE i.source_url = c.source_url AND i.title ILIKE '%urgent%') UNION ALL SELECT source_url, 'ingest' FROM incoming_v WHERE title IS NULL OR NOT title ILIKE '%urgent%'")
def w8_drop_sold(spark, d):
    kept, raw = merge.drop_sold(view(spark, d, "current_v"), view(spark, d, "incoming_v"), F.coalesce(F.lower("title").contains("urgent"), F.lit(False)))
    return kept.select("source_url", F.lit("kept").alias("state")).unionByName(raw.select("source_url", F.lit("ingest").alias("state")))


@q("SELECT listing_id, status FROM ledger_v WHERE status <> 'failed'")
def w10_reset_ledger(spark, d):
    ledger = view(spark, d, "ledger_v")
    return merge.reset_ledger(ledger, ledger.where("status = 'failed'").select(F.col("listing_id").alias("id"))).select("listing_id", "status")


_CHANGE = "CASE k % 3 WHEN 0 THEN 'create' WHEN 1 THEN 'delete' ELSE 'purge' END"
_SITES = "SELECT concat('c', CAST(c_custkey AS STRING)) AS key, concat('old ', c_mktsegment) AS name, c_custkey % 4 <> 0 AS is_active FROM {customer} WHERE c_custkey % 5 < 4"
_CHANGES = f"SELECT concat('c', CAST(k AS STRING)) AS key, {_CHANGE} AS action, concat('new ', CAST(k AS STRING)) AS new_name FROM (SELECT c_custkey AS k FROM {{customer}} WHERE c_custkey % 7 < 5) x"


@q(f"""SELECT coalesce(s.key, c.key) AS key, CASE WHEN c.action = 'create' AND (s.key IS NULL OR NOT s.is_active) THEN c.new_name ELSE s.name END AS name,
 CASE WHEN c.action = 'create' AND (s.key IS NULL OR NOT s.is_active) THEN true WHEN c.action = 'delete' AND s.is_active THEN false ELSE s.is_active END AS is_active,
 CASE WHEN c.action IS NULL THEN 'kept' WHEN c.action = 'create' THEN CASE WHEN s.key IS NULL THEN 'created' WHEN NOT s.is_active THEN 'reactivated' ELSE 'duplicate' END WHEN s.key IS NULL THEN 'not_found' WHEN c.action = 'purge' THEN 'purged' WHEN s.is_active THEN 'deactivated' ELSE 'already_inactive' END AS result
FROM ({_SITES.replace("{customer}", "customer")}) s FULL JOIN ({_CHANGES.replace("{customer}", "customer")}) c ON s.key = c.key""")
def w12_site_changes(spark, d):
    customer = table(spark, d, "customer")
    return merge.apply_site_changes(spark.sql(_SITES, customer=customer), spark.sql(_CHANGES, customer=customer))


@q("SELECT id, CASE WHEN id % 3 = 0 THEN 'new' WHEN id % 3 = 1 THEN 'old' ELSE 'new' END AS pt, CASE WHEN id % 3 > 0 THEN 'kept' END AS en FROM listings_v")
def w14_apply_translations(spark, d):
    none = F.create_map().cast("map<string,string>")
    have = F.when(F.col("id") % 3 == 0, none).otherwise(F.create_map(F.lit("pt"), F.lit("old"), F.lit("en"), F.lit("kept")))
    come = F.when(F.col("id") % 3 == 1, none).otherwise(F.create_map(F.lit("pt"), F.lit("new")))
    merged = merge.map_merge(have, come)
    return view(spark, d, "listings_v").select("id", F.try_element_at(merged, F.lit("pt")).alias("pt"), F.try_element_at(merged, F.lit("en")).alias("en"))


@q("SELECT id, concat_ws(' ', string_split(regexp_replace(lower(title), '[^a-z0-9]+', ' ', 'g'), ' ')) AS tokens FROM listings_v")
def w15_rebuild_tokens(spark, d):
    return view(spark, d, "listings_v").select("id", F.array_join(C.search_tokens(F.col("title"), STOP), " ").alias("tokens"))


@q("""SELECT f.source_url, CASE WHEN f.n % 5 = 0 THEN 'errored' WHEN f.n % 5 = 1 THEN 'sold' WHEN f.n % 5 = 2 THEN 'warned' WHEN c.source_url IS NOT NULL THEN 'scraped_updated' ELSE 'scraped_new' END AS outcome
FROM (SELECT source_url, min(ord) AS n FROM incoming_v GROUP BY 1) f LEFT JOIN current_v c ON c.source_url = f.source_url""")
def w16_classify(spark, d):
    found = view(spark, d, "incoming_v").groupBy("source_url").agg(F.min("ord").alias("n"))
    raw = found.where("n % 5 > 0").select("source_url", (F.col("n") % 5 == 1).alias("sold"), F.when(F.col("n") % 5 != 2, 1.0).alias("price_amount"))
    return merge.classify(found.select("source_url"), view(spark, d, "current_v"), raw)


_OUTCOME = "CASE WHEN f.n % 5 = 0 THEN 'errored' WHEN f.n % 5 = 1 THEN 'sold' WHEN f.n % 5 = 2 THEN 'warned' WHEN c.source_url IS NOT NULL THEN 'scraped_updated' ELSE 'scraped_new' END"


@q(f"""SELECT 'log' AS kind, CASE WHEN n % 10 = 0 THEN 'error' WHEN n % 5 = 1 THEN 'info' ELSE 'warning' END AS state, CASE WHEN n % 10 = 0 THEN 'Error processing listing: e' WHEN n % 5 = 0 THEN 'Failed to fetch listing page' WHEN n % 5 = 1 THEN 'Listing marked as sold/reserved \u2014 skipped' ELSE 'Critical parser fields missing: price, title' END AS message, source_url AS url
FROM (SELECT source_url, min(ord) AS n FROM incoming_v GROUP BY 1) f WHERE n % 5 < 3
UNION ALL SELECT 'url', CASE WHEN {_OUTCOME} = 'errored' THEN 'failed' ELSE 'scraped' END, NULL, f.source_url FROM (SELECT source_url, min(ord) AS n FROM incoming_v GROUP BY 1) f LEFT JOIN current_v c ON c.source_url = f.source_url WHERE f.n % 5 <> 1""")
def w16_ingest_rows(spark, d):
    """Log entries and url states of a batch; every other failure came after the page was there."""
    found = view(spark, d, "incoming_v").groupBy("source_url").agg(F.min("ord").alias("n"))
    raw = found.where("n % 5 > 0").select("source_url", (F.col("n") % 5 == 1).alias("sold"), F.when(F.col("n") % 5 != 2, 1.0).alias("price_amount"))
    classified = merge.classify(found.select("source_url"), view(spark, d, "current_v"), raw).join(found, "source_url")
    log, urls = merge.ingest_rows(classified.withColumns({"error": F.when(F.col("n") % 10 == 0, "e"), "missing": F.when(F.col("n") % 5 == 2, F.array(F.lit("price"), F.lit("title")))}))
    return log.select(F.lit("log").alias("kind"), F.col("level").alias("state"), "message", "url").unionByName(urls.select(F.lit("url").alias("kind"), "state", F.lit(None).cast("string").alias("message"), "url"))


@q("SELECT job_id, status FROM jobs_v WHERE status = 'running' OR epoch(CAST(created_at AS TIMESTAMP)) >= epoch(TIMESTAMP '2001-01-01 00:00:00') - 3600")
def r8_evict(spark, d):
    """Finished jobs older than an hour are evicted; the day of their creation stands for that of their end."""
    return jobs.evict(view(spark, d, "jobs_v"), F.lit("2001-01-01 00:00:00").cast("timestamp"), at="created_at").select("job_id", "status")


def _fake(prompt: str) -> str:
    if len(prompt) % 7 == 0:
        raise ValueError("refused")
    return '{"en": {"title": "%d"}}' % len(prompt)


@q("SELECT doc_id, CASE WHEN length(text) % 7 <> 0 THEN CAST(length(text) AS VARCHAR) END AS title, CASE WHEN length(text) % 7 = 0 THEN 'refused' END AS error FROM documents WHERE text IS NOT NULL")
def u3_model_provider(spark, d):
    """A provider given by the caller on every prompt; its answers are parsed, its errors kept for each row."""
    rows = table(spark, d, "documents").where("text IS NOT NULL").select("doc_id", F.col("text").alias("prompt"))
    out = records.enrich(rows, _fake)
    return out.select("doc_id", F.try_element_at(records.parse_model_output(F.col("answer")), F.lit("en"))["title"].alias("title"), "error")


@q("""SELECT id, CASE WHEN id % 4 = 0 THEN 'skipped' WHEN length(title) % 7 = 0 THEN 'error' ELSE 'enriched' END AS status, CASE WHEN id % 4 = 0 THEN '' WHEN length(title) % 7 = 0 THEN '' ELSE 'en' END AS locales,
 CASE WHEN id % 4 = 0 THEN 'stored' WHEN length(title) % 7 <> 0 THEN CAST(length(title) AS VARCHAR) END AS title FROM listings_v""")
def u6_bulk_driver(spark, d):
    """All listings, of which every fourth has its translation: plan, generate, parse, apply, and a status for each."""
    told = F.create_map(F.lit("en"), F.struct(F.lit("stored").alias("title"), F.lit("d").alias("description"), F.lit(None).cast("string").alias("meta_description")))
    rows = view(spark, d, "listings_v").select("id", "title", "created_at", F.when(F.col("id") % 4 == 0, told).alias("enriched_translations"))
    after, results = records.bulk_enrich(rows, _fake, ["en"], F.col("title"), ids=rows.select("id"))
    return after.join(results, "id").select("id", "status", F.array_join("locales", ",").alias("locales"), F.try_element_at("enriched_translations", F.lit("en"))["title"].alias("title"))


@q("""SELECT id, CASE WHEN length(title) % 7 = 0 THEN 'failed' ELSE 'enriched' END AS status, CASE WHEN length(title) % 7 <> 0 THEN CAST(length(title) AS VARCHAR) END AS title
FROM (SELECT * FROM listings_v WHERE NOT is_enriched ORDER BY created_at, id LIMIT 50) x""")
def u6_bulk_enrich(spark, d):
    """The oldest 50 listings without a translation: generate, parse, status for each."""
    todo = query.work_queue(view(spark, d, "listings_v").where("NOT is_enriched"), 50).select("id", F.col("title").alias("prompt"))
    out = records.enrich(todo, _fake)
    title = F.try_element_at(records.parse_model_output(F.col("answer")), F.lit("en"))["title"]
    return out.select("id", F.when(F.col("error").isNotNull(), "failed").otherwise("enriched").alias("status"), title.alias("title"))


@q("""SELECT id, md5(concat('Title: ', title, chr(10), 'Property type: ', coalesce(property_type, ''), chr(10), 'Typology: ', typology, chr(10), 'Bedrooms: ', CASE WHEN bedrooms = 0 THEN '' ELSE CAST(bedrooms AS VARCHAR) END, chr(10), 'Bathrooms: ', chr(10),
 'Price: ', coalesce(CAST(price_amount AS VARCHAR), ''), ' EUR', chr(10), 'Area (useful): ', CAST(area_useful_m2 AS VARCHAR), ' m²', chr(10), 'District: ', district, chr(10), 'County: ', county, chr(10), 'Parish: ', chr(10), 'Energy certificate: B', chr(10),
 'Features: garage=', CASE WHEN is_enriched THEN 'True' ELSE 'False' END, ', pool=None, elevator=None, balcony=None', chr(10), 'Description: ', CASE WHEN id % 2 = 0 THEN 'raw' ELSE 'own' END, chr(10),
 'Primary keyword: ', typology, chr(10), 'Secondary keywords: ', CASE WHEN id % 2 = 0 THEN district ELSE 'None provided' END, chr(10), 'Locales: en (English), xx (xx)')) AS prompt FROM listings_v""")
def c35_prompt(spark, d):
    """Digests of whole prompts, with columns that are missing, blank and 0."""
    rows = view(spark, d, "listings_v").withColumns({"price_currency": F.lit("EUR"), "energy_certificate": F.lit("B"), "has_garage": F.col("is_enriched"), "description": F.when(F.col("id") % 2 == 1, "own").otherwise(""), "raw_description": F.lit("raw")})
    keywords = records.infer_keywords(F.col("typology"), F.when(F.col("id") % 2 == 0, F.col("district")))
    return rows.select("id", F.md5(records.build_prompt(rows.columns, keywords, ["en", "xx"])).alias("prompt"))



@q("""SELECT id, CASE id % 6 WHEN 0 THEN 'Moradia' WHEN 1 THEN 'Apartamento' WHEN 2 THEN 'Escritório' WHEN 4 THEN 'Quintinha' END AS kind FROM listings_v""")
def b29_type_from_title(spark, d):
    title = F.concat("title", F.expr("CASE id % 6 WHEN 0 THEN ' Moradia com loja' WHEN 1 THEN ', apartamento e garagem' WHEN 2 THEN ' ESCRITÓRIO' WHEN 3 THEN ' lojas' WHEN 4 THEN ' Quinta' ELSE '' END"))
    return view(spark, d, "listings_v").select("id", records.type_from_title(title).alias("kind"))
