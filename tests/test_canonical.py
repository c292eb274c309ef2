"""Whole records: the cases of each family, missing and odd fields, limits, export columns; embedded data of odd shapes."""

from pyspark.sql import functions as F

from listmill.operators import canonical, embedded, extract, pairs


def records(spark, family, *rows):
    names = sorted({k for r in rows for k in r})
    kinds = ", ".join(f"{n} {'array<string>' if n in canonical.LISTS else 'string'}" for n in names)
    raw = spark.createDataFrame([tuple([i, "p", *[r.get(n) for n in names]]) for i, r in enumerate(rows)], f"id long, source_partner string, {kinds}")
    partners = spark.createDataFrame([("p", family)], "source_partner string, family string")
    return canonical.build_canonical(raw, partners)


def places(spark, family, *rows):
    return [tuple(r) for r in records(spark, family, *rows).orderBy("id").select("record.address.region", "record.address.city", "record.address.area").collect()]


def test_plain_family_whole_record(spark):
    raw = {
        "url": "https://example.com/property/123", "title": "Beautiful Apartment T2", "property_id": "REF-123", "price": "250 000 €", "property_type": "Apartment", "typology": "T2", "bathrooms": "1", "useful_area": "80 m²", "gross_area": "100 m²",
        "district": "Lisboa", "county": "Lisboa", "parish": "Estrela", "garage": "Yes", "elevator": "Yes", "energy_certificate": "B", "construction_year": "2015", "raw_description": "A nice apartment.",
        "images": ["https://example.com/img1.jpg", "", "https://example.com/img2.jpg"], "alt_texts": ["Photo 1"],
    }
    r = records(spark, "plain", raw).first()["record"]
    assert (r.partner_id, r.business_type, r.property_type, r.bedrooms, r.bathrooms, r.construction_year) == ("REF-123", "sale", "Apartment", 2, 1, 2015)
    assert (float(r.price.amount), r.price.currency, r.price_per_m2.amount, r.price_on_request, r.area_useful_m2, r.area_gross_m2, r.area_land_m2) == (250000, "EUR", 2500, False, 80, 100, None)
    assert (r.address.region, r.address.city, r.address.area, r.address.country) == ("Lisboa", "Lisboa", "Estrela", "Portugal")
    assert [(m.url, m.alt_text) for m in r.media] == [("https://example.com/img1.jpg", "Photo 1"), ("https://example.com/img2.jpg", None)]
    assert (r.features.has_garage, r.features.has_elevator, r.features.has_pool, r.features.is_new_construction) == (True, True, None, None)
    assert r.descriptions == {"raw": "A nice apartment.", "pt": "A nice apartment."} and r.seo is None


def test_places(spark):
    assert places(spark, "hierarchy", {"location": "Porto > Gaia > Canidelo"}, {"location": "Gaia > Afurada"}, {"location": "Gaia"}, {"county": "Maia", "location": "A > B > C"}, {"location": " "}, {"district": "D", "parish": "P", "location": "X >  Y"}) == [
        ("Porto", "Gaia", "Canidelo"), ("Gaia", "Gaia", "Afurada"), ("Gaia", "Gaia", None), ("Maia", "Maia", None), (None, None, None), ("D", "X", "P"),
    ]
    assert places(spark, "comma", {"location": " Porto , , Maia"}, {"district": "D", "location": "X, Y"}, {"parish": "Uma casa com jardim"}, {"parish": "Sé"}, {"location": ""}) == [("Porto", "Maia", None), ("D", "Y", None), (None, None, None), (None, None, "Sé"), (None, None, None)]
    assert places(spark, "mixed", {"location": "A, B, C"}, {"location": "A > B > C"}, {"location": "A > B"}, {"location": "A"}, {"district": "D", "location": "A > B > C"}, {"district": "D", "location": "A, B"}, {"county": "K", "location": "A > B"}) == [
        ("A", "C", None), ("A", "B", "C"), (None, "A", "B"), (None, "A", None), ("A", "B", "C"), ("D", "A, B", None), (None, "K", None),
    ]
    at = "https://x/Imovel/Venda/T2/Por-to/Ma-ia/S-e/12"
    assert places(spark, "url", {"url": at}, {"url": at.lower(), "location": "Zona, Cidade"}, {"url": at[:-2], "location": "Cidade"}, {}) == [("Por to", "Ma ia", "S e"), (None, "Cidade", "Zona"), (None, "Cidade", None), (None, None, None)]


def test_titles_ids_and_new(spark):
    out = records(spark, "hierarchy", {"title": "moradia nova", "property_id": "Ref.  7"}, {"title": "Nice V3"}, {"title": "T2 a"}, {"title": "x", "reference": "9"}, {}).orderBy("id").select("record.property_type", "record.partner_id").collect()
    assert [tuple(r) for r in out] == [("Moradia", "7"), ("Moradia", None), ("Apartamento", None), (None, "9"), (None, None)]
    out = records(spark, "url", {"title": "T3 Bairro, Porto", "location": "Bairro, Porto", "property_id": "Ref: 5", "condition": "Estado: Novo"}, {"title": "Casa", "url": "https://x/Arrendamento/1", "typology": ""}).orderBy("id")
    rows = out.select("record.title", "record.partner_id", "record.bedrooms", "record.business_type", F.get_json_object("record.raw_partner_payload", "$.typology"), F.get_json_object("record.raw_partner_payload", "$.condition")).collect()
    assert [tuple(r) for r in rows] == [("T3", "5", 3, "sale", "T3", "Novo"), ("Casa", None, None, "rent", None, None)]
    out = records(spark, "comma", {"condition": "Em planta", "page_title": "t", "headers": ""}, {"condition": "usado"}).orderBy("id").select("record.features.is_new_construction", "record.seo").collect()
    assert [tuple(r) for r in out] == [(True, {"page_title": "t"}), (None, None)]


def test_rows_of_no_family_empty_tables_and_limits(spark):
    out = records(spark, "unheard", {"title": "x"})
    assert tuple(out.select("record", "error").first()) == (None, "unknown partner: p") and canonical.to_listing(out, F.lit(1)).count() == 0
    assert canonical.build_canonical(out.select("id", "source_partner").limit(0), spark.createDataFrame([], "source_partner string, family string")).count() == 0
    flat = canonical.to_listing(records(spark, "plain", {c: "ab  " * 1000 for c in canonical.RAW}), F.lit(5))
    r = flat.first().asDict()
    assert len(flat.columns) == 41 and {c: len(r[c]) for c in canonical.LIMITS if c not in ("source_partner", "business_type", "price_currency", "full_address", "page_title")} == {
        c: n for c, n in canonical.LIMITS.items() if c not in ("source_partner", "business_type", "price_currency", "full_address", "page_title")
    }
    rows = canonical.export_listings(flat)
    assert rows.columns == canonical.EXPORTED and rows.first()["created_at"] is None


def page(*blocks, more=""):
    return "".join(f'<script type="application/ld+json">{b}</script>' for b in blocks) + more


def values(spark, *htmls):
    rows = embedded.jsonld_values(spark.createDataFrame(list(enumerate(htmls)), "page_id long, html string")).collect()
    return {(r.page_id, r.field): r["values"] for r in rows}


def test_embedded_shapes(spark):
    deep = '[[{"@graph": {"name": "no list"}}, [{"name": {"value": {"name": " deep  one "}}}]], {"@type": 5, "name": false, "price": 1.50}]'
    got = values(spark, page(deep), page('{"@type": ["Person"], "name": "x"}', "[]", "", "null", '"text"', "{} {}"), None, "", page('{"@type": "HOUSE", "offers": [{}, {"price": null}, {"price": 0, "businessFunction": "Sell"}], "address": "A,B"}'))
    assert got == {
        (0, "title"): ["deep one", "False"], (0, "price"): ["1.5"], (4, "property_type"): ["House"], (4, "price"): ["0"], (4, "business_type"): ["Sell"], (4, "district"): ["A"], (4, "county"): ["B"],
    }
    assert values(spark, page('{"name": "' + "n" * 500 + '"}')) == {(0, "title"): ["n" * 160]}
    assert embedded.jsonld_values(spark.createDataFrame([], "page_id long, html string")).count() == 0


def test_gaps_of_nothing(spark):
    pages = spark.createDataFrame([(1, "<p>x</p>"), (2, page('{"image": ["a", "b"]}', more="<title>T</title><meta property='og:title' content='O'>"))], "page_id long, html string")
    nodes = extract.page_nodes(pages)
    raw = spark.createDataFrame([(1, ["i"], "P"), (2, [], None), (3, None, " ")], "page_id long, images array<string>, parish string")
    out = {r.page_id: r for r in embedded.fill_missing(raw, embedded.jsonld_values(pages), pairs.meta_values(nodes), embedded.seo_meta(nodes)).collect()}
    assert (out[1].images, out[1].alt_texts, out[1].location, out[1].title) == (["i"], None, "P", None)
    assert (out[2].images, out[2].alt_texts, out[2].title, out[2].page_title) == (["a", "b"], ["", ""], "O", "T")
    assert (out[3].images, out[3].location, out[3].property_type) == (None, None, None)
