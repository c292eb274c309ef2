"""Cases of records and page sections that the queries' data lack."""

import json

import pytest
from pyspark.sql import functions as F

from listmill.operators import extract, merge, records, sections
from listmill.plans import registry

from .conftest import DATA


def test_model_output(spark):
    good = {"title": "T", "description": " ", "meta_description": "m"}
    answers = [json.dumps({"pt": good}), "```json\n" + json.dumps({"pt": good}) + "\n```", "Sure! " + json.dumps({"pt": good}) + " ok", json.dumps([good | {"locale": "pt"}, {"locale": "pt", "title": "U"}]), "none", "", None]
    rows = spark.createDataFrame(list(enumerate(answers)), "i int, x string").orderBy("i").select(records.parse_model_output(F.col("x")).alias("o")).collect()
    got = [r.o["pt"] if r.o and "pt" in r.o else None for r in rows]
    assert [tuple(g) if g else None for g in got] == [("T", None, "m")] * 3 + [("U", None, None), None, None, None]


def test_keywords_and_quotes(spark):
    row = spark.range(1).select(records.infer_keywords(F.lit(" a "), F.lit("A"), F.lit(None).cast("string"), F.lit(" "), F.lit("b")).alias("k"), records.strip_quotes(F.lit('"')).alias("one"), records.strip_quotes(F.lit('"x\ny"')).alias("two")).first()
    assert row.k == ["a", "b"] and row.one == '"' and row.two == "x\ny"


def test_address_rules(spark):
    rows = spark.createDataFrame([(1, "p", "Lisboa > Sintra > Belas", None), (2, "p", " Porto 10 ", None), (3, "q", "x", None), (4, "p", None, None)], "id int, source_partner string, location string, source_url string")
    rules = spark.createDataFrame([("p", "mixed")], "source_partner string, family string")
    out = {r.id: r for r in records.normalize(rows, rules).collect()}
    assert tuple(out[1].address) == ("Lisboa", "Sintra", "Belas") and out[2].address.county == "Porto 10"
    assert out[3].address is None and out[3].error and out[4].error is None


def test_sites(spark):
    sites = spark.createDataFrame([("a", "A", True), ("b", "B", False)], "key string, name string, is_active boolean")
    ask = lambda *rows: {r.key: (r.name, r.is_active, r.result) for r in merge.apply_site_changes(sites, spark.createDataFrame(rows, "key string, action string, new_name string")).collect()}
    assert ask(("a", "create", "N"), ("b", "create", "N")) == {"a": ("A", True, "duplicate"), "b": ("N", True, "reactivated")}
    assert ask(("a", "delete", None), ("b", "delete", None), ("c", "purge", None)) == {"a": ("A", False, "deactivated"), "b": ("B", False, "already_inactive"), "c": (None, None, "not_found")}


IMAGES = """<a href="/full.jpg"><img src="t.jpg" alt="A"></a><a href="#x"><img data-src="/u.jpg" alt="B"></a><img src="data:q" data-original="/v.jpg"><source srcset="/w.jpg 2x, /z.jpg">
<img src="/v.jpg"><img src="">"""


def test_images(spark):
    pages = spark.createDataFrame([(1, "https://a.test/p/q", IMAGES), (2, "https://a.test/", "")], "page_id long, url string, html string")
    nodes = extract.dom_nodes(pages)
    row = sections.images(nodes, pages, "a, source, img[data-original], img[src]").first()
    assert row.images[0] == "https://a.test/full.jpg" and row.alts[0] == "A" and "https://a.test/w.jpg" in row.images
    assert row.images.count("https://a.test/v.jpg") == 2 and "https://a.test/u.jpg" in row.images
    assert sections.images(nodes, pages, "img", exclude=".").count() == 0


@pytest.mark.parametrize("bad", ["h1[[", "a]", "b(", "", "p:hover"])
def test_bad_selectors(spark, bad):
    with pytest.raises(ValueError):
        extract.select_nodes(extract.dom_nodes(spark.createDataFrame([], "page_id long, html string")), bad)


def test_provider_errors(spark):
    def fails(text):
        raise RuntimeError("no")

    rows = spark.createDataFrame([(1, "x")], "id int, prompt string")
    assert tuple(records.enrich(rows, fails).first()) == (1, None, "no")


def test_every_section_query_has_rows(spark):
    for name in ("b7_description", "b11_characteristics", "b37_link_report", "b41_preview_selector"):
        assert registry.QUERIES[name](spark, DATA).count()
