"""Selectors as data against selectors in code, :has, fallbacks, and a plan whose size does not grow with the sites."""

import pytest
from pyspark.sql import functions as F

from listmill.operators import extract, matching, pairs
from listmill.plans import details
from listmill.sources.bindings import table

from .conftest import DATA

PAGE = '<div id="a" class="x y"><p class="x">one</p><ul><li data-k="v 1"><a href="/p?q=1">two</a></li><li>three <b>four</b></li></ul></div><div class="y"><p>five</p></div>'
PLAIN = ["p", "div.x p", "#a > p.x", "li:nth-of-type(2)", "[data-k]", "li[data-k='v 1'] a, b", "a[href*=q]", "a[href^='/p']", "a[href$=\"1\"]", 'li:-soup-contains("thr")', "* > b", "div ul li", ".x.y", "div.y > *", "section"]
SITES = "site_key string, field string, selector string"


def nodes_of(spark, *pages, key="s"):
    return extract.dom_nodes(spark.createDataFrame(list(enumerate(pages)), "page_id long, html string")).withColumn("site_key", F.lit(key))


def found(df):
    return sorted((r.page_id, r.field, r.node_id) for r in df.collect())


def test_equal_to_selectors_in_code(spark):
    nodes = nodes_of(spark, PAGE, "<p>only</p>", "")
    want = found(extract.select_many(nodes.drop("site_key"), {str(k): s for k, s in enumerate(PLAIN)}))
    rows = spark.createDataFrame([("s", str(k), s) for k, s in enumerate(PLAIN)] + [("s", "0", PLAIN[0]), ("s", "n", None), ("s", "b", " "), ("other", "1", "p"), (None, "1", "p")], SITES)
    assert found(matching.select_by_site(nodes, rows)) == want
    assert matching.select_by_site(nodes, rows.limit(0)).count() == 0
    assert matching.select_by_site(nodes.limit(0), rows).count() == 0


@pytest.mark.parametrize(
    ("selector", "texts"),
    [("li:has(b)", ["three four"]), ("li:has(> b, > a)", ["three four", "two"]), ("div:has(> p.x)", ["onetwothree four"]), ("div:has(p):has(b) p", ["one"]), ("li:has(i)", []), ('li:has(a[href="/p?q=1"])', ["two"]), ("ul:has(li b) > li:has(> a)", ["two"]), ("div:has(> b)", [])],
)
def test_has(spark, selector, texts):
    nodes = nodes_of(spark, PAGE).drop("site_key")
    assert sorted(r.text for r in extract.select_nodes(nodes, selector).collect()) == texts


def test_unsupported(spark):
    nodes = nodes_of(spark, PAGE)
    rows = [("s", "late", "p:first-child"), ("s", "bad", "p[["), ("s", "open", "p >"), ("s", "deep", "div:has(ul:has(b))"), ("s", "good", "p")]
    first = matching.first_matches(matching.matches(nodes, spark.createDataFrame(rows, SITES))).join(nodes.select("page_id", "node_id", "text"), ["page_id", "node_id"])
    assert {r.field: r.text for r in first.collect()} == {"late": "five", "good": "one"}  # of the stripped selector the last match
    for selector in ("a:hover", "> p", "p > > a", "div:has(ul:has(b))", "p:has(b", "p:has()"):
        with pytest.raises(ValueError):
            matching.select_fields(nodes.drop("site_key"), {"": selector})


def sites_frame(spark, n):
    """Settings for n sites, each with a title of its own class, every other in section mode."""
    return spark.range(n).select(
        F.col("id").cast("string").alias("site_key"), F.when(F.col("id") % 2 == 0, "section").alias("mode"),
        F.create_map(F.lit("title_selector"), F.concat(F.lit("h1.t"), F.col("id").cast("string")), F.lit("price_selector"), F.lit(".p > b"), F.lit("details_section"), F.lit("#d")).alias("selectors"),
        F.lit(None).cast("map<string,string>").alias("patterns"),
    )


def test_ten_thousand_sites_in_one_plan(spark):
    html = '<h1 class="t{0}">own {0}</h1><h1 class="t{1}">of another</h1><i class="p"><b>7</b></i><div id="d"><i class="detail"><b class="name">preço</b><b class="value">{0} €</b></i></div>'
    keys = [0, 1, 77, 5000, 9998, 9999]
    pages = spark.createDataFrame([(k, str(k), html.format(k, k + 1)) for k in keys] + [(-1, "unknown", html), (-2, None, html)], "page_id long, site_key string, html string")
    nodes = extract.page_nodes(pages.select("page_id", "html"))
    out = pairs.extract_sites(nodes, pages, sites_frame(spark, 10_000))
    got = {(r.page_id, r.field): r.value for r in out.collect()}
    assert got == {(k, "title"): f"own {k}" for k in keys} | {(k, "price"): f"{k} €" if k % 2 == 0 else "7" for k in keys}
    size = lambda df: df._jdf.queryExecution().optimizedPlan().toString().count("\n")
    assert size(out) == size(pairs.extract_sites(nodes, pages, sites_frame(spark, 2)))


def test_sites_equal_one_site_at_a_time(spark):
    pages = table(spark, DATA, "pages").where(F.contains("html", F.lit("<article>")))
    pages = pages.withColumn("html", F.replace("html", F.lit("<article>"), F.concat(F.expr(details._BLOCK), F.lit("<article>")))).withColumn("site_key", F.lit("s"))
    nodes = extract.page_nodes(pages)
    site = details.SITE | {"description_selector": "#none, article p", "characteristics_section": "#a_div_imovel_descricao", "characteristics_item_selector": "*", "condition_selector": "h1"}
    want = pairs.extract_section(nodes, pages, site)
    selectors = {k: v for k, v in site.items() if k.endswith(("_selector", "_section"))}
    row = spark.createDataFrame([("s", "section", selectors, site["text_patterns"])], "site_key string, mode string, selectors map<string,string>, patterns map<string,string>")
    rows = lambda df: sorted((r.page_id, r.field, r.value) for r in df.collect())
    assert rows(pairs.extract_sites(nodes, pages, row)) == rows(want)
    direct = {"title_selector": "article > h1", "ref_selector": "#ref", "none_selector": "table", "energy_selector": "#a_div_certificacao i"}
    row = spark.createDataFrame([("s", "unheard", direct, {"x": "(.)"})], row.schema)
    assert rows(pairs.extract_sites(nodes, pages, row)) == rows(pairs.extract_direct_long(nodes, {"mode": "unheard"} | direct))
    assert pairs.extract_sites(nodes, pages, row.limit(0)).count() == 0
