"""Cases of the third round's findings."""

import os

import duckdb
from pyspark.sql import functions as F

from listmill.operators import canonical, embedded, extract, mining, textindex
from listmill.sources import tables
from listmill.streaming import jobs
from tests.conftest import DATA


def nodes_of(spark, *pages):
    return extract.dom_nodes(spark.createDataFrame(list(enumerate(pages)), "page_id long, html string"))


def test_title_with_cut_reference(spark):
    nodes = nodes_of(spark, '<title>a&amp;b &amp</title><meta name="description" content="x&lt;y &copy &nosuch; &notit; &#65;">')
    assert [tuple(r)[1:] for r in embedded.seo_meta(nodes).collect()] == [("a&b &amp", "x<y &copy &nosuch; &notit; A")]


def test_fields_with_cut_references(spark):
    nodes = nodes_of(spark, '<article><h1>Salt &amp; Co &amp</h1><a href="/x?a=1&copy=2&amp;b=3">l</a></article>')
    assert [tuple(r) for r in extract.extract_direct(nodes, {"title": "article > h1"}).collect()] == [(0, "Salt & Co &amp")]
    assert [r.attrs["href"] for r in nodes.where("tag = 'a'").collect()] == ["/x?a=1&copy=2&b=3"]


def test_ingested_title_with_cut_reference(spark):
    pages = spark.createDataFrame([(1, "https://a.test/1", "<h1>T &amp</h1><b>1 200 €</b>")], "page_id long, url string, html string")
    assert [(r.title, float(r.price_amount)) for r in jobs.page_listings(pages, {"title": "h1", "price": "b"}).collect()] == [("T &amp", 1200.0)]


def test_latest_jobs_of_one_number_and_day(spark, tmp_path):
    """Every job comes three times, with other counts; the SQL on one thread takes the first in the table."""
    import __spark_entry__ as entry

    for name in ("customer", "nation", "region"):
        os.symlink(f"{DATA}/{name}.parquet", tmp_path / f"{name}.parquet")
    con = duckdb.connect()
    con.execute("SET threads = 1")
    copies = " UNION ALL ".join(f"SELECT * REPLACE (o_orderkey + {k} * 400000 AS o_orderkey) FROM read_parquet('{DATA}/orders.parquet')" for k in range(3))
    con.execute(f"COPY ({copies}) TO '{tmp_path}/orders.parquet'")
    for name in ("orders", "customer", "nation", "region"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{tmp_path}/{name}.parquet')")
    rows = entry.queries()["g10_site_confidence"](spark, str(tmp_path)).collect()
    assert sorted(map(tuple, rows), key=str) == sorted(con.execute(entry.oracle_sql()["g10_site_confidence"]).fetchall(), key=str)


def test_labels_are_whole_words(spark):
    page = "<body><p>Stateain and more</p><p>Zonas rest</p><li>Estado Novo</li><li>EstadoUsado</li><li><i>Concelho</i><i>porto</i></li><p>Quartos: 3</p></body>"
    found = {(r.field, r.sample) for r in mining.structured_pairs(nodes_of(spark, page)).collect()}
    assert found == {("condition", "Novo"), ("condition", "Usado"), ("county", "porto"), ("rooms", "3")}


def test_partners_are_not_shuffled(spark):
    """The rows of one partner are not left to one task, and members that the flat row lacks are not made."""
    partners = spark.createDataFrame([("p", "plain"), ("c", "comma")], "source_partner string, family string")
    raw = spark.range(9).select("id", F.element_at(F.array(F.lit("p"), F.lit("c"), F.lit("x")), (F.col("id") % 3 + 1).cast("int")).alias("source_partner"), F.concat(F.lit("T "), "id").alias("title"), F.lit("2 000 €").alias("price"))
    flat = canonical.listing_rows(raw, partners, F.lit(1))
    assert sorted(map(str, flat.collect())) == sorted(map(str, canonical.to_listing(canonical.build_canonical(raw, partners), F.lit(1)).collect()))
    assert flat.count() == 6
    plan = flat.drop("raw_payload")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning" not in plan and "to_json" not in plan


def test_whole_records_are_not_shuffled_by_partner(spark):
    partners = spark.createDataFrame([("p", "plain")], "source_partner string, family string")
    out = canonical.build_canonical(spark.range(4).select("id", F.lit("p").alias("source_partner"), F.lit("t").alias("title")), partners)
    assert "Exchange hashpartitioning" not in out._jdf.queryExecution().executedPlan().toString()
    assert [r.record.title for r in out.collect()] == ["t"] * 4


def test_index_is_written_in_one_shuffle(spark, tmp_path):
    """Rows repeated under one id are put together by the shuffle that deals them; an update takes rows away and adds others, also twice."""
    rows = spark.createDataFrame([(1, ["a", "b"]), (1, ["a"]), (2, ["a", None])], "id long, tokens array<string>")
    assert textindex.postings(rows)._jdf.queryExecution().executedPlan().toString().count("Exchange") == 0
    path = str(tmp_path / "index")
    textindex.build_index(rows, path)
    found = lambda *tokens: sorted(r.id for r in textindex.search_index(spark, path, list(tokens)).collect())
    assert found("a") == [1, 2] and found("a", "b") == [1]
    after = spark.createDataFrame([(1, ["a", "c"]), (3, ["c"])], "id long, tokens array<string>")
    for _ in range(2):
        textindex.update_index(path, rows.where("id = 1"), after)
        assert found("a") == [1, 2] and found("b") == [] and found("c") == [1, 3]


def test_selectors_are_made_from_the_nodes_concerned(spark):
    """The steps after the first read no whole nodes; ways by classes, by an ancestor and by position come out as they should."""
    page = "<main><section id='s'><p class='x y'>a</p><p>b</p></section><ul class='l'><li>c</li><li class='k'>d</li></ul><footer><p>e</p></footer></main>"
    nodes = tables.written(nodes_of(spark, page, page.replace("id='s'", "")))
    out = mining.unique_selectors(nodes, nodes.where("tag in ('p', 'li')").select("page_id", "node_id"))
    assert not set(nodes.inputFiles()) & set(out.inputFiles())
    got = {(r.page_id, r.node_id): r.selector for r in out.collect()}
    assert [got[0, k] for k in (2, 3, 5, 6, 8)] == ["p.x.y", "#s p:nth-of-type(2)", "ul.l li:nth-of-type(1)", "li.k", "footer p"]
    assert [got[1, k] for k in (2, 3, 5, 6, 8)] == ["p.x.y", "section p:nth-of-type(2)", "ul.l li:nth-of-type(1)", "li.k", "footer p"]
