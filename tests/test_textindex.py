"""The inverted index against a scan, the files that a search reads, and updates from the listing table."""

from pyspark.sql import functions as F

from listmill.functions import columns as C
from listmill.operators import query, textindex
from listmill.plans.registry import STOP
from listmill.sources.bindings import table
from listmill.streaming import store

from .conftest import DATA


def ids(df, c="id"):
    return sorted(r[c] for r in df.collect())


def files_read(df):
    """Files that the scan of `df` opens when it runs."""
    spark = df.sparkSession
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        df.collect()
        leaves = df._jdf.queryExecution().executedPlan().collectLeaves()
        return sum(leaves.apply(k).metrics().apply("numFiles").value() for k in range(leaves.size()))
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")


def test_search_equals_the_scan_and_reads_few_files(spark, tmp_path):
    docs = table(spark, DATA, "documents").select(F.col("doc_id").alias("id"), C.search_tokens(F.col("text"), STOP).alias("tokens"))
    path = str(tmp_path / "i")
    textindex.build_index(docs, path)
    words = [r["w"] for r in docs.select(F.explode("tokens").alias("w")).groupBy("w").count().orderBy(F.desc("count"), "w").limit(40).collect()]
    for asked in ([words[0]], words[1:3], [words[5], words[0], words[0]], ["never seen"], [words[0], "never seen"]):
        assert ids(textindex.search_index(spark, path, asked)) == ids(query.fts(docs, F.col("tokens"), asked))
    assert textindex.search_index(spark, path, []).count() == 0
    every = len(spark.read.parquet(path).inputFiles())
    rows = textindex.read_index(spark, path, textindex.buckets_of(spark, words[:2])).where(F.col("token").isin(words[:2]))
    assert every > 200 and 0 < files_read(rows) <= 2 * textindex.SPREAD
    assert "PushedFilters: [In(token" in rows._jdf.queryExecution().toString()


def test_updates_follow_the_listing_table(spark, tmp_path):
    path, index = str(tmp_path / "s"), str(tmp_path / "i")
    columns = "source_url string, source_partner string, title string, price_amount decimal(18,2), price_currency string, area_useful_m2 double, images array<string>, scrape_job_id long, ord long"
    batch = lambda titles: spark.createDataFrame([(f"https://h{k % 5}/{k}", "p", t, None, None, None, None, 1, 1) for k, t in titles.items()], columns)
    tokens = lambda df: df.select("id", C.search_tokens(F.col("title"), STOP).alias("tokens"))
    store.merge_batch(path, batch({k: f"casa {k} azul" for k in range(50)}), 0)
    textindex.build_index(tokens(store.read_listings(spark, path)), index)
    new = batch({3: "moradia verde", 4: "casa 4 azul", 60: "casa nova"})
    urls = new.select("source_url")
    before = spark.createDataFrame(store.read_listings(spark, path).join(urls, "source_url", "left_semi").collect(), store.SCHEMA)
    store.merge_batch(path, new, 1)
    after = store.read_listings(spark, path).join(urls, "source_url", "left_semi")
    for _ in range(2):  # again after a failure
        textindex.update_index(index, tokens(before), tokens(after))
        now = tokens(store.read_listings(spark, path))
        for asked in (["casa"], ["moradia"], ["casa", "azul"], ["3"], ["nova"], ["verde", "moradia"]):
            assert ids(textindex.search_index(spark, index, asked)) == ids(query.fts(now, F.col("tokens"), asked))


def test_odd_rows(spark, tmp_path):
    path = str(tmp_path / "i")
    rows = spark.createDataFrame([(1, ["a", "a", None]), (1, ["a"]), (2, []), (3, None), (None, ["a"])], "id long, tokens array<string>")
    textindex.build_index(rows, path)
    assert ids(textindex.search_index(spark, path, ["a"])) == [1]
    textindex.update_index(path, rows, rows.limit(0))
    assert textindex.search_index(spark, path, ["a"]).count() == 0
    textindex.update_index(path, rows.limit(0), rows.limit(0))
