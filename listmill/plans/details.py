"""Queries of labelled values, section mode, fallbacks, embedded values and selector mining.

The given pages have none of these structures, so a block of them, filled from the page's id, is written into each page.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from listmill.operators import extract, mining, pairs, sections
from listmill.plans.registry import q
from listmill.sources.bindings import table, view
from listmill.streaming import jobs as streams

_BLOCK = """concat('<main><section id="details"><div class="detail"><span class="name">Preço</span><span class="value">', CAST(page_id * 1000 AS STRING), ' €</span></div>',
 '<div class="detail"><span class="name">Certificado energético</span><img alt="Class ', substr('ABCDEFG', CAST(page_id % 7 AS INT) + 1, 1), '"></div>',
 '<div class="detail"><span class="name">Venda</span><span class="value">', CAST(page_id AS STRING), '</span></div></section>',
 '<section id="areas"><div class="area"><span class="name">Área útil</span><span class="value">', CAST(20 + page_id % 180 AS STRING), ' m²</span></div>',
 '<div class="area"><span class="name">Área bruta</span><span class="value">', CAST(30 + page_id % 180 AS STRING), ' m²</span></div></section>',
 '<section id="divisions"><div class="division"><div class="name">Quartos</div><div class="value">', CAST(page_id % 6 AS STRING), '</div></div></section>',
 '<ul id="summary"><li><b>Distrito:</b> D', CAST(page_id % 7 AS STRING), '</li><li><b>Estado</b> <span class="value">Novo</span></li><li><b>Arrendamento</b> x</li></ul>',
 '<div id="', CASE WHEN page_id % 2 = 0 THEN 'a_modulodadosicones' ELSE 'plain' END, '"><span id="a_lbl_valor_quarto">', CAST(page_id % 5 AS STRING), '</span></div>',
 '<div id="a_div_certificacao"><i class="energyClass APlus"></i></div><div id="a_div_imovel_descricao">Moradia com garagem, piscina</div><p>Com elevador</p>',
 '<a id="ref" data-reference="R', CAST(page_id AS STRING), '"></a><img id="pic" src="/p.jpg" alt="P', CAST(page_id AS STRING), '">',
 '<meta property="og:title" content="  T  ', CAST(page_id AS STRING), '"><meta name="twitter:title" content="T ', CAST(page_id AS STRING), '"><meta property="og:price" content="', CAST(page_id AS STRING), '"></main>')"""
_P = "(SELECT page_id, html FROM pages WHERE contains(html, '<article>')) p"
_LETTER = "substr('ABCDEFG', CAST(page_id % 7 AS INT) + 1, 1)"
_ID = "CAST(page_id AS VARCHAR)"


def _pages(spark, d):
    pages = table(spark, d, "pages").where(F.contains("html", F.lit("<article>")))
    return pages.withColumn("html", F.replace("html", F.lit("<article>"), F.concat(F.expr(_BLOCK), F.lit("<article>"))))


def _nodes(spark, d):
    return extract.page_nodes(_pages(spark, d))


def _settings(spark, d):
    """Settings of a site for each host of the pages, told by the length of its name: section mode or direct mode, own selectors and patterns."""
    hosts = table(spark, d, "pages").select(F.regexp_extract("url", "^https?://([^/?#]+)", 1).alias("site_key")).distinct()
    n = F.length("site_key")
    mode = F.when(n % 2 == 0, "section").otherwise("direct")
    section = F.create_map(F.lit("details_section"), F.when(n % 4 == 0, "#details").otherwise("main > section#details"), F.lit("divisions_section"), F.lit("section:has(> .division)"), F.lit("condition_selector"), F.lit("#summary li:has(.value) .value"))
    direct = F.create_map(F.lit("price_selector"), F.concat(F.lit("#details .detail:nth-of-type("), (n % 3 + 1).cast("string"), F.lit(") .value")), F.lit("picture_selector"), F.lit("img[alt^=P], img:hover"))
    pattern = F.create_map(F.lit("track"), F.when(n % 4 == 0, r"track\((\d+)\)").otherwise(r"track\(\d*(\d)\)"))
    return hosts.select("site_key", mode.alias("mode"), F.when(F.col("mode") == "section", section).otherwise(direct).alias("selectors"), F.when(n % 8 != 0, pattern).alias("patterns"))


def _long(*rows: tuple[str, str]) -> str:
    """SQL of (page_id, field, value) for each page and given field and value expression."""
    return " UNION ALL ".join(f"SELECT page_id, '{f}' AS field, {v} AS value FROM {_P}" for f, v in rows)


@q(f"SELECT page_id, 'A+' AS energy, concat('P', {_ID}) AS picture FROM {_P}")
def b4_element_value(spark, d):
    nodes = _nodes(spark, d)
    energy = pairs.element_values(nodes, "#a_div_certificacao", energy=True).withColumnRenamed("value", "energy")
    return energy.join(pairs.element_values(nodes, "#pic").withColumnRenamed("value", "picture"), "page_id")


@q(f"SELECT page_id, concat('R', {_ID}) AS reference FROM {_P}")
def b8_reference(spark, d):
    return extract.select_one(_nodes(spark, d), "#ref").select("page_id", sections.reference_value().alias("reference"))


@q(_long(("garage", "CAST(page_id % 5 AS VARCHAR)"), ("lift", "'Yes'")))
def b10_feature_values(spark, d):
    return pairs.feature_values(_nodes(spark, d), {"garage": "#a_lbl_valor_quarto", "lift": "#a_div_certificacao"})


@q("""SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN '2' WHEN contains(lower(text), 'the') OR contains(lower(text), 'garage') THEN 'Yes' END AS garage,
 CASE WHEN contains(lower(text), 'und') THEN 'Yes' END AS pool FROM documents""")
def b12_feature_fallback(spark, d):
    raw = table(spark, d, "documents").select("doc_id", F.when(F.col("doc_id") % 4 == 0, "2").alias("garage"), F.lit(" ").alias("pool"), "text")
    return pairs.feature_fallback(raw, "text", {"garage": ["the", "garage"], "pool": ["und"]}).drop("text")


@q(f"SELECT * FROM ({_long(('bedrooms', 'CAST(page_id % 5 AS VARCHAR)'), ('energy_certificate', chr(39) + 'A+' + chr(39)), ('garage', chr(39) + 'Yes' + chr(39)), ('elevator', chr(39) + 'Yes' + chr(39)))}) x WHERE page_id % 2 = 0")
def b13_layout_fallback(spark, d):
    candidates = {"bedrooms": ["[id*='valor_none']", "[id*='lbl_valor_quarto']"], "energy_certificate": ["[id*='div_certificacao']"]}
    features = {"garage": ["garagem"], "elevator": ["elevador"]}
    return pairs.layout_fallback(_nodes(spark, d), ["modulodadosicones", "imovel_none"], candidates, ["[id*='div_imovel_descricao']"], features)


@q(_long(("price", "concat(CAST(page_id * 1000 AS VARCHAR), ' €')"), ("energy_certificate", _LETTER), ("business_type", "'Venda'")))
def b14_name_value_pairs(spark, d):
    return pairs.name_value_pairs(_nodes(spark, d))


@q(_long(("bedrooms", "CAST(page_id % 6 AS VARCHAR)")))
def b15_divisions(spark, d):
    return pairs.divisions(_nodes(spark, d))


@q(_long(("useful_area", "concat(CAST(20 + page_id % 180 AS VARCHAR), ' m²')"), ("gross_area", "concat(CAST(30 + page_id % 180 AS VARCHAR), ' m²')")))
def b16_area_pairs(spark, d):
    return pairs.area_pairs(_nodes(spark, d))


@q(_long(("district", "concat('D', CAST(page_id % 7 AS VARCHAR))"), ("condition", "'Novo'"), ("business_type", "'Arrendamento'")))
def b17_summary_pairs(spark, d):
    return pairs.summary_pairs(pairs.within(_nodes(spark, d), "#summary"))


SITE = {"mode": "section", "title_selector": "article > h1", "details_section": "#details", "areas_section": "#areas", "divisions_section": "#divisions", "summary_section": "#summary", "text_patterns": {"track": r"track\((\d+)\)"}}
_SECTION = _long(
    ("price", "concat(CAST(page_id * 1000 AS VARCHAR), ' €')"), ("energy_certificate", _LETTER), ("bedrooms", "CAST(page_id % 6 AS VARCHAR)"),
    ("useful_area", "concat(CAST(20 + page_id % 180 AS VARCHAR), ' m²')"), ("gross_area", "concat(CAST(30 + page_id % 180 AS VARCHAR), ' m²')"),
    ("district", "concat('D', CAST(page_id % 7 AS VARCHAR))"), ("condition", "'Novo'"), ("business_type", "'Arrendamento'"),
)


@q(f"{_SECTION} UNION ALL SELECT page_id, 'track', regexp_extract(html, 'track\\((\\d+)\\)', 1) FROM {_P} WHERE regexp_matches(html, 'track\\(\\d+\\)')")
def b19_section_mode(spark, d):
    """The title is left out, as its characters are decoded by the tokenizer."""
    return pairs.extract_section(_nodes(spark, d), _pages(spark, d), SITE).where("field <> 'title'")


@q(f"""SELECT page_id, CASE WHEN page_id % 2 = 0 THEN 's' ELSE 'd' END AS site_key, field, value FROM ({_SECTION}) x WHERE page_id % 2 = 0
UNION ALL SELECT page_id, 'd', 'quarto', CAST(page_id % 5 AS VARCHAR) FROM {_P} WHERE page_id % 2 = 1""")
def b20_mode_switch(spark, d):
    """Both sites' settings are rows of a table; one of them has an unheard-of mode."""
    pages = _pages(spark, d).withColumn("site_key", F.when(F.col("page_id") % 2 == 0, "s").otherwise("d"))
    section = {k: v for k, v in SITE.items() if k.endswith("_section")}
    sites = spark.createDataFrame([("s", "section", section, None), ("d", "unheard", {"quarto_selector": "#a_lbl_valor_quarto"}, {})], "site_key string, mode string, selectors map<string,string>, patterns map<string,string>")
    return pairs.extract_sites(_nodes(spark, d), pages, sites)


_HOSTED = f"(SELECT page_id, html, regexp_extract(url, '^https?://([^/?#]+)', 1) AS site_key, length(regexp_extract(url, '^https?://([^/?#]+)', 1)) AS n FROM pages WHERE contains(html, '<article>'))"


@q(f"""SELECT * FROM (SELECT page_id, site_key, 'price' AS field, CASE WHEN n % 2 = 0 OR n % 3 = 0 THEN concat(CAST(page_id * 1000 AS VARCHAR), ' €') WHEN n % 3 = 2 THEN {_ID} END AS value FROM {_HOSTED} x
UNION ALL SELECT page_id, site_key, 'picture', concat('P', {_ID}) FROM {_HOSTED} x WHERE n % 2 = 1
UNION ALL SELECT page_id, site_key, 'business_type', 'Venda' FROM {_HOSTED} x WHERE n % 2 = 0 UNION ALL SELECT page_id, site_key, 'energy_certificate', {_LETTER} FROM {_HOSTED} x WHERE n % 2 = 0
UNION ALL SELECT page_id, site_key, 'bedrooms', CAST(page_id % 6 AS VARCHAR) FROM {_HOSTED} x WHERE n % 2 = 0 UNION ALL SELECT page_id, site_key, 'condition', 'Novo' FROM {_HOSTED} x WHERE n % 2 = 0
UNION ALL SELECT page_id, site_key, 'track', regexp_extract(html, CASE WHEN n % 4 = 0 THEN 'track\\((\\d+)\\)' ELSE 'track\\(\\d*(\\d)\\)' END, 1) FROM {_HOSTED} x WHERE n % 2 = 0 AND n % 8 <> 0) y WHERE value <> ''""")
def u2_site_settings(spark, d):
    """Every host is a site with settings of its own, read as data."""
    pages = _pages(spark, d).withColumn("site_key", F.regexp_extract("url", "^https?://([^/?#]+)", 1))
    return pairs.extract_sites(_nodes(spark, d), pages, _settings(spark, d))


@q("""SELECT o_orderkey AS id, CASE o_orderkey % 3 WHEN 0 THEN 'House' WHEN 1 THEN 'Apartment' END AS kind, concat('T', CAST(o_custkey % 6 AS VARCHAR)) AS typology,
 o_orderstatus AS district, o_orderpriority AS county, CASE WHEN o_orderkey % 2 = 0 THEN 'x y' END AS parish FROM orders""")
def b26_jsonld_helpers(spark, d):
    o = table(spark, d, "orders")
    types = F.expr("CASE o_orderkey % 3 WHEN 0 THEN array('Thing', 'SingleFamilyResidence') WHEN 1 THEN array('Apartment', 'House') ELSE array('Person') END")
    place = F.concat("o_orderstatus", F.lit(", , "), "o_orderpriority", F.when(F.col("o_orderkey") % 2 == 0, ",  x   y ").otherwise(" ,"))
    title = F.concat(F.lit("Nice t"), F.col("o_custkey") % 6, F.lit(" in town"))
    rows = o.select(F.col("o_orderkey").alias("id"), pairs.type_from_jsonld(types).alias("kind"), pairs.typology_from(F.lit(None).cast("string"), title).alias("typology"), pairs.address_from(place).alias("a"))
    return rows.select("id", "kind", "typology", "a.*")


@q(f"SELECT page_id, concat('T ', {_ID}) AS titles, {_ID} AS prices FROM {_P}")
def b27_meta_values(spark, d):
    return pairs.meta_values(_nodes(spark, d)).select("page_id", F.array_join("titles", "|").alias("titles"), F.array_join("prices", "|").alias("prices"))


@q(f"SELECT page_id, concat('D', CAST(page_id % 7 AS VARCHAR)) AS location, concat(CAST(page_id * 1000 AS VARCHAR), ' €') AS price FROM {_P}")
def b36_card_fields(spark, d):
    out = pairs.card_fields(_nodes(spark, d), {"location": "#summary > li", "price": ".detail > .value"})
    return out.withColumn("location", F.regexp_replace("location", "^Distrito: ", ""))


@q("""SELECT doc_id, CAST(length(substr(text, 1, 300)) AS INTEGER) AS chars, concat_ws(',', CASE WHEN trim(coalesce(text, '')) = '' THEN 'text' END,
 CASE WHEN doc_id % 2 = 0 AND lang <> 'en' THEN 'district' END) AS missing FROM documents WHERE lang IS NOT NULL""")
def b38_dry_run(spark, d):
    raw = table(spark, d, "documents").where("lang IS NOT NULL").select("doc_id", "text", "lang", F.when(F.col("doc_id") % 2 == 1, "x").alias("district"))
    out = pairs.dry_run(raw, {"district": F.when(F.col("lang") == "en", "Lisboa")}, ["text", "district"])
    return out.select("doc_id", F.length("text").alias("chars"), F.array_join("missing_critical", ",").alias("missing"))


@q(f"""SELECT page_id, field, heuristic, sample, CAST(matches AS BIGINT) AS matches FROM (SELECT page_id, 'area' AS field, '.area' AS heuristic, concat('Área útil', CAST(20 + page_id % 180 AS VARCHAR), ' m²') AS sample, 2 AS matches FROM {_P}
UNION ALL SELECT page_id, 'area', '.area', concat('Área bruta', CAST(30 + page_id % 180 AS VARCHAR), ' m²'), 2 FROM {_P}
UNION ALL SELECT page_id, 'rooms', '.division .value', CAST(page_id % 6 AS VARCHAR), 1 FROM {_P} UNION ALL SELECT page_id, 'images', '#pic', '/p.jpg', 1 FROM {_P}) x""")
def b42_mine_candidates(spark, d):
    found = mining.mine_candidates(_nodes(spark, d), {"area": [".area"], "rooms": [".division .value"], "images": ["#pic"]})
    return found.select("page_id", "field", "heuristic", "sample", "matches")


@q("""SELECT o_orderkey AS id, CAST(round(CASE o_orderkey % 4 WHEN 0 THEN (0.55 + 0.22 + 0.06 + 0.08) / 1.5 WHEN 1 THEN (0.55 - 0.08 + 0.2 + 0.08 + 0.05) / 1.5
 WHEN 2 THEN (0.55 + 0.22 + 0.06 + 0.08) * 0.8 / 1.5 ELSE (0.55 + 0.22 + 0.06 + 0.08 + 0.25) / 1.5 END, 2) AS DOUBLE) AS score FROM orders""")
def b43_score_candidates(spark, d):
    """A price, a typology below another element, a price of 17 elements, and a price that was expected."""
    kind = F.col("id") % 4
    price = F.concat("id", F.lit(" €"))
    rows = table(spark, d, "orders").select(F.col("o_orderkey").alias("id")).select(
        "id", F.when(kind == 1, "typology").otherwise("price").alias("field"), F.when(kind == 1, 2).otherwise(0).alias("rank"), F.when(kind == 1, "#a b").otherwise("#price").alias("selector"),
        F.when(kind == 1, "T3").otherwise(price).alias("sample"), F.lit(None).cast("string").alias("context"), F.when(kind == 3, F.array(price)).alias("expected"), F.when(kind == 2, 17).otherwise(1).alias("matches"),
    )
    return mining.score_candidates(rows).select("id", "score")


@q(f"SELECT page_id, field, value AS sample FROM ({_long(('district', 'concat(chr(68), CAST(page_id % 7 AS VARCHAR))'), ('condition', chr(39) + 'Novo' + chr(39)), ('rooms', 'CAST(page_id % 6 AS VARCHAR)'), ('area', 'concat(CAST(20 + page_id % 180 AS VARCHAR), chr(32), chr(109), chr(178))'), ('area', 'concat(CAST(30 + page_id % 180 AS VARCHAR), chr(32), chr(109), chr(178))'))}) x")
def b46_structured_pairs(spark, d):
    return mining.structured_pairs(_nodes(spark, d)).select("page_id", "field", "sample")


@q(f"SELECT page_id, tag, selector FROM {_P}, (VALUES ('main', 'main'), ('a', '#ref'), ('div', '#a_div_certificacao'), ('i', 'i.energyClass.APlus')) v(tag, selector)")
def b47_unique_selectors(spark, d):
    nodes = _nodes(spark, d)
    picked = extract.select_nodes(nodes, "main,#ref,#a_div_certificacao,i.energyClass")
    return mining.unique_selectors(nodes, picked).join(picked.select("page_id", "node_id", "tag"), ["page_id", "node_id"]).select("page_id", "tag", "selector")


@q()
def b48_suggest_selectors(spark, d):
    """Selectors for every field of every page, with titles of the sharing tags as expected values."""
    nodes = _nodes(spark, d)
    known = pairs.meta_values(nodes).select("page_id", F.lit("title").alias("field"), F.explode("titles").alias("value"))
    return mining.suggest_selectors(nodes, known)


@q("""SELECT o_orderkey AS page_id, field, CAST(CASE WHEN field = 'land_area' AND o_orderkey % 2 = 0 THEN 1 ELSE place END AS INTEGER) AS place, selector FROM orders,
(VALUES ('area', 1, '.a'), ('land_area', 1, '.a'), ('land_area', 2, '.b')) v(field, place, selector) WHERE NOT (o_orderkey % 2 = 0 AND field = 'land_area' AND place = 1)""")
def b49_area_conflict(spark, d):
    """Even orders stand for pages whose area and land area have one first selector; odd ones differ by their area's."""
    rows = F.array(*[F.struct(F.lit(f).alias("field"), F.lit(p).alias("place"), F.lit(s).alias("selector")) for f, p, s in (("area", 1, ".a"), ("land_area", 1, ".a"), ("land_area", 2, ".b"))])
    top = table(spark, d, "orders").select(F.col("o_orderkey").alias("page_id"), F.explode(rows).alias("r")).select("page_id", "r.*")
    odd = (F.col("page_id") % 2 == 1) & (F.col("field") == "area")
    out = mining.drop_area_conflict(top.withColumn("selector", F.when(odd, ".other").otherwise(F.col("selector"))))
    return out.withColumn("selector", F.when(odd, ".a").otherwise(F.col("selector")))


_SNAPSHOTS = "SELECT job_id, ts, event_id, CASE kind WHEN 'error' THEN 'failed' ELSE 'running' END AS status, kind AS progress FROM {}"


@q(f"""SELECT job_id, t, event FROM (WITH s AS ({_SNAPSHOTS.format('events_v')}), x AS (SELECT *, CAST(epoch(date_trunc('second', ts)) - epoch(date_trunc('second', min(ts) OVER (PARTITION BY job_id))) AS BIGINT) AS t FROM s),
y AS (SELECT *, CASE WHEN status = 'failed' OR t > 3600 THEN 1 ELSE 0 END AS closing, lag(status) OVER w AS s0, lag(progress) OVER w AS p0 FROM x WINDOW w AS (PARTITION BY job_id ORDER BY ts, event_id)),
z AS (SELECT *, sum(closing) OVER (PARTITION BY job_id ORDER BY ts, event_id) - closing AS closed FROM y), o AS (SELECT * FROM z WHERE closed = 0)
SELECT job_id, t, CASE WHEN s0 IS DISTINCT FROM status THEN 'status' ELSE 'progress' END AS event FROM o WHERE t <= 3600 AND (s0 IS DISTINCT FROM status OR p0 IS DISTINCT FROM progress)
UNION ALL SELECT job_id, least(t, 3600), 'done' FROM o WHERE closing = 1
UNION ALL SELECT job_id, unnest(generate_series(15, m - 1, 15)), 'heartbeat' FROM (SELECT job_id, least(max(t), 3600) AS m FROM o GROUP BY 1) e WHERE m > 15) f""")
def r2_progress_feed(spark, d):
    return streams.progress_feed(spark.sql(_SNAPSHOTS.format("{e}"), e=view(spark, d, "events_v"))).select("job_id", "t", "event")


@q("""SELECT o_orderkey AS id, NOT regexp_matches(o_orderpriority, CASE o_orderstatus WHEN 'O' THEN '^[12]' ELSE 'LOW|MEDIUM' END) AS kept FROM orders WHERE o_orderstatus <> 'P'""")
def u2_patterns_as_data(spark, d):
    """Each site's pattern is a column of its row; sites without a row have none and go."""
    sites = spark.createDataFrame([("O", "^[12]"), ("F", "LOW|MEDIUM")], "o_orderstatus string, pattern string")
    rows = table(spark, d, "orders").join(F.broadcast(sites), "o_orderstatus")  # two rows of settings
    return rows.select(F.col("o_orderkey").alias("id"), (~F.rlike("o_orderpriority", F.col("pattern"))).alias("kept"))


@q("SELECT page_id, tag, CAST(len(regexp_extract_all(html, concat('<', tag, '[ >]'))) AS BIGINT) AS n FROM (SELECT page_id, html FROM pages WHERE contains(html, '<article>')) p, (VALUES ('article'), ('h1'), ('nav'), ('li')) v(tag)")
def u4_table_function(spark, d):
    """Pages to nodes within SQL."""
    extract.register(spark)
    sql = "SELECT p.page_id, n.tag, count(*) AS n FROM {p} p, LATERAL dom_nodes(p.html) n WHERE n.tag IN ('article', 'h1', 'nav', 'li') GROUP BY ALL"
    return spark.sql(sql, p=table(spark, d, "pages").where(F.contains("html", F.lit("<article>"))))
