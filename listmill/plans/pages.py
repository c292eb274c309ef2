"""Queries of page extraction over whole pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from listmill.operators import embedded, extract, pairs, sections
from listmill.plans.registry import LINKS, q, requoted
from listmill.sources.bindings import table, view

NAV = "nav ul li"
_ITEMS = "SELECT page_id, regexp_extract_all(regexp_extract(html, '(?s)<nav>(.*?)</nav>', 1), '<a[^>]*>([^<]*)</a>', 1) AS l FROM pages WHERE html <> ''"
_PLAIN = "replace(replace(replace(replace(x, '&lt;', '<'), '&gt;', '>'), '&quot;', chr(34)), '&amp;', '&')"
_TEXT = "nullif(trim(regexp_replace(" + _PLAIN + ", '\\s+', ' ', 'g')), '')"


def _nodes(spark, d):
    return extract.page_nodes(table(spark, d, "pages"))


@q(f"SELECT page_id, array_to_string(list_filter(list_transform(l, lambda x: trim({_PLAIN})), lambda x: x <> ''), '|') AS items FROM ({_ITEMS}) i WHERE len(list_filter(l, lambda x: trim(x) <> '')) > 0")
def b18_list_items(spark, d):
    return sections.list_items(_nodes(spark, d), NAV).select("page_id", F.array_join("items", "|").alias("items"))


@q(f"SELECT page_id, CASE WHEN len(list_filter(l, lambda x: contains(lower(x), 'the') OR contains(lower(x), 'et'))) > 0 THEN 'Yes' END AS garage, CASE WHEN len(list_filter(l, lambda x: contains(lower(x), 'and'))) > 0 THEN 'Yes' END AS pool FROM ({_ITEMS}) i WHERE len(l) > 0")
def b9_feature_flags(spark, d):
    return sections.feature_flags(_nodes(spark, d), NAV, {"garage": ["the", "et"], "pool": ["and"]})


@q("""SELECT page_id, field, CAST(n AS BIGINT) AS n FROM (SELECT page_id, 'ad' AS field, CASE WHEN contains(html, '<div class="ad">') THEN 1 ELSE 0 END AS n FROM pages
UNION ALL SELECT page_id, 'link', len(regexp_extract_all(html, '<li><a href="/(The|la|der|de)"')) FROM pages
UNION ALL SELECT page_id, 'bold', CASE WHEN regexp_matches(html, '(?s)<article>.*<b>') OR contains(html, '<footer>') THEN 1 ELSE 0 END FROM pages
UNION ALL SELECT page_id, 'both', CASE WHEN contains(html, '<div class="ad">') AND regexp_matches(html, '(?s)<article>.*<b>') THEN 1 ELSE 0 END FROM pages) x WHERE n > 0""")
def b2_has(spark, d):
    """Elements by what they hold: a child, a link below, one of a list, and two things at once."""
    fields = {"ad": "body:has(> div.ad)", "link": "li:has(a[href='/The'], a[href='/la'], > a[href='/der'], a[href='/de'])", "bold": "html:has(article b, footer) > body", "both": "body:has(.ad):has(article b)"}
    return extract.select_many(_nodes(spark, d), fields).groupBy("page_id", "field").agg(F.count("*").alias("n"))


@q(f"""SELECT page_id, field, arg_max(x, n) AS value FROM (SELECT page_id, n, trim({_PLAIN}) AS x, CASE WHEN contains(lower(x), 'the') THEN 'garage' WHEN contains(lower(x), 'and') THEN 'pool' WHEN contains(lower(x), 'le') THEN 'lift' END AS field
FROM (SELECT page_id, unnest(l) AS x, generate_subscripts(l, 1) AS n FROM ({_ITEMS}) i) y) z WHERE field IS NOT NULL GROUP BY 1, 2""")
def b11_characteristics(spark, d):
    return sections.characteristics(_nodes(spark, d), NAV, {"the": "garage", "and": "pool", "le": "lift"})


@q("SELECT page_id, tag, count(*) AS n FROM (SELECT page_id, unnest(regexp_extract_all(html, '<([a-z][a-z0-9]*)[ >]', 1)) AS tag FROM pages) x GROUP BY 1, 2")
def b1_tag_counts(spark, d):
    """Every element of every page, by its tag."""
    return _nodes(spark, d).groupBy("page_id", "tag").agg(F.count("*").alias("n"))


@q()
def b7_description(spark, d):
    return sections.first_long(_nodes(spark, d), ["div.ad", "article p", "article"])


@q("SELECT page_id, nullif(trim(regexp_extract(html, '(?is)track\\((\\d+)\\)', 1)), '') AS track, nullif(trim(regexp_extract(html, '(?is)<html lang=\"(..)\"', 1)), '') AS lang FROM pages")
def b21_text_patterns(spark, d):
    return table(spark, d, "pages").select("page_id", extract.text_pattern(r"track\((\d+)\)", "html").alias("track"), extract.text_pattern('<html lang="(..)"', "html").alias("lang"))


@q("SELECT page_id, CAST(len(regexp_extract_all(html, '<div class=\"ad\">')) AS INTEGER) AS n, concat(regexp_extract(url, '^(https?://[^/?#]+)', 1), '/img/1.jpg') AS first FROM pages WHERE contains(html, '<div class=\"ad\">')")
def b22_images(spark, d):
    """An image, one with inline data and an excluded one before each advertisement."""
    marks = '<img src="/img/1.jpg" alt="a"><img src="data:x"><img data-src="/logo.png"><div class="ad">'
    pages = table(spark, d, "pages").withColumn("html", F.replace("html", F.lit('<div class="ad">'), F.lit(marks)))
    out = sections.images(extract.page_nodes(pages), pages, "img", "img|logo", "logo")
    return out.select("page_id", F.size("images").alias("n"), F.get("images", F.lit(0)).alias("first"))


_BLOCKS = [
    """<script type="application/ld+json">{"@type": "House", "name": "N#", "offers": {"price": "#000"}, "numberOfRooms": 3}</script>""",
    """<script type='application/ld+json' id=x>{"@type": ["Thing", "PRODUCT"], "name": "  N\\n # ", "offers": [{"x": 1}, {"price": "#"}], "image": "/i#.jpg", "floorSize": {"value": 70}}</script>""",
    """<SCRIPT type=application/ld+json>{"@graph": [{"@type": "Person", "name": "x"}, {"name": "plain #", "address": "D1, , C2 ,P3,Q"}, [{"@type": "apartment", "headline": ["", "Flat t2+1"], "@graph": [{"title": "in"}]}]]}</script>""",
    """<script type="application/ld+json">{broken</script><script type="application/ld+json">{"@type": "residence", "address": {"addressRegion": "R", "addressLocality": {"name": "L"}}, "image": ["a", {"url": "b"}, null, "a"]}</script>""",
    """<script type="application/ld+json">[{"name": "N#", "price": 5, "category": "Villa", "itemCondition": true}, {"name": "N#", "price": "6"}, {"@type": [], "lotSize": {"name": "2 ha"}}, 7, null]</script>""",
    "",
]


def _embedded(spark, d):
    """The given pages with blocks of six shapes, by the page's id, behind them; pages have none of their own."""
    block = F.replace(F.element_at(F.array(*map(F.lit, _BLOCKS)), (F.col("page_id") % 6 + 1).cast("int")), F.lit("#"), F.col("page_id").cast("string"))
    return table(spark, d, "pages").withColumn("html", F.concat(F.coalesce("html", F.lit("")), block))


_VALUES = """SELECT page_id, page_id % 6 AS k, CAST(page_id AS VARCHAR) AS i, unnest([
 {'f': 'title', 'v': concat('N', i), 'k': 0}, {'f': 'price', 'v': concat(i, '000'), 'k': 0}, {'f': 'rooms', 'v': '3', 'k': 0}, {'f': 'property_type', 'v': 'House', 'k': 0},
 {'f': 'title', 'v': concat('N ', i), 'k': 1}, {'f': 'price', 'v': i, 'k': 1}, {'f': 'images', 'v': concat('/i', i, '.jpg'), 'k': 1}, {'f': 'area', 'v': '70', 'k': 1},
 {'f': 'title', 'v': concat('plain ', i, '|Flat t2+1|in'), 'k': 2}, {'f': 'district', 'v': 'D1', 'k': 2}, {'f': 'county', 'v': 'C2', 'k': 2}, {'f': 'parish', 'v': 'P3', 'k': 2}, {'f': 'property_type', 'v': 'Apartment', 'k': 2}, {'f': 'typology', 'v': 'T2+1', 'k': 2},
 {'f': 'property_type', 'v': 'Residence', 'k': 3}, {'f': 'district', 'v': 'R', 'k': 3}, {'f': 'county', 'v': 'L', 'k': 3}, {'f': 'images', 'v': 'a|b', 'k': 3},
 {'f': 'title', 'v': concat('N', i), 'k': 4}, {'f': 'price', 'v': '5|6', 'k': 4}, {'f': 'property_type', 'v': 'Villa', 'k': 4}, {'f': 'condition', 'v': 'True', 'k': 4}, {'f': 'land_area', 'v': '2 ha', 'k': 4}]) AS e
FROM (SELECT page_id, CAST(page_id AS VARCHAR) AS i FROM pages) p"""


@q(f"SELECT page_id, e.f AS field, e.v AS values FROM ({_VALUES}) x WHERE k = e.k")
def b25_jsonld(spark, d):
    """Blocks with lists, graphs and types of several shapes, one of them broken."""
    pages = _embedded(spark, d)
    return embedded.jsonld_values(pages).select("page_id", "field", F.array_join("values", "|").alias("values"))


_GAPS = {"title": "own title", "price": "9", "district": "Porto", "raw_description": "told"}
_OWN = f"SELECT page_id, k, {', '.join(f'max(v) FILTER (f = {chr(39)}{f}{chr(39)}) AS {f}' for f in ('title', 'price', 'area', 'land_area', 'property_type', 'typology', 'condition', 'district', 'county', 'parish', 'images'))} FROM (SELECT page_id, k, e.f AS f, split_part(e.v, '|', 1) AS v FROM ({_VALUES}) x WHERE k = e.k UNION ALL SELECT page_id, page_id % 6, NULL, NULL FROM pages) y GROUP BY 1, 2"


@q(f"""SELECT page_id, title, price, area, land_area, CASE WHEN property_type IS NULL AND contains(lower(title), 'moradia') THEN 'Moradia' ELSE property_type END AS property_type, typology, condition, NULL::VARCHAR AS business_type, district, county, parish,
 CAST(CASE WHEN k = 1 THEN 1 WHEN k = 3 THEN 2 ELSE 0 END AS INTEGER) AS images, concat('D', CAST(page_id AS VARCHAR)) AS meta_description, CASE WHEN g THEN 'told' ELSE concat('D', CAST(page_id AS VARCHAR)) END AS raw_description,
 nullif(concat_ws(', ', district, county, parish), '') AS location FROM (SELECT page_id, k, page_id % 4 = 1 AS g, CASE WHEN page_id % 4 = 1 THEN 'own title' ELSE coalesce(title, 'Moradia nova') END AS title, CASE WHEN page_id % 4 = 1 THEN '9' ELSE coalesce(price, '12') END AS price,
 area, land_area, property_type, typology, condition, CASE WHEN page_id % 4 = 1 THEN 'Porto' ELSE district END AS district, county, parish FROM ({_OWN}) o) z""")
def b28_fill_missing(spark, d):
    """Every fourth page has values of its own; the rest come from embedded objects, sharing tags, title and description."""
    tags = '<meta property="og:title" content="Moradia  nova"><meta property="og:price" content="12"><meta name="description" content=""><meta property="description" content="D'
    pages = _embedded(spark, d).withColumn("html", F.concat(F.lit(tags), F.col("page_id").cast("string"), F.lit('">'), "html"))
    nodes = extract.page_nodes(pages)
    raw = pages.select("page_id", *[F.when(F.col("page_id") % 4 == 1, v).otherwise("  ").alias(f) for f, v in _GAPS.items()])
    out = embedded.fill_missing(raw, embedded.jsonld_values(pages), pairs.meta_values(nodes), embedded.seo_meta(nodes))
    return out.select("page_id", *embedded.FILLED, F.coalesce(F.size("alt_texts"), F.lit(0)).alias("images"), "meta_description", "raw_description", "location")


@q(f"""SELECT page_id, CASE WHEN page_id % 5 = 0 THEN 'shared' ELSE (SELECT {_TEXT} FROM (SELECT regexp_extract(html, '(?s)<title>(.*?)</title>', 1) AS x) t) END AS page_title,
 CASE page_id % 4 WHEN 0 THEN 'named' WHEN 1 THEN 'tweeted' WHEN 2 THEN 'property' END AS meta_description FROM pages""")
def b23_seo_meta(spark, d):
    """Titles and descriptions by order of precedence; every fifth page has lost its title."""
    tags = ['<meta property="og:description" content="late"><meta name="description" content="named">', '<meta name="description" content=""><meta name="description" content="second"><meta name="twitter:description" content="tweeted">', '<meta property="description" content="property">', ""]
    extra = F.element_at(F.array(*map(F.lit, tags)), (F.col("page_id") % 4 + 1).cast("int"))
    html = F.when(F.col("page_id") % 5 == 0, F.concat(F.lit('<meta property="og:title" content="shared">'), F.regexp_replace("html", "(?s)<title>.*?</title>", ""))).otherwise(F.col("html"))
    return embedded.seo_meta(extract.page_nodes(table(spark, d, "pages").withColumn("html", F.concat(extra, html))))


_STATES = ["Vendida", "RESERVADA", "reserved", "Negócio fechado", "Under offer", "à venda", ""]


@q("""SELECT doc_id, coalesce(regexp_matches(lower(s), 'vendido|vendida|imóvel vendido|já vendido|reservado|reservada|sold|under offer|sale agreed|negócio fechado'), false) AS sold
FROM (SELECT doc_id, concat(text, ' ', ['Vendida', 'RESERVADA', 'reserved', 'Negócio fechado', 'Under offer', 'à venda', ''][doc_id % 7 + 1]) AS s FROM documents) x""")
def b30_is_sold(spark, d):
    """Each document's text with one of some states behind it; null texts too."""
    state = F.element_at(F.array(*map(F.lit, _STATES)), (F.col("doc_id") % 7 + 1).cast("int"))
    return table(spark, d, "documents").select("doc_id", extract.is_sold(F.concat("text", F.lit(" "), state)).alias("sold"))


@q(f"""SELECT page_id, concat(regexp_extract(url, '^(https?://[^/?#]+)', 1), {_PLAIN}) AS next FROM (SELECT page_id, url, regexp_extract(html, '<nav><ul><li><a href="([^"]+)"', 1) AS x FROM pages) p WHERE x <> ''""")
def b33_next_page(spark, d):
    pages = requoted(table(spark, d, "pages"))
    return sections.next_page(extract.page_nodes(pages), pages, "nav ul li a[href]")


@q("""SELECT job_id, event_id FROM (SELECT *, max(r) OVER (PARTITION BY job_id ORDER BY ts, event_id) AS m FROM (SELECT *, CASE WHEN row_number() OVER (PARTITION BY job_id, kind ORDER BY ts, event_id) > 1 THEN 1 ELSE 0 END AS r FROM events_v) x) y WHERE m = 0""")
def b35_visited_prefix(spark, d):
    return sections.visited_prefix(view(spark, d, "events_v"), "job_id", ["ts", "event_id"], "kind").select("job_id", "event_id")


_REPORT = "SELECT page_id, count(*) AS found, count(*) FILTER (ok) AS matched, coalesce(string_agg(u, '|' ORDER BY n) FILTER (ok AND k <= 5), '') AS accepted, coalesce(string_agg(u, '|' ORDER BY n) FILTER (NOT ok AND k <= 5), '') AS rejected"
_ORIGIN = "regexp_extract(p.url, '^(https?://[^/?#]+)', 1)"


@q(f"""SELECT p.page_id, coalesce(found, 0) AS found, coalesce(matched, 0) AS matched, coalesce(accepted, '') AS accepted, coalesce(rejected, '') AS rejected,
 CASE WHEN contains(html, '<div class="ad">') THEN concat({_ORIGIN}, '/a.jpg|', {_ORIGIN}, '/c.jpg') ELSE '' END AS thumbnails, (SELECT concat({_ORIGIN}, {_PLAIN}) FROM (SELECT regexp_extract(html, '<nav><ul><li><a href="([^"]+)"', 1) AS x) y WHERE x <> '') AS next
FROM pages p LEFT JOIN ({_REPORT} FROM (SELECT *, row_number() OVER (PARTITION BY page_id, ok ORDER BY n) AS k FROM (SELECT *, regexp_matches(u, '/[a-m][^/]*$') AS ok FROM ({LINKS}) a) b) c GROUP BY 1) r ON r.page_id = p.page_id""")
def b37_link_report(spark, d):
    """Thumbnails are written before each advertisement, one of them without a source and a sixth beyond the first five."""
    marks = '<img src="/a.jpg"><img alt="b"><img src="" data-src="c.jpg"><img alt="d"><img alt="e"><img src="/f.jpg"><div class="ad">'
    pages = requoted(table(spark, d, "pages")).withColumn("html", F.replace("html", F.lit('<div class="ad">'), F.lit(marks)))
    pages = pages.withColumn("url", F.regexp_extract("url", "^(https?://[^/?#]+)", 1))
    out = sections.link_report(extract.page_nodes(pages), pages, "a", "/[a-m][^/]*$", "img", "nav ul li a[href]")
    return out.withColumns({c: F.array_join(c, "|") for c in ("accepted", "rejected", "thumbnails")})


@q("""SELECT page_id, f AS field, f <> 'bad' AS valid, CAST(CASE f WHEN 'ad' THEN len(regexp_extract_all(html, '<div class="ad">')) WHEN 'heading' THEN len(regexp_extract_all(html, '<h1>')) ELSE 0 END AS BIGINT) AS matches
FROM (SELECT page_id, html FROM pages WHERE html IS NOT NULL) p, (SELECT unnest(['ad', 'heading', 'none', 'bad']) AS f) x""")
def b40_validate_selectors(spark, d):
    pages = table(spark, d, "pages").where("html IS NOT NULL")
    out = sections.validate_selectors(_nodes(spark, d), pages, {"ad": "div.ad", "heading": "article > h1", "none": "table.x", "bad": "h1[["})
    return out.select("page_id", "field", "valid", "matches")


@q(f"""SELECT p.page_id, CAST(coalesce(len(l), 0) AS BIGINT) AS matches, coalesce(array_to_string(list_transform(l[1:3], lambda x: substr(trim({_PLAIN}), 1, 200)), '|'), '') AS samples
FROM pages p LEFT JOIN ({_ITEMS}) i ON i.page_id = p.page_id WHERE html IS NOT NULL""")
def b41_preview_selector(spark, d):
    pages = table(spark, d, "pages").where("html IS NOT NULL")
    out = sections.validate_selectors(_nodes(spark, d), pages, {"items": NAV})
    return out.select("page_id", "matches", F.coalesce(F.array_join("samples", "|"), F.lit("")).alias("samples"))


_FIELDS = {"title": "article > h1", "ad": "div.ad", "page_title": "head > title", "top": "body > article > h1", "charset": "head > meta[charset]", "script": "head > script"} | {f"item_{k}": f"nav ul li:nth-of-type({k}) a[href]" for k in range(1, 15)}
_FOUND = {"title": "<h1>(.*?)</h1>", "ad": '<div class="ad">(.*?)</div>', "page_title": "<title>(.*?)</title>", "top": "<h1>(.*?)</h1>"}


def _direct_sql() -> str:
    texts = [f"{_TEXT.replace('x,', f'regexp_extract(html, {chr(39)}(?s){p}{chr(39)}, 1),', 1)} AS {f}" for f, p in _FOUND.items()]
    items = [f"(SELECT {_TEXT} FROM (SELECT l[{k}] AS x) t) AS item_{k}" for k in range(1, 15)]
    return f"SELECT page_id, {', '.join(texts)}, NULL::VARCHAR AS charset, NULL::VARCHAR AS script, {', '.join(items)} FROM (SELECT p.page_id, html, l FROM pages p JOIN ({_ITEMS}) i ON i.page_id = p.page_id) z"


@q(_direct_sql())
def b6_extract_direct(spark, d):
    """Twenty fields, two of them elements without text."""
    return extract.extract_direct(_nodes(spark, d), _FIELDS)
