"""Normalisation of scraped text to typed values, as Column expressions that stay in the JVM."""

from __future__ import annotations

import unicodedata
from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

# Phrases that stand for a price on request, currency signs from the longest on, yes/no words, date formats, words of
# rentals and of new buildings, and marks of a sentence that is no address (fixed values).
ON_REQUEST = ["sob consulta", "on request", "price on request", "a definir", "consultar", "sob pedido"]
CURRENCIES = [
    ("euros", "EUR"), ("euro", "EUR"), ("eur", "EUR"), ("usd", "USD"), ("gbp", "GBP"), ("brl", "BRL"), ("jpy", "JPY"), ("R$", "BRL"), ("€", "EUR"), ("$", "USD"), ("£", "GBP"), ("¥", "JPY"),
]
YES, NO = ["yes", "sim", "true", "1", "✓", "✔"], ["no", "não", "nao", "false", "0"]
DATE_FORMATS = ["yyyy-M-d", "yyyy-M-d'T'H:m:s", "yyyy-M-d'T'H:m:s.SSSSSS", "d/M/yyyy", "d-M-yyyy", "yyyy/M/d"]
RENT = ["arrend", "arrendar", "arrendamento", "rent", "rental", "aluguer"]
NEW = ["novo", "new", "constru", "em planta"]
SENTENCE = [". ", "!", "?", ":", " é ", " foi ", " com "]
ACCENTS = "áàâãäéèêëíìîïóòôõöúùûüçñÁÀÂÃÄÉÈÊËÍÌÎÏÓÒÔÕÖÚÙÛÜÇÑ", "aaaaaeeeeiiiiooooouuuucnAAAAAEEEEIIIIOOOOOUUUUCN"
MIN_PRICE = 1000


def nullif_blank(c: Column) -> Column:
    return F.when(F.trim(c) != "", c)


def plain_spaces(c: Column) -> Column:
    return F.replace(c, F.lit(" "), F.lit(" "))


def contains_any(c: Column, words: list[str]) -> Column:
    """Whether a text has one of the words; false for null."""
    return F.coalesce(reduce(or_, [c.contains(w) for w in words]), F.lit(False))


def on_request(c: Column) -> Column:
    return contains_any(F.lower(F.regexp_replace(c, r"\s+", " ")), ON_REQUEST)


def price_amount(c: Column, least: int = MIN_PRICE) -> Column:
    """First numeric run of a price text; with both marks a comma is decimal, else a mark is decimal or thousands by its place; small amounts are dropped."""
    n = F.regexp_replace(F.regexp_extract(plain_spaces(c), r"([0-9][0-9\s.,]*[0-9]|[0-9])", 1), r"\s+", "")
    swapped = F.replace(F.replace(n, F.lit("."), F.lit("")), F.lit(","), F.lit("."))
    comma = F.when(n.rlike(",[0-9]{2}$"), F.replace(n, F.lit(","), F.lit("."))).otherwise(F.replace(n, F.lit(","), F.lit("")))
    point = F.when(n.rlike(r"^[0-9]+([.][0-9]{3})+$"), F.replace(n, F.lit("."), F.lit(""))).otherwise(n)
    amount = F.when(n.contains(".") & n.contains(","), swapped).when(n.contains(","), comma).otherwise(point).try_cast("decimal(12,2)")
    return F.when(~on_request(c) & (amount >= least), amount)


def currency(c: Column) -> Column:
    """The first sign of CURRENCIES in the text as it is or lower-cased, EUR without one; null with a null amount."""
    code = F.coalesce(*[F.when(F.lower(c).contains(sign) | c.contains(sign), code) for sign, code in CURRENCIES], F.lit("EUR"))
    return F.when(price_amount(c).isNotNull(), code)


def area(c: Column) -> Column:
    """The number before m, m2 or m², else the first number; 2.408 reads as thousands, a comma as decimal."""
    text = plain_spaces(c)
    unit = F.regexp_extract(text, r"([0-9]+(?:[.,][0-9]+)*) *[mM](?:2|²)?(?:[^A-Za-z]|$)", 1)
    n = F.when(unit != "", unit).otherwise(F.regexp_extract(text, r"([0-9]+(?:[.,][0-9]+)*)", 1))
    n = F.when(n.rlike(r"^[0-9]+[.][0-9]{3}$"), F.replace(n, F.lit("."), F.lit(""))).otherwise(F.replace(n, F.lit(","), F.lit(".")))
    return n.try_cast("double")


def first_int(c: Column) -> Column:
    return F.regexp_extract(c, "([0-9]+)", 1).try_cast("int")


def tri_bool(c: Column) -> Column:
    low = F.lower(F.trim(c))
    return F.when(low.isin(YES), True).when(low.isin(NO), False).when(low.try_cast("double") > 0, True)


def clean_text(c: Column, most: int | None = None) -> Column:
    out = nullif_blank(F.trim(F.regexp_replace(plain_spaces(c), r"\s+", " ")))
    return F.substring(out, 1, most) if most else out


def parse_time(c: Column) -> Column:
    """A timestamp by the first of DATE_FORMATS that fits the whole text."""
    return F.coalesce(*[F.try_to_timestamp(F.trim(c), F.lit(f)) for f in DATE_FORMATS])


def parse_date(c: Column) -> Column:
    return F.to_date(parse_time(c))


def bedrooms(c: Column) -> Column:
    return F.regexp_extract(c, "[TtVv]([0-9]+)", 1).try_cast("int")


def price_per_m2(amount: Column, gross: Column, useful: Column) -> Column:
    base = F.when(gross > 0, gross).otherwise(useful)
    exact = F.bround(amount.cast("decimal(14,2)") / base.cast("decimal(14,4)"), 2)  # halves to even, on decimals
    return F.when((base > 0) & (amount > 0), exact.cast("double"))


def clean_description(c: Column) -> Column:
    """A leading label with its colon or dash goes, as do blanks before punctuation; a blank is put behind the end of a sentence."""
    c = F.regexp_replace(F.trim(F.regexp_replace(plain_spaces(c), r"\s+", " ")), r"^(?iu)(descriç[aã]o|description)\s*[:\-]?\s*", "")
    c = F.regexp_replace(F.regexp_replace(c, r"\s+([,.;:!?])", "$1"), r"([.!?;:])(\S)", "$1 $2")
    return nullif_blank(F.trim(F.regexp_replace(c, r"\s+", " ")))


def address_or_null(c: Column) -> Column:
    """An address without what reads like a sentence; white space collapsed."""
    plain = F.trim(F.regexp_replace(plain_spaces(c), r"\s+", " "))
    return F.when((F.length(plain) <= 100) & ~contains_any(F.lower(plain), SENTENCE), nullif_blank(plain))


def address_parts(c: Column, sep: str) -> Column:
    return F.filter(F.transform(F.split(c, sep), lambda x: F.trim(x)), lambda x: x != "")


def addr_comma(c: Column) -> Column:
    p = address_parts(c, ",")
    return F.struct(F.get(p, 0).alias("district"), F.get(p, 1).alias("county"))


def addr_hier(c: Column) -> Column:
    p = address_parts(c, ">")
    n = F.size(p)
    return F.struct(
        F.when(n >= 3, F.get(p, 0)).otherwise(F.get(p, 0)).alias("region"), F.when(n >= 3, F.get(p, 1)).otherwise(F.get(p, 0)).alias("city"), F.when(n >= 2, F.element_at(p, -1)).alias("area")
    )


def addr_url(url: Column) -> Column:
    at = lambda i: nullif_blank(F.replace(F.regexp_extract(url, r"/Imovel/[^/]+/[^/]+/([^/?#]+)/([^/?#]+)/([^/?#]+)/\d+", i), F.lit("-"), F.lit(" ")))
    return F.struct(at(1).alias("district"), at(2).alias("county"), at(3).alias("parish"))


def strip_prefix(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(c, r"^Ref\. *", ""), r"^[^:]+: *", ""))


def typology_from_title(c: Column) -> Column:
    return nullif_blank(F.upper(F.regexp_extract(c, r"\b([TtVv][0-9]+)\b", 1)))


def type_from_list(c: Column, types: list[str], begins: bool = False) -> Column:
    """The first of the types that the text holds or, with `begins`, begins with, whatever the case."""
    low = F.lower(F.trim(c))
    return F.coalesce(*[F.when(low.startswith(t.lower()) if begins else low.contains(t.lower()), t) for t in types])


def title_without(title: Column, place: Column) -> Column:
    """A title without the place that it names; null if nothing is left."""
    text = F.trim(F.coalesce(title, F.lit("")))
    return nullif_blank(F.trim(F.when(F.contains(text, place), F.replace(text, place, F.lit(""))).otherwise(text)))


def type_from_code(c: Column) -> Column:
    return F.when(c.rlike("^[Tt][0-9]"), "Apartamento").when(c.rlike("^[Vv][0-9]"), "Moradia")


def business_type(kind: Column, url: Column) -> Column:
    """rent by the words of the kind, or by the folder Arrendamento of the url; else sale."""
    return F.when(contains_any(F.lower(kind), RENT) | contains_any(url, ["/Arrendamento/"]), "rent").otherwise("sale")


def is_new(c: Column) -> Column:
    """True, or null."""
    return F.when(contains_any(F.lower(c), NEW), True)


def drop_empty(pairs: dict[str, Column]) -> Column:
    return F.map_filter(F.create_map(*[x for k, v in pairs.items() for x in (F.lit(k), v)]), lambda k, v: F.coalesce(v != "", F.lit(False)))


def media_array(images: Column, alts: Column) -> Column:
    zipped = F.transform(F.arrays_zip(images.alias("u"), alts.alias("a")), lambda z, i: F.struct(z["u"].alias("url"), z["a"].alias("alt_text"), F.lit("photo").alias("type"), i.alias("position")))
    return F.filter(zipped, lambda m: F.coalesce(m["url"] != "", F.lit(False)))


def _folded() -> tuple[str, str, dict[str, str]]:
    """Letters whose compatibility decomposition has one ASCII character, these characters, and Latin letters that have several."""
    pairs = {c: unicodedata.normalize("NFKD", c).encode("ascii", "ignore").decode() for c in map(chr, range(0x80, 0xD800))}
    pairs |= {c: unicodedata.normalize("NFKD", c).encode("ascii", "ignore").decode() for c in map(chr, range(0xF900, 0xFFFF))}
    one = {c: a for c, a in pairs.items() if len(a) == 1}
    many = {c: a for c, a in pairs.items() if len(a) > 1 and c == c.lower() and unicodedata.category(c)[0] == "L" and "LATIN" in unicodedata.name(c, "")}
    return "".join(one), "".join(one.values()), many


FOLDED = _folded()


def fold_text(c: Column, most: int = 160) -> Column:
    """Lower case, white space collapsed, at most `most` characters, folded to ASCII: what has no ASCII letter in it goes."""
    text = F.translate(F.lower(F.substring(F.trim(F.regexp_replace(plain_spaces(c), r"\s+", " ")), 1, most)), FOLDED[0], FOLDED[1])
    for letter, plain in FOLDED[2].items():
        text = F.replace(text, F.lit(letter), F.lit(plain))
    return F.regexp_replace(text, r"[^\x00-\x7F]", "")


def url_allowed(c: Column) -> Column:
    host = F.lower(F.regexp_extract(c, r"^(?i)https?://(?:[^/@]*@)?(\[[^\]]*\]|[^/:?#]*)", 1))
    local = host.rlike(r"^(localhost|.*\.local|.*\.internal|metadata(\..*)?|\[.*\])$") | host.rlike(r"^(0|10|127|169\.254|192\.168|172\.(1[6-9]|2[0-9]|3[01]))\.")
    return F.coalesce((host != "") & ~local, F.lit(False))


def url_join(base: Column, href: Column) -> Column:
    """`href` as seen from `base`: absolute, of the same scheme, host or folder, a query or an anchor alone; `.` and `..` are resolved."""
    h = F.trim(href)
    scheme, origin = F.regexp_extract(base, "^([a-z]+:)", 1), F.regexp_extract(base, r"^([a-z]+://[^/?#]+)", 1)
    path = F.regexp_extract(base, r"^[a-z]+://[^/?#]+([^?#]*)", 1)
    own, rest = F.regexp_extract(h, "^([^?#]*)", 1), F.regexp_extract(h, "^[^?#]*(.*)$", 1)
    joined = F.when(own.startswith("/"), own).otherwise(F.concat(F.regexp_replace(path, "[^/]*$", ""), own))
    joined = F.when(joined.startswith("/"), joined).otherwise(F.concat(F.lit("/"), joined))
    parts = F.split(F.substring(joined, 2, 1 << 30), "/")

    def step(kept: Column, part: Column) -> Column:
        return F.when(part == "..", F.slice(kept, 1, F.greatest(F.size(kept) - 1, F.lit(0)))).when(part == ".", kept).otherwise(F.array_append(kept, part))

    kept = F.aggregate(parts, F.array().cast("array<string>"), step)
    folder = F.when(joined.rlike(r"/\.\.?$") & (F.size(kept) > 0), "/").otherwise("")
    whole = F.concat(origin, F.lit("/"), F.array_join(kept, "/"), folder, rest)
    return (
        F.when(h.rlike("^[a-zA-Z][a-zA-Z0-9+.-]*:"), h).when(h.startswith("//"), F.concat(scheme, h)).when(h == "", base)
        .when(h.startswith("?"), F.concat(origin, path, h)).when(h.startswith("#"), F.concat(F.regexp_extract(base, "^([^#]*)", 1), h)).otherwise(whole)
    )


def fix_mojibake(c: Column, pairs: dict[str, str]) -> Column:
    for bad in sorted(pairs, key=len, reverse=True):
        c = F.replace(c, F.lit(bad), F.lit(pairs[bad]))
    return c


def quality_score(c: Column, groups: list[tuple[list[str], int]], least_chars: int = 100, penalty: int = 20) -> Column:
    """0 to 100: weight of each keyword group that occurs, minus a penalty for short texts."""
    low, score = F.lower(c), F.lit(0)
    for words, weight in groups:
        hit = F.lit(False)
        for w in words:
            hit = hit | low.contains(w)
        score = score + F.when(hit, weight).otherwise(0)
    return F.greatest(F.lit(0), F.least(F.lit(100), score - F.when(F.length(c) < least_chars, penalty).otherwise(0)))


def _marks(c: Column, config: dict) -> tuple[Column, Column]:
    low = F.lower(c)
    hits = {g: contains_any(low, words) for g, words in config["keywords"].items()}
    weights, penalties = config["weights"], config["penalties"]
    plus = sum((F.when(hits[g], weights.get(g, 0)).otherwise(0) for g in hits if g != "marketing"), F.lit(0))
    plus += F.when(F.length(c) >= config["good_length"], weights.get("length_bonus", 0)).otherwise(0) + F.when(hits.get("marketing", F.lit(False)), weights.get("marketing_penalty", 0)).otherwise(0)
    bad = {
        "short_description": F.length(c) < config["short_length"], "no_location": ~hits.get("location", F.lit(True)), "no_area": ~hits.get("area", F.lit(True)),
        "all_caps": c.rlike(r"(?U)\p{Lu}") & ~c.rlike(r"(?U)\p{Ll}"), "contact_info": c.rlike(r"[\w.+-]+@[\w-]+\.\w|\+?\d[\d ]{7,}\d"),
    }
    return plus, sum((F.when(bad[k], v).otherwise(0) for k, v in penalties.items()), F.lit(0))


def graded_quality(c: Column, config: dict) -> Column:
    """struct(score, grade) of a description by a configuration row; a null text has neither.

    config: keywords of each group, weights of groups, length_bonus and marketing_penalty, penalties, short_length, good_length,
    base (points of a text without any) and grades (grade -> least score). The score is kept within 0 and 100.
    """
    plus, minus = _marks(c, config)
    score = F.greatest(F.lit(0), F.least(F.lit(100), F.lit(config["base"]) + plus + minus))
    grade = F.lit(None).cast("string")
    for name, least in sorted(config["grades"].items(), key=lambda g: g[1]):
        grade = F.when(score >= least, name).otherwise(grade)
    return F.when(c.isNotNull(), F.struct(score.cast("int").alias("score"), grade.alias("grade")))


def search_tokens(c: Column, stop_words: list[str]) -> Column:
    words = F.array_distinct(F.filter(F.split(F.regexp_replace(F.lower(F.translate(c, *ACCENTS)), "[^a-z0-9]+", " "), " "), lambda w: w != ""))
    return F.array_except(words, F.array(*map(F.lit, stop_words)).cast("array<string>"))
