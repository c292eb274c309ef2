"""Selectors as data: the nodes of pages are joined with a table of compiled selector steps.

A table (site_key, field, selector) of any number of sites is compiled row by row to steps (one row for each compound part of
each selector). Nodes meet the steps of their site by one key (an id, a class, a tag or *), what else a step asks is tested on the
joined row, and one join for each depth of combinators takes all selectors one step up. The plan's size depends on the deepest
selector alone, not on sites or fields.

Supported are tags, ids, classes, attributes ([a], =, *=, ^=, $=, ~=), :nth-of-type(n), :-soup-contains("..."), :has(list of relative
selectors), comma lists, descendant and child combinators. A selector that is not supported is tried again without its
pseudo-classes, and then gives its last match (`fallback`); if that is not supported either, it gives nothing. Null and blank
selectors give nothing, repeated rows of one (site_key, field) add up.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from listmill.sources.tables import written

STEPS = """site_key string, field string, way int, k int, last boolean, child boolean, key string, tag string, id string, classes array<string>,
 attrs array<struct<name:string,op:string,value:string>>, nth int, texts array<string>, needs array<string>, need string, fallback boolean"""
_ARROW = pa.schema([
    ("site_key", pa.string()), ("field", pa.string()), ("way", pa.int32()), ("k", pa.int32()), ("last", pa.bool_()), ("child", pa.bool_()), ("key", pa.string()), ("tag", pa.string()), ("id", pa.string()),
    ("classes", pa.list_(pa.string())), ("attrs", pa.list_(pa.struct([("name", pa.string()), ("op", pa.string()), ("value", pa.string())]))), ("nth", pa.int32()), ("texts", pa.list_(pa.string())),
    ("needs", pa.list_(pa.string())), ("need", pa.string()), ("fallback", pa.bool_()),
])
_SIMPLE = re.compile(r"""(?P<tag>^(?:[a-zA-Z][\w-]*|\*))|\#(?P<id>[\w-]+)|\.(?P<cls>[\w-]+)|\[\s*(?P<attr>[\w:-]+)\s*(?:(?P<op>[*^$~]?=)\s*(?P<val>"[^"]*"|'[^']*'|[^\]]*?))?\s*\]|:nth-of-type\((?P<nth>\d+)\)|:-soup-contains\((?P<text>"[^"]*"|'[^']*')\)""")


@dataclass
class Compound:
    """What one element must be."""

    tag: str | None = None
    id: str | None = None
    classes: list[str] = field(default_factory=list)
    attrs: list[tuple[str, str, str]] = field(default_factory=list)
    nth: int | None = None
    texts: list[str] = field(default_factory=list)
    has: list[str] = field(default_factory=list)

    def key(self) -> str:
        return f"#{self.id}" if self.id else f".{self.classes[0]}" if self.classes else self.tag or "*"


def _outer(text: str, at: str) -> list[str]:
    """Pieces of `text`, and between them the characters of `at` that stand outside brackets and quotes."""
    out, depth, quote = [""], 0, ""
    for c in text:
        if quote:
            quote = "" if c == quote else quote
        elif c in "\"'":
            quote = c
        elif c in "([":
            depth += 1
        elif c in ")]":
            depth -= 1
        elif c in at and not depth:
            out += [c, ""]
            continue
        out[-1] += c
    if depth or quote:
        raise ValueError(f"unsupported selector: {text}")
    return out


def _whole(text: str) -> bool:
    try:
        return bool(_outer(text, ""))
    except ValueError:
        return False


def parse_compound(text: str) -> Compound:
    out, at = Compound(), 0
    while at < len(text):
        if text.startswith(":has(", at):
            end = next((e for e in range(at + 5, len(text)) if text[e] == ")" and _whole(text[at + 5 : e])), -1)
            if end < 0:
                raise ValueError(f"unsupported selector: {text}")
            out.has.append(text[at + 5 : end])
            at = end + 1
            continue
        m = _SIMPLE.match(text, at)
        if not m:
            raise ValueError(f"unsupported selector: {text}")
        at = m.end()
        bare = lambda v: v[1:-1] if v and v[0] in "\"'" else v or ""
        if m["tag"]:
            out.tag = None if m["tag"] == "*" else m["tag"].lower()
        elif m["id"]:
            if out.id not in (None, m["id"]):
                out.attrs.append(("id", "=", m["id"]))
            out.id = m["id"]
        elif m["cls"]:
            out.classes.append(m["cls"])
        elif m["attr"]:
            out.attrs.append((m["attr"].lower(), m["op"] or "", bare(m["val"])))
        elif m["nth"]:
            out.nth = int(m["nth"])
        else:
            out.texts.append(bare(m["text"]))
    return out


def parse(selectors: str, relative: bool = False) -> list[list[tuple[bool, Compound]]]:
    """The steps (whether child of the one before, compound) of each selector of a list; relative ones may begin with >."""
    out = []
    for selector in _outer(selectors, ",")[::2]:
        steps, child = [], False
        for piece in _outer(selector.strip(), " \t\r\n>"):
            if piece == ">":
                if child or not (steps or relative):
                    raise ValueError(f"unsupported selector: {selectors}")
                child = True
            elif piece.strip():
                steps.append((child, parse_compound(piece)))
                child = False
        if not steps or child:
            raise ValueError(f"unsupported selector: {selectors}")
        out.append(steps)
    return out


def _rows(site: str | None, name: str, selector: str, fallback: bool) -> list[dict]:
    rows: list[dict] = []

    def add(steps: list[tuple[bool, Compound]], need: str | None) -> None:
        way = rows[-1]["way"] + 1 if rows else 0
        later = []
        for k, (child, c) in enumerate(steps):
            needs = [f"{way}.{k}.{n}" for n in range(len(c.has))]
            if c.has and need:
                raise ValueError(f":has within :has: {selector}")
            later += [(steps[k], n, inner) for n, inner in zip(needs, c.has, strict=True)]
            rows.append({"site_key": site, "field": name, "way": way, "k": k, "last": k == len(steps) - 1, "child": child, "key": c.key(), "tag": c.tag, "id": c.id, "classes": c.classes, "attrs": [dict(zip(("name", "op", "value"), a, strict=True)) for a in c.attrs], "nth": c.nth, "texts": c.texts, "needs": needs, "need": need, "fallback": fallback})
        for (_, c), n, inner in later:  # what :has asks is a chain that begins at the element itself
            own = Compound(c.tag, c.id, c.classes, c.attrs, c.nth, c.texts)
            for below in parse(inner, relative=True):
                add([(False, own), *below], n)

    for steps in parse(selector):
        add(steps, None)
    return rows


def compile_selector(site: str | None, name: str, selector: str | None) -> list[dict]:
    """Rows of STEPS of one selector; of an unsupported one those without its pseudo-classes, or none."""
    for text, fallback in ((selector or "", False), (re.sub(r":[a-z-]+(\([^)]*\))?", "", selector or "").strip(), True)):
        try:
            return _rows(site, name, text, fallback)
        except ValueError:
            continue
    return []


def compile_steps(selectors: DataFrame) -> DataFrame:
    """selectors(site_key, field, selector) as a table of steps."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [r for row in zip(*(c.to_pylist() for c in batch.columns), strict=True) for r in compile_selector(*row)]
            if rows:
                yield pa.RecordBatch.from_pylist(rows, _ARROW)

    return selectors.select(F.col("site_key").cast("string").alias("site_key"), "field", "selector").distinct().mapInArrow(run, STEPS)


def _fits() -> Column:
    """Whether a node (n.*) is what a step (s.*) asks, beyond the key they met by."""
    n, s = (lambda c: F.col(f"n.{c}")), (lambda c: F.col(f"s.{c}"))
    v = lambda a: n("attrs")[a["name"]]
    test = lambda a: F.when(a["op"] == "", v(a).isNotNull()).when(a["op"] == "=", v(a) == a["value"]).when(a["op"] == "*=", F.contains(v(a), a["value"])).when(a["op"] == "^=", F.startswith(v(a), a["value"])).when(a["op"] == "$=", F.endswith(v(a), a["value"])).otherwise(F.array_contains(F.split(v(a), r"\s+"), a["value"]))
    return (
        (s("tag").isNull() | (s("tag") == n("tag"))) & (s("id").isNull() | n("id").eqNullSafe(s("id"))) & (F.size(F.array_except(s("classes"), n("classes"))) == 0) & (s("nth").isNull() | (s("nth") == n("nth_of_type")))
        & F.forall(s("attrs"), lambda a: F.coalesce(test(a), F.lit(False))) & F.forall(s("texts"), lambda t: F.contains(n("text"), t))
    )


def _hits(nodes: DataFrame, steps: DataFrame) -> DataFrame:
    keys = F.array_compact(F.concat(F.array(F.lit("*"), F.col("tag"), F.concat(F.lit("#"), F.col("id"))), F.transform(F.array_distinct("classes"), lambda c: F.concat(F.lit("."), c))))
    met = nodes.withColumn("_key", F.explode(keys)).alias("n").join(steps.alias("s"), (F.col("n.site_key") == F.col("s.site_key")) & (F.col("n._key") == F.col("s.key")))
    return met.where(_fits()).select("n.page_id", "s.site_key", "s.field", "s.way", "s.k", "s.last", "s.child", "s.needs", "s.need", "s.fallback", "n.node_id", "n.parent_id", "n.ancestors")


def _chains(hits: DataFrame, deepest: int) -> DataFrame:
    """(page_id, site_key, field, need, fallback, node_id, top): last and first node of every chain of hits."""
    rows = hits.where("last").select("page_id", "site_key", "field", "way", "need", "fallback", "node_id", "k", "child", F.col("node_id").alias("top"), F.col("parent_id").alias("up"), F.col("ancestors").alias("over"))
    above = hits.where("NOT last").select(*[F.col(c).alias(f"_{c}") for c in ("page_id", "field", "way", "child", "node_id", "parent_id", "ancestors")], (F.col("k") + 1).alias("_k"))
    out = ["page_id", "site_key", "field", "need", "fallback", "node_id", "top"]
    done = rows.where("k = 0").select(*out)
    for _ in range(deepest):
        on = (F.col("page_id") == F.col("_page_id")) & (F.col("field") == F.col("_field")) & (F.col("way") == F.col("_way")) & (F.col("k") == F.col("_k"))
        on &= F.when(F.col("child"), F.col("up") == F.col("_node_id")).otherwise(F.array_contains("over", F.col("_node_id")))
        rows = rows.where("k > 0").join(above, on).select(
            "page_id", "site_key", "field", "way", "need", "fallback", "node_id", (F.col("k") - 1).alias("k"), F.col("_child").alias("child"), F.col("_node_id").alias("top"), F.col("_parent_id").alias("up"), F.col("_ancestors").alias("over")
        ).dropDuplicates(["page_id", "field", "way", "node_id", "k", "top"])
        done = done.unionByName(rows.where("k = 0").select(*out))
    return done


def matches(nodes: DataFrame, selectors: DataFrame) -> DataFrame:
    """(page_id, site_key, field, node_id, fallback) of all nodes (with site_key) that their site's selectors match."""
    steps = written(compile_steps(selectors))
    deepest, needed = steps.agg(F.coalesce(F.max("k"), F.lit(0)), F.coalesce(F.max(F.size("needs")), F.lit(0))).first()
    hits = written(_hits(nodes, steps))
    if needed:
        met = _chains(hits.where("need IS NOT NULL"), deepest).select("page_id", "field", "need", F.col("top").alias("node_id")).distinct()
        asked = hits.where("need IS NULL AND size(needs) > 0").select("page_id", "field", "way", "k", "node_id", F.size("needs").alias("n"), F.explode("needs").alias("need"))
        whole = asked.join(met, ["page_id", "field", "need", "node_id"]).groupBy("page_id", "field", "way", "k", "node_id").agg((F.count("*") == F.max("n")).alias("all")).where("all")
        plain = hits.where("need IS NULL AND size(needs) = 0")
        hits = plain.unionByName(hits.where("need IS NULL AND size(needs) > 0").join(whole.drop("all"), ["page_id", "field", "way", "k", "node_id"], "left_semi"))
    return _chains(hits, deepest).select("page_id", "site_key", "field", "node_id", "fallback").distinct()


def select_by_site(nodes: DataFrame, selectors: DataFrame) -> DataFrame:
    """`field` and the nodes (with site_key) that their site's selectors(site_key, field, selector) match."""
    found = matches(nodes, selectors).select("page_id", "field", "node_id", "fallback")
    return nodes.join(found, ["page_id", "node_id"]).select("field", *nodes.columns, "fallback")


def first_matches(found: DataFrame) -> DataFrame:
    """Of matches(): the first node of each page and field, of a fallback the last."""
    at = F.when(F.bool_and("fallback"), F.max("node_id")).otherwise(F.min("node_id"))
    return found.groupBy("page_id", "site_key", "field").agg(at.alias("node_id"))


def select_fields(nodes: DataFrame, selectors: dict[str, str]) -> DataFrame:
    """`field` and the nodes that one set of selectors matches on all pages, for selectors given in code; unsupported ones are an error."""
    for s in selectors.values():
        _rows(None, "", s, False)
    rows = nodes.sparkSession.createDataFrame([("", f, s) for f, s in selectors.items()], "site_key string, field string, selector string")
    return select_by_site(nodes.withColumn("site_key", F.lit("")), rows).drop("site_key", "fallback")
