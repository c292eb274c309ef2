"""Personal data: candidate generators, boosted trees on format and context, calibrated thresholds. DataFrame functions only.

Generators propose spans, which may overlap. Spans of the base kinds (email, ip, card, phone) that pass their own check
always count. Candidates of the further kinds (secret, iban, ssn, tel) are scored by boosted trees and count from a
threshold, calibrated for each kind on held-out documents, at which precision reaches PRECISION. The trees are trained
here, on labels given by rules (a passing check and fitting surroundings), from counts of every feature combination over
all documents: at most MOST_COMBINATIONS rows reach the driver, a number set by the features' values, not by the data.

Positions are code points, ends exclusive. Null text counts as empty: no spans, and it stays null when redacted. Every row
is judged by its own text, so repeated rows and repeated doc_ids do not matter. Extra columns stay as they are. An empty
table gives an empty result and a model that adds no spans. Of overlapping spans a base span wins over the others.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import text_or_empty

# Kinds in the order of listing, and their patterns (fixed values). Possessive quantifiers and look-behinds do not change
# what matches; they keep very long runs linear. Matches of `card` with fewer than 14 digits could never count.
KINDS = ["email", "ip", "card", "phone", "secret", "iban", "ssn", "tel"]
BASE = 4
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[ -]?[0-9]){13,}+",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
    "secret": r"(?<![A-Za-z0-9_/+=-])[A-Za-z0-9_/+=-]{20,}+",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "tel": r"(?<![0-9+)( .-])\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9])",
}
#: A text without these cannot hold the kind; looked for first, as it is cheap.
NEEDS = {"email": "@", "phone": "+", "ssn": "-"}
HINTS = r"(?i)(token|secret|passw(or)?d|key|iban|account|konto|ssn|social|tel|phone|call|fax)\W*$"

FEATURES = ["kind", "valid", "length", "digits", "distinct", "mixed", "hint", "quote", "before", "after"]
#: 8 kinds x 2 x 6 x 5 x 5 x 2 x 2 x 2 x 4 x 4 values, twice for the two folds.
MOST_COMBINATIONS = 2 * 8 * 2 * 6 * 5 * 5 * 2 * 2 * 2 * 4 * 4
ROUNDS, RATE, PRECISION = 25, 0.4, 0.95
#: Of so many parts of the documents one is held out for thresholds.
FOLDS = 5


@dataclass
class Model:
    """trees: lists of leaves ((feature, op, value), ...) -> weight; thresholds: score from which a kind counts."""

    trees: list[list[tuple[tuple, float]]] = field(default_factory=list)
    thresholds: dict[int, float] = field(default_factory=dict)


def _digits(v: Column) -> Column:
    return F.regexp_replace(v, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    def worth(c: Column, i: Column) -> Column:
        d = c.cast("int") * F.when(i % 2 == 1, 2).otherwise(1)
        return F.when(d > 9, d - 9).otherwise(d)

    reverse = F.filter(F.split(F.reverse(digits), ""), lambda c: c != "")
    return F.aggregate(F.transform(reverse, worth), F.lit(0), lambda a, x: a + x) % 10 == 0


def _iban(v: Column) -> Column:
    """Remainder of the number made by moving the first four characters to the end and writing letters as 10 to 35, digit by digit."""
    plain = F.regexp_replace(v, " ", "")
    moved = F.filter(F.split(F.concat(F.substring(plain, 5, 40), F.substring(plain, 1, 4)), ""), lambda c: c != "")

    def step(a: Column, c: Column) -> Column:
        n = F.when(c.rlike("[0-9]"), c.cast("int")).otherwise(F.ascii(c) - 55)
        return (a * F.when(n > 9, 100).otherwise(10) + n) % 97

    return F.aggregate(moved, F.lit(0), step) == 1


def _valid(kind: str, v: Column) -> Column:
    n = F.length(_digits(v))
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        return F.forall(F.split(v, r"\."), lambda p: F.regexp_replace(p, "^0+(?=[0-9])", "").rlike("^([0-9]|[1-9][0-9]|1[0-9]{2}|2[0-4][0-9]|25[0-5])$"))
    if kind == "card":
        return F.when((n >= 14) & (n <= 19), _luhn(_digits(v))).otherwise(False)
    if kind == "phone":
        return (n >= 10) & (n <= 15)
    if kind == "secret":
        return v.rlike("[0-9]") & v.rlike("[A-Za-z]")
    if kind == "iban":
        return _iban(v)
    if kind == "ssn":
        return ~v.rlike("^(000|666|9)") & ~v.rlike("-00-|-0000$")
    return v.rlike(r"^\(?[2-9]")


def _class(c: Column) -> Column:
    return F.when(F.coalesce(c, F.lit("")) == "", 0).when(c.rlike(r"^[\p{L}\p{N}]$"), 1).when(c.rlike(r"^\s$"), 2).otherwise(3)


def _cut(c: Column, *edges: int) -> Column:
    out = F.lit(0)
    for i, e in enumerate(edges):
        out = F.when(c >= e, i + 1).otherwise(out)
    return out


def _found(text: Column, kind: str) -> tuple[Column, Column]:
    """Matches, and the code points between them."""
    pattern = F.lit(PATTERNS[kind])
    there = text.contains(NEEDS[kind]) if kind in NEEDS else text.rlike(PATTERNS[kind])
    none = F.array().cast("array<string>")
    return F.when(there, F.regexp_extract_all(text, pattern, F.lit(0))).otherwise(none), F.when(there, F.split(text, PATTERNS[kind], -1)).otherwise(none)


def _located(kind: str) -> Column:
    """(kind, start, v) of the matches of a kind: one fold over gaps and matches sums their lengths."""
    matches, gaps = F.col(f"_m_{kind}"), F.col(f"_g_{kind}")
    sizes = F.zip_with(F.slice(gaps, 1, F.size(matches)), matches, lambda g, m: F.struct(F.length(g).alias("g"), F.length(m).alias("m")))
    none = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("starts"))

    def step(a: Column, x: Column) -> Column:
        start = a["at"] + x["g"]
        return F.struct((start + x["m"]).alias("at"), F.array_append(a["starts"], start).alias("starts"))

    starts = F.aggregate(sizes, none, step, lambda a: a["starts"])
    return F.zip_with(starts, matches, lambda start, v: F.struct(F.lit(KINDS.index(kind)).alias("kind"), start.alias("start"), v.alias("v")))


def candidates(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with a column `_found`: array of (start, end, value, and the features) of all candidates of all kinds."""
    text = text_or_empty(text_col)
    df = docs.withColumn("_text", text)
    made = [c for k in KINDS for c in zip((f"_m_{k}", f"_g_{k}"), _found(F.col("_text"), k), strict=True)]
    df = df.withColumns(dict(made))
    df = df.withColumns({f"_s_{k}": _located(k) for k in KINDS})

    def features(k: str):
        def of(c: Column) -> Column:
            v, start = c["v"], c["start"]
            end = start + F.length(v)
            before = F.substring(F.col("_text"), F.greatest(start - 15, F.lit(1)), F.least(start, F.lit(16)))
            digits = F.length(_digits(v)) * 4 / F.length(v)
            letters = F.filter(F.array_distinct(F.split(v, "")), lambda x: x != "")
            return F.struct(
                c["kind"].alias("kind"),
                start.alias("start"),
                end.alias("end"),
                _valid(k, v).cast("int").alias("valid"),
                _cut(F.length(v), 10, 15, 20, 32, 64).alias("length"),
                F.floor(digits).cast("int").alias("digits"),
                _cut(F.size(letters), 5, 9, 13, 20).alias("distinct"),
                (v.rlike("[0-9]") & v.rlike("[A-Za-z]")).cast("int").alias("mixed"),
                before.rlike(HINTS).cast("int").alias("hint"),
                before.rlike("[\"'=:]$").cast("int").alias("quote"),
                _class(F.right(before, F.lit(1))).alias("before"),
                _class(F.substring(F.col("_text"), end + 1, F.lit(1))).alias("after"),
            )

        return of

    found = F.concat(*[F.transform(F.col(f"_s_{k}"), features(k)) for k in KINDS])
    return df.select(*docs.columns, found.alias("_found"))


def label() -> Column:
    """The rule that labels candidates for training: a passing check, and surroundings that fit."""
    clear = (F.col("before") != 1) & (F.col("after") != 1)
    secret = (F.col("mixed") == 1) & (F.col("digits") >= 1) & ((F.col("hint") == 1) | (F.col("quote") == 1))
    return (F.col("valid") == 1) & clear & F.when(F.col("kind") == KINDS.index("secret"), secret).otherwise(True)


def fit(docs: DataFrame) -> Model:
    """Boosted trees from counts over all candidates of `docs`."""
    rows = candidates(docs.select("text")).select(F.explode("_found").alias("c"), (F.pmod(F.xxhash64("text"), F.lit(FOLDS)) == 0).alias("held"))
    rows = rows.select("c.*", "held").withColumn("y", label().cast("int"))
    counts = rows.groupBy(*FEATURES, "held").agg(F.count("*").alias("n"), F.sum("y").alias("ones")).limit(MOST_COMBINATIONS).collect()
    train = [(tuple(r[f] for f in FEATURES), r["n"], r["ones"]) for r in counts if not r["held"]]
    held = [(tuple(r[f] for f in FEATURES), r["n"], r["ones"]) for r in counts if r["held"]]
    model = Model()
    score = [0.0] * len(train)
    for _ in range(ROUNDS if train else 0):
        slope = [(ones - n / (1 + math.exp(-s)), n * math.exp(-abs(s)) / (1 + math.exp(-abs(s))) ** 2) for (_, n, ones), s in zip(train, score, strict=True)]
        tree = _grow(train, slope, list(range(len(train))), ())
        model.trees.append(tree)
        score = [s + _value(tree, x) for (x, _, _), s in zip(train, score, strict=True)]
    for kind in range(BASE, len(KINDS)):
        ranked = sorted(((sum(_value(t, x) for t in model.trees), n, ones) for x, n, ones in held if x[0] == kind), reverse=True)
        n = ones = 0
        for i, (s, more, good) in enumerate(ranked):
            n, ones = n + more, ones + good
            if ones >= PRECISION * n and (i + 1 == len(ranked) or ranked[i + 1][0] < s):
                model.thresholds[kind] = s
    return model


def _holds(x: tuple, test: tuple) -> bool:
    f, op, value = test
    return (x[f] == value) == (op == "==") if op in ("==", "!=") else (x[f] <= value) == (op == "<=")


def _value(tree: list, x: tuple) -> float:
    return next(w for tests, w in tree if all(_holds(x, t) for t in tests))


def _grow(train: list, slope: list, rows: list[int], tests: tuple, depth: int = 3) -> list:
    """Leaves of a tree of Newton steps on the logistic loss."""
    g, h = sum(slope[i][0] for i in rows), sum(slope[i][1] for i in rows)
    best = (1e-6, None)
    if depth:
        for f in range(len(FEATURES)):
            values: dict[int, list[float]] = {}
            for i in rows:
                v = values.setdefault(train[i][0][f], [0.0, 0.0])
                v[0] += slope[i][0]
                v[1] += slope[i][1]
            left_g = left_h = 0.0
            for value in sorted(values):
                left_g, left_h = left_g + values[value][0], left_h + values[value][1]
                one = values[value]
                for op, a, b in (("<=", left_g, left_h), ("==", one[0], one[1])):
                    gain = a * a / (b + 1) + (g - a) ** 2 / (h - b + 1) - g * g / (h + 1)
                    if gain > best[0]:
                        best = (gain, (f, op, value))
    if not best[1]:
        return [(tests, RATE * g / (h + 1))]
    f, op, value = best[1]
    yes = [i for i in rows if _holds(train[i][0], best[1])]
    no = [i for i in rows if not _holds(train[i][0], best[1])]
    if not yes or not no:
        return [(tests, RATE * g / (h + 1))]
    other = (f, {"<=": ">", "==": "!="}[op], value)
    return _grow(train, slope, yes, (*tests, best[1]), depth - 1) + _grow(train, slope, no, (*tests, other), depth - 1)


def _score(model: Model, c: Column) -> Column:
    total = F.lit(0.0)
    for tree in model.trees:
        part = F.lit(0.0)
        for tests, weight in tree:
            hit = F.lit(True)
            for f, op, value in tests:
                x = c[FEATURES[f]]
                hit &= {"==": x == value, "!=": x != value, "<=": x <= value, ">": x > value}[op]
            part = F.when(hit, weight).otherwise(part)
        total = total + part
    return total


def spans(docs: DataFrame, model: Model) -> DataFrame:
    """docs with `base` and `spans`: arrays of (start, rank, end, kind), sorted; spans holds the base ones and those the model adds."""
    df = candidates(docs)
    light = lambda c: F.struct(c["start"].alias("start"), c["kind"].alias("rank"), c["end"].alias("end"), F.element_at(F.array(*map(F.lit, KINDS)), c["kind"] + 1).alias("kind"))
    base = F.array_sort(F.transform(F.filter("_found", lambda c: (c["kind"] < BASE) & (c["valid"] == 1)), light))
    df = df.withColumn("base", base)
    if not model.thresholds:
        return df.withColumn("spans", F.col("base")).drop("_found")

    def chosen(c: Column) -> Column:
        limit = F.lit(None).cast("double")
        for kind, t in model.thresholds.items():
            limit = F.when(c["kind"] == kind, t - 1e-9).otherwise(limit)
        clear = ~F.exists("base", lambda b: (b["start"] < c["end"]) & (c["start"] < b["end"]))
        return F.when(c["kind"] < BASE, False).when(limit.isNull(), False).otherwise((_score(model, c) >= limit) & clear)

    # the score is only worked out where there is a candidate that needs it
    needs = F.exists("_found", lambda c: c["kind"] >= BASE)
    more = F.when(needs, F.transform(F.filter("_found", chosen), light)).otherwise(F.slice("base", 1, 0))
    return df.withColumn("spans", F.array_sort(F.concat("base", more))).drop("_found")


def _count(kind: str) -> Column:
    def same(s: Column) -> Column:
        return s["kind"] == kind

    return F.size(F.filter("base", same)).cast("long").alias(f"n_{kind}")


def listed(spans_col: str) -> Column:
    return F.array_join(F.transform(spans_col, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def find(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """doc_id, counts of the base kinds, base_sha256 and all spans as text."""
    df = spans(docs.select("doc_id", "text"), model or fit(docs))
    counts = map(_count, KINDS[:BASE])
    return df.select(F.col("doc_id").cast("long").alias("doc_id"), *counts, F.sha2(listed("base").cast("binary"), 256).alias("base_sha256"), listed("spans").alias("spans"), F.size("spans").cast("long").alias("n_spans"))


def redact(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """docs with every span in `text` replaced by its kind in brackets; overlapping spans are replaced together, named by the first."""
    # the caller's columns go along in one, so that no name of theirs meets one of ours
    own = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), "text")
    df = spans(own, model or fit(docs))
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(a: Column, s: Column) -> Column:
        fresh = F.concat(a["out"], F.substring(F.col("text"), a["at"] + 1, s["start"] - a["at"]), F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]")))
        return F.struct(F.greatest(a["at"], s["end"]).alias("at"), F.when(s["start"] >= a["at"], fresh).otherwise(a["out"]).alias("out"))

    done = F.aggregate("spans", start, step, lambda a: F.concat(a["out"], F.substring(F.col("text"), a["at"] + 1, F.length("text"))))
    text = F.when(F.col("text").isNotNull() & (F.size("spans") > 0), done).otherwise(F.col("text"))
    return df.select(*[F.col(f"doc.`{c}`") if c != "text" else text.alias("text") for c in docs.columns])
