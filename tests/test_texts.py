"""Matching-block ratios and folding against the standard library."""

import random
import re
import unicodedata
from difflib import SequenceMatcher

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from listmill.functions import columns as C
from listmill.functions import similarity


def by_library(a, b):
    a, b = (re.sub(r"\W+", "", x[:160].lower()) for x in (a, b))
    return SequenceMatcher(None, a, b).ratio() if a and b else 0.0


def test_ratio_of_ten_thousand_pairs():
    rng = random.Random(7)
    words = ["Moradia", "T3", "em", "Gondomar", "250.000 €", "área", "útil", "120 m²", "com", "garagem", "aaaa", "abab", "Rua_1"]
    pairs = []
    for _ in range(10_000):
        a = " ".join(rng.choices(words, k=rng.randint(0, 8)))
        b = " ".join(rng.sample(a.split(), len(a.split()))) if rng.random() < 0.5 else " ".join(rng.choices(words, k=rng.randint(0, 8)))
        pairs.append((a, "".join(c for c in b if rng.random() > 0.1)))
    got = similarity.ratios([similarity.plain(a) for a, _ in pairs], [similarity.plain(b) for _, b in pairs])
    assert [round(x, 12) for x in got] == [round(by_library(a, b), 12) for a, b in pairs]


@settings(max_examples=300, deadline=None)
@given(st.text("abcé1 ", max_size=200), st.text("abcé1 ", max_size=200))
def test_ratio(a, b):
    assert similarity.ratios([similarity.plain(a)], [similarity.plain(b)])[0] == pytest.approx(by_library(a, b))


def test_closest(spark):
    rows = [("Moradia T3", ["x", None, "moradia t3!", "T3"]), ("a", []), (None, ["a"]), ("a", None), ("", [""]), ("y" * 5000, ["y" * 160 + "z"])]
    out = spark.createDataFrame(rows, "s string, o array<string>").select(similarity.closest(F.col("s"), F.col("o"))).collect()
    assert [r[0] for r in out] == [1.0, 0.0, 0.0, 0.0, 0.0, 1.0]


def test_folding_of_every_latin_letter(spark):
    letters = [chr(i) for i in range(0x80, 0xFFFF) if unicodedata.category(chr(i))[0] == "L" and "LATIN" in unicodedata.name(chr(i), "")]
    texts = [f"x{c}y" for c in letters] + ["  Á  B ", "m²", "日本", "№ 5…"]
    want = [unicodedata.normalize("NFKD", " ".join(t.split()).lower()).encode("ascii", "ignore").decode() for t in texts[:-1]]
    got = [r[0] for r in spark.createDataFrame(list(enumerate(texts)), "i int, t string").orderBy("i").select(C.fold_text(F.col("t"))).collect()]
    assert len(letters) > 1000 and [(t, g) for t, g, w in zip(texts, got, want, strict=False) if g != w] == []
