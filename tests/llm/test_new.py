"""Alignment, spelling variants, benchmark passages: against plain versions on small fixtures."""

import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from listmill.llm import alignment, bpe, contamination, spelling
from listmill.llm.queries import PIECES, VOCABULARY, read

from ..conftest import DATA

DOCS = "doc_id long, text string, lang string, word string, block string, spans string, item_ids string, n long"


def documents(spark, texts, ids=None):
    rows = [(i, t, "en", "x", "y", "z", "u", 7) for i, t in zip(ids or range(len(texts)), texts, strict=True)]
    return spark.createDataFrame(rows, DOCS)


# --- op11 -------------------------------------------------------------------------------------------------------------

library_a, library_b = Tokenizer.from_file(VOCABULARY), sentencepiece.SentencePieceProcessor(model_file=PIECES)
library_a.encode_special_tokens = True
LETTERS = {c: b for b, c in enumerate(bpe.byte_letters())}


def plain_tokens(text):
    """(ids, end bytes) of both, by the libraries alone; None if the bytes differ."""
    if not text:
        return None
    out = []
    ids = library_a.encode(" " + text, add_special_tokens=False).ids
    out.append((ids, [bytes(LETTERS[c] for c in library_a.id_to_token(i)) for i in ids]))
    ids = library_b.encode(text)
    out.append((ids, [bytes([int(library_b.id_to_piece(i)[3:5], 16)]) if library_b.is_byte(i) else library_b.id_to_piece(i).replace("▁", " ").encode() for i in ids]))
    if any(b"".join(s) != (" " + text).encode() for _, s in out):
        return None
    return [(ids, np.cumsum([len(s) for s in strings]).tolist()) for ids, strings in out]


def plain_alignment(texts):
    """The contract's columns of each text, pair by pair."""
    linked, made = [], []
    for text in texts:
        t = plain_tokens(text)
        if t is None:
            linked.append([])
            made.append((0, 0, 0, 0, ""))
            continue
        (a, x), (b, y) = t
        starts = [0, *x], [0, *y]
        links = [(a[i], b[j]) for i in range(len(a)) for j in range(len(b)) if max(starts[0][i], starts[1][j]) < min(x[i], y[j])]
        cuts = sorted(set(x) & set(y))
        groups, low = [], 0
        for c in cuts:
            groups.append(",".join(str(k) for k, e in zip(a, x, strict=True) if low < e <= c) + "|" + ",".join(str(k) for k, e in zip(b, y, strict=True) if low < e <= c))
            low = c
        linked.append(links)
        made.append((len(a), len(b), len(cuts), len(links), hashlib.sha256(";".join(groups).encode()).hexdigest()))
    count = Counter(p for links in linked for p in links)
    top: dict = {}
    for (_, b), n in count.items():
        top[b] = max(top.get(b, 0), n)
    return [(n_a, n_b, n_g, n_l, sum(count[p] == top[p[1]] for p in links), sum(count[p] for p in links), sha) for (n_a, n_b, n_g, n_l, sha), links in zip(made, linked, strict=True)]


ODD = ["a  b", " lead", "trail ", "\n", "a \n b", "", None, "x▁y", "<|endoftext|> it's <s>ok</s>", "tab\tx\r\ny", "nbsp y 　z", "日本語 テキスト", "é ²³ ½x", "👍🏽 ok", "<0x0A>", "\u0000 null", "one two one two", "one two one two", "ab" * 300, "la de "]


def test_alignment_equals_the_plain_version(spark, monkeypatch):
    texts = ODD + [r["text"][:600] for r in read(spark, DATA, "documents").orderBy("doc_id").limit(40).collect()]
    want = plain_alignment(texts)
    for stretch, size in ((1024, 6 << 20), (3, 500)):  # stretches and blocks within texts give the same
        made = alignment.lockstep.__defaults__
        monkeypatch.setattr(alignment.lockstep, "__defaults__", (stretch,))
        monkeypatch.setattr(alignment, "BLOCK_BYTES", size)
        both = alignment.aligner(bpe.read_vocabulary(VOCABULARY), open(PIECES, "rb").read())
        a, b, left, right, cut = both.block(texts)
        order = np.lexsort((right, left))
        assert (order == np.arange(len(left))).all() and len(left) == sum(w[3] for w in want) and cut.sum() == sum(w[2] for w in want)
        rows = alignment.alignment_digests(documents(spark, texts).repartition(3), VOCABULARY, PIECES).collect()
        got = {r["doc_id"]: (r["n_a"], r["n_b"], r["n_groups"], r["n_links"], r["n_best"], r["count_sum"], r["groups_sha256"]) for r in rows}
        assert len(rows) == len(texts)
        assert [got[i] for i in range(len(texts))] == want
        monkeypatch.setattr(alignment.lockstep, "__defaults__", made)


def test_aligned_documents(spark):
    texts = ["one two thréé", None, "日本語 a  b"]
    for r in alignment.align_documents(documents(spark, texts), VOCABULARY, PIECES).collect():
        t = plain_tokens(texts[r["doc_id"]])
        if t is None:
            assert (r["a_ids"], r["b_ids"], r["links"], r["cuts"]) == ([], [], [], [])
            continue
        (a, x), (b, y) = t
        assert (r["a_ids"], r["b_ids"], r["cuts"]) == (a, b, sorted(set(x) & set(y)))
        assert [tuple(p) for p in r["links"]] == [(i, j) for i in range(len(a)) for j in range(len(b)) if max([0, *x][i], [0, *y][j]) < min(x[i], y[j])]


def test_alignment_of_nothing(spark):
    assert alignment.alignment_digests(documents(spark, ["a"]).limit(0), VOCABULARY, PIECES).count() == 0
    rows = alignment.alignment_digests(documents(spark, [None, ""], [None, 3]), VOCABULARY, PIECES).collect()
    assert sorted(map(tuple, rows), key=str) == [(3, 0, 0, 0, 0, 0, 0, ""), (None, 0, 0, 0, 0, 0, 0, "")]


@settings(max_examples=200, deadline=None)
@given(st.text(st.sampled_from(list("abTH ▁é'\n\t .,<s>日👍")) | st.characters(codec="utf-8"), max_size=30))
def test_encoders_equal_the_libraries(text):
    both = alignment.aligner(bpe.read_vocabulary(VOCABULARY), open(PIECES, "rb").read())
    want = plain_tokens(text)
    a, b, *_ = both.block(["one two", text, text + " one"])
    ids = [x.ids[x.first[1] : x.first[2]].tolist() for x in (a, b)]
    assert ids == ([want[0][0], want[1][0]] if want else [[], []])
    assert alignment.odd_space(text) == bool(not text or bpe.ODD_SPACE.search(text))


# --- op12 -------------------------------------------------------------------------------------------------------------


def one_edit(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    short, long = sorted((a, b), key=len)
    return any(long[:i] + long[i + 1 :] == short for i in range(len(long)))


def plain_variants(rows, rarest=3):
    count: Counter = Counter()
    for doc, text in rows:
        for w in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in w)
            h = zlib.crc32(f"{'' if doc is None else doc}:{w}".encode())
            if h % 97 == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            if len(w) >= 5:
                count[w] += 1
    words = {w: n for w, n in count.items() if n >= rarest}
    near = {w: [v for v in words if one_edit(w, v)] for w in words}
    form = {w: (v if words[v] >= 2 * n else None) for w, n in words.items() for v in [min(near[w], key=lambda v: (-words[v], v), default=None)] if v is not None}

    def root(w):
        return root(form[w]) if form.get(w) else w

    return sorted((w, form.get(w), root(w), n, len(near[w]), words[form[w]] if form.get(w) else None) for w, n in words.items()), sorted((w, v) for w in near for v in near[w])


def invented(rng, n):
    """Words of few letters, so that runs of equal letters and near words abound."""
    return ["".join(rng.choice(list("aabéz"), rng.integers(4, 9))) for _ in range(n)]


@pytest.mark.parametrize("key_words", [20_000, 3])
def test_spelling_variants_equal_the_plain_version(spark, monkeypatch, key_words):
    monkeypatch.setattr(spelling, "KEY_WORDS", key_words)  # 3: nearly every half is dealt to blocks
    monkeypatch.setattr(spelling, "SHARD_WORDS", 200)
    monkeypatch.setattr(spelling, "TOGETHER", 50)
    rng = np.random.default_rng(4)
    pool = invented(rng, 250)
    texts = [" ".join(rng.choice(pool, 60)) + ", Été×Zaaab; x1aaaab" for _ in range(40)] + [None, "", "1 2 3", "Aaaab " * 500]
    rows = [*enumerate(texts), (0, texts[0]), (None, texts[1])]
    docs = documents(spark, [t for _, t in rows], [i for i, _ in rows])
    want, pairs = plain_variants(rows)
    got = sorted((r["word"], r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in spelling.spelling_variants(docs).collect())
    assert len(want) > 100 and got == want
    words = spelling.count_words(docs).where("n >= 3")
    assert sorted((r["word"], r["near"]) for r in spelling.near_words(words).collect()) == pairs


def test_spelling_of_nothing(spark):
    assert spelling.spelling_variants(documents(spark, ["a"]).limit(0)).count() == 0
    assert spelling.spelling_variants(documents(spark, ["abc", None])).count() == 0
    assert [tuple(r) for r in spelling.spelling_variants(documents(spark, ["single single single"], [1])).collect()] == [("single", None, "single", 3, 0, None)]


def test_counts_in_parts(spark, monkeypatch):
    monkeypatch.setattr(spelling, "HELD", 5)
    docs = documents(spark, ["alpha betas gamma delta epsilon zetas etaaa thetas"] * 30)
    n = Counter()
    for i in range(30):
        for w in "alpha betas gamma delta epsilon zetas etaaa thetas".split():
            w = spelling.seeded(zlib.crc32(f"{i}:".encode()), w)
            n.update([w] if len(w) > 4 else [])
    assert {r["word"]: r["n"] for r in spelling.count_words(docs).collect()} == n


@settings(max_examples=100, deadline=None)
@given(st.lists(st.text("abé", min_size=4, max_size=8), min_size=1, max_size=40, unique=True))
def test_index_finds_what_shares_the_left_half(words):
    found = spelling.BidirectionalIndex(words).near(words)
    got = sorted(zip(*(x.tolist() for x in found), strict=True))
    want = [(i, j) for i, a in enumerate(words) for j, b in enumerate(words) if one_edit(a, b) and b.startswith(a[: len(a) // 2])]
    assert got == want  # each once


# --- op13 -------------------------------------------------------------------------------------------------------------


def plain_words(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def plain_contamination(docs, items, window):
    out = []
    for doc, text in docs:
        words, hit, names = plain_words(text), set(), set()
        for name, item in items:
            w = plain_words(item)
            m = min(window, len(w))
            for k in range(len(w) - m + 1 if m else 0):
                for i in range(len(words) - m + 1):
                    if words[i : i + m] == w[k : k + m]:
                        hit |= {*range(i, i + m)}
                        names.add("" if name is None else str(name))
        out.append((doc, len(words), len(hit), len(names), hashlib.sha256(",".join(sorted(names)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


@pytest.mark.parametrize(("part", "piece"), [(2 << 20, 512), (60, 2)])
def test_contamination_equals_the_plain_version(spark, monkeypatch, part, piece):
    monkeypatch.setattr(contamination, "PART_BYTES", part)  # 60: many parts, state carried from one to the next
    monkeypatch.setattr(contamination, "PIECE", piece)
    rng = np.random.default_rng(6)
    pick = lambda n: " ".join(rng.choice(["a", "b", "É", "c9"], n))
    texts = [pick(int(rng.integers(0, 60))) for _ in range(60)] + [None, "", "...", "A,B;a\x00b c9", "the The THE"]
    items = [(i, pick(int(rng.integers(4, 14)))) for i in range(12)] + [(20, "b"), (21, None), (22, "--"), (2, "c9 É"), (None, "the the"), (3, "a b"), (3, "a b")]
    docs, table = documents(spark, [*texts, texts[0]], [*range(len(texts)), 0]), spark.createDataFrame(items, "item_id long, text string")
    got = contamination.digests(contamination.find_occurrences(docs, table, window=5)).collect()
    want = plain_contamination([*enumerate(texts), (0, texts[0])], items, 5)
    assert sorted(((r["doc_id"], r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"], r["contaminated"]) for r in got), key=str) == want
    assert any(w[5] for w in want) and not all(w[5] for w in want)


def test_contamination_of_nothing(spark):
    docs, items = documents(spark, ["one two"]), spark.createDataFrame([(1, "one two")], "item_id long, text string")
    assert contamination.find_occurrences(docs.limit(0), items).count() == 0
    assert [tuple(r) for r in contamination.find_occurrences(docs, items.limit(0)).collect()] == [(0, 2, [], [])]


def test_search_skips_positions():
    """Of words that no pattern holds the search looks at about every ninth place only."""
    table, = contamination.tables([("i", b" ".join(b"w%d" % i for i in range(30)))], 10)
    looked = []

    class Counted(dict):
        def get(self, key, other=None):
            looked.append(key)
            return dict.get(self, key, other)

    table.shift = Counted(table.shift)
    words = [b"x%d" % i for i in range(900)] + [b"w%d" % i for i in range(3, 13)]
    hit, found = bytearray(len(words)), set()
    table.search(words, hit, found)
    assert sum(hit) == 10 and len(found) == 1 and len(looked) < 120
