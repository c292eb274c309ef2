"""Search, near duplicates, fuzzy lines, personal data, quality: against brute force on small fixtures."""

import hashlib
import re

import numpy as np
import pytest

from listmill.llm import lines, near, pii, quality, search
from listmill.llm.queries import read
from listmill.llm.shared import components

from ..conftest import DATA

DOCS = "doc_id long, text string, lang string, source string, n_chars long, set string, root string"


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 200), (100, 300), (7, 7)] + [(500, i) for i in range(501, 560)]
    out = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(out[i] == 0 for i in range(41)) and out[300] == out[200] == 100 and out[559] == 500
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def vectors(spark):
    rng = np.random.default_rng(2)
    rows = [(i, v.tolist(), "x", 1.0) for i, v in enumerate(rng.normal(size=(300, 8)) * np.exp(rng.normal(size=(300, 1))))]
    rows += [(400 + i, rows[0][1], "x", 1.0) for i in range(30)]
    rows += [(500, None, "x", 1.0), (501, [float("nan")] * 8, "x", 1.0), (502, [None] * 8, "x", 1.0), (503, [0.0] * 8, "x", 1.0), (504, [float("inf")] * 8, "x", 1.0), (505, [1.0], "x", 1.0), (506, [], "x", 1.0)]
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>, query_id string, score double")


def test_search(spark):
    data = vectors(spark)
    fine = {r["vec_id"]: np.array(r["embedding"]) for r in data.collect() if r["vec_id"] < 500}
    whole = search.quantised(data)
    near_rows, top_rows = search.nearest(data.where("vec_id % 20 = 0"), data, 10).collect(), search.top_products(whole.where("vec_id % 20 = 0"), whole, 5).collect()
    hit = total = 0
    for q in (i for i in fine if i % 20 == 0):
        d = sorted((float(np.sqrt(((v - fine[q]) ** 2).sum())), i) for i, v in fine.items() if i != q)[:10]
        got = sorted((r["rank"], r["vec_id"], r["score"]) for r in near_rows if r["query_id"] == q)
        hit, total = hit + len({i for _, i in d} & {g[1] for g in got}), total + 10
        assert all(abs(s - float(np.sqrt(((fine[i] - fine[q]) ** 2).sum()))) < 1e-12 for _, i, s in got)
        w = {i: np.floor(256 * v).astype(int) for i, v in fine.items()} | {503: np.zeros(8, int)}
        s = sorted((-int(v @ w[q]), i) for i, v in w.items() if i != q)[:5]
        assert [(r["score"], r["vec_id"]) for r in sorted((r for r in top_rows if r["query_id"] == q), key=lambda r: r["rank"])] == [(-a, i) for a, i in s]
    assert hit >= 0.9 * total
    assert search.nearest(data.limit(0), data.limit(0)).count() == 0


def plain_components(sets, linked):
    names, parent = sorted(sets), {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, i in enumerate(names):
        for j in names[a + 1 :]:
            if root(i) != root(j) and linked(sets[i], sets[j]):
                parent[max(root(i), root(j))] = min(root(i), root(j))
    return {i: root(i) for i in sets}


def near_fixture(spark):
    rng = np.random.default_rng(4)
    base = [" ".join(f"w{rng.integers(5000)}" for _ in range(120)) for _ in range(12)]
    rows = []
    for b, text in enumerate(base):
        for k in range(14):
            words = text.split()
            for _ in range(k % 7):
                words[rng.integers(len(words))] = f"x{rng.integers(10**6)}"
            rows.append((b * 100 + k, " ".join(words).title() if k == 3 else " ".join(words)))
    rows += [(5000, None), (5001, ""), (5002, " \n\t"), (5003, "one two"), (5004, "One\ttwo"), (5005, "a b c"), (5006, "z " * 30_000), (5007, "z " * 20)]
    return spark.createDataFrame([(i, t, "en", "s", 0, "x", "y") for i, t in [*rows, rows[0]]], DOCS), dict(rows)


@pytest.mark.parametrize(("words", "percent"), [(3, 85), (5, 80)])
def test_near_duplicates(spark, words, percent):
    docs, texts = near_fixture(spark)

    def shingles(t):
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").lower())
        return {tuple(w[i : i + words]) for i in range(max(1, len(w) - words + 1))} if w else set()

    sets = {i: shingles(t) for i, t in texts.items()}
    want = plain_components(sets, lambda a, b: bool(a and b) and 100 * len(a & b) >= percent * len(a | b))
    rows = near.near_duplicates(docs, words, percent).collect()
    assert len(rows) == len(texts) + 1
    for r in rows:
        assert (r["n_shingles"], r["component_id"], r["kept"]) == (len(sets[r["doc_id"]]), want[r["doc_id"]], want[r["doc_id"]] == r["doc_id"])
    assert near.near_duplicates(docs.limit(0)).count() == 0


def test_crowded_nodes_branch_and_lose_nothing(spark, monkeypatch):
    monkeypatch.setattr(near, "NODE", 8)
    monkeypatch.setattr(near, "LEVELS", 2)
    monkeypatch.setattr(near, "BLOCK", 4)
    test_near_duplicates(spark, 3, 85)


def test_lines(spark):
    words = "the small house stands near the old river with a green door and three rooms for rent in the quiet town of many hills".split()
    line = " ".join(words)
    rows = [(1, f"{line}\nown one\n\n---"), (2, f"own two\n{line.upper()}!\n\n---"), (3, line.replace("house", "hause")), (4, None), (5, ""), (6, "own one"), (7, "\n".join(f"l{i}" for i in range(5000)) + f"\n{line}")]
    docs = spark.createDataFrame([(i, t, "en", "s", 0, "x", "y") for i, t in [*rows, rows[1]]], DOCS)
    out = {r["doc_id"]: r for r in lines.deduplicate_lines(docs).collect()}
    assert out[1]["text"] == rows[0][1] and out[2]["text"] == "own two\n\n---" and out[6]["text"] == "" and out[4]["text"] is None and out[5]["text"] == ""
    assert out[7]["n_lines"] == 5001 and out[7]["text"].count("\n") == 4999
    both = [lines.normalise(x.encode()) for x in (line, rows[2][1])]
    linked = np.bitwise_count(np.bitwise_xor(*lines.simhashes(both))) <= lines.DISTANCE
    assert out[3]["text"] == ("" if linked else rows[2][1])
    assert lines.deduplicate_lines(docs.limit(0)).count() == 0


def test_lines_equal_brute_force(spark):
    docs = read(spark, DATA, "documents")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    where: dict = {}
    for i in sorted(texts):
        for k, x in enumerate(texts[i].encode().split(b"\n")):
            if clean := lines.normalise(x):
                where.setdefault(clean, []).append((i, k))
    names = sorted(where)
    h = dict(zip(names, lines.simhashes(names).tolist(), strict=True))
    root = plain_components({n: n for n in names}, lambda a, b: (h[a] ^ h[b]).bit_count() <= lines.DISTANCE and lines.alike(a.decode(), b.decode()))
    keep: dict = {}
    for n in names:
        keep[root[n]] = min(keep.get(root[n], (1 << 60, 0)), min(where[n]))
    gone = {o for n in names for o in where[n] if o != keep[root[n]]}
    for r in lines.deduplicate_lines(docs).collect():
        assert r["text"] == "\n".join(x for k, x in enumerate(texts[r["doc_id"]].split("\n")) if (r["doc_id"], k) not in gone)


def edited(rng, line, edits):
    """`line` with so many random edits: letters replaced, left out or added."""
    out = list(line)
    for _ in range(edits):
        i, letter = int(rng.integers(len(out))), "abcdefghijklmnopqrstuvwxyz"[rng.integers(26)]
        out[i : i + 1] = [[letter], [], [out[i], letter]][rng.integers(3)]
    return " ".join("".join(out).split())


@pytest.mark.parametrize("share", [0.0, 0.1])
def test_lines_of_one_edit_or_at_the_threshold_are_found(spark, share):
    """Against brute force on the edit similarity alone, with no SimHash; lines of 10 to 600 characters."""
    rng, rows = np.random.default_rng(8), []
    for i in range(300):
        line = " ".join("".join(chr(97 + c) for c in rng.integers(0, 26, rng.integers(2, 9))) for _ in range(3 + i % 100))[: 10 + 2 * i].strip()
        rows += [(2 * i, line), (2 * i + 1, edited(rng, line, max(1, int(share * len(line)))))]
    want = [i for (i, a), (_, b) in zip(rows[::2], rows[1::2], strict=True) if lines.alike(a, b)]
    docs = spark.createDataFrame([(i, t, "en", "s", 0, "x", "y") for i, t in rows], DOCS)
    gone = {r["doc_id"] - 1 for r in lines.deduplicate_lines(docs).collect() if r["n_dropped"]}
    assert len(want) > 200 and gone <= set(want) and len(gone) >= (0.99 if share == 0 else 0.95) * len(want)


@pytest.mark.parametrize("crowd", [4, 4096])
def test_crowded_keys_lose_nothing(spark, monkeypatch, crowd):
    monkeypatch.setattr(lines, "CROWD", crowd)
    monkeypatch.setattr(lines, "DENSE", 2)
    monkeypatch.setattr(lines, "ROWS_AT_ONCE", 50)
    monkeypatch.setattr(lines, "BLOCK", 8)
    rng = np.random.default_rng(9)
    line = "a quiet house of three rooms near the old river for rent from the first of may"
    docs = spark.createDataFrame([(i, edited(rng, line, 2), "en", "s", 0, "x", "y") for i in range(60)], DOCS)
    assert sum(r["n_dropped"] for r in lines.deduplicate_lines(docs).collect()) == 59


def test_distances_of_many_pairs_equal_those_of_one():
    rng = np.random.default_rng(0)
    a = ["".join("abcdefgh é"[c] for c in rng.integers(0, 10, rng.integers(0, 300))) for _ in range(200)] + ["", "x"]
    b = [edited(rng, x + "end", int(rng.integers(0, 30))) for x in a[:-2]] + ["", ""]
    far = np.full(len(a), 10**9)
    want = [lines.edit_distance(x, y, 10**9) for x, y in zip(a, b, strict=True)]
    assert lines.distances(a, b, far).tolist() == want
    assert (lines.distances(a, b[1:] + b[:1], far // far * 20) <= 20).tolist() == [lines.edit_distance(x, y, 20) <= 20 for x, y in zip(a, b[1:] + b[:1], strict=True)]
    some = lines.letters([x.encode() for x in (*a, *b)]).view(np.uint8).astype(int).reshape(2, len(a), 32)
    assert all(d <= 2 * e for d, e in zip(np.abs(some[0] - some[1]).sum(1).tolist(), want, strict=True))
    most = [int((1 - lines.SIMILARITY) * max(len(x), len(y)) + 1e-9) for x, y in zip(a, b, strict=True)]
    want = [lines.edit_distance(x, y, k) <= k for x, y, k in zip(a, b, most, strict=True)]
    assert lines.alike_pairs(a, b).tolist() == [lines.alike(x, y) for x, y in zip(a, b, strict=True)] == want


def test_lines_replace_columns_of_their_own_names(spark):
    docs = spark.createDataFrame([(1, "a b c\na b c", "mine", 7)], "doc_id long, text string, n_lines string, drop long")
    row = lines.deduplicate_lines(docs).first()
    assert row.asDict() == {"doc_id": 1, "text": "a b c", "drop": 7, "n_lines": 2, "n_dropped": 1}


BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"
}
PII = ["a@b.c_x@y.z", "x" * 3000 + "@a.b", "1.2.3.4.5.6.7.8 256.1.1.1 001.2.3.004", "4111 1111 1111 1111, 4111-1111-1111-1111 4111  1111", "+1 (555) 123-4567+44 20 7946 0958", "1" * 20_000, None, "", "é+49 30 1234567 ü a@é.com a.b@c.d.", "👍 4111111111111111 x", "+1+2+3 +12-"]


def _counts(kind, v):
    digits = [int(c) for c in v if c.isdigit()]
    if kind == "card":
        double = [d * (1 + i % 2) for i, d in enumerate(reversed(digits))]
        return 14 <= len(digits) <= 19 and sum(d - 9 if d > 9 else d for d in double) % 10 == 0
    return {"email": True, "ip": kind != "ip" or all(int(p) <= 255 for p in v.split(".")), "phone": 10 <= len(digits) <= 15}[kind]


def test_pii(spark):
    extra = spark.createDataFrame([(10**6 + i, t, "en", "s", 0, "x", "y") for i, t in enumerate([*PII, PII[0]])], DOCS)
    docs = read(spark, DATA, "documents").select("doc_id", "text").unionByName(extra.select("doc_id", "text"))
    texts = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    model = pii.fit(docs)
    for r in pii.find(docs, model).collect():
        found = sorted((m.start(), i, m.end(), k) for i, (k, p) in enumerate(BASE.items()) for m in re.finditer(p, texts[r["doc_id"]]) if _counts(k, m.group()))
        base = [f"{k}:{a}:{b}" for a, _, b, k in found]
        assert r["base_sha256"] == hashlib.sha256(",".join(base).encode()).hexdigest()
        assert [r[f"n_{k}"] for k in BASE] == [sum(f[3] == k for f in found) for k in BASE]
        assert set(base) <= set(r["spans"].split(",")) or not base
    done = {r["doc_id"]: r["text"] for r in pii.redact(extra, model).collect()}
    assert done[10**6] == "[EMAIL][EMAIL]" and done[10**6 + 6] is None and done[10**6 + 9] == "👍 [CARD] x"
    assert pii.find(extra.limit(0)).count() == 0


def test_pii_keeps_columns_of_any_name_and_takes_many_matches(spark):
    many = " ".join(f"u{i}@ex{i % 7}.org" for i in range(3000))
    docs = spark.createDataFrame([(1, "a@b.c", "mine", "his", "x"), (2, many, "mine", "his", "x")], "doc_id long, text string, base string, spans string, _found string")
    done = {r["doc_id"]: r for r in pii.redact(docs, pii.Model()).collect()}
    assert done[1].asDict() == {"doc_id": 1, "text": "[EMAIL]", "base": "mine", "spans": "his", "_found": "x"}
    assert done[2]["text"] == " ".join(["[EMAIL]"] * 3000)
    assert [r["n_email"] for r in pii.find(docs, pii.Model()).orderBy("doc_id").collect()] == [1, 3000]


def test_quality_on_held_out_labels(spark):
    sf = DATA.replace("sf0.001", "sf0.01")
    docs, labels = read(spark, sf, "documents"), read(spark, sf, "labels")
    kept = {r["doc_id"]: r["kept"] for r in quality.classify(docs, labels).collect()}
    assert len(kept) == 1000
    rows = labels.collect()
    good = [kept[r["doc_id"]] for r in rows if r["quality"] == 1 and not r["toxic"]]
    bad = [kept[r["doc_id"]] for r in rows if r["quality"] == 0]
    assert sum(good) >= 0.97 * len(good) and sum(bad) <= 0.15 * len(bad)
    odd = spark.createDataFrame([(-1, None, "en", "s", 0, "x", "y"), (-2, "", None, "s", 0, "x", "y"), (-3, "word " * 50_000, "xx", "s", 0, "x", "y")], DOCS)
    assert quality.keep_good(odd, labels).count() == 3
    assert quality.classify(docs.limit(0), labels).count() == 0


def test_kneser_ney_sums_to_one(spark):
    trusted = spark.createDataFrame([("en", "the cat sat on the mat the hat"), ("en", "a rat ate that")], "lang string, text string")
    rows = quality.train(trusted).collect()
    logp = {r["g"]: r["logp"] for r in rows if r["logp"] is not None}
    scores = quality._Scores(logp, {r["g"]: r["bow"] for r in rows if r["bow"] is not None and r["g"]})
    letters = sorted({g[-1] for g in logp if g})

    def p(h, c):
        total = 0.0
        for j in range(len(h) + 1):
            if h[j:] + c in logp:
                return np.exp(total + logp[h[j:] + c])
            total += scores.bow.get(h[j:], 0.0)
        return np.exp(total + logp[""])

    for h in ("", "t", "\x02t", "\x02th", "zz"):
        assert abs(sum(p(h, c) for c in letters) + np.exp(logp[""]) * np.exp(sum(scores.bow.get(h[j:], 0.0) for j in range(len(h)))) - 1) < 0.02


def test_blocks_of_unlike_lines_need_few_edit_distances(monkeypatch):
    """Lines of the same few words pass the SimHash, but not the numbers of their letters; links are those of brute force."""
    rng, decided = np.random.default_rng(4), []
    words = [edited(rng, "lorem ipsum dolor", 9)[:7].replace(" ", "x") for _ in range(40)]
    rows = [" ".join(words[k] for k in rng.integers(0, 40, 12)) for _ in range(150)]
    rows += [edited(rng, x, 3) for x in rows[1:51]]
    some = [lines.normalise(x.encode()) for x in rows]
    side = np.where(np.arange(len(some)) % 2, 1, -1)
    h, whole = lines.simhashes(some), lines.alike_pairs
    monkeypatch.setattr(lines, "alike_pairs", lambda a, b: (decided.extend(a), whole(a, b))[1])
    for sides in (side, 0 * side):
        passed = [(i, j) for i in range(len(some)) for j in range(i) if (h[i] ^ h[j]).bit_count() <= lines.DISTANCE and (not sides[i] or sides[i] != sides[j])]
        want = {(i, j) for i, j in passed if lines.alike(some[i].decode(), some[j].decode())}
        decided.clear()
        links = lines.block_links(some, sides)
        assert len(decided) < len(passed) / 5
        roots = [plain_components({i: i for i in range(len(some))}, lambda a, b, found=found: (max(a, b), min(a, b)) in found) for found in ({(max(x), min(x)) for x in links}, want)]
        assert roots[0] == roots[1] and len(want) > 10


def test_passes_have_all_keys_once():
    rng = np.random.default_rng(5)
    some = [bytes(rng.integers(97, 123, n).astype(np.uint8)) for n in np.geomspace(lines.SHORTEST, 900, 120).astype(int)]
    chars = np.array(list(map(len, some)))
    rows = lambda *classes: list(zip(*(c.tolist() for c in lines.keys(some, chars, *classes)), strict=True))
    parts = [rows(classes) for classes in lines.PASSES]
    assert sorted(sum(parts, [])) == sorted(rows()) and max(map(len, parts)) < 0.7 * len(rows())


def test_letters_are_fetched_only_for_lines_not_yet_connected(spark, monkeypatch):
    rng, asked, whole = np.random.default_rng(6), [], lines._passing
    row = "".join(map(chr, rng.integers(97, 123, 200)))
    docs = spark.createDataFrame([(i, row[: 8 * i] + "#" + row[8 * i + 1 :].replace("#", "x") + "ab"[i % 2]) for i in range(12)], "doc_id long, text string")
    monkeypatch.setattr(lines, "_passing", lambda some, pairs: (asked.append(pairs.count()), whole(some, pairs))[1])
    assert sum(r["n_dropped"] for r in lines.deduplicate_lines(docs).collect()) == 11
    assert asked[0] > 0 and asked[1] == 0


def test_lines_of_several_crowded_nodes_are_compared_in_the_least_alone(spark):
    rng = np.random.default_rng(7)
    rows = ["".join(map(chr, rng.integers(97, 123, 90))) for _ in range(30)]
    rows += [edited(rng, x, 3) for x in rows[:20]]
    clean = [lines.normalise(x.encode()) for x in rows]
    assert lines.block_links(clean, np.zeros(len(clean), int))
    held = [np.array([5] if i % 2 else [5, 6]) for i in range(len(clean))]
    assert lines.links_of_blocks([(clean, np.zeros(len(clean), int), held)]) == [[]]  # all share node 5
    some = spark.createDataFrame([(i, len(x), bytearray(x)) for i, x in enumerate(clean)], "line long, bytes int, clean binary")
    nodes = spark.createDataFrame([(i, n) for i in range(len(clean)) for n in ((1, 2) if i < 25 else (2, 3) if i < 40 else (1, 3))], "line long, node long")
    got = {(min(x), max(x)) for x in lines._decided(some.select("line", "clean"), some, spark.createDataFrame([], "a long, b long"), nodes).collect()}
    want = {(i, j) for i in range(len(rows)) for j in range(i + 1, len(rows)) if lines.alike(clean[i].decode(), clean[j].decode())}
    assert got == want and len(want) >= 15


def test_lines_of_other_n_grams_need_no_edit_distance(monkeypatch):
    rng, decided, whole = np.random.default_rng(8), [], lines.distances
    words = ["".join("abcdefghij éçã"[c] for c in rng.integers(0, 10, 7)) + "é" for _ in range(60)]
    a = [" ".join(words[k] for k in rng.permutation(60)[:40]) for _ in range(150)]
    b = [x[::-1] if i % 2 else edited(rng, x, 9) for i, x in enumerate(a)]
    monkeypatch.setattr(lines, "distances", lambda a, b, most: (decided.extend(a), whole(a, b, most))[1])
    assert lines.alike_pairs(a, b).tolist() == [lines.alike(x, y) for x, y in zip(a, b, strict=True)]
    assert 60 <= len(decided) <= 80


def test_only_lines_with_candidates_are_joined(spark, monkeypatch):
    rng, joined, whole = np.random.default_rng(9), [], lines._passing
    rows = ["".join(map(chr, rng.integers(97, 123, 120))) for _ in range(40)]
    docs = spark.createDataFrame(list(enumerate([*rows, rows[0][:60] + "#x" + rows[0][61:]])), "doc_id long, text string")
    monkeypatch.setattr(lines, "_passing", lambda some, pairs: (joined.append(some.count()), whole(some, pairs))[1])
    assert sum(r["n_dropped"] for r in lines.deduplicate_lines(docs).collect()) == 1
    assert joined[0] == 2
