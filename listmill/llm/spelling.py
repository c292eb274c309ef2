"""Spelling variants of the words of a corpus: words one edit apart, found in bidirectional FM-indexes.

Words are maximal runs of letters (A-Z, a-z, U+00C0 to U+00FF), A-Z lower-cased, with the contract's seeded deletions, of at least
5 code points and 3 occurrences. Two words are near if one inserted, deleted or replaced code point turns one into the other. Then
the word's left or its right half stands unchanged in the other. So each half is a search scheme of its own: match the half exactly
from its inner end out to the word's border, then extend over the other half, allowing one error, up to the other border.

Extending both ways needs a bidirectional FM-index: the delimited words of a shard as one cyclic text, its Burrows-Wheeler transform
and that of the reversed text, each as a wavelet matrix. A pattern is an interval of suffix ranks in both; counting symbols, and
smaller symbols, in the interval of one keeps the other in step. All patterns of a shard advance together in numpy.

A word stands in the shard of each half by which a word of one letter more or less, or of its own length, may look for it, and looks
in the shard of its own half (len // 2 letters); the right half is the same on reversed words. A half that more than KEY_WORDS words share is dealt to
blocks of holders times blocks of askers, so that no task gets it whole. Near words met from both halves count at the left one only.

Results: a row for each word. Null, empty and letterless texts have no words; a null doc_id counts as '' in the seed of the deletions;
repeated rows count each; an empty table gives an empty result. Only doc_id and text are read, so that further columns cannot clash.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import broadcast_if_few, give_back, written

#: A maximal run of letters, after A-Z have been lower-cased.
RUN = re.compile("[a-zÀ-ÿ]+")
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
#: Least code points and occurrences of a word; every SEED-th run of a document loses a code point.
SHORTEST, RAREST, SEED = 5, 3, 97
#: Words that a task counts before it hands them on.
HELD = 200_000
#: Words of a shard on average, and words of one half above which it is dealt to blocks.
SHARD_WORDS, KEY_WORDS = 8_000, 20_000
#: Askers that advance together.
TOGETHER = 4_096
#: Pointer-jumping rounds; each doubles the length of chains followed, and a form occurs twice as often as its word.
ROUNDS = 8


def seeded(head: int, word: str) -> str:
    """The run as it is counted: without one code point where its checksum, continued from the document's `head`, says so."""
    h = crc32(word.encode(), head)
    return word if h % SEED else word[: (at := h % len(word))] + word[at + 1 :]


def count_words(docs: DataFrame) -> DataFrame:
    """word, n: words of at least SHORTEST code points and their occurrences in all documents."""

    def rows(held: dict[str, int]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())], ["word", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, int] = {}
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                for doc, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    head = crc32(f"{doc}:".encode())
                    for word, n in Counter(RUN.findall(text.translate(LOWER).decode())).items():
                        if len(word) >= SHORTEST and len(word := seeded(head, word)) >= SHORTEST:
                            held[word] = held.get(word, 0) + n
                    if len(held) > HELD:
                        yield rows(held)
                        held = {}
        if held:
            yield rows(held)

    docs = docs.where("text IS NOT NULL").select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("doc_id"), F.col("text").cast("binary").alias("text"))
    return docs.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


class Wavelet:
    """A wavelet matrix: symbols below 2**bits, counted in any interval in one pass over the bits."""

    def __init__(self, symbols: np.ndarray, sigma: int):
        self.bits = max(1, int(sigma - 1).bit_length())
        self.ones, self.zeros, level = [], [], symbols
        for b in reversed(range(self.bits)):
            bit = level >> b & 1
            self.ones.append(np.concatenate(([0], np.cumsum(bit))).astype(np.int32))
            self.zeros.append(len(bit) - int(self.ones[-1][-1]))
            level = np.concatenate((level[bit == 0], level[bit == 1]))
        every = np.arange(sigma)
        start = self._down(every, np.zeros(sigma, np.int32), np.zeros(sigma, np.int32))[0]
        self.base = (np.concatenate(([0], np.cumsum(np.bincount(symbols, minlength=sigma))))[:-1] - start).astype(np.int32)

    def _down(self, c: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        smaller = np.zeros(len(lo), np.int32)
        for b, ones, zeros in zip(reversed(range(self.bits)), self.ones, self.zeros, strict=True):
            bit, a, z = (c >> b & 1).astype(bool), ones[lo], ones[hi]
            smaller += np.where(bit, (hi - lo) - (z - a), 0)
            lo, hi = np.where(bit, zeros + a, lo - a), np.where(bit, zeros + z, hi - z)
        return lo, hi, smaller

    def extend(self, c: np.ndarray, lo: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Interval start and size after one more symbol `c`, and how far the other direction's interval moves."""
        a, z, smaller = self._down(c, lo, lo + size)
        return self.base[c] + a, z - a, smaller

    def children(self, lo: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Every symbol that occurs in each interval: row, symbol, start and size after it, move of the other interval."""
        row, c, hi = np.arange(len(lo)), np.zeros(len(lo), np.int64), lo + size
        smaller = np.zeros(len(lo), np.int32)
        for ones, zeros in zip(self.ones, self.zeros, strict=True):
            a, z = ones[lo], ones[hi]
            none = (hi - lo) - (z - a)
            left, right = none > 0, z > a
            lo, hi = np.concatenate(((lo - a)[left], (zeros + a)[right])), np.concatenate(((hi - z)[left], (zeros + z)[right]))
            row, c = np.concatenate((row[left], row[right])), np.concatenate((c[left] << 1, c[right] << 1 | 1))
            smaller = np.concatenate((smaller[left], (smaller + none)[right]))
        return row, c, self.base[c] + lo, hi - lo, smaller


def suffix_ranks(text: np.ndarray, bits: int) -> np.ndarray:
    """Starts of the rotations of a cyclic text in order; no two rotations are equal."""
    n, step = len(text), 60 // bits
    key = np.zeros(n, np.int64)
    for k in range(step):
        key = key << bits | np.roll(text, -k)
    while True:
        order = np.argsort(key, kind="stable")
        ranks = np.empty(n, np.int64)
        ranks[order] = np.concatenate(([0], np.cumsum(np.diff(key[order]) != 0)))
        if ranks[order[-1]] == n - 1:
            return order
        key, step = ranks * n + np.roll(ranks, -step), 2 * step


class BidirectionalIndex:
    """Distinct words, each between delimiters, as one cyclic text that is searched by extending patterns to the left or the right."""

    def __init__(self, words: list[str]):
        points = np.frombuffer(("\0".join(words) + "\0").encode("utf-32-le"), "<u4").astype(np.int64)
        self.letters, text = np.unique(points, return_inverse=True)  # the delimiter is the smallest
        sigma, self.size = len(self.letters), len(text)
        bits = max(1, int(sigma - 1).bit_length())
        order, back = suffix_ranks(text, bits), suffix_ranks(text[::-1], bits)
        self.left, self.right = Wavelet(text[order - 1], sigma), Wavelet(text[::-1][back - 1], sigma)
        number = np.concatenate(([0], np.cumsum(text == 0)))[:-1]
        self.word_at = number[(order + 1) % self.size]  # the word behind the delimiter at which a rotation starts

    def symbols(self, text: str) -> np.ndarray:
        return np.searchsorted(self.letters, np.frombuffer(text.encode("utf-32-le"), "<u4"))

    def near(self, askers: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(asker, word) numbers: words that begin with the asker's left half, its len // 2 first letters, and differ by one edit beyond it."""
        pattern = self.symbols("".join(w + "\0" for w in askers))  # all letters of askers occur in the index
        length = np.fromiter(map(len, askers), np.int64, len(askers))
        begin, half = np.concatenate(([0], np.cumsum(length + 1)))[:-1], length // 2
        lo, other, size = self._halves(pattern, begin, half)
        q, p = np.arange(len(askers)), half.copy()  # patterns without an error: all of them stand as far behind their half
        found: list[tuple[np.ndarray, np.ndarray]] = []
        late: list[np.ndarray] = [np.empty(0, np.int64) for _ in range(5)]  # patterns with their error: asker, place, intervals
        while len(q) or len(late[0]):
            late = self._further(pattern, begin, length, late, found)
            x, last = pattern[begin[q] + p], p == length[q]
            row, c, o2, s2, moved = self.right.children(other, size)
            spare, l2 = (c != x[row]) & (c != 0), lo[row] + moved
            grown = [(q[row][spare], p[row][spare], l2[spare], o2[spare], s2[spare])]  # the word has one letter more here
            changed = spare & ~last[row]
            grown.append((q[row][changed], p[row][changed] + 1, l2[changed], o2[changed], s2[changed]))
            cut = ~last
            cut[cut] = pattern[begin[q[cut]] + p[cut] + 1] != x[cut]  # of a run of equal letters the last one is left out
            grown.append((q[cut], p[cut] + 1, lo[cut], other[cut], size[cut]))
            late = [np.concatenate((a, *(g[k] for g in grown))) for k, a in enumerate(late)]
            on = (c == x[row]) & (c != 0)
            q, p, lo, other, size = q[row][on], p[row][on] + 1, l2[on], o2[on], s2[on]
        if not found:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        a, b = (np.concatenate(x) for x in zip(*found, strict=True))
        return a, b

    def _halves(self, pattern: np.ndarray, begin: np.ndarray, half: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Both intervals of each asker's left half, matched from its inner end to the delimiter before the word."""
        lo, other, size = np.zeros(len(begin), np.int64), np.zeros(len(begin), np.int64), np.full(len(begin), self.size, np.int64)
        for k in range(int(half.max(initial=0)) + 1):
            now = np.flatnonzero(half >= k)
            inner = half[now] - 1 - k
            c = np.where(inner >= 0, pattern[begin[now] + np.maximum(inner, 0)], 0)
            lo[now], size[now], moved = self.left.extend(c, lo[now], size[now])
            other[now] += moved
        return lo, other, size

    def _further(self, pattern, begin, length, late, found) -> list[np.ndarray]:
        """Patterns with their error, one symbol on; whole words go to `found`."""
        q, p, lo, other, size = late
        other, size, moved = self.right.extend(pattern[begin[q] + p], other, size)
        alive = size > 0
        q, p, lo, other, size = q[alive], p[alive] + 1, (lo + moved)[alive], other[alive], size[alive]
        done = p > length[q]
        if done.any():
            found.append((q[done], self.word_at[lo[done]]))
        on = ~done
        return [q[on], p[on], lo[on], other[on], size[on]]


def shard_pairs(side: int, words: list[str], asks: list[bool], holds: list[bool]) -> tuple[list[int], list[int]]:
    """Rows (asker, near word) of a shard; on side 1 words are read from behind, and pairs that side 0 meets are left out."""
    turned = [w[::-1] for w in words] if side else words
    first = {w: i for i, (w, h) in enumerate(zip(turned, holds, strict=True)) if h}  # a word may stand here under two halves
    askers = [i for i, a in enumerate(asks) if a]
    if not first or not askers:
        return [], []
    index, rows = BidirectionalIndex([*first, *{turned[i] for i in askers} - set(first)]), [*first.values()]
    left, right = [], []
    for at in range(0, len(askers), TOGETHER):
        some = askers[at : at + TOGETHER]
        for q, w in zip(*(x.tolist() for x in index.near([turned[i] for i in some])), strict=True):
            if w >= len(rows):
                continue  # an asker that no holder's block has
            i, j = some[q], rows[w]
            if side and words[j].startswith(words[i][: len(words[i]) // 2]):
                continue
            left.append(i)
            right.append(j)
    return left, right


def shards(words: DataFrame) -> DataFrame:
    """word, n, side, shard, asks, holds: every word under each half by which it may be looked for."""
    size = F.length("word")
    halves = lambda side, of: F.array_distinct(F.transform(F.array(of(size - 1), of(size), of(size + 1)), lambda h: F.struct(F.lit(side).alias("side"), h.alias("h"), (h == of(size)).alias("asks"))))
    each = F.explode(F.concat(*(halves(s, lambda x: (x / 2).cast("int")) for s in (0, 1)))).alias("e")
    rows = words.select("word", "n", each).select("word", "n", "e.side", "e.asks", F.when(F.col("e.side") == 0, F.substring("word", F.lit(1), F.col("e.h"))).otherwise(F.right("word", F.col("e.h"))).alias("half"))
    rows = rows.withColumn("key", F.xxhash64("side", "half")).drop("half")
    hot = written(rows.groupBy("key").count().where(F.col("count") > KEY_WORDS).select(F.col("key").alias("hot_key"), F.ceil(F.col("count") / KEY_WORDS).cast("int").alias("blocks")))
    total = rows.count()
    plain = F.concat_ws(":", "side", F.pmod("key", F.lit(max(1, total // SHARD_WORDS))))
    if hot.isEmpty():
        return rows.select("word", "n", "side", plain.alias("shard"), "asks", F.lit(True).alias("holds"))
    rows = rows.join(broadcast_if_few(hot), F.col("key") == F.col("hot_key"), "left")
    own, all_blocks = F.pmod(F.xxhash64("word"), "blocks").cast("int"), F.sequence(F.lit(0), F.col("blocks") - 1)
    cells = F.concat(  # (block of holders, block of askers) in which the word stands, as one of either
        F.transform(all_blocks, lambda b: F.struct(own.alias("i"), b.alias("j"), (F.col("asks") & (b == own)).alias("asks"), F.lit(True).alias("holds"))),
        F.transform(F.filter(all_blocks, lambda b: F.col("asks") & (b != own)), lambda b: F.struct(b.alias("i"), own.alias("j"), F.lit(True).alias("asks"), F.lit(False).alias("holds"))),
    )
    cold = rows.where("blocks IS NULL").select("word", "n", "side", plain.alias("shard"), "asks", F.lit(True).alias("holds"))
    dealt = rows.where("blocks IS NOT NULL").select("word", "n", "side", "key", F.explode(cells).alias("e"))
    return cold.unionByName(dealt.select("word", "n", "side", F.concat_ws(":", "side", "key", "e.i", "e.j").alias("shard"), "e.asks", "e.holds"))


def _columns(table: pa.Table) -> tuple[list[str], np.ndarray, list[bool], list[int], list[int]]:
    words, n = table["word"].to_pylist(), table["n"].to_numpy()
    asks = table["asks"].to_pylist()
    left, right = shard_pairs(table["side"][0].as_py(), words, asks, table["holds"].to_pylist())
    return words, n, asks, left, right


def near_words(words: DataFrame) -> DataFrame:
    """word, n, near, near_n: all pairs of `words` (word, n; distinct) that are one edit apart, in both orders."""

    def run(table: pa.Table) -> pa.Table:
        own, n, _, left, right = _columns(table)
        cols = [[own[i] for i in left], n[left], [own[j] for j in right], n[right]]
        return pa.table([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.int64(), pa.string(), pa.int64()), strict=True)], ["word", "n", "near", "near_n"])

    return shards(words).groupBy("shard").applyInArrow(run, "word string, n long, near string, near_n long")


def nearest_words(words: DataFrame) -> DataFrame:
    """word, n, n_near, best (n, word): of every word, how many near words it has, and the most frequent one; summed in the shards first."""

    def run(table: pa.Table) -> pa.Table:
        own, n, asks, left, right = _columns(table)
        count = np.bincount(np.asarray(left, np.int64), minlength=len(own))
        best: dict[int, tuple[int, str]] = {}
        for i, j in zip(left, right, strict=True):
            key = (-int(n[j]), own[j])
            if i not in best or key < best[i]:
                best[i] = key
        rows = [i for i, a in enumerate(asks) if a]
        top = [best.get(i) for i in rows]
        cols = [[own[i] for i in rows], n[rows], count[rows], [t and t[0] for t in top], [t and t[1] for t in top]]
        out = pa.table([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string()), strict=True)], ["word", "n", "n_near", "less_n", "near"])
        give_back()
        return out

    found = shards(words).groupBy("shard").applyInArrow(run, "word string, n long, n_near long, less_n long, near string")
    best = F.min(F.when(F.col("near").isNotNull(), F.struct("less_n", "near"))).alias("best")
    return found.groupBy("word").agg(F.max("n").alias("n"), F.sum("n_near").alias("n_near"), best)


def roots(forms: DataFrame) -> DataFrame:
    """word, root: where following `form` from each word that has one ends; by pointer jumping."""
    links = written(forms.where("form IS NOT NULL").select("word", F.col("form").alias("root")))
    for _ in range(ROUNDS):
        up = broadcast_if_few(links).select(F.col("word").alias("at"), F.col("root").alias("up"))
        jumped = written(links.join(up, F.col("root") == F.col("at"), "left").select("word", F.coalesce("up", "root").alias("root"), F.col("up").isNotNull().alias("moved")))
        links = jumped.select("word", "root")
        if jumped.where("moved").isEmpty():
            return links
    raise RuntimeError("chains of forms do not end")


def spelling_variants(docs: DataFrame, rarest: int = RAREST) -> DataFrame:
    """word, form, root, n, n_near, form_n of every word with at least `rarest` occurrences.

    `form` is the near word of largest n (ties: the smallest) if that n is at least twice the word's; `root` is where forms lead.
    """
    words = written(count_words(docs).where(F.col("n") >= rarest))
    near = written(nearest_words(words))
    better = -F.col("best.less_n") >= 2 * F.col("n")
    forms = near.select("word", "n", "n_near", F.when(better, F.col("best.near")).alias("form"), F.when(better, -F.col("best.less_n")).alias("form_n"))
    ends = broadcast_if_few(roots(forms)).withColumnRenamed("word", "start")
    out = forms.join(ends, F.col("word") == F.col("start"), "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
