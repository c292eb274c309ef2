"""Alignment of two tokenizers over the same text: which tokens overlap, where both end, and how often an id goes with another.

Each text is encoded by a byte-level BPE (A) and a piece BPE with byte fallback (B), special strings as plain text, both of them with
a space in front. The tokens' ends in bytes are merged in lockstep: documents are cut into stretches of STRETCH A tokens, and one
numpy state vector holds the A and the B pointer of every stretch of a batch. Each step emits one link for every stretch, a cut where
both tokens end together, moves the pointer of the token that ends first (both at a cut), and drops the stretches that are finished.

How often a pair of ids is linked is known only over the whole corpus. A block of documents (BLOCK_BYTES of text) keeps its
documents' pairs as numbers into the block's own list of pairs; that list alone is joined with the sums of all blocks and comes back
to the block, so that no row is shuffled for a link. The best count of each B id is a table of the size of its vocabulary.

Results: a row for each row of the documents. Null and empty texts, and texts of which either tokenizer's bytes differ from space and
text, have no tokens: zeros, and '' instead of a digest. Repeated rows count each; very long texts are whole; empty tables give empty
results. Only doc_id and text are read, so that further columns cannot clash.
"""

from __future__ import annotations

import hashlib
import re
from array import array
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import WHITE, LibraryEncoder, encoder, read_vocabulary
from .shared import give_back, written

#: A tokens of a stretch; all stretches of a batch take about as many steps.
STRETCH = 1024
#: Bytes of text of a block, about: it is held at once by a task, in tokens and links.
BLOCK_BYTES = 3 << 20
#: Units that are encoded together.
JOINED = 400
#: White space other than spaces and line ends.
RARE = re.compile(rf"[{WHITE.replace(' ', '')}](?<!\n)")


class Units:
    """A tokenizer that encodes what stands between single spaces alike wherever it stands.

    Units are encoded many at once, joined by spaces: each begins with the one token of it whose bytes begin with a space. Where
    that, or the bytes of the tokens, does not come out so, every unit is encoded apart.
    """

    strings: list[bytes]

    def cut(self, text: str) -> list[str]:
        return text.split(" ")

    def joins(self, unit: str) -> bool:
        return True

    def spaced(self, texts: list[str]) -> list[list[int]]:
        """Ids of space and text, for each text."""
        raise NotImplementedError

    def encode(self, units: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, number of ids of each unit, whether their bytes are those of space and unit)."""
        apart = [k for k, u in enumerate(units) if not self.joins(u)]
        lone, joining = set(apart), len(units) - len(apart)
        order = [k for k in range(len(units)) if k not in lone] + apart if apart else [*range(len(units))]
        chunks = [order[at : min(at + JOINED, joining)] for at in range(0, joining, JOINED)] + [[k] for k in order[joining:]]
        texts = [" ".join([units[k] for k in c]) for c in chunks]
        parts: list[np.ndarray] = []
        counts, good = np.zeros(len(units), np.int64), np.ones(len(units), bool)
        for chunk, text, ids in zip(chunks, texts, self.spaced(texts), strict=True):
            own = np.array(ids, np.int64)
            at = np.flatnonzero(self.begins[own])
            fits = b"".join(map(self.strings.__getitem__, ids)) == (" " + text).encode()
            if len(chunk) == 1:
                counts[chunk[0]], good[chunk[0]] = len(own), fits
            elif fits and len(at) == len(chunk):
                counts[chunk] = np.diff(at, append=len(own))
            else:
                each = self.spaced([units[k] for k in chunk])
                counts[chunk] = [len(e) for e in each]
                good[chunk] = [b"".join([self.strings[i] for i in e]) == (" " + units[k]).encode() for k, e in zip(chunk, each, strict=True)]
                own = np.fromiter(chain.from_iterable(each), np.int64)
            parts.append(own)
        ids = np.concatenate(parts) if parts else np.empty(0, np.int64)
        if not apart:
            return ids, counts, good
        starts = np.empty(len(units), np.int64)  # back into the order of the units
        starts[order] = np.concatenate(([0], np.cumsum(counts[order])))[:-1]
        return ids[_ranges(starts, counts)], counts, good


class Pieces(Units):
    """A piece BPE model (sentencepiece file), which puts the space in front itself."""

    def __init__(self, model: bytes):
        self.library = sentencepiece.SentencePieceProcessor(model_proto=model)
        names = [self.library.id_to_piece(i) for i in range(self.library.vocab_size())]
        self.strings = [bytes([int(p[3:5], 16)]) if self.library.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(names)]
        self.begins = np.array([s.startswith(b" ") for s in self.strings])
        self.space = self.library.piece_to_id("▁")
        self.apart = not any("▁" in p[1:] for p in names)  # no piece reaches over the space before a word

    def cut(self, text: str) -> list[str]:
        return text.split(" ") if self.apart else [text]

    def joins(self, unit: str) -> bool:
        return self.apart and unit != ""

    def spaced(self, texts: list[str]) -> list[list[int]]:
        return [ids if t else [self.space] for t, ids in zip(texts, self.library.encode(texts, num_threads=1), strict=True)]


class Bytes(Units):
    """A byte-level BPE (the vocabulary of LibraryEncoder); special strings are plain text."""

    def __init__(self, vocabulary: str):
        own = encoder(vocabulary, LibraryEncoder)
        self.library = own.library
        self.strings = [own.vocabulary.strings.get(i, b"") for i in range(max(own.vocabulary.strings) + 1)]
        self.begins = np.array([s.startswith(b" ") for s in self.strings])

    def cut(self, text: str) -> list[str]:
        """At spaces, unless white space stands otherwise than singly between words."""
        return [text] if odd_space(text) else text.split(" ")

    def joins(self, unit: str) -> bool:
        return unit.isalnum() or not (" " in unit or odd_space(unit))

    def spaced(self, texts: list[str]) -> list[list[int]]:
        one = self.library.encode_ordinary
        return [one(" " + t) for t in texts]


def odd_space(text: str) -> bool:
    """What ODD_SPACE finds, tested piece by piece."""
    return "  " in text or "\n\n" in text or " \n" in text or "\n " in text or text[:1] in ("", " ", "\n") or text[-1] in " \n" or RARE.search(text) is not None


def _ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """All of starts[k] to starts[k] + counts[k] - 1, one after another."""
    return np.repeat(starts - (np.cumsum(counts) - counts), counts) + np.arange(int(counts.sum()))


class Tokens:
    """Ids of the texts of a batch by one tokenizer, one after another, with the bytes of space and text that each ends at.

    Texts are cut into units that encode apart, and each distinct unit of the batch is encoded once. `whole` says of each text
    whether its tokens' bytes are those of space and text.
    """

    def __init__(self, tokenizer: Units, texts: list[str | None], lengths: np.ndarray):
        number: dict[str, int] = {}
        rows = array("q")
        ends = []
        for text in texts:
            if text:
                rows.extend([number.setdefault(u, len(number)) for u in tokenizer.cut(text)])
            ends.append(len(rows))
        self.lengths = lengths
        self.unit_ids, self.unit_count, good = tokenizer.encode([*number])
        self.rows, self.text = np.frombuffer(rows, np.int64), np.repeat(np.arange(len(texts)), np.diff(ends, prepend=0))
        self.whole = np.bincount(self.text[~good[self.rows]], minlength=len(texts)) == 0

    def settle(self, kept: np.ndarray) -> Tokens:
        """Leaves the tokens of the texts that are kept only."""
        on = kept[self.text]
        rows, text = self.rows[on], self.text[on]
        count = self.unit_count[rows]
        starts = np.concatenate(([0], np.cumsum(self.unit_count)))[rows]
        self.ids = self.unit_ids[_ranges(starts, count)]
        self.count = np.bincount(text, weights=count, minlength=len(kept)).astype(np.int64)
        self.first = np.concatenate(([0], np.cumsum(self.count)))
        self.size = self.lengths[self.ids]
        self.ends = np.cumsum(self.size)  # over all texts, so that no two texts overlap
        del self.rows, self.text, self.unit_ids, self.unit_count
        return self


def lockstep(a: Tokens, b: Tokens, stretch: int = STRETCH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Links of all texts in order: A token, B token (numbers over the batch), and whether both end there."""
    offset = np.concatenate([np.arange(0, n, stretch) for n in a.count]) if len(a.count) else np.empty(0, np.int64)
    owner = np.repeat(np.arange(len(a.count)), -(-a.count // stretch))
    i = a.first[owner] + offset
    last = np.minimum(i + stretch, a.first[owner + 1])
    begun = a.ends[i] - a.size[i]
    j = np.searchsorted(b.ends, begun, side="right")  # the B token that holds the stretch's first byte
    place = np.full(len(a.ids) + len(b.ids), -1, np.int64)  # a link's i + j grows along the batch: it is its place
    cut = np.zeros(len(place), bool)
    ends_a, ends_b = np.append(a.ends, 0), np.append(b.ends, 0)
    while len(i):
        x, y = ends_a[i], ends_b[j]
        both = x == y
        place[i + j], cut[i + j] = i, both
        i, j = i + (x <= y), j + (y <= x)
        on = i < last
        if not on.all():
            i, j, last = i[on], j[on], last[on]
    at = np.flatnonzero(place >= 0)
    left = place[at]
    return left, at - left, cut[at]


def group_strings(a: Tokens, b: Tokens, left: np.ndarray, right: np.ndarray, cut: np.ndarray, figures: list[bytes]) -> Iterator[bytes]:
    """Groups of each text, `a1,a2|b1;a3|b2,b3`; `figures` holds ids with a comma or the mark behind their group, first A's, then B's."""
    ends_a, ends_b = np.zeros(len(a.ids), bool), np.zeros(len(b.ids), bool)
    ends_a[left[cut]] = ends_b[right[cut]] = True
    group_a, group_b = (np.cumsum(e) - e for e in (ends_a, ends_b))
    # a token's place: the tokens of its own kind before it, and those of the other kind in groups before (B: up to) its own
    total_a, total_b = (np.concatenate(([0], np.flatnonzero(e) + 1)) for e in (ends_a, ends_b))
    order = np.empty(len(a.ids) + len(b.ids), np.int64)
    order[np.arange(len(a.ids)) + total_b[group_a]] = 2 * a.ids + ends_a
    order[np.arange(len(b.ids)) + total_a[group_b + 1]] = 2 * (len(a.lengths) + b.ids) + ends_b
    marked = list(map(figures.__getitem__, order.tolist()))
    ends = (a.first + b.first).tolist()
    for s, e in zip(ends[:-1], ends[1:], strict=True):
        yield b"".join(marked[s:e])[:-1]


class Aligner:
    """Both tokenizers, and the number of bytes and the figures of their ids."""

    def __init__(self, vocabulary: str, model: bytes):
        self.a, self.b = Bytes(vocabulary), Pieces(model)
        self.length_a, self.length_b = (np.array([len(s) for s in t.strings], np.int64) for t in (self.a, self.b))
        self.figures = [b"%d%c" % (i, mark) for n, end in ((len(self.length_a), b"|"), (len(self.length_b), b";")) for i in range(n) for mark in (b",", end)]

    def block(self, texts: list[str | None]) -> tuple[Tokens, Tokens, np.ndarray, np.ndarray, np.ndarray]:
        a, b = Tokens(self.a, texts, self.length_a), Tokens(self.b, texts, self.length_b)
        whole = a.whole & b.whole
        a, b = a.settle(whole), b.settle(whole)
        return a, b, *lockstep(a, b)


_aligners: dict[str, Aligner] = {}


def aligner(vocabulary: str, model: bytes) -> Aligner:
    """One for each pair of tokenizers and Python worker."""
    key = hashlib.blake2b(vocabulary.encode() + model).hexdigest()
    if key not in _aligners:
        _aligners[key] = Aligner(vocabulary, model)
    return _aligners[key]


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[int | None], list[str | None]]]:
    ids: list[int | None] = []
    texts: list[str | None] = []
    held = 0
    for batch in batches:
        for at in range(0, batch.num_rows, 64):
            part = batch.slice(at, 64)
            ids += part.column(0).to_pylist()
            texts += part.column(1).to_pylist()
            held += part.column(1).nbytes
            if held >= BLOCK_BYTES:
                yield ids, texts
                ids, texts, held = [], [], 0
    if ids:
        yield ids, texts


def _over_blocks(docs: DataFrame, vocabulary_path: str, model_path: str, make: Callable, schema: str) -> DataFrame:
    """make(aligner, block number, doc_ids, texts) -> record batches, for every block of documents."""
    with open(model_path, "rb") as f:
        source = docs.sparkSession.sparkContext.broadcast((read_vocabulary(vocabulary_path), f.read()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = TaskContext.get().partitionId() << 32
        for k, (ids, texts) in enumerate(_blocks(batches)):
            yield from make(aligner(*source.value), first + k, ids, texts)
        give_back()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, schema)


def _lists(values: np.ndarray, ends: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], ends)), pa.int32()), pa.array(values))


def align_documents(docs: DataFrame, vocabulary_path: str, model_path: str) -> DataFrame:
    """doc_id, a_ids, b_ids, links (a, b: token numbers in the text), cuts (bytes of space and text at which both end) of every document."""

    def make(both: Aligner, _: int, ids: list, texts: list) -> Iterator[pa.RecordBatch]:
        a, b, left, right, cut = both.block(texts)
        owner = np.repeat(np.arange(len(ids)), a.count)[left]
        ends, cuts = np.searchsorted(owner, np.arange(len(ids)), side="right"), np.searchsorted(owner[cut], np.arange(len(ids)), side="right")
        begun = np.concatenate(([0], a.ends))[a.first[:-1]]
        links = pa.StructArray.from_arrays([pa.array(left - a.first[owner]).cast(pa.int32()), pa.array(right - b.first[owner]).cast(pa.int32())], ["a", "b"])
        at = a.ends[left[cut]] - begun[owner[cut]]
        yield pa.RecordBatch.from_arrays(
            [pa.array(ids, pa.int64()), _lists(a.ids, a.first[1:]), _lists(b.ids, b.first[1:]), pa.ListArray.from_arrays(pa.array(np.concatenate(([0], ends)), pa.int32()), links), _lists(at, cuts)],
            ["doc_id", "a_ids", "b_ids", "links", "cuts"],
        )

    return _over_blocks(docs, vocabulary_path, model_path, make, "doc_id long, a_ids array<long>, b_ids array<long>, links array<struct<a:int,b:int>>, cuts array<long>")


STATE = "block long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, steps binary, times binary, a int, b int, links long"


def _state(both: Aligner, block: int, ids: list, texts: list) -> Iterator[pa.RecordBatch]:
    """Rows of the documents, with their pairs as numbers into the block's pairs; then rows of these pairs (a, b, links)."""
    a, b, left, right, cut = both.block(texts)
    n = len(ids)
    owner = np.repeat(np.arange(n), a.count)[left]
    shas = [hashlib.sha256(g).hexdigest() if g else "" for g in group_strings(a, b, left, right, cut, both.figures)]
    n_b = len(both.length_b)
    span = len(both.length_a) * n_b
    own = np.sort(owner * span + a.ids[left] * n_b + b.ids[right])
    new = np.flatnonzero(np.diff(own, prepend=-1))
    times, own = np.diff(np.append(new, len(own))), own[new]
    of = own // span
    known, number_of = np.unique(own - of * span, return_inverse=True)  # the block's pairs, and of each text which of them
    cuts = np.searchsorted(of, np.arange(n), side="right")
    steps = np.diff(number_of, prepend=0).astype("<i4")
    starts = np.concatenate(([0], cuts[:-1]))
    full = starts < cuts
    steps[starts[full]] = number_of[starts[full]]  # every text begins anew
    slices = lambda x: [x[s:e].tobytes() for s, e in zip(starts.tolist(), cuts.tolist(), strict=True)]
    longs = lambda x: pa.array(x, pa.int64())
    names = [f.split()[0] for f in STATE.split(", ")]
    none = lambda k, t: pa.nulls(k, t)
    yield pa.RecordBatch.from_arrays(
        [longs(np.full(n, block)), longs(ids), longs(a.count), longs(b.count), longs(np.bincount(owner[cut], minlength=n)), longs(np.bincount(owner, minlength=n)), pa.array(shas, pa.string()),
         pa.array(slices(steps), pa.binary()), pa.array(slices(times.astype("<i4")), pa.binary()), none(n, pa.int32()), none(n, pa.int32()), none(n, pa.int64())], names,
    )
    k = len(known)
    total = np.bincount(number_of, weights=times, minlength=k).astype(np.int64)
    wide = [none(k, t) for t in (*[pa.int64()] * 5, pa.string(), pa.binary(), pa.binary())]
    for at in range(0, k, 50_000):
        yield pa.RecordBatch.from_arrays([longs(np.full(k, block)), *wide, pa.array(known // n_b, pa.int32()), pa.array(known % n_b, pa.int32()), longs(total)], names).slice(at, 50_000)


OUT = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


def _sums(docs: pa.Table, pairs: pa.Table) -> pa.Table:
    """Documents of a block with the counts of its pairs, both in the order of the block's list of pairs."""
    pairs = pairs.sort_by([("a", "ascending"), ("b", "ascending")])
    count, best = pairs["total"].to_numpy(), pairs["best"].to_numpy(zero_copy_only=False)
    sums, bests = [], []
    for steps, times in zip(docs["steps"].to_pylist(), docs["times"].to_pylist(), strict=True):
        number, n = np.cumsum(np.frombuffer(steps, "<i4").astype(np.int64)), np.frombuffer(times, "<i4").astype(np.int64)
        sums.append(int(count[number] @ n) if len(n) else 0)
        bests.append(int(n[best[number]].sum()) if len(n) else 0)
    kept = [docs[c] for c in ("doc_id", "n_a", "n_b", "n_groups", "n_links")]
    return pa.table([*kept, pa.array(bests, pa.int64()), pa.array(sums, pa.int64()), docs["groups_sha256"]], [f.split()[0] for f in OUT.split(", ")])


def pair_counts(state: DataFrame) -> DataFrame:
    """a, b, total (links of the pair in the corpus), best (whether no pair of that b has more)."""
    total = written(state.where("a IS NOT NULL").groupBy("a", "b").agg(F.sum("links").alias("total")))
    top = F.broadcast(total.groupBy(F.col("b").alias("top_b")).agg(F.max("total").alias("top")))  # at most one row for each id of B
    return total.join(top, F.col("b") == F.col("top_b")).select("a", "b", "total", (F.col("total") == F.col("top")).alias("best"))


def alignment_digests(docs: DataFrame, vocabulary_path: str, model_path: str) -> DataFrame:
    """Counts, sums over the links, and a digest of the groups of every document."""
    state = written(_over_blocks(docs, vocabulary_path, model_path, _state, STATE))
    counted = pair_counts(state).select(F.col("a").alias("of_a"), F.col("b").alias("of_b"), "total", "best")
    asked = state.where("a IS NOT NULL").select(F.col("block").alias("of_block"), "a", "b")
    pairs = asked.join(counted, (F.col("a") == F.col("of_a")) & (F.col("b") == F.col("of_b"))).select("of_block", "a", "b", "total", "best")
    texts = state.where("a IS NULL").select("block", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "steps", "times")
    return texts.groupBy("block").cogroup(pairs.groupBy("of_block")).applyInArrow(_sums, OUT)
