"""Byte-level BPE encoding and decoding, without a tokenizer library.

Merging runs on a doubly linked list of symbols with a priority queue of (merge rank, position); entries whose symbols
have since been merged are skipped as stale. Decoding concatenates the vocabulary's byte strings.

Results: null text counts as empty (no ids, empty decoded text); special tokens of the vocabulary file that occur in a
text become their own id, as the file's own library does by default. Repeated rows count each; of further columns only the
caller's id and text are read. Empty tables give empty results.
"""

from __future__ import annotations

import hashlib
import json
import re
from array import array
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import text_or_empty

# White space as Unicode's White_Space property has it (fixed values).
WHITE = r"\t-\r \x85\xa0  -     　"
#: The public pattern of byte-level BPE that cuts a text into words before merging (fixed value but for WHITE).
WORDS = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{WHITE}\p{{L}}\p{{N}}]+|[{WHITE}]+(?![^{WHITE}])|[{WHITE}]+"
#: Beyond single spaces and single line ends, cutting at every space would differ from the pattern.
ODD_SPACE = re.compile(rf"[{WHITE.replace(' ', '')}](?<!\n)|[ \n][ \n]|\A[ \n]|[ \n]\Z")
#: Bytes that a cache of words, or of pieces between spaces, may take.
CACHE_BYTES = 32 << 20


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in the vocabulary file: itself, or the next free one from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    free = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(free)) for b in range(256)]


class Vocabulary:
    """Ids, merge ranks and special tokens of a byte-level BPE file in JSON form."""

    def __init__(self, source: str):
        j = json.loads(source)
        ids: dict[str, int] = j["model"]["vocab"]
        letters = byte_letters()
        back = {c: b for b, c in enumerate(letters)}
        self.byte_ids = [ids[c] for c in letters]
        self.strings: dict[int, bytes] = {i: bytes(back[c] for c in s) for s, i in ids.items()}
        self.after: dict[int, dict[int, int]] = {i: {} for i in ids.values()}
        self.left: list[int] = []
        self.right: list[int] = []
        self.merged: list[int] = []
        for rank, pair in enumerate(j["model"]["merges"]):
            left, right = pair.split(" ") if isinstance(pair, str) else pair
            self.after[ids[left]][ids[right]] = rank
            self.left.append(ids[left])
            self.right.append(ids[right])
            self.merged.append(ids[left + right])
        self.special: dict[str, int] = {t["content"]: t["id"] for t in j.get("added_tokens", [])}
        self.strings |= {i: s.encode() for s, i in self.special.items()}

    def merge(self, word: bytes) -> array:
        """Ids of one word. A queue entry holds (rank, position) in one number; the rank names the pair it was made for."""
        byte_ids = self.byte_ids
        symbols = [byte_ids[b] for b in word]
        end = len(symbols)
        if end == 1:
            return array("I", symbols)
        rank_after, shift = self.after, end.bit_length()
        queue = [r << shift | i for i in range(end - 1) if (r := rank_after[symbols[i]].get(symbols[i + 1])) is not None]
        if not queue:
            return array("I", symbols)
        heapify(queue)
        lefts, rights, merged, mask = self.left, self.right, self.merged, (1 << shift) - 1
        after, before = list(range(1, end + 1)), list(range(-1, end - 1))
        while queue:
            entry = heappop(queue)
            i = entry & mask
            j = after[i]
            rank = entry >> shift
            if j == end or symbols[i] != lefts[rank] or symbols[j] != rights[rank]:
                continue  # stale: one of the two has been merged meanwhile
            new = symbols[i] = merged[rank]
            symbols[j] = -1
            k = after[i] = after[j]
            if k != end:
                before[k] = i
                if (r := rank_after[new].get(symbols[k])) is not None:
                    heappush(queue, r << shift | i)
            h = before[i]
            if h >= 0 and (r := rank_after[symbols[h]].get(new)) is not None:
                heappush(queue, r << shift | h)
        return array("I", [s for s in symbols if s >= 0])


class _Cache(dict):
    """Piece of text -> what `make` gives for it, in two generations of half of `most` bytes, about.

    When the younger one is full it becomes the older one, whose pieces come back to the younger as they are asked for: what is
    often asked for stays, and pieces that were met once go.
    """

    def __init__(self, make, most: int = 0):
        super().__init__()
        self.make, self.held, self.older = make, 0, {}
        self.most = (most or CACHE_BYTES) // 2

    def __missing__(self, key):
        value = self.older.get(key)
        if value is None:
            value = self.make(key)
        size = len(key) + (len(value) if isinstance(value, bytes) else 32) + 200
        if self.held + size > self.most:
            self.older, self.held = dict(self), 0
            self.clear()
        if size < self.most:
            self[key] = value
            self.held += size
        return value


class Encoder:
    """Text -> ids as little-endian unsigned 32-bit integers, and back."""

    #: Bytes of the cache of pieces between spaces: to merge a word anew costs far more than to look it up.
    PIECES = 160 << 20

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary
        self.pattern = regex.compile(WORDS)
        self.words = _Cache(lambda w: vocabulary.merge(w.encode()).tobytes())
        self.first = _Cache(self.by_pattern)
        self.inner = _Cache(lambda s: self.by_pattern(" " + s), self.PIECES)
        self.specials = regex.compile("(" + "|".join(map(regex.escape, vocabulary.special)) + ")") if vocabulary.special else None
        self.newline = self.by_pattern("\n")

    def by_pattern(self, text: str) -> bytes:
        return b"".join(map(self.words.__getitem__, self.pattern.findall(text)))

    def plain(self, text: str) -> bytes:
        if not text or ODD_SPACE.search(text):
            return self.by_pattern(text)
        # only single spaces and line ends between words: every piece between them encodes alike wherever it stands
        inner, first, out = self.inner.__getitem__, self.first.__getitem__, []
        for line in text.split("\n"):
            head, *rest = line.split(" ")
            out += (first(head), *map(inner, rest), self.newline)
        out.pop()
        return b"".join(out)

    def encode(self, text: str) -> bytes:
        if self.specials and any(s in text for s in self.vocabulary.special):
            special = self.vocabulary.special
            return b"".join(special[p].to_bytes(4, "little") if p in special else self.plain(p) for p in self.specials.split(text))
        return self.plain(text)

    def decode(self, ids: bytes) -> str:
        return b"".join(map(self.vocabulary.strings.__getitem__, memoryview(ids).cast("I"))).decode("utf-8", "replace")


class LibraryEncoder(Encoder):
    """The same ids, with pieces of text that are not cached yet encoded by the tiktoken library.

    Its ranks are the vocabulary's ids: in such a file ids follow the order of the merges.
    """

    PIECES = CACHE_BYTES

    def __init__(self, vocabulary: Vocabulary):
        special = set(vocabulary.special.values())
        ranks = {b: i for i, b in vocabulary.strings.items() if i not in special}
        if any(vocabulary.merged[r] <= vocabulary.merged[r - 1] for r in range(1, len(vocabulary.merged))):
            raise ValueError("ids of this vocabulary do not follow its merges")
        self.library = tiktoken.Encoding("vocabulary", pat_str=WORDS, mergeable_ranks=ranks, special_tokens={})
        super().__init__(vocabulary)

    def by_pattern(self, text: str) -> bytes:
        return array("I", self.library.encode_ordinary(text)).tobytes()


_encoders: dict[tuple, Encoder] = {}


def encoder(source: str, kind: type[Encoder] = Encoder) -> Encoder:
    """One encoder for each vocabulary and Python worker, so that its caches serve later tasks too."""
    key = kind, hashlib.blake2b(source.encode()).hexdigest()
    if key not in _encoders:
        _encoders[key] = kind(Vocabulary(source))
    return _encoders[key]


def read_vocabulary(path: str) -> str:
    """The vocabulary file's text; its size is fixed by the tokenizer, not by the data."""
    with open(path, encoding="utf-8") as f:
        return f.read()


def encode_documents(docs: DataFrame, vocabulary_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids binary: little-endian unsigned 32-bit, n_tokens, decoded text) for every row."""
    source = docs.sparkSession.sparkContext.broadcast(read_vocabulary(vocabulary_path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(source.value)
        for batch in batches:
            for part in _slices(batch):
                ids = [e.encode(t) for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(ids, pa.binary()), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array([e.decode(x) for x in ids], pa.string())],
                    ["id", "ids", "n_tokens", "decoded"],
                )

    rows = docs.select(F.col(id_col).cast("long").alias("id"), text_or_empty(text_col).alias("text"))
    return rows.mapInArrow(run, "id long, ids binary, n_tokens long, decoded string")


def _slices(batch: pa.RecordBatch, rows: int = 256) -> Iterator[pa.RecordBatch]:
    """Small pieces of a batch, so that a few very long texts do not pile up."""
    for at in range(0, batch.num_rows, rows):
        yield batch.slice(at, rows)


def token_digests(docs: DataFrame, vocabulary_path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: digests of what encode_documents() gives, taken in the JVM."""
    out = encode_documents(docs, vocabulary_path)
    return out.select(
        F.col("id").alias("doc_id"), "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256")
    )
