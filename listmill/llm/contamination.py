"""Benchmark passages inside documents: Wu-Manber multi-pattern search over words.

Words are runs of ASCII letters, digits and characters beyond ASCII, A-Z lower-cased. A benchmark item gives one pattern for every
`window` consecutive words, or one of all its words if it has fewer. For each length of pattern there is a shift table of blocks of
two words: a block that no pattern holds lets the search jump over a whole pattern's length, any other block as far as its last place
in a pattern allows. Where the shift is 0, the block that ends the pattern and the block that begins it name a bucket, whose patterns
are compared word for word.

The benchmark is cut into parts of bounded bytes (long items into pieces that overlap, so that no window is lost). Each part is
searched in all documents, without a shuffle; what was found travels with the row from one part to the next.

Results: a row for each row of the documents, repeated rows and repeated or null doc_ids too. Null or empty text, or text without
words: no words, nothing hit. Items without words match nothing; items of one item_id (repeated rows) count once; a null item_id
counts as ''. An empty benchmark hits nothing, empty documents give an empty result. Further columns are left out, so that their
names cannot clash.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import written

#: Words of a window.
WINDOW = 10
#: Bytes of words that one part of the benchmark holds, about; it is what the driver gathers and each task holds at once.
PART_BYTES = 2 << 20
#: Windows of one piece of an item.
PIECE = 512
#: Lower-cases A-Z and turns every other separator into a space; bytes beyond ASCII stay.
WORD_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


def word_list(text: bytes | None) -> list[bytes]:
    return text.translate(WORD_BYTES).split() if text else []


class Patterns:
    """Patterns of one length in words: shift table, buckets by first and last block, and the owners of each pattern."""

    def __init__(self, size: int):
        self.size, self.block = size, min(2, size)
        self.far = size - self.block + 1
        self.shift: dict[tuple, int] = {}
        self.bucket: dict[tuple, list[int]] = {}
        self.flat: list[bytes] = []
        self.owners: dict[int, set[str]] = {}

    def add(self, words: list[bytes], owner: str) -> None:
        """All runs of `size` words in `words`."""
        m, b, base = self.size, self.block, len(self.flat)
        self.flat += words
        runs = len(words) - m + 1
        for end in range(b, len(words) + 1):  # the nearest distance of a block to the end of a pattern that holds it
            key = tuple(words[end - b : end])
            self.shift[key] = min(self.shift.get(key, self.far), max(0, m - end))
        for at in range(runs):
            own = words[at : at + m]
            known = self.bucket.setdefault((*own[:b], *own[-b:]), [])
            start = next((s for s in known if self.flat[s : s + m] == own), None)
            if start is None:
                known.append(start := base + at)
            self.owners.setdefault(start, set()).add(owner)

    def search(self, words: list[bytes], hit: bytearray, found: set[int]) -> None:
        """Marks the words inside any occurrence, and collects the patterns that occur."""
        m, b, far, shift, bucket, flat = self.size, self.block, self.far, self.shift, self.bucket, self.flat
        i, n, mark = m, len(words), b"\1" * m
        while i <= n:  # i: end of the place that is looked at
            jump = shift.get(tuple(words[i - b : i]), far)
            if jump:
                i += jump
                continue
            own = words[i - m : i]
            for start in bucket.get((*own[:b], *own[-b:]), ()):
                if flat[start : start + m] == own:
                    found.add(start)
                    hit[i - m : i] = mark
                    break
            i += 1


def tables(rows: Iterable[tuple[str, bytes]], window: int) -> list[Patterns]:
    by_size: dict[int, Patterns] = {}
    for owner, joined in rows:
        words = joined.split()
        size = min(window, len(words))
        by_size.setdefault(size, Patterns(size)).add(words, owner)
    return list(by_size.values())


def spans(hit: bytearray) -> list[dict]:
    """Runs of marked words: start, and end exclusive."""
    out, at = [], hit.find(1)
    while at >= 0:
        end = hit.find(0, at)
        end = len(hit) if end < 0 else end
        out.append({"start": at, "end": end})
        at = hit.find(1, end)
    return out


def pieces(items: DataFrame, window: int) -> DataFrame:
    """item_id, words (joined by spaces), bytes: items cut into pieces of at most PIECE windows, each window in one piece."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                names, texts = [], []
                for name, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    words = word_list(text)
                    for begin in range(0, max(1, len(words) - window + 1) if words else 0, PIECE):
                        names.append(name)
                        texts.append(b" ".join(words[begin : begin + PIECE + window - 1]))
                yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(texts, pa.binary()), pa.array(map(len, texts), pa.int64())], ["item_id", "words", "bytes"])

    rows = items.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"), F.col("text").cast("binary").alias("text"))
    return rows.mapInArrow(run, "item_id string, words binary, bytes long")


FOUND = "doc_id long, text binary, n_words long, spans array<struct<start:int,end:int>>, item_ids array<string>"


def _search(state: DataFrame, part: list[tuple[str, bytes]], window: int) -> DataFrame:
    """`state` (columns of FOUND) with the occurrences of one part added."""
    shared = state.sparkSession.sparkContext.broadcast(part)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        patterns = tables(shared.value, window)
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                rows = batch.slice(at, 64)
                counts, runs, owners = [], [], []
                for text, before, names in zip(*(rows.column(c).to_pylist() for c in (1, 3, 4)), strict=True):
                    words = word_list(text)
                    hit, own = bytearray(len(words)), set(names)
                    for s in before:
                        hit[s["start"] : s["end"]] = b"\1" * (s["end"] - s["start"])
                    for p in patterns:
                        found: set[int] = set()
                        p.search(words, hit, found)
                        own.update(*(p.owners[f] for f in found))
                    counts.append(len(words))
                    runs.append(spans(hit))
                    owners.append(sorted(own))
                yield pa.RecordBatch.from_arrays(
                    [rows.column(0), rows.column(1), pa.array(counts, pa.int64()), pa.array(runs, SPANS), pa.array(owners, pa.list_(pa.string()))], ["doc_id", "text", "n_words", "spans", "item_ids"]
                )

    return state.mapInArrow(run, FOUND)


SPANS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))


def find_occurrences(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, spans (words inside any occurrence: start, end exclusive) and item_ids (of items that occur) of every document."""
    cut = written(pieces(items, window))
    total = cut.agg(F.coalesce(F.sum("bytes"), F.lit(0))).first()[0]
    parts = -(-total // PART_BYTES) or 1
    dealt = cut.withColumn("part", F.pmod(F.xxhash64("item_id", "words"), F.lit(parts)))
    state = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"), F.lit(0).cast("long").alias("n_words"),
        F.expr("cast(array() AS array<struct<start:int,end:int>>)").alias("spans"), F.expr("cast(array() AS array<string>)").alias("item_ids"),
    )
    for p in range(parts):
        rows = [(r["item_id"], bytes(r["words"])) for r in dealt.where(F.col("part") == p).select("item_id", "words").toLocalIterator()]
        state = _search(state if p == 0 else written(state), rows, window)
    return state.select("doc_id", "n_words", "spans", "item_ids")


def digests(found: DataFrame) -> DataFrame:
    """What find_occurrences() gives, as counts and a digest of the item_ids in string order."""
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return found.select(
        "doc_id", "n_words", hit.alias("n_hit"), F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("item_ids"), ",").cast("binary"), 256).alias("items_sha256"), (hit > 0).alias("contaminated"),
    )
