"""Packing of documents into windows of a fixed number of tokens: best-fit decreasing.

Overlong documents are first cut into full windows; the remainders, longest first, each go to the open window with the
least remaining capacity that still holds them, which a segment tree over remaining capacities finds in O(log window).

A document's tokens are its ids plus one end id. Null or empty text: just the end id. Repeated rows are packed as often
as they occur. Windows are filled within one partition of pieces, so that no task sees them all.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bpe import LibraryEncoder, encoder, read_vocabulary
from .shared import text_or_empty

#: Tokens of a sequence.
WINDOW = 1024
#: Id that ends each document.
END_ID = 0


class OpenWindows:
    """Windows by remaining capacity: a segment tree of counts, and a stack of windows at each leaf."""

    def __init__(self, window: int):
        self.leaves = 1 << window.bit_length()
        self.count = [0] * (2 * self.leaves)
        self.at: list[list[int]] = [[] for _ in range(window + 1)]

    def _add(self, capacity: int, by: int) -> None:
        i = capacity + self.leaves
        while i:
            self.count[i] += by
            i >>= 1

    def put(self, capacity: int, name: int) -> None:
        self.at[capacity].append(name)
        self._add(capacity, 1)

    def take(self, length: int) -> tuple[int, int] | None:
        """(capacity, name) of the tightest window that holds `length`, removed; None if there is none."""
        count, i = self.count, length + self.leaves
        if not count[i]:
            while i and (i & 1 or not count[i + 1]):  # up until a right neighbour has windows
                i >>= 1
            if not i:
                return None
            i += 1
            while i < self.leaves:  # down to its first leaf
                i = 2 * i if count[2 * i] else 2 * i + 1
        capacity = i - self.leaves
        self._add(capacity, -1)
        return capacity, self.at[capacity].pop()


def best_fit(lengths: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Window number and offset of each piece; `lengths` in descending order, each from 1 to `window`."""
    names, offsets = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    free, opened = OpenWindows(window), 0
    for i, n in enumerate(lengths.tolist()):
        found = free.take(n) if n < window else None
        if found is None:
            found, opened = (window, opened), opened + 1
        capacity, names[i] = found
        offsets[i] = window - capacity
        if capacity > n:
            free.put(capacity - n, found[1])
    return names, offsets


def cut_documents(docs: DataFrame, vocabulary_path: str, window: int = WINDOW, end_id: int = END_ID) -> DataFrame:
    """Pieces of at most `window` tokens: doc_id, start, length, ids (binary, unsigned 32-bit little-endian), doc_tokens."""
    source = docs.sparkSession.sparkContext.broadcast(read_vocabulary(vocabulary_path))
    end = end_id.to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(source.value, LibraryEncoder)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                rows: list[tuple] = []
                for doc, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    ids = e.encode(text) + end
                    total = len(ids) // 4
                    rows += [(doc, s, min(window, total - s), ids[4 * s : 4 * (s + window)], total) for s in range(0, total, window)]
                cols = list(zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64()), strict=True)],
                    ["doc_id", "start", "length", "ids", "doc_tokens"],
                )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    return rows.mapInArrow(run, "doc_id long, start long, length long, ids binary, doc_tokens long")


def pack(pieces: DataFrame, window: int = WINDOW) -> DataFrame:
    """`pieces` (any columns; at least doc_id, start, length) with sequence_id and offset.

    Pieces are dealt by hash; every partition packs its own. Sorted by (length, doc_id, start) first, a repeated task
    gives the same windows.
    """
    fields = list(pieces.schema.names)
    schema = T.StructType([*pieces.schema.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        table = pa.Table.from_batches(held)
        table = table.sort_by([("length", "descending"), ("doc_id", "ascending"), ("start", "ascending")])
        names, offsets = best_fit(table["length"].to_numpy(), window)
        names += TaskContext.get().partitionId() << 40
        table = table.append_column("sequence_id", pa.array(names)).append_column("offset", pa.array(offsets))
        yield from table.select([*fields, "sequence_id", "offset"]).to_batches(max_chunksize=10_000)

    return pieces.repartition(F.xxhash64("doc_id", "start")).mapInArrow(run, schema)


def sequences(packed: DataFrame, window: int = WINDOW, pad_id: int = END_ID) -> DataFrame:
    """Packed pieces that hold ids -> one padded row of ids for each sequence: sequence_id, n_tokens, ids, doc_ids."""
    whole = packed.groupBy("sequence_id").agg(
        F.sum("length").alias("n_tokens"), F.array_sort(F.collect_list(F.struct("offset", "ids", "doc_id"))).alias("p")
    )
    hexed = F.array_join(F.transform("p", lambda x: F.hex(x["ids"])), "")
    pad = F.repeat(F.lit(pad_id.to_bytes(4, "little").hex()), (F.lit(window) - F.col("n_tokens")).cast("int"))
    return whole.select("sequence_id", "n_tokens", F.unhex(F.concat(hexed, pad)).alias("ids"), F.col("p.doc_id").alias("doc_ids"))


def packed_digests(docs: DataFrame, vocabulary_path: str, window: int = WINDOW) -> DataFrame:
    """Where every piece of every document lies, with a checksum of its ids instead of the ids."""
    pieces = cut_documents(docs, vocabulary_path, window)
    light = pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens")
    return pack(light, window)
