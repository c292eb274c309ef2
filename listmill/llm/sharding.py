"""Sharding by bytes: Karmarkar-Karp differencing over groups of equal texts.

Every group (all rows of one text) is indivisible and goes to one shard. Partial partitions with the largest spread are
combined again and again, the one's largest bundles with the other's smallest, until one partition is left. It is done in
levels: each Spark partition differences its own groups down to one partial partition of `shards` bundles, then up to
FAN partial partitions at a time are differenced in the same way, so no task sees more than its share.

Null text: no bytes, in one group with the empty text. A group larger than a whole shard's fair share cannot be kept in
one piece in any even split; its rows are dealt by doc_id into pieces of at most about half a fair share.
Repeated rows are separate rows with slots of their own. An empty table gives an empty result.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import broadcast_if_few, text_or_empty, written

#: Partial partitions that one task combines, about.
FAN = 256
#: Groups that one partial partition is made from at most.
GROUPS_AT_ONCE = 50_000
#: Groups with more than this part of all rows are joined by broadcast; there are fewer than HOT of them.
HOT = 1024
#: Ranges of hashed doc_id within which slots are counted.
SLOT_RANGES = 1024


def difference(parts: list[list[tuple[int, object]]], k: int) -> list[list[int]]:
    """Karmarkar-Karp over partial partitions.

    parts: each a list of at most k bundles (size, name). Returns, for each of the k final bundles, the names in it.
    """
    heap = []
    for order, bundles in enumerate(parts):
        full = sorted(((size, name) for size, name in bundles), key=lambda x: -x[0])
        full += [(0, None)] * (k - len(full))
        heap.append((full[-1][0] - full[0][0], order, full))
    heapq.heapify(heap)
    order = len(heap)
    while len(heap) > 1:
        _, _, a = heapq.heappop(heap)
        _, _, b = heapq.heappop(heap)
        both = [(x[0] + y[0], y[1] if x[1] is None else x[1] if y[1] is None else (x[1], y[1])) for x, y in zip(a, reversed(b), strict=True)]
        both.sort(key=lambda x: -x[0])
        heapq.heappush(heap, (both[-1][0] - both[0][0], order, both))
        order += 1
    out = []
    for _, tree in heap[0][2] if heap else []:
        names, stack = [], [tree]
        while stack:
            x = stack.pop()
            if isinstance(x, tuple):
                stack += x
            elif x is not None:
                names.append(x)
        out.append(names)
    return out


def _first_level(units: DataFrame, k: int) -> DataFrame:
    """units(g, chunk, bytes) -> with part (long) and bundle (int)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows, made = [], 0, 0
        base = TaskContext.get().partitionId() << 24
        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                rows += batch.num_rows
            if rows >= GROUPS_AT_ONCE:
                yield from one(held, base + made)
                held, rows, made = [], 0, made + 1
        if held:
            yield from one(held, base + made)

    def one(held: list[pa.RecordBatch], part: int) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(held).sort_by([("bytes", "descending"), ("g", "ascending"), ("chunk", "ascending")])
        bundle = [0] * table.num_rows
        for b, names in enumerate(difference([[(s, i)] for i, s in enumerate(table["bytes"].to_pylist())], k)):
            for i in names:
                bundle[i] = b
        table = table.append_column("part", pa.array([part] * len(bundle), pa.int64())).append_column("bundle", pa.array(bundle, pa.int32()))
        yield from table.to_batches(max_chunksize=10_000)

    return units.repartition("g", "chunk").mapInArrow(run, "g binary, chunk int, bytes long, part long, bundle int")


def _combine(sums: DataFrame, k: int) -> DataFrame:
    """sums(part, bundle, bytes, up) -> part, bundle, up, to: partial partitions of one `up` become the one named so."""

    def run(table: pa.Table) -> pa.Table:
        rows = sorted(zip(*(table[c].to_pylist() for c in ("part", "bundle", "bytes")), strict=True))
        parts: dict[int, list] = {}
        for i, (part, _, size) in enumerate(rows):
            parts.setdefault(part, []).append((size, i))
        to = [0] * len(rows)
        for b, names in enumerate(difference(list(parts.values()), k)):
            for i in names:
                to[i] = b
        up = table["up"].to_pylist()[0]
        return pa.table({"part": pa.array([r[0] for r in rows], pa.int64()), "bundle": pa.array([r[1] for r in rows], pa.int32()), "up": pa.array([up] * len(rows), pa.int64()), "to": pa.array(to, pa.int32())})

    return sums.groupBy("up").applyInArrow(run, "part long, bundle int, up long, to int")


def shard_by_bytes(docs: DataFrame, shards: int = 16) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard for every row of docs."""
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.octet_length(text_or_empty()) + 1).cast("long").alias("size"),
        F.crc32(text_or_empty().cast("binary")).alias("text_crc32"),
        F.unhex(F.md5(text_or_empty().cast("binary"))).alias("g"),
    )
    rows = written(rows)
    groups = written(rows.groupBy("g").agg(F.sum("size").alias("bytes"), F.count("*").alias("n")))
    total, count = groups.agg(F.coalesce(F.sum("bytes"), F.lit(0)), F.coalesce(F.sum("n"), F.lit(0))).first()
    # fewer than `shards` groups can be larger than a fair share
    large = groups.where(F.col("bytes") * shards > total).collect()
    chunk = F.lit(0)
    for r in large:
        pieces = -(-r["bytes"] * 2 * shards // max(1, total))
        chunk = F.when(F.col("g") == F.lit(bytes(r["g"])), F.pmod(F.xxhash64("doc_id"), F.lit(pieces)).cast("int")).otherwise(chunk)
    rows = rows.withColumn("chunk", chunk)
    units = written(_first_level(rows.groupBy("g", "chunk").agg(F.sum("size").alias("bytes")), shards))

    sums = written(units.groupBy("part", "bundle").agg(F.sum("bytes").alias("bytes")))
    path = units.select("g", "chunk", "part", "bundle")
    while True:
        teams = max(1, -(-sums.select("part").distinct().count() // FAN))
        level = written(_combine(sums.withColumn("up", F.pmod(F.xxhash64("part"), F.lit(teams)).cast("long")), shards))
        step = broadcast_if_few(level)
        path = path.join(step, ["part", "bundle"]).select("g", "chunk", F.col("up").alias("part"), F.col("to").alias("bundle"))
        if teams == 1:
            break
        sums = written(sums.join(step, ["part", "bundle"]).groupBy(F.col("up").alias("part"), F.col("to").alias("bundle")).agg(F.sum("bytes").alias("bytes")))
    # rows of one text may be a large share of all: those of the at most HOT largest groups stay where they are
    path = written(path)
    hot = F.broadcast(groups.where(F.col("n") * HOT > count).select("g"))
    few = F.broadcast(path.join(hot, "g", "left_semi"))  # HOT groups, in at most 2 * shards + 1 pieces each
    placed = rows.join(hot, "g", "left_semi").join(few, ["g", "chunk"]).unionByName(rows.join(hot, "g", "left_anti").join(path, ["g", "chunk"]))
    placed = placed.select("doc_id", "size", "text_crc32", F.col("bundle").alias("shard"))
    return _slots(written(placed))


def _slots(placed: DataFrame) -> DataFrame:
    """Gapless slots in each shard, counted within ranges of hashed doc_id and shifted by the ranges before."""
    placed = placed.withColumn("range", F.pmod(F.xxhash64("doc_id", "text_crc32"), F.lit(SLOT_RANGES)).cast("int"))
    counts = placed.groupBy("shard", "range").agg(F.count("*").alias("n"))
    before = Window.partitionBy("shard").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("shard", "range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    order = Window.partitionBy("shard", "range").orderBy("doc_id", "text_crc32", "size")
    # starts has at most shards * SLOT_RANGES rows
    return placed.withColumn("k", F.row_number().over(order)).join(F.broadcast(starts), ["shard", "range"]).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("start") + F.col("k") - 1).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )
