"""Near-duplicate documents: a chosen-path set similarity join over minwise tokens.

Every document is a set of word shingles with SIGNATURE minwise tokens. A tree puts each set into the node of its token at
a chosen coordinate; a node of at most NODE sets compares them exhaustively on the tokens' low bytes, a larger one picks
one coordinate (sometimes two) from its own path and branches again. TREES independent trees make it next to certain that
two sets above the threshold meet in a small node. Candidates only form coarse classes; inside these every pair is
decided on the full sets, in blocks of bounded size, so links are exact and no partner is capped.

Recall: a pair of similarity s meets below the root of one tree with probability s, so not to meet at all in 8 trees has
probability (1 - s)^8 (3e-6 at 0.8). In nodes that need further levels about 18 % of the nodes branch twice, which
offsets the loss of a level. Nodes still too large after LEVELS levels are compared in all pairs of blocks instead.

Null and empty texts and texts without words have no shingles and are linked with nothing. Texts of fewer words than a
shingle are one shingle of all their words. Equal sets are one vertex, however many rows have it. Rows that repeat a
doc_id count as that document. Extra columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import _Cache
from .groups import Forest, link_batch, runs
from .shared import broadcast_if_few, components, text_or_empty, written

#: Minwise tokens of a set, trees, sets of a small node, and levels of branching.
SIGNATURE, TREES, NODE, LEVELS = 64, 8, 1024, 24
#: Standard deviations by which the estimate from a signature may fall below the threshold.
SLACK = 4
#: Sets, and shingles in all, of a block of exact comparison.
BLOCK, BLOCK_SHINGLES = 128, 1 << 18
#: Share of nodes that branch twice, in thousandths (1 / 0.85 - 1).
TWICE = 176

_ODD = np.random.default_rng(11).integers(0, 1 << 63, SIGNATURE, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_MIX = [np.uint64(m) for m in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB)]


def word_hashes() -> _Cache:
    return _Cache(xxhash.xxh3_64_intdigest)


def shingle_set(text: str, words: int, hashed: _Cache) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles: A-Z lower-cased, words cut at ASCII white space."""
    parts = text.encode().lower().split()
    if not parts:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(hashed.__getitem__, parts), np.uint64, len(parts))
    k = min(words, len(h))
    out = np.full(len(h) - k + 1, k, np.uint64)
    for i in range(k):
        out = (out ^ h[i : len(h) - k + 1 + i]) * _MIX[0]
        out ^= out >> np.uint64(29)
    out *= _MIX[1]
    out ^= out >> np.uint64(32)
    out *= _MIX[2]
    return np.unique(out)


def signature(shingles: np.ndarray) -> np.ndarray:
    """SIGNATURE minwise tokens of 32 bits."""
    least = np.full(SIGNATURE, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(shingles), 1024):
        np.minimum(least, (shingles[at : at + 1024, None] * _ODD).min(0), out=least)
    return (least >> np.uint64(32)).astype(np.uint32)


def fingerprint(shingles: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(shingles.tobytes())


def sketches(docs: DataFrame, words: int) -> DataFrame:
    """doc_id, n_shingles, set (16-byte fingerprint of the whole set), tokens array<int>, sketch (low bytes of the tokens)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashed = word_hashes()
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                sets = [shingle_set(t, words, hashed) for t in part.column(1).to_pylist()]
                tokens = np.stack([signature(s) for s in sets])
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0),
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array([fingerprint(s) for s in sets], pa.binary()),
                        pa.ListArray.from_arrays(pa.array(np.arange(len(sets) + 1, dtype=np.int32) * SIGNATURE), pa.array(tokens.view(np.int32).ravel())),
                        pa.array([t.tobytes() for t in tokens.astype(np.uint8)], pa.binary()),
                    ],
                    ["doc_id", "n_shingles", "set", "tokens", "sketch"],
                )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_shingles long, set binary, tokens array<int>, sketch binary")


def _compare_nodes(rows: DataFrame, least: int) -> DataFrame:
    """rows(node, set, sketch) -> links (a, b) that connect all sets of a node with `least` equal low bytes or more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        for node in runs(batches, "node"):
            names = node["set"].to_pylist()
            s = np.frombuffer(b"".join(node["sketch"].to_pylist()), np.uint8).reshape(len(names), SIGNATURE)
            if len(names) == 2:
                if names[0] != names[1] and (s[0] == s[1]).sum() >= least:
                    out.append((names[0], names[1]))
            else:
                forest = Forest(len(names))
                for i in range(len(names) - 1):
                    for j in (np.flatnonzero((s[i + 1 :] == s[i]).sum(1, dtype=np.int16) >= least) + i + 1).tolist():
                        forest.join(i, j)
                out += [(names[i], names[j]) for i, j in forest.links if names[i] != names[j]]
            if len(out) >= 5000:
                yield link_batch(out, pa.binary())
                out = []
        if out:
            yield link_batch(out, pa.binary())

    return rows.select("node", "set", "sketch").repartition("node").sortWithinPartitions("node").mapInArrow(run, "a binary, b binary")


def _candidates(sets: DataFrame, threshold: float) -> DataFrame:
    """Links (a, b) that connect every two sets which met in a node and look alike there."""
    share = threshold - SLACK * (threshold * (1 - threshold) / SIGNATURE) ** 0.5
    least = int(share * SIGNATURE)
    rows = sets.select("set", "sketch", "tokens", F.explode(F.array(*[F.xxhash64(F.lit(t), F.col("tokens")[t]) for t in range(TREES)])).alias("node"))
    found = None
    for level in range(LEVELS + 1):
        large = written(rows.groupBy("node").agg(F.count("*").alias("n")).where(F.col("n") > NODE))
        any_large = bool(large.limit(1).count())
        small = rows.join(large, "node", "left_anti") if any_large else rows
        links = _compare_nodes(small, least)
        found = links if found is None else found.unionByName(links)
        if not any_large:
            return found
        rest = rows.join(large, "node")
        if level == LEVELS:
            parts = F.ceil(F.col("n") / BLOCK)
            return found.unionByName(_compare_nodes(_block_pairs(rest.withColumn("parts", parts), F.xxhash64("set"), "node"), least))
        pick = lambda b: F.expr(f"tokens[pmod(xxhash64(node, {level}, {b}), {SIGNATURE})]")
        children = F.array(
            F.xxhash64("node", F.lit(0), pick(0)), F.when(F.expr(f"pmod(xxhash64(node, {level}, 2), 1000) < {TWICE}"), F.xxhash64("node", F.lit(1), pick(1)))
        )
        rows = written(rest.select("set", "sketch", "tokens", F.explode(F.array_compact(children)).alias("node")))
    return found


def _block_pairs(rows: DataFrame, spread, key: str) -> DataFrame:
    """rows with `parts`: each row goes to every pair of blocks of its group that has its own block; `node` names the pair."""
    own = F.pmod(spread, F.col("parts"))
    rows = rows.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts").cast("long") - 1)))
    return rows.withColumn("node", F.xxhash64(F.col(key), F.least("own", "other"), F.greatest("own", "other")))


def _exact_links(docs: DataFrame, members: DataFrame, words: int, percent: int) -> DataFrame:
    """members(doc_id, set, root, n_shingles): links (a, b) connecting all sets of a coarse class whose similarity is at least percent / 100."""
    sizes = members.groupBy("root").agg(F.count("*").alias("n"), F.sum("n_shingles").alias("shingles"))
    sizes = sizes.select("root", F.greatest(F.ceil(F.col("n") / BLOCK), F.ceil(F.col("shingles") / BLOCK_SHINGLES)).alias("parts"))
    wanted = written(members.join(sizes, "root"))

    def full(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashed = word_hashes()
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                keep, sets = [], []
                for i, (text, name) in enumerate(zip(part["text"].to_pylist(), part["set"].to_pylist(), strict=True)):
                    s = shingle_set(text, words, hashed)
                    if fingerprint(s) == name:  # else another row has the same doc_id
                        keep.append(i)
                        sets.append(s.tobytes())
                part = part.take(pa.array(keep, pa.int64()))
                yield pa.RecordBatch.from_arrays([part["root"], part["set"], part["parts"], pa.array(sets, pa.binary())], ["root", "set", "parts", "shingles"])

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    rows = texts.join(broadcast_if_few(wanted), "doc_id").select("text", "set", "root", "parts").mapInArrow(full, "root binary, set binary, parts long, shingles binary")
    rows = _block_pairs(rows, F.xxhash64("set"), "root").select("node", "set", "shingles")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in runs(batches, "node"):
            names = block["set"].to_pylist()
            sets = [np.frombuffer(s, np.uint64) for s in block["shingles"].to_pylist()]
            out = [(names[i], names[j]) for i, j in linked(sets, percent) if names[i] != names[j]]
            if out:
                yield link_batch(out, pa.binary())

    return rows.repartition("node").sortWithinPartitions("node").mapInArrow(run, "a binary, b binary")


def linked(sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """A spanning forest of the links between sets: 100 * intersection >= percent * union."""
    forest, n = Forest(len(sets)), [len(s) for s in sets]
    if len(sets) <= 4:
        for i in range(len(sets)):
            for j in range(i + 1, len(sets)):
                if 100 * min(n[i], n[j]) >= percent * max(n[i], n[j]) and forest.root(i) != forest.root(j):
                    both = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
                    if 100 * both >= percent * (n[i] + n[j] - both):
                        forest.join(i, j)
        return forest.links
    # incidence of all sets over the shingles that two or more of them have, multiplied in slices of the vocabulary
    flat = np.concatenate(sets)
    shingle, column, count = np.unique(flat, return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(len(sets)), n)
    number = np.cumsum(count > 1) - 1
    keep = count[column] > 1
    row, column = row[keep], number[column[keep]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    both = np.zeros((len(sets), len(sets)), np.float32)
    total, width = int((count > 1).sum()), 4096
    for at in range(0, total, width):
        a, b = np.searchsorted(column, (at, at + width))
        m = np.zeros((len(sets), min(width, total - at)), np.float32)
        m[row[a:b], column[a:b] - at] = 1
        both += m @ m.T
    size = np.array(n)
    both = both.astype(np.int64)
    hit = 100 * both >= percent * (size[:, None] + size[None, :] - both)
    for i, j in zip(*(x.tolist() for x in np.nonzero(np.triu(hit, 1))), strict=True):
        forest.join(i, j)
    return forest.links


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id reachable over links), kept (it is that document)."""
    table = written(sketches(docs, words))
    sets = table.where("n_shingles > 0").groupBy("set").agg(F.min("doc_id").alias("doc_id"), F.first("n_shingles").alias("n_shingles"), F.first("tokens").alias("tokens"), F.first("sketch").alias("sketch"))
    sets = written(sets)
    coarse = components(written(_candidates(sets, percent / 100)))
    members = written(coarse.join(sets.select("set", "doc_id", "n_shingles"), coarse.node == sets.set).select("set", "doc_id", "n_shingles", "root"))
    exact = components(written(_exact_links(docs, members, words, percent)))
    named = sets.select("set", "doc_id").join(exact, F.col("set") == F.col("node"), "left").select("set", "doc_id", F.coalesce("root", "set").alias("root"))
    least = named.where(F.col("root") != F.col("set")).select("root").distinct()
    linked_sets = named.join(least, "root")
    smallest = linked_sets.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    classes = named.join(smallest, "root", "left").select("set", F.coalesce("component_id", "doc_id").alias("component_id"))
    out = table.select("doc_id", "n_shingles", "set").join(classes, "set", "left")
    component = F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), (F.col("doc_id") == component).alias("kept"))
