"""Nearest neighbours and top-k inner products of a stated query set against all rows of an embeddings table.

Rows are dealt once into blocks: the leaves of a kd-tree over projections, or the buckets of length, in parts of about
DATA_BLOCK rows. A query first searches one block; with the bound found there it is sent only to the blocks that can still
hold something better, and carries its bound along. Rows are never copied for queries. A window merges the winners.

Vectors that are null, empty or hold a null or non-finite component take no part; the nearest-neighbour search also
leaves out zero vectors. Vectors of different dimension are never compared. Ties go to the smaller vec_id; a query's own
row is no candidate. A vec_id given twice is two rows. Extra columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import broadcast_if_few, written

#: Rows of a block, about.
DATA_BLOCK = 1024
#: Vectors on which the kd-tree is fitted, at most, and its leaves; every vector is put into a leaf.
SAMPLE, LEAVES = 65_536, 4096
#: Dimensions of the stable projection (even, for the closed form of the chi-square distribution).
PROJECTED = 8
#: Probability with which a nearer point that is not yet seen would have had to show up already.
CONFIDENCE = 0.99
#: Width of a length bucket, as a factor; shorter vectors than the longest by a factor of LENGTH_STEP ** -LENGTHS share the last.
LENGTH_STEP, LENGTHS = 1.05, 400
#: Local cosine threshold from which one coordinate prunes best; below, half of the coordinates do.
COSINE_FOR_COORDINATE = 0.7


def usable(vectors: DataFrame, zero: bool) -> DataFrame:
    """(vec_id, v array<double>) of the vectors that take part."""
    v = F.col("embedding").cast("array<double>")
    fine = F.size(v) > 0
    fine &= F.forall(v, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < F.lit(math.inf)), F.lit(False)))
    if not zero:
        fine &= F.exists(v, lambda x: x != 0)
    return vectors.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")).where(F.col("v").isNotNull() & fine)


def _matrix(table: pa.Table) -> np.ndarray:
    flat = table["v"].combine_chunks().flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(table.num_rows, -1)


def _searched(queries: DataFrame, data: DataFrame, search: Callable, kind: str) -> DataFrame:
    """Winners (query_id, vec_id, score, order) of each query in each block it is sent to.

    queries(block, part, vec_id, v, bound, far), data(block, part, vec_id, v); `search(query ids, queries, bounds, far,
    ids, vectors)` gives the columns, best first by (order, vec_id).
    """
    arrow = pa.int64() if kind == "long" else pa.float64()

    def pair(left: pa.Table, right: pa.Table) -> pa.Table:
        cols = [[], [], [], []]
        if left.num_rows and right.num_rows:
            cols = search(left["vec_id"].to_numpy(), _matrix(left), left["bound"].to_numpy(), left["far"].to_numpy(), right["vec_id"].to_numpy(), _matrix(right))
        return pa.table([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), arrow, arrow), strict=True)], names=["query_id", "vec_id", "score", "order"])

    names = ("block", "part", "vec_id", "v", "bound", "far")
    queries = queries.select(*(F.col(c).alias(c) for c in names))  # names of its own: both sides may stem from one table
    return queries.groupBy("block", "part").cogroup(data.groupBy("block", "part")).applyInArrow(pair, f"query_id long, vec_id long, score {kind}, order {kind}")


def _best(found: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("order", "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


def _parted(data: DataFrame) -> tuple[DataFrame, DataFrame]:
    """data(block, ...) with `part`, and the blocks (block, parts): parts of about DATA_BLOCK rows by hash, however many rows are alike."""
    blocks = written(data.groupBy("block").agg(F.ceil(F.count("*") / DATA_BLOCK).alias("parts")))
    return data.join(broadcast_if_few(blocks), "block").withColumn("part", F.pmod(F.xxhash64("vec_id"), "parts")).drop("parts"), blocks


def _two_rounds(first: DataFrame, data: DataFrame, ways: Callable, search: Callable, kind: str, k: int) -> DataFrame:
    """first: queries with the block and part they start in; `ways(queries)`: with `block` of every block that their bound leaves, and `far`."""
    start = written(first.withColumns({"bound": F.lit(None).cast("double"), "far": F.lit(0.0)}))
    found = written(_searched(start, data, search, kind))
    bound = found.groupBy("query_id").agg(F.when(F.count("*") >= k, F.max("order").cast("double")).alias("bound"))
    q = start.drop("bound", "far").join(bound, F.col("vec_id") == F.col("query_id"), "left").drop("query_id")
    rest = ways(q.withColumnsRenamed({"block": "home", "part": "home_part"})).where("block <> home OR part <> home_part")
    out = found.unionByName(_searched(rest, data, search, kind))
    return _best(out, k).select("query_id", "rank", "vec_id", "score")


# --- nearest neighbours -------------------------------------------------------------------------------------------


def chi_square_quantile(p: float, m: int) -> float:
    """x with P(chi-square of m degrees <= x) = p; m is even, so the distribution has a closed form."""

    def cdf(x: float) -> float:
        term, total = 1.0, 0.0
        for i in range(m // 2):
            total += term
            term *= x / 2 / (i + 1)
        return 1 - math.exp(-x / 2) * total

    low, high = 0.0, 10.0 * m + 100
    for _ in range(80):
        mid = (low + high) / 2
        low, high = (mid, high) if cdf(mid) < p else (low, mid)
    return high


def kd_tree(points: np.ndarray, leaves: int) -> list[tuple[int, float]]:
    """(axis, threshold) of the inner nodes of a kd-tree in heap order: halves at the median of the widest coordinate."""
    out, level = [], [np.arange(len(points))]
    while len(level) < leaves:
        after = []
        for rows in level:
            part = points[rows]
            axis = int(np.argmax(np.ptp(part, axis=0))) if len(rows) else 0
            at = float(np.median(part[:, axis])) if len(rows) else 0.0
            out.append((axis, at))
            after += [rows[part[:, axis] <= at], rows[part[:, axis] > at]]
        level = after
    return out


def leaf_of(points: np.ndarray, tree: list[tuple[int, float]]) -> np.ndarray:
    """Leaf of each point."""
    node = np.zeros(len(points), np.int64)
    axes, at = np.array([t[0] for t in tree], np.int64), np.array([t[1] for t in tree])
    while len(tree) and node[:1].size and node[0] < len(tree):
        node = 2 * node + 1 + (points[np.arange(len(points)), axes[node]] > at[node])
    return node - len(tree)


def _directions(dim: int) -> np.ndarray:
    return np.random.default_rng(7).standard_normal((dim, PROJECTED))


def _batches(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Rows of one dimension at a time, with their vectors."""
    for batch in batches:
        table = pa.Table.from_batches([batch])
        sizes = np.asarray(pc.list_value_length(table["v"]))
        for dim in np.unique(sizes).tolist():
            some = table.filter(pa.array(sizes == dim))
            yield some, _matrix(some)


def nearest(queries: DataFrame, data: DataFrame, k: int = 10, confidence: float = CONFIDENCE) -> DataFrame:
    """query_id, rank, vec_id, score (Euclidean distance): approximate nearest neighbours.

    Vectors are projected to PROJECTED Gaussian (2-stable) directions, which a kd-tree indexes: it is fitted on at most
    SAMPLE vectors and holds all. In a leaf a query takes its projected neighbours one after another, nearest first, and
    verifies them on the original vectors. If a point lies within the distance d of the k-th best so far, its squared
    projected distance over d^2 is chi-square distributed; the query ends, and a leaf is left out, once the next projected
    distance is so large that this would have had probability below 1 - confidence. The k-th best distance of the query's
    own leaf goes along to all others.
    """
    data, queries = usable(data, zero=False), usable(queries, zero=False)
    limit = chi_square_quantile(confidence, PROJECTED)
    data = written(data)
    total = data.count()
    leaves = 1 << max(0, min(LEAVES, -(-total // DATA_BLOCK)) - 1).bit_length()
    sample: dict[int, list] = {}
    for row in data.select("v").orderBy(F.xxhash64("vec_id")).limit(SAMPLE).toLocalIterator() if leaves > 1 else ():  # bounded by SAMPLE
        sample.setdefault(len(row[0]), []).append(np.array(row[0]) @ _directions(len(row[0])))
    trees = {dim: kd_tree(np.stack(points), leaves) for dim, points in sample.items()}

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, v in _batches(batches):
            low = v @ _directions(v.shape[1])
            block = v.shape[1] * LEAVES + leaf_of(low, trees.get(v.shape[1], []))
            table = table.append_column("block", pa.array(block)).append_column("low", pa.array(list(low), pa.list_(pa.float64())))
            yield from table.to_batches()

    schema = "vec_id long, v array<double>, block long, low array<double>"
    placed = written(data.mapInArrow(place, schema))
    rows, blocks = _parted(placed.select("vec_id", "v", "block"))
    ends = [f(F.col("low")[i]).alias(f"{n}{i}") for n, f in (("a", F.min), ("b", F.max)) for i in range(PROJECTED)]
    # a row for each leaf of each dimension of the sample, at most LEAVES a dimension
    boxes = placed.groupBy("block").agg(*ends).join(blocks, "block").orderBy("block").toPandas()
    names, parts = boxes["block"].to_numpy(), boxes["parts"].to_numpy()
    lower, upper = (boxes[[f"{n}{i}" for i in range(PROJECTED)]].to_numpy() for n in "ab")

    def ways(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, v in _batches(batches):
            own = names // LEAVES == v.shape[1]
            bound = np.nan_to_num(table["bound"].to_numpy(), nan=np.inf)
            low = v @ _directions(v.shape[1])
            for i in range(table.num_rows):
                away = (np.maximum(0, np.maximum(lower[own] - low[i], low[i] - upper[own])) ** 2).sum(1)
                hit = np.flatnonzero(away <= limit * bound[i] ** 2)
                block, n = names[own][hit], parts[own][hit]
                one = table.slice(i, 1).take(pa.array(np.zeros(int(n.sum()), np.int64)))
                one = one.append_column("block", pa.array(np.repeat(block, n))).append_column("part", pa.array(np.concatenate([np.arange(x) for x in n]) if len(n) else [], pa.int64()))
                yield from one.append_column("far", pa.array(np.repeat(away[hit], n))).to_batches()

    def search(query_ids, queries, bounds, far, ids, vectors):
        low_q, low = queries @ _directions(vectors.shape[1]), vectors @ _directions(vectors.shape[1])
        out = []
        for query, q, p, bound in zip(query_ids.tolist(), queries, low_q, np.nan_to_num(bounds, nan=np.inf).tolist(), strict=True):
            away = ((low - p) ** 2).sum(1)
            nearby, at, step = np.argsort(away, kind="stable"), 0, k
            best_d, best_i = np.empty(0), np.empty(0, np.int64)
            while at < len(nearby):
                some = nearby[at : at + step]  # a few neighbours at a time, then some more
                some = some[away[some] <= limit * bound**2]
                if not len(some):
                    break
                at, step = at + step, min(2 * step, 64)
                d = np.sqrt(((vectors[some] - q) ** 2).sum(1))
                keep = (ids[some] != query) & (d <= bound)
                d, i = np.concatenate((best_d, d[keep])), np.concatenate((best_i, ids[some[keep]]))
                first = np.lexsort((i, d))[:k]
                best_d, best_i = d[first], i[first]
                if len(best_d) >= k:
                    bound = min(bound, float(best_d[k - 1]))
            out.append((np.full(len(best_d), query), best_i, best_d))
        query_ids, ids, d = (np.concatenate(c) for c in zip(*out, strict=True))
        return query_ids, ids, d, d

    first = queries.mapInArrow(place, schema).drop("low").join(broadcast_if_few(blocks), "block", "left")
    first = first.withColumn("part", F.pmod(F.xxhash64("vec_id"), F.coalesce("parts", F.lit(1)))).drop("parts")
    sent = "vec_id long, v array<double>, home long, home_part long, bound double, block long, part long, far double"
    go = lambda q: q.select("vec_id", "v", "home", "home_part", "bound").mapInArrow(ways, sent)
    return _two_rounds(first, rows, go, search, "double", k)


# --- top-k inner products -----------------------------------------------------------------------------------------


def quantised(vectors: DataFrame, scale: int = 256) -> DataFrame:
    """Components as floor(scale * x), as doubles that hold whole numbers."""
    return usable(vectors, zero=True).select("vec_id", F.transform("v", lambda x: F.floor(x * scale).cast("double")).alias("v"))


def top_products(queries: DataFrame, data: DataFrame, k: int = 5) -> DataFrame:
    """query_id, rank, vec_id, score (long): the exact k largest inner products of vectors of whole numbers.

    Vectors are grouped by length; a block holds vectors of one length bucket. A query starts among the longest vectors;
    with t the k-th best product there, it is sent on only to buckets of greatest length l with t <= |q| l. The local
    cosine threshold t / (|q| l) of a bucket then decides how its rows are pruned: by length and the query's largest
    coordinate (high thresholds), or by the products of the query's larger half of coordinates and what the rest of
    both can add at most. What is left is verified. Sums must stay below 2^63.
    """
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))
    data = written(data.select("vec_id", "v", F.size("v").alias("dim"), norm.alias("norm")))
    longest = broadcast_if_few(written(data.groupBy("dim").agg(F.max("norm").alias("top"))))
    step = F.least(F.floor(F.log(F.col("top") / F.col("norm")) / math.log(LENGTH_STEP)), F.lit(LENGTHS - 1))
    bucket = F.when(F.col("norm") > 0, step).otherwise(LENGTHS - 1).cast("long")
    placed = written(data.join(longest, "dim").select("vec_id", "v", "norm", "dim", (F.col("dim") * LENGTHS + bucket).alias("block")))
    rows, blocks = _parted(placed.select("vec_id", "v", "block"))
    # LENGTHS rows for each dimension at most
    buckets = broadcast_if_few(written(placed.groupBy("block", "dim").agg(F.max("norm").alias("l")).join(blocks, "block")))

    def ways(q: DataFrame) -> DataFrame:
        q = q.withColumns({"dim": F.size("v"), "norm": norm})
        q = q.join(buckets, "dim").where(F.col("bound").isNull() | (-F.col("bound") <= F.col("norm") * F.col("l") * (1 + 1e-9)))
        return q.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))).withColumn("far", F.lit(0.0))

    def search(query_ids, queries, bounds, far, ids, vectors):
        exact = np.abs(queries).max(initial=0) * np.abs(vectors).max(initial=0) * vectors.shape[1] < 2**53
        lengths = np.sqrt((vectors**2).sum(1))
        order = np.argsort(-lengths, kind="stable")
        ids, vectors, lengths = ids[order], vectors[order], lengths[order]
        whole, square = vectors if exact else vectors.astype(np.int64), vectors**2
        out = []
        for query, q, bound in zip(query_ids.tolist(), queries, bounds.tolist(), strict=True):
            n, t = float(np.sqrt((q**2).sum())), -bound if bound == bound else -math.inf
            rows = np.arange(len(ids))
            if t > 0 and n > 0:
                rows = rows[lengths * n * (1 + 1e-9) >= t]
                cosine = min(1.0, t / (n * lengths[0])) if len(rows) else 1.0
                focus = np.argsort(-np.abs(q))[: 1 if cosine >= COSINE_FOR_COORDINATE else -(-len(q) // 2)]
                rest_q = math.sqrt(max(0.0, n * n - float((q[focus] ** 2).sum())))
                rest = np.sqrt(np.maximum(0, lengths[rows] ** 2 - square[np.ix_(rows, focus)].sum(1)))
                most = vectors[np.ix_(rows, focus)] @ q[focus] + rest_q * rest
                rows = rows[most * (1 + np.sign(most) * 1e-9) + 1e-6 >= t]
            s = whole[rows] @ (q if exact else q.astype(np.int64))
            keep = (ids[rows] != query) & (s >= t)
            s, i = s[keep], ids[rows[keep]]
            first = np.lexsort((i, -s))[:k]
            out.append((np.full(len(first), query), i[first], s[first]))
        query_ids, ids, s = (np.concatenate(c) for c in zip(*out, strict=True))
        s = s.astype(np.int64)
        return query_ids, ids, s, -s

    # the longest bucket of the query's dimension, and one of its parts
    top = buckets.groupBy("dim").agg(F.min_by("block", "block").alias("block"), F.min_by("parts", "block").alias("parts"))
    first = queries.withColumn("dim", F.size("v")).join(broadcast_if_few(written(top)), "dim")
    first = first.select("vec_id", "v", "block", F.pmod(F.xxhash64("vec_id"), "parts").alias("part"))
    return _two_rounds(first, rows, ways, search, "long", k)
