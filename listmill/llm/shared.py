"""Helpers that several operators of this subpackage share."""

from __future__ import annotations

import ctypes
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Spark's setting that deletes a query's shuffle files when the query has ended.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Rounds after which component labelling gives up; each round at least halves the longest chain.
MAX_ROUNDS = 60
LIBC = ctypes.CDLL(None)
#: Rows, and bytes, up to which a table is broadcast.
FEW, FEW_BYTES = 200_000, 16 << 20


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named by spark.checkpoint.dir; a local one only where the setting is absent (tests)."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        folder = tempfile.mkdtemp(prefix="spark-checkpoint-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def written(df: DataFrame) -> DataFrame:
    """`df` written once as Parquet in the shared checkpoint folder and read back.

    It cuts the lineage, so that costly Python stages run once, and survives the loss of executors. The shuffle files that
    the write needed are deleted when it has ended, as nothing reads them again.
    """
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark)}/stage-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        if before is None:
            spark.conf.unset(CLEANUP)
        else:
            spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def give_back() -> None:
    """Returns the memory that a Python task has freed to the system: its worker lives on, and idle ones add up."""
    pa.default_memory_pool().release_unused()
    if hasattr(LIBC, "malloc_trim"):
        LIBC.malloc_trim(0)


def _bytes(kind: T.DataType, x: Column) -> Column:
    """About the bytes of a value in memory."""
    if isinstance(kind, (T.StringType, T.BinaryType)):
        return F.coalesce(F.octet_length(x).cast("long"), F.lit(0)) + 8
    if isinstance(kind, T.ArrayType):
        return 16 + F.coalesce(F.aggregate(x, F.lit(0).cast("long"), lambda n, y: n + _bytes(kind.elementType, y)), F.lit(0))
    if isinstance(kind, T.StructType):
        return sum((_bytes(f.dataType, x[f.name]) for f in kind.fields), F.lit(16))
    return F.lit(8).cast("long")


def broadcast_if_few(df: DataFrame) -> DataFrame:
    """`df`, a table written before, marked for broadcast if it has at most FEW rows and FEW_BYTES bytes; else as it is, for a shuffled join."""
    size = sum((_bytes(f.dataType, F.col(f"`{f.name}`")) for f in df.schema.fields), F.lit(16))
    some = df.limit(FEW + 1).agg(F.count("*"), F.coalesce(F.sum(size), F.lit(0))).first()
    return F.broadcast(df) if some[0] <= FEW and some[1] <= FEW_BYTES else df


def components(edges: DataFrame) -> DataFrame:
    """Connected components of an undirected graph.

    edges: (a, b) of one orderable type; loops and repeated edges are allowed.
    Returns (node, root), root being the least node of the component; nodes without edges do not appear.
    Alternating large-star and small-star rounds: the number of edges never grows, a hub's neighbours are dealt by
    the smaller end's hash join, and each round is written to the shared folder.
    """
    flat = edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    start = current = written(flat.where("a <> b").distinct())
    nodes = start.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    digest = lambda df: df.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    before = digest(current)
    if not before[0]:
        return nodes.select("node", F.col("node").alias("root"))
    for _ in range(MAX_ROUNDS):
        # large star: every neighbour above a node is linked to the least node around it
        both = current.unionByName(current.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("m").alias("a"), "b").where("a <> b").distinct()
        # small star: a node and its lesser neighbours are linked to the least of them
        low = large.groupBy("b").agg(F.min("a").alias("m"))
        small = large.join(low, "b").select(
            F.explode(F.array(F.struct("m", F.col("b").alias("x")), F.struct("m", F.col("a").alias("x")))).alias("e")
        )
        after = written(small.select(F.col("e.m").alias("a"), F.col("e.x").alias("b")).where("a <> b").distinct())
        current, last, before = after, before, digest(after)
        if before == last:
            break
    else:
        raise RuntimeError("component labelling did not settle")
    root = current.groupBy("b").agg(F.min("a").alias("root"))
    return nodes.join(root, nodes.node == root.b, "left").select("node", F.coalesce("root", "node").alias("root"))


def text_or_empty(column: str = "text") -> Column:
    return F.coalesce(F.col(column), F.lit(""))
