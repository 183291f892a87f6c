"""Connected components of a distributed graph, and pointer doubling in a forest."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, as the session names it in spark.checkpoint.dir.

    Only a local session, as in tests, gets a folder of its own where it names none; on a cluster that is an error,
    as executors would write where no other machine reads.
    """
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        sc.setCheckpointDir(os.path.join(tempfile.gettempdir(), "undertow-checkpoints"))
    return sc._jsc.sc().getCheckpointDir().get()


def frozen(df: DataFrame) -> DataFrame:
    """df with its lineage cut by a reliable checkpoint in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def star(edges: DataFrame, large: bool) -> DataFrame:
    """One star operation: each vertex hands its neighbours (large: the greater, else the smaller) to the least.

    The least neighbour of each vertex is aggregated before the shuffle and joined back, so no vertex's
    neighbours are gathered; a vertex with very many is a skewed join key, which Spark splits.
    """
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = both.groupBy("a").agg(F.min("b").alias("m"))
    if large:
        least = least.select("a", F.least("a", "m").alias("m"))
        return both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
    handed = both.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return handed.union(least.select("a", F.col("m").alias("b"))).where("a <> b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """node, root of every node of edges (a, b), where root is the least node of its component.

    Large-star and small-star rounds until nothing changes; each round is checkpointed, so a lost executor
    costs at most that round. Nothing but two sums reaches the driver. Null ends and loops must be left out.
    """
    edges = frozen(edges.select("a", "b").where("a <> b").distinct())
    digest = lambda df: tuple(df.agg(F.count("*"), F.bit_xor(F.xxhash64(F.greatest("a", "b"), F.least("a", "b")))).first())
    before = digest(edges)
    while before[0]:
        edges = frozen(star(star(edges, True), False))
        after = digest(edges)
        if after == before:
            break
        before = after
    stars = edges.select(F.greatest("a", "b").alias("node"), F.least("a", "b").alias("root"))
    return stars.union(stars.select(F.col("root"), F.col("root")).distinct())


def roots(parents: DataFrame) -> DataFrame:
    """node, root of a forest (node, parent; a root is its own parent) by pointer doubling: log2 of the depth joins."""
    current = frozen(parents.select("node", "parent"))
    while True:
        up = current.select(F.col("node").alias("parent"), F.col("parent").alias("above"))
        step = frozen(current.join(up, "parent", "left").select("node", F.coalesce("above", "parent").alias("parent"), (F.coalesce("above", "parent") != F.col("parent")).alias("moved")))
        if step.where("moved").isEmpty():
            return step.select("node", F.col("parent").alias("root"))
        current = step.select("node", "parent")
