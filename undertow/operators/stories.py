"""Items grouped into stories by nearness and shared entities."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from undertow.config import D
from undertow.functions.vector import dot, unit
from undertow.operators.graph import frozen, roots
from undertow.operators.neighbours import nearest_indexed, nearest_met
from undertow.operators.parts import Parts


def nearest(items: DataFrame, k: int = D.neighbours, window_s: int = D.story_window_s, known: DataFrame | None = None, floor: float = -2.0) -> DataFrame:
    """id, neighbour, similarity, place: for each item the k most similar earlier ones of the window, known ones included,
    without those less similar than floor.

    items (id, ts, embedding, entities), known likewise. Exact, by an index of blocks (nearest_indexed) that skips what can't
    be among the k. Ties go to the smaller id; items without an embedding, or with one of length 0, have no neighbours and
    are none. Embeddings have one length.
    """
    placed = lambda df: df.where("embedding is not null").select("id", "ts", unit(F.col("embedding")).alias("unit")).where("unit is not null")
    return nearest_indexed(placed(items), None if known is None else placed(known), k, window_s, floor=floor)


def nearest_by_slots(items: DataFrame, k: int = D.neighbours, window_s: int = D.story_window_s) -> DataFrame:
    """As nearest, by comparing each item with all of its own and the earlier slot of the window: what nearest is held against."""
    rows = items.where("embedding is not null").select("id", "ts", unit(F.col("embedding")).alias("unit"), F.floor(F.col("ts") / window_s).alias("slot"))
    left = rows.select("id", "ts", F.col("unit").alias("own"), F.explode(F.array("slot", F.col("slot") - 1)).alias("slot"))
    right = rows.select("slot", F.col("id").alias("neighbour"), F.col("ts").alias("then"), F.col("unit").alias("other"))
    earlier = F.struct("then", "neighbour") < F.struct("ts", "id")
    pairs = left.join(right, "slot").where(earlier & (F.col("then") >= F.col("ts") - window_s)).select("id", "neighbour", dot(F.col("own"), F.col("other")).alias("similarity"))
    place = F.row_number().over(W.partitionBy("id").orderBy(F.desc("similarity"), "neighbour"))
    return pairs.withColumn("place", place).where(F.col("place") <= k)


def lsh_shape(theta: float, recall: float = 0.95, most: int = 32) -> tuple[int, int]:
    """(tables, bits): the most bits for which up to most tables meet a neighbour at cosine theta with probability recall; one bit at least."""
    agree = 1 - math.acos(max(-1.0, min(1.0, theta))) / math.pi
    shape = None
    for bits in range(1, 17):
        missed = 1 - agree**bits
        tables = 1 if missed <= 0 else math.ceil(math.log(1 - recall) / math.log(missed))
        if shape and tables > most:
            break
        shape = tables, bits
    return shape


def nearest_lsh(items: DataFrame, theta: float = D.theta, k: int = D.neighbours, window_s: int = D.story_window_s, tables: int | None = None, bits: int | None = None, seed: int = 5, block: int = 2048) -> DataFrame:
    """As nearest, for large windows: only items that share a bucket of random hyperplane signs meet (nearest_met); then exact.

    A neighbour at cosine c is met with probability 1 - (1 - (1 - acos(c) / pi) ** bits) ** tables. Tables and
    bits not given are those of lsh_shape, so this is 0.95 at theta and more above; a low theta saves little.
    """
    import numpy as np

    fitting = lsh_shape(theta)
    tables, bits = tables or fitting[0], bits or fitting[1]
    known = items.where("embedding is not null").select(F.size("embedding")).first()
    planes = np.random.default_rng(seed).normal(size=(tables, bits, known[0] if known else 1))

    @F.pandas_udf("array<int>" if tables << bits < 1 << 31 else "array<long>")
    def buckets(vectors):
        import pandas as pd

        x = np.stack(vectors.to_numpy())
        signs = np.einsum("nd,tbd->ntb", x, planes) > 0
        codes = (signs * (1 << np.arange(bits))).sum(2)
        return pd.Series(list(codes + (np.arange(tables) << bits)))

    norm, slot = F.sqrt(dot(F.col("embedding"), F.col("embedding"))), F.floor(F.col("ts") / window_s)
    rows = items.where("embedding is not null").select("id", F.col("ts").cast("double").alias("ts"), "embedding", norm.alias("norm"), buckets("embedding").alias("buckets"), slot.alias("slot"))
    pairs = nearest_met(frozen(rows.where("norm > 0 AND norm < double('Infinity')")), k, window_s, theta, tables, bits, block).distinct()
    place = F.row_number().over(W.partitionBy("id").orderBy(F.desc("similarity"), "neighbour"))
    return pairs.withColumn("place", place).where(F.col("place") <= k)


def parents(items: DataFrame, neighbours: DataFrame, theta: float = D.theta, among: DataFrame | None = None) -> DataFrame:
    """node, parent: the nearest of an item's neighbours (of among, if given) that is similar enough and shares an entity; else itself.

    The cut to k neighbours comes before the look at entities.
    """
    own = items.select("id", F.transform("entities", F.lower).alias("own"))
    other = (items if among is None else among).select(F.col("id").alias("neighbour"), F.transform("entities", F.lower).alias("other"))
    fits = neighbours.where(F.col("similarity") >= theta).join(own, "id").join(other, "neighbour").where(F.arrays_overlap("own", "other"))
    chosen = fits.groupBy("id").agg(F.min_by("neighbour", "place").alias("parent"))
    return items.select("id").join(chosen, "id", "left").select(F.col("id").alias("node"), F.coalesce("parent", "id").alias("parent"))


def formed(items: DataFrame, theta: float = D.theta, exact: bool = False) -> DataFrame:
    """id, story_id of items (id, ts, embedding, entities): the path from vectors to stories, by buckets unless exact.

    Exact goes by the index and skips what can't be as near as theta. With buckets, whose number follows theta, an item meets
    those near it and not the whole window; of neighbours at theta it finds 0.95 and of nearer ones more.
    """
    return assigned(parents(items, nearest(items, floor=theta) if exact else nearest_lsh(items, theta), theta))


def assigned(parent_rows: DataFrame) -> DataFrame:
    """id, story_id: a story is named by the item that opened it."""
    return roots(parent_rows).select(F.col("node").alias("id"), F.col("root").alias("story_id"))


def folded(items: DataFrame) -> DataFrame:
    """One row for each story of items (story_id, id, ts, source, entities, embedding): sets, first and last time, first item
    and its vector."""
    first = F.struct("ts", "id")
    names = F.array_sort(F.array_distinct(F.flatten(F.collect_set(F.transform("entities", F.lower)))))
    return items.groupBy("story_id").agg(
        F.count("*").alias("n_items"), F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"), names.alias("entity_set"),
        F.array_sort(F.collect_set("source")).alias("source_set"), F.min_by("embedding", first).alias("centroid"), F.min_by("id", first).alias("first_id"),
    )


def refolded(folds: DataFrame) -> DataFrame:
    """Folds of the same stories over different items, as one fold over all of them."""
    first = F.struct("first_seen", "first_id")
    union = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_set(c)))).alias(c)
    out = folds.groupBy("story_id").agg(
        F.sum("n_items").alias("n_items"), F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"), union("entity_set"),
        union("source_set"), F.min_by("centroid", first).alias("centroid"), F.min_by("first_id", first).alias("first_id"),
    )
    return out.select(folds.columns)


class StoryStore:
    """Stories that grow by batches of items: what a batch adds is found from its own items and the stored ones of their window.

    Three tables in one commit: vectors (id, ts, embedding, entities), assigned (id, ts, story_id) and folds of stories, of
    which each batch writes those it has touched; stories() merges a story's folds. An item's story depends on earlier items
    only, so batches in the order of time give what all items at once would. An item that comes late finds those earlier
    ones that are there, and does not move items that are assigned.
    """

    def __init__(self, spark: SparkSession, folder: str, theta: float = D.theta, k: int = D.neighbours, window_s: int = D.story_window_s, fan: int = 8):
        self.parts = Parts(spark, folder, {"folds": refolded}, fan)
        self.theta, self.k, self.window_s = theta, k, window_s

    def add(self, number: int, items: DataFrame, before_commit: Callable[[], None] | None = None) -> bool:
        """Assign and store a batch of items (id, ts, embedding, entities, source); False if it was added before."""
        if self.parts.batch() >= number:
            return False
        rows = frozen(items.select("id", "ts", "embedding", "entities", "source"))
        known, since = self._window(rows)
        window = rows.drop("source") if known is None else known.unionByName(rows.drop("source"))
        found = frozen(parents(rows, nearest(rows, self.k, self.window_s, known, self.theta), self.theta, window))
        inside = found.join(rows.select(F.col("id").alias("parent")), "parent", "left_semi").select("node", "parent")
        outside = found.join(rows.select(F.col("id").alias("parent")), "parent", "left_anti").select("node", F.col("parent").alias("earlier"))
        tops = roots(inside.union(outside.select("node", F.col("node").alias("parent"))))
        named = tops.join(outside.withColumnRenamed("node", "root"), "root", "left")
        if known is not None:  # what leads out of the batch ends at an item of the window, whose story is known
            told = self.parts.read("assigned").where(F.col("ts") >= since).select(F.col("id").alias("earlier"), F.col("story_id").alias("told"))
            named = named.join(told, "earlier", "left").withColumn("root", F.coalesce("told", "root"))
        assigned = frozen(named.select(F.col("node").alias("id"), F.col("root").alias("story_id")).join(rows.select("id", "ts"), "id").select("id", "ts", "story_id"))
        folds = folded(rows.join(assigned.select("id", "story_id"), "id"))
        if before_commit is not None:
            before_commit()
        return self.parts.add(number, {"vectors": rows.drop("source"), "assigned": assigned, "folds": folds})

    def _window(self, rows: DataFrame) -> tuple[DataFrame | None, float | None]:
        """Stored items that a batch may meet, and from when on: parts are pruned by their least and greatest times."""
        stored = self.parts.read("vectors")
        since = rows.agg(F.min("ts")).first()[0]
        if stored is None or since is None:
            return None, None
        return stored.where(F.col("ts") >= since - self.window_s), since - self.window_s

    def assigned(self) -> DataFrame | None:
        return self.parts.read("assigned")

    def stories(self) -> DataFrame | None:
        return self.parts.merged("folds")
