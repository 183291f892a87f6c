"""Mention tallies and the series made of them. Times are seconds since the epoch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from undertow.config import D
from undertow.functions.series import bin_start


def minute_tallies(mentions: DataFrame, seconds: int = 60) -> DataFrame:
    """entity, bucket, mentions from mentions (entity, ts)."""
    return mentions.groupBy(F.lower("entity").alias("entity"), bin_start(F.col("ts"), seconds).alias("bucket")).agg(F.count("*").alias("mentions"))


def hottest(tallies: DataFrame, most: int = D.max_counts) -> DataFrame:
    """The most frequent entities of each bucket; equal counts in order of name. Catalyst prunes each group before the shuffle."""
    rank = F.row_number().over(W.partitionBy("bucket").orderBy(F.desc("mentions"), "entity"))
    return tallies.withColumn("place", rank).where(F.col("place") <= most)


def binned(tallies: DataFrame, since: int, seconds: int) -> DataFrame:
    """entity, bin, n: sums over replicas in bins, of buckets after since (since itself is out)."""
    return tallies.where(F.col("bucket") > since).groupBy("entity", bin_start(F.col("bucket"), seconds).alias("bin")).agg(F.sum("mentions").cast("double").alias("n"))


def dense(bins: DataFrame, since: int, until: int, seconds: int) -> DataFrame:
    """entity, bin, n with zeros where no bin is, from since to until inclusive (since is on the grid).

    A map of each entity's own bins is probed, so a long silence costs no rows before it is asked for.
    """
    maps = bins.groupBy("entity").agg(F.map_from_entries(F.collect_list(F.struct("bin", "n"))).alias("known"))
    grid = F.explode(F.sequence(F.lit(since).cast("long"), F.lit(until).cast("long"), F.lit(seconds).cast("long")))
    return maps.withColumn("bin", grid).select("entity", "bin", F.coalesce(F.try_element_at("known", F.col("bin")), F.lit(0.0)).alias("n"))


def series(bins: DataFrame, since: int, until: int, seconds: int) -> DataFrame:
    """entity, series: the same as one array for each entity, oldest first."""
    maps = bins.groupBy("entity").agg(F.map_from_entries(F.collect_list(F.struct("bin", "n"))).alias("known"))
    grid = F.sequence(F.lit(since).cast("long"), F.lit(until).cast("long"), F.lit(seconds).cast("long"))
    return maps.select("entity", F.transform(grid, lambda t: F.coalesce(F.try_element_at("known", t), F.lit(0.0))).alias("series"))
