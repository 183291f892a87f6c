"""From raw items to enriched ones: tally, dedup, relevance, admission or exploration, tagging, embedding."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from undertow.functions.text import composed_relevance, relevance
from undertow.functions.vector import hash_embedding
from undertow.operators.admission import governed
from undertow.operators.entities import filled_geo, merged
from undertow.operators.storage import dedup_key
from undertow.schemas import ENTITY, GEO


def drained(items: DataFrame, match: Callable, replica: str = "batch") -> DataFrame:
    """entity, bucket_ts, replica, mentions of the minutes of items (text, ts seconds): every item counts, copies too."""
    found = items.select(F.explode(match("text")).alias("e"), (F.floor(F.col("ts") / 60) * 60).alias("bucket"))
    return found.groupBy(F.lower("e.text").alias("entity"), F.timestamp_seconds("bucket").alias("bucket_ts"), F.lit(replica).alias("replica")).agg(F.count("*").cast("int").alias("mentions"))


def judged(items: DataFrame, score: Callable[[Column], Column] = relevance) -> DataFrame:
    """items with relevance: that of their text, raised for a place and for entities."""
    return items.withColumn("relevance", composed_relevance(score(F.col("text")), F.col("geo").isNotNull(), F.coalesce(F.size("entities"), F.lit(0))))


def enriched(
    items: DataFrame, match: Callable | None = None, tag: Callable | None = None, embed: Callable | None = None, known: DataFrame | None = None, score: Callable[[Column], Column] = relevance, lanes: int = 1
) -> DataFrame:
    """The items that pass, with entities, geo, relevance, exploration and embedding.

    items (id, ts seconds, text, content_hash, source_class, entities, geo). Of copies the first stays, and none whose key
    (content_hash, or the text where that is empty) is that of an item of known (content_hash, text). The governor sees each of these once, in order of ts; of those that it sheds a reproducible
    few stay, marked as exploration. Only what stays is tagged (match: a gazetteer's matcher; tag: a tagger) and embedded.
    """
    keyed = judged(items, score).select("id", "ts", "relevance", "source_class", dedup_key().alias("dedup_key"))  # narrow: texts come back for what stays
    first = keyed.groupBy("dedup_key").agg(F.min_by(F.struct("id", "ts", "relevance", "source_class"), F.struct("ts", "id")).alias("first")).select("first.*", "dedup_key")
    if known is not None:
        texts = known if "text" in known.columns else known.where("content_hash <> ''").withColumn("text", F.lit(None).cast("string"))
        seen = texts.select(dedup_key().alias("known_key")).distinct()
        first = first.join(seen, F.col("dedup_key").eqNullSafe(F.col("known_key")), "left_anti")
    stays = governed(first.select("id", "ts", "relevance", "source_class"), lanes).where("admitted OR exploration").select("id", "exploration")
    place = F.to_json(F.struct("id", "ts", "dedup_key")).alias("place")  # one string, so that the join's order serves what follows
    chosen = first.join(stays, "id").select(place, "relevance", "exploration")
    whole = items.withColumn("dedup_key", dedup_key()).select(*items.columns, place)
    # an item that was delivered twice is there once
    out = whole.join(chosen, "place").dropDuplicates(["place"]).drop("place")
    return finished(out, match, tag, embed or hash_embedding())


def finished(out: DataFrame, match: Callable | None, tag: Callable | None, embed: Callable) -> DataFrame:
    """Items that stay, with what tag and match find in their texts merged into entities and geo, and with embedding."""
    for find in (tag, match):
        if find is not None:
            out = out.withColumn("found", F.transform(find("text"), as_entity(has_place=find is match)))
            out = out.withColumn("geo", filled_geo(F.col("geo"), F.col("entities"), F.col("found"))).withColumn("entities", merged(F.col("entities"), F.col("found"))).drop("found")
    return out.withColumn("embedding", embed("text"))


def as_entity(has_place: bool) -> Callable[[Column], Column]:
    """A found entity as the schema has it."""

    def one(e: Column) -> Column:
        none = F.lit(None).cast(GEO)
        geo = F.when(e["lat"].isNotNull() & e["lon"].isNotNull(), F.struct(e["lat"].alias("lat"), e["lon"].alias("lon"), F.lit(None).cast("string").alias("geohash"))).otherwise(none) if has_place else none
        return F.struct(e["text"].alias("text"), e["type"].alias("type"), geo.alias("geo")).cast(ENTITY)

    return one
