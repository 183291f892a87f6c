"""Primary match of two streams that arrive together, late or not: what a batch can change is matched again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from undertow.config import D
from undertow.operators.graph import frozen
from undertow.operators.matching import names, primary_matches
from undertow.operators.parts import Parts

CLAIM = ("story_id", "id", "ts", "entities", "lat", "lon")
OFFICIAL = CLAIM[1:]


def _by_day(rows: DataFrame, near: bool = False) -> DataFrame:
    """rows with entity and day of each entity; near: and of the days beside."""
    day = F.floor(F.col("ts") / D.match_s)
    keyed = rows.where("ts IS NOT NULL").withColumn("entity", F.explode(names(F.col("entities"))))
    return keyed.withColumn("day", F.explode(F.array(day - 1, day, day + 1)) if near else day)


def _touched(rows: DataFrame, others: DataFrame) -> DataFrame:
    """Of rows those that share an entity with one of others, at most a day (of the calendar) apart."""
    keys = _by_day(others, near=True).select("entity", "day").distinct()
    return _by_day(rows).join(keys, ["entity", "day"], "left_semi").select(*rows.columns).distinct()


class MatchStore:
    """Claims, official items and the newest match of each claim, parts under one commit log.

    A batch's official items may give claims of earlier batches another match, or none, where fifty newer ones that are too
    far apart came in; so the claims that share an entity and a day with them are matched again, with those of the batch,
    against the official items of the entities and days that these claims have. Neither side is read into one task, and no
    pair is made beyond those that primary_matches looks at. since (seconds) lets merges forget what is older.
    """

    def __init__(self, spark: SparkSession, folder: str, since: int | None = None, fan: int = 8):
        kept = lambda rows: rows if since is None else rows.where(F.col("ts") >= since)
        newest = lambda rows: rows.groupBy("story_id", "id").agg(F.max_by(F.struct("primary_id"), "batch")["primary_id"].alias("primary_id"), F.max("batch").alias("batch"))
        self.parts = Parts(spark, folder, {"claims": kept, "official": kept, "matches": newest}, fan)

    def add(self, batch: int, claims: DataFrame, official: DataFrame) -> bool:
        """Commit a batch of claims (story_id, id, ts, entities, lat, lon) and official items (the same but story_id)."""
        if self.parts.batch() >= batch:
            return False
        claims, official = claims.select(*CLAIM), official.select(*OFFICIAL)
        before, known = self.parts.read("claims"), self.parts.read("official")
        asked = frozen(claims if before is None else claims.union(_touched(before, official)).distinct())
        backing = official if known is None else official.union(_touched(known, asked))
        found = primary_matches(asked, backing)
        now = asked.select("story_id", "id").distinct().join(found, ["story_id", "id"], "left").withColumn("batch", F.lit(batch).cast("long"))
        return self.parts.add(batch, {"claims": claims, "official": official, "matches": now})

    def matches(self) -> DataFrame:
        """story_id, id, primary_id of the claims that are backed as far as the batches go."""
        return self.parts.merged("matches").where("primary_id IS NOT NULL").drop("batch")


def write_matches(items: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Keep path at the matches of a stream of items (story_id, id, ts, source_class, entities, lat, lon): social ones are
    claims, authoritative and primary ones back them. A batch that is taken again counts once."""

    def save(batch: DataFrame, number: int) -> None:
        rows = frozen(batch)
        official = F.col("source_class").isin("authoritative", "primary")
        MatchStore(batch.sparkSession, path).add(number, rows.where("source_class = 'social'"), rows.where(official))

    return items.writeStream.foreachBatch(save).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
