"""Scores of stories: coordination, presence, velocity, gap, alerts. Times are seconds since the epoch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from undertow.config import D
from undertow.functions.series import acceleration, bin_start, corroboration_weight, ewma, gap_score, inauthenticity, z_of_last
from undertow.operators import tallies
from undertow.operators.graph import frozen
from undertow.operators.provenance import story_copies
from undertow.operators.storage import change_snapshot, exists, insert_absent, scores_updated, snapshot, upserted


def mainstream_presence(items: DataFrame) -> DataFrame:
    n = F.count_if(F.col("source_class") == "mainstream")
    return items.groupBy("story_id").agg(n.alias("mainstream_items")).withColumn("mainstream_presence", F.least(F.lit(1.0), F.col("mainstream_items") / D.saturation))


def synchronised(items: DataFrame, window_s: int = D.sync_s) -> DataFrame:
    """story_id, social_items, synced_items: social items with another of the story within window_s, before or after."""
    w = W.partitionBy("story_id").orderBy("ts", "id")
    social = items.where("source_class = 'social'").select("story_id", "ts", F.lag("ts").over(w).alias("before"), F.lead("ts").over(w).alias("after"))
    near = F.coalesce(F.col("ts") - F.col("before") <= window_s, F.lit(False)) | F.coalesce(F.col("after") - F.col("ts") <= window_s, F.lit(False))
    return social.groupBy("story_id").agg(F.count("*").alias("social_items"), F.count_if(near).alias("synced_items"))


def low_reputation(items: DataFrame, stories: DataFrame) -> DataFrame:
    """story_id, low_rep_items: social items of authors with three or more items of which half are in flagged stories.

    stories (story_id, inauthenticity) as the cycle before left them, so no story's score depends on the
    order in which others are scored. An item of no story counts as unflagged.
    """
    social = items.where("source_class = 'social' AND author_ref <> ''")
    flags = social.join(stories.select("story_id", "inauthenticity"), "story_id", "left")
    bad = F.avg(F.when(F.col("inauthenticity") >= D.flag, 1.0).otherwise(0.0))
    authors = flags.groupBy("author_ref").agg(F.count("*").alias("n"), bad.alias("bad_share"))
    offenders = authors.where((F.col("n") >= D.rep_items) & (F.col("bad_share") >= D.rep_share)).select("author_ref")
    return social.join(offenders, "author_ref").groupBy("story_id").agg(F.count("*").alias("low_rep_items"))


def copies(edges: DataFrame) -> DataFrame:
    return edges.where(F.col("edge_type").isin("copy", "author")).groupBy("story_id").agg(F.count("*").alias("copy_edges"))


def copies_by_class(items: DataFrame) -> DataFrame:
    """As copies, from items (story_id, id, ts, author_ref, simhash) without an edge between two of them: n items of one
    author, or of one simhash, are n (n - 1) / 2 edges, and two simhashes near each other the product of their numbers."""
    pairs = (F.sum(F.col("n") * (F.col("n") - 1)) / 2).cast("long").alias("n")
    authors = items.where("author_ref <> ''").groupBy("story_id", "author_ref").agg(F.count("*").alias("n")).groupBy("story_id").agg(pairs)
    classes, links = story_copies(items)
    found = authors.union(classes.groupBy("story_id").agg(pairs)).union(links.groupBy("story_id").agg(F.sum("n").alias("n")))
    return found.groupBy("story_id").agg(F.sum("n").alias("copy_edges")).where("copy_edges > 0")


def story_inauthenticity(items: DataFrame, copied: DataFrame, origins: DataFrame, previous: DataFrame) -> DataFrame:
    """story_id, social_items, synced_items, low_rep_items, copy_edges, inauthenticity, for stories with social items.

    copied (story_id, copy_edges) is copies' or copies_by_class'.
    """
    joined = synchronised(items).join(low_reputation(items, previous), "story_id", "left").join(copied, "story_id", "left").join(origins.select("story_id", "independent_origins"), "story_id", "left")
    joined = joined.fillna(0, ["low_rep_items", "copy_edges", "independent_origins"])
    score = inauthenticity(*(F.col(c) for c in ("social_items", "independent_origins", "copy_edges", "synced_items", "low_rep_items")))
    return joined.withColumn("inauthenticity", score)


def velocities(story_entities: DataFrame, mentions: DataFrame, since: int, now: int, seconds: int = D.bin_s) -> DataFrame:
    """story_id, velocity_z: acceleration of all mentions of a story's entities in the last bin against those before.

    story_entities (story_id, entity). Mentions in the second of since itself are out; the bin of now is in.
    """
    bins = tallies.binned(mentions, since, seconds)
    by_story = story_entities.distinct().join(bins, "entity").groupBy(F.col("story_id").alias("entity"), "bin").agg(F.sum("n").alias("n"))
    rows = tallies.series(by_story, since, now // seconds * seconds, seconds)
    z = F.when(F.size("series") < D.min_buckets, 0.0).otherwise(z_of_last(acceleration(ewma(F.col("series")))))
    return rows.select(F.col("entity").alias("story_id"), z.alias("velocity_z"))


def warming(mentions: DataFrame, now: int, baseline_s: int = D.baseline_s) -> DataFrame:
    """earliest, warming, since: one row; warming until the oldest tally of the baseline is half a day old."""
    earliest = mentions.where(F.col("bucket") > now - baseline_s).agg(F.min("bucket").alias("earliest"))
    start = F.coalesce(F.greatest(F.lit(now - baseline_s), F.col("earliest")), F.lit(now))
    return earliest.withColumn("warming", F.coalesce(now - F.col("earliest") < D.warm_s, F.lit(True))).withColumn("since", bin_start(start, D.bin_s))


def active(stories: DataFrame, now: int, most: int | None = None) -> DataFrame:
    """Stories seen in the last two days that have entities, the newest first."""
    out = stories.where((F.col("last_seen") > now - D.active_s) & (F.size("entity_set") > 0))
    return out.orderBy(F.desc("last_seen"), "story_id").limit(most) if most else out


def score_cycle(stories: DataFrame, items: DataFrame, copied: DataFrame, mentions: DataFrame, now: int, seconds: int = D.bin_s) -> DataFrame:
    """Scores of all active stories as one plan: no loop over stories.

    stories (story_id, last_seen, entity_set, trust_state, independent_origins, inauthenticity); copied (story_id, copy_edges).
    """
    live = active(stories, now).select("story_id", "entity_set", "trust_state", "independent_origins")
    start = warming(mentions, now).first()  # one row
    since = start["since"] // seconds * seconds
    entities = live.select("story_id", F.explode("entity_set").alias("entity"))
    velocity = velocities(entities, mentions, since, now, seconds)
    fake = story_inauthenticity(items, copied, live, stories).select("story_id", F.col("inauthenticity").alias("new_inauthenticity"))
    joined = live.join(velocity, "story_id", "left").join(mainstream_presence(items), "story_id", "left").join(fake, "story_id", "left")
    joined = joined.select("story_id", "trust_state", F.coalesce("velocity_z", F.lit(0.0)).alias("velocity_z"), F.coalesce("mainstream_presence", F.lit(0.0)).alias("mainstream_presence"), F.coalesce("new_inauthenticity", F.lit(0.0)).alias("inauthenticity"))
    gap = gap_score(F.col("velocity_z"), F.col("mainstream_presence"), corroboration_weight(F.col("trust_state")), F.col("inauthenticity"))
    return joined.withColumn("gap", gap).withColumn("warming", F.lit(start["warming"]))


def alert_gate() -> F.Column:
    return (~F.col("warming")) & (F.col("gap") > D.alert_gap) & (F.col("trust_state") != "rumor")


def new_alerts(scored: DataFrame, alerts: DataFrame, now: int, cooldown_s: int = D.cooldown_s) -> DataFrame:
    """Alerts to append: those that pass the gate, of stories without one in the cooldown."""
    due = scored.where(alert_gate()).select("story_id", F.lit(now).cast("long").alias("ts"), "gap", "velocity_z", "trust_state")
    recent = alerts.where(F.col("ts") > now - cooldown_s).select("story_id")
    return due.join(recent, "story_id", "left_anti")


def cycle(stories: DataFrame, items: DataFrame, copied: DataFrame, mentions: DataFrame, alerts: DataFrame, now: int, seconds: int = D.bin_s) -> dict[str, DataFrame]:
    """A whole cycle, each part a table for its writer: scores, stories with them, alerts to append, and the health beat.

    Scores are of all active stories at once; alerts follow from them; the beat tells readers whether the baseline warms.
    """
    scored = score_cycle(stories, items, copied, mentions, now, seconds)
    warm = F.coalesce(F.bool_or("warming"), F.lit(True))
    value = F.to_json(F.struct(warm.alias("baseline_warming"), F.count("*").alias("stories")))
    beat = scored.agg(value.alias("value")).select(F.lit("score").alias("key"), "value", F.timestamp_seconds(F.lit(now)).alias("updated_at"))
    return {"scores": scored, "stories": scores_updated(stories, scored), "alerts": new_alerts(scored, alerts, now), "state": beat}


def run_cycle(spark: SparkSession, folder: str, now: int, seconds: int = D.bin_s) -> dict[str, int]:
    """A cycle over the tables in folder, written back: the snapshots stories and state, and the table alerts."""
    stories = snapshot(spark, f"{folder}/stories")
    read = {name: spark.read.parquet(f"{folder}/{name}") for name in ("items", "edges", "mentions")}
    old = spark.read.parquet(f"{folder}/alerts") if exists(spark, f"{folder}/alerts") else spark.createDataFrame([], "story_id long, ts long")
    parts = cycle(stories, read["items"], copies(read["edges"]), read["mentions"], old, now, seconds)
    found = frozen(parts["alerts"].join(stories.select("story_id", "entity_set"), "story_id"))
    scores = frozen(parts["scores"])
    change_snapshot(spark, f"{folder}/stories", lambda rows: scores_updated(rows, scores))  # on what another writer has left, if one was faster
    insert_absent(found.withColumn("at", F.timestamp_seconds("ts")), f"{folder}/alerts", "alerts", "at")
    beat = frozen(parts["state"])
    change_snapshot(spark, f"{folder}/state", lambda rows: beat if rows is None else upserted(rows, beat))
    return {"scored": scores.count(), "alerts": found.count()}
