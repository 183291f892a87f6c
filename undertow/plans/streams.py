"""Streaming queries run over the tables until they are read, then what they wrote."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from undertow.operators.graph import shared_folder
from undertow.plans.adapters import ITEMS, MENTIONS, MINUTES, items, last_mention, mentions, seconds
from undertow.plans.mention_queries import HOUR, SERIES
from undertow.plans.provenance_queries import FOLD, THETA, shown_folds, vectors
from undertow.plans.story_queries import CALM, CALM_PHRASES, raw_items
from undertow.plans.catalog import ORACLE_SQL, query
from undertow.streaming import jobs, matching, velocity


def folder(spark: SparkSession) -> str:
    """A new folder among those that the session shares with its executors."""
    return f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"


def stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    schema = spark.read.parquet(f"{sf_dir}/{name}.parquet").schema
    return spark.readStream.schema(schema).parquet(f"{sf_dir}/{name}.parquet*")


@query("SELECT lower(event_type) AS entity, CAST(floor(epoch(ts)) AS BIGINT) // 60 * 60 AS bucket, count(*) AS mentions FROM events GROUP BY ALL")
def stream_tally(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Minute windows over the events as a stream; equal to tally_minute."""
    out = folder(spark)
    rows = stream(spark, sf_dir, "events").select(F.col("event_type").alias("entity"), F.timestamp_seconds(seconds(F.col("ts"))).alias("ts"))
    jobs.write_tallies(rows, f"{out}/tallies", f"{out}/checkpoint").awaitTermination()
    return jobs.newest_tallies(spark, f"{out}/tallies").select("entity", F.unix_timestamp("bucket_ts").alias("bucket"), "mentions")


@query("SELECT md5(text) AS digest, length(text) AS n_chars FROM documents GROUP BY text")
def stream_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as a stream, each text once."""
    out = folder(spark)
    rows = stream(spark, sf_dir, "documents").select("doc_id", "text", F.lit("").alias("content_hash"), F.timestamp_seconds(F.lit(1_704_067_200)).alias("ts_observed"))
    jobs.deduplicated(rows).select("doc_id", "text").writeStream.format("parquet").option("path", f"{out}/kept").option("checkpointLocation", f"{out}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{out}/kept").select(F.md5(F.col("text").cast("binary")).alias("digest"), F.length("text").cast("long").alias("n_chars"))


def arriving(rows: DataFrame, path: str, slices: int):
    """rows laid down in path as files, one slice of time after the other; yields after each."""
    first, last = rows.agg(F.min("ts"), F.max("ts")).first()
    width = (last - first) // slices + 1
    for i in range(slices):
        rows.where((F.col("ts") >= first + i * width) & (F.col("ts") < first + (i + 1) * width)).write.mode("append").parquet(path)
        yield i


@query(CALM)
def enrich_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """enrich_calm as a stream that is stopped and started again for each of three batches: keys of earlier ones are state."""
    from undertow.operators import entities
    from undertow.streaming import enrichment

    out, rows = folder(spark), raw_items(spark, sf_dir)
    for _ in arriving(rows, f"{out}/in", 3):
        coming = spark.readStream.schema(rows.schema).parquet(f"{out}/in")
        enrichment.enrich_stream(coming, f"{out}/kept", f"{out}/checkpoint", match=entities.matcher(CALM_PHRASES)).awaitTermination()
    kept = enrichment.store(spark, f"{out}/kept").read("items")
    return kept.select("id", F.round("relevance", 6).alias("relevance"), F.size("entities").cast("long").alias("n_entities"), F.size("embedding").alias("n_dim"))


@query(f"""WITH t AS (SELECT {1_704_067_200} + doc_id * 60 AS ts, ' ' || array_to_string(regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+'), '  ') || ' ' AS flat FROM documents),
m AS (SELECT ts, trim(unnest(regexp_extract_all(flat, ' (?:of|the|und|de) '))) AS entity FROM t)
SELECT entity, ts // 60 * 60 AS bucket, CAST(count(*) AS INTEGER) AS mentions FROM m GROUP BY ALL""")
def enrich_stream_tallies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the same stream counts, copies included, in the commits that its items become visible in."""
    from undertow.operators import entities
    from undertow.streaming import enrichment

    out, rows = folder(spark), raw_items(spark, sf_dir)
    for _ in arriving(rows, f"{out}/in", 3):
        coming = spark.readStream.schema(rows.schema).parquet(f"{out}/in")
        enrichment.enrich_stream(coming, f"{out}/kept", f"{out}/checkpoint", match=entities.matcher(CALM_PHRASES)).awaitTermination()
    return enrichment.store(spark, f"{out}/kept").merged("tallies").select("entity", F.unix_timestamp("bucket_ts").alias("bucket"), "mentions")


@query(f"WITH RECURSIVE {FOLD}")
def stories_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """story_fold from three batches, each of which meets the stored vectors of its window only."""
    from undertow.operators.stories import StoryStore

    out, rows = folder(spark), vectors(spark, sf_dir)
    for _ in arriving(rows, f"{out}/in", 3):
        jobs.write_stories(spark.readStream.schema(rows.schema).parquet(f"{out}/in"), f"{out}/stories", f"{out}/checkpoint", THETA).awaitTermination()
    return shown_folds(StoryStore(spark, f"{out}/stories", THETA).stories())


@query(f"WITH {MENTIONS}, {MINUTES}, {SERIES} SELECT entity, round(velocity_z, 6) AS velocity_z FROM z")
def stream_velocity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """velocity_z of a stream that is stopped and started again for each of four batches, from summaries of runs of bins."""
    out, rows = folder(spark), mentions(spark, sf_dir).select("entity", "ts")
    for _ in arriving(rows, f"{out}/mentions", 4):
        arrived = spark.readStream.schema(rows.schema).parquet(f"{out}/mentions")
        velocity.write_velocity(arrived, f"{out}/velocity", f"{out}/checkpoint", HOUR, 16).awaitTermination()
    until = last_mention(spark, sf_dir) // HOUR * HOUR
    scored = velocity.VelocityState(spark, f"{out}/velocity", HOUR, 16).z(until - 240 * HOUR, until)
    return scored.select("entity", F.round("velocity_z", 6).alias("velocity_z"))


@query(ORACLE_SQL["primary_match"])
def stream_primary_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """primary_match of items that come in three batches, of which each holds items of all times, so most are late."""
    out = folder(spark)
    rows = items(spark, sf_dir).select("story_id", "id", "ts", "source_class", "entities", "lat", "lon")
    for batch in range(3):
        rows.where(F.floor(F.col("id") / 7) % 3 == batch).write.mode("append").parquet(f"{out}/items")
        arrived = spark.readStream.schema(rows.schema).parquet(f"{out}/items")
        matching.write_matches(arrived, f"{out}/matches", f"{out}/checkpoint").awaitTermination()
    return matching.MatchStore(spark, f"{out}/matches").matches()


@query(f"WITH {ITEMS} SELECT id, ts FROM items")
def inserted_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items in three batches, of which each brings again half of those before; the filter names what to look for."""
    from undertow.operators.once import OnceStore

    rows = items(spark, sf_dir).select("id", "ts", F.timestamp_seconds("ts").alias("ts_observed"), "source")
    store = OnceStore(spark, f"{folder(spark)}/items", ("id", "ts_observed"), "ts_observed", blocks=16)
    for batch in range(3):
        store.add(batch, rows.where((F.col("id") % 3 == batch) | (F.col("id") % 3 < batch) & (F.col("id") % 2 == 0)))
    return store.rows().select("id", "ts")
