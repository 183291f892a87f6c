"""Tallies, series, velocity and rank."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from undertow.config import D
from undertow.functions import series as S
from undertow.operators import scoring, serving, tallies
from undertow.plans.adapters import LAST, MENTIONS, MINUTES, last_mention, mentions, seconds, table
from undertow.plans.catalog import query

HOUR = 3600
#: Ten days of hours before the last mention, as a dense series for each entity.
SERIES = f"""bins AS (SELECT entity, bucket // {HOUR} * {HOUR} AS bin, CAST(sum(mentions) AS DOUBLE) AS n FROM minutes WHERE bucket > {LAST} // {HOUR} * {HOUR} - 240 * {HOUR} GROUP BY ALL),
grid AS (SELECT entity, unnest(range({LAST} // {HOUR} * {HOUR} - 240 * {HOUR}, {LAST} // {HOUR} * {HOUR} + 1, {HOUR})) AS bin FROM (SELECT DISTINCT entity FROM bins)),
dense AS (SELECT entity, bin, coalesce(n, 0.0) AS n FROM grid LEFT JOIN bins USING (entity, bin)),
series AS (SELECT entity, list(n ORDER BY bin) AS s FROM dense GROUP BY entity),
smooth AS (SELECT entity, list_transform(range(1, len(s) + 1), lambda i: list_reduce(s[1:i], lambda a, x: 0.3 * x + 0.7 * a)) AS e FROM series),
accel AS (SELECT entity, list_transform(range(3, len(e) + 1), lambda i: e[i] - 2 * e[i - 1] + e[i - 2]) AS a FROM smooth),
z AS (SELECT entity, CASE WHEN list_stddev_pop(a[1:-2]) < 1e-9 THEN CASE WHEN abs(a[-1]) < 1e-9 THEN 0.0 ELSE 10.0 END
      ELSE (a[-1] - list_avg(a[1:-2])) / list_stddev_pop(a[1:-2]) END AS velocity_z FROM accel)"""


def hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    until = last_mention(spark, sf_dir) // HOUR * HOUR
    since = until - 240 * HOUR
    return tallies.series(tallies.binned(tallies.minute_tallies(mentions(spark, sf_dir)), since, HOUR), since, until, HOUR)


@query(f"WITH {MENTIONS} SELECT lower(entity) AS entity, ts // 60 * 60 AS bucket, count(*) AS mentions FROM mentions GROUP BY ALL")
def tally_minute(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tallies.minute_tallies(mentions(spark, sf_dir))


@query(f"WITH {MENTIONS}, d AS (SELECT lower(entity) AS entity, ts // 86400 * 86400 AS bucket, count(*) AS mentions FROM mentions GROUP BY ALL) SELECT * EXCLUDE place FROM (SELECT *, row_number() OVER (PARTITION BY bucket ORDER BY mentions DESC, entity) AS place FROM d) WHERE place <= 3")
def tally_topn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tallies.hottest(tallies.minute_tallies(mentions(spark, sf_dir), 86_400), 3).drop("place")


@query(f"WITH {MENTIONS}, {MINUTES} SELECT entity, bucket // 300 * 300 AS bin, CAST(sum(mentions) AS DOUBLE) AS n FROM minutes WHERE bucket > {LAST} - {D.baseline_s} GROUP BY ALL")
def mention_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tallies.binned(tallies.minute_tallies(mentions(spark, sf_dir)), last_mention(spark, sf_dir) - D.baseline_s, D.bin_s)


@query(f"WITH {MENTIONS}, {MINUTES} SELECT bucket // 900 * 900 AS bin, CAST(sum(mentions) AS DOUBLE) AS n FROM minutes WHERE entity IN ('click', 'view', 'purchase') AND bucket > {LAST} - 86400 GROUP BY ALL")
def velocity_spark(spark: SparkSession, sf_dir: str) -> DataFrame:
    return serving.velocity_series(tallies.minute_tallies(mentions(spark, sf_dir)), ["click", "view", "purchase"], last_mention(spark, sf_dir))


@query(f"WITH {MENTIONS}, {MINUTES} SELECT min(bucket) AS earliest, coalesce({LAST} - min(bucket) < {D.warm_s}, true) AS warming FROM minutes WHERE bucket > {LAST} - {D.baseline_s}")
def earliest_bucket(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.warming(tallies.minute_tallies(mentions(spark, sf_dir)), last_mention(spark, sf_dir)).select("earliest", "warming")


@query(f"WITH {MENTIONS}, {MINUTES}, {SERIES} SELECT entity, bin, n FROM dense")
def fill_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    until = last_mention(spark, sf_dir) // HOUR * HOUR
    since = until - 240 * HOUR
    return tallies.dense(tallies.binned(tallies.minute_tallies(mentions(spark, sf_dir)), since, HOUR), since, until, HOUR)


@query(f"WITH {MENTIONS}, {MINUTES}, {SERIES} SELECT entity, unnest(range(len(e))) AS at, round(unnest(e), 6) AS value FROM smooth")
def ewma(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hourly(spark, sf_dir).select("entity", F.posexplode(S.ewma(F.col("series"))).alias("at", "value")).select("entity", F.col("at").cast("long").alias("at"), F.round("value", 6).alias("value"))


@query(f"WITH {MENTIONS}, {MINUTES}, {SERIES} SELECT entity, unnest(range(len(a))) AS at, round(unnest(a), 6) AS value FROM accel")
def acceleration(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = hourly(spark, sf_dir).select("entity", F.posexplode(S.acceleration(S.ewma(F.col("series")))).alias("at", "value"))
    return rows.select("entity", F.col("at").cast("long").alias("at"), F.round("value", 6).alias("value"))


@query(f"WITH {MENTIONS}, {MINUTES}, {SERIES} SELECT entity, round(velocity_z, 6) AS velocity_z FROM z")
def velocity_z(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hourly(spark, sf_dir).select("entity", F.round(S.z_of_last(S.acceleration(S.ewma(F.col("series")))), 6).alias("velocity_z"))


@query(f"""WITH {MENTIONS}, {MINUTES}, {SERIES} SELECT entity, round(greatest(0.0, velocity_z) * (1 - 0.25) * 0.7 * (1 - 0.1), 6) AS gap FROM z ORDER BY gap DESC, entity LIMIT 50""")
def gap_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entities by gap, under a fixed presence, state and inauthenticity."""
    z = S.z_of_last(S.acceleration(S.ewma(F.col("series"))))
    gap = S.gap_score(z, F.lit(0.25), S.corroboration_weight(F.lit("corroborated")), F.lit(0.1))
    return hourly(spark, sf_dir).select("entity", F.round(gap, 6).alias("gap")).orderBy(F.desc("gap"), "entity").limit(50)


@query("""WITH s AS (SELECT user_id, ts, lag(ts) OVER w AS b, lead(ts) OVER w AS a FROM (SELECT user_id, event_id, CAST(floor(epoch(ts)) AS BIGINT) AS ts FROM events) WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
SELECT user_id AS story_id, count(*) AS social_items, count(*) FILTER (WHERE coalesce(ts - b <= 3600, false) OR coalesce(a - ts <= 3600, false)) AS synced_items FROM s GROUP BY user_id""")
def sync_lag_lead(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select(F.col("user_id").alias("story_id"), F.col("event_id").alias("id"), seconds(F.col("ts")).alias("ts"), F.lit("social").alias("source_class"))
    return scoring.synchronised(rows, 3600)


@query(f"WITH {MENTIONS} SELECT entity, ts // 300 * 300 AS bin, ts // 900 * 900 AS quarter, count(*) AS n FROM mentions GROUP BY ALL")
def bin_floor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mentions(spark, sf_dir).groupBy("entity", S.bin_start(F.col("ts"), 300).alias("bin"), S.bin_start(F.col("ts"), 900).alias("quarter")).agg(F.count("*").alias("n"))


@query("""WITH f AS (SELECT event_type AS entity, CAST(floor(epoch(ts)) AS BIGINT) // 60 * 60 AS bucket_ts, 'r' || (user_id % 3) AS replica, count(*) AS mentions FROM events GROUP BY ALL)
SELECT f.entity, f.bucket_ts, f.replica, f.mentions FROM f WHERE NOT (f.replica = 'r0' AND f.bucket_ts % 120 = 0)""")
def tallies_if_absent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What an insert of all tallies adds to a table that holds some."""
    from undertow.operators import storage

    rows = table(spark, sf_dir, "events").select(F.col("event_type").alias("entity"), S.bin_start(seconds(F.col("ts")), 60).alias("bucket_ts"), F.concat(F.lit("r"), (F.col("user_id") % 3).cast("string")).alias("replica"))
    counted = rows.groupBy("entity", "bucket_ts", "replica").agg(F.count("*").alias("mentions"))
    there = counted.where("replica = 'r0' AND bucket_ts % 120 = 0")
    return storage.absent(counted, there, storage.KEYS["entity_tallies"])


@query("""WITH s AS (SELECT 'u' || (user_id % 40) AS key, CAST(event_id AS VARCHAR) AS value, event_id AS updated_at FROM events)
SELECT key, arg_max(value, updated_at) AS value, max(updated_at) AS updated_at FROM s GROUP BY key""")
def upsert_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    from undertow.operators import storage

    rows = table(spark, sf_dir, "events").select(F.concat(F.lit("u"), (F.col("user_id") % 40).cast("string")).alias("key"), F.col("event_id").cast("string").alias("value"), F.col("event_id").alias("updated_at"))
    return storage.upserted(rows.where("updated_at % 2 = 0"), rows.where("updated_at % 2 = 1"))


@query("SELECT event_id, CAST(CAST(ts AS DATE) AS VARCHAR) AS day FROM events WHERE CAST(ts AS DATE) >= (SELECT max(CAST(ts AS DATE)) FROM events) - 5")
def retention(spark: SparkSession, sf_dir: str) -> DataFrame:
    from undertow.operators import storage

    rows = table(spark, sf_dir, "events").select("event_id", F.to_date("ts").alias("day"))
    today = rows.agg(F.max("day").cast("string")).first()[0]
    return storage.retained(rows, today).select("event_id", F.col("day").cast("string").alias("day"))


@query("""WITH c AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL), m AS (SELECT user_id, event_type, n FROM c)
SELECT user_id, count(*) <= 4096 AND min(n) >= 0 AND user_id % 100 / 100.0 BETWEEN 0 AND 1 AS valid, CAST(sum(n) AS BIGINT) AS mentions FROM m GROUP BY user_id""")
def tally_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    from undertow.schemas import valid_tally

    counts = table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.count("*").cast("int").alias("n"))
    flush = counts.groupBy("user_id").agg(F.map_from_entries(F.collect_list(F.struct("event_type", "n"))).alias("counts")).withColumn("theta", F.col("user_id") % 100 / 100)
    total = F.aggregate(F.map_values("counts"), F.lit(0).cast("long"), lambda acc, x: acc + x)
    return flush.select("user_id", valid_tally().alias("valid"), total.alias("mentions"))

