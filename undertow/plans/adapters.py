"""The supplied tables seen as the engine's own, and the same in SQL.

documents are items, of five classes in turn, a minute apart; events are mentions of their event_type; 97
stories deal out the items. Times are seconds since the epoch.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from undertow.schemas import SOURCE_CLASSES, TRUST_STATES

START = 1_704_067_200
STORIES = 97


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def seconds(ts: Column) -> Column:
    """Seconds since the epoch of a timestamp without zone, whatever the session's zone."""
    day = F.datediff(F.to_date(ts), F.lit("1970-01-01").cast("date")).cast("long")
    return day * 86_400 + F.hour(ts) * 3600 + F.minute(ts) * 60 + F.second(ts)


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, n = table(spark, sf_dir, "documents"), F.col("doc_id")
    return d.select(
        n.alias("id"), "text", "lang", "source", F.get(F.array(*map(F.lit, SOURCE_CLASSES)), (n % 5).cast("int")).alias("source_class"), (START + n * 60).alias("ts"),
        F.when(n % 7 == 0, "").otherwise(F.concat(F.lit("a"), (n % STORIES % 12 * 4 + F.floor(n / STORIES) % 4).cast("string"))).alias("author_ref"),
        F.when((n % 4 == 0) & (n >= STORIES), F.concat(F.lit("h"), (n - STORIES).cast("string"))).otherwise("").alias("parent_ref"),
        F.concat(F.lit("h"), n.cast("string")).alias("content_hash"),
        F.when(n % STORIES % 3 == 0, F.array(F.concat(F.lit("u"), (F.floor(n / STORIES) % 5).cast("string")))).otherwise(F.array().cast("array<string>")).alias("urls"),
        F.array("source", "lang").alias("entities"), (n % STORIES).alias("story_id"), (n % 50 == 0).alias("exploration"),
        (n % 180 - 90).cast("double").alias("lat"), (n % 360 - 180).cast("double").alias("lon"),
    )


ITEMS = f"""items AS (
  SELECT doc_id AS id, text, lang, source, (['social', 'authoritative', 'primary', 'mainstream', 'local_news'])[CAST(doc_id % 5 AS INTEGER) + 1] AS source_class,
         {START} + doc_id * 60 AS ts, CASE WHEN doc_id % 7 = 0 THEN '' ELSE 'a' || (doc_id % {STORIES} % 12 * 4 + doc_id // {STORIES} % 4) END AS author_ref,
         CASE WHEN doc_id % 4 = 0 AND doc_id >= {STORIES} THEN 'h' || (doc_id - {STORIES}) ELSE '' END AS parent_ref, 'h' || doc_id AS content_hash,
         CASE WHEN doc_id % {STORIES} % 3 = 0 THEN ['u' || (doc_id // {STORIES} % 5)] ELSE [] END AS urls, [source, lang] AS entities,
         doc_id % {STORIES} AS story_id, doc_id % 50 = 0 AS exploration, CAST(doc_id % 180 - 90 AS DOUBLE) AS lat, CAST(doc_id % 360 - 180 AS DOUBLE) AS lon
  FROM documents)"""


def stories(spark: SparkSession, sf_dir: str, told: DataFrame | None = None) -> DataFrame:
    """Stories of told (items of sf_dir, unless given)."""
    s = F.col("story_id")
    names = F.array_sort(F.array_distinct(F.flatten(F.collect_set("entities"))))
    rows = (items(spark, sf_dir) if told is None else told).groupBy("story_id").agg(F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"), names.alias("entity_set"), F.array_sort(F.collect_set("source")).alias("source_set"))
    return rows.select(
        "*", F.get(F.array(*map(F.lit, TRUST_STATES)), (s % 3).cast("int")).alias("trust_state"), ((s % 10) / 10).alias("inauthenticity"), ((s * 7 % 50) / 10).alias("gap"),
        ((s * 3 % 40) / 10 - 1).alias("velocity_z"), (s % 6).alias("independent_origins"),
    )


STORY_ROWS = """stories AS (
  SELECT story_id, min(ts) AS first_seen, max(ts) AS last_seen, list_sort(list_distinct(flatten(list(entities)))) AS entity_set, list_sort(list(DISTINCT source)) AS source_set,
         (['rumor', 'corroborated', 'primary_backed'])[CAST(story_id % 3 AS INTEGER) + 1] AS trust_state, (story_id % 10) / 10.0::DOUBLE AS inauthenticity,
         (story_id * 7 % 50) / 10.0::DOUBLE AS gap, (story_id * 3 % 40) / 10.0::DOUBLE - 1 AS velocity_z, story_id % 6 AS independent_origins
  FROM items GROUP BY story_id)"""


def alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stories(spark, sf_dir).where("story_id % 4 = 0").select("story_id", (F.col("last_seen") - F.col("story_id") * 600).alias("ts"), "gap", "velocity_z", "trust_state")


ALERTS = "alerts AS (SELECT story_id, last_seen - story_id * 600 AS ts, gap, velocity_z, trust_state FROM stories WHERE story_id % 4 = 0)"


def latest(spark: SparkSession, sf_dir: str) -> int:
    """Now: the time of the newest item."""
    return START + 60 * (table(spark, sf_dir, "documents").agg(F.max("doc_id")).first()[0] or 0)


NOW = "(SELECT max(ts) FROM items)"


def mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(F.col("event_type").alias("entity"), seconds(F.col("ts")).alias("ts"), "user_id")


MENTIONS = "mentions AS (SELECT event_type AS entity, CAST(floor(epoch(ts)) AS BIGINT) AS ts, user_id FROM events)"
MINUTES = "minutes AS (SELECT lower(entity) AS entity, ts // 60 * 60 AS bucket, count(*) AS mentions FROM mentions GROUP BY ALL)"


def last_mention(spark: SparkSession, sf_dir: str) -> int:
    return table(spark, sf_dir, "events").agg(F.max(seconds(F.col("ts")))).first()[0] or 0


LAST = "(SELECT max(ts) FROM mentions)"


def copied_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """items with simhash, of which those of one simhash are in one story, that of the first; written once, without texts."""
    from undertow.functions.text import simhash_md5, word_tokens
    from undertow.operators.graph import frozen

    rows = frozen(items(spark, sf_dir).withColumn("simhash", simhash_md5(word_tokens(F.col("text")))).drop("text"))
    first = rows.where("simhash <> 0").groupBy("simhash").agg(F.min("id").alias("first"))
    return frozen(rows.join(first, "simhash", "left").withColumn("story_id", F.coalesce("first", "id") % STORIES).drop("first"))


def links(rows: DataFrame) -> DataFrame:
    """What connects copied_items beside shared_keys(copies=True): references, and simhashes near each other."""
    from undertow.operators import provenance

    return provenance.ref_links(rows).union(provenance.story_copies(rows)[1].select("story_id", "src", "dst"))


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    from undertow.operators import provenance

    rows = items(spark, sf_dir)
    return provenance.ref_edges(rows).union(provenance.url_edges(rows)).union(provenance.author_edges(rows))


EDGES = """pairs AS (
  SELECT x.story_id, x.id AS x, y.id AS y, 'ref' AS edge_type FROM items x JOIN items y ON x.story_id = y.story_id AND x.parent_ref = y.content_hash WHERE x.parent_ref <> '' AND x.id <> y.id
  UNION SELECT x.story_id, x.id, y.id, 'author' FROM items x JOIN items y ON x.story_id = y.story_id AND x.author_ref = y.author_ref WHERE x.author_ref <> '' AND x.id > y.id
  UNION SELECT x.story_id, x.id, y.id, 'url' FROM items x JOIN items y ON x.story_id = y.story_id AND x.urls[1] = y.urls[1] WHERE x.id > y.id),
edges AS (SELECT DISTINCT story_id, greatest(x, y) AS src, least(x, y) AS dst, edge_type FROM pairs)"""

#: Word bigrams, hashed by 64 bits of md5, 64 votes each.
SIMHASH = r"""t AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}_]+') AS w FROM documents),
g AS (SELECT doc_id, unnest(CASE WHEN len(w) >= 2 THEN list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) ELSE w END) AS s FROM t),
h AS (SELECT doc_id, CAST(('0x' || substr(md5(s), 1, 16)) AS UBIGINT) AS h FROM g),
b AS (SELECT doc_id, bit, sum(CASE WHEN (h >> bit) & 1 = 1 THEN 1 ELSE -1 END) AS v FROM h, (SELECT CAST(unnest(range(64)) AS UBIGINT) AS bit) GROUP BY ALL),
f AS (SELECT doc_id, CAST(sum(CASE WHEN v > 0 THEN CAST(1 AS HUGEINT) << CAST(bit AS HUGEINT) ELSE CAST(0 AS HUGEINT) END) AS UBIGINT) AS u FROM b GROUP BY doc_id),
sim AS (SELECT d.doc_id, coalesce(u, 0) AS u FROM documents d LEFT JOIN f USING (doc_id))"""
#: items as copied_items has them, and all pairs of them with an edge, copies included.
COPIED_ITEMS = f"""{SIMHASH}, {ITEMS.replace("items AS (", "dealt AS (", 1)}, items AS (
  SELECT * REPLACE (CASE WHEN u = 0 THEN id ELSE least_id END % {STORIES} AS story_id) FROM (SELECT dealt.*, u, min(id) OVER (PARTITION BY u) AS least_id FROM dealt JOIN sim ON sim.doc_id = dealt.id))"""
COPIED_EDGES = EDGES.replace("),\nedges AS", """
  UNION SELECT x.story_id, x.id, y.id, 'copy' FROM items x JOIN items y ON x.story_id = y.story_id AND x.id > y.id WHERE x.u <> 0 AND y.u <> 0 AND bit_count(xor(x.u, y.u)) <= 6),
edges AS""")
