"""Normalizers of the feeds, over raw records written from the tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from undertow.plans.adapters import START, table
from undertow.plans.catalog import query
from undertow.sources import feeds



def n() -> Column:
    return F.col("doc_id")


LAT, LON = "CAST(doc_id % 180 - 90 AS DOUBLE)", "CAST(doc_id % 360 - 180 AS DOUBLE)"
#: A time in ISO 8601, in UTC, on the first of January 2024.
CLOCK = "lpad(CAST(doc_id % 24 AS {0}), 2, '0') || ':' || lpad(CAST(doc_id % 60 AS {0}), 2, '0') || ':00'"
SECONDS = f"{START} + doc_id % 24 * 3600 + doc_id % 60 * 60"


def raw(spark: SparkSession, sf_dir: str, **fields: Column) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.to_json(F.struct(*[c.alias(k) for k, c in fields.items()])).alias("raw"))


def clock(suffix: str) -> Column:
    return F.concat(F.lit("2024-01-01T"), F.expr(CLOCK.format("STRING")), F.lit(suffix))


def lat() -> Column:
    return (n() % 180 - 90).cast("double")


def lon() -> Column:
    return (n() % 360 - 180).cast("double")


def when() -> Column:
    return F.unix_timestamp("ts_event").alias("ts")


@query(f"""SELECT 'us' || doc_id AS content_hash, CASE WHEN doc_id % 3 = 0 THEN 'M' || CAST(CAST(doc_id % 80 / 10.0 AS DOUBLE) AS VARCHAR) || ' - ' || source ELSE 'Quake ' || doc_id END AS text, {START} + doc_id * 60 AS ts, {LAT} AS lat, {LON} AS lon, source AS place FROM documents""")
def normalize_usgs(spark: SparkSession, sf_dir: str) -> DataFrame:
    title = F.when(n() % 3 != 0, F.concat(F.lit("Quake "), n().cast("string")))
    record = raw(
        spark, sf_dir, id=F.concat(F.lit("us"), n().cast("string")), geometry=F.struct(F.array(lon(), lat(), F.lit(10.0)).alias("coordinates")),
        properties=F.struct((n() % 80 / 10).alias("mag"), F.col("source").alias("place"), ((START + n() * 60) * 1000).alias("time"), title.alias("title")),
    )
    return feeds.usgs(record).select("content_hash", "text", when(), "geo.lat", "geo.lon", F.col("entities")[0]["text"].alias("place"))


@query(f"""SELECT 'urn:' || doc_id AS content_hash, CASE WHEN doc_id % 2 = 0 THEN 'Head ' || doc_id ELSE 'Flood - ' || source || '; ' || lang END AS text, {SECONDS} AS ts, {LAT} + 0.25 AS lat, {LON} + 0.5 AS lon, source || '|' || lang AS places, 'https://alerts/' || doc_id AS url FROM documents WHERE doc_id % 5 <> 0""")
def normalize_noaa(spark: SparkSession, sf_dir: str) -> DataFrame:
    ring = F.array(F.array(lon(), lat()), F.array(lon() + 1, lat()), F.array(lon() + 1, lat() + 1), F.array(lon(), lat()))
    record = raw(
        spark, sf_dir, id=F.concat(F.lit("https://alerts/"), n().cast("string")), geometry=F.struct(F.lit("Polygon").alias("type"), F.array(ring).alias("coordinates")),
        properties=F.struct(
            F.concat(F.lit("urn:"), n().cast("string")).alias("id"), F.lit("Flood").alias("event"), F.when(n() % 2 == 0, F.concat(F.lit("Head "), n().cast("string"))).alias("headline"),
            F.concat("source", F.lit("; "), "lang").alias("areaDesc"), F.when(n() % 3 == 0, clock("")).alias("onset"), clock("+00:00").alias("sent"), F.when(n() % 5 == 0, "Test").otherwise("Actual").alias("status"),
        ),
    )
    names = F.array_join(F.transform("entities", lambda e: e["text"]), "|").alias("places")
    return feeds.noaa(record).select("content_hash", "text", when(), "geo.lat", "geo.lon", names, F.col("urls")[0].alias("url"))


@query(f"""SELECT 'gdacs:EQ:' || doc_id AS content_hash, 'GDACS Green alert: ' || source AS text, {SECONDS} AS ts, {LAT} AS lat, len(['a', 'b']) AS n_places FROM documents WHERE doc_id % 4 <> 0""")
def normalize_gdacs(spark: SparkSession, sf_dir: str) -> DataFrame:
    record = raw(
        spark, sf_dir, geometry=F.struct(F.lit("Point").alias("type"), F.array(lon(), lat()).alias("coordinates")),
        properties=F.struct(F.lit("EQ").alias("eventtype"), F.when(n() % 4 != 0, n()).alias("eventid"), F.col("source").alias("name"), F.lit("Green").alias("alertlevel"), F.concat("lang", F.lit(", "), "source").alias("country"), clock("").alias("fromdate")),
    )
    return feeds.gdacs(record).select("content_hash", "text", when(), "geo.lat", F.size("entities").cast("long").alias("n_places"))


@query(f"""SELECT 'gdelt:' || substr(sha256('http://x/' || doc_id), 1, 40) AS content_hash, source AS text, CASE WHEN lang = 'en' THEN 'en' ELSE 'und' END AS lang, {SECONDS} AS ts, lang || '.org' AS author_ref FROM documents WHERE doc_id % 6 <> 0""")
def normalize_gdelt(spark: SparkSession, sf_dir: str) -> DataFrame:
    url = F.concat(F.when(n() % 6 == 0, "ftp").otherwise("http"), F.lit("://x/"), n().cast("string"))
    seen = F.concat(F.regexp_replace(clock(""), "[-:]", ""), F.lit("Z"))
    record = raw(spark, sf_dir, url=url, title=F.col("source"), seendate=seen, domain=F.concat("lang", F.lit(".org")), language=F.when(F.col("lang") == "en", "English").otherwise("Other"))
    return feeds.gdelt(record).select("content_hash", "text", "lang", when(), "author_ref")


@query(f"""SELECT 'g' || doc_id AS content_hash, source AS text, CASE WHEN doc_id % 3 = 0 THEN NULL ELSE {SECONDS} END AS ts, len(CASE WHEN doc_id % 2 = 0 THEN ['l'] ELSE [] END) AS n_urls FROM documents WHERE doc_id % 3 = 0 OR {SECONDS} >= {START} + 43200""")
def normalize_rss(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Releases of the last week as of noon of the eighth; undated ones stay."""
    dated = F.concat(F.lit("Mon, 01 Jan 2024 "), F.expr(CLOCK.format("STRING")), F.lit(" +0000"))
    record = raw(spark, sf_dir, title=F.concat(F.lit(" "), "source"), guid=F.concat(F.lit("g"), n().cast("string")), link=F.when(n() % 2 == 0, "https://x").otherwise("x"), pubdate=F.when(n() % 3 != 0, dated))
    now = F.timestamp_seconds(F.lit(START + 7 * 86_400 + 43_200))
    return feeds.rss(record, "cdc", max_age_days=7, now=now).select("content_hash", "text", when(), F.size("urls").cast("long").alias("n_urls"))


@query(f"""SELECT 'bsky:' || substr(sha256('at://did:' || source || '/app.bsky.feed.post/k' || doc_id), 1, 40) AS content_hash, 'post ' || doc_id AS text, substr(sha256('did:' || source), 1, 32) AS author_ref,
CASE WHEN doc_id % 2 = 0 THEN 'bsky:' || substr(sha256('at://p/' || doc_id), 1, 40) END AS parent_ref, {SECONDS} AS ts, 'https://a,https://b' AS urls FROM documents WHERE lang = 'en' AND doc_id % 7 <> 0""")
def normalize_bluesky(spark: SparkSession, sf_dir: str) -> DataFrame:
    uris = F.array(F.struct(F.array(*[F.struct(F.lit(u).alias("uri")) for u in ("https://a", "https://b", "https://a", "mailto:x")]).alias("features")))
    reply = F.when(n() % 2 == 0, F.struct(F.struct(F.concat(F.lit("at://p/"), n().cast("string")).alias("uri")).alias("parent")))
    post = F.struct(clock("Z").alias("createdAt"), F.array(F.concat("lang", F.lit("-XX"))).alias("langs"), F.concat(F.lit("post "), n().cast("string")).alias("text"), reply.alias("reply"), uris.alias("facets"))
    record = raw(
        spark, sf_dir, did=F.concat(F.lit("did:"), "source"), kind=F.lit("commit"),
        commit=F.struct(F.when(n() % 7 == 0, "delete").otherwise("create").alias("operation"), F.lit(feeds.POSTS).alias("collection"), F.concat(F.lit("k"), n().cast("string")).alias("rkey"), post.alias("record")),
    )
    return feeds.bluesky(record).select("content_hash", "text", "author_ref", "parent_ref", when(), F.array_join("urls", ",").alias("urls"))


@query(f"""SELECT 'masto:' || substr(sha256('u/' || doc_id), 1, 40) AS content_hash, 'a & b’s café — x €' || chr(10) || source AS text, substr(sha256('inst:' || doc_id), 1, 32) AS author_ref, {SECONDS} AS ts FROM documents WHERE lang = 'en' AND doc_id % 2 = 0 AND doc_id % 5 <> 0""")
def normalize_mastodon(spark: SparkSession, sf_dir: str) -> DataFrame:
    record = raw(
        spark, sf_dir, id=n().cast("string"), created_at=clock("Z"), language=F.col("lang"), uri=F.concat(F.lit("u/"), n().cast("string")), visibility=F.when(n() % 2 == 0, "public").otherwise("private"),
        content=F.concat(F.lit("<p>a &amp; b&#8217;s caf&eacute; &mdash; x &#x20ac;</p><b>"), "source", F.lit("</b>")), account=F.struct(n().cast("string").alias("id"), (n() % 5 == 0).alias("bot")),
    )
    return feeds.mastodon(record, "inst").select("content_hash", "text", "author_ref", when())


@query(f"""SELECT 'wiki:en.wikipedia.org:' || (doc_id + 1) AS content_hash, CASE WHEN doc_id % 2 = 0 THEN source || ' — note' ELSE source END AS text, substr(sha256('en.wikipedia.org:' || lang), 1, 32) AS author_ref, 'en' AS lang, {SECONDS} AS ts FROM documents WHERE doc_id % 3 <> 0 AND doc_id % 4 <> 0""")
def normalize_wikipedia(spark: SparkSession, sf_dir: str) -> DataFrame:
    record = raw(
        spark, sf_dir, meta=F.struct(F.lit("https://w").alias("uri"), F.lit("en.wikipedia.org").alias("domain"), clock("Z").alias("dt")), type=F.lit("edit"), namespace=F.when(n() % 3 == 0, 1).otherwise(0),
        title=F.col("source"), comment=F.when(n() % 2 == 0, "note"), user=F.col("lang"), bot=F.when(n() % 4 != 0, False), revision=F.struct((n() + 1).alias("new")), server_name=F.lit("en.wikipedia.org"),
    )
    return feeds.wikipedia(record).select("content_hash", "text", "author_ref", "lang", when())
