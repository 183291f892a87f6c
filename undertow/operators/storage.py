"""Tables of day partitions: idempotent inserts, upserts, retention, published models."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from undertow.config import D
from undertow.operators.commits import CommitLog, Conflict

KEYS = {
    "items": ("id", "ts_observed"),
    "stories": ("id", "first_seen"),
    "entity_tallies": ("entity", "bucket_ts", "replica"),
    "alerts": ("story_id", "ts"),
    "provenance_edges": ("story_id", "src_item", "dst_item", "edge_type", "ts_observed"),
    "system_state": ("key",),
    "assignments": ("item_id", "ts_observed"),
    "streams": ("name",),
}


def absent(rows: DataFrame, target: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Rows, one for each key, whose key target lacks: what an insert that does nothing on conflict adds."""
    return rows.dropDuplicates(list(keys)).join(target.select(*keys), list(keys), "left_anti")


def exploded_tallies(flushes: DataFrame) -> DataFrame:
    """entity, bucket_ts, replica, mentions of flushes; an empty flush adds none, two of one minute add up."""
    rows = flushes.select("bucket_ts", "replica", F.explode("counts").alias("entity", "mentions"))
    return rows.groupBy("entity", "bucket_ts", "replica").agg(F.sum("mentions").cast("int").alias("mentions"))


def summed_tallies(tallies: DataFrame) -> DataFrame:
    """Tallies (entity, bucket_ts, mentions) with the counts of one entity and minute added up."""
    return tallies.groupBy("entity", "bucket_ts").agg(F.sum("mentions").cast("int").alias("mentions"))


def upserted(current: DataFrame, rows: DataFrame, key: str = "key", order: str = "updated_at") -> DataFrame:
    """Last writer wins, by order; among equals the greatest value."""
    both = current.unionByName(rows)
    values = [c for c in current.columns if c != key]
    newest = both.groupBy(key).agg(F.max(F.struct(order, *[c for c in values if c != order])).alias("v"))
    return newest.select(key, *[F.col(f"v.{c}").alias(c) for c in values])


def retained(rows: DataFrame, today, day: str = "day", days: int = D.retention_days) -> DataFrame:
    """Rows of days not older than the wall; the day that is exactly days old stays."""
    return rows.where(F.col(day) >= F.date_sub(F.lit(today).cast("date"), days))


def append(rows: DataFrame, path: str, ts: str) -> None:
    """Append in a partition for each day; days that do not exist come into being."""
    rows.withColumn("day", F.to_date(ts)).write.mode("append").partitionBy("day").parquet(path)


def exists(spark: SparkSession, path: str) -> bool:
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop)


def insert_absent(rows: DataFrame, path: str, name: str, ts: str) -> None:
    """Append those rows whose key the table at path lacks. Of the table only the days at hand are read: days are
    joined, however many, and prune its partitions."""
    spark = rows.sparkSession
    if exists(spark, path):
        days = rows.select(F.to_date(ts).alias("day")).distinct()
        rows = absent(rows, spark.read.parquet(path).join(days, "day", "left_semi"), KEYS[name])
    else:
        rows = rows.dropDuplicates(list(KEYS[name]))
    append(rows, path, ts)


def has_snapshot(spark: SparkSession, folder: str) -> bool:
    return CommitLog(spark, folder).latest()[0] >= 0


def change_snapshot(spark: SparkSession, folder: str, change: Callable[[DataFrame | None], DataFrame], keep: int = 2) -> str:
    """Replace a whole table by what change makes of it (None before the first version): its rows are written as a version
    of their own, and a commit makes them the table. If another writer committed in between, change is asked again with
    that one's rows, so neither is lost. A writer that dies in between leaves the table as it was, and rows that drop_strays
    takes away. The last keep versions stay for those who still read them."""
    log = CommitLog(spark, folder)
    while True:
        number, state = log.latest()
        versions = state["versions"] if state else []
        rows = change(spark.read.parquet(f"{folder}/v={versions[-1]}") if versions else None)
        version = uuid.uuid4().hex
        rows.write.parquet(f"{folder}/v={version}")
        try:
            log.put(number + 1, {"versions": [*versions, version][-keep:]})
        except Conflict:
            log.delete(f"v={version}")
            continue
        for old in [*versions, version][:-keep]:
            log.delete(f"v={old}")
        log.trim()
        return version


def save_snapshot(rows: DataFrame, folder: str) -> str:
    """change_snapshot for rows that do not depend on those before, or whose writer is the only one."""
    return change_snapshot(rows.sparkSession, folder, lambda _: rows)


def snapshot(spark: SparkSession, folder: str) -> DataFrame:
    number, state = CommitLog(spark, folder).latest()
    if state is None:
        raise FileNotFoundError(f"no version of {folder}")
    return spark.read.parquet(f"{folder}/v={state['versions'][-1]}")


def drop_strays(spark: SparkSession, folder: str, seconds: int = 86_400) -> list[str]:
    """Delete versions that no commit names and that are older than seconds: what writers left that died."""
    log = CommitLog(spark, folder)
    root = log.hadoop.Path(folder)
    now, gone = spark._jvm.java.lang.System.currentTimeMillis(), []
    listed = [(status.getPath().getName(), status.getModificationTime()) for status in log.files.listStatus(root)]
    named = {f"v={version}" for number in log.numbers() for version in log.read(number)["versions"]}
    for name, at in listed:
        if name.startswith("v=") and name not in named and now - at >= seconds * 1000:
            log.delete(name)
            gone.append(name)
    return sorted(gone)


def updated(current: DataFrame, changes: DataFrame, key: str, columns: tuple[str, ...]) -> DataFrame:
    """current with columns taken from changes for the keys that those hold; other rows and columns stay."""
    new = changes.select(key, *[F.col(c).alias(f"new_{c}") for c in columns], F.lit(True).alias("new_row"))
    joined = current.join(new, key, "left")
    return joined.select(*[F.when(F.col("new_row"), F.col(f"new_{c}")).otherwise(F.col(c)).alias(c) if c in columns else F.col(c) for c in current.columns])


def trust_updated(stories: DataFrame, states: DataFrame) -> DataFrame:
    """stories with the origins and state that states (story_id, independent_origins, trust_state) give them."""
    return updated(stories, states, "story_id", ("independent_origins", "trust_state"))


def scores_updated(stories: DataFrame, scored: DataFrame) -> DataFrame:
    """stories with the four scores of a cycle."""
    return updated(stories, scored, "story_id", ("velocity_z", "mainstream_presence", "inauthenticity", "gap"))


def assignments(items: DataFrame, assigned: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows of the table assignments, those to try again): items are not changed in place but joined with these on read.

    assigned (item_id, story_id). Each row is annotated with the item's simhash and wire_ref; an item that is not there
    (yet) is handed back.
    """
    known = items.select(F.col("id").alias("item_id"), "ts_observed", "simhash", "wire_ref")
    return assigned.join(known, "item_id").select("item_id", "ts_observed", "story_id", "simhash", "wire_ref"), assigned.join(known, "item_id", "left_anti")


def edge_rows(edges: DataFrame) -> DataFrame:
    """Edges (story_id, src, dst, ts, edge_type) as rows of the table provenance_edges."""
    return edges.select("story_id", F.col("src").alias("src_item"), F.col("dst").alias("dst_item"), "edge_type", F.timestamp_seconds("ts").alias("ts_observed"))


def insert_edges(edges: DataFrame, path: str) -> None:
    insert_absent(edge_rows(edges), path, "provenance_edges", "ts_observed")


def declare(spark: SparkSession, folder: str, name: str, prefix: str, days: int = D.retention_days, cap: int = 65_536) -> DataFrame:
    """The settings of all declared streams, with this one created or brought up to date: how long its records stay, how
    long one may be, and the subjects it takes. settings() hands them to publishable and drop_old."""
    row = spark.createDataFrame([(name, prefix, days, cap)], "name string, prefix string, days int, cap int")
    change_snapshot(spark, folder, lambda rows: row if rows is None else rows.where(F.col("name") != name).unionByName(row))
    return snapshot(spark, folder)


def settings(spark: SparkSession, folder: str, name: str) -> dict:
    """prefix, days and cap of a declared stream; KeyError if it is none."""
    row = snapshot(spark, folder).where(F.col("name") == name).first()
    if row is None:
        raise KeyError(f"stream {name} is not declared in {folder}")
    return {k: row[k] for k in ("prefix", "days", "cap")}


def publish(rows: DataFrame, subject: str, streams: str, name: str) -> DataFrame:
    """publishable under the declared stream's prefix and cap."""
    own = settings(rows.sparkSession, streams, name)
    return publishable(rows, subject, own["prefix"], own["cap"])


def expire(spark: SparkSession, path: str, today: str, streams: str, name: str) -> list[str]:
    """drop_old with the days that the stream was declared with."""
    return drop_old(spark, path, today, settings(spark, streams, name)["days"])


def tally_state(flushes: DataFrame) -> DataFrame:
    """The newest health beat of each replica in flushes, as a row of system_state."""
    newest = flushes.groupBy("replica").agg(F.max_by(F.struct("sampling_active", "theta"), "flushed_at").alias("v"), F.max("flushed_at").alias("updated_at"))
    return newest.select(F.concat(F.lit("enrich:"), "replica").alias("key"), F.to_json("v").alias("value"), "updated_at")


def drop_old(spark: SparkSession, path: str, today: str, days: int = D.retention_days) -> list[str]:
    """Delete the folders of days behind the wall; the names of those deleted."""
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = root.getFileSystem(spark._jsc.hadoopConfiguration())
    wall = spark.sql(f"SELECT CAST(date_sub(DATE'{today}', {days}) AS STRING)").first()[0]
    gone = []
    for status in files.listStatus(root):
        name = status.getPath().getName()
        if name.startswith("day=") and name[4:] < wall:
            files.delete(status.getPath(), True)
            gone.append(name)
    return sorted(gone)


def publish_model(weights: DataFrame, folder: str, meta: str) -> str:
    """Write weights and their metadata as a new version, which a commit makes the current one."""
    spark, version = weights.sparkSession, uuid.uuid4().hex
    weights.write.parquet(f"{folder}/{version}/weights")
    spark.createDataFrame([(version, meta)], "version string, meta string").write.parquet(f"{folder}/{version}/meta")
    CommitLog(spark, folder).commit(lambda _: {"version": version})
    return version


def model_version(spark: SparkSession, folder: str) -> str | None:
    """The current model's version; None where no model was published."""
    state = CommitLog(spark, folder).latest()[1]
    return state["version"] if state else None


def model_of(spark: SparkSession, folder: str, version: str) -> tuple[DataFrame, str]:
    """Weights and metadata of a version."""
    return spark.read.parquet(f"{folder}/{version}/weights"), spark.read.parquet(f"{folder}/{version}/meta").first()["meta"]


def current_model(spark: SparkSession, folder: str) -> tuple[str, DataFrame, str]:
    version = model_version(spark, folder)
    if version is None:
        raise FileNotFoundError(f"no model in {folder}")
    return version, *model_of(spark, folder, version)


def publishable(rows: DataFrame, subject: str | F.Column, prefix: str, cap: int = 65_536) -> DataFrame:
    """rows as JSON payloads under a subject, or each under its own: refused outside prefix, and too long a payload fails the job."""
    if isinstance(subject, str):
        if not subject.startswith(prefix):
            raise PermissionError(f"{subject} is not under {prefix}")
        own = F.lit(subject)
    else:
        own = F.when(subject.startswith(prefix), subject).otherwise(F.raise_error(F.concat(F.coalesce(subject, F.lit("null")), F.lit(f" is not under {prefix}"))))
    payload = rows.select(own.alias("subject"), F.to_json(F.struct(*rows.columns)).alias("payload"))
    fits = F.when(F.octet_length("payload") <= cap, F.col("payload")).otherwise(F.raise_error(F.lit(f"payload over {cap} bytes")))
    return payload.select("subject", fits.alias("payload"))


def dedup_key() -> F.Column:
    """What makes two items copies: SHA-256 of the content_hash, or of the text where that is empty; null for neither."""
    return F.sha2(F.when(F.coalesce("content_hash", F.lit("")) != "", F.col("content_hash")).otherwise(F.col("text")).cast("binary"), 256)


def first_of_key(rows: DataFrame, order: list[str], key: F.Column | None = None) -> DataFrame:
    """Exact dedup: the first row of each content_hash, or of each text where that is empty.

    An aggregation and no window, so copies meet before the shuffle: a text that a third of all rows hold
    costs a row for each task.
    """
    own = F.sha2(key.cast("binary"), 256) if key is not None else dedup_key()
    first = F.min_by(F.struct(*rows.columns), F.struct(*order)).alias("first")
    return rows.groupBy(own.alias("dedup_key")).agg(first).select("first.*")
