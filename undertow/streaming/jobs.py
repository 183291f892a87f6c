"""Streaming queries. State is bounded by a watermark of the retention wall; sinks are idempotent."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from undertow.config import D
from undertow.operators.admission import Governor
from undertow.operators.admission import State as Held
from undertow.operators.parts import Parts
from undertow.operators.storage import insert_absent

WALL = f"{D.retention_days} days"
#: Groups that keys are dealt to where their order is free. State lies by them, so they follow no setting.
LANES = 1024


def validated(raw: DataFrame, ddl: str, valid, cap: int = 65_536) -> tuple[DataFrame, DataFrame]:
    """(records, dead letters) of a stream with a column raw. Every payload is in one of them: those too long, unreadable
    or invalid are set aside with the reason."""
    from undertow.schemas import strict_json

    rows = strict_json(raw, "raw", ddl)
    # the condition speaks of the record's fields, so it is put where these are columns
    judged = rows.select("raw", "well_formed", "record", "record.*").withColumn("fine", F.coalesce(valid, F.lit(False)))
    reason = F.when(F.octet_length("raw") > cap, "too long").when(F.coalesce(F.col("well_formed") & F.col("record").isNotNull(), F.lit(False)) == F.lit(False), "unreadable").when(~F.col("fine"), "invalid")
    judged = judged.select("raw", "record", reason.alias("reason"))
    return judged.where("reason IS NULL").select("record.*"), judged.where("reason IS NOT NULL").select("raw", "reason")


def bounded(reader, files: int = 8, size: str | None = None):
    """Backpressure: a reader of files that hands on at most so many, or about so much, in a micro-batch; the rest waits where it is."""
    return reader.option("maxBytesPerTrigger", size) if size else reader.option("maxFilesPerTrigger", files)


def redelivered(start: Callable[[], StreamingQuery], attempts: int = 5, seconds: float = 1.0) -> StreamingQuery:
    """Run a query that ends by itself, and start it again, a moment later, if it fails: from its checkpoint it takes the
    same batch anew. What fails for good is raised after so many attempts."""
    import time

    for left in range(attempts - 1, -1, -1):
        try:
            query = start()
            query.awaitTermination()
            return query
        except Exception:
            if not left:
                raise
            time.sleep(seconds)
    raise ValueError("attempts must be 1 at least")


class Progress(StreamingQueryListener):
    """Keeps the newest progress of each query, for health pages: rows in, rows a second, state rows."""

    def __init__(self):
        self.newest: dict[str, dict] = {}

    def onQueryStarted(self, event) -> None:
        self.newest[str(event.id)] = {"running": True}

    def onQueryProgress(self, event) -> None:
        p = event.progress
        self.newest[str(p.id)] = {"running": True, "batch": p.batchId, "rows": p.numInputRows, "rate": p.processedRowsPerSecond, "state_rows": sum(s.numRowsTotal for s in p.stateOperators)}

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self.newest[str(event.id)] = self.newest.get(str(event.id), {}) | {"running": False}


def deduplicated(items: DataFrame, ts: str = "ts_observed") -> DataFrame:
    """First sight of each content_hash, or of each text where that is empty, within the wall (event time)."""
    key = F.sha2(F.when(F.coalesce("content_hash", F.lit("")) != "", F.col("content_hash")).otherwise(F.col("text")).cast("binary"), 256)
    return items.withColumn("dedup_key", key).withWatermark(ts, WALL).dropDuplicatesWithinWatermark(["dedup_key"]).drop("dedup_key")


def fifo_deduplicated(items: DataFrame, order: tuple[str, ...] = ("ts", "id"), most: int | None = 50_000, lanes: int | None = None) -> DataFrame:
    """Rows of a stream whose key (content_hash, or the text where that is empty) is not among the last most new ones.

    As FifoDeduper, as state: keys leave in the order in which they came, and a hit does not renew a key's place. Each
    of lanes, by a hash of the key, remembers its share; one lane, as without lanes, keeps the order of all. A batch is
    taken by order. With most None no key leaves, so the order of different keys does not matter and lanes change no
    result: there are LANES of them, and each holds its keys and the first row of each new one.
    """
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    from undertow.operators.seen import FifoDeduper

    lanes = lanes or (LANES if most is None else 1)

    def step(key: tuple, batches: Iterator, state: GroupState) -> Iterator:
        import pandas as pd

        held = state.get[0] if state.exists else b""
        keys = dict.fromkeys(held[i : i + 16] for i in range(0, len(held), 16))
        if most is None:
            first = None
            for part in batches:
                part = part[[bytes.fromhex(k) not in keys for k in part["dedup_key"]]]
                first = pd.concat([x for x in (first, part) if x is not None]).sort_values(list(order), kind="stable").drop_duplicates("dedup_key")
            state.update((held + b"".join(bytes.fromhex(k) for k in first["dedup_key"]),))
            yield first[columns]
            return
        known = FifoDeduper(max(1, most // lanes))
        known.keys = keys
        rows = pd.concat(list(batches)).sort_values(list(order), kind="stable")
        fresh = [not known.seen(bytes.fromhex(k)) for k in rows["dedup_key"]]
        state.update((b"".join(known.keys),))
        yield rows.loc[fresh, columns]

    columns = items.columns
    name = F.md5(F.when(F.coalesce("content_hash", F.lit("")) != "", F.col("content_hash")).otherwise(F.coalesce("text", F.lit(""))).cast("binary"))
    keyed = items.withColumn("dedup_key", name).withColumn("lane", F.pmod(F.xxhash64("dedup_key"), F.lit(lanes)))
    return keyed.groupBy("lane").applyInPandasWithState(step, items.schema, "held binary", "append", GroupStateTimeout.NoTimeout)


def matches_in_time(claims: DataFrame, official: DataFrame, seconds: int = D.match_s) -> DataFrame:
    """story_id, claim, id of a stream of claims and one of official items that share an entity within seconds.

    claims (story_id, id, ts timestamp, entities), official (id, ts timestamp, entities). An interval join: each side is
    kept as long as the other may still bring a partner, and no longer.
    """
    names = lambda rows: F.explode(F.array_distinct(F.transform("entities", F.lower)))
    a = claims.select("story_id", F.col("id").alias("claim"), F.col("ts").alias("claimed"), names(claims).alias("said")).withWatermark("claimed", WALL)
    b = official.select("id", F.col("ts").alias("recorded"), names(official).alias("named")).withWatermark("recorded", WALL)
    near = F.expr(f"said = named AND recorded BETWEEN claimed - INTERVAL {seconds} SECONDS AND claimed + INTERVAL {seconds} SECONDS")
    return a.join(b, near).select("story_id", "claim", "id", "said")


def tallied(mentions: DataFrame, minutes: int = 1) -> DataFrame:
    """entity, bucket_ts, mentions of a stream (entity, ts timestamp) in tumbling windows; late rows fall behind the wall."""
    windows = mentions.withWatermark("ts", WALL).groupBy(F.window("ts", f"{minutes} minutes"), F.lower("entity").alias("entity"))
    return windows.agg(F.count("*").alias("mentions")).select("entity", F.col("window.start").alias("bucket_ts"), "mentions")


def tally_parts(spark: SparkSession, path: str, fan: int = 8, since=None) -> Parts:
    """The table that write_tallies keeps: merges leave the newest count of each window, and of windows from since on only."""

    def merge(rows: DataFrame) -> DataFrame:
        kept = rows if since is None else rows.where(F.col("bucket_ts") >= F.lit(since))
        return kept.groupBy("entity", "bucket_ts").agg(F.max_by("mentions", "batch").alias("mentions"), F.max("batch").alias("batch"))

    return Parts(spark, path, {"tallies": merge}, fan)


def write_tallies(mentions: DataFrame, path: str, checkpoint: str, fan: int = 8, since=None) -> StreamingQuery:
    """Keep path at the newest counts: each batch's updated windows are a part of tally_parts, which a repeated batch adds
    once, and parts are merged as they grow many. newest_tallies() reads the last count of each window."""

    def save(batch: DataFrame, number: int) -> None:
        tally_parts(batch.sparkSession, path, fan, since).add(number, {"tallies": batch.withColumn("batch", F.lit(number).cast("long"))})

    return tallied(mentions).writeStream.outputMode("update").foreachBatch(save).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def newest_tallies(spark: SparkSession, path: str) -> DataFrame:
    return tally_parts(spark, path).merged("tallies").drop("batch")


def write_stories(items: DataFrame, path: str, checkpoint: str, theta: float = D.theta, before_commit: Callable[[int], None] | None = None) -> StreamingQuery:
    """Cluster a stream of items (id, ts seconds, embedding, entities, source) batch by batch into the StoryStore at path."""
    from undertow.operators.stories import StoryStore

    def save(batch: DataFrame, number: int) -> None:
        StoryStore(batch.sparkSession, path, theta).add(number, batch, None if before_commit is None else lambda: before_commit(number))

    return items.writeStream.foreachBatch(save).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def governed(items: DataFrame) -> DataFrame:
    """id, admitted, theta of a stream (id, ts seconds, relevance, source_class): the controller as state of one key."""
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    def step(key: tuple, batches: Iterator, state: GroupState) -> Iterator:
        import pandas as pd

        governor = Governor()
        if state.exists:
            theta, rate, last = state.get
            governor.state = Held(theta, rate, None if last < 0 else last)
        rows = pd.concat(list(batches)).sort_values(["ts", "id"], kind="stable")
        out = [(r.id, governor.admit(r.relevance, r.source_class, r.ts), governor.theta) for r in rows.itertuples(index=False)]
        state.update((governor.theta, governor.rate, -1.0 if governor.state.last is None else governor.state.last))
        yield pd.DataFrame(out, columns=["id", "admitted", "theta"])

    keyed = items.select(F.lit(0).alias("one"), F.col("id").cast("long").alias("id"), F.col("ts").cast("double").alias("ts"), F.col("relevance").cast("double").alias("relevance"), "source_class")
    return keyed.groupBy("one").applyInPandasWithState(step, "id long, admitted boolean, theta double", "theta double, rate double, last double", "append", GroupStateTimeout.NoTimeout)


def write_items(enriched: DataFrame, path: str, checkpoint: str, then: Callable[[DataFrame], None] | None = None) -> StreamingQuery:
    """Insert items that are absent, then hand the same batch on (to clustering): one query, so the order holds."""

    def save(batch: DataFrame, number: int) -> None:
        batch.persist()
        insert_absent(batch, path, "items", "ts_observed")
        if then:
            then(batch)
        batch.unpersist()

    return enriched.writeStream.foreachBatch(save).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def write_tally_flushes(flushes: DataFrame, tallies: str, state: str, checkpoint: str) -> StreamingQuery:
    """Insert the tallies of a stream of flushes and keep each replica's newest health beat in the state's snapshot."""
    from undertow.operators import storage

    def save(batch: DataFrame, number: int) -> None:
        batch.persist()
        storage.insert_absent(storage.exploded_tallies(batch), tallies, "entity_tallies", "bucket_ts")
        beats = storage.tally_state(batch)
        storage.change_snapshot(batch.sparkSession, state, lambda rows: beats if rows is None else storage.upserted(rows, beats))
        batch.unpersist()

    return flushes.writeStream.foreachBatch(save).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def pushed(alerts: DataFrame, push: Callable[[str, str], None], checkpoint: str) -> StreamingQuery:
    """Push each alert of a stream (entity_set, gap, velocity_z, trust_state) once its batch is planned; a failed
    push fails the batch, which is tried again."""
    from undertow.operators.serving import push_message

    def save(batch: DataFrame, number: int) -> None:
        title, body = push_message()
        for row in batch.select(title.alias("t"), body.alias("b")).toLocalIterator():
            push(row["t"], row["b"])

    return alerts.writeStream.foreachBatch(save).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
