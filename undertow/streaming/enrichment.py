"""Enrichment of a stream, item after item: dedup as keyed state that expires, and tallies and items in one commit."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from undertow.config import D
from undertow.functions.text import relevance
from undertow.functions.vector import hash_embedding
from undertow.operators.commits import CommitLog, Conflict
from undertow.operators.enrich import drained, finished, judged
from undertow.operators.parts import Parts
from undertow.operators.storage import dedup_key, summed_tallies
from undertow.streaming.jobs import LANES

#: Keyed state that expires needs this store; and, as time passes, it would ask for batches without rows for ever.
STATE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.noDataMicroBatches.enabled": "false",
}


class FirstSight(StatefulProcessor):
    """Of the rows of one key the first one, by order, is fresh, if none came in an earlier batch that is not forgotten.
    A group is a lane of keys: its state is their digests, 16 bytes each, and when each came."""

    def __init__(self, seconds: int):
        self.seconds = seconds

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getValueState("seen", "keys binary, at binary")

    def handleInputRows(self, key, rows, timerValues) -> Iterator:
        import numpy as np
        import pandas as pd

        now, known, gone = timerValues.getCurrentProcessingTimeInMs(), {}, False
        if self.seen.exists():
            keys, at = self.seen.get()
            came = np.frombuffer(bytes(at), "<i8").tolist()
            known = {bytes(keys[i * 16 : i * 16 + 16]): t for i, t in enumerate(came) if t + self.seconds * 1000 > now}
            gone = len(known) < len(came)
        first: dict = {}  # of each new key the first row met so far; all others are handed on at once
        for part in rows:
            again = []
            for digest, ts, i, payload in zip(part["digest"], part["place_ts"], part["place_id"], part["payload"], strict=True):
                digest = bytes.fromhex(digest)
                place = (pd.isna(ts), 0 if pd.isna(ts) else ts, pd.isna(i), 0 if pd.isna(i) else i)
                if digest in known:
                    again.append(payload)
                elif digest not in first:
                    first[digest] = place, payload
                elif place < first[digest][0]:
                    again.append(first[digest][1])
                    first[digest] = place, payload
                else:
                    again.append(payload)
            yield pd.DataFrame({"payload": pd.Series(again, dtype=object), "fresh": pd.Series([False] * len(again), dtype=bool)})
        if first or gone:
            known |= dict.fromkeys(first, now)
            self.seen.update((b"".join(known), np.array(list(known.values()), "<i8").tobytes()))
        if first:
            yield pd.DataFrame({"payload": [payload for _, payload in first.values()], "fresh": True})

    def close(self) -> None:
        pass


def sighted(items: DataFrame, seconds: int = D.retention_days * 86_400) -> DataFrame:
    """A stream's items (id, ts seconds, text, content_hash, ...) with fresh: whether it is the first of its key, which is
    content_hash, or the text where that is empty. Keys are state, dealt out into lanes by a hash, and expire seconds after
    they came. Copies within a batch wait for nothing: only the first of a key is held until its lane's rows are read."""
    rows = items.select(F.md5(F.coalesce(dedup_key(), F.lit("")).cast("binary")).alias("digest"), F.col("ts").cast("double").alias("place_ts"), F.col("id").cast("string").alias("place_id"), F.to_json(F.struct(*items.columns), {"ignoreNullFields": "false"}).alias("payload"))
    if items.schema["id"].dataType.typeName() in ("byte", "short", "integer", "long"):
        rows = rows.withColumn("place_id", F.get_json_object("payload", "$.id").cast("long"))
    rows = rows.withColumn("lane", F.pmod(F.xxhash64("digest"), F.lit(LANES)))
    found = rows.groupBy("lane").transformWithStateInPandas(FirstSight(seconds), "payload string, fresh boolean", "Append", "ProcessingTime")
    return found.select(F.from_json("payload", items.schema).alias("item"), "fresh").select("item.*", "fresh")


def scorer(spark: SparkSession, models: str | None, version: str | None) -> Callable[[Column], Column]:
    """Relevance of a text by a published model, or by the heuristic where there is none."""
    from undertow.operators.labels import predictor
    from undertow.operators.storage import model_of

    return relevance if models is None or version is None else predictor(model_of(spark, models, version)[0])


def pinned(spark: SparkSession, out: str, batch: int, models: str | None) -> str | None:
    """The model version of a batch: that of the moment when it is first taken, the same when it is taken again."""
    from undertow.operators.storage import model_version

    log = CommitLog(spark, f"{out}/plans")
    wanted = model_version(spark, models) if models else None
    try:
        log.put(batch, {"model": wanted})
        log.trim(100)
        return wanted
    except Conflict:
        return log.read(batch)["model"]


def store(spark: SparkSession, out: str) -> Parts:
    """What enrich_stream keeps in out: the tables tallies (entity, bucket_ts, mentions) and items."""
    return Parts(spark, out, {"tallies": summed_tallies})


def enrich_stream(
    items: DataFrame, out: str, checkpoint: str, match: Callable | None = None, tag: Callable | None = None, embed: Callable | None = None,
    models: str | None = None, admit: Callable[[DataFrame], DataFrame] | None = None, seconds: int = D.retention_days * 86_400, before_commit: Callable[[int], None] | None = None,
) -> StreamingQuery:
    """The stream form of enriched: reads what is there, batch by batch, and ends.

    Each micro-batch counts the mentions of all its items, copies too, and scores, tags and embeds those that are fresh, by
    the model that is published when the batch is taken first. admit takes id, ts, relevance and source_class of these and
    returns id and exploration of those that stay; all do without it. Tallies and items become visible in one commit, whose
    number is the batch's; the dedup state is that of the batch's own number, so a batch that failed anywhere is taken
    again with the same state and the same model, and adds its rows once.
    """
    spark = items.sparkSession

    def save(batch: DataFrame, number: int) -> None:
        session = batch.sparkSession
        table = store(session, out)
        if table.batch() >= number:
            return
        staged = f"staged/{number}"  # written first: what follows reads it several times, and no task holds keyed state beside it
        batch.write.mode("overwrite").parquet(f"{out}/{staged}")
        batch = session.read.parquet(f"{out}/{staged}")
        scored = judged(batch.where("fresh").drop("fresh"), scorer(session, models, pinned(session, out, number, models)))
        if admit is None:
            stays = scored.withColumn("exploration", F.lit(False))
        else:
            stays = scored.join(admit(scored.select("id", "ts", "relevance", "source_class")).select("id", "exploration"), "id")
        rows = {"items": finished(stays, match, tag, embed or hash_embedding())}
        if match is not None:
            rows["tallies"] = drained(batch, match).drop("replica")
        if before_commit is not None:
            before_commit(number)
        table.add(number, rows)
        table.log.delete(staged)

    fresh = sighted(items, seconds)
    old = {key: spark.conf.get(key) for key in STATE}
    for key, value in STATE.items():  # a query keeps what it was started with
        spark.conf.set(key, value)
    try:
        return fresh.writeStream.foreachBatch(save).outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    finally:
        for key, value in old.items():
            spark.conf.set(key, value)
