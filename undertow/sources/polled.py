"""The polled feeds as transports and streams: each is asked at its pace and gives the records that were not seen.

A transport's cursor holds short digests of the last records seen, oldest first, so a restart repeats none of them.
"""

from __future__ import annotations

import hashlib
import json
import logging
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql.streaming import DataStreamReader

from undertow.sources import feeds
from undertow.sources.live import opened
from undertow.sources.poll import FEEDS, Feed, FeedSource, poll_once

SEEN = 10_000


def record_key(feed: Feed, record: dict) -> str:
    """What names a record in its present revision; as feeds.revision_key, on a parsed record."""
    p = record.get("properties") or {}
    named = {
        "usgs": lambda: (record.get("id"), p.get("updated")),
        "noaa": lambda: (p.get("id"), p.get("sent")),
        "gdacs": lambda: tuple(p.get(c) for c in ("eventtype", "eventid", "episodeid", "datemodified")),
        "gdelt": lambda: (record.get("url"),),
    }.get(feed.name, lambda: (record.get("guid") or record.get("link"),))
    return hashlib.sha256(json.dumps(named()).encode()).hexdigest()[:16]


def transport(name: str, open_: Callable = opened, most: int = SEEN) -> Callable[[str], tuple[list[str], str]]:
    """fetch(cursor) of a feed: new records as JSON strings. A poll that fails gives none and keeps the cursor."""

    def asked(url: str, headers: dict) -> tuple[bytes, str]:
        with open_(url, headers) as answer:
            return answer.read(), answer.headers.get("Content-Type", "") if hasattr(answer, "headers") else "application/xml"

    def fetch(cursor: str) -> tuple[list[str], str]:
        feed, out = FEEDS[name].configured(), []
        seen = dict.fromkeys(json.loads(cursor or "[]"), True)
        try:
            poll_once(feed, asked, seen, lambda r: record_key(feed, r), lambda r: out.append(json.dumps(r)), most)
        except (OSError, ValueError) as failed:
            logging.getLogger("undertow.sources").warning("%s: %s", name, failed)
            return [], cursor
        return out, json.dumps(list(seen))

    return fetch


usgs, noaa, gdacs, gdelt, state, dod, cisa, cdc = map(transport, FEEDS)


def normalized(raw: DataFrame, name: str, now: Column | None = None) -> DataFrame:
    """Items of a feed's raw records: its own normalizer, or that of press releases under its name, class and age."""
    feed = FEEDS[name].configured()
    if feed.kind == "rss":
        return feeds.rss(raw, name, feed.source_class, feed.max_age_days, now)
    return getattr(feeds, name)(raw)


def reader(spark: SparkSession, name: str, log: str | None = None) -> DataStreamReader:
    """A stream of a feed's raw records. Give its writer the trigger pace(name)."""
    spark.dataSource.register(FeedSource)
    found = spark.readStream.format(FeedSource.name()).option("transport", f"{__name__}:{name}")
    return found.option("log", log) if log else found


def pace(name: str) -> dict:
    return {"processingTime": f"{FEEDS[name].configured().seconds:g} seconds"}


def items(spark: SparkSession, name: str, log: str | None = None) -> DataFrame:
    """A feed as a stream of items."""
    return normalized(reader(spark, name, log).load(), name)
