"""Sources that fetch: a data source for polled and streamed feeds, with an injectable transport.

fetch(cursor) is named as module:function in the option transport; it returns (list of JSON strings, new
cursor). The cursor is the stream's offset, so a restart resumes where the last batch ended.
"""

from __future__ import annotations

import importlib
import json
import os
import re
import xml.etree.ElementTree as ET
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition, SimpleDataSourceStreamReader

#: The tags that are read.
WANTED = ("title", "link", "guid", "pubdate", "creator", "description")


def sse_events(lines: Iterable[str]) -> Iterator[tuple[str, dict]]:
    """(last event id, payload) of a server-sent event stream: an empty line dispatches, bad JSON is skipped."""
    last, data = "", []
    for line in lines:
        line = line.rstrip("\r\n")
        if not line:
            if data:
                try:
                    yield last, json.loads("\n".join(data))
                except ValueError:
                    pass
            data = []
        elif line.startswith("id:"):
            last = line[3:].strip()
        elif line.startswith("data:"):
            data.append(line[5:].strip())


def bare(node: ET.Element) -> str:
    """A tag without its namespace, in lower case."""
    return node.tag[node.tag.find("}") + 1 :].lower()


def rss_items(body: bytes, content_type: str = "application/xml") -> list[dict]:
    """Items of an RSS or entries of an Atom document as flat records, the first of each wanted tag; HTML is refused."""
    if not re.search("xml|rss", content_type.lower()):
        raise ValueError(f"not XML but {content_type}")
    if re.search(rb"<!doctype", body[:2048], re.I) or re.search(rb"<!entity", body, re.I):
        raise ValueError("document types and entities are refused")
    records = []
    for entry in filter(lambda node: bare(node) in ("item", "entry"), ET.fromstring(body).iter()):
        values = {bare(node): (node.text or node.get("href") or "").strip() for node in reversed(entry)}  # so the first of a tag is what stays
        records.append({name: values[name] for name in WANTED if name in values})
    return records


def json_items(body: bytes, path: str = "") -> list[dict]:
    found = json.loads(body)
    for key in filter(None, path.split(".")):
        found = (found or {}).get(key)
    return found or []


@dataclass(frozen=True)
class Feed:
    """How one feed is polled and read."""

    name: str
    url: str
    seconds: float
    path: str = ""
    kind: str = "json"
    source_class: str = "authoritative"
    max_age_days: int | None = None
    headers: dict = field(default_factory=dict)

    def configured(self) -> Feed:
        """With what the environment says of url, pace and user agent."""
        name = self.name.upper()
        agent = os.environ.get(f"{name}_USER_AGENT", f"Mozilla/5.0 (compatible; undertow/0.1; +ingest.{self.name})")
        return Feed(self.name, os.environ.get(f"{name}_FEED_URL", self.url), float(os.environ.get(f"{name}_POLL_SECONDS", self.seconds)), self.path, self.kind, self.source_class, self.max_age_days, {"User-Agent": agent} | self.headers)


# Public feeds, how often they are asked and where their records are.
FEEDS = {
    f.name: f
    for f in (
        Feed("usgs", "https://earthquake.usgs.gov/earthquakes/feed/v1.0/summary/all_hour.geojson", 60, "features"),
        Feed("noaa", "https://api.weather.gov/alerts/active", 120, "features", headers={"Accept": "application/geo+json"}),
        Feed("gdacs", "https://www.gdacs.org/gdacsapi/api/events/geteventlist/EVENTS4APP", 300, "features"),
        Feed("gdelt", "https://api.gdeltproject.org/api/v2/doc/doc?mode=artlist&format=json&maxrecords=250&sort=datedesc", 120, "articles", source_class="mainstream"),
        Feed("state", "https://www.state.gov/rss-feed/press-releases/feed/", 300, kind="rss"),
        Feed("dod", "https://www.defense.gov/DesktopModules/ArticleCS/RSS.ashx?max=20&ContentType=9", 300, kind="rss"),
        Feed("cisa", "https://www.cisa.gov/cybersecurity-advisories/all.xml", 300, kind="rss"),
        Feed("cdc", "https://tools.cdc.gov/api/v2/resources/media/132608.rss", 300, kind="rss", max_age_days=7),
    )
}


def poll_once(feed: Feed, fetch: Callable[[str, dict], tuple[bytes, str]], seen: dict, key: Callable[[dict], str], publish: Callable[[dict], object], most: int = 10_000) -> int:
    """Publish the records of one poll that were not seen, and count those; seen (insertion ordered) forgets its oldest beyond most.

    A record is remembered once it is handed on; one that publish finds unusable, and says so by returning False, is
    remembered too but does not count. If publish fails the record is not remembered, and comes again.
    """
    body, content_type = fetch(feed.url, feed.headers)
    n = 0
    for record in rss_items(body, content_type) if feed.kind == "rss" else json_items(body, feed.path):
        name = key(record)
        if name in seen:
            continue
        n += publish(record) is not False
        seen[name] = True
        while len(seen) > most:
            seen.pop(next(iter(seen)))
    return n


def gov_rss(name: str, url: str, source_class: str = "authoritative", seconds: float = 300, max_age_days: int | None = None) -> Feed:
    """A feed of press releases, with what the environment says of it."""
    return Feed(name, url, seconds, kind="rss", source_class=source_class, max_age_days=max_age_days).configured()


def _transport(options: dict) -> Callable[[str], tuple[list[str], str]]:
    module, _, name = options["transport"].partition(":")
    return getattr(importlib.import_module(module), name)


class FeedSource(DataSource):
    """format("undertow_feed").option("transport", "module:function"): rows (raw string), streamed or as one batch.

    Option log names a folder that outlives the driver. Each batch is written there before it is handed on and deleted
    once it is committed, so a restarted stream repeats the very rows of the batch that failed, which a live feed may
    no longer give. Without it the feed is asked again, as often as it was then.
    """

    @classmethod
    def name(cls) -> str:
        return "undertow_feed"

    def schema(self) -> str:
        return "raw string"

    def simpleStreamReader(self, schema) -> SimpleDataSourceStreamReader:
        return _Stream(self.options)

    def reader(self, schema) -> DataSourceReader:
        return _Batch(self.options)


class _Stream(SimpleDataSourceStreamReader):
    """Offsets are a cursor and the number of fetches that led to it."""

    def __init__(self, options: dict):
        self.options = options

    def _log(self):
        """The file system and folder of the option log."""
        from pyarrow import fs

        files, folder = fs.FileSystem.from_uri(self.options["log"])
        files.create_dir(folder, recursive=True)
        return files, folder

    def initialOffset(self) -> dict:
        return {"cursor": self.options.get("cursor", ""), "n": 0}

    def read(self, start: dict):
        rows, cursor = _transport(self.options)(start["cursor"])
        end = {"cursor": cursor, "n": start["n"] + bool(rows or cursor != start["cursor"])}
        if self.options.get("log") and end["n"] > start["n"]:
            files, folder = self._log()
            with files.open_output_stream(f"{folder}/{end['n']:012d}.json") as out:
                out.write(json.dumps(rows).encode())
        return iter([(r,) for r in rows]), end

    def readBetweenOffsets(self, start: dict, end: dict):
        rows, cursor = [], start["cursor"]
        for n in range(start["n"] + 1, end["n"] + 1):
            if self.options.get("log"):
                files, folder = self._log()
                with files.open_input_stream(f"{folder}/{n:012d}.json") as kept:
                    rows += json.loads(kept.read())
            else:
                more, cursor = _transport(self.options)(cursor)
                rows += more
        return iter([(r,) for r in rows])

    def commit(self, end: dict) -> None:
        if self.options.get("log"):
            from pyarrow import fs

            files, folder = self._log()
            for file in files.get_file_info(fs.FileSelector(folder)):
                if file.base_name.endswith(".json") and int(file.base_name[:-5]) <= end["n"]:
                    files.delete_file(file.path)


class _Batch(DataSourceReader):
    def __init__(self, options: dict):
        self.options = options

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(0)]

    def read(self, partition: InputPartition):
        rows, _ = _transport(self.options)(self.options.get("cursor", ""))
        yield from ((r,) for r in rows)
