"""Normalizers, sources and streams."""

from __future__ import annotations

import datetime
import json

import pytest
from pyspark.sql import functions as F

from undertow.sources import feeds, poll
from undertow.streaming import jobs


def raw(spark, *records):
    return spark.createDataFrame([(r if isinstance(r, str) else json.dumps(r),) for r in records], "raw string")


def rows(df):
    return [r.asDict(recursive=True) for r in df.collect()]


def test_usgs(spark):
    good = {"id": "us1", "geometry": {"coordinates": [10.0, 20.0, 5.0]}, "properties": {"mag": 4.5, "place": "Rome", "time": 1704067200000, "url": "https://x"}}
    bare = {"id": "us2", "geometry": {"coordinates": [999.0, 0.0]}, "properties": {"place": "Oslo"}}
    got = rows(feeds.usgs(raw(spark, good, bare, {"id": "us3", "properties": {"mag": 1.0}}, "no json")))
    assert [r["text"] for r in got] == ["M4.5 - Rome", "Oslo"] and got[0]["geo"]["lat"] == 20.0 and got[1]["geo"] is None
    assert got[0]["entities"][0]["text"] == "Rome" and got[0]["ts_event"] is not None and got[0]["source_class"] == "authoritative"


def test_noaa(spark):
    base = {"id": "https://a/1", "properties": {"id": "urn:1", "event": "Flood", "areaDesc": "A; B ;", "status": "Actual", "onset": "2024-01-01T00:00:00", "sent": "2024-01-02T00:00:00+00:00"}}
    test = json.loads(json.dumps(base))
    test["properties"]["status"] = "Test"
    wrong = json.loads(json.dumps(base)) | {"geometry": {"type": "Polygon", "coordinates": "x"}}
    got = rows(feeds.noaa(raw(spark, base, test, wrong)))
    assert len(got) >= 1 and got[0]["text"] == "Flood - A; B ;" and [e["text"] for e in got[0]["entities"]] == ["A", "B"]
    assert got[0]["urls"] == ["https://a/1"] and got[0]["ts_event"] is not None and got[0]["geo"] is None


def test_bluesky(spark):
    def post(**more):
        record = {"text": "hi", "langs": ["en-US"], "createdAt": "2024-01-01T00:00:00Z"} | more
        return {"did": "d", "kind": "commit", "commit": {"operation": "create", "collection": feeds.POSTS, "rkey": "k", "record": record}}

    got = rows(feeds.bluesky(raw(spark, post(), post(langs=["fr"]), post(text="  "), post(langs=None), post(reply={"parent": {"uri": "at://d/app.bsky.feed.post/k"}}))))
    assert len(got) == 2 and got[0]["lang"] == "en-us" and got[0]["parent_ref"] is None
    assert got[1]["parent_ref"] == got[0]["content_hash"]


def test_mastodon_and_wikipedia(spark):
    status = {"uri": "u", "visibility": "public", "language": "en", "content": "<p>it&#8217;s caf&eacute;</p>", "account": {"id": "1", "bot": False}}
    got = rows(feeds.mastodon(raw(spark, status, status | {"reblog": {"id": "1"}}, status | {"account": {"id": "1", "bot": True}}, status | {"content": "<p></p>"}), "inst"))
    assert len(got) == 1 and got[0]["text"] == "it’s café"
    change = {"meta": {"domain": "en.wikipedia.org", "id": "m"}, "type": "edit", "namespace": 0, "title": "T", "bot": False, "server_name": "en.wikipedia.org"}
    got = rows(feeds.wikipedia(raw(spark, change, change | {"bot": None}, change | {"type": "log"}, change | {"title": ""})))
    assert [(r["content_hash"], r["lang"], r["text"]) for r in got] == [("wiki:en.wikipedia.org:m", "en", "T")]


@pytest.mark.parametrize(("date", "want"), [("Sat, 11 Jul 26 13:09:35 +0000", 1783775375), ("11 Jul 2026 13:09:35 GMT", 1783775375), ("11 Jul 2026 09:09:35 -0400", 1783775375), ("11 Jul 2026 09:09:35 EDT", 1783775375), ("Sat, 11 Jul 2026 13:09:35", None), ("soon", None), (None, None)])
def test_mail_dates(spark, date, want):
    got = feeds.rss(raw(spark, {"title": "t", "guid": "g", "pubdate": date}), "dod").select(F.unix_timestamp("ts_event")).first()[0]
    assert got == want


def test_framing_and_documents():
    lines = ["id: 7", "data: {\"a\": 1}", "", "data: not json", "", ": comment", "id: 8", "data: {\"a\":", "data: 2}", ""]
    assert list(poll.sse_events(lines)) == [("7", {"a": 1}), ("8", {"a": 2})]
    body = b'<rss xmlns:dc="http://d"><channel><item><title>a</title><title>b</title><guid>g</guid><dc:creator>c</dc:creator><other>x</other></item></channel></rss>'
    assert poll.rss_items(body) == [{"title": "a", "guid": "g", "creator": "c"}]
    with pytest.raises(ValueError, match="not XML"):
        poll.rss_items(b"<html>", "text/html")
    assert poll.json_items(b'{"features": [1]}', "features") == [1] and poll.json_items(b"{}", "features") == []


def test_polling_remembers_what_it_published():
    feed, seen, out = poll.FEEDS["usgs"], {}, []
    fetch = lambda url, headers: (b'{"features": [{"id": 1}, {"id": 2}, {"id": 1}]}', "application/json")
    assert poll.poll_once(feed, fetch, seen, lambda r: str(r["id"]), out.append) == 2
    assert poll.poll_once(feed, fetch, seen, lambda r: str(r["id"]), out.append, most=1) == 0 and len(out) == 2
    assert poll.poll_once(feed, fetch, {}, lambda r: str(r["id"]), lambda r: False) == 0


def test_feed_source(spark, tmp_path):
    spark.dataSource.register(poll.FeedSource)
    options = {"transport": "undertow.sources.samples:numbered"}
    assert spark.read.format("undertow_feed").options(**options).load().count() == 3
    stream = spark.readStream.format("undertow_feed").options(**options).load()
    query = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "ck")).start()
    query.processAllAvailable()
    query.stop()
    assert sorted(json.loads(r["raw"])["n"] for r in spark.read.parquet(str(tmp_path / "out")).collect()) == list(range(6))


def test_streamed_dedup_survives_a_restart(spark, tmp_path):
    source, out, checkpoint = (str(tmp_path / n) for n in ("in", "out", "ck"))
    frame = lambda *texts: spark.createDataFrame([(t, "") for t in texts], "text string, content_hash string").withColumn("ts_observed", F.lit("2024-01-01").cast("timestamp"))

    def run():
        stream = spark.readStream.schema(frame("x").schema).parquet(source)
        jobs.deduplicated(stream).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
        return sorted(r["text"] for r in spark.read.parquet(out).collect())

    frame("a", "b", "a").write.mode("append").parquet(source)
    assert run() == ["a", "b"]
    frame("b", "c").write.mode("append").parquet(source)
    assert run() == ["a", "b", "c"]


def test_streamed_governor_equals_the_replay(spark, tmp_path):
    from undertow.operators.admission import Governor

    data = [(i, i * 0.01, (i * 37 % 100) / 100, "social") for i in range(200)]
    spark.createDataFrame(data, "id long, ts double, relevance double, source_class string").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("id long, ts double, relevance double, source_class string").parquet(str(tmp_path / "in"))
    jobs.governed(stream).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start().awaitTermination()
    governor = Governor()
    want = [(i, governor.admit(r, c, t)) for i, t, r, c in data]
    assert sorted((r["id"], r["admitted"]) for r in spark.read.parquet(str(tmp_path / "out")).collect()) == want


def test_validated_stream_sets_bad_payloads_aside(spark):
    records, dead = jobs.validated(raw(spark, {"a": 1}, {"a": 1, "b": 2}, "x" * 70_000, {"a": -1}, {"a": None}), "a int", F.col("a") >= 0)
    assert [r["a"] for r in records.collect()] == [1]
    assert sorted(r["reason"] for r in dead.collect()) == ["invalid", "invalid", "too long", "unreadable"]


def test_a_failed_batch_is_repeated_as_it_was(spark, tmp_path):
    """The live feed gives other rows when it is asked again; the log gives those of the batch that failed."""
    spark.dataSource.register(poll.FeedSource)
    out, state = str(tmp_path / "out"), str(tmp_path / "asked")
    seen: list = []

    def run(fail: bool):
        def save(batch, number):
            rows_ = sorted(json.loads(r["raw"])["asked"] for r in batch.collect())
            seen.append((number, rows_))
            if fail and number == 1:
                raise RuntimeError("killed")
            batch.write.mode("append").parquet(out)

        reader = spark.readStream.format("undertow_feed").option("transport", "undertow.sources.samples:counted").option("cursor", state).option("log", f"file://{tmp_path}/log")
        return reader.load().writeStream.foreachBatch(save).option("checkpointLocation", str(tmp_path / "ck")).start()

    first = run(True)
    with pytest.raises(Exception, match="killed"):
        first.awaitTermination(60)
        first.processAllAvailable()
    second = run(False)
    second.processAllAvailable()
    second.stop()
    batches = [r for n, r in seen if n == 1]
    assert len(batches) == 2 and batches[0] == batches[1]
    got = sorted(json.loads(r["raw"])["asked"] for r in spark.read.parquet(out).collect())
    assert got == sorted(set(got)) and len(got) == 6


def test_recovery_without_a_log_ends():
    reader = poll._Stream({"transport": "undertow.sources.samples:numbered"})
    start, ends = reader.initialOffset(), []
    for _ in range(3):
        ends.append(reader.read(ends[-1] if ends else start)[1])
    assert [e["n"] for e in ends] == [1, 2, 2]
    assert len(list(reader.readBetweenOffsets(start, {"cursor": "never met", "n": 2}))) == 6


def test_streamed_fifo_dedup_equals_the_plain_one(spark, tmp_path):
    from undertow.operators.seen import FifoDeduper

    texts = [t for t in "aabacabddcaebfa"]
    plain, ddl = FifoDeduper(3), "id long, ts long, text string, content_hash string"
    want = [i for i, t in enumerate(texts) if not plain.seen(t)]
    out, got = str(tmp_path / "out"), None
    for part in (range(0, 6), range(6, 15)):
        spark.createDataFrame([(i, i, texts[i], "") for i in part], ddl).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(ddl).parquet(str(tmp_path / "in"))
        jobs.fifo_deduplicated(stream, most=3).writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start().awaitTermination()
        got = sorted(r["id"] for r in spark.read.parquet(out).collect())
    assert got == want


def test_streams_meet_within_a_day(spark, tmp_path):
    day = lambda d, h=0: datetime.datetime(2024, 1, d, h)
    claims = [(1, 10, day(2), ["Rome"]), (1, 11, day(5), ["rome"]), (2, 12, day(2), ["Oslo"])]
    official = [(20, day(2, 23), ["ROME", "x"]), (21, day(4), ["rome"]), (22, day(9), ["oslo"])]
    spark.createDataFrame(claims, "story_id int, id int, ts timestamp, entities array<string>").write.parquet(str(tmp_path / "a"))
    spark.createDataFrame(official, "id int, ts timestamp, entities array<string>").write.parquet(str(tmp_path / "b"))
    a, b = (spark.readStream.schema(spark.read.parquet(str(tmp_path / n)).schema).parquet(str(tmp_path / n)) for n in "ab")
    jobs.matches_in_time(a, b).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start().awaitTermination()
    assert sorted((r["claim"], r["id"]) for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [(10, 20), (11, 21)]


def test_a_failed_query_is_started_again():
    class Query:
        def awaitTermination(self):
            pass

    tries = []

    def start():
        tries.append(1)
        if len(tries) < 3:
            raise RuntimeError("down")
        return Query()

    assert isinstance(jobs.redelivered(start, 3, 0.0), Query) and len(tries) == 3
    with pytest.raises(RuntimeError):
        jobs.redelivered(lambda: (_ for _ in ()).throw(RuntimeError("down")), 2, 0.0)


def test_polled_feeds(spark):
    from undertow.sources import polled

    bodies = {
        "usgs": json.dumps({"features": [{"id": "a", "geometry": {"coordinates": [1.0, 2.0]}, "properties": {"title": "Quake", "updated": 1}}]}).encode(),
        "gdelt": json.dumps({"articles": [{"url": "https://x/1", "title": "News", "seendate": "20240101T000000Z", "domain": "x", "language": "English"}]}).encode(),
        "cdc": b"<rss><channel><item><title>New</title><guid>g1</guid><pubDate>Mon, 08 Jan 2024 00:00:00 +0000</pubDate></item><item><title>Old</title><guid>g2</guid><pubDate>Mon, 01 Jan 2023 00:00:00 +0000</pubDate></item></channel></rss>",
    }
    now = F.lit("2024-01-09").cast("timestamp")
    for name, body in bodies.items():
        fetch = polled.transport(name, lambda url, headers, body=body: Answer(body))
        out, cursor = fetch("")
        assert out and fetch(cursor) == ([], cursor)
        items = polled.normalized(raw(spark, *out), name, now).collect()
        assert [(r["text"], r["source"], r["source_class"]) for r in items] == [{"usgs": ("Quake", "usgs", "authoritative"), "gdelt": ("News", "gdelt", "mainstream"), "cdc": ("New", "cdc", "authoritative")}[name]]

    def down(url, headers):
        raise OSError

    assert polled.transport("noaa", down)("[]") == ([], "[]")
    assert all(callable(getattr(polled, name)) for name in poll.FEEDS) and polled.pace("usgs") == {"processingTime": "60 seconds"}
    assert polled.reader(spark, "usgs").load().isStreaming


def test_revisions_come_again():
    from undertow.sources import polled

    feed = poll.FEEDS["usgs"]
    keys = {polled.record_key(feed, {"id": "a", "properties": {"updated": u}}) for u in (1, 1, 2)}
    assert len(keys) == 2


def test_flushes_become_tallies_and_a_beat(spark, tmp_path):
    ddl = "bucket_ts timestamp, counts map<string,int>, sampling_active boolean, theta double, replica string, flushed_at timestamp"
    t = lambda s: datetime.datetime(2024, 1, 1, 0, 0, s)
    data = [(t(0), {"a": 2}, False, 0.0, "r1", t(1)), (t(0), {"a": 1, "b": 1}, True, 0.5, "r1", t(2)), (t(0), {}, False, 0.0, "r2", t(1))]
    spark.createDataFrame(data, ddl).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(ddl).parquet(str(tmp_path / "in"))
    for _ in range(2):
        jobs.write_tally_flushes(jobs.bounded(spark.readStream.schema(ddl), 1).parquet(str(tmp_path / "in")) if _ else stream, str(tmp_path / "tallies"), str(tmp_path / "state"), str(tmp_path / f"ck{_}")).awaitTermination()
    from undertow.operators import storage

    assert sorted((r["entity"], r["mentions"]) for r in spark.read.parquet(str(tmp_path / "tallies")).collect()) == [("a", 3), ("b", 1)]
    assert {r["key"]: json.loads(r["value"])["sampling_active"] for r in storage.snapshot(spark, str(tmp_path / "state")).collect()} == {"enrich:r1": True, "enrich:r2": False}


class Answer:
    def __init__(self, body):
        self.body = body

    def __enter__(self):
        return self

    def __exit__(self, *_):
        return False

    def read(self):
        return self.body

    def __iter__(self):
        return iter(self.body.splitlines(keepends=True))


def test_live_cursors():
    from undertow.sources import live

    asked = []

    def pages(url, headers):
        asked.append(url)
        if "bad" in url:
            raise OSError
        return Answer(b'[{"id": "9"}, {"id": "8"}]' if "since_id" not in url else b"[]")

    out, cursor = live.mastodon_page("", ["a.org", "bad.org"], pages)
    assert [json.loads(r)["id"] for r in out] == ["8", "9"] and json.loads(cursor) == {"a.org": "9"}
    assert live.mastodon_page(cursor, ["a.org"], pages) == ([], cursor) and asked[-1].endswith("since_id=9")
    wrong = lambda url, headers: Answer(b'{"error": "x"}' if "bad" in url else b'[{"id": "3"}]')
    assert json.loads(live.mastodon_page("", ["bad.org", "a.org"], wrong)[1]) == {"a.org": "3"}
    assert len(live.mastodon_page("", open_=lambda url, headers: asked.append(url) or Answer(b"[]"))[0]) == 0 and "fosstodon" in asked[-1]
    out, cursor = live.wikipedia_changes("", 1, lambda u, h: Answer(b'id: 5\ndata: {"a": 1}\n\nid: 6\ndata: {"a": 2}\n\n'))
    assert (out, cursor) == (['{"a": 1}'], "5")
    out, cursor = live.bluesky_posts("3", 9, lambda url: ['{"time_us": 4}', "no json", '{"time_us": 7}'])
    assert len(out) == 2 and cursor == "7"
    closed = []

    def socket(url):
        try:
            yield from ('{"time_us": 1}', '{"time_us": 2}')
        finally:
            closed.append(url)

    assert live.bluesky_posts("", 1, socket)[1] == "1" and closed


def test_seen_keys_leave_in_order():
    from undertow.operators.seen import FifoDeduper

    keys = FifoDeduper(2)
    assert [keys.seen(k) for k in "aabacab"] == [False, True, False, True, False, False, False]
