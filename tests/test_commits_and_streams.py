"""Commits, parts, enrichment and clustering of streams: writers that die or race, batches that are taken again."""

from __future__ import annotations

import json
import random

import pytest
from pyspark.sql import functions as F

from undertow.operators import enrich, entities, stories, storage
from undertow.operators.commits import CommitLog, Conflict
from undertow.operators.parts import Parts
from undertow.schemas import ENTITY, GEO
from undertow.streaming import enrichment, jobs


def rows_of(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)


def test_of_two_writers_of_a_number_one_wins(spark, tmp_path):
    log, other = CommitLog(spark, str(tmp_path)), CommitLog(spark, str(tmp_path))
    assert log.latest() == (-1, None)
    log.put(0, {"by": "one"})
    with pytest.raises(Conflict):
        other.put(0, {"by": "two"})
    assert other.latest() == (0, {"by": "one"})
    first = iter([True])

    def change(state):
        if next(first, False):
            other.put(1, {"by": "two", "sum": 5})  # another writer is faster
        return {"by": "one", "sum": state.get("sum", 0) + 1}

    assert log.commit(change) == (2, {"by": "one", "sum": 6})
    assert not [p for p in (tmp_path / "_commits").iterdir() if p.name.startswith(".") and not p.name.endswith(".crc")]


def test_a_writer_that_dies_leaves_the_table_as_it_was(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "t")
    storage.save_snapshot(spark.range(3), path)
    with monkeypatch.context() as m:
        m.setattr(CommitLog, "put", lambda *_: (_ for _ in ()).throw(OSError("killed")))
        with pytest.raises(OSError):
            storage.change_snapshot(spark, path, lambda rows: rows.union(rows))
    assert storage.snapshot(spark, path).count() == 3
    assert len(storage.drop_strays(spark, path, 0)) == 1 and storage.drop_strays(spark, path, 0) == []
    assert storage.snapshot(spark, path).count() == 3
    with pytest.raises(FileNotFoundError):
        storage.snapshot(spark, str(tmp_path / "none"))


def test_two_writers_of_a_snapshot_lose_nothing(spark, tmp_path):
    path = str(tmp_path / "t")
    storage.save_snapshot(spark.createDataFrame([("a", 1, 1)], "key string, value int, updated_at int"), path)
    beat = lambda key: spark.createDataFrame([(key, 2, 2)], "key string, value int, updated_at int")
    raced = iter([True])

    def change(rows):
        if next(raced, False):
            storage.change_snapshot(spark, path, lambda now: storage.upserted(now, beat("b")))
        return storage.upserted(rows, beat("c"))

    storage.change_snapshot(spark, path, change)
    assert [r[0] for r in rows_of(storage.snapshot(spark, path), "key")] == ["a", "b", "c"]


def test_models_are_swapped_by_commits(spark, tmp_path):
    path = str(tmp_path / "m")
    weights = lambda w: spark.createDataFrame([(0, w)], "idx int, weight double")
    assert storage.model_version(spark, path) is None
    one = storage.publish_model(weights(1.0), path, "{}")
    two = storage.publish_model(weights(2.0), path, json.dumps({"n": 2}))
    version, got, meta = storage.current_model(spark, path)
    assert (version, got.first()["weight"], meta) == (two, 2.0, '{"n": 2}') and storage.model_of(spark, path, one)[0].first()["weight"] == 1.0


def test_declared_settings_hold_writers_and_retention(spark, tmp_path):
    streams, path = str(tmp_path / "streams"), str(tmp_path / "t")
    storage.declare(spark, streams, "raw", "ingest.", days=1, cap=30)
    assert storage.settings(spark, streams, "raw") == {"prefix": "ingest.", "days": 1, "cap": 30}
    rows = spark.createDataFrame([("x" * 5, "2024-01-01"), ("x" * 5, "2024-01-05")], "text string, at string").withColumn("at", F.col("at").cast("timestamp"))
    assert storage.publish(rows.select("text"), "ingest.a", streams, "raw").count() == 2
    with pytest.raises(PermissionError):
        storage.publish(rows.select("text"), "other.a", streams, "raw")
    with pytest.raises(Exception, match="over 30 bytes"):
        storage.publish(rows.select(F.repeat("text", 9).alias("text")), "ingest.a", streams, "raw").collect()
    storage.append(rows, path, "at")
    assert storage.expire(spark, path, "2024-01-06", streams, "raw") == ["day=2024-01-01"]
    with pytest.raises(KeyError):
        storage.settings(spark, streams, "none")


def test_parts_stay_few_and_add_a_batch_once(spark, tmp_path):
    parts = Parts(spark, str(tmp_path), {"sums": lambda df: df.groupBy("k").agg(F.sum("n").alias("n"))}, fan=3)
    assert parts.read("sums") is None and parts.batch() == -1
    for n in range(13):
        rows = {"sums": spark.createDataFrame([(n % 2, 1)], "k long, n long").coalesce(1)}
        assert parts.add(n, rows) and not parts.add(n, rows)
        assert len(parts.paths("sums")) <= 6
        assert parts.merged("sums").agg(F.sum("n")).first()[0] == n + 1
    assert [p["level"] for p in parts.state()[1]["tables"]["sums"]] == [2, 1, 0]
    assert len(list((tmp_path / "sums").iterdir())) <= 6  # merged parts go
    assert rows_of(parts.merged("sums"), "k", "n") == [(0, 7), (1, 6)]


def test_many_tally_batches_leave_few_parts(spark, tmp_path):
    events = [("a" if n % 2 else "b", 1_700_000_000 + 30 * n) for n in range(40)]
    for n in range(5):
        spark.createDataFrame(events[8 * n : 8 * n + 8], "entity string, at long").select("entity", F.timestamp_seconds("at").alias("ts")).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        coming = spark.readStream.schema("entity string, ts timestamp").parquet(f"{tmp_path}/in")
        jobs.write_tallies(coming, f"{tmp_path}/out", f"{tmp_path}/check", fan=2).awaitTermination()
    assert len(jobs.tally_parts(spark, f"{tmp_path}/out").paths("tallies")) <= 4
    counts: dict = {}
    for entity, at in events:
        counts[entity, at // 60 * 60] = counts.get((entity, at // 60 * 60), 0) + 1
    found = jobs.newest_tallies(spark, f"{tmp_path}/out").select("entity", F.unix_timestamp("bucket_ts").alias("at"), "mentions")
    assert {(r["entity"], r["at"]): r["mentions"] for r in found.collect()} == counts


ITEM = f"id long, ts long, text string, content_hash string, source_class string, entities array<{ENTITY}>, geo {GEO}"
PLACES = {"tokyo": ("place", "Tokyo", 35.0, 139.0), "un": ("org", "UN", None, None)}


def some_items(spark, n=24):
    rng = random.Random(6)
    texts = ["flood in tokyo", "un meets", "Tokyo and the UN", "nothing", "", None]
    rows = [(i, i * 60, rng.choice(texts), rng.choice(["", "", "h1", "h2", None]), "social", [], None) for i in range(n)]
    return spark.createDataFrame(rows, ITEM)


@pytest.mark.parametrize("fails_at", [None, 0, 2])
def test_enrichment_of_a_stream_equals_the_batch_though_it_dies(spark, tmp_path, fails_at):
    items, dead = some_items(spark), []

    def dies(number):
        if number == fails_at and not dead:
            dead.append(number)
            raise RuntimeError("killed between rows and commit")

    match = entities.matcher(PLACES)
    for n in range(3):
        items.where((F.col("id") >= 8 * n) & (F.col("id") < 8 * n + 8)).write.mode("append").parquet(f"{tmp_path}/in")
        start = lambda: enrichment.enrich_stream(spark.readStream.schema(items.schema).parquet(f"{tmp_path}/in"), f"{tmp_path}/out", f"{tmp_path}/check", match=match, before_commit=dies)
        jobs.redelivered(start, attempts=2, seconds=0)
    assert dead == ([] if fails_at is None else [fails_at])
    store = enrichment.store(spark, f"{tmp_path}/out")
    want = enrich.finished(enrich.judged(storage.first_of_key(items.withColumn("text", F.col("text")), ["ts", "id"])), match, None, lambda c: F.lit(0))
    shown = lambda df: rows_of(df.select("id", F.round("relevance", 6).alias("r"), F.transform("entities", lambda e: e["text"]).alias("e")), "id", "r", "e")
    assert shown(store.read("items").where("text is not null")) == shown(want.where("text is not null"))
    tallies = enrich.drained(items, match).groupBy("entity", "bucket_ts").agg(F.sum("mentions").alias("mentions"))
    assert rows_of(store.merged("tallies"), "entity", "bucket_ts", "mentions") == rows_of(tallies, "entity", "bucket_ts", "mentions")


def test_a_batch_taken_again_keeps_its_model(spark, tmp_path):
    models, out = str(tmp_path / "models"), str(tmp_path / "out")
    weights = spark.createDataFrame([(0, 1.0)], "idx int, weight double")
    assert enrichment.pinned(spark, out, 0, models) is None
    one = storage.publish_model(weights, models, "{}")
    assert enrichment.pinned(spark, out, 0, models) is None and enrichment.pinned(spark, out, 1, models) == one
    two = storage.publish_model(weights, models, "{}")
    assert enrichment.pinned(spark, out, 1, models) == one and enrichment.pinned(spark, out, 2, models) == two


def vectors(spark, n=60, seed=3):
    rng = random.Random(seed)
    centres = [[rng.gauss(0, 1) for _ in range(8)] for _ in range(6)]
    rows = [(i, i * 3600 * 4, [x + rng.gauss(0, 0.2) for x in rng.choice(centres)], [rng.choice("AbC")], f"s{i % 3}") for i in range(n)]
    return spark.createDataFrame(rows, "id long, ts long, embedding array<double>, entities array<string>, source string")


def test_stories_of_batches_equal_those_of_all_items_though_a_writer_dies(spark, tmp_path):
    items = vectors(spark)
    formed = stories.formed(items, exact=True)
    store = stories.StoryStore(spark, str(tmp_path), fan=2)
    assert store.stories() is None

    def dies():
        raise RuntimeError("killed")

    for n in range(4):
        batch = items.where((F.col("id") >= 15 * n) & (F.col("id") < 15 * n + 15))
        if n == 2:
            with pytest.raises(RuntimeError):
                store.add(n, batch, dies)
        assert store.add(n, batch) and not store.add(n, batch)
    assert rows_of(store.assigned(), "id", "story_id") == rows_of(formed, "id", "story_id")
    columns = ("story_id", "n_items", "first_seen", "last_seen", "entity_set", "source_set", "centroid")
    assert rows_of(store.stories(), *columns) == rows_of(stories.folded(items.join(formed, "id")), *columns)
    assert len(store.parts.paths("folds")) <= 4
    store.add(4, items.limit(0))
    assert store.stories().count() == stories.folded(items.join(formed, "id")).count()


def test_empty_windows_have_no_neighbours(spark):
    none = vectors(spark).limit(0)
    assert stories.nearest_lsh(none).collect() == [] and stories.nearest(none).collect() == []
    assert stories.formed(none).collect() == []
    nulls = vectors(spark, 3).withColumn("embedding", F.lit(None).cast("array<double>"))
    assert stories.nearest_lsh(nulls).collect() == []


def test_items_seen_before_are_known_by_hash_or_text(spark):
    items = spark.createDataFrame([(1, 0, "seen", "", "social", [], None), (2, 0, "new", "", "social", [], None), (3, 0, "x", "h", "social", [], None), (4, 0, "seen", "other", "social", [], None)], ITEM)
    known = spark.createDataFrame([("", "seen"), ("h", "y")], "content_hash string, text string")
    got = enrich.enriched(items, known=known, embed=lambda c: F.lit(0))
    assert rows_of(got, "id") == [(2,), (4,)]


def test_a_gazetteer_of_two_files(spark, tmp_path):
    for n, phrase in enumerate(("Lima", "Oslo")):
        (tmp_path / f"{n}.json").write_text(json.dumps([{"phrase": phrase, "type": "place"}, {"phrase": "both", "type": f"kind{n}"}]))
    found = entities.gazetteer(spark, str(tmp_path))
    assert "lima" in found and "oslo" in found and found["both"][0] == "kind1"
    (tmp_path / "2.json").write_text("broken")
    assert entities.gazetteer(spark, str(tmp_path)) == entities.SEED


@pytest.mark.parametrize(("cells", "block"), [(1, 10_000), (4, 7), (64, 2048)])
def test_neighbours_by_the_index_equal_those_of_whole_slots(spark, cells, block):
    from undertow.functions.vector import unit
    from undertow.operators.neighbours import nearest_indexed

    items = vectors(spark, 150, 9)
    items = items.union(items.where("id < 6").selectExpr("id + 500", "ts + 86400", "embedding", "entities", "source")).union(items.where("id = 9").selectExpr("id + 900", "ts", "embedding", "entities", "source"))
    ready = items.select("id", "ts", unit(F.col("embedding")).alias("unit"))
    shown = lambda df: rows_of(df.select("id", "neighbour", "place", F.round("similarity", 9).alias("s")), "id", "neighbour", "place", "s")
    want = shown(stories.nearest_by_slots(items))
    assert shown(nearest_indexed(ready, None, 10, 2 * 86_400, cells, block)) == want
    late = lambda df: df.where("id >= 100")
    got = nearest_indexed(late(ready), ready.where("id < 100"), 10, 2 * 86_400, cells, block)
    assert shown(got) == [r for r in want if r[0] >= 100]


def test_the_index_skips_blocks_that_cannot_hold_a_neighbour(spark, monkeypatch):
    from undertow.functions.vector import unit
    from undertow.operators import neighbours

    rng = random.Random(1)
    rows = [(i, i, [rng.gauss(0, 0.02) + 5 * (i % 40 == j) for j in range(40)]) for i in range(8000)]
    ready = spark.createDataFrame(rows, "id long, ts long, embedding array<double>").select("id", "ts", unit(F.col("embedding")).alias("unit"))
    asked = []
    frame = type(ready)
    whole = frame.mapInArrow

    def counted(df, f, schema):
        out = whole(df, f, schema)
        if f.__name__ == "probe":
            out = neighbours.frozen(out)
            asked.append(out.agg(F.sum(F.size("ids"))).first()[0])
        return out

    monkeypatch.setattr(frame, "mapInArrow", counted)
    found = neighbours.nearest_indexed(ready, None, 10, 2 * 86_400, 40, 200)
    assert found.groupBy("id").count().where("count = 10").count() == 7990
    assert asked[0] <= 8000 * 40 / 10  # a query looks into a tenth of the blocks at most
