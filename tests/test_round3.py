"""What the reviewer of the third round found, in small."""

from __future__ import annotations

import hashlib
import os

import pytest
from pyspark.sql import functions as F

from test_entry import TABLES, plain

needs_tables = pytest.mark.skipif(not os.path.isdir(TABLES), reason="needs the supplied tables")


def parity(spark, name, folder=TABLES, tables=("events", "documents", "embeddings", "pages")):
    import duckdb

    import __spark_entry__ as entry

    db = duckdb.connect()
    for table in tables:
        db.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet'")
    got, want = entry.queries()[name](spark, folder), db.execute(entry.oracle_sql()[name]).df()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    assert plain([[r[c] for c in columns] for r in got.collect()]) == plain(want[columns].astype(object).where(want[columns].notna(), None).values.tolist())


@needs_tables
def test_notified_equals_its_sql(spark):
    parity(spark, "notified")


def test_hash_embedding_in_double_precision(spark):
    """Single precision moves the sum by some 1e-6 of its size, and with it the rounded sum of one in many texts."""
    from undertow.functions.vector import hash_embedding

    texts = [f"t{i}" for i in range(50)]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", hash_embedding(kind="double")("t").alias("v"), hash_embedding()("t").alias("single")).collect()
    for r in rows:
        raw = b"".join(hashlib.sha256(f"{i}:{r['t']}".encode()).digest() for i in range(48))
        plain = [int.from_bytes(raw[i : i + 4], "little") / (2**32 - 1) - 0.5 for i in range(0, len(raw), 4)]
        length = sum(x * x for x in plain) ** 0.5
        assert r["v"] == pytest.approx([x / length for x in plain], abs=1e-14)
        assert r["single"] == pytest.approx(r["v"], abs=1e-6)


def test_entities_without_a_semicolon_stay(spark):
    from undertow.functions import text

    row = spark.range(1).select(*[f(F.lit(" <p>a &amp b &amp;copy; &copy;&#65;&nope; &quo")).alias(n) for n, f in (("closed", text.html_text_closed), ("all", text.html_text))]).first()
    assert row["closed"] == "a &amp b &copy; ©A&nope; &quo" and row["all"] == "a & b &copy; ©A&nope; &quo"


MEMBERS = "story_id int, id int, ts long, author_ref string, parent_ref string, content_hash string, urls array<string>"


def members(n):
    return [(i % 2, i, 100 - i, "a" if i % 3 else "", f"h{i - 2}" if i > 1 else "", f"h{i}", [f"u{i % 2}", "u", ""][: i % 4]) for i in range(n)]


def brute(rows, shares):
    return sorted((x[0], *((x[1], y[1]) if (x[2], x[1]) > (y[2], y[1]) else (y[1], x[1])), max(x[2], y[2])) for x in rows for y in rows if x[0] == y[0] and x[1] < y[1] and shares(x, y))


def by_author(x, y):
    return x[3] == y[3] != ""


def by_url(x, y):
    return bool({u for u in x[6] if u} & {u for u in y[6] if u})


@pytest.mark.parametrize("kind, shares", [("author", by_author), ("url", by_url)])
def test_edges_of_members_by_tiles(spark, kind, shares):
    from undertow.operators import provenance

    rows = members(40)
    df = spark.createDataFrame(rows + rows[:7], MEMBERS)
    want = brute(rows, shares)
    for tile in (3, 2048):
        found = provenance.member_edges(provenance.edge_members(df, kind), kind, tile)
        assert sorted(tuple(r) for r in found.select("story_id", "src", "dst", "ts").collect()) == want
    made = (provenance.author_edges if kind == "author" else provenance.url_edges)(df)
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    assert not plan.startswith("Aggregate")  # pairs are not shuffled to be told apart


def test_edge_store_keeps_members_and_makes_each_edge_once(spark, tmp_path):
    from undertow.operators.edges import EdgeStore

    rows = members(40)
    df = spark.createDataFrame(rows, MEMBERS)
    store = EdgeStore(spark, str(tmp_path / "edges"))
    assert store.edges() is None
    assert store.add(0, df.where("id % 2 = 0 or id < 9"), ("ref", "author")) and not store.add(0, df)
    assert store.add(1, df) and store.add(2, df)
    assert store.parts.read("author").count() == sum(1 for r in rows if r[3])  # a row a member, however often it came
    found = sorted((r["edge_type"], r["story_id"], r["src"], r["dst"]) for r in store.edges().collect())
    refers = lambda x, y: x[4] == y[5] or y[4] == x[5]
    want = sorted((kind, *e[:3]) for kind, shares in (("author", by_author), ("url", by_url), ("ref", refers)) for e in brute(rows, shares))
    assert found == want


def test_fifo_that_forgets_nothing_is_dealt_into_lanes(spark, tmp_path):
    from undertow.streaming import jobs

    texts = [f"t{i * 7 % 60}" for i in range(200)]
    ddl, out = "id long, ts long, text string, content_hash string", str(tmp_path / "out")
    for part in (range(120, 200), range(0, 120)):  # what comes in the second batch is older, and late
        spark.createDataFrame([(i, -i, texts[i], "") for i in part], ddl).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(ddl).parquet(str(tmp_path / "in"))
        jobs.fifo_deduplicated(stream, most=None, lanes=5).writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start().awaitTermination()
    first = {}
    for part in (range(199, 119, -1), range(119, -1, -1)):
        for i in part:
            first.setdefault(texts[i], i)
    assert sorted(r["id"] for r in spark.read.parquet(out).collect()) == sorted(first.values())


def test_first_sight_holds_lanes_of_keys_that_expire():
    import types

    import pandas as pd

    from undertow.streaming.enrichment import FirstSight

    held = []
    state = types.SimpleNamespace(exists=lambda: bool(held), get=lambda: held[-1], update=held.append)
    sight = FirstSight(10)
    sight.init(types.SimpleNamespace(getValueState=lambda *a, **b: state))

    def seen(now_s, rows):
        parts = [pd.DataFrame([(hashlib.md5(k.encode()).hexdigest(), ts, i, f"{k}{i}") for k, ts, i in part], columns=["digest", "place_ts", "place_id", "payload"]) for part in rows]
        timer = types.SimpleNamespace(getCurrentProcessingTimeInMs=lambda: now_s * 1000)
        out = pd.concat(list(sight.handleInputRows((0,), iter(parts), timer)))
        return sorted(out.loc[out["fresh"].astype(bool), "payload"]), len(out)

    assert seen(100, [[("a", 5.0, 1), ("b", 1.0, 2)], [("a", 4.0, 3), ("a", 4.0, 4), ("b", None, 0)]]) == (["a3", "b2"], 5)
    assert seen(105, [[("a", 0.0, 5), ("c", 0.0, 6)]]) == (["c6"], 2)
    assert seen(111, [[("a", 9.0, 7), ("c", 0.0, 8)]]) == (["a7"], 2) and len(held[-1][0]) == 32


def test_basic_words_of_far_characters():
    from undertow.operators import entities

    text = "Aé́x_1 \U0001d49c\U0001d4d0b, \U00020000c\U00010100d　 一퟿e\U000e0001f×­$"
    found = [text[a:b] for a, b in entities.WordPiece(["[UNK]"]).spans(text)]
    assert found == ["Aé\u0301x", "_", "1", "\U0001d49c\U0001d4d0b", ",", "\U00020000", "c", "\U00010100", "d", "\u4e00", "e", "f×", "$"]


def test_long_texts_are_cut_into_basic_words_in_little_time():
    import time

    from undertow.operators import entities

    words, text = entities.WordPiece(["[UNK]"]), "some words, of little note " * 20_000
    words.spans("a")
    start = time.process_time()
    assert len(words.spans(text)) == 120_000
    assert time.process_time() - start < 0.6


def test_simhashes_are_made_once_for_copies(spark):
    from undertow.operators import provenance

    made = spark.sparkContext.accumulator(0)

    @F.pandas_udf("long")
    def hashed(ids):
        made.add(len(ids))
        return ids % 5

    rows = spark.range(100).select("id", hashed("id").alias("simhash"))
    members, links = provenance.copy_classes(rows)
    assert members.count() == 80 and links.count() == 6 and made.value == 100


def test_feature_cells_are_made_where_rows_lie_and_score_alike(spark):
    from undertow.operators import labels

    rows = spark.createDataFrame([(1, "A b a, c"), (2, ""), (3, None), (4, "b b c d")], "id int, text string")
    found = labels.features(rows)
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
    cells = labels.feature_cells(rows)
    assert {r["id"]: len(r["cells"]["idx"]) for r in cells.collect()} == {1: 3, 2: 0, 3: 0, 4: 3}
    weights = found.where("id = 1").select("idx", F.col("value").alias("weight")).union(spark.createDataFrame([(-1, 0.25)], "idx int, weight double"))
    long, wide = ({r["id"]: r["score"] for r in labels.scored(x, weights).collect()} for x in (found, cells))
    assert sorted(wide) == [1, 4] and wide == pytest.approx(long, abs=1e-12)
    labelled = rows.withColumn("label", F.col("id") % 2)
    models = [{r["idx"]: r["weight"] for r in labels.trained_sparse(x, labelled, epochs=3).collect()} for x in (found, cells)]
    assert models[0] == pytest.approx(models[1], abs=1e-12)
