"""Operators on small tables, against plain Python where they are iterative."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from undertow.config import D, Defaults
from undertow.operators import admission, graph, labels, provenance, scoring, serving, storage, stories, tallies
from undertow.operators.commits import CommitLog

ITEM = "story_id int, id int, ts long, source string, source_class string, author_ref string, parent_ref string, content_hash string, urls array<string>, simhash long, wire_ref string, entities array<string>"


def item(i, story=1, **more):
    base = {"story_id": story, "id": i, "ts": i, "source": f"s{i}", "source_class": "social", "author_ref": "", "parent_ref": "", "content_hash": f"h{i}", "urls": [], "simhash": 0, "wire_ref": "", "entities": []}
    return base | more


def table(spark, rows):
    return spark.createDataFrame([tuple(r.values()) for r in rows], ITEM)


def found(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


def test_edges(spark):
    rows = table(spark, [item(1), item(2, parent_ref="h1"), item(3, author_ref="x", simhash=7), item(4, author_ref="x", simhash=7 | 1 << 40), item(5, urls=["u", "u"]), item(6, urls=["u"], simhash=1 << 62), item(7, 2, parent_ref="h1")])
    want = [("author", 4, 3), ("copy", 4, 3), ("copy", 6, 3), ("copy", 6, 4), ("ref", 2, 1), ("url", 6, 5)]
    assert found(provenance.all_edges(rows), "edge_type", "src", "dst") == want


def test_copy_edges_equal_brute_force(spark):
    rng = random.Random(1)
    base = [rng.getrandbits(63) for _ in range(5)]
    rows = [item(i, i % 2, simhash=rng.choice(base) ^ sum({1 << rng.randrange(63) for _ in range(rng.randint(0, 6))})) for i in range(60)]
    want = sorted((b["id"], a["id"]) for a in rows for b in rows if a["id"] < b["id"] and a["story_id"] == b["story_id"] and (a["simhash"] ^ b["simhash"]).bit_count() <= 6)
    assert found(provenance.copy_edges(table(spark, rows)), "src", "dst") == want


def test_origins(spark):
    rows = [item(1, author_ref="a"), item(2, author_ref="a"), item(3), item(4), item(5, source="usgs", source_class="authoritative"), item(6, source="usgs", source_class="authoritative"), item(7, source_class="mainstream", wire_ref="ap"), item(8, source_class="local_news", wire_ref="ap", author_ref="z"), item(9, wire_ref="ap")]
    edges = spark.createDataFrame([(1, 4, 3, "ref"), (1, 3, 99, "ref")], "story_id int, src int, dst int, edge_type string")
    got = provenance.corroboration(provenance.origins(table(spark, rows), edges))
    assert found(got, "story_id", "independent_origins", "distinct_sources") == [(1, 5, 5)]


@pytest.mark.parametrize("most", [3, 50_000])
def test_origins_by_keys_equal_those_by_edges(spark, most):
    rng = random.Random(12)
    rows = table(spark, [item(i, i % 5, source=f"s{i % 4}", author_ref=rng.choice(["", "", "a", "b"]), urls=rng.choice([[], ["u"], ["u", "v"], [""]]), parent_ref=f"h{i - 5}" if rng.random() < 0.2 else "") for i in range(60)])
    want = provenance.corroboration(provenance.origins(rows, provenance.ref_edges(rows).union(provenance.url_edges(rows)).union(provenance.author_edges(rows))))
    got = provenance.corroboration(provenance.origins(rows, provenance.ref_edges(rows), provenance.shared_keys(), most))
    assert found(got, "story_id", "independent_origins", "distinct_sources") == found(want, "story_id", "independent_origins", "distinct_sources")


def tangled(spark, n=80, stories=4, seed=12):
    """Items with every kind of edge, copies of equal and of near simhashes among them."""
    rng = random.Random(seed)
    base = [rng.getrandbits(62) | 1 for _ in range(4)]
    simhash = lambda: rng.choice([0, rng.getrandbits(62), rng.choice(base), rng.choice(base) ^ sum({1 << rng.randrange(62) for _ in range(rng.randint(1, 6))})])
    return table(spark, [item(i, i % stories, ts=rng.randint(0, n), source=f"s{i % 5}", author_ref=rng.choice(["", "", "", f"a{i % 7}"]), urls=rng.choice([[], [], [f"u{i % 9}"]]), simhash=simhash(), content_hash=f"h{rng.randrange(n)}", parent_ref=f"h{rng.randrange(n)}" if rng.random() < 0.3 else "") for i in range(n)])


def linked(rows):
    """The edges that are no keys, without pairs of copies."""
    links = provenance.story_copies(rows)[1].select("story_id", "src", "dst")
    return provenance.ref_links(rows).union(links)


@pytest.mark.parametrize("most", [3, 50_000])
def test_copies_count_by_class_as_by_pair(spark, most):
    rows = tangled(spark)
    pairs = provenance.all_edges(rows)
    assert pairs.where("edge_type = 'copy'").count() > 20
    assert found(scoring.copies_by_class(rows), "story_id", "copy_edges") == found(scoring.copies(pairs), "story_id", "copy_edges")
    want, got = provenance.origins(rows, pairs), provenance.origins(rows, linked(rows), provenance.shared_keys(copies=True), most)
    assert found(got, "story_id", "id", "origin") == found(want, "story_id", "id", "origin")  # names and all, whatever the path


def test_replay_of_links_equals_every_prefix_of_all_pairs(spark):
    rows = tangled(spark, 60, 3, 5)
    pairs = [(r["story_id"], r["src"], r["dst"]) for r in provenance.all_edges(rows).collect()]
    want = []
    for story in range(3):
        order = sorted((r for r in rows.collect() if r["story_id"] == story), key=lambda r: (r["ts"], r["id"]))
        for n in range(1, len(order) + 1):
            root = {r["id"]: r["id"] for r in order[:n]}

            def find(x):
                while root[x] != x:
                    x = root[x]
                return x

            for s, a, b in pairs:
                if s == story and a in root and b in root:
                    root[find(a)] = find(b)
            origins = {find(r["id"]) for r in order[:n]}
            sources = {min(r["source"] for r in order[:n] if find(r["id"]) == o) for o in origins}
            want.append((story, order[n - 1]["id"], n - 1, len(origins), len(sources)))
    got = provenance.replay(rows, linked(rows), provenance.shared_keys(copies=True))
    assert found(got, "story_id", "id", "seq", "independent_origins", "distinct_sources") == sorted(want)


def test_ref_links_connect_what_edges_do_at_every_moment(spark):
    rows = table(spark, [item(1, content_hash="x"), item(2, content_hash="x"), item(3, parent_ref="x"), item(4, parent_ref="x"), item(5, content_hash="x"), item(6, parent_ref="h6", content_hash="h6"), item(7, content_hash="h6")])
    assert found(provenance.ref_links(rows), "src", "dst") == [(1, 3), (2, 3), (3, 1), (4, 1), (5, 3), (7, 6)]


def test_more_simhashes_meet_under_longer_keys():
    assert [provenance._equal_parts(n, 6) for n in (0, 1000, 10_000, 10**6, 10**7, 10**10, 10**15)] == [1, 1, 2, 3, 4, 6, 6]


def test_states_never_fall(spark):
    cases = spark.createDataFrame([("rumor", 3, 2, False), ("rumor", 3, 1, False), ("corroborated", 0, 0, False), ("rumor", 0, 0, True), ("primary_backed", 1, 1, False)], "s string, o int, d int, p boolean")
    state = provenance.next_state(F.col("s"), F.col("o"), F.col("d"), F.col("p"))
    assert [r[0] for r in cases.select(state).collect()] == ["corroborated", "rumor", "corroborated", "primary_backed", "primary_backed"]


def test_replay_ends_where_the_final_graph_is(spark):
    rng = random.Random(2)
    rows = [item(i, i % 4, source=f"s{i % 5}", author_ref=rng.choice(["", "a", "b", "c", "d"]), parent_ref=f"h{i - 4 * rng.randint(1, 3)}" if rng.random() < 0.3 else "") for i in range(80)]
    data = table(spark, rows)
    edges = provenance.ref_edges(data).union(provenance.author_edges(data))
    replayed = provenance.replay(data, edges).collect()
    last = {}
    for r in sorted(replayed, key=lambda r: r["seq"]):
        rank = ["rumor", "corroborated", "primary_backed"].index
        assert r["story_id"] not in last or rank(r["trust_state"]) >= rank(last[r["story_id"]]["trust_state"])
        last[r["story_id"]] = r
    final = {r["story_id"]: r for r in provenance.trust_states(data, edges).collect()}
    assert {k: (v["independent_origins"], v["distinct_sources"]) for k, v in last.items()} == {k: (v["independent_origins"], v["distinct_sources"]) for k, v in final.items()}


def test_components_and_roots(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(150)] + [(300 + i, 301 + i) for i in range(40)]
    root = {n: n for e in edges for n in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        root[max(find(a), find(b))] = min(find(a), find(b))
    got = {r["node"]: r["root"] for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {n: find(n) for n in got} and set(got) == {n for a, b in edges for n in (a, b) if a != b}
    chain = spark.createDataFrame([(i, max(i - 1, i // 10 * 10)) for i in range(60)], "node int, parent int")
    assert {r["node"]: r["root"] for r in graph.roots(chain).collect()} == {i: i // 10 * 10 for i in range(60)}


def test_story_formation_equals_the_sequence(spark):
    import numpy as np

    rng = np.random.default_rng(4)
    v = rng.normal(size=(80, 8))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    tags = [[str(t) for t in rng.choice(3, size=rng.integers(0, 3), replace=False)] for _ in v]
    rows = [(i, i * 3600, [float(x) for x in v[i].astype(np.float32)], tags[i]) for i in range(80)]
    owner = {}
    for i, ts, e, own in rows:
        near = sorted(((-float(np.dot(np.array(e), np.array(o)) / np.linalg.norm(e) / np.linalg.norm(o)), j) for j, t, o, _ in rows[:i] if t >= ts - D.story_window_s))[:10]
        match = [j for s, j in near if -s >= 0.5 and set(own) & set(tags[j])]
        owner[i] = owner[match[0]] if match else i
    data = spark.createDataFrame(rows, "id int, ts long, embedding array<float>, entities array<string>")
    got = stories.assigned(stories.parents(data, stories.nearest(data), 0.5))
    assert {r["id"]: r["story_id"] for r in got.collect()} == owner


def test_lsh_recall(spark):
    import numpy as np

    rng = np.random.default_rng(5)
    base = rng.normal(size=(20, 32))
    rows = [(i, i, [float(x) for x in base[i % 20] + rng.normal(size=32) * 0.2]) for i in range(200)]
    data = spark.createDataFrame(rows, "id int, ts long, embedding array<float>")
    exact = {(r["id"], r["neighbour"]) for r in stories.nearest(data, 200).where("similarity >= 0.82").collect()}
    near = {(r["id"], r["neighbour"]) for r in stories.nearest_lsh(data, 0.82, 200).collect()}
    assert near <= exact and len(near) >= 0.9 * len(exact)


def test_stories_form_alike_by_buckets(spark):
    import numpy as np

    rng = np.random.default_rng(9)
    base = rng.normal(size=(30, 64))
    rows = [(i, i * 60, [float(x) for x in base[i % 30] + rng.normal(size=64) * 0.3], [f"e{i % 30}"]) for i in range(400)]
    data = spark.createDataFrame(rows, "id int, ts long, embedding array<float>, entities array<string>")
    exact = {r["id"]: r["story_id"] for r in stories.formed(data, exact=True).collect()}
    near = {r["id"]: r["story_id"] for r in stories.formed(data).collect()}
    assert len(set(exact.values())) == 30 and sum(near[i] == s for i, s in exact.items()) >= 0.95 * len(exact)


def test_lsh_recall_of_loose_neighbours(spark):
    import numpy as np

    rng = np.random.default_rng(6)
    rows = [(i, i, [float(x) for x in rng.normal(size=64)]) for i in range(600)]
    data = spark.createDataFrame(rows, "id int, ts long, embedding array<float>")
    exact = {(r["id"], r["neighbour"]) for r in stories.nearest(data).where("similarity >= 0.3").collect()}
    near = {(r["id"], r["neighbour"]) for r in stories.nearest_lsh(data, 0.3).collect()}
    assert len(exact) > 500 and len(near & exact) >= 0.9 * len(exact)


def test_primary_match(spark):
    ddl = "id int, ts long, entities array<string>, lat double, lon double, story_id int"
    claims = spark.createDataFrame([(1, 100_000, ["Rome"], 41.9, 12.5, 1), (2, 100_000, ["Oslo"], None, None, 2), (3, 100_000, ["Paris"], 48.8, 2.3, 3)], ddl)
    official = spark.createDataFrame([(10, 100_500, ["ROME"], 41.0, 12.0, 0), (11, 100_900, ["rome"], -41.0, 12.0, 0), (12, 99_000, ["oslo"], 1.0, 1.0, 0), (13, 300_000, ["paris"], 48.8, 2.3, 0)], ddl)
    assert found(provenance.primary_matches(claims, official), "story_id", "primary_id") == [(1, 10), (2, 12)]


def test_governor(spark):
    rng = random.Random(6)
    rows, t = [], 0.0
    for i in range(400):
        t += rng.random() * 0.2
        rows.append((i, t, rng.random(), rng.choice(["social", "mainstream", "primary"])))
    data = spark.createDataFrame(rows, "id int, ts double, relevance double, source_class string")
    quick = Defaults(halflife_s=5.0)
    governor = admission.Governor(quick)
    want = [(i, governor.admit(r, c, t)) for i, t, r, c in rows]
    assert found(admission.governed(data, config=quick), "id", "admitted") == want
    assert governor.theta > 0 and all(a for (_, a), r in zip(want, rows, strict=True) if r[3] == "primary")
    assert admission.governed(data, lanes=3).count() == 400


def test_governor_relaxes_and_keeps_its_bounds():
    governor = admission.Governor(Defaults(halflife_s=1.0))
    for i in range(2000):
        governor.admit(1.0, "social", i * 0.01)
        assert 0 <= governor.theta <= D.ceiling
    assert governor.exhausted
    high = governor.theta
    for i in range(50):
        governor.admit(0.0, "social", 20 + i * 1000.0)
    assert governor.theta < high


def test_series(spark):
    rows = spark.createDataFrame([("a", 300, 2), ("a", 301, 3), ("b", 900, 1)], "entity string, bucket long, mentions long")
    bins = tallies.binned(rows, 300, 300)
    assert found(bins, "entity", "bin", "n") == [("a", 300, 3.0), ("b", 900, 1.0)]
    assert found(tallies.dense(bins, 300, 900, 300), "entity", "bin", "n") == [("a", 300, 3.0), ("a", 600, 0.0), ("a", 900, 0.0), ("b", 300, 0.0), ("b", 600, 0.0), ("b", 900, 1.0)]
    assert found(tallies.hottest(spark.createDataFrame([("a", 0, 2), ("b", 0, 2), ("c", 0, 3)], "entity string, bucket long, mentions long"), 2), "entity") == [("a",), ("c",)]


def test_alerts(spark):
    scored = spark.createDataFrame([(1, 3.0, 1.0, "corroborated", False), (2, 3.0, 1.0, "rumor", False), (3, 3.0, 1.0, "corroborated", True), (4, 2.0, 1.0, "corroborated", False), (5, 3.0, 1.0, "primary_backed", False)], "story_id int, gap double, velocity_z double, trust_state string, warming boolean")
    earlier = spark.createDataFrame([(5, 100_000 - D.cooldown_s + 1)], "story_id int, ts long")
    assert found(scoring.new_alerts(scored, earlier, 100_000), "story_id") == [(1,)]


def test_sync_and_reputation(spark):
    rows = table(spark, [item(0, ts=0), item(1, ts=50), item(2, ts=500), item(3, 2, ts=0), item(4, 3, author_ref="x"), item(5, 3, author_ref="x"), item(6, 1, ts=9000, author_ref="x")])
    assert found(scoring.synchronised(rows).where("story_id < 3"), "story_id", "social_items", "synced_items") == [(1, 4, 2), (2, 1, 0)]
    flagged = spark.createDataFrame([(1, 0.1), (3, 0.9)], "story_id int, inauthenticity double")
    assert found(scoring.low_reputation(rows, flagged), "story_id", "low_rep_items") == [(1, 1), (3, 2)]


def test_storage(spark, tmp_path):
    path = str(tmp_path / "items")
    rows = spark.createDataFrame([(1, "2024-01-01 10:00:00"), (1, "2024-01-01 10:00:00"), (2, "2024-01-09 00:00:00")], "id int, t string").select("id", F.col("t").cast("timestamp").alias("ts_observed"))
    for _ in range(2):
        storage.insert_absent(rows, path, "items", "ts_observed")
    assert spark.read.parquet(path).count() == 2
    assert storage.drop_old(spark, path, "2024-01-09") == ["day=2024-01-01"] and spark.read.parquet(path).count() == 1
    assert storage.drop_old(spark, path, "2024-01-14") == []
    flushes = spark.createDataFrame([(1, "r", {"a": 1}), (1, "r", {"a": 2}), (1, "q", {})], "bucket_ts int, replica string, counts map<string,int>")
    assert found(storage.exploded_tallies(flushes), "entity", "replica", "mentions") == [("a", "r", 3)]
    a, b = (spark.createDataFrame([r], "key string, value string, updated_at int") for r in (("k", "old", 1), ("k", "new", 2)))
    assert found(storage.upserted(a, b), "value") == [("new",)] == found(storage.upserted(b, a), "value")
    with pytest.raises(PermissionError):
        storage.publishable(a, "other.x", "ingest.")
    with pytest.raises(Exception, match="payload over"):
        storage.publishable(a, "ingest.x", "ingest.", 5).collect()
    kept = storage.first_of_key(spark.createDataFrame([(2, "h", "x"), (1, "h", "y"), (3, "", "x"), (4, None, "x")], "id int, content_hash string, text string"), ["id"])
    assert found(kept, "id") == [(1,), (3,)]


def test_a_batch_of_many_days_is_inserted_once(spark, tmp_path):
    path = str(tmp_path / "items")
    rows = spark.range(1000).select(F.col("id").cast("int"), F.timestamp_seconds(F.col("id") * 43_200).alias("ts_observed"))
    for _ in range(2):
        storage.insert_absent(rows.coalesce(1), path, "items", "ts_observed")
    got = spark.read.parquet(path)
    assert got.count() == 1000 and got.select("day").distinct().count() == 500


def test_snapshots(spark, tmp_path):
    path = str(tmp_path / "stories")
    rows = spark.createDataFrame([(1, 0, "rumor", 0.0), (2, 5, "corroborated", 1.0)], "story_id int, independent_origins int, trust_state string, gap double")
    storage.save_snapshot(rows, path)
    for n in range(3):
        states = spark.createDataFrame([(1, n, "corroborated"), (9, 1, "x")], "story_id int, independent_origins int, trust_state string")
        storage.save_snapshot(storage.trust_updated(storage.snapshot(spark, path), states), path)
    assert found(storage.snapshot(spark, path), "story_id", "independent_origins", "trust_state", "gap") == [(1, 2, "corroborated", 0.0), (2, 5, "corroborated", 1.0)]
    assert len([p for p in tmp_path.joinpath("stories").iterdir() if p.name.startswith("v=")]) == 2
    streams = str(tmp_path / "streams")
    storage.declare(spark, streams, "ingest", "ingest.")
    assert found(storage.declare(spark, streams, "ingest", "ingest.", days=3), "name", "days") == [("ingest", 3)]
    assert storage.declare(spark, streams, "alerts", "alerts.").count() == 2


def test_assignments_and_edges(spark, tmp_path):
    items_ = spark.createDataFrame([(1, 5, "ap"), (2, 6, "")], "id int, simhash long, wire_ref string").withColumn("ts_observed", F.timestamp_seconds(F.lit(0)))
    done, again = storage.assignments(items_, spark.createDataFrame([(1, 7), (3, 7)], "item_id int, story_id int"))
    assert found(done, "item_id", "story_id", "simhash", "wire_ref") == [(1, 7, 5, "ap")] and found(again, "item_id") == [(3,)]
    edges = spark.createDataFrame([(1, 2, 1, 5, "ref"), (1, 3, 1, 100_000, "url")], "story_id int, src int, dst int, ts long, edge_type string")
    for _ in range(2):
        storage.insert_edges(edges, str(tmp_path / "edges"))
    assert spark.read.parquet(str(tmp_path / "edges")).count() == 2


def test_claims_that_may_be_backed(spark):
    rows = spark.createDataFrame(
        [(1, 1, "social", 100, ["Rome"], 1.0, 1.0), (2, 1, "social", 100, [" "], None, None), (3, 2, "social", 100, ["rome"], None, None), (4, 1, "mainstream", 100, ["rome"], None, None), (5, 9, "primary", 90, ["ROME"], None, None), (6, 9, "authoritative", 86_499, ["rome", "x"], 1.0, 1.1), (7, 9, "primary", 86_501 + 100, ["rome"], 1.0, 1.0)],
        "id int, story_id int, source_class string, ts long, entities array<string>, lat double, lon double",
    )
    claims = spark.createDataFrame([(1, 1, "said"), (1, 1, "again"), (1, 2, "said"), (1, 3, "moved"), (1, 4, "said"), (1, 8, "gone"), (2, 3, "  ")], "story_id int, item_id int, claim string")
    assert found(provenance.eligible_claims(claims, rows), "story_id", "id") == [(1, 1)]
    assert found(provenance.claim_matches(claims, rows), "story_id", "id", "primary_id") == [(1, 1, 6)]


@pytest.mark.parametrize("bits", [3, 6])
def test_copy_classes_equal_brute_force(spark, bits):
    rng = random.Random(8)
    base = [rng.getrandbits(64) for _ in range(5)]
    values = [0, 0] + [rng.choice(base) ^ sum({1 << rng.randrange(64) for _ in range(rng.randint(0, bits + 1))}) for _ in range(150)]
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    members, links = provenance.copy_classes(spark.createDataFrame(list(enumerate(signed)), "id int, simhash long"), bits)
    first = {v: values.index(v) for v in values if v}
    assert found(members, "id", "first") == sorted((i, first[v]) for i, v in enumerate(values) if v)
    assert found(links, "src", "dst") == sorted((b, a) for x, a in first.items() for y, b in first.items() if a < b and (x ^ y).bit_count() <= bits)


def test_enrichment(spark):
    from undertow.operators import enrich, entities
    from undertow.schemas import ENTITY, GEO

    texts = ["Explosion in Tokyo tonight", "Explosion in Tokyo tonight", "nothing here", None, "of New York and Tokyo, a long text that goes on and on until it has more than eighty characters"]
    rows = spark.createDataFrame([(i, i * 60, t, "h4" if i == 4 else "", "social") for i, t in enumerate(texts)], "id long, ts long, text string, content_hash string, source_class string")
    rows = rows.select("*", F.array().cast(f"array<{ENTITY}>").alias("entities"), F.lit(None).cast(GEO).alias("geo"))
    match = entities.matcher(entities.SEED)
    assert sorted((r["entity"], r["mentions"]) for r in enrich.drained(rows, match).groupBy("entity").agg(F.sum("mentions").alias("mentions")).collect()) == [("new york", 1), ("tokyo", 3)]
    got = {r["id"]: r for r in enrich.enriched(rows, match=match).collect()}
    assert sorted(got) == [0, 2, 3, 4] and not any(r["exploration"] for r in got.values())
    assert [e["text"] for e in got[4]["entities"]] == ["New York", "Tokyo"] and got[4]["geo"]["lat"] == 40.7128 and got[2]["geo"] is None
    assert all(len(r["embedding"]) == 384 for r in got.values()) and got[0]["relevance"] > got[2]["relevance"]
    known = spark.createDataFrame([("h4",), ("",)], "content_hash string")
    assert sorted(r["id"] for r in enrich.enriched(rows, known=known).collect()) == [0, 2, 3]


def test_enrichment_sheds_and_explores(spark):
    from undertow.operators import enrich
    from undertow.schemas import ENTITY, GEO

    n = 20_000
    rows = spark.range(n).select("id", (F.col("id") * 0.01).alias("ts"), F.concat(F.lit("text "), "id").alias("text"), F.lit("").alias("content_hash"), F.when(F.col("id") % 10 == 0, "primary").otherwise("social").alias("source_class"), F.array().cast(f"array<{ENTITY}>").alias("entities"), F.lit(None).cast(GEO).alias("geo"))
    got = enrich.enriched(rows, embed=lambda c: F.lit(0)).select("id", "exploration", "source_class").collect()
    assert sum(r["source_class"] == "primary" for r in got) == n // 10 and 0 < sum(r["exploration"] for r in got) < 0.05 * n and len(got) < 0.5 * n


def test_a_whole_cycle(spark, tmp_path):
    stories_ = spark.createDataFrame([(1, 86_400 * 9, ["a"], "corroborated", 3, 0.0, 0.0, 0.0, 0.0), (2, 0, ["a"], "rumor", 0, 0.0, 0.0, 0.0, 0.5)], "story_id long, last_seen long, entity_set array<string>, trust_state string, independent_origins int, inauthenticity double, velocity_z double, mainstream_presence double, gap double")
    storage.save_snapshot(stories_, str(tmp_path / "stories"))
    table(spark, [item(1, 1)]).write.parquet(str(tmp_path / "items"))
    spark.createDataFrame([], "story_id int, src int, dst int, edge_type string").write.parquet(str(tmp_path / "edges"))
    now = 86_400 * 9
    spark.createDataFrame([("a", now - 4 * 86_400, 1)] + [("a", now, 50)], "entity string, bucket long, mentions long").write.parquet(str(tmp_path / "mentions"))
    assert scoring.run_cycle(spark, str(tmp_path), now, 3600) == {"scored": 1, "alerts": 1}
    assert scoring.run_cycle(spark, str(tmp_path), now, 3600) == {"scored": 1, "alerts": 0}
    kept = {r["story_id"]: r for r in storage.snapshot(spark, str(tmp_path / "stories")).collect()}
    assert kept[1]["gap"] > D.alert_gap and kept[2]["gap"] == 0.5 and spark.read.parquet(str(tmp_path / "alerts")).count() == 1
    assert serving.health(storage.snapshot(spark, str(tmp_path / "state"))).first()["baseline_warming"] is False


def test_the_api_and_pushes(spark):
    now = 100
    parts = {
        "stories": spark.createDataFrame([(1, 90, 1.0, "corroborated", ["x"], ["a"])], "story_id int, last_seen int, gap double, trust_state string, source_set array<string>, entity_set array<string>"),
        "items": table(spark, [item(1, 1), item(2, 1)]).withColumn("text", F.lit("words")),
        "mentions": spark.createDataFrame([("a", 60, 2)], "entity string, bucket long, mentions long"),
        "alerts": spark.createDataFrame([(1, 95, 1.0)], "story_id int, ts int, gap double"),
        "state": spark.createDataFrame([("score", '{"baseline_warming": false}'), ("enrich:a", '{"sampling_active": true}')], "key string, value string"),
    }
    broken = []

    def tables():
        if broken:
            raise OSError
        return parts

    api = serving.Api(tables)
    for _ in range(2):
        assert api.stories(now)[0][0]["item_count"] == 2 and len(api.story(1)[0]) == 3 and api.story(1)[1] is bool(broken)
        assert api.velocity(1, now)[0][0]["n"] == 2 and api.alerts(now)[0][0]["entity_set"] == ["a"]
        assert api.health()[0][0]["sampling_active"] and [r["key"] for r in api.state()[0]] == ["enrich:a", "score"]
        broken.append(1)
    with pytest.raises(OSError):
        api.velocity(2, now)
    sent = []

    class Done:
        def __enter__(self):
            return self

        def __exit__(self, *_):
            return False

    serving.http_push("http://host/topic", "u", "p", lambda request, timeout: sent.append(request) or Done())("title", "body")
    assert sent[0].data == b"body" and sent[0].get_header("Priority") == "high" and sent[0].get_header("Authorization").startswith("Basic ")


def test_feed_and_notifier(spark):
    rows = spark.createDataFrame([(1, 90, 1.0, "corroborated", ["noaa"], ["a"]), (2, 91, 2.0, "corroborated", ["x"], []), (3, 92, 0.5, "primary_backed", ["x"], ["b"])], "story_id int, last_seen int, gap double, trust_state string, source_set array<string>, entity_set array<string>")
    items = table(spark, [item(1, 2), item(2, 2)])
    order = lambda tab: [(r["story_id"], r["item_count"]) for r in serving.feed(rows, items, 100, tab).orderBy(F.desc("gap")).collect()]
    assert order("gap") == order("no such tab") == [(2, 2), (3, 0)] and order("corroborated") == [(2, 2)] and order("primary") == [(3, 0)] and order("weather") == [(1, 0)]
    alerts = spark.createDataFrame([(1, 5, 1.0, 1.0, "x"), (2, 6, 2.5, 1.0, "x"), (3, 6, 1.0, 1.0, "x")], "story_id int, ts int, gap double, velocity_z double, trust_state string")
    sent = []
    assert serving.Notifier.at_newest(lambda *m: sent.append(m), alerts).poll(alerts, rows) == 0
    notifier = serving.Notifier(lambda *m: sent.append(m), 5)
    assert notifier.poll(alerts, rows, batch=1) == 2 and notifier.poll(alerts, rows) == 0
    assert sorted(m[0] for m in sent) == ["Developing story: b", "Developing story: unknown entities"]

    def fails(*_):
        raise OSError

    stuck = serving.Notifier(fails, 5)
    with pytest.raises(OSError):
        stuck.poll(alerts, rows)
    assert stuck.cursor == 5
    later = serving.Notifier(lambda title, body: title.endswith("b") and fails(), 0)
    with pytest.raises(OSError):
        later.poll(alerts, rows)
    assert later.cursor == 5  # the alert of second 5 went out and is not sent again


def test_degradable_reads():
    read = serving.Degradable()
    assert read("k", lambda: [1]) == ([1], False)
    assert read("k", lambda: 1 / 0) == ([1], True)
    with pytest.raises(ZeroDivisionError):
        read("other", lambda: 1 / 0)


def test_split_and_metrics(spark):
    for n, held in ((1, 0), (2, 1), (10, 2), (12, 2), (13, 3), (5, 1)):
        rows = spark.range(n).select("id", F.col("id").alias("ts"))
        assert labels.time_split(rows).where("held_out").count() == held
    scored = spark.createDataFrame([(1, 0.9), (1, 0.1), (0, 0.5)], "label int, score double")
    got = labels.f1_metrics(scored).first()
    assert (got["n"], got["precision"], got["recall"], got["f1"]) == (3, 0.5, 0.5, 0.5)
    assert labels.f1_metrics(scored.where("label = 9")).first()["f1"] == 0


def test_retrain_and_gate(spark, tmp_path):
    rows = spark.createDataFrame([(i, i, "good news today" if i % 2 else "bad spam here", i % 2) for i in range(300)], "id int, ts int, text string, label int")
    out = labels.retrain(rows, str(tmp_path))
    assert out["promoted"] and out["f1"] == 1.0
    version, weights, _ = storage.current_model(spark, str(tmp_path))
    assert version == out["version"] and weights.where("idx = -1").count() == 1
    assert out["incumbent_f1"] is None
    assert not labels.retrain(rows.where("id < 100"), str(tmp_path))["promoted"]
    flipped = rows.withColumn("label", F.when(F.col("id") < 240, 1 - F.col("label")).otherwise(F.col("label")))  # what was learned before is right again
    worse = labels.retrain(flipped, str(tmp_path))
    assert not worse["promoted"] and worse["incumbent_f1"] == 1.0 and worse["f1"] < 0.5
    model = labels.CurrentModel(spark, str(tmp_path))
    assert model.scores(rows.limit(2)).where("(score > 0.5) = (label = 1)").count() == 2 and model.version == version
    from undertow.evaluate import evaluation

    rows.write.parquet(str(tmp_path / "rows"))
    report = evaluation(spark, str(tmp_path), str(tmp_path / "rows"))
    assert report["version"] == version and report["f1"] == 1.0 and report["enough"] and evaluation(spark, str(tmp_path / "none"), str(tmp_path / "rows"))["version"] is None
    spark.createDataFrame([(3, 9.0)], "idx int, weight double").write.mode("overwrite").parquet(str(tmp_path / "bad" / "weights"))
    spark.createDataFrame([("bad", '{"sha256": "0"}')], "version string, meta string").write.parquet(str(tmp_path / "bad" / "meta"))
    CommitLog(spark, str(tmp_path)).commit(lambda _: {"version": "bad"})
    assert model.get() is not None and model.version == version and labels.CurrentModel(spark, str(tmp_path)).get() is None
    counts = {0: 150, 1: 150}
    assert labels.promotes(counts, 0.5, 0.5) and labels.promotes(counts, 0.1, None) and not labels.promotes(counts, 0.4, 0.5) and not labels.promotes({0: 190, 1: 29}, 1.0, None)
    scores = {r["id"]: r["score"] for r in labels.scored(labels.features(rows), labels.features(rows).where("id = 1").select("idx", F.col("value").alias("weight"))).collect()}
    assert scores[1] > scores[0]


def test_an_exported_model_scores_alike(spark):
    import numpy as np
    import onnxruntime

    rng = np.random.default_rng(3)
    weights = [(int(i), float(w)) for i, w in zip(rng.choice(labels.DIM, 40, replace=False), rng.normal(size=40), strict=True)] + [(-1, 0.3)]
    session = onnxruntime.InferenceSession(labels.onnx_model(weights))
    x = rng.normal(size=(7, labels.DIM)).astype(np.float32)
    dense = np.zeros(labels.DIM)
    for i, w in weights[:-1]:
        dense[i] = w
    got = session.run(["score"], {"features": x})[0]
    assert got.shape == (7, 1) and np.allclose(got[:, 0], 1 / (1 + np.exp(-(x @ dense + 0.3))), atol=1e-5)


def test_sparse_training_equals_dense(spark):
    import numpy as np

    rows = spark.createDataFrame([(i, t, y) for i, (t, y) in enumerate([("good day", 1), ("bad day", 0), ("good good", 1), ("", 1), ("bad bad x", 0), ("zzz", None)])], "id int, text string, label int")
    found = labels.features(rows)
    dense = np.zeros((5, labels.DIM))
    for r in found.where("id < 5").collect():
        dense[r["id"], r["idx"]] = r["value"]
    w, b = labels.train(dense, np.array([1, 0, 1, 1, 0.0]), epochs=3)
    got = {r["idx"]: r["weight"] for r in labels.trained_sparse(found, rows, epochs=3).collect()}
    assert abs(got.pop(-1) - b) < 1e-12 and all(abs(w[i] - v) < 1e-12 for i, v in got.items()) and len(got) == np.count_nonzero(w)


def test_weak_labels(spark):
    rows = table(spark, [item(1, 1), item(2, 1, source_class="primary"), item(3, 2), item(4, 3), item(5, 9)]).withColumn("exploration", F.col("id").isin(4, 5))
    known = spark.createDataFrame([(1, 0.7, "rumor"), (2, 0.0, "corroborated"), (3, 0.0, "rumor")], "story_id int, inauthenticity double, trust_state string")
    assert {r["id"]: r["label"] for r in labels.weak_labels(rows, known).collect()} == {1: 0, 2: None, 3: 1, 4: 0, 5: 0}


def test_nodes_and_the_current_model(spark, tmp_path):
    rows = spark.createDataFrame([(1, "(AP) some words", ["https://www.a.org/x/", "nothing"]), (2, None, [])], "id int, text string, urls array<string>")
    got = {r["id"]: r for r in provenance.nodes(rows).collect()}
    assert got[1]["urls"] == ["a.org/x"] and got[1]["wire_ref"] == "ap" and got[1]["simhash"] != 0 and got[2]["simhash"] == 0
    model = labels.CurrentModel(spark, str(tmp_path / "m"))
    assert model.get() is None
    storage.publish_model(spark.createDataFrame([(1, 0.5)], "idx int, weight double"), str(tmp_path / "m"), "{}")
    assert model.get().count() == 1 and model.version
