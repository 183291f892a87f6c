"""Primary matches against a loop over all pairs."""

from __future__ import annotations

import math
import random

import pytest
from pyspark.sql import functions as F

from undertow.config import D
from undertow.operators.matching import newest_shared, primary_matches
from undertow.streaming.matching import MatchStore

SIDE = "id long, ts long, entities array<string>, lat double, lon double, story_id long"


def km(a, b):
    la, lo, lb, lob = (math.radians(v) for v in (a[3], a[4], b[3], b[4]))
    h = math.sin((lb - la) / 2) ** 2 + math.cos(la) * math.cos(lb) * math.sin((lob - lo) / 2) ** 2
    return 2 * 6371 * math.asin(math.sqrt(min(1, h)))


def brute(claims, official):
    found = set()
    for c in claims:
        said = {e.lower() for e in c[2] or () if e}
        near = {o for o in map(lambda o: (*o[:2], tuple(o[2] or ()), *o[3:]), official) if None not in (c[1], o[1]) and abs(o[1] - c[1]) <= D.match_s and said & {e.lower() for e in o[2] if e}}
        for o in sorted(near, key=lambda o: (-o[1], o[0]))[: D.match_candidates]:
            if None in (c[3], c[4], o[3], o[4]) or km(c, o) <= D.match_km:
                found.add((c[5], c[0], o[0]))
                break
    return sorted(found)


def sides(seed: int, n: int, span: int, hot: float):
    rng = random.Random(seed)
    words = ["Rome", "rome", "Oslo", "x", "", None, "Ülm"]
    some = lambda: None if rng.random() < 0.05 else (["hot"] if rng.random() < hot else []) + rng.choices(words, k=rng.randrange(3))
    place = lambda: rng.choice([None, 1.0, 3.0, 40.0])
    when = lambda: None if rng.random() < 0.02 else rng.randrange(span) // 60 * 60  # noqa: E731 - many share a time
    rows = [(i, when(), some(), place(), place(), i % 7) for i in range(n)]
    claims, official = rows[: n // 2], rows[n // 2 :]
    return claims + claims[:20], official + official[:40]


@pytest.mark.parametrize(("seed", "n", "span", "hot"), [(1, 1200, 86_400, 0.9), (2, 600, 20 * 86_400, 0.3), (3, 800, 3600, 0.0)])
def test_equals_all_pairs(spark, seed, n, span, hot):
    claims, official = sides(seed, n, span, hot)
    got = primary_matches(spark.createDataFrame(claims, SIDE).withColumn("near", F.lit(1)), spark.createDataFrame(official, SIDE).withColumn("part", F.lit("x")))
    assert sorted(map(tuple, got.collect())) == brute(claims, official)


def test_one_entity_is_spread_over_tasks(spark):
    claims, official = ([(i, i * 10, ["one"], None, None, 1) for i in range(a, b)] for a, b in ((0, 2000), (2000, 4000)))
    rows = newest_shared(spark.createDataFrame(claims, SIDE), spark.createDataFrame([(i, (i - 2000) * 10, *r) for i, _, *r in official], SIDE))
    parts = [r["n"] for r in rows.groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()]
    assert sum(parts) == 2000 and len(parts) > 1 and max(parts) < 1500
    assert {len(r["near"]) for r in rows.select("near").collect()} == {50}  # also where the fifty lie in the range before


def test_empty_sides(spark):
    none, one = spark.createDataFrame([], SIDE), spark.createDataFrame([(1, 5, ["a"], None, None, 1)], SIDE)
    assert primary_matches(none, one).count() == primary_matches(one, none).count() == primary_matches(none, none).count() == 0
    assert [tuple(r) for r in primary_matches(one, one).collect()] == [(1, 1, 1)]
    text = one.withColumn("id", F.lit("é")).withColumn("ts", F.lit(2.5))
    assert [tuple(r) for r in primary_matches(text, text).collect()] == [(1, "é", "é")]


def test_batches_equal_one_pass(spark, tmp_path):
    """Official items that come late back claims of earlier batches, or push their match out of the newest fifty."""
    claims, official = sides(4, 500, 2 * 86_400, 0.5)
    far = [(9000 + i, 50_400, ["Solo"], 80.0, 80.0, 0) for i in range(50)]
    claims, official = [*claims, (8000, 50_000, ["solo"], 1.0, 1.0, 1)], [(8500, 50_100, ["solo"], 1.0, 1.0, 0), *official]
    for batch in range(3):
        some = official[batch::3] + (far if batch == 2 else [])
        for _ in range(2):
            store = MatchStore(spark, str(tmp_path / "m"), fan=2)
            store.add(batch, spark.createDataFrame(claims[batch::3], SIDE), spark.createDataFrame(some, SIDE))
        seen = [o for b in range(batch + 1) for o in official[b::3]] + (far if batch == 2 else [])
        asked = [c for b in range(batch + 1) for c in claims[b::3]]
        assert sorted(map(tuple, store.matches().collect())) == brute(asked, seen)
    assert all(r["id"] != 8000 for r in store.matches().collect())
