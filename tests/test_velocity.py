"""Velocity from summaries of runs against the plain series."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from undertow.config import D
from undertow.functions import series as S
from undertow.streaming.velocity import Moments, VelocityState, composed, repeated, run_of


def plain(x):
    e = [float(x[0])]
    for v in x[1:]:
        e.append(D.alpha * v + (1 - D.alpha) * e[-1])
    return e, [c - 2 * b + a for a, b, c in zip(e, e[1:], e[2:])]


def plain_z(x):
    *base, last = plain(x)[1]
    deviation = np.std(base)
    return (0.0 if abs(last) < D.eps else D.flat_z) if deviation < D.eps else (last - np.mean(base)) / deviation


@pytest.mark.parametrize("x", [[5.0] * 40, [0.0] * 20 + [1000.0] + [0.0] * 30, [float(i * i % 17) for i in range(50)], [1e6] * 30 + [1e6 + 1], [3.0] * 39 + [9.0]])
def test_runs_make_the_moments_of_all_bins(x):
    for cut in (8, 15):
        runs = [run_of(np.array([x[2:cut]]))[0], run_of(np.array([x[cut : len(x) - 1]]))[0]]
        for tried in (runs, [composed(*runs)]):
            moments = Moments(x[0], x[1])
            for run in tried:
                moments.run(run, 0)
            moments.n = len(x) - 3
            assert moments.z(x[-1]) == pytest.approx(plain_z(x), rel=1e-6, abs=1e-6)


def test_brackets_do_not_matter():
    a, b, c = run_of(np.random.default_rng(1).poisson(9, (3, 12)).astype(float))
    assert np.allclose(composed(composed(a, b), c), composed(a, composed(b, c)))
    assert np.allclose(repeated(a, 5), composed(a, composed(composed(a, a), composed(a, a)))) and repeated(a, 0) is None


def test_ewma_is_a_scan(spark):
    rng = random.Random(3)
    rows = [(i, [float(rng.choice([0, 0, 1, 50])) for _ in range(n)]) for i, n in enumerate([0, 1, 2, 3, 64, 65, 400])] + [(9, [7.0] * 100)]
    got = {r["i"]: r["e"] for r in spark.createDataFrame(rows, "i int, s array<double>").select("i", S.ewma(F.col("s")).alias("e")).collect()}
    for i, s in rows:
        assert got[i] == pytest.approx(plain(s)[0] if s else [], rel=1e-12, abs=1e-12)


def test_batches_late_and_repeated(spark, tmp_path):
    rng, hour = random.Random(5), 3600
    rows = [(rng.choice(["A", "b", "c"]), rng.randrange(0, 100 * hour)) for _ in range(900)] + [("a", 99 * hour + i) for i in range(50)] + [("quiet", 61 * hour), ("gone", 10), ("edge", 30 * hour + 5), (None, 5), ("a", None)]
    rng.shuffle(rows)  # so every batch but the first is late
    ddl = "entity string, ts long"
    for batch in range(5):
        for _ in range(2):  # each is taken twice
            state = VelocityState(spark, str(tmp_path / "v"), hour, 7, fan=3)
            state.add(batch, spark.createDataFrame(rows[batch::5], ddl))
    for since, until in ((0, 99), (30, 99), (41, 99), (30, 60), (88, 99), (90, 99)):
        counts = {}
        for entity, ts in rows:
            if entity and ts is not None and since * hour + 60 <= ts < (until + 1) * hour:
                counts.setdefault(entity.lower(), [0.0] * (until - since + 1))[ts // hour - since] += 1
        want = {e: plain_z(x) if len(x) >= D.min_buckets else 0.0 for e, x in counts.items()}
        got = {r["entity"]: r["velocity_z"] for r in state.z(since * hour, until * hour).collect()}
        assert got == pytest.approx(want, rel=1e-6, abs=1e-6), (since, until)
