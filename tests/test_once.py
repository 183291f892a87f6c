"""Inserts that a Bloom filter prunes."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from undertow.operators.once import OnceStore


def rows(spark, first, last):
    return spark.range(first, last).select(F.col("id"), F.timestamp_seconds(F.col("id") * 60).alias("at"), F.lit("x").alias("bits"))


@pytest.mark.parametrize("blocks", [1, 64])
def test_each_key_once(spark, tmp_path, blocks):
    """Also where the filter is far too small, and lets nearly all through."""
    store = OnceStore(spark, str(tmp_path / "t"), ("id",), "at", blocks, fan=2)
    assert store.rows() is None and store.add(0, rows(spark, 0, 30_000).union(rows(spark, 0, 10))) == 0
    assert store.add(0, rows(spark, 0, 5)) is None
    looked = store.add(1, rows(spark, 30_000, 40_000))
    assert looked < (300 if blocks == 64 else 10_001)
    looked = store.add(2, rows(spark, 39_000, 41_000))
    assert 1000 <= looked < (1100 if blocks == 64 else 2001)  # none that is there is ruled out
    store.add(3, spark.createDataFrame([(None, None, "x")], store.rows().schema))
    store.add(4, rows(spark, 0, 0))
    got = OnceStore(spark, str(tmp_path / "t"), ("id",), "at", blocks).rows()
    assert got.columns == ["id", "at", "bits"] and got.count() == got.select("id").distinct().count() == 41_000
