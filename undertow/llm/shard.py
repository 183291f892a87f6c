"""Sharding by histogram sort: splitters are refined until exact, then one exchange."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from undertow.llm.common import arrow_schema, frozen

KEY_BITS = 63
SPREAD_BITS = 24


def sort_key() -> F.Column:
    """A key of 63 bits: 39 of a hash of the text, so that equal texts are neighbours, then 24 of one of doc_id,
    so that a group of copies however large can be cut anywhere."""
    text = F.shiftleft(F.shiftrightunsigned(F.xxhash64("text"), 25), SPREAD_BITS)
    return text.bitwiseOR(F.xxhash64(F.col("doc_id").cast("string"), F.lit(7)).bitwiseAND((1 << SPREAD_BITS) - 1))


def size() -> F.Column:
    return F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 1


def below(keys: DataFrame, probes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Exact bytes and rows with a key below each probe (sorted), counted in each partition, then added up."""
    edges = np.ascontiguousarray(probes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size, rows = np.zeros(len(edges) + 1), np.zeros(len(edges) + 1)
        for batch in batches:
            at = np.searchsorted(edges, batch.column(0).to_numpy(), "right")
            size += np.bincount(at, batch.column(1).to_numpy(), len(edges) + 1)
            rows += np.bincount(at, minlength=len(edges) + 1)
        used = np.flatnonzero(rows)
        yield pa.record_batch([pa.array(used), pa.array(size[used].astype(np.int64)), pa.array(rows[used].astype(np.int64))], names=["cell", "size", "n"])

    schema, _ = arrow_schema("cell long, size long, n long")
    total, rows = np.zeros(len(edges) + 1, np.int64), np.zeros(len(edges) + 1, np.int64)
    for r in keys.mapInArrow(run, schema).groupBy("cell").agg(F.sum("size").alias("size"), F.sum("n").alias("n")).collect():  # a row for each probe at most
        total[r["cell"]], rows[r["cell"]] = r["size"], r["n"]
    return np.cumsum(total)[:-1], np.cumsum(rows)[:-1]


def splitters(keys: DataFrame, parts: int, exact_every: int, tolerance: float, loose: float = 0.25, probes_a_round: int = 8192, rounds: int = 24) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys at which parts of nearly equal bytes start, with the bytes and rows before each.

    Each round counts the bytes below evenly spaced probes inside every open splitter's bracket, and narrows
    the bracket to the two around the target, until one of them is near enough, or no row lies between them:
    within tolerance of exact_every parts' bytes for each exact_every-th splitter, within loose of a part's
    for the others. Among the ends of a bracket that are near enough, one between two groups of equal texts
    is preferred. What reaches the driver is a number for each probe.
    """
    total = keys.agg(F.sum("size"), F.count("*")).first()
    if parts == 1 or not total[1]:
        return (np.zeros(0, np.int64),) * 3
    share = total[0] / parts
    number = np.arange(1, parts)
    target = share * number
    near_enough = np.where(number % exact_every == 0, tolerance * share * exact_every, loose * share)
    last = (1 << KEY_BITS) - 1
    low, high = np.zeros(parts - 1, np.int64), np.full(parts - 1, last, np.int64)
    low_size, low_rows = np.zeros(parts - 1, np.int64), np.zeros(parts - 1, np.int64)
    high_size, high_rows = np.full(parts - 1, total[0]), np.full(parts - 1, total[1])
    group = np.int64(1 << SPREAD_BITS)
    probes = np.arange(1, 1 << 13, dtype=np.int64) << KEY_BITS - 13
    for _ in range(rounds):
        size, rows = below(keys, probes - 1)  # a key below a probe is at most one less
        at = np.searchsorted(size, target, "right")
        for i, j in enumerate(at):
            if j > 0 and probes[j - 1] > low[i]:
                low[i], low_size[i], low_rows[i] = probes[j - 1], size[j - 1], rows[j - 1]
            if j < len(probes) and probes[j] < high[i]:
                high[i], high_size[i], high_rows[i] = probes[j], size[j], rows[j]
        open_ = (np.minimum(target - low_size, high_size - target) > near_enough) & (high - low > 1) & (high_rows - low_rows > 1)
        brackets = {(int(a), int(b)) for a, b in zip(low[open_], high[open_], strict=True)}
        if not brackets:
            break
        fan, found = max(16, probes_a_round // len(brackets)), []
        for a, b in brackets:
            inner = np.unique(np.array([a + (b - a) * k // fan for k in range(1, fan)], np.int64))
            aligned = np.unique(inner // group * group)  # between groups, as long as the bracket holds several
            aligned = aligned[aligned > a]
            found.append(aligned if len(aligned) else inner[inner > a])
        probes = np.unique(np.concatenate(found))
    low_error, high_error = target - low_size, high_size - target
    between = lambda x, error: (x % group == 0) & (error <= near_enough)
    take_high = np.where(between(high, high_error) & ~between(low, low_error), True, np.where(between(low, low_error) & ~between(high, high_error), False, high_error < low_error))
    return tuple(np.maximum.accumulate(np.where(take_high, a, b)) for a, b in ((high, low), (high_size, low_size), (high_rows, low_rows)))


def shard(docs: DataFrame, shards: int = 8, runs: int = 32, tolerance: float = 0.002, run_bytes: int = 64 << 20) -> DataFrame:
    """docs (doc_id, text) in shards of nearly equal bytes, in key order.

    Columns: doc_id, text, size (UTF-8 bytes and 1; null: 1), shard, slot (from 0 in each shard, without
    gaps, in key order), sort_key. Copies of a text are neighbours, and in one shard unless a cut within
    tolerance (a share of a shard's bytes) needs their group divided. Rows with the same doc_id and text have
    one key and stay together, whatever their number. Other columns are not read; an empty table stays empty, and
    texts of any length are one row each.

    Each shard is cut into runs runs, or more so that none has over about run_bytes: their number follows the input,
    and a task of the exchange sorts a run and never a whole shard. Keys and sizes are written once, narrow, and counted
    there; texts move once. Bytes that no refinement can even out within tolerance (a row larger than it, or more rows
    with one doc_id and text) are an error of that size in two shards and not of the operator.
    """
    rows = docs.select("doc_id", "text")
    keys = frozen(rows.select(sort_key().alias("key"), size().alias("size")))
    total = keys.agg(F.sum("size")).first()[0] or 0
    runs = max(runs, -(-total // (shards * run_bytes)))
    n = shards * runs
    cuts, _, before = splitters(keys, n, runs, tolerance)
    of_shard = np.arange(len(cuts) + 1) // runs
    starts = np.concatenate([[0], before])
    shard_starts = starts[::runs]
    sent = docs.sparkSession.sparkContext.broadcast((cuts, starts - shard_starts[of_shard]))  # two numbers a run

    @F.pandas_udf("run int, base long")
    def run_of(key: pd.Series) -> pd.DataFrame:
        edges, base = sent.value
        run = np.searchsorted(edges, key.to_numpy(), "right")
        return pd.DataFrame({"run": run.astype("int32"), "base": base[run]})

    placed = rows.withColumns({"sort_key": sort_key(), "size": size()}).withColumn("ut_run", run_of("sort_key"))
    order = W.partitionBy("ut_run.run").orderBy("sort_key", "doc_id", F.xxhash64("text"))
    slot = F.col("ut_run.base") + F.row_number().over(order) - 1
    return placed.select("doc_id", "text", "size", F.floor(F.col("ut_run.run") / runs).cast("int").alias("shard"), slot.alias("slot"), "sort_key")
