"""Exact nearest neighbours by an index: blocks of vectors around centres, skipped where the triangle inequality allows."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from undertow.operators.graph import frozen

SLACK = 1e-9
PACK = "slot long, cell int, part int, ids array<{id}>, ts array<double>, asks array<boolean>, units binary, least array<double>, mean binary, radius double"


def _schema(ddl: str) -> tuple[T.StructType, pa.Schema]:
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = T._parse_datatype_string(ddl)
    return schema, to_arrow_schema(schema)


def centres(rows: DataFrame, cells: int, sample: int = 4096, rounds: int = 5) -> np.ndarray:
    """Up to cells unit vectors, the means of clusters of about sample rows (unit), which are all that the driver sees."""
    share = min(1.0, sample / max(1, rows.count()))
    some = rows.where(F.pmod(F.xxhash64("unit"), F.lit(1 << 30)) < int(share * (1 << 30))).select("unit").limit(4 * sample).collect()
    if not some:
        return np.zeros((0, 0))
    body = np.array(sorted(r["unit"] for r in some), float)
    at = body[:: max(1, len(body) // cells)][:cells]
    for _ in range(rounds):
        own = (body @ at.T).argmax(1)
        sums = np.stack([body[own == j].sum(0) if (own == j).any() else at[j] for j in range(len(at))])
        at = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-12)
    return at


def _best(queries, others, k: int, window_s: float, meets: Callable[[slice], np.ndarray] | None = None) -> Iterator[tuple[int, np.ndarray, np.ndarray, int]]:
    """(row of queries, rows of others, similarities, how many were compared) for each query: its up to k most similar earlier ones.

    Sums of products in bulk find who can be among them; of these the similarities are summed anew, the same for equal vectors.
    meets says which others some queries may be held against, if not all.
    """
    ids, ts, units, least = queries
    other_ids, other_ts, other_units = others
    places = {i: n for n, i in enumerate(sorted(set(ids) | set(other_ids)))}
    rank, other_rank = (np.array([places[i] for i in x], np.int64) for x in (ids, other_ids))
    for low in range(0, len(ids), 256):
        part = slice(low, low + 256)
        near = units[part] @ other_units.T
        then, now = other_ts[None, :], ts[part, None]
        fits = ((then < now) | (then == now) & (other_rank[None, :] < rank[part, None])) & (then >= now - window_s) & (near >= least[part, None] - SLACK)
        if meets is not None:
            fits &= meets(part)
        for i in range(near.shape[0]):
            at = np.flatnonzero(fits[i])
            n = len(at)
            if n > k:
                at = at[near[i, at] >= np.partition(near[i, at], n - k)[n - k] - SLACK]
            similarity = np.einsum("ij,j->i", other_units[at], units[low + i])
            order = np.lexsort([other_rank[at], -similarity])[:k]
            yield low + i, at[order], similarity[order], n


def nearest_indexed(items: DataFrame, known: DataFrame | None, k: int, window_s: int, cells: int | None = None, block: int = 2048, floor: float = -2.0) -> DataFrame:
    """id, neighbour, similarity, place of items (id, ts, unit) among themselves and known: see stories.nearest.

    Vectors are dealt out by slot of the window and nearest centre into blocks of about block rows, each with its mean and
    the radius around it. A query's k-th similarity in its own block is what another block must be able to beat: a vector
    of a block is no nearer than the query's distance to the mean less the radius. Only queries for which a block can travel
    to it, all those of a block as one row; until that is known, means and radii stand for vectors. A query with fewer than
    k earlier ones in its block looks into all, unless floor says from which similarity on neighbours are wanted; those
    below it are left out. Vectors are of one length. The centres decide where they lie, and no result.
    """
    kind = items.schema["id"].dataType.simpleString()
    rows = items.select("id", F.col("ts").cast("double").alias("ts"), "unit", F.floor(F.col("ts") / window_s).alias("slot"), F.lit(True).alias("asks"))
    if known is not None:
        rows = rows.unionByName(known.select("id", F.col("ts").cast("double").alias("ts"), "unit", F.floor(F.col("ts") / window_s).alias("slot"), F.lit(False).alias("asks")))
    rows = frozen(rows)
    schema, arrow = _schema(PACK.format(id=kind))
    if cells is None:  # so many that a cell of the fullest slot has some hundred rows
        fullest = rows.groupBy("slot").count().agg(F.max("count")).first()[0] or 0
        cells = min(256, max(1, fullest // 512))
    at = rows.sparkSession.sparkContext.broadcast(centres(rows, cells))

    @F.pandas_udf("int")
    def cell(units):
        import pandas as pd

        return pd.Series((np.stack(units.to_numpy()) @ at.value.T).argmax(1).astype(np.int32))

    placed = frozen(rows.withColumn("cell", cell("unit")))
    sizes = placed.groupBy("slot", "cell").agg(F.ceil(F.count("*") / block).alias("parts"))
    spread = placed.join(sizes, ["slot", "cell"]).withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))

    def pack(group: pa.Table) -> pa.Table:
        of = group.combine_chunks()
        ids, ts, asks = of["id"].to_pylist(), of["ts"].to_numpy(), of["asks"].to_numpy()
        units = of["unit"].combine_chunks().flatten().to_numpy().reshape(len(ids), -1)
        least = np.full(len(ids), floor)
        for i, rows_of, similarity, _ in _best((ids, ts, units, least), (ids, ts, units), k, window_s):
            if len(rows_of) == k:
                least[i] = max(floor, similarity[-1])
        mean = units.mean(0)
        radius = float(np.sqrt(((units - mean) ** 2).sum(1).max()))
        row = [of["slot"][:1], of["cell"][:1], of["part"][:1], [ids], [ts], [asks], [units.tobytes()], [least], [mean.tobytes()], [radius]]
        return pa.Table.from_arrays([pa.array(x.to_pylist() if isinstance(x, pa.ChunkedArray) else x, f.type) for x, f in zip(row, arrow, strict=True)], schema=arrow)

    packs = frozen(spread.select("slot", "cell", "part", "id", "ts", "asks", "unit").groupBy("slot", "cell", "part").applyInArrow(pack, schema))
    outlines = packs.groupBy(F.col("slot").alias("there")).agg(F.collect_list(F.struct("cell", "part", "mean", "radius", F.array_min("ts").alias("first"))).alias("outlines"))
    probe_schema, probe_arrow = _schema(f"there long, other_cell int, other_part int, ids array<{kind}>, ts array<double>, units binary, least array<double>")

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                asks = np.flatnonzero(row["asks"])
                if not len(asks):
                    continue
                units = np.frombuffer(row["units"]).reshape(len(row["ids"]), -1)[asks]
                ts, least = np.array(row["ts"])[asks], np.array(row["least"])[asks]
                reach = np.sqrt(np.maximum(0, 2 - 2 * least)) + SLACK  # distances that can still matter
                for line in row["outlines"]:
                    gap = np.sqrt(((units - np.frombuffer(line["mean"])) ** 2).sum(1)) - line["radius"]
                    hit = np.flatnonzero((gap <= reach) & (ts >= line["first"]))
                    if len(hit):
                        out = [[row["there"]], [line["cell"]], [line["part"]], [[row["ids"][asks[i]] for i in hit]], [ts[hit]], [units[hit].tobytes()], [least[hit]]]
                        yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(out, probe_arrow, strict=True)], schema=probe_arrow)

    both = packs.select("ids", "ts", "asks", "units", "least", F.explode(F.array("slot", F.col("slot") - 1)).alias("there"))
    probes = both.join(outlines, "there").select("ids", "ts", "asks", "units", "least", "there", "outlines").mapInArrow(probe, probe_schema)
    found_schema, found_arrow = _schema(f"id {kind}, neighbour {kind}, similarity double")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                units, others = (np.frombuffer(row[c]).reshape(len(row[i]), -1) for c, i in (("units", "ids"), ("other_units", "other_ids")))
                out: tuple[list, list, list] = [], [], []
                for i, rows_of, similarity, _ in _best((row["ids"], np.array(row["ts"]), units, np.array(row["least"])), (row["other_ids"], np.array(row["other_ts"]), others), k, window_s):
                    out[0].extend([row["ids"][i]] * len(rows_of))
                    out[1].extend(row["other_ids"][j] for j in rows_of)
                    out[2].extend(similarity.tolist())
                if out[0]:
                    yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(out, found_arrow, strict=True)], schema=found_arrow)

    other = packs.select(F.col("slot").alias("there"), F.col("cell").alias("other_cell"), F.col("part").alias("other_part"), F.col("ids").alias("other_ids"), F.col("ts").alias("other_ts"), F.col("units").alias("other_units"))
    tiles = probes.join(other, ["there", "other_cell", "other_part"])
    pairs = tiles.select("ids", "ts", "units", "least", "other_ids", "other_ts", "other_units").mapInArrow(compare, found_schema).where(F.col("similarity") >= floor)
    place = F.row_number().over(W.partitionBy("id").orderBy(F.desc("similarity"), "neighbour"))
    return pairs.withColumn("place", place).where(F.col("place") <= k)


def nearest_met(rows: DataFrame, k: int, window_s: int, floor: float, tables: int, bits: int, block: int = 2048) -> DataFrame:
    """id, neighbour, similarity: of rows (id, ts as double, embedding, norm, buckets: one a table, slot of the window) the
    earlier ones of the window that share a bucket with a row and are at least as similar as floor, k a row and tile at most.

    A vector travels to its own slot and to the one before, where it only asks, and not once for each of its buckets: these
    go with it and are compared there. A slot of more than block rows is dealt out in parts of about block, each two of which
    are a tile; one so full that its parts are more than the tables is dealt out by bucket before. So a vector travels a few
    times, and at most about twice a bucket if no bucket is crowded; no task holds more than a tile. A pair that shares
    several buckets meets in the first.
    """
    kind = rows.schema["id"].dataType.simpleString()
    columns = ["there", "bucket", "a", "b", "id", "ts", "embedding", "norm", "buckets", "asks", "known"]
    here = F.col("slot") == F.col("there")
    both = rows.select("*", F.explode(F.array("slot", F.col("slot") - 1)).alias("there"))
    whole = lambda df: df.select("*", F.lit(-1).cast("long").alias("bucket"), F.lit(0).cast("long").alias("a"), F.lit(0).cast("long").alias("b"), F.lit(True).alias("asks"), here.alias("known")).select(columns)
    crowded = frozen(rows.groupBy(F.col("slot").alias("there")).agg(F.count("*").alias("n")).where(F.col("n") > block))
    if crowded.isEmpty():
        tiles = whole(both)
    else:
        cells = F.when(F.col("n") > block * tables, F.col("buckets").cast("array<long>")).otherwise(F.array(F.lit(-1).cast("long")))
        dealt = both.join(crowded, "there").withColumn("bucket", F.explode(cells))
        sizes = frozen(dealt.groupBy("there", "bucket").agg(F.ceil(F.count("*") / block).alias("parts")))
        parted = dealt.join(sizes, ["there", "bucket"]).withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")))
        other = parted.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
        same = F.col("part") == F.col("other")
        asking = other.select("*", F.col("part").alias("a"), F.col("other").alias("b"), F.lit(True).alias("asks"), (here & same).alias("known"))
        known = other.where(here & ~same).select("*", F.col("other").alias("a"), F.col("part").alias("b"), F.lit(False).alias("asks"), F.lit(True).alias("known"))
        tiles = whole(both.join(crowded, "there", "left_anti")).union(asking.select(columns)).union(known.select(columns))
    schema, arrow = _schema(f"id {kind}, neighbour {kind}, similarity double")

    def compare(tile: pa.Table) -> pa.Table:
        of = tile.combine_chunks()
        asks, known = (np.flatnonzero(of[c].to_numpy()) for c in ("asks", "known"))
        out: tuple[list, list, list] = [], [], []
        if len(asks) and len(known):
            ids, ts = of["id"].to_pylist(), of["ts"].to_numpy()
            flat = lambda c: of[c].combine_chunks().flatten().to_numpy().reshape(len(ids), -1)
            units, buckets, bucket = flat("embedding").astype(float) / of["norm"].to_numpy()[:, None], flat("buckets"), of["bucket"][0].as_py()

            def meets(part: slice) -> np.ndarray:
                shared = buckets[asks[part], None] == buckets[None, known]
                return shared.any(2) if bucket < 0 else shared.any(2) & (shared.argmax(2) == bucket >> bits)

            own = lambda at: ([ids[i] for i in at], ts[at], units[at])
            others = own(known)
            for i, rows_of, similarity, _ in _best((*own(asks), np.full(len(asks), floor)), others, k, window_s, meets):
                out[0].extend([ids[asks[i]]] * len(rows_of))
                out[1].extend(others[0][j] for j in rows_of)
                out[2].extend(similarity.tolist())
        return pa.Table.from_arrays([pa.array(x, f.type) for x, f in zip(out, arrow, strict=True)], schema=arrow)

    return tiles.groupBy("there", "bucket", "a", "b").applyInArrow(compare, schema).where(F.col("similarity") >= floor)
