"""Exact top-k inner products by pivot-table elimination."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from undertow.llm.common import arrow_schema, frozen

#: From this squared norm on double precision no longer holds every inner product, and those rows are compared without bounds.
EXACT = 2.0**52
NOTHING = -(2**63)


def scaled(vectors: DataFrame, scale: int) -> DataFrame:
    """vec_id and values, floor(scale * component) as longs, of the rows whose inner products all fit in a long."""
    x = F.col("embedding")
    fine = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float(2**31) / scale))
    rows = vectors.select("vec_id", "embedding").where(F.coalesce(x.isNotNull() & fine, F.lit(False)))
    whole = rows.select("vec_id", F.transform("embedding", lambda v: F.floor(F.lit(scale) * v.cast("double"))).alias("values"))
    return whole.where(F.aggregate("values", F.lit(0.0), lambda s, v: s + v.cast("double") * v.cast("double")) < 2.0**62)


def chosen(rows: DataFrame, pivots: int, sample: int) -> dict[int, np.ndarray]:
    """For each length of vectors up to pivots of them that lie far apart, from about sample rows (all, if there are fewer).

    The sample is taken by a hash of the vector and is the only part of the rows that reaches the driver. A length that it
    misses has no pivots, so that its vectors are compared without bounds. The first pivot is the longest vector, each
    further one the farthest from those before.
    """
    share = min(1.0, sample / max(1, rows.count()))
    some = rows.where(F.pmod(F.xxhash64("values"), F.lit(1 << 30)) < int(share * (1 << 30))).select("values").distinct().limit(4 * sample).collect()
    found: dict[int, list] = {}
    for (values,) in sorted(some):
        found.setdefault(len(values), []).append(values)
    out = {}
    for dim, rows_of in found.items():
        body = np.array(rows_of, float).reshape(len(rows_of), dim)
        at = [int((body**2).sum(1).argmax())]
        near = ((body - body[at[0]]) ** 2).sum(1)
        while len(at) < min(pivots, len(body)) and near.max() > 0:
            at.append(int(near.argmax()))
            near = np.minimum(near, ((body - body[at[-1]]) ** 2).sum(1))
        out[dim] = body[at]
    return out


def tabled(rows: DataFrame, pivots: dict[int, np.ndarray]) -> DataFrame:
    """rows (vec_id, n, query, candidate, values) with dim, cell (the nearest pivot), far (distances to all pivots) and body (values), as bytes."""
    sent = rows.sparkSession.sparkContext.broadcast(pivots)
    schema, arrow = arrow_schema(f"vec_id {rows.schema['vec_id'].dataType.simpleString()}, n int, query boolean, candidate boolean, dim int, cell int, far binary, body binary")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(4)
            sizes = np.diff(lists.offsets.to_numpy())
            for dim in np.unique(sizes).tolist():
                part = batch.filter(pa.array(sizes == dim))
                body = part.column(4).flatten().to_numpy().reshape(part.num_rows, dim)
                at = sent.value.get(dim, np.zeros((0, dim)))
                far = np.stack([np.sqrt(((body - p) ** 2).sum(1)) for p in at], 1) if len(at) else np.zeros((len(body), 0))
                cell = far.argmin(1) if len(at) else np.zeros(len(body))
                cells, dims = pa.array(cell.astype(np.int32)), pa.array(np.full(len(body), dim, np.int32))
                yield pa.RecordBatch.from_arrays([*(part.column(i) for i in range(4)), dims, cells, packed(far), packed(body)], schema=arrow)

    return rows.select("vec_id", "n", "query", "candidate", "values").mapInArrow(run, schema)


def packed(rows: np.ndarray) -> pa.Array:
    return pa.array([row.tobytes() for row in rows], pa.binary())


def matrix(column: pa.Array, kind: type) -> np.ndarray:
    """Rows of equally many values, from their bytes."""
    data = b"".join(column.to_pylist())
    return np.frombuffer(data, kind).reshape(len(column), -1)


class Side:
    """Vectors as a tile compares them: ids, pivot distances, values, squared norms."""

    def __init__(self, ids: list, far: np.ndarray, body: np.ndarray):
        self.ids, self.far, self.body = ids, far, body
        self.squares = (body.astype(float) ** 2).sum(1)
        self.wide = bool(len(body)) and self.squares.max() >= EXACT
        self.values = body if self.wide else body.astype(float)

    @classmethod
    def of(cls, ids: pa.Array, far: bytes, body: bytes) -> Side:
        return cls(ids.to_pylist(), np.frombuffer(far).reshape(len(ids), -1), np.frombuffer(body, np.int64).reshape(len(ids), -1))


def bounds(query: Side, other: Side, some: slice) -> np.ndarray:
    """The most that the inner products of some queries with all of other can be.

    An inner product is half of what two squared norms exceed the squared distance by, and the distance is at least the
    greatest difference of the two's distances to one pivot.
    """
    if query.wide or other.wide:
        return np.full((len(query.squares[some]), len(other.ids)), np.inf)
    least = np.zeros((len(query.squares[some]), len(other.ids)))
    for a, b in zip(query.far[some].T, other.far.T, strict=True):
        np.maximum(least, np.abs(a[:, None] - b[None, :]), out=least)
    sums = query.squares[some][:, None] + other.squares[None, :]
    return (sums - least**2) / 2 + (1 + sums * 1e-9)


def best(query: Side, other: Side, counts: np.ndarray, k: int, least: list[int]) -> Iterator[tuple[int, list[tuple[int, int]], int]]:
    """(query, its up to k highest (score, row of other), how many rows of other were compared), scores below least left out.

    The rows of other are compared in the order of their bounds, until k scores are above the next bound. A row that stands
    for several (counts) counts as so many. A row with the query's own id is left out.
    """
    names = np.array([hash(i) for i in other.ids], np.int64) if len(other.ids) else np.zeros(0, np.int64)
    for low in range(0, len(query.ids), 64):
        upper = bounds(query, other, slice(low, low + 64))
        for i, row in enumerate(upper, low):
            own = query.ids[i]
            at = np.flatnonzero(row >= least[i])
            at = at[np.argsort(-row[at], kind="stable")]
            if own is not None:
                same = names[at] == hash(own)
                if same.any():
                    at = at[[not (s and other.ids[j] == own) for s, j in zip(same.tolist(), at.tolist(), strict=True)]]
            kept: list[tuple[int, int]] = []
            kth, done, step = least[i], 0, 32
            while done < len(at) and not row[at[done]] < kth:
                part = at[done : done + step]
                scores = other.values[part] @ query.values[i]
                good = scores >= kth
                kept += zip(scores[good].astype(np.int64).tolist(), part[good].tolist(), strict=True)
                done, step = done + len(part), min(2 * step, 1024)
                kept, kth = highest(kept, other.ids, counts, k, kth)
            yield i, kept, done


def highest(kept: list[tuple[int, int]], ids: list, counts: np.ndarray, k: int, kth: int) -> tuple[list[tuple[int, int]], int]:
    """The first of kept, in order of score and then id, that make up k rows, and the k-th one's score (else kth)."""
    kept.sort(key=lambda x: (-x[0], ids[x[1]] is None, ids[x[1]] or 0))
    n = 0
    for i, (score, j) in enumerate(kept):
        n += int(counts[j])
        if n >= k:
            return kept[: i + 1], max(kth, score)
    return kept, kth


def blocks(rows: DataFrame, size: int, k: int) -> DataFrame:
    """dim, cell, part, and of each block of about size rows of one cell its candidates and its queries, packed.

    The queries bring with them the k-th highest score within their own block, which theirs of all rows can't be below.
    """
    counts = rows.groupBy("dim", "cell").agg(F.count("*").alias("rows"))
    spread = rows.join(frozen(counts), ["dim", "cell"]).withColumn("part", F.pmod(F.xxhash64("vec_id", "body"), F.ceil(F.col("rows") / size)).cast("int")).drop("rows")
    kind = rows.schema["vec_id"].dataType.simpleString()
    schema, arrow = arrow_schema(f"dim int, cell int, part int, ids array<{kind}>, counts array<int>, far binary, body binary, qids array<{kind}>, qfar binary, qbody binary, qleast array<long>")

    def pack(group: pa.Table) -> pa.Table:
        block = group.combine_chunks().to_batches()[0]
        of = {name: block.column(name) for name in block.schema.names}
        far, body = matrix(of["far"], np.float64), matrix(of["body"], np.int64)
        rows, asks = (np.flatnonzero(of[name].to_numpy(zero_copy_only=False)) for name in ("candidate", "query"))
        ids, qids = of["vec_id"].take(pa.array(rows)), of["vec_id"].take(pa.array(asks))
        counts = of["n"].take(pa.array(rows))
        query, other = Side(qids.to_pylist(), far[asks], body[asks]), Side(ids.to_pylist(), far[rows], body[rows])
        least = [NOTHING] * len(qids)
        multiple = counts.to_numpy()
        for i, kept, _ in best(query, other, multiple, k, least):
            if sum(int(multiple[j]) for _, j in kept) >= k:
                least[i] = kept[-1][0]
        row = [block.column("dim")[:1], block.column("cell")[:1], block.column("part")[:1], [ids.to_pylist()], [counts.to_pylist()], [far[rows].tobytes()], [body[rows].tobytes()], [qids.to_pylist()], [far[asks].tobytes()], [body[asks].tobytes()], [least]]
        return pa.Table.from_batches([pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x, f.type) for x, f in zip(row, arrow, strict=True)], schema=arrow)])

    return spread.groupBy("dim", "cell", "part").applyInArrow(pack, schema)


def chunks(found: DataFrame, together: int) -> DataFrame:
    """dim, cell, chunk, qids, qfar, qbody, qleast: the queries of together blocks of a cell as one row."""
    asks = found.where(F.size("qids") > 0).select("dim", "cell", F.floor(F.col("part") / together).cast("int").alias("chunk"), "qids", "qfar", "qbody", "qleast")
    schema, arrow = arrow_schema(", ".join(f"{f.name} {f.dataType.simpleString()}" for f in asks.schema))

    def join(group: pa.Table) -> pa.Table:
        of = group.to_pydict()
        row = [of["dim"][:1], of["cell"][:1], of["chunk"][:1], [sum(of["qids"], [])], [b"".join(of["qfar"])], [b"".join(of["qbody"])], [sum(of["qleast"], [])]]
        return pa.Table.from_arrays([pa.array(x, f.type) for x, f in zip(row, arrow, strict=True)], schema=arrow)

    return asks.groupBy("dim", "cell", "chunk").applyInArrow(join, schema)


def outlines(found: DataFrame, together: int) -> DataFrame:
    """dim, sheet, cells, parts, low, high, most: of about together blocks, the least and greatest pivot distances and the greatest squared norm."""
    schema, arrow = arrow_schema("dim int, cell int, part int, low binary, high binary, most double")

    def outline(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                dim, cell, part, ids, far, body = (batch.column(j)[i] for j in range(6))
                side = Side.of(ids.values, far.as_py(), body.as_py())
                row = [dim, cell, part, side.far.min(0).tobytes(), side.far.max(0).tobytes(), np.inf if side.wide else side.squares.max()]
                yield pa.RecordBatch.from_arrays([pa.array([x.as_py() if isinstance(x, pa.Scalar) else x], f.type) for x, f in zip(row, arrow, strict=True)], schema=arrow)

    rows = frozen(found.where(F.size("ids") > 0).select("dim", "cell", "part", "ids", "far", "body").mapInArrow(outline, schema))
    sheets = rows.groupBy("dim").agg(F.ceil(F.count("*") / together).cast("int").alias("sheets"))
    spread = rows.join(sheets, "dim").withColumn("sheet", F.pmod(F.xxhash64("cell", "part"), F.col("sheets")).cast("int"))
    one = F.struct("cell", "part", "low", "high", "most")
    return spread.groupBy("dim", "sheet", "sheets").agg(F.collect_list(one).alias("outlines"))


def probes(asks: DataFrame, sheets: DataFrame) -> DataFrame:
    """dim, qcell, chunk, cell, part: the blocks that a chunk must look into, as one of its queries can find a score there."""
    schema, arrow = arrow_schema("dim int, qcell int, chunk int, cell int, part int")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                dim, cell, chunk, qids, qfar, qbody, qleast, lines = (batch.column(j)[i] for j in range(8))
                query, least = Side.of(qids.values, qfar.as_py(), qbody.as_py()), np.array(qleast.as_py(), float)
                hits = []
                for line in lines.as_py():
                    low, high = np.frombuffer(line["low"]), np.frombuffer(line["high"])
                    gap = np.maximum(0, np.maximum(low - query.far, query.far - high)).max(1, initial=0)
                    sums = query.squares + line["most"]
                    if query.wide or ((sums - gap**2) / 2 + 1 + sums * 1e-9 >= least).any():
                        hits.append(line)
                if hits:
                    row = [[dim.as_py()] * len(hits), [cell.as_py()] * len(hits), [chunk.as_py()] * len(hits), [h["cell"] for h in hits], [h["part"] for h in hits]]
                    yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(row, arrow, strict=True)], schema=arrow)

    counts = sheets.groupBy("dim").agg(F.max("sheets").alias("sheets"))
    each = asks.join(counts, "dim").withColumn("sheet", F.explode(F.sequence(F.lit(0), F.col("sheets") - 1)))
    met = each.join(sheets.select("dim", "sheet", "outlines"), ["dim", "sheet"])
    return met.select("dim", "cell", "chunk", "qids", "qfar", "qbody", "qleast", "outlines").mapInArrow(run, schema)


def compared(tiles: DataFrame, kind: str, k: int) -> DataFrame:
    """query_id, query_key, vec_id, score, n of every tile's highest scores, and compared: over how many rows they were found."""
    schema, arrow = arrow_schema(f"query_id {kind}, query_key binary, vec_id {kind}, score long, n int, compared long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                qids, qfar, qbody, qleast, ids, counts, far, body = (batch.column(j)[i] for j in range(8))
                query, other = Side.of(qids.values, qfar.as_py(), qbody.as_py()), Side.of(ids.values, far.as_py(), body.as_py())
                if other.wide != query.wide:
                    query.values, other.values = query.body, other.body
                multiple = counts.values.to_numpy()
                out: list[tuple] = []
                for q, kept, n in best(query, other, multiple, k, qleast.as_py()):
                    key = query.body[q].tobytes()
                    out += [(query.ids[q], key, other.ids[j], score, int(multiple[j]), n * (first == 0)) for first, (score, j) in enumerate(kept)]
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(list(x), f.type) for x, f in zip(zip(*out, strict=True), arrow, strict=True)], schema=arrow)

    return tiles.select("qids", "qfar", "qbody", "qleast", "ids", "counts", "far", "body").mapInArrow(run, schema)


def top_products(vectors: DataFrame, queries: Column, k: int = 5, scale: int = 256, pivots: int = 32, block: int = 4096, sample: int = 4096) -> DataFrame:
    """query_id, rank (from 1), vec_id and score: for every row of vectors (vec_id, embedding) for which queries (a condition on
    vec_id) holds, the k other rows with the highest inner products, all if there are fewer; of equal ones those with smaller vec_id.

    Components x count as floor(scale * x), x as a double, and scores are their exact integer inner products. A vector that
    is null, or holds a null or non-finite component, or is so long that products would not fit in a long (2**31 in a scaled
    component or 2**62 in their squares), takes no part. Vectors are compared with those of equal length only. Rows with the
    query's own vec_id are not its candidates. Rows that repeat are candidates each; as queries they are answered once, and so
    is each of several vectors of one vec_id. Rows without vec_id are candidates and come last among equals. An empty table
    gives none, other columns are not read.

    Every vector's distances to the pivots are written beside it. A pair's distance is at least the greatest difference of
    the two's distances to one pivot, which bounds its inner product. Vectors are dealt out in blocks by their nearest
    pivot. A query's k-th score in its own block decides which blocks it must look into at all, and there it compares rows in
    the order of their bounds until none can be higher. Of vectors that are equal only the k + 1 first by vec_id travel, as
    no query returns more; equal rows travel as one with a count, so copies cost nothing however many there are.
    """
    kind = vectors.schema["vec_id"].dataType.simpleString()
    rows = frozen(scaled(vectors, scale).groupBy("vec_id", "values").agg(F.least(F.count("*"), F.lit(k)).cast("int").alias("n")))
    first = F.row_number().over(W.partitionBy("values").orderBy(F.col("vec_id").asc_nulls_last()))
    candidates = rows.withColumn("place", first).where(F.col("place") <= k + 1).select("vec_id", "n", F.lit(False).alias("query"), F.lit(True).alias("candidate"), "values")
    asking = rows.where(queries).select("vec_id", "n", F.lit(True).alias("query"), F.lit(False).alias("candidate"), "values")
    table = frozen(tabled(candidates.union(asking), chosen(rows, pivots, sample)))
    found = frozen(blocks(table, block, k))
    asks = frozen(chunks(found, 12))
    hits = probes(asks, frozen(outlines(found, 1024)))
    tiles = hits.join(asks.withColumnRenamed("cell", "qcell"), ["dim", "qcell", "chunk"]).join(found.select("dim", "cell", "part", "ids", "counts", "far", "body"), ["dim", "cell", "part"])
    scores = compared(tiles, kind, k)
    each = scores.withColumn("copy", F.explode(F.sequence(F.lit(1), "n")))
    rank = F.row_number().over(W.partitionBy("query_id", "query_key").orderBy(F.desc("score"), F.col("vec_id").asc_nulls_last()))
    return each.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


#: The result of top_products(embeddings, vec_id % 50 = 0).
SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.vec_id AS query_id, b.vec_id, CAST(list_dot_product(a.e, b.e) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.vec_id IS DISTINCT FROM b.vec_id AND len(a.e) = len(b.e)),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 5
"""
