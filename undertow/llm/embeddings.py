"""Near-duplicate vectors by a subspace pigeonhole join."""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from undertow.llm.common import arrow_schema, components, frozen

SLACK = 1e-6


def rotation(dim: int, seed: int = 11) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(seed).normal(size=(dim, dim)))
    return q * np.sign(np.diag(r))


class Grid:
    """Where the blocks of a unit vector fall, for links of at least a cosine.

    A cosine of at least c is a squared distance of at most 2 - 2c. Of the blocks of a rotated vector, one
    holds at most its proportional share of it. In that block two linked vectors are within radius, so their
    cells, whose sides are cell radii long, are the same or neighbours in the first axes of the block.
    """

    def __init__(self, dim: int, least: float, block: int = 8, axes: int = 3, cell: float = 3.0):
        self.rotation = rotation(dim)
        self.edges = [*range(0, dim, min(block, dim)), dim]
        self.budgets = [(2 - 2 * least) * (b - a) / dim + SLACK for a, b in zip(self.edges, self.edges[1:], strict=False)]
        self.axes, self.cell, self.least = axes, cell, least

    def turned(self, vectors: np.ndarray) -> np.ndarray:
        vectors = sized(vectors)
        unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
        return unit @ self.rotation

    def cells(self, turned: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(block, row, cell as a hash): every row's own cell, and those neighbours behind it in order that its ball meets.

        Two linked vectors in different cells each meet the other's; that of the one in front is enough.
        """
        for block, (a, b) in enumerate(zip(self.edges, self.edges[1:], strict=False)):
            radius = self.budgets[block] ** 0.5
            width = self.cell * radius
            part = turned[:, a : min(b, a + self.axes)]
            own = np.floor(part / width).astype(np.int64)
            low, high = part - own * width < radius, (own + 1) * width - part < radius
            for step in itertools.product((0, -1, 1), repeat=part.shape[1]):
                if step < (0,) * len(step):
                    continue
                meets = np.ones(len(part), bool)
                for axis, s in enumerate(step):
                    if s:
                        meets &= low[:, axis] if s < 0 else high[:, axis]
                rows = np.flatnonzero(meets)
                if len(rows):
                    yield block, rows, hashed(own[rows] + np.array(step), block), np.full(len(rows), any(step))

    def first_block(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The first block in which each pair is within budget, in which alone it counts."""
        fits = np.stack([((a[:, x:y] - b[:, x:y]) ** 2).sum(1) <= budget for x, y, budget in zip(self.edges, self.edges[1:], self.budgets, strict=False)], 1)
        return fits.argmax(1)


def sized(vectors: np.ndarray) -> np.ndarray:
    """Each vector times the power of two that takes its largest component to 0.5 to 1, so that no square over- or underflows."""
    return np.ldexp(vectors, -np.frexp(np.abs(vectors).max(1, keepdims=True, initial=0))[1])


def hashed(cells: np.ndarray, block: int) -> np.ndarray:
    mix, out = np.uint64(0x9E3779B97F4A7C15), np.full(len(cells), block + 1, np.uint64)
    for i in range(cells.shape[1]):
        out = (out ^ cells[:, i].astype(np.uint64)) * mix
        out ^= out >> np.uint64(31)
    return out.view(np.int64)


def usable() -> F.Column:
    """Whether label and embedding allow links: neither null, no null or non-finite component, not all zero."""
    fine = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(F.col("label").isNotNull() & fine & F.exists("embedding", lambda x: x != 0), F.lit(False))


def spread(vectors: DataFrame, grid: Grid, bodies: bool) -> DataFrame:
    """label, block, cell, guest, vid, copies, body: each distinct vector in its own cell and, as a guest, in others it meets.

    Without bodies, body is empty.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                part = batch.slice(at, 2048)
                values = part.column(3).flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, -1)
                body = [row.tobytes() for row in values] if bodies else [b""] * len(values)
                labels, vids, copies, body = part.column(0), part.column(1), part.column(2), pa.array(body, pa.binary())
                for block, rows, cell, guest in grid.cells(grid.turned(values.astype(float))):
                    take = pa.array(rows)
                    yield pa.RecordBatch.from_arrays([labels.take(take), pa.array(np.full(len(rows), block, np.int32)), pa.array(cell), pa.array(guest), vids.take(take), copies.take(take), body.take(take)], schema=arrow)

    kind = vectors.schema["label"].dataType.simpleString()
    schema, arrow = arrow_schema(f"label {kind}, block int, cell long, guest boolean, vid long, copies long, body binary")
    return vectors.mapInArrow(run, schema)


def tiled(rows: DataFrame, crowded: DataFrame, most: int) -> DataFrame:
    """rows with a tile: cells of more than most vectors are cut into parts, and every two parts meet in one tile.

    A tile holds at most about two parts, so no task holds a crowded cell; a pair of vectors of one part is
    left to the tile of that part with itself.
    """
    spot = ["label", "block", "cell"]
    if crowded.isEmpty():
        joined = rows.withColumn("parts", F.lit(1))
    else:
        joined = rows.join(crowded.select(*spot, F.ceil(F.col("n") / most).cast("int").alias("parts")), spot, "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    own = F.pmod(F.xxhash64("vid", "guest"), F.col("parts")).cast("int")
    tiles = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda i: F.least(i, F.col("part")) * F.col("parts") + F.greatest(i, F.col("part")))
    return joined.withColumn("part", own).withColumn("tile", F.explode(tiles)).select("label", "block", "cell", "tile", "parts", "part", "guest", "vid", "copies", "body")


def verified(rows: DataFrame, grid: Grid, kind: str) -> DataFrame:
    """a, b, n: for each tile, links that connect what it links (n is 0), and to how many vectors each one is linked (a = b)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[pa.RecordBatch] = []  # parts of one tile, the last one met
        for batch in batches:
            if not batch.num_rows:
                continue
            if waiting and any(waiting[-1].column(i)[-1] != batch.column(i)[0] for i in range(4)):
                yield from out(waiting)
                waiting = []
            changes = np.zeros(batch.num_rows - 1, bool)
            for column in batch.columns[:4]:
                changes |= pc.not_equal(column[1:], column[:-1]).to_numpy(zero_copy_only=False)
            cuts = [0, *(np.flatnonzero(changes) + 1).tolist(), batch.num_rows]
            for low, high in zip(cuts[:-1], cuts[1:], strict=True):
                if low:
                    yield from out(waiting)
                    waiting = []
                waiting.append(batch.slice(low, high - low))
        yield from out(waiting)

    def out(waiting: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if sum(part.num_rows for part in waiting) < 2:
            return
        block, tile, parts = (waiting[0].column(i)[0].as_py() for i in (1, 3, 4))
        part, guest, vids, copies = (np.concatenate([w.column(i).to_numpy(zero_copy_only=False) for w in waiting]) for i in (5, 6, 7, 8))
        raw = sized(np.concatenate([bodies(w.column(9)) for w in waiting]).astype(float))
        unit = raw / np.linalg.norm(raw, axis=1, keepdims=True)
        turned = unit @ grid.rotation
        a, b = grid.edges[block], grid.edges[block + 1]
        own = turned[:, a:b]
        squares = (own**2).sum(1)
        across = tile // parts != tile % parts
        degree = np.zeros(len(vids), np.int64)
        root = np.arange(len(vids))
        forest_a, forest_b = [], []

        def find(x: int) -> int:
            while root[x] != x:
                root[x] = root[root[x]]
                x = root[x]
            return x

        for low in range(0, len(vids), 512):
            rest = slice(low, len(vids))
            near = squares[low : low + 512, None] + squares[None, rest] - 2 * own[low : low + 512] @ own[rest].T <= grid.budgets[block] + SLACK
            i, j = np.nonzero(near)
            keep = (j > i) & ~(guest[low + i] & guest[low + j]) & (vids[low + i] != vids[low + j])
            if across:
                keep &= part[low + i] != part[low + j]
            i, j = low + i[keep], low + j[keep]
            for at in range(0, len(i), 1 << 16):
                x, y = i[at : at + (1 << 16)], j[at : at + (1 << 16)]
                linked = cosines(raw[x], raw[y]) >= grid.least
                x, y = x[linked], y[linked]
                first = grid.first_block(turned[x], turned[y]) == block
                x, y = x[first], y[first]
                np.add.at(degree, x, copies[y])
                np.add.at(degree, y, copies[x])
                for p, q in zip(x.tolist(), y.tolist(), strict=True):
                    p, q = find(p), find(q)
                    if p != q:
                        root[max(p, q)] = min(p, q)
                        forest_a.append(p)
                        forest_b.append(q)
        some = np.flatnonzero(degree)
        a = np.concatenate([vids[some], vids[np.array(forest_a, np.int64)]])
        b = np.concatenate([vids[some], vids[np.array(forest_b, np.int64)]])
        n = np.concatenate([degree[some], np.zeros(len(forest_a), np.int64)])
        if len(a):
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(n)], schema=arrow)

    def bodies(column: pa.Array) -> np.ndarray:
        """Vectors of one length, from their bytes one after the other."""
        column = column.cast(pa.large_binary())
        offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
        return np.frombuffer(column.buffers()[2], np.uint8)[offsets[0] : offsets[-1]].view(kind).reshape(len(column), -1)

    schema, arrow = arrow_schema("a long, b long, n long")
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spot = ["label", "block", "cell", "tile"]
    return rows.repartition(n, *spot).sortWithinPartitions(*spot).mapInArrow(run, schema)


def cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cosines in double precision, by the same sums whatever the pair's order."""
    return np.einsum("ij,ij->i", a, b) / (np.sqrt(np.einsum("ij,ij->i", a, a)) * np.sqrt(np.einsum("ij,ij->i", b, b)))


def near_duplicates(vectors: DataFrame, least: float = 0.98, most: int = 4096) -> DataFrame:
    """vec_id, n_links, component_id and kept of every row of vectors (vec_id, embedding, label; nothing else is read).

    Two vectors are linked if their labels are equal and their cosine, in double precision, is at least
    least. One that is null, empty, all zero, or holds a null or non-finite component, or whose label is
    null, is linked with none; so are vectors of unlike lengths. component_id is the smallest vec_id that
    links reach and kept says that it is the row's own. Equal vectors are joined as one that counts for
    all, so copies, and rows that repeat, cost no pairs. Rows without vec_id are linked but name no component
    unless all of it lacks one (then null, and not kept). Vectors of any length are read whole; an empty table gives none.
    """
    rows = vectors.select("vec_id", "label", "embedding")
    for seed in itertools.count():  # again in the rare case that two vectors have one hash
        own = F.when(usable(), F.xxhash64(F.lit(seed), "label", "embedding")).alias("vid")
        found = rows.select("vec_id", "label", "embedding", own).where("vid is not null").groupBy("label", "vid").agg(F.min("embedding").alias("embedding"), F.max("embedding").alias("other"), F.count("*").alias("copies"), F.min("vec_id").alias("first"))
        distinct = frozen(found.withColumn("other", F.col("other") != F.col("embedding")))
        if distinct.where("other").isEmpty():
            break
    marked = frozen(rows.select("vec_id", own))
    distinct = distinct.drop("other")
    kind = "<f4" if "float" in vectors.schema["embedding"].dataType.simpleString() else "<f8"
    found = None
    for (dim,) in distinct.select(F.size("embedding")).distinct().collect():  # as a rule one
        grid = Grid(dim, least)
        some = distinct.where(F.size("embedding") == dim).select("label", "vid", "copies", "embedding")
        crowded = frozen(spread(some, grid, False).groupBy("label", "block", "cell").agg(F.count("*").alias("n")).where(F.col("n") > most))
        part = verified(tiled(spread(some, grid, True), crowded, most), grid, kind)
        found = part if found is None else found.union(part)
    plain = [F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id")]
    if found is None:
        out = marked.select("vec_id", *plain)
    else:
        found = frozen(found)
        degrees = found.where("a = b").groupBy(F.col("a").alias("vid")).agg(F.sum("n").alias("n"))
        roots = components(found.where("a <> b").select("a", "b")).withColumnRenamed("node", "vid")
        known = frozen(distinct.select("vid", "copies", "first").join(degrees, "vid", "left").join(roots, "vid", "left").select("vid", F.coalesce("root", "vid").alias("root"), (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "first"))
        least_id = known.groupBy("root").agg(F.min("first").alias("component_id"))
        classes = known.drop("first").join(least_id, "root")
        out = marked.where("vid is not null").join(classes, "vid").select("vec_id", "n_links", "component_id").union(marked.where("vid is null").select("vec_id", *plain))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


#: The result of near_duplicates(embeddings).
SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, e, sqrt(list_dot_product(e, e)) AS n
  FROM (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL)),
links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id
  WHERE a.n > 0 AND b.n > 0 AND isfinite(a.n) AND isfinite(b.n) AND list_dot_product(a.e, b.e) / (a.n * b.n) >= 0.98),
reach AS (SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a),
roots AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a),
degrees AS (SELECT a, count(*) AS n_links FROM links GROUP BY a)
SELECT vec_id, coalesce(n_links, 0) AS n_links, component_id, vec_id = component_id AS kept
FROM embeddings JOIN roots ON vec_id = roots.a LEFT JOIN degrees ON vec_id = degrees.a
"""
