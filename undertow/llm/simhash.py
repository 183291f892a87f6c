"""SimHash fingerprints and their links by deletion-variant signatures."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from undertow.llm.common import arrow_schema, as_bytes, components, frozen, map_batches

SEED = 42


def shingle_hashes(text: bytes | None, shingle: int) -> np.ndarray:
    """XXH64 of every shingle of a whole text, repeats included; of all its words if they are fewer."""
    words = text.lower().split() if text else []
    if not words:
        return np.zeros(0, np.uint64)
    flat = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    size = min(shingle, len(words))
    starts = np.concatenate([[0], ends[: len(words) - size] + 1])
    digest = xxhash.xxh64_intdigest
    return np.array([digest(flat[a:b], SEED) for a, b in zip(starts.tolist(), ends[size - 1 :].tolist(), strict=True)], np.uint64)


def voted(hashes: np.ndarray) -> int:
    """The 64-bit value whose bits are those that over half of the hashes have."""
    total = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        part = hashes[at : at + (1 << 16)]
        total += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    bits = (2 * total > len(hashes)).astype(np.uint8)
    return int.from_bytes(np.packbits(bits, bitorder="little").tobytes(), "little")


def fingerprint(text: bytes | None, shingle: int) -> int:
    """64-bit fingerprint of a whole text; 0 if it has no word."""
    hashes = shingle_hashes(text, shingle)
    return voted(hashes) if len(hashes) else 0


def fingerprints(docs: DataFrame, shingle: int) -> DataFrame:
    """doc_id and fp (the fingerprint as a signed long) of every row."""

    def work(batch):
        yield {"doc_id": batch.column(0), "fp": np.array([fingerprint(t, shingle) for t in as_bytes(batch.column(1))], np.uint64).view(np.int64)}

    kind = docs.schema["doc_id"].dataType.simpleString()
    return map_batches(docs, [F.col("doc_id"), F.col("text")], f"doc_id {kind}, fp long", work)


def forest(values: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """Links (from, to) of a spanning forest of the graph of distances up to limit.

    A breadth-first search that compares each value with those not yet reached only: in a tight group few
    are left after the first, so the work is near the group's size, not its square.
    """
    left, out_a, out_b = values, [], []
    while len(left) > 1:
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            at = queue.pop()
            near = np.bitwise_count(left ^ at) <= limit
            if near.any():
                reached = left[near]
                left = left[~near]
                out_a.append(np.full(len(reached), at))
                out_b.append(reached)
                queue.extend(reached)
    none = np.zeros(0, np.uint64)
    return (np.concatenate(out_a), np.concatenate(out_b)) if out_a else (none, none)


def bounds(limit: int) -> list[int]:
    """Where segments of the 64 bits start and end: of two fingerprints within limit, one differs by at most one bit."""
    segments = max(2, (limit + 2) // 2)
    return [64 * i // segments for i in range(segments + 1)]


def variants(distinct: DataFrame, limit: int) -> DataFrame:
    """sig, fp: for each fingerprint and segment one signature per bit of it that is left open.

    A signature is the open bit's number, times 2**32, and the segment with that bit deleted.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = batch.column(0).to_numpy().view(np.uint64)
            for low, high in zip(cuts, cuts[1:], strict=False):
                own = fps >> np.uint64(low) & np.uint64((1 << high - low) - 1)
                for bit in range(high - low):
                    sig = own & ~np.uint64(1 << bit) | np.uint64(low + bit << 32)
                    yield pa.record_batch([pa.array(sig.view(np.int64)), batch.column(0)], names=["sig", "fp"])

    cuts = bounds(limit)
    schema, _ = arrow_schema("sig long, fp long")
    return distinct.mapInArrow(run, schema)


def dealt_again(rows: DataFrame, limit: int, first: bool) -> DataFrame:
    """Rows (sig, free, fp) of crowded groups, dealt out by limit + 1 parts of the bits still free in their group.

    Two fingerprints of a group differ in free bits only; if in at most limit of them, one part is equal.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mix = np.uint64(0x9E3779B97F4A7C15)
        for batch in batches:
            if not batch.num_rows:
                continue
            sig, free, fp = (batch.column(i).to_numpy().view(np.uint64) for i in range(3))
            if first:  # the open bit names the segment, whose other bits are equal
                bit = (sig >> np.uint64(32)).astype(np.int64)
                own = np.array([next(((1 << h) - (1 << low)) & ~(1 << b) for low, h in zip(cuts, cuts[1:], strict=False) if low <= b < h) for b in range(64)], np.uint64)
                free = ~own[bit]
            for mask in np.unique(free):
                at = free == mask
                bits = [b for b in range(64) if int(mask) >> b & 1]
                for i in range(limit + 1):
                    part = np.uint64(sum(1 << b for b in bits[i :: limit + 1]))
                    key = ((sig[at] * mix ^ part) * mix ^ fp[at] & part) * mix
                    out = key ^ key >> np.uint64(29), np.full(len(key), mask & ~part), fp[at]
                    yield pa.record_batch([pa.array(x.view(np.int64)) for x in out], names=["sig", "free", "fp"])

    cuts = bounds(limit)
    schema, _ = arrow_schema("sig long, free long, fp long")
    return rows.mapInArrow(run, schema)


def links(distinct: DataFrame, limit: int, most: int = 4096, rounds: int = 3) -> DataFrame:
    """a, b: links that connect all fingerprints within limit bits, a spanning forest for each signature.

    Equal signatures are brought together by one exchange and each group is verified whole. A group of more
    than most fingerprints is first dealt out again by parts of its free bits, up to rounds times, after
    which at most 2**14 different ones can be left together at limit 3: no group is dropped or cut.
    """
    n = int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # dealt out anew, as each row becomes 64; by another hash than before, or Spark would take it for done
    level = frozen(variants(distinct.repartition(n, F.xxhash64("fp")), limit))
    found = []
    for depth in range(rounds + 1):
        hot = frozen(level.groupBy("sig").agg(F.count("*").alias("n")).where(F.col("n") > most).select("sig"))
        if depth == rounds or hot.isEmpty():
            found.append(groups_linked(level.select("sig", "fp"), limit))
            break
        found.append(groups_linked(level.join(hot, "sig", "left_anti").select("sig", "fp"), limit))
        crowded = level.join(hot, "sig").select("sig", F.lit(0).cast("long").alias("free") if depth == 0 else "free", "fp")
        level = frozen(dealt_again(crowded, limit, depth == 0))
    out = found[0]
    for more in found[1:]:
        out = out.union(more)
    return out


def groups_linked(rows: DataFrame, limit: int) -> DataFrame:
    """Links of each group of rows (sig, fp), one group in memory at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_sig, held = None, np.zeros(0, np.uint64)
        for batch in batches:
            if not batch.num_rows:
                continue
            sig = batch.column(0).to_numpy()
            fp = batch.column(1).to_numpy().view(np.uint64)
            cuts = np.concatenate([[0], np.flatnonzero(np.diff(sig)) + 1, [len(sig)]])
            if sig[0] == held_sig:
                held = np.concatenate([held, fp[: cuts[1]]])
                if len(cuts) == 2:
                    continue
                cuts = cuts[1:]
            yield from emit(held)
            sizes = np.diff(cuts)
            pairs = cuts[:-1][:-1][sizes[:-1] == 2]
            if len(pairs):
                a, b = fp[pairs], fp[pairs + 1]
                yield from sent(a, b, np.bitwise_count(a ^ b) <= limit)
            for i in np.flatnonzero(sizes[:-1] > 2):
                yield from emit(fp[cuts[i] : cuts[i + 1]])
            held_sig, held = sig[-1], fp[cuts[-2] :]
        yield from emit(held)

    def emit(group: np.ndarray) -> Iterator[pa.RecordBatch]:
        if len(group) > 1:
            a, b = forest(group, limit)
            yield from sent(a, b, np.ones(len(a), bool))

    def sent(a: np.ndarray, b: np.ndarray, keep: np.ndarray) -> Iterator[pa.RecordBatch]:
        if keep.any():
            yield pa.record_batch([pa.array(a[keep].view(np.int64)), pa.array(b[keep].view(np.int64))], names=["a", "b"])

    schema, _ = arrow_schema("a long, b long")
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(n, "sig").sortWithinPartitions("sig").mapInArrow(run, schema)


def classes(docs: DataFrame, shingle: int = 3, limit: int = 3) -> tuple[DataFrame, DataFrame]:
    """(doc_id, fp) of every row, and (fp, root, first): first is the least doc_id of fp's class."""
    marked = frozen(fingerprints(docs, shingle))
    distinct = marked.groupBy("fp").agg(F.min("doc_id").alias("first"))
    roots = components(links(distinct.select("fp"), limit)).withColumnRenamed("node", "fp")
    known = frozen(distinct.join(roots, "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"), "first"))
    least = known.groupBy("root").agg(F.min("first").alias("first"))
    return marked, known.drop("first").join(least, "root")


def near_duplicates(docs: DataFrame, shingle: int = 3, limit: int = 3) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id of every row of docs (doc_id, text; nothing else is read).

    Texts whose fingerprints differ by at most limit bits are linked; component_id is the least doc_id that
    links reach. A null or blank text has fingerprint 0, linked like any other. Rows that repeat are linked
    like other copies; rows without doc_id get a class, but name none unless alone in it (then null). A bit that
    exactly half of the shingles have is 0. Texts are read whole, however long; an empty table gives no rows.
    """
    marked, known = classes(docs, shingle, limit)
    return marked.join(known, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), F.col("first").alias("component_id"))
