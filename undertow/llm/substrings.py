"""Removal of word sequences that stand in an earlier document, by super-k-mer partitioning."""

from __future__ import annotations

from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from undertow.llm.common import arrow_schema, as_bytes, frozen, map_batches, same_document

#: Stands for a missing doc_id, of which NAMELESS, a bit of the row's key beyond those of short_key, tells a document that
#: has the greatest id. A document without doc_id is later than all that have one.
NO_ID = np.iinfo(np.int64).max
NAMELESS = 1 << 31
ROW = "bucket long, body binary, places binary"


def minimisers(hashes: np.ndarray, window: int, mer: int = 3) -> np.ndarray:
    """The least hash of mer consecutive words in each window of words."""
    mix = np.uint64(0x9E3779B97F4A7C15)
    mers = hashes[: len(hashes) - mer + 1] * mix
    for i in range(1, mer):
        mers = (mers ^ mers >> np.uint64(29)) * mix + hashes[i : len(hashes) - mer + 1 + i] * (mix | np.uint64(2 * i))
    mers = (mers ^ mers >> np.uint64(32)) * mix
    mers ^= mers >> np.uint64(29)
    span = window - mer + 1
    least, width = mers, 1
    while 2 * width <= span:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    rest = span - width
    return np.minimum(least[: len(least) - rest], least[rest:]) if rest else least


def packed(ids: np.ndarray, keys: np.ndarray, starts: np.ndarray, counts: np.ndarray) -> bytes:
    """Documents and word places of strings, small when ids rise slowly."""
    parts = np.diff(ids, prepend=0).astype("<i8"), keys.astype("<u4"), np.asarray(starts).astype("<u4"), np.asarray(counts).astype("<u4")
    return zstandard.ZstdCompressor(level=3).compress(b"".join(x.tobytes() for x in parts))


def unpacked(data: bytes) -> tuple[np.ndarray, ...]:
    raw = zstandard.ZstdDecompressor().decompress(data)
    n = len(raw) // 20
    ids = np.cumsum(np.frombuffer(raw, "<i8", n))
    return ids, *(np.frombuffer(raw, "<u4", n, 8 * n + 4 * n * i).astype(np.int64) for i in range(3))


def window_hashes(hashes: np.ndarray, window: int, at: np.ndarray) -> np.ndarray:
    """A hash of all words of the windows that start at the given places."""
    mix, out = np.uint64(0x9E3779B97F4A7C15), np.zeros(len(at), np.uint64)
    for i in range(window):
        out = (out ^ hashes[at + i]) * mix
        out ^= out >> np.uint64(29)
    return out


def flat_words(texts: list[bytes], window: int) -> tuple[list[bytes], list[int]]:
    """The words of all texts that have window words, one after the other, and how many each text gives."""
    words, sizes = [], []
    for text in texts:
        own = text.split()
        if len(own) >= window:
            words += own
        sizes.append(len(own) if len(own) >= window else 0)
    return words, sizes


def super_kmers(docs: list[tuple[int, int, bytes]], window: int, buckets: int, longest: int = 256, hot: np.ndarray | None = None) -> tuple[list[list], list[tuple[int, int, int, int]]]:
    """Rows of ROW, one for each bucket met, and (doc_id, key, start, end) of words known to be covered.

    docs are (doc_id, key, text). Consecutive windows with one minimiser are one string of words. Of equal
    strings in several of these documents only that with the least doc_id travels: in the others its windows
    are covered, which needs no further look. So a group of copies costs a string for each call, not each copy.
    Windows whose minimiser is among hot (sorted) are dealt by a hash of all their words instead, one string each.
    """
    docs = sorted(docs, key=lambda d: (d[0], d[1] & NAMELESS))
    words, sizes = flat_words([text for _, _, text in docs], window)
    if not words:
        return [], []
    hashes = np.fromiter(map(crc32, words), np.uint64, len(words))
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    begins = np.concatenate([[0], ends[:-1] + 1])
    flat = b" ".join(words)
    del words
    least = minimisers(hashes, window)
    if hot is not None and len(hot):
        crowded = np.flatnonzero(hot[np.minimum(np.searchsorted(hot, least), len(hot) - 1)] == least)
        least[crowded] = window_hashes(hashes, window, crowded)
    doc_ends = np.cumsum(sizes)
    doc_starts = doc_ends - sizes
    doc_of = np.repeat(np.arange(len(docs)), sizes)
    at = np.arange(len(least))
    valid = at + window <= doc_ends[doc_of[: len(least)]]
    same = np.zeros(len(least), bool)
    same[1:] = (least[1:] == least[:-1]) & valid[1:] & valid[:-1] & (doc_of[1 : len(least)] == doc_of[: len(least) - 1])
    firsts = np.flatnonzero(valid & ~same)
    stops = np.append(firsts[1:], len(least))
    lasts = np.minimum(stops, doc_ends[doc_of[firsts]] - window + 1)  # behind the last window of each run
    runs = lasts - firsts
    if (runs > longest).any():
        pieces = -(-runs // longest)
        step = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        firsts, lasts = np.repeat(firsts, pieces) + step * longest, np.repeat(lasts, pieces)
        lasts = np.minimum(lasts, firsts + longest)
    tails = lasts + window - 1  # behind the last word
    bucket = (least[firsts] % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    firsts, tails, bucket = firsts[order], tails[order], bucket[order]
    owner = doc_of[firsts]
    start = firsts - doc_starts[owner]
    count = tails - firsts
    ids = np.array([d[0] for d in docs], np.int64)
    keys = np.array([d[1] for d in docs], np.int64)
    owner_id = ids[owner]
    rows, covered = [], []
    packer = zstandard.ZstdCompressor(level=5)
    cuts = np.concatenate([[0], np.flatnonzero(np.diff(bucket)) + 1, [len(bucket)]])
    text_from, text_to = begins[firsts].tolist(), ends[tails - 1].tolist()
    id_list = owner_id.tolist()
    place = [2 * d[0] + (d[1] & NAMELESS > 0) for d in docs]  # in the order of documents, equal for those of one doc_id
    order_of = [place[i] for i in owner.tolist()]
    for low, high in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
        seen: dict[bytes, int] = {}
        strings, kept = [], []
        # in the order of doc_id, as runs of one bucket are in the order of documents
        for i in range(low, high):
            string = flat[text_from[i] : text_to[i]]
            if seen.setdefault(string, order_of[i]) < order_of[i]:
                covered.append(i)
            else:
                strings.append(string)
                kept.append(i)
        rows.append([int(bucket[low]), packer.compress(b"\n".join(strings)), packed(owner_id[kept], keys[owner[kept]], start[kept], count[kept])])
    return rows, [(id_list[i], int(keys[owner[i]]), int(start[i]), int(start[i] + count[i])) for i in covered]


def word_numbers(bodies: list[bytes]) -> np.ndarray:
    """A number for each word of packed strings, the same for equal words."""
    unpack, chunks = zstandard.ZstdDecompressor().decompress, []
    for body in bodies:  # single spaces and newlines part the words, so each is taken with the space behind it
        data = np.frombuffer(unpack(body).replace(b"\n", b" ") + b" ", np.uint8)
        offsets = np.concatenate([[0], np.flatnonzero(data == 32) + 1])
        chunks.append(pa.Array.from_buffers(pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(data)]))
    return np.concatenate([c.indices.to_numpy() for c in pa.chunked_array(chunks).dictionary_encode().chunks])


def covered_windows(rows: list[tuple], window: int, most: int = 1 << 21) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(doc_id, key, start, end) of runs of covered windows among all super-k-mers of one bucket.

    Windows are sorted by a hash of their words' numbers, and equal neighbours compared word by word. A bucket of more
    than most windows is sorted in shares by that hash, so that beside its words' numbers only a share is in memory.
    """
    codes = word_numbers([r[1] for r in rows])
    ids, keys, starts, count = (np.concatenate(x) for x in zip(*(unpacked(r[2]) for r in rows), strict=True))
    ends = np.cumsum(count)
    mix, mixed, wide = np.uint64(0x9E3779B97F4A7C15), np.zeros(len(codes) - window + 1, np.uint64), codes.astype(np.uint64)
    for i in range(window):
        mixed *= mix
        mixed += wide[i : len(mixed) + i]
        mixed ^= mixed >> np.uint64(31)
    del wide
    valid = np.zeros(len(codes) + 1, np.int8)  # whether a window starts at a place
    valid[ends - count] = 1
    valid[ends - window + 1] = -1
    at = np.flatnonzero(np.cumsum(valid[: len(mixed)], dtype=np.int8))
    shares = -(-len(at) // most)
    found = [repeated(codes, mixed, at if shares == 1 else at[mixed[at] % np.uint64(shares) == k], ids, keys & NAMELESS > 0, ends, window) for k in range(shares)]
    found = np.sort(np.concatenate(found)) if found else np.zeros(0, np.int64)
    none = np.zeros(0, np.int64)
    if not len(found):
        return none, none, none, none
    piece = np.searchsorted(ends, found, "right")
    offset = found - (ends - count)[piece]
    breaks = np.flatnonzero((np.diff(found) != 1) | (np.diff(piece) != 0)) + 1
    first, last = np.concatenate([[0], breaks]), np.concatenate([breaks - 1, [len(found) - 1]])
    return ids[piece[first]], keys[piece[first]], starts[piece[first]] + offset[first], starts[piece[last]] + offset[last] + window


def repeated(codes: np.ndarray, mixed: np.ndarray, at: np.ndarray, ids: np.ndarray, nameless: np.ndarray, ends: np.ndarray, window: int) -> np.ndarray:
    """Of the windows that start at the given places those whose words also stand in a document with a smaller id."""
    hashes = mixed[at]
    order = np.argsort(hashes)
    hashes = hashes[order]
    equal = hashes[1:] == hashes[:-1]
    if not equal.any():
        return np.zeros(0, np.int64)
    several = np.append(equal, False) | np.append(False, equal)  # windows that stand once are done with
    hashes, place = hashes[several], at[order[several]]
    new = hashes[1:] != hashes[:-1]
    same = np.flatnonzero(~new)
    truly = np.ones(len(same), bool)
    for i in range(window):
        truly &= codes[place[same] + i] == codes[place[same + 1] + i]
    if not truly.all():  # two sequences with one hash: sort these by all their words
        place = place[np.lexsort([codes[place + i] for i in range(window)])]
        new = np.zeros(len(place) - 1, bool)
        for i in range(window):
            new |= codes[place[1:] + i] != codes[place[:-1] + i]
    piece = np.searchsorted(ends, place, "right")
    owner, named = ids[piece], ~nameless[piece]
    starts, group = np.concatenate([[0], np.flatnonzero(new) + 1]), np.concatenate([[0], np.cumsum(new)])
    least, some = np.minimum.reduceat(owner, starts)[group], np.logical_or.reduceat(named, starts)[group]
    return place[(owner > least) | ~named & some]


def hot_minimisers(docs: DataFrame, window: int, buckets: int, one_in: int = 64, fewest: int = 100_000) -> np.ndarray:
    """Minimisers with more windows than four buckets have on average, and than one in fewest of all, sorted.

    They are counted in one document of one_in, chosen by a hash of the text and its id. What is missed or taken for
    nothing changes where windows meet and no result; there are at most fewest.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, sizes = flat_words([t for t in as_bytes(batch.column(0)) if t], window)
            if not words:
                continue
            least = minimisers(np.fromiter(map(crc32, words), np.uint64, len(words)), window)
            ends = np.cumsum(sizes)
            at = np.arange(len(least))
            least, n = np.unique(least[at + window <= ends[np.searchsorted(ends, at, "right")]], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(least.view(np.int64)), pa.array(n)], schema=arrow)

    schema, arrow = arrow_schema("m long, n long")
    part = docs.select("text").where(F.pmod(F.xxhash64("text", "doc_id", F.lit(5)), F.lit(one_in)) == 0)
    counted = part.mapInArrow(run, schema).groupBy("m").agg(F.sum("n").alias("n"))
    counted = frozen(counted)
    total = counted.agg(F.sum("n")).first()[0] or 0
    least = max(4 * total / buckets, total / fewest, 64)
    return np.sort(np.array([r["m"] for r in counted.where(F.col("n") > least).select("m").collect()], np.int64).view(np.uint64))


def short_key() -> F.Column:
    """Tells two texts under one doc_id apart."""
    return F.xxhash64("text").bitwiseAND(NAMELESS - 1).alias("ut_text_key")


def covered(docs: DataFrame, window: int, buckets: int, chunk: int, hot: np.ndarray) -> DataFrame:
    """doc_id, ut_text_key, a, b: words a to b - 1 of a document that earlier documents' windows cover."""

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for doc_id, key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), as_bytes(batch.column(2)), strict=True):
                if text:
                    held.append((NO_ID, key | NAMELESS, text) if doc_id is None else (doc_id, key, text))
                    size += len(text)
                if size >= chunk:
                    yield from sent(held)
                    held, size = [], 0
        yield from sent(held)

    def sent(held: list) -> Iterator[pa.RecordBatch]:
        rows, known = super_kmers(held, window, buckets, hot=hot)
        if known:  # travels with the rest to where it is returned, dealt evenly
            a = np.array(known, np.int64)
            rows.append([-1 - int(a[0, 1] % buckets), b"", packed(a[:, 0], a[:, 1], a[:, 2], a[:, 3] - a[:, 2])])
        for at in range(0, len(rows), 64):
            part = list(zip(*rows[at : at + 64], strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(part, row_arrow, strict=True)], schema=row_arrow)

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = []
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if row[0] < 0:
                    ids, keys, starts, count = unpacked(row[2])
                    yield result(ids, keys, starts, starts + count)
                    continue
                if held and held[0][0] != row[0]:
                    yield result(*covered_windows(held, window))
                    held = []
                held.append(row)
        if held:
            yield result(*covered_windows(held, window))

    def result(ids, keys, a, b) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(ids, mask=keys & NAMELESS > 0), pa.array(keys & ~NAMELESS), pa.array(a), pa.array(b)], schema=out_arrow)

    row_schema, row_arrow = arrow_schema(ROW)
    out_schema, out_arrow = arrow_schema("doc_id long, ut_text_key long, a long, b long")
    n = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), docs.rdd.getNumPartitions())
    strings = docs.select(F.col("doc_id").cast("long"), short_key(), "text").mapInArrow(spread, row_schema)
    # a bucket's number deals it out, so that tasks get equally many
    return strings.repartitionById(n, F.pmod("bucket", F.lit(n)).cast("int")).sortWithinPartitions("bucket").mapInArrow(gather, out_schema)


def remove_repeats(docs: DataFrame, window: int = 13, buckets: int | None = None, chunk: int = 8 << 20) -> DataFrame:
    """doc_id, n_words, n_removed, kept (text) of every row of docs (doc_id integer, text; nothing else is read).

    Words are what ASCII white space separates. A word goes if a window of consecutive words that covers it
    also starts in a document with a smaller doc_id, as the input stands. A null text has no words and kept
    is ''; a text shorter than the window keeps its words; kept words are joined by one space. Rows that
    repeat a doc_id are not earlier than each other; a row without doc_id is later than all that have one.

    A text is split whole, however long; an empty table gives no rows; doc_ids of another integer type are widened, and
    any that is no integer is an error. buckets grows with the input's partitions unless given, so that one bucket fits
    in memory, and the windows of minimisers that are much more frequent than a bucket are dealt out one by one.
    """
    if not isinstance(docs.schema["doc_id"].dataType, T.IntegralType):
        raise TypeError("doc_id must be an integer")
    if buckets is None:
        buckets = 8 * max(8, docs.rdd.getNumPartitions())
    runs = covered(docs, window, buckets, chunk, hot_minimisers(docs, window, buckets)).groupBy("doc_id", "ut_text_key").agg(F.collect_list(F.struct("a", "b")).alias("ut_runs"))
    joined = same_document(docs.select(F.col("doc_id").cast("long"), short_key(), "text"), runs, "left")

    def work(batch):
        out = {"doc_id": batch.column(0), "n_words": [], "n_removed": [], "kept": []}
        for text, runs in zip(as_bytes(batch.column(1)), batch.column(2).to_pylist(), strict=True):
            words = text.split() if text else []
            n = len(words)
            if runs:
                gone = np.zeros(n + 1, np.int32)
                np.add.at(gone, [r["a"] for r in runs], 1)
                np.add.at(gone, [r["b"] for r in runs], -1)
                words = [words[i] for i in np.flatnonzero(np.cumsum(gone[:-1]) == 0).tolist()]
            out["n_words"].append(n)
            out["n_removed"].append(n - len(words))
            out["kept"].append(b" ".join(words).decode("utf-8", "replace"))
        yield out

    return map_batches(joined, [F.col("doc_id"), F.col("text"), F.col("ut_runs")], "doc_id long, n_words long, n_removed long, kept string", work)


def digests(found: DataFrame) -> DataFrame:
    return found.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


#: The result of digests(remove_repeats(documents)).
SQL = r"""
WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[ \t\n\x0B\f\r]+'), lambda x: x <> '') AS a FROM documents),
g AS (SELECT doc_id, i, array_to_string(a[i:i + 12], ' ') AS s FROM (SELECT doc_id, a, unnest(range(1, len(a) - 11)) AS i FROM w)),
f AS (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY s) < doc_id AS later FROM g),
c AS (SELECT DISTINCT doc_id, i + unnest(range(0, 13)) AS p FROM f WHERE later),
e AS (SELECT doc_id, unnest(a) AS x, unnest(range(1, len(a) + 1)) AS p FROM w),
k AS (
  SELECT e.doc_id, count(c.p) AS n_removed, coalesce(string_agg(x, ' ' ORDER BY e.p) FILTER (WHERE c.p IS NULL), '') AS kept
  FROM e LEFT JOIN c ON e.doc_id = c.doc_id AND e.p = c.p GROUP BY e.doc_id)
SELECT w.doc_id, len(a) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM w LEFT JOIN k ON w.doc_id = k.doc_id
"""
