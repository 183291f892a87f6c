"""Benchmark passages in documents, found by spaced seeds and verified around each hit."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from undertow.llm.common import arrow_schema, as_bytes, held, keyed, map_batches, same_document, text_key, whole

WINDOW = 13
MISSES = 2
#: Positions of a 13-word window that a seed compares (1) or ignores (0). Whichever two words of a window are
#: substituted, some seed at some place in it compares none of them; tests prove it by trying all pairs.
SEEDS = ("11101011", "110100111")
SIGNS = re.compile(r"[\W_]+")


class Words:
    """64-bit hashes of words, lower case and without punctuation; 0 for a word of punctuation only."""

    def __init__(self, max_memo: int = 400_000):
        self.memo: dict[bytes, int] = {}
        self.max_memo = max_memo

    def hashed(self, word: bytes) -> int:
        known = self.memo.get(word)
        if known is None:
            plain = word.lower() if word.isalnum() else SIGNS.sub("", word.decode("utf-8", "replace").lower()).encode()
            known = xxhash.xxh64_intdigest(plain, 1) | 1 if plain else 0
            if len(word) <= 64:
                if len(self.memo) >= self.max_memo:
                    self.memo.clear()
                self.memo[word] = known
        return known

    def of(self, text: bytes) -> np.ndarray:
        words = text.split()
        found = list(map(self.memo.get, words))
        if None in found:
            found = list(map(self.hashed, words))
        out = np.array(found, np.uint64)
        return out[out != 0]


def seed_keys(hashes: np.ndarray, mask: str) -> np.ndarray:
    """A key of the compared words at each place where the seed fits."""
    mix, n = np.uint64(0x9E3779B97F4A7C15), len(hashes) - len(mask) + 1
    out = np.zeros(max(n, 0), np.uint64)
    if n > 0:
        for i, c in enumerate(mask):
            if c == "1":
                out = (out ^ hashes[i : i + n]) * mix
                out ^= out >> np.uint64(32)
    return out


class Index:
    """Seeds of a block of test items, sorted by key, and a bitmap that turns most other keys away."""

    def __init__(self, items: list[tuple], bitmap_bits: int = 22, most_hits: int = 1 << 19):
        words = Words()
        self.most_hits = most_hits
        hashed = [(item, words.of((text or "").encode())) for item, text in items]
        hashed = [(item, h) for item, h in hashed if len(h)]
        self.items = [item for item, _ in hashed]
        lengths = np.array([len(h) for _, h in hashed], np.int64)
        self.ends = np.cumsum(lengths)
        self.starts = self.ends - lengths
        self.hashes = np.concatenate([h for _, h in hashed]) if hashed else np.zeros(0, np.uint64)
        self.tables = []
        masks = [(m, lengths >= WINDOW) for m in SEEDS]
        masks += [("1" * int(n), lengths == n) for n in np.unique(lengths[lengths < WINDOW])]  # too short for a window: whole
        self.shift = np.uint64(64 - bitmap_bits)
        for mask, of in masks:
            places = [np.arange(a, b - len(mask) + 1) for a, b, use in zip(self.starts, self.ends, of, strict=True) if use]
            place = np.concatenate(places) if places else np.zeros(0, np.int64)
            if not len(place):
                continue
            keys = seed_keys(self.hashes, mask)[place]
            order = np.argsort(keys, kind="stable")
            bitmap = np.zeros(1 << bitmap_bits, bool)
            bitmap[keys >> self.shift] = True
            self.tables.append((mask, keys[order], place[order], bitmap))

    def cut(self, at: np.ndarray, low: np.ndarray, n: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Places, their first hit and number of hits, in parts of at most about most_hits, a place alone if it has more."""
        ends = np.cumsum(n)
        start = 0
        while start < len(n):
            base = int(ends[start - 1]) if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, base + self.most_hits, "right")))
            yield at[start:stop], low[start:stop], n[start:stop]
            start = stop

    def overlaps(self, hashes: np.ndarray) -> dict[int, tuple[int, int, int]]:
        """For each item found: first word, behind the last word, and equal words of its longest verified overlap."""
        diagonals: list[np.ndarray] = []
        offset, span = len(self.hashes), len(self.hashes) + len(hashes) + 1
        for mask, keys, place, bitmap in self.tables:
            own = seed_keys(hashes, mask)
            at = np.flatnonzero(bitmap[own >> self.shift])
            if not len(at):
                continue
            low, high = np.searchsorted(keys, own[at], "left"), np.searchsorted(keys, own[at], "right")
            hit = high > low
            at, low, n = at[hit], low[hit], (high - low)[hit]
            # a seed that stands often on both sides hits in every pair of places, but lies on few diagonals: these are
            # kept, and the hits are made a part at a time
            for x, y, z in self.cut(at, low, n):
                test = place[np.repeat(y, z) + np.arange(z.sum()) - np.repeat(np.cumsum(z) - z, z)]
                item = np.searchsorted(self.ends, test, "right")
                diagonals.append(np.unique(item * span + np.repeat(x, z) - test + offset))
                if len(diagonals) > 16:
                    diagonals = [np.unique(np.concatenate(diagonals))]
            if len(diagonals) > 1:
                diagonals = [np.unique(np.concatenate(diagonals))]
        found: dict[int, tuple[int, int, int]] = {}
        for code in np.concatenate(diagonals).tolist() if diagonals else ():
            item, shift = divmod(code, span)
            shift -= offset
            a, b = int(max(self.starts[item], -shift)), int(min(self.ends[item], len(hashes) - shift))
            equal = hashes[a + shift : b + shift] == self.hashes[a:b]
            width = min(WINDOW, int(self.ends[item] - self.starts[item]))
            if len(equal) < width:
                continue
            sums = np.concatenate([[0], np.cumsum(equal)])
            good = np.flatnonzero(sums[width:] - sums[:-width] >= width - (MISSES if width == WINDOW else 0))
            if len(good):  # windows that verify, joined as far as they touch; the longest stretch counts
                cuts = np.flatnonzero(np.diff(good) > width) + 1
                first, last = good[np.concatenate([[0], cuts])], good[np.concatenate([cuts - 1, [len(good) - 1]])] + width
                best = int((last - first).argmax())
                x, y = int(first[best]), int(last[best])
                row = (x + a + shift, y + a + shift, int(sums[y] - sums[x]))
                if item not in found or (row[1] - row[0], row[2], -row[0]) > (found[item][1] - found[item][0], found[item][2], -found[item][0]):
                    found[item] = row
        return found


def blocks_of(benchmark: DataFrame, block_words: int) -> tuple[DataFrame, int]:
    """Items (item_id, text) of at most block_words words each, and the number of blocks that hold them.

    A longer item is cut into pieces that share 12 words, so that each window of it lies in one.
    """
    rows = benchmark.select("item_id", "text").where("text is not null")
    words = F.split(F.trim("text"), r"\s+")
    total, longest = rows.agg(F.sum(F.size(words)), F.max(F.size(words))).first()
    if (longest or 0) > block_words:
        starts = F.sequence(F.lit(0), F.greatest(F.size("w") - WINDOW, F.lit(0)), F.lit(block_words - WINDOW + 1))
        pieces = rows.select("item_id", words.alias("w")).select("item_id", "w", F.explode(starts).alias("a"))
        rows = pieces.select("item_id", F.array_join(F.slice("w", F.col("a") + 1, block_words), " ").alias("text"))
    return rows, max(1, -(-int(total or 0) // block_words))


def indexes(benchmark: DataFrame, block_words: int = 500_000) -> Iterator:
    """Broadcast indexes over benchmark (item_id, text), each of about block_words words.

    However large the benchmark, no more than a block is on the driver or broadcast at once: a larger one takes more
    blocks, dealt by a hash of the item and its piece, each of which is held against all documents.
    """
    rows, blocks = blocks_of(benchmark, block_words)
    for i in range(blocks):
        part = rows.where(F.pmod(F.xxhash64(F.col("item_id").cast("string"), "text"), F.lit(blocks)) == i) if blocks > 1 else rows
        yield benchmark.sparkSession.sparkContext.broadcast(Index([(r["item_id"], r["text"]) for r in part.orderBy("item_id", "text").collect()]))


def words() -> Words:
    return held(__name__, Words)


def find_overlaps(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, first_word, last_word, n_equal, share: one row for each document and item that overlap.

    Words are lower-cased and freed of punctuation; those left empty do not count. A document overlaps an
    item if, at some alignment, 13 consecutive words agree in all but two (or, in a shorter item, all its
    words agree); the stretch of such windows that is longest is reported, and share is its equal words by
    the item's words; of equally long ones that with more equal words, then the first, is reported. Null and empty texts
    overlap nothing, and neither does an empty table or benchmark; repeated rows give repeated results; only doc_id and
    text are read. Documents are scanned whole, however long, and not shuffled. An item of more than 500,000 words is
    held in pieces, each of which gives its own row.
    """
    doc_kind, item_kind = docs.schema["doc_id"].dataType.simpleString(), benchmark.schema["item_id"].dataType.simpleString()
    schema, arrow = arrow_schema(f"doc_id {doc_kind}, item_id {item_kind}, first_word long, last_word long, n_equal long, share double")

    def scan(index):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                out = []
                for doc_id, text in zip(batch.column(0).to_pylist(), as_bytes(batch.column(1)), strict=True):
                    for item, (a, b, n) in index.value.overlaps(words().of(text)).items() if text else ():
                        size = int(index.value.ends[item] - index.value.starts[item])
                        out.append((doc_id, index.value.items[item], a, b - 1, n, n / size))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), arrow, strict=True)], schema=arrow)

        return docs.select("doc_id", "text").mapInArrow(run, schema)

    parts = [scan(index) for index in indexes(benchmark)]
    if len(parts) == 1:
        return parts[0]
    found = parts[0]
    for part in parts[1:]:
        found = found.union(part)
    return found


def contaminated(docs: DataFrame, index) -> DataFrame:
    """doc_id, ut_text_key of the documents that overlap an item of the index."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def work(batch):
        hit = [i for i, t in enumerate(as_bytes(batch.column(2))) if t and index.value.overlaps(words().of(t))]
        if hit:
            yield {"doc_id": batch.column(0).take(pa.array(hit)), "ut_text_key": batch.column(1).take(pa.array(hit))}

    return map_batches(docs, [*text_key(), F.col("text")], f"doc_id {kind}, ut_text_key long", work)


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs, with all its columns, without the rows whose text overlaps an item of the benchmark.

    Overlaps are those of find_overlaps; null and empty texts stay, and so does every row if the benchmark has no item;
    of repeated rows all stay or go; an empty table gives one, no column name clashes, and texts are read whole. A
    benchmark of one block is a filter on the documents as they pass; each task of a larger one holds one block and
    names the documents to take out, which are then joined.
    """
    held_blocks = list(indexes(benchmark))
    if len(held_blocks) > 1:
        found = None
        for index in held_blocks:
            part = contaminated(docs, index)
            found = part if found is None else found.union(part)
        return whole(same_document(keyed(docs), found.distinct(), "left_anti"))
    index = held_blocks[0]

    @F.pandas_udf("boolean")
    def free(texts: pd.Series) -> pd.Series:
        return pd.Series([not t or not index.value.overlaps(words().of(t.encode())) for t in texts], dtype=bool)

    return docs.where(free("text"))
