"""Periodic runs of word sequences, by Lyndon arrays of both orders of words."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from undertow.llm.common import as_bytes, map_batches


def next_smaller(words: list, down: bool) -> tuple[list[int], list[int]]:
    """For each place the next one whose suffix is smaller (its longest Lyndon word ends there), and how many words both share.

    Words need an order and nothing else; down turns it round. The end is smaller than any suffix. Places whose suffixes
    grow wait on a stack; each new place is compared with the last of them until one is smaller. How many words two places
    share is not counted anew where it is known. The pair whose shared words reach farthest shows what follows as a copy of
    what was before; a pair within the copy shares what its original did, unless that goes on beyond the copy's end, and only
    there words are compared. And of three places, where two pairs share unlike numbers, the third shares the smaller one.
    So a word, once matched, is as a rule not matched again: the time is linear in the number of words.
    """
    n = len(words)
    after, shared = [n] * n, [0] * n
    before, shared_before = [-1] * n, [0] * n
    stack: list[int] = []
    x = y = far = 0  # words[x : x + far - y] == words[y:far]
    for r in range(n):
        word = words[r]
        last = k = 0
        while stack:
            p = stack[-1]
            if words[p] != word:
                popped = (word < words[p]) != down
                k = 0
            else:
                exact, low = False, 1
                if last:
                    a, b = k, shared_before[last]
                    exact, low = a != b, min(a, b)
                if not exact and r < far:
                    d, room = y - x, far - r
                    q, o = p - d if p >= y else p, r - d
                    known = shared[q] if after[q] == o else shared_before[o] if before[o] == q else 0
                    if known:
                        exact, low = known != room, min(known, room)
                k = low
                if not exact:
                    while r + k < n and words[p + k] == words[r + k]:
                        k += 1
                if r + k >= far:
                    x, y, far = p, r, r + k
                popped = r + k == n or (words[r + k] < words[p + k]) != down
            if not popped:
                before[r], shared_before[r] = p, k
                break
            after[p], shared[p] = r, k
            last = stack.pop()
        stack.append(r)
    return after, shared


def all_runs(words: list, least: int, exponent: int) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run of words with at least least words and exponent periods (2 or more), sorted.

    In one of the two orders a run's period is the longest Lyndon word of a place in its first period; from there it goes on
    for as many words as that place shares with the next smaller one, and back by fewer words than its period.
    """
    found = set()
    for down in (False, True):
        after, shared = next_smaller(words, down)
        for p, r in enumerate(after):
            period, more = r - p, shared[p]
            if more <= (exponent - 2) * period or p >= period and after[p - period] == p and shared[p - period] == more + period:
                continue  # too short, or not the first period
            start = p
            while start and words[start - 1] == words[start - 1 + period]:
                start -= 1
            if r + more - start >= max(least, exponent * period):
                found.add((start, r + more - start, period))
    return sorted(found)


def stretches(words: list[bytes], least: int, exponent: int) -> list[tuple[int, int]]:
    """Where runs can be: stretches of at least least words each of which stands exponent times at least in words.

    A word of a run stands once in each of its periods. Words count as one by their first 8 bytes, so no stretch is too short.
    """
    heads = np.array(words, "S8").view(np.uint64)
    order = np.sort(heads)
    often = order[exponent - 1 :][order[exponent - 1 :] == order[: 1 - exponent]]  # sorted; a head stands here if it does so often
    at = np.searchsorted(often, heads)
    hit = (often[np.minimum(at, len(often) - 1)] == heads) if len(often) else np.zeros(len(heads), bool)
    bounds = np.flatnonzero(np.diff(np.concatenate([[0], hit.astype(np.int8), [0]])))
    return [(a, b) for a, b in bounds.reshape(-1, 2).tolist() if b - a >= least]


def word_runs(words: list[bytes], least: int = 6, exponent: int = 4) -> list[tuple[int, int, int]]:
    """all_runs of a text's words, looked for where they can be."""
    if len(words) < max(least, exponent):
        return []
    return [(start + low, length, period) for low, high in stretches(words, least, exponent) for start, length, period in all_runs(words[low:high], least, exponent)]


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> list[bytes]:
    """words without those that a run holds behind its first period."""
    if not runs:
        return words
    gone = np.zeros(len(words), bool)
    for start, length, period in runs:
        gone[start + period : start + length] = True
    return [words[i] for i in np.flatnonzero(~gone).tolist()]


def periodic_runs(docs: DataFrame, least: int = 6, exponent: int = 4) -> DataFrame:
    """doc_id, n_words, runs (start, length, period; by start, then period) and collapsed_text of every row of docs (doc_id, text).

    Words are what white space (space and U+0009 to U+000D) separates, numbered from 0. A run is a stretch of words with a
    smallest period, least words and exponent periods long at least, that no neighbour extends. collapsed_text has the words
    that stay if of each run only the first period does, joined by one space. A null, empty or blank text has no words, no
    runs and the collapsed text ''. Texts are read whole, in time linear in their words. Repeated rows give repeated results;
    an empty table gives none; no other column is read; no shuffle.
    """

    def work(batch: pa.RecordBatch):
        ids = batch.column(0)
        for low in range(0, batch.num_rows, 256):
            part = [(text or b"").split() for text in as_bytes(batch.column(1).slice(low, 256))]
            found = [word_runs(words, least, exponent) for words in part]
            yield {
                "doc_id": ids.slice(low, 256),
                "n_words": [len(words) for words in part],
                "runs": [[dict(zip(("start", "length", "period"), run, strict=True)) for run in runs] for runs in found],
                "collapsed_text": [b" ".join(collapsed(words, runs)).decode() for words, runs in zip(part, found, strict=True)],
            }

    kind = docs.schema["doc_id"].dataType.simpleString()
    return map_batches(docs, [F.col("doc_id"), F.col("text")], f"doc_id {kind}, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed_text string", work)


def looped(docs: DataFrame) -> DataFrame:
    """doc_id and text of docs, with periodic stretches put into the texts of one in ten, as crc32 of the decimal doc_id says.

    With h that number and g = h div 10: where h mod 10 is 0, the words from a = g mod n on repeat the first
    1 + (n - a) div (3 + g mod 8) of them to the end. Rows without doc_id, and texts without words, stay as they are.
    """
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    g = F.floor(h / 10)
    words = F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")

    def loop(w):
        n = F.size(w)
        start = (F.col("g") % n).cast("int")
        period = (1 + F.floor((n - start) / (3 + F.col("g") % 8))).cast("int")
        times = F.ceil((n - start) / period).cast("int")
        return F.array_join(F.concat(F.slice(w, 1, start), F.slice(F.flatten(F.array_repeat(F.slice(w, start + 1, period), times)), 1, n - start)), " ")

    # the one-element array hands the words on, so that they are split once
    made = F.get(F.transform(F.filter(F.array(words), lambda w: F.size(w) > 0), loop), F.lit(0))
    rows = docs.select("doc_id", "text", h.alias("h"), g.alias("g"))
    return rows.select("doc_id", F.when(F.col("h") % 10 == 0, F.coalesce(made, F.col("text"))).otherwise(F.col("text")).alias("text"))


def digests(found: DataFrame) -> DataFrame:
    """Of periodic_runs' rows: doc_id, n_runs, the longest run's start, length, period and exponent_milli, and SHA-256s of
    all runs and of the collapsed text. Of equally long runs the first counts, of those with one start the one with the smaller period."""
    longest = F.array_min(F.transform("runs", lambda r: F.struct((-r["length"]).alias("l"), r["start"].alias("s"), r["period"].alias("p"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n"))), "")
    rows = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), longest.alias("r"), F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed_text", 256).alias("collapsed_sha256"))
    return rows.select("doc_id", "n_runs", F.col("r.s").alias("start"), (-F.col("r.l")).alias("length"), F.col("r.p").alias("period"), F.expr("(-1000 * r.l) div r.p").alias("exponent_milli"), "runs_sha256", "collapsed_sha256")
