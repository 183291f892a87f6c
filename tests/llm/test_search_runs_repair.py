"""Pivot search, periodic runs and conversation repair, each against brute force."""

from __future__ import annotations

import hashlib
import itertools
import math
import random
from zlib import crc32

import pytest
from pyspark.sql import functions as F

from undertow.llm import conversations, pivots, runs

# ---- pivot search


def brute_products(rows, chosen, k=5):
    ok = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = set()
    for i, v in {(i, tuple(v)) for i, v in ok if i is not None and chosen(i)}:
        scores = sorted((-sum(a * b for a, b in zip(v, w, strict=True)), j is None, j or 0) for j, w in ok if j != i and len(w) == len(v))
        out |= {(i, n, None if none else j, -s) for n, (s, none, j) in enumerate(scores[:k], 1)}
    return out


def found(df):
    return sorted(tuple(r) for r in df.select("query_id", "rank", "vec_id", "score").collect())


def by_id(*wanted):
    return F.col("vec_id").isin(*wanted)


def test_top_products_equal_brute_force(spark):
    rnd = random.Random(3)
    centres = [[rnd.gauss(0, 1) for _ in range(6)] for _ in range(5)]
    rows = [(i, [x + rnd.gauss(0, 0.1) for x in centres[i % 5]]) for i in range(400)]
    rows += [(1000 + i, rows[7][1]) for i in range(60)] + [(7, rows[7][1])] * 3  # copies, rows that repeat
    rows += [(None, rows[3][1]), (2000, None), (2001, []), (2002, [1.0, None] * 3), (2003, [math.nan] * 6), (2004, [math.inf] + [0.0] * 5), (2005, [1.0, 2.0]), (2006, [2.0, 1.0]), (2007, [0.0] * 6), (2008, [])]
    rows += [(2009, [4e6, 1.0, 0.0, 0.0, 0.0, 0.0]), (2010, [1e300] + [0.0] * 5)]  # beyond the bounds; beyond a long
    df = spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<double>, score string")
    ask = [0, 7, 20, 1005, 2001, 2005, 2007, 2009]
    rows.remove((2010, [1e300] + [0.0] * 5))
    want = brute_products(rows, lambda i: i in ask)
    for size in (16, 4096):
        assert sorted(found(pivots.top_products(df, by_id(*ask), block=size, sample=64)), key=repr) == sorted(want, key=repr)


def test_top_products_of_few_rows_and_none(spark):
    df = spark.createDataFrame([(50, [1.0]), (1, [0.5])], "vec_id long, embedding array<float>")
    assert found(pivots.top_products(df, F.col("vec_id") % 50 == 0)) == [(50, 1, 1, 256 * 128)]
    assert found(pivots.top_products(df.limit(0), F.col("vec_id") % 50 == 0)) == []


def test_bounds_spare_comparisons():
    import numpy as np

    rnd = np.random.default_rng(1)
    body = np.concatenate([rnd.integers(-20, 20, (500, 16)) + 400 * np.eye(16, dtype=int)[c] for c in range(8)]).astype(np.int64)
    at = body[::500].astype(float)
    far = np.sqrt(((body[:, None, :].astype(float) - at) ** 2).sum(2))
    side = pivots.Side(list(range(len(body))), far, body)
    query = pivots.Side([0], far[:1], body[:1])
    ((_, kept, compared),) = pivots.best(query, side, np.ones(len(body), int), 5, [pivots.NOTHING])
    scores = body @ body[0]
    assert [s for s, _ in kept][:5] == sorted(scores[1:].tolist(), reverse=True)[:5]
    assert compared <= 1000  # of 4,000


# ---- periodic runs


def brute_runs(words, least, exponent):
    out = []
    for q in range(1, len(words) // 2 + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            length = j + q - i
            smallest = not any(all(words[t] == words[t + d] for t in range(i, i + length - d)) for d in range(1, q))
            if length >= max(least, exponent * q) and smallest:
                out.append((i, length, q))
            i = j + 1
    return sorted(out)


def some_words(rnd):
    letters = [b"a", b"b", b"longer-than-eight-1", b"longer-than-eight-2"][: rnd.randint(1, 4)]
    words = [rnd.choice(letters) for _ in range(rnd.randint(0, 12))]
    for _ in range(rnd.randint(0, 2)):
        words = words * rnd.randint(1, 5) + [rnd.choice(letters) for _ in range(rnd.randint(0, 3))]
    return words


def test_runs_equal_brute_force():
    rnd = random.Random(5)
    for _ in range(1500):
        words = some_words(rnd)
        for least, exponent in ((1, 2), (4, 3), (6, 4)):
            want = brute_runs(words, least, exponent)
            assert runs.all_runs(words, least, exponent) == want
            assert runs.word_runs(words, least, exponent) == want


class Counted:
    seen = 0

    def __init__(self, v):
        self.v = v

    def __eq__(self, other):
        Counted.seen += 1
        return self.v == other.v

    def __lt__(self, other):
        Counted.seen += 1
        return self.v < other.v


def test_comparisons_grow_with_the_words():
    fibonacci, nested = ["a", "ab"], "a"
    while len(fibonacci[-1]) < 20_000:
        fibonacci.append(fibonacci[-1] + fibonacci[-2])
    for letter in "bcdefg":
        nested = nested * 4 + letter
    rnd = random.Random(2)
    for text in ("a" * 20_000, fibonacci[-1], nested * 4, "".join(rnd.choice("ab") for _ in range(20_000)), "".join("a" * i + "b" for i in range(200))):
        for down in (False, True):
            Counted.seen = 0
            runs.next_smaller([Counted(c) for c in text], down)
            assert Counted.seen < 7 * len(text)


def test_op12_equals_brute_force(spark):
    rnd = random.Random(9)
    texts = [" ".join(w.decode() for w in some_words(rnd)) for _ in range(300)]
    texts += [None, "", " \t\n", "x", "a b " * 30, "           ", "no spaces" * 10, "w " * 30_000, " ".join(str(i) for i in range(5_000))]
    ids = [*range(-5, len(texts) - 6), None]
    rows = [*zip(ids, texts, strict=True), (3, texts[8]), (3, texts[8])]
    df = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, runs int")
    want = []
    for i, text in rows:
        words = "".join(" " if c in " \t\n\v\f\r" else c for c in text or "").split(" ")
        words = [w for w in words if w]
        h, n = crc32(str(i).encode()), len(words)
        if i is not None and h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[j] if j < a else words[a + (j - a) % p] for j in range(n)]
        found = [(0, n, 1)] if n > 2000 and len(set(words)) == 1 else [] if n > 2000 and len(set(words)) == n else brute_runs(words, 6, 4)
        gone = {j for s, length, q in found for j in range(s + q, s + length)}
        best = min(((-length, s, q) for s, length, q in found), default=None)
        first = (None,) * 4 if best is None else (best[1], -best[0], best[2], 1000 * -best[0] // best[2])
        sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
        want.append((i, len(found), *first, sha("".join(f"{a},{b},{c}\n" for a, b, c in found)), sha(" ".join(w for j, w in enumerate(words) if j not in gone))))
    got = [tuple(r) for r in runs.digests(runs.periodic_runs(runs.looped(df))).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert sum(w[1] > 0 for w in want) > 50
    assert runs.digests(runs.periodic_runs(runs.looped(df.limit(0)))).collect() == []


# ---- conversation repair


def brute_edits(turns):
    """Cheapest (cost, audit, repaired) over all edits of turns (initial, role, text, fault)."""
    every = []

    def walk(i, cost, audit, out):
        if cost > 3 * len(turns):
            return
        if i == len(turns):
            initials = "".join(r[:1] or "?" for r, _ in out)  # no role fits no place
            body = initials[initials[:1] == "s" :]
            if (not out) or (body and body == "ua" * (len(body) // 2)):
                every.append((cost, audit, "\n".join(f"{r}:{t}" for r, t in out)))
            if len(out) < 2 * len(turns) + 2:
                for role in ("user", "assistant"):
                    walk(i, cost + 2, audit + "I", [*out, (role, "")])
            return
        _, role, text, fault = turns[i]
        walk(i + 1, cost + 3, audit + "D", out)
        if fault not in (1, 2):
            walk(i + 1, cost + (fault == 3), audit + "K", [*out, (role, text)])
            for other in ("user", "assistant"):
                walk(i + 1, cost + 2 + (fault == 3), audit + "R", [*out, (other, text)])
        for other in ("user", "assistant"):
            walk(i, cost + 2, audit + "I", [*out, (other, "")])

    walk(0, 0, "", [])
    return min(every)


def brute_report(rows):
    """rows: (turn, role, text) of one conversation, in order."""
    seen, turns, counts = set(), [], [0] * 4
    for _, role, text in rows:
        bare = text.strip(" \t\n\v\f\r")
        fault = 1 if not bare else 2 if (role, text) in seen else 0 if bare[-1] in ".!?" else 3
        seen.add((role, text))
        counts[fault] += 1
        turns.append((role[:1], role, text, fault))
    numbers = [t for t, _, _ in rows if t is not None]
    gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
    illegal = sum(a[0] + b[0] not in ("su", "ua", "au") for a, b in itertools.pairwise(turns))
    cost, audit, out = brute_edits(turns)
    return (gaps, *counts[1:], illegal, cost, audit, hashlib.sha256(out.encode()).hexdigest())


def in_order(rows):
    return sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(r[2].encode()).digest()[:16]))


@pytest.fixture(scope="module")
def talks():
    rnd = random.Random(4)
    out = []
    for conv in range(70):
        for turn in range(rnd.randint(1, 4)):
            role = rnd.choice(["user", "assistant", "system", "tool", "", None, "umpire"] if rnd.random() < 0.4 else ["user", "assistant"])
            out.append((conv, turn if rnd.random() < 0.8 else rnd.choice([None, 0, 9]), role, rnd.choice(["Yes.", "No", "", " \n", None, "Why? ", "!", "Yes.", "a. "])))
    return [*out, (None, 0, "user", "Hi."), (None, 1, "assistant", "Hello"), (-3, None, "user", "Lone."), (-3, None, "user", "Lone.")]


def test_repair_equals_brute_force(spark, talks):
    df = spark.createDataFrame([(*t, True) for t in talks], "conv_id long, turn long, role string, text string, cost boolean")
    whole = {}
    for conv, turn, role, text in talks:
        whole.setdefault(conv, []).append((turn, " " if role is None else role, " " if text is None else text))
    want = {conv: brute_report(in_order(rows)) for conv, rows in whole.items()}
    got = {r[0]: tuple(r)[1:] for r in conversations.digests(df).collect()}
    assert got == want
    assert {r[0]: tuple(r)[1:] for r in conversations.reports(df).collect()} == {c: w[:-1] for c, w in want.items()}
    texts = {}
    for r in sorted(conversations.repaired(df).collect(), key=lambda r: r["position"]):
        texts.setdefault(r["conv_id"], []).append(f"{r['role']}:{r['text']}")
    assert {c: hashlib.sha256("\n".join(texts.get(c, [])).encode()).hexdigest() for c in want} == {c: w[-1] for c, w in want.items()}


def test_op13_equals_brute_force(spark, talks):
    df = spark.createDataFrame(talks, "conv_id long, turn long, role string, text string")
    whole = {}
    for conv, turn, role, text in talks:
        role, text = " " if role is None else role, " " if text is None else text
        fate = crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        rows = whole.setdefault(conv, [])
        if fate:
            text = "" if fate == 1 else text.translate({ord(c): None for c in ".!?"}) if fate == 2 else text
            rows += [(turn, "user" if fate == 4 else role, text)] * (2 if fate == 3 else 1)
    want = sorted((((c, *brute_report(in_order(rows))) if rows else (c, *[0] * 6, "", hashlib.sha256(b"").hexdigest())) for c, rows in whole.items()), key=repr)
    got = conversations.digests(conversations.damaged(df))
    assert sorted((tuple(r) for r in got.collect()), key=repr) == want
    assert any(not rows for rows in whole.values())
    assert conversations.digests(conversations.damaged(df.limit(0))).collect() == []


def test_long_conversation_passes_row_by_row(spark):
    rows = [(1, n, "user" if n % 2 == 0 else "assistant", f"{n}.") for n in range(20_000) if n % 100] + [(1, 7, "user", "14.")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    ((_, gaps, blank, duplicate, truncated, illegal, cost, audit),) = conversations.reports(df).collect()
    assert (gaps, blank, duplicate, truncated) == (199, 0, 1, 0) and len(audit) >= 19_801 and audit.count("K") + audit.count("R") + audit.count("D") == 19_801
