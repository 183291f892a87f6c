"""Parts of the operators that need no session, against brute force and the tokenizer libraries."""

from __future__ import annotations

import itertools
import random
import re
import tracemalloc
from zlib import crc32

import numpy as np
import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")

from undertow.llm import decontam, langid, licenses, packing, simhash, substrings, tokens  # noqa: E402

BITS = ["a", "b", " ", "  ", "\n", "\t", "'s", "'", "'re", "'r", "é", "ß", "日", "1", "23", "!", "<|endoftext|>", " ", " ", "the", "ing", "\x1c", "'LL", "’s", "𝒳", "́", "don't", "x'y", "  \n ", "...", "\r\n"]


@pytest.mark.parametrize("chunk", [16, 1 << 16])
def test_counts_equal_the_library(chunk):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    own, library = tokens.CountTransducer(path, max_states=5000, chunk=chunk), Tokenizer.from_file(path)
    rng = random.Random(4)
    texts = ["", " ", "\n\n", "a" * 5000, " " * 300 + "x", "<|endoftext|>"] + ["".join(rng.choice(BITS) for _ in range(rng.randint(0, 80))) for _ in range(1500)]
    assert [own.count(t.encode()) for t in texts] == [len(library.encode(t, add_special_tokens=False).ids) for t in texts]


def test_chunk_maps_compose_in_any_order():
    own = tokens.CountTransducer(public_tokenizers.path("byte_bpe_50k.json"), chunk=7)
    text = "a few words, and one_long_word_without_spaces then  two spaces".encode()
    maps = [own.chunk_map(text[i : i + 7]) for i in range(0, len(text), 7)]
    whole = own.finish(own.scan(maps))
    right = maps[-1]
    for m in reversed(maps[:-1]):
        right = own.compose(m, right)
    assert own.finish(right) == whole == own.piece(text)


def test_a_space_between_visible_characters_fixes_the_state():
    """What such a place is said to be in the module: the tokens on both sides do not depend on each other."""
    own = tokens.CountTransducer(public_tokenizers.path("byte_bpe_50k.json"))
    visible = [chr(c) for c in range(33, 127)]
    for a, b in itertools.product(visible, visible):
        for left, right in ((f"x {a}", f"{b}y"), (f"don't{a}", f"{b} z"), (a, b)):
            assert own.words.findall(f"{left} {right}") == own.words.findall(left) + own.words.findall(f" {right}")
            assert own.chunk_map(f"{left} {right}".encode())[0] == f"{left} {right}".encode()[: own.place(f"{left} {right}".encode(), 1)]


def test_a_scan_holds_few_maps_of_a_long_text():
    own = tokens.CountTransducer(public_tokenizers.path("byte_bpe_50k.json"), chunk=16)
    text = ("word " * 700 + "x" * 300 + " end").encode()
    assert own.count(text) == own.piece(text)


def test_word_ids_equal_the_library():
    path = public_tokenizers.path("word_bpe_49k.json")
    own = packing.WordIds(path)
    rng = random.Random(5)
    texts = ["", "<|startoftext|> x", "The CAT's don't", "éte été ÉTÉ"] + ["".join(rng.choice(BITS) for _ in range(rng.randint(0, 60))) for _ in range(800)]
    for text in texts:
        units = text.encode().split()
        own.learn([units])
        want = own.tokenizer.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(own.ids(units), "<u4").tolist() == want, repr(text)


@pytest.mark.parametrize("lengths", [[], [1], [2048], [4097, 1], [100] * 50, [3, 5000, 700, 64, 65, 2047, 2049]])
def test_packing_places_each_token_once_without_padding(lengths):
    got = packing.pack(lengths)
    seen = {d: [] for d in range(len(lengths))}
    for tier, pieces in got:
        assert sum(n for _, _, n in pieces) == tier <= 2048 and tier & tier - 1 == 0
        for d, start, n in pieces:
            seen[d] += range(start, start + n)
    assert all(sorted(seen[d]) == list(range(n)) for d, n in enumerate(lengths))


def test_step_groups_hold_about_equal_tokens():
    sizes = [2048] * 13 + [64] * 20 + [512] * 9
    groups = packing.step_groups(sizes, 6)
    sums = [sum(s for s, g in zip(sizes, groups, strict=True) if g == k) for k in range(max(groups) + 1)]
    assert max(sums) - min(sums) <= 2048


def test_forest_connects_what_brute_force_links():
    rng = random.Random(6)
    base = [rng.getrandbits(64) for _ in range(20)]
    values = sorted({b ^ sum(1 << rng.randrange(64) for _ in range(rng.randint(0, 4))) & (1 << 64) - 1 for b in base for _ in range(8)})
    a, b = simhash.forest(np.array(values, np.uint64), 3)
    root = {v: v for v in values}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for x, y in zip(a.tolist(), b.tolist(), strict=True):
        assert (x ^ y).bit_count() <= 3
        assert find(x) != find(y)
        root[find(y)] = find(x)
    for x, y in itertools.combinations(values, 2):
        if (x ^ y).bit_count() <= 3:
            assert find(x) == find(y)


def brute_cover(docs, window):
    first, out = {}, {}
    for d, _, t in docs:
        w = t.split()
        for i in range(len(w) - window + 1):
            first[tuple(w[i : i + window])] = min(first.get(tuple(w[i : i + window]), 1 << 60), d)
    for d, _, t in docs:
        w = t.split()
        out[d] = {j for i in range(len(w) - window + 1) if first[tuple(w[i : i + window])] < d for j in range(i, i + window)}
    return out


def test_super_kmers_cover_what_brute_force_covers():
    rng = random.Random(7)
    for _ in range(120):
        letters = [b"a", b"b", b"cc", b"the", b"of"][: rng.randint(1, 5)]
        base = [rng.choice(letters) for _ in range(200)]
        docs = []
        for d in range(12):
            s = rng.randint(0, 150)
            docs.append((d, d * 7, b" ".join(base[s : s + rng.randint(0, 50)] if rng.random() < 0.6 else [rng.choice(letters) for _ in range(rng.randint(0, 40))])))
        window, rows, known = rng.choice([3, 5, 13]), [], []
        least = [substrings.minimisers(np.array([crc32(w) for w in t.split()], np.uint64), window) for _, _, t in docs if len(t.split()) >= window]
        hot = np.unique(np.concatenate(least))[:: rng.choice([1, 2, 1000])] if least else None
        for part in (docs[::2], docs[1::2]):
            a, b = substrings.super_kmers(part, window, 4, longest=rng.choice([2, 256]), hot=hot)
            rows, known = rows + a, known + b
        for bucket in {r[0] for r in rows}:
            known += zip(*(x.tolist() for x in substrings.covered_windows([r for r in rows if r[0] == bucket], window, most=rng.choice([7, 1 << 21]))), strict=True)
        got = {d: set() for d, _, _ in docs}
        for d, _, a, b in known:
            got[d] |= set(range(a, b))
        assert got == brute_cover(docs, window)


def test_seeds_meet_every_window_with_two_substitutions():
    for wrong in itertools.combinations(range(decontam.WINDOW), decontam.MISSES):
        hit = any(all(c == "0" or at + i not in wrong for i, c in enumerate(seed)) for seed in decontam.SEEDS for at in range(decontam.WINDOW - len(seed) + 1))
        assert hit, wrong


def test_overlaps_survive_substitutions_and_spare_others():
    rng = random.Random(8)
    words = [f"w{i}" for i in range(3000)]
    items = [(i, " ".join(rng.sample(words, 30))) for i in range(20)] + [(90, "only five words stand here"), (91, None), (92, "")]
    index, hashes = decontam.Index(items), decontam.Words()
    for i, text in items[:20]:
        own = text.split()
        for k in range(4, 30, 5):
            own[k] = "other"
        found = index.overlaps(hashes.of(" ".join([*rng.sample(words, 9), *own, *rng.sample(words, 9)]).encode()))
        assert list(found) == [index.items.index(i)]
        a, b, n = found[index.items.index(i)]
        assert 9 <= a and b <= 39 and n >= 11
    assert not index.overlaps(hashes.of(" ".join(rng.sample(words, 2000)).encode()))
    assert [index.items[k] for k in index.overlaps(hashes.of(b"x ONLY five, words stand here! y"))] == [90]


def brute_overlaps(items, text):
    """Items that agree with the text in all but two of 13 consecutive words at some alignment; short ones, in all."""
    words = lambda t: [w for w in (re.sub(r"[\W_]+", "", x.lower()) for x in (t or "").split()) if w]
    own, out = words(text), {}
    for item, t in items:
        other = words(t)
        width = min(13, len(other))
        for shift in range(-len(other), len(own)):
            same = [0 <= j + shift < len(own) and own[j + shift] == other[j] for j in range(len(other))]
            inside = [0 <= j + shift < len(own) for j in range(len(other))]
            good = [j for j in range(len(other) - width + 1) if width and all(inside[j : j + width]) and sum(same[j : j + width]) >= width - (2 if width == 13 else 0)]
            runs = []
            for j in good:
                if runs and j <= runs[-1][1]:
                    runs[-1][1] = j + width
                else:
                    runs.append([j, j + width])
            for a, b in runs:
                row = (b - a, sum(same[a:b]), -(a + shift))
                out[item] = max(out.get(item, row), row)
    return {item: (-a, n - a, k) for item, (n, k, a) in out.items()}


@pytest.mark.parametrize("most_hits", [5, 1 << 19])
def test_overlaps_equal_brute_force(most_hits):
    rng = random.Random(18)
    for vocabulary in (2, 3, 12, 40):
        words = [f"w{i}" for i in range(vocabulary)]
        items = [(i, " ".join(rng.choice(words) for _ in range(rng.choice([4, 13, 20, 45])))) for i in range(6)]
        index, hashes = decontam.Index(items, most_hits=most_hits), decontam.Words()
        for _ in range(25):
            own = [rng.choice(words) for _ in range(rng.randint(0, 40))]
            if rng.random() < 0.7:
                part = rng.choice(items)[1].split()
                for _ in range(rng.randint(0, 4)):
                    part[rng.randrange(len(part))] = "Other!"
                own[rng.randint(0, len(own)) :] = part
            text = " ".join(own)
            got = {index.items[k]: v for k, v in index.overlaps(hashes.of(text.encode())).items()}
            assert got == brute_overlaps(items, text)


def test_repeated_seeds_are_held_a_part_at_a_time():
    index = decontam.Index([(1, " ".join(["the"] * 2000))])
    tracemalloc.start()
    found = index.overlaps(decontam.Words().of(b"the " * 8000))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert found == {0: (0, 2000, 2000)} and peak < 60 << 20


@pytest.mark.parametrize(
    ("text", "postfix", "labels", "free"),
    [
        ("MIT", ["mit"], {"mit"}, True),
        ("MIT OR GPL-2.0-only", ["mit", "gpl-2.0-only", "or"], {"mit", "gpl"}, True),
        ("MIT AND GPL-2.0-only", ["mit", "gpl-2.0-only", "and"], {"mit", "gpl"}, False),
        ("(MIT OR GPL-2.0) AND Apache-2.0", ["mit", "gpl-2.0", "or", "apache-2.0", "and"], {"mit", "gpl", "apache"}, True),
        ("GPL-2.0 WITH Classpath-exception-2.0 OR BSD-3-Clause", ["gpl-2.0", "classpath-exception-2.0", "with", "bsd-3-clause", "or"], {"gpl", "bsd"}, True),
    ],
)
def test_licence_expressions(text, postfix, labels, free):
    assert licenses.to_postfix(text) == postfix
    assert licenses.evaluate(postfix) == (labels, free)


@pytest.mark.parametrize("text", ["", "(", "MIT OR", "(MIT", "AND MIT"])
def test_broken_licence_expressions(text):
    assert licenses.to_postfix(text) is None


def test_licence_scan_finds_places_and_tags():
    n, places, base, labels, expressions, free = licenses.scan("Under the MIT License; cc-by 4. Été GNU\nGeneral-Public License.\nSPDX-License-Identifier: Apache-2.0 OR LGPL-2.1\n".encode())
    assert [p for p in places if p[2]] == [(2, "mit", True), (4, "cc-by", True), (8, "gpl", True)]
    assert base == {"mit", "cc-by", "gpl"} and labels == base | {"apache", "lgpl"}
    assert expressions == ["apache-2.0 lgpl-2.1 or"] and free is True
    assert licenses.scan(b"mit license mit license")[1] == [(0, "mit", True), (2, "mit", True)]


def test_language_counts_ignore_what_is_no_letter():
    assert (langid.counts("Abc, abc!") == langid.counts("abc -- ABC")).all()
    assert langid.Model.empty().predict(["x", None, "12"]) == (["und"] * 3, [0.0] * 3, [True] * 3)


def test_long_texts_are_counted_in_pieces(monkeypatch):
    rng = random.Random(3)
    texts = ["", "a", " ", "ab  c", *("".join(rng.choice("abÉ9 .") for _ in range(n)) for n in (6, 7, 8, 13, 50, 200))]
    whole = [langid.counts(t) for t in texts]
    for piece in (1, 2, 7):
        monkeypatch.setattr(langid, "PIECE", piece)
        assert all((langid.counts(t) == w).all() for t, w in zip(texts, whole, strict=True))


def test_a_worker_holds_one_operators_tables():
    from undertow.llm import common

    made = []
    make = lambda name: lambda: made.append(name) or name
    for owner, detail in (("a", None), ("a", None), ("a", 1), ("b", None), ("b", None), ("a", None)):
        common.held(owner, make(f"{owner}{detail}"), detail)
    assert made == ["aNone", "a1", "bNone", "aNone"]
    common.claim("c")
    assert list(common._held) == ["c"]
