"""Operators on small tables with nulls, empty and long texts, ties, repeated rows, none at all, and extra columns."""

from __future__ import annotations

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

pytest.importorskip("public_tokenizers")

from undertow.llm import catalog, common, decontam, embeddings, langid, licenses, linededup, nearcopies, packing, shard, simhash, substrings, tokens  # noqa: E402

DOCS = "doc_id long, text string, lang string, shard string, ut_key string, n_lines string, ut_text_key string, ut_row int"
RNG = random.Random(3)
WORDS = [f"{a}{b}{c}" for a in "bdfgk" for b in "aeiou" for c in "lmnr"]


def prose(n: int) -> str:
    return " ".join(RNG.choice(WORDS) for _ in range(n))


@pytest.fixture(scope="module")
def docs(spark):
    passage, long = prose(60), prose(30_000)
    near = prose(400).split()
    texts = [passage, f"{prose(20)} {passage} {prose(30)}", None, "", " \n\t ", long, prose(200), passage, "one", "one", "a\nb\nc\nd", "x\na\nb\nc\ny", "c\nd\na\nb\nc", "q\nq\nq\nq", "日本 été", " ".join(near), " ".join([*near[:200], "changed", *near[201:]])]
    rows = [(i, t, "en", "s", "k", "l", "f", 1) for i, t in enumerate(texts)] + [(7, passage, "en", "s", "k", "l", "f", 1), (None, passage, None, "s", "k", "l", "f", 1), (None, "one", "en", "s", "k", "l", "f", 1), (50, prose(3), "en", None, None, None, None, None)]
    return spark.createDataFrame(rows, DOCS).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def rows(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)


def test_shards(docs, empty):
    got = shard.shard(docs, 4, 3).collect()
    assert len(got) == docs.count() and shard.shard(empty).count() == 0
    for s in range(4):
        assert sorted(r["slot"] for r in got if r["shard"] == s) == list(range(sum(r["shard"] == s for r in got)))
    assert all(r["size"] == len((r["text"] or "").encode()) + 1 for r in got)


def test_shards_are_even_even_with_a_hot_group(spark):
    table = spark.range(6000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, F.repeat(F.lit("x"), 50)).otherwise(F.repeat(F.col("id").cast("string"), (F.col("id") % 17).cast("int"))).alias("text"))
    sizes = [r["s"] for r in shard.shard(table).groupBy("shard").agg(F.sum("size").alias("s")).collect()]
    assert len(sizes) == 8 and max(sizes) - min(sizes) < 0.01 * sum(sizes) / 8


def test_shards_by_exact_counts(spark):
    """Each cut is where brute force would put it: bytes before it are within tolerance, and keys on both sides in order."""
    table = spark.createDataFrame([(i, None if i % 40 == 0 else "x" * (i * 7919 % 400)) for i in range(4000)], "doc_id long, text string").repartition(5)
    got = shard.shard(table, 4, runs=3, run_bytes=1 << 14).collect()
    assert len(got) == 4000 and {r["size"] for r in got if r["text"] is None} == {1}
    per, total = {}, sum(r["size"] for r in got)
    for r in got:
        per.setdefault(r["shard"], []).append(r)
    assert all(abs(sum(r["size"] for r in rows_) - total / 4) < 0.005 * total / 4 + 800 for rows_ in per.values())
    ordered = [sorted(per[s], key=lambda r: r["slot"]) for s in range(4)]
    keys = [r["sort_key"] for rows_ in ordered for r in rows_]
    assert keys == sorted(keys) and all([r["slot"] for r in rows_] == list(range(len(rows_))) for rows_ in ordered)


def test_token_counts(docs, empty):
    from public_tokenizers import path
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(path("byte_bpe_50k.json"))
    want = sorted(((r["doc_id"], len((r["text"] or "").encode()), len(library.encode(r["text"] or "").ids)) for r in docs.collect()), key=repr)
    assert rows(tokens.count_tokens(docs), "doc_id", "n_bytes", "n_tokens") == want
    assert tokens.count_tokens(empty).count() == 0


def brute_classes(found, limit):
    root = list(range(len(found)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(found)):
        for j in range(i):
            if (found[i][1] ^ found[j][1]).bit_count() <= limit:
                root[max(find(i), find(j))] = min(find(i), find(j))
    least = {}
    for i, (d, _) in enumerate(found):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return [least.get(find(i)) for i in range(len(found))]


def plain_fingerprint(text, n=3):
    """As the contract says it, word by word and bit by bit."""
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")) if w]
    parts = [" ".join(words[i : i + n]) for i in range(max(1, len(words) - n + 1))] if words else []
    hashes = [xxhash.xxh64(p.encode(), seed=42).intdigest() for p in parts]
    return sum(1 << bit for bit in range(64) if 2 * sum(h >> bit & 1 for h in hashes) > len(hashes))


def test_near_duplicates(docs, empty):
    found = [(r["doc_id"], plain_fingerprint(r["text"])) for r in docs.collect()]
    want = sorted(((d, f"{f:016x}", c) for (d, f), c in zip(found, brute_classes(found, 3), strict=True)), key=repr)
    assert rows(simhash.near_duplicates(docs), "doc_id", "fingerprint", "component_id") == want
    assert simhash.near_duplicates(empty).count() == 0 and nearcopies.representatives(empty).count() == 0


def test_one_row_of_each_class_stays(docs):
    kept = nearcopies.representatives(docs)
    assert kept.columns == docs.columns
    texts = [r["text"] for r in docs.collect()]
    own = [shingles(t or "") if (t or "").split() else set() for t in texts]
    root = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if own[i] == own[j] or own[i] and own[j] and jaccard(own[i], own[j]) >= 0.8:
                old, new = sorted((root[i], root[j]), reverse=True)
                root = [new if x == old else x for x in root]
    assert kept.count() == len(set(root))
    ids = {r["doc_id"] for r in kept.collect()}
    assert {0, 15} <= ids and not {7, 16, None} & ids


def planted(n, seed, cluster):
    """Texts in clusters: each a copy of the cluster's first with some words in a row changed, so that similarities lie around 0.8."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    texts = []
    for _ in range(n):
        words = [word() for _ in range(104)]
        texts.append(" ".join(words))
        for _ in range(cluster - 1):
            k, at = rng.randint(1, 30), rng.randint(0, 70)
            texts.append(" ".join([*words[:at], *[word() for _ in range(k)], *words[at + k :]]))
    return texts


def shingles(text):
    words = text.split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))}


def jaccard(a, b):
    return len(a & b) / len(a | b)


@pytest.mark.parametrize("n, cluster", [(250, 4), (3, 60)])
def test_near_copies_equal_brute_force_jaccard(spark, n, cluster):
    texts = planted(n, 21, cluster)
    own = [shingles(t) for t in texts]
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    close = 0
    for i in range(len(texts)):
        for j in range(i // cluster * cluster, i):
            s = jaccard(own[i], own[j])
            close += 0.8 <= s < 0.85
            if s >= 0.8:
                root[max(find(i), find(j))] = min(find(i), find(j))
    assert close > 20
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    assert sorted(r["doc_id"] for r in nearcopies.representatives(table).collect()) == [i for i in range(len(texts)) if find(i) == i]


@pytest.mark.parametrize("n, cluster", [(40, 6), (2, 60)])
def test_crowded_signatures_lose_no_link(spark, monkeypatch, n, cluster):
    """Every signature of three sets or more goes by the pivot, and what that leaves by small parts."""
    plain = nearcopies.links
    monkeypatch.setattr(nearcopies, "links", lambda *a: plain(*a, small=2, most=5))
    test_near_copies_equal_brute_force_jaccard(spark, n, cluster)


def test_documents_below_the_similarity_stay(spark):
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    chain = [word() for _ in range(104)]
    texts = []
    for i in range(40):  # each shares 0.75 with the one before
        chain = [*chain[: i * 11 % 90], *[word() for _ in range(11)], *chain[i * 11 % 90 + 11 :]]
        texts.append(" ".join(chain))
    own = [shingles(t) for t in texts]
    assert all(0.7 < jaccard(a, b) < 0.8 for a, b in zip(own, own[1:], strict=False))
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert nearcopies.representatives(table).count() == 40


@pytest.mark.parametrize("most, limit", [(4, 3), (4096, 3), (4096, 4), (16, 6)])
def test_links_of_crowded_signatures(spark, most, limit):
    rng = random.Random(9)
    base = [rng.getrandbits(64) for _ in range(6)]
    values = sorted({b ^ sum({1 << rng.randrange(64) for _ in range(rng.randint(0, 5))}) for b in base for _ in range(60)})
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    table = spark.createDataFrame([(v,) for v in signed], "fp long")
    got = {r["node"]: r["root"] for r in common.components(simhash.links(table, limit, most)).collect()}
    classes = brute_classes([(v, u) for v, u in zip(signed, values, strict=True)], limit)
    assert {v: got.get(v, v) for v in signed} == dict(zip(signed, classes, strict=True))


def brute_lines(found, window, words):
    order = sorted(((d is None, d if d is not None else 0, i) for i, (d, t) in enumerate(found) if t is not None))
    first, out = {}, {}

    def windows(lines):
        for size in range(1, window + 1):
            for s in range(len(lines) - size + 1):
                if size == window or sum(len(x.split()) for x in lines[s : s + size]) >= words:
                    yield s, tuple(lines[s : s + size])

    for none, d, i in order:
        for s, w in windows(found[i][1].split("\n")):
            first[w] = min(first.get(w, (none, d, s)), (none, d, s))
    for none, d, i in order:
        lines = found[i][1].split("\n")
        gone = {j for s, w in windows(lines) if first[w] < (none, d, s) for j in range(s, s + len(w))}
        out[i] = "\n".join(x for j, x in enumerate(lines) if j not in gone)
    return out


def test_line_dedup(docs, empty):
    found = [(r["doc_id"], r["text"]) for r in docs.collect()]
    want = brute_lines(found, 3, 50)
    out = linededup.dedup_lines(docs)
    assert rows(out, "doc_id", "text") == sorted(((d, want.get(i)) for i, (d, _) in enumerate(found)), key=repr)
    assert sorted(out.columns) == sorted(docs.columns + ["n_removed"])
    assert linededup.dedup_lines(empty).count() == 0
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_line_dedup_equals_brute_force(spark):
    rng = random.Random(17)
    texts = []
    for _ in range(150):
        lines = [rng.choice("abcdefgh") if rng.random() < 0.6 else prose(rng.choice([1, 3, 26, 51])) for _ in range(rng.randint(1, 14))]
        if texts and rng.random() < 0.6:
            other = rng.choice(texts).split("\n")
            a = rng.randrange(len(other))
            lines[rng.randint(0, len(lines)) :] = other[a : a + rng.randint(1, 6)]
        texts.append("\n".join(lines))
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    for words in (50, None):
        want = brute_lines(list(enumerate(texts)), 3, words or 10**9)
        got = {r["doc_id"]: r for r in linededup.dedup_lines(table, words=words).collect()}
        assert {i: r["text"] for i, r in got.items()} == want
        assert all(r["n_lines"] == len(texts[i].split("\n")) for i, r in got.items())
        assert any(r["n_removed"] for r in got.values())
    prints = linededup.fingerprints(table, 3)
    n = prints.agg(F.count("*"), F.sum(F.size("windows"))).first()
    assert n[1] == sum(max(0, len(t.split("\n")) - 2) for t in texts) and n[0] < 0.8 * n[1]
    assert prints.select("doc_id", "at").distinct().count() == n[0]


def test_short_runs_of_many_words_go(spark):
    long, half, other = prose(60), prose(30), prose(28)
    texts = [f"{long}\na", f"b\n{long}\nc", f"{half}\n{other}\nd", f"e\n{half}\n{other}", f"{half}\nf\n{other}", f"{long}\na", long, f"{prose(3)}\n{prose(49)}", None, f"g\n{long}\n{long}"]
    texts += [f"h\n{texts[7].splitlines()[1]}", f"{half}\n{other}\nd\n{long}"]
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = texts[:1] + ["b\nc", texts[2], "e", texts[4], "", "", texts[7], None, "g", texts[10], ""]
    got = {r["doc_id"]: r for r in linededup.dedup_lines(table, words=50).collect()}
    assert [got[i]["text"] for i in range(12)] == want
    assert [got[i]["n_removed"] for i in (1, 3, 5, 9, 11)] == [1, 2, 2, 2, 4]


def test_decontamination(spark, docs, empty):
    text = docs.where("doc_id = 1").first()["text"].split()
    leaked = text[30:60]
    leaked[5], leaked[11] = "other", "words"
    bench = spark.createDataFrame([(1, " ".join(leaked)), (2, prose(40)), (3, None), (4, "")], "item_id long, text string")
    got = decontam.find_overlaps(docs, bench)
    assert {r["doc_id"] for r in got.collect()} == {0, 1, 7, None} and {r["item_id"] for r in got.collect()} == {1}
    kept = decontam.clean(docs, bench)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()}.isdisjoint({0, 1, 7})
    assert decontam.find_overlaps(empty, bench).count() == 0
    assert decontam.clean(docs, bench.where("item_id = 9")).count() == docs.count()


def test_a_large_benchmark_is_held_in_blocks(spark, docs, monkeypatch):
    bench = spark.createDataFrame([(i, prose(40)) for i in range(30)] + [(99, docs.where("doc_id = 0").first()["text"])], "item_id long, text string")
    assert len(list(decontam.indexes(bench, block_words=100))) > 5
    one, clean = rows(decontam.find_overlaps(docs, bench), "doc_id", "item_id"), rows(decontam.clean(docs, bench), "doc_id", "text")
    split = decontam.indexes
    monkeypatch.setattr(decontam, "indexes", lambda b: split(b, 100))
    assert rows(decontam.find_overlaps(docs, bench), "doc_id", "item_id") == one and one
    assert rows(decontam.clean(docs, bench), "doc_id", "text") == clean and len(clean) < docs.count()


def test_a_long_item_is_held_in_pieces(spark, monkeypatch):
    text = prose(900)
    bench = spark.createDataFrame([(1, text), (2, prose(30))], "item_id long, text string")
    split = decontam.indexes
    monkeypatch.setattr(decontam, "indexes", lambda b: split(b, 100))
    assert all(len(i.value.hashes) <= 400 for i in decontam.indexes(bench))
    words = text.split()
    table = spark.createDataFrame([(i, " ".join(words[i : i + 13])) for i in range(0, 888, 3)] + [(-1, prose(50))], "doc_id long, text string")
    assert {r["doc_id"] for r in decontam.find_overlaps(table, bench).collect()} == set(range(0, 888, 3))


def vectors(spark):
    rng = np.random.default_rng(2)
    base = rng.normal(size=(12, 64))
    out = []
    for i in range(240):
        v = base[i % 12] + rng.normal(size=64) * rng.choice([0, 0.05, 0.12, 0.18, 1])
        out.append((i, [float(x) for x in v.astype(np.float32)], i % 12 % 3))
    out += [(300, out[0][1], out[0][2]), (301, out[0][1], out[0][2]), (302, out[0][1], None), (303, None, 1), (304, [0.0] * 64, 1), (305, [float("nan"), *[1.0] * 63], 1), (306, [None, *[1.0] * 63], 1), (307, [], 1), (308, [1.0, 2.0], 1), (309, [2.0, 4.0], 1), (310, [float("inf"), *[1.0] * 63], 1)]
    return out, spark.createDataFrame(out, "vec_id long, embedding array<float>, label int")


@pytest.mark.parametrize("most", [7, 4096])
def test_vector_links(spark, most):
    plain, table = vectors(spark)
    fine = [v for v in plain if v[2] is not None and v[1] and all(x is not None and np.isfinite(x) for x in v[1]) and any(v[1])]
    root, n = {v[0]: v[0] for v in plain}, {v[0]: 0 for v in plain}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(fine):
        for b in fine[:i]:
            x, y = np.float32(a[1]).astype(float), np.float32(b[1]).astype(float)
            if a[2] == b[2] and len(x) == len(y) and x @ y / np.sqrt(x @ x) / np.sqrt(y @ y) >= 0.98:
                n[a[0]] += 1
                n[b[0]] += 1
                p, q = find(a[0]), find(b[0])
                root[max(p, q)] = min(p, q)
    want = sorted(((v[0], n[v[0]], find(v[0]), find(v[0]) == v[0]) for v in plain), key=repr)
    assert sum(n.values()) > 100
    assert rows(embeddings.near_duplicates(table, most=most), "vec_id", "n_links", "component_id", "kept") == want
    assert embeddings.near_duplicates(table.where("vec_id < 0")).count() == 0


def test_licences(docs, empty):
    out = licenses.scan_licenses(docs)
    assert out.count() == docs.count() and licenses.scan_licenses(empty).count() == 0
    assert out.where("n_base > 0 or labels <> ''").count() == 0


def brute_licences(text):
    words = [w for w in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")) if w]
    found = sorted((i, label) for phrase, label in {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}.items() for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.split())
    return len(words), len(found), found[0][0] if found else None, found[-1][0] if found else None, ",".join(sorted({x for _, x in found}))


def test_licence_base_fields_equal_brute_force(spark):
    rng = random.Random(19)
    bits = ["GNU", "General", "Public", "License", "gnu general-public\tLICENSE", "Apache License", "apache", "CC", "BY", "cc-by", "MIT", "MIT_License", "mitlicense", "é", "licenseé", "2.0", "SPDX-License-Identifier: MIT OR Apache-2.0", "word", "\x00", "日本"]
    texts = [None, "", *(rng.choice([" ", ".", "\n"]).join(rng.choice(bits) for _ in range(rng.randint(1, 30))) for _ in range(300)), prose(20_000) + " Apache License " + prose(20_000)]
    table = spark.createDataFrame([(i, t, "x", 1) for i, t in enumerate(texts)], "doc_id long, text string, labels string, n_words int").repartition(3)
    found = licenses.scan_licenses(table).collect()
    for r in found:
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == brute_licences(texts[r["doc_id"]]), texts[r["doc_id"]]
        assert set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(",")) and 0 <= r["score"] <= 1
    assert sum(r["n_base"] > 0 for r in found) > 50 and any(r["expressions"] for r in found)


def test_long_licence_expressions_are_read_whole():
    names = [f"GPL-{i}.0-only" for i in range(40)]
    for inner, end in ((f"({' AND '.join(names)}) OR Apache-2.0", True), (f"{' OR '.join(['MIT'] * 90)} AND GPL-3.0-only", True), (f"{' AND '.join(['MIT'] * 90)} AND GPL-3.0-only", False)):
        assert len(inner) > 400
        _, _, _, labels, expressions, permissive = licenses.scan(f"SPDX-License-Identifier: {inner}\nprose".encode())
        assert len(expressions) == 1 and permissive is end and "gpl" in labels
        assert len(expressions[0].split()) == len(inner.replace("(", "").replace(")", "").split())
    two = f"SPDX-License-Identifier: MIT {prose(200)} SPDX-License-Identifier: ISC"
    assert licenses.scan(two.encode())[4] == ["mit", "isc"]


def test_substrings(docs, empty):
    found = [(r["doc_id"], r["text"]) for r in docs.collect()]
    first = {}
    for d, t in found:
        w = (t or "").encode().split()
        for i in range(len(w) - 12):
            key = tuple(w[i : i + 13])
            first[key] = min(first.get(key, 1 << 60), 1 << 59 if d is None else d)
    want = []
    for d, t in found:
        w = (t or "").encode().split()
        gone = {j for i in range(len(w) - 12) if first[tuple(w[i : i + 13])] < (1 << 59 if d is None else d) for j in range(i, i + 13)}
        kept = b" ".join(x for j, x in enumerate(w) if j not in gone)
        want.append((d, len(w), len(gone), hashlib.sha256(kept).hexdigest()))
    got = substrings.digests(substrings.remove_repeats(docs, chunk=500))
    assert rows(got, "doc_id", "n_words", "n_removed", "kept_sha256") == sorted(want, key=repr)
    assert sum(r[2] for r in want) > 100
    assert substrings.remove_repeats(empty).count() == 0


def test_packing_round_trip(docs, empty):
    from public_tokenizers import path
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(path("word_bpe_49k.json"))
    pieces = packing.pack_documents(docs, pool_tokens=3000).collect()
    texts = {}
    for r in docs.collect():
        texts.setdefault(r["doc_id"], []).append(np.array([*library.encode(r["text"] or "", add_special_tokens=False).ids, 1], "<u4"))
    total = sum(len(i) for ids in texts.values() for i in ids)
    assert sum(p["length"] for p in pieces) == total
    for p in pieces:
        assert any(i[p["start"] : p["start"] + p["length"]].tobytes() == p["ids"] and len(i) == p["doc_tokens"] for i in texts[p["doc_id"]])
    by_sequence = {}
    for p in pieces:
        by_sequence.setdefault(p["sequence_id"], []).append((p["offset"], p["length"], p["tier"]))
    for parts in by_sequence.values():
        at = 0
        for offset, length, tier in sorted(parts):
            assert offset == at
            at += length
        assert at == tier
    assert packing.pack_documents(empty).count() == 0
    crc = packing.digests(packing.pack_documents(docs.where("doc_id = 8"))).first()["ids_crc32"]
    assert crc == zlib.crc32(texts[8][0].tobytes())


def test_language_identification(spark, docs, empty):
    rng = random.Random(1)
    sounds = {"aa": ["tion", "the", "ing", "ed"], "bb": ["che", "ung", "lich", "sch"], "cc": ["eau", "oir", "que", "ez"]}
    make = lambda lang: " ".join("".join(rng.choice(sounds[lang]) for _ in range(rng.randint(1, 3))) for _ in range(rng.randint(20, 60)))
    table = spark.createDataFrame([(i, make(lang), lang, 0) for i, lang in enumerate(["aa", "bb", "cc"] * 60)], "doc_id long, text string, lang string, score int")
    model = langid.fit(langid.learnable(table))
    held = langid.identify(table, model).join(table.select("doc_id", "lang"), "doc_id").where(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(4)) == 2)
    assert held.count() > 20 and held.where("lang <> lang_pred or rejected or score not between 0 and 1").count() == 0
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "12 !!"), (4, "日本語 中文 한국어 " * 5)], "doc_id long, text string")
    got = {r["doc_id"]: r for r in langid.identify(odd, model).collect()}
    assert [got[i]["lang_pred"] for i in (1, 2, 3)] == ["und"] * 3 and all(got[i]["rejected"] for i in got)
    assert [r["doc_id"] for r in langid.accepted(odd.union(table.select("doc_id", "text").where("doc_id = 9")), model).collect()] == [9]
    assert langid.identify(empty, langid.fit(empty)).count() == 0
    nothing = langid.fit(docs.withColumn("lang", F.lit(None).cast("string")))
    assert {r["lang_pred"] for r in langid.identify(docs, nothing).collect()} == {"und"}


def test_every_language_is_learned_and_odd_texts_are_rejected(spark):
    rng = random.Random(20)
    letters = "abcdefghijklmnopqrstuvwxyz"
    sounds = {f"l{k:03}": ["".join(rng.choice(letters) for _ in range(3)) for _ in range(12)] for k in range(131)}
    make = lambda lang, n: " ".join("".join(rng.choice(sounds[lang]) for _ in range(2)) for _ in range(n))
    table = spark.createDataFrame([(i, make(lang, rng.choice([6, 40, 200])), lang) for i, lang in enumerate(list(sounds) * 9)], "doc_id long, text string, lang string")
    model = langid.fit(langid.learnable(table))
    assert set(model.langs) == set(sounds)
    found = langid.identify(table, model).join(table.select("doc_id", "lang"), "doc_id")
    assert found.where("lang = lang_pred").count() > 0.97 * 131 * 9 and found.where("rejected").count() < 0.02 * 131 * 9
    noise = lambda n: " ".join("".join(rng.choice(letters) for _ in range(rng.randint(2, 9))) for _ in range(n))
    odd = spark.createDataFrame([(i, noise(rng.choice([20, 100, 400]))) for i in range(60)], "doc_id long, text string")
    few = langid.fit(table.where("lang < 'l004'"))
    assert langid.accepted(odd, few).count() <= 1
    assert langid.accepted(table.where("lang < 'l004'"), few).count() >= 35
    assert langid.accepted(table.where("lang > 'l100'").select("doc_id", "text"), few).count() < 0.05 * 30 * 9
    assert langid.identify(table.select("doc_id", F.repeat("text", 20000).alias("text")).limit(2), few).count() == 2


def test_every_operator_has_one_query():
    assert sorted({int(n[2:].split("_")[0]) for n in catalog.QUERIES}) == list(range(1, 14)) and len(catalog.QUERIES) == 13
