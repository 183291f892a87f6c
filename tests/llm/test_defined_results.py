"""Cases with a defined result that rows of usual sizes do not show."""

from __future__ import annotations

import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from undertow.llm import embeddings, langid, linededup, substrings


def test_texts_without_a_letter_have_no_language(spark):
    model = langid.Model(np.ones(langid.DIM), np.ones((1, langid.DIM), np.float32), ["en"], np.zeros(langid.BINS))
    texts = ["½ ² ①", "Ⅷ", "123 _-", "", None, " \n", "é", "中", "1 a"]
    assert model.predict(texts)[0] == ["und"] * 6 + ["en"] * 3
    docs = spark.createDataFrame([(i, t, "en") for i, t in enumerate(texts)], "doc_id long, text string, lang string")
    assert langid.accepted(docs, model).count() == 3


def plain_grams(text):
    """Hashed 1- to 3-grams of letters, all else one space, in plain Python."""
    out, run = [], " "
    for c in (text.lower() + " "):
        c = c if c.isalpha() else " "
        if not (c == " " and run[-1] == " "):
            run += c
    mask = (1 << 32) - 1
    for i in range(len(run)):
        one = ord(run[i]) * 2654435761 & mask
        out.append(one >> 19)
        if i + 1 < len(run):
            two = (one ^ ord(run[i + 1])) * 2246822519 & mask
            out.append(two >> 19)
            if i + 2 < len(run):
                out.append(((two ^ ord(run[i + 2])) * 3266489917 & mask) >> 19)
    return Counter(out)


def test_languages_equal_plain_tf_idf_and_cosine(spark):
    rnd = random.Random(8)
    syllables = {"aa": ["ka", "lo", "mi", "nu"], "bb": ["sch", "ei", "tz", "un"], "cc": ["que", "oi", "aux", "ne"]}
    rows = [(i, " ".join("".join(rnd.choice(syllables[lang]) for _ in range(rnd.randint(1, 4))) for _ in range(rnd.randint(3, 60))), lang) for i in range(120) for lang in [rnd.choice("abc") * 2]]
    docs = spark.createDataFrame([*rows, (900, "kalo mi, SCHEI!", None)], "doc_id long, text string, lang string")
    model = langid.fit(docs)
    learned = [plain_grams(text) for _, text, lang in rows]
    idf = {g: math.log((1 + len(learned)) / (1 + sum(g in x for x in learned))) + 1 for x in learned for g in x}

    def vector(grams):
        out = np.zeros(langid.DIM)
        for g, n in grams.items():
            out[g] = math.log1p(n) * idf.get(g, math.log(1 + len(learned)) + 1)
        return out / np.linalg.norm(out)

    want = {}
    for doc_id, text, _ in [*rows, (900, "kalo mi, SCHEI!", None)]:
        near = [(float(vector(plain_grams(text)) @ c), lang) for c, lang in zip(model.centroids.astype(float), model.langs, strict=True)]
        want[doc_id] = max(near)
    for r in langid.identify(docs, model).collect():
        assert abs(r["score"] - want[r["doc_id"]][0]) < 1e-5
        assert r["lang_pred"] == want[r["doc_id"]][1]
    assert sum(r["lang_pred"] == lang for r, (_, _, lang) in zip(sorted(langid.identify(docs.where("lang is not null"), model).collect()), rows, strict=True)) > 115


def test_fitting_takes_as_many_jobs_whatever_the_partitions(spark):
    docs = spark.range(400).select(F.col("id").alias("doc_id"), F.concat(F.lit("some words "), F.col("id").cast("string")).alias("text"), F.lit("en").alias("lang"))
    tracker, jobs = spark.sparkContext.statusTracker(), []
    for n in (2, 24):
        spark.sparkContext.setJobGroup(f"fit {n}", "")
        langid.fit(docs.repartition(n))
        jobs.append(len(tracker.getJobIdsForGroup(f"fit {n}")))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert jobs[1] <= jobs[0] + 1


@pytest.mark.parametrize("first", [0, 2**63 - 1, -(2**63)])
def test_the_greatest_doc_id_is_one_like_others(spark, first):
    copy = " ".join(f"w{i}" for i in range(20))
    ids = [first, 2**63 - 1, None, None] if first != 2**63 - 1 else [first, None, None]
    docs = spark.createDataFrame([(i, copy) for i in ids], "doc_id long, text string").repartition(3)
    got = sorted(((r["doc_id"] is None, r["doc_id"] or 0, r["n_removed"]) for r in substrings.remove_repeats(docs).collect()))
    assert got == sorted((i is None, i or 0, 0 if i == first else 20) for i in ids)


def test_line_dedup_leaves_columns_of_any_name_alone(spark):
    run = "a\nb\nc"
    docs = spark.createDataFrame([(1, run, 77, "x", 3), (2, run, 78, "y", 4)], "doc_id long, text string, n_lines long, n_removed string, ut_n int")
    out = linededup.without_repeats(docs)
    assert out.schema == docs.schema
    assert sorted(tuple(r) for r in out.collect()) == [(1, run, 77, "x", 3), (2, "", 78, "y", 4)]


@pytest.mark.parametrize("size", [1e-300, 1e-200, 1.0, 1e200, 1e300])
def test_vectors_of_any_size_link_by_their_cosine(spark, size):
    rows = [(1, [1.0, 2.0, 2.0]), (2, [size, 2 * size, 2 * size]), (3, [-size, 2 * size, 2 * size]), (4, [0.0, 0.0, 0.0])]
    df = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<double>, label int")
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in embeddings.near_duplicates(df).collect()}
    assert got == {1: (1, 1), 2: (1, 1), 3: (0, 3), 4: (0, 4)}
