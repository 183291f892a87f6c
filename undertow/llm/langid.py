"""Language identification by nearest centroid over hashed character n-grams."""

from __future__ import annotations

import itertools
from zlib import crc32

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from undertow.llm.common import frozen, held, map_batches

DIM = 1 << 13
BINS = 14
UNKNOWN = "und"


PIECE = 1 << 20


def counts(text: str) -> np.ndarray:
    """Hashed counts of a text's character 1-, 2- and 3-grams; all that is no letter is one space. A long text passes in pieces."""
    out = np.zeros(DIM, np.int64)
    tail, after_letter = np.array([32], np.uint32), False
    out += np.bincount(tail * np.uint32(2654435761) >> np.uint32(19), minlength=DIM)
    for at in range(0, len(text) + 1, PIECE):
        piece = text[at : at + PIECE].lower() + (" " if at + PIECE > len(text) else "")
        points = np.frombuffer(piece.encode("utf-32-le", "replace"), np.uint32)
        letters = _letters()[np.minimum(points, _LAST)]
        before = np.concatenate([[after_letter], letters[:-1]])
        points = np.concatenate([tail, np.where(letters, points, np.uint32(32))[letters | before]])  # runs of other characters count as one
        mixed = points * np.uint32(2654435761)
        two = (mixed[:-1] ^ points[1:]) * np.uint32(2246822519)
        three = (two[:-1] ^ points[2:]) * np.uint32(3266489917)
        for grams in (mixed[len(tail) :], two[len(tail) - 1 :], three):
            out += np.bincount(grams >> np.uint32(19), minlength=DIM)
        tail, after_letter = points[-2:], bool(letters[-1])
    return out


_LAST = 0x30000


def _letters() -> np.ndarray:
    """Whether each code point below _LAST is a letter; all from there on count as letters."""
    return held(__name__, lambda: np.array([chr(c).isalpha() if not 0xD800 <= c < 0xE000 else False for c in range(_LAST)] + [True]))


def grams_bin(rows: np.ndarray) -> np.ndarray:
    """The power of two of the number of different n-grams of each row of counts."""
    return np.log2(np.maximum((rows > 0).sum(1), 1)).astype(int)


class Model:
    """Inverse document frequencies, unit centroids with their languages, and the least cosine accepted by grams_bin."""

    def __init__(self, idf: np.ndarray, centroids: np.ndarray, langs: list[str], least: np.ndarray):
        self.idf, self.centroids, self.langs, self.least = idf, centroids, langs, least

    @classmethod
    def empty(cls) -> Model:
        return cls(np.ones(DIM), np.zeros((0, DIM), np.float32), [], np.ones(BINS))

    def vectors(self, rows: np.ndarray) -> np.ndarray:
        out = np.log1p(rows) * self.idf
        norms = np.linalg.norm(out, axis=1, keepdims=True)
        return (out / np.where(norms == 0, 1, norms)).astype(np.float32)

    def nearest(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of each row of counts the nearest centroid, the first of equally near ones, and its cosine."""
        near = self.vectors(rows) @ self.centroids.T
        return near.argmax(1), near.max(1)

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float], list[bool]]:
        """Language, score and whether rejected, for whole texts."""
        langs, scores, rejected = [UNKNOWN] * len(texts), [0.0] * len(texts), [True] * len(texts)
        useful = [i for i, t in enumerate(texts) if t and any(map(str.isalpha, t))]
        if not self.langs:
            return langs, scores, rejected
        for at in range(0, len(useful), 64):
            part = useful[at : at + 64]
            rows = np.stack([counts(texts[i]) for i in part])
            for i, j, cosine, least in zip(part, *self.nearest(rows), self.least[grams_bin(rows)], strict=True):
                langs[i], scores[i], rejected[i] = self.langs[j], float(min(1.0, max(0.0, cosine))), bool(cosine < least)
        return langs, scores, rejected


def clustered(vectors: np.ndarray, k: int, rounds: int = 8) -> np.ndarray:
    """Unit centroids of k clusters by cosine; starts are the vectors farthest from those chosen."""
    chosen = [int((vectors @ vectors.mean(0)).argmax())]
    near = vectors @ vectors[chosen[0]]
    while len(chosen) < min(k, len(vectors)):
        chosen.append(int(near.argmin()))
        near = np.maximum(near, vectors @ vectors[chosen[-1]])
    centroids = vectors[chosen]
    for _ in range(rounds):
        own = (vectors @ centroids.T).argmax(1)
        sums = np.stack([vectors[own == j].sum(0) if (own == j).any() else centroids[j] for j in range(len(centroids))])
        centroids = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-12)
    return centroids


def thresholds(bins: np.ndarray, near: np.ndarray, share: float) -> np.ndarray:
    """The least cosine accepted in each of BINS, from samples' bins and cosines: share of the bin's 1 per cent quantile.

    A bin without samples is held to the next lower one's, and those below all samples to the lowest one's.
    """
    out = np.full(BINS, np.nan)
    for b in np.unique(bins):
        out[b] = share * np.quantile(near[bins == b], 0.01)
    known = np.flatnonzero(~np.isnan(out))
    return out[np.maximum.accumulate(np.where(np.isnan(out), known[0], np.arange(BINS)))]


def snippet(doc_id, text: str) -> str:
    """The first 4 to 128 words of a text, or all of it, as its id says."""
    words = 4 << crc32(str(doc_id).encode()) // 8 % 7
    return text if words > 128 else " ".join(text.split(None, words)[:words])


def fit(docs: DataFrame, per_lang: int = 300, max_rows: int = 20_000, clusters: int = 4, reject_share: float = 0.7) -> Model:
    """A model from labelled rows of docs (doc_id, text, lang), of which a bounded sample is used.

    Every language is learned. At most about per_lang rows of each, or max_rows over the number of languages if that is
    less, are sampled by a hash of doc_id, and they reach the driver as hashed counts, whose size does not depend on
    the texts'. The model holds clusters centroids a language. How near a text must be to be accepted depends on how
    many different n-grams it has, as short texts lie farther from every centroid: the least cosine is reject_share of
    the 1 per cent quantile of the sampled rows and of snippets of theirs with about as many. Rows without lang or
    letters teach nothing; without any others the model knows no language and rejects everything.
    """
    rows = docs.select("doc_id", "text", "lang").where(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    sizes = docs.select("lang").where("lang is not null").groupBy("lang").count().collect()  # a row for each language
    if not sizes:
        return Model.empty()
    most = max(1, min(per_lang, max_rows // len(sizes)))
    limit = F.create_map([F.lit(x) for r in sizes for x in (r["lang"], max(1, int(min(1.0, most / r["count"]) * (1 << 20))))])
    sample = rows.where(F.pmod(F.xxhash64(F.col("doc_id").cast("string"), F.lit(17)), F.lit(1 << 20)) < F.try_element_at(limit, F.col("lang")))

    def work(batch: pa.RecordBatch):
        for doc_id, lang, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            found = [counts(text), counts(snippet(doc_id, text))]
            at = [np.flatnonzero(f) for f in found]
            yield {"lang": [lang] * 2, "snippet": [False, True], "at": [x.astype("<u2").tobytes() for x in at], "n": [f[x].astype("<u4").tobytes() for f, x in zip(found, at, strict=True)]}

    columns = [F.col("doc_id"), F.col("lang"), F.col("text")]
    drawn = frozen(map_batches(sample, columns, "lang string, snippet boolean, at binary, n binary", work))  # in one job, by all tasks; what the driver reads is bounded
    got = sorted((r["lang"], r["snippet"], r["at"], r["n"]) for r in drawn.collect())
    if not got:
        return Model.empty()

    def dense(part: list[tuple]) -> np.ndarray:
        matrix = np.zeros((len(part), DIM), np.float32)
        for row, (*_, at, n) in zip(matrix, part, strict=True):
            row[np.frombuffer(at, "<u2")] = np.frombuffer(n, "<u4")
        return matrix

    whole = [g for g in got if not g[1]]
    met = np.zeros(DIM, np.int64)
    for g in whole:
        met[np.frombuffer(g[2], "<u2")] += 1
    model = Model.empty()
    model.idf = np.log((1 + len(whole)) / (1 + met)) + 1
    parts = [(lang, clustered(model.vectors(dense(list(part))), clusters)) for lang, part in itertools.groupby(whole, lambda g: g[0])]
    model.centroids = np.concatenate([c for _, c in parts]).astype(np.float32)
    model.langs = [lang for lang, c in parts for _ in c]
    bins, near = [], []
    for low in range(0, len(got), 512):
        matrix = dense(got[low : low + 512])
        bins.append(grams_bin(matrix))
        near.append(model.nearest(matrix)[1])
    model.least = thresholds(np.concatenate(bins), np.concatenate(near), reject_share)
    return model


def learnable(docs: DataFrame) -> DataFrame:
    """The rows that a model may learn from: those whose doc_id's crc32 modulo 4 is not 2."""
    return docs.where(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(4)) != 2)


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred, score, rejected of every row of docs (doc_id, text; nothing else is read).

    lang_pred is und, with score 0, for a text that is null or has no letter, or if the model knows no
    language; score is the cosine with the nearest centroid, of equally near ones the first by language.
    Texts are read whole, long ones in pieces; repeated rows give repeated results; an empty table gives no
    rows; no shuffle. The model is sent to the executors; its size is that of its centroids.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def work(batch):
        langs, scores, rejected = sent.value.predict(batch.column(1).to_pylist())
        yield {"doc_id": batch.column(0), "lang_pred": langs, "score": scores, "rejected": rejected}

    kind = docs.schema["doc_id"].dataType.simpleString()
    return map_batches(docs, [F.col("doc_id"), F.col("text")], f"doc_id {kind}, lang_pred string, score double, rejected boolean", work)


def accepted(docs: DataFrame, model: Model) -> DataFrame:
    """docs, with all its columns, without the rows whose text the model rejects: those of identify that are rejected.

    Null texts and texts without a letter go; repeated rows go or stay together; an empty table gives one.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("boolean")
    def keeps(texts: pd.Series) -> pd.Series:
        return ~pd.Series(sent.value.predict(texts.tolist())[2], dtype=bool)

    return docs.where(keeps("text"))
