"""Vectors as arrays."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda acc, x: acc + x)


def cosine(a: Column, b: Column) -> Column:
    """Null if either has no length."""
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norms > 0, dot(a, b) / norms)


def unit(a: Column) -> Column:
    """a at length one, in double precision; null if it has no length. Dot products of these are cosines."""
    return F.get(F.transform(F.array(F.sqrt(dot(a, a))), lambda n: F.when(n > 0, F.transform(a, lambda x: x.cast("double") / n))), F.lit(0))


def hash_embedding(dim: int = 384, kind: str = "float"):
    """A unit vector that only depends on the text: sha256 of the text and a counter, as unsigned integers. kind is float or double."""

    @F.arrow_udf(f"array<{kind}>")
    def embed(texts: pa.Array) -> pa.Array:
        import hashlib

        import numpy as np

        exact = np.float64 if kind == "double" else np.float32

        def one(text: str | None) -> np.ndarray:
            body, heads = (text or "").encode(), [hashlib.sha256(b"%d:" % i) for i in range(-(-dim * 4 // 32))]
            for head in heads:
                head.update(body)
            raw = b"".join(head.digest() for head in heads)
            v = np.frombuffer(raw[: 4 * dim], "<u4").astype(exact) / (2**32 - 1) - 0.5
            return (v / (np.linalg.norm(v) or 1.0)).astype(exact)

        found = [one(text) for text in texts.to_pylist()]
        flat = pa.array(np.concatenate(found) if found else np.zeros(0, exact))
        return pa.ListArray.from_arrays(pa.array(np.arange(len(found) + 1) * dim, pa.int32()), flat)

    return embed
