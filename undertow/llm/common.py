"""Pieces shared by the operators of this subpackage."""

from __future__ import annotations

import contextlib
import ctypes
import gc
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from undertow.operators.graph import components, frozen, shared_folder

__all__ = ["arrow_schema", "as_bytes", "claim", "components", "frozen", "held", "keyed", "map_batches", "same_document", "shared_folder", "table", "text_key", "whole"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def arrow_schema(ddl: str) -> tuple[T.StructType, pa.Schema]:
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = T._parse_datatype_string(ddl)
    return schema, to_arrow_schema(schema)


def as_bytes(column: pa.Array) -> list[bytes | None]:
    """A string column as UTF-8 bytes, without a decoding pass."""
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return column.cast(kind).to_pylist()


def map_batches(docs: DataFrame, columns: list, ddl: str, work: Callable[[pa.RecordBatch], Iterable[dict]]) -> DataFrame:
    """Stream Arrow batches of the given columns through work, which yields dicts of equally long lists.

    Only the columns named reach Python, under the names c0, c1, ...; nothing is held beyond a batch.
    """
    schema, arrow = arrow_schema(ddl)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim(work.__module__)
        for batch in batches:
            if batch.num_rows:
                for out in work(batch):
                    yield pa.RecordBatch.from_arrays([pa.array(out[f.name], f.type) for f in arrow], schema=arrow)

    return docs.select(*[c.alias(f"c{i}") for i, c in enumerate(columns)]).mapInArrow(run, schema)


def text_key() -> list:
    """Names a document beside its doc_id, so that two texts under one doc_id are not mixed up."""
    return [F.col("doc_id"), F.xxhash64("text").alias("ut_text_key")]


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id, ut_text_key and ut_row: every column of docs inside one struct, where no name of ours can clash."""
    return docs.select(*text_key(), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("ut_row"))


def whole(rows: DataFrame) -> DataFrame:
    """The columns that keyed has put aside."""
    return rows.select("ut_row.*")


def same_document(a: DataFrame, b: DataFrame, how: str) -> DataFrame:
    """a joined with b on doc_id (null safe) and text_key; b's key columns are dropped. Neither has other columns of users."""
    b = b.withColumnsRenamed({"doc_id": "ut_doc_id", "ut_text_key": "ut_key"})
    on = F.col("doc_id").eqNullSafe(F.col("ut_doc_id")) & (F.col("ut_text_key") == F.col("ut_key"))
    return a.join(b, on, how).drop("ut_doc_id", "ut_key")


_held: dict[str, dict] = {}


def claim(owner: str) -> None:
    """Let go, in this Python worker, of what other operators than owner hold, and give the memory back.

    Workers serve one stage after the other. So one holds one operator's tables at a time, and not those of all.
    """
    if _held and owner not in _held:
        _held.clear()
        gc.collect()
        pa.default_memory_pool().release_unused()
        with contextlib.suppress(OSError, AttributeError):  # the C library of another system
            ctypes.CDLL(None).malloc_trim(0)
    _held.setdefault(owner, {})


def held(owner: str, make: Callable, detail=None):
    """What make returns, kept by a Python worker from batch to batch for owner (a module's name) and each detail."""
    claim(owner)
    own = _held[owner]
    if detail not in own:
        own[detail] = make()
    return own[detail]
