"""Edges that are kept as what they come from, so that a table of them grows with the items and not with their pairs."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from undertow.operators import provenance
from undertow.operators.parts import Parts

KINDS = ("ref", "author", "url")


def members(items: DataFrame, kind: str) -> DataFrame:
    """A row an item, or an item and key, from which edges() makes the edges of a kind."""
    return items.select("story_id", "id", "ts", "parent_ref", "content_hash") if kind == "ref" else provenance.edge_members(items, kind)


def edges(rows: DataFrame, kind: str) -> DataFrame:
    """story_id, src, dst, ts, edge_type of all members of a kind."""
    return provenance.ref_edges(rows) if kind == "ref" else provenance.member_edges(rows, kind)


class EdgeStore:
    """Members of a table for each kind, batches of which are one commit. What is there is not added again, so an item may
    come as often as it likes; an edge between items of two batches is there when both are. The m members of a key are m
    rows on disk, and their m (m - 1) / 2 edges are made where they are read."""

    def __init__(self, spark: SparkSession, folder: str, fan: int = 8):
        self.parts = Parts(spark, folder, fan=fan)

    def add(self, number: int, items: DataFrame, kinds: Iterable[str] = KINDS) -> bool:
        """Store a batch of items (story_id, id, ts, author_ref, parent_ref, content_hash, urls); False if it was added before."""
        rows = {kind: members(items, kind).distinct() for kind in kinds}
        for kind, new in rows.items():
            known = self.parts.read(kind)
            if known is not None:
                same = [F.col(f"n.{c}").eqNullSafe(F.col(f"k.{c}")) for c in new.columns]
                rows[kind] = new.alias("n").join(known.alias("k"), same, "left_anti")
        return self.parts.add(number, rows)

    def edges(self) -> DataFrame | None:
        """story_id, src, dst, ts, edge_type of all edges; None while there are no items."""
        out = None
        for kind in KINDS:
            rows = self.parts.read(kind)
            if rows is not None:
                out = edges(rows, kind) if out is None else out.union(edges(rows, kind))
        return out
