"""Tables that grow by batches: parts under one commit log, merged level by level."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from undertow.operators.commits import CommitLog


class Parts:
    """Some tables of a folder, of which each batch adds a part to any, all in one commit.

    A batch that is committed already, as when it is taken again after a failure, adds nothing; one whose writer died before
    the commit left parts that no reader sees. When fan parts of a level stand beside each other they become one of the next
    level, through the table's own merge (rows as they are, unless given), so after n batches a table has at most
    fan * log(n) parts, and a row is rewritten log(n) times. What was merged is deleted one commit later, for those who still
    read it.
    """

    def __init__(self, spark: SparkSession, folder: str, merge: dict[str, Callable[[DataFrame], DataFrame]] | None = None, fan: int = 8):
        self.spark, self.folder, self.merge, self.fan = spark, folder, merge or {}, fan
        self.log = CommitLog(spark, folder)

    def state(self) -> tuple[int, dict]:
        number, state = self.log.latest()
        return number, state or {"batch": -1, "tables": {}, "gone": []}

    def batch(self) -> int:
        """The last batch committed; -1 before the first."""
        return self.state()[1]["batch"]

    def paths(self, table: str) -> list[str]:
        return [f"{self.folder}/{part['name']}" for part in self.state()[1]["tables"].get(table, [])]

    def read(self, table: str) -> DataFrame | None:
        """All rows of a table's parts, as they are; None while it has no part."""
        paths = self.paths(table)
        return self.spark.read.parquet(*paths) if paths else None

    def merged(self, table: str) -> DataFrame | None:
        """A table as its merge makes it of all parts."""
        rows = self.read(table)
        return rows if rows is None else self.merge.get(table, lambda df: df)(rows)

    def _write(self, table: str, rows: DataFrame) -> str:
        name = f"{table}/{uuid.uuid4().hex}"
        rows.write.parquet(f"{self.folder}/{name}")
        return name

    def add(self, batch: int, rows: dict[str, DataFrame]) -> bool:
        """Commit a batch's rows of each table; False if it was committed before. Raises Conflict if another writer was first."""
        number, state = self.state()
        if state["batch"] >= batch:
            return False
        tables, gone = {table: list(parts) for table, parts in state["tables"].items()}, []
        for table, added in rows.items():
            parts = [*tables.get(table, []), {"name": self._write(table, added), "level": 0}]
            while len(tail := [p for p in parts if p["level"] == parts[-1]["level"]]) >= self.fan:
                together = self.spark.read.parquet(*[f"{self.folder}/{p['name']}" for p in tail])
                one = self._write(table, self.merge.get(table, lambda df: df)(together))
                parts = [*parts[: -len(tail)], {"name": one, "level": tail[0]["level"] + 1}]
                gone += [p["name"] for p in tail]
            tables[table] = parts
        self.log.put(number + 1, {"batch": batch, "tables": tables, "gone": gone})
        for name in state["gone"]:
            self.log.delete(name)
        self.log.trim()
        return True
