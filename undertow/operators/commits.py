"""A log of numbered commits beside a table: what a reader sees is what the last one names, whatever else lies there."""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable

from pyspark.sql import SparkSession


class Conflict(RuntimeError):
    """Another writer took the number."""


class CommitLog:
    """Commits of a folder: files _commits/NNN.json, each a whole state, written once and never changed.

    A commit is written under a name of its own and then renamed to its number, which fails if the number is there. So of
    two writers one wins and the other knows; a writer that dies leaves at most a file that no reader looks at.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder
        self.hadoop = spark._jvm.org.apache.hadoop.fs
        self.root = self.hadoop.Path(f"{folder}/_commits")
        self.files = self.root.getFileSystem(spark._jsc.hadoopConfiguration())

    def numbers(self) -> list[int]:
        if not self.files.exists(self.root):
            return []
        names = (status.getPath().getName() for status in self.files.listStatus(self.root))
        return sorted(int(name[:-5]) for name in names if name.endswith(".json") and name[:-5].isdigit())

    def read(self, number: int) -> dict:
        stream = self.files.open(self.hadoop.Path(self.root, f"{number:020d}.json"))
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def latest(self) -> tuple[int, dict | None]:
        """The number and state of the last commit; -1 and None before the first."""
        numbers = self.numbers()
        return (numbers[-1], self.read(numbers[-1])) if numbers else (-1, None)

    def put(self, number: int, state: dict) -> None:
        """Write commit number, or raise Conflict if it is there."""
        own = self.hadoop.Path(self.root, f".{uuid.uuid4().hex}")
        stream = self.files.create(own, False)
        try:
            stream.write(json.dumps(state).encode())
        finally:
            stream.close()
        conf = self.spark._jsc.hadoopConfiguration()
        qualified = self.files.makeQualified(own)
        context = self.hadoop.FileContext.getFileContext(qualified.toUri(), conf)
        none = self.spark._jvm.java.lang.reflect.Array.newInstance(self.spark._jvm.java.lang.Class.forName("org.apache.hadoop.fs.Options$Rename"), 0)
        try:
            context.rename(qualified, self.files.makeQualified(self.hadoop.Path(self.root, f"{number:020d}.json")), none)
        except Exception as error:
            self.files.delete(own, False)
            if "AlreadyExists" in str(error):
                raise Conflict(f"commit {number} of {self.folder}") from None
            raise

    def commit(self, change: Callable[[dict | None], dict], attempts: int = 20) -> tuple[int, dict]:
        """Commit what change makes of the last state. If another writer was first, change is asked again, with what that one left."""
        for attempt in range(attempts):
            number, state = self.latest()
            new = change(state)
            try:
                self.put(number + 1, new)
            except Conflict:
                time.sleep(min(2.0, 0.05 * 2**attempt))
                continue
            return number + 1, new
        raise Conflict(f"{attempts} attempts at {self.folder}")

    def trim(self, keep: int = 10) -> None:
        """Delete all but the last commits."""
        for number in self.numbers()[:-keep]:
            self.files.delete(self.hadoop.Path(self.root, f"{number:020d}.json"), False)

    def delete(self, name: str) -> None:
        self.files.delete(self.hadoop.Path(f"{self.folder}/{name}"), True)
