"""Transports that need no network, to try the feed source with."""

from __future__ import annotations

import json


def numbered(cursor: str) -> tuple[list[str], str]:
    """Six records in two batches of three."""
    start = int(cursor or 0)
    end = min(start + 3, 6)
    return [json.dumps({"n": i}) for i in range(start, end)], str(end)


def counted(cursor: str) -> tuple[list[str], str]:
    """Three records a fetch, of two fetches behind each other, which tell how often the file at the first cursor's path
    was asked: another answer each time, as of a live feed."""
    path, _, done = cursor.partition("#")
    if done == "2":
        return [], cursor
    with open(path, "a+", encoding="utf-8") as file:
        file.write(".")
        file.seek(0)
        asked = len(file.read())
    return [json.dumps({"asked": asked * 10 + i}) for i in range(3)], f"{path}#{int(done or 0) + 1}"
