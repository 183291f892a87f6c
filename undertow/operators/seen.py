"""Small memories of keys that were seen."""

from __future__ import annotations

from typing import Protocol


class Deduper(Protocol):
    def seen(self, key: str) -> bool:
        """True if key is known, else remember it."""


class FifoDeduper:
    """Remembers the last most keys in order of first sight; a hit does not renew a key's place."""

    def __init__(self, most: int = 50_000):
        self.most, self.keys = most, {}

    def seen(self, key: str) -> bool:
        if key in self.keys:
            return True
        self.keys[key] = None
        if len(self.keys) > self.most:
            self.keys.pop(next(iter(self.keys)))
        return False
