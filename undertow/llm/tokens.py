"""Token counts by a compiled finite-state transducer.

The tokenizer is compiled into a deterministic transducer over bytes whose transitions carry the number of
tokens they add (it may be negative, where a longer token swallows shorter ones). A state is what the future
depends on: for each position from which a token may still grow, the bytes since then, the token that ends
there, and the count there relative to now. That a sequence of tokens is the tokenizer's own exactly if each
two neighbours are makes this determined. States are built when first met, up to a bound; then all are
dropped and built anew, so memory is bounded for every input.

A chunk of text maps an entry state to an exit state and a count. A single space between two visible ASCII characters
is a synchronising word of the transducer: it is in one and the same state there whatever came before (tests try all
pairs of such characters). So a chunk's map of all entry states is whole if it tells the count between its first and
last such place and the bytes outside them, whose count waits for the neighbours; a chunk without such a place is its
bytes. Those maps compose associatively, and the up-sweep of a prefix scan composes those of a text.
"""

from __future__ import annotations

import json
from collections.abc import Iterable

import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from undertow.llm.common import as_bytes, held, map_batches

SPACES = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"  # Unicode White_Space
WORDS = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{SPACES}\p{{L}}\p{{N}}]+|[{SPACES}]+(?![^{SPACES}])|[{SPACES}]+"
START = ((b"", None, 0),)


def byte_letters() -> dict[str, int]:
    """The letter that byte-level vocabularies write for each byte, inverted."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class CountTransducer:
    def __init__(self, path: str, max_states: int = 200_000, max_memo: int = 400_000, chunk: int = 1 << 16):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        letters = byte_letters()
        specials = {t["content"] for t in spec["added_tokens"]}
        raw = lambda s: bytes(letters[c] for c in s)
        #: A token's number is its byte, or 256 and the rank of the merge that makes it.
        self.number = {bytes([b]): b for b in range(256)}
        self.halves: list[tuple[int, int]] = [(b, b) for b in range(256)]
        self.joins: dict[tuple[int, int], int] = {}
        for m in spec["model"]["merges"]:
            left, right = map(raw, m if isinstance(m, list) else m.split(" "))
            pair = self.number[left], self.number[right]
            self.joins[pair] = self.number[left + right] = len(self.halves)
            self.halves.append(pair)
        self.growing = {t[:k] for t in self.number for k in range(len(t))}
        self.specials = [s.encode() for s in sorted(specials, key=len, reverse=True)]
        self.special = regex.compile(b"|".join(regex.escape(s) for s in self.specials)) if specials else None
        self.words = regex.compile(WORDS)
        self.memo: dict[bytes, int] = {}
        self.max_states, self.max_memo, self.chunk = max_states, max_memo, chunk
        self.reset()

    def reset(self) -> None:
        self.keys = [START]
        self.ids = {START: 0}
        self.moves: dict[int, int] = {}

    def follows(self, left: int, right: int) -> bool:
        """Whether the tokenizer leaves two tokens side by side as they are.

        Undo the later of the two tokens' merges again and again, looking at what meets at the seam: a pair
        there that merges before the merge just undone would have been taken first, and the two not arise.
        """
        joins, halves, before = self.joins, self.halves, 1 << 30
        while True:
            if joins.get((left, right), 1 << 30) < before:
                return False
            if left > right:
                if left > 255:
                    before, left = left, halves[left][1]
                else:
                    return True
            elif right > 255:
                before, right = right + 1, halves[right][0]
            else:
                return True

    def compiled(self, move: int) -> int:
        """The transition of state move >> 8 on byte move & 255: next state << 10 | emitted tokens + 512."""
        byte, grown, last, emitted = bytes([move & 255]), [], None, 0
        for since, token, count in self.keys[move >> 8]:
            s = since + byte
            if last is None and (number := self.number.get(s)) is not None and (token is None or self.follows(token, number)):
                last, emitted = number, count + 1
            if s in self.growing:
                grown.append((s, token, count))
        key = (*((s, token, count - emitted) for s, token, count in grown), (b"", last, 0))
        state = self.ids.get(key)
        if state is None:
            state = self.ids[key] = len(self.keys)
            self.keys.append(key)
        out = self.moves[move] = state << 10 | emitted + 512
        return out

    def run(self, word: bytes) -> int:
        """Tokens of one word (a match of the pattern that splits texts)."""
        if len(self.keys) > self.max_states:
            self.reset()
        state = total = 0
        known = self.moves.get
        for byte in word:
            move = state << 8 | byte
            out = known(move)
            if out is None:
                out = self.compiled(move)
            state = out >> 10
            total += (out & 1023) - 512
        return total

    def piece(self, piece: bytes) -> int:
        """Tokens of a piece that starts and ends where the transducer is in its starting state."""
        return sum(self.run(w.encode()) for w in self.words.findall(piece.decode("utf-8", "replace")))

    @staticmethod
    def visible(part: bytes, at: int) -> bool:
        """Whether part has a character at its start (at = 0) or end (at = -1), and no white space there."""
        if not part:
            return False
        return 32 < part[at] < 127 or part[at] > 127 and not part.decode("utf-8", "replace")[at].isspace()

    def remembered(self, part: bytes) -> int:
        count = self.memo.get(part)
        if count is None:
            if part.isalpha():  # ASCII letters only, as these are bytes: one word
                count = self.run(b" " + part)
            elif part[-1] in b".," and part[:-1].isalpha():
                return self.remembered(part[:-1]) + self.run(part[-1:])
            else:
                count = self.piece(b" " + part)
            if len(part) <= 64:
                if len(self.memo) >= self.max_memo:
                    self.memo.clear()
                self.memo[part] = count
        return count

    def parts(self, parts: list[bytes]) -> int:
        """Tokens of parts, each with a space before it; the first space is at a fixing place."""
        found = list(map(self.memo.get, parts))
        if None not in found:
            return sum(found)
        loose = []  # parts that may share a token with a neighbour: they have white space at an end
        for i in [i for i, n in enumerate(found) if n is None]:
            if self.visible(parts[i], 0) and self.visible(parts[i], -1):
                found[i] = self.remembered(parts[i])
            else:
                loose.append(i)
        done = -1
        for i in loose:
            if i <= done:
                continue
            low = i - 1 if i and not self.visible(parts[i], 0) else i
            done = i
            while done + 1 < len(parts) and not (self.visible(parts[done], -1) and self.visible(parts[done + 1], 0)):
                done += 1
            found[low : done + 1] = [0] * (done + 1 - low)
            found[low] = self.piece(b"".join(b" " + p for p in parts[low : done + 1]))
        return sum(found)

    def plain(self, text: bytes) -> int:
        """Tokens of a text without special tokens: chunk maps, then their scan."""
        if len(text) <= self.chunk:
            return self.finish(self.chunk_map(text))
        return self.finish(self.scan(self.chunk_map(text[i : i + self.chunk]) for i in range(0, len(text), self.chunk)))

    def chunk_map(self, chunk: bytes):
        """(head, tokens, tail), or (bytes,) without a place that fixes the state."""
        first = self.place(chunk, 1)
        if first < 0:
            return (chunk,)
        last = self.place_back(chunk)
        return chunk[:first], self.parts(self.split(chunk[first:last])) if last > first else 0, chunk[last:]

    @staticmethod
    def split(text: bytes) -> list[bytes]:
        return text[1:].split(b" ") if text else []

    @staticmethod
    def fixes(text: bytes, at: int) -> bool:
        """Whether at stands a space between two visible ASCII characters."""
        return 0 < at < len(text) - 1 and 32 < text[at - 1] < 127 and 32 < text[at + 1] < 127

    def place(self, text: bytes, start: int) -> int:
        at = text.find(b" ", start)
        while at >= 0 and not self.fixes(text, at):
            at = text.find(b" ", at + 1)
        return at

    def place_back(self, text: bytes) -> int:
        at = text.rfind(b" ")
        while at >= 0 and not self.fixes(text, at):
            at = text.rfind(b" ", 0, at)
        return at

    def compose(self, a, b):
        if len(a) == 1:
            return self.joined(a[0], b)
        if len(b) == 1:
            middle = self.chunk_map(a[2] + b[0])
            return (a[0], a[1] + self.lead(middle[0]) + middle[1], middle[2]) if len(middle) == 3 else (a[0], a[1], middle[0])
        return a[0], a[1] + self.lead(a[2] + b[0]) + b[1], b[2]

    def joined(self, left: bytes, b):
        if len(b) == 1:
            return self.chunk_map(left + b[0])
        head = self.chunk_map(left + b[0])
        return (head[0], head[1] + self.lead(head[2]) + b[1], b[2]) if len(head) == 3 else (head[0], b[1], b[2])

    def lead(self, text: bytes) -> int:
        """Tokens of bytes between two fixing places: they start with a space, which parts() puts back."""
        return self.parts(self.split(text)) if text else 0

    def scan(self, maps: Iterable):
        """The composition of all maps, in order, as a counter of the scan's up-sweep: of the prefixes only the last is
        wanted, so no more is held than one map for each power of two."""
        levels: list = []
        for found in maps:
            at = 0
            while at < len(levels) and levels[at] is not None:
                found, levels[at] = self.compose(levels[at], found), None
                at += 1
            levels[at : at + 1] = [found]
        out = None
        for found in levels:
            if found is not None:
                out = found if out is None else self.compose(found, out)
        return out

    def finish(self, whole) -> int:
        if len(whole) == 1:
            return self.piece(whole[0])
        return self.piece(whole[0]) + whole[1] + self.lead(whole[2])

    def count(self, text: bytes) -> int:
        if self.special is None or not any(s in text for s in self.specials):
            return self.plain(text)
        pieces = self.special.split(text)
        return sum(map(self.plain, pieces)) + len(pieces) - 1


def count_tokens(docs: DataFrame, vocabulary: str = "byte_bpe_50k.json", limit: int = 1024) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of every row of docs (doc_id, text; other columns are not read).

    A null or empty text has 0 bytes and 0 tokens; repeated rows give repeated results; an empty table gives
    none. vocabulary names a byte-level BPE file of public_tokenizers. Texts of any length are counted whole,
    by chunks; no shuffle.
    """

    def work(batch):
        import public_tokenizers

        path = public_tokenizers.path(vocabulary)
        machine = held(__name__, lambda: CountTransducer(path), path)
        ids, texts = batch.column(0), as_bytes(batch.column(1))
        tokens = [machine.count(t) if t else 0 for t in texts]
        yield {"doc_id": ids, "n_bytes": [len(t) if t else 0 for t in texts], "n_tokens": tokens, "over_limit": [n > limit for n in tokens]}

    kind = docs.schema["doc_id"].dataType.simpleString()
    return map_batches(docs, [F.col("doc_id"), F.col("text")], f"doc_id {kind}, n_bytes long, n_tokens long, over_limit boolean", work)
