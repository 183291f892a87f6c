"""Packing of tokenized documents into training sequences of several lengths."""

from __future__ import annotations

import json
import os
import struct
import unicodedata

from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from undertow.llm.common import arrow_schema, as_bytes, held
from undertow.llm.tokens import byte_letters

TIERS = (64, 128, 256, 512, 1024, 2048)


class WordIds:
    """Ids of texts, as little-endian unsigned 32-bit bytes, under a tokenizer that drops white space.

    No token of such a tokenizer spans white space, so what stands between ASCII white space is encoded by
    itself, and remembered up to a bound. A unit that is one lower-case word of letters is one piece to the
    tokenizer's merge rules, which tiktoken applies to it at once: a byte that no UTF-8 text has stands for
    the end of the word, and the merges of it with each byte come first, as they do in the vocabulary. All
    other units go through the tokenizers library.
    """

    END = b"\xff"

    def __init__(self, path: str, max_memo: int = 500_000):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import tiktoken
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model, letters = spec["model"], byte_letters()
        end = model["end_of_word_suffix"]
        added = {t["content"] for t in spec["added_tokens"]}
        ranks = {}
        for token, number in model["vocab"].items():
            if token not in added:
                ends = token.endswith(end)
                ranks[bytes(letters[c] for c in (token[: -len(end)] if ends else token)) + self.END * ends] = number
        ranks.setdefault(self.END, max(ranks.values()) + 1)
        for b in range(256):  # tiktoken wants every single byte, met or not
            ranks.setdefault(bytes([b]), (1 << 20) + b)
        self.merges = tiktoken.Encoding("words", pat_str=r"\S+", mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_single_piece
        self.memo: dict[bytes, bytes] = {}
        self.max_memo = max_memo

    def encoded(self, units: list[bytes]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast([u.decode("utf-8", "replace") for u in units], add_special_tokens=False)
        return [struct.pack(f"<{len(ids)}I", *ids) for e in found for ids in (e.ids,)]

    def word(self, word: bytes) -> bytes:
        """Ids of a lower-case word of letters."""
        ids = self.merges(word + self.END)
        return struct.pack(f"<{len(ids)}I", *ids)

    def learn(self, texts: list[list[bytes]]) -> None:
        """Remember the ids of all short units of some texts."""
        if len(self.memo) > self.max_memo:
            self.memo.clear()
        memo, rest = self.memo, []
        for unit in set().union(*texts).difference(memo):
            if len(unit) > 64:
                continue
            word, sign = (unit[:-1], unit[-1:]) if unit[-1:] in (b".", b",") else (unit, b"")
            if word.isalpha():
                ids = self.word(word.lower())
            else:
                try:
                    text = word.decode()
                except UnicodeDecodeError:
                    text = ""
                if not (text.isalpha() and text == text.lower() and unicodedata.is_normalized("NFC", text)):
                    rest.append(unit)
                    continue
                ids = self.word(word)
            memo[unit] = ids + self.sign(sign) if sign else ids
        for at in range(0, len(rest), 50_000):
            part = rest[at : at + 50_000]
            memo.update(zip(part, self.encoded(part), strict=True))

    def sign(self, sign: bytes) -> bytes:
        ids = self.memo.get(sign)
        if ids is None:
            ids = self.memo[sign] = self.encoded([sign])[0]
        return ids

    def ids(self, units: list[bytes]) -> bytes:
        get = self.memo.get
        return b"".join([ids if (ids := get(u)) is not None else self.encoded([u])[0] for u in units])


def pack(lengths: list[int], tiers: tuple[int, ...] = TIERS) -> list[tuple[int, list[tuple[int, int, int]]]]:
    """Sequences of one pool of documents: (tier, pieces as (document, start, length)).

    A document's full windows of the largest tier are sequences of their own; what remains is routed to the
    smallest tier that holds it. Tiers are packed from the largest: each document opens a sequence, whose gap
    is filled with the longest shorter documents that fit and, when none fits any more, with the start of the
    shortest one, whose rest waits on. So every sequence but the last is full. The last one, if short, is cut
    where its length's binary digits say, so it needs no padding either.
    """
    top = tiers[-1]
    waiting: list[list[tuple[int, int]]] = [[] for _ in range(top + 1)]
    sequences = []
    mask = 0
    for doc, length in enumerate(lengths):
        full = length // top
        sequences += [(top, [(doc, i * top, top)]) for i in range(full)]
        if rest := length - full * top:
            waiting[rest].append((doc, full * top))
            mask |= 1 << rest

    def take(size: int) -> tuple[int, int]:
        nonlocal mask
        item = waiting[size].pop()
        if not waiting[size]:
            mask &= ~(1 << size)
        return item

    while mask:
        size = mask.bit_length() - 1
        tier = next(t for t in tiers if t >= size)
        doc, start = take(size)
        pieces, gap = [(doc, start, size)], tier - size
        while gap and mask:
            size = (mask & (1 << gap + 1) - 1).bit_length() - 1
            if size > 0:
                doc, start = take(size)
                pieces.append((doc, start, size))
            else:
                longer = (mask & -mask).bit_length() - 1
                doc, start = take(longer)
                size = gap
                pieces.append((doc, start, size))
                waiting[longer - size].append((doc, start + size))
                mask |= 1 << longer - size
            gap -= size
        if not gap:
            sequences.append((tier, pieces))
            continue
        left = tier - gap
        for bit in range(left.bit_length() - 1, -1, -1):  # the last pieces of all
            room, part = left & 1 << bit, []
            while room:
                doc, start, size = pieces[0]
                cut = min(size, room)
                part.append((doc, start, cut))
                room -= cut
                pieces[:1] = [(doc, start + cut, size - cut)] if cut < size else []
            if part:
                sequences.append((1 << bit, part))
    return sequences


def step_groups(sizes: list[int], group: int) -> list[int]:
    """A group number for each sequence: dealt by size in turns, so that groups hold about equal tokens."""
    n = -(-len(sizes) // group)
    order = sorted(range(len(sizes)), key=lambda i: -sizes[i])
    out = [0] * len(sizes)
    for rank, i in enumerate(order):
        turn, at = divmod(rank, n)
        out[i] = at if turn % 2 == 0 else n - 1 - at
    return out


def pack_documents(docs: DataFrame, vocabulary: str = "word_bpe_49k.json", end_id: int = 1, tiers: tuple[int, ...] = TIERS, pool_tokens: int = 4_000_000, group: int = 8) -> DataFrame:
    """Pieces of all documents in sequences of at most tiers[-1] tokens.

    Columns: doc_id, start, length, ids (binary, little-endian unsigned 32-bit), doc_tokens (with end_id),
    sequence_id, offset, tier (the sequence's length, a power of two), step_group. A null or empty text is
    end_id alone. Rows that repeat are packed as often as they stand; an empty table gives no rows. Each task
    packs pools of about pool_tokens tokens as they arrive, so nothing is shuffled and memory is bounded by
    a pool and a document; sequence_id and step_group are the task's number times 2**32 and a count.
    """
    if any(t & t - 1 for t in tiers):
        raise ValueError("tiers must be powers of two")

    def pool(state: dict, waiting: list[tuple]) -> dict:
        sequences = pack([len(ids) // 4 for _, ids in waiting], tiers)
        groups = step_groups([t for t, _ in sequences], group)
        out: dict[str, list] = {k: [] for k in ("doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset", "tier", "step_group")}
        for n, (tier, pieces) in enumerate(sequences):
            offset = 0
            for doc, start, length in pieces:
                doc_id, ids = waiting[doc]
                row = doc_id, start, length, ids[4 * start : 4 * (start + length)], len(ids) // 4, state["base"] + state["sequences"] + n, offset, tier, state["base"] + state["groups"] + groups[n]
                for column, value in zip(out.values(), row, strict=True):
                    column.append(value)
                offset += length
        state["sequences"] += len(sequences)
        state["groups"] += max(groups, default=-1) + 1
        return out

    def run(batches):
        import public_tokenizers
        import pyarrow as pa

        path = public_tokenizers.path(vocabulary)
        words = held(__name__, lambda: WordIds(path), path)
        context = TaskContext.get()
        state = {"base": (context.partitionId() if context else 0) << 32, "sequences": 0, "groups": 0}
        end, waiting, size = end_id.to_bytes(4, "little"), [], 0
        record = lambda out: pa.RecordBatch.from_arrays([pa.array(out[f.name], f.type) for f in arrow], schema=arrow)
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), as_bytes(batch.column(1))
            for at in range(0, len(texts), 256):
                units = [(t or b"").split() for t in texts[at : at + 256]]
                words.learn(units)
                for doc_id, u in zip(ids[at : at + 256], units, strict=True):
                    waiting.append((doc_id, words.ids(u) + end))
                    size += len(waiting[-1][1]) // 4
                    if size >= pool_tokens:
                        yield record(pool(state, waiting))
                        waiting, size = [], 0
        if waiting:
            yield record(pool(state, waiting))

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema, arrow = arrow_schema(f"doc_id {kind}, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long, tier int, step_group long")
    return docs.select("doc_id", "text").mapInArrow(run, schema)


def digests(pieces: DataFrame) -> DataFrame:
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "tier", "step_group")
