"""Structure repair of conversations: the cheapest edits after which roles alternate."""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from undertow.llm.common import arrow_schema, frozen

DELETE, REROLE, INSERT, LEFT_TRUNCATED = 3, 2, 2, 1
ROLES = {"u": "user", "a": "assistant"}
#: The last retained turn: none yet, a system turn, a user's, an assistant's.
NONE, SYSTEM, USER, ASSISTANT = range(4)
#: How many turns must be inserted between a last retained turn and one of the next role, where that is allowed.
BETWEEN = {USER: {NONE: 0, SYSTEM: 0, USER: 1, ASSISTANT: 0}, ASSISTANT: {NONE: 1, SYSTEM: 1, USER: 0, ASSISTANT: 1}, SYSTEM: {NONE: 0}}
#: How many must be inserted after the last retained turn.
AFTER = {NONE: 0, SYSTEM: 2, USER: 1, ASSISTANT: 0}
OF_INITIAL = {"s": SYSTEM, "u": USER, "a": ASSISTANT}
BLANK, DUPLICATE, TRUNCATED = 1, 2, 3


class Edits:
    """The cheapest edits of one conversation, fed turn by turn.

    A state is the role of the last retained turn. Its running minimum is the least of what a turn retained in that role
    costs, less the price of deleting all turns up to it; the prefix sum of deletions up to a later turn, added, prices the
    gap between the two. Of equally cheap edits the audit that is least as ASCII wins. Audits of two states hold as many
    letters of turns and end with one, so neither begins the other, and one letter more keeps their order; hence a rank
    among four states stands for them. A turn leaves three bytes, by which the audit is read backwards in the end.
    """

    def __init__(self) -> None:
        self.deletions = 0  # the prefix sum
        self.least: list[int | None] = [0, None, None, None]
        self.rank = [0, 1, 2, 3]
        self.back = {state: bytearray() for state in (SYSTEM, USER, ASSISTANT)}

    def feed(self, initial: str, fault: int) -> None:
        found = {}
        if fault not in (BLANK, DUPLICATE):
            own = OF_INITIAL.get(initial)
            for state in (SYSTEM, USER, ASSISTANT):
                if own == state or state != SYSTEM:
                    letter, cost = ("K", 0) if own == state else ("R", REROLE)
                    cost += LEFT_TRUNCATED if fault == TRUNCATED else 0
                    ways = [(self.least[before] + self.deletions + INSERT * n + cost, self.rank[before], "I" * n + letter, before) for before, n in BETWEEN[state].items() if self.least[before] is not None]
                    if ways:
                        found[state] = min(ways)
        self.deletions += DELETE
        least, audits = list(self.least), [(self.rank[state], "D") for state in range(4)]
        for state, back in self.back.items():
            code = 0
            if state in found:
                cost, rank, letters, before = found[state]
                cost -= self.deletions
                if least[state] is None or (cost, (rank, letters)) < (least[state], audits[state]):
                    least[state], audits[state] = cost, (rank, letters)
                    code = 1 + before * 4 + (len(letters) - 1) * 2 + (letters[-1] == "R")
            back.append(code)
        order = sorted(range(4), key=lambda state: audits[state])
        self.least, self.rank = least, [order.index(state) for state in range(4)]

    def close(self) -> tuple[int, str]:
        """Cost and audit."""
        cost, _, n, state = min((self.least[s] + self.deletions + INSERT * n, self.rank[s], n, s) for s, n in AFTER.items() if self.least[s] is not None)
        audit = bytearray(b"I" * n)
        for i in range(len(self.back[USER]) - 1, -1, -1):
            code = self.back[state][i] if state != NONE else 0
            if not code:
                audit += b"D"
                continue
            code -= 1
            audit += (b"R" if code & 1 else b"K") + b"I" * (code >> 1 & 1)
            state = code >> 2
        return cost, bytes(reversed(audit)).decode()


def damaged(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, lost of conversations with faults put in, as crc32 of `conv_id:turn` modulo 20 says.

    0 loses the turn (the row stays, with lost true), 1 empties its text, 2 takes `.`, `!` and `?` out of it, 3 has it twice,
    4 gives it the role user. Nulls are one space, in the key, the roles and the texts. Columns of other names are left out.
    """
    part = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = conversations.select("conv_id", "turn", part("role").alias("role"), part("text").alias("text"), (F.crc32(F.concat(part("conv_id"), F.lit(":"), part("turn")).cast("binary")) % 20).alias("fate"))
    text = F.when(F.col("fate") == 1, "").when(F.col("fate") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("fate") == 4, "user").otherwise(F.col("role"))
    copies = F.explode(F.array_repeat(F.lit(1), F.when(F.col("fate") == 3, 2).otherwise(1)))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), (F.col("fate") == 0).alias("lost"), copies.alias("copy")).drop("copy")


def marked(rows: DataFrame) -> DataFrame:
    """rows with mark (128 bits of the text's SHA-256) and fault: of each turn the first of blank, duplicate and truncated.

    A turn is a duplicate if one of its role and text stands earlier. The first turn number of each role and text that a
    conversation has twice is counted before the shuffle and joined back, so no conversation is gathered; among rows of one
    turn number all but the first in order are duplicates, which is left to the reader of the ordered rows (fault null).
    """
    mark = F.unhex(F.substring(F.sha2("text", 256), 1, 32))
    rows = rows.select("*", F.when(F.col("lost"), None).otherwise(mark).alias("mark"))
    key = ["conv_id", "role", "mark"]
    twice = rows.where("not lost").groupBy(*key).agg(F.count("*").alias("n"), F.count_if(F.col("turn").isNull()).alias("nulls"), F.min("turn").alias("least")).where("n > 1")
    twice = frozen(twice.select(F.col("conv_id").alias("c"), F.col("role").alias("r"), F.col("mark").alias("m"), "nulls", "least"))
    joined = rows.join(twice, rows.conv_id.eqNullSafe(twice.c) & (rows.role == twice.r) & (rows.mark == twice.m), "left")
    end = F.regexp_extract("text", r"([^\x20\x09-\x0D])[\x20\x09-\x0D]*\z", 1)
    later = F.col("turn").isNotNull() & ((F.col("nulls") > 0) | (F.col("turn") > F.col("least")))
    unsure = F.col("r").isNotNull()  # another row may have its turn number
    fault = F.when(end == "", BLANK).when(later, DUPLICATE).when(unsure, None).when(end.isin(".", "!", "?"), 0).otherwise(TRUNCATED)
    return joined.select("conv_id", "turn", "role", "text", "lost", "mark", fault.alias("fault"), F.when(end.isin(".", "!", "?"), 0).otherwise(TRUNCATED).alias("else_fault"))


def ordered(rows: DataFrame, *first: str) -> DataFrame:
    """rows dealt out by conversation, each in order: by turn (nulls first), rows of one turn by role and mark."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(n, "conv_id").sortWithinPartitions("conv_id", *first, F.col("turn").asc_nulls_first(), "role", "mark")


STATS = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"


def examined(rows: DataFrame) -> DataFrame:
    """conv_id and STATS of every conversation of marked rows, which pass through without their texts, one at a time."""
    kind = rows.schema["conv_id"].dataType.simpleString()
    schema, arrow = arrow_schema(f"conv_id {kind}, {STATS}")

    def report(conv_id, turns: Iterable[tuple]) -> dict:
        """What a conversation's turns (turn, initial, role, mark, lost, fault, else_fault), in order, come to."""
        edits, counts = Edits(), [0] * 4
        illegal = distinct = 0
        lowest = highest = before = initial_before = None
        for turn, initial, role, mark, lost, fault, else_fault in turns:
            if lost:
                continue
            if fault is None:
                fault = DUPLICATE if before == (turn, role, mark) else else_fault
            if turn is not None and turn != highest:
                lowest, highest, distinct = turn if lowest is None else lowest, turn, distinct + 1
            before = (turn, role, mark)
            if initial_before is not None and initial_before + initial not in ("su", "ua", "au"):
                illegal += 1
            initial_before = initial
            counts[fault] += 1
            edits.feed(initial, fault)
        cost, audit = edits.close()
        gaps = highest - lowest + 1 - distinct if distinct else 0
        return {"conv_id": conv_id, "gaps": gaps, "blank": counts[BLANK], "duplicate": counts[DUPLICATE], "truncated": counts[TRUNCATED], "illegal": illegal, "cost": cost, "audit": audit}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: list[dict] = []
        size = 0
        for conv_id, turns in grouped(batches):
            done.append(report(conv_id, turns))
            size += 64 + len(done[-1]["audit"])
            if size > 1 << 20:
                yield pa.RecordBatch.from_pylist(done, schema=arrow)
                done, size = [], 0
        if done:
            yield pa.RecordBatch.from_pylist(done, schema=arrow)

    narrow = rows.select("conv_id", "turn", F.substring("role", 1, 1).alias("initial"), "role", "mark", "lost", "fault", "else_fault")
    return ordered(narrow).mapInArrow(run, schema)


def grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[object, Iterator[tuple]]]:
    """(key, rows) of rows that are ordered by their first column, which the rows then lack; nothing but a batch is held."""
    rows = (row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns), strict=True))
    row = next(rows, None)

    def of(key) -> Iterator[tuple]:
        nonlocal row
        while row is not None and row[0] == key:
            yield row[1:]
            row = next(rows, None)

    while row is not None:
        key = row[0]
        group = of(key)
        yield key, group
        for _ in group:  # what the taker has left
            pass


def _stream(rows: DataFrame, reports: DataFrame) -> DataFrame:
    """conv_id, second (false: a report), STATS, role and text: every conversation's report and behind it its turns in order."""
    stats = [f.split()[0] for f in STATS.split(", ")]
    none = lambda *names: [F.lit(None).cast(rows.schema[n].dataType).alias(n) for n in names]
    heads = reports.select("conv_id", F.lit(False).alias("second"), *stats, *none("turn", "role", "mark", "text"))
    turns = rows.where("not lost").select("conv_id", F.lit(True).alias("second"), *[F.lit(None).cast(reports.schema[s].dataType).alias(s) for s in stats], "turn", "role", "mark", "text")
    return ordered(heads.union(turns), "second").select("conv_id", "second", *stats, "role", "text")


def edited(audit: str, turns: Iterator[tuple[str, str]]) -> Iterator[tuple[str, str, str]]:
    """(edit, role, text) of the turns that stay or are inserted, in order."""
    following = ""
    for letter in audit:
        if letter == "D":
            next(turns)
            continue
        role, text = ("", "") if letter == "I" else next(turns)
        if letter != "K":
            role = ROLES["a" if following == "a" else "u"]
        following = "a" if role[:1] == "u" else "u"
        yield letter, role, text


def repaired(conversations: DataFrame) -> DataFrame:
    """conv_id, position, role, text and edit of what conversations (conv_id, turn, role, text) are after repair.

    See reports for what is repaired. position counts from 0 within a conversation; edit is K (kept), R (another role) or I
    (inserted, with an empty text). Conversations of which nothing stays have no rows.
    """
    rows, reports = _read(conversations)
    kind = conversations.schema["conv_id"].dataType.simpleString()
    schema, arrow = arrow_schema(f"conv_id {kind}, position long, role string, text string, edit string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, size = [], 0
        for conv_id, group in grouped(batches):
            audit = next(group)[-3]
            for position, (edit, role, text) in enumerate(edited(audit, (row[-2:] for row in group))):
                out.append({"conv_id": conv_id, "position": position, "role": role, "text": text, "edit": edit})
                size += 64 + len(text)
                if size > 1 << 20:
                    yield pa.RecordBatch.from_pylist(out, schema=arrow)
                    out, size = [], 0
        if out:
            yield pa.RecordBatch.from_pylist(out, schema=arrow)

    return _stream(rows, reports).mapInArrow(run, schema)


def _read(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """marked rows, written once, and their reports."""
    names = ["conv_id", "turn", *(F.coalesce(F.col(c), F.lit(" ")).alias(c) for c in ("role", "text"))]
    lost = F.coalesce(F.col("lost"), F.lit(False)) if "lost" in conversations.columns else F.lit(False)
    rows = frozen(marked(conversations.select(*names, lost.alias("lost"))))
    return rows, examined(rows)


def reports(conversations: DataFrame) -> DataFrame:
    """What is wrong with every conversation of conversations (conv_id, turn, role, text), and what mends it cheapest.

    gaps, blank, duplicate, truncated and illegal count turn numbers that are missing, turns by their first fault, and
    neighbours whose roles don't follow one another. cost and audit are those of the cheapest edits after which roles read
    system (or not), then user and assistant in turn, ending with assistant; or nothing stays. Keep costs 0, rerole to user
    or assistant 2, delete 3, which blank turns and duplicates must be, insert an empty turn 2; a truncated turn that stays
    costs 1. Of equally cheap edits the audit that is least as ASCII is given.

    Rows of one turn number stand by role and by the SHA-256 of their texts; null turns come first and make no gaps. A null
    role or text is one space; rows without conv_id are one conversation. A boolean column lost marks rows that are not
    there but name a conversation; other columns are not read. Roles count by their first character; one that is no s, u or
    a, and an empty one, can't be kept. Texts are read whole in the JVM, a conversation of any length passes row by row and
    leaves a few bytes for each turn. An empty table gives none.
    """
    return _read(conversations)[1]


def digests(conversations: DataFrame) -> DataFrame:
    """reports with repaired_sha256: of what stays, as `role:text` and joined by newlines. It is read in one stream."""
    rows, found = _read(conversations)
    kind = conversations.schema["conv_id"].dataType.simpleString()
    schema, arrow = arrow_schema(f"conv_id {kind}, {STATS}, repaired_sha256 string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, size = [], 0
        for conv_id, group in grouped(batches):
            head = next(group)
            digest = hashlib.sha256()
            for i, (_, role, text) in enumerate(edited(head[-3], (row[-2:] for row in group))):
                digest.update(f"{chr(10) * (i > 0)}{role}:{text}".encode())
            out.append(dict(zip(arrow.names, (conv_id, *head[1:-2], digest.hexdigest()), strict=True)))
            size += 128 + len(head[-3])
            if size > 1 << 20:
                yield pa.RecordBatch.from_pylist(out, schema=arrow)
                out, size = [], 0
        if out:
            yield pa.RecordBatch.from_pylist(out, schema=arrow)

    return _stream(rows, found).mapInArrow(run, schema)


def _sql() -> str:
    """The edits turn by turn: m0 to m3 are the states' least cost (c), audit (a) and repaired text so far (t)."""
    line = lambda before, *lines: f"CASE WHEN {before} = '' THEN '' ELSE {before} || chr(10) END || " + " || chr(10) || ".join(lines)

    def way(state: int, before: int, own: str, letter: str, role: str, when: str) -> str:
        n = BETWEEN[state][before]
        inserted = ["'assistant:'" if state == USER else "'user:'"] * n
        return f"CASE WHEN m{before} IS NOT NULL AND {when} THEN {{'c': m{before}.c + {INSERT * n} + {own}, 'a': m{before}.a || '{'I' * n}{letter}', 't': {line(f'm{before}.t', *inserted, role + chr(32) + '|| chr(58) || text')}}} END"

    def least(ways: list[str]) -> str:
        return f"list_sort(list_filter([{', '.join(ways)}], lambda x: x IS NOT NULL))[1]"

    steps = []
    for state, letter in ((NONE, ""), (SYSTEM, "s"), (USER, "u"), (ASSISTANT, "a")):
        ways = [f"CASE WHEN m{state} IS NOT NULL THEN {{'c': m{state}.c + {DELETE}, 'a': m{state}.a || 'D', 't': m{state}.t}} END"]
        for before in BETWEEN.get(state, ()):
            own = f"(fault = {TRUNCATED})::INT"
            ways.append(way(state, before, own, "K", "role", f"fault IN (0, {TRUNCATED}) AND role[1:1] = '{letter}'"))
            if letter in ROLES:
                ways.append(way(state, before, f"{REROLE} + {own}", "R", f"'{ROLES[letter]}'", f"fault IN (0, {TRUNCATED})"))
        steps.append(f"{least(ways)} AS m{state}")
    ends = ["m0", f"CASE WHEN m1 IS NOT NULL THEN {{'c': m1.c + 4, 'a': m1.a || 'II', 't': {line('m1.t', chr(39) + 'user:' + chr(39), chr(39) + 'assistant:' + chr(39))}}} END", f"CASE WHEN m2 IS NOT NULL THEN {{'c': m2.c + 2, 'a': m2.a || 'I', 't': {line('m2.t', chr(39) + 'assistant:' + chr(39))}}} END", "m3"]
    kind = "STRUCT(c BIGINT, a VARCHAR, t VARCHAR)"
    return rf"""
WITH RECURSIVE crc AS (
  SELECT list_transform(range(256), lambda b: list_reduce(list_prepend(b, [0, 0, 0, 0, 0, 0, 0, 0]), lambda c, z: xor(c >> 1, CASE WHEN c & 1 = 1 THEN 3988292384 ELSE 0 END))) AS t),
k AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         xor(list_reduce(list_prepend(4294967295, list_transform(string_split(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '), ''), lambda x: CAST(ascii(x) AS BIGINT))),
                         lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])), 4294967295) % 20 AS fate
  FROM conversations, crc),
d AS (
  SELECT conv_id, turn, CASE fate WHEN 4 THEN 'user' ELSE role END AS role, unnest(range(CASE fate WHEN 3 THEN 2 ELSE 1 END)) AS copy,
         CASE fate WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text FROM k WHERE fate <> 0),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text)) AS i, regexp_extract(text, '([^\x20\x09-\x0D])[\x20\x09-\x0D]*\z', 1) AS final FROM d),
f AS (
  SELECT *, CASE WHEN final = '' THEN {BLANK} WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN {DUPLICATE} WHEN final IN ('.', '!', '?') THEN 0 ELSE {TRUNCATED} END AS fault,
         lag(role[1:1]) OVER (PARTITION BY conv_id ORDER BY i) || role[1:1] AS pair FROM o),
every AS (SELECT DISTINCT conv_id FROM conversations),
m AS (
  SELECT conv_id, CAST(0 AS BIGINT) AS i, CAST({{'c': 0, 'a': '', 't': ''}} AS {kind}) AS m0, CAST(NULL AS {kind}) AS m1, CAST(NULL AS {kind}) AS m2, CAST(NULL AS {kind}) AS m3 FROM every
  UNION ALL
  SELECT m.conv_id, f.i, {", ".join(steps)}
  FROM m JOIN f ON m.conv_id IS NOT DISTINCT FROM f.conv_id AND f.i = m.i + 1),
e AS (SELECT conv_id, {least(ends)} AS m FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY i DESC) AS z FROM m) WHERE z = 1),
s AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = {BLANK}) AS blank, count(*) FILTER (fault = {DUPLICATE}) AS duplicate,
         count(*) FILTER (fault = {TRUNCATED}) AS truncated, count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal FROM f GROUP BY conv_id)
SELECT e.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
       m.c AS cost, m.a AS audit, sha256(m.t) AS repaired_sha256
FROM e LEFT JOIN s ON e.conv_id IS NOT DISTINCT FROM s.conv_id
"""


#: The result of digests(damaged(conversations)).
SQL = _sql()
