"""Licence scans: notice phrases and identifier tags by one Aho-Corasick pass, expressions by shunting-yard."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from undertow.llm.common import as_bytes, held, map_batches

#: Phrases that count as base places, with their labels.
BASE = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
#: Notices that the method adds.
NOTICES = {
    "gnu lesser general public license": "lgpl", "gnu affero general public license": "agpl", "mozilla public license": "mpl", "eclipse public license": "epl",
    "bsd license": "bsd", "redistribution and use in source and binary forms": "bsd", "permission is hereby granted free of charge to any person obtaining a copy": "mit",
    "creative commons attribution": "cc-by", "creative commons zero": "cc0", "isc license": "isc", "boost software license": "bsl", "all rights reserved": "proprietary",
}
TAG = "spdx license identifier"
#: First parts of identifiers and their family labels, the longest first.
FAMILIES = (("agpl", "agpl"), ("lgpl", "lgpl"), ("gpl", "gpl"), ("apache", "apache"), ("cc-by", "cc-by"), ("cc0", "cc0"), ("mit", "mit"), ("bsd", "bsd"), ("mpl", "mpl"), ("epl", "epl"), ("isc", "isc"), ("bsl", "bsl"), ("unlicense", "unlicense"))
PERMISSIVE = {"apache", "mit", "bsd", "isc", "bsl", "cc0", "cc-by", "unlicense"}
#: Bytes that stand in no word become spaces, and A-Z lower case.
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b > 127 else 32 for b in range(256))
RAW_TAG = "spdx-license-identifier"
#: What follows a tag: a colon, then characters of an expression, up to any other or to the next tag.
EXPRESSION = re.compile(rb"\s*:\s*((?:(?!spdx-license-identifier)[a-z0-9.+\-() \t])+)", re.I)
RANK = {"or": 1, "and": 2, "with": 3}


def family(identifier: str) -> str | None:
    return next((label for start, label in FAMILIES if identifier.startswith(start)), None)


def to_postfix(expression: str) -> list[str] | None:
    """A licence expression in postfix order by shunting-yard: with binds before and, and before or.

    Text after a complete expression is left aside; None if there is none or a bracket stays open.
    """
    out: list[str] = []
    stack: list[str] = []
    operand_next = True
    for token in re.findall(r"[()]|[a-z0-9.+\-]+", expression.lower()):
        if token == "(":
            if not operand_next:
                break
            stack.append(token)
        elif token == ")":
            if operand_next or "(" not in stack:
                break
            while stack[-1] != "(":
                out.append(stack.pop())
            stack.pop()
        elif token in RANK:
            if operand_next:
                return None
            while stack and stack[-1] != "(" and RANK[stack[-1]] >= RANK[token]:
                out.append(stack.pop())
            stack.append(token)
            operand_next = True
        else:
            if not operand_next:
                break
            out.append(token)
            operand_next = False
    if operand_next or "(" in stack:
        return None
    return out + stack[::-1]


def evaluate(postfix: list[str]) -> tuple[set[str], bool]:
    """Families named, and whether some choice of the alternatives is permissive throughout."""
    stack: list[tuple[set[str], bool]] = []
    for token in postfix:
        if token in RANK:
            (right, r), (left, l) = stack.pop(), stack.pop()
            stack.append((left, l) if token == "with" else (left | right, l or r if token == "or" else l and r))
        else:
            label = family(token)
            stack.append(({label} if label else set(), label in PERMISSIVE))
    return stack[0]


def machines() -> tuple:
    """The automaton of phrases over folded words, and that of tags over lower-case text."""
    import ahocorasick

    phrases, tags = ahocorasick.Automaton(), ahocorasick.Automaton()
    for phrase, label in (NOTICES | BASE).items():
        phrases.add_word(f" {phrase} ", (label, phrase in BASE, len(phrase) + 2))
    phrases.add_word(f" {TAG} ", (TAG, False, len(TAG) + 2))
    tags.add_word(RAW_TAG, True)
    phrases.make_automaton()
    tags.make_automaton()
    return phrases, tags


def tagged_expressions(text: bytes) -> list[bytes]:
    """What stands behind each identifier tag, to its end. Latin-1 keeps a character a byte, so places are the text's."""
    ends = [end + 1 for end, _ in held(__name__, machines)[1].iter(text.lower().decode("latin-1"))]
    return [found[1] for found in (EXPRESSION.match(text, end) for end in ends) if found]


def scan(text: bytes) -> tuple:
    """(n_words, places, base labels, all labels, expressions, permissive) of one text; places: (first word, label, base)."""
    words = text.translate(FOLD).split()
    folded = f" {b' '.join(words).decode('utf-8', 'replace')} "
    places, base, more, expressions, free = [], set(), set(), [], []
    tagged, seen, at = False, 0, 0
    for end, (label, own, length) in held(__name__, machines)[0].iter(folded):
        start = end - length + 1
        if label == TAG:
            tagged = True
            continue
        if start < at:
            first = folded.count(" ", 0, start)
        else:
            first = seen = seen + folded.count(" ", at, start)
            at = start
        places.append((first, label, own))
        (base if own else more).add(label)
    if tagged:
        for found in tagged_expressions(text):
            postfix = to_postfix(found.decode("ascii"))
            if postfix:
                labels, permissive = evaluate(postfix)
                more |= labels
                expressions.append(" ".join(postfix))
                free.append(permissive)
    permissive = all(free) if free else None
    return len(words), sorted(places), base, base | more, expressions, permissive


def scan_licenses(docs: DataFrame) -> DataFrame:
    """Licence evidence of every row of docs (doc_id, text; other columns are not read).

    Columns: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, places (first word,
    label, base), expressions (postfix), permissive (of tags; null without one). A null or empty text has no
    words, labels '' and score 0. score is 1 for a readable tag, else 1 - 2**-n for n places of any phrase.
    Repeated rows give repeated results, an empty table none. Whole texts, however long, and whole expressions,
    each read behind the tag that the automaton finds; of places at one word the labels stand in order; no shuffle.
    """

    def work(batch):
        found = [scan(t) if t else (0, [], set(), set(), [], None) for t in as_bytes(batch.column(1))]
        firsts = [[p[0] for p in f[1] if p[2]] for f in found]
        yield {
            "doc_id": batch.column(0), "n_words": [f[0] for f in found], "n_base": [len(x) for x in firsts],
            "first_word": [min(x, default=None) for x in firsts], "last_word": [max(x, default=None) for x in firsts],
            "base_labels": [",".join(sorted(f[2])) for f in found], "labels": [",".join(sorted(f[3])) for f in found],
            "score": [1.0 if f[4] else 1 - 0.5 ** len(f[1]) for f in found],
            "places": [[{"word": a, "label": b, "base": c} for a, b, c in f[1]] for f in found], "expressions": [f[4] for f in found], "permissive": [f[5] for f in found],
        }

    kind = docs.schema["doc_id"].dataType.simpleString()
    ddl = f"doc_id {kind}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, places array<struct<word:long,label:string,base:boolean>>, expressions array<string>, permissive boolean"
    return map_batches(docs, [F.col("doc_id"), F.col("text")], ddl, work)
