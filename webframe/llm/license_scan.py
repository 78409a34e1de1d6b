"""License scans: Aho-Corasick for tags and notices, a shunting-yard parser for licence expressions.

Texts become words (A-Z lower-cased; digits, letters and everything beyond ASCII)
with single spaces, in which an automaton finds all phrases in one pass. Where it
finds the tag of a licence identifier, the expression behind the tag is parsed by
operator precedence (with, and, or) and worked out to the choices it offers.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from webframe.llm.common import with_text
from webframe.llm.words import chunks

#: The base phrases and their labels.
BASE = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
#: Further notices; label and how sure one of them alone makes.
NOTICES = {
    "gnu lesser general public license": ("lgpl", 0.9), "gnu affero general public license": ("agpl", 0.9),
    "mozilla public license": ("mpl", 0.9), "eclipse public license": ("epl", 0.9), "bsd license": ("bsd", 0.9),
    "isc license": ("isc", 0.9), "boost software license": ("boost", 0.9),
    "creative commons attribution": ("cc-by", 0.9), "creative commons zero": ("cc0", 0.9),
    "permission is hereby granted free of charge to any person obtaining a copy": ("mit", 0.95),
    "redistribution and use in source and binary forms": ("bsd", 0.95),
    "released into the public domain": ("public-domain", 0.8), "all rights reserved": ("reserved", 0.5),
}
TAG = "spdx license identifier"
BASE_SURE, TAG_SURE = 0.8, 0.98
#: Beginnings of identifiers, longest first where one begins another.
IDENTIFIERS = (
    ("agpl", "agpl"), ("lgpl", "lgpl"), ("gpl", "gpl"), ("apache", "apache"), ("mit", "mit"), ("bsd", "bsd"),
    ("mpl", "mpl"), ("epl", "epl"), ("isc", "isc"), ("bsl", "boost"), ("cc0", "cc0"), ("cc-by", "cc-by"),
    ("unlicense", "public-domain"),
)
OTHER = "other"
_RANK = {"or": 1, "and": 2, "with": 3}
_KEEP = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))
_EXPRESSION = re.compile(r"spdx[^0-9a-z\x80-\U0010ffff]+license[^0-9a-z\x80-\U0010ffff]+identifier[ \t:=]*", re.ASCII)
_TOKEN = re.compile(r"[()]|[^\s()]+")
_NEXT = re.compile(r"[^\S\n\r]*([()]|[0-9a-z][0-9a-z.+:_-]*)", re.ASCII)


def leading(text: str, at: int) -> str:
    """The longest well-formed expression that begins at a place of a lower-case text; it ends with the line at the latest."""
    tokens, best, depth, operand = [], 0, 0, False
    while m := _NEXT.match(text, at):
        at, token = m.end(), m[1]
        if token == "(":
            fits, depth = not operand, depth + 1
        elif token == ")":
            fits, depth = operand and depth > 0, depth - 1
        elif token in _RANK:
            fits, operand = operand, False
        else:
            fits, operand = not operand, True
        if not fits:
            break
        # Signs at the end of an identifier belong to what follows it.
        bare = token.rstrip(".:_-")
        tokens.append(bare)
        if operand and not depth:
            best = len(tokens)
        if bare != token:
            break
    return " ".join(tokens[:best])


def postfix(expression: str) -> list[str] | None:
    """The tokens of an expression in postfix order, or None if it is not well-formed."""
    out, waiting, operand = [], [], False
    for token in _TOKEN.findall(expression.lower()):
        if token in _RANK:
            if not operand:
                return None
            while waiting and waiting[-1] != "(" and _RANK[waiting[-1]] >= _RANK[token]:
                out.append(waiting.pop())
            waiting.append(token)
            operand = False
        elif token == ")":
            if not operand:
                return None
            while waiting and waiting[-1] != "(":
                out.append(waiting.pop())
            if not waiting:
                return None
            waiting.pop()
        elif operand:
            return None
        elif token == "(":
            waiting.append(token)
        else:
            out.append(token)
            operand = True
    if not operand or "(" in waiting:
        return None
    return out + waiting[::-1]


def choices(expression: str) -> list[frozenset[str]]:
    """The least sets of labels that an expression lets one choose from; none if it is not well-formed."""
    stack: list[set[frozenset[str]]] = []
    for token in postfix(expression) or ():
        if token not in _RANK:
            stack.append({frozenset([token])})
            continue
        b, a = stack.pop(), stack.pop()
        if token == "with":  # an exception leaves the licence as it is
            stack.append(a)
        else:
            both = a | b if token == "or" else {x | y for x in map(_labelled, a) for y in map(_labelled, b)}
            stack.append({x for x in both if not any(y < x for y in both)})
    return sorted({_labelled(x) for x in stack[0]}, key=sorted) if stack else []


def _labelled(ids: frozenset[str]) -> frozenset[str]:
    known = {label for _, label in IDENTIFIERS} | {OTHER}
    return frozenset(i if i in known else next((label for start, label in IDENTIFIERS if i.startswith(start)), OTHER) for i in ids)


def automaton():
    import ahocorasick

    found = ahocorasick.Automaton()
    for phrase in [*BASE, *NOTICES, TAG]:
        found.add_word(f" {phrase} ", phrase)
    found.make_automaton()
    return found


def scan(text: bytes, found) -> tuple:
    """n_words, n_base, first_word, last_word, base_labels, labels, score, expressions of one text."""
    words = text.translate(_KEEP).split()
    joined = f" {b' '.join(words).decode()} "
    base, places, labels, unsure, expressions = set(), [], set(), 1.0, []
    tagged = False
    for end, phrase in found.iter(joined):
        if phrase in BASE:
            base.add(BASE[phrase])
            places.append(joined.count(" ", 0, end - len(phrase) - 1))
            unsure *= 1 - BASE_SURE
        elif phrase == TAG:
            tagged = True
        else:
            labels.add(NOTICES[phrase][0])
            unsure *= 1 - NOTICES[phrase][1]
    if tagged:
        low = text.decode().translate(_LOWER)
        for m in _EXPRESSION.finditer(low):
            offered = choices(leading(low, m.end()))
            if offered:
                labels |= frozenset().union(*offered)
                unsure *= 1 - TAG_SURE
                expressions.append(" or ".join("+".join(sorted(x)) for x in offered))
    first, last = (min(places), max(places)) if places else (None, None)
    every = ",".join(sorted(base | labels))
    return len(words), len(places), first, last, ",".join(sorted(base)), every, 1 - unsure, expressions


_LOWER = {c: c + 32 for c in range(65, 91)}
_FIELDS = [
    ("n_words", pa.int64(), "long"), ("n_base", pa.int64(), "long"), ("first_word", pa.int64(), "long"),
    ("last_word", pa.int64(), "long"), ("base_labels", pa.string(), "string"), ("labels", pa.string(), "string"),
    ("score", pa.float64(), "double"), ("expressions", pa.list_(pa.string()), "array<string>"),
]


def scan_licenses(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with the found licences as further columns, which replace columns of their names.

    ``n_words``; of the base phrases ``n_base`` (all places), ``first_word`` and ``last_word`` (words from 0; null if
    none) and ``base_labels``; ``labels`` of these, further notices and licence expressions; ``score`` from 0 (none) to
    1; ``expressions``, the choices behind each tag, of the longest well-formed expression there, whatever follows it. Null
    and empty texts have no words and labels "". A tag without such an expression gives nothing.
    """
    names = [n for n, _, _ in _FIELDS]
    kept = [c for c in docs.columns if c not in names]
    fed, at = with_text(docs, kept, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = automaton()
        for batch in batches:
            for row, data, offsets in chunks(batch.column(at)):
                raw, ends = data.tobytes(), np.asarray(offsets).tolist()
                rows = [scan(raw[a:b], found) for a, b in zip(ends, ends[1:])]
                columns = [pa.array(c, kind) for c, (_, kind, _) in zip(zip(*rows), _FIELDS)]
                yield pa.RecordBatch.from_arrays([*batch.slice(row, len(rows)).columns[: len(kept)], *columns], [*kept, *names])

    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*kept).schema]
    schema = ", ".join([*fields, *(f"{n} {t}" for n, _, t in _FIELDS)])
    return fed.mapInArrow(run, schema)
