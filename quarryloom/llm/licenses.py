"""License scans: Aho-Corasick for notice phrases and identifier tags, shunting-yard for licence expressions."""

from __future__ import annotations

import functools
import re

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices

#: Phrases whose places are reported, and their labels.
BASE_PHRASES = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}
#: Further notice phrases, words as the scan sees them, and how sure a find is.
NOTICES = {
    "permission is hereby granted free of charge to any person obtaining a copy": ("mit", 0.9),
    "redistribution and use in source and binary forms with or without modification": ("bsd", 0.9),
    "permission to use copy modify and or distribute this software for any purpose": ("isc", 0.9),
    "gnu general public license": ("gpl", 0.8),
    "gnu lesser general public license": ("lgpl", 0.8),
    "gnu affero general public license": ("agpl", 0.8),
    "mozilla public license": ("mpl", 0.8),
    "eclipse public license": ("epl", 0.8),
    "creative commons attribution noncommercial": ("cc-by-nc", 0.8),
    "creative commons attribution sharealike": ("cc-by-sa", 0.8),
    "this is free and unencumbered software released into the public domain": ("unlicense", 0.9),
}
#: Tags that a licence expression follows.
TAGS = ("spdx-license-identifier:", "license-expression:")
#: Identifiers by lower case, their label, and how freely their texts may be used (1: with attribution at most).
KNOWN = {
    "mit": ("mit", 1.0),
    "apache-2.0": ("apache-2", 1.0),
    "bsd-2-clause": ("bsd", 1.0),
    "bsd-3-clause": ("bsd", 1.0),
    "isc": ("isc", 1.0),
    "unlicense": ("unlicense", 1.0),
    "cc0-1.0": ("cc0", 1.0),
    "cc-by-4.0": ("cc-by", 1.0),
    "cc-by-sa-4.0": ("cc-by-sa", 0.6),
    "cc-by-nc-4.0": ("cc-by-nc", 0.2),
    "mpl-2.0": ("mpl", 0.6),
    "epl-2.0": ("epl", 0.6),
    "lgpl-2.1-only": ("lgpl", 0.5),
    "lgpl-2.1-or-later": ("lgpl", 0.5),
    "lgpl-3.0-only": ("lgpl", 0.5),
    "lgpl-3.0-or-later": ("lgpl", 0.5),
    "gpl-2.0-only": ("gpl", 0.3),
    "gpl-2.0-or-later": ("gpl", 0.3),
    "gpl-3.0-only": ("gpl", 0.3),
    "gpl-3.0-or-later": ("gpl", 0.3),
    "agpl-3.0-only": ("agpl", 0.1),
    "agpl-3.0-or-later": ("agpl", 0.1),
}
PRECEDENCE = {"or": 1, "and": 2, "with": 3}
_TOKEN = re.compile(r"[ \t]*([()]|[A-Za-z0-9][A-Za-z0-9.+:-]*)")
_LOWER_ASCII = {c: c + 32 for c in range(65, 91)}
#: Bytes of a lower-cased text: what isn't part of a word becomes a space.
_WORDS = bytes(c if c >= 0x80 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


def tokens(text: str, at: int) -> list[str]:
    """The tokens of an expression that starts at ``at``: it ends with its line, or where grammar can't go on."""
    found: list[str] = []
    while m := _TOKEN.match(text, at):
        t = m[1]
        operand = t not in "()" and t.lower() not in PRECEDENCE
        after_operand = bool(found) and found[-1] != "(" and found[-1].lower() not in PRECEDENCE
        if (operand or t == "(") == after_operand:
            break
        found.append(t)
        at = m.end()
    return found


def parse(found: list[str]) -> list[str] | None:
    """Reverse Polish notation, by one shunting-yard pass, of the longest start of ``found`` that is an expression; None if none is. Operators come out in lower case."""
    out: list[str] = []
    stack: list[str] = []
    depth, whole = 0, None  # open parentheses; output and operators where an expression was last complete
    wants = True  # an operand
    for t in found:
        op = t.lower()
        if wants != (op not in PRECEDENCE and t != ")"):
            break
        if op in PRECEDENCE:
            while stack and stack[-1] != "(" and PRECEDENCE[stack[-1]] >= PRECEDENCE[op]:
                out.append(stack.pop())
            stack.append(op)
            wants = True
        elif t == "(":
            stack.append(t)
            depth += 1
        else:
            if t == ")":
                if not depth:
                    break
                while stack[-1] != "(":
                    out.append(stack.pop())
                stack.pop()
                depth -= 1
            else:
                out.append(t)
            wants = False
            if not depth:
                whole = len(out), stack[::-1]  # at most an operator of each precedence
    return whole and out[: whole[0]] + whole[1]


def evaluate(rpn: list[str]) -> tuple[set[str], float]:
    """(labels named, freedom of use from 0 to 1): ``and`` takes the stricter, ``or`` the freer side, ``with`` an exception that eases its licence halfway."""
    stack: list[tuple[set[str], float]] = []
    for t in rpn:
        if t in PRECEDENCE and len(stack) > 1:
            (b, q), (a, p) = stack.pop(), stack.pop()
            stack.append((a, (1 + p) / 2) if t == "with" else (a | b, min(p, q) if t == "and" else max(p, q)))
        else:
            label, free = KNOWN.get(t.lower().rstrip("+"), (t.lower(), 0.0))
            stack.append(({label}, free))
    return stack[-1]


def expression_at(text: str, at: int) -> tuple[set[str], float] | None:
    """The expression at ``at``, as far as one can be read: trailing words that break it are left. Time is linear in what is read."""
    rpn = parse(tokens(text, at))
    return evaluate(rpn) if rpn else None


@functools.cache
def _automata():
    phrases, tags = ahocorasick.Automaton(), ahocorasick.Automaton()
    for p, label in BASE_PHRASES.items():
        phrases.add_word(f" {p} ", (p, label, 0.95, True))
    for p, (label, sure) in NOTICES.items():
        phrases.add_word(f" {p} ", (p, label, sure, False))
    for t in TAGS:
        tags.add_word(t, t)
    phrases.make_automaton()
    tags.make_automaton()
    return phrases, tags


def scan(text: str) -> tuple:
    """One text's (n_words, n_base, first_word, last_word, base_labels, labels, score, freedom)."""
    phrases, tags = _automata()
    lower = text.translate(_LOWER_ASCII)
    words = lower.encode("utf-8", "surrogatepass").translate(_WORDS).split()
    flat = (b" " + b" ".join(words) + b" ").decode("utf-8", "surrogatepass")
    starts, base, labels, doubt, freedom = [], set(), set(), 1.0, None
    seen, counted = 0, 0
    finds = sorted((end - len(p) - 1, label, sure, is_base) for end, (p, label, sure, is_base) in phrases.iter(flat))
    for at, label, sure, is_base in finds:
        labels.add(label)
        doubt *= 1 - sure
        if is_base:
            counted += flat.count(" ", seen, at)  # the phrase's first space stands before its first word
            seen = at
            starts.append(counted)
            base.add(label)
    for end, _ in tags.iter(lower):
        if got := expression_at(text, end + 1):
            labels |= got[0]
            doubt *= 0.05
            freedom = got[1] if freedom is None else min(freedom, got[1])
    return len(words), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(base)), ",".join(sorted(labels)), 1 - doubt, freedom


_SCHEMA = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64()), ("freedom", pa.float64())])


def scan_licenses(docs: DataFrame) -> DataFrame:
    """A row per row of ``docs`` (doc_id, text): words, places and labels of the base phrases, labels of the whole scan, a score.

    Labels are distinct, sorted and comma-joined, empty where there are none.
    ``score`` is the chance that at least one find is right, 0 without finds;
    ``freedom`` is that of the strictest licence expression, null without one.
    Null text is empty. Texts of any length are read whole, in time that grows with their length.
    Every row is judged by its own text, so rows that share an id, or have none, get their own each.
    Empty input gives an empty result; other columns than doc_id and text are not read.
    """

    def run(batches):
        for b in batches:
            for part in slices(b, 1, 1024):
                rows = [(i, *scan(t or "")) for i, t in zip(*(c.to_pylist() for c in part.columns), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _SCHEMA, strict=True)], schema=_SCHEMA)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, freedom double")
