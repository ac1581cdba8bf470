"""License scan: Aho-Corasick over phrases and tags, shunting-yard over expressions.

One automaton holds all phrases as words; it runs over each text's words joined
by single spaces, so a phrase is found wherever its words stand consecutively. A
second automaton finds identifier tags in the raw text; what follows a tag on
its line is parsed as a licence expression (``and``, ``or``, ``with``,
parentheses) into postfix form and evaluated: the licences it names, and whether
it can be met with licences of the allowed set alone.

Scale: one pass over the documents in Arrow batches, no shuffle; a task holds one
batch and the two automata.

Defined cases: null text is empty: no words, no labels, score 0. Long texts are
scanned whole in linear time. A broken expression yields the licences before the
fault and isn't counted as allowed. Repeated rows are judged one by one; an
empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Phrases of the base scan and their labels (fixed values).
BASE = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}
#: Further notice phrases, as words.
NOTICES = {
    "gnu lesser general public license": "lgpl",
    "gnu affero general public license": "agpl",
    "mozilla public license": "mpl",
    "eclipse public license": "epl",
    "bsd license": "bsd",
    "redistribution and use in source and binary forms": "bsd",
    "permission is hereby granted free of charge": "mit",
    "isc license": "isc",
    "boost software license": "bsl",
    "creative commons attribution": "cc-by",
    "creative commons zero": "cc0",
    "public domain": "public-domain",
    "all rights reserved": "all-rights-reserved",
}
TAGS = ("spdx-license-identifier:", "license-expression:", "license:", "licence:")
#: Licence families by the start of an identifier; a sign, a digit or a version (``v2``) follows it.
FAMILIES = {
    "agpl": "agpl", "lgpl": "lgpl", "gpl": "gpl", "apache": "apache", "mit": "mit", "bsd": "bsd", "isc": "isc",
    "mpl": "mpl", "epl": "epl", "bsl": "bsl", "cc-by": "cc-by", "cc0": "cc0", "unlicense": "public-domain",
}
ALLOWED = frozenset({"apache", "mit", "bsd", "isc", "bsl", "cc-by", "cc0", "public-domain"})

#: ASCII: letters lower-cased, digits kept, the rest white; other bytes belong to words.
_WORD_BYTES = bytes(
    c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256)
)
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_TOKEN = re.compile(r"\(|\)|[A-Za-z0-9.+-]+")
_AFTER = re.compile(r"v?[0-9]|[^A-Za-z]|$")
_RANK = {"or": 1, "and": 2, "with": 3}
#: An expression ends with its line.
_LINE = re.compile(r"[^\r\n]*")


def postfix(expression: str) -> list[str]:
    """Licence expression in postfix order (shunting-yard); stops at the first fault."""
    out: list[str] = []
    waiting: list[str] = []
    operand = True  # an operand is due
    for token in _TOKEN.findall(expression):
        word = token.lower()
        if word in _RANK and not operand:
            while waiting and waiting[-1] != "(" and _RANK[waiting[-1]] >= _RANK[word]:
                out.append(waiting.pop())
            waiting.append(word)
            operand = True
        elif token == "(" and operand:
            waiting.append(token)
        elif token == ")" and not operand and "(" in waiting:
            while waiting[-1] != "(":
                out.append(waiting.pop())
            waiting.pop()
        elif operand and word not in _RANK and token not in "()":
            out.append(word)
            operand = False
        else:
            break
    return out + [w for w in reversed(waiting) if w != "("]


def family(identifier: str) -> str | None:
    for start, label in FAMILIES.items():
        if identifier.startswith(start) and _AFTER.match(identifier, len(start)):
            return label
    return None


def evaluate(expression: str, allowed: frozenset[str] = ALLOWED) -> tuple[set[str], bool | None]:
    """Families an expression names, and whether allowed ones suffice; None without any."""
    named: set[str] = set()
    stack: list[tuple[bool, bool]] = []  # (known licence, allowed)
    for token in postfix(expression):
        if token in _RANK:
            if len(stack) < 2:
                return named, False if named else None
            (kb, b), (ka, a) = stack.pop(), stack.pop()
            if token == "with":
                stack.append((ka, a))  # an exception only adds permissions
            elif token == "and":
                stack.append((ka and kb, a and b))
            else:
                stack.append((ka or kb, a or b))
        else:
            label = family(token)
            if label:
                named.add(label)
            stack.append((label is not None, label in allowed))
    return named, (stack[0][1] if len(stack) == 1 else False) if named else None


class Scanner:
    """Both automata; one per Python worker and task."""

    def __init__(self):
        import ahocorasick

        self.phrases = ahocorasick.Automaton()
        for phrase, label in NOTICES.items():
            self.phrases.add_word(f" {phrase} ", (phrase.count(" ") + 1, label, False))
        for phrase, label in BASE.items():
            self.phrases.add_word(f" {phrase} ", (phrase.count(" ") + 1, label, True))
        self.phrases.make_automaton()
        self.tags = ahocorasick.Automaton()
        for tag in TAGS:
            self.tags.add_word(tag, tag)
        self.tags.make_automaton()

    def __call__(self, text: str | None) -> tuple:
        raw = (text or "").encode("utf-8", "replace")
        joined = b" ".join(raw.translate(_WORD_BYTES).split()).decode("utf-8")
        n_words = joined.count(" ") + 1 if joined else 0
        base, more, starts, counted, at = set(), set(), [], 0, 0
        padded = f" {joined} "
        for end, (size, label, is_base) in self.phrases.iter(padded):
            if is_base:
                # the place's last word ends before ``end``: words so far less its own
                counted += padded.count(" ", at, end)
                at = end
                starts.append(counted - size)
                base.add(label)
            else:
                more.add(label)
        lower = raw.translate(_LOWER).decode("utf-8")
        expressions, allowed = [], None
        for end, _ in self.tags.iter(lower):
            line = _LINE.match(lower, end + 1).group().strip()
            named, ok = evaluate(line)
            if named:
                more |= named
                expressions.append(" ".join(postfix(line)))
                allowed = ok if allowed is None else allowed and ok
        n_base = len(starts)
        labels = base | more
        # evidence: places found against one half of doubt
        score = 0.0 if not labels else (n_base + len(more) + len(expressions)) / (n_base + len(more) + len(expressions) + 0.5)
        return (
            n_words, n_base, min(starts, default=None), max(starts, default=None), ",".join(sorted(base)),
            ",".join(sorted(labels)), score, "; ".join(expressions) or None, allowed,
        )


SCHEMA = (
    "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, "
    "score double, expressions string, allowed boolean"
)


def scan(docs: DataFrame) -> DataFrame:
    """One row per document, see ``SCHEMA``; expressions are in postfix order."""

    def run(batches):
        scanner = Scanner()
        for b in batches:
            out = pd.DataFrame([scanner(t) for t in b["text"]], columns=[c.split()[0] for c in SCHEMA.split(", ")][1:])
            out.insert(0, "doc_id", b["doc_id"].astype("Int64"))
            yield out.astype({"first_word": "Int64", "last_word": "Int64", "allowed": "boolean"})

    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return base.mapInPandas(run, SCHEMA)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
