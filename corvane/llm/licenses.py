"""Licence scan: an Aho-Corasick automaton finds notice phrases and identifier tags in whole texts; the tags'
and/or/with expressions are parsed by the shunting-yard method and evaluated.

Words are ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of the text with A-Z lowered. A phrase is found wherever its words
stand one after another. Null text counts as empty: no words, no labels, score 0. Repeated rows give repeated rows, an empty
table gives no rows, texts of any length are scanned whole, extra columns are ignored.
An expression that can't be parsed gives the labels of the identifiers read before the fault.
"""

from __future__ import annotations

import re
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

# Notice phrases and their labels.
BASE_PHRASES = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}
MORE_PHRASES = {
    "gnu general public license version 3": "gpl-3",
    "gnu general public license version 2": "gpl-2",
    "gnu lesser general public license": "lgpl",
    "gnu affero general public license": "agpl-3",
    "mozilla public license version 2": "mpl-2",
    "redistribution and use in source and binary forms": "bsd",
    "permission is hereby granted free of charge to any person obtaining a copy": "mit",
    "mit license": "mit",
    "gpl v3": "gpl-3",
    "gplv3": "gpl-3",
    "gpl version 3": "gpl-3",
    "gpl v2": "gpl-2",
    "gplv2": "gpl-2",
    "gpl version 2": "gpl-2",
    "lgpl v2": "lgpl",
    "lgpl v3": "lgpl",
    "lgplv2": "lgpl",
    "lgplv3": "lgpl",
    "agpl v3": "agpl-3",
    "agplv3": "agpl-3",
    "bsd license": "bsd",
    "isc license": "isc",
    "cc by sa": "cc-by-sa",
    "cc by nd": "cc-by-nd",
    "dedicated to the public domain": "public-domain",
    "all rights reserved": "proprietary",
}
TAG = "spdx license identifier"
_TAG_LINE = re.compile(rb"spdx-license-identifier[ \t]*:[ \t]*([^\r\n]*)")
# Identifiers whose label differs from their lower-cased name.
IDENTIFIERS = {
    "apache-2.0": "apache-2",
    "gpl-3.0": "gpl-3",
    "gpl-3.0-only": "gpl-3",
    "gpl-3.0-or-later": "gpl-3",
    "gpl-2.0": "gpl-2",
    "gpl-2.0-only": "gpl-2",
    "gpl-2.0-or-later": "gpl-2",
    "agpl-3.0": "agpl-3",
    "agpl-3.0-only": "agpl-3",
    "agpl-3.0-or-later": "agpl-3",
    "lgpl-2.0": "lgpl",
    "lgpl-2.0-only": "lgpl",
    "lgpl-2.0-or-later": "lgpl",
    "lgpl-2.1": "lgpl",
    "lgpl-2.1-only": "lgpl",
    "lgpl-2.1-or-later": "lgpl",
    "lgpl-3.0": "lgpl",
    "lgpl-3.0-only": "lgpl",
    "lgpl-3.0-or-later": "lgpl",
    "mpl-2.0": "mpl-2",
    "mpl-2.0-no-copyleft-exception": "mpl-2",
    "cc-by-3.0": "cc-by",
    "cc-by-4.0": "cc-by",
    "cc-by-nc-3.0": "cc-by-nc",
    "cc-by-nc-4.0": "cc-by-nc",
    "cc-by-nd-3.0": "cc-by-nd",
    "cc-by-nd-4.0": "cc-by-nd",
    "cc-by-sa-3.0": "cc-by-sa",
    "cc-by-sa-4.0": "cc-by-sa",
    "bsd-2-clause": "bsd",
    "bsd-3-clause": "bsd",
    "cc0-1.0": "public-domain",
}
PERMISSIVE = {"mit", "apache-2", "bsd", "isc", "zlib", "unlicense", "public-domain"}

_WORD_BYTES = bytes(
    c + 32 if 65 <= c <= 90 else c if c >= 0x80 or 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A else 0x20 for c in range(256)
)
_BINDS = {"or": 1, "and": 2, "with": 3}


def postfix(expression: str) -> list[str]:
    """Shunting-yard: an and/or/with expression in postfix order; what follows a fault is left out."""
    out: list[str] = []
    held: list[str] = []
    operand = True
    for token in re.findall(r"[()]|[a-z0-9.+-]+", expression.lower()):
        if token == "(":
            if not operand:
                break
            held.append(token)
        elif token == ")":
            if operand or "(" not in held:
                break
            while held[-1] != "(":
                out.append(held.pop())
            held.pop()
        elif token in _BINDS:
            if operand:
                break
            while held and held[-1] != "(" and _BINDS[held[-1]] >= _BINDS[token]:
                out.append(held.pop())
            held.append(token)
            operand = True
        else:
            if not operand:
                break
            out.append(token)
            operand = False
    if operand and held and held[-1] in _BINDS:
        held.pop()
    return out + [x for x in reversed(held) if x != "("]


def evaluate(expression: str) -> tuple[set[str], bool]:
    """Labels of the licences named (exceptions after ``with`` are none), and whether some choice of the
    ``or`` branches needs permissive licences only."""
    stack: list[tuple[set[str], bool]] = []
    for token in postfix(expression):
        if token not in _BINDS:
            name = token.rstrip("+")
            label = IDENTIFIERS.get(name, name)
            stack.append(({label}, label in PERMISSIVE))
        elif len(stack) >= 2:
            (right, b), (left, a) = stack.pop(), stack.pop()
            stack.append((left, a) if token == "with" else (left | right, (a and b) if token == "and" else (a or b)))
    return stack[-1] if stack else (set(), False)


@lru_cache(maxsize=4)
def automaton(phrases: tuple[tuple[str, str, bool], ...]):
    import ahocorasick

    found = ahocorasick.Automaton()
    by_pattern: dict[str, list] = {}
    for phrase, label, base in phrases:
        # word bytes as Latin-1 characters, one space at each end
        words = " ".join(phrase.encode().translate(_WORD_BYTES).decode("latin-1").split())
        by_pattern.setdefault(f" {words} ", []).append((label, base))
    for pattern, what in by_pattern.items():
        found.add_word(pattern, (len(pattern), what))
    found.make_automaton()
    return found


def scan_text(text: str | None, found) -> tuple:
    """(n_words, n_base, first_word, last_word, base labels, labels, score, expressions, permissive)."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    words = raw.translate(_WORD_BYTES).split()
    line = " " + b" ".join(words).decode("latin-1") + " "
    starts, base, labels, hits, tagged = [], set(), set(), 0, False
    for end, (size, what) in found.iter(line):
        for label, is_base in what:
            if label == TAG:
                tagged = True
                continue
            hits += 1
            labels.add(label)
            if is_base:
                base.add(label)
                starts.append(end - size + 1)
    expressions, permissive = [], None
    if tagged:
        for m in _TAG_LINE.finditer(raw.lower()):
            expression = m[1].decode("utf-8", "replace").strip()
            named, free = evaluate(expression)
            if named:
                expressions.append(expression)
                labels |= named
                hits += 2
                permissive = free if permissive is None else permissive and free
    place = [line.count(" ", 0, s) for s in (min(starts), max(starts))] if starts else [None, None]
    join = lambda x: ",".join(sorted(x))
    return len(words), len(starts), *place, join(base), join(labels), 1.0 - 0.5**hits, expressions, permissive


def scan(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    base: dict[str, str] | None = None,
    more: dict[str, str] | None = None,
) -> DataFrame:
    """One row per input row; score is 1 - 0.5^hits, a tag counting as two hits. One narrow pass, no shuffle."""
    phrases = tuple(
        [(p, x, True) for p, x in (BASE_PHRASES if base is None else base).items()]
        + [(p, x, False) for p, x in (MORE_PHRASES if more is None else more).items()]
        + [(TAG, TAG, False)]
    )
    schema = T.StructType([docs.schema[id_col]]).add("n_words", "long").add("n_base", "long").add("first_word", "long").add("last_word", "long")
    schema = schema.add("base_labels", "string").add("labels", "string").add("score", "double").add("expressions", T.ArrayType(T.StringType())).add("permissive", "boolean")
    kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64(), pa.list_(pa.string()), pa.bool_()]

    def run(batches):
        found = automaton(phrases)
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                rows = [scan_text(t, found) for t in part.column(1).to_pylist()]
                cols = [pa.array(list(x), k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), *cols], schema.names)

    return docs.select(id_col, text_col).mapInArrow(run, schema)
