"""License scans: an Aho-Corasick automaton over normalised words, and a shunting-yard evaluator of license expressions."""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodeframe.llm.columns import column, raw_texts, rows

# Base phrases and their labels.
BASE = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

# Further notice phrases (normalised words), their labels, and how surely each one is a notice.
NOTICES = {
    "released under the mit license": ("mit", 0.9),
    "licensed under the apache license version 2 0": ("apache", 0.95),
    "gnu general public license": ("gpl", 0.9),
    "gnu lesser general public license": ("lgpl", 0.9),
    "gnu affero general public license": ("agpl", 0.9),
    "mozilla public license": ("mpl", 0.8),
    "eclipse public license": ("epl", 0.8),
    "bsd 2 clause": ("bsd", 0.7),
    "bsd 3 clause": ("bsd", 0.7),
    "redistribution and use in source and binary forms": ("bsd", 0.9),
    "permission is hereby granted free of charge": ("mit", 0.7),
    "permission to use copy modify and or distribute this software": ("isc", 0.8),
    "cc0 1 0": ("cc0", 0.7),
    "cc by": ("cc-by", 0.6),
    "cc by sa": ("cc-by-sa", 0.7),
    "cc by nc": ("cc-by-nc", 0.7),
    "cc by nd": ("cc-by-nd", 0.7),
    "cc by nc sa": ("cc-by-nc-sa", 0.7),
    "creative commons attribution": ("cc-by", 0.6),
    "this is free and unencumbered software released into the public domain": ("unlicense", 0.9),
    "all rights reserved": ("proprietary", 0.5),
    "boost software license": ("bsl", 0.8),
}
BASE_WEIGHT = 0.6
TAG = "spdx license identifier"
TAG_WEIGHT = 0.95

# identifiers' first parts in license expressions and their labels.
FAMILIES = {
    "mit": "mit", "apache": "apache", "gpl": "gpl", "lgpl": "lgpl", "agpl": "agpl", "bsd": "bsd", "mpl": "mpl", "epl": "epl", "isc": "isc",
    "cc0": "cc0", "unlicense": "unlicense", "bsl": "bsl", "zlib": "zlib", "0bsd": "bsd",
}
PERMISSIVE = {"mit", "apache", "bsd", "isc", "cc0", "cc-by", "unlicense", "bsl", "zlib"}

_NORMAL = bytes(b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else b + 32 if 0x41 <= b <= 0x5A else 0x20 for b in range(256))
_TOKEN = re.compile(r"[()]|[A-Za-z0-9.+:-]+")
_RAW_TAG = re.compile(rb"spdx-license-identifier:[ \t]*([^\r\n]*)", re.IGNORECASE)
# Binding strength of the operators; WITH binds an exception to its license.
STRENGTH = {"OR": 1, "AND": 2, "WITH": 3}


def label_of(identifier: str) -> str:
    name = identifier.lower().rstrip("+")
    if name.startswith("cc-by"):
        return re.sub(r"-\d.*", "", name)
    return FAMILIES.get(name.split("-")[0], name)


def postfix(expression: str) -> list[str] | None:
    """The expression's tokens in postfix order by the shunting-yard method; None if it is not well formed.

    Text after a complete expression (a comment's end, say) is left out.
    """
    out: list[str] = []
    held: list[str] = []
    operand = False  # whether the last token ended an operand
    depth = 0
    for token in _TOKEN.findall(expression):
        kind = token.upper()
        if kind in STRENGTH:
            if not operand:
                return None
            while held and held[-1] != "(" and STRENGTH[held[-1]] >= STRENGTH[kind]:
                out.append(held.pop())
            held.append(kind)
            operand = False
        elif token == "(":
            if operand:
                break
            held.append(token)
            depth += 1
        elif token == ")":
            if not operand or not depth:
                break
            while held[-1] != "(":
                out.append(held.pop())
            held.pop()
            depth -= 1
        elif not re.search(r"[A-Za-z]", token):
            break
        else:
            if operand:
                break
            out.append(token)
            operand = True
    if not operand or depth:
        return None
    while held:
        out.append(held.pop())
    return out


def evaluate(expression: str, allowed=frozenset(PERMISSIVE)) -> tuple[set[str], bool] | None:
    """(labels named, whether the expression can be satisfied by allowed labels alone); None if it is not well formed.

    OR needs one side, AND both; WITH loosens a license and leaves its label and standing as they are.
    """
    order = postfix(expression)
    if order is None:
        return None
    stack: list[tuple[set[str], bool]] = []
    for token in order:
        if token in STRENGTH:
            right, left = stack.pop(), stack.pop()
            if token == "WITH":
                stack.append(left)
            else:
                stack.append((left[0] | right[0], left[1] or right[1] if token == "OR" else left[1] and right[1]))
        else:
            label = label_of(token)
            stack.append(({label}, label in allowed))
    return stack[0]


@lru_cache(1)
def automaton():
    import ahocorasick

    found = ahocorasick.Automaton()
    for phrase in {*BASE, *NOTICES, TAG}:
        found.add_word(f" {phrase} ", phrase)
    found.make_automaton()
    return found


def scan(raw: bytes, allowed=frozenset(PERMISSIVE)) -> tuple:
    """(n_words, n_base, first_word, last_word, base labels, labels, score, places, usable) of one text.

    places: (word number, phrase) of every phrase found; usable: None without a license, else whether every
    license found or one alternative of every expression is allowed.
    """
    words = raw.translate(_NORMAL).split(b" ")
    words = [w for w in words if w]
    n = len(words)
    if not n:
        return 0, 0, None, None, set(), set(), 0.0, [], None
    text = b" " + b" ".join(words) + b" "
    places = []
    blanks = np.flatnonzero(np.frombuffer(text, np.uint8) == 0x20)
    for end, phrase in automaton().iter(text.decode("latin-1")):
        start = end - len(phrase) - 1  # of the blank before the phrase
        places.append((int(np.searchsorted(blanks, start)), phrase))
    places.sort()
    base = [k for k, phrase in places if phrase in BASE]
    base_labels = {BASE[phrase] for _, phrase in places if phrase in BASE}
    labels, doubt, usable = set(base_labels), 1.0, None
    for _, phrase in places:
        weight = BASE_WEIGHT if phrase in BASE else NOTICES[phrase][1] if phrase in NOTICES else 0.0
        doubt *= 1 - weight
        if phrase in NOTICES:
            labels.add(NOTICES[phrase][0])
    if labels:
        usable = labels <= set(allowed)
    if any(phrase == TAG for _, phrase in places):
        for m in _RAW_TAG.finditer(raw):
            found = evaluate(m[1].decode("utf-8", "replace"), allowed)
            if found:
                labels |= found[0]
                doubt *= 1 - TAG_WEIGHT
                usable = found[1] if usable is None else usable and found[1]
    return n, len(base), base[0] if base else None, base[-1] if base else None, base_labels, labels, 1 - doubt, places, usable


SCANNED = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, usable boolean"


def scan_licenses(docs: DataFrame, key: str = "doc_id", text: str = "text", allowed=frozenset(PERMISSIVE)) -> DataFrame:
    """One row per row of docs: SCANNED; the places where base phrases stand, labels, and a score of evidence.

    Null and empty texts have no words, no places, empty labels and score 0. A null key stays null, repeated
    rows stay repeated, and an empty table gives an empty result. Texts are scanned whole, whatever their length.
    """

    def scanned(batches):
        for batch in batches:
            found = [scan(t, allowed) for t in raw_texts(column(batch, "t"))]
            ints = {name: pa.array([f[i] for f in found], pa.int64()) for i, name in enumerate(("n_words", "n_base", "first_word", "last_word"))}
            text_of = {name: pa.array([",".join(sorted(f[i])) for f in found], pa.string()) for i, name in ((4, "base_labels"), (5, "labels"))}
            yield rows(doc_id=column(batch, "d").cast(pa.int64()), **ints, **text_of, score=np.array([f[6] for f in found], np.float64), usable=pa.array([f[8] for f in found], pa.bool_()))

    return docs.select(F.col(key).cast("long").alias("d"), F.col(text).alias("t")).mapInArrow(scanned, SCANNED)
