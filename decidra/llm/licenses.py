"""Licence scan: exact phrases, and short notices found with a bounded number of edits.

A notice of which at most k characters differ, split into k + 1 pieces, keeps one piece unharmed
(pigeonhole). One Aho-Corasick pass over the normalised text finds every piece of every notice; a
hit at offset d of a notice opens the window in which that notice can lie, and only there does the
``regex`` library match the whole notice with ``{e<=k}`` and report span and edits. In a window the best match
comes first, then the parts before and after it are searched in the same way, so damaged copies next to better
ones are reported too.

The normalised text is the lower-cased (A-Z) words joined by one space, so line breaks and
punctuation inside a notice cost no edits. Matching is on bytes.
"""

from __future__ import annotations

import functools
import re

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import free_name, utf8

#: A-Z to a-z, other ASCII that is not a letter or digit to a space; bytes from 0x80 on stay.
NORMAL = bytes(
    b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256)
)
BASE = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
#: notice, label
NOTICES = [
    ("released under the mit license", "mit"),
    ("licensed under the mit license", "mit"),
    ("permission is hereby granted free of charge to any person obtaining a copy", "mit"),
    ("licensed under the apache license version 2 0", "apache"),
    ("you may not use this file except in compliance with the license", "apache"),
    ("gnu general public license", "gpl"),
    ("gnu lesser general public license", "lgpl"),
    ("gnu affero general public license", "agpl"),
    ("redistribution and use in source and binary forms with or without modification", "bsd"),
    ("mozilla public license version 2 0", "mpl"),
    ("creative commons attribution", "cc"),
    ("all rights reserved", "proprietary"),
]
#: One edit is allowed for so many characters of a notice.
CHARS_PER_EDIT = 10
SPAN = "struct<label: string, start: bigint, end: bigint, first_word: bigint, edits: int, score: double>"
RESULT = f"struct<n_words: bigint, n_base: bigint, first_word: bigint, last_word: bigint, base_labels: string, labels: string, score: double, spans: array<{SPAN}>>"


def split_pieces(notice: str, edits: int) -> list[tuple[int, str]]:
    """edits + 1 pieces (offset, text) that cover the notice, nearly equal in length."""
    cuts = [len(notice) * i // (edits + 1) for i in range(edits + 2)]
    return [(a, notice[a:b]) for a, b in zip(cuts, cuts[1:])]


@functools.lru_cache(maxsize=4)
def _search(notices: tuple[tuple[str, str], ...]):
    """The automaton over all pieces and the fuzzy pattern of each notice; built once a worker."""
    pieces: dict[str, list[tuple[int, int]]] = {}
    patterns = []
    for n, (notice, label) in enumerate(notices):
        edits = max(1, len(notice) // CHARS_PER_EDIT)
        for offset, piece in split_pieces(notice, edits):
            pieces.setdefault(piece, []).append((n, offset))
        fuzzy = regex.compile(b"(?b)(?:" + regex.escape(notice.encode()) + b"){e<=%d}" % edits)
        patterns.append((notice, label, edits, fuzzy))
    machine = ahocorasick.Automaton()
    for piece, places in pieces.items():
        machine.add_word(piece, (len(piece), places))
    machine.make_automaton()
    return machine, patterns


BASE_PATTERN = re.compile(b"(?<![^ ])(?=(" + b"|".join(p.encode() for p in BASE) + b")(?![^ ]))")


def fuzzy_spans(fuzzy, plain: bytes, start: int, stop: int, least: int):
    """Matches in plain[start:stop] that do not overlap, the best first, then those on either side of it."""
    parts = [(start, stop)]
    while parts:
        a, b = parts.pop()
        found = fuzzy.search(plain, a, b) if b - a >= least else None
        if found:
            yield found
            parts += [(a, found.start()), (found.end(), b)]


def word_numbers(plain: bytes, starts: list[int]) -> list[int]:
    """The number of the word in which each byte offset lies."""
    if not starts:
        return []
    gaps = np.flatnonzero(np.frombuffer(plain, dtype=np.uint8) == 32)
    return np.searchsorted(gaps, starts).tolist()


def scan_text(body: bytes, notices: tuple[tuple[str, str], ...] = tuple(NOTICES)) -> dict:
    """The RESULT of one whole text; spans are byte offsets in the normalised text."""
    words = body.translate(NORMAL).split()
    plain = b" ".join(words)
    places = [(m.start(), BASE[m.group(1).decode()]) for m in BASE_PATTERN.finditer(plain)]
    at = word_numbers(plain, [start for start, _ in places])
    base = {label for _, label in places}

    machine, patterns = _search(notices)
    windows: dict[int, list[list[int]]] = {}
    for end, (size, where) in machine.iter(plain.decode("latin-1")):
        for n, offset in where:
            notice, _, edits, _ = patterns[n]
            start = end + 1 - size - offset - edits
            stop = start + len(notice) + 2 * edits
            windows.setdefault(n, []).append([max(0, start), stop])
    spans = []
    for n, found in sorted(windows.items()):
        notice, label, edits, fuzzy = patterns[n]
        merged: list[list[int]] = []
        for a, b in sorted(found):
            if merged and a <= merged[-1][1]:
                merged[-1][1] = max(merged[-1][1], b)
            else:
                merged.append([a, b])
        for a, b in merged:
            for m in fuzzy_spans(fuzzy, plain, a, min(b, len(plain)), len(notice) - edits):
                cost = sum(m.fuzzy_counts)
                spans.append({"label": label, "start": m.start(), "end": m.end(), "edits": cost, "score": 1 - cost / len(notice)})
    spans.sort(key=lambda s: (s["start"], s["end"], s["label"]))
    for span, first in zip(spans, word_numbers(plain, [s["start"] for s in spans]), strict=True):
        span["first_word"] = first
    exact = 1.0 if places else 0.0
    return {
        "n_words": len(words),
        "n_base": len(places),
        "first_word": at[0] if at else None,
        "last_word": at[-1] if at else None,
        "base_labels": ",".join(sorted(base)),
        "labels": ",".join(sorted(base | {s["label"] for s in spans})),
        "score": max([exact, *(s["score"] for s in spans)]),
        "spans": spans,
    }


def load_notices(table: DataFrame, most: int = 1000) -> list[tuple[str, str]]:
    """Notices from a table (notice, label), normalised as texts are; the list is at most ``most`` long, by
    design: it goes to every task. Rows with nulls, and notices of under 10 characters, are left out."""
    rows = table.where("notice IS NOT NULL AND label IS NOT NULL").select("notice", "label").distinct().orderBy("notice", "label").limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} notices")
    plain = [(b" ".join(r["notice"].encode().translate(NORMAL).split()).decode("utf-8", "replace"), r["label"]) for r in rows]
    return [x for x in plain if len(x[0]) >= CHARS_PER_EDIT]


def scan(docs: DataFrame, notices: list[tuple[str, str]] = NOTICES) -> DataFrame:
    """docs with a last struct column licence (RESULT) for each row; if docs has a column of that name it
    stays, and the new one has underscores behind its name.

    Null and empty texts have no words, no places, empty labels and score 0. Rows stay as they are,
    repeated ones too; nothing is shuffled. Texts are scanned whole; an empty table gives no rows.
    """
    chosen = tuple(notices)

    def run(bodies: pa.Array) -> pa.Array:
        kind = pa.struct(
            [("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64())]
            + [("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64())]
            + [("spans", pa.list_(pa.struct([("label", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("first_word", pa.int64()), ("edits", pa.int32()), ("score", pa.float64())])))]
        )
        return pa.array([scan_text(x.as_buffer().to_pybytes(), chosen) for x in bodies], kind)

    return docs.withColumn(free_name(docs, "licence"), F.arrow_udf(run, returnType=RESULT).asNondeterministic()(utf8(F.col("text"))))
