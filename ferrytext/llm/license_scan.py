"""Short-notice licence search with bounded errors.

Each notice of length L with at most k edits is cut into k+1 pieces: a place within k edits holds at least one
piece unchanged (pigeonhole), at most k bytes from where it would stand without edits. The pieces are searched as exact
byte strings; whatever begins and ends with whole words near enough to a hit is verified by the ``regex`` library's
bounded-error matching, which counts the edits. Work is per document: no shuffle.
"""

from __future__ import annotations

from bisect import bisect, insort
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from ferrytext.llm.common import ALNUM_TABLE, slices, text_rows, tidied


class Notice(NamedTuple):
    """``firm``: words at the phrase's start that no edit may touch, as an edit would make another name of them."""

    label: str
    phrase: str
    max_edits: int
    base: bool = False
    firm: str = ""


#: The phrases looked for, in words of ``[0-9a-z]`` and non-ASCII characters with single blanks.
NOTICES = (
    Notice("gpl", "gnu general public license", 3, True, "gnu"),
    Notice("apache", "apache license", 1, True),
    Notice("cc-by", "cc by", 0, True),
    Notice("mit", "mit license", 1, True, "mit"),
    Notice("agpl", "gnu affero general public license", 3, firm="gnu"),
    Notice("lgpl", "gnu lesser general public license", 3, firm="gnu"),
    Notice("mpl", "mozilla public license", 2),
    Notice("epl", "eclipse public license", 2),
    Notice("cc-by-nc", "cc by nc", 0),
    Notice("cc-by-sa", "cc by sa", 0),
    Notice("cc-by", "creative commons attribution", 3),
    Notice("cc0", "creative commons zero", 2),
    Notice("mit", "permission is hereby granted free of charge to any person obtaining a copy", 6),
    Notice("bsd", "redistribution and use in source and binary forms", 4),
    Notice("isc", "permission to use copy modify and or distribute this software", 5),
    Notice("unlicense", "this is free and unencumbered software released into the public domain", 5),
    Notice("reserved", "all rights reserved", 1),
)

MATCHES = "array<struct<label:string,phrase:string,start_word:bigint,n_words:bigint,edits:int,matched:string,base:boolean>>"
SCHEMA = f"doc_id bigint, n_words bigint, matches {MATCHES}"


def seeds(phrase: bytes, max_edits: int) -> list[tuple[int, bytes]]:
    """The phrase in max_edits + 1 pieces of nearly equal length, each with its offset."""
    n, k = len(phrase), max_edits + 1
    cuts = [i * n // k for i in range(k + 1)]
    return [(a, phrase[a:b]) for a, b in zip(cuts, cuts[1:])]


@lru_cache(maxsize=8)
def _compiled(notices: tuple[Notice, ...]) -> list[tuple]:
    out = []
    for x in notices:
        phrase, firm = x.phrase.encode(), f"{x.firm} ".encode() if x.firm else b""
        rest = phrase[len(firm) :]
        escaped = [regex.escape(part, literal_spaces=True) for part in (firm, rest)]
        fuzzy = x.max_edits and regex.compile(rb"(?b)%s(?:%s){e<=%d}" % (*escaped, x.max_edits))
        out.append((x, phrase, firm, [(at + len(firm), piece) for at, piece in seeds(rest, x.max_edits)], fuzzy))
    return out


def _hits(text: bytes, piece: bytes) -> Iterator[int]:
    at = text.find(piece)
    while at >= 0:
        yield at
        at = text.find(piece, at + 1)


def _edits(text: bytes, phrase: bytes, firm: bytes, k: int, pieces: list[tuple[int, bytes]], fuzzy: regex.Pattern) -> dict[tuple[int, int], int]:
    """Every run of whole words within k edits of the phrase, as (start, end), and its edits."""
    n, found, tried = len(phrase), {}, set()
    for offset, piece in pieces:
        for at in _hits(text, piece):
            place = at - offset
            starts = [s for s in range(max(0, place - k), place + k + 1) if (not s or text[s - 1] == 32) and text.startswith(firm, s)]
            if not starts:
                continue
            ends = [e for e in range(max(1, place + n - k), min(len(text), place + n + k) + 1) if e == len(text) or text[e] == 32]
            for s, e in ((s, e) for s in starts for e in ends if abs(e - s - n) <= k):
                if (s, e) not in tried:
                    tried.add((s, e))
                    if m := fuzzy.fullmatch(text, s, e):
                        found[s, e] = sum(m.fuzzy_counts)
    return found


def find_notices(text: bytes, notices: tuple[Notice, ...] = NOTICES) -> list[dict]:
    """All places in ``text`` (words joined by single blanks), by start. All exact places are reported. Of places with edits
    that overlap another place of their notice, the one with the fewest edits is, then the first, then the longest."""
    found, blanks = [], None
    for notice, phrase, firm, pieces, fuzzy in _compiled(notices):
        n = len(phrase)
        whole = lambda s, e: (not s or text[s - 1] == 32) and (e == len(text) or text[e] == 32)
        spans = [(s, s + n, 0) for s in _hits(text, phrase) if whole(s, s + n)]
        if fuzzy and (near := _edits(text, phrase, firm, notice.max_edits, pieces, fuzzy)):
            taken = [(s, e) for s, e, _ in spans]
            for (s, e), edits in sorted(near.items(), key=lambda x: (x[1], x[0][0], -x[0][1])):
                i = bisect(taken, (s, e))
                if edits and not (i and taken[i - 1][1] > s) and not (i < len(taken) and taken[i][0] < e):
                    insort(taken, (s, e))
                    spans.append((s, e, edits))
        if spans and blanks is None:
            blanks = np.flatnonzero(np.frombuffer(text, np.uint8) == 32)
        for s, e, edits in spans:
            first, last = np.searchsorted(blanks, (s, e)).tolist()
            found.append(
                {
                    "label": notice.label,
                    "phrase": notice.phrase,
                    "start_word": first,
                    "n_words": last - first + 1,
                    "edits": edits,
                    "matched": text[s:e].decode("utf-8", "replace"),
                    "base": notice.base,
                }
            )
    return sorted(found, key=lambda x: (x["start_word"], x["label"], x["phrase"]))


def scan_licenses(docs: DataFrame, notices: tuple[Notice, ...] = NOTICES) -> DataFrame:
    """One row per document: doc_id, n_words and ``matches``, an array of places with label, phrase, first word,
    words, edits and the matched words.

    Null and empty texts have no words and no matches; texts are searched whole, in time that grows with their length and
    the hits in them; repeated rows give repeated rows; ties are settled as in ``find_notices``; an empty table gives an
    empty result; columns other than doc_id and text are ignored.
    """
    schema = pa.schema(
        [
            ("doc_id", pa.int64()),
            ("n_words", pa.int64()),
            (
                "matches",
                pa.list_(
                    pa.struct(
                        [
                            ("label", pa.string()),
                            ("phrase", pa.string()),
                            ("start_word", pa.int64()),
                            ("n_words", pa.int64()),
                            ("edits", pa.int32()),
                            ("matched", pa.string()),
                            ("base", pa.bool_()),
                        ]
                    )
                ),
            ),
        ]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 4 << 20):
            counts, matches = [], []
            for text in batch.column("text").to_pylist():
                words = text.translate(ALNUM_TABLE).split()
                counts.append(len(words))
                matches.append(find_notices(b" ".join(words), notices))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(matches, schema.field(2).type)],
                schema=schema,
            )

    return text_rows(docs).mapInArrow(tidied(run), SCHEMA)
