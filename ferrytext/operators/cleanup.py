"""Clean-up of recognised text: loops, echoes and repeats."""

from __future__ import annotations

import re
from collections.abc import Iterator
from difflib import SequenceMatcher
from heapq import heappop, heappush
from itertools import accumulate, takewhile

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ferrytext.functions.arrow import with_mapped
from ferrytext.functions.text import collapse_repeats, echoes, normalize_ocr_lines, py_strip

#: What a model says when it repeats its instruction instead of a picture's text.
ECHO_KEYWORDS = [
    "转写", "只输出", "阅读顺序", "保持原文", "不加任何", "不含其他", "请照", "照原样", "请按照图片", "写出以下", "transcribe", "the text is",
    "as accurately as possible", "markdown",
]


def drop_consecutive_duplicates(rows: DataFrame, keys: list[str], order: str, column: str) -> DataFrame:
    """Rows whose ``column`` differs from that of the row before."""
    before = F.lag(column).over(Window.partitionBy(*keys).orderBy(order))
    return rows.withColumn("__b", before).where(~F.col("__b").eqNullSafe(F.col(column))).drop("__b")


#: Where stretches share this part of what they need, bounds from them tell too little to pay, and the rest is compared at once.
_CLOSE = 0.95
#: Stretches of so many characters are compared at once: a bound takes longer to find than the answer.
_LONG = 2_500


def _bits(text: str) -> dict[str, int]:
    """By character: a number with a bit for every place where it stands."""
    if len(text) > 600:
        codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        return {c: int.from_bytes(np.packbits(codes == ord(c), bitorder="little").tobytes(), "little") for c in set(text)}
    places: dict[str, int] = {}
    for i, c in enumerate(text):
        places[c] = places.get(c, 0) | 1 << i
    return places


def _shared(a: str, b: str) -> int:
    """Length of the longest common subsequence, with all of ``a`` in one number; matching blocks never hold more."""
    places, open_ = _bits(a), (1 << len(a)) - 1
    for c in b:
        if at := places.get(c):
            taken = open_ & at
            open_ = (open_ + taken) | (open_ - taken)
    return len(a) - (open_ & ((1 << len(a)) - 1)).bit_count()


#: So many pairs of places that hold the same two characters are kept at once; beyond, they are walked as difflib does.
_PAIRS = 2_000_000


class _Matcher:
    """``find_longest_match`` of ``SequenceMatcher(None, a, b)`` for ``b`` of 200 characters and more, where difflib begins
    matches at the rarer characters of ``b`` only. Places where two of these in a row are the same are paired once, each pair
    with the length of the run that ends there; a gap's longest run is the first of the longest among its pairs, cut at the
    gap's edges, or, if there is none, the gap's first rare character that is the same."""

    def __init__(self, a: str, b: str) -> None:
        self.texts = a, b
        self.a, self.b = (np.frombuffer(x.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64) for x in (a, b))
        top = 1 + int(max(self.a.max(), self.b.max()))
        self.in_a, self.in_b = np.bincount(self.a, minlength=top), np.bincount(self.b, minlength=top)
        self.i = self.plain = None

    def most(self) -> int:
        """What ``quick_ratio`` counts: characters that both have, wherever they stand."""
        return int(np.minimum(self.in_a, self.in_b).sum())

    def _pair(self) -> None:
        a, b, top = self.a, self.b, len(self.in_b)
        rare = (self.in_b > 0) & (self.in_b <= len(b) // 100 + 1)
        self.at_a, at_b = np.flatnonzero(rare[a]), np.flatnonzero(rare[b])
        self.at_b = np.sort(b[at_b] * len(b) + at_b)
        i, j = (at[1:][np.diff(at) == 1] for at in (self.at_a, at_b))
        two_a, two_b = a[i - 1] * top + a[i], b[j - 1] * top + b[j]
        order = np.argsort(two_b, kind="stable")
        first, last = (np.searchsorted(two_b[order], two_a, side) for side in ("left", "right"))
        n = last - first
        if n.sum() > _PAIRS:
            self.plain = SequenceMatcher(None, *self.texts)
            return
        self.i = np.repeat(i, n)
        self.j = j[order][np.arange(len(self.i)) - np.repeat(np.cumsum(n) - n - first, n)]
        slope = (self.j - self.i + len(a)) * (len(a) + 1) + self.i
        order = np.argsort(slope)
        place = np.arange(len(order))
        self.run = np.empty(len(order), np.int64)
        self.run[order] = place - np.maximum.accumulate(np.where(np.diff(slope[order], prepend=-2) != 1, place, 0)) + 2

    def find_longest_match(self, a0: int, a1: int, b0: int, b1: int) -> tuple[int, int, int]:
        if self.i is None and self.plain is None:
            self._pair()
        if self.plain:
            return self.plain.find_longest_match(a0, a1, b0, b1)
        x, y = np.searchsorted(self.i, (a0, a1))
        i, j, k = a0, b0, 0
        inside = x + np.flatnonzero((self.j[x:y] >= b0) & (self.j[x:y] < b1))
        if inside.size:
            ends_a, ends_b = self.i[inside], self.j[inside]
            runs = np.minimum(self.run[inside], np.minimum(ends_a - a0, ends_b - b0) + 1)
            best = int(np.argmax(runs))
            k = int(runs[best])
            i, j = int(ends_a[best]) - k + 1, int(ends_b[best]) - k + 1
        if k < 2:
            i, j, k = self._first(a0, a1, b0, b1)
        n = _prefix(self.a[a0:i][::-1], self.b[b0:j][::-1])
        return i - n, j - n, n + k + _prefix(self.a[i + k : a1], self.b[j + k : b1])

    def _first(self, a0: int, a1: int, b0: int, b1: int) -> tuple[int, int, int]:
        at, end = np.searchsorted(self.at_a, (a0, a1))
        step = 64
        while at < end and self.at_b.size:
            places = self.at_a[at : min(end, at + step)]
            base = self.a[places] * len(self.b)
            next_ = self.at_b[np.minimum(np.searchsorted(self.at_b, base + b0), self.at_b.size - 1)] - base
            met = (next_ >= b0) & (next_ < b1)
            if met.any():
                n = int(met.argmax())
                return int(places[n]), int(next_[n]), 1
            at, step = at + step, 4 * step
        return a0, b0, 0


def _prefix(a: np.ndarray, b: np.ndarray) -> int:
    """How far two arrays are the same."""
    at, step, n = 0, 64, min(len(a), len(b))
    while at < n:
        differ = a[at : min(n, at + step)] != b[at : min(n, at + step)]
        if differ.any():
            return at + int(differ.argmax())
        at, step = at + step, 4 * step
    return n


def _alike(a: str, b: str, least: float) -> bool:
    """Whether two texts are equal or both there and similar, as by ``ratio`` of ``SequenceMatcher``; no more blocks are looked
    for than the answer needs, those of the widest gaps first."""
    if a == b or not (a and b):
        return a == b
    found, hoped, total = 0, min(len(a), len(b)), len(a) + len(b)
    if 2.0 * hoped / total < least:
        return False
    if len(b) < 200:
        m = SequenceMatcher(None, a, b)
        if m.quick_ratio() < least:
            return False
    else:
        m = _Matcher(a, b)
        if 2.0 * m.most() / total < least:
            return False
    gaps = [(-hoped, 0, len(a), 0, len(b))]
    while gaps and 2.0 * found / total < least <= 2.0 * (found + hoped) / total:
        n, a0, a1, b0, b1 = heappop(gaps)
        i, j, k = m.find_longest_match(a0, a1, b0, b1)
        found, hoped = found + k, hoped + n
        for gap in ((a0, i, b0, j), (i + k, a1, j + k, b1)) if k else ():
            if n := min(gap[1] - gap[0], gap[3] - gap[2]):
                heappush(gaps, (-n, *gap))
                hoped += n
    return 2.0 * found / total >= least


#: Lengths of strings whose other places are looked for, and from how many characters on a stretch is tried by them.
_GRAMS, _TRIED = (6, 9, 14, 30), 500


class _Places:
    """How much two stretches of a text, one right after the other, can share as ``SequenceMatcher`` counts it. Its matches hold a
    rarer character of the second stretch each, but for one that both begin with, so none is longer than the longest
    strings about such characters that stand in the text again, and near enough."""

    def __init__(self, text: str) -> None:
        self.codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        self.top, n = 1 + int(self.codes.max()), len(self.codes)
        self.near, bits = [], np.uint64(n.bit_length())
        hashes, length = (self.codes.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15), 1
        for gram in _GRAMS:
            while length < gram:  # strings of gram characters as two of length, which may overlap
                more = min(length, gram - length)
                hashes = hashes[: len(hashes) - more] * np.uint64(0xBF58476D1CE4E5B9) + (hashes[more:] ^ hashes[more:] >> np.uint64(29))
                length += more
            keyed = np.sort(hashes >> bits << bits | np.arange(len(hashes), dtype=np.uint64))
            order, kind = (keyed & (np.uint64(1) << bits) - np.uint64(1)).astype(np.int64), keyed >> bits
            gaps = np.full(len(order) + 1, n)
            gaps[1:-1] = np.where(kind[1:] == kind[:-1], order[1:] - order[:-1], n)
            near = np.full(n, n)
            near[order] = np.minimum(gaps[1:], gaps[:-1])
            width = 1
            while width < gram:  # of the strings that hold a place, the nearest
                more = min(width, gram - width)
                near[more:] = np.minimum(near[more:], near[:-more].copy())
                width += more
            self.near.append(near)

    def by_line(self, at: np.ndarray) -> None:
        """Sums for ``most_of_blocks`` over lines that begin at the places ``at``, the last of which is the text's end. A text that
        repeats for the most part, or that has very many kinds of characters, gets none."""
        n, lines = len(self.codes), len(at) - 1
        again = self.near[-1] < n
        kinds, kind = np.unique(self.codes, return_inverse=True)
        self.sums = None
        if 2 * np.count_nonzero(again) < n and lines * len(kinds) < 4_000_000:
            longest = np.full(n, _GRAMS[-1] - 1)
            for gram, near in reversed(list(zip(_GRAMS, self.near))):
                longest[near >= n] = gram - 1
            line = np.repeat(np.arange(lines), np.diff(at))
            sums = lambda where, m, of: np.vstack([np.zeros((1, m)), np.bincount(where, of, lines * m).reshape(lines, m).cumsum(0)])
            where = line * len(kinds) + kind
            self.sums = at, sums(where, len(kinds), None), sums(where, len(kinds), longest), sums(line, 1, again)[:, 0]

    def most_of_blocks(self, start: int, size: np.ndarray) -> np.ndarray:
        """``most`` for the stretches of so many lines from line ``start`` on, all at once and as if any place were near enough."""
        at, count, longest, again = self.sums
        middle, end = start + size, start + 2 * size
        in_b = count[end] - count[middle]
        rare = (in_b > 0) & (in_b <= ((at[end] - at[middle]) // 100 + 1)[:, None])
        return _GRAMS[-1] - 1 + again[middle] - again[start] + np.where(rare, longest[middle] - longest[start], 0).sum(axis=1)

    def most(self, start: int, middle: int, end: int) -> int:
        a, b = self.codes[start:middle], self.codes[middle:end]
        in_b = np.bincount(b, minlength=self.top)
        at = start + np.flatnonzero(((in_b > 0) & (in_b <= len(b) // 100 + 1))[a])
        found = _prefix(a, b)
        for gram, near in zip(_GRAMS, self.near):
            again = near[at] < end - start
            found += (gram - 1) * int(len(at) - np.count_nonzero(again))
            at = at[again]
        # longer matches are made of places of such strings, shorter ones there hold a rarer character each
        return found + (_GRAMS[-1] - 1) * len(at) + int(np.count_nonzero(near[start:middle] < end - start)) if len(at) else found


class _Lines:
    """A list of lines in which stretches are compared, equal or similar as one text. What two stretches share grows by no
    more than the characters that come in, so one comparison settles many stretches about it."""

    def __init__(self, lines: list[str], least: float) -> None:
        self.lines, self.least, self.text = lines, least, "".join(lines)
        self.at = np.array([0, *accumulate(map(len, lines))])
        self.before, self.most = -2, np.zeros(0, np.int64)
        self.places: _Places | None = None

    def same(self, a: slice, b: slice) -> bool:
        x, y = self.lines[a], self.lines[b]
        return x == y or bool("".join(x) and "".join(y)) and _alike("".join(x), "".join(y), self.least)

    def _shared(self, a: int, b: int, k: int) -> int:
        x, y = (self.text[self.at[i] : self.at[i + k]] for i in (a, b))
        return len(x) if x == y else _shared(x, y)

    def loop(self, start: int) -> tuple[int, int] | None:
        """Length of the shortest block from ``start`` on that stands three times or more in a row, and how many times."""
        left, at = len(self.lines) - start, self.at
        size = np.arange(1, left // 3 + 1)
        middle, end = at[start + size], at[start + 2 * size]
        total = np.maximum(end - at[start], 1)
        most = np.minimum(middle - at[start], end - middle)
        if size.size and self.before == start - 1:  # the blocks of the line before, moved by a line, and those that hold these
            most = np.minimum(most, self.most[: size.size] + (middle - at[start + size - 1]) + (end - at[start + 2 * size - 1]))
            wider = self.most[1 : size.size + 1]
            most[: wider.size] = np.minimum(most[: wider.size], wider)
        self.before, self.most = start, most
        k, close = 0, False
        other = np.ones(size.size, bool)
        tried = np.flatnonzero((end - middle >= _TRIED) & (2.0 * most / total >= self.least))
        if tried.size and not self.places:
            self.places = _Places(self.text)
            self.places.by_line(at)
        if tried.size and self.places.sums:
            other[tried] = 2.0 * self.places.most_of_blocks(start, size[tried]) / total[tried] >= self.least
        while True:
            open_ = np.flatnonzero((2.0 * most[k:] / total[k:] >= self.least) & other[k:] | (end[k:] == at[start]))
            if not open_.size:
                return None
            k += int(open_[0]) + 1
            if end[k - 1] - middle[k - 1] >= _TRIED and 2.0 * self.places.most(int(at[start]), int(middle[k - 1]), int(end[k - 1])) / total[k - 1] < self.least:
                continue
            if not close and end[k - 1] > at[start] and min(middle[k - 1] - at[start], end[k - 1] - middle[k - 1]) < _LONG:
                most[k - 1] = n = self._shared(start, start + k, k)
                most[k:] = np.minimum(most[k:], n + middle[k:] - middle[k - 1] + end[k:] - np.maximum(end[k - 1], middle[k:]))
                close = 2.0 * n / total[k - 1] >= _CLOSE * self.least
                if 2.0 * n / total[k - 1] < self.least:
                    continue
            later = (slice(a, a + k) for a in range(start + k, start + left - k + 1, k))
            times = 1 + sum(1 for _ in takewhile(lambda b: self.same(slice(start, start + k), b), later))
            if times > 2:
                return k, times

    def kept(self) -> Iterator[str]:
        start = 0
        while start < len(self.lines):
            k, times = self.loop(start) or (1, 1)
            yield from self.lines[start : start + k]
            after = start + k * times
            rest = len(self.lines) - after
            if times > 1 and rest and self.same(slice(start, start + min(k, rest)), slice(after, None)):
                return
            start = after


def collapse_blocks(lines: list[str], least: float = 0.75) -> list[str]:
    """Blocks of lines that stand three times or more in a row (equal or alike) are kept once, smallest block first;
    so is a rest at the end that is like the block's beginning."""
    return list(_Lines(lines, least).kept())


def truncate_tail(text: str, least: float = 0.7) -> str:
    """The shortest head, cut before or after a line break, whose end is like all that follows it (8 characters at least);
    else the text."""
    most, before, close, places = len(text), 0, False, None
    for n in sorted({at for m in re.finditer("\n", text) for at in m.span()}):
        rest = len(text) - n
        if n > 3 and 8 <= rest <= n:
            tail, most, before = slice(n - rest, n), min(rest, most + n - before), n
            middle = n + rest // 2  # what stands there and before, too, is likely to be a loop, of which _Places tells nothing
            if rest >= _TRIED and most / rest >= least and text[middle : middle + _GRAMS[-1]] not in text[tail]:
                places = places or _Places(text)
                if places.most(n - rest, n, len(text)) / rest < least:
                    continue
            if rest < _LONG and not close and most / rest >= least:
                most = rest if text[tail] == text[n:] else _shared(text[tail], text[n:])
                close = most / rest >= _CLOSE * least
            if most / rest >= least and _alike(text[tail], text[n:], least):
                return text[:n].rstrip()
    return text


def spread(rows: DataFrame) -> DataFrame:
    """Rows dealt over many tasks, however few row groups they come from: a few long documents take most of the time."""
    return rows.repartition(8 * rows.sparkSession.sparkContext.defaultParallelism)


def collapse_line_blocks(rows: DataFrame, column: str) -> DataFrame:
    """``rows`` with the array of lines in ``column`` collapsed."""
    return with_mapped(spread(rows), column, column, collapse_blocks, "array<string>")


def truncate_loop_tail(rows: DataFrame, column: str) -> DataFrame:
    """``rows`` with the text in ``column`` cut where it begins to loop."""
    return with_mapped(spread(rows), column, column, truncate_tail, "string")


def _settle(lines: list[str]) -> str:
    kept = collapse_blocks(lines)
    return truncate_tail("\n".join(line for i, line in enumerate(kept) if not i or line != kept[i - 1]))


def clean_recognition(rows: DataFrame, column: str, keywords: list[str] | None = None) -> DataFrame:
    """``rows`` with ``column`` cleaned: loops, marks, echoes of the instruction (``ECHO_KEYWORDS`` or others), repeated
    blocks and lines and a looping tail go."""
    words = F.array(*map(F.lit, ECHO_KEYWORDS if keywords is None else keywords))
    lines = F.filter(normalize_ocr_lines(collapse_repeats(F.col(column))), lambda x: ~echoes(x, words))
    out = with_mapped(spread(rows).withColumn(column, lines), column, column, _settle, "string")
    return out.withColumn(column, py_strip(F.col(column))).select(*rows.columns)
