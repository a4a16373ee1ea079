"""Removal of byte strings of a given length that occur more than once in a corpus.

A corpus-wide suffix array can't be one task's work, so texts are first aligned by content: of each window of
``LENGTH`` bytes the k-gram with the smallest hash is its anchor, hence equal windows have equal anchors at equal
offsets. Neighbouring windows with the same anchor form a span. Only spans whose anchor k-gram occurs again are
looked at: those with an exact twin are repeated as a whole; of the others, one representative per variant meets
its variants, where deep-shallow sorting of the contexts right and left of the anchor gives all common prefixes
and so the repeated part. Counts are pre-aggregated, texts are shuffled once, and an anchor with more variants
than ``MOST_VARIANTS`` is settled by counting its windows' hashes over all tasks instead of in one group.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ferrytext.llm.common import dropped, slices, stored, tidied
from ferrytext.llm.suffix_sort import common_prefix, deep_shallow_sort

LENGTH = 400
GRAM = 64
#: Bytes that are searched for spans at once (some 60 bytes of arrays for each), and that come from Python in a batch.
SEGMENT, BATCH = 1 << 18, 2 << 20
#: Bytes of a passage of about fifty words.
PASSAGE = 240
#: Variants that one group may hold: about 1 KB and, in array operations, 20,000 comparisons each.
MOST_VARIANTS = 20_000
_BASE = 0x9E3779B97F4A7C15 | 1
_POSITION_BITS = 24


class Anchors:
    """Finds spans in buffers; keeps the powers that the rolling hash needs."""

    def __init__(self, length: int, gram: int) -> None:
        self.length, self.gram = length, gram
        self._grow(1 << 16)

    def _grow(self, n: int) -> None:
        bases = np.full((2, n + 1), 1, np.uint64)
        bases[0, 1:], bases[1, 1:] = _BASE, pow(_BASE, -1, 1 << 64)
        self.powers, self.inverses = np.cumprod(bases, axis=1, dtype=np.uint64)

    def gram_hashes(self, data: np.ndarray) -> np.ndarray:
        """A 64-bit hash of every k-gram."""
        n = len(data)
        if n > len(self.inverses):
            self._grow(2 * n)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * self.inverses[:n], out=sums[1:])
        h = (sums[self.gram :] - sums[: -self.gram]) * self.powers[: n - self.gram + 1]
        h *= np.uint64(0xFF51AFD7ED558CCD)
        h ^= h >> np.uint64(32)
        h *= np.uint64(0xC4CEB9FE1A85EC53)
        h ^= h >> np.uint64(29)
        return h

    def spans(self, pieces: list[bytes]) -> tuple[np.ndarray, ...]:
        """(piece, first window, last window, anchor, hash of its k-gram) of every span; positions in the piece."""
        w = self.length - self.gram + 1
        data = np.frombuffer(b"".join(pieces), np.uint8)
        offsets = np.cumsum([0, *map(len, pieces)])
        h = self.gram_hashes(data)
        packed = h >> np.uint64(_POSITION_BITS) << np.uint64(_POSITION_BITS) | np.arange(len(h), dtype=np.uint64)
        rows = -(-len(packed) // w)
        grid = np.full(rows * w, np.iinfo(np.uint64).max)
        grid[: len(packed)] = packed
        grid = grid.reshape(rows, w)
        ahead = np.minimum.accumulate(grid, axis=1).ravel()
        back = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
        n = len(data) - self.length + 1
        least = np.minimum(back[:n], ahead[w - 1 : w - 1 + n]) & np.uint64((1 << _POSITION_BITS) - 1)
        valid = np.zeros(n, bool)
        for a, b in zip(offsets, offsets[1:]):
            valid[a : b - self.length + 1] = True
        at = np.flatnonzero(valid)
        anchor = least[at].astype(np.int64)
        new = np.ones(len(at), bool)
        new[1:] = (anchor[1:] != anchor[:-1]) | (at[1:] != at[:-1] + 1)
        first = np.flatnonzero(new)
        last = np.append(first[1:], len(at)) - 1
        piece = np.searchsorted(offsets, at[first], "right") - 1
        base = offsets[piece]
        return piece, at[first] - base, at[last] - base, anchor[first] - base, h[anchor[first]]


def _keyed(docs: DataFrame) -> DataFrame:
    """doc_id, text (binary; null: empty) and a 128-bit key of the text as two longs."""
    text = F.coalesce(docs["text"], F.lit(""))
    return docs.select(
        docs["doc_id"].cast("long").alias("doc_id"),
        F.xxhash64(text).alias("k1"),
        F.xxhash64(F.lit(7), text).alias("k2"),
        text.cast("binary").alias("text"),
    )


_SPANS = pa.schema(
    [("doc_id", pa.int64()), ("k1", pa.int64()), ("k2", pa.int64()), ("n_bytes", pa.int64()), ("sha256", pa.string()), ("text", pa.binary())]
    + [(c, pa.list_(pa.int64())) for c in ("first", "last", "anchor", "gram", "span")]
)
_SPANS_DDL = "doc_id long, k1 long, k2 long, n_bytes long, sha256 string, text binary, " + ", ".join(
    f"{c} array<bigint>" for c in ("first", "last", "anchor", "gram", "span")
)


def _spans(keyed: DataFrame, length: int, gram: int) -> DataFrame:
    """One row per document; of equal texts in a task only the first has its text and spans, as has no text too short for
    a span."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder, seen = Anchors(length, gram), set()
        for batch in slices(batches, BATCH):
            texts = batch.column("text").to_pylist()
            keys = list(zip(batch.column("k1").to_pylist(), batch.column("k2").to_pylist()))
            parts: list[list[np.ndarray]] = [[] for _ in texts]
            held: list[tuple[int, int, bytes]] = []

            def flush() -> None:
                if not held:
                    return
                piece, first, last, anchor, grams = finder.spans([p for _, _, p in held])
                ends = np.searchsorted(piece, np.arange(len(held) + 1))
                for (i, start, data), a, b in zip(held, ends, ends[1:]):
                    pairs = zip(first[a:b].tolist(), (last[a:b] + length).tolist())
                    span = np.array([xxhash.xxh3_64_intdigest(data[x:y]) for x, y in pairs], np.uint64).view(np.int64)
                    parts[i].append(
                        np.stack([first[a:b] + start, last[a:b] + start, anchor[a:b] + start, grams[a:b].view(np.int64), span])
                    )
                held.clear()

            size, kept = 0, [None] * len(texts)
            for i, (text, key) in enumerate(zip(texts, keys)):
                if len(text) < length or key in seen:
                    continue
                seen.add(key)
                kept[i] = text
                for start in range(0, len(text) - length + 1, SEGMENT):
                    data = text[start : start + SEGMENT + length - 1]
                    if size + len(data) > SEGMENT:
                        flush()
                        size = 0
                    held.append((i, start, data))
                    size += len(data)
            flush()
            full = [np.concatenate(p, axis=1) if p else np.zeros((5, 0), np.int64) for p in parts]
            bounds = pa.array(np.cumsum([0, *(x.shape[1] for x in full)]), pa.int32())
            columns = np.concatenate(full, axis=1)
            yield pa.RecordBatch.from_arrays(
                [
                    *(batch.column(c) for c in ("doc_id", "k1", "k2")),
                    pa.array(map(len, texts), pa.int64()),
                    pa.array([hashlib.sha256(t).hexdigest() for t in texts], pa.string()),
                    pa.array(kept, pa.binary()),
                    *(pa.ListArray.from_arrays(bounds, pa.array(c)) for c in columns),
                ],
                schema=_SPANS,
            )

    return keyed.mapInArrow(tidied(run), _SPANS_DDL)


def shared_extents(strings: list[bytes], anchors: list[int], length: int, gram: int) -> list[tuple[int, int] | None]:
    """For strings with the same k-gram at ``anchors``: how far left and right of its anchor each repeats in others,
    over all others that share at least ``length`` bytes with it there; None if no other does."""
    right = [s[p:] for s, p in zip(strings, anchors)]
    left = [s[:p][::-1] for s, p in zip(strings, anchors)]
    n = len(strings)
    if n == 2:
        r, l = common_prefix(*right), common_prefix(*left)
        return [(l, r) if l + r >= length else None] * 2
    both = [deep_shallow_sort(right, gram), deep_shallow_sort(left)]
    rank = [np.empty(n, np.int64), np.empty(n, np.int64)]
    for where, (order, _) in zip(rank, both):
        where[order] = np.arange(n)
    steps = [np.array(lcp, np.int64) for _, lcp in both]

    def with_others(side: int, i: int) -> np.ndarray:
        """Common prefixes of string i with all, by index; with itself -1."""
        k, out = rank[side][i], np.full(n, -1, np.int64)
        out[k + 1 :] = np.minimum.accumulate(steps[side][k + 1 :])
        out[:k] = np.minimum.accumulate(steps[side][k:0:-1])[::-1]
        return out[rank[side]]

    found = []
    for i in range(n):
        r, l = with_others(0, i), with_others(1, i)
        ok = (r >= 0) & (r + l >= length)
        found.append((int(l[ok].max()), int(r[ok].max())) if ok.any() else None)
    return found


def _partial(variants: DataFrame, length: int, gram: int) -> DataFrame:
    """Repeated parts (k1, k2, start, end) of variants (gram, k1, k2, first, anchor, single, text) of the same k-gram.
    Rows come sorted by gram, and a group has a bounded number of rows."""

    def settle(rows: list[tuple]) -> Iterator[tuple]:
        if len(rows) < 2:
            return
        for row, ext in zip(rows, shared_extents([r[6] for r in rows], [r[4] - r[3] for r in rows], length, gram)):
            if ext and row[5]:
                yield row[1], row[2], row[4] - ext[0], row[4] + ext[1]

    names = ("gram", "k1", "k2", "first", "anchor", "single", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group: list[tuple] = []
        for batch in batches:
            out: list[tuple] = []
            for row in zip(*(batch.column(c).to_pylist() for c in names)):
                if group and group[0][0] != row[0]:
                    out.extend(settle(group))
                    group = []
                group.append(row)
            yield _found(out)
        yield _found(list(settle(group)))

    return variants.select(*names).repartition("gram").sortWithinPartitions("gram").mapInArrow(tidied(run), "k1 long, k2 long, start long, end long")


def _found(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([r[i] for r in rows], pa.int64()) for i in range(4)], ["k1", "k2", "start", "end"]
    )


def repeated_parts(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, most_variants: int = MOST_VARIANTS) -> tuple[DataFrame, DataFrame]:
    """(texts, removed): per document its key, size and digest; per text key with repeats the number of bytes and
    spans removed, the digest of the kept bytes, and them as text without broken characters."""
    keyed = _keyed(docs)
    table = stored(_spans(keyed, length, gram), "spans")
    texts = stored(table.select("doc_id", "k1", "k2", "n_bytes", "sha256"), "text-keys")
    copies = texts.where(F.col("n_bytes") >= length).groupBy("k1", "k2").agg(F.count("*").alias("n"), F.first("n_bytes").alias("n_bytes")).where("n > 1")

    spans = table.select("k1", "k2", F.explode(F.arrays_zip("first", "last", "anchor", "gram", "span")).alias("s")).select("k1", "k2", "s.*")
    # a table of its own, so that the join can split a hot gram
    twice = stored(spans.groupBy("gram").agg(F.count("*").alias("n")).where("n > 1").select("gram"), "shared-grams")
    spans = stored(spans.join(twice, "gram").withColumn("before", F.col("anchor") - F.col("first")), "shared-spans")
    kinds = spans.groupBy("gram", "before", "span").agg(
        F.count("*").alias("n"), F.min(F.struct("k1", "k2", "first", "last", "anchor")).alias("one")
    )
    kinds = stored(kinds, "span-kinds")
    full = spans.join(kinds.where("n > 1"), ["gram", "before", "span"], "left_semi").select(
        "k1", "k2", F.col("first").alias("start"), (F.col("last") + length).alias("end")
    )
    mixed = kinds.groupBy("gram").agg(F.count("*").alias("variants"), F.min("n").alias("least")).where("variants > 1 and least = 1")
    mixed = stored(mixed, "mixed-grams")
    needed = kinds.join(mixed, "gram").select(
        "gram", "one.*", (F.col("n") == 1).alias("single"), (F.col("variants") > most_variants).alias("hot")
    )
    touched = full.select("k1", "k2").unionByName(needed.select("k1", "k2")).distinct()
    # at most a copy of a text per task is there; the grouping leaves one
    sources = table.where("text is not null").select("k1", "k2", "text").join(touched, ["k1", "k2"])
    sources = stored(sources.groupBy("k1", "k2").agg(F.first("text").alias("text")), "texts")
    wanted = needed.groupBy("k1", "k2").agg(F.collect_list(F.struct("gram", "first", "last", "anchor", "single", "hot")).alias("wanted"))
    cut = (
        sources.join(wanted, ["k1", "k2"])
        .select("k1", "k2", "text", F.explode("wanted").alias("w"))
        .select("k1", "k2", "w.*", F.expr(f"substring(text, cast(w.first as int) + 1, cast(w.last - w.first as int) + {length})").alias("text"))
    )
    cut = stored(cut, "contexts")
    parts = _partial(cut.where("not hot"), length, gram)
    hot = _windows(cut.where("hot"), length)
    windows = _repeated(hot).select("k1", "k2", "start", (F.col("start") + length).alias("end"))
    whole = copies.select("k1", "k2", F.lit(0).cast("long").alias("start"), F.col("n_bytes").alias("end"))
    ranges = full.unionByName(parts).unionByName(windows).join(copies, ["k1", "k2"], "left_anti")
    per_text = ranges.groupBy("k1", "k2").agg(F.collect_list(F.struct("start", "end")).alias("ranges"))
    removed = _cut_out(sources.join(per_text, ["k1", "k2"]))
    gone = whole.select(
        "k1", "k2", F.col("end").alias("n_removed"), F.lit(1).cast("long").alias("n_spans"),
        F.lit(hashlib.sha256(b"").hexdigest()).alias("kept_sha256"), F.lit("").alias("kept"),
    )
    removed = stored(removed.unionByName(gone), "removed")
    dropped(table, twice, spans, kinds, mixed, sources, cut)
    return texts, removed


def _windows(rows: DataFrame, length: int) -> DataFrame:
    """A 128-bit hash of every window of the spans, with its start and its distance before the anchor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1 << 18):
            out = []
            for gram, k1, k2, first, anchor, single, text in zip(
                *(batch.column(c).to_pylist() for c in ("gram", "k1", "k2", "first", "anchor", "single", "text"))
            ):
                for i in range(len(text) - length + 1):
                    h = xxhash.xxh3_128_intdigest(text[i : i + length])
                    out.append((gram, k1, k2, first + i, anchor - first - i, single, (h >> 64) - (1 << 63), (h & (1 << 64) - 1) - (1 << 63)))
            types = [pa.int64()] * 5 + [pa.bool_()] + [pa.int64()] * 2
            yield pa.RecordBatch.from_arrays(
                [pa.array([x[i] for x in out], t) for i, t in enumerate(types)],
                ["gram", "k1", "k2", "start", "before", "single", "h1", "h2"],
            )

    return rows.select("gram", "k1", "k2", "first", "anchor", "single", "text").mapInArrow(
        tidied(run), "gram long, k1 long, k2 long, start long, before long, single boolean, h1 long, h2 long"
    )


def _repeated(windows: DataFrame) -> DataFrame:
    """Those of single spans that stand at the same distance before their anchor in another span. A context makes hundreds of
    windows, which Spark's estimate of sizes doesn't count, so none are broadcast."""
    key = ["gram", "before", "h1", "h2"]
    again = windows.groupBy(*key).agg(F.count("*").alias("n")).where("n > 1")
    return windows.where("single").join(again.hint("merge"), key, "left_semi")


def _cut_out(rows: DataFrame) -> DataFrame:
    """Texts without the union of their ranges."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 4 << 20):
            out = []
            for text, ranges in zip(batch.column("text").to_pylist(), batch.column("ranges").to_pylist()):
                kept, end, n = [], 0, 0
                for start, stop in sorted((r["start"], r["end"]) for r in ranges):
                    if start > end or not n:
                        kept.append(text[end:start])
                        n += 1
                    end = max(end, stop)
                kept.append(text[end:])
                rest = b"".join(kept)
                digest = hashlib.sha256(rest).hexdigest()
                out.append((len(text) - len(rest), n, digest, rest.decode("utf-8", "ignore")))
            types = (pa.int64(), pa.int64(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays(
                [batch.column("k1"), batch.column("k2"), *(pa.array([x[i] for x in out], t) for i, t in enumerate(types))],
                ["k1", "k2", "n_removed", "n_spans", "kept_sha256", "kept"],
            )

    return rows.select("k1", "k2", "text", "ranges").mapInArrow(
        tidied(run), "k1 long, k2 long, n_removed long, n_spans long, kept_sha256 string, kept string"
    )


def removal_digests(
    docs: DataFrame, length: int = LENGTH, gram: int = GRAM, most_variants: int = MOST_VARIANTS, *, passage: int | None = None
) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of every document; with ``passage``, another length, also
    n_repeated: how many bytes strings of that length which repeat cover. They are not removed.

    Null and empty texts, and texts shorter than ``length``, keep all they have; repeated rows are copies of each
    other and lose everything from ``length`` bytes on; an empty table gives an empty result.
    """
    texts, removed = repeated_parts(docs, length, gram, most_variants)
    rows, more = texts.join(removed.drop("kept"), ["k1", "k2"], "left"), []
    if passage is not None:
        _, shorter = repeated_parts(docs, passage, gram, most_variants)
        rows = rows.join(shorter.select("k1", "k2", F.col("n_removed").alias("n_repeated")), ["k1", "k2"], "left")
        more = [F.coalesce("n_repeated", F.lit(0)).alias("n_repeated")]
    return rows.select(
        "doc_id",
        "n_bytes",
        F.coalesce("n_removed", F.lit(0)).alias("n_removed"),
        F.coalesce("n_spans", F.lit(0)).alias("n_spans"),
        F.coalesce("kept_sha256", "sha256").alias("kept_sha256"),
        *more,
    )


def without_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, most_variants: int = MOST_VARIANTS) -> DataFrame:
    """``docs`` with the repeated bytes gone from ``text``; all columns stay, whatever their names. A character of which a
    byte is removed goes as a whole. Null texts stay null, empty ones and those shorter than ``length`` stay as they
    are; of repeated rows all lose their text; an empty table gives an empty result."""
    _, removed = repeated_parts(docs, length, gram, most_variants)
    text = docs["text"]
    long = F.octet_length(text) >= length
    rows = docs.where(long).select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.xxhash64("text").alias("k1"), F.xxhash64(F.lit(7), "text").alias("k2"))
    cut = rows.join(removed.select("k1", "k2", "kept"), ["k1", "k2"], "left")
    new = [F.coalesce("kept", "row.text").alias("text") if c == "text" else F.col("row").getField(c).alias(c) for c in docs.columns]
    return cut.select(*new).unionByName(docs.where(~F.coalesce(long, F.lit(False))))
