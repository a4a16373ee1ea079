"""Document fingerprints by prefix polynomial hashes.

For a text's code points c the arrays S[i] = sum of (c[j] + 1) * B^j over j < i, modulo 2^31 - 1 and for two bases, give the hash of any
span: (S[j] - S[i]) * B^-i. So the spans of GRAM code points of a whole text are hashed by a few array operations, two
spans are compared in constant time, and the longest common extension of two places is found by binary search.

A fingerprint has 128 slots. A span's hash names its slot by its top bits; a slot holds 16 bits of the smallest hash that falls there.
Two fingerprints' likeness is the share of equal slots among those that either fills, an estimate of the share of common spans.
Long texts are taken in blocks, so that the arrays never hold more than a block.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from ferrytext.llm.common import slices, tidied, worker_copy

#: The modulus is 2^31 - 1, so that a product of two residues fits 64 bits and is reduced by shifts.
PRIME_BITS = 31
PRIME = np.uint64((1 << PRIME_BITS) - 1)
BASES = 1_203_787_381, 1_889_162_053
GRAM = 12
SLOT_BITS = 7
SLOTS = 1 << SLOT_BITS
#: Code points whose arrays are held at once, and bytes of text that go to Python in one piece.
BLOCK = 1 << 14
PIECE = 4 << 20


def _mod(x: np.ndarray) -> np.ndarray:
    """``x`` modulo PRIME, for x below 2^62."""
    high = x >> np.uint64(PRIME_BITS)
    high += x & PRIME
    return np.minimum(high, high - PRIME)  # below PRIME the difference wraps around and is the larger one


class Powers:
    """B^i and B^-i for i up to ``size``, one row per base."""

    def __init__(self, size: int) -> None:
        self.size = size
        inverses = [pow(b, -1, int(PRIME)) for b in BASES]
        self.up, self.down = (np.stack([self._series(b, size + 1) for b in bases]) for bases in (BASES, inverses))

    @staticmethod
    def _series(base: int, n: int) -> np.ndarray:
        out = np.ones(n, np.uint64)
        done = 1
        while done < n:  # the first ``done`` powers times B^done are the next ones
            more = min(done, n - done)
            out[done : done + more] = _mod(out[:more] * np.uint64(pow(base, done, int(PRIME))))
            done += more
        return out


class PrefixHashes:
    """The prefix arrays of a run of at most BLOCK + GRAM code points."""

    def __init__(self, codes: np.ndarray, powers: Powers) -> None:
        n = len(codes)
        self.powers, self.length = powers, n
        terms = _mod((codes.astype(np.uint64) + np.uint64(1)) * powers.up[:, :n])
        self.sums = np.zeros((len(BASES), n + 1), np.uint64)
        self.sums[:, 1:] = _mod(np.cumsum(terms, axis=1))  # below 2^62, as there are fewer than 2^31 terms

    def spans(self, starts: np.ndarray | slice, ends: np.ndarray | slice, shift: np.ndarray | slice) -> np.ndarray:
        """62-bit hashes of the spans from starts to ends; ``shift`` selects the same places as ``starts``."""
        parts = _mod(_mod(self.sums[:, ends] + PRIME - self.sums[:, starts]) * self.powers.down[:, shift])
        return (parts[0] << np.uint64(PRIME_BITS)) | parts[1]

    def grams(self, size: int) -> np.ndarray:
        """Hashes of all spans of ``size`` code points."""
        n = self.length - size + 1
        return self.spans(slice(0, n), slice(size, size + n), slice(0, n)) if n > 0 else np.zeros(0, np.uint64)

    def span(self, start: int, end: int) -> int:
        at = slice(start, start + 1)
        return int(self.spans(at, slice(end, end + 1), at)[0])


def common_extension(a: np.ndarray, b: np.ndarray, powers: Powers | None = None) -> int:
    """How many code points two arrays share from their starts on, by binary search over spans' hashes: first blocks
    that are equal as a whole are passed, then the first that differs is halved."""
    powers, done, most = powers or tables(), 0, min(len(a), len(b))
    while done < most:
        end = min(done + BLOCK, most)
        left, right = PrefixHashes(a[done:end], powers).sums, PrefixHashes(b[done:end], powers).sums
        low, high = 0, end - done
        same = lambda i: left[0, i] == right[0, i] and left[1, i] == right[1, i]  # noqa: E731  both spans begin the arrays
        if not same(high):
            while low < high:
                middle = (low + high + 1) // 2
                if same(middle):
                    low = middle
                else:
                    high = middle - 1
            return done + low
        done = end
    return done


def tables() -> Powers:
    return worker_copy(Powers, BLOCK + GRAM)


def _mixed(h: np.ndarray) -> np.ndarray:
    """Spreads hashes over 64 bits (the finalizer of splitmix64)."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


_SLOT_STARTS = np.arange(SLOTS, dtype=np.uint64) << np.uint64(64 - SLOT_BITS)
_NONE = np.uint64(0xFFFFFFFFFFFFFFFF)


def _smallest(mixed: np.ndarray) -> np.ndarray:
    """The smallest hash of each slot; all bits where a slot has none."""
    ordered = np.append(np.sort(mixed), _NONE)
    at = np.searchsorted(ordered, _SLOT_STARTS)
    found = ordered[at]
    return np.where((found >> np.uint64(64 - SLOT_BITS)) == np.arange(SLOTS, dtype=np.uint64), found, _NONE)


def _digits(smallest: np.ndarray) -> str:
    values = np.where(smallest == _NONE, 0, smallest % np.uint64(65535) + np.uint64(1))
    return values.astype(">u2").tobytes().hex()


def fingerprint_all(texts: list[np.ndarray], powers: Powers) -> list[str]:
    """Fingerprints of arrays of code points. Short texts are hashed together, as one run of code points of which spans over
    a text's end are left out; a text over a block goes block by block. A text shorter than GRAM is one span."""
    out = [""] * len(texts)
    group: list[int] = []
    held = 0

    def flush() -> None:
        nonlocal held
        if group:
            hashes = PrefixHashes(np.concatenate([texts[i] for i in group]), powers)
            mixed, start = _mixed(hashes.grams(GRAM)), 0
            for i in group:
                n = len(texts[i])
                own = mixed[start : start + n - GRAM + 1] if n >= GRAM else _mixed(np.array([hashes.span(start, start + n)][: n and 1], np.uint64))
                out[i] = _digits(_smallest(own))
                start += n
            group.clear()
            held = 0

    for i, codes in enumerate(texts):
        if len(codes) > BLOCK:
            least = np.full(SLOTS, _NONE, np.uint64)
            for start in range(0, len(codes) - GRAM + 1, BLOCK):
                grams = PrefixHashes(codes[start : start + BLOCK + GRAM - 1], powers).grams(GRAM)
                least = np.minimum(least, _smallest(_mixed(grams)))
            out[i] = _digits(least)
            continue
        if held + len(codes) > BLOCK:
            flush()
        group.append(i)
        held += len(codes)
    flush()
    return out


def code_points(text: bytes | None) -> np.ndarray:
    return np.frombuffer((text or b"").decode("utf-8", "surrogateescape").encode("utf-32-le", "surrogatepass"), np.uint32)


def with_fingerprint(rows: DataFrame, text: str, to: str, against: str | None = None, common: str | None = None) -> DataFrame:
    """``rows`` with the fingerprint of column ``text`` as column ``to``, 512 hex digits. With ``against``, a second column of text,
    also the number of code points that both share from the start on as column ``common``.

    Null and empty texts have no spans: all digits are 0. Columns of the same names are replaced, all others stay. Long texts are taken
    whole, in blocks; equal texts have equal fingerprints; an empty table stays empty.
    """
    kept = rows.drop(to, *([common] if common else []))
    types = [f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields] + [f"`{to}` string"] + ([f"`{common}` long"] if common else [])
    names = [*kept.columns, to, *([common] if common else [])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = tables()
        for batch in slices(batches, PIECE, text):
            codes = [code_points(x.encode() if isinstance(x, str) else x) for x in batch.column(text).to_pylist()]
            new = [pa.array(fingerprint_all(codes, powers), pa.string())]
            if common:
                others = (code_points(x.encode() if isinstance(x, str) else x) for x in batch.column(against).to_pylist())
                new.append(pa.array([common_extension(a, b, powers) for a, b in zip(codes, others, strict=True)], pa.int64()))
            yield pa.RecordBatch.from_arrays([*batch.columns, *new], names)

    return kept.mapInArrow(tidied(run), ", ".join(types))


@F.arrow_udf(DoubleType())
def likeness(a: pa.Array, b: pa.Array) -> pa.Array:
    """Share of equal slots among those that either of two fingerprints fills, 0 to 1; 1 if neither fills any; null if one is null."""
    known = np.flatnonzero((a.is_valid().to_numpy(False) & b.is_valid().to_numpy(False)))
    slots = lambda x: np.frombuffer("".join(x.take(pa.array(known)).to_pylist()).encode(), "S4").reshape(-1, SLOTS)
    left, right = slots(a), slots(b)
    filled = ((left != b"0000") | (right != b"0000")).sum(axis=1)
    equal = ((left == right) & (left != b"0000")).sum(axis=1)
    shares = np.full(len(a), np.nan)
    shares[known] = np.where(filled == 0, 1.0, equal / np.maximum(filled, 1))
    return pa.array(shares, pa.float64(), mask=np.isin(np.arange(len(a)), known, invert=True))


#: Bytes of text that a bucket of the order of ids holds on average, and keys sampled per bucket to find where to cut.
BUCKET_BYTES = 128 << 20
KEYS_PER_BUCKET = 8


def _cuts(rows: DataFrame) -> list[tuple[int, int, int]]:
    """Keys (null last, id, hash of the text) that cut the descending order into buckets; the first is the first key of all. Each is
    a key of a row. The sample is by hashes of keys, KEYS_PER_BUCKET for each bucket of BUCKET_BYTES, so its size is bounded by
    the number of buckets; it decides where rows are worked on, not what comes out."""
    spark = rows.sparkSession
    key = F.struct("known", "doc_id", "tie")
    n, size, first = rows.agg(F.count("*"), F.sum(F.octet_length("text")), F.max(key)).first()
    if not n:
        return []
    parts = max(math.ceil((size or 0) / BUCKET_BYTES), 2 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    share = max(n // (parts * KEYS_PER_BUCKET), 1)
    sampled = rows.select("known", "doc_id", "tie").where(F.pmod(F.xxhash64("doc_id", "tie"), F.lit(share)) == 0).distinct()
    keys = sorted({tuple(r) for r in sampled.toArrow().to_pandas().itertuples(index=False)} | {tuple(first)}, reverse=True)
    return keys[:: max(len(keys) // parts, 1)]


def in_buckets(docs: DataFrame) -> DataFrame:
    """doc_id, text, fingerprint, bucket and ``ahead``: the rows in buckets of the order by descending id, and at the end of each bucket
    (``ahead`` is 1) the first row of the next one, that of the first bucket after the last."""
    id_ = docs["doc_id"].cast("long")
    text = F.coalesce(docs["text"], F.lit(""))
    rows = docs.select(
        id_.isNotNull().cast("int").alias("known"), F.coalesce(id_, F.lit(0)).alias("doc_id"), F.xxhash64(text).alias("tie"), text.alias("text")
    )
    cuts = np.array(_cuts(rows)[::-1], dtype=[("known", "i4"), ("doc_id", "i8"), ("tie", "i8")])  # ascending now
    shared = docs.sparkSession.sparkContext.broadcast(cuts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bounds = shared.value
        for batch in batches:
            keys = np.empty(batch.num_rows, bounds.dtype)
            for name in bounds.dtype.names:
                keys[name] = batch.column(name).to_numpy(zero_copy_only=False)
            above = np.searchsorted(bounds, keys)  # bounds below the key; a bound itself is the first of its bucket
            bucket = len(bounds) - 1 - above
            exact = np.flatnonzero(bounds[np.minimum(above, len(bounds) - 1)] == keys)
            own = pa.RecordBatch.from_arrays([*batch.columns, pa.array(bucket, pa.int32()), pa.array(np.zeros(len(keys)), pa.int32())], names)
            yield own
            if len(exact):
                firsts = batch.take(pa.array(exact))
                before = (bucket[exact] - 1) % len(bounds)
                yield pa.RecordBatch.from_arrays([*firsts.columns, pa.array(before, pa.int32()), pa.array(np.ones(len(exact)), pa.int32())], names)

    marked = with_fingerprint(rows, "text", "fingerprint")
    names = [*marked.columns, "bucket", "ahead"]
    schema = "known int, doc_id long, tie long, text string, fingerprint string, bucket int, ahead int"
    return marked.mapInArrow(run, schema)


def edited_fingerprints(docs: DataFrame) -> DataFrame:
    """Holds every text's fingerprint against that of its edited text and of the next document's.

    The edited text has the first floor(n_chars / 3) code points (or all) of the next document in place of as many last ones. The order is by
    descending id, null ids last, rows of one id by the hash of their text; after the last comes the first. Returns doc_id,
    n_chars, edited (the text), fingerprint, edited_fingerprint, near_edited, near_next (0 to 1) and common_prefix (code points that text and edited
    text share from the start on). Null texts are empty; an empty or short text may be its own edited text; repeated rows
    follow each other, so all but the last of them are compared with themselves; long texts are taken whole; an empty table gives an empty
    result; other columns are left behind. Buckets of the order are cut at sampled keys, and every bucket gets the
    next one's first row, so texts are shuffled once.
    """
    order = Window.partitionBy("bucket").orderBy(F.asc("ahead"), F.desc("known"), F.desc("doc_id"), F.desc("tie"), F.desc("text"))
    rows = in_buckets(docs).select("*", F.lead("text").over(order).alias("next_text"), F.lead("fingerprint").over(order).alias("next_fingerprint"))
    n = F.length("text").cast("long")
    cut = F.floor(n / 3).cast("int")
    edited = F.concat(F.left("text", n.cast("int") - cut), F.left("next_text", cut))
    rows = rows.where("ahead = 0").select(
        F.when(F.col("known") == 1, F.col("doc_id")).alias("doc_id"), n.alias("n_chars"), "text", edited.alias("edited"), "fingerprint", "next_fingerprint"
    )
    done = with_fingerprint(rows, "edited", "edited_fingerprint", against="text", common="common_prefix")
    return done.select(
        "doc_id", "n_chars", "edited", "fingerprint", "edited_fingerprint",
        likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"),
        likeness(F.col("fingerprint"), F.col("next_fingerprint")).alias("near_next"),
        "common_prefix",
    )
