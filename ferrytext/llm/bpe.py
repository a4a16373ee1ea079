"""Byte-level BPE by ranks: encoding with a hierarchical-bitmap rank queue, and decoding.

The text is split by a pattern; each piece is merged on its own. Buckets per merge rank hold positions of the
linked list of symbols, a three-level bitmap over ranks gives the next rank by find-first-set, and entries whose
symbols have changed meanwhile are skipped. The work for a piece of n bytes is about n steps whatever its length.
Work is per document: no shuffle. A bounded table per task keeps what pieces were merged to.
"""

from __future__ import annotations

import base64
import gc
import hashlib
from array import array
from collections.abc import Iterator
from contextlib import contextmanager
from itertools import islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from ferrytext.llm.common import slices, text_rows, tidied, worker_copy

WORD_BITS = 64
#: Texts of about so many bytes are encoded together.
SLICE_BYTES = 2 << 20


class RankQueue:
    """Positions by rank; ``pop`` gives the lowest rank's positions. Levels of words with one bit per child."""

    def __init__(self, n_ranks: int) -> None:
        self.buckets: dict[int, list[int]] = {}
        sizes = [max(1, -(-n_ranks // WORD_BITS))]
        while sizes[-1] > 1:
            sizes.append(-(-sizes[-1] // WORD_BITS))
        self.levels = [[0] * n for n in sizes]

    def add(self, rank: int, positions: list[int]) -> None:
        """A new bucket, or more for one that is there."""
        if rank in self.buckets:
            self.buckets[rank] += positions
            return
        self.buckets[rank] = positions
        i = rank
        for level in self.levels:
            word = i >> 6
            old = level[word]
            level[word] = old | 1 << (i & 63)
            if old:
                break
            i = word

    def pop(self) -> tuple[int, list[int]] | None:
        top = self.levels[-1][0]
        if not top:
            return None
        i = 0
        for level in reversed(self.levels):
            word = level[i]
            i = i << 6 | (word & -word).bit_length() - 1
        rank = i
        for level in self.levels:
            level[i >> 6] &= ~(1 << (i & 63))
            if level[i >> 6]:
                break
            i >>= 6
        return rank, self.buckets.pop(rank)


class Bpe:
    """Merges by rank. ``ranks``: byte strings to ranks; every single byte must be there."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        self.ranks = ranks
        self.tokens = {v: k for k, v in ranks.items()}
        self.n_ranks = max(ranks.values()) + 1
        #: ids of two neighbours, as left << 20 | right, to the rank of the two together
        self.pairs = {
            ranks[token[:i]] << 20 | ranks[token[i:]]: rank
            for token, rank in ranks.items()
            for i in range(1, len(token))
            if token[:i] in ranks and token[i:] in ranks
        }
        self.bytes = np.array([ranks[bytes([i])] for i in range(256)], np.int64)
        self.first = np.full((256, 256), -1, np.int64)
        for token, rank in ranks.items():
            if len(token) == 2:
                self.first[token[0], token[1]] = rank

    def encode_pieces(self, pieces: list[bytes]) -> list[list[int]]:
        """Ids of each piece (none empty). All pieces lie in one linked list that is cut between them, so that
        the queue is walked once for all."""
        data = np.frombuffer(b"".join(pieces), np.uint8)
        ends = np.cumsum([len(x) for x in pieces])
        after, before = np.arange(1, len(data) + 1), np.arange(-1, len(data) - 1)
        after[ends - 1] = -1
        before[ends[:-1]] = -1
        symbol, after_of, before_of = self.bytes[data].tolist(), after.tolist(), before.tolist()
        queue, get = RankQueue(self.n_ranks), self.pairs.get
        first = self.first[data[:-1], data[1:]]
        first[ends[:-1] - 1] = -1
        order = np.argsort(first, kind="stable")
        order = order[first[order] >= 0]
        starts = np.flatnonzero(np.diff(first[order], prepend=-1))
        for rank, bucket in zip(first[order][starts].tolist(), np.split(order, starts[1:])):
            queue.add(rank, bucket.tolist())
        buckets = queue.buckets
        while (got := queue.pop()) is not None:
            rank, positions = got
            high = rank << 20
            positions.sort()  # equal ranks merge from left to right
            for at, i in enumerate(positions):
                j = after_of[i]
                if j < 0 or get(symbol[i] << 20 | symbol[j]) != rank:
                    continue  # stale: one of the two has been merged since
                symbol[i] = rank
                k = after_of[i] = after_of[j]
                after_of[j] = -1
                least = rank
                if k >= 0:
                    before_of[k] = i
                    if (r := get(high | symbol[k])) is not None:
                        if r in buckets:
                            buckets[r].append(i)
                        else:
                            queue.add(r, [i])
                        least = r
                if (h := before_of[i]) >= 0 and (r := get(symbol[h] << 20 | rank)) is not None:
                    if r in buckets:
                        buckets[r].append(h)
                    else:
                        queue.add(r, [h])
                    least = min(least, r)
                if least < rank:  # a lower rank has come up: it goes first
                    if at + 1 < len(positions):
                        queue.add(rank, positions[at + 1 :])
                    break
        out = []
        for i in [0, *ends[:-1].tolist()]:
            ids = []
            while i >= 0:
                ids.append(symbol[i])
                i = after_of[i]
            out.append(ids)
        return out


class Encoder:
    """Ids of texts. A text is cut before every single blank that a non-blank follows, as no piece of the pattern
    reaches over such a place; what each cut-out stands for is kept between batches, as packed ids. When full, only
    what the batch at hand needs is kept; long cut-outs are never kept.

    This holds for patterns in which a blank may only begin a piece, as in all that take an optional blank before
    letters, digits or signs; ``split_blanks=False`` matches whole texts instead.
    """

    def __init__(self, bpe: Bpe, pattern: str, most: int, split_blanks: bool = True) -> None:
        self.bpe, self.pattern, self.most, self.split_blanks = bpe, regex.compile(pattern), most, split_blanks
        self.pieces: dict[str, bytes] = {}
        self.parts: dict[str, bytes] = {}
        self.blank = regex.compile(r"\s|$")

    def trim(self, entries: int) -> None:
        """Keeps the entries that were made first, mostly of frequent words: what a worker holds between tasks is small."""
        self.parts = dict(islice(self.parts.items(), entries))
        self.pieces = dict(islice(self.pieces.items(), entries))

    def _of_pieces(self, texts: list[list[str]]) -> None:
        """Makes ``self.pieces`` have all pieces of ``texts``."""
        used = set().union(*texts)
        missing = [x for x in used if x not in self.pieces]
        if len(self.pieces) + len(missing) > self.most:
            self.pieces = {x: self.pieces[x] for x in used if x in self.pieces}
        hard = []
        for x in missing:
            data = x.encode("utf-8")
            if (rank := self.bpe.ranks.get(data)) is not None:
                self.pieces[x] = array("i", (rank,)).tobytes()
            else:
                hard.append((x, data))
        if hard:
            for (x, _), ids in zip(hard, self.bpe.encode_pieces([data for _, data in hard])):
                self.pieces[x] = array("i", ids).tobytes()

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text."""
        cut = [t.split(" ") if self.split_blanks else [t] for t in texts]
        for parts in cut if self.split_blanks else ():
            parts[1:] = [" " + x for x in parts[1:]]
        used = set().union(*cut)
        missing = [x for x in used if x not in self.parts]
        # a part that begins with a blank and then ends, or goes on with white space, isn't a cut-out: its text stays whole
        odd = {x for x in missing if x[:1] == " " and self.blank.match(x, 1)} if self.split_blanks else ()
        if odd:
            missing = [x for x in missing if x not in odd]
            for i, parts in enumerate(cut):
                if not odd.isdisjoint(parts):
                    cut[i] = [texts[i]]
                    missing.append(texts[i])
        if len(self.parts) + len(missing) > self.most:
            self.parts = {x: self.parts[x] for x in used if x in self.parts}
        found = [self.pattern.findall(x) for x in missing]
        self._of_pieces(found)
        piece = self.pieces.__getitem__
        for x, pieces in zip(missing, found):
            self.parts[x] = piece(pieces[0]) if len(pieces) == 1 else b"".join(map(piece, pieces))
        part = self.parts.__getitem__
        out = [np.frombuffer(b"".join(map(part, parts)), np.int32) for parts in cut]
        for x in {x for x in missing if len(x) > 64}:
            del self.parts[x]
        for x in [x for pieces in found for x in pieces if len(x) > 64]:
            self.pieces.pop(x, None)
        return out


def parse_ranks(data: bytes) -> dict[bytes, int]:
    """A rank file: lines of a base64 token, a blank and its rank."""
    return {base64.b64decode(a): int(b) for a, b in (line.split() for line in data.splitlines() if line.strip())}


@contextmanager
def uncollected() -> Iterator[None]:
    """Without runs of the garbage collector: the tables hold many small objects and no cycles."""
    gc.disable()
    try:
        yield
    finally:
        gc.enable()


def _codec(path: str, pattern: str, most: int, split_blanks: bool) -> tuple[Encoder, list[bytes | None]]:
    with open(path, "rb") as f:
        bpe = Bpe(parse_ranks(f.read()))
    return Encoder(bpe, pattern, most, split_blanks), [bpe.tokens.get(i) for i in range(bpe.n_ranks)]


def encode_decode(
    docs: DataFrame,
    ranks_path: str,
    pattern: str,
    *,
    with_ids: bool = False,
    cache_entries: int = 320_000,
    split_blanks: bool = True,
) -> DataFrame:
    """Per document: n_tokens, sha256 of the decimal ids joined by commas, sha256 of the bytes decoded from the
    ids and, with ``with_ids``, the ids. ``ranks_path`` is a rank file that each executor has (installed with its
    package).

    Null and empty texts have no tokens; both digests are those of the empty string. Texts of any length are encoded whole;
    merges of equal rank go from left to right; repeated rows give repeated rows; an empty table gives an empty result;
    other columns are ignored.
    """
    fields = [("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())]
    fields += [("ids", pa.list_(pa.int32()))] * with_ids
    schema = pa.schema(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, tokens = worker_copy(_codec, ranks_path, pattern, cache_entries, split_blanks)
        names = [str(i) for i in range(len(tokens))]
        for batch in slices(batches, SLICE_BYTES):
            with uncollected():
                encoded = encoder.encode([x.decode("utf-8", "replace") for x in batch.column("text").to_pylist()])
            digests, decoded = [], []
            for packed in encoded:
                ids = packed.tolist()
                digests.append(hashlib.sha256(",".join(map(names.__getitem__, ids)).encode()).hexdigest())
                decoded.append(hashlib.sha256(b"".join(map(tokens.__getitem__, ids))).hexdigest())
            arrays = [batch.column("doc_id"), pa.array(map(len, encoded), pa.int64()), pa.array(digests, pa.string()), pa.array(decoded, pa.string())]
            if with_ids:
                offsets = pa.array(np.cumsum([0, *map(len, encoded)]), pa.int32())
                arrays.append(pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(encoded))))
            yield pa.RecordBatch.from_arrays(arrays, schema=schema)
        encoder.trim(cache_entries // 8)

    ddl = "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids
    return text_rows(docs).mapInArrow(tidied(run), ddl)
