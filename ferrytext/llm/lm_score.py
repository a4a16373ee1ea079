"""Language-model scores of whole texts: word unigrams over the corpus and a causal self-attention model.

Texts are read once: a pass over blocks of texts gives, per block, the subword ids of its documents, where its words
stand, and how often its rarer words occur. All else is made from that table. Frequent words (a bounded list chosen from
a sample; it only routes the work) are counted per document and block and their sums shipped to the tasks. All others
are summed by word, pre-aggregated, and joined back: a row per block and word.

The model's counts are sums over all training texts. The network starts from windows drawn from all of them, as many as
grow with the cube root of the corpus, and then learns from every window: texts are dealt to groups by a hash, each group is
passed over from the same start, and the weights that come of it are averaged by the number of windows.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ferrytext.llm.attention import CLASSES, FRESH, HEADS, WINDOW, AttentionModel, classes_of, framed, heads_of, scored_rows, windows_of
from ferrytext.llm.bpe import Bpe, parse_ranks
from ferrytext.llm.common import LOWER_TABLE, fold, slices, stored, text_rows, tidied, worker_copy

BLOCK_BYTES = 8 << 20
#: Bounds of the list of frequent words and of the rows it is chosen from (about so many, by hash).
FREQUENT, FREQUENT_ROWS = 40_000, 8_000
#: Pairs of ids that the model remembers; all are counted, and the shares of the rest go to single ids.
MOST_PAIRS = 1 << 19
#: The network starts from so many times the cube root of the number of windows of all training texts.
WINDOWS_PER_ROOT = 1_000
#: Windows of a group of texts that the network passes over on its own, and the sums of weights that the driver gets.
GROUP_WINDOWS, SUMS = 1 << 17, 16
#: Words over so many bytes are merged by the rank queue, whose time is about linear in their length.
LONG_WORD = 1_000


def words_of(text: bytes) -> list[bytes]:
    return text.translate(LOWER_TABLE).split()


class Subwords:
    """Subword ids of words, each behind a blank, by a public rank file. A word's ids depend on nothing but the word."""

    def __init__(self, ranks_path: str, pattern: str) -> None:
        with open(ranks_path, "rb") as f:
            self.ranks = parse_ranks(f.read())
        self.end = max(self.ranks.values()) + 1
        self.pattern = pattern
        self.encoding = tiktoken.Encoding("subwords", pat_str=pattern, mergeable_ranks=self.ranks, special_tokens={})
        self.blank = np.zeros(self.end, bool)
        self.blank[[i for token, i in self.ranks.items() if token[:1] == b" "]] = True
        self.bpe: Bpe | None = None

    def alone(self, word: bytes) -> np.ndarray:
        text = " " + word.decode("utf-8", "replace")
        if len(word) <= LONG_WORD:
            return np.array(self.encoding.encode_ordinary(text), np.int64)
        self.bpe = self.bpe or Bpe(self.ranks)
        pieces = [x.encode() for x in regex.findall(self.pattern, text)]
        return np.concatenate([np.array(x, np.int64) for x in self.bpe.encode_pieces(pieces)])

    def encode(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all words in a row, and how many each has. Plain words are encoded together: the only blanks are
        those before words, so a token that begins with one begins a word. Long words, and those with white space other
        than blanks, are encoded on their own."""
        if not words:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        joined = " " + b" ".join(words).decode("utf-8", "replace")
        odd = [i for i, w in enumerate(words) if len(w) > LONG_WORD]
        if regex.search(r"[^\S ]", joined):
            odd += [i for i, w in enumerate(words) if len(w) <= LONG_WORD and regex.search(r"\s", w.decode("utf-8", "replace"))]
        if odd:
            alone = {i: self.alone(words[i]) for i in odd}
            joined = " " + b" ".join(b"x" if i in alone else w for i, w in enumerate(words)).decode("utf-8", "replace")
        ids = np.array(self.encoding.encode_ordinary(joined), np.int64)
        starts = np.flatnonzero(self.blank[ids])
        if len(starts) != len(words):
            raise ValueError("the pattern joins words")
        sizes = np.diff(np.append(starts, len(ids)))
        if odd:
            parts = [alone.get(i, x) for i, x in enumerate(np.split(ids, starts[1:]))]
            ids, sizes = np.concatenate(parts), np.array([len(x) for x in parts])
        return ids, sizes


#: Lower-cases A-Z and makes blanks of all white space.
_BLANKED = bytes(32 if 9 <= b <= 13 else b for b in LOWER_TABLE)


def numbered(texts: pa.Array, known: pa.Array) -> tuple[list[np.ndarray], list[bytes]]:
    """The numbers of each text's words (``words_of``), and the words that are not known: these are numbered from len(known) on, in
    order of appearance. Only those become Python objects, each once."""
    at = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset :][: len(texts) + 1]
    plain = texts.buffers()[2].slice(at[0], at[-1] - at[0]).to_pybytes().translate(_BLANKED) if at[-1] > at[0] else b""
    cut = pc.split_pattern(pa.Array.from_buffers(pa.binary(), len(texts), [None, pa.py_buffer(at - at[0]), pa.py_buffer(plain)]), " ")
    words = cut.flatten()
    is_word = pc.binary_length(words).to_numpy() > 0
    ends = np.concatenate([[0], np.cumsum(is_word)])[cut.offsets.to_numpy()]
    coded = words.filter(pa.array(is_word)).dictionary_encode()
    found = pc.index_in(coded.dictionary, known)
    numbers, new = found.fill_null(-1).to_numpy().copy(), coded.dictionary.filter(found.is_null())
    numbers[numbers < 0] = len(known) + np.arange(len(new))
    joined = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(new)], pa.int32()), new), b" ")[0]
    return np.split(numbers.astype(np.int32)[coded.indices.to_numpy()], ends[1:-1]), joined.as_buffer().to_pybytes().split()


def _frequent_words(rows: DataFrame, n: int) -> list[bytes]:
    """The most frequent words, 64 bytes long at most, of about FREQUENT_ROWS of the n rows."""
    every = max(1, n // FREQUENT_ROWS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[bytes] = Counter()
        for batch in batches:
            for text in batch.column("text").to_pylist():
                seen.update(w for w in words_of(text) if len(w) <= 64)
        yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()), pa.array(list(seen.values()), pa.int64())], ["word", "n"])

    sample = rows.where(F.pmod(F.xxhash64("doc_id"), F.lit(every)) == 0).select("text")
    counted = sample.mapInArrow(tidied(run), "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return [bytes(r["word"]) for r in counted.where("n > 1").orderBy(F.col("n").desc(), "word").limit(FREQUENT).collect()]


def packed(end: int) -> type[np.unsignedinteger]:
    """The integers that hold ids up to ``end`` and the filling behind it."""
    return np.uint16 if end + 1 < 1 << 16 else np.uint32


#: Rows with a word: its places in a block as pairs (document, occurrences) of int32, and its occurrences in training
#: documents. Rows without: the block's documents; per document how many words, ids and distinct frequent words it has, and
#: the ids, the frequent words (uint16) and their occurrences (int32) of all documents in a row.
_BLOCKS = pa.schema(
    [
        ("block", pa.int64()), ("word", pa.binary()), ("places", pa.binary()), ("n", pa.int64()),
        ("doc_ids", pa.list_(pa.int64())), ("held", pa.list_(pa.bool_())), ("words", pa.list_(pa.int64())),
        ("sizes", pa.list_(pa.int64())), ("ids", pa.binary()), ("distinct", pa.list_(pa.int64())),
        ("frequent", pa.binary()), ("times", pa.binary()),
    ]
)
_BLOCKS_DDL = (
    "block long, word binary, places binary, n long, doc_ids array<bigint>, held array<boolean>, words array<bigint>,"
    " sizes array<bigint>, ids binary, distinct array<bigint>, frequent binary, times binary"
)


def blocks(rows: DataFrame, frequent: list[bytes], ranks_path: str, pattern: str) -> DataFrame:
    """The table of blocks of ``rows`` (doc_id, held, text)."""
    shipped = rows.sparkSession.sparkContext.broadcast(frequent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        subwords: Subwords = worker_copy(Subwords, ranks_path, pattern)
        frequent = shipped.value
        known, places = subwords.encode(frequent), pa.array(frequent, pa.binary())
        numbers = count(TaskContext.get().partitionId() << 32)
        for batch in slices(batches, BLOCK_BYTES):
            yield from _block(next(numbers), batch, *numbered(batch.column("text").cast(pa.binary()), places), known, subwords)

    return rows.select("doc_id", "held", "text").mapInArrow(tidied(run), _BLOCKS_DDL)


def _block(
    block: int, batch: pa.RecordBatch, parts: list[np.ndarray], rare: list[bytes], known: tuple[np.ndarray, np.ndarray], subwords: Subwords
) -> Iterator[pa.RecordBatch]:
    """Both kinds of rows of a block, given the numbers of each text's words: those of frequent words come first."""
    n_docs, n_frequent, taught = len(parts), len(known[1]), ~np.array(batch.column("held").to_pylist(), bool)
    words = np.array([len(x) for x in parts], np.int64)
    flat, docs = np.concatenate(parts), np.repeat(np.arange(n_docs, dtype=np.int32), words)
    new = subwords.encode(rare)
    ids, each = np.concatenate([known[0], new[0]]).astype(packed(subwords.end)), np.concatenate([known[1], new[1]]).astype(np.int32)
    at, sizes = (np.cumsum(each) - each).astype(np.int32), each[flat]
    stream = ids[np.repeat(at[flat] - (np.cumsum(sizes) - sizes).astype(np.int32), sizes) + np.arange(sizes.sum(), dtype=np.int32)]

    is_rare = flat >= n_frequent
    pairs, times = np.unique(docs[~is_rare] * np.int64(max(1, n_frequent)) + flat[~is_rare], return_counts=True)
    doc, number = np.divmod(pairs, max(1, n_frequent))
    lists = (
        batch.column("doc_id").to_pylist(), (~taught).tolist(), words.tolist(), np.bincount(docs, sizes, n_docs).astype(np.int64).tolist(),
        stream.tobytes(), np.bincount(doc, minlength=n_docs).tolist(), number.astype(np.uint16).tobytes(), times.astype(np.int32).tobytes(),
    )
    nothing = [pa.nulls(1, pa.binary()), pa.nulls(1, pa.binary()), pa.nulls(1, pa.int64())]
    listing = [pa.array([x], f.type) for x, f in zip(lists, list(_BLOCKS)[4:])]
    yield pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), *nothing, *listing], schema=_BLOCKS)

    pairs, times = np.unique((flat[is_rare] - n_frequent) * np.int64(n_docs) + docs[is_rare], return_counts=True)
    word, doc = np.divmod(pairs, n_docs)
    offsets = (np.append(np.flatnonzero(np.diff(word, prepend=-1)), len(word)) * 8).astype(np.int32)
    places = pa.py_buffer(np.stack([doc, times], axis=1).astype(np.int32).tobytes())
    occurrences = np.bincount(word, times * taught[doc], len(rare)).astype(np.int64)
    m = len(rare)
    places = pa.Array.from_buffers(pa.binary(), m, [None, pa.py_buffer(offsets.tobytes()), places])
    columns = [pa.array(np.full(m, block)), pa.array(rare, pa.binary()), places, pa.array(occurrences)]
    yield pa.RecordBatch.from_arrays([*columns, *(pa.nulls(m, f.type) for f in list(_BLOCKS)[4:])], schema=_BLOCKS)


class _Listed:
    """The documents of one row of the table of blocks."""

    def __init__(self, batch: pa.RecordBatch, i: int, end: int) -> None:
        of = lambda c: batch.column(c)[i]
        array = lambda c: of(c).values.to_numpy(zero_copy_only=False)
        data = lambda c, kind: np.frombuffer(of(c).as_buffer(), kind)
        self.held, self.words, self.sizes = array("held").astype(bool), array("words"), array("sizes")
        self.doc_ids = of("doc_ids").values
        self.ids, self.frequent, self.times = data("ids", packed(end)), data("frequent", np.uint16), data("times", np.int32)
        self.docs = np.repeat(np.arange(len(self.sizes)), array("distinct"))


_LISTED = ("block", "doc_ids", "held", "words", "sizes", "ids", "distinct", "frequent", "times")


def counted(table: DataFrame, n_frequent: int, end: int) -> DataFrame:
    """(key, n) over training documents: of neighbouring ids with the ends of texts, key is the id before times the number
    of ids plus the id; of frequent words it is -1 minus the word's number."""
    n_ids = end + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, keys, times = np.zeros(n_frequent, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)

        def rows(keys: np.ndarray, times: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(keys), pa.array(times)], ["key", "n"])

        for batch in batches:
            for i in range(batch.num_rows):
                x = _Listed(batch, i, end)
                words += np.bincount(x.frequent, x.times * ~x.held[x.docs], n_frequent).astype(np.int64)[:n_frequent]
                ids, sizes = x.ids[np.repeat(~x.held, x.sizes)], x.sizes[~x.held]
                stream = np.full(len(ids) + len(sizes) + 1, end, np.int64)
                stream[np.repeat(np.arange(1, len(sizes) + 1), sizes) + np.arange(len(ids))] = ids
                new, n = np.unique(stream[:-1] * n_ids + stream[1:], return_counts=True)
                keys, at = np.unique(np.concatenate([keys, new]), return_inverse=True)
                times = np.bincount(at, np.concatenate([times, n]), len(keys)).astype(np.int64)
                if len(keys) > 2_000_000:
                    yield rows(keys, times)
                    keys, times = keys[:0], times[:0]
        yield rows(keys, times)
        at = np.flatnonzero(words)
        yield rows(-1 - at, words[at])

    listing = table.where("word is null").select(*_LISTED)
    return listing.mapInArrow(tidied(run), "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))


def drawn_windows(table: DataFrame, end: int) -> np.ndarray:
    """Windows of training texts, each drawn by a hash of its text and place, sorted."""
    kind, rows = packed(end), lambda x: F.when(x["held"], 0).otherwise(1 + F.floor(x["sizes"] / FRESH))
    size = F.aggregate(F.arrays_zip("held", "sizes"), F.lit(0).cast("long"), lambda n, x: n + rows(x))
    listing = table.where("word is null").select(*_LISTED)
    places = listing.agg(F.sum(size)).first()[0] or 0
    limit = np.uint64(min(1.0, WINDOWS_PER_ROOT * max(1, places) ** (1 / 3 - 1)) * ((1 << 64) - 2048))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                x = _Listed(batch, i, end)
                ids, sizes = x.ids[np.repeat(~x.held, x.sizes)], x.sizes[~x.held]
                starts = np.cumsum(sizes) - sizes
                names = [d for d, is_held in zip(x.doc_ids.to_pylist(), x.held) if not is_held]
                marks = [zlib.crc32(ids[a : a + n].tobytes(), zlib.crc32(str(d).encode())) for d, a, n in zip(names, starts, sizes)]
                stream, first = framed(ids, sizes, end)
                rows = scored_rows(stream, first)
                text = np.searchsorted(first, rows, "right") - 1
                h = np.array(marks, np.uint64)[text] << np.uint64(32) | (rows - first[text]).astype(np.uint64)
                for shift, multiplier in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB), (31, 1)):
                    h = (h ^ h >> np.uint64(shift)) * np.uint64(multiplier)
                yield pa.RecordBatch.from_arrays([pa.array([windows_of(stream, rows[h <= limit]).astype(kind).tobytes()], pa.binary())], ["windows"])

    found = listing.mapInArrow(tidied(run), "windows binary").toArrow()["windows"].to_pylist()
    windows = np.frombuffer(b"".join(found), kind).reshape(-1, WINDOW + 1)
    return windows[np.lexsort(windows.T)]


def _dealt(table: DataFrame, end: int, groups: int) -> DataFrame:
    """Training texts in groups by a hash of their id and ids: (grp, mark, ids), those of a group one after the other. Neither
    groups nor their order depend on how the rows came."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                x = _Listed(batch, i, end)
                starts, names = np.cumsum(x.sizes) - x.sizes, x.doc_ids.to_pylist()
                ids = [x.ids[starts[d] : starts[d] + x.sizes[d]].tobytes() for d in np.flatnonzero(~x.held)]
                marks = [zlib.crc32(v, zlib.crc32(str(names[d]).encode())) for d, v in zip(np.flatnonzero(~x.held), ids)]
                columns = [pa.array([m % groups for m in marks], pa.int32()), pa.array(marks, pa.int64()), pa.array(ids, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, ["grp", "mark", "ids"])

    texts = table.where("word is null").select(*_LISTED).mapInArrow(tidied(run), "grp int, mark long, ids binary")
    return texts.repartition(min(groups, 4096), "grp").sortWithinPartitions("grp", "mark", "ids")


def _windows(texts: list[bytes], end: int) -> np.ndarray:
    """Every window of some texts' ids."""
    kind = packed(end)
    stream, first = framed(np.frombuffer(b"".join(texts), kind), np.array([len(t) // kind().itemsize for t in texts]), end)
    return windows_of(stream.astype(kind), scored_rows(stream, first))


def passed_over(table: DataFrame, model: AttentionModel, group: int = GROUP_WINDOWS) -> tuple[np.ndarray, int]:
    """The network's weights, in a row, after a pass over every window of all training texts, and how many windows these were.
    Groups of about ``group`` windows are passed over on their own, from the same start; weights are means over groups by
    their windows."""
    rows = lambda x: F.when(x["held"], 0).otherwise(1 + F.floor(x["sizes"] / FRESH))
    size = F.aggregate(F.arrays_zip("held", "sizes"), F.lit(0).cast("long"), lambda n, x: n + rows(x))
    groups = -(-(table.where("word is null").agg(F.sum(size)).first()[0] or 0) // group)
    if not groups:
        return np.zeros(0), 0
    shipped, end = table.sparkSession.sparkContext.broadcast(model), model.end

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, texts, held, nth = shipped.value, [], 0, 0

        def learned(grp: int) -> pa.RecordBatch:
            windows = _windows(texts, end)
            columns = [[grp % SUMS], [grp], [nth], [len(windows)], [model.passed(windows).tobytes()]]
            kinds = (pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["part", "grp", "nth", "n", "weights"])

        last = None
        for batch in batches:
            for grp, ids in zip(batch.column("grp").to_pylist(), batch.column("ids").to_pylist()):
                if texts and (grp != last or held >= 4 * group):  # a group of many copies is several, in bounded memory
                    yield learned(last)
                    texts, held, nth = [], 0, nth + 1
                last, held = grp, held + 1 + len(ids) // (FRESH * packed(end)().itemsize)
                texts.append(ids)
        if texts:
            yield learned(last)

    def add(found: pa.Table) -> pa.Table:
        sums = 0.0
        for r in sorted(found.to_pylist(), key=lambda r: (r["grp"], r["nth"])):
            sums = sums + r["n"] * np.frombuffer(r["weights"], np.float32).astype(float)
        return pa.table({"part": found["part"][:1], "n": [pc.sum(found["n"]).as_py()], "sums": [sums.tobytes()]})

    tasks = _dealt(table, end, groups).select("grp", "ids").mapInArrow(tidied(run), "part int, grp int, nth int, n long, weights binary")
    found = stored(tasks.groupBy("part").applyInArrow(add, "part int, n long, sums binary"), "weights").orderBy("part").collect()
    shipped.unpersist()
    n = sum(r["n"] for r in found)
    return sum(np.frombuffer(r["sums"]) for r in found) / n, n


def learned(table: DataFrame, n_frequent: int, end: int) -> tuple[AttentionModel, np.ndarray]:
    """The model and the occurrences of frequent words, from the training documents of a table of blocks. The driver gets
    sums per id, per id and head, and per id and class, at most MOST_PAIRS pairs, the windows that the network starts from, and
    SUMS sums of its weights."""
    n_ids = end + 1
    sums = stored(counted(table, n_frequent, end), "pair-counts")

    def by_key(rows: DataFrame, size: int) -> np.ndarray:
        found, out = rows.groupBy("key").agg(F.sum("n").alias("n")).toArrow(), np.zeros(size, np.int64)
        out[found["key"].to_numpy()] = found["n"].to_numpy()
        return out

    occurrences = by_key(sums.where("key < 0").select((-1 - F.col("key")).alias("key"), "n"), n_frequent)
    before, ids = F.floor(F.col("key") / n_ids), F.pmod("key", F.lit(n_ids))
    pairs = sums.where("key >= 0").select("key", before.alias("before"), ids.alias("id"), "n")
    counts = by_key(pairs.select(F.col("id").alias("key"), "n"), n_ids)

    def by_table(values: np.ndarray, column: str, other: str, width: int) -> np.ndarray:
        """Sums per ``other`` and what ``values`` says of ``column``, an array of width columns."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                key = batch.column(other).to_numpy() * width + values[batch.column(column).to_numpy()]
                key, at = np.unique(key, return_inverse=True)
                n = np.bincount(at, batch.column("n").to_numpy(), len(key)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(n)], ["key", "n"])

        return by_key(pairs.mapInArrow(run, "key long, n long"), n_ids * width).reshape(n_ids, width)

    cls = classes_of(counts, by_table(heads_of(counts), "before", "id", HEADS))
    follows = by_table(cls, "id", "before", CLASSES)
    # pairs are taken by steps of their counts' logarithms, so as to hold the most that the bound allows
    step = F.floor(F.log("n") * 64).cast("int")
    most, last = 0, None
    for r in sorted(pairs.groupBy(step.alias("step")).count().collect(), key=lambda r: -r["step"]):
        most += r["count"]
        if most > MOST_PAIRS:
            break
        last = r["step"]
    kept = pairs.where(step >= (last if last is not None else 1 << 30)).select("id", "before", "n").toArrow()
    kept = [kept[c].to_numpy() for c in ("id", "before", "n")]
    order = np.lexsort((kept[0], kept[1], -kept[2]))
    model = AttentionModel(counts, cls, follows, tuple(x[order] for x in kept), drawn_windows(table, end))
    weights, n = passed_over(table, model)
    if n:
        model.settle(weights)
    return model, occurrences


_PARTS = "block long, doc_ids array<bigint>, held array<boolean>, words array<bigint>, known array<bigint>, logs array<double>, scores array<double>"


def _scored(table: DataFrame, occurrences: np.ndarray, model: AttentionModel) -> DataFrame:
    """Per block: its documents, how many of their frequent words are known, the logs of those, and the model's scores."""
    shipped = table.sparkSession.sparkContext.broadcast((occurrences, model))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        occurrences, model = shipped.value
        logs = np.log10(occurrences + 0.5)
        for batch in batches:
            for i in range(batch.num_rows):
                x = _Listed(batch, i, model.end)
                n = len(x.sizes)
                known = np.bincount(x.docs, x.times * (occurrences[x.frequent] > 0), n).astype(np.int64)
                starts = np.append(np.cumsum(x.sizes) - x.sizes, len(x.ids))
                scores = [model.log10(x.ids[starts[a] : starts[min(a + 256, n)]], x.sizes[a : a + 256]) for a in range(0, n, 256)]
                lists = (x.held.tolist(), x.words.tolist(), known.tolist(), np.bincount(x.docs, x.times * logs[x.frequent], n).tolist(), np.concatenate(scores).tolist())
                arrays = [pa.array([v]) for v in lists]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("block").slice(i, 1), batch.column("doc_ids").slice(i, 1), *arrays],
                    ["block", "doc_ids", "held", "words", "known", "logs", "scores"],
                )

    return table.where("word is null").select(*_LISTED).mapInArrow(tidied(run), _PARTS)


_SCORES = pa.schema(
    [
        ("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()),
        ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64()),
    ]
)


def score_texts(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score (smoothed unigrams over words and an end) and score
    (the attention model's log10 probability of the subwords of the words, each behind a blank, and an end).

    Documents of fold 1 of 5 are held out of all learning. Null and empty texts are an end alone. Repeated rows count
    and come out as often as they are there. Words of any length are scored whole; a text larger than a block is a block of its
    own. Without training documents N is 0, nothing is known and the model is uniform over classes. An empty table
    gives an empty result; columns other than doc_id and text are ignored.
    """
    rows = text_rows(docs).withColumn("held", fold(F.col("doc_id"), 5) == 1)
    end = Subwords(ranks_path, pattern).end
    taught = rows.where("not held")
    frequent = _frequent_words(taught, taught.count())
    table = stored(blocks(rows, frequent, ranks_path, pattern), "blocks")
    model, occurrences = learned(table, len(frequent), end)

    listing = table.where("word is null")
    ends = listing.agg(F.sum(F.size(F.filter("held", lambda h: ~h)))).first()[0] or 0
    rare = table.where("word is not null").select("block", "word", "places", "n")
    sums = stored(rare.groupBy("word").agg(F.sum("n").alias("c")), "word-counts")
    n_rare, v_rare = sums.agg(F.sum("c"), F.count_if(F.col("c") > 0)).first()
    total = int(ends + occurrences.sum() + (n_rare or 0))
    distinct = int((ends > 0) + (occurrences > 0).sum() + (v_rare or 0))
    room = math.log10(total + 0.5 * (distinct + 1))
    end_log, end_known = math.log10(ends + 0.5), int(ends > 0)

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                listed = {c: batch.column(c)[i].as_py() for c in ("doc_ids", "held", "words", "known", "logs", "scores")}
                n, n_tokens = len(listed["doc_ids"]), np.array(listed["words"]) + 1
                logs, known = np.array(listed["logs"]) + end_log, np.array(listed["known"]) + end_known
                found = batch.column("rare")[i].values
                if found is not None:
                    places = found.field("places")
                    pairs = np.frombuffer(b"".join(places.to_pylist()), np.int32).reshape(-1, 2)
                    c = np.repeat(found.field("c").to_numpy(), pc.binary_length(places).to_numpy() // 8)
                    order = np.lexsort((pairs[:, 1], c))  # sums in an order that the words' arrival doesn't change
                    pairs, c = pairs[order], c[order]
                    logs += np.bincount(pairs[:, 0], pairs[:, 1] * np.log10(c + 0.5), n)
                    known += np.bincount(pairs[:, 0], pairs[:, 1] * (c > 0), n).astype(np.int64)
                columns = (listed["doc_ids"], listed["held"], n_tokens, known, [total] * n, logs - n_tokens * room, listed["scores"])
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(columns, _SCORES)], schema=_SCORES)

    per_block = rare.join(sums, "word").groupBy("block").agg(F.collect_list(F.struct("places", "c")).alias("rare"))
    return _scored(table, occurrences, model).join(per_block, "block", "left").mapInArrow(
        tidied(finish), "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    )
