"""Benchmark decontamination with a distributed positional inverted index.

Training texts are cut into blocks of bounded size; per block and term the index holds the sorted word positions
(postings). The index is a table of its own: one row per block and term. A search takes the benchmark in chunks
of bounded size, keeps the postings of its terms, brings each block's postings together and intersects
offset-adjusted lists from the rarest term on. A frequent term is spread over as many rows as there are blocks,
so no group outgrows a block.
"""

from __future__ import annotations

import hashlib
import itertools
from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast, TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ferrytext.llm.common import ALNUM_TABLE, slices, stored, text_rows, tidied

WINDOW = 13
BLOCK_BYTES = 6 << 20
#: Bound of what is broadcast at once: UTF-8 bytes of benchmark text. A single item may be larger.
CHUNK_BYTES = 8 << 20

INDEX_SCHEMA = "block bigint, term binary, positions binary, doc_ids array<bigint>, starts array<bigint>"
_INDEX = pa.schema(
    [
        ("block", pa.int64()),
        ("term", pa.binary()),
        ("positions", pa.binary()),
        ("doc_ids", pa.list_(pa.int64())),
        ("starts", pa.list_(pa.int64())),
    ]
)


def build_index(docs: DataFrame, vocabulary: DataFrame | None = None, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Rows (block, term, positions) with positions as ascending int32 in the block, and per block one row with a
    null term that lists its documents: ids, and the first position of each plus the end of the last. Texts are a
    position apart, so no run of positions crosses documents.

    ``vocabulary``: a table whose first column has the only terms wanted (binary); without it all are indexed. A
    vocabulary over CHUNK_BYTES isn't shipped to the tasks but joined.
    """
    wanted = None
    joined = None
    if vocabulary is not None:
        terms = vocabulary.select(vocabulary[0].alias("term")).distinct()
        size = terms.agg(F.sum(F.octet_length("term") + 16)).first()[0] or 0
        if size <= CHUNK_BYTES:
            wanted = docs.sparkSession.sparkContext.broadcast({bytes(r[0]): i for i, r in enumerate(terms.collect())})
        else:
            joined = terms

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers = itertools.count(TaskContext.get().partitionId() << 32)
        for batch in slices(batches, block_bytes):
            known = wanted.value if wanted else defaultdict(itertools.count().__next__)
            get = (lambda w: known.get(w, -1)) if wanted else known.__getitem__
            coded, starts, at = [], [], 0
            for text in batch.column("text").to_pylist():
                words = text.translate(ALNUM_TABLE).split()
                starts.append(at)
                coded.extend(map(get, words))
                coded.append(-1)
                at += len(words) + 1
            starts.append(at)
            ids = np.array(coded, np.int32)
            order = np.argsort(ids, kind="stable").astype(np.int32)
            order = order[np.count_nonzero(ids < 0) :]
            runs = np.flatnonzero(np.diff(ids[order], prepend=-1))
            names = list(known)
            lists = np.split(order, runs[1:]) if len(runs) else []
            block, n = next(numbers), len(lists)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([block] * (n + 1), pa.int64()),
                    pa.array([names[i] for i in ids[order[runs]]] + [None], pa.binary()),
                    pa.array([x.tobytes() for x in lists] + [None], pa.binary()),
                    pa.array([None] * n + [batch.column("doc_id").to_pylist()], _INDEX.field(3).type),
                    pa.array([None] * n + [starts], _INDEX.field(4).type),
                ],
                schema=_INDEX,
            )

    index = text_rows(docs).mapInArrow(tidied(run), INDEX_SCHEMA)
    if joined is not None:
        index = stored(index, "index")  # block numbers come from partitions, so it is made once
        kept = index.where("term is not null").join(joined.hint("merge"), "term", "left_semi")  # sized before its words were cut
        index = kept.select(*_INDEX.names).unionByName(index.where("term is null"))
    return index


def benchmark_words(items: DataFrame) -> DataFrame:
    """item_id (text) and words (array of binary) of every item that has words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1 << 20):
            words = [t.translate(ALNUM_TABLE).split() for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("item_id"), pa.array(words, pa.list_(pa.binary()))], ["item_id", "words"])

    rows = items.select(
        items["item_id"].cast("string").alias("item_id"), F.coalesce(items["text"], F.lit("")).cast("binary").alias("text")
    )
    return rows.mapInArrow(run, "item_id string, words array<binary>").where("size(words) > 0")


class Searcher:
    """Phrases of a chunk of benchmark items, ready to be looked up in blocks."""

    def __init__(self, items: list[tuple[str | None, list[bytes]]], window: int = WINDOW) -> None:
        phrases: dict[tuple[bytes, ...], set[int]] = defaultdict(set)
        self.items = [item_id for item_id, _ in items]
        for i, (_, words) in enumerate(items):
            n = min(window, len(words))
            for a in range(len(words) - n + 1):
                phrases[tuple(words[a : a + n])].add(i)
        self.phrases = list(phrases.items())
        self.words = [sorted(set(words)) for _, words in items]
        self.spans = [len(words) for _, words in items]

    def places(self, postings: dict[bytes, np.ndarray]) -> Iterator[tuple[np.ndarray, int, set[int]]]:
        """(positions, length, items) of every phrase that occurs."""
        for phrase, owners in self.phrases:
            lists = [postings.get(w) for w in phrase]
            if any(x is None for x in lists):
                continue
            order = sorted(range(len(phrase)), key=lambda k: len(lists[k]))
            at = lists[order[0]] - order[0]
            for k in order[1:]:
                at = at[_member(at + k, lists[k])]
                if not len(at):
                    break
            else:
                yield at, len(phrase), owners

    def near(self, postings: dict[bytes, np.ndarray], starts: np.ndarray) -> Iterator[tuple[int, int]]:
        """(document, item) where as many words in a row as the item has, all of the document, hold each of the item's words, in
        any order. Candidates are places of the rarest word that have all others near enough in their document."""
        for i, words in enumerate(self.words):
            lists = [postings.get(w) for w in words]
            if any(x is None for x in lists):
                continue
            lists.sort(key=len)
            at, span = lists[0].astype(np.int64), self.spans[i]
            doc = np.searchsorted(starts, at, "right") - 1
            low, high = np.maximum(starts[doc], at - span + 1), np.minimum(starts[doc + 1] - 1, at + span)
            for other in lists[1:]:
                j = np.searchsorted(other, low)
                ok = (j < len(other)) & (other[np.minimum(j, len(other) - 1)] < high)
                at, doc, low, high = at[ok], doc[ok], low[ok], high[ok]
                if not len(at):
                    break
            found = -1
            for p, d, a, b in zip(at.tolist(), doc.tolist(), low.tolist(), high.tolist()):
                if d != found and _together(lists, np.arange(a, p + 1), span, b):
                    found = d
                    yield d, i


def _together(lists: list[np.ndarray], first: np.ndarray, span: int, end: int) -> bool:
    """Whether from one of the places ``first`` on, ``span`` places hold one of each list, all before ``end``."""
    last = np.minimum(first + span, end)
    ok = np.ones(len(first), bool)
    for x in lists:
        j = np.searchsorted(x, first)
        ok &= (j < len(x)) & (x[np.minimum(j, len(x) - 1)] < last)
    return bool(ok.any())


def _member(values: np.ndarray, within: np.ndarray) -> np.ndarray:
    j = np.searchsorted(within, values)
    return (j < len(within)) & (within[np.minimum(j, len(within) - 1)] == values)


FOUND_SCHEMA = "doc_id bigint, n_words bigint, block bigint, nth bigint, hits array<struct<start:bigint,end:bigint>>, items array<string>, near array<string>"
_FOUND = pa.schema(
    [
        ("doc_id", pa.int64()),
        ("n_words", pa.int64()),
        ("block", pa.int64()),
        ("nth", pa.int64()),
        ("hits", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
        ("items", pa.list_(pa.string())),
        ("near", pa.list_(pa.string())),
    ]
)


def _search_block(table: pa.Table, searcher: Searcher, proximity: bool) -> pa.Table:
    listing, postings = None, {}
    for block, term, positions, doc_ids, starts in zip(*(table.column(c).to_pylist() for c in _INDEX.names)):
        if term is None:
            listing = block, doc_ids, np.array(starts)
        else:
            postings[term] = np.frombuffer(positions, np.int32)
    block, doc_ids, starts = listing
    edge = np.zeros(starts[-1] + 1, np.int32)
    items, near = defaultdict(set), defaultdict(set)
    for at, length, owners in searcher.places(postings):
        np.add.at(edge, at, 1)
        np.add.at(edge, at + length, -1)
        for d in np.unique(np.searchsorted(starts, at, "right") - 1).tolist():
            items[d] |= owners
    for d, i in searcher.near(postings, starts) if proximity else ():
        near[d].add(i)
    change = np.diff(np.cumsum(edge) > 0, prepend=False, append=False)
    bounds = np.flatnonzero(change).reshape(-1, 2)
    hits = defaultdict(list)
    for (a, b), d in zip(bounds.tolist(), (np.searchsorted(starts, bounds[:, 0], "right") - 1).tolist()):
        hits[d].append({"start": a - int(starts[d]), "end": b - int(starts[d])})
    n = range(len(doc_ids))
    named = lambda found: [[searcher.items[i] for i in sorted(found[d])] if d in found else [] for d in n]
    return pa.Table.from_arrays(
        [
            pa.array(doc_ids, pa.int64()),
            pa.array((np.diff(starts) - 1).tolist(), pa.int64()),
            pa.array([block] * len(doc_ids), pa.int64()),
            pa.array(n, pa.int64()),
            pa.array([hits.get(d, []) for d in n], _FOUND.field(4).type),
            pa.array(named(items), _FOUND.field(5).type),
            pa.array(named(near), _FOUND.field(6).type),
        ],
        schema=_FOUND,
    )


def _block_search(searcher: Broadcast, proximity: bool) -> Callable[[pa.Table], pa.Table]:
    def run(table: pa.Table) -> pa.Table:
        return _search_block(table, searcher.value, proximity)

    return run


def search(
    index: DataFrame, items: DataFrame, *, window: int = WINDOW, proximity: bool = True
) -> tuple[DataFrame, int]:
    """For every document of the index and chunk of the benchmark: the hit runs of words, the items of which a
    window occurs and, with ``proximity``, the items whose words all stand within as many words as the item has.

    ``items``: item_id and words. A benchmark over CHUNK_BYTES is taken in chunks by hash of the item; the rows of
    one document (same block and nth) from several chunks are to be merged, as ``contamination`` does. Returns the
    rows and the number of chunks.
    """
    spark = index.sparkSession
    sized = items.withColumn("size", F.aggregate("words", F.lit(0).cast("long"), lambda n, w: n + F.octet_length(w) + 1))
    chunks = -(-(sized.agg(F.sum("size")).first()[0] or 0) // CHUNK_BYTES)
    if chunks > 1:
        index = stored(index, "index")
    out = None
    for chunk in range(max(1, chunks)):
        mine = items.where(F.crc32(F.coalesce("item_id", F.lit("")).cast("binary")) % max(1, chunks) == chunk)
        rows = [(r["item_id"], [bytes(w) for w in r["words"]]) for r in mine.collect()]
        searcher = spark.sparkContext.broadcast(Searcher(rows, window))
        found = index.groupBy("block").applyInArrow(_block_search(searcher, proximity), FOUND_SCHEMA)
        out = found if out is None else out.unionByName(found)
    return out, max(1, chunks)


def contamination(docs: DataFrame, benchmark: DataFrame, *, proximity: bool = False) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated per document, by windows of 13 words; with ``proximity``
    also n_near, the items whose words all stand within as many words as the item has.

    Null and empty texts have no words and are clean; an item without words is never found; a null item_id counts
    as an item without a name, and items of one name as one; repeated rows give repeated rows; an empty table of documents
    gives an empty result and an empty benchmark finds nothing; columns other than the id and text are ignored. A text larger
    than a block is a block of its own.
    """
    items = benchmark_words(benchmark)
    index = build_index(docs, items.select(F.explode("words")))
    found, chunks = search(index, items, proximity=proximity)
    if chunks > 1:
        found = found.groupBy("block", "nth").agg(
            F.first("doc_id").alias("doc_id"),
            F.first("n_words").alias("n_words"),
            *(F.flatten(F.collect_list(c)).alias(c) for c in ("hits", "items", "near")),
        )
    zero, names = F.lit(0).cast("long"), lambda c: F.array_distinct(F.transform(c, lambda x: F.coalesce(x, F.lit(""))))
    more = lambda so_far, h: F.struct(  # noqa: E731  runs of several chunks may overlap
        (so_far["n"] + F.greatest(zero, h["end"] - F.greatest(so_far["end"], h["start"]))).alias("n"),
        F.greatest(so_far["end"], h["end"]).alias("end"),
    )
    n_hit = F.aggregate(F.array_sort("hits"), F.struct(zero.alias("n"), zero.alias("end")), more)["n"]
    rows = found.select("doc_id", "n_words", n_hit.alias("n_hit"), names("items").alias("items"), names("near").alias("near"))
    return rows.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("items"), ",").cast("binary"), 256).alias("items_sha256"),
        ((F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"),
        *([F.size("near").cast("long").alias("n_near")] if proximity else []),
    )


def oracle(window: int = WINDOW) -> str:
    """The rows of ``contamination`` with ``proximity`` in DuckDB SQL."""
    words = lambda text: (
        f"regexp_extract_all(translate(coalesce({text}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),"
        " '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
    )
    return f"""
    WITH d AS (SELECT row_number() OVER () AS rid, doc_id, {words("text")} AS w FROM documents),
    b AS (SELECT item_id::VARCHAR AS item, {words("text")} AS w FROM benchmark),
    bl AS (SELECT item, w, least({window}, len(w)) AS n FROM b WHERE len(w) > 0),
    phrases AS (
      SELECT DISTINCT item, n, array_to_string(w[i : i + n - 1], ' ') AS phrase
      FROM (SELECT item, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM bl)),
    places AS (
      SELECT rid, i, n, array_to_string(w[i : i + n - 1], ' ') AS phrase
      FROM (SELECT rid, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM bl))),
    found AS (SELECT rid, i, n, item FROM places JOIN phrases USING (n, phrase)),
    hit AS (SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT rid, unnest(range(i, i + n)) AS p FROM found) GROUP BY rid),
    its AS (SELECT rid, list_sort(list(DISTINCT item)) AS items FROM found GROUP BY rid),
    pairs AS (SELECT rid, item, d.w AS w, need, n FROM d JOIN (SELECT item, list_distinct(w) AS need, len(w) AS n FROM bl) ON list_has_all(d.w, need)),
    spots AS (
      SELECT rid, item, n, need, i, word FROM (SELECT rid, item, n, need, unnest(w) AS word, unnest(range(len(w))) AS i FROM pairs)
      WHERE list_contains(need, word)),
    runs AS (
      SELECT a.rid, a.item FROM spots a JOIN spots b ON a.rid = b.rid AND a.item IS NOT DISTINCT FROM b.item AND a.need = b.need
        AND a.n = b.n AND b.i BETWEEN a.i AND a.i + a.n - 1
      GROUP BY a.rid, a.item, a.need, a.n, a.i HAVING count(DISTINCT b.word) = len(a.need)),
    near AS (SELECT rid, count(DISTINCT coalesce(item, '')) AS n_near FROM runs GROUP BY rid)
    SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit,
      coalesce(len(items), 0)::BIGINT AS n_items, sha256(coalesce(array_to_string(items, ','), '')) AS items_sha256,
      coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated,
      coalesce(n_near, 0)::BIGINT AS n_near
    FROM d LEFT JOIN hit USING (rid) LEFT JOIN its USING (rid) LEFT JOIN near USING (rid)"""
