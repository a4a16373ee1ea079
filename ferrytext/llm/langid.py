"""Language identification by cross-parsing entropy.

Per language a suffix automaton is built over a bounded sample of labelled text. A text is cut greedily into longest
matches (phrases) against each automaton; the language that needs the fewest phrases, normalised by the logarithm of
the sample's length, wins. Symbols are the UTF-8 bytes of lower-case letters, and a blank for anything else, so no
letter of any alphabet is merged with another. All texts of a batch are parsed in step, as array operations, each from its
first symbol to its last. Work is per document: no shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ferrytext.llm.common import fold, slices, text_rows, tidied, worker_copy

#: The symbol of a byte that no sample has; all others are numbered from 1.
OTHER = 0
#: Texts of about so many bytes are parsed together.
SLICE_BYTES = 8 << 20


class SuffixAutomaton:
    """Of a list of symbols; ``next[state]`` maps symbols to states; state 0 is the root."""

    def __init__(self, symbols: list[int]) -> None:
        self.next: list[dict[int, int]] = [{}]
        link, length, last = [-1], [0], 0
        for c in symbols:
            now = len(self.next)
            self.next.append({})
            length.append(length[last] + 1)
            link.append(0)
            p = last
            while p >= 0 and c not in self.next[p]:
                self.next[p][c] = now
                p = link[p]
            if p >= 0:
                q = self.next[p][c]
                if length[p] + 1 == length[q]:
                    link[now] = q
                else:
                    copy = len(self.next)
                    self.next.append(dict(self.next[q]))
                    length.append(length[p] + 1)
                    link.append(link[q])
                    link[q] = link[now] = copy
                    while p >= 0 and self.next[p].get(c) == q:
                        self.next[p][c] = copy
                        p = link[p]
            last = now


class Parser:
    """Counts phrases of many texts against all languages. ``samples``: (language, text) pairs."""

    def __init__(self, samples: tuple[tuple[str, str], ...]) -> None:
        #: code points of letters to those of their lower-case forms, of all else to blanks
        self.lower = np.full(0x110000, 32, np.uint32)
        for cp in range(0x110000):
            c = chr(cp)
            if c.isalpha():
                self.lower[cp] = ord(low) if len(low := c.lower()) == 1 else cp
        coded = [self.data(text)[0] for _, text in samples]
        used = sorted(set().union(*coded))
        self.symbol = np.full(256, OTHER, np.uint8)
        self.symbol[used] = np.arange(1, len(used) + 1)
        width, tables, self.roots, self.sizes, base = len(used) + 1, [], [], [], 0
        for data in coded:
            symbols = self.symbol[np.frombuffer(data, np.uint8)].tolist()
            automaton = SuffixAutomaton(symbols)
            dead = len(automaton.next)  # after a symbol that the sample lacks, which is a phrase of its own
            table = np.full((dead + 1, width), -1, np.int64)
            for state, go in enumerate(automaton.next):
                for symbol, to in go.items():
                    table[state, symbol] = to
            # where a match ends, the next phrase starts with this symbol: ~target marks the end of a phrase
            fresh = np.where(table[0] < 0, dead, table[0])
            table = np.where(table < 0, ~((base + fresh) * width), (base + table) * width)
            table[0] = (base + fresh) * width  # only a text's first symbol is read here
            tables.append(table)
            self.roots.append(base * width)
            self.sizes.append(max(2, len(symbols)))
            base += len(table)
        kind = np.int32 if base * width < 1 << 31 else np.int64
        self.table = np.concatenate(tables).astype(kind).ravel() if tables else np.zeros(0, kind)

    def data(self, text: str) -> tuple[bytes, bool]:
        """The bytes that are parsed, and whether the text has a letter."""
        points = self.lower[np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)]
        return points.tobytes().decode("utf-32-le").encode(), bool((points != 32).any())

    def code(self, data: bytes) -> np.ndarray:
        return self.symbol[np.frombuffer(data, np.uint8)]

    def phrases(self, texts: list[np.ndarray]) -> np.ndarray:
        """Phrases of each coded text (rows) in each language (columns)."""
        sizes = np.array([len(t) for t in texts], np.int64)
        order = np.argsort(-sizes, kind="stable")
        flat = np.concatenate([texts[i] for i in order]) if len(texts) else np.zeros(0, np.uint8)
        starts = np.cumsum(sizes[order]) - sizes[order]
        kind = self.table.dtype
        state = np.tile(np.array(self.roots, kind), (len(texts), 1))
        ended = np.zeros(state.shape, np.int64)
        at, sign = 0, 8 * kind.itemsize - 1
        for end in np.unique(sizes):  # so many symbols the texts that are left have at least
            n = int((sizes >= end).sum())
            mine, now, count = starts[:n], state[:n], ended[:n]
            for t in range(at, int(end)):
                to = self.table.take(now + flat.take(mine + t)[:, None], mode="clip")
                over = to >> sign
                count -= over
                np.bitwise_xor(to, over, out=now)
            at = int(end)
        ended += (sizes[order] > 0)[:, None]  # the last phrase
        out = np.empty_like(ended)
        out[order] = ended
        return out


def training_sample(docs: DataFrame, *, rows_per_language: int = 64, chars_per_row: int = 312) -> tuple[tuple[str, str], ...]:
    """(language, text) pairs from folds 0 and 2 of 3 with a language and a text: of each language the rows of the lowest
    id hashes, at most ``rows_per_language``, and of each a piece of at most ``chars_per_row`` characters from a place chosen
    by hash. This bounds the automata; each task keeps no more rows. Rows without a letter, a language or a text are
    passed over; of rows that tie any may be taken; without labelled rows the result is empty."""
    order = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")
    room = F.greatest(F.lit(0), F.length("text") - chars_per_row)
    piece = F.substring(F.col("text"), (F.lit(1) + F.pmod(F.xxhash64("doc_id", F.lit(1)), room + 1)).cast("int"), F.lit(chars_per_row))
    rows = (
        docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["lang"].cast("string").alias("lang"), docs["text"].alias("text"))
        .where(F.col("lang").isNotNull() & (fold(F.col("doc_id"), 3) != 1) & F.col("text").rlike(r"\p{L}"))
        .select("lang", "doc_id", piece.alias("text"))
        .withColumn("nth", F.row_number().over(order))
        .where(F.col("nth") <= rows_per_language)
        .collect()
    )
    out: dict[str, list[str]] = {}
    for r in sorted(rows, key=lambda r: (r["lang"], r["nth"])):
        out.setdefault(r["lang"], []).append(r["text"])
    return tuple((lang, "\n".join(texts)) for lang, texts in out.items())


def identify(docs: DataFrame, samples: tuple[tuple[str, str], ...]) -> DataFrame:
    """doc_id, lang_pred, score (1 - best / second of the normalised phrase counts; 1 if one language is known) and
    phrases per symbol of the best language.

    ``und`` with score 0 for null and empty texts, texts without a letter and where no language is known. Ties go to the
    language that sorts first. Texts are parsed whole; repeated rows give repeated rows; an empty table gives an empty
    result; columns other than doc_id and text are ignored.
    """
    samples = tuple(sorted(samples))
    shipped = docs.sparkSession.sparkContext.broadcast(samples)
    schema = pa.schema([("doc_id", pa.int64()), ("lang_pred", pa.string()), ("score", pa.float64()), ("phrases_per_symbol", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parser: Parser = worker_copy(Parser, shipped.value)
        names = [x for x, _ in shipped.value]
        scale = np.log2(parser.sizes)
        for batch in slices(batches, SLICE_BYTES):
            coded, letters = [], []
            for text in batch.column("text"):
                data, has_letter = parser.data(text.as_buffer().to_pybytes().decode("utf-8", "replace"))
                letters.append(has_letter)
                coded.append(parser.code(data))
            langs, scores, rates = ["und"] * len(coded), [0.0] * len(coded), [None] * len(coded)
            if names:
                cost = parser.phrases(coded) * scale
                best = cost.argmin(axis=1)
                lead = np.sort(cost, axis=1)
                for i, known in enumerate(letters):
                    if known:
                        langs[i] = names[best[i]]
                        scores[i] = float(1 - lead[i, 0] / lead[i, 1]) if len(names) > 1 else 1.0
                        rates[i] = float(lead[i, 0] / scale[best[i]] / len(coded[i]))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(langs), pa.array(scores, pa.float64()), pa.array(rates, pa.float64())], schema=schema
            )

    return text_rows(docs).mapInArrow(tidied(run), "doc_id bigint, lang_pred string, score double, phrases_per_symbol double")
