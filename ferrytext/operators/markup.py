"""Block elements of markup: found, taken out as units and put back translated."""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ferrytext.functions.text import BLOCK, JAPANESE, escape_text

_BLOCK = re.compile(BLOCK)
_NESTED = re.compile(r"(?i)<(?:p|h[1-6]|blockquote)\b")
_MEDIA = re.compile(r"(?i)<(?:img|image|svg)\b")
_RUBY = re.compile(r"(?is)<rt\b[^>]*>.*?</rt>")
_TAG = re.compile(r"(?s)<[^>]+>")


def flat_blocks(rows: DataFrame, key: str, column: str) -> DataFrame:
    """(key, nth, tag, block, inner) of blocks that hold no other block: built-in expressions only."""
    found = F.regexp_extract_all(column, F.lit(BLOCK), 0)
    out = rows.select(key, F.posexplode(found).alias("nth", "block"))
    part = lambda i: F.regexp_extract("block", r"(?s)\A" + BLOCK + r"\z", i)
    return out.select(key, "nth", F.lower(part(1)).alias("tag"), "block", part(2).alias("inner"))


def _text(inner: str) -> str:
    return html.unescape(_TAG.sub("", _RUBY.sub("", inner))).strip()


def _spans(content: str, start: int, end: int, keep: re.Pattern) -> Iterator[tuple[int, int, str, str]]:
    for m in _BLOCK.finditer(content, start, end):
        if _MEDIA.search(m[2]):
            continue  # a block with a picture stays as it is, whatever it holds
        if _NESTED.search(m[2]):
            yield from _spans(content, m.start(2), m.end(2), keep)
        elif (text := _text(m[2])) and keep.search(text):
            yield m.start(), m.end(), m[1].lower(), text


def block_spans(rows: DataFrame, key: str, column: str, keep: str = JAPANESE.replace(r"\x{", "\\u").replace("}", "")) -> DataFrame:
    """(key, nth, start, end, tag, text) of the innermost blocks without pictures whose text matches ``keep``; offsets
    are in characters."""
    kind = dict(rows.dtypes)[key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pattern = re.compile(keep)
        for batch in batches:
            out = [
                (k, nth, *span)
                for k, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())
                for nth, span in enumerate(_spans(content or "", 0, len(content or ""), pattern))
            ]
            types = (batch.schema.field(0).type, pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], t) for i, t in enumerate(types)], [key, "nth", "start", "end", "tag", "text"])

    return rows.select(key, column).mapInArrow(run, f"{key} {kind}, nth int, start int, end int, tag string, text string")


def rebuild_markup(rows: DataFrame, spans: DataFrame, key: str, column: str) -> DataFrame:
    """``rows`` with the insides of spans (key, start, end, translation) replaced by the escaped translation; tags and all
    other text stay."""
    edits = spans.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("start", "end", escape_text(F.col("translation")).alias("t")))).alias("__e"))
    content, n = F.col(column), F.length(column)
    block = lambda e: F.substring(content, e["start"] + 1, e["end"] - e["start"])
    head = lambda e: F.regexp_extract(block(e), r"\A[^>]*>", 0)
    tail = lambda e: F.regexp_extract(block(e), r"</[^<>]*>\z", 0)
    piece = lambda e, i: F.concat(
        F.substring(content, F.coalesce(F.get("__e", i - 1)["end"], F.lit(0)) + 1, e["start"] - F.coalesce(F.get("__e", i - 1)["end"], F.lit(0))), head(e), e["t"], tail(e)
    )
    last = F.element_at("__e", -1)["end"]
    rebuilt = F.concat(F.array_join(F.transform("__e", piece), ""), F.substring(content, last + 1, n))
    return rows.join(edits, key, "left").withColumn(column, F.when(F.col("__e").isNull(), content).otherwise(rebuilt)).drop("__e")
