"""Fill-in-the-middle transformation: texts cut at two chosen boundaries and written as prefix, suffix, middle.

A text is decoded to an array of UTF-32 code points. Each code point has a class; where the classes of neighbours differ
there is a boundary between two units. Two ranks among the boundaries, chosen by a hash of the document's id, are the ends of
prefix and middle. The units are code points (every code point counts as another class than the one before), words (white space or
not) or lines. Work is per row: no shuffle, and a retried task makes the same rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ferrytext.llm.common import slices, tidied

#: White space below U+0100, and the wider blanks.
_BLANKS = np.array([*range(9, 14), *range(28, 33), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000], np.uint32)


def _points(codes: np.ndarray) -> np.ndarray:
    return np.arange(len(codes), dtype=np.uint8)  # wraps at 256: neighbours differ all the same


def _words(codes: np.ndarray) -> np.ndarray:
    return np.isin(codes, _BLANKS)


def _lines(codes: np.ndarray) -> np.ndarray:
    return np.cumsum(np.concatenate(([0], codes[:-1] == 10)))


#: Name of a unit: function from code points to classes.
UNITS: dict[str, Callable[[np.ndarray], np.ndarray]] = {"code_point": _points, "word": _words, "line": _lines}


@dataclass(frozen=True)
class Plan:
    """``plain_percent`` of the documents stay as they are, ``spm_percent`` of the others have the suffix first. Each marker's first
    character must occur in no other place of any marker, so that a marker can't begin within a piece and end in the next marker."""

    unit: str = "code_point"
    seed: int = 1
    plain_percent: int = 10
    spm_percent: int = 20
    prefix: str = "<P>"
    suffix: str = "<S>"
    middle: str = "<M>"

    def __post_init__(self) -> None:
        marks = self.markers()
        if self.unit not in UNITS or len(set(marks)) < 3 or any(not m or any(m[0] in other[1:] for other in marks) for m in marks):
            raise ValueError("unknown unit or ambiguous markers")

    def markers(self) -> tuple[str, str, str]:
        return self.prefix, self.suffix, self.middle


def decode(text: bytes) -> np.ndarray:
    """Code points of UTF-8 bytes; a byte that is no part of valid UTF-8 is a code point of its own (U+DC80 to U+DCFF)."""
    return np.frombuffer(text.decode("utf-8", "surrogateescape").encode("utf-32-le", "surrogatepass"), np.uint32)


def encode(codes: np.ndarray) -> bytes:
    return codes.tobytes().decode("utf-32-le", "surrogatepass").encode("utf-8", "surrogateescape")


def boundaries(codes: np.ndarray, unit: str) -> np.ndarray:
    """Places between units, both ends included: one more than there are units."""
    if not len(codes):
        return np.zeros(1, np.int64)
    classes = UNITS[unit](codes)
    return np.concatenate(([0], np.flatnonzero(classes[1:] != classes[:-1]) + 1, [len(codes)]))


def pieces(text: bytes, first: int, second: int, unit: str) -> tuple[bytes, bytes, bytes, int, int, int]:
    """Prefix, middle and suffix of a text, the code points of the first two, and the number of units. ``first`` and ``second`` are any
    numbers from 0; taken modulo the number of boundaries they are the boundaries' ranks, in either order."""
    codes = decode(text)
    places = boundaries(codes, unit)
    low, high = sorted((first % len(places), second % len(places)))
    start, end = int(places[low]), int(places[high])
    return encode(codes[:start]), encode(codes[start:end]), encode(codes[end:]), start, end - start, len(places) - 1


def draws(doc_id: Column, seed: int) -> list[Column]:
    """Four numbers of 32 bits from the SHA-256 of the seed and the decimal id (null: the empty text)."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"), 256)
    return [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)]


def fill_in_middle(docs: DataFrame, plan: Plan = Plan()) -> DataFrame:
    """doc_id, n_units, form, prefix_chars, middle_chars and ``output``, the transformed text, of every row.

    ``form`` is plain (the text as it is), psm (prefix, suffix, middle) or spm (suffix first); lengths are null where it is plain.
    Null and empty texts are plain and empty; a text that holds a marker is plain, so that every output can be taken apart.
    Long texts are taken whole, four bytes a code point, one text after the other. Rows with the same id and text give the same
    rows, a null id draws like the empty text, an empty table gives an empty result; columns other than doc_id and text are left
    behind, whatever their names.
    """
    text = F.coalesce(docs["text"], F.lit(""))
    h1, h2, h3, h4 = draws(docs["doc_id"], plan.seed)
    marked = F.lit(False)
    for mark in plan.markers():
        marked = marked | F.contains(text, F.lit(mark))
    plain = (text == "") | marked | (h3 % 100 >= 100 - plan.plain_percent)
    form = F.when(plain, "plain").when(h4 % 100 < plan.spm_percent, "spm").otherwise("psm")
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), text.cast("binary").alias("text"), h1.alias("h1"), h2.alias("h2"), form.alias("form"))
    unit, (p, s, m) = plan.unit, (x.encode() for x in plan.markers())
    types = [("doc_id", pa.int64()), ("n_units", pa.int64()), ("form", pa.string()), ("prefix_chars", pa.int64()), ("middle_chars", pa.int64()), ("output", pa.binary())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 8 << 20):
            out: list[list] = [[], [], [], []]
            forms = batch.column("form")
            for data, first, second, kind in zip(batch.column("text"), batch.column("h1").to_pylist(), batch.column("h2").to_pylist(), forms.to_pylist(), strict=True):
                data = data.as_py()
                prefix, middle, suffix, before, within, units = pieces(data, first, second, unit)
                if kind == "plain":
                    row = units, None, None, data
                elif kind == "psm":
                    row = units, before, within, b"".join((p, prefix, s, suffix, m, middle))
                else:
                    row = units, before, within, b"".join((s, suffix, p, prefix, m, middle))
                for values, value in zip(out, row, strict=True):
                    values.append(value)
            columns = [batch.column("doc_id"), out[0], forms, *out[1:]]
            yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, t) for c, (_, t) in zip(columns, types, strict=True)], schema=pa.schema(types))

    schema = "doc_id long, n_units long, form string, prefix_chars long, middle_chars long, output binary"
    return rows.mapInArrow(tidied(run), schema).withColumn("output", F.col("output").cast("string"))


def restored(output: Column, form: Column, plan: Plan = Plan()) -> Column:
    """The text that an output of ``fill_in_middle`` was made from, by the markers alone; null where one of the two is."""
    first = F.when(form == "psm", F.lit(plan.prefix)).otherwise(plan.suffix)
    second = F.when(form == "psm", F.lit(plan.suffix)).otherwise(plan.prefix)
    head, rest = F.substring_index(output, plan.middle, 1), F.substring_index(output, plan.middle, -1)
    one, two = F.split_part(head, second, F.lit(1)), F.split_part(head, second, F.lit(2))
    one = F.substring(one, F.length(first) + 1, F.length(one))
    return F.when(form == "plain", output).when(form == "psm", F.concat(one, rest, two)).otherwise(F.concat(two, rest, one))


def oracle(plan: Plan = Plan()) -> str:
    """DuckDB SQL for the query's rows, with units of one code point."""
    p, s, m = plan.markers()
    return f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, ''))::BIGINT AS n, sha256('{plan.seed}:' || coalesce(doc_id::VARCHAR, '')) AS g FROM documents),
 h AS (SELECT *, ('0x' || substr(g, 1, 8))::BIGINT % (n + 1) AS a, ('0x' || substr(g, 9, 8))::BIGINT % (n + 1) AS b,
  CASE WHEN t = '' OR contains(t, '{p}') OR contains(t, '{s}') OR contains(t, '{m}') OR ('0x' || substr(g, 17, 8))::BIGINT % 100 >= {100 - plan.plain_percent} THEN 'plain'
  WHEN ('0x' || substr(g, 25, 8))::BIGINT % 100 < {plan.spm_percent} THEN 'spm' ELSE 'psm' END AS form FROM d),
 c AS (SELECT *, left(t, least(a, b)) AS pre, substr(t, least(a, b) + 1, greatest(a, b) - least(a, b)) AS mid, substr(t, greatest(a, b) + 1) AS suf FROM h)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN least(a, b) END AS prefix_chars, CASE WHEN form <> 'plain' THEN greatest(a, b) - least(a, b) END AS middle_chars,
 sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '{p}' || pre || '{s}' || suf || '{m}' || mid ELSE '{s}' || suf || '{p}' || pre || '{m}' || mid END) AS output_sha256,
 sha256(t) AS restored_sha256 FROM c"""
