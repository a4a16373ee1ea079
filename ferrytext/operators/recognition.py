"""Recognition as a pluggable function over pages."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

REGIONS = "page_id long, region_id int, x0 int, y0 int, x1 int, y1 int, confidence double, text string"
_TYPES = (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.float64(), pa.string())
Recognizer = Callable[[dict], list[tuple]]


def recognize_pages(pages: DataFrame, recognize: Recognizer) -> DataFrame:
    """A row per region that ``recognize`` finds on a page: it gets the page's row as a dict and returns (x0, y0, x1, y1,
    confidence, text) tuples, whose order gives region_id from 1. A function with an attribute ``at_once`` is given batches of
    pages by that, and returns the index of each region's page and the six columns. No shuffle."""
    at_once, names = getattr(recognize, "at_once", None), [x.split()[0] for x in REGIONS.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if at_once:
                page, columns = at_once(batch)
                nth = np.arange(len(page)) - np.searchsorted(page, page) + 1
                arrays = [batch.column("page_id").take(pa.array(page)), pa.array(nth), *columns]
                yield pa.RecordBatch.from_arrays([a.cast(t) for a, t in zip(arrays, _TYPES)], names)
                continue
            rows = [(page["page_id"], n, *region) for page in batch.to_pylist() for n, region in enumerate(recognize(page), 1)]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(_TYPES)], names)

    return pages.mapInArrow(run, REGIONS)


def from_table(page: dict) -> list[tuple]:
    """A recogniser for pages that carry their regions."""
    return [tuple(r[c] for c in ("x0", "y0", "x1", "y1", "confidence", "text")) for r in page["regions"]]


def _table_at_once(batch: pa.RecordBatch) -> tuple[np.ndarray, list[pa.Array]]:
    found = batch.column("regions")
    page = np.repeat(np.arange(len(found)), found.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
    regions = found.flatten()
    return page, [regions.field(c) for c in ("x0", "y0", "x1", "y1", "confidence", "text")]


from_table.at_once = _table_at_once
