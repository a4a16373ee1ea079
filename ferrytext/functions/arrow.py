"""A Python function over one column, as Arrow batches; all other columns pass by."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

_TYPES = {"string": pa.string(), "array<string>": pa.list_(pa.string())}


def with_mapped(rows: DataFrame, source: str, target: str, f: Callable, kind: str) -> DataFrame:
    """``rows`` with ``target``: f of every value of ``source`` that isn't null. ``kind`` is string or array<string>."""
    kept = rows if target == source else rows.drop(target)
    others = [c for c in kept.columns if c != target]
    schema = ", ".join(f"`{c}` {kept.schema[c].dataType.simpleString()}" for c in others)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [None if v is None else f(v) for v in batch.column(source).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in others), pa.array(made, _TYPES[kind])], [*others, target])

    return kept.mapInArrow(run, f"{schema}, `{target}` {kind}" if others else f"`{target}` {kind}")
