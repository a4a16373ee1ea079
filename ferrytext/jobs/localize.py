"""The text job end to end: documents to units, translated, put together again, with a report."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ferrytext.operators import units as U


def localize(docs: DataFrame, provider: str = "echo", max_chars: int = 420) -> DataFrame:
    """(doc_id, text, segments, characters, encoding) of documents (doc_id, text), translated with rolling context."""
    return U.localized(docs, U.translator(provider), max_chars=max_chars).withColumn("encoding", F.lit("utf-8"))
