"""All registered queries of the library proper."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ferrytext.jobs import catalog_files, catalog_ops, catalog_regions, catalog_text
from ferrytext.jobs.localize import localize
from ferrytext.sources.views import kana_docs


def localize_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return localize(kana_docs(spark, sf_dir))


_PARTS = (catalog_text, catalog_ops, catalog_regions, catalog_files)
QUERIES = {"localize_documents": localize_documents} | {k: f for part in _PARTS for k, f in part.QUERIES.items()}
ORACLE_SQL = {
    "localize_documents": f"""WITH {catalog_text.LAYOUT} SELECT doc_id, text, coalesce(segments, 0)::BIGINT AS segments, len(text)::BIGINT AS characters, 'utf-8' AS encoding
    FROM kana LEFT JOIN (SELECT doc_id, count(*) AS segments FROM units GROUP BY doc_id) USING (doc_id)"""
} | {k: sql for part in _PARTS for k, sql in part.ORACLE_SQL.items()}
