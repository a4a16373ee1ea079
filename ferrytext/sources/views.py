"""Inputs of the registered queries: views derived from the given tables, in Spark and (``*_SQL``) in DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def kana_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents; those of even ids with vowels turned into kana."""
    text = F.when(F.col("doc_id") % 2 == 0, F.translate("text", "aeiou.", "あいうえお。")).otherwise(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", text.alias("text"))


KANA_DOCS_SQL = "SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN translate(text, 'aeiou.', 'あいうえお。') ELSE text END AS text FROM documents"


def members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Archive members from pages."""
    name = F.regexp_replace(F.regexp_replace("url", r"\Ahttps?://", ""), r"\?.*\z", "")
    return table(spark, sf_dir, "pages").select(
        (F.col("page_id") % 20).cast("int").alias("archive_id"), F.col("page_id").alias("ordinal"), name.alias("name"), F.length("html").cast("long").alias("size")
    )


MEMBERS_SQL = r"SELECT (page_id % 20)::INT AS archive_id, page_id AS ordinal, regexp_replace(regexp_replace(url, '\Ahttps?://', ''), '\?.*\z', '') AS name, length(html)::BIGINT AS size FROM pages"

EXTENSIONS = (".txt", ".md", ".jpg", ".PNG", ".epub", ".db")


def job_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of jobs from documents."""
    ext = F.element_at(F.array(*map(F.lit, EXTENSIONS)), (F.col("doc_id") % 6 + 1).cast("int"))
    plain = F.concat("source", F.lit("/"), F.col("doc_id").cast("string"), ext)
    name = F.when(F.col("doc_id") % 6 == 5, F.concat("source", F.lit("/Thumbs.db"))).otherwise(plain)
    return table(spark, sf_dir, "documents").select((F.col("doc_id") % 50).cast("int").alias("archive_id"), "doc_id", name.alias("name"))


JOB_FILES_SQL = (
    "SELECT (doc_id % 50)::INT AS archive_id, doc_id, CASE WHEN doc_id % 6 = 5 THEN source || '/Thumbs.db' ELSE source || '/' || doc_id ||"
    f" (['{chr(39).join(EXTENSIONS).replace(chr(39), chr(39) + ', ' + chr(39))}'])[doc_id % 6 + 1] END AS name FROM documents"
)


def boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text boxes on pages from lineitem."""
    lines = table(spark, sf_dir, "lineitem")
    nth = F.row_number().over(Window.partitionBy("l_orderkey").orderBy(*lines.columns))
    x0 = ((F.col("l_partkey") * 7 + F.col("l_linenumber") * 13) % 160).cast("int")
    y0 = ((F.col("l_suppkey") * 5 + F.col("l_linenumber") * 31) % 220).cast("int")
    w, h = (6 + F.col("l_partkey") % 70).cast("int"), (6 + F.col("l_quantity").cast("int")).cast("int")
    return lines.withColumn("region_id", nth).select(
        F.col("l_orderkey").alias("page_id"), "region_id", x0.alias("x0"), y0.alias("y0"), (x0 + w).alias("x1"), (y0 + h).alias("y1"),
        (F.col("l_discount") * 10).cast("double").alias("confidence"), F.concat(F.lit("あ"), F.col("region_id").cast("string")).alias("text"),
    )


BOXES_SQL = """SELECT page_id, region_id::INT AS region_id, x0::INT AS x0, y0::INT AS y0, (x0 + w)::INT AS x1, (y0 + h)::INT AS y1, confidence,
  'あ' || region_id AS text FROM (SELECT l_orderkey AS page_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate) AS region_id,
  (l_partkey * 7 + l_linenumber * 13) % 160 AS x0, (l_suppkey * 5 + l_linenumber * 31) % 220 AS y0, 6 + l_partkey % 70 AS w,
  6 + floor(l_quantity)::INT AS h, (l_discount * 10)::DOUBLE AS confidence FROM lineitem)"""

PAGE_WIDTH, PAGE_HEIGHT = 240, 290
STATUS = {"signup": "queued", "view": "running", "click": "running", "purchase": "completed", "error": "failed"}
