"""The corpus pipeline: stages over documents, each written as Parquet and read again as the next one's input."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ferrytext.llm import toxicity
from ferrytext.llm.bpe import encode_decode
from ferrytext.llm.common import documents, stored
from ferrytext.llm.decontaminate import contamination
from ferrytext.llm.simhash import near_duplicates
from ferrytext.llm.suffix_dedup import PASSAGE, without_repeats


#: The stages share the executors' memory one after the other, so texts go to Python in batches of so many bytes, unless
#: the session has a bound of its own.
BATCH = ("spark.sql.execution.arrow.maxBytesPerBatch", str(4 << 20))


def small_batches(spark: SparkSession) -> None:
    """Sets BATCH where it is unset. It stays set: a stage's plan runs after the stage has returned."""
    if spark.conf.get(BATCH[0], None) is None:
        spark.conf.set(*BATCH)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the passage search doesn't predict as toxic; it learns from their labels. Null and empty texts stay,
    repeated rows stay or go together, an empty table stays empty."""
    small_batches(spark)
    return toxicity.without_toxic(docs, toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def keyed(docs: DataFrame) -> DataFrame:
    """``row``, a struct of all columns of ``docs``, whatever their names, and ``nth``, a number of its own for every row, as ids
    may be null or repeated; stored, so that it stays."""
    return stored(docs.select(F.struct("*").alias("row"), F.monotonically_increasing_id().alias("nth")), "rows")


def numbered_texts(rows: DataFrame) -> DataFrame:
    return rows.select(F.col("nth").alias("doc_id"), F.col("row.text").alias("text"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked fingerprints one row: that with the smallest id, of those with the same id the one with
    the fewest characters, then by hash of the id, text, language and source; a row without an id stays only where no row of its
    group has one. Rows of one id whose texts aren't linked are in groups of their own. Null and empty texts are linked to each
    other like any texts; an empty table stays empty; other columns, of any name, stay as they are."""
    small_batches(spark)
    rows = keyed(docs)
    found = near_duplicates(numbered_texts(rows))
    of_row = lambda *names: [F.col(f"row.{n}") for n in names]
    rank = F.struct(F.col("row.doc_id").isNull(), *of_row("doc_id", "n_chars"), F.xxhash64(*of_row("doc_id", "text", "lang", "source")), "nth")
    ranks = rows.select("nth", rank.alias("rank"))
    groups = found.select(F.col("doc_id").alias("nth"), "component_id").join(ranks, "nth").groupBy("component_id")
    first = groups.agg(F.min("rank").alias("rank")).select("rank.nth")
    return rows.join(first, "nth", "left_semi").select("row.*")


def drop_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the bytes of strings of PASSAGE bytes, about fifty words, that occur again anywhere; ``n_chars`` follows
    the text. All rows stay; null texts stay null, short and empty ones as they are, and texts of repeated rows lose all that
    repeats."""
    small_batches(spark)
    return without_repeats(docs, PASSAGE).withColumn("n_chars", F.coalesce(F.length("text").cast("long"), F.col("n_chars")))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which less than a twentieth of the words lies in benchmark windows; each row by its own text. Null and
    empty texts stay, as do all where the benchmark is empty; an empty table stays empty; other columns, of any name, stay as
    they are."""
    small_batches(spark)
    rows = keyed(docs)
    found = contamination(numbered_texts(rows), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    bad = found.where("contaminated").select(F.col("doc_id").alias("nth"))
    return rows.join(bad, "nth", "left_anti").select("row.*")


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text, with the digests of the ids and of what they decode to; null and empty texts have none. Repeated
    rows are coded each, texts of any length whole, an empty table stays empty."""
    small_batches(spark)
    return encode_decode(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, with_ids=True)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("repeats", drop_repeats),
    ("decontamination", drop_contaminated),
    ("bpe", encode),
]

#: Learned labels and Hamming links are beyond SQL: the tests hold the stages against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order over the documents of ``sf_dir``."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
