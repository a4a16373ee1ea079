"""The queries of this subpackage: each applies one operator to whole tables and derives the digest columns."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ferrytext.llm import decontaminate, fill_in_middle, fingerprints, langid, merkle, sharding, toxicity
from ferrytext.llm.bpe import encode_decode
from ferrytext.llm.common import documents, fold
from ferrytext.llm.license_scan import scan_licenses
from ferrytext.llm.lm_score import score_texts
from ferrytext.llm.media import text_media_digests
from ferrytext.llm.simhash import near_duplicates
from ferrytext.llm.suffix_dedup import PASSAGE, removal_digests


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_licenses(documents(spark, sf_dir))
    base = F.filter("matches", lambda m: m["base"] & (m["edits"] == 0))
    labels = lambda ms: F.array_join(F.array_sort(F.array_distinct(F.transform(ms, lambda m: m["label"]))), ",")
    starts = F.transform(base, lambda m: m["start_word"])
    nearness = F.transform(F.col("matches"), lambda m: 1 - m["edits"] / F.length(m["phrase"]))
    return found.select(
        "doc_id",
        "n_words",
        F.size(base).cast("long").alias("n_base"),
        F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"),
        labels(base).alias("base_labels"),
        labels(F.col("matches")).alias("labels"),
        F.coalesce(F.array_max(nearness), F.lit(0.0)).alias("score"),
    )


def op2_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_texts(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir))


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return removal_digests(documents(spark, sf_dir), passage=PASSAGE)


def op5_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text_media_digests(documents(spark, sf_dir))


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return encode_decode(documents(spark, sf_dir), ranks, public_tokenizers.PATTERN)


def op7_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    found = langid.identify(docs, langid.training_sample(docs))
    return found.select("doc_id", (fold(F.col("doc_id"), 3) == 1).alias("held_out"), "lang_pred", "score")


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), proximity=True)


def op9_shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.hilbert_shards(documents(spark, sf_dir), 8)


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    found = toxicity.score_documents(docs, model)
    return found.select(
        "doc_id",
        (fold(F.col("doc_id"), 5) == 0).alias("held_out"),
        "score",
        "predicted",
        F.size("passages").cast("long").alias("n_passages"),
    )


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = fill_in_middle.fill_in_middle(documents(spark, sf_dir))
    digest = lambda c: F.sha2(c.cast("binary"), 256)
    return found.select(
        "doc_id",
        F.col("n_units").alias("n"),
        "form",
        "prefix_chars",
        "middle_chars",
        digest(F.col("output")).alias("output_sha256"),
        digest(fill_in_middle.restored(F.col("output"), F.col("form"))).alias("restored_sha256"),
    )


def op12_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = fingerprints.edited_fingerprints(documents(spark, sf_dir))
    return found.withColumn("edited_sha256", F.sha2(F.col("edited").cast("binary"), 256)).drop("edited")


def op13_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = merkle.manifest(documents(spark, sf_dir), altered=fold(F.col("doc_id"), 7) == 0)
    back = merkle.folded(F.coalesce("other_leaf", "leaf"), F.col("path"))
    rows = found.select("doc_id", "leaf", "subroot", "root", merkle.proof(F.col("path")).alias("proof_sha256"), back.alias("folded_root"))
    return rows.withColumn("verified", F.col("folded_root") == F.col("root"))


QUERIES = {
    "op1_license_scan": op1_license_scan,
    "op2_lm_score": op2_lm_score,
    "op3_simhash": op3_simhash,
    "op4_suffix_dedup": op4_suffix_dedup,
    "op5_media": op5_media,
    "op6_bpe": op6_bpe,
    "op7_langid": op7_langid,
    "op8_decontaminate": op8_decontaminate,
    "op9_shard": op9_shard,
    "op10_toxicity": op10_toxicity,
    "op11_fill_in_middle": op11_fill_in_middle,
    "op12_fingerprints": op12_fingerprints,
    "op13_merkle": op13_merkle,
}

ORACLE_SQL = {"op8_decontaminate": decontaminate.oracle(), "op9_shard": sharding.oracle(8), "op11_fill_in_middle": fill_in_middle.oracle(), "op13_merkle": merkle.oracle()}
