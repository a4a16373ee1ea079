"""SimHash near-duplicates with the pigeonring filter.

Two 64-bit fingerprints at most 3 bits apart, seen as a ring of four 16-bit segments, have a segment from which
every chain of l segments differs in at most l * 3 / 4 bits: 0 in the first, 1 in two, 2 in three. The first two
conditions are the key of an equi-join (a segment as it is, the next with one bit flipped or none: 32 bits, so
chance matches stay rare at any size); the third and the whole distance are checked on what it finds. Only
distinct fingerprints are joined, so groups of copies cost one row.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ferrytext.llm.common import LOWER_TABLE, slices, stored, text_rows, tidied
from ferrytext.llm.components import components

SEGMENTS, WIDTH, MOST = 4, 16, 3
#: So many hashes of a text are spread into bits at once.
SHINGLES = 1 << 16


def fingerprint(text: bytes, shingle: int = 3) -> int:
    """A bit is 1 if it is set in over half of the XXH64 hashes (seed 42) of the text's shingles of words, repeats
    included; fewer words than a shingle are one shingle, and no words give 0."""
    words = text.translate(LOWER_TABLE).split()
    if not words:
        return 0
    n = max(1, len(words) - shingle + 1)
    shingles = map(b" ".join, zip(*(words[i : i + n] for i in range(min(shingle, len(words))))))
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(42)), ">u8", n)
    ones = np.zeros(64, np.int64)
    for a in range(0, n, SHINGLES):
        ones += np.unpackbits(hashes[a : a + SHINGLES].view(np.uint8)).reshape(-1, 64).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big")


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """doc_id and fp (the fingerprint's bits as a signed long); null and empty texts have fingerprint 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 4 << 20):
            found = np.array([fingerprint(t, shingle) for t in batch.column("text").to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found.view(np.int64))], ["doc_id", "fp"])

    return text_rows(docs).mapInArrow(tidied(run), "doc_id bigint, fp bigint")


def _key(i: int) -> Column:
    segment = lambda k: F.shiftrightunsigned("fp", 64 - WIDTH * (k % SEGMENTS + 1)).bitwiseAND((1 << WIDTH) - 1)
    return F.lit(i << 2 * WIDTH).bitwiseOR(F.shiftleft(segment(i), WIDTH)).bitwiseOR(segment(i + 1))


def links(fps: DataFrame) -> DataFrame:
    """(a, b), a < b: all pairs of the distinct ``fp`` at most 3 bits apart.

    A fingerprint makes 68 probes, which Spark's estimate of sizes doesn't count: left to itself it broadcasts them all.
    """
    keys = F.array(*(_key(i) for i in range(SEGMENTS)))
    index = fps.select(F.col("fp").alias("a"), F.explode(keys).alias("key"))
    flips = F.array(F.lit(0).cast("long"), *(F.lit(1 << j).cast("long") for j in range(WIDTH)))
    probes = fps.select(F.col("fp").alias("b"), F.explode(keys).alias("exact")).select(
        "b", F.explode(F.transform(flips, lambda m: F.col("exact").bitwiseXOR(m))).alias("key")
    )
    met = index.hint("merge").join(probes, "key").where("a < b").withColumn("x", F.expr("a ^ b"))
    turn = f"cast({WIDTH} * (key >> {2 * WIDTH}) as int)"
    chain = F.expr(f"shiftleft(x, {turn}) | shiftrightunsigned(x, 64 - {turn})")
    return (
        met.withColumn("chain", chain)
        .where((F.bit_count(F.shiftrightunsigned("chain", WIDTH)) <= 2) & (F.bit_count("x") <= MOST))
        .select("a", "b")
        .distinct()
    )


def near_duplicates(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id: the smallest doc_id reachable over links.

    Null and empty texts share fingerprint 0 and are linked like any other; rows with a null id belong to a
    component but never name it (one of null ids alone is null); repeated rows give repeated rows; an empty table
    gives an empty result.
    """
    seen = stored(fingerprints(docs, shingle), "fingerprints")
    each = stored(seen.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct-fingerprints")
    found = components(links(each.select("fp")))
    rooted = each.join(found.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    rooted = stored(rooted, "rooted")
    least = stored(rooted.groupBy("root").agg(F.min("least").alias("component_id")), "component-ids")
    # tables of their own on both sides, so that a hot root or fingerprint can be split over tasks
    named = stored(rooted.join(least, "root").select("fp", "component_id"), "named")
    return seen.join(named, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
