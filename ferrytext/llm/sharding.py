"""Hilbert-curve sharding with DataFrame functions only.

Each row gets three small coordinates (size on a log scale, source, language), their index on a Hilbert curve,
and a place in the order (index, sub-bucket of a hash of the row, row). Runs of that order with row counts at most one apart are the
shards, so a shard's files cover a compact part of all three dimensions. The order is global, yet no task sorts
more than a sub-bucket: places come from counts per cell and sub-bucket.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ferrytext.llm.common import stored

BITS = 4
SIDE = 1 << BITS
#: Rows that a sub-bucket of a cell should hold at most; a cell of a third of all rows has many sub-buckets.
BUCKET_ROWS = 250_000
#: Equal rows that one task makes of their number at a time.
EQUAL_ROWS = 100_000


def hilbert_steps() -> list[tuple[str, str]]:
    """Assignments (name, SQL) that turn coordinates x, y, z of BITS bits into their index h on the Hilbert curve
    (Skilling's transposition); both engines run the same text."""
    steps: list[tuple[str, str]] = []
    q = SIDE >> 1
    while q > 1:
        p = q - 1
        for axis in "xyz":
            bit = f"({axis} & {q}) <> 0"
            if axis == "x":
                steps.append(("x", f"CASE WHEN {bit} THEN xor(x, {p}) ELSE x END"))
            else:
                steps.append(("t", f"CASE WHEN {bit} THEN 0 ELSE xor(x, {axis}) & {p} END"))
                steps.append(("x", f"CASE WHEN {bit} THEN xor(x, {p}) ELSE xor(x, t) END"))
                steps.append((axis, f"xor({axis}, t)"))
        q >>= 1
    steps += [("y", "xor(y, x)"), ("z", "xor(z, y)"), ("t", "0")]
    q = SIDE >> 1
    while q > 1:
        steps.append(("t", f"CASE WHEN (z & {q}) <> 0 THEN xor(t, {q - 1}) ELSE t END"))
        q >>= 1
    steps += [(axis, f"xor({axis}, t)") for axis in "xyz"]
    spread = [f"(({axis} >> {b}) & 1) * {1 << (3 * b + 2 - i)}" for i, axis in enumerate("xyz") for b in range(BITS)]
    return [*steps, ("h", " + ".join(spread))]


def curve(spark: SparkSession) -> DataFrame:
    """cell (x * 256 + y * 16 + z) and h: 4096 rows, whatever the data."""
    cells = spark.range(0, SIDE**3, 1, 1).select(
        F.col("id").cast("int").alias("cell"),
        *(F.expr(f"cast((id >> {s}) & {SIDE - 1} as int)").alias(axis) for axis, s in zip("xyz", (2 * BITS, BITS, 0))),
    )
    for name, sql in hilbert_steps():
        sql = sql.replace("xor(", "bitwise_xor(")
        cells = cells.withColumn(name, F.expr(_spark_xor(sql)))
    return cells.select("cell", F.col("h").cast("int").alias("h"))


def _spark_xor(sql: str) -> str:
    """bitwise_xor(a, b) as Spark's a ^ b."""
    while "bitwise_xor(" in sql:
        head, _, rest = sql.partition("bitwise_xor(")
        a, _, rest = rest.partition(", ")
        b, _, tail = rest.partition(")")
        sql = f"{head}(({a}) ^ ({b})){tail}"
    return sql


def coordinates(size: Column, source: Column, lang: Column) -> list[Column]:
    """Size on a scale of half powers of two from 256 bytes on; source and language by crc32, so that equal values
    share a coordinate (null: that of the empty text)."""
    by_hash = lambda c: F.crc32(F.coalesce(c.cast("string"), F.lit("")).cast("binary")) % SIDE
    log = F.floor(F.log2(size.cast("double")) * 2) - 16
    return [F.greatest(F.lit(0), F.least(F.lit(SIDE - 1), log)).cast("int"), by_hash(source).cast("int"), by_hash(lang).cast("int")]


def hilbert_shards(docs: DataFrame, shards: int = 8, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """doc_id, size, text_crc32, law ('rows'), shard, slot, grown_shard (null) and h, the curve's index.

    Shards are runs of the order (h, spread, id, size, text_crc32), spread being the crc32 of the last three; the first (rows mod
    shards) have a row more. Slots count from 0 in each shard. Rows without an id and rows of one id are spread by their texts; rows
    equal in all three count as one with a number until they have got their slots, next to each other. Texts of any length are read
    once where they lie; an empty table gives an empty result. Columns other than doc_id, text, source and lang are ignored.
    """
    spark = docs.sparkSession
    text = F.coalesce(docs["text"], F.lit(""))
    size = F.octet_length(text).cast("long") + 1
    x, y, z = coordinates(size, docs["source"], docs["lang"])
    rows = docs.select(
        docs["doc_id"].cast("long").alias("doc_id"),
        size.alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        (x * SIDE * SIDE + y * SIDE + z).alias("cell"),
    )
    rows = rows.withColumn("spread", F.crc32(F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "size", "text_crc32").cast("binary")))
    rows = stored(rows, "shard-keys")  # small: texts are read once
    total = rows.count()
    parts = 1
    while parts * bucket_rows < total:
        parts *= 2
    parts *= 16  # cells differ in size
    width = -(-(1 << 32) // parts)
    rows = rows.withColumn("bucket", F.floor(F.col("spread") / width).cast("int"))
    counts = rows.groupBy("cell", "bucket").agg(F.count("*").alias("n")).join(F.broadcast(curve(spark)), "cell")
    in_cell = Window.partitionBy("cell").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    # one row per cell, 4096 at most
    cells = counts.groupBy("cell", "h").agg(F.sum("n").alias("n"))
    over = Window.orderBy("h").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.select("cell", F.coalesce(F.sum("n").over(over), F.lit(0)).alias("cell_first"))
    firsts = (
        counts.withColumn("bucket_first", F.coalesce(F.sum("n").over(in_cell), F.lit(0)))
        .join(F.broadcast(cells), "cell")
        .select("cell", "bucket", "h", (F.col("cell_first") + F.col("bucket_first")).alias("first"))
    )
    alike = rows.groupBy("cell", "bucket", "spread", "doc_id", "size", "text_crc32").agg(F.count("*").alias("n"))
    earlier = Window.partitionBy("cell", "bucket").orderBy("spread", "doc_id", "size", "text_crc32").rowsBetween(Window.unboundedPreceding, -1)
    alike = alike.withColumn("nth", F.coalesce(F.sum("n").over(earlier), F.lit(0)))
    # numbers over EQUAL_ROWS are cut, and the pieces dealt to all tasks, before rows are made of them
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(EQUAL_ROWS).cast("long")))
    many = alike.where(F.col("n") > EQUAL_ROWS).withColumn("from", every).withColumn("nth", F.col("nth") + F.col("from"))
    many = many.withColumn("n", F.least(F.lit(EQUAL_ROWS), F.col("n") - F.col("from"))).repartition("cell", "nth").drop("from")
    alike = alike.where(F.col("n") <= EQUAL_ROWS).unionByName(many)
    placed = alike.withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1))).join(firsts, ["cell", "bucket"])
    place = F.col("first") + F.col("nth") + F.col("copy")
    low, more = divmod(total, shards)
    long_rows = more * (low + 1)
    in_long = place < long_rows
    shard = F.when(in_long, F.floor(place / (low + 1))).otherwise(more + F.floor((place - long_rows) / max(1, low)))
    start = F.when(F.col("shard") < more, F.col("shard") * (low + 1)).otherwise(long_rows + (F.col("shard") - more) * low)
    return placed.select("doc_id", "size", "text_crc32", "h", place.alias("place"), shard.cast("int").alias("shard")).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        "shard",
        (F.col("place") - start).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
        F.col("h").cast("long").alias("h"),
    )


def _crc_table() -> list[int]:
    table = []
    for c in range(256):
        for _ in range(8):
            c = c >> 1 ^ 0xEDB88320 * (c & 1)
        table.append(c)
    return table


def _crc32_sql(text: str) -> str:
    """crc32 of a text's UTF-8 bytes in DuckDB, which has no such function."""
    data = f"list_transform(regexp_extract_all(hex(encode({text})), '..'), lambda h: ('0x' || h)::BIGINT)"
    step = f"lambda c, b: xor(c >> 8, {_crc_table()}[(xor(c, b) & 255) + 1])"
    return f"xor(list_reduce({data}, {step}, 4294967295::BIGINT), 4294967295)"


def oracle(shards: int = 8) -> str:
    """The rows of ``hilbert_shards`` in DuckDB SQL."""
    keys = f"""
    SELECT doc_id, strlen(coalesce(text, '')) + 1 AS size, {_crc32_sql("coalesce(text, '')")} AS text_crc32,
      {_crc32_sql("coalesce(source, '')")} % {SIDE} AS y, {_crc32_sql("coalesce(lang, '')")} % {SIDE} AS z
    FROM documents"""
    ctes = [f"bare AS ({keys})"]
    own = "coalesce(doc_id::VARCHAR, '') || ':' || size || ':' || text_crc32"
    ctes.append(f"keys AS (SELECT *, {_crc32_sql(own)} AS spread FROM bare)")
    ctes.append(f"s0 AS (SELECT *, greatest(0, least({SIDE - 1}, floor(log2(size) * 2)::BIGINT - 16)) AS x, 0::BIGINT AS t FROM keys)")
    for i, (name, sql) in enumerate(hilbert_steps()):
        have = f"* REPLACE ({sql} AS {name})" if name != "h" else f"*, {sql} AS h"
        ctes.append(f"s{i + 1} AS (SELECT {have} FROM s{i})")
    ctes.append(
        f"""placed AS (SELECT *, row_number() OVER (ORDER BY h, spread, doc_id NULLS FIRST, size, text_crc32) - 1 AS place,
      count(*) OVER () // {shards} AS low, count(*) OVER () % {shards} AS more FROM s{len(hilbert_steps())})"""
    )
    ctes.append(
        """sharded AS (SELECT *, CASE WHEN place < more * (low + 1) THEN place // (low + 1)
      ELSE more + (place - more * (low + 1)) // greatest(1, low) END AS shard FROM placed)"""
    )
    return "WITH " + ",\n".join(ctes) + """
    SELECT doc_id, size::BIGINT AS size, text_crc32::BIGINT AS text_crc32, 'rows' AS law, shard::INTEGER AS shard,
      (place - CASE WHEN shard < more THEN shard * (low + 1) ELSE more * (low + 1) + (shard - more) * low END)::BIGINT AS slot,
      NULL::INTEGER AS grown_shard, h::BIGINT AS h
    FROM sharded"""
