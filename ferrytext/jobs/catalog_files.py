"""Registered queries over packages, recognised pages, pixels, clean-up and streams' batch twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ferrytext.functions import text as T
from ferrytext.jobs.catalog import Catalog
from ferrytext.jobs.catalog_ops import EVENTS, SAMPLES, job_events, rate_samples
from ferrytext.operators import cleanup as C
from ferrytext.operators import layout as L
from ferrytext.operators import pixels as P
from ferrytext.operators import recognition as G
from ferrytext.sources import archives as Z
from ferrytext.sources.decoding import decode_text
from ferrytext.sources.scratch import scratch
from ferrytext.sources.views import BOXES_SQL, boxes, table
from ferrytext.sources import writers as W
from ferrytext.sources.writers import write_packages as pack
from ferrytext.streaming import jobs as S

_catalog = Catalog()
QUERIES, ORACLE_SQL, query = _catalog.queries, _catalog.sql, _catalog.query

_PACKED = "SELECT doc_id % 50 AS archive_id, (row_number() OVER (PARTITION BY doc_id % 50 ORDER BY doc_id) - 1)::INT AS ordinal, source || '/' || doc_id || '.txt' AS name, strlen(text)::BIGINT AS size, false AS is_dir, text FROM documents"


#: Bounds of a volume's files and bytes (one file at least), far below what an archive may hold.
VOLUME_FILES, VOLUME_BYTES = 1_000, 64 << 20


def _files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files of 50 archives, with their volume: archives are cut, in order of doc_id, by ranges of ids, and
    these where they are over a bound. No task holds more than a range of an archive."""
    key = ["archive_id", "span"]
    files = table(spark, sf_dir, "documents").select(
        (F.col("doc_id") % 50).alias("archive_id"), F.floor(F.col("doc_id") / F.lit(50 * VOLUME_FILES)).alias("span"), F.col("doc_id").alias("nth"),
        F.concat("source", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("name"), F.col("text").cast("binary").alias("content"),
    )
    order = Window.partitionBy(*key).orderBy("nth", F.xxhash64("name", "content"))
    before = F.coalesce(F.sum(F.octet_length("content")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    part = F.floor((F.row_number().over(order) - 1) / VOLUME_FILES) + F.floor(before / VOLUME_BYTES)
    return files.withColumn("part", part)


def volumes(files: DataFrame) -> DataFrame:
    """(archive_id, span, part, volume, start): a number for each volume and the members of its archive before it."""
    counted = files.groupBy("archive_id", "span", "part").agg(F.count("*").alias("n"))
    order = Window.partitionBy("archive_id").orderBy("span", "part")
    start = F.coalesce(F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("int")
    # ids modulo 50 are within -49 and 49; 50 more is over 0, which is for null
    volume = (F.row_number().over(order) - 1).cast("long") * 100 + F.coalesce(F.col("archive_id") + 50, F.lit(0))
    return counted.select("archive_id", "span", "part", volume.alias("volume"), start.alias("start"))


def packages(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Documents as zip packages (archive_id, content), a package per volume, and the volumes: 50 archives, whose volumes
    grow in number and not in size."""
    files = _files(spark, sf_dir)
    known = volumes(files)
    same = [files[c].eqNullSafe(known[c]) for c in ("archive_id", "span", "part")]
    rows = files.join(known, same).select(known["volume"].alias("job_id"), "nth", "name", "content")
    return pack(rows).select(F.col("job_id").alias("archive_id"), F.col("package").alias("content")), known


def _joined(members: DataFrame, known: DataFrame) -> DataFrame:
    """Members of volumes as members of their archives."""
    found = members.withColumnRenamed("archive_id", "volume").join(known.select("archive_id", "volume", "start"), "volume")
    return found.withColumn("ordinal", F.col("ordinal") + F.col("start"))


@query(f"SELECT archive_id, ordinal, name, size, is_dir, text FROM ({_PACKED})")
def read_archive_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed, known = packages(spark, sf_dir)
    return _joined(Z.read_archive_members(packed), known).select("archive_id", "ordinal", "name", "size", "is_dir", F.col("content").cast("string").alias("text"))


@query(f"SELECT archive_id, count(*) AS members, sum(size)::BIGINT AS bytes FROM ({_PACKED}) GROUP BY archive_id")
def write_packages(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed, known = packages(spark, sf_dir)
    return _joined(Z.read_archive_members(packed), known).groupBy("archive_id").agg(F.count("*").alias("members"), F.sum("size").alias("bytes"))


@query(f"SELECT archive_id, ordinal, name FROM ({_PACKED})")
def repack_book(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed, known = packages(spark, sf_dir)
    books = Z.read_archive_members(packed).withColumnRenamed("archive_id", "book_id")
    again = Z.repack_book(books.select("book_id", "ordinal", "name", "is_dir", "content"))
    return _joined(Z.read_archive_members(again.withColumnRenamed("book_id", "archive_id")), known).select("archive_id", "ordinal", "name")


@query(f"WITH boxes AS ({BOXES_SQL}) SELECT page_id, region_id, x0, y0, x1, y1, confidence, text FROM boxes")
def recognize_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = boxes(spark, sf_dir)
    cells = F.array_sort(F.collect_list(F.struct("region_id", "x0", "y0", "x1", "y1", "confidence", "text")))
    return G.recognize_pages(rows.groupBy("page_id").agg(cells.alias("regions")), G.from_table)


#: Bytes of text in a band of a page: 20 rows of 60 pixels.
_BAND = 3600


def _texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(page_id, text, bands) of documents with any text."""
    bands = F.ceil(F.octet_length("text") / _BAND).cast("int")
    return table(spark, sf_dir, "documents").where(F.length("text") > 0).select(F.col("doc_id").alias("page_id"), "text", bands.alias("bands"))


def page_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pictures 60 wide from all bytes of documents, in bands of 20 rows, with a white band below."""
    data = F.rpad(F.encode("text", "UTF-8"), (F.col("bands") + 1) * _BAND, F.unhex(F.lit("FF")))
    return _texts(spark, sf_dir).select("page_id", ((F.col("bands") + 1) * 20).alias("height"), F.lit(60).alias("width"), data.alias("rgb"))


def _image_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A region in every band."""
    box = lambda i, y0, y1: F.struct(i.alias("region_id"), F.lit(2).alias("x0"), y0.alias("y0"), F.lit(50).alias("x1"), y1.alias("y1"))
    n = F.col("bands")
    text = F.transform(F.sequence(F.lit(1), n), lambda i: box(i, i * 20 - 18, i * 20 - 2))
    both = F.concat(text, F.array(box(n + 1, n * 20 + 4, n * 20 + 18)))
    return _texts(spark, sf_dir).select("page_id", F.explode(both).alias("r")).select("page_id", "r.*")


#: Volumes of a hundred ids: their documents one after the other, in order.
_VOLUMES = """volumes AS (SELECT coalesce(floor(doc_id / 100)::BIGINT::VARCHAR, 'none') AS volume, coalesce(string_agg(text, chr(10) ORDER BY doc_id, text), '') AS text
  FROM documents GROUP BY 1)"""


def bound_volumes(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.coalesce(F.floor(F.col("doc_id") / 100).cast("string"), F.lit("none"))
    texts = F.array_sort(F.collect_list(F.struct("doc_id", "text")))
    rows = table(spark, sf_dir, "documents").groupBy(name.alias("volume")).agg(texts.alias("x"))
    return rows.select("volume", F.array_join(F.col("x.text"), "\n").alias("text"))


@query(f"WITH {_VOLUMES} SELECT volume, 'EFBBBF' || hex(encode(text)) AS data FROM volumes")
def write_document_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Volumes written as files, and the files read back as bytes."""
    at = scratch(spark, "files")
    W.write_document_files(bound_volumes(spark, sf_dir).select(F.concat("volume", F.lit("/text_zh.txt")).alias("path"), "text"), at)
    files = Z.read_text_files(spark, at)
    return files.select(F.regexp_extract("path", "([^/]+)/text_zh", 1).alias("volume"), F.hex("content").alias("data"))


@query(
    f"""WITH {_VOLUMES} SELECT volume, 60 AS width, (20 * (n + 1))::INT AS height, sha256(hex(encode(text)) || repeat('FF', (n + 1) * {_BAND} - strlen(text))) AS pixels
    FROM (SELECT *, ceil(strlen(text) / {_BAND})::BIGINT AS n FROM volumes)"""
)
def read_page_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All bytes of volumes as pictures 60 wide, written as BMP files and read by Spark's source of images."""
    size = (F.ceil(F.octet_length("text") / _BAND) + 1).cast("int")
    data = F.rpad(F.encode("text", "UTF-8"), size * _BAND, F.unhex(F.lit("FF")))
    path, at = F.concat("volume", F.lit("/page.bmp")), scratch(spark, "pictures")
    W.write_page_images(bound_volumes(spark, sf_dir).select(path.alias("path"), (size * 20).alias("height"), F.lit(60).alias("width"), data.alias("rgb")), at)
    name = F.regexp_extract("origin", "([^/]+)/page", 1)
    return Z.read_page_images(spark, f"{at}/*").select(name.alias("volume"), "width", "height", F.sha2(F.hex("rgb"), 256).alias("pixels"))


@query()
def region_pixel_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.region_pixel_stats(page_images(spark, sf_dir), _image_regions(spark, sf_dir))


@query()
def erase_flat_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = P.erase_flat_regions(page_images(spark, sf_dir), _image_regions(spark, sf_dir))
    anew = F.aggregate("runs", F.lit(0).cast("long"), lambda n, r: n + r["length"]).alias("inpaint_pixels")
    ids = F.concat_ws(",", F.col("needs_inpaint").cast("array<string>")).alias("needs_inpaint")
    return rows.select("page_id", F.sha2("rgb", 256).alias("sha256"), ids, anew, F.sha2(F.to_json("runs"), 256).alias("runs_sha256"))


def looping_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of documents, those of every third document three times over."""
    lines = T.normalize_ocr_lines(F.col("text"))
    rows = C.spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    times = F.when(F.col("doc_id") % 3 == 0, 3).otherwise(1)
    return rows.select("doc_id", F.flatten(F.array_repeat(lines, times)).alias("lines"))  # one copy of the expression, so that lines are cut once


@query()
def collapse_line_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.collapse_line_blocks(looping_lines(spark, sf_dir), "lines").select("doc_id", F.array_join("lines", "\n").alias("text"))


@query()
def truncate_loop_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.truncate_loop_tail(looping_lines(spark, sf_dir).select("doc_id", F.array_join("lines", "\n").alias("text")), "text")


@query()
def clean_recognition(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = looping_lines(spark, sf_dir).select("doc_id", F.array_join("lines", "\n").alias("text"))
    return C.clean_recognition(rows, "text")


_WIDE = r"[\x{2e80}-\x{9fff}\x{ff00}-\x{ff60}]"
_ADVANCE = lambda c: f"CASE WHEN regexp_matches({c}, '{_WIDE}') THEN 1000 ELSE 500 END"


@query(
    f"""SELECT doc_id, array_to_string(CASE WHEN len(t) <= 3 THEN [t] ELSE list_transform([list_reduce(list_transform(regexp_extract_all(t, '(?s).'),
    lambda c: {{'d': []::VARCHAR[], 'l': c, 'u': {_ADVANCE('c')}}}), lambda a, x: CASE WHEN a.l <> '' AND (a.u + x.u) * 14 > 200000
    THEN {{'d': a.d || [a.l], 'l': x.l, 'u': x.u}} ELSE {{'d': a.d, 'l': a.l || x.l, 'u': a.u + x.u}} END, {{'d': []::VARCHAR[], 'l': '', 'u': 0}})],
    lambda z: z.d || [z.l])[1] END, '|') AS lines FROM (SELECT doc_id, regexp_replace(translate(text, 'aei', 'あえい'), '[\\r\\n]', '', 'g') AS t FROM documents) WHERE t <> ''"""
)
def horizontal_wrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.translate("text", "aei", "あえい")
    rows = table(spark, sf_dir, "documents").where(L.plain(t) != "")
    return rows.select("doc_id", F.array_join(L.horizontal_wrap(t, F.lit(14), F.lit(200)), "|").alias("lines"))


@query(
    f"""WITH RECURSIVE {SAMPLES}, s AS (SELECT *, row_number() OVER (PARTITION BY download_id ORDER BY t, bytes) AS i, t = max(t) OVER (PARTITION BY download_id) AS force FROM samples),
    walk AS (SELECT download_id, i, t, bytes, t AS last, true AS kept FROM s WHERE i = 1
      UNION ALL SELECT s.download_id, s.i, s.t, s.bytes, CASE WHEN s.t - walk.last >= 0.8 OR s.force THEN s.t ELSE walk.last END, s.t - walk.last >= 0.8 OR s.force
      FROM walk JOIN s ON s.download_id = walk.download_id AND s.i = walk.i + 1)
    SELECT download_id, round(t, 6) AS t, bytes, round(CASE WHEN dt > 0 THEN greatest(0.0, db / dt) ELSE 0.0 END, 6)::DOUBLE AS speed FROM
      (SELECT *, t - min(t) OVER w AS dt, bytes - arg_min(bytes, t) OVER w AS db FROM walk WHERE kept
      WINDOW w AS (PARTITION BY download_id ORDER BY t RANGE BETWEEN 4 PRECEDING AND CURRENT ROW))"""
)
def stream_throughput(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples come in two portions, earlier and later ones; the stream is stopped between them and goes on from its
    checkpoint."""
    at = scratch(spark, "rates")
    rows = rate_samples(spark, sf_dir).withColumn("force", F.col("t") == F.max("t").over(Window.partitionBy("download_id")))
    rows.write.parquet(f"{at}/samples")  # sorted by download once, not once for each portion
    rows = spark.read.schema(rows.schema).parquet(f"{at}/samples")
    middle = rows.agg(F.percentile_approx("t", 0.5)).first()[0] or 0.0
    for portion in (rows.where(F.col("t") <= middle), rows.where(F.col("t") > middle)):
        portion.write.mode("append").parquet(f"{at}/in")
        stream = S.stream_throughput(spark.readStream.schema(rows.schema).parquet(f"{at}/in"), 3600, "4 hours")
        sink = stream.writeStream.format("parquet").option("checkpointLocation", f"{at}/state").outputMode("append")
        sink.trigger(availableNow=True).start(f"{at}/out").awaitTermination()
    found = spark.read.schema(stream.schema).parquet(f"{at}/out")
    return found.select("download_id", F.round("t", 6).alias("t"), "bytes", F.round("speed", 6).alias("speed"))


_KEEP, _DELAY = 24 * 3_600_000, 6 * 3_600_000
_LATEST = lambda c: f"arg_max({c}, (ts, seq)) AS {c}"
_FOLD = f"min(ts) AS created, max(ts) AS updated, max(seq) FILTER (ts = top) AS seq, {', '.join(map(_LATEST, ('kind', 'status', 'progress', 'message')))}"
_TOP = "max(ts) OVER (PARTITION BY job_id) AS top"
_GONE = lambda mark: f"status IN ('completed', 'failed') AND epoch_us(updated) // 1000 + {_KEEP} <= (SELECT w FROM {mark})"


@query(
    f"""WITH {EVENTS}, parts AS (SELECT ev.*, ts <= make_timestamp((SELECT (epoch_us(min(ts)) + epoch_us(max(ts))) // 2 FROM ev)) AND seq % 10 <> 0 AS early FROM ev),
    mark1 AS (SELECT max(epoch_us(ts)) // 1000 - {_DELAY} AS w FROM parts WHERE early), mark2 AS (SELECT max(epoch_us(ts)) // 1000 - {_DELAY} AS w FROM parts),
    one AS (SELECT job_id, {_FOLD} FROM (SELECT *, {_TOP} FROM parts WHERE early) GROUP BY job_id), gone AS (SELECT * FROM one WHERE {_GONE("mark1")}),
    late AS (SELECT count(*) AS late_rows FROM parts WHERE NOT early AND epoch_us(ts) // 1000 <= (SELECT w FROM mark1)),
    later AS (SELECT job_id, ts, ts AS since, seq, kind, status, progress, message, true AS new FROM parts WHERE NOT early AND epoch_us(ts) // 1000 > (SELECT w FROM mark1)
      UNION ALL SELECT job_id, updated, created, seq, kind, status, progress, message, false FROM one ANTI JOIN gone USING (job_id)),
    two AS (SELECT job_id, {_FOLD.replace("min(ts)", "min(since)")}, bool_or(new) AS new FROM (SELECT *, {_TOP} FROM later) GROUP BY job_id),
    log AS (SELECT *, false AS expired FROM one UNION ALL SELECT *, true FROM gone UNION ALL SELECT * EXCLUDE (new), false FROM two WHERE new
      UNION ALL SELECT * EXCLUDE (new), true FROM two WHERE {_GONE("mark2")})
    SELECT job_id, created AS created_at, updated AS updated_at, kind, status, progress, message, expired, late_rows FROM log, late"""
)
def stream_job_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Updates of the earlier half of the time come first, but every tenth comes with the later half; the stream is stopped
    between the two and goes on from its checkpoint."""
    rows = job_events(spark, sf_dir)
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    first, last = rows.agg(F.min(us), F.max(us)).first()
    early, at, late = (us <= ((first or 0) + (last or 0)) // 2) & (F.col("seq") % 10 != 0), scratch(spark, "jobs"), 0
    for portion in (rows.where(early), rows.where(~early)):
        portion.write.mode("append").parquet(f"{at}/in")
        stream = S.stream_job_state(spark.readStream.schema(rows.schema).parquet(f"{at}/in"), f"{_DELAY} milliseconds", _KEEP)
        with S.rocksdb_state(spark):
            sink = stream.writeStream.format("parquet").option("checkpointLocation", f"{at}/state").outputMode("append")
            run = sink.trigger(availableNow=True).start(f"{at}/out")
            run.awaitTermination()
        late += S.late_rows(run.recentProgress)
    return spark.read.schema(stream.schema).parquet(f"{at}/out").withColumn("late_rows", F.lit(late).cast("long"))


def text_files(spark: SparkSession, sf_dir: str) -> str:
    """A folder of text files with a document to a line, as JSON; 1,000 lines a file at most."""
    at = scratch(spark, "texts")
    docs = table(spark, sf_dir, "documents").select((F.col("doc_id") % 50).alias("archive"), F.to_json(F.struct("doc_id", "text")).alias("value"))
    docs.write.partitionBy("archive").option("maxRecordsPerFile", 1_000).text(at)
    return at


def _documents_of(files: DataFrame) -> DataFrame:
    """(doc_id, text) of the files (content) of such a folder."""
    lines = F.explode(T.split_lines(F.col("text")))
    rows = decode_text(files.select("content")).select(lines.alias("line"))
    return rows.select(F.from_json("line.content", "doc_id long, text string").alias("x")).select("x.*")


@query("SELECT doc_id, text FROM documents")
def read_text_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _documents_of(Z.read_text_files(spark, text_files(spark, sf_dir)))


@query("SELECT doc_id, text FROM documents")
def stream_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder, at = text_files(spark, sf_dir), scratch(spark, "ingested")
    handle = lambda files: _documents_of(files).write.mode("append").parquet(f"{at}/out")
    S.stream_ingest(spark, folder, f"{at}/state", handle).awaitTermination()
    return spark.read.schema("doc_id long, text string").parquet(f"{at}/out")
