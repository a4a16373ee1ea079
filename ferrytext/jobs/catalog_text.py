"""Registered queries over texts and units, each with its DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ferrytext.functions import text as T
from ferrytext.jobs.catalog import Catalog
from ferrytext.operators import units as U
from ferrytext.sources.views import KANA_DOCS_SQL, kana_docs, table

N = T.MAX_CHARS
_catalog = Catalog()
QUERIES, ORACLE_SQL, query = _catalog.queries, _catalog.sql, _catalog.query

WHITE = T.WHITE
STRIP = lambda x: rf"regexp_replace({x}, '\A[{WHITE}]+|[{WHITE}]+\z', '', 'g')"
SLICES = lambda x: f"list_transform(range(0, greatest(1, len({x})), {N}), lambda i: {x}[i + 1 : i + {N}])"
PACK = lambda c: (
    f"CASE WHEN len({c}) <= {N} THEN [{c}] ELSE list_transform([list_reduce(list_transform(regexp_extract_all({c}, '{T.SENTENCE}'),"
    " lambda s: {'d': []::VARCHAR[], 'c': s}), lambda a, x: CASE"
    f" WHEN len(x.c) > {N} THEN {{'d': a.d || (CASE WHEN a.c <> '' THEN [a.c] ELSE [] END) || {SLICES('x.c')}, 'c': ''}}"
    f" WHEN a.c <> '' AND len(a.c) + len(x.c) > {N} THEN {{'d': a.d || [a.c], 'c': x.c}}"
    " ELSE {'d': a.d, 'c': a.c || x.c} END, {'d': []::VARCHAR[], 'c': ''})],"
    " lambda z: z.d || (CASE WHEN z.c <> '' THEN [z.c] ELSE [] END))[1] END"
)
KANA = f"kana AS ({KANA_DOCS_SQL})"
LINES = (
    f"lines AS (SELECT doc_id, generate_subscripts(ls, 1) - 1 AS line_no, unnest(ls) AS line FROM"
    f" (SELECT doc_id, regexp_extract_all(text, '{T.LINE}') AS ls FROM kana)),"
    r" parts AS (SELECT doc_id, line_no, regexp_replace(line, '[\r\n]+\z', '') AS content, regexp_extract(line, '[\r\n]*\z') AS ending FROM lines)"
)
LAYOUT = f"""{KANA}, {LINES}, bodies AS (
  SELECT doc_id, line_no, ending, CASE WHEN regexp_matches(content, '{T.JAPANESE}') AND {STRIP("content")} <> ''
    THEN list_transform({PACK("content")}, lambda u: {{'kind': 'unit', 'piece': u}}) ELSE [{{'kind': 'literal', 'piece': content}}] END AS body FROM parts),
  flat AS (SELECT doc_id, line_no, unnest(body || (CASE WHEN ending <> '' THEN [{{'kind': 'literal', 'piece': ending}}] ELSE [] END)) AS x,
    generate_subscripts(body || (CASE WHEN ending <> '' THEN [{{'kind': 'literal', 'piece': ending}}] ELSE [] END), 1) AS k FROM bodies),
  layout AS (SELECT doc_id, (row_number() OVER w - 1)::INT AS pos, x.kind AS kind,
    CASE WHEN x.kind = 'unit' THEN (count(CASE WHEN x.kind = 'unit' THEN 1 END) OVER w - 1)::INT END AS unit_idx, x.piece AS piece
    FROM flat WINDOW w AS (PARTITION BY doc_id ORDER BY line_no, k ROWS UNBOUNDED PRECEDING)),
  units AS (SELECT doc_id, unit_idx, piece AS unit FROM layout WHERE kind = 'unit')"""
TRANSLATED = "tr AS (SELECT doc_id, unit_idx, '译:' || unit AS translation FROM units)"


@query(f"WITH {LAYOUT} SELECT doc_id, pos, kind, unit_idx, piece FROM layout")
def build_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    return U.build_units(kana_docs(spark, sf_dir))


@query(f"WITH {KANA}, {LINES} SELECT doc_id, line_no::INT AS line_no, content, ending FROM parts")
def split_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kana_docs(spark, sf_dir).select("doc_id", F.posexplode(T.split_lines(F.col("text"))).alias("line_no", "x")).select("doc_id", "line_no", "x.*")


@query(
    f"WITH {KANA} SELECT doc_id, unnest(s) AS sentence, (generate_subscripts(s, 1) - 1)::INT AS nth FROM"
    f" (SELECT doc_id, regexp_extract_all(text, '{T.SENTENCE}') AS s FROM kana)"
)
def split_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kana_docs(spark, sf_dir).select("doc_id", F.posexplode(T.split_sentences(F.col("text"))).alias("nth", "sentence"))


@query(
    f"WITH {KANA} SELECT doc_id, unnest(s) AS chunk, (generate_subscripts(s, 1) - 1)::INT AS nth FROM"
    f" (SELECT doc_id, {PACK('text')} AS s FROM kana)"
)
def pack_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kana_docs(spark, sf_dir).select("doc_id", F.posexplode(T.pack_sentences(F.col("text"))).alias("nth", "chunk"))


@query(f"WITH {KANA} SELECT doc_id, regexp_matches(text, '{T.JAPANESE}') AS japanese FROM kana")
def has_japanese(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kana_docs(spark, sf_dir).select("doc_id", T.has_japanese(F.col("text")).alias("japanese"))


@query(f"WITH {LAYOUT} SELECT doc_id, pos, (row_number() OVER (PARTITION BY doc_id ORDER BY pos) - 1)::INT AS unit_idx FROM layout WHERE kind = 'unit'")
def unit_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = U.build_units(kana_docs(spark, sf_dir)).where("kind = 'unit'").select("doc_id", "pos")
    return U.unit_index(rows, ["doc_id"], ["pos"])


@query(f"WITH {LAYOUT} SELECT doc_id, unit_idx, (unit_idx // 8)::INT AS batch FROM units")
def batch_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    return U.batch_units(U.units(kana_docs(spark, sf_dir)).select("doc_id", "unit_idx"))


def _translated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return U.units(kana_docs(spark, sf_dir)).select("doc_id", "unit_idx", F.concat(F.lit("译:"), "unit").alias("translation"))


@query(
    f"WITH {LAYOUT}, {TRANSLATED} SELECT doc_id, (unit_idx // 8)::INT AS batch, right(context, 1800) AS context FROM"
    " (SELECT doc_id, unit_idx, coalesce(string_agg(translation, chr(10)) OVER (PARTITION BY doc_id ORDER BY unit_idx ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING), '') AS context FROM tr)"
    " WHERE unit_idx % 8 = 0"
)
def rolling_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    return U.rolling_context(_translated(spark, sf_dir))


@query(
    f"WITH {LAYOUT}, {TRANSLATED} SELECT doc_id, (unit_idx // 8)::INT AS batch, right(context, 1800) AS context FROM"
    " (SELECT doc_id, unit_idx, coalesce(string_agg(chr(10) || translation, '') OVER (PARTITION BY doc_id ORDER BY unit_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS context FROM tr)"
    " WHERE unit_idx % 8 = 0"
)
def page_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    return U.page_context(_translated(spark, sf_dir))


@query(
    f"WITH {LAYOUT} SELECT doc_id, (unit_idx // 8)::INT AS batch, ((max(unit_idx) + 1) * 100 // any_value(total))::BIGINT AS percent FROM"
    " (SELECT *, count(*) OVER (PARTITION BY doc_id) AS total FROM units) GROUP BY doc_id, unit_idx // 8"
)
def unit_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    return U.unit_progress(U.units(kana_docs(spark, sf_dir)))


@query(
    f"WITH {LAYOUT}, {TRANSLATED} SELECT doc_id, string_agg(coalesce(translation, piece), '' ORDER BY pos) AS text"
    " FROM layout LEFT JOIN tr USING (doc_id, unit_idx) GROUP BY doc_id"
)
def restore_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    return U.restore_document(U.build_units(kana_docs(spark, sf_dir)), _translated(spark, sf_dir))


@query(
    f"WITH {LAYOUT} SELECT doc_id, coalesce(segments, 0)::BIGINT AS segments, len(text)::BIGINT AS characters, 'utf-8' AS encoding FROM kana"
    " LEFT JOIN (SELECT doc_id, count(*) AS segments FROM units GROUP BY doc_id) USING (doc_id)"
)
def document_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = kana_docs(spark, sf_dir)
    return U.document_report(docs, U.build_units(docs))


#: A translation shows the last two characters of its batch's context: those of the last translation before the batch.
_TAILS = """SELECT a.doc_id, a.unit_idx, coalesce(right('>' || b.unit, 2), '') || '>' || a.unit AS translation
  FROM units a LEFT JOIN units b ON a.doc_id = b.doc_id AND b.unit_idx = a.unit_idx // 8 * 8 - 1"""


@query(f"WITH {LAYOUT} {_TAILS}")
def translate_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    return U.translate_units(U.units(kana_docs(spark, sf_dir)), U.translator("tail"))


@query(f"WITH {LAYOUT} SELECT doc_id AS page_id, unit_idx, translation FROM ({_TAILS})")
def translate_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return U.translate_regions(U.units(kana_docs(spark, sf_dir)).withColumnRenamed("doc_id", "page_id"), U.translator("tail"))


@query(f"WITH {LAYOUT} SELECT doc_id, unit_idx, unit, '>' || unit AS translation FROM units")
def translator_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return U.translate_free(U.units(kana_docs(spark, sf_dir)), U.translator("tail"))


#: Model output of several kinds, made from documents; white space may stand before a label's colon.
_RAW_SQL = """SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN '<think>' || p || '</think>  ' || p WHEN 1 THEN (CASE WHEN doc_id % 12 = 1 THEN '译文 ： ' ELSE '翻译:' END) || p WHEN 2 THEN '"' || p || '"'
  WHEN 3 THEN '“' || p || '”' WHEN 4 THEN p || p || p || p || left(p, 7) ELSE p END AS raw FROM (SELECT doc_id, text AS p FROM documents)"""


def model_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, kind = F.col("text"), F.col("doc_id") % 6
    raw = (
        F.when(kind == 0, F.concat(F.lit("<think>"), p, F.lit("</think>  "), p))
        .when(kind == 1, F.concat(F.when(F.col("doc_id") % 12 == 1, "译文 ： ").otherwise("翻译:"), p))
        .when(kind == 2, F.concat(F.lit('"'), p, F.lit('"')))
        .when(kind == 3, F.concat(F.lit("“"), p, F.lit("”")))
        .when(kind == 4, F.concat(p, p, p, p, F.left(p, F.lit(7))))
        .otherwise(p)
    )
    return table(spark, sf_dir, "documents").select("doc_id", raw.alias("raw"))


@query(
    f"WITH raw AS ({_RAW_SQL}), a AS (SELECT doc_id, {STRIP(chr(39).join(['regexp_replace(raw, ', '(?s)<think>.*?</think>', ', ', '', ', ', 'g', ')']))} AS c FROM raw),"
    rf" b AS (SELECT doc_id, regexp_replace(c, '\A(?:翻译|译文)[{WHITE}]*[:：][{WHITE}]*', '') AS c FROM a)"
    f" SELECT doc_id, {STRIP('CASE WHEN len(c) >= 2 AND left(c, 1) = right(c, 1) AND left(c, 1) IN (chr(34), chr(39), chr(8220), chr(8221)) THEN c[2 : len(c) - 1] ELSE c END')} AS clean FROM b"
)
def clean_translation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return model_output(spark, sf_dir).select("doc_id", T.clean_translation(F.col("raw")).alias("clean"))


#: A unit's length is among the places where the first four characters stand again.
_RUNS = """pieces AS (SELECT doc_id, unnest(ps) AS piece, generate_subscripts(ps, 1) AS i FROM (SELECT doc_id, string_split(raw, left(raw, 4))[2:] AS ps FROM raw)),
  starts AS (SELECT doc_id, (4 * i + sum(len(piece)) OVER (PARTITION BY doc_id ORDER BY i ROWS UNBOUNDED PRECEDING))::BIGINT AS u FROM pieces),
  u AS (SELECT doc_id, raw, least_u AS u FROM raw LEFT JOIN (SELECT doc_id, min(u) AS least_u FROM starts JOIN raw USING (doc_id)
    WHERE u >= 4 AND 3 * u <= len(raw) AND raw[u + 1 : 2 * u] = raw[1 : u] AND raw[2 * u + 1 : 3 * u] = raw[1 : u] GROUP BY doc_id) USING (doc_id))"""


@query(
    f"""WITH raw AS ({_RAW_SQL}), {_RUNS},
    n AS (SELECT doc_id, raw, u, list_max(list_filter(range(3, len(raw) // u + 1), lambda k: raw[1 : k * u] = repeat(raw[1 : u], k))) AS k FROM u WHERE u IS NOT NULL)
    SELECT doc_id, raw[1 : u] || CASE WHEN starts_with(raw[1 : u], raw[k * u + 1 :]) THEN '' ELSE raw[k * u + 1 :] END AS collapsed FROM n
    UNION ALL SELECT doc_id, raw FROM u WHERE u IS NULL"""
)
def collapse_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return model_output(spark, sf_dir).select("doc_id", T.collapse_repeats(F.col("raw")).alias("collapsed"))


_NORMAL = (
    r"regexp_replace(regexp_replace(" + STRIP(r"regexp_replace(replace(" + STRIP(r"regexp_replace(" + STRIP("l") + r", '\A`+|`+\z', '', 'g')") + r", '*', ''), '\A#+', '')")
    + rf", '<[^>]+>', ' ', 'g'), '[{WHITE}]+', '', 'g')"
)


@query(
    f"WITH {KANA}, {LINES} SELECT doc_id, line_no::INT AS line_no, line FROM (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY line_no) - 1 AS line_no, line FROM"
    f" (SELECT doc_id, line_no, {_NORMAL.replace('(l,', '(content,')} AS line FROM parts) WHERE line <> '')"
)
def normalize_ocr_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kana_docs(spark, sf_dir).select("doc_id", F.posexplode(T.normalize_ocr_lines(F.col("text"))).alias("line_no", "line"))


ECHOES = ["thndor", "ing the", "eauçé", "transcribe"]


@query(
    f"WITH {KANA}, {LINES} SELECT doc_id, line_no::INT AS line_no, content FROM parts WHERE NOT list_has_any([true], list_transform({ECHOES}, lambda k: contains(lower(content), k)))"
)
def echo_line_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = split_lines(spark, sf_dir).drop("ending")
    return rows.where(~T.echoes(F.col("content"), F.array(*map(F.lit, ECHOES))))


@query(
    f"WITH {KANA}, {LINES} SELECT doc_id, line_no::INT AS line_no, content FROM (SELECT *, lag(content) OVER (PARTITION BY doc_id ORDER BY line_no) AS b FROM parts) WHERE b IS DISTINCT FROM content"
)
def drop_consecutive_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ferrytext.operators.cleanup import drop_consecutive_duplicates as drop

    return drop(split_lines(spark, sf_dir).drop("ending"), ["doc_id"], "line_no", "content")


@query(
    f"WITH {KANA}, {LINES}, s AS (SELECT doc_id, line_no, content, ' ' || right(content, 1) || chr(9) AS mark FROM parts) SELECT doc_id, line_no::INT AS line_no, "
    + ", ".join(STRIP(t) + r" = '' OR regexp_matches(" + STRIP(t) + r", '\A[\x00-\x7f]\z') AS " + name for t, name in (("content", "noise"), ("mark", "mark_noise")))
    + " FROM s"
)
def is_noise_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole lines, and beside them their last characters between white space, as texts of one character."""
    mark = F.concat(F.lit(" "), F.right("content", F.lit(1)), F.lit("\t"))
    return split_lines(spark, sf_dir).select("doc_id", "line_no", T.is_noise_text(F.col("content")).alias("noise"), T.is_noise_text(mark).alias("mark_noise"))


@query(f"SELECT doc_id, CASE WHEN len(c) > 300 THEN left(c, 300) || chr(10) || '[…]' ELSE c END AS clipped FROM (SELECT doc_id, {STRIP('text')} AS c FROM documents)")
def clip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", T.clip(F.col("text"), 300).alias("clipped"))


@query("SELECT page_id, replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') AS escaped FROM pages")
def escape_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", T.escape_text(F.col("html")).alias("escaped"))


@query(
    f"WITH {LAYOUT} SELECT doc_id, unit_idx, '[style=' || CASE WHEN doc_id % 4 = 0 THEN 'literal' ELSE 'colloquial' END || '] Translate into zh.' || chr(10)"
    " || CASE WHEN context <> '' THEN 'Context:' || chr(10) || context || chr(10) ELSE '' END || unit AS prompt FROM"
    " (SELECT *, coalesce(lag(unit) OVER (PARTITION BY doc_id ORDER BY unit_idx), '') AS context FROM units)"
)
def build_prompt(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ferrytext.operators.prompts import build_prompt as build
    from pyspark.sql import Window

    rows = U.units(kana_docs(spark, sf_dir))
    before = F.coalesce(F.lag("unit").over(Window.partitionBy("doc_id").orderBy("unit_idx")), F.lit(""))
    style = F.when(F.col("doc_id") % 4 == 0, F.lit("literal")).otherwise(F.lit("colloquial"))
    return rows.withColumn("context", before).select("doc_id", "unit_idx", build(F.col("unit"), F.col("context"), style, "zh").alias("prompt"))


@query(
    """SELECT doc_id, 'm1' AS model, false AS stream, least(1.0, greatest(0.0, (doc_id % 5) / 2.0 - 0.5))::DOUBLE AS temperature,
    2::BIGINT AS n_messages, 'user' AS last_role, text AS last_content FROM documents"""
)
def request_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ferrytext.operators.prompts import request_json as build

    body = build("m1", F.lit("You translate."), F.col("text"), (F.col("doc_id") % 5) / 2.0 - 0.5)
    schema = "model string, stream boolean, messages array<struct<role:string,content:string>>, options struct<temperature:double>"
    return table(spark, sf_dir, "documents").select("doc_id", F.from_json(body, schema).alias("x")).select(
        "doc_id", "x.model", "x.stream", "x.options.temperature", F.size("x.messages").cast("long").alias("n_messages"),
        F.col("x.messages")[1]["role"].alias("last_role"), F.col("x.messages")[1]["content"].alias("last_content"),
    )


@query(
    f"""SELECT doc_id, CASE doc_id % 5 WHEN 2 THEN 'failed' WHEN 3 THEN 'failed' WHEN 4 THEN 'failed' ELSE CASE WHEN t = '' THEN 'failed' ELSE 'ok' END END AS status,
    CASE WHEN doc_id % 5 < 2 AND t <> '' THEN t END AS answer,
    CASE doc_id % 5 WHEN 2 THEN 'no model' WHEN 3 THEN 'empty: length' WHEN 4 THEN 'not JSON' ELSE CASE WHEN t = '' THEN 'empty: ' END END AS error
    FROM (SELECT doc_id, {STRIP("text")} AS t FROM documents)"""
)
def parse_response(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ferrytext.operators.prompts import parse_response as parse

    t, kind = F.col("text"), F.col("doc_id") % 5
    body = (
        F.when(kind == 0, F.to_json(F.struct(F.struct(t.alias("content")).alias("message"))))
        .when(kind == 1, F.to_json(F.struct(t.alias("response"))))
        .when(kind == 2, F.lit('{"error": "no model"}'))
        .when(kind == 3, F.lit('{"message": {"content": " "}, "done_reason": "length"}'))
        .otherwise(F.lit("{broken"))
    )
    return table(spark, sf_dir, "documents").select("doc_id", parse(body).alias("x")).select("doc_id", "x.*")


@query("SELECT doc_id, hex(encode(chr(65279) || text)) AS data, source || '/' || doc_id || '_zh.txt' AS path FROM documents")
def write_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ferrytext.sources.writers import document_bytes

    path = T.output_name(F.concat("source", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt")))
    return table(spark, sf_dir, "documents").select("doc_id", F.hex(document_bytes(F.col("text"))).alias("data"), path.alias("path"))


@query("SELECT doc_id, text, 'utf-8' AS encoding, NULL::VARCHAR AS error FROM documents")
def decode_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ferrytext.sources.decoding import decode_text as decode

    rows = table(spark, sf_dir, "documents").select("doc_id", F.col("text").cast("binary").alias("content"))
    return decode(rows).drop("content").select("doc_id", "text", "encoding", "error")
