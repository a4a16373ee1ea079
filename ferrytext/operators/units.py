"""Documents to translation units and back. One exchange on doc_id serves numbering, context and rebuilding."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ferrytext.functions.text import MAX_CHARS, has_japanese, pack_sentences, py_strip, split_lines


def layout_pieces(text: Column, max_chars: int = MAX_CHARS) -> Column:
    """Array of (kind, piece): the chunks of lines in the script are units, other lines and line endings literals."""
    literal = lambda c: F.struct(F.lit("literal").alias("kind"), c.alias("piece"))

    def pieces(line: Column) -> Column:
        content = line["content"]
        chunks = F.transform(pack_sentences(content, max_chars), lambda x: F.struct(F.lit("unit").alias("kind"), x.alias("piece")))
        body = F.when(has_japanese(content) & (py_strip(content) != ""), chunks).otherwise(F.array(literal(content)))
        return F.when(line["ending"] != "", F.concat(body, F.array(literal(line["ending"])))).otherwise(body)

    return F.flatten(F.transform(split_lines(text), pieces))


def build_units(docs: DataFrame, max_chars: int = MAX_CHARS) -> DataFrame:
    """(doc_id, pos, kind, unit_idx, piece): the layout of every document; unit_idx counts its units from 0."""
    rows = docs.select("doc_id", F.posexplode(layout_pieces(F.col("text"), max_chars)).alias("pos", "x")).select("doc_id", "pos", "x.*")
    nth = F.sum(F.when(F.col("kind") == "unit", 1)).over(Window.partitionBy("doc_id").orderBy("pos")) - 1
    return rows.select("doc_id", "pos", "kind", F.when(F.col("kind") == "unit", nth).cast("int").alias("unit_idx"), "piece")


def units(docs: DataFrame, max_chars: int = MAX_CHARS) -> DataFrame:
    """(doc_id, unit_idx, unit), numbered inside the row: no shuffle."""
    kept = F.filter(layout_pieces(F.col("text"), max_chars), lambda x: x["kind"] == "unit")
    return docs.select("doc_id", F.posexplode(kept).alias("unit_idx", "x")).select("doc_id", "unit_idx", F.col("x.piece").alias("unit"))


def restore_document(layout: DataFrame, translations: DataFrame) -> DataFrame:
    """(doc_id, text): each unit of the layout replaced by its translation (doc_id, unit_idx, translation), in order."""
    joined = layout.join(translations, ["doc_id", "unit_idx"], "left")
    piece = F.struct("pos", F.coalesce("translation", "piece").alias("piece"))
    ordered = F.transform(F.array_sort(F.collect_list(piece)), lambda x: x["piece"])
    return joined.groupBy("doc_id").agg(F.array_join(ordered, "").alias("text"))


def unit_index(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Adds unit_idx: consecutive numbers from 0 over ``order`` within ``keys``."""
    return rows.withColumn("unit_idx", (F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1).cast("int"))


def batch_units(rows: DataFrame, n: int = 8) -> DataFrame:
    return rows.withColumn("batch", F.floor(F.col("unit_idx") / n).cast("int"))


def _batches(translations: DataFrame, batch: int, last: int | None = None) -> DataFrame:
    """(doc_id, batch, parts): a batch's translations in order, all or the last few."""
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("unit_idx", "translation"))), lambda x: x["translation"])
    rows = batch_units(translations, batch).groupBy("doc_id", "batch").agg(ordered.alias("parts"))
    return rows if last is None else rows.withColumn("parts", F.slice("parts", -F.least(F.lit(last), F.size("parts")), F.lit(last)))


def rolling_context(translations: DataFrame, batch: int = 8, k: int = 4, chars: int = 1800) -> DataFrame:
    """(doc_id, batch, context): per batch the last k translations before it, joined by line breaks, last ``chars``
    characters; empty where k or chars is not over 0. A window over batches, of which k units' worth are looked at."""
    if k <= 0 or chars <= 0:
        return batch_units(translations, batch).select("doc_id", "batch", F.lit("").alias("context")).distinct()
    over = Window.partitionBy("doc_id").orderBy("batch").rowsBetween(-(-(-k // batch)), -1)
    before = F.flatten(F.collect_list("parts").over(over))
    joined = F.array_join(F.slice(before, F.greatest(F.lit(1), F.size(before) - k + 1), F.lit(k)), "\n")
    return _batches(translations, batch, k).select("doc_id", "batch", F.right(joined, F.lit(chars)).alias("context"))


def page_context(translations: DataFrame, batch: int = 8, chars: int = 1800) -> DataFrame:
    """(doc_id, batch, context) as pages keep it: a line break and the batch are added each time, and the last
    ``chars`` characters stay. A window over batches, of which only as many are looked at as ``chars`` can hold, as each
    unit adds its break."""
    text = F.right(F.concat(F.lit("\n"), F.array_join("parts", "\n")), F.lit(chars))
    over = Window.partitionBy("doc_id").orderBy("batch").rowsBetween(-(-(-chars // batch)), -1)
    before = F.array_join(F.collect_list("text").over(over), "")
    return _batches(translations, batch).withColumn("text", text).select("doc_id", "batch", F.right(before, F.lit(chars)).alias("context"))


def unit_progress(units_: DataFrame, batch: int = 8) -> DataFrame:
    """(doc_id, batch, percent): completed units in percent at the end of every batch."""
    total = F.count("*").over(Window.partitionBy("doc_id"))
    rows = batch_units(units_.withColumn("total", total), batch)
    return rows.groupBy("doc_id", "batch", "total").agg(F.max("unit_idx").alias("last")).select(
        "doc_id", "batch", F.expr("(last + 1) * 100 div total").alias("percent")
    )


def document_report(docs: DataFrame, layout: DataFrame, encoding: str = "utf-8") -> DataFrame:
    """(doc_id, segments, characters, encoding)."""
    counted = layout.groupBy("doc_id").agg(F.count_if(F.col("kind") == "unit").alias("segments"))
    return docs.join(counted, "doc_id", "left").select(
        "doc_id", F.coalesce("segments", F.lit(0)).alias("segments"), F.length("text").cast("long").alias("characters"), F.lit(encoding).alias("encoding")
    )


Translator = Callable[..., list[str]]


def echo(texts: list[str], *, context: str) -> list[str]:
    return list(texts)


def prefix(mark: str) -> Translator:
    """A translator that puts a mark before every text."""

    def translate(texts: list[str], *, context: str) -> list[str]:
        return [mark + t for t in texts]

    return translate


def tail(texts: list[str], *, context: str) -> list[str]:
    """Puts the context's last two characters before every text: what it gives shows what it was given."""
    return [f"{context[-2:]}>{t}" for t in texts]


#: Translators by provider; callers add their own.
REGISTRY: dict[str, Callable[[], Translator]] = {"echo": lambda: echo, "prefix": lambda: prefix("译:"), "tail": lambda: tail}


def translator(provider: str) -> Translator:
    if provider not in REGISTRY:
        raise ValueError(f"unknown translator: {provider}")
    return REGISTRY[provider]()


def in_turn(texts: list[str], translate: Translator, batch: int, context: Callable[[list[str]], str]) -> list[str]:
    """Translations of a sequence of texts, batch by batch; ``context`` makes each batch's from all that are done."""
    done: list[str] = []
    for at in range(0, len(texts), batch):
        got = translate(texts[at : at + batch], context=context(done))
        if len(got) != len(texts[at : at + batch]):
            raise ValueError("a translator returns as many texts as it gets")
        done += got
    return done


def last_translations(k: int, chars: int) -> Callable[[list[str]], str]:
    return lambda done: "\n".join(done[-k:])[-chars:] if k > 0 and chars > 0 else ""


def grown(chars: int) -> Callable[[list[str]], str]:
    """Every translation behind a line break, of which the last ``chars`` characters are looked at."""

    def context(done: list[str]) -> str:
        held, out = 0, []
        for text in reversed(done):
            out.append("\n" + text)
            held += len(text) + 1
            if held >= chars:
                break
        return "".join(reversed(out))[-chars:] if chars > 0 else ""

    return context


def _sequences(rows: DataFrame, key: str, translate: Translator, batch: int, context: Callable[[list[str]], str]) -> DataFrame:
    """Units grouped by ``key`` and translated in order: one exchange, and many groups in an Arrow batch."""
    groups = rows.groupBy(F.col(key).cast("long").alias(key)).agg(F.array_sort(F.collect_list(F.struct("unit_idx", "unit"))).alias("units"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for found in batches:
            for name, units_ in zip(found.column(0), found.column(1)):
                numbers, texts = (units_.values.field(i) for i in range(2))
                done = in_turn(texts.to_pylist(), translate, batch, context)
                names = pa.array([name.as_py()] * len(done), pa.int64())
                yield pa.RecordBatch.from_arrays([names, numbers, pa.array(done, pa.string())], [key, "unit_idx", "translation"])

    return groups.mapInArrow(run, f"{key} long, unit_idx int, translation string")


def translate_units(rows: DataFrame, translate: Translator, *, key: str = "doc_id", batch: int = 8, k: int = 4, chars: int = 1800) -> DataFrame:
    """(key, unit_idx, translation): each document's units in order, batch by batch, with the last k translations as
    context. A document is one task's sequence, as every batch needs the results of the one before."""
    return _sequences(rows, key, translate, batch, last_translations(k, chars))


def translate_regions(rows: DataFrame, translate: Translator, *, batch: int = 8, chars: int = 1800) -> DataFrame:
    """(page_id, unit_idx, translation): as ``translate_units`` with a context that begins anew on each page and grows
    by whole batches."""
    return _sequences(rows, "page_id", translate, batch, grown(chars))


#: Documents whose pieces are Python objects at one time.
_ROWS = 64


def localized(docs: DataFrame, translate: Translator, *, max_chars: int = MAX_CHARS, batch: int = 8, k: int = 4, chars: int = 1800) -> DataFrame:
    """(doc_id, text, segments, characters): documents with their units translated in order. A document's layout stays in
    its row, so nothing is shuffled."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.length("text").cast("long").alias("characters"), layout_pieces(F.col("text"), max_chars).alias("x"))
    rows = rows.select("doc_id", "characters", F.col("x.kind").alias("kinds"), F.col("x.piece").alias("pieces"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for found in (batch.slice(at, _ROWS) for batch in batches for at in range(0, batch.num_rows, _ROWS)):
            texts, segments = [], []
            for kinds, pieces in zip(found.column("kinds").to_pylist(), found.column("pieces").to_pylist()):
                at = [i for i, kind in enumerate(kinds or []) if kind == "unit"]
                for i, done in zip(at, in_turn([pieces[i] for i in at], translate, batch, last_translations(k, chars))):
                    pieces[i] = done
                texts.append("".join(pieces or []))
                segments.append(len(at))
            columns = [found.column("doc_id"), pa.array(texts, pa.string()), pa.array(segments, pa.int64()), found.column("characters")]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "text", "segments", "characters"])

    return rows.mapInArrow(run, "doc_id long, text string, segments long, characters long")


def translate_free(rows: DataFrame, translate: Translator, *, batch: int = 256) -> DataFrame:
    """``rows`` with ``translation``, without context: no shuffle, any number of tasks per document."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            done: list[str] = []
            for at in range(0, len(frame), batch):
                done += translate(frame["unit"].iloc[at : at + batch].tolist(), context="")
            yield frame.assign(translation=done)

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields)
    return rows.mapInPandas(run, f"{fields}, translation string")
