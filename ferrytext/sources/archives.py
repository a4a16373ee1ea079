"""Archives and files as tables, and books packed again."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ferrytext.functions.text import extension
from ferrytext.operators.archives import IMAGE, MAX_BYTES, MAX_FILES, TEXT

MEMBERS = "archive_id long, ordinal int, name string, size long, is_dir boolean, content binary, error string"


def read_files(spark: SparkSession, path: str, extensions: tuple[str, ...]) -> DataFrame:
    """(path, length, modificationTime, content) of the files under a folder with one of the extensions."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return files.where(extension(F.col("path")).isin(*extensions))


def read_text_files(spark: SparkSession, path: str) -> DataFrame:
    return read_files(spark, path, TEXT)


def read_page_images(spark: SparkSession, path: str) -> DataFrame:
    """(origin, height, width, channels, rgb): pictures as the JVM reads them, broken ones left out; rows of BGR bytes
    become RGB."""
    images = spark.read.format("image").option("dropInvalid", True).load(path).select("image.*")
    images = images.where(extension(F.col("origin")).isin(*IMAGE))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        for batch in batches:
            rgb = []
            for data, n in zip(batch.column("data").to_pylist(), batch.column("nChannels").to_pylist()):
                pixels = np.frombuffer(data, np.uint8).reshape(-1, n)
                rgb.append((pixels[:, 2::-1] if n >= 3 else np.repeat(pixels, 3, axis=1)).tobytes())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("origin", "height", "width")), pa.array(rgb, pa.binary())], ["origin", "height", "width", "rgb"])

    return images.mapInArrow(run, "origin string, height int, width int, rgb binary")


def read_archive_members(archives: DataFrame, max_files: int = MAX_FILES, max_bytes: int = MAX_BYTES) -> DataFrame:
    """A row per member of zip archives (archive_id, content). Declared counts and sizes are checked before anything is
    unpacked, and what is unpacked never exceeds what was declared; a broken or too large archive is one row with an
    error. A zip can't be split, so an archive is one task's work, member by member."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = (pa.int64(), pa.int32(), pa.string(), pa.int64(), pa.bool_(), pa.binary(), pa.string())
        names = ["archive_id", "ordinal", "name", "size", "is_dir", "content", "error"]
        row = lambda *x: pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(x, types)], names)
        for batch in batches:
            for key, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                try:
                    with zipfile.ZipFile(io.BytesIO(content)) as z:
                        infos = z.infolist()
                        if len(infos) > max_files or sum(i.file_size for i in infos) > max_bytes:
                            raise ValueError("over the quota")
                        for n, info in enumerate(infos):
                            with z.open(info) as f:
                                yield row(key, n, info.filename, info.file_size, info.is_dir(), f.read(info.file_size), None)
                except (zipfile.BadZipFile, ValueError, NotImplementedError, RuntimeError) as e:
                    yield row(key, None, None, None, None, None, str(e))

    return archives.select(F.col("archive_id").cast("long"), "content").mapInArrow(run, MEMBERS)


def repack_book(members: DataFrame) -> DataFrame:
    """(book_id, content): members (book_id, ordinal, name, is_dir, content, replaced) zipped in their order: ``mimetype``
    stored in its place, replaced ones deflated, directories left out. A book is one task's work."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w") as z:
            for m in group.sort_values("ordinal").itertuples(index=False):
                if not m.is_dir:
                    kind = zipfile.ZIP_STORED if m.name == "mimetype" else zipfile.ZIP_DEFLATED
                    z.writestr(zipfile.ZipInfo(m.name), bytes(m.content), kind)
        return pd.DataFrame({"book_id": [group["book_id"].iloc[0]], "content": [out.getvalue()]})

    return members.groupBy("book_id").applyInPandas(run, "book_id long, content binary")
