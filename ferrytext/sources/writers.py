"""Sinks: documents, reports and packages."""

from __future__ import annotations

import io
import struct
import zipfile
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ferrytext.sources.file_sink import write_files

def document_bytes(text: Column) -> Column:
    """UTF-8 with a byte order mark."""
    return F.concat(F.unhex(F.lit("EFBBBF")), F.encode(text, "UTF-8"))


def write_documents(docs: DataFrame, path: str) -> None:
    """A table of (path, content)."""
    docs.select("path", document_bytes(F.col("text")).alias("content")).write.parquet(path)


def write_document_files(docs: DataFrame, path: str, mode: str = "append") -> None:
    """Documents (path, text) as files under a folder, UTF-8 with a byte order mark; a null text is an empty one."""
    write_files(docs.select("path", document_bytes(F.coalesce("text", F.lit(""))).alias("content")), path, mode)


def write_page_images(images: DataFrame, path: str, mode: str = "append") -> None:
    """Pictures (path, height, width, rgb) as BMP files of 24 bits a pixel: rows from the bottom, blue first, filled up to
    multiples of four bytes. A picture is in memory as a whole."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):  # a picture at a time: a batch of them made anew would be held beside its rows
                made = bitmap(*(batch.column(c)[i].as_py() for c in ("rgb", "height", "width")))
                yield pa.RecordBatch.from_arrays([batch.column("path").slice(i, 1), pa.array([made], pa.binary())], ["path", "content"])

    rows = images.select("path", "height", "width", "rgb").mapInArrow(run, "path string, content binary")
    write_files(rows, path, mode)


def bitmap(rgb: bytes, height: int, width: int) -> bytes:
    rows = np.zeros((height, -(-3 * width // 4) * 4), np.uint8)
    rows[:, : 3 * width] = np.frombuffer(rgb, np.uint8).reshape(height, width, 3)[::-1, :, ::-1].reshape(height, 3 * width)
    return struct.pack("<2sIHHIIiiHHIIiiII", b"BM", 54 + rows.size, 0, 0, 54, 40, width, height, 1, 24, 0, rows.size, 2835, 2835, 0, 0) + rows.tobytes()


def report_json(**fields: Column) -> Column:
    return F.to_json(F.struct(*(c.alias(k) for k, c in fields.items())))


def write_packages(files: DataFrame) -> DataFrame:
    """(job_id, package): per job a deflated zip of its files (job_id, nth, name, content) in order of nth. A package is
    one task's work: its files must fit in memory."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
            for name, content in group.sort_values("nth")[["name", "content"]].itertuples(index=False):
                z.writestr(zipfile.ZipInfo(name), bytes(content), zipfile.ZIP_DEFLATED)
        return pd.DataFrame({"job_id": [group["job_id"].iloc[0]], "package": [out.getvalue()]})

    return files.select("job_id", "nth", "name", "content").groupBy("job_id").applyInPandas(run, "job_id long, package binary")
