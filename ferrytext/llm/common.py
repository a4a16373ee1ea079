"""What the operators of this subpackage share."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII bytes that are no digit or letter become blanks, A-Z become a-z, bytes over 127 stay:
#: after this, ``split()`` gives the words ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` of the lower-cased text.
ALNUM_TABLE = bytes(
    b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256)
)
#: Lower-cases A-Z only; ``split()`` after it gives the words ``[^\x20\x09-\x0D]+``.
LOWER_TABLE = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def text_rows(docs: DataFrame) -> DataFrame:
    """``doc_id`` and the UTF-8 bytes of ``text`` (null: empty); all other columns are left behind."""
    return docs.select(
        docs["doc_id"].cast("long").alias("doc_id"),
        F.coalesce(docs["text"], F.lit("")).cast("binary").alias("text"),
    )


def fold(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % folds


def slices(batches: Iterator[pa.RecordBatch], max_bytes: int, column: str = "text") -> Iterator[pa.RecordBatch]:
    """The same rows in pieces whose ``column`` holds about ``max_bytes`` at most (one row at least)."""
    for batch in batches:
        sizes = pc.binary_length(batch.column(column)).to_pylist()
        start, held = 0, 0
        for i, n in enumerate(sizes):
            if i > start and held + (n or 0) > max_bytes:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += n or 0
        if start < len(sizes):
            yield batch.slice(start)


_TRIM = getattr(ctypes.CDLL(None), "malloc_trim", None)
_KEPT: list[Any] = [None, None]
_OPERATOR: list[str | None] = [None]


def worker_copy(make: Callable[..., Any], *args: Any) -> Any:
    """``make(*args)``, kept in this Python worker until something else is asked for. A worker serves tasks of one operator
    after the other, so what all of them have built there would add up."""
    if _KEPT[0] != (make, args):
        _KEPT[:] = None, None
        _KEPT[:] = (make, args), make(*args)
    return _KEPT[1]


def tidied(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run``, a function for mapInArrow, after which the worker gives the memory that its task has freed back to the system.
    A worker that comes from another function drops what that one has kept first."""
    operator = f"{run.__module__}.{run.__qualname__}"

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _begin(operator)
        try:
            yield from run(batches)
        finally:
            _give_back()

    return whole


def _begin(operator: str) -> None:
    if _OPERATOR[0] != operator:
        _OPERATOR[0], _KEPT[:] = operator, (None, None)
        _give_back()


def _give_back() -> None:
    pa.default_memory_pool().release_unused()
    if _TRIM:
        _TRIM(0)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; where it is unset, as in tests, a new one, if
    the master is local."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        at = tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", at)
        spark.sparkContext.setCheckpointDir(at)
    return at.rstrip("/")


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as a table in the shared folder and read again: its lineage ends there, and a lost
    executor takes nothing with it. Shuffle files behind it go once it is written."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def dropped(*tables: DataFrame) -> None:
    """Removes tables that ``stored`` has made; all that was made of them must be stored by now."""
    for table in tables:
        jvm, conf = table.sparkSession._jvm, table.sparkSession._jsc.hadoopConfiguration()
        path = jvm.org.apache.hadoop.fs.Path(table.stored_at)
        path.getFileSystem(conf).delete(path, True)
