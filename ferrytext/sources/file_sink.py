"""A sink of files: every row becomes a file, and the files of a job appear together or not at all."""

from __future__ import annotations

import time
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow import RecordBatch, fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage
from pyspark.sql.types import StructType

from ferrytext.functions.text import unsafe_member


def file_system(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI, and the path in it."""
    if path.startswith("file:"):
        path = "/" + path.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


@dataclass
class Written(WriterCommitMessage):
    files: int
    size: int


class FolderWriter(DataSourceArrowWriter):
    """Rows (path, content) as files. A task writes each file aside and moves it to its place in the job's own folder, so
    that a task that is repeated, even while its first attempt still runs, only replaces whole files with the same. The
    commit of the job is the move of that folder to where the result shall be; a job that fails leaves nothing there.
    Tasks that outlive a failed job make no folder again. The file system must be able to move folders; the driver gets
    two numbers a task."""

    def __init__(self, path: str, overwrite: bool) -> None:
        self.path, self.overwrite = path.rstrip("/"), overwrite
        self.staging = f"{self.path}.{uuid.uuid4().hex}"
        store, staging = file_system(self.staging)
        for name in ("attempts", "files"):
            store.create_dir(f"{staging}/{name}")

    def write(self, iterator: Iterator[RecordBatch]) -> Written:
        store, staging = file_system(self.staging)
        task = TaskContext.get()
        aside = f"{staging}/attempts/{task.partitionId()}-{task.taskAttemptId()}"
        store.create_dir(aside, recursive=False)
        made, files, size = set(), 0, 0
        for batch in iterator:
            for path, content in zip(batch.column("path"), batch.column("content")):
                place, data = f"{staging}/files/{path.as_py()}", content.as_buffer()
                with store.open_output_stream(f"{aside}/{files}") as f:
                    f.write(data)
                folders = path.as_py().split("/")[:-1]
                for inner in ("/".join(folders[: n + 1]) for n in range(len(folders))):
                    if inner not in made:
                        store.create_dir(f"{staging}/files/{inner}", recursive=False)
                        made.add(inner)
                store.move(f"{aside}/{files}", place)
                files, size = files + 1, size + data.size
        return Written(files, size)

    def commit(self, messages: list[Written | None]) -> None:
        store, path = file_system(self.path)
        _, staging = file_system(self.staging)
        if store.get_file_info(path).type != fs.FileType.NotFound:
            if not self.overwrite:
                self.abort(messages)
                raise FileExistsError(self.path)
            store.move(path, f"{staging}/before")
        store.move(f"{staging}/files", path)
        store.delete_dir(staging)

    def abort(self, messages: list[Written | None]) -> None:
        store, staging = file_system(self.staging)
        for tries in range(5):
            if store.get_file_info(staging).type == fs.FileType.NotFound:
                return
            try:
                store.delete_dir(staging)
            except OSError:  # a task has just added a file
                time.sleep(tries)


class Folder(DataSource):
    """The format ``folder``; mode append makes a new folder, overwrite also replaces one."""

    @classmethod
    def name(cls) -> str:
        return "folder"

    def writer(self, schema: StructType, overwrite: bool) -> FolderWriter:
        return FolderWriter(self.options["path"], overwrite)


def write_files(files: DataFrame, path: str, mode: str = "append") -> None:
    """The rows (path string, content binary) of ``files`` as files under the folder ``path``. Null content is an empty
    file. Nothing is written, and an error raised, if a path is null, empty, absolute, climbs with ``..`` or ends in a
    slash, or if two rows have one path, which a job of its own over the paths alone finds out first."""
    twice = files.groupBy("path").count().where("count > 1").select("path").first()
    if twice:
        raise ValueError(f"two rows of path {twice[0]}")
    p = F.col("path")
    bad = p.isNull() | (p == "") | unsafe_member(p) | p.rlike(r"(?:\A|/)\.?(?:/|\z)")
    checked = F.when(bad, F.raise_error(F.concat(F.lit("no path of a file: "), F.coalesce(p, F.lit("null")))).cast("string")).otherwise(p)
    files.sparkSession.dataSource.register(Folder)
    rows = files.select(checked.alias("path"), F.coalesce("content", F.lit(b"")).alias("content"))
    rows.write.format("folder").mode(mode).save(path)
