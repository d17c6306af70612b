"""Files of given names, one a key, written by many tasks and made visible by one commit.

Rows are dealt by name, so that each file is written from one end to the other by one task, as a stream; a task may write many.
Files are written to a draft folder first. When all tasks have ended the driver moves them to their names; if the job
fails it deletes the draft, and nothing is left.
"""

from __future__ import annotations

import posixpath
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import unquote, urlparse

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage


def file_system(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI, and the path in it."""
    parsed = urlparse(path)
    if parsed.scheme in ("", "file"):
        return fs.LocalFileSystem(), unquote(parsed.path) if parsed.scheme else path
    return fs.FileSystem.from_uri(path)


@dataclass
class Written(WriterCommitMessage):
    files: list[tuple[str, str]]


class NamedFilesWriter(DataSourceArrowWriter):
    """Writes rows of (name, content), in order of names, to a file each."""

    def __init__(self, folder: str, head: bytes):
        self.folder, self.head = folder, head
        self.draft = f"{folder.rstrip('/')}/_draft-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        files, draft = file_system(self.draft)
        task = TaskContext.get()
        own = f"{draft}/{task.partitionId()}-{task.taskAttemptId()}"
        files.create_dir(own, recursive=True)
        done, out, now = [], None, None
        try:
            for batch in iterator:
                for name, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    if name != now:
                        if not name or posixpath.basename(name) != name or name.startswith("_"):
                            raise ValueError(f"not a file name: {name!r}")
                        if out:
                            out.close()
                        now = name
                        out = files.open_output_stream(f"{own}/{len(done)}")
                        done.append((f"{own}/{len(done)}", name))
                        out.write(self.head)
                    out.write(content or b"")
        finally:
            if out:
                out.close()
        return Written(done)

    def commit(self, messages: list[Written | None]) -> None:
        files, folder = file_system(self.folder)
        moves = [move for m in messages if m for move in m.files]
        names = [name for _, name in moves]
        if len(names) != len(set(names)):
            self.abort(messages)
            raise ValueError("a name was written by more than one task")
        for path, name in moves:
            files.move(path, f"{folder}/{name}")
        self.abort(messages)

    def abort(self, messages: list[Written | None]) -> None:
        files, draft = file_system(self.draft)
        if files.get_file_info(draft).type != fs.FileType.NotFound:
            files.delete_dir(draft)


class NamedFiles(DataSource):
    """The format ``named_files``: option path is the folder, option head what every file begins with."""

    @classmethod
    def name(cls) -> str:
        return "named_files"

    def schema(self) -> str:
        return "name string, content binary"

    def writer(self, schema, overwrite: bool) -> NamedFilesWriter:
        return NamedFilesWriter(self.options["path"], self.options.get("head", "").encode())


def write_contents(df: DataFrame, folder: str, order: list[str] | None = None, head: str = "") -> None:
    """Write name and content (bytes) of ``df``: the contents of each name one after another, by ``order``, after ``head``."""
    spark: SparkSession = df.sparkSession
    spark.dataSource.register(NamedFiles)
    order = order or []
    ready = df.repartition("name").sortWithinPartitions("name", *order).select("name", "content")
    ready.write.format("named_files").mode("append").option("head", head).save(folder)


def write_csv(df: DataFrame, folder: str, name: str, order: list[str], columns: list[str], header: bool = True) -> None:
    """A CSV file of ``columns`` for each value of ``name``, with its rows by ``order``."""
    line = F.concat(F.to_csv(F.struct(*columns)), F.lit("\n"))
    keyed = df.select(F.col(name).alias("name"), line.cast("binary").alias("content"), *(F.col(c).alias(f"order_{i}") for i, c in enumerate(order)))
    write_contents(keyed, folder, [f"order_{i}" for i in range(len(order))], ",".join(columns) + "\n" if header else "")
