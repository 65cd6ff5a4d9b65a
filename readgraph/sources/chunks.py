"""A sink for texts with lines longer than a row: rows are written after each other, without anything between them."""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import Row
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import StructType


@dataclass
class Part(WriterCommitMessage):
    """A file that a task has written, and the name it gets in the end."""

    written: str
    name: str


class ChunkWriter(DataSourceWriter):
    """Each attempt of a task writes a file of its own; the folder gets those of the attempts that count, at the end."""

    def __init__(self, path: str, overwrite: bool):
        self.path, self.overwrite, self.job = path if ":/" in path else os.path.abspath(path), overwrite, uuid.uuid4().hex

    def _place(self) -> tuple[fs.FileSystem, str, str]:
        files, root = fs.FileSystem.from_uri(self.path)
        return files, root, f"{root}/_temporary-{self.job}"

    def write(self, iterator: Iterator[Row]) -> Part | None:
        files, _, temporary = self._place()
        task, out, written = TaskContext.get(), None, ""
        for row in iterator:
            if out is None:
                written = f"{temporary}/{task.taskAttemptId()}"
                files.create_dir(temporary, recursive=True)
                out = files.open_output_stream(written)
            out.write((row[0] or "").encode())
        if out is None:
            return None
        out.close()
        return Part(written, f"part-{task.partitionId():06d}")

    def commit(self, messages: list[Part | None]) -> None:
        files, root, temporary = self._place()
        files.create_dir(root, recursive=True)
        for old in files.get_file_info(fs.FileSelector(root)) if self.overwrite else []:
            if old.base_name.startswith("part-") or old.base_name == "_SUCCESS":
                files.delete_dir(old.path) if old.type == fs.FileType.Directory else files.delete_file(old.path)
        prefix = "" if self.overwrite else f"-{self.job}"
        for part in filter(None, messages):
            files.move(part.written, f"{root}/{part.name}{prefix}")
        self.abort(messages)
        with files.open_output_stream(f"{root}/_SUCCESS"):
            pass

    def abort(self, messages: list[Part | None]) -> None:
        files, _, temporary = self._place()
        if files.get_file_info(temporary).type == fs.FileType.Directory:
            files.delete_dir(temporary)


class ChunkSource(DataSource):
    """``df.write.format("text_chunks")``: a column of text into the folder ``path``, on a file system that pyarrow opens and all executors share."""

    @classmethod
    def name(cls) -> str:
        return "text_chunks"

    def writer(self, schema: StructType, overwrite: bool) -> ChunkWriter:
        if [f.dataType.typeName() for f in schema.fields] != ["string"]:
            raise ValueError("one column of text is written")
        return ChunkWriter(self.options["path"], overwrite)
