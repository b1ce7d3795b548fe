"""Archives as a data source: one file an author, named by it, a JSON line a publication.

Tasks write into folders of their own beneath a staging folder; when all are done the driver moves the files to their
names and takes away those of authors who are no more. A task that fails or runs twice leaves nothing in the archive.
Names go by percent signs where an author has a slash or a percent sign.
"""

from __future__ import annotations

import posixpath
import uuid
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

#: Bytes of files that a task reads.
READ_BYTES = 32 << 20
#: Bytes that are written at once.
WRITE_BYTES = 1 << 20
LINES = "author string, line string"
ENDING = ".jsonl"


def file_name(author: str) -> str:
    return author.replace("%", "%25").replace("/", "%2F") + ENDING


def author_of(path: str) -> str:
    return posixpath.basename(path).removesuffix(ENDING).replace("%2F", "/").replace("%25", "%")


def _place(folder: str) -> tuple[fs.FileSystem, str]:
    system, path = fs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (fs.LocalFileSystem(), folder)
    return system, path.rstrip("/")


@dataclass
class Written(WriterCommitMessage):
    files: list[str]


@dataclass
class Files(InputPartition):
    paths: list[str]

    def __init__(self, paths: list[str]) -> None:
        super().__init__(paths)
        self.paths = paths


class ArchiveWriter(DataSourceArrowWriter):
    """Rows of author and line, those of an author one behind the other in one task."""

    def __init__(self, folder: str, overwrite: bool) -> None:
        self.folder, self.overwrite = folder, overwrite
        self.staging = f"_staging-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        system, path = _place(self.folder)
        mine = f"{path}/{self.staging}/{uuid.uuid4().hex}"
        system.create_dir(mine, recursive=True)
        files: list[str] = []
        out, now, held = None, None, bytearray()

        def closed() -> None:
            if out is not None:
                out.write(bytes(held))
                held.clear()
                out.close()

        try:
            for batch in iterator:
                for author, line in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    if author is None or author == "":
                        raise ValueError("a publication has no author to name its file by")
                    if author != now:
                        closed()
                        now = author
                        files.append(f"{mine}/{file_name(author)}")
                        out = system.open_output_stream(files[-1])
                    held += line.encode() + b"\n"
                    if len(held) > WRITE_BYTES:
                        out.write(bytes(held))
                        held.clear()
        finally:
            closed()
        return Written(files)

    def commit(self, messages: list[Written | None]) -> None:
        system, path = _place(self.folder)
        system.create_dir(path, recursive=True)
        files = [f for m in messages if m is not None for f in m.files]
        names = [posixpath.basename(f) for f in files]
        if len(set(names)) < len(names):
            self.abort(messages)
            raise ValueError("an author's publications came from two tasks")
        gone = set()
        if self.overwrite:
            gone = {f.base_name for f in system.get_file_info(fs.FileSelector(path)) if f.type == fs.FileType.File and f.base_name.endswith(ENDING)} - set(names)
        for f, name in zip(files, names, strict=True):
            system.move(f, f"{path}/{name}")
        for name in gone:
            system.delete_file(f"{path}/{name}")
        self._clear(system, path)

    def abort(self, messages: list[Written | None]) -> None:
        self._clear(*_place(self.folder))

    def _clear(self, system: fs.FileSystem, path: str) -> None:
        if system.get_file_info(f"{path}/{self.staging}").type == fs.FileType.Directory:
            system.delete_dir(f"{path}/{self.staging}")


class ArchiveReader(DataSourceReader):
    def __init__(self, folder: str) -> None:
        self.folder = folder

    def partitions(self) -> Sequence[Files]:
        system, path = _place(self.folder)
        found = [f for f in system.get_file_info(fs.FileSelector(path)) if f.type == fs.FileType.File and f.base_name.endswith(ENDING)]
        made: list[Files] = []
        held: list[str] = []
        size = 0
        for f in sorted(found, key=lambda f: f.path):
            held.append(f.path)
            size += f.size
            if size >= READ_BYTES:
                made.append(Files(held))
                held, size = [], 0
        return [*made, Files(held)] if held or not made else made

    def read(self, partition: Files) -> Iterator[tuple[str, str]]:
        system, _ = _place(self.folder)
        for path in partition.paths:
            author, rest = author_of(path), b""
            with system.open_input_stream(path) as f:
                while part := f.read(WRITE_BYTES):
                    *lines, rest = (rest + part).split(b"\n")
                    yield from ((author, x.decode()) for x in lines if x)
            if rest:
                yield author, rest.decode()


class Archives(DataSource):
    """``spark.read.format("archives").load(folder)`` and ``df.write.format("archives").save(folder)``: author and line."""

    @classmethod
    def name(cls) -> str:
        return "archives"

    def schema(self) -> str:
        return LINES

    def reader(self, schema: StructType) -> ArchiveReader:
        return ArchiveReader(self.options["path"])

    def writer(self, schema: StructType, overwrite: bool) -> ArchiveWriter:
        if [f.name for f in schema] != ["author", "line"]:
            raise ValueError("archives are written from author and line")
        return ArchiveWriter(self.options["path"], overwrite)
