"""Archives as a data source: df.write.format("quarry_archive").save(folder), and spark.read.format("quarry_archive").

Rows are files (name, content). Tasks write zip parts of bounded size to a folder of their run, and each an index of its
parts. The commit names the run in the manifest, whose replacement publishes all of it at once; readers see what the manifest
names. A task that fails or is lost leaves files that no index names; an abort removes the run's folder. Nothing but
the names of indexes goes through the driver.
"""

from __future__ import annotations

import io
import json
import uuid
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

#: Bytes of content at which a part is closed, and those of a batch that is read.
PART_BYTES, BATCH_BYTES = 64 << 20, 8 << 20
MANIFEST = "manifest.json"
#: Fixed time of all entries, so that the same files give the same bytes.
WHEN = (2023, 12, 25, 0, 0, 0)


def _open(folder: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(folder if "://" in folder or not folder.startswith("file:") else "file://" + folder[5:])


def _read(files: fs.FileSystem, path: str) -> list:
    with files.open_input_stream(path) as source:
        return json.loads(source.read())


def _write(files: fs.FileSystem, path: str, value: list) -> None:
    """All of the file or nothing."""
    own = f"{path}.{uuid.uuid4().hex}"
    with files.open_output_stream(own, compression=None) as sink:
        sink.write(json.dumps(value).encode())
    files.move(own, path)


def _runs(files: fs.FileSystem, base: str) -> list[list]:
    """(run, indexes) of each published run."""
    path = f"{base}/{MANIFEST}"
    return _read(files, path) if files.get_file_info(path).type == fs.FileType.File else []


@dataclass
class Index(WriterCommitMessage):
    name: str | None


class ArchiveWriter(DataSourceArrowWriter):
    def __init__(self, folder: str, overwrite: bool, part_bytes: int):
        self.folder, self.overwrite, self.part_bytes, self.run = folder, overwrite, part_bytes, f"run-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Index:
        files, base = _open(self.folder)
        parts, sink, out = [], None, None
        for batch in iterator:
            for name, content in zip(batch.column("name").to_pylist(), batch.column("content").to_pylist()):
                if content is None:
                    continue
                if name is None:
                    raise ValueError("a file of an archive has no name")
                if out is None:
                    files.create_dir(f"{base}/{self.run}", recursive=True)
                    parts.append({"part": f"{self.run}/part-{uuid.uuid4().hex}.zip", "entries": 0, "bytes": 0})
                    sink = files.open_output_stream(f"{base}/{parts[-1]['part']}", compression=None)
                    out = zipfile.ZipFile(sink, "w", zipfile.ZIP_DEFLATED)
                out.writestr(zipfile.ZipInfo(name, WHEN), content, zipfile.ZIP_DEFLATED)
                parts[-1]["entries"] += 1
                parts[-1]["bytes"] += len(content)
                if parts[-1]["bytes"] >= self.part_bytes:
                    out.close()
                    sink.close()
                    out = None
        if out is not None:
            out.close()
            sink.close()
        if not parts:
            return Index(None)
        name = f"{self.run}/index-{uuid.uuid4().hex}.json"
        _write(files, f"{base}/{name}", parts)
        return Index(name)

    def commit(self, messages: list) -> None:
        files, base = _open(self.folder)
        files.create_dir(base, recursive=True)
        before = _runs(files, base)
        own = [[self.run, [m.name for m in messages if m and m.name]]]
        _write(files, f"{base}/{MANIFEST}", own if self.overwrite else before + own)
        if self.overwrite:
            for run, indexes in before:
                if indexes:
                    files.delete_dir(f"{base}/{run}")

    def abort(self, messages: list) -> None:
        files, base = _open(self.folder)
        if files.get_file_info(f"{base}/{self.run}").type == fs.FileType.Directory:
            files.delete_dir(f"{base}/{self.run}")


class Part(InputPartition):
    def __init__(self, index: str):
        super().__init__(index)


class ArchiveReader(DataSourceReader):
    def __init__(self, folder: str):
        self.folder = folder

    def partitions(self) -> list[Part]:
        """One for each index, which is what a task wrote."""
        files, base = _open(self.folder)
        return [Part(name) for _, indexes in _runs(files, base) for name in indexes] or [Part("")]

    def read(self, partition: Part) -> Iterator[pa.RecordBatch]:
        files, base = _open(self.folder)
        for part in _read(files, f"{base}/{partition.value}") if partition.value else ():
            with files.open_input_file(f"{base}/{part['part']}") as source, zipfile.ZipFile(io.BufferedReader(source)) as held:
                names, contents, size = [], [], 0
                for entry in held.infolist():
                    names.append(entry.filename)
                    contents.append(held.read(entry))
                    size += len(contents[-1])
                    if size >= BATCH_BYTES:
                        yield _batch(names, contents)
                        names, contents, size = [], [], 0
                if names:
                    yield _batch(names, contents)


def _batch(names: list[str], contents: list[bytes]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(contents, pa.binary())], names=["name", "content"])


class Archive(DataSource):
    """Options: path; part_bytes (PART_BYTES)."""

    @classmethod
    def name(cls) -> str:
        return "quarry_archive"

    def schema(self) -> str:
        return "name string, content binary"

    def reader(self, schema) -> ArchiveReader:
        return ArchiveReader(self.options["path"])

    def writer(self, schema, overwrite: bool) -> ArchiveWriter:
        return ArchiveWriter(self.options["path"], overwrite, int(self.options.get("part_bytes", PART_BYTES)))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(Archive)
