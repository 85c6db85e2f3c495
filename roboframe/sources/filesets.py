"""Named files as a sink and a source: rows (path, content) become files under a folder, all of them or none, and files
become rows again, many of them to a task. The driver lists the entries of the folder itself only; what lies below them is
listed by the tasks, so very many files belong into folders of some thousand.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import (
    DataSource,
    DataSourceArrowWriter,
    DataSourceReader,
    InputPartition,
    WriterCommitMessage,
)

from .tars import BATCH, TEMPORARY, begin, clear, file_system, note, noted, undo

NAME = "file_set"
ARROW = pa.schema([("path", pa.string()), ("content", pa.binary())])
#: Rows that are handed on at once.
ROWS = 10_000


@dataclass
class Named(WriterCommitMessage):
    """Digests of the names that a task has written, 16 bytes each."""

    digests: bytes


class FileWriter(DataSourceArrowWriter):
    """A task writes the files of a batch beside their places, notes their names, and moves them there. A task that runs again
    replaces what the job has moved; a job that fails is undone by its notes."""

    def __init__(self, path: str):
        self.path = path.rstrip("/")
        self.job = begin(*file_system(self.path))

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Named:
        fs, root = file_system(self.path)
        held, done = f"{root}/{TEMPORARY}/{self.job}", bytearray()
        for batch in iterator:
            names = batch.column("path").to_pylist()
            for n in names:
                if not n or n.startswith("/") or ".." in n.split("/"):
                    raise ValueError(f"not a path below the folder: {n}")
            there = {n for n in names if fs.get_file_info(f"{root}/{n}").type != pafs.FileType.NotFound}
            if there and (there := there - noted(fs, held)):
                raise ValueError(f"{min(there)} is there")
            own = [f"{held}/{uuid.uuid4().hex}" for _ in names]
            for target, content in zip(own, batch.column("content").to_pylist(), strict=True):
                with fs.open_output_stream(target) as out:
                    out.write(content or b"")
            note(fs, held, names)
            for folder in {f"{root}/{n}".rpartition("/")[0] for n in names}:
                fs.create_dir(folder, recursive=True)
            for source, n in zip(own, names, strict=True):
                fs.move(source, f"{root}/{n}")
            done += b"".join(hashlib.blake2b(n.encode(), digest_size=16).digest() for n in names)
        return Named(bytes(done))

    def commit(self, messages: list[Named | None]) -> None:
        digests = np.sort(np.frombuffer(b"".join(m.digests for m in messages if m is not None), "S16"))
        if twice := int((digests[1:] == digests[:-1]).sum()):
            raise ValueError(f"paths come twice: {twice} rows have the path of another")
        clear(*file_system(self.path), self.job)

    def abort(self, messages: list[Named | None]) -> None:
        undo(*file_system(self.path), self.job)


def hidden(path: str) -> bool:
    return path.rpartition("/")[2].startswith((".", "_"))


@dataclass
class Entries(InputPartition):
    """Files, and folders to be listed, right below the folder that is read."""

    files: list[str] = field(default_factory=list)
    folders: list[str] = field(default_factory=list)

    def __post_init__(self):
        InputPartition.__init__(self, None)


class FileReader(DataSourceReader):
    def __init__(self, path: str, tasks: int):
        self.path, self.tasks = path.rstrip("/"), max(tasks, 1)

    def partitions(self) -> list[Entries]:
        fs, root = file_system(self.path)
        found = [x for x in fs.get_file_info(pafs.FileSelector(root, allow_not_found=True)) if not hidden(x.path)]
        out = [Entries() for _ in range(min(self.tasks, len(found)) or 1)]
        for kind, part in ((pafs.FileType.File, "files"), (pafs.FileType.Directory, "folders")):
            for k, path in enumerate(sorted(x.path for x in found if x.type == kind)):
                getattr(out[k % len(out)], part).append(path)
        return out

    def read(self, partition: Entries) -> Iterator[pa.RecordBatch]:
        fs, root = file_system(self.path)
        paths, contents, size = [], [], 0

        def packed() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip((paths, contents), ARROW.types, strict=True)], schema=ARROW)

        def files() -> Iterator[str]:
            yield from partition.files
            todo = partition.folders[::-1]
            while todo:
                found = sorted((x for x in fs.get_file_info(pafs.FileSelector(todo.pop())) if not hidden(x.path)), key=lambda x: x.path)
                yield from (x.path for x in found if x.type == pafs.FileType.File)
                todo += [x.path for x in found if x.type == pafs.FileType.Directory]

        for path in files():
            with fs.open_input_file(path) as f:
                contents.append(f.read())
            paths.append(path.removeprefix(f"{root.rstrip('/')}/"))
            size += len(contents[-1])
            if size >= BATCH or len(paths) >= ROWS:
                yield packed()
                paths, contents, size = [], [], 0
        if paths:
            yield packed()


class FileSet(DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return "path STRING, content BINARY"

    def reader(self, schema) -> FileReader:
        options = {k.lower(): v for k, v in self.options.items()}
        return FileReader(options["path"], int(options.get("tasks", 1)))

    def writer(self, schema, overwrite: bool) -> FileWriter:
        if overwrite or {"path", "content"} - set(schema.names):
            raise ValueError("append rows with path and content")
        return FileWriter(dict(self.options)["path"])


def write_files(rows: DataFrame, root: str) -> None:
    """rows(path, content, ...) -> a file for each row below root; a path that is there, or leads out of root, is an error."""
    rows.sparkSession.dataSource.register(FileSet)
    rows.select("path", rows["content"].cast("binary").alias("content")).write.format(NAME).mode("append").save(root)


def read_files(spark: SparkSession, root: str) -> DataFrame:
    """The files below root -> path (relative to it), content; names that begin with a dot or an underscore are left out, and
    so is what lies in folders of such names. Nothing where there is no folder."""
    spark.dataSource.register(FileSet)
    return spark.read.format(NAME).option("tasks", 4 * spark.sparkContext.defaultParallelism).load(root)
