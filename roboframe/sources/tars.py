"""Tar shards as a Spark data source and sink.

Reading: each partition is a range of bytes of some shards. Files above `splitBytes` are cut between samples, at places
that a walk over their member headers tells; their contents are read by the tasks. `shards` leaves files out before
anything is opened, and `fields` leaves members out before their content is read. (Spark 4.1 can push filters into Python
sources, but keeps what they left for later queries of the same DataFrame, which then lose rows: so these are options.)
Damaged members and shards come out of the same pass as rows with a reason.

Writing: a task streams the members of each shard beside its place, notes its name, moves it there when it is whole, and
tells the driver its name and count; the manifest is made of what the tasks told, once all are done. A task that runs again
replaces what it has moved; a job that fails is undone by the notes of its tasks, killed ones among them, and leaves nothing.

Files are reached through Arrow's file systems: local paths and file:, hdfs:, s3:, gs: and abfs: addresses.
"""

from __future__ import annotations

import bz2
import fnmatch
import gzip
import json
import lzma
import tarfile
import uuid
import zlib
from collections import Counter
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from typing import NamedTuple

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource,
    DataSourceArrowWriter,
    DataSourceReader,
    InputPartition,
    WriterCommitMessage,
)

NAME = "tar_shards"
SAMPLES = "shard STRING, key STRING, fields MAP<STRING, BINARY>, reason STRING"
ARROW = pa.schema([("shard", pa.string()), ("key", pa.string()), ("fields", pa.map_(pa.string(), pa.binary())), ("reason", pa.string())])
#: Bytes of a partition, about, and of what is handed on at once.
SPLIT, BATCH = 256 << 20, 16 << 20
#: Bytes of small files below which a partition isn't shared further.
LEAST = 1 << 20
MANIFEST = "manifest.jsonl"
TEMPORARY = "_temporary"
#: How compressed files begin, and what opens them.
COMPRESSED = {b"\x1f\x8b": gzip.GzipFile, b"BZh": bz2.BZ2File, b"\xfd7zXZ": lzma.LZMAFile}
DAMAGE = (tarfile.TarError, EOFError, OSError, zlib.error, lzma.LZMAError, UnicodeError, ValueError)


def file_system(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of an address, and the path in it."""
    if "://" in path or path.startswith("file:"):
        return pafs.FileSystem.from_uri(path if "://" in path else "file://" + path.removeprefix("file:"))
    return pafs.LocalFileSystem(), path


def listed(path: str, suffixes: tuple[str, ...] = (".tar", ".tgz")) -> list[pafs.FileInfo]:
    """A file, those right in a folder whose names have one of the suffixes (all files if there are none), or what matches a
    pattern; nothing where there is nothing."""
    fs, at = file_system(path.replace("*", "%2A").replace("?", "%3F") if "://" in path else path)
    at = at.replace("%2A", "*").replace("%3F", "?")
    fixed = at.split("*")[0].split("?")[0].split("[")[0]
    if fixed != at:
        inside = pafs.FileSelector(fixed.rpartition("/")[0] or "/", recursive=True, allow_not_found=True)
        depth = at.count("/")
        found = [x for x in fs.get_file_info(inside) if x.path.count("/") == depth and fnmatch.fnmatchcase(x.path, at)]
    else:
        found = [fs.get_file_info(at)]
        if found[0].type == pafs.FileType.Directory:
            found = fs.get_file_info(pafs.FileSelector(at))
            found = [x for x in found if not suffixes or any(s in x.base_name for s in suffixes)]
    return sorted((x for x in found if x.type == pafs.FileType.File and x.base_name[0] not in "._"), key=lambda x: x.path)


class Range(NamedTuple):
    """Bytes of a file from `start`; whole samples that begin before `end` (None: to the end of the file)."""

    path: str
    start: int
    end: int | None


@dataclass
class Ranges(InputPartition):
    ranges: list[Range] = field(default_factory=list)

    def __post_init__(self):
        InputPartition.__init__(self, None)


class Forward:
    """A decompressed stream that can be read on and stepped over, and knows the last bytes that were read."""

    def __init__(self, raw):
        self.raw, self.at, self.last = raw, 0, (0, b"")

    def read(self, n: int = -1) -> bytes:
        data = self.raw.read(n)
        self.last, self.at = (self.at, data), self.at + len(data)
        return data

    def tell(self) -> int:
        return self.at

    def seek(self, to: int, whence: int = 0) -> int:
        if to < self.at or whence:
            raise OSError("a compressed archive is read forward only")
        while self.at < to and (data := self.raw.read(min(1 << 20, to - self.at))):
            self.at += len(data)
        return self.at


def members(f, start: int = 0) -> Iterator[tuple[tarfile.TarFile, tarfile.TarInfo]]:
    """The files in a tar from an offset on, in constant memory. Raises where the archive doesn't end as one should."""
    f.seek(start)
    head = f.read(6)
    f.seek(start)
    if not head:
        raise tarfile.ReadError("the file is empty")
    for begin, opened in COMPRESSED.items():
        if start == 0 and head.startswith(begin):
            f = Forward(opened(mode="rb", fileobj=f) if opened is gzip.GzipFile else opened(f))
    with tarfile.open(fileobj=f, mode="r:") as tar:
        while (m := tar.next()) is not None:
            tar.members = []
            if m.isfile():
                yield tar, m
        if isinstance(f, Forward) and f.last[0] == tar.offset:
            block = f.last[1]
        else:
            f.seek(tar.offset)
            block = f.read(tarfile.BLOCKSIZE)
        if any(block) or 0 < len(block) < tarfile.BLOCKSIZE:
            raise tarfile.ReadError(f"no member header at byte {tar.offset}")


def split_places(fs: pafs.FileSystem, path: str, split: int) -> list[int]:
    """Offsets at which a tar may be cut: the first sample at or after each `split` bytes. Stops at the first damage, which
    the task that reads the last range will meet."""
    places, key = [0], None
    with fs.open_input_file(path) as f:
        if f.read(6).startswith(tuple(COMPRESSED)):
            return places
        try:
            for _, m in members(f):
                own = m.name.partition(".")[0]
                if own != key and m.offset >= places[-1] + split:
                    places.append(m.offset)
                key = own
        except DAMAGE:
            pass
    return places


class Sample:
    """Members of one name up to the first dot, as they come one after another."""

    def __init__(self, key: str):
        self.key, self.fields, self.reason, self.size = key, {}, None, 0

    def add(self, tar: tarfile.TarFile, m: tarfile.TarInfo, name: str) -> None:
        try:
            if name in self.fields:
                raise ValueError(f"{name} comes twice")
            raw = tar.extractfile(m).read()
            if len(raw) < m.size:
                raise EOFError(f"{name} ends before its size")
            self.fields[name] = raw
            self.size += len(raw)
        except DAMAGE as e:
            self.reason = self.reason or str(e) or type(e).__name__


def samples(f, start: int, end: int | None, wanted: frozenset | None) -> Iterator[Sample]:
    """Samples of a range; the last one has no key but a reason if what follows can't be read."""
    one = None
    try:
        for tar, m in members(f, start):
            key, _, name = m.name.partition(".")
            if one is None or key != one.key:
                if one is not None:
                    yield one
                    one = None
                if end is not None and m.offset >= end:
                    return
                one = Sample(key)
            if wanted is None or name in wanted:
                one.add(tar, m, name)
    except DAMAGE as e:
        reason = str(e) or type(e).__name__
        if one is not None:  # whether it is whole can't be known
            one.reason = one.reason or reason
            yield one
        one = Sample(None)
        one.reason = reason
    if one is not None:
        yield one


class TarReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.mode = options["path"], options.get("mode", "PERMISSIVE").upper()
        if self.mode not in ("PERMISSIVE", "DROPMALFORMED", "FAILFAST"):
            raise ValueError(f"no such mode: {self.mode}")
        self.split = int(options.get("splitbytes", SPLIT))
        self.fields = frozenset(options["fields"].split(",")) if options.get("fields") else None
        self.tasks = int(options.get("tasks", 1))
        self.shards = frozenset(json.loads(options["shards"])) if "shards" in options else None

    def partitions(self) -> list[Ranges]:
        """Small files go together, in order, up to the size of a partition, or to their share of `tasks` where that is less;
        large ones are walked over and cut."""
        fs, _ = file_system(self.path)
        files = [x for x in listed(self.path) if self.shards is None or x.base_name in self.shards]
        large = [x for x in files if x.size > self.split]
        with ThreadPoolExecutor(16) as pool:
            cuts = dict(zip((x.path for x in large), pool.map(lambda x: split_places(fs, x.path, self.split), large), strict=True))
        small = sum(x.size for x in files if x.path not in cuts)
        share = min(self.split, max(LEAST, -(-small // self.tasks)))
        out, room = [], 0
        for x in files:
            if x.path in cuts:
                at = cuts[x.path]
                out += [Ranges([Range(x.path, a, b)]) for a, b in zip(at, [*at[1:], None], strict=True)]
                room = 0
            else:
                if x.size > room:
                    out.append(Ranges())
                    room = share
                out[-1].ranges.append(Range(x.path, 0, None))
                room -= x.size
        return out or [Ranges()]

    def read(self, partition: Ranges) -> Iterator[pa.RecordBatch]:
        fs, _ = file_system(self.path)
        rows, size = [], 0
        for path, start, end in partition.ranges:
            shard = path.rpartition("/")[2]
            with fs.open_input_file(path) as f:
                for one in samples(f, start, end, self.fields):
                    if one.reason is not None:
                        if self.mode == "FAILFAST":
                            raise ValueError(f"{path}, {one.key or 'archive'}: {one.reason}")
                        if self.mode == "DROPMALFORMED":
                            continue
                    rows.append((shard, one.key, None if one.reason else list(one.fields.items()), one.reason))
                    size += one.size
                    if size >= BATCH or len(rows) >= 1000:
                        yield _batch(rows)
                        rows, size = [], 0
        if rows:
            yield _batch(rows)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), ARROW.types, strict=True)], schema=ARROW)


def begin(fs: pafs.FileSystem, root: str) -> str:
    """A folder for what a job's tasks write. The driver makes it: a task that outlives the job finds none."""
    job = uuid.uuid4().hex
    fs.create_dir(f"{root}/{TEMPORARY}/{job}", recursive=True)
    return job


def note(fs: pafs.FileSystem, held: str, names: list[str]) -> None:
    """Before files are moved to their names: so that they can be taken back, whatever becomes of the task."""
    with fs.open_output_stream(f"{held}/{uuid.uuid4().hex}.names") as out:
        out.write("\n".join(names).encode())


def noted(fs: pafs.FileSystem, held: str) -> set[str]:
    out = set()
    for x in fs.get_file_info(pafs.FileSelector(held, allow_not_found=True)):
        if x.extension == "names":
            with fs.open_input_stream(x.path) as f:
                out.update(f.read().decode().split("\n"))
    return out


def undo(fs: pafs.FileSystem, root: str, job: str, keep: frozenset[str] = frozenset()) -> None:
    """Take back what a job has moved below root. Its own folder goes first: tasks that still run can move nothing then."""
    held, aside = f"{root}/{TEMPORARY}/{job}", f"{root}/{TEMPORARY}/.{job}"
    if fs.get_file_info(held).type == pafs.FileType.Directory:
        fs.move(held, aside)
        for n in noted(fs, aside) - keep:
            if fs.get_file_info(f"{root}/{n}").type == pafs.FileType.File:
                fs.delete_file(f"{root}/{n}")
        fs.delete_dir(aside)
    clear(fs, root, job)


def clear(fs: pafs.FileSystem, root: str, job: str) -> None:
    """The job's own folder, and the one of all jobs if it is empty."""
    for p in (f"{root}/{TEMPORARY}/{job}", f"{root}/{TEMPORARY}"):
        info = fs.get_file_info(p)
        if info.type == pafs.FileType.Directory and (p.endswith(job) or not fs.get_file_info(pafs.FileSelector(p))):
            fs.delete_dir(p)


@dataclass
class Told(WriterCommitMessage):
    """What a task has written: shards with their counts."""

    shards: list[tuple[str, int]]


def shard_name(shard) -> str:
    return f"shard_{shard:06d}" if isinstance(shard, int) else str(shard)


_BARE = bytearray(tarfile.TarInfo().tobuf())
_BARE[124:136], _BARE[148:156] = bytes(12), b" " * 8
_SUM = sum(_BARE)


def header(name: str, size: int) -> bytes:
    """A member's header, as tarfile makes it of a name and a size; short plain names need little of it."""
    if not name.isascii() or len(name) > 100 or size >= 8**11:
        info = tarfile.TarInfo(name)
        info.size = size
        return info.tobuf()
    own, long = name.encode(), b"%011o" % size
    out = bytearray(_BARE)
    out[: len(own)], out[124:135] = own, long
    out[148:156] = b"%06o\0 " % (_SUM + sum(own) + sum(long))
    return bytes(out)


class TarWriter(DataSourceArrowWriter):
    def __init__(self, options: dict):
        self.path = options["path"].rstrip("/")
        self.job = begin(*self._root())

    def _root(self) -> tuple[pafs.FileSystem, str]:
        fs, root = file_system(self.path)
        return fs, root.rstrip("/")

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Told:
        fs, root = self._root()
        held, own = f"{root}/{TEMPORARY}/{self.job}", uuid.uuid4().hex
        before = read_manifest_file(fs, root)
        done: dict[str, int] = {}
        name, out, at = None, None, 0

        def finish() -> None:
            out.write(bytes(-(-(at + 2 * tarfile.BLOCKSIZE) // tarfile.RECORDSIZE) * tarfile.RECORDSIZE - at))
            out.close()
            note(fs, held, [f"{name}.tar"])
            fs.move(f"{held}/{own}-{name}.tar", f"{root}/{name}.tar")

        for batch in iterator:
            for shard, key, fields in zip(*(batch.column(c).to_pylist() for c in ("shard", "key", "fields")), strict=True):
                if shard is None or key is None:
                    raise ValueError("a sample needs a shard and a key")
                if (this := shard_name(shard)) != name:
                    if out is not None:
                        finish()
                    name, at = this, 0
                    if name in done or name in before:
                        raise ValueError(f"{name} is there, or its samples don't follow one another")
                    done[name] = 0
                    out = fs.open_output_stream(f"{held}/{own}-{name}.tar")
                for part, raw in sorted(fields or []):
                    raw = raw or b""
                    head, end = header(f"{key}.{part}", len(raw)), bytes(-len(raw) % tarfile.BLOCKSIZE)
                    out.write(head + raw + end if len(raw) < BATCH else head)
                    if len(raw) >= BATCH:
                        out.write(raw)
                        out.write(end)
                    at += len(head) + len(raw) + len(end)
                done[name] += 1
        if out is not None:
            finish()
        return Told(list(done.items()))

    def commit(self, messages: list[Told | None]) -> None:
        """The manifest: shards that were there, and those of all tasks. It is written whole, then takes the old one's place."""
        fs, root = self._root()
        told = [x for m in messages if m is not None for x in m.shards]
        before = list(read_manifest_file(fs, root).items())
        twice = [n for n, k in Counter(n for n, _ in told + before).items() if k > 1]
        if twice:
            raise ValueError(f"shards were written twice: {', '.join(sorted(twice)[:5])}")
        kept = dict(before + told)
        _write_manifest(fs, root, kept, self.job)
        clear(fs, root, self.job)

    def abort(self, messages: list[Told | None]) -> None:
        fs, root = self._root()
        undo(fs, root, self.job, frozenset(f"{n}.tar" for n in read_manifest_file(fs, root)))


def read_manifest_file(fs: pafs.FileSystem, root: str) -> dict[str, int]:
    if fs.get_file_info(f"{root}/{MANIFEST}").type != pafs.FileType.File:
        return {}
    with fs.open_input_stream(f"{root}/{MANIFEST}") as f:
        rows = [json.loads(x) for x in f.read().decode().splitlines() if x]
    return {r["shard"]: r["num_sequences"] for r in rows}


def _write_manifest(fs: pafs.FileSystem, root: str, shards: dict[str, int], job: str) -> None:
    lines = [json.dumps({"shard": n, "num_sequences": shards[n]}) for n in sorted(shards)]
    fs.create_dir(root, recursive=True)
    with fs.open_output_stream(f"{root}/.{MANIFEST}.{job}") as out:
        out.write("".join(x + "\n" for x in lines).encode())
    fs.move(f"{root}/.{MANIFEST}.{job}", f"{root}/{MANIFEST}")


def enter(path: str, shards: list[tuple[str, int]]) -> None:
    """Enter shards in a manifest that have no file, for they have no samples."""
    fs, root = file_system(path.rstrip("/"))
    _write_manifest(fs, root, dict(shards) | read_manifest_file(fs, root), uuid.uuid4().hex)


class TarShards(DataSource):
    """Options for reading: path (a file, a folder or a pattern), shards (a JSON list of file names; others aren't opened),
    fields (names with commas between; others aren't read), mode (PERMISSIVE: what is damaged comes as rows with a reason; DROPMALFORMED; FAILFAST), splitBytes, tasks (so many partitions of small files, if there is
    a megabyte for each). For writing: path;
    rows (shard, key, fields), those of a shard one after another in one partition."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return SAMPLES

    def reader(self, schema) -> TarReader:
        return TarReader({k.lower(): v for k, v in self.options.items()})

    def writer(self, schema, overwrite: bool) -> TarWriter:
        missing = {"shard", "key", "fields"} - set(schema.names)
        if missing:
            raise ValueError(f"columns are missing: {', '.join(sorted(missing))}")
        if overwrite:
            raise ValueError("shards are not replaced: append to a folder, or take a new one")
        return TarWriter({k.lower(): v for k, v in self.options.items()})


def registered(spark: SparkSession) -> SparkSession:
    spark.dataSource.register(TarShards)
    return spark


def read_tar_shards(spark: SparkSession, path: str, fields: tuple[str, ...] = (), shards: list[str] | None = None,
                    mode: str = "PERMISSIVE", split: int = SPLIT) -> DataFrame:
    """Samples of tar shards, of those named in `shards` if given: shard (its file's name), key, fields, reason. Members that follow one another and share the name
    up to the first dot are one sample; a sample with a damaged member or a field that comes twice has a reason and no
    fields, and so have the last sample before a damaged place and, without a key, the rest of that shard. An empty archive has no rows."""
    options = {"mode": mode, "splitBytes": split, "tasks": 4 * spark.sparkContext.defaultParallelism} | ({"fields": ",".join(fields)} if fields else {})
    options |= {} if shards is None else {"shards": json.dumps(shards)}
    return registered(spark).read.format(NAME).options(**options).load(path)


def write_tar_shards(rows: DataFrame, path: str, order: str = "key") -> None:
    """rows(shard, key, fields, ...) -> <path>/<shard>.tar and a manifest. A shard is written by one task, its samples in the
    order of `order` then key; how large a shard gets is set by whoever numbers the shards. Shards that the manifest of the
    folder already has are an error."""
    registered(rows.sparkSession)
    by = list(dict.fromkeys(["shard", order, "key"]))
    rows = rows.repartition("shard").sortWithinPartitions(*by).select("shard", "key", "fields")
    rows.write.format(NAME).mode("append").save(path)


def members_of(rows: DataFrame, keys: list[str], name: str = "field", content: str = "content") -> DataFrame:
    """A row for each member -> a row for each sample, with its members as a map."""
    pairs = F.collect_list(F.struct(F.col(name), F.col(content)))
    return rows.groupBy(*keys).agg(F.map_from_entries(F.array_sort(pairs)).alias("fields"))
