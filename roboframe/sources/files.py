"""File sources and sinks: episode folders, frame files, run summaries. Tar shards are in tars.py.

Everything is read through Spark's own file sources, so any store that Spark reaches will do; decoding runs in tasks.
"""

from __future__ import annotations

import io
import math
import re
import tempfile
import uuid
import zipfile
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MANIFEST = "shard STRING, num_sequences BIGINT"


def scratch(spark: SparkSession) -> str:
    """A new folder below the shared one (spark.checkpoint.dir). Where that is unset a temporary one does on a single
    machine; on a cluster that is an error."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="spark-")
    return f"{base.rstrip('/')}/roboframe-{uuid.uuid4().hex}"


def kept(df: DataFrame) -> DataFrame:
    """df as a table in the shared folder, read back: no lineage before it, and lost executors lose nothing."""
    path = scratch(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def file_system(spark: SparkSession, root: str):
    """Spark's file system of a path, and what makes its paths."""
    path = spark._jvm.org.apache.hadoop.fs.Path
    return path(root).getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()), path


def list_files(spark: SparkSession, root: str, prefix: str = "", part: str = "") -> DataFrame:
    """path (relative to the root) and size of all files below a folder whose relative path begins with `prefix` and contains
    `part`; nothing where there is no folder. Contents aren't read."""
    fs, of = file_system(spark, root)
    if not fs.exists(of(root)):
        return spark.createDataFrame([], "path string, size long")
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    base = fs.makeQualified(of(root)).toUri().getPath().rstrip("/") + "/"
    path = F.split_part("path", F.lit(base), F.lit(2))
    return found.select(path.alias("path"), F.col("length").alias("size")).where(F.col("path").startswith(prefix) & F.col("path").contains(part))


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(MANIFEST).option("mode", "FAILFAST").json(path)


def write_manifests(shards: DataFrame, path: str) -> None:
    """shards(dataset, shard, num_sequences): a manifest for each dataset, whichever there are."""
    rows = shards.select("dataset", "shard", "num_sequences").repartition("dataset").sortWithinPartitions("dataset", "shard")
    rows.write.mode("errorifexists").partitionBy("dataset").json(path)


def read_manifests(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.schema(f"{MANIFEST}, dataset STRING").option("mode", "FAILFAST").json(path)
    return rows.select("dataset", "shard", "num_sequences")


def write_manifest(shards: DataFrame, path: str) -> None:
    """One JSON-lines file: a manifest has a row per shard."""
    shards.select("shard", "num_sequences").coalesce(1).write.mode("errorifexists").json(path)


FRAMES = "episode string, t int, field string, value array<double>"


def scan_chunked_episodes(spark: SparkSession, root: str) -> DataFrame:
    """data/chunk-*/episode_%06d.parquet with the episode index from the path."""
    rows = spark.read.option("basePath", root).parquet(f"{root}/data/chunk-*")
    return rows.withColumn("episode_index", F.regexp_extract("_metadata.file_path", r"episode_(\d+)", 1).cast("int"))


def scan_fps(spark: SparkSession, root: str) -> DataFrame:
    """Frames per second of the dataset; 30 where its info has none."""
    info = spark.read.schema("fps DOUBLE").option("multiLine", True).json(f"{root}/meta/info.json")
    return info.select(F.coalesce("fps", F.lit(30.0)).alias("fps"))


def scan_episode_metadata(spark: SparkSession, root: str) -> DataFrame:
    """episode_index, tasks, length of each episode; a line that is no JSON fails."""
    schema = "episode_index BIGINT, tasks ARRAY<STRING>, length BIGINT"
    return spark.read.schema(schema).option("mode", "FAILFAST").json(f"{root}/meta/episodes*.jsonl")


FRAME_JSON = "time DOUBLE, robot_type STRING, states STRUCT<arm_state: ARRAY<DOUBLE>, leg_state: ARRAY<DOUBLE>>, actions STRUCT<sol_q: ARRAY<DOUBLE>>"


def scan_frame_json(spark: SparkSession, pattern: str) -> DataFrame:
    """An episode is a JSON array of frames; task and episode come from the path, robot_type defaults to h1."""
    rows = spark.read.schema(FRAME_JSON).option("multiLine", True).json(pattern)
    path = F.col("_metadata.file_path")
    return rows.select(
        F.split_part(path, F.lit("/"), F.lit(-3)).alias("task"), F.split_part(path, F.lit("/"), F.lit(-2)).alias("episode"),
        "time", F.coalesce("robot_type", F.lit("h1")).alias("robot_type"), "states", "actions",
    )


#: What begins an array's bytes; the header's length follows the version.
MAGIC = b"\x93NUMPY"


@lru_cache(4096)
def _header(head: bytes) -> tuple[np.dtype, tuple[int, ...], bool]:
    """The arrays of many small files have few headers."""
    f = io.BytesIO(head)
    read = np.lib.format.read_array_header_1_0 if np.lib.format.read_magic(f) == (1, 0) else np.lib.format.read_array_header_2_0
    shape, fortran, dtype = read(f)
    if dtype.hasobject:
        raise ValueError("arrays of objects aren't read")
    return dtype, shape, fortran


def _array(raw: bytes) -> np.ndarray | None:
    if not raw.startswith(MAGIC):
        return None
    if len(raw) < 12:
        raise ValueError("an array ends in its header")
    at, size = (10, raw[8:10]) if raw[6] == 1 else (12, raw[8:12])
    at += int.from_bytes(size, "little")
    if raw[6] > 2:  # names of fields in UTF-8
        return np.lib.format.read_array(io.BytesIO(raw), allow_pickle=False)
    dtype, shape, fortran = _header(raw[:at])
    if len(raw) < at + math.prod(shape) * dtype.itemsize:
        raise ValueError("an array ends before its size")
    if not math.prod(shape) * dtype.itemsize:
        return np.zeros(shape, dtype)
    return np.frombuffer(raw, dtype, math.prod(shape), at).reshape(shape, order="F" if fortran else "C")


def _members(raw: bytes, drop: tuple[str, ...] = ()) -> Iterator[tuple[str, np.ndarray | None]]:
    """Names and arrays of an .npz file, none where a member is something else. Stored members are taken from where they lie."""
    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        for m in z.infolist():
            if (name := m.filename.removesuffix(".npy")) in drop:
                continue
            head = raw[m.header_offset : m.header_offset + 30]
            if m.compress_type == zipfile.ZIP_STORED and not m.flag_bits & 1 and len(head) == 30 and head.startswith(b"PK\3\4"):
                at = m.header_offset + 30 + int.from_bytes(head[26:28], "little") + int.from_bytes(head[28:30], "little")
                content = raw[at : at + m.file_size]
                if len(content) < m.file_size or zlib.crc32(content) != m.CRC:
                    raise zipfile.BadZipFile(f"{m.filename} is damaged")
            else:
                content = z.read(m)
            yield name, _array(content)


def _arrays(raw: bytes) -> dict[str, np.ndarray]:
    return {k: np.atleast_1d(a).astype(float).ravel() for k, a in _members(raw) if a is not None and a.dtype.kind in "fiub"}


DAMAGE = (ValueError, OSError, EOFError, KeyError, zipfile.BadZipFile, zlib.error)


#: Rows and bytes of values that are handed on at once.
ROWS, BYTES = 10_000, 16 << 20
DECODED = pa.schema([("episode", pa.string()), ("t", pa.int32()), ("field", pa.string()), ("value", pa.list_(pa.float64())), ("path", pa.string()), ("reason", pa.string())])


def _decoded(files: DataFrame, decode, strict: bool) -> DataFrame:
    """files(path, content) -> the rows of each, or a row with its path and the reason why it has none."""

    def packed(rows: list[tuple]) -> pa.RecordBatch:
        columns = zip(*rows, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(c, t, from_pandas=True) for c, t in zip(columns, DECODED.types, strict=True)], schema=DECODED)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # files may be small and many: their rows go on together
        held, size = [], 0
        for batch in batches:
            for path, content in zip(batch.column(0), batch.column(1), strict=True):
                path = path.as_py()
                try:
                    rows = [(*r, path, None) for r in decode(path, content.as_py())]
                except DAMAGE as e:
                    if strict:
                        raise
                    rows = [(None, None, None, None, path, str(e) or type(e).__name__)]
                held += rows
                size += sum(r[3].nbytes for r in rows if r[3] is not None)
                if len(held) >= ROWS or size >= BYTES:
                    yield packed(held)
                    held, size = [], 0
        if held:
            yield packed(held)

    return files.select("path", "content").mapInArrow(run, f"{FRAMES}, path string, reason string")


def _frame(path: str, content: bytes) -> list[tuple]:
    m = re.search(r"([^/]+)_t(\d+)\.npz$", path)
    if not m:
        raise ValueError(f"not a frame file: {path}")
    return [(m[1], int(m[2]), k, v) for k, v in _arrays(content).items()]


def frame_rows(files: DataFrame) -> DataFrame:
    """files(path, content) of <episode>_t%04d.npz -> episode, t, field, value, path, reason: what can't be read, or has
    another name, is a row with its path and the reason."""
    return _decoded(files, _frame, False)


def frame_files(files: DataFrame) -> DataFrame:
    """The same as frames; a file that can't be read or has a name of another form raises, keys that are not numbers are
    skipped."""
    return _decoded(files, _frame, True).drop("path", "reason")


def scan_frame_files(spark: SparkSession, pattern: str) -> DataFrame:
    return frame_files(spark.read.format("binaryFile").load(pattern))


def _episode(drop: tuple[str, ...]):
    def decode(path: str, content: bytes) -> list[tuple]:
        episode, part = path.split("/")[-2], path.split("/")[-1].removesuffix(".npz")
        rows = []
        for k, a in _members(content, drop):
            if a is None:
                raise ValueError(f"{k} is no array")
            a = np.asarray(a, dtype=float)
            rows += [(episode, t, f"{part}/{k}", np.atleast_1d(a[t]).ravel()) for t in range(len(a))]
        return rows

    return decode


def episode_rows(files: DataFrame, drop: tuple[str, ...] = ()) -> DataFrame:
    """files(path, content) of <episode>/<part>.npz, one array over time per key -> episode, t, field, value, path, reason."""
    return _decoded(files, _episode(drop), False)


def processed_episodes(files: DataFrame, drop: tuple[str, ...] = ()) -> DataFrame:
    """The same as frames without the dropped keys; a file that can't be read raises."""
    return _decoded(files, _episode(drop), True).drop("path", "reason")


def scan_summaries(spark: SparkSession, pattern: str) -> DataFrame:
    """One text document per rollout with `success:` on a line; false without it; a document that has no line of the
    form `key:` is left out."""
    rows = spark.read.text(pattern, wholetext=True)
    return summaries(rows.select(F.col("_metadata.file_path").alias("path"), "value"))


def summary_rows(rows: DataFrame) -> DataFrame:
    """rows(path, value) -> path, success, reason."""
    said = F.lower(F.regexp_extract("value", r"(?m)^success:\s*(\w+)", 1))
    there = F.col("value").rlike(r"(?m)^\w+:")
    return rows.select("path", F.coalesce(said.isin("true", "yes"), F.lit(False)).alias("success"), F.when(~F.coalesce(there, F.lit(False)), "no line of the form `key:`").alias("reason"))


def summaries(rows: DataFrame) -> DataFrame:
    return summary_rows(rows).where("reason IS NULL").drop("reason")


def scan_results(spark: SparkSession, root: str) -> DataFrame:
    """{model}/{task}/rollouts/{stamp}/results.json under a root -> one row per evaluation; other layouts raise."""
    schema = "max_sample_size_per_model INT, evaluations ARRAY<STRUCT<skill_type: STRING, scenario_index: INT, is_success: BOOLEAN, is_pending: BOOLEAN, total_time: DOUBLE, failure_message: STRING>>"
    rows = spark.read.schema(schema).option("multiLine", True).option("recursiveFileLookup", True).option("pathGlobFilter", "results.json").json(root)
    p = F.split("_metadata.file_path", "/")
    bad = F.raise_error(F.lit("the path is not model/task/rollouts/stamp/results.json"))
    model = F.when(F.element_at(p, -3) == "rollouts", F.element_at(p, -5)).otherwise(bad)
    flat = rows.select(model.alias("model"), F.element_at(p, -4).alias("task"), F.element_at(p, -2).alias("stamp"), F.col("max_sample_size_per_model").alias("budget"), F.explode("evaluations").alias("e"))
    return flat.select(
        "model", "task", "stamp", "budget", F.col("e.scenario_index").alias("demo_id"), F.col("e.is_success").alias("success"),
        F.coalesce("e.is_pending", F.lit(False)).alias("pending"), F.col("e.total_time").alias("duration"), F.col("e.failure_message").alias("failure"),
    )


def scan_run_csv(spark: SparkSession, path: str, schema: str, name: str) -> DataFrame:
    """Tracked runs; short rows are left out, of a run's name the first row in the order of files and of rows in them
    stays (Spark may pack the parts of files into tasks in any order)."""
    rows = spark.read.schema(schema).option("header", True).option("mode", "DROPMALFORMED").csv(path)
    at = F.struct(F.col("_metadata.file_path"), F.col("_metadata.file_block_start"), F.monotonically_increasing_id())
    rows = rows.select("*", at.alias("_n"))
    return rows.groupBy(name).agg(F.min_by(F.struct(*[c for c in rows.columns if c not in (name, "_n")]), "_n").alias("r")).select(name, "r.*")


def assert_empty_output(spark: SparkSession, path: str) -> None:
    """Raise where the target of a sink holds a file already; a missing or an empty folder will do."""
    fs, of = file_system(spark, path)
    target = of(path)
    if fs.exists(target) and fs.getContentSummary(target).getFileCount() > 0:
        raise FileExistsError(f"{path} holds output")


def export_csv(rows: DataFrame, path: str) -> None:
    """A table with a header as one CSV file, in the rows' order: summaries are small. Refuses a folder with output."""
    assert_empty_output(rows.sparkSession, path)
    rows.coalesce(1).write.mode("append").option("header", True).csv(path)
