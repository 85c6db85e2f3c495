"""Shared pieces of the training-data operators: tables, written intermediates, bounded bitmaps, batching."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Characters of text that a Python worker turns into arrays at once; bounds the memory of a worker.
SLICE_CHARS = 600_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Models that a worker keeps from one task to the next; tasks of other operators let go of them.
KEPT: list = []


def lean() -> None:
    """At the start of a task that needs much memory of its own: Python workers go on to the next task, and what earlier
    ones left would add up; it returns to the system."""
    for cache in KEPT:
        cache.cache_clear()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library: nothing to set
        pass


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset a temporary one does on a
    single machine; on a cluster that is an error."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        base = spark.conf.get("roboframe.shared.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("roboframe.shared.dir", base)
    return base.rstrip("/")


def written(df: DataFrame, label: str) -> DataFrame:
    """Write df to the shared folder and read it back: cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/roboframe-{label}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_to = path
    return out


def discard(*frames: DataFrame) -> None:
    """Delete tables of written() that no later plan reads."""
    for df in frames:
        session = df.sparkSession
        path = session._jvm.org.apache.hadoop.fs.Path(df._written_to)
        path.getFileSystem(session._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def prepare(spark: SparkSession) -> None:
    """Arrow batches of 1,000 rows and some 32 MB: rows carry whole texts or blocks, and a batch is held by a worker at once."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(32 << 20))


def partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


@contextmanager
def few_samples(spark: SparkSession, n: int) -> Iterator[None]:
    """What is run inside samples 3 * n rows for each range of a range partition, which the driver gets: for long keys."""
    name = "spark.sql.execution.rangeExchange.sampleSizePerPartition"
    before = spark.conf.get(name)
    spark.conf.set(name, str(n))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def runs_of(texts: list, chars: int = SLICE_CHARS) -> Iterator[tuple[int, int]]:
    """Cut a batch of texts into runs [a, b) with about `chars` characters each (one text at least)."""
    if len(texts):
        sizes = np.array([len(x) if isinstance(x, str) else 0 for x in texts], dtype=np.int64)
        group = (np.cumsum(sizes) - sizes) // chars
        ends = np.cumsum(np.unique(group, return_counts=True)[1]).tolist()
        yield from zip([0, *ends[:-1]], ends, strict=True)


def slices(frame: pd.DataFrame, text: str = "text", chars: int = SLICE_CHARS) -> Iterator[pd.DataFrame]:
    """The same for a batch of rows."""
    for a, b in runs_of(frame[text].tolist(), chars):
        yield frame.iloc[a:b]


def bitmap(slots: DataFrame, log2_bits: int) -> np.ndarray:
    """Bitmap of a long column `slot` in [0, 2**log2_bits), whatever the number of rows.

    Spark sets the bits; the driver gets 2**log2_bits / 8 bytes at most. Where slots are hashes of keys a set bit may
    be a false positive, but a clear bit is proof of absence: it may only be used to skip work that an exact step follows.
    """
    slot = F.col("slot") + 1  # the bitmap functions count from 1
    rows = (
        slots.select(slot.alias("slot"))
        .groupBy(F.bitmap_bucket_number("slot").alias("bucket"))
        .agg(F.bitmap_construct_agg(F.bitmap_bit_position("slot")).alias("bits"))
        .collect()
    )
    out = np.zeros((1 << log2_bits) // 8, dtype=np.uint8)
    for r in rows:
        out[(r["bucket"] - 1) * 4096 : r["bucket"] * 4096] = np.frombuffer(bytes(r["bits"]), dtype=np.uint8)
    return out


def key_slot(column: str, log2_bits: int):
    """Slot of a key of any kind."""
    return F.pmod(F.xxhash64(F.col(column)), F.lit(1 << log2_bits))


def test_bits(bits: np.ndarray, slots: np.ndarray) -> np.ndarray:
    return (bits[slots >> 3] >> (slots & 7).astype(np.uint8)) & 1 == 1


def bitmap_udf(bits: np.ndarray):
    @F.pandas_udf("boolean")
    def hit(slot: pd.Series) -> pd.Series:
        return pd.Series(test_bits(bits, slot.to_numpy(np.int64)))

    return hit


#: log2 of the bits of the bitmaps of rows that a join has to see.
KEY_BITS = 23


def near_keys(rows: DataFrame, key: str, keys: DataFrame) -> DataFrame:
    """The rows whose key may be among keys (one column): all that are, and a few more. Keeps a join that follows from
    shuffling the rest; needs no size bound on keys."""
    (name,) = keys.columns
    bits = bitmap(keys.select(key_slot(name, KEY_BITS).alias("slot")), KEY_BITS)
    return rows.where(F.coalesce(bitmap_udf(bits)(key_slot(key, KEY_BITS)), F.lit(False)))


def without(docs: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """The rows of docs whose key is not in keys. A bitmap of fixed size lets most rows pass beside the anti-join."""
    gone = written(keys.select(key).distinct(), "without")
    bits = bitmap(gone.select(key_slot(key, KEY_BITS).alias("slot")), KEY_BITS)
    hit = F.coalesce(bitmap_udf(bits)(key_slot(key, KEY_BITS)), F.lit(False))
    return docs.where(~hit).unionByName(docs.where(hit).join(gone, key, "left_anti").select(*(f"`{c}`" for c in docs.columns)))


def set_aside(carry, result: list[str]) -> dict[str, str]:
    """Columns that are only carried -> names that no operator has. Names of the operator's own result are refused; doc_id
    comes anyway."""
    if clash := sorted(set(carry) & set(result)):
        raise ValueError(f"columns of the result can't be carried: {', '.join(clash)}")
    return {c: f"_carried_{k}" for k, c in enumerate(carry) if c != "doc_id"}


def renamed(inner: dict[str, str]) -> list:
    return [F.col(f"`{c}`").alias(x) for c, x in inner.items()]


def back(inner: dict[str, str]) -> list:
    return [F.col(x).alias(c) for c, x in inner.items()]


def mix(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """A bijective 64-bit finalizer (the public splitmix64 step)."""
    with np.errstate(over="ignore"):
        x = x + np.uint64((salt * 0x9E3779B97F4A7C15 + 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


BYTE_CODES = mix(np.arange(256, dtype=np.uint64), 11)
BASE = 0x9FB21C651E98DF25 | 1
_powers: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i modulo 2**64 for i < n."""
    have = len(_powers.get("up", ()))
    if have < n:
        n = max(n, 1 << 16)
        with np.errstate(over="ignore"):
            for name, base in (("up", BASE), ("down", pow(BASE, -1, 1 << 64))):
                p = np.full(n, np.uint64(base), dtype=np.uint64)
                p[0] = 1
                _powers[name] = np.cumprod(p)
    return _powers["up"], _powers["down"]


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """P with P[j] - P[i] a polynomial hash of data[i:j]; bring to a common base with span_hash."""
    up, _ = powers(len(data) + 1)
    out = np.zeros(len(data) + 1, dtype=np.uint64)
    with np.errstate(over="ignore"):
        np.cumsum(BYTE_CODES[data] * up[: len(data)], out=out[1:])
    return out


def span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    _, down = powers(len(prefix))
    with np.errstate(over="ignore"):
        return mix((prefix[end] - prefix[start]) * down[start], 3)


def joined(texts: list) -> tuple[np.ndarray, np.ndarray]:
    """All texts as one UTF-8 byte array with a newline after each, and the start of each text (plus the end)."""
    raw = [x.encode("utf-8", "surrogatepass") if isinstance(x, str) else b"" for x in texts]
    starts = np.zeros(len(raw) + 1, dtype=np.int64)
    np.cumsum([len(x) + 1 for x in raw], out=starts[1:])
    return np.frombuffer(b"\n".join(raw) + b"\n", dtype=np.uint8), starts


LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def words(data: np.ndarray, starts: np.ndarray, is_word: np.ndarray):
    """Words of a joined batch: start and end of each, its hash, and the number of its text."""
    inside = np.concatenate(([False], is_word[data], [False]))
    edge = np.flatnonzero(inside[1:] != inside[:-1])
    start, end = edge[::2], edge[1::2]
    text_of = np.searchsorted(starts, start, side="right") - 1
    return start, end, span_hash(prefix_hash(data), start, end), text_of
