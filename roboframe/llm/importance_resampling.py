"""Target-distribution importance resampling.

Documents and target texts are counted as hashed runs of one and two words; what a bucket of features gains in the
target over the corpus is held in one array, which scores every document. Documents are drawn by their weight plus
Gumbel noise, the highest first. The last key that is drawn is found exactly by weighted medians of medians: each
partition tells the median of its keys that are still open and how many these are; the weighted median of the medians
discards a guaranteed share of them in each round. What is drawn is then sorted.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common
from .common import LOWER, joined, partitions, slices, table, written

#: Number of buckets, the noise's seed, least words of a document that may be drawn, share in percent.
BUCKETS = 10_000
SEED = 7
LEAST_WORDS = 20
PERCENT = 25
#: Open keys that are fetched at once to end the search: bounded, 24 bytes each.
FEW = 4096
#: Bytes of the longest word whose checksum is computed in step with others.
LONG = 64

IS_WORD = np.zeros(256, dtype=bool)
IS_WORD[0x30:0x3A] = IS_WORD[0x61:0x7B] = IS_WORD[0x80:] = True


def _crc_table() -> np.ndarray:
    c = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        c = np.where(c & 1, (c >> 1) ^ np.uint32(0xEDB88320), c >> 1).astype(np.uint32)
    return c


CRC = _crc_table()


def _shift_tables(longest: int) -> np.ndarray:
    """[k, b, v]: what byte b with value v of a checksum becomes when k zero bytes follow. A checksum is linear, so that of
    two strings together is the first one's after as many zeros as the second has bytes, xor the second one's."""
    out = np.zeros((longest + 1, 4, 256), dtype=np.uint32)
    for b in range(4):
        out[0, b] = np.arange(256, dtype=np.uint32) << np.uint32(8 * b)
    for k in range(longest):
        out[k + 1] = CRC[out[k] & 0xFF] ^ (out[k] >> np.uint32(8))
    return out


SHIFT = _shift_tables(LONG)


def word_checksums(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """crc32 of each span of data: a byte of all spans at a time; spans above LONG one by one."""
    size = end - start
    crc = np.full(len(start), 0xFFFFFFFF, dtype=np.uint32)
    order = np.argsort(-np.minimum(size, LONG + 1), kind="stable")
    order = order[np.count_nonzero(size > LONG) :]
    ascending = -size[order]
    for k in range(int(size[order[0]]) if len(order) else 0):
        here = order[: np.searchsorted(ascending, -k, side="left")]
        c = crc[here]
        crc[here] = CRC[(c ^ data[start[here] + k]) & 0xFF] ^ (c >> np.uint32(8))
    crc ^= np.uint32(0xFFFFFFFF)
    for i in np.flatnonzero(size > LONG).tolist():
        crc[i] = zlib.crc32(data[start[i] : end[i]].tobytes())
    return crc


def together(first: np.ndarray, second: np.ndarray, size: np.ndarray) -> np.ndarray:
    """crc32 of pairs of strings put together, from those of both and the sizes of the second ones."""
    left, rest = first.copy(), size.copy()
    out = np.empty_like(first)
    todo = np.arange(len(first))
    while len(todo):
        k = np.minimum(rest[todo], LONG)
        c = left[todo]
        left[todo] = SHIFT[k, 0, c & 0xFF] ^ SHIFT[k, 1, c >> 8 & 0xFF] ^ SHIFT[k, 2, c >> 16 & 0xFF] ^ SHIFT[k, 3, c >> 24]
        rest[todo] -= k
        todo = todo[rest[todo] > 0]
    np.bitwise_xor(left, second, out=out)
    return out


def features(texts: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of all features of a batch of texts, the text of each, and the number of words of each text."""
    data, starts = joined(texts)
    data = LOWER[data]
    inside = np.concatenate(([False], IS_WORD[data], [False]))
    edge = np.flatnonzero(inside[1:] != inside[:-1])
    start, end = edge[::2], edge[1::2]
    text = np.searchsorted(starts, start, side="right") - 1
    one = word_checksums(data, start, end)
    pair = np.flatnonzero(text[1:] == text[:-1])
    blank = CRC[(one ^ np.uint32(0xFFFFFFFF) ^ 0x20) & 0xFF] ^ ((one ^ np.uint32(0xFFFFFFFF)) >> np.uint32(8)) ^ np.uint32(0xFFFFFFFF)
    two = together(blank[pair], one[pair + 1], (end - start)[pair + 1])
    bucket = np.concatenate((one, two)) % np.uint32(BUCKETS)
    return bucket.astype(np.int64), np.concatenate((text, text[pair])), np.bincount(text, minlength=len(texts))


def _histogram(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    total = np.zeros(BUCKETS, dtype=np.int64)
    for batch in batches:
        for part in slices(batch):
            total += np.bincount(features(part["text"].tolist())[0], minlength=BUCKETS)
    at = np.flatnonzero(total)
    yield pd.DataFrame({"bucket": at, "n": total[at]})


def bucket_counts(docs: DataFrame) -> np.ndarray:
    """Features of all texts by bucket; the driver gets BUCKETS numbers."""
    found = docs.select(F.col("text").cast("string").alias("text")).mapInPandas(_histogram, "bucket long, n long")
    out = np.zeros(BUCKETS, dtype=np.int64)
    for r in found.groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r["bucket"]] = r["n"]
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """What each bucket gains in the target over the corpus, in thousandths of a natural logarithm, rounded down."""
    s_all, t_all = int(corpus.sum()), int(target.sum())
    pairs = zip(corpus.tolist(), target.tolist(), strict=True)
    return np.array([math.floor(1000 * math.log((t + 1) * (s_all + BUCKETS) / ((s + 1) * (t_all + BUCKETS)))) for s, t in pairs], dtype=np.int64)


def noise(doc_id: str, seed: int) -> int:
    h = int(hashlib.sha256(f"{seed}:{doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


SCORED = "doc_id string, n_features long, n_words long, weight long, score long"


def _score(gain: np.ndarray, seed: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for part in slices(batch):
                bucket, text, n_words = features(part["text"].tolist())
                n = np.bincount(text, minlength=len(part))
                total = np.zeros(len(part), dtype=np.int64)
                np.add.at(total, text, gain[bucket])
                weight = np.floor_divide(total, np.maximum(n, 1))
                score = [None if i is None else w + noise(i, seed) for i, w in zip(part["doc_id"], weight.tolist(), strict=True)]
                out = {"doc_id": part["doc_id"], "n_features": n, "n_words": n_words, "weight": weight}
                yield pd.DataFrame(out | {"score": pd.array(score, dtype="Int64")})

    return run


def scores(docs: DataFrame, gain: np.ndarray, seed: int = SEED) -> DataFrame:
    """docs(doc_id, text, ...) -> doc_id, n_features, n_words, weight, score of each row. A null text has no features and
    the weight 0; a row without a doc_id has no noise and so a null score; other columns are ignored."""
    rows = docs.select(F.col("doc_id").cast("string").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInPandas(_score(gain, seed), SCORED).withColumn("doc_id", F.col("doc_id").cast("long"))


# A key is (-score, doc_id, tie), the least is drawn first; tie tells rows apart that repeat a doc_id.
KEY = ["score", "doc_id", "tie"]
Key = tuple[int, int, int]


def _order(keys: np.ndarray) -> np.ndarray:
    return np.lexsort((keys[:, 2], keys[:, 1], keys[:, 0]))


def _below(keys: np.ndarray, pivot: Key) -> np.ndarray:
    """Which keys are at or below the pivot."""
    a, b, c = (keys[:, k] for k in range(3))
    x, y, z = pivot
    return (a < x) | (a == x) & ((b < y) | (b == y) & (c <= z))


def _keys(batches: Iterator[pd.DataFrame], low: Key | None, high: Key | None) -> np.ndarray:
    """Keys of a partition above low, and at or below high."""
    out = []
    for b in batches:
        keys = np.column_stack((-b["score"].to_numpy(np.int64), b["doc_id"].to_numpy(np.int64), b["tie"].to_numpy(np.int64)))
        keep = np.ones(len(keys), dtype=bool)
        if low is not None:
            keep &= ~_below(keys, low)
        if high is not None:
            keep &= _below(keys, high)
        out.append(keys[keep])
    return np.concatenate(out) if out else np.zeros((0, 3), dtype=np.int64)


MEDIANS = "n long, a long, b long, c long"


def _median(low: Key | None, high: Key | None):
    """The lower median of a partition's open keys, and how many these are."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        keys = _keys(batches, low, high)
        if len(keys):
            a, b, c = keys[_order(keys)[(len(keys) - 1) // 2]].tolist()
            yield pd.DataFrame({"n": [len(keys)], "a": [a], "b": [b], "c": [c]})

    return run


def _at_or_below(low: Key | None, high: Key | None, pivot: Key):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        yield pd.DataFrame({"n": [int(_below(_keys(batches, low, high), pivot).sum())]})

    return run


def cutoff(rows: DataFrame, draw: int) -> Key | None:
    """The draw-th least key of rows(score, doc_id, tie), exactly; None if draw is 0. There are draw rows at least.

    In each round the driver gets a median and a count from each partition. At least half of the partitions, by weight,
    have their median on either side of the weighted median, and half of each such partition lies beyond its own median:
    a quarter of the open keys goes in each round at least, whatever their distribution.
    """
    if draw <= 0:
        return None
    rows = rows.select(*KEY)
    low = high = None
    while True:
        medians = rows.mapInPandas(_median(low, high), MEDIANS).collect()
        medians.sort(key=lambda r: (r["a"], r["b"], r["c"]))
        open_ = sum(r["n"] for r in medians)
        if open_ <= FEW:
            break
        reached = np.cumsum([r["n"] for r in medians])
        m = medians[int(np.searchsorted(reached, -(-open_ // 2)))]
        pivot = (m["a"], m["b"], m["c"])
        below = rows.mapInPandas(_at_or_below(low, high, pivot), "n long").agg(F.sum("n")).first()[0]
        if draw <= below:
            high = pivot
        else:
            low, draw = pivot, draw - below

    def rest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        yield pd.DataFrame(_keys(batches, low, high), columns=["a", "b", "c"])

    keys = sorted((r["a"], r["b"], r["c"]) for r in rows.mapInPandas(rest, "a long, b long, c long").collect())
    return keys[draw - 1]


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, seed: int = SEED, least_words: int = LEAST_WORDS) -> DataFrame:
    """docs(doc_id, text, ...), target(text, ...) -> a row per row of docs: doc_id, n_features, weight, score, rank.

    floor(percent * N / 100) of the N rows with `least_words` words or more are drawn, those with the highest scores, ties
    to the smaller doc_id; rank is 1, 2, 3, ... in that order, null for the others. Rows without a doc_id have a null
    score, aren't drawn and don't count in N; rows that repeat a doc_id are drawn as rows of their own. Null and empty
    texts have no features. An empty table gives an empty result; with an empty target all gains come from the corpus.
    """
    spark = docs.sparkSession
    gain = gains(bucket_counts(docs), bucket_counts(target))
    rows = written(scores(docs, gain, seed).withColumn("tie", F.monotonically_increasing_id()), "op13-scores")
    eligible = rows.where((F.col("n_words") >= least_words) & F.col("score").isNotNull())
    draw = percent * eligible.count() // 100
    last = cutoff(eligible, draw)
    kept = ["doc_id", "n_features", "weight", "score"]
    if last is None:
        return rows.select(*kept, F.lit(None).cast("long").alias("rank"))
    score, doc_id, tie = -last[0], last[1], last[2]
    drawn = (F.col("n_words") >= least_words) & F.expr(
        f"score > {score} OR score = {score} AND (doc_id < {doc_id} OR doc_id = {doc_id} AND tie <= {tie})"
    )
    drawn = F.coalesce(drawn, F.lit(False))
    others = rows.where(~drawn).select(*kept, F.lit(None).cast("long").alias("rank"))
    return others.unionByName(_ranked(rows.where(drawn), partitions(spark)).select(*kept, "rank"))


def _ranked(rows: DataFrame, parts: int) -> DataFrame:
    """rows with their rank by key: ranges are sorted each by itself, and numbered on from the counts of those before."""
    key = [F.desc("score"), F.asc("doc_id"), F.asc("tie")]
    ranges = written(rows.repartitionByRange(parts, *key).withColumn("range", F.spark_partition_id()), "op13-drawn")
    counts = sorted((r["range"], r["count"]) for r in ranges.groupBy("range").count().collect())
    before, offsets = 0, []
    for at, n in counts:
        offsets.append((at, before))
        before += n
    offsets = rows.sparkSession.createDataFrame(offsets, "range int, offset long")  # a row for each range
    inside = F.row_number().over(Window.partitionBy("range").orderBy(*key))
    return ranges.withColumn("inside", inside).join(F.broadcast(offsets), "range").withColumn("rank", F.col("offset") + F.col("inside"))


def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    common.prepare(spark)
    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
