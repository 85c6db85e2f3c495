"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

The patterns are the distinct windows of the benchmark items, grouped by their length m. A table gives for each block
of words the shift that no occurrence can be missed by; blocks that end a pattern have shift 0 and lead to the bucket
of the patterns with that suffix, whose words are then compared, and whose bytes are compared last. Many cursors run
over the words of a batch in step, so that each table look-up is one array operation.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from math import ceil

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .common import LOWER, discard, joined, mix, slices, table, words, written

#: Bytes of words after lower-casing: digits, a-z and all of non-ASCII characters.
WORD = np.zeros(256, dtype=bool)
WORD[0x30:0x3A] = WORD[0x61:0x7B] = WORD[0x80:] = True
#: Patterns that a task holds at once; a larger benchmark is searched for in several passes.
PATTERNS_PER_PASS = 100_000
#: Slots of a shift table for each block of a pattern, so that most blocks of a text find an empty one and are skipped.
SLOTS_PER_BLOCK = 8
LANE = 256


def text_words(texts: list):
    data, starts = joined(texts)
    data = LOWER[data]
    start, end, h, text_of = words(data, starts, WORD)
    return data, start, end, h, np.searchsorted(text_of, np.arange(len(texts) + 1))


def item_windows(width: int):
    """(item_id, text) -> (item_id, length, body): the windows of each item, words joined by blanks."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for part in slices(batch):
                data, start, end, _, first = text_words(part["text"].tolist())
                raw = data.tobytes()
                rows = []
                for i, item in enumerate(part["item_id"]):
                    w = [raw[s:e] for s, e in zip(start[first[i] : first[i + 1]], end[first[i] : first[i + 1]], strict=True)]
                    m = min(width, len(w))
                    rows += [(item, m, b" ".join(w[j : j + m])) for j in range(len(w) - m + 1) if m]
                yield pd.DataFrame(rows, columns=["item_id", "length", "body"])

    return run


class Patterns:
    """The search tables of patterns of one length."""

    def __init__(self, length: int, bodies: list[bytes], ids: np.ndarray):
        self.m, self.b = length, min(3, length)
        data, starts = joined([x.decode("utf-8", "surrogatepass") for x in bodies])
        _, _, h, _ = words(data, starts, WORD)
        h = h.reshape(len(bodies), length)
        suffix = self.block(h, np.full(len(bodies), length - 1))
        order = np.argsort(suffix)
        self.suffix, self.hash, self.ids = suffix[order], h[order], ids[order]
        self.bodies = [bodies[i] for i in order]
        self.bits = max(12, (SLOTS_PER_BLOCK * len(bodies) * (length - self.b + 1)).bit_length())
        self.shift = np.full(1 << self.bits, length - self.b + 1, dtype=np.int32)
        for end in range(self.b - 1, length):
            at = self.slot(self.block(h, np.full(len(bodies), end)))
            np.minimum.at(self.shift, at, length - 1 - end)

    def block(self, h: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Hash of the block of words that ends at `at`."""
        rows = (np.arange(len(at)),) if h.ndim == 2 else ()
        total = np.zeros(len(at), dtype=np.uint64)
        with np.errstate(over="ignore"):
            for j in range(self.b):
                total = (total + h[(*rows, at - j)]) * np.uint64(0xD1342543DE82EF95)
        return mix(total)

    def slot(self, block: np.ndarray) -> np.ndarray:
        return (block >> np.uint64(64 - self.bits)).astype(np.int64)

    def search(self, data, start, end, h, first) -> tuple[np.ndarray, np.ndarray]:
        """Last word of each occurrence, and the pattern's place."""
        lo, hi = first[:-1] + self.m - 1, first[1:]
        lanes = np.maximum(0, -(-(hi - lo) // LANE))
        text = np.repeat(np.arange(len(lo)), lanes)
        step = np.arange(len(text)) - np.repeat(np.cumsum(lanes) - lanes, lanes)
        at = lo[text] + step * LANE
        stop = np.minimum(at + LANE, hi[text])
        found, keys = [], []
        while len(at):
            block = self.block(h, at)
            shift = self.shift[self.slot(block)]
            zero = shift == 0
            found.append(at[zero])
            keys.append(block[zero])
            at = at + np.maximum(shift, 1)
            live = at < stop
            at, stop = at[live], stop[live]
        none = np.zeros(0, dtype=np.int64)
        if not found:
            return none, none
        at, keys = np.concatenate(found), np.concatenate(keys)
        low, high = np.searchsorted(self.suffix, keys), np.searchsorted(self.suffix, keys, side="right")
        size = high - low
        place = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size - low, size)
        at = np.repeat(at, size)
        for j in range(self.m):
            same = h[at - self.m + 1 + j] == self.hash[place, j]
            at, place = at[same], place[same]
        sure = np.ones(len(at), dtype=bool)
        for i, (a, p) in enumerate(zip(at, place, strict=True)):
            span = range(a - self.m + 1, a + 1)
            sure[i] = b" ".join(data[start[j] : end[j]].tobytes() for j in span) == self.bodies[p]
        return at[sure], place[sure]


def _scan(groups: list[tuple[int, list[bytes], np.ndarray]]):
    """(doc_id, row, text) -> (doc_id, row, n_words, hits, windows): hits = word intervals [from, to), flat."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        patterns = [Patterns(*g) for g in groups]
        for batch in batches:
            for part in slices(batch):
                got = text_words(part["text"].tolist())
                first, n = got[4], len(part)
                change = np.zeros(first[-1] + 1, dtype=np.int64)
                texts, ids = [], []
                for p in patterns:
                    at, place = p.search(*got)
                    np.add.at(change, at - p.m + 1, 1)
                    np.add.at(change, at + 1, -1)
                    texts.append(np.searchsorted(first, at, side="right") - 1)
                    ids.append(p.ids[place])
                texts = np.concatenate(texts) if texts else np.zeros(0, dtype=np.int64)
                ids = np.concatenate(ids) if ids else np.zeros(0, dtype=np.int64)
                hits = [[] for _ in range(n)]
                windows = [[] for _ in range(n)]
                covered = np.cumsum(change) > 0
                for i in np.unique(texts):
                    windows[i] = np.unique(ids[texts == i])
                    edge = np.diff(covered[first[i] : first[i + 1]].astype(np.int8), prepend=0, append=0)
                    hits[i] = np.flatnonzero(edge)
                yield pd.DataFrame(
                    {
                        "doc_id": part["doc_id"].array,
                        "row": part["row"].array,
                        "n_words": np.diff(first),
                        "hits": hits,
                        "windows": windows,
                    }
                )

    return run


def decontaminate(docs: DataFrame, benchmark: DataFrame, width: int = 10) -> DataFrame:
    """docs(doc_id, text, ...), benchmark(item_id, text, ...) -> one row per row of docs: doc_id, n_words, n_hit,
    n_items, items_sha256, contaminated, hits (hit word intervals [from, to), flat), items (sorted as strings).

    Words are runs of digits, a-z (A-Z lower-cased) and non-ASCII characters. A window is `width` consecutive words of
    an item; an item of fewer words is one window, an item without words has none. A word inside an occurrence of any
    window is hit. Null or empty texts have no words; rows that repeat, or repeat a doc_id, are searched and returned
    each; a null doc_id stays null; items with a null item_id count as hits but not as items; other columns are
    ignored. With an empty benchmark nothing is hit.
    """
    items = benchmark.select("item_id", F.col("text").cast("string").alias("text"))
    kind = dict(items.dtypes)["item_id"]
    windows = items.mapInPandas(item_windows(width), f"item_id {kind}, length int, body binary")
    windows = windows.withColumn("window", F.xxhash64("length", "body"))
    windows = written(windows.select("item_id", "length", "body", "window").distinct(), "op4-windows")
    distinct = windows.select("length", "body", "window").distinct()
    passes = max(1, ceil(distinct.count() / PATTERNS_PER_PASS))
    source = docs.select("doc_id", F.col("text").cast("string").alias("text"), F.monotonically_increasing_id().alias("row"))
    if passes > 1:
        source = written(source, "op4-source")  # so that a row has the same number in each pass
    doc_kind = dict(source.dtypes)["doc_id"]
    schema = f"doc_id {doc_kind}, row long, n_words long, hits array<int>, windows array<long>"
    found = []
    for k in range(passes):
        block = distinct.where(F.pmod("window", F.lit(passes)) == k).orderBy("length", "window").collect()
        groups = []
        for m in sorted({r["length"] for r in block}):
            rows = [r for r in block if r["length"] == m]
            groups.append((m, [bytes(r["body"]) for r in rows], np.array([r["window"] for r in rows], dtype=np.int64)))
        got = source.mapInPandas(_scan(groups), schema)
        found.append(written(got if k == 0 else got.where("size(hits) > 0"), "op4-found"))  # a pass holds its patterns alone
    if passes > 1:
        discard(source)
    found = found[0] if passes == 1 else _merge(found)
    pairs = found.select("row", F.explode("windows").alias("window"))
    pairs = pairs.join(windows.where("item_id IS NOT NULL").select("window", "item_id"), "window")
    named = pairs.groupBy("row").agg(F.array_sort(F.collect_set(F.col("item_id").cast("string"))).alias("items"))
    runs = F.expr("aggregate(sequence(1, size(hits), 2), 0L, (a, i) -> a + hits[i] - hits[i - 1])")
    n_hit = F.when(F.size("hits") > 0, runs).otherwise(F.lit(0).cast("long"))
    out = found.join(named, "row", "left").withColumn("items", F.coalesce("items", F.expr("array()").cast("array<string>")))
    return out.select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
        "hits",
        "items",
    )


def _merge(found: list[DataFrame]) -> DataFrame:
    """Unite what several passes found in the same row: the first has all rows, the others those with hits."""
    first, more = found[0], reduce(DataFrame.unionByName, found[1:]).select("row", "hits", "windows")
    pairs = "transform(filter(sequence(0, size(hits) - 1), i -> i % 2 = 0), i -> struct(hits[i] as a, hits[i + 1] as b))"
    more = more.unionByName(first.where("size(hits) > 0").select("row", "hits", "windows"))
    more = more.select("row", F.expr(pairs).alias("spans"), "windows").groupBy("row").agg(
        F.array_sort(F.flatten(F.collect_list("spans"))).alias("spans"),
        F.array_distinct(F.flatten(F.collect_list("windows"))).alias("windows"),
    )
    # spans in their order: one that starts where the last one goes on lengthens it
    united = """aggregate(spans, cast(array() as array<int>), (s, x) ->
        CASE WHEN size(s) = 0 OR x.a > s[size(s) - 1] THEN concat(s, array(x.a, x.b))
             WHEN x.b > s[size(s) - 1] THEN concat(slice(s, 1, size(s) - 1), array(x.b)) ELSE s END)"""
    more = more.select("row", F.expr(united).alias("all"), F.col("windows").alias("named"))
    out = first.drop("windows").join(more, "row", "left")
    windows = F.coalesce("named", F.expr("cast(array() as array<bigint>)"))
    return out.select("doc_id", "row", "n_words", F.coalesce("all", "hits").alias("hits"), windows.alias("windows"))


def op4_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    common.prepare(spark)
    out = decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.drop("hits", "items")


ORACLE_SQL = r"""
WITH low AS (
  SELECT doc_id AS id, 0 AS side, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents
  UNION ALL
  SELECT item_id, 1, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') FROM benchmark),
w AS (SELECT id, side, regexp_extract_all(t, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM low),
item AS (SELECT id AS item_id, w, least(10, len(w)) AS m FROM w WHERE side = 1 AND len(w) > 0),
win AS (SELECT DISTINCT item_id, m, array_to_string(w[i:i + m - 1], ' ') AS body
        FROM (SELECT item_id, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM item)),
lens AS (SELECT DISTINCT m FROM win),
doc AS (SELECT id AS doc_id, w FROM w WHERE side = 0),
pos AS (SELECT doc_id, m, unnest(range(1, len(w) - m + 2)) AS i, w FROM doc, lens WHERE len(w) >= m),
occ AS (SELECT p.doc_id, p.m, p.i, b.item_id
        FROM (SELECT doc_id, m, i, array_to_string(w[i:i + m - 1], ' ') AS body FROM pos) p JOIN win b USING (m, body)),
hit AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + m)) AS k FROM occ) GROUP BY doc_id),
named AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS items
          FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item_id FROM occ) GROUP BY doc_id)
SELECT doc.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AS contaminated
FROM doc LEFT JOIN hit USING (doc_id) LEFT JOIN named USING (doc_id)
"""
