"""Exact top-k by exhaustive term-at-a-time accumulation.

A vector's terms are its dimensions, the postings of a term are the rows of a block with a weight there. For each term
of a query row its weight times the posting weights is scattered into the query's array of scores; a partition
selection then keeps the k best of the block, and the blocks' bests are merged, in the task first. Candidate blocks stay
where they are; query blocks come to them in passes of a bounded size, each pass written before the next one starts.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from math import ceil

import numpy as np
import pandas as pd
from pyspark import Broadcast, TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common
from .common import discard, table, written

CANDIDATES = 8192
QUERIES = 512
#: Components and ids of all queries of a pass, about: 16 MB at eight bytes each, which the driver and each task hold.
PASS = 1 << 21
SCALE = 64


def quantized(vectors: list) -> np.ndarray:
    v = np.floor(np.asarray(vectors, dtype=np.float64) * SCALE)
    if (np.abs(v) >= 2.0**63).any():
        raise ValueError(f"a component times {SCALE} is not a 64-bit integer")
    return v.astype(np.int64)


def _pack(rows: int):
    """(id, v) -> blocks of at most `rows` rows: block number, ids, and the matrix row by row in the least integer type."""

    def block(part: int, number: int, ids: list, vectors: list) -> pd.DataFrame:
        order = np.argsort(np.array(ids, dtype=np.int64), kind="stable")
        i = np.array(ids, dtype=np.int64)[order]
        m = np.stack(vectors)[order]
        kind = next(k for k in ("<i1", "<i2", "<i4", "<i8") if m.max(initial=0) <= np.iinfo(k).max and m.min(initial=0) >= np.iinfo(k).min)
        row = ((part << 32) + number, m.shape[1], i.tobytes(), kind, m.astype(kind).tobytes())
        return pd.DataFrame([row], columns=["block", "dims", "ids", "kind", "m"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[int, tuple[list, list]] = {}
        part, number = TaskContext.get().partitionId(), 0
        for batch in batches:
            for i, v in zip(batch["id"], batch["v"], strict=True):
                ids, vectors = held.setdefault(len(v), ([], []))
                ids.append(i)
                vectors.append(quantized(v))
                if len(ids) == rows:
                    yield block(part, number, ids, vectors)
                    number += 1
                    del held[len(v)]
        for ids, vectors in held.values():
            yield block(part, number, ids, vectors)
            number += 1

    return run


def _largest(m: np.ndarray) -> float:
    return max(float(m.max(initial=0)), -float(m.min(initial=0)))


def accumulate(queries: np.ndarray, columns: list[tuple[np.ndarray, np.ndarray]], rows: int) -> np.ndarray:
    """Scores of each query against `rows` candidates, term at a time: columns[d] = (rows, weights) of dimension d."""
    scores = np.zeros((len(queries), rows), dtype=queries.dtype)
    for d, (at, weight) in enumerate(columns):
        having = np.flatnonzero(queries[:, d])
        if not len(having) or not len(at):
            continue
        if 2 * len(at) > rows:  # a posting list of most rows is held as a full column
            full = np.zeros(rows, dtype=queries.dtype)
            full[at] = weight
            for q in having:
                scores[q] += queries[q, d] * full
        else:
            for q in having:
                scores[q, at] += queries[q, d] * weight
    return scores


def _best(k: int, asked: Broadcast):
    """Candidate blocks -> the k best candidates that the task has for each query of the pass."""

    def merge(held: tuple | None, score: np.ndarray, ids: np.ndarray, real: np.ndarray) -> tuple:
        if held is not None:
            score, ids, real = (np.concatenate(x, axis=1) for x in zip(held, (score, ids, real), strict=True))
        first = np.lexsort((ids, ~score, ~real), axis=-1)[:, :k]  # ~score falls as the score grows, without overflow
        return tuple(np.take_along_axis(x, first, axis=1) for x in (score, ids, real))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        queries = []
        for block, dims, ids, kind, m in asked.value:
            q_ids = np.frombuffer(ids, dtype=np.int64)
            queries.append((block, dims, q_ids, np.frombuffer(m, dtype=kind).astype(np.int64).reshape(len(q_ids), dims)))
        held: dict[int, tuple] = {}
        for batch in batches:
            for r in batch.itertuples(index=False):
                c_ids = np.frombuffer(r.ids, dtype=np.int64)
                c = np.frombuffer(r.m, dtype=r.kind).astype(np.int64).reshape(len(c_ids), r.dims)
                high, columns = _largest(c), {}
                for n, (_, dims, q_ids, q) in enumerate(queries):
                    if dims != r.dims:
                        continue
                    largest = _largest(q) * high * dims
                    # sums below 2**31 in half the bytes; sums that may not fit into 64 bits in Python's integers
                    kind = np.int32 if largest < 2**31 else np.int64 if largest < 2**62 else object
                    if kind not in columns:
                        x = c.astype(kind)
                        columns[kind] = [(at := np.flatnonzero(x[:, d]), x[at, d]) for d in range(dims)]
                    score = np.zeros((len(q_ids), k), dtype=np.int64)
                    ids, real = np.zeros_like(score), np.zeros(score.shape, dtype=bool)
                    for a in range(0, len(q_ids), 64):
                        scores = accumulate(q[a : a + 64].astype(kind), columns[kind], len(c_ids))
                        for row, (s, v) in enumerate(_select(q_ids[a : a + 64], scores, c_ids, k), a):
                            score[row, : len(s)], ids[row, : len(s)], real[row, : len(s)] = s, v, True
                    held[n] = merge(held.get(n), score, ids, real)
        for n, (score, ids, real) in held.items():
            block, _, q_ids, _ = queries[n]
            row = np.nonzero(real)[0]
            yield pd.DataFrame({"query_id": q_ids[row], "q_block": block, "q_row": row, "score": score[real], "vec_id": ids[real]})

    return run


def _select(q_ids: np.ndarray, scores: np.ndarray, c_ids: np.ndarray, k: int) -> list:
    """k largest scores of each row, ties to the smaller id (c_ids ascend), the query's own id left out."""
    n = len(c_ids)
    own_from, own_to = np.searchsorted(c_ids, q_ids), np.searchsorted(c_ids, q_ids, side="right")
    out = []
    for r in range(len(q_ids)):
        s = scores[r]
        own = int(own_to[r] - own_from[r])
        want = min(n, k + own)
        at = np.arange(n)
        if want < n:
            edge = np.partition(s, n - want)[n - want]
            above = np.flatnonzero(s > edge)
            at = np.concatenate((above, np.flatnonzero(s == edge)[: want - len(above)]))
            if own:  # own rows may push ties out: take k others at the edge
                tie = np.flatnonzero(s == edge)
                tie = tie[(tie < own_from[r]) | (tie >= own_to[r])]
                at = np.concatenate((above, tie[:k]))
        at = at[(at < own_from[r]) | (at >= own_to[r])]
        if s.dtype == object and any(abs(x) >= 1 << 63 for x in s[at]):
            raise ValueError("a score is not a 64-bit integer")
        at = at[np.lexsort((at, -s[at].astype(np.int64)))][:k]
        out.append((s[at].astype(np.int64), c_ids[at]))
    return out


def top_k(vectors: DataFrame, is_query, k: int = 20) -> DataFrame:
    """vectors(vec_id, embedding, ...) and a condition on their columns -> query_id, rank, vec_id, score.

    Components become floor(64 * x); the score is the integer inner product; each query gets its k highest scores
    among all rows with another vec_id, ties to the smaller vec_id. Rows take no part if vec_id or the vector is null,
    or a component is null, NaN or infinite. Sums are exact: where 64 bits may not hold them Python's integers do, and a component or a best score that
    is no 64-bit integer is an error, not another number. Vectors of different lengths are not compared; empty vectors score 0.
    Rows that repeat a vec_id are candidates each, and as queries give their own rows each. Other columns are ignored.
    """
    good = vectors.select(
        F.col("vec_id").cast("long").alias("id"), F.col("embedding").cast("array<double>").alias("v"), is_query.alias("q")
    ).where("id IS NOT NULL AND v IS NOT NULL")
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    good = good.where(finite)
    schema = "block long, dims int, ids binary, kind string, m binary"
    session = vectors.sparkSession
    blocks = written(good.select("id", "v").mapInPandas(_pack(CANDIDATES), schema), "op7-candidates")
    asked = written(good.where("q").select("id", "v").mapInPandas(_pack(QUERIES), schema), "op7-queries")
    components = asked.agg(F.sum((F.col("dims") + 1) * F.length("ids") / 8)).first()[0] or 0
    passes = max(1, ceil(components / PASS))
    order = Window.partitionBy("query_id", "q_block", "q_row").orderBy(F.desc("score"), "vec_id")
    best = []
    for n in range(passes):
        rows = asked.where(F.pmod(F.xxhash64("block"), F.lit(passes)) == n).collect()
        held = session.sparkContext.broadcast([(r["block"], r["dims"], bytes(r["ids"]), r["kind"], bytes(r["m"])) for r in rows])
        found = blocks.mapInPandas(_best(k, held), "query_id long, q_block long, q_row int, score long, vec_id long")
        ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        best.append(written(ranked.select("query_id", "rank", "vec_id", "score"), "op7-best"))
        held.destroy()
    discard(blocks, asked)
    return reduce(DataFrame.unionByName, best)


def op7_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    common.prepare(spark)
    return top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


ORACLE_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2])) AS BIGINT) AS score
      FROM v q, v c WHERE q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""
