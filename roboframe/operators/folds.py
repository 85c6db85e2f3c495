"""Folds over the ordered rows of a key, in constant memory: no key is an array or a frame."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def fingerprints(rows: DataFrame, key: str, value: str, first: int = 10, between: str = "\n") -> DataFrame:
    """rows(key, value) -> key, n, first (the least values), fingerprint: md5 of all values of the key in their order, put
    together with `between`.

    Rows are dealt by key and sorted in their partition; a task reads them batch by batch and keeps one digest, so that a
    key with a third of all rows takes time, for a digest is a chain, but no memory. Null values are left out, repeated ones
    count each time; a null key is a key; a key without values has no row.
    """
    name = f"`{key}`"

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, digest, n, least = None, None, 0, []

        def done() -> pa.RecordBatch:
            columns = [pa.array([now[0]], kind), pa.array([n], pa.int64()), pa.array([least], pa.list_(pa.string())), pa.array([digest.hexdigest()])]
            return pa.RecordBatch.from_arrays(columns, names=["k", "n", "first", "fingerprint"])

        kind = None
        for batch in batches:
            kind = batch.schema.field(0).type
            for k, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if now != (k,):
                    if now is not None:
                        yield done()
                    now, digest, n, least = (k,), hashlib.md5(), 0, []
                elif n:
                    digest.update(between.encode())
                digest.update(v.encode())
                n += 1
                if n <= first:
                    least.append(v)
        if now is not None:
            yield done()

    rows = rows.where(F.col(value).isNotNull()).select(F.col(name).alias("k"), F.col(value).cast("string").alias("v"))
    sorted_ = rows.repartition("k").sortWithinPartitions("k", "v")
    out = sorted_.mapInArrow(fold, f"k {dict(rows.dtypes)['k']}, n long, first array<string>, fingerprint string")
    return out.withColumnRenamed("k", key)
