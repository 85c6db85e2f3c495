"""Bounded samples of labelled rows for fitting."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

GRAIN = 1_000_000
#: Values whose shares are broadcast, at most.
BROADCAST = 100_000


def bounded(rows: DataFrame, stratum: str, key: str, most: int) -> DataFrame:
    """About `most` rows of each value of `stratum` (1.2 times that at most, up to chance), the same ones on every run:
    those whose hash of `key` is below a share that one count of the whole table sets. All rows where there are fewer.
    Any number of values will do: their shares are joined, by a broadcast where they are BROADCAST or fewer. Rows without a
    value are left out."""
    counts = rows.groupBy(F.col(stratum).alias("_stratum")).agg(F.count("*").alias("_n"))
    few = counts.count() <= BROADCAST
    share = counts.select("_stratum", F.least(F.lit(GRAIN), F.lit(1.1 * most * GRAIN) / F.col("_n")).cast("int").alias("_share"))
    near = rows.join(F.broadcast(share) if few else share, F.col(stratum) == F.col("_stratum"))
    return near.where(F.pmod(F.xxhash64(F.col(key)), F.lit(GRAIN)) < F.col("_share")).drop("_stratum", "_share")


def remainder(key: str, of: int):
    """crc32 of the key as text, modulo `of`."""
    return F.crc32(F.col(key).cast("string").cast("binary")) % of
