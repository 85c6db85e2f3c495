"""Rows that can't be used, with the reason: told apart from the good ones in the pass that finds them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .files import scratch


def split(rows: DataFrame, stage: str, row: Column, reason: str = "reason") -> tuple[DataFrame, DataFrame]:
    """rows with a reason (null for good ones) -> the good rows without it, and the rejects: stage, row, reason.

    Both are written by one job, each to a folder of its own, and read back: the source is read once, however often the
    two are used. row: what names a row, as text.
    """
    spark, root = rows.sparkSession, scratch(rows.sparkSession)
    good = [c for c in rows.columns if c != reason]
    bad = F.col(reason).isNotNull()
    kept = F.when(~bad, F.struct(*good)).alias("good")
    told = F.when(bad, F.struct(F.lit(stage).alias("stage"), row.cast("string").alias("row"), F.col(reason).alias("reason"))).alias("rejected")
    out = rows.select(kept, told, bad.alias("is_rejected"))
    out.write.partitionBy("is_rejected").parquet(root)
    both = spark.read.schema(out.schema).parquet(root)
    return both.where("NOT is_rejected").select("good.*"), both.where("is_rejected").select("rejected.*")
