"""From a source's frames to shards of windows, as one job that can be cut off and begun again."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources import files, tars
from . import statistics as S
from . import windows as W

#: Where a slice's size isn't given: the least number of shards to a job, and the most jobs of a call.
LEAST, JOBS = 64, 16


def shards_there(spark: SparkSession, root: str) -> DataFrame:
    """The manifest: the ledger of what is done."""
    fs, path = files.file_system(spark, root)
    if not fs.exists(path(f"{root}/shards/{tars.MANIFEST}")):
        return spark.createDataFrame([], files.MANIFEST)
    return files.read_manifest(spark, f"{root}/shards/{tars.MANIFEST}")


def convert(frames: DataFrame, root: str, past: int, future: int, most_past: int, most_future: int, per_shard: int = 16,
            slice_: int | None = None, most_slices: int | None = None) -> int:
    """frames(episode, ts, ordinal, x) -> under root: shards of window samples (`per_shard` episodes of consecutive numbers to a
    shard, samples in the order of episode and step), their manifest, and moments for each slot of the windows.

    The shards that the manifest lacks are made, `slice_` of them to a job, until none is left or `most_slices` are done; the
    number of those that were still to do is returned. Where `slice_` isn't given it is LEAST, or what makes JOBS jobs of all that
    is left: jobs don't grow in number, nor does reading the manifest for each. Frames are read twice, once for the numbers of
    their shards, once to deal them over the slices; a slice reads its own. It first writes the moments of its shards, to a folder
    of its try, then the shards; the sink's commit enters these in the manifest. So a job that breaks off anywhere is begun again
    with the same call, does what is left, and ends with the same shards, manifest and moments.
    Frames without an episode are left out. The driver gets the numbers of the shards that are left.
    """
    spark = frames.sparkSession
    shard = F.floor(F.col("episode") / per_shard).cast("int")
    frames = frames.where("episode IS NOT NULL").withColumn("shard", shard)
    name = F.format_string("shard_%06d", "shard")
    wanted = frames.select("shard").distinct().withColumn("name", name)
    left = wanted.join(shards_there(spark, root).select(F.col("shard").alias("name")), "name", "left_anti")
    left = [r["shard"] for r in left.orderBy("shard").collect()]
    slice_ = slice_ or max(LEAST, -(-len(left) // JOBS))
    slices = [left[at : at + slice_] for at in range(0, len(left), slice_)][:most_slices]
    dealt = _dealt(frames, slices) if slices else None
    for k, shards in enumerate(slices):
        own = dealt.where(F.col("slice") == k).drop("slice")
        samples = W.window_samples(W.episode_timesteps(own), past, future, most_past, most_future)
        samples = files.kept(samples.select("shard", "episode", "t", "window", "past_mask", "future_mask"))
        moments = S.masked_moments(S.slots(samples, keep=("shard",)), ("shard", "t"))
        moments.write.parquet(f"{root}/moments/try={_tries(spark, root)}")
        fields = F.create_map(F.lit("json"), F.to_json(F.struct("episode", "t", "window", "past_mask", "future_mask")).cast("binary"))
        key = F.format_string("e%08d_t%08d", "episode", "t")
        tars.write_tar_shards(samples.select("shard", key.alias("key"), fields.alias("fields")), f"{root}/shards")
        # shards whose episodes have no window that may stay are entered with no samples, so that they aren't tried again
        tars.enter(f"{root}/shards", [(tars.shard_name(x), 0) for x in shards])
    return len(left) - sum(map(len, slices))


def _dealt(frames: DataFrame, slices: list[list[int]]) -> DataFrame:
    """The frames of the slices' shards with the slice's number, in the shared folder, a folder to a slice."""
    spark, path = frames.sparkSession, files.scratch(frames.sparkSession)
    numbers = pa.table({"shard": pa.array([x for s in slices for x in s], pa.int32()), "slice": pa.array([k for k, s in enumerate(slices) for _ in s], pa.int32())})
    out = frames.join(F.broadcast(spark.createDataFrame(numbers)), "shard")
    out.hint("rebalance", F.col("slice")).write.partitionBy("slice").parquet(path)
    return spark.read.schema(out.schema).parquet(path)


def _tries(spark: SparkSession, root: str) -> int:
    """The number of the next try to write moments: one more than any before."""
    fs, path = files.file_system(spark, root)
    if not fs.exists(path(f"{root}/moments")):
        return 0
    return 1 + max((int(x.getPath().getName().removeprefix("try=")) for x in fs.listStatus(path(f"{root}/moments")) if x.getPath().getName().startswith("try=")), default=-1)


def converted_moments(spark: SparkSession, root: str) -> DataFrame:
    """Moments for each slot over all shards of the manifest; those of a shard are of its last try."""
    parts = spark.read.schema("t int, n long, mean double, m2 double, min double, max double, nan_count long, shard int, try int").parquet(f"{root}/moments")
    there = shards_there(spark, root).select(F.regexp_extract("shard", r"(\d+)$", 1).cast("int").alias("shard"))
    last = F.max("try").over(Window.partitionBy("shard"))
    parts = parts.join(there, "shard").withColumn("last", last).where("try = last").drop("try", "last")
    return S.merge_moments(parts, ("t",))
