"""Shards: manifests, seeded order, selection for a sample budget, mixing, batching."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.files import kept
from .windows import running_sums


def seeded_order(key: Column, seed: int, epoch: Column | int = 0) -> Column:
    """A hash that orders rows: every (seed, epoch) is another full permutation."""
    e = epoch if isinstance(epoch, Column) else F.lit(epoch)
    return F.md5(F.concat_ws("|", F.lit(str(seed)), e.cast("string"), key.cast("string")))


def prefix_sum(rows: DataFrame, keys: list[str], order: list[str], value: str, out: str = "cum") -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn(out, F.sum(value).over(w))


def plan_epochs(manifest: DataFrame, budget: DataFrame, seed: int, allow_more: bool = True) -> DataFrame:
    """manifest(dataset, shard, num_sequences), budget(dataset, need) -> shards in the order they are used, over as many
    epochs as the need takes, each epoch a permutation of its own. A need above one epoch raises unless allowed.

    Whole epochs need no scan: their number is need div total; one range is exploded."""
    total = manifest.groupBy("dataset").agg(F.sum("num_sequences").alias("total"))
    plan = total.join(budget, "dataset")
    if not allow_more:
        over = F.raise_error(F.lit("the budget needs more than one epoch"))
        plan = plan.withColumn("need", F.when(F.col("need") > F.col("total"), over).otherwise(F.col("need")))
    epochs = F.greatest(F.ceil(F.col("need") / F.col("total")).cast("int") - 1, F.lit(0))
    plan = plan.withColumn("epoch", F.explode(F.sequence(F.lit(0), epochs)))
    rows = manifest.join(plan, "dataset")
    rows = rows.withColumn("h", seeded_order(F.col("shard"), seed, F.col("epoch")))
    rows = prefix_sum(rows, ["dataset"], ["epoch", "h", "shard"], "num_sequences")
    w = Window.partitionBy("dataset").orderBy("epoch", "h", "shard")
    return rows.withColumn("pos", F.row_number().over(w))


def select_shards(manifest: DataFrame, weights: dict[str, float], samples: int, workers: int, seed: int, allow_more: bool = True) -> DataFrame:
    """Each dataset gets ceil(weight share * samples); shards are taken until that is reached and there is one for each
    worker, then cut to a multiple of the workers."""
    whole = sum(weights.values())
    need = F.lit(None).cast("long")
    for name, w in weights.items():
        need = F.when(F.col("dataset") == name, F.ceil(F.lit(w * samples / whole)).cast("long")).otherwise(need)
    budget = manifest.select("dataset").distinct().withColumn("need", need).where("need IS NOT NULL")
    rows = plan_epochs(manifest, budget, seed, allow_more)
    rows = rows.where((F.col("cum") - F.col("num_sequences") < F.col("need")) | (F.col("pos") <= workers))
    k = F.count("*").over(Window.partitionBy("dataset"))
    return rows.withColumn("k", k).where(F.col("pos") <= F.floor(F.col("k") / workers) * workers).drop("k")


def next_cursor(selected: DataFrame, manifest: DataFrame) -> DataFrame:
    """Where the next selection starts: epoch and position in it."""
    sizes = manifest.groupBy("dataset").agg(F.count("*").alias("shards"))
    used = selected.groupBy("dataset").agg(F.max("pos").alias("used"), F.sum("num_sequences").alias("samples"))
    rows = used.join(sizes, "dataset")
    return rows.select("dataset", F.floor(F.col("used") / F.col("shards")).alias("epoch"), (F.col("used") % F.col("shards")).alias("cursor"), "samples")


def resume(plan: DataFrame, cursors: DataFrame) -> DataFrame:
    """Shards of a plan from the saved positions on; a dataset without a cursor starts at 0."""
    rows = plan.join(cursors, "dataset", "left")
    return rows.where(F.col("pos") > F.coalesce("cursor", F.lit(0))).drop("cursor")


def mix_datasets(selected: DataFrame, seed: int) -> DataFrame:
    """Interleave datasets at random in proportion to their scheduled shards: every scheduled shard has a place by hash
    of the seed in [0, 1), all places being as likely for each dataset; `mix`, then dataset, epoch and position order."""
    h = F.md5(F.concat_ws("|", F.lit(str(seed)), "dataset", F.col("epoch").cast("string"), "shard").cast("binary"))
    return selected.withColumn("mix", F.conv(F.substring(h, 1, 7), 16, 10).cast("long") / F.lit(float(1 << 28)))


def assign_to_workers(selected: DataFrame, nodes: int, per_node: int) -> DataFrame:
    w = (F.col("pos") - 1) % (nodes * per_node)
    return selected.withColumn("node", (w % nodes).cast("int")).withColumn("worker", F.floor(w / nodes).cast("int"))


def batch_rows(rows: DataFrame, keys: list[str], order: list[str], size: int, block: Column | None = None) -> DataFrame:
    """Number rows of a worker into batches of `size`; the incomplete last one is dropped. `block`, a monotone function
    of the order, deals a worker's rows over several tasks: whole blocks are counted first."""
    rows = running_sums(rows.withColumn("_one", F.lit(1)), keys, F.lit(0) if block is None else block, order, ["_one"])
    total = rows.groupBy(*keys).agg(F.floor(F.count("*") / size).alias("_full"))
    total = F.broadcast(total.select(*[F.col(k).alias(f"_of_{k}") for k in keys], "_full"))  # a row for each worker
    rows = rows.join(total, [F.col(k).eqNullSafe(F.col(f"_of_{k}")) for k in keys]).drop(*[f"_of_{k}" for k in keys])
    rows = rows.withColumn("batch", F.floor((F.col("sum__one") - 1) / size).cast("long"))
    return rows.where("batch < _full").drop("_full", "_one", "sum__one")


def chunk_into_shards(rows: DataFrame, key: str, per_shard: int, seed: int, block_digits: int = 4) -> DataFrame:
    """Shuffled rows in groups of `per_shard` (the last may be short), numbered over all rows: a count per block of the
    hash order first, so that no task sorts everything. There are 16 ** block_digits blocks."""
    h = seeded_order(F.col(key), seed)
    rows = rows.withColumn("h", h).withColumn("_b", F.conv(F.substring("h", 1, block_digits), 16, 10).cast("int"))
    counts = rows.groupBy("_b").agg(F.count("*").alias("_n"))
    # blocks of blocks, then blocks: two short orders
    counts = counts.withColumn("_top", F.floor(F.col("_b") / 256).cast("int"))
    tops = counts.groupBy("_top").agg(F.sum("_n").alias("_t"))
    tops = tops.select("_top", F.coalesce(F.sum("_t").over(Window.orderBy("_top").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_t"))
    inside = F.sum("_n").over(Window.partitionBy("_top").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1))
    counts = counts.withColumn("_before", F.coalesce(inside, F.lit(0))).join(F.broadcast(tops), "_top")
    counts = F.broadcast(counts.select("_b", (F.col("_before") + F.col("_t")).alias("_before")))  # 16 ** block_digits rows
    n = F.row_number().over(Window.partitionBy("_b").orderBy("h", key))
    rows = rows.join(counts, "_b").withColumn("shard", F.floor((F.col("_before") + n - 1) / per_shard).cast("long"))
    return rows.drop("_b", "_before", "h")


def sum_before(rows: DataFrame, order: str, value: str, out: str) -> DataFrame:
    """The sum of a value over all rows before each one in an order of the whole table: ranges of the order are summed first,
    then each row inside its range, so that no task sees all rows. Rows are written once, by range."""
    ranges = kept(rows.repartitionByRange(order).withColumn("_range", F.spark_partition_id()))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    totals = ranges.groupBy("_range").agg(F.sum(value).alias("_sum")).withColumn("_over", F.coalesce(F.sum("_sum").over(before), F.lit(0)))
    inside = F.sum(value).over(Window.partitionBy("_range").orderBy(order).rowsBetween(Window.unboundedPreceding, -1))
    rows = ranges.withColumn(out, F.coalesce(inside, F.lit(0))).join(F.broadcast(totals.select("_range", "_over")), "_range")
    return rows.withColumn(out, F.col(out) + F.col("_over")).drop("_range", "_over")


def full_shard_plan(files: DataFrame, per_shard: int) -> DataFrame:
    """files(file, n_rows) -> complete shards of each file and the number of its first shard."""
    rows = files.withColumn("shards", F.floor(F.col("n_rows") / per_shard).cast("long"))
    return sum_before(rows, "file", "shards", "first_shard")


def transfer_states(listing: DataFrame, attempts: DataFrame, key: str, retries: int = 1) -> DataFrame:
    """listing(key, ...), attempts(key, attempt, ok) -> the number of attempts for each listed file and its state: done,
    pending (never tried), retry (failed, with a further attempt left) or failed. A file that once came is done."""
    log = attempts.groupBy(key).agg(F.max("attempt").cast("int").alias("attempts"), F.bool_or("ok").alias("_done"))
    rows = listing.join(log, key, "left").withColumn("attempts", F.coalesce("attempts", F.lit(0)))
    state = F.when(F.col("_done"), "done").when(F.col("attempts") == 0, "pending").when(F.col("attempts") <= retries, "retry").otherwise("failed")
    return rows.withColumn("state", state).drop("_done")
