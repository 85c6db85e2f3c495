"""Alignment of message channels in time: nearest as-of join and checks of timelines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import scans


def nearest_asof_join(targets: DataFrame, sources: DataFrame, keys: list[str], time: str, payload: list[str],
                      tolerance: float | None = None, ordinal: str | None = None, hot: int | None = scans.HOT) -> DataFrame:
    """For each target row the source row of its key with the nearest time: equal gaps take the earlier one, beyond
    the ends the end row. `payload` columns and `source_time` are added. A key without source rows raises, and so does
    a gap above the tolerance. One exchange by key and two window passes; no range join.

    Two one-sided scans look back from each target in either order of time, so the work is linear in the rows; a key with
    more than `hot` rows is scanned by blocks of time, to which the last and the first source come over their borders."""
    extra = [c for c in targets.columns if c not in (*keys, time)]
    order = F.col(ordinal) if ordinal else F.lit(0)
    src = sources.select(*keys, time, order.alias("_o"), F.lit(True).alias("_src"), F.struct(F.col(time).alias("_t"), *payload).alias("_p"))
    tgt = targets.select(*keys, time, F.lit(None).cast("long").alias("_o"), F.lit(False).alias("_src"), F.struct(*(extra or [F.lit(0).alias("_none")])).alias("_x"))
    c = scans.cut(tgt.unionByName(src, allowMissingColumns=True), keys, time, hot)
    c = scans.carried(c, [time, "_src", "_o"], "_p", "_before", inclusive=False)
    c = scans.carried(c, [time, "_src", "_o"], "_p", "_after", inclusive=False, backward=True)
    rows = scans.done(c).where("NOT _src")
    a, b, x = F.col("_before"), F.col("_after"), F.col(time)
    pick = (
        F.when(a.isNull() & b.isNull(), F.raise_error(F.lit("no source rows")))
        .when(b.isNull(), a)
        .when(a.isNull(), b)
        .when(x - a["_t"] <= b["_t"] - x, a)
        .otherwise(b)
    )
    rows = rows.withColumn("_pick", pick)
    if tolerance is not None:
        far = F.abs(F.col("_pick._t") - x) > tolerance
        rows = rows.withColumn("_pick", F.when(far, F.raise_error(F.lit(f"a gap is above {tolerance}"))).otherwise(F.col("_pick")))
    return rows.select(*keys, time, *[F.col(f"_x.{c}") for c in extra], F.col("_pick._t").alias("source_time"), *[F.col(f"_pick.{c}") for c in payload])


def align_to_pivot(messages: DataFrame, pivot: str, fields: list[str], keys: list[str], field: str, time: str, value: str, ordinal: str,
                   hot: int | None = scans.HOT) -> DataFrame:
    """One row per step of the pivot channel with the nearest value of every other channel as a column."""
    own = messages.where(F.col(field) == pivot).select(*keys, time, ordinal, F.col(value).alias(pivot))
    steps = own.withColumn(field, F.explode(F.array(*[F.lit(f) for f in fields])))
    sources = messages.where(F.col(field).isin(fields)).select(*keys, field, time, F.col(ordinal).alias("_so"), F.col(value).alias("_v"))
    present = sources.select(*keys, field).distinct()
    steps = steps.join(present, [*keys, field], "left_semi")
    near = nearest_asof_join(steps, sources, [*keys, field], time, ["_v"], ordinal="_so", hot=hot)
    return near.groupBy(*keys, time, ordinal, pivot).pivot(field, fields).agg(F.first("_v"))


def gap_check(messages: DataFrame, keys: list[str], time: str, threshold: float, ordinal: str, fail: bool = False) -> DataFrame:
    """Gaps between neighbours of a timeline: how many are above the threshold, the largest and its index, the median."""
    w = Window.partitionBy(*keys).orderBy(time, ordinal)
    gaps = messages.withColumn("_gap", F.col(time) - F.lag(time).over(w)).withColumn("_i", F.row_number().over(w) - 2).where("_gap IS NOT NULL")
    out = gaps.groupBy(*keys).agg(
        F.count_if(F.col("_gap") > threshold).alias("n_gaps"),
        F.max("_gap").alias("largest"),
        F.max_by("_i", F.struct("_gap", -F.col("_i"))).alias("at"),
        F.median("_gap").alias("median"),
    )
    return out.withColumn("n_gaps", F.when(F.col("n_gaps") > 0, F.raise_error(F.lit("gaps in the timeline"))).otherwise(F.col("n_gaps"))) if fail else out


def clock_overlap_check(messages: DataFrame, pivot: str, keys: list[str], field: str, time: str) -> DataFrame:
    """Whether each channel's range meets the pivot's range widened by a tenth of max(duration, 1 s)."""
    spans = messages.groupBy(*keys, field).agg(F.min(time).alias("lo"), F.max(time).alias("hi"))
    p = spans.where(F.col(field) == pivot).select(*keys, F.col("lo").alias("plo"), F.col("hi").alias("phi"))
    slack = 0.1 * F.greatest(F.col("phi") - F.col("plo"), F.lit(1.0))
    both = spans.where(F.col(field) != pivot).join(p, keys)
    return both.withColumn("overlaps", (F.col("hi") >= F.col("plo") - slack) & (F.col("lo") <= F.col("phi") + slack))


def effective_rate(time: str) -> Column:
    """Aggregate: (n - 1) / duration, 0 when there is no duration."""
    return F.coalesce(F.try_divide((F.count("*") - 1).cast("double"), F.max(time) - F.min(time)), F.lit(0.0))


def best_timestamp(messages: DataFrame, keys: list[str], header: str, log: str) -> DataFrame:
    """Header stamps where all messages of a channel have one, log stamps where none has, else an error; both as seconds
    after the earliest log time of the recording."""
    # counts per channel by partial sums, then a join with a row for each channel: no channel is sorted in one task
    counts = messages.groupBy(*[F.col(k).alias(f"_of_{k}") for k in keys]).agg(F.count("*").alias("_n"), F.count(header).alias("_h"))
    n, h = F.col("_n"), F.col("_h")
    stamp = F.when(h == n, F.col(header)).when(h == 0, F.col(log)).otherwise(F.raise_error(F.lit("some messages have no header stamp")))
    rows = messages.join(counts, [F.col(k).eqNullSafe(F.col(f"_of_{k}")) for k in keys])
    return rows.withColumn("stamp", stamp).drop(*[f"_of_{k}" for k in keys], "_n", "_h")


def quaternion_to_matrix(x: Column, y: Column, z: Column, w: Column) -> Column:
    n = F.sqrt(x * x + y * y + z * z + w * w)
    x, y, z, w = x / n, y / n, z / n, w / n
    return F.array(
        1 - 2 * (y * y + z * z), 2 * (x * y - z * w), 2 * (x * z + y * w),
        2 * (x * y + z * w), 1 - 2 * (x * x + z * z), 2 * (y * z - x * w),
        2 * (x * z - y * w), 2 * (y * z + x * w), 1 - 2 * (x * x + y * y),
    )


def message_field_path(payload: Column, path: str) -> Column:
    """Numbers at a path of a JSON payload as an array; one `[*]` step goes over a list; a bad path gives null."""
    v = F.try_parse_json(payload)
    head, star, tail = path.partition("[*]")
    if not star:
        one = F.try_variant_get(v, f"$.{head}", "double")
        return F.when(one.isNotNull(), F.array(one))
    items = F.try_variant_get(v, f"$.{head}", "array<variant>")
    inner = f"${tail}" if tail else "$"
    return F.transform(items, lambda i: F.try_variant_get(i, inner, "double"))
