"""Episodes and windows around anchor steps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from ..functions.names import actual_key
from . import scans


def episode_timesteps(frames: DataFrame, episode: str = "episode", order: tuple[str, ...] = ("ts", "ordinal"), hot: int | None = None) -> DataFrame:
    """Number the frames of each episode 0..n-1 in order, and put the episode's length n on every row. With `hot`, an episode
    of more frames than that is numbered by blocks of its first order column, a number or a time."""
    if hot is not None:
        c = scans.cut(frames, [episode], order[0], hot)
        if c.hot:
            rows = scans.numbered(c, list(order), "t").rows.withColumn("t", (F.col("t") - 1).cast("int"))
            few = rows.where("NOT _hot").withColumn("n", F.count("*").over(Window.partitionBy(episode)).cast("int"))
            sizes = c.rows.where("_hot").groupBy(F.col(episode).alias("_of")).agg(F.count("*").cast("int").alias("n"))  # a row for each hot episode
            many = rows.where("_hot").join(F.broadcast(sizes), F.col(episode).eqNullSafe(F.col("_of"))).drop("_of")
            return few.unionByName(many).drop("_block", "_hot")
    w = Window.partitionBy(episode)
    t = (F.row_number().over(w.orderBy(*order)) - 1).cast("int")
    return frames.withColumn("t", t).withColumn("n", F.count("*").over(w).cast("int"))


def stride_anchors(steps: DataFrame, stride: int) -> DataFrame:
    if stride < 1:
        raise ValueError("stride must be 1 or more")
    return steps.where(F.col("t") % stride == 0)


def window_padding(steps: DataFrame, past: int, future: int) -> DataFrame:
    """Start, end and paddings of the window [t - past, t + future] inside the episode."""
    lead = F.greatest(F.lit(past) - F.col("t"), F.lit(0))
    tail = F.greatest(F.col("t") + future - F.col("n") + 1, F.lit(0))
    return (
        steps.withColumn("past_padding", lead)
        .withColumn("future_padding", tail)
        .withColumn("start", F.greatest(F.col("t") - past, F.lit(0)))
        .withColumn("end", F.least(F.col("t") + future, F.col("n") - 1))
        .withColumn("is_padded", (F.col("past_padding") > 0) | (F.col("future_padding") > 0))
    )


def filter_window_padding(padded: DataFrame, most_past: int, most_future: int) -> DataFrame:
    """Drop anchors with more padding than allowed; comes before any array is built."""
    return padded.where((F.col("past_padding") <= most_past) & (F.col("future_padding") <= most_future))


def _frame(past: int, future: int, *keys: str):
    return Window.partitionBy(*keys).orderBy("t").rowsBetween(-past, future)


def window_values(steps: DataFrame, past: int, future: int, field: str = "x", out: str = "w", episode: str = "episode", block: int | None = None) -> DataFrame:
    """The unpadded values of the window, nulls kept, as an array. With `block`, an episode (its steps numbered without gaps)
    is dealt over blocks of so many steps; a step goes to every block with a window that it lies in."""
    keys = [episode]
    if block is not None:
        at = lambda t: F.floor(t / block)
        reached = F.sequence(at(F.greatest(F.col("t") - future, F.lit(0))), at(F.col("t") + past))
        steps, keys = steps.withColumn("_block", F.explode(reached)), [episode, "_block"]
    rows = F.collect_list(F.struct(F.col(field).alias("v"))).over(_frame(past, future, *keys))
    steps = steps.withColumn(out, F.transform(rows, lambda r: r["v"]))
    return steps if block is None else steps.where(F.col("_block") == at(F.col("t"))).drop("_block")


def pad_window(values: Column, before: Column, after: Column, how: str = "copy") -> Column:
    """Pad an array: copy (its edge), zero, reflect (edge not repeated)."""
    if how == "copy":
        left, right = F.array_repeat(F.get(values, F.lit(0)), before), F.array_repeat(F.element_at(values, -1), after)
    elif how == "zero":
        left, right = F.array_repeat(F.lit(0.0), before), F.array_repeat(F.lit(0.0), after)
    elif how == "reflect":
        n = F.size(values)

        def at(i):  # position of step i of the mirrored row; a single value repeats
            period = F.greatest(2 * n - 2, F.lit(1))
            k = F.pmod(i, period)
            return F.get(values, F.when(k < n, k).otherwise(period - k))

        left = F.when(before > 0, F.transform(F.sequence(-before, F.lit(-1)), at)).otherwise(F.array().cast("array<double>"))
        right = F.when(after > 0, F.transform(F.sequence(n, n + after - 1), at)).otherwise(F.array().cast("array<double>"))
    else:
        raise ValueError(f"padding {how}")
    return F.concat(left, values, right)


def past_future_masks(steps: DataFrame, past: int, future: int) -> DataFrame:
    """Slot j stands for step t - past + j; past: j < past and inside the episode; future: j >= past and inside."""
    slots = F.sequence(F.lit(0), F.lit(past + future))

    def inside(j):
        return (F.col("t") - past + j >= 0) & (F.col("t") - past + j < F.col("n"))

    return steps.withColumn("past_mask", F.transform(slots, lambda j: (j < past) & inside(j))).withColumn(
        "future_mask", F.transform(slots, lambda j: (j >= past) & inside(j))
    )


def window_samples(steps: DataFrame, past: int, future: int, most_past: int, most_future: int, how: str = "copy", stride: int = 1,
                   field: str = "x", episode: str = "episode") -> DataFrame:
    """Anchors that pass the padding limits, each with its padded window and masks."""
    # every step must look at its neighbours, as plain columns; arrays are built for the anchors that stay
    w = Window.partitionBy(episode).orderBy("t")
    cells = {f"_x{k}": F.lead(field, k).over(w) if k > 0 else F.lag(field, -k).over(w) for k in range(-past, future + 1)}
    rows = stride_anchors(steps.withColumns(cells), stride)
    rows = filter_window_padding(window_padding(rows, past, future), most_past, most_future)
    before, after = F.col("past_padding"), F.col("future_padding")
    inside = F.slice(F.array(*cells), before + 1, F.lit(past + future + 1) - before - after)
    rows = rows.withColumn("window", pad_window(inside, before, after, how)).drop(*cells)
    return past_future_masks(rows, past, future)


def still_spread(steps: DataFrame, past: int, future: int, fields: list[str], episode: str = "episode") -> DataFrame:
    """Largest population deviation of any movement channel over the unpadded window."""
    w = _frame(past, future, episode)
    return steps.withColumn("spread", F.greatest(*[F.stddev_pop(f).over(w) for f in fields], F.lit(float("-inf"))))


MOVEMENT = ("action", "joint", "poses", "xyz", "actual")


def filter_still_windows(steps: DataFrame, past: int, future: int, threshold: float, fields: list[str], episode: str = "episode") -> DataFrame:
    """Drop windows that move by no more than the threshold; without a movement field all stay; one-row windows go."""
    moving = [f for f in fields if any(m in f for m in MOVEMENT)]
    if not moving:
        return steps
    return still_spread(steps, past, future, moving, episode).where(F.col("spread") > threshold).drop("spread")


def filter_counters(steps: DataFrame, past: int, future: int, most_past: int, most_future: int, threshold: float, field: str = "x") -> DataFrame:
    rows = window_padding(still_spread(steps, past, future, [field]), past, future)
    padded = (F.col("past_padding") > most_past) | (F.col("future_padding") > most_future)
    still = ~padded & (F.col("spread") <= threshold)
    return rows.agg(
        F.count("*").alias("potential"),
        F.count_if(padded).alias("dropped_padding"),
        F.count_if(still).alias("dropped_still"),
        F.count_if(~padded & ~still).alias("kept"),
    )


def write_kept_windows(steps: DataFrame, path: str, past: int, future: int, most_past: int, most_future: int, threshold: float, field: str = "x") -> dict[str, int]:
    """Write the steps whose windows pass both filters, and count in the same pass what was there, what each filter has
    dropped and what stays: the counts are observed as the rows go by, nothing is read for them."""
    rows = window_padding(still_spread(steps, past, future, [field]), past, future)
    padded = (F.col("past_padding") > most_past) | (F.col("future_padding") > most_future)
    still = ~padded & (F.col("spread") <= threshold)
    seen = Observation()
    rows = rows.observe(
        seen,
        F.count(F.lit(1)).alias("potential"),
        F.count(F.when(padded, 1)).alias("dropped_padding"),
        F.count(F.when(still, 1)).alias("dropped_still"),
        F.count(F.when(~padded & ~still, 1)).alias("kept"),
    )
    rows.where(~padded & ~still).drop("spread").write.parquet(path)
    return seen.get


def reference_rows(anchors: DataFrame, fields: DataFrame, field: str = "field", value: str = "x", episode: str = "episode") -> DataFrame:
    """anchors(episode, t, field, ...) with `reference`: the value at the anchor's step of the field's actual counterpart, null
    where the name has none or the episode doesn't have that field. A join on episode, step and counterpart, so no key is
    more than a row."""
    own = fields.select(F.col(episode).alias("_e"), F.col("t").alias("_t"), F.col(field).alias("_f"), F.col(value).alias("reference"))
    on = [F.col(episode) == F.col("_e"), F.col("t") == F.col("_t"), actual_key(F.col(field)) == F.col("_f")]
    return anchors.join(own, on, "left").drop("_e", "_t", "_f")


def image_offset_lookup(steps: DataFrame, offsets: list[int], field: str, episode: str = "episode") -> DataFrame:
    """The frame at anchor + offset, clamped to the episode: a column <field>_t<offset> for each offset."""
    w = Window.partitionBy(episode).orderBy("t")
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    for k in offsets:
        value = F.lag(field, -k).over(w) if k < 0 else F.lead(field, k).over(w)
        inside = (F.col("t") + k >= 0) & (F.col("t") + k < F.col("n"))
        edge = F.first(field).over(whole) if k < 0 else F.last(field).over(whole)
        steps = steps.withColumn(f"{field}_t{k}", F.when(inside, value).otherwise(edge))
    return steps


def crop_window(values: Column, anchor: Column, past: int, future: int) -> Column:
    """[anchor - past, anchor + future] of an array; outside raises. The anchor's new index is `past`."""
    bad = (anchor - past < 0) | (anchor + future >= F.size(values))
    return F.when(bad, F.raise_error(F.lit("crop outside of the window"))).otherwise(F.slice(values, anchor - past + 1, F.lit(past + future + 1)))


def hysteresis_state(steps: DataFrame, low: float, high: float, field: str = "x", episode: str = "episode", hot: int | None = scans.HOT) -> DataFrame:
    """Open above `high`, closed below `low`, else as before; the first row by the midpoint.

    A step is a map of the two states: to open, to closed, or the identity. Maps compose, so that an episode of more than
    `hot` steps is worked off by blocks, each of which hands its map on to the next."""
    c = scans.numbered(scans.cut(steps, [episode], "t", hot), ["t"], "_k")
    event = (
        F.when(F.col(field) > high, True)
        .when(F.col(field) < low, False)
        .when(F.col("_k") == 1, F.col(field) >= (low + high) / 2)
    )
    c = c._replace(rows=c.rows.withColumn("_e", event))
    return scans.done(scans.carried(c, ["t"], "_e", "is_open")).drop("_e", "_k")


def history_buffer(steps: DataFrame, past: int, field: str = "x", episode: str = "episode") -> DataFrame:
    """The last past + 1 values of each step, the first value repeated before the start."""
    rows = window_values(steps, past, 0, field, "h", episode)
    short = F.lit(past + 1) - F.size("h")
    return rows.withColumn("h", F.concat(F.array_repeat(F.get("h", F.lit(0)), short), F.col("h")))


def fractional_lag(steps: DataFrame, lag: float, field: str = "x", episode: str = "episode") -> DataFrame:
    """Value at t + lag by linear interpolation between whole steps, clamped to the episode."""
    lo, part = int(lag // 1), lag % 1
    rows = window_values(steps, 0, lo + 1, field, "_w", episode)
    a = F.element_at("_w", F.least(F.lit(lo + 1), F.size("_w")))
    b = F.element_at("_w", F.least(F.lit(lo + (2 if part else 1)), F.size("_w")))
    return rows.withColumn("lagged", a * (1 - part) + b * part).drop("_w")


def every_nth(rows: DataFrame, keys: list[str], order: list[str], n: int) -> DataFrame:
    """The first and every n-th row of a key."""
    if n < 1:
        raise ValueError("n must be 1 or more")
    k = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return rows.withColumn("_k", k).where((F.col("_k") == 1) | (F.col("_k") % n == 0)).drop("_k")


def running_sums(rows: DataFrame, keys: list[str], block: Column, order: list[str], values: list[str]) -> DataFrame:
    """rows with sum_<value>: the sums of `values` over the rows of the same keys up to the row, in `order`.

    `block` cuts the order of a key into pieces (a monotone function of it, such as a range of time): sums of whole
    blocks first, then inside each, so that a key with very many rows is dealt over as many tasks as it has blocks."""
    rows = rows.withColumn("_block", block)
    inside = Window.partitionBy(*keys, "_block").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)  # a row for each block
    blocks = rows.groupBy(*keys, "_block").agg(*[F.sum(v).alias(f"_{v}") for v in values])
    blocks = blocks.select(*[F.col(k).alias(f"_of_{k}") for k in [*keys, "_block"]], *[F.coalesce(F.sum(f"_{v}").over(before), F.lit(0)).alias(f"_{v}") for v in values])
    same = [F.col(k).eqNullSafe(F.col(f"_of_{k}")) for k in [*keys, "_block"]]
    out = rows.withColumns({f"sum_{v}": F.sum(v).over(inside) for v in values}).join(blocks, same)
    return out.withColumns({f"sum_{v}": F.col(f"sum_{v}") + F.col(f"_{v}") for v in values}).drop(*[f"_{v}" for v in values], *[f"_of_{k}" for k in [*keys, "_block"]], "_block")
