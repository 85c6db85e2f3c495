"""Statistics of windows: mergeable moments per step and channel, percentiles, sketches, comparison, normalization."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.files import kept

PERCENTS = (0.01, 0.02, 0.05, 0.95, 0.98, 0.99)


def valid(column: str) -> Column:
    """The value where it counts: null and NaN are missing."""
    return F.when(~F.isnan(column), F.col(column))


def slots(samples: DataFrame, window: str = "window", keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per unmasked slot: slot t and its value x."""
    rows = samples.select(*keep, F.posexplode(F.arrays_zip(window, "past_mask", "future_mask")).alias("slot", "z"))
    rows = rows.where("z.past_mask OR z.future_mask")
    return rows.select(*keep, F.col("slot").alias("t"), F.col(f"z.{window}").alias("x"))


def masked_moments(rows: DataFrame, keys: tuple[str, ...] = ("t",), x: str = "x") -> DataFrame:
    """Per key: n, mean, m2 (sum of squared deviations), min, max of the unmasked values. Partial and final aggregate."""
    v = valid(x)
    return rows.groupBy(*keys).agg(
        F.count(v).alias("n"),
        F.avg(v).alias("mean"),
        (F.coalesce(F.var_pop(v), F.lit(0.0)) * F.count(v)).alias("m2"),
        F.min(v).alias("min"),
        F.max(v).alias("max"),
        F.count_if(F.isnan(x)).alias("nan_count"),
    )


def step_deviation() -> Column:
    """Sample deviation, 0 for one value or none."""
    return F.when(F.col("n") > 1, F.sqrt(F.col("m2") / (F.col("n") - 1))).otherwise(0.0)


def _beside(a: DataFrame, b: DataFrame, on: tuple[str, ...] | list[str]) -> DataFrame:
    """Inner join on columns of the same names, in which null equals null."""
    b = b.select(*[F.col(k).alias(f"_r_{k}") for k in on], *[c for c in b.columns if c not in on])
    return a.join(b, [F.col(k).eqNullSafe(F.col(f"_r_{k}")) for k in on]).drop(*[f"_r_{k}" for k in on])


def _with_mean(parts: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """parts with the pooled mean of their key beside them: what is summed afterwards are differences from it, which
    cancel nothing where values are large and close. Parts are few for each key; they meet once, by key, and are made once."""
    mean = F.try_divide(F.sum(F.col("n") * F.col("mean")), F.sum("n"))
    if not keys:
        parts = kept(parts)
        return parts.crossJoin(F.broadcast(parts.agg(mean.alias("_mean"))))  # one row
    w = Window.partitionBy(*keys)
    pooled = F.try_divide(F.sum(F.col("n") * F.col("mean")).over(w), F.sum("n").over(w))
    return parts.withColumn("_mean", pooled)


def finalize_statistics(moments: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """Overall statistics from those per step: count-weighted mean; deviation from the weighted mean of the per-step
    variances (sample) and the weighted variance of the per-step means."""
    apart = F.col("mean") - F.col("_mean")
    n = F.sum("n")
    spread = F.try_divide(F.sum(F.col("n") * (step_deviation() * step_deviation() + apart * apart)), n)
    return _with_mean(moments, keys).groupBy(*keys).agg(
        n.alias("n"),
        F.first("_mean").alias("mean"),
        F.sqrt(spread).alias("std"),
        F.min("min").alias("min"),
        F.max("max").alias("max"),
    )


#: Values of a key that one task puts in order, at most; the share of ranks on either side that a sketch is trusted to.
ORDERED, MARGIN = 1 << 22, 0.02
#: Quantiles of a sketch that bounds are taken from.
GRID = 200


def masked_percentiles(rows: DataFrame, keys: tuple[str, ...] = ("t",), x: str = "x", percents: tuple[float, ...] = PERCENTS,
                       most: int = ORDERED) -> DataFrame:
    """Exact percentiles by linear interpolation: (keys, p), without keys one row; a key without a value has no row.

    The values of a key with `most` of them or fewer are counted and put in order. For a larger key a sketch names two values
    around each rank; a pass counts what lies below and between them, and that is narrowed again until it is `most` or fewer,
    which are put in order. The counts prove that the rank lies between; where they don't, wider bounds are taken."""
    out = keys or ("_all",)
    v = rows.withColumn("_all", F.lit(0)).select(*out, valid(x).cast("double").alias("_x")).where("_x IS NOT NULL")
    large = v.groupBy(*out).agg(F.count("*").alias("_n")).where(F.col("_n") > most)
    if large.isEmpty():
        return _by_order(v, out, percents).drop("_all")
    large = kept(large)
    named = [f"_k{i}" for i in range(len(out))]
    mark = large.select(*[F.col(k).alias(c) for k, c in zip(out, named, strict=True)], "_n")
    same = [F.col(k).eqNullSafe(F.col(c)) for k, c in zip(out, named, strict=True)]
    few = _by_order(v.join(mark, same, "left_anti"), out, percents)
    many = v.join(mark, same).drop(*named)
    return few.unionByName(_by_narrowing(many, large, out, percents, most)).drop("_all")


def _interpolated(low: Column, high: Column, r: Column) -> Column:
    return F.when(low == high, low).otherwise(low + (high - low) * (r - F.floor(r)))


def _by_order(v: DataFrame, keys: tuple[str, ...], percents: tuple[float, ...]) -> DataFrame:
    values = v.groupBy(*keys, "_x").agg(F.count("*").alias("_k"))
    w = Window.partitionBy(*keys)
    values = values.withColumns({"_to": F.sum("_k").over(w.orderBy("_x")), "_n": F.sum("_k").over(w)})
    # the value at a rank is the least one up to which there are more values
    at = [(F.col("_n") - 1) * F.lit(p) for p in percents]
    ends = [F.min(F.when(F.col("_to") > f(r), F.col("_x"))).alias(f"_{side}{i}") for i, r in enumerate(at) for side, f in (("l", F.floor), ("h", F.ceil))]
    found = values.groupBy(*keys).agg(F.first("_n").alias("_n"), *ends)
    return found.select(*keys, F.array(*[_interpolated(F.col(f"_l{i}"), F.col(f"_h{i}"), r) for i, r in enumerate(at)]).alias("p"))


def _by_narrowing(v: DataFrame, sizes: DataFrame, keys: tuple[str, ...], percents: tuple[float, ...], most: int) -> DataFrame:
    """v: the values of the keys in sizes(*keys, _n), which are many."""
    ranks = F.explode(F.array(*[F.struct(F.lit(i).alias("_i"), ((F.col("_n") - 1) * F.lit(p)).alias("_r")) for i, p in enumerate(percents)]))
    far = F.lit(float("inf"))
    b = sizes.withColumn("_w", ranks).select(
        *keys, "_w.*", (-far).alias("_lo"), far.alias("_hi"), F.lit(0).cast("long").alias("_below"), F.col("_n").alias("_inside"), F.lit(MARGIN).alias("_m")
    )
    b = kept(b)  # a row for each large key and rank
    on = [*keys, "_i"]
    v = v.select(*keys, "_x")
    while True:
        open_ = b.where((F.col("_inside") > most) & (F.col("_m") < 1))
        if open_.isEmpty():
            break
        inside = _beside(v, open_, keys).where("_x >= _lo AND _x <= _hi")
        q = (F.col("_r") - F.col("_below")) / F.col("_inside")
        grid = F.kll_sketch_get_quantile_double("_s", F.array(*[F.lit(k / GRID) for k in range(1, GRID)]))
        at = lambda k, end: F.when((k < 1) | (k >= GRID), end).otherwise(F.get(grid, k.cast("int") - 1))
        new = inside.groupBy(*on).agg(F.kll_sketch_agg_double("_x").alias("_s"), *[F.first(c).alias(c) for c in ("_r", "_lo", "_hi", "_below", "_inside", "_m")])
        new = kept(new.select(*on, "_r", "_lo", "_hi", "_below", "_inside", "_m", at(F.floor((q - F.col("_m")) * GRID), F.col("_lo")).alias("_a"), at(F.ceil((q + F.col("_m")) * GRID), F.col("_hi")).alias("_b")))
        seen = _beside(v, new, keys).where("_x >= _lo AND _x <= _hi").groupBy(*on)
        seen = seen.agg(F.count_if(F.col("_x") < F.col("_a")).alias("_less"), F.count_if(F.col("_x").between(F.col("_a"), F.col("_b"))).alias("_mid"))
        new = _beside(new, seen, on)
        below = F.col("_below") + F.col("_less")
        sure = (F.floor("_r") >= below) & (F.ceil("_r") < below + F.col("_mid")) & (F.col("_mid") < F.col("_inside"))
        new = new.select(
            *on, "_r", *[F.when(sure, x).otherwise(F.col(o)).alias(o) for x, o in ((F.col("_a"), "_lo"), (F.col("_b"), "_hi"), (below, "_below"), (F.col("_mid"), "_inside"))],
            F.when(sure, F.lit(MARGIN)).otherwise(F.col("_m") * 4).alias("_m"),
        )
        b = kept(b.where((F.col("_inside") <= most) | (F.col("_m") >= 1)).unionByName(new))
    values = _beside(v, b, keys).where("_x >= _lo AND _x <= _hi").groupBy(*on, "_x").agg(F.count("*").alias("_k"), F.first("_r").alias("_r"), F.first("_below").alias("_below"))
    values = values.withColumn("_to", F.col("_below") + F.sum("_k").over(Window.partitionBy(*on).orderBy("_x")))
    ends = [F.min(F.when(F.col("_to") > f("_r"), F.col("_x"))).alias(c) for c, f in (("_l", F.floor), ("_h", F.ceil))]
    each = values.groupBy(*on).agg(*ends, F.first("_r").alias("_r"))
    each = each.select(*on, _interpolated(F.col("_l"), F.col("_h"), F.col("_r")).alias("_p"))
    return each.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("_i", "_p"))), lambda s: s["_p"]).alias("p"))


def quantile_state(rows: DataFrame, keys: tuple[str, ...] = ("t",), x: str = "x") -> DataFrame:
    """Mergeable quantile state of each key as a BINARY sketch of bounded size, for data where exact ranks cost too much."""
    return rows.groupBy(*keys).agg(F.kll_sketch_agg_double(valid(x)).alias("sketch"), F.count(valid(x)).alias("n"))


def merge_quantile_states(states: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    return states.groupBy(*keys).agg(F.kll_merge_agg_double("sketch").alias("sketch"), F.sum("n").alias("n"))


def state_quantiles(states: DataFrame, percents: tuple[float, ...] = PERCENTS) -> DataFrame:
    q = F.array(*[F.kll_sketch_get_quantile_double("sketch", F.lit(p)) for p in percents])
    return states.withColumn("p", q)


def merge_moments(parts: DataFrame, keys: tuple[str, ...] = ("t",)) -> DataFrame:
    """Combine partial moments (n, mean, m2, min, max) of the same key: pooled m2 with the term between the parts.

    Parts without a value count for nothing; a key with no value at all has null mean."""
    apart = F.col("mean") - F.col("_mean")
    return _with_mean(parts, keys).groupBy(*keys).agg(
        F.sum("n").alias("n"),
        F.first("_mean").alias("mean"),
        F.sum(F.col("m2") + F.coalesce(F.col("n") * apart * apart, F.lit(0.0))).alias("m2"),
        F.min("min").alias("min"),
        F.max("max").alias("max"),
    )


def merge_statistics(parts: DataFrame, dataset: str = "dataset", keys: tuple[str, ...] = ("t",)) -> DataFrame:
    """Merge the per-step statistics of several datasets; datasets with unequal numbers of steps raise."""
    sizes = parts.groupBy(dataset).agg(F.count("*").alias("k"))
    guard = sizes.agg((F.min("k") == F.max("k")).alias("same"))
    merged = merge_moments(parts, keys).crossJoin(F.broadcast(guard))  # one row
    checked = F.when(F.col("same"), F.col("n")).otherwise(F.raise_error(F.lit("datasets differ in their number of steps")))
    return merged.withColumn("n", checked).drop("same").withColumn("std", step_deviation())


def stats_diff(ours: DataFrame, ref: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Full outer comparison of two tables (keys, t, value): largest and mean difference, percent of the joint range."""
    a = ours.select(*keys, "t", F.col("value").alias("a"), F.lit(True).alias("in_a"))
    b = ref.select(*keys, "t", F.col("value").alias("b"), F.lit(True).alias("in_b"))
    d = F.abs(F.col("a") - F.col("b"))
    span = F.greatest(F.max("a"), F.max("b")) - F.least(F.min("a"), F.min("b"))
    return (
        a.join(b, [*keys, "t"], "full")
        .groupBy(*keys)
        .agg(
            F.max(d).alias("max_diff"),
            F.avg(d).alias("mean_diff"),
            F.try_divide(100 * F.max(d), span).alias("percent"),
            F.count_if(F.col("in_b").isNull()).alias("only_ours"),
            F.count_if(F.col("in_a").isNull()).alias("only_ref"),
            F.count_if((F.col("a").isNull() & F.col("in_a")) | (F.col("b").isNull() & F.col("in_b"))).alias("none_values"),
        )
    )


def anchor_step(counts: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """The first step with the largest count."""
    return counts.groupBy(*keys).agg(F.min_by("t", F.struct(-F.col("n"), "t")).alias("anchor"))


def align_on_anchor(ours: DataFrame, ref: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Overlay two per-step tables (keys, t, n, value) on their anchors; only the overlap stays."""

    def shifted(df, name):
        s = df.join(anchor_step(df, keys), list(keys)) if keys else df.crossJoin(F.broadcast(anchor_step(df, keys)))
        return s.select(*keys, (F.col("t") - F.col("anchor")).alias("rel_t"), F.col("value").alias(name))

    return shifted(ours, "ours").join(shifted(ref, "ref"), [*keys, "rel_t"])


NORMS = {
    "std": lambda s: (s["mean"], s["std"]),
    "min_max": lambda s: ((s["min"] + s["max"]) / 2, (s["max"] - s["min"]) / 2),
    "percentile_5_95": lambda s: ((s["p"][2] + s["p"][3]) / 2, (s["p"][3] - s["p"][2]) / 2),
    "percentile_1_99": lambda s: ((s["p"][0] + s["p"][5]) / 2, (s["p"][5] - s["p"][0]) / 2),
}


def center_scale(stats: Column, method: str, epsilon: float = 1e-6) -> tuple[Column, Column]:
    center, scale = NORMS[method](stats)
    return center, F.greatest(scale, F.lit(epsilon))


def field_setting(field: Column, settings: dict[str, str], default: str) -> Column:
    """What holds for a field: the setting of its exact name, else of the first name in `settings` that its own contains,
    else the default."""
    exact, part = F.lit(None).cast("string"), F.lit(default)
    for name, value in reversed(settings.items()):
        exact = F.when(field == name, value).otherwise(exact)
        part = F.when(field.contains(name), value).otherwise(part)
    return F.coalesce(exact, part)


def normalize_by_setting(window: Column, stats: Column, method: Column, scope: str = "global", start: Column | None = None) -> Column:
    """As normalize_window, with the method in a column; another method raises."""
    out = F.raise_error(F.concat(F.lit("no normalization "), method)).cast("array<double>")
    for name in NORMS:
        out = F.when(method == name, normalize_window(window, stats, name, scope, start)).otherwise(out)
    return out


def normalize_window(window: Column, stats: Column, method: str, scope: str = "global", start: Column | None = None) -> Column:
    """(x - center) / scale. scope global: one statistics struct; per_step: an array of structs from step `start` on;
    a window that the statistics do not cover raises."""
    if scope == "global":
        c, s = center_scale(stats, method)
        return F.transform(window, lambda x: (x - c) / s)
    start = F.lit(0) if start is None else start
    short = (start < 0) | (start + F.size(window) > F.size(stats))

    def one(x, i):
        c, s = center_scale(F.get(stats, start + i), method)
        return (x - c) / s

    return F.when(short, F.raise_error(F.lit("statistics do not cover the window"))).otherwise(F.transform(window, one))


def denormalize_window(window: Column, stats: Column, method: str, scope: str = "global", start: Column | None = None) -> Column:
    """x * scale + center; steps beyond the statistics take the nearest one."""
    if scope == "global":
        c, s = center_scale(stats, method)
        return F.transform(window, lambda x: x * s + c)
    start = F.lit(0) if start is None else start

    def one(x, i):
        k = F.least(F.greatest(start + i, F.lit(0)), F.size(stats) - 1)
        c, s = center_scale(F.get(stats, k), method)
        return x * s + c

    return F.transform(window, one)


def masked_mse(rows: DataFrame, prediction: str, target: str, weight: str, keys: tuple[str, ...] = ()) -> DataFrame:
    """Weighted mean squared error over valid positions; none: 0."""
    e = F.col(prediction) - F.col(target)
    loss = F.coalesce(F.try_divide(F.sum(F.col(weight) * e * e), F.sum(weight)), F.lit(0.0))
    return rows.groupBy(*keys).agg(loss.alias("loss"))
