"""Rollout results and leaderboards: summaries, balance, comparison, guards, upserts."""

from __future__ import annotations

from math import erf, lgamma, sqrt

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from . import scans


def success_summary(rollouts: DataFrame, keys: tuple[str, ...] = ("task", "model")) -> DataFrame:
    """Totals over finished rollouts; pending and crashed ones (success null, by the flag) are counted apart, and keys
    that have only such rows stay."""
    done = F.col("success").isNotNull()
    return rollouts.groupBy(*keys).agg(
        F.count_if(done).alias("total"),
        F.count_if("success").alias("successes"),
        F.try_divide(100.0 * F.count_if("success"), F.count_if(done)).alias("pct"),
        F.avg(F.when(done, F.col("duration"))).alias("mean_duration"),
        F.count_if(~done & F.col("pending")).alias("pending"),
        F.count_if(~done & ~F.col("pending")).alias("crashed"),
    )


def beta_cdf(x: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Regularized incomplete beta function by its continued fraction (Lentz), for arrays."""
    x, a, b = np.broadcast_arrays(x, a, b)
    flip = x > (a + 1) / (a + b + 2)
    y, p, q = np.where(flip, 1 - x, x), np.where(flip, b, a), np.where(flip, a, b)
    tiny = 1e-300
    lg = np.vectorize(lgamma)
    front = np.exp(lg(p + q) - lg(p) - lg(q) + p * np.log(np.maximum(y, tiny)) + q * np.log(np.maximum(1 - y, tiny))) / p
    c, d = np.ones_like(y), 1 - (p + q) * y / (p + 1)
    d = 1 / np.where(np.abs(d) < tiny, tiny, d)
    h = d.copy()
    for m in range(1, 300):
        for num in (m * (q - m) * y / ((p + 2 * m - 1) * (p + 2 * m)), -(p + m) * (p + q + m) * y / ((p + 2 * m) * (p + 2 * m + 1))):
            d = 1 + num * d
            d = 1 / np.where(np.abs(d) < tiny, tiny, d)
            c = 1 + num / c
            c = np.where(np.abs(c) < tiny, tiny, c)
            h = h * d * c
    v = np.clip(front * h, 0, 1)
    return np.where(flip, 1 - v, v)


def beta_quantile(p: float | np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    lo, hi = np.zeros(len(a)), np.ones(len(a))
    for _ in range(60):
        mid = (lo + hi) / 2
        below = beta_cdf(mid, a, b) < p
        lo, hi = np.where(below, mid, lo), np.where(below, hi, mid)
    return (lo + hi) / 2


def binomial_ci(confidence: float = 0.90, side: str = "two-sided"):
    """Clopper-Pearson interval of (successes, total) as an array of two; total 0 gives (0, 1)."""
    tail = (1 - confidence) / (2 if side == "two-sided" else 1)

    @F.pandas_udf(ArrayType(DoubleType()))
    def ci(k: pd.Series, n: pd.Series) -> pd.Series:
        k, n = k.to_numpy(float), n.to_numpy(float)
        lo, hi = np.zeros(len(k)), np.ones(len(k))
        some = (n > 0) & (k > 0)
        if side != "upper" and some.any():
            lo[some] = beta_quantile(tail, k[some], n[some] - k[some] + 1)
        some = (n > 0) & (k < n)
        if side != "lower" and some.any():
            hi[some] = beta_quantile(1 - tail, k[some] + 1, n[some] - k[some])
        return pd.Series([[a, b] for a, b in zip(lo, hi, strict=True)])

    return ci


@F.pandas_udf(ArrayType(DoubleType()))
def beta_quantiles(a: pd.Series, b: pd.Series) -> pd.Series:
    """2.5, 25, 50, 75 and 97.5 % points of Beta(a, b)."""
    q = np.stack([beta_quantile(p, a.to_numpy(float), b.to_numpy(float)) for p in (0.025, 0.25, 0.5, 0.75, 0.975)], axis=1)
    return pd.Series(list(q))


def uniform(seed: int, *counter: str) -> Column:
    """A number in (0, 1) by a hash of the seed and the values of the counter: the same wherever and in whatever order."""
    text = F.concat_ws("|", F.lit(str(seed)), *[F.col(c).cast("string") for c in counter])
    return (F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("long") + 0.5) / F.lit(float(1 << 52))


@F.pandas_udf(DoubleType())
def beta_inverse(p: pd.Series, a: pd.Series, b: pd.Series) -> pd.Series:
    """The value below which a share p of Beta(a, b) lies."""
    return pd.Series(beta_quantile(p.to_numpy(float), a.to_numpy(float), b.to_numpy(float)))


def beta_draws(groups: DataFrame, keys: list[str], a: str, b: str, n: int, seed: int) -> DataFrame:
    """groups(*keys, a, b) -> n draws of Beta(a, b) for each: *keys, i, draw. Draws are numbered, and each is the inverse
    distribution at a number that depends on seed, keys and i only."""
    rows = groups.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    return rows.select(*keys, "i", beta_inverse(uniform(seed, *keys, "i"), F.col(a), F.col(b)).alias("draw"))


def balanced_success(rollouts: DataFrame, hot: int | None = scans.HOT) -> tuple[DataFrame, DataFrame]:
    """Rollouts of the tasks that all models have, the same number for each model and task (the smallest of all), in
    the order of demo_id; and the excluded tasks."""
    done = rollouts.where("success IS NOT NULL")
    counts = done.groupBy("task", "model").agg(F.count("*").alias("n"))
    models = counts.agg(F.countDistinct("model").alias("models"))
    per_task = counts.groupBy("task").agg(F.count("*").alias("k"), F.min("n").alias("least"))
    both = per_task.crossJoin(F.broadcast(models))  # one row
    common, excluded = both.where("k = models").select("task", "least"), both.where("k < models").select("task")
    floor = F.broadcast(common.agg(F.min("least").alias("floor")))
    rows = numbered(done.join(common.select("task"), "task"), ["task", "model"], "demo_id", "rn", hot)
    return rows.crossJoin(floor).where("rn <= floor").drop("rn", "floor"), excluded


def numbered(rows: DataFrame, keys: list[str], order: str, out: str, hot: int | None = scans.HOT) -> DataFrame:
    """Number the rows of each key by a numeric column, from 1; keys with more than `hot` rows by blocks."""
    return scans.done(scans.numbered(scans.cut(rows, keys, order, hot), [order], out))


def paired(rollouts: DataFrame, hot: int | None = scans.HOT) -> DataFrame:
    """Results of each pair of models on a task, rank by rank, up to the shorter one: task, a, b, n, ka, kb."""
    r = numbered(rollouts.where("success IS NOT NULL"), ["task", "model"], "demo_id", "k", hot).select("task", "model", "k", "success")
    a = r.select("task", "k", F.col("model").alias("a"), F.col("success").alias("sa"))
    b = r.select("task", "k", F.col("model").alias("b"), F.col("success").alias("sb"))
    both = a.join(b, ["task", "k"]).where("a < b")
    return both.groupBy("task", "a", "b").agg(F.count("*").alias("n"), F.count_if("sa").alias("ka"), F.count_if("sb").alias("kb"))


def pivot_rates(summary: DataFrame, rate: str = "pct", most: int = 200) -> DataFrame:
    """A row for each task with a column for each model that there is; 0 where a model has no rate. More than `most` models
    are an error."""
    models = [r[0] for r in summary.where("model IS NOT NULL").select("model").distinct().orderBy("model").limit(most + 1).collect()]
    if len(models) > most:
        raise ValueError(f"more than {most} models")
    return summary.groupBy("task").pivot("model", models).agg(F.first(rate)).fillna(0.0, models)


def task_order(summary: DataFrame, rate: str = "pct") -> DataFrame:
    """Tasks by the mean of their models' rates, the highest first, ties by name: task, mean, place. A task is one row here."""
    means = summary.where(F.col(rate).isNotNull()).groupBy("task").agg(F.avg(rate).alias("mean"))
    return means.withColumn("place", F.row_number().over(Window.orderBy(F.desc("mean"), "task")))


def page_of(rows: DataFrame, order: list[str], page: int, size: int = 9) -> DataFrame:
    """Page `page` (from 0) of the rows in their order, clamped to the pages that there are; with the page's number."""
    pages = max(1, -(-rows.count() // size))
    page = min(max(page, 0), pages - 1)
    return rows.orderBy(*order).offset(page * size).limit(size).withColumn("page", F.lit(page))


def z_score(na: Column, ka: Column, nb: Column, kb: Column) -> Column:
    """Pooled two-proportion statistic; 0 where it is not defined."""
    p = F.try_divide(ka + kb, na + nb)
    se = F.sqrt(p * (1 - p) * (F.try_divide(F.lit(1), na) + F.try_divide(F.lit(1), nb)))
    return F.coalesce(F.try_divide(F.try_divide(ka, na) - F.try_divide(kb, nb), se), F.lit(0.0))


def critical_z(alpha: float) -> float:
    """z with P(|Z| > z) = alpha."""
    lo, hi = 0.0, 40.0
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if 1 - erf(mid / sqrt(2)) > alpha else (lo, mid)
    return (lo + hi) / 2


def pairwise(summary: DataFrame, group: str, label: str, alpha: float = 0.05) -> DataFrame:
    """All pairs a < b of labels in a group (labels of a group are few) with -1, 0 or 1: b better, no difference, a better."""
    a = summary.select(group, F.col(label).alias("a"), F.col("total").alias("na"), F.col("successes").alias("ka"))
    b = summary.select(group, F.col(label).alias("b"), F.col("total").alias("nb"), F.col("successes").alias("kb"))
    rows = a.join(b, group).where("a < b").withColumn("z", z_score(F.col("na"), F.col("ka"), F.col("nb"), F.col("kb")))
    return rows.withColumn("verdict", F.when(F.abs("z") > critical_z(alpha), F.signum("z")).otherwise(0).cast("int"))


def compact_letters(summary: DataFrame, pairs: DataFrame, group: str, label: str) -> DataFrame:
    """Letters from a table of pairwise verdicts: best rate first, each unassigned label opens a letter, which all
    unassigned ones that do not differ from it share."""
    rows = summary.select(group, label, "total", "successes")
    differ = pairs.where("verdict <> 0").groupBy(group).agg(F.collect_list(F.struct("a", "b")).alias("differ"))
    rows = rows.join(differ, group, "left").select(group, label, "total", "successes", "differ")

    def letters(frame: pd.DataFrame) -> pd.DataFrame:
        rate = frame["successes"] / frame["total"].clip(lower=1)
        order = frame.assign(rate=rate).sort_values(["rate", label], ascending=[False, True])
        first = frame["differ"].iloc[0]
        apart = {(x["a"], x["b"]) for x in first} if first is not None else set()
        out = {}
        for one in order[label]:
            if one in out:
                continue
            letter = chr(97 + len(set(out.values())))
            for other in order[label]:
                if other not in out and (one, other) not in apart and (other, one) not in apart:
                    out[other] = letter
        return pd.DataFrame({group: frame[group].iloc[0], label: list(out), "letters": list(out.values())})

    return rows.groupBy(group).applyInPandas(letters, f"{group} string, {label} string, letters string")


def duplicate_guard(rollouts: DataFrame, keys: tuple[str, ...] = ("task", "model", "demo_id")) -> DataFrame:
    return rollouts.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def budget_guard(rollouts: DataFrame, budget: int) -> DataFrame:
    """Rows per (task, model); more than the budget raises."""
    n = F.count("*")
    over = F.raise_error(F.lit("more rollouts than the budget"))
    return rollouts.groupBy("task", "model").agg(F.when(n > budget, over).otherwise(n).alias("n"))


def missing_indices(present: DataFrame, group: str, index: str, first: int, count: int) -> DataFrame:
    """Indices first .. first + count - 1 that a group does not have."""
    all_ = present.select(group).distinct().withColumn(index, F.explode(F.sequence(F.lit(first).cast("long"), F.lit(first + count - 1).cast("long"))))
    return all_.join(present.select(group, index), [group, index], "left_anti")


def index_ranges(rows: DataFrame, group: str, index: str, hot: int | None = scans.HOT) -> DataFrame:
    """Distinct indices as ranges: 0-5,10,15-20. A group's ranges are one text."""
    d = numbered(rows.select(group, index).distinct(), [group], index, "_k", hot)
    runs = d.withColumn("_i", F.col(index) - F.col("_k")).groupBy(group, "_i").agg(F.min(index).alias("lo"), F.max(index).alias("hi"))
    text = F.when(F.col("lo") == F.col("hi"), F.col("lo").cast("string")).otherwise(F.concat_ws("-", "lo", "hi"))
    return runs.groupBy(group).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("lo", text.alias("t")))), lambda x: x["t"]), ",").alias("ranges"))


def upsert(old: DataFrame, new: DataFrame, keys: list[str], overwrite: bool = True) -> DataFrame:
    """Rows of new replace those of old with the same key; without overwrite a key that is there raises."""
    if not overwrite:
        hit = old.select(*keys).distinct().withColumn("_hit", F.lit(True))
        new = new.join(hit, keys, "left")
        fail = F.when(F.col("_hit"), F.raise_error(F.lit("the key exists")))
        new = new.withColumn(keys[0], F.coalesce(fail, F.col(keys[0]))).drop("_hit")
    return old.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new)


def leaderboard_filter(rows: DataFrame, tags: str | None = None, need: list[str] | None = None, least: int | None = None, **allowed: list) -> DataFrame:
    """Optional filters: allowed values by column, required tags, fewest rollouts."""
    for column, values in allowed.items():
        rows = rows.where(F.col(column).isin(values))
    for t in need or []:
        rows = rows.where(F.array_contains(tags, t))
    return rows if least is None else rows.where(F.col("total_rollouts") >= least)



def replace_groups(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """The rows of new, and those of old whose keys do not come in new: a group is replaced as a whole."""
    return old.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new)
