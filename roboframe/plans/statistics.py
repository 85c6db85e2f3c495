"""Queries over window statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import statistics as S
from ..operators.windows import running_sums
from ..registry import query
from ..sources.files import scratch
from ..sources.views import EP, EV, VE, messages, vectors
from .episodes import OK, P, PAD, SLOT, samples

#: unmasked slot values; `d` cuts the episodes into two datasets
UN = f"WITH {EP}, {PAD}, {OK}, {SLOT}, un AS (SELECT CAST(j AS INTEGER) AS t, x, episode, episode % 2 AS d FROM val WHERE a >= 0 AND a < n)"
STEP = "step AS (SELECT t, count(x) AS n, avg(x) AS mean, var_pop(x) * count(x) AS m2, min(x) AS min, max(x) AS max, coalesce(var_samp(x), 0) AS var FROM un GROUP BY t)"


def stored(rows):
    """rows written to the shared folder and read again: they are looked at several times."""
    path = scratch(rows.sparkSession)
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def r6(c):
    return F.round(c, 6)


def unmasked(spark, sf, keep=()):
    return S.slots(samples(spark, sf), keep=keep)


def two(spark, sf):
    rows = unmasked(spark, sf, ("episode",)).withColumn("dataset", F.col("episode") % 2)
    return S.masked_moments(rows, ("dataset", "t"))


@query("D01_masked_moments", f"""{UN}, {STEP} SELECT t, n, round(mean, 6) AS mean, round(sqrt(var), 6) AS std, min, max, 0 AS nan_count FROM step""")
def _(spark, sf):
    m = S.masked_moments(unmasked(spark, sf))
    return m.select("t", "n", r6("mean").alias("mean"), r6(S.step_deviation()).alias("std"), "min", "max", F.col("nan_count").cast("int").alias("nan_count"))


@query("D02_finalize_statistics", f"""{UN}, {STEP}, w AS (SELECT CAST(sum(n) AS BIGINT) AS n, sum(n * mean) / sum(n) AS mean, min(min) AS min, max(max) AS max, sum(n * var) / sum(n) AS within,
  sum(n * mean * mean) / sum(n) AS sq FROM step) SELECT n, round(mean, 6) AS mean, round(sqrt(within + sq - mean * mean), 6) AS std, min, max FROM w""")
def _(spark, sf):
    f = S.finalize_statistics(S.masked_moments(unmasked(spark, sf)))
    return f.select("n", r6("mean").alias("mean"), r6("std").alias("std"), "min", "max")


@query("D03_masked_percentiles", f"""{UN} SELECT t, list_transform(quantile_cont(x, [0.01, 0.02, 0.05, 0.95, 0.98, 0.99]), lambda y: round(y, 6)) AS p FROM un GROUP BY t""")
def _(spark, sf):
    return S.masked_percentiles(stored(unmasked(spark, sf))).select("t", F.transform("p", r6).alias("p"))


@query("D04_quantile_state", f"{UN} SELECT t, count(x) AS n, 6 AS quantiles, true AS in_rank FROM un GROUP BY t")
def _(spark, sf):
    # sketches answer within a rank error, so each quantile is held against the share of values up to it
    rows = stored(unmasked(spark, sf, ("episode",)).withColumn("dataset", F.col("episode") % 2))
    merged = S.merge_quantile_states(S.quantile_state(rows, ("dataset", "t")), ("t",))
    state = F.broadcast(S.state_quantiles(merged).select("t", "n", "p"))  # a row for each step of the window
    shares = [F.struct(F.avg((F.col("x") < F.get("p", F.lit(i))).cast("int")).alias("lo"), F.avg((F.col("x") <= F.get("p", F.lit(i))).cast("int")).alias("hi")) for i in range(len(S.PERCENTS))]
    out = rows.join(state, "t").groupBy("t", "n").agg(F.size(F.first("p")).alias("quantiles"), F.array(*shares).alias("s"))
    good = [(F.get("s", F.lit(i))["lo"] <= q + 0.02) & (F.get("s", F.lit(i))["hi"] >= q - 0.02) for i, q in enumerate(S.PERCENTS)]
    return out.select("t", "n", "quantiles", F.forall(F.array(*good), lambda g: g).alias("in_rank"))


@query("D05_stats_resume", f"""{UN}, {STEP} SELECT t, n, round(mean, 6) AS mean, round(sqrt(var), 6) AS std, min, max FROM step""")
def _(spark, sf):
    saved = S.masked_moments(unmasked(spark, sf, ("episode",)).where("episode < 50"))
    more = S.masked_moments(unmasked(spark, sf, ("episode",)).where("episode >= 50"))
    m = S.merge_moments(saved.unionByName(more))
    return m.select("t", "n", r6("mean").alias("mean"), r6(S.step_deviation()).alias("std"), "min", "max")


@query("D06_merge_statistics", f"""{UN}, {STEP} SELECT t, n, round(mean, 6) AS mean, round(sqrt(var), 6) AS std, min, max FROM step""")
def _(spark, sf):
    m = S.merge_statistics(two(spark, sf))
    return m.select("t", "n", r6("mean").alias("mean"), r6("std").alias("std"), "min", "max")


@query("D07_point_cloud_stats", f"""WITH {VE}, pt AS (SELECT label, c, v[p * 6 + c + 1] AS x FROM ve, (SELECT unnest(range(0, 10)) AS p), (SELECT unnest(range(0, 6)) AS c))
SELECT label, CAST(c AS INTEGER) AS c, count(x) AS n, round(avg(x), 6) AS mean, round(stddev_samp(x), 6) AS std, round(min(x), 6) AS min, round(max(x), 6) AS max FROM pt GROUP BY label, c""")
def _(spark, sf):
    # ten points of six channels each per vector; the points of a cloud count as samples
    rows = vectors(spark, sf).select("label", F.posexplode(F.slice("v", 1, 60)).alias("i", "x")).withColumn("c", F.col("i") % 6)
    m = S.masked_moments(rows, ("label", "c"))
    return m.select("label", "c", "n", r6("mean").alias("mean"), r6(S.step_deviation()).alias("std"), r6("min").alias("min"), r6("max").alias("max"))


DIFF = """a AS (SELECT t, avg(x) AS v FROM un WHERE d = 0 GROUP BY t), b AS (SELECT t, avg(x) AS v FROM un WHERE d = 1 AND t > 0 GROUP BY t)"""


def _two_tables(spark, sf):
    m = two(spark, sf).withColumnRenamed("mean", "value").withColumn("field", F.lit("x"))
    return m.where("dataset = 0"), m.where("dataset = 1 AND t > 0")


@query("C13_stats_diff", f"""{UN}, {DIFF} SELECT 'x' AS field, round(max(abs(a.v - b.v)), 6) AS max_diff, round(avg(abs(a.v - b.v)), 6) AS mean_diff,
round(100 * max(abs(a.v - b.v)) / (greatest(max(a.v), max(b.v)) - least(min(a.v), min(b.v))), 6) AS percent,
count(*) FILTER (WHERE b.t IS NULL) AS only_ours, count(*) FILTER (WHERE a.t IS NULL) AS only_ref, 0 AS none_values FROM a FULL JOIN b USING (t)""")
def _(spark, sf):
    d = S.stats_diff(*_two_tables(spark, sf), ("field",))
    cols = [r6(c).alias(c) for c in ("max_diff", "mean_diff", "percent")]
    return d.select("field", *cols, "only_ours", "only_ref", F.col("none_values").cast("int").alias("none_values"))


@query("C14_align_on_anchor", f"""{UN}, a AS (SELECT t, count(x) AS n, avg(x) AS v FROM un WHERE d = 0 GROUP BY t), b AS (SELECT t, count(x) AS n, avg(x) AS v FROM un WHERE d = 1 AND t > 0 GROUP BY t),
x AS (SELECT t FROM a ORDER BY n DESC, t LIMIT 1), y AS (SELECT t FROM b ORDER BY n DESC, t LIMIT 1)
SELECT 'x' AS field, a.t - x.t AS rel_t, round(a.v, 6) AS ours, round(b.v, 6) AS ref FROM a, x, b, y WHERE a.t - x.t = b.t - y.t""")
def _(spark, sf):
    return S.align_on_anchor(*_two_tables(spark, sf), ("field",)).select("field", "rel_t", r6("ours").alias("ours"), r6("ref").alias("ref"))


@query("F06_worst_fields", f"""{UN}, {DIFF} SELECT t, round(abs(a.v - b.v), 6) AS diff FROM a JOIN b USING (t) ORDER BY diff DESC, t LIMIT 10""")
def _(spark, sf):
    a, b = _two_tables(spark, sf)
    d = a.select("t", F.col("value").alias("a")).join(b.select("t", F.col("value").alias("b")), "t")
    return d.select("t", r6(F.abs(F.col("a") - F.col("b"))).alias("diff")).orderBy(F.desc("diff"), "t").limit(10)


@query("G03_key_set_difference", f"""{UN}, {DIFF}, k AS (SELECT t, 'ours' AS side FROM (SELECT t FROM a EXCEPT SELECT t FROM b) UNION ALL SELECT t, 'ref' FROM (SELECT t FROM b EXCEPT SELECT t FROM a)
UNION ALL SELECT t, 'both' FROM (SELECT t FROM a INTERSECT SELECT t FROM b)) SELECT t, side FROM k""")
def _(spark, sf):
    a, b = (x.select("t") for x in _two_tables(spark, sf))
    one = a.subtract(b).withColumn("side", F.lit("ours")).unionByName(b.subtract(a).withColumn("side", F.lit("ref")))
    return one.unionByName(a.intersect(b).withColumn("side", F.lit("both")))


GLOBAL = "g AS (SELECT avg(x) AS mean, stddev_samp(x) AS std, min(x) AS mn, max(x) AS mx, quantile_cont(x, 0.05) AS p5, quantile_cont(x, 0.95) AS p95 FROM un)"


def _global(windows):
    """Statistics of all unmasked values of windows, one row."""
    rows = S.slots(windows)
    v = S.valid("x")
    g = rows.agg(F.avg(v).alias("mean"), F.stddev_samp(v).alias("std"), F.min(v).alias("min"), F.max(v).alias("max"))
    g = g.crossJoin(S.masked_percentiles(rows, ()))  # one row each
    return F.broadcast(g.select(F.struct("*").alias("g")))


@query("H10_normalize_field", f"""{UN}, {GLOBAL} SELECT episode, t, list(round((x - mean) / std, 6) ORDER BY j) AS by_std, list(round((x - (p5 + p95) / 2) / ((p95 - p5) / 2), 6) ORDER BY j) AS by_percentile,
list(round((x - (mn + mx) / 2) / ((mx - mn) / 2), 6) ORDER BY j) AS by_range FROM val, g GROUP BY episode, t""")
def _(spark, sf):
    windows = stored(samples(spark, sf))
    rows = windows.crossJoin(_global(windows))
    return rows.select("episode", "t", *[
        F.transform(S.normalize_window(F.col("window"), F.col("g"), m), r6).alias(a)
        for a, m in (("by_std", "std"), ("by_percentile", "percentile_5_95"), ("by_range", "min_max"))
    ])


def _per_step(windows):
    m = S.masked_moments(S.slots(windows)).withColumn("std", S.step_deviation())
    return F.broadcast(m.agg(F.array_sort(F.collect_list(F.struct("t", "mean", "std", "min", "max"))).alias("g")))  # one row of P+F+1 steps


@query("H10b_normalize_per_step", f"""{UN}, {STEP} SELECT val.episode, val.t, list(round((x - mean) / greatest(sqrt(var), 1e-6), 6) ORDER BY j) AS w FROM val JOIN step s ON s.t = j GROUP BY val.episode, val.t""")
def _(spark, sf):
    windows = stored(samples(spark, sf))
    rows = windows.crossJoin(_per_step(windows))
    w = S.normalize_window(F.col("window"), F.col("g"), "std", "per_step")
    return rows.select("episode", "t", F.transform(w, r6).alias("w"))


@query("H11_denormalize_field", f"{UN} SELECT episode, t, list(round(x, 4) ORDER BY j) AS w, list(round(x, 4) ORDER BY j) AS s FROM val GROUP BY episode, t")
def _(spark, sf):
    windows = stored(samples(spark, sf))
    rows = windows.crossJoin(_global(windows)).crossJoin(_per_step(windows).withColumnRenamed("g", "h"))
    g, h = F.col("g"), F.col("h")
    back = S.denormalize_window(S.normalize_window(F.col("window"), g, "percentile_5_95"), g, "percentile_5_95")
    step = S.denormalize_window(S.normalize_window(F.col("window"), h, "std", "per_step"), h, "std", "per_step")
    return rows.select("episode", "t", F.transform(back, lambda x: F.round(x, 4)).alias("w"), F.transform(step, lambda x: F.round(x, 4)).alias("s"))


@query("H12_normalize_xyz_keep_rgb", f"""WITH {VE}, g AS (SELECT c, avg(v[c]) AS m, stddev_samp(v[c]) AS s FROM ve, (SELECT unnest(range(1, 4)) AS c) GROUP BY c)
SELECT vec_id, list(round(CASE WHEN c <= 3 THEN (v[c] - m) / s ELSE (v[c] - 0.5) / 0.25 END, 6) ORDER BY c) AS p FROM ve, (SELECT unnest(range(1, 7)) AS c) k LEFT JOIN g USING (c) GROUP BY vec_id""")
def _(spark, sf):
    v = vectors(spark, sf)
    stats = [F.struct(F.avg(F.get("v", F.lit(i))).alias("m"), F.stddev_samp(F.get("v", F.lit(i))).alias("s")) for i in range(3)]
    rows = v.crossJoin(F.broadcast(v.agg(F.array(*stats).alias("g"))))  # one row
    xyz = F.zip_with(F.slice("v", 1, 3), "g", lambda x, s: (x - s["m"]) / F.greatest(s["s"], F.lit(1e-6)))  # constant channels
    rgb = F.transform(F.slice("v", 4, 3), lambda x: (x - 0.5) / 0.25)
    return rows.select("vec_id", F.transform(F.concat(xyz, rgb), r6).alias("p"))


@query("D30_masked_mse", f"""WITH {VE}, e AS (SELECT label, CASE WHEN v[c] > 0 THEN 1.0 ELSE 0.0 END AS w, v[c] AS p, v[c + 1] AS y FROM ve, (SELECT unnest(range(1, 9)) AS c))
SELECT label, round(coalesce(sum(w * (p - y) * (p - y)) / nullif(sum(w), 0), 0), 6) AS loss FROM e GROUP BY label""")
def _(spark, sf):
    rows = vectors(spark, sf).select("label", F.posexplode(F.arrays_zip(F.slice("v", 1, 8).alias("p"), F.slice("v", 2, 8).alias("y"))).alias("c", "z"))
    rows = rows.select("label", F.col("z.p").alias("p"), F.col("z.y").alias("y"), F.when(F.col("z.p") > 0, 1.0).otherwise(0.0).alias("w"))
    return S.masked_mse(rows, "p", "y", "w", ("label",)).select("label", r6("loss").alias("loss"))


@query("D31_weighted_mean_metric", f"""WITH {EV}, m AS (SELECT *, episode % 5 + 1 AS k, CAST(round(value * 100) AS BIGINT) AS cents FROM ev)
SELECT topic, event_id, CAST(sum(cents * k) OVER w AS BIGINT) * 1000 // CAST(sum(k) OVER w AS BIGINT) AS running FROM m WINDOW w AS (PARTITION BY topic ORDER BY s, event_id)""")
def _(spark, sf):
    # in whole hundred-thousandths, so that both engines cut at the same place
    rows = messages(spark, sf).withColumn("k", F.col("episode") % 5 + 1).withColumn("cents", F.round(F.col("value") * 100).cast("long"))
    rows = rows.withColumn("weighted", F.col("cents") * F.col("k")).select("topic", "s", "event_id", "weighted", "k")
    out = running_sums(rows, ["topic"], F.floor(F.col("s") / 21600).cast("long"), ["s", "event_id"], ["weighted", "k"])
    return out.select("topic", "event_id", F.expr("sum_weighted * 1000 div sum_k").alias("running"))


@query("H10c_normalize_by_field", f"""{UN}, {STEP}, g AS (SELECT avg(x) AS mean, stddev_samp(x) AS std, min(x) AS mn, max(x) AS mx FROM un)
SELECT episode, t, list(round(CASE WHEN episode % 3 = 1 THEN (x - mean) / std ELSE (x - (mn + mx) / 2) / ((mx - mn) / 2) END, 6) ORDER BY j) AS w FROM val, g GROUP BY episode, t""")
def _(spark, sf):
    # fields by name: the exact one, one that contains a name, one that takes the default
    v = S.valid("x")
    g = unmasked(spark, sf).agg(F.avg(v).alias("mean"), F.stddev_samp(v).alias("std"), F.min(v).alias("min"), F.max(v).alias("max"))
    g = F.broadcast(g.withColumn("p", F.array_repeat(F.lit(None).cast("double"), 6)).select(F.struct("*").alias("g")))  # one row
    field = F.get(F.array(F.lit("xyz"), F.lit("arm_joint_0"), F.lit("other")), (F.col("episode") % 3).cast("int"))
    method = S.field_setting(field, {"joint": "std", "xyz": "min_max", "arm": "percentile_1_99"}, "min_max")
    rows = samples(spark, sf).crossJoin(g)
    return rows.select("episode", "t", F.transform(S.normalize_by_setting(F.col("window"), F.col("g"), method), r6).alias("w"))


@query("D32_throughput", f"""WITH {EV} SELECT event_id, round(512 / nullif(value, 0), 6) AS samples_s, round(512 / nullif(value, 0) / 8, 6) AS samples_s_gpu, round(512 * 2048 / nullif(value, 0), 6) AS tokens_s FROM ev""")
def _(spark, sf):
    rate = F.try_divide(F.lit(512), "value")
    return messages(spark, sf).select("event_id", r6(rate).alias("samples_s"), r6(rate / 8).alias("samples_s_gpu"), r6(F.try_divide(F.lit(512 * 2048), "value")).alias("tokens_s"))


@query("D34_array_profile", f"""WITH {VE} SELECT label, count(*) AS n, min(len(v)) AS shape_min, max(len(v)) AS shape_max, round(min(list_min(v)), 6) AS min, round(max(list_max(v)), 6) AS max, round(avg(list_avg(v)), 6) AS mean FROM ve GROUP BY label""")
def _(spark, sf):
    mean = F.try_divide(F.aggregate("v", F.lit(0.0), lambda a, x: a + x), F.size("v"))  # null for an empty array
    return vectors(spark, sf).groupBy("label").agg(
        F.count("*").alias("n"), F.min(F.size("v")).alias("shape_min"), F.max(F.size("v")).alias("shape_max"),
        r6(F.min(F.array_min("v"))).alias("min"), r6(F.max(F.array_max("v"))).alias("max"), r6(F.avg(mean)).alias("mean"),
    )


@query("D37_validate_samples", f"""WITH {VE} SELECT vec_id, array_to_string(list_filter([CASE WHEN len(v) < 64 THEN 'short' END, CASE WHEN list_max(v) > 0.3 THEN 'large' END, CASE WHEN label % 3 = 0 THEN 'missing metadata' END], lambda x: x IS NOT NULL), ',') AS errors FROM ve""")
def _(spark, sf):
    nan = F.exists("v", lambda x: F.isnan(x) | x.isNull())
    checks = F.array_compact(F.array(
        F.when(F.size("v") < 64, "short"), F.when(nan, "nan"), F.when(F.array_max("v") > 0.3, "large"), F.when(F.col("label") % 3 == 0, "missing metadata"),
    ))
    return vectors(spark, sf).select("vec_id", F.array_join(checks, ",").alias("errors"))
