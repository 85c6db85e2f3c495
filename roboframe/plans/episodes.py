"""Queries over episodes and windows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import scans
from ..operators import windows as W
from ..registry import query
from ..sources import files
from ..sources.views import EP, EV, VE, frames, messages, read, vectors

P, FUT = 1, 14
PAD = f"""pad AS (SELECT *, greatest({P} - t, 0) AS past_padding, greatest(t + {FUT} - n + 1, 0) AS future_padding FROM ep)"""
OK = "ok AS (SELECT * FROM pad WHERE past_padding <= 1 AND future_padding <= 7)"
#: slot values of each window: index clamped to the episode (copy padding)
SLOT = f"""slot AS (SELECT o.episode, o.t, o.n, j, greatest(0, least(o.n - 1, o.t - {P} + j)) AS i, o.t - {P} + j AS a
  FROM ok o, (SELECT unnest(range(0, {P + FUT + 1})) AS j)),
val AS (SELECT s.*, e.x FROM slot s JOIN ep e ON e.episode = s.episode AND e.t = s.i)"""


def steps(spark, sf):
    return W.episode_timesteps(frames(spark, sf))


def samples(spark, sf, how="copy"):
    return W.window_samples(steps(spark, sf), P, FUT, 1, 7, how)


@query("E01_episode_timesteps", f"WITH {EP} SELECT episode, t, n, x FROM ep")
def _(spark, sf):
    return steps(spark, sf).select("episode", "t", "n", "x")


@query("B17_stride_anchors", f"WITH {EP} SELECT episode, t, x FROM ep WHERE t % 5 = 0")
def _(spark, sf):
    return W.stride_anchors(steps(spark, sf), 5).select("episode", "t", "x")


@query("B10_filter_window_padding", f"WITH {EP}, {PAD}, {OK} SELECT episode, t, past_padding, future_padding FROM ok")
def _(spark, sf):
    rows = W.filter_window_padding(W.window_padding(steps(spark, sf), P, FUT), 1, 7)
    return rows.select("episode", "t", "past_padding", "future_padding")


@query("E02_window_samples", f"""WITH {EP}, {PAD}, {OK}, {SLOT}, w AS (SELECT episode, t, list(x ORDER BY j) AS w FROM val GROUP BY ALL)
SELECT episode, t, n, past_padding, future_padding, greatest(t - {P}, 0) AS "start", least(t + {FUT}, n - 1) AS "end",
  past_padding > 0 OR future_padding > 0 AS is_padded, w AS "window" FROM ok JOIN w USING (episode, t)""")
def _(spark, sf):
    return samples(spark, sf).select("episode", "t", "n", "past_padding", "future_padding", "start", "end", "is_padded", "window")


@query("E03_pad_window", f"""WITH {EP}, {PAD}, {OK}, s AS (SELECT episode, t, n, j, t - {P} + j AS a, greatest(t - {P}, 0) AS lo, least(t + {FUT}, n - 1) AS hi
    FROM ok, (SELECT unnest(range(0, {P + FUT + 1})) AS j)),
m AS (SELECT *, hi - lo + 1 AS k, CASE WHEN a < lo THEN lo + (lo - a) WHEN a > hi THEN hi - (a - hi) ELSE a END AS r,
    CASE WHEN a BETWEEN lo AND hi THEN a END AS z FROM s),
v AS (SELECT m.episode, m.t, j, coalesce(e.x, 0.0) AS zero, f.x AS refl FROM m LEFT JOIN ep e ON e.episode = m.episode AND e.t = m.z
    JOIN ep f ON f.episode = m.episode AND f.t = m.r)
SELECT episode, t, list(zero ORDER BY j) AS zero, list(refl ORDER BY j) AS reflect FROM v GROUP BY ALL""")
def _(spark, sf):
    rows = W.window_padding(W.window_values(steps(spark, sf), P, FUT), P, FUT)
    rows = W.filter_window_padding(rows, 1, 7)
    args = (F.col("w"), F.col("past_padding"), F.col("future_padding"))
    return rows.select("episode", "t", W.pad_window(*args, "zero").alias("zero"), W.pad_window(*args, "reflect").alias("reflect"))


@query("E04_past_future_masks", f"""WITH {EP}, {PAD}, {OK}, s AS (SELECT episode, t, n, j, t - {P} + j AS a FROM ok, (SELECT unnest(range(0, {P + FUT + 1})) AS j))
SELECT episode, t, list(j < {P} AND a >= 0 AND a < n ORDER BY j) AS past_mask, list(j >= {P} AND a >= 0 AND a < n ORDER BY j) AS future_mask
FROM s GROUP BY ALL""")
def _(spark, sf):
    return samples(spark, sf).select("episode", "t", "past_mask", "future_mask")


@query("E05_image_offset_lookup", f"""WITH {EP} SELECT e.episode, e.t, a.x AS "x_t-1", e.x AS x_t0, b.x AS x_t3 FROM ep e
JOIN ep a ON a.episode = e.episode AND a.t = greatest(e.t - 1, 0) JOIN ep b ON b.episode = e.episode AND b.t = least(e.t + 3, e.n - 1)""")
def _(spark, sf):
    return W.image_offset_lookup(steps(spark, sf), [-1, 0, 3], "x").select("episode", "t", "`x_t-1`", "x_t0", "x_t3")


@query("E06_crop_window", f"""WITH {EP}, {PAD}, {OK}, {SLOT} SELECT episode, t, list(x ORDER BY j) AS w, 1 AS anchor FROM val WHERE j BETWEEN 0 AND 4 GROUP BY ALL""")
def _(spark, sf):
    w = W.crop_window(F.col("window"), F.lit(P), 1, 3)
    return samples(spark, sf).select("episode", "t", w.alias("w"), F.lit(1).alias("anchor"))


@query("B11_filter_still_windows", f"""WITH {EP}, s AS (SELECT episode, t, stddev_pop(x) OVER (PARTITION BY episode ORDER BY t ROWS BETWEEN {P} PRECEDING AND {FUT} FOLLOWING) AS d FROM ep)
SELECT episode, t FROM s WHERE d > 30""")
def _(spark, sf):
    rows = steps(spark, sf).withColumnRenamed("x", "joint_x")
    return W.filter_still_windows(rows, P, FUT, 30.0, ["joint_x"]).select("episode", "t")


@query("D08_filter_counters", f"""WITH {EP}, {PAD}, s AS (SELECT *, stddev_pop(x) OVER (PARTITION BY episode ORDER BY t ROWS BETWEEN {P} PRECEDING AND {FUT} FOLLOWING) AS d,
  past_padding > 1 OR future_padding > 7 AS p FROM pad)
SELECT count(*) AS potential, count(*) FILTER (WHERE p) AS dropped_padding, count(*) FILTER (WHERE NOT p AND d <= 30) AS dropped_still,
  count(*) FILTER (WHERE NOT p AND d > 30) AS kept FROM s""")
def _(spark, sf):
    counts = W.write_kept_windows(steps(spark, sf), files.scratch(spark), P, FUT, 1, 7, 30.0)
    return spark.createDataFrame([counts], "potential long, dropped_padding long, dropped_still long, kept long")


@query("B01_select_fields", f"WITH {EP} SELECT episode, t, x AS action FROM ep")
def _(spark, sf):
    rows = steps(spark, sf).withColumn("lowdim", F.create_map(F.lit("action"), "x", F.lit("unused"), F.col("x") * 2))
    wanted = ["action"]
    kept = F.map_filter("lowdim", lambda k, _: k.isin(wanted))
    return rows.select("episode", "t", kept["action"].alias("action"))


@query("B08_filter_episodes", f"WITH {EP} SELECT episode, t, x FROM ep WHERE episode IN (1, 5, 8, 13)")
def _(spark, sf):
    return steps(spark, sf).where(F.col("episode").isin(1, 5, 8, 13)).select("episode", "t", "x")


@query("B16_every_nth", f"""WITH {EV}, k AS (SELECT *, row_number() OVER (PARTITION BY topic, episode ORDER BY s, event_id) AS k FROM ev)
SELECT topic, episode, event_id FROM k WHERE k = 1 OR k % 4 = 0""")
def _(spark, sf):
    return W.every_nth(messages(spark, sf), ["topic", "episode"], ["s", "event_id"], 4).select("topic", "episode", "event_id")


@query("E10_hysteresis_state", f"""WITH {EP}, e AS (SELECT episode, t, x, CASE WHEN x > 60 THEN true WHEN x < 20 THEN false WHEN t = 0 THEN x >= 40 END AS e FROM ep)
SELECT episode, t, last_value(e IGNORE NULLS) OVER (PARTITION BY episode ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS is_open FROM e""")
def _(spark, sf):
    return W.hysteresis_state(steps(spark, sf), 20.0, 60.0).select("episode", "t", "is_open")


@query("E11_history_buffer", f"""WITH {EP}, s AS (SELECT e.episode, e.t, j, greatest(e.t - 3 + j, 0) AS i FROM ep e, (SELECT unnest(range(0, 4)) AS j))
SELECT s.episode, s.t, list(e.x ORDER BY j) AS h FROM s JOIN ep e ON e.episode = s.episode AND e.t = s.i GROUP BY ALL""")
def _(spark, sf):
    return W.history_buffer(steps(spark, sf), 3).select("episode", "t", "h")


@query("E12_fractional_lag", f"""WITH {EP} SELECT e.episode, e.t, round(a.x * 0.75 + b.x * 0.25, 6) AS lagged FROM ep e
JOIN ep a ON a.episode = e.episode AND a.t = least(e.t + 2, e.n - 1) JOIN ep b ON b.episode = e.episode AND b.t = least(e.t + 3, e.n - 1)""")
def _(spark, sf):
    return W.fractional_lag(steps(spark, sf), 2.25).select("episode", "t", F.round("lagged", 6).alias("lagged"))


@query("E16_window_calibration", f"""WITH {VE}, k AS (SELECT label, CAST(row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS INTEGER) AS t, count(*) OVER (PARTITION BY label) AS n, v[1:9] AS m FROM ve),
s AS (SELECT e.label, e.t, j, greatest(0, least(e.n - 1, e.t - 1 + j)) AS i FROM k e, (SELECT unnest(range(0, 4)) AS j))
SELECT s.label, s.t, list(round(list_sum(e.m), 6) ORDER BY j) AS windowed, list(round(f.m[1], 6) ORDER BY j) AS static FROM s
JOIN k e ON e.label = s.label AND e.t = s.i JOIN k f ON f.label = s.label AND f.t = s.t GROUP BY ALL""")
def _(spark, sf):
    # an episode is a label, which may have very many vectors: both its numbering and its windows go by blocks
    m = vectors(spark, sf).where("label IS NOT NULL")
    m = m.select(F.col("label").alias("episode"), F.col("vec_id").alias("ts"), F.lit(0).alias("ordinal"), F.slice("v", 1, 9).alias("m"))
    steps = W.episode_timesteps(m, hot=scans.HOT)
    rows = W.window_padding(W.window_values(steps, 1, 2, "m", block=1 << 16), 1, 2)
    window = W.pad_window(F.col("w"), F.col("past_padding"), F.col("future_padding"))
    total = F.transform(window, lambda a: F.round(F.aggregate(a, F.lit(None).cast("double"), lambda s, y: F.coalesce(s + y, s, y)), 6))
    return rows.select(F.col("episode").alias("label"), "t", total.alias("windowed"), F.array_repeat(F.round(F.get("m", F.lit(0)), 6), 4).alias("static"))


@query("D33_metadata_constant", "SELECT l_orderkey AS episode, count(DISTINCT l_returnflag) = 1 AS constant FROM lineitem GROUP BY 1")
def _(spark, sf):
    rows = read(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("episode"))
    return rows.agg((F.min("l_returnflag") == F.max("l_returnflag")).alias("constant"))


@query("C05_exclude_validation", f"""WITH {EP} SELECT episode, t, x FROM ep WHERE NOT EXISTS (SELECT 1 FROM customer WHERE c_custkey = episode AND c_mktsegment = 'MACHINERY')""")
def _(spark, sf):
    held = read(spark, sf, "customer").where("c_mktsegment = 'MACHINERY'").select(F.col("c_custkey").alias("episode"))
    return steps(spark, sf).join(held, "episode", "left_anti").select("episode", "t", "x")


@query("C03_episode_meta_join", f"""WITH {EP} SELECT episode, t, coalesce(c_mktsegment, replace('pick_' || episode, '_', ' ')) AS instruction FROM ep
LEFT JOIN (SELECT * FROM customer WHERE c_custkey % 2 = 0) ON c_custkey = episode""")
def _(spark, sf):
    meta = read(spark, sf, "customer").where("c_custkey % 2 = 0").select(F.col("c_custkey").alias("episode"), "c_mktsegment")
    name = F.replace(F.concat(F.lit("pick_"), "episode"), F.lit("_"), F.lit(" "))
    return steps(spark, sf).join(meta, "episode", "left").select("episode", "t", F.coalesce("c_mktsegment", name).alias("instruction"))


@query("C04_video_row_check", f"""WITH {EP}, f AS (SELECT episode, max(n) AS n_rows, max(n) + episode % 3 AS frames FROM ep GROUP BY episode)
SELECT episode, n_rows, frames, CASE WHEN frames > n_rows THEN 'truncate' ELSE 'ok' END AS status FROM f WHERE episode % 7 <> 0""")
def _(spark, sf):
    rows = steps(spark, sf).groupBy("episode").agg(F.max("n").alias("n_rows"))
    video = rows.where("episode % 7 <> 0").select("episode", (F.col("n_rows") + F.col("episode") % 3).alias("frames"))
    both = rows.join(video, "episode")
    status = (
        F.when(F.col("frames") < F.col("n_rows"), F.raise_error(F.lit("fewer frames than rows")))
        .when(F.col("frames") > F.col("n_rows"), "truncate")
        .otherwise("ok")
    )
    return both.select("episode", "n_rows", "frames", status.alias("status"))


@query("C18_reference_row_join", f"""WITH {EP}, {PAD}, {OK} SELECT episode, t, 'robot__desired__poses__xyz' AS field, CASE WHEN episode % 3 > 0 THEN x / 2 END AS reference FROM ok
UNION ALL SELECT episode, t, 'robot__actual__poses__xyz', x / 2 FROM ok WHERE episode % 3 > 0 UNION ALL SELECT episode, t, 'gripper', NULL FROM ok""")
def _(spark, sf):
    # a desired pose, in two of three episodes the actual one beside it, and a field that has no counterpart
    s = steps(spark, sf)
    desired, actual = s.withColumn("field", F.lit("robot__desired__poses__xyz")), s.where("episode % 3 > 0").withColumns({"field": F.lit("robot__actual__poses__xyz"), "x": F.col("x") / 2})
    fields = desired.unionByName(actual).unionByName(s.withColumn("field", F.lit("gripper")))
    anchors = W.filter_window_padding(W.window_padding(fields, P, FUT), 1, 7)
    return W.reference_rows(anchors, fields).select("episode", "t", "field", "reference")
