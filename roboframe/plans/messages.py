"""Queries over message logs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import nested
from ..operators import alignment as A
from ..operators.statistics import masked_percentiles
from ..registry import query
from ..sources import rejects
from ..sources.views import EV, messages, read

PAIR = "tg AS (SELECT * FROM ev WHERE topic = 'view' AND episode IN (SELECT episode FROM ev WHERE topic = 'purchase')), so AS (SELECT * FROM ev WHERE topic = 'purchase')"


@query("C01_nearest_asof_join", f"""WITH {EV}, {PAIR}, r AS (SELECT t.event_id, t.episode, s.s AS st, s.value AS v, row_number() OVER (PARTITION BY t.event_id ORDER BY abs(s.s - t.s), s.s, s.event_id) AS k
FROM tg t JOIN so s ON s.episode = t.episode) SELECT event_id, episode, round(st, 6) AS source_time, v AS near FROM r WHERE k = 1""")
def _(spark, sf):
    m = messages(spark, sf)
    so = m.where("topic = 'purchase'").select("episode", "s", F.col("value").alias("near"), F.col("event_id").alias("o"))
    tg = m.where("topic = 'view'").select("episode", "s", "event_id").join(so.select("episode").distinct(), "episode", "left_semi")
    r = A.nearest_asof_join(tg, so, ["episode"], "s", ["near"], ordinal="o")
    return r.select("event_id", "episode", F.round("source_time", 6).alias("source_time"), "near")


@query("C02_align_to_pivot", f"""WITH {EV}, tg AS (SELECT * FROM ev WHERE topic = 'view'), r AS (SELECT t.event_id, t.episode, t.value AS x, s.topic, s.value AS v,
  row_number() OVER (PARTITION BY t.event_id, s.topic ORDER BY abs(s.s - t.s), s.s, s.event_id) AS k FROM tg t JOIN ev s ON s.episode = t.episode AND s.topic IN ('click', 'error'))
SELECT event_id, episode, x AS "view", max(v) FILTER (WHERE topic = 'click') AS click, max(v) FILTER (WHERE topic = 'error') AS error FROM r WHERE k = 1 GROUP BY ALL""")
def _(spark, sf):
    out = A.align_to_pivot(messages(spark, sf), "view", ["click", "error"], ["episode"], "topic", "s", "value", "event_id")
    return out.select("event_id", "episode", "view", "click", "error")


@query("E07_gap_check", f"""WITH {EV}, g AS (SELECT episode, s - lag(s) OVER w AS gap, CAST(row_number() OVER w - 2 AS INTEGER) AS i FROM ev WINDOW w AS (PARTITION BY episode ORDER BY s, event_id))
SELECT episode, count(*) FILTER (WHERE gap > 80000) AS n_gaps, round(max(gap), 5) AS largest, arg_max(i, gap) AS "at", round(median(gap), 3) AS median FROM g WHERE gap IS NOT NULL GROUP BY episode""")
def _(spark, sf):
    g = A.gap_check(messages(spark, sf), ["episode"], "s", 80000.0, "event_id")
    return g.select("episode", "n_gaps", F.round("largest", 5).alias("largest"), "at", F.round("median", 3).alias("median"))


@query("E08_clock_overlap_check", f"""WITH {EV}, sp AS (SELECT episode, topic, min(s) AS lo, max(s) AS hi FROM ev WHERE s < 500000 OR topic <> 'view' AND s > 700000 GROUP BY ALL)
SELECT a.episode, a.topic, a.hi >= p.lo - 0.1 * greatest(p.hi - p.lo, 1) AND a.lo <= p.hi + 0.1 * greatest(p.hi - p.lo, 1) AS overlaps FROM sp a JOIN sp p ON p.episode = a.episode AND p.topic = 'view' WHERE a.topic <> 'view'""")
def _(spark, sf):
    m = messages(spark, sf).where("s < 500000 OR topic <> 'view' AND s > 700000")
    return A.clock_overlap_check(m, "view", ["episode"], "topic", "s").select("episode", "topic", "overlaps")


@query("E09_effective_rate", f"WITH {EV} SELECT episode, topic, round(coalesce((count(*) - 1) / nullif(max(s) - min(s), 0), 0), 9) AS rate FROM ev GROUP BY ALL")
def _(spark, sf):
    return messages(spark, sf).groupBy("episode", "topic").agg(F.round(A.effective_rate("s"), 9).alias("rate"))


@query("F07_sorted_timestamps", f"WITH {EV} SELECT episode, topic, list(event_id ORDER BY s, event_id) AS ids FROM ev GROUP BY ALL")
def _(spark, sf):
    rows = messages(spark, sf).groupBy("episode", "topic").agg(F.array_sort(F.collect_list(F.struct("s", "event_id"))).alias("z"))
    return rows.select("episode", "topic", F.col("z.event_id").alias("ids"))


def parsed_messages(spark, sf):
    """Messages whose payload is JSON; every thirteenth is cut short."""
    props = F.when(F.col("event_id") % 13 == 5, F.expr("substring(props, 1, length(props) - 1)")).otherwise(F.col("props"))
    rows = messages(spark, sf).select("topic", "event_id", F.try_parse_json(props).alias("v"))
    return rejects.split(rows.withColumn("reason", F.when(F.col("v").isNull(), "the payload is not JSON")), "messages", F.col("event_id"))


@query("A12_scan_messages", f"WITH {EV} SELECT topic, event_id, CAST(json_extract(props, '$.k') AS DOUBLE) AS k FROM ev WHERE json_valid(props) AND event_id % 13 <> 5")
def _(spark, sf):
    return parsed_messages(spark, sf)[0].select("topic", "event_id", F.try_variant_get("v", "$.k", "double").alias("k"))


@query("A12b_message_rejects", f"""WITH {EV} SELECT 'messages' AS stage, CAST(event_id AS VARCHAR) AS "row", 'the payload is not JSON' AS reason FROM ev WHERE NOT json_valid(props) OR event_id % 13 = 5""")
def _(spark, sf):
    return parsed_messages(spark, sf)[1]


@query("H30_message_field_path", f"WITH {EV} SELECT event_id, [CAST(json_extract(props, '$.k') AS DOUBLE)] AS k, [CAST(json_extract(props, '$.k') AS DOUBLE), 1.0] AS list, CAST(NULL AS DOUBLE[]) AS bad FROM ev")
def _(spark, sf):
    wrapped = F.concat(F.lit('{"a":{"l":[{"x":'), F.get_json_object("props", "$.k"), F.lit('},{"x":1}]}}'))
    return messages(spark, sf).select(
        "event_id", A.message_field_path(F.col("props"), "k").alias("k"), A.message_field_path(wrapped, "a.l[*].x").alias("list"),
        A.message_field_path(F.col("props"), "z.y").alias("bad"),
    )


@query("H31_structured_message", f"""WITH {EV}, q AS (SELECT event_id, CAST(json_extract(props, '$.k') AS DOUBLE) AS k FROM ev), n AS (SELECT *, sqrt(k * k + 30) AS l FROM q),
u AS (SELECT event_id, k, 1 / l AS x, 2 / l AS y, 5 / l AS z, k / l AS w FROM n)
SELECT event_id, k AS joint_a, 2 * k AS joint_b, round(1 - 2 * (y * y + z * z), 6) AS r0, round(2 * (x * y - z * w), 6) AS r1, round(2 * (x * z + y * w), 6) AS r2 FROM u""")
def _(spark, sf):
    k = F.get_json_object("props", "$.k").cast("double")
    m = A.quaternion_to_matrix(F.lit(1.0), F.lit(2.0), F.lit(5.0), k)
    rows = messages(spark, sf).select("event_id", k.alias("k"), m.alias("m"), F.map_from_arrays(F.array(F.lit("a"), F.lit("b")), F.array(k, 2 * k)).alias("joints"))
    return rows.select("event_id", F.col("joints.a").alias("joint_a"), F.col("joints.b").alias("joint_b"), *[F.round(F.get("m", F.lit(i)), 6).alias(f"r{i}") for i in range(3)])


@query("H32_best_timestamp", f"""WITH {EV}, h AS (SELECT *, CASE WHEN topic IN ('view', 'click') THEN s + 1 END AS hs FROM ev), z AS (SELECT min(s) AS z FROM ev)
SELECT event_id, round(coalesce(hs, s) - z, 6) AS stamp FROM h, z""")
def _(spark, sf):
    m = messages(spark, sf).withColumn("hs", F.when(F.col("topic").isin("view", "click"), F.col("s") + 1))
    first = F.broadcast(m.agg(F.min("s").alias("z")))  # one row
    r = A.best_timestamp(m, ["topic"], "hs", "s").crossJoin(first)
    return r.select("event_id", F.round(F.col("stamp") - F.col("z"), 6).alias("stamp"))


@query("H33_typed_readings", "SELECT conv_id, list(length(text) ORDER BY turn) AS readings FROM conversations WHERE role = 'user' GROUP BY conv_id")
def _(spark, sf):
    c = read(spark, sf, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", F.col("role").alias("kind"), F.array(F.length("text")).alias("readings")))).alias("s"))
    r = F.flatten(F.transform(F.filter("s", lambda x: x["kind"] == "user"), lambda x: x["readings"]))
    return c.select("conv_id", r.alias("readings")).where(F.size("readings") > 0)


@query("D35_topic_inventory", f"WITH {EV} SELECT topic, count(*) AS n, arg_min(props, s) AS sample FROM ev GROUP BY topic")
def _(spark, sf):
    return messages(spark, sf).groupBy("topic").agg(F.count("*").alias("n"), F.min_by("props", "s").alias("sample"))


@query("B05_rename_by_mapping", f"WITH {EV} SELECT event_id, CASE topic WHEN 'view' THEN 'camera_front' WHEN 'click' THEN 'camera_wrist' END AS name FROM ev WHERE topic IN ('view', 'click')")
def _(spark, sf):
    mapping = F.broadcast(spark.createDataFrame([("view", "camera_front"), ("click", "camera_wrist")], "topic string, name string"))
    return messages(spark, sf).join(mapping, "topic").select("event_id", "name")


TALK = """cfg AS (SELECT conv_id, json_object('turns', count(*), 'first', json_object('role', arg_min(role, turn), 'chars', CAST(length(arg_min(text, turn)) AS BIGINT)),
  'roles', list(role ORDER BY turn), 'talk', json_object('users', count(*) FILTER (WHERE role = 'user'), 'long', count(*) > 4, 'note', NULL, 'more', json_object(),
  'ends', [json_object('at', min(turn)), json_object('at', max(turn))])) AS j FROM conversations GROUP BY conv_id)"""


def talks(spark, sf):
    """A nested configuration for each conversation."""
    turns = F.array_sort(F.collect_list(F.struct("turn", "role", F.length("text").cast("long").alias("chars"))))
    c = read(spark, sf, "conversations").groupBy("conv_id").agg(turns.alias("t"))
    users = F.size(F.filter("t", lambda x: x["role"] == "user"))
    ends = F.array(F.struct(F.get("t", F.lit(0))["turn"].alias("at")), F.struct(F.element_at("t", -1)["turn"].alias("at")))
    talk = F.struct(users.alias("users"), (F.size("t") > 4).alias("long"), F.lit(None).cast("string").alias("note"), F.create_map().cast("map<string,int>").alias("more"), ends.alias("ends"))
    first = F.get("t", F.lit(0))
    config = F.struct(F.size("t").alias("turns"), F.struct(first["role"].alias("role"), first["chars"].alias("chars")).alias("first"), F.col("t.role").alias("roles"), talk.alias("talk"))
    return c.select("conv_id", F.parse_json(F.to_json(config, {"ignoreNullFields": "false"})).alias("config"))


FLAT = f"""{TALK}, flat AS (SELECT conv_id, substr(t.fullkey, 3) AS path, CASE t.type WHEN 'VARCHAR' THEN 'string' WHEN 'BOOLEAN' THEN 'boolean' WHEN 'NULL' THEN 'null' WHEN 'OBJECT' THEN 'object' WHEN 'ARRAY' THEN 'list' ELSE 'number' END AS kind,
  CASE WHEN t.type <> 'NULL' THEN t.value ->> '$' END AS value FROM cfg, json_tree(cfg.j) t WHERE t.type NOT IN ('OBJECT', 'ARRAY') OR t.value::VARCHAR IN ('{{}}', '[]'))"""


@query("D19_config_schema", f"""WITH {FLAT}, c AS (SELECT path, kind, value, count(*) AS n FROM flat GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY path ORDER BY value NULLS FIRST, kind) AS k FROM c) SELECT path, kind, value, n FROM r WHERE k <= 50""")
def _(spark, sf):
    return nested.value_counts(nested.walk(talks(spark, sf), [], "config"))


@query("D19b_flatten_config", f"WITH {FLAT} SELECT conv_id, path, kind, value FROM flat")
def _(spark, sf):
    return nested.walk(talks(spark, sf), ["conv_id"], "config")


@query("D20_config_diff", f"""WITH {EV}, f AS (SELECT event_id, 'k' AS path, CAST(json_extract(props, '$.k') AS VARCHAR) AS value FROM ev), n AS (SELECT path, count(DISTINCT value) AS n_values FROM f GROUP BY path)
SELECT path, value, n_values, count(*) AS n, min(event_id) AS first_run, max(event_id) AS last_run FROM f JOIN n USING (path) WHERE n_values > 1 GROUP BY ALL""")
def _(spark, sf):
    pairs = F.explode(F.map_entries(F.from_json("props", "map<string,string>")))
    # every run against all others: the paths that differ, and which runs say what
    flat = messages(spark, sf).select("event_id", pairs.alias("p")).groupBy(F.col("p.key").alias("path"), F.col("p.value").alias("value"))
    said = flat.agg(F.count("*").alias("n"), F.min("event_id").alias("first_run"), F.max("event_id").alias("last_run"))
    paths = said.where("value IS NOT NULL").groupBy("path").agg(F.count("*").alias("n_values")).where("n_values > 1")
    return said.join(paths, "path").select("path", "value", "n_values", "n", "first_run", "last_run")


@query("D22_duration_summary", f"""WITH {EV} SELECT topic = 'error' AS failed, count(*) AS n, round(avg(value), 6) AS mean, round(median(value), 6) AS median, min(value) AS min, max(value) AS max, round(stddev_pop(value), 6) AS std FROM ev GROUP BY 1""")
def _(spark, sf):
    v = F.col("value")
    rows = messages(spark, sf).select((F.col("topic") == "error").alias("failed"), "value")
    out = rows.groupBy("failed").agg(
        F.count("*").alias("n"), F.round(F.avg(v), 6).alias("mean"), F.min(v).alias("min"), F.max(v).alias("max"), F.round(F.stddev_pop(v), 6).alias("std"))
    middle = masked_percentiles(rows, ("failed",), "value", (0.5,)).select("failed", F.round(F.get("p", F.lit(0)), 6).alias("median"))
    return out.join(middle, "failed")


@query("D23_duration_histogram", f"""WITH {EV}, r AS (SELECT min(value) AS lo, (max(value) - min(value)) / 60 AS w FROM ev), b AS (SELECT CAST(least(floor((value - lo) / w), 59) AS INTEGER) AS bin, topic <> 'error' AS ok FROM ev, r)
SELECT bin, count(*) AS n, round(avg(CASE WHEN ok THEN 1.0 ELSE 0.0 END), 6) AS share FROM b GROUP BY bin""")
def _(spark, sf):
    m = messages(spark, sf)
    r = F.broadcast(m.agg(F.min("value").alias("lo"), ((F.max("value") - F.min("value")) / 60).alias("w")))  # one row
    b = F.least(F.floor(F.try_divide(F.col("value") - F.col("lo"), "w")), F.lit(59)).cast("int")
    b = F.when(F.col("w") == 0, 0).otherwise(b)  # all values equal
    share = F.round(F.avg(F.when(F.col("topic") != "error", 1.0).otherwise(0.0)), 6)
    return m.crossJoin(r).groupBy(b.alias("bin")).agg(F.count("*").alias("n"), share.alias("share"))
