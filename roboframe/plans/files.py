"""Queries that write tables as files and read them back, and streaming twins run to their end."""

from __future__ import annotations

import io

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import convert as C
from ..operators import results as R
from ..operators import windows as W
from ..registry import query
from ..sources import files as S
from ..sources import filesets, rejects
from ..sources import tars as TAR
from ..sources.views import EP, EV, RN, RO, evaluations, frames, messages, read, rollouts
from ..streaming import jobs as J
from ..streaming import merge as M

#: Batches of steps double in width from 100 on, so many times, up to the widest.
DOUBLINGS = 10
WIDEST = 100 << DOUBLINGS


def tar_rows(spark, sf):
    """Documents as samples of two members, 64 to a shard."""
    d = read(spark, sf, "documents")
    text, meta = F.col("text").cast("binary"), F.to_json(F.struct("lang", "source")).cast("binary")
    return d.select(
        F.floor(F.col("doc_id") / 64).cast("int").alias("shard"), F.format_string("%08d", "doc_id").alias("key"),
        F.create_map(F.lit("txt"), text, F.lit("json"), meta).alias("fields"),
    )


def manifest_of(spark, root):
    """The manifest that the sink has written, with the files' names."""
    m = S.read_manifest(spark, f"{root}/{TAR.MANIFEST}")
    return m.select(F.concat("shard", F.lit(".tar")).alias("name"), "num_sequences")


@query("A03_write_tar_samples", "SELECT printf('shard_%06d.tar', doc_id // 64) AS name, count(*) AS num_sequences FROM documents GROUP BY 1")
def _(spark, sf):
    root = S.scratch(spark)
    TAR.write_tar_shards(tar_rows(spark, sf), root)
    return manifest_of(spark, root)


@query("A02_read_tar_samples", "SELECT printf('shard_%06d.tar', doc_id // 64) AS shard, lpad(CAST(doc_id AS VARCHAR), 8, '0') AS key, text FROM documents")
def _(spark, sf):
    root = S.scratch(spark)
    TAR.write_tar_shards(tar_rows(spark, sf), root)
    rows = TAR.read_tar_shards(spark, root, fields=("txt",)).where("reason IS NULL")
    return rows.select("shard", "key", F.col("fields")["txt"].cast("string").alias("text"))


@query("A04_write_episode_shards", f"""WITH {EP} SELECT printf('shard_%06d.tar', episode) AS name, count(*) AS num_sequences, round(sum(x), 4) AS total, string_agg('e' || episode || '_f' || lpad(CAST(t AS VARCHAR), 6, '0'), ',' ORDER BY t) AS keys
FROM ep GROUP BY episode""")
def _(spark, sf):
    # frames lie in their shard in the order of their index, whatever their keys say
    root = S.scratch(spark)
    s = W.episode_timesteps(frames(spark, sf))
    fields = F.create_map(F.lit("json"), F.to_json(F.struct("x")).cast("binary"))
    key = F.format_string("e%d_f%06d", "episode", "t")
    TAR.write_tar_shards(s.select(F.col("episode").cast("int").alias("shard"), key.alias("key"), "t", fields.alias("fields")), root, order="t")
    rows = TAR.read_tar_shards(spark, root).withColumn("at", F.monotonically_increasing_id())
    x = F.get_json_object(F.col("fields")["json"].cast("string"), "$.x").cast("double")
    found = rows.groupBy(F.col("shard").alias("name")).agg(
        F.round(F.sum(x), 4).alias("total"), F.transform(F.array_sort(F.collect_list(F.struct("at", "key"))), lambda r: r["key"]).alias("keys")
    )
    return found.join(manifest_of(spark, root), "name").select("name", "num_sequences", "total", F.array_join("keys", ",").alias("keys"))


def chunked(spark, sf):
    """A dataset in chunks: data/chunk-000/episode_000000.parquet, an episode to a file, and what is said of it in meta."""
    root, s = S.scratch(spark), W.episode_timesteps(frames(spark, sf)).select("episode", "t", "x")

    def pack(table: pa.Table) -> pa.Table:
        e, out = table.column("episode")[0].as_py(), io.BytesIO()
        pq.write_table(table.select(["t", "x"]).sort_by("t"), out)
        return pa.table({"path": [f"data/chunk-{e // 100:03d}/episode_{e:06d}.parquet"], "content": [out.getvalue()]})

    filesets.write_files(s.groupBy("episode").applyInArrow(pack, "path string, content binary"), root)
    # some hundred episodes to a file of their descriptions
    said = F.to_json(F.struct(F.col("episode").alias("episode_index"), F.array(F.concat(F.lit("task "), F.col("episode") % 5)).alias("tasks"), F.col("length")))
    lines = s.groupBy("episode").agg(F.count("*").alias("length")).groupBy(F.floor(F.col("episode") / 100).alias("k")).agg(F.array_join(F.array_sort(F.collect_list(said)), "\n").alias("content"))
    filesets.write_files(lines.select(F.format_string("meta/episodes-%03d.jsonl", "k").alias("path"), "content"), root)
    filesets.write_files(spark.createDataFrame([("meta/info.json", '{"fps": 20,\n "robot_type": "x"}')], "path string, content string"), root)
    return root


@query("A08_scan_chunked_episodes", f"WITH {EP} SELECT CAST(episode AS INTEGER) AS episode_index, count(*) AS n, round(sum(x), 4) AS total FROM ep GROUP BY 1")
def _(spark, sf):
    rows = S.scan_chunked_episodes(spark, chunked(spark, sf))
    return rows.groupBy("episode_index").agg(F.count("*").alias("n"), F.round(F.sum("x"), 4).alias("total"))


@query("A08b_chunked_metadata", f"WITH {EP} SELECT CAST(episode AS BIGINT) AS episode_index, 'task ' || episode % 5 AS task, count(*) AS length, count(*) / 20.0 AS seconds FROM ep GROUP BY ALL")
def _(spark, sf):
    root = chunked(spark, sf)
    rows = S.scan_episode_metadata(spark, root).crossJoin(F.broadcast(S.scan_fps(spark, root)))  # one row
    return rows.select("episode_index", F.get("tasks", F.lit(0)).alias("task"), "length", (F.col("length") / F.col("fps")).alias("seconds"))


@query("A09_scan_frame_json", f"WITH {EP} SELECT 'h1' AS robot_type, count(*) AS n, round(sum(x), 4) AS total FROM ep")
def _(spark, sf):
    # the frames of each episode as a file of its own that holds one JSON array
    root = S.scratch(spark)
    s = W.episode_timesteps(frames(spark, sf))
    one = F.struct(F.col("t").alias("time"), F.struct(F.array("x").alias("arm_state")).alias("states"))
    text = s.groupBy("episode").agg(F.to_json(F.array_sort(F.collect_list(one))).alias("value"))
    text.select(F.col("episode").alias("file"), "value").write.partitionBy("file").text(f"{root}/task")
    rows = S.scan_frame_json(spark, f"{root}/task/*")
    rows = rows.select("robot_type", F.col("states.arm_state")[0].alias("x"))
    return rows.groupBy("robot_type").agg(F.count("*").alias("n"), F.round(F.sum("x"), 4).alias("total"))


def summary_files(spark, sf):
    """A text file for each rollout: its success on a line where it has one, every thirtieth of them empty of keys. Folders
    hold those of a thousand numbers; of rollouts with the same number each has a file. Those without a number have none."""
    root, r = S.scratch(spark), rollouts(spark, sf).where("demo_id IS NOT NULL")
    said = F.when(F.col("success").isNotNull(), F.concat(F.lit("success: "), F.col("success").cast("string"), F.lit("\n"))).otherwise("")
    text = F.when(F.col("demo_id") % 30 == 7, "nothing to say").otherwise(F.concat(F.lit("demo: 1\n"), said))
    k = F.row_number().over(Window.partitionBy("folder", "demo_id").orderBy("value"))
    files = r.select(F.expr("demo_id DIV 1000").alias("folder"), "demo_id", text.alias("value")).repartition("folder").withColumn("k", k)
    filesets.write_files(files.select(F.format_string("of=%d/%d_%d.txt", "folder", "demo_id", "k").alias("path"), F.col("value").alias("content")), root)
    rows = filesets.read_files(spark, root)
    return S.summary_rows(rows.select(F.regexp_extract("path", r"(-?\d+)_\d+\.txt$", 1).alias("path"), F.col("content").cast("string").alias("value")))


@query("A14_scan_summary", f"WITH {RO} SELECT demo_id, coalesce(success, false) AS success FROM ro WHERE demo_id % 30 <> 7")
def _(spark, sf):
    good, _ = rejects.split(summary_files(spark, sf), "summaries", F.col("path"))
    return good.select(F.col("path").cast("long").alias("demo_id"), "success")


@query("A14b_summary_rejects", f"""WITH {RO} SELECT 'summaries' AS stage, CAST(demo_id AS VARCHAR) AS "row", 'no line of the form `key:`' AS reason FROM ro WHERE demo_id % 30 = 7""")
def _(spark, sf):
    return rejects.split(summary_files(spark, sf), "summaries", F.col("path"))[1]


def batches(spark, rows, batch, build, keep, mode="append", key=None, root=None):
    """Write rows into a folder for each value of `batch`, one folder after the other, each once a streaming query has
    taken all before it and given it to keep(frame, number); returns the query's frame. Rows without a batch come in batch
    0. Rows of a `key` lie in one file of each folder, so their order holds where a trigger sees a folder that is not yet
    whole."""
    root = root or S.scratch(spark)
    rows.withColumn("_batch", F.coalesce(batch.cast("long"), F.lit(0))).write.partitionBy("_batch").parquet(f"{root}/held")
    held = spark.read.schema(T.StructType([*rows.schema, T.StructField("_batch", T.LongType())])).parquet(f"{root}/held")
    q, numbers = None, [r[0] for r in held.select("_batch").distinct().sort("_batch").collect()]
    try:
        for k in numbers or [0]:
            part = held.where(F.col("_batch") == k).drop("_batch")
            (part.repartition(key) if key else part).write.parquet(f"{root}/in/{k}")
            if q is None:
                out = build(spark.readStream.schema(rows.schema).option("recursiveFileLookup", True).parquet(f"{root}/in"))
                q = out.writeStream.outputMode(mode).option("checkpointLocation", f"{root}/state").foreachBatch(keep).start()
            q.processAllAvailable()
    finally:
        if q is not None:
            q.stop()
    return out


def streamed(spark, rows, batch, build, mode="append", key=None):
    """The rows that a streaming query makes of batches."""
    path = S.scratch(spark)

    def keep(df, k):
        # a folder for each batch: one that runs again replaces its rows
        df.write.mode("overwrite").parquet(path if mode == "complete" else f"{path}/batch={k}")

    out = batches(spark, rows, batch, build, keep, mode, key)
    return spark.read.schema(out.schema).parquet(path).select(*out.columns)


def rocks(spark):
    """Keyed state of one's own needs this store."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


@query("K01_stream_masked_moments", f"WITH {EV} SELECT topic, count(*) AS n, round(avg(value), 6) AS mean, round(var_pop(value) * count(*), 2) AS m2, min(value) AS min, max(value) AS max FROM ev GROUP BY topic")
def _(spark, sf):
    m = messages(spark, sf).select("topic", F.col("value").alias("x"), "event_id")
    out = streamed(spark, m, F.pmod("event_id", F.lit(4)), lambda s: J.stream_masked_moments(s, ["topic"]), "complete")
    return out.select("topic", "n", F.round("mean", 6).alias("mean"), F.round("m2", 2).alias("m2"), "min", "max")


@query("K01b_resumed_moments", f"WITH {EV} SELECT topic, count(*) AS n, round(avg(value), 6) AS mean, round(var_pop(value) * count(*), 2) AS m2, min(value) AS min, max(value) AS max FROM ev GROUP BY topic")
def _(spark, sf):
    # half of the rows in one stream, whose state is saved; a new stream goes on from there with the other half
    rocks(spark)
    m = messages(spark, sf).select(F.col("topic").alias("key"), F.col("value").alias("x"), "event_id")
    none = spark.createDataFrame([], J.Moments.output)
    root = S.scratch(spark)
    batches(spark, m.where("event_id % 2 = 0"), F.pmod("event_id", F.lit(4)), lambda s: J.resumed_moments(s, none), lambda df, k: df.count(), root=root)
    saved = S.kept(J.saved_moments(spark.read.format("statestore").option("stateVarName", "moments").load(f"{root}/state")))
    out = streamed(spark, m.where("event_id % 2 = 1"), F.pmod("event_id", F.lit(4)), lambda s: J.resumed_moments(s, saved))
    last = out.unionByName(saved).groupBy("key").agg(F.max_by(F.struct("n", "mean", "m2", "min", "max"), "n").alias("r")).select("key", "r.*")
    return last.select(F.col("key").alias("topic"), "n", F.round("mean", 6).alias("mean"), F.round("m2", 2).alias("m2"), "min", "max")


@query("K05_stream_results", f"WITH {RO} SELECT task, model, count(*) FILTER (WHERE success IS NOT NULL) AS total, count(*) FILTER (WHERE success) AS successes FROM ro GROUP BY ALL")
def _(spark, sf):
    # each rollout is pending at first; its result comes in a file of a later hour
    rocks(spark)
    r = rollouts(spark, sf)
    hour = lambda h: F.timestamp_seconds(F.lit(1_700_000_000) + 3600 * h)
    first = r.withColumns({"stamp": hour(F.col("demo_id") % 2), "success": F.lit(None).cast("boolean"), "pending": F.lit(True)})
    final = r.withColumn("stamp", hour(2 + F.col("demo_id") % 2))
    both = first.unionByName(final)
    out = streamed(spark, both, F.floor((F.unix_timestamp("stamp") - 1_700_000_000) / 3600), lambda s: J.stream_results(s, "2 hours", 7_200_000))
    done = (F.col("event") == "final") & F.col("success").isNotNull()
    return out.groupBy("task", "model").agg(F.count_if(done).alias("total"), F.count_if(done & F.col("success")).alias("successes"))


@query("K06_run_state", f"""WITH {EV} SELECT episode AS run_id, arg_max(CASE topic WHEN 'error' THEN 'crashed' WHEN 'purchase' THEN 'completed' ELSE 'running' END, (s, event_id)) AS state, arg_max(event_id, (s, event_id)) AS last_update FROM ev GROUP BY 1""")
def _(spark, sf):
    # events as they come, not in their order: the last one by time wins
    state = F.when(F.col("topic") == "error", "crashed").when(F.col("topic") == "purchase", "completed").otherwise("running")
    rows = messages(spark, sf).select(F.col("episode").alias("run_id"), state.alias("state"), F.col("event_id").alias("last_update"), "s")
    table = M.MergedTable(spark, S.scratch(spark), rows.schema, ["run_id"], 8)
    batches(spark, rows, F.pmod(F.xxhash64("last_update"), F.lit(3)), lambda s: s, table.sink("events", M.newest(["run_id"], ["s", "last_update"])))
    return table.read().select("run_id", "state", "last_update")


@query("K07_upsert_evaluations", f"WITH {RN} SELECT run_id, CASE WHEN run_id % 4 = 0 THEN total_rollouts + 100 ELSE total_rollouts END AS total_rollouts FROM evals UNION ALL SELECT -1, 5")
def _(spark, sf):
    # evaluations, then those that are made again, and one of a new run
    old = evaluations(spark, sf).select("run_id", "total_rollouts", F.lit(0).alias("k"))
    again = old.where("run_id % 4 = 0").select("run_id", F.col("total_rollouts") + 100, F.lit(1))
    rows = old.union(again).union(spark.createDataFrame([(-1, 5, 1)], "run_id long, total_rollouts long, k int"))
    table = M.MergedTable(spark, S.scratch(spark), "run_id long, total_rollouts long", ["run_id"], 8)
    batches(spark, rows, F.col("k"), lambda s: s.drop("k"), table.sink("evaluations", lambda a, b: R.upsert(a, b, ["run_id"])))
    return table.read()


def npz(**arrays) -> bytes:
    out = io.BytesIO()
    np.savez(out, **arrays)
    return out.getvalue()


def frame_shards(spark, sf):
    """Frames as files in shards, an episode to a shard, every fiftieth of them damaged; as (path, content)."""
    root = S.scratch(spark)

    def pack(batches):
        for b in batches:
            raw = [npz(x=np.array([v]), name=np.array("n")) for v in b["x"]]
            raw = [r[:40] if o % 50 == 7 else r for r, o in zip(raw, b["ordinal"], strict=True)]
            yield pd.DataFrame({"shard": b["episode"], "key": [f"ep{e}_t{t:04d}" for e, t in zip(b["episode"], b["t"], strict=True)], "fields": [{"npz": r} for r in raw]})

    s = W.episode_timesteps(frames(spark, sf)).select(F.col("episode").cast("int").alias("episode"), "t", "x", "ordinal")
    TAR.write_tar_shards(s.mapInPandas(pack, "shard int, key string, fields map<string,binary>"), root)
    rows = TAR.read_tar_shards(spark, root, fields=("npz",)).where("reason IS NULL")
    return rows.select(F.concat("shard", F.lit("/"), "key", F.lit(".npz")).alias("path"), F.col("fields")["npz"].alias("content"))


@query("A10_scan_frame_files", f"WITH {EP} SELECT 'ep' || episode AS episode, t, 'x' AS field, round(x, 4) AS x FROM ep WHERE ordinal % 50 <> 7")
def _(spark, sf):
    good, _ = rejects.split(S.frame_rows(frame_shards(spark, sf)), "frames", F.col("path"))
    return good.select("episode", "t", "field", F.round(F.get("value", F.lit(0)), 4).alias("x"))


@query("A10b_frame_rejects", f"""WITH {EP} SELECT 'frames' AS stage, printf('shard_%06d.tar/ep%d_t%04d.npz', episode, episode, t) AS "row", true AS told FROM ep WHERE ordinal % 50 = 7""")
def _(spark, sf):
    _, bad = rejects.split(S.frame_rows(frame_shards(spark, sf)), "frames", F.col("path"))
    return bad.select("stage", "row", (F.length("reason") > 0).alias("told"))


@query("A11_scan_processed_episodes", f"WITH {EP} SELECT 'ep' || episode AS episode, t, 'obs/x' AS field, round(x, 4) AS x FROM ep")
def _(spark, sf):
    # an episode is a file of arrays over time, all of them members of shards
    def pack(frame):
        x = frame.sort_values("t")["x"].to_numpy()
        e = int(frame["episode"].iloc[0])
        return pd.DataFrame({"shard": [e // 16], "key": [f"ep{e}/obs"], "fields": [{"npz": npz(x=x, depth=x)}]})

    root = S.scratch(spark)
    s = W.episode_timesteps(frames(spark, sf)).select("episode", "t", "x")
    TAR.write_tar_shards(s.groupBy("episode").applyInPandas(pack, "shard int, key string, fields map<string,binary>"), root)
    rows = TAR.read_tar_shards(spark, root, fields=("npz",)).where("reason IS NULL")
    files = rows.select(F.concat("shard", F.lit("/"), "key", F.lit(".npz")).alias("path"), F.col("fields")["npz"].alias("content"))
    good, _ = rejects.split(S.episode_rows(files, ("depth",)), "episodes", F.col("path"))
    return good.select("episode", "t", "field", F.round(F.get("value", F.lit(0)), 4).alias("x"))


@query("A04b_convert_episodes", f"""WITH {EP}, ok AS (SELECT * FROM ep WHERE t >= 0 AND t + 14 - n + 1 <= 7)
SELECT printf('shard_%06d', s.shard) AS shard, count(ok.t) AS num_sequences FROM (SELECT DISTINCT episode // 4 AS shard FROM ep) s LEFT JOIN ok ON ok.episode // 4 = s.shard GROUP BY 1""")
def _(spark, sf):
    # cut off after one slice, and begun again
    root, f = S.scratch(spark), frames(spark, sf)
    many = f.select((F.max("episode") / 4).alias("k")).first()["k"]
    C.convert(f, root, 1, 14, 1, 7, per_shard=4, slice_=int(many) // 2 + 1, most_slices=1)
    C.convert(f, root, 1, 14, 1, 7, per_shard=4)
    return C.shards_there(spark, root)


def step_batch(t):
    """The batch of a step, growing with it: 25 steps a batch up to 100, then batches that double in width, then of
    WIDEST steps each; so no batch holds more than WIDEST steps of a key, and their number stays low."""
    early, doubling = F.floor(t / 25), 3 + F.length(F.bin(F.floor(t / 100)))
    return F.when(t < 100, early).when(t < WIDEST, doubling).otherwise(3 + DOUBLINGS + F.floor(t / WIDEST))


def keyed(spark, sf, processor):
    """Run a stateful processor over the episodes' steps, in batches of steps."""
    rocks(spark)
    s = W.episode_timesteps(frames(spark, sf)).select(F.col("episode").cast("string").alias("key"), F.col("t").cast("long").alias("t"), "x")
    return streamed(spark, s, step_batch(F.col("t")), lambda r: J.stateful(r, "key", processor), key="key")


@query("K02_stream_history_window", f"""WITH {EP}, s AS (SELECT e.episode, e.t, j, greatest(e.t - 3 + j, 0) AS i FROM ep e, (SELECT unnest(range(0, 4)) AS j))
SELECT CAST(s.episode AS VARCHAR) AS key, CAST(s.t AS BIGINT) AS t, list(e.x ORDER BY j) AS h, CAST(least(s.t + 1, 4) AS INTEGER) AS filled FROM s JOIN ep e ON e.episode = s.episode AND e.t = s.i GROUP BY ALL""")
def _(spark, sf):
    return keyed(spark, sf, J.HistoryWindow(3))


@query("K03_stream_hysteresis", f"""WITH {EP}, e AS (SELECT episode, t, x, CASE WHEN x > 60 THEN true WHEN x < 20 THEN false WHEN t = 0 THEN x >= 40 END AS e FROM ep)
SELECT CAST(episode AS VARCHAR) AS key, CAST(t AS BIGINT) AS t, last_value(e IGNORE NULLS) OVER (PARTITION BY episode ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS is_open FROM e""")
def _(spark, sf):
    return keyed(spark, sf, J.Hysteresis(20.0, 60.0))


@query("K08_stream_every_nth", f"WITH {EP} SELECT CAST(episode AS VARCHAR) AS key, CAST(t AS BIGINT) AS t, CAST(t + 1 AS BIGINT) AS k FROM ep WHERE t = 0 OR (t + 1) % 4 = 0")
def _(spark, sf):
    return keyed(spark, sf, J.EveryNth(4))


@query("K04_stream_action_buffer", f"""WITH {EP} SELECT CAST(episode AS VARCHAR) AS key, CAST(t AS BIGINT) AS t, CAST(t // 10 * 10 + least(t % 10 - 1, 4) AS DOUBLE) AS action, t % 10 <= 5 AS valid,
CAST(greatest(5 - t % 10, 0) AS INTEGER) AS remaining FROM ep WHERE t % 10 <> 0""")
def _(spark, sf):
    # every tenth step brings a plan of five steps, the others take one each
    rocks(spark)
    s = W.episode_timesteps(frames(spark, sf))
    plan = F.when(F.col("t") % 10 == 0, F.transform(F.sequence(F.lit(0), F.lit(4)), lambda i: (F.col("t") + i).cast("double")))
    s = s.select(F.col("episode").cast("string").alias("key"), F.col("t").cast("long").alias("t"), plan.alias("plan"))
    return streamed(spark, s, step_batch(F.col("t")), lambda r: J.stateful(r, "key", J.ActionBuffer()), key="key")
