"""File sources on self-written files, and streaming twins against their batch operators."""

import io
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from roboframe.operators import windows
from roboframe.sources import files
from roboframe.streaming import jobs


def test_manifest(spark, tmp_path):
    m = spark.createDataFrame([("00000000", 5), ("00000001", 7)], files.MANIFEST)
    files.write_manifest(m, f"{tmp_path}/m")
    assert sorted(map(tuple, files.read_manifest(spark, f"{tmp_path}/m").collect())) == [("00000000", 5), ("00000001", 7)]
    with pytest.raises(Exception):
        files.write_manifest(m, f"{tmp_path}/m")


def npz(**arrays):
    out = io.BytesIO()
    np.savez(out, **arrays)
    return out.getvalue()


def test_episode_files(spark, tmp_path):
    for t in range(3):
        (tmp_path / f"ep1_t{t:04d}.npz").write_bytes(npz(pos=np.array([t, 1.5]), name=np.array("x")))
    got = sorted((r.t, r.field, r.value) for r in files.scan_frame_files(spark, f"{tmp_path}/*.npz").collect())
    assert got == [(t, "pos", [float(t), 1.5]) for t in range(3)]
    bad = spark.createDataFrame([("x/other.npz", npz(a=np.zeros(1)))], "path string, content binary")
    with pytest.raises(Exception, match="not a frame file"):
        files.frame_files(bad).collect()
    one = spark.createDataFrame([("r/ep7/obs.npz", npz(q=np.arange(4).reshape(2, 2), skip=np.zeros(2)))], "path string, content binary")
    assert sorted((r.episode, r.t, r.field, r.value) for r in files.processed_episodes(one, ("skip",)).collect()) == [("ep7", 0, "obs/q", [0.0, 1.0]), ("ep7", 1, "obs/q", [2.0, 3.0])]


def test_result_and_frame_json(spark, tmp_path):
    folder = tmp_path / "m1" / "TaskA" / "rollouts" / "2025"
    folder.mkdir(parents=True)
    evaluations = [{"skill_type": "s", "scenario_index": 0, "is_success": True, "total_time": 1.5}, {"scenario_index": 1, "is_pending": True}]
    (folder / "results.json").write_text(json.dumps({"max_sample_size_per_model": 5, "evaluations": evaluations}))
    got = sorted((r.model, r.task, r.demo_id, r.success, r.pending) for r in files.scan_results(spark, str(tmp_path)).collect())
    assert got == [("m1", "TaskA", 0, True, False), ("m1", "TaskA", 1, None, True)]
    frames = tmp_path / "clean" / "episode_0"
    frames.mkdir(parents=True)
    (frames / "data.json").write_text(json.dumps([{"time": 0.0, "states": {"arm_state": [1.0]}}, {"time": 0.1, "robot_type": "g1"}]))
    got = sorted((r.task, r.episode, r.time, r.robot_type) for r in files.scan_frame_json(spark, f"{tmp_path}/clean/*/data.json").collect())
    assert got == [("clean", "episode_0", 0.0, "h1"), ("clean", "episode_0", 0.1, "g1")]


def test_csv_and_summaries(spark, tmp_path):
    (tmp_path / "runs.csv").write_text("name,tags\nr1,first\nr1,second\nr2,x\n")
    got = sorted(map(tuple, files.scan_run_csv(spark, f"{tmp_path}/runs.csv", "name string, tags string", "name").collect()))
    assert got == [("r1", "first"), ("r2", "x")]
    s = spark.createDataFrame([("a", "success: true\n"), ("b", "seed: 1\n"), ("c", "garbage")], "path string, value string")
    assert sorted(map(tuple, files.summaries(s).collect())) == [("a", True), ("b", False)]


def run_stream(spark, rows, schema, tmp_path, build):
    for k, part in enumerate(rows):
        spark.createDataFrame(part, schema).coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(f"{tmp_path}/in")
    out = build(source)
    q = out.writeStream.outputMode("append").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True)
    q = q.foreachBatch(lambda df, _: df.write.mode("append").parquet(f"{tmp_path}/out")).start()
    q.awaitTermination()
    return spark.read.schema(out.schema).parquet(f"{tmp_path}/out")


KEYED = "key string, t long, x double"


@pytest.fixture
def keyed():
    rng = np.random.default_rng(4)
    return [[(k, b * 10 + t, float(rng.integers(0, 100))) for k in ("a", "b") for t in range(5)] for b in range(3)]


def batch(spark, keyed):
    f = spark.createDataFrame([r for part in keyed for r in part], KEYED)
    return windows.episode_timesteps(f.withColumnRenamed("t", "ts"), "key", ("ts",))


def test_history_stream(spark, tmp_path, keyed):
    got = run_stream(spark, keyed, KEYED, tmp_path, lambda s: jobs.stateful(s, "key", jobs.HistoryWindow(3)))
    want = windows.history_buffer(batch(spark, keyed), 3, episode="key").select("key", F.col("ts").alias("t"), "h")
    assert sorted(map(tuple, got.select("key", "t", "h").collect())) == sorted(map(tuple, want.collect()))


def test_hysteresis_stream(spark, tmp_path, keyed):
    got = run_stream(spark, keyed, KEYED, tmp_path, lambda s: jobs.stateful(s, "key", jobs.Hysteresis(20, 60)))
    want = windows.hysteresis_state(batch(spark, keyed), 20.0, 60.0, episode="key").select("key", F.col("ts").alias("t"), "is_open")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_every_nth_stream(spark, tmp_path, keyed):
    got = run_stream(spark, keyed, KEYED, tmp_path, lambda s: jobs.stateful(s, "key", jobs.EveryNth(4)))
    want = windows.every_nth(batch(spark, keyed), ["key"], ["ts"], 4).select("key", F.col("ts").alias("t"))
    assert sorted(map(tuple, got.select("key", "t").collect())) == sorted(map(tuple, want.collect()))


def test_action_buffer_stream(spark, tmp_path):
    parts = [[("a", 0, [1.0, 2.0]), ("a", 1, None), ("a", 2, None)], [("a", 3, None), ("a", 4, [9.0]), ("a", 5, None)]]
    got = run_stream(spark, parts, "key string, t long, plan array<double>", tmp_path, lambda s: jobs.stateful(s, "key", jobs.ActionBuffer()))
    assert sorted(map(tuple, got.collect())) == [("a", 1, 1.0, True, 1), ("a", 2, 2.0, True, 0), ("a", 3, 2.0, False, 0), ("a", 5, 9.0, True, 0)]


def test_streams_of_long_episodes(spark, tmp_path):
    """Steps past 100 come after those before them, whatever the length of the episode."""
    from datetime import datetime, timedelta

    from roboframe import registry

    rng = np.random.default_rng(5)
    x = {u: [float(v) for v in rng.integers(0, 100, n)] for u, n in ((1, 430), (2, 101), (3, 7))}
    start = datetime(2024, 1, 1)
    rows = [(u * 1000 + t, start + timedelta(seconds=t), u, "a", v, "{}") for u in x for t, v in enumerate(x[u])]
    schema = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"
    spark.createDataFrame(rows, schema).repartition(5).write.parquet(f"{tmp_path}/events.parquet")

    def got(name):
        return sorted(map(tuple, registry.queries()[name](spark, str(tmp_path)).collect()))

    steps = [(str(u), t) for u in x for t in range(len(x[u]))]
    windows_ = [(k, t, [x[int(k)][max(t - 3 + j, 0)] for j in range(4)], min(t + 1, 4)) for k, t in steps]
    assert got("K02_stream_history_window") == sorted(windows_)
    assert got("K08_stream_every_nth") == sorted((k, t, t + 1) for k, t in steps if t == 0 or (t + 1) % 4 == 0)
    assert got("K04_stream_action_buffer") == sorted((k, t, float(t // 10 * 10 + min(t % 10 - 1, 4)), t % 10 <= 5, max(5 - t % 10, 0)) for k, t in steps if t % 10)
    is_open = []
    for u in x:
        now = x[u][0] >= 40
        for t, v in enumerate(x[u]):
            now = True if v > 60 else False if v < 20 else now
            is_open.append((str(u), t, now))
    assert got("K03_stream_hysteresis") == sorted(is_open)
    assert [tuple(r)[:2] for r in registry.queries()["K01_stream_masked_moments"](spark, str(tmp_path)).collect()] == [("a", len(steps))]


def test_step_batches_grow(spark):
    from roboframe.plans import files as plans

    edges = [0, 24, 25, 99, 100, 199, 200, plans.WIDEST - 1, plans.WIDEST, 2 * plans.WIDEST - 1, 2 * plans.WIDEST, 10**9]
    rows = spark.createDataFrame([(t,) for t in edges], "t long").select("t", plans.step_batch(F.col("t")).cast("long").alias("b"))
    got = [r.b for r in sorted(rows.collect())]
    assert got == [0, 0, 1, 3, 4, 4, 5, 13, 14, 14, 15, 13 + 10**9 // plans.WIDEST]


def test_sinks_refuse_folders_with_output(spark, tmp_path):
    from roboframe.sources import files as S

    rows = spark.createDataFrame([("b", 2), ("a", 1)], "k string, n long")
    path = f"file://{tmp_path}/out"
    S.assert_empty_output(spark, path)
    S.export_csv(rows, path)
    assert [tuple(r) for r in spark.read.option("header", True).csv(path).collect()] == [("b", "2"), ("a", "1")]
    with pytest.raises(FileExistsError):
        S.export_csv(rows, path)


def test_first_row_of_a_run_csv(spark, tmp_path):
    from roboframe.sources import files as S

    (tmp_path / "a.csv").write_text("name,x\nr1,1\nr2,2\nr1,3\n")
    (tmp_path / "b.csv").write_text("name,x\n" + "r2,9\n" * 2000 + "r3,4\n")
    got = S.scan_run_csv(spark, str(tmp_path), "name STRING, x INT", "name")
    assert {r.name: r.x for r in got.collect()} == {"r1": 1, "r2": 2, "r3": 4}
