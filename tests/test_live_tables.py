"""Streams that merge into a table, and streams whose state ends."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from roboframe.operators import results
from roboframe.streaming import jobs, merge

ROWS = "k long, s long, v string"


def table(spark, path):
    return merge.MergedTable(spark, str(path), ROWS, ["k"], buckets=4)


@pytest.fixture
def parts():
    rng = random.Random(7)
    return [[(rng.randrange(40), rng.randrange(1000), f"{b}.{i}") for i in range(30)] for b in range(5)]


def last(parts):
    out = {}
    for k, s, v in (r for p in parts for r in p):
        out[k] = max(out.get(k, (s, v)), (s, v))
    return out


def content(t):
    rows = t.read().collect()
    assert len(rows) == len({r.k for r in rows})
    return {r.k: (r.s, r.v) for r in rows}


def test_batches_take_effect_once(spark, tmp_path, parts):
    t = table(spark, tmp_path / "t")
    assert content(t) == {} and t.vacuum() == 0
    into = t.sink("a", merge.newest(["k"], ["s"]))
    for n, p in enumerate(parts):
        into(spark.createDataFrame(p, ROWS), n)
        into(spark.createDataFrame(parts[0], ROWS).withColumn("s", F.col("s") + 5000), n)  # the number has been
    assert content(t) == last(parts) and t.version().number == 5
    assert t.merge(spark.createDataFrame([(99, 1, "x")], ROWS), 0, "b", merge.newest(["k"], ["s"]))
    assert content(t) == last(parts) | {99: (1, "x")}
    before = content(t)
    assert t.vacuum() > 0 and content(t) == before and t.version().ledger == {"a": 4, "b": 0}


def test_a_batch_that_breaks_off(spark, tmp_path, parts, monkeypatch):
    """The merge is done, its version isn't written: readers see the old one, the batch comes again."""
    t = table(spark, tmp_path / "t")
    how = merge.newest(["k"], ["s"])
    t.merge(spark.createDataFrame(parts[0], ROWS), 0, "a", how)
    with monkeypatch.context() as m:
        m.setattr(merge.MergedTable, "_commit", lambda *a: (_ for _ in ()).throw(OSError("lost")))
        with pytest.raises(OSError, match="lost"):
            t.merge(spark.createDataFrame(parts[1], ROWS), 1, "a", how)
    assert content(t) == last(parts[:1])
    assert t.merge(spark.createDataFrame(parts[1], ROWS), 1, "a", how)
    assert content(t) == last(parts[:2]) and t.vacuum() >= 1 and content(t) == last(parts[:2])
    stale = t.version()
    t.merge(spark.createDataFrame(parts[2], ROWS), 2, "a", how)
    with monkeypatch.context() as m, pytest.raises(RuntimeError, match="another writer"):
        m.setattr(merge.MergedTable, "version", lambda self: stale)
        t.merge(spark.createDataFrame(parts[3], ROWS), 3, "a", how)
    assert content(t) == last(parts[:3])


def test_a_stream_that_is_begun_again(spark, tmp_path, parts):
    """The query ends in the middle, after a merge that its checkpoint doesn't know of; the next run gives the batch result."""
    t = table(spark, tmp_path / "t")
    into = t.sink("s", merge.newest(["k"], ["s"]))
    for n, p in enumerate(parts):
        spark.createDataFrame(p, ROWS).coalesce(1).write.parquet(f"{tmp_path}/in/{n}")

    def run(keep):
        rows = spark.readStream.schema(ROWS).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(f"{tmp_path}/in")
        q = rows.writeStream.option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).foreachBatch(keep).start()
        q.awaitTermination()

    def broken(df, n):
        into(df, n)
        if n == 2:
            raise OSError("the driver is lost")

    with pytest.raises(Exception, match="driver is lost"):
        run(broken)
    assert t.version().ledger == {"s": 2}
    run(into)
    assert t.version().ledger == {"s": 4} and content(t) == last(parts)


def test_groups_that_are_replaced(spark, tmp_path):
    """A merge that deletes: an evaluation brings its own samples, an empty bucket goes."""
    t = merge.MergedTable(spark, str(tmp_path / "t"), "run long, i long", ["run"], buckets=4)
    how = lambda a, b: results.replace_groups(a, b.where("i >= 0"), ["run"]).join(b.where("i < 0").select("run"), "run", "left_anti")
    t.merge(spark.createDataFrame([(r, i) for r in range(8) for i in range(3)], "run long, i long"), 0, "a", how)
    t.merge(spark.createDataFrame([(1, 7), *((r, -1) for r in range(2, 8))], "run long, i long"), 1, "a", how)
    assert sorted(map(tuple, t.read().collect())) == [(0, 0), (0, 1), (0, 2), (1, 7)]


ROLLOUT = "task string, model string, demo_id long, success boolean, pending boolean, duration double, stamp timestamp"


def test_state_of_final_rollouts_goes(spark, tmp_path):
    at = lambda h: datetime(2025, 1, 1) + timedelta(hours=h)
    files = [
        [("t", "m", i, None, True, None, at(0)) for i in range(6)],
        [("t", "m", i, i % 2 == 0, False, 1.5, at(1)) for i in range(4)] + [("t", "m", 0, False, False, 9.0, at(1.5))],
        [("t", "m", 4, True, False, 2.0, at(4))],
        [("t", "m", 8, None, True, None, at(9))],
        [("t", "m", 1, True, False, 3.0, at(1.2)), ("t", "m", 8, None, True, None, at(9.5))],  # the first is late by hours
        [("t", "m", 9, True, False, 3.0, at(9.6))],
    ]
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    for k, rows in enumerate(files):
        spark.createDataFrame(rows, ROLLOUT).coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
        source = spark.readStream.schema(ROLLOUT).option("recursiveFileLookup", True).parquet(f"{tmp_path}/in")
        out = jobs.stream_results(source, "30 minutes", 2 * 3_600_000)
        q = out.writeStream.outputMode("append").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True)
        q.foreachBatch(lambda df, n, k=k: df.write.mode("overwrite").parquet(f"{tmp_path}/out/b={k}_{n}")).start().awaitTermination()
    rows = spark.read.schema(out.schema).parquet(f"{tmp_path}/out").collect()
    told = sorted((r.demo_id, r.event, r.success) for r in rows)
    want = [(i, "open", None) for i in (*range(6), 8, 9)] + [(i, "final", i % 2 == 0) for i in range(4)] + [(4, "final", True), (5, "lost", None), (9, "final", True)]
    assert told == sorted(want, key=lambda r: (r[0], r[1]))
    left = spark.read.format("statestore").option("stateVarName", "rollout").load(f"{tmp_path}/state")
    assert {r[0] for r in left.select("key.demo_id").collect()} == {8, 9}
