"""Scans of hot keys by blocks: the same rows as one window over the key, over many tasks."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from roboframe.operators import alignment, scans, windows


@pytest.fixture(scope="module")
def hot_rows(spark):
    """Half of all rows are one key's, a quarter those of the null key; times repeat, values are rare."""
    rng = random.Random(4)
    keys = ["hot"] * 3000 + [None] * 1500 + [f"k{i % 40}" for i in range(1500)]
    rows = [(k, rng.choice([None, 1e9]) if rng.random() < 0.01 else rng.expovariate(1) * 100 // 1, i, rng.random() if rng.random() < 0.01 else None) for i, k in enumerate(keys)]
    return spark.createDataFrame(rows, "k string, s double, o int, v double").repartition(6).cache()


@pytest.mark.parametrize("least", [None, 1000, 20])
@pytest.mark.parametrize("backward", [False, True])
@pytest.mark.parametrize("inclusive", [False, True])
def test_carried_equals_one_window(spark, hot_rows, least, backward, inclusive):
    c = scans.cut(hot_rows, ["k"], "s", least, blocks=16)
    assert c.hot == (least is not None)
    got = scans.done(scans.carried(c, ["s", "o"], "v", "last", inclusive, backward))
    way = F.desc if backward else F.asc
    w = Window.partitionBy("k").orderBy(way("s"), way("o")).rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    want = hot_rows.withColumn("last", F.last("v", ignorenulls=True).over(w))
    assert got.columns == want.columns and sorted(got.collect(), key=str) == sorted(want.collect(), key=str)


@pytest.mark.parametrize("least", [None, 1000, 20])
def test_numbered_equals_one_window(spark, hot_rows, least):
    got = scans.done(scans.numbered(scans.cut(hot_rows, ["k"], "s", least, blocks=16), ["s", "o"], "n"))
    want = hot_rows.withColumn("n", F.row_number().over(Window.partitionBy("k").orderBy("s", "o")))
    assert sorted(got.collect(), key=str) == sorted(want.collect(), key=str)


def test_a_hot_key_is_dealt_over_blocks(spark, hot_rows):
    c = scans.cut(hot_rows, ["k"], "s", 1000, blocks=16)
    sizes = {(r["k"], r["_block"]): r["count"] for r in c.rows.groupBy("k", "_block").count().collect()}
    assert max(n for (k, _), n in sizes.items() if k == "hot") < 3000 / 8
    assert all(b == 0 for k, b in sizes if k not in ("hot", None))
    assert c.rows.where("_hot").select("k").distinct().count() == 2
    empty = scans.cut(hot_rows.limit(0), ["k"], "s", 1000)
    assert not empty.hot and scans.done(scans.carried(empty, ["s"], "v", "x")).count() == 0


@pytest.mark.parametrize("hot", [None, 100])
def test_asof_join_of_a_hot_channel(spark, hot):
    """Half of all messages are of one recording; the sources are rarer than the blocks of time."""
    rng = random.Random(9)
    channel = lambda n: [("a" if rng.random() < 0.7 else rng.choice("bcd"), float(rng.randrange(5000)), i) for i in range(n)]
    sources = channel(60) + [(k, 1.0, 900 + i) for i, k in enumerate("abcd")]
    targets = channel(2000)
    want = set()
    for k, t, i in targets:
        j = min((abs(s - t), s, o) for c, s, o in sources if c == k)
        # equal gaps take the earlier time; of one time the first ordinal after, the last before or at the target
        same = [o for c, s, o in sources if c == k and s == j[1]]
        want.add((k, t, i, j[1], max(same) if j[1] <= t and j[1] != t or j[1] < t else min(same)))
    schema = "k string, s double, o int"
    tgt, src = spark.createDataFrame(targets, schema).withColumnRenamed("o", "i"), spark.createDataFrame(sources, schema)
    got = alignment.nearest_asof_join(tgt, src.withColumn("p", F.col("o")), ["k"], "s", ["p"], ordinal="o", hot=hot).collect()
    plain = alignment.nearest_asof_join(tgt, src.withColumn("p", F.col("o")), ["k"], "s", ["p"], ordinal="o", hot=None).collect()
    assert sorted(got) == sorted(plain)
    assert {tuple(r)[:4] for r in got} == {x[:4] for x in want}
    with pytest.raises(Exception, match="no source rows"):
        alignment.nearest_asof_join(tgt, src.where("k <> 'a'").withColumn("p", F.col("o")), ["k"], "s", ["p"], hot=hot).collect()


def test_hysteresis_of_a_hot_episode(spark):
    rng = random.Random(3)
    frames = [("long", float(i), i, rng.choice([10.0, 30.0, 45.0, 70.0]) if i % 50 == 0 else 40.0) for i in range(3000)]
    frames += [(f"e{i % 30}", float(i), i, rng.choice([10.0, 39.0, 41.0, 70.0])) for i in range(600)] + [(None, 1.0, 1, 50.0)]
    rows = spark.createDataFrame(frames, "episode string, ts double, ordinal int, x double").repartition(5)
    steps, by_blocks = windows.episode_timesteps(rows), windows.episode_timesteps(rows, hot=200)
    assert sorted(steps.collect(), key=str) == sorted(by_blocks.collect(), key=str)
    state, want = {}, set()
    for e, t, _, x in sorted(frames, key=lambda f: f[1]):
        state[e] = True if x > 60 else False if x < 20 else state.get(e, x >= 40)
        want.add((e, t, state[e]))
    for hot in (None, 200):
        got = windows.hysteresis_state(by_blocks, 20.0, 60.0, hot=hot)
        assert {(r["episode"], r["ts"], r["is_open"]) for r in got.collect()} == want


@pytest.mark.parametrize("past,future,block", [(1, 2, 4), (3, 0, 1), (0, 5, 2), (2, 2, 1000)])
def test_windows_by_blocks_equal_one_window(spark, past, future, block):
    rng = random.Random(6)
    data = {k: [rng.choice([None, float(i)]) for i in range(n)] for k, n in (("long", 57), ("b", 8), ("c", 1), (None, 9))}
    rows = [(k, t, len(v), x) for k, v in data.items() for t, x in enumerate(v)]
    steps = spark.createDataFrame(rows, "episode string, t int, n int, x double").repartition(5)
    got = windows.window_values(steps, past, future, block=block)
    want = {(k, t): v[max(t - past, 0) : t + future + 1] for k, v in data.items() for t in range(len(v))}
    assert got.columns == [*steps.columns, "w"] and got.count() == len(rows)
    assert {(r.episode, r.t): r.w for r in got.collect()} == want


def test_calibration_windows_span_a_whole_label(spark, tmp_path, monkeypatch):
    """Vectors 511 and 512 of a label are neighbours; null labels are in no window; null components add nothing."""
    from roboframe import registry

    monkeypatch.setattr(scans, "HOT", 600)
    rows = [(i, 1 if i < 1500 else 2 if i < 1600 else None, None if i == 3 else [None if i == 7 else float(i), 0.5] * 8) for i in range(1700)]
    spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>").repartition(3).write.parquet(f"{tmp_path}/embeddings.parquet")
    got = {(r.label, r.t): (r.windowed, r.static) for r in registry.queries()["E16_window_calibration"](spark, str(tmp_path)).collect()}
    assert len(got) == 1600
    total = lambda i: None if i == 3 else 2.0 if i == 7 else 5.0 * i + 2.0
    first = lambda i: None if i in (3, 7) else float(i)
    for label, start, n in ((1, 0, 1500), (2, 1500, 100)):
        for t in range(n):
            window = [total(start + min(max(t - 1 + j, 0), n - 1)) for j in range(4)]
            assert got[label, t] == (window, [first(start + t)] * 4)
