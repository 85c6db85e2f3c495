"""Ranking, paging, pivots and numbering of hot keys; named files as a sink."""

import os
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from roboframe.functions import names
from roboframe.operators import results, windows
from roboframe.sources import filesets


@pytest.fixture(scope="module")
def rollouts(spark):
    rng = random.Random(2)
    rows = [("hot", rng.choice("ab"), i, rng.choice([True, False, None])) for i in range(2000)]
    rows += [(f"t{i % 7}", rng.choice("abcde"), i, rng.random() < 0.5) for i in range(2000, 2300)]
    return spark.createDataFrame(rows, "task string, model string, demo_id long, success boolean").repartition(4).cache()


def test_numbering_of_hot_keys(rollouts):
    for f in (results.paired, lambda r, hot: results.index_ranges(r.where("demo_id % 5 <> 2"), "task", "demo_id", hot)):
        want = Counter(map(tuple, f(rollouts, None).collect()))
        assert want and Counter(map(tuple, f(rollouts, 100).collect())) == want
    common = rollouts.where("model IN ('a', 'b')")
    want = Counter(map(tuple, results.balanced_success(common, None)[0].collect()))
    assert len(want) > 20 and Counter(map(tuple, results.balanced_success(common, 100)[0].collect())) == want


def test_pivot_takes_the_models_that_there_are(spark):
    rows = [(f"t{i % 3}", f"m{i}", 10.0 * i) for i in range(6)] + [("t0", "odd name", None), ("t1", None, 3.0)]
    s = spark.createDataFrame(rows, "task string, model string, pct double")
    out = results.pivot_rates(s).orderBy("task").collect()
    assert out[0].asDict() == {"task": "t0", "m0": 0.0, "m1": 0.0, "m2": 0.0, "m3": 30.0, "m4": 0.0, "m5": 0.0, "odd name": 0.0}
    with pytest.raises(ValueError, match="more than 6 models"):
        results.pivot_rates(s, most=6)


def test_order_of_tasks_and_pages(spark):
    s = spark.createDataFrame([("a", 10.0), ("a", 30.0), ("b", 20.0), ("c", 90.0), ("d", None)], "task string, pct double")
    assert [tuple(r) for r in results.task_order(s).orderBy("place").collect()] == [("c", 90.0, 1), ("a", 20.0, 2), ("b", 20.0, 3)]
    rows = spark.range(20)
    for page, want in ((0, range(9)), (1, range(9, 18)), (2, range(18, 20)), (99, range(18, 20)), (-4, range(9))):
        assert [r[0] for r in results.page_of(rows, ["id"], page).collect()] == list(want)
    assert results.page_of(rows.limit(0), ["id"], 5).count() == 0 and results.page_of(spark.range(9), ["id"], 1).count() == 9


@pytest.mark.parametrize("parts", ["1", "7"])
def test_sums_over_ranges(spark, parts):
    from roboframe.operators import shards

    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        rng = random.Random(int(parts))
        rows = [(f"f{i:04d}", rng.randrange(100)) for i in range(300)]
        want, total = [], 0
        for f, n in rows:
            want.append((f, n, n // 8, total))
            total += n // 8
        plan = shards.full_shard_plan(spark.createDataFrame(rows, "file string, n_rows long").repartition(3), 8)
        assert sorted(map(tuple, plan.collect())) == want
        assert shards.full_shard_plan(spark.createDataFrame([], "file string, n_rows long"), 8).count() == 0
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_counterparts_and_axes(spark):
    fields = [(1, 0, "robot__desired__poses__xyz", 1.0), (1, 0, "robot__actual__poses__xyz", 2.0), (1, 0, "x", 3.0), (2, 0, "robot__desired__poses__xyz", 4.0)]
    f = spark.createDataFrame(fields, "episode int, t int, field string, x double")
    got = {(r.episode, r.field): r.reference for r in windows.reference_rows(f, f).collect()}
    assert got == {(1, fields[0][2]): 2.0, (1, fields[1][2]): 2.0, (1, "x"): None, (2, fields[0][2]): None}
    n = spark.createDataFrame([("robot__a__poses__left::r1__xyz",), ("a__poses__right::r1__xyz",), ("clock",)], "name string")
    got = {(r.axis, r.value): r.n for r in names.axis_values(n.select(names.parse_tensor_name(F.col("name")).alias("p")), "p").collect()}
    assert got == {("group", "a"): 2, ("category", "poses"): 2, ("category", "clock"): 1, ("limb", "left"): 1, ("limb", "right"): 1, ("robot", "r1"): 2, ("repr", "xyz"): 2}


def tree(path):
    return sorted(os.path.relpath(os.path.join(d, f), path) for d, _, found in os.walk(path) for f in found)


def test_named_files(spark, tmp_path):
    rows = spark.createDataFrame([(f"a/{i}/x.txt", f"{i}") for i in range(7)] + [("top", None)], "path string, content string").repartition(3)
    filesets.write_files(rows, f"{tmp_path}/out")
    assert tree(f"{tmp_path}/out") == sorted([*(f"a/{i}/x.txt" for i in range(7)), "top"])
    assert open(f"{tmp_path}/out/a/5/x.txt").read() == "5"
    for odd, why in (("top", "is there"), ("b/3", "come twice"), ("../up", "below the folder"), ("/root", "below the folder"), (None, "below the folder")):
        more = spark.createDataFrame([(f"b/{i}", "x") for i in range(9)] + [(odd, "x")], "path string, content string").repartition(4)
        with pytest.raises(Exception, match=why):
            filesets.write_files(more, f"{tmp_path}/out")
        assert len(tree(f"{tmp_path}/out")) == 8 and not os.path.exists(f"{tmp_path}/up")
