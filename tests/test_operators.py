"""Rules that the test tables don't reach: errors, edges and golden numbers of the operators."""

import uuid

import pytest
from pyspark.sql import functions as F

from roboframe.functions import geometry, names, vectors
from roboframe.operators import alignment, results, shards, statistics, windows


def rows(spark, data, schema):
    return spark.createDataFrame(data, schema)


def test_asof_edges(spark):
    src = rows(spark, [("a", 1.0, 0, 10), ("a", 3.0, 1, 30), ("a", 3.0, 2, 31), ("a", 9.0, 3, 90)], "k string, s double, o long, v int")
    tgt = rows(spark, [("a", x, i) for i, x in enumerate([0.0, 1.0, 2.0, 2.1, 3.0, 6.0, 6.1, 99.0])], "k string, s double, i long")
    got = alignment.nearest_asof_join(tgt, src, ["k"], "s", ["v"], ordinal="o").orderBy("i").collect()
    assert [r.v for r in got] == [10, 10, 10, 30, 30, 31, 90, 90]
    with pytest.raises(Exception, match="gap is above"):
        alignment.nearest_asof_join(tgt, src, ["k"], "s", ["v"], tolerance=1.0, ordinal="o").collect()
    with pytest.raises(Exception, match="no source rows"):
        alignment.nearest_asof_join(tgt, src.where("k = 'z'"), ["k"], "s", ["v"], ordinal="o").collect()


def test_reflect_of_short_windows(spark):
    got = spark.range(1).select(windows.pad_window(F.array(F.lit(1.0), F.lit(2.0)), F.lit(3), F.lit(3), "reflect").alias("w")).first().w
    assert got == [2.0, 1.0, 2.0, 1.0, 2.0, 1.0, 2.0, 1.0]
    one = spark.range(1).select(windows.pad_window(F.array(F.lit(7.0)), F.lit(2), F.lit(1), "reflect").alias("w")).first().w
    assert one == [7.0] * 4
    with pytest.raises(ValueError):
        windows.pad_window(F.array(F.lit(1.0)), F.lit(1), F.lit(1), "other")


def test_crop_outside_raises(spark):
    with pytest.raises(Exception, match="crop outside"):
        spark.range(1).select(windows.crop_window(F.array(F.lit(1.0)), F.lit(0), 1, 0)).collect()


def test_still_window_of_one_row_goes(spark):
    f = rows(spark, [(1, 0, 1, 5.0), (2, 0, 2, 5.0), (2, 1, 2, 9.0)], "episode int, t int, n int, joint double")
    assert windows.filter_still_windows(f, 1, 1, 0.0, ["joint"]).select("episode").distinct().count() == 1
    assert windows.filter_still_windows(f, 1, 1, 0.0, ["other"]).count() == 3


def test_merge_rules(spark):
    a = rows(spark, [("a", 0, 2, 1.0, 2.0, 0.0, 2.0), ("a", 1, 0, None, 0.0, None, None)], "dataset string, t int, n long, mean double, m2 double, min double, max double")
    b = rows(spark, [("b", 0, 3, 4.0, 6.0, 3.0, 6.0), ("b", 1, 0, None, 0.0, None, None)], a.schema)
    got = {r.t: r for r in statistics.merge_statistics(a.unionByName(b)).collect()}
    values = [0.0, 2.0, 4.0 - 3**0.5, 4.0, 4.0 + 3**0.5]
    mean = sum(values) / 5
    assert got[0].mean == pytest.approx(mean) and got[0].std == pytest.approx((sum((x - mean) ** 2 for x in values) / 4) ** 0.5)
    assert got[1].mean is None and got[1].n == 0
    with pytest.raises(Exception, match="number of steps"):
        statistics.merge_statistics(a.unionByName(b.where("t = 0"))).collect()


def test_quantile_sketch_rank_error(spark):
    import numpy as np

    x = np.random.default_rng(0).uniform(0, 100, 5000)
    f = rows(spark, [(0, float(v)) for v in x], "t int, x double")
    parts = statistics.quantile_state(f.where("x < 50"), ("t",)).unionByName(statistics.quantile_state(f.where("x >= 50"), ("t",)))
    p = statistics.state_quantiles(statistics.merge_quantile_states(parts, ("t",))).first().p
    assert all(abs((x < q).mean() - r) < 0.02 for q, r in zip(p, statistics.PERCENTS, strict=True))


def test_uncovered_windows(spark):
    stats = F.array(F.struct(F.lit(1.0).alias("mean"), F.lit(2.0).alias("std")))
    w = F.array(F.lit(5.0), F.lit(7.0))
    with pytest.raises(Exception, match="do not cover"):
        spark.range(1).select(statistics.normalize_window(w, stats, "std", "per_step")).collect()
    assert spark.range(1).select(statistics.denormalize_window(w, stats, "std", "per_step").alias("w")).first().w == [11.0, 15.0]


def test_selection_totals(spark):
    m = rows(spark, [("a", f"{i:08d}", 4000 + i) for i in range(6)], "dataset string, shard string, num_sequences long")
    sel = shards.select_shards(m, {"a": 1.0}, 100_000, 8, 1)
    assert sel.count() % 8 == 0 and sel.agg(F.sum("num_sequences")).first()[0] >= 100_000 - 8 * 4005
    first = sel.where("epoch = 0")
    assert first.select("shard").distinct().count() == first.count() == 6
    assert sel.collect() == shards.select_shards(m, {"a": 1.0}, 100_000, 8, 1).collect()
    with pytest.raises(Exception, match="more than one epoch"):
        shards.select_shards(m, {"a": 1.0}, 100_000, 8, 1, allow_more=False).collect()
    mixed = shards.mix_datasets(sel.unionByName(sel.withColumn("dataset", F.lit("b"))), 3).orderBy("mix").limit(sel.count())
    share = mixed.where("dataset = 'a'").count() / mixed.count()
    assert 0.3 < share < 0.7


def test_interval_edges(spark):
    f = rows(spark, [(0, 0), (0, 10), (10, 10), (5, 10)], "k long, n long")
    got = [r.ci for r in f.select(results.binomial_ci(0.9)("k", "n").alias("ci")).collect()]
    assert got[0] == [0.0, 1.0]
    assert got[1][0] == 0.0 and got[1][1] == pytest.approx(1 - 0.05**0.1, abs=1e-9)
    assert got[2][1] == 1.0 and got[2][0] == pytest.approx(0.05**0.1, abs=1e-9)
    assert got[3] == pytest.approx([0.2224411, 0.7775589], abs=1e-6)
    median = f.limit(1).select(results.beta_quantiles(F.lit(1.0), F.lit(1.0)).alias("q")).first().q
    assert median == pytest.approx([0.025, 0.25, 0.5, 0.75, 0.975], abs=1e-9)


def test_letters(spark):
    s = rows(spark, [("t", "a", 100, 90), ("t", "b", 100, 85), ("t", "c", 100, 10), ("u", "a", 5, 1)], "task string, model string, total long, successes long")
    got = {(r.task, r.model): r.letters for r in results.compact_letters(s, results.pairwise(s, "task", "model"), "task", "model").collect()}
    assert got == {("t", "a"): "a", ("t", "b"): "a", ("t", "c"): "b", ("u", "a"): "a"}


def test_guards(spark):
    r = rows(spark, [("t", "m", 1), ("t", "m", 1)], "task string, model string, demo_id long")
    assert results.duplicate_guard(r).first().n == 2
    with pytest.raises(Exception, match="budget"):
        results.budget_guard(r, 1).collect()
    with pytest.raises(Exception, match="key exists"):
        results.upsert(r, r, ["task"], overwrite=False).collect()


def test_uuid5(spark):
    f = rows(spark, [("a/b",), ("ü",), ("",)], "p string")
    assert [r.u for r in f.select(names.uuid5(F.col("p")).alias("u")).collect()] == [str(uuid.uuid5(uuid.NAMESPACE_URL, x)) for x in ("a/b", "ü", "")]


def test_rotations(spark):
    r6 = F.array(*[F.lit(x) for x in (2.0, 0.0, 0.0, 5.0, 3.0, 0.0)])
    m = spark.range(1).select(geometry.rot6d_to_matrix(r6).alias("m")).first().m
    assert m == pytest.approx([1, 0, 0, 0, 1, 0, 0, 0, 1])
    with pytest.raises(Exception, match="rigid"):
        spark.range(1).select(geometry.from_matrix16(F.array(*[F.lit(1.0)] * 16))).collect()


def test_vector_rules(spark):
    with pytest.raises(ValueError):
        vectors.slice_action_vector(F.lit(None), {"a": 2, "b": 2})
    with pytest.raises(KeyError):
        vectors.concat_action_vector({}, ["x"])
    with pytest.raises(ValueError):
        vectors.remap_indices(F.lit(None), {"a": [1, (0, 2, 1)]})
    with pytest.raises(Exception, match="does not reach"):
        spark.range(1).select(vectors.slice_action_vector(F.array(F.lit(1.0)), {"a": 2})["a"]).collect()


def test_farthest_points(spark):
    pts = rows(spark, [("k", i, float(x), 0.0, 0.0, 1.0, 1.0, 1.0) for i, x in enumerate([0, 1, 10, 5])], "k string, i int, x double, y double, z double, r double, g double, b double")
    got = geometry.farthest_point_sample(pts, ["k"], 6).orderBy("i").collect()
    assert [r.x for r in got] == [0.0, 10.0, 5.0, 1.0, 0.0, 0.0] and [r.r for r in got] == [1.0] * 4 + [0.0] * 2


def test_moments_far_from_zero(spark):
    """Two parts of 1000 rows whose means are large and one apart."""
    from roboframe.operators import statistics as S

    parts = spark.createDataFrame([(0, 1000, 1.7e9, 0.0, 1.7e9, 1.7e9), (0, 1000, 1.7e9 + 1, 0.0, 1.7e9 + 1, 1.7e9 + 1), (1, 0, None, 0.0, None, None)], "t int, n long, mean double, m2 double, min double, max double")
    rows = {r.t: r for r in S.merge_moments(parts).collect()}
    assert rows[0].n == 2000 and abs(rows[0].m2 - 500) < 1e-6 and rows[0]["mean"] == 1.7e9 + 0.5
    assert rows[1].n == 0 and rows[1]["mean"] is None
    whole = S.finalize_statistics(parts.where("t = 0")).first()
    assert abs(whole.std - 0.5) < 1e-9


@pytest.mark.parametrize("most", [1 << 22, 40, 3])
def test_percentiles_by_rank(spark, most):
    import numpy as np

    from roboframe.operators import statistics as S

    rng = np.random.default_rng(4)
    groups = {0: rng.normal(size=3000), 1: np.repeat([1.0, 2.0], [900, 100]), 2: np.array([5.0]), None: rng.integers(0, 9, 500) / 2}
    rows = [(k, float(x)) for k, v in groups.items() for x in v] + [(0, None), (0, float("nan")), (3, None)]
    got = {r.t: r.p for r in S.masked_percentiles(spark.createDataFrame(rows, "t int, x double").repartition(5), most=most).collect()}
    assert set(got) == set(groups)
    for k, v in groups.items():
        assert np.allclose(got[k], np.quantile(v, S.PERCENTS))
    everything = S.masked_percentiles(spark.createDataFrame(rows, "t int, x double"), (), most=most).first().p
    assert np.allclose(everything, np.quantile(np.concatenate(list(groups.values())), S.PERCENTS))


def test_running_sums_of_one_hot_key(spark):
    import random

    from pyspark.sql import functions as F

    from roboframe.operators.shards import batch_rows
    from roboframe.operators.windows import running_sums

    rng = random.Random(2)
    rows = [("hot" if rng.random() < 0.8 else None, i, rng.randint(-5, 5)) for i in range(500)]
    frame = spark.createDataFrame(rows, "k string, i long, v long").repartition(3)
    total, want = {}, set()
    for k, i, v in rows:
        total[k] = total.get(k, 0) + v
        want.add((k, i, total[k]))
    assert {(r.k, r.i, r.sum_v) for r in running_sums(frame, ["k"], F.floor(F.col("i") / 40), ["i"], ["v"]).collect()} == want
    one, many = (batch_rows(frame, ["k"], ["i"], 7, b).select("k", "i", "batch").collect() for b in (None, F.floor(F.col("i") / 30)))
    assert sorted(one, key=str) == sorted(many, key=str) and len(one) == sum(n // 7 * 7 for n in (sum(r[0] == k for r in rows) for k in ("hot", None)))


def test_settings_of_fields(spark):
    from pyspark.sql import functions as F

    from roboframe.operators import statistics as S

    settings = {"joint": "std", "arm_joint": "min_max", "xyz": "percentile_1_99"}
    names = spark.createDataFrame([("xyz",), ("arm_joint",), ("left_arm_joint",), ("grip",), (None,)], "f string")
    got = [r.s for r in names.select(S.field_setting(F.col("f"), settings, "std_default").alias("s")).collect()]
    assert got == ["percentile_1_99", "min_max", "std", "std_default", "std_default"]


def test_run_attributes(spark):
    from pyspark.sql import functions as F

    from roboframe.functions import names as N

    paths = ["a/diffusion_policy/ablations/x/wide/2024_01_02-03_04_05-lr_1e-05-bsz_64-tail/", "2024_01_02-03_04_05-bsz_8-lr_0.001", "plain"]
    rows = spark.createDataFrame([(p,) for p in paths], "p string").select(N.run_attributes(F.col("p")).alias("a")).select("a.*").collect()
    assert tuple(rows[0]) == ("diffusion_policy", "wide", "1e-05", 64, "2024_01_02-03_04_05")
    assert tuple(rows[1]) == (None, "run_2024_01_02-03_04_05", "0.001", 8, "2024_01_02-03_04_05")
    assert tuple(rows[2]) == (None, None, None, None, None)


def test_tensor_names(spark):
    from pyspark.sql import functions as F

    from roboframe.functions import names as N

    names = ["robot__actual__poses__left::panda__xyz", "actual__poses__left::panda__xyz", "timestep", None]
    rows = spark.createDataFrame([(n,) for n in names], "n string").select(N.parse_tensor_name(F.col("n")).alias("a")).select("a.*").collect()
    assert tuple(rows[0]) == tuple(rows[1]) == ("actual", "poses", "left", "panda", "xyz")
    assert tuple(rows[2]) == (None, "timestep", None, None, None) and tuple(rows[3]) == (None,) * 5


def test_farthest_points_of_null_empty_and_short_clouds(spark):
    two = [[1.0, 0.0, 0.0, 7.0], [3.0, 0.0, 0.0, 8.0]]
    f = rows(spark, [(0, None), (1, []), (2, two), (3, [[0.0, 0.0, 0.0, 1.0], [1.0, 0.0, 0.0, 2.0], [-1.0, 0.0, 0.0, 3.0]])], "i int, c array<array<double>>")
    got = {r.i: r.p for r in f.select("i", geometry.farthest_points(3, 4)("c").alias("p")).collect()}
    none = [0.0] * 4
    assert got[0] is None and got[1] == [none] * 3 and got[2] == [*two, none]
    assert [p[3] for p in got[3]] == [1.0, 2.0, 3.0]  # both are one apart: the earlier point first


def test_states_of_transfers(spark):
    listed = rows(spark, [(p, 1) for p in "abcde"], "path string, ok int")
    log = rows(spark, [("b", 1, True), ("c", 1, False), ("d", 1, False), ("d", 2, False), ("e", 1, False), ("e", 2, True), ("x", 1, True)], "path string, attempt int, ok boolean")
    got = {r.path: (r.attempts, r.state) for r in shards.transfer_states(listed, log, "path").collect()}
    assert got == {"a": (0, "pending"), "b": (1, "done"), "c": (1, "retry"), "d": (2, "failed"), "e": (2, "done")}


@pytest.mark.parametrize("past,future,stride", [(0, 0, 1), (0, 3, 2), (4, 0, 1), (3, 5, 3)])
def test_windows_against_plain_python(spark, past, future, stride):
    data = {"a": [1.0, 2.0, None, 4.0, 5.0, 6.0, 7.0], "b": [9.0], "c": [1.5, 2.5]}
    steps = rows(spark, [(k, t, len(v), x) for k, v in data.items() for t, x in enumerate(v)], "episode string, t int, n int, x double")
    got = windows.window_samples(steps, past, future, past, future, "copy", stride).collect()
    want = {(k, t): [v[min(max(t + j, 0), len(v) - 1)] for j in range(-past, future + 1)] for k, v in data.items() for t in range(0, len(v), stride)}
    assert {(r.episode, r.t): r.window for r in got} == want
