"""The converter that is begun again, rejects of one pass, folds in constant memory, draws, counts of a pass that writes."""

import hashlib
import io
import json
import os
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from roboframe.operators import convert, folds, results, windows
from roboframe.sources import files, rejects, tars


@pytest.fixture(scope="module")
def frames(spark):
    rng = random.Random(12)
    rows = [(e, t, t, rng.choice([None, rng.random()])) for e in [*range(0, 30), 41] for t in range(rng.randint(1, 30) if e not in (8, 9, 10, 11) else 2)]
    rows += [(None, 1, 1, 0.5)]
    return spark.createDataFrame(rows, "episode int, ts int, ordinal int, x double").repartition(4).cache()


def outcome(spark, root):
    shards = {}
    for name in os.listdir(f"{root}/shards"):
        if name.endswith(".tar"):
            shards[name] = hashlib.md5(open(f"{root}/shards/{name}", "rb").read()).hexdigest()
    manifest = [json.loads(x) for x in open(f"{root}/shards/manifest.jsonl")]
    moments = sorted(tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in convert.converted_moments(spark, root).collect())
    assert {s["shard"] + ".tar" for s in manifest if s["num_sequences"]} == set(shards)
    return shards, manifest, moments


ARGS = (1, 5, 1, 2)


def test_conversion_that_is_cut_off(spark, frames, tmp_path, monkeypatch):
    whole = f"{tmp_path}/whole"
    assert convert.convert(frames, whole, *ARGS, per_shard=4) == 0
    want = outcome(spark, whole)
    assert {"shard": "shard_000002", "num_sequences": 0} in want[1] and len(want[1]) == 9  # two steps leave no window
    # between slices
    parts = f"{tmp_path}/parts"
    assert convert.convert(frames, parts, *ARGS, per_shard=4, slice_=3, most_slices=1) == 6
    assert convert.convert(frames, parts, *ARGS, per_shard=4, slice_=3) == 0
    assert outcome(spark, parts) == want
    # after the moments of a slice, before its shards; and in the middle of the shards
    for k, place in enumerate(("write_tar_shards", "_write_manifest")):
        broken = f"{tmp_path}/broken{k}"
        convert.convert(frames, broken, *ARGS, per_shard=4, slice_=2, most_slices=1)
        with monkeypatch.context() as m, pytest.raises(Exception):
            if k == 0:
                m.setattr(tars, place, lambda *a, **b: (_ for _ in ()).throw(OSError("cut off")))
            else:
                odd = frames.withColumn("x", F.when((F.col("episode") == 25) & (F.col("ts") == 1), F.raise_error(F.lit("cut off"))).otherwise(F.col("x")))
                convert.convert(odd, broken, *ARGS, per_shard=4)
            convert.convert(frames, broken, *ARGS, per_shard=4)
        assert convert.convert(frames, broken, *ARGS, per_shard=4) == 0
        assert outcome(spark, broken) == want
    assert convert.convert(frames, whole, *ARGS, per_shard=4) == 0 and outcome(spark, whole) == want
    assert convert.convert(frames.limit(0), f"{tmp_path}/none", *ARGS) == 0


def test_rejects_of_one_pass(spark):
    read = spark.sparkContext.accumulator(0)

    def seen(batches):
        for b in batches:
            read.add(len(b))
            yield b

    rows = spark.createDataFrame([(i, f"p{i}", "odd" if i % 4 == 0 else None) for i in range(20)], "i int, path string, reason string")
    good, bad = rejects.split(rows.mapInPandas(seen, rows.schema), "parse", F.col("path"))
    assert sorted(map(tuple, good.collect())) == [(i, f"p{i}") for i in range(20) if i % 4]
    assert sorted(map(tuple, bad.collect())) == sorted(("parse", f"p{i}", "odd") for i in range(0, 20, 4))
    assert good.count() + bad.count() == 20 and read.value == 20
    none = rejects.split(rows.where("i < 0"), "parse", F.col("path"))
    assert [x.count() for x in none] == [0, 0]


def npz(**arrays):
    out = io.BytesIO()
    np.savez(out, **arrays)
    return out.getvalue()


def test_files_that_cannot_be_read(spark):
    good = npz(x=np.arange(3.0), name=np.array("n"))
    content = [("r/e1_t0003.npz", good), ("r/e1_t0004.npz", good[:60]), ("r/other.npz", good), ("r/e2_t1.npz", b""), ("r/e3_t1.npz", npz(name=np.array("n")))]
    rows = files.frame_rows(spark.createDataFrame(content, "path string, content binary")).collect()
    assert [(r.episode, r.t, r.field, r.value) for r in rows if r.reason is None] == [("e1", 3, "x", [0.0, 1.0, 2.0])]
    assert {r.path for r in rows if r.reason} == {"r/e1_t0004.npz", "r/other.npz", "r/e2_t1.npz"}
    rows = files.episode_rows(spark.createDataFrame([("r/e/a.npz", npz(x=np.arange(2.0))), ("r/e/b.npz", b"no")], "path string, content binary")).collect()
    assert {(r.t, r.path, r.reason is None) for r in rows} == {(0, "r/e/a.npz", True), (1, "r/e/a.npz", True), (None, "r/e/b.npz", False)}


@pytest.mark.parametrize("batch", [10_000, 7])
def test_fingerprints(spark, batch):
    rng = random.Random(batch)
    rows = [(rng.choice(["hot"] * 8 + ["a", "b", None]), rng.choice(["", "p", "é", "p/q", None]) if i % 5 == 0 else f"f{rng.randrange(900)}") for i in range(3000)]
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(batch))
    try:
        frame = spark.createDataFrame(rows, "k string, v string").repartition(5)
        got = {r["k"]: (r["n"], r["first"], r["fingerprint"]) for r in folds.fingerprints(frame, "k", "v", first=3).collect()}
        assert folds.fingerprints(frame.limit(0), "k", "v").count() == 0
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    want = {}
    for k in {r[0] for r in rows}:
        values = sorted((v for x, v in rows if x == k and v is not None), key=lambda v: v.encode())
        want[k] = (len(values), values[:3], hashlib.md5("\n".join(values).encode()).hexdigest())
    assert got == want


def test_draws_follow_their_distribution(spark):
    groups = spark.createDataFrame([("x", 3, 9), ("y", 40, 2)], "k string, a long, b long")
    draws = results.beta_draws(groups.repartition(2), ["k"], "a", "b", 3000, 7)
    one, other = Counter(map(tuple, draws.collect())), Counter(map(tuple, results.beta_draws(groups.coalesce(1), ["k"], "a", "b", 3000, 7).collect()))
    assert one == other and one != Counter(map(tuple, results.beta_draws(groups, ["k"], "a", "b", 3000, 8).collect()))
    for k, a, b in (("x", 3, 9), ("y", 40, 2)):
        d = np.array([r[2] for r in one if r[0] == k])
        assert len(d) == 3000 and abs(d.mean() - a / (a + b)) < 0.01
        assert abs(d.var() - a * b / ((a + b) ** 2 * (a + b + 1))) < 0.002
        assert abs((results.beta_cdf(d, np.full(3000, float(a)), np.full(3000, float(b))) < 0.3).mean() - 0.3) < 0.03


def test_counts_of_the_pass_that_writes(spark, frames, tmp_path):
    steps = windows.episode_timesteps(frames.where("episode IS NOT NULL").fillna(0.0))
    counts = windows.write_kept_windows(steps, f"{tmp_path}/kept", 1, 5, 1, 2, 0.2)
    want = windows.filter_counters(steps, 1, 5, 1, 2, 0.2).first().asDict()
    assert counts == want and spark.read.parquet(f"{tmp_path}/kept").count() == want["kept"] > 0
