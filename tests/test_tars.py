"""Tar shards: the source's ranges, filters and rejects; the sink's commit and abort."""

import io
import json
import os
import tarfile

import pytest
from pyspark.sql import functions as F

from roboframe.sources import tars


def pack(path, members, mode="w", tail=b""):
    with tarfile.open(path, mode) as tar:
        for name, raw in members:
            info = tarfile.TarInfo(name)
            info.size = len(raw)
            tar.addfile(info, io.BytesIO(raw))
    with open(path, "ab") as f:
        f.write(tail)


def content(rows):
    return {(r.shard, r.key): (None if r.fields is None else {k: bytes(v) for k, v in r.fields.items()}) for r in rows}


def sample(i, size=300):
    return [(f"k{i:03d}.a.txt", f"{i}".encode() * size), (f"k{i:03d}.json", b"{}"), (f"k{i:03d}." + "long" * 40, b"x")]


@pytest.mark.parametrize("split", [1, 3000, 20_000, 1 << 28])
def test_ranges_keep_samples_whole(spark, tmp_path, split):
    for s in range(3):
        pack(tmp_path / f"s{s}.tar", [m for i in range(10 * s, 10 * s + 10) for m in sample(i)])
    pack(tmp_path / "z.tar.gz", sample(900), "w:gz")
    pack(tmp_path / "void.tar", [])
    frame = tars.read_tar_shards(spark, str(tmp_path), split=split)
    got = content(frame.collect())
    want = {(f"s{i // 10}.tar", f"k{i:03d}"): {n.partition(".")[2]: raw for n, raw in sample(i)} for i in range(30)}
    assert got == want | {("z.tar.gz", "k900"): {n.partition(".")[2]: raw for n, raw in sample(900)}}
    tasks = frame.select(F.spark_partition_id().alias("p"), "shard").distinct().groupBy("shard").count().collect()
    assert {r["shard"]: r["count"] for r in tasks}["s1.tar"] == {1: 10, 3000: 10, 20_000: 2, 1 << 28: 1}[split]
    some = content(tars.read_tar_shards(spark, f"{tmp_path}/s[12].*", ("json",), split=split).where("shard = 's2.tar'").collect())
    assert some == {("s2.tar", f"k{i:03d}"): {"json": b"{}"} for i in range(20, 30)}


def test_other_shards_stay_closed(spark, tmp_path):
    pack(tmp_path / "good.tar", sample(1))
    (tmp_path / "bad.tar").write_bytes(b"broken" * 200)
    assert tars.read_tar_shards(spark, str(tmp_path), shards=["good.tar", "none.tar"], mode="FAILFAST").count() == 1
    assert tars.read_tar_shards(spark, str(tmp_path), shards=[]).count() == 0
    frame = tars.read_tar_shards(spark, str(tmp_path), mode="FAILFAST")
    with pytest.raises(Exception, match="bad.tar"):
        frame.collect()
    frame = tars.read_tar_shards(spark, str(tmp_path))  # filters of one query leave the others of its frame alone
    assert (frame.count(), frame.where("shard = 'good.tar'").count(), frame.count()) == (2, 1, 2)


def test_more_than_two_gigabytes(spark, tmp_path):
    """A sparse file: its large member is stepped over, and several tasks read the rest."""
    path = tmp_path / "huge.tar"
    with open(path, "wb") as f:
        for i in range(6):
            for name, raw, size in ((f"k{i}.bin", b"", 1 << 29), (f"k{i}.txt", b"%d" % i, 1)):
                info = tarfile.TarInfo(name)
                info.size = size
                f.write(info.tobuf())
                f.write(raw)
                f.seek(-(-(f.tell() + size - len(raw)) // 512) * 512)
        f.write(bytes(1024))
    assert os.path.getsize(path) > 3 << 30
    frame = tars.read_tar_shards(spark, str(path), ("txt",), split=1 << 30)
    assert content(frame.collect()) == {("huge.tar", f"k{i}"): {"txt": b"%d" % i} for i in range(6)}
    assert frame.rdd.getNumPartitions() == 3


def test_rejects_say_why(spark, tmp_path):
    pack(tmp_path / "ok.tar", sample(1))
    pack(tmp_path / "twice.tar", [("a.txt", b"1"), ("a.txt", b"2"), ("b.txt", b"3")])
    pack(tmp_path / "cut.tar", sample(2) + [("last.txt", b"z" * 5000)])
    raw = (tmp_path / "cut.tar").read_bytes()
    (tmp_path / "cut.tar").write_bytes(raw[: raw.index(b"zzzz") + 700])
    raw = bytearray((tmp_path / "ok.tar").read_bytes())
    raw[raw.index(b"k001.json") + 3] ^= 1  # a header whose checksum is wrong now
    (tmp_path / "header.tar").write_bytes(raw)
    (tmp_path / "void.tar").write_bytes(b"")
    (tmp_path / "noise.tar").write_bytes(b"noise" * 300)
    pack(tmp_path / "z.tar.gz", sample(3), "w:gz")
    z = (tmp_path / "z.tar.gz").read_bytes()
    (tmp_path / "half.tar.gz").write_bytes(z[: len(z) // 2])
    pack(tmp_path / "z.tar.bz2", sample(4), "w:bz2")
    pack(tmp_path / "z.tar.xz", sample(5), "w:xz")
    rows = tars.read_tar_shards(spark, str(tmp_path)).collect()
    good = {(r.shard, r.key) for r in rows if r.reason is None}
    assert good == {("ok.tar", "k001"), ("twice.tar", "b"), ("cut.tar", "k002"), ("z.tar.gz", "k003"), ("z.tar.bz2", "k004"), ("z.tar.xz", "k005")}
    bad = {(r.shard, r.key) for r in rows if r.reason and r.fields is None}
    assert len(bad) + len(good) == len(rows)
    want = {("twice.tar", "a"), ("cut.tar", "last"), ("header.tar", "k001"), ("half.tar.gz", "k003")}
    assert bad == want | {(s, None) for s in ("cut.tar", "header.tar", "void.tar", "noise.tar", "half.tar.gz")}
    dropped = tars.read_tar_shards(spark, str(tmp_path), mode="DROPMALFORMED")
    assert {(r.shard, r.key) for r in dropped.collect()} == good
    assert {(r.shard, r.key) for r in tars.read_tar_shards(spark, str(tmp_path)).where("reason IS NULL").collect()} == good
    assert tars.read_tar_shards(spark, f"{tmp_path}/nothing").count() == 0


def tree(path):
    return sorted(os.path.relpath(os.path.join(d, f), path) for d, _, files in os.walk(path) for f in files if not f.endswith(".crc"))


def rows_of(spark, shards, per=4):
    rows = [(s, f"k{s}_{i}", 9 - i, {"txt": f"{s}.{i}".encode(), "json": b""}) for s in shards for i in range(per)]
    return spark.createDataFrame(rows, "shard int, key string, t int, fields map<string,binary>").repartition(5)


def test_sink_writes_shards_and_their_manifest(spark, tmp_path):
    out = f"{tmp_path}/out"
    tars.write_tar_shards(rows_of(spark, range(4)), out, order="t")
    assert tree(out) == ["manifest.jsonl", *(f"shard_{s:06d}.tar" for s in range(4))]
    with tarfile.open(f"{out}/shard_000002.tar") as tar:
        assert tar.getnames() == [f"k2_{i}.{x}" for i in (3, 2, 1, 0) for x in ("json", "txt")]
    tars.write_tar_shards(rows_of(spark, [7]), f"file://{out}")
    lines = [json.loads(x) for x in open(f"{out}/manifest.jsonl")]
    assert lines == [{"shard": f"shard_{s:06d}", "num_sequences": 4} for s in (0, 1, 2, 3, 7)]
    assert tars.read_tar_shards(spark, out).count() == 20
    tars.write_tar_shards(rows_of(spark, []), f"{tmp_path}/none")
    assert tree(f"{tmp_path}/none") == ["manifest.jsonl"]


def test_a_job_that_fails_leaves_nothing(spark, tmp_path):
    out = f"{tmp_path}/out"
    tars.write_tar_shards(rows_of(spark, [1]), out)
    before, raw = tree(out), open(f"{out}/shard_000001.tar", "rb").read()
    broken = rows_of(spark, range(20, 60)).withColumn("key", F.when((F.col("shard") == 41) & (F.col("t") == 7), F.lit(None)).otherwise(F.col("key")))
    with pytest.raises(Exception, match="needs a shard and a key"):
        tars.write_tar_shards(broken, out)
    assert tree(out) == before
    with pytest.raises(Exception, match="is there"):
        tars.write_tar_shards(rows_of(spark, [1, 5], per=2), out)
    assert tree(out) == before and open(f"{out}/shard_000001.tar", "rb").read() == raw
    with pytest.raises(Exception, match="twice"):  # a shard that two tasks write
        tars.registered(spark)
        rows_of(spark, [8], per=40).select("shard", "key", "fields").write.format(tars.NAME).mode("append").save(out)
    assert tree(out) == before
    with pytest.raises(Exception, match="not replaced"):
        rows_of(spark, [8]).select("shard", "key", "fields").write.format(tars.NAME).mode("overwrite").save(out)
