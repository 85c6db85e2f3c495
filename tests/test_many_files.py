"""Tables in parts, and results that don't hang on how many files there are."""

import io
import os
import tarfile
import zipfile

import numpy as np
import pytest

from roboframe import registry
from roboframe.operators import convert
from roboframe.sources import files, filesets, tars
from roboframe.streaming import jobs


@pytest.mark.parametrize("rows, parts", [(25, 3), (0, 1)])
def test_rows_of_a_table_in_parts(spark, tmp_path, rows, parts):
    d = spark.range(rows).selectExpr("id AS doc_id", "'a' AS text").repartition(parts)
    d.write.parquet(f"{tmp_path}/documents.parquet")
    got = registry.queries()["A07_parquet_row_counts"](spark, str(tmp_path)).collect()
    assert [tuple(r) for r in got] == [("documents.parquet", rows)]


def npz(save=np.savez, **arrays):
    out = io.BytesIO()
    save(out, **arrays)
    return out.getvalue()


def test_small_shards_are_shared_among_tasks(spark, tmp_path):
    for k in range(12):
        with tarfile.open(tmp_path / f"s{k:02d}.tar", "w") as tar:
            info = tarfile.TarInfo(f"k{k}.bin")
            info.size = 600_000
            tar.addfile(info, io.BytesIO(bytes(info.size)))
    frame = tars.read_tar_shards(spark, str(tmp_path))
    assert frame.rdd.getNumPartitions() == 12 and frame.count() == 12
    assert tars.read_tar_shards(spark, str(tmp_path), split=1_300_000).rdd.getNumPartitions() == 12


def test_arrays_of_small_files_are_as_numpy_reads_them():
    arrays = {"f": np.arange(6.0).reshape(2, 3), "o": np.asfortranarray(np.arange(6).reshape(2, 3)), "b": np.array([True, False]),
              "big": np.arange(4, dtype=">i2"), "none": np.zeros((0, 3)), "one": np.float32(2.5), "s": np.array("n"), "nan": np.array([np.nan, 1])}
    for save in (np.savez, np.savez_compressed):
        raw = npz(save, **arrays)
        with np.load(io.BytesIO(raw)) as z:
            want = {k: np.atleast_1d(z[k]).astype(float).ravel() for k in arrays if k != "s"}
        got = files._arrays(raw)
        assert list(got) == list(want) and all(np.array_equal(got[k], want[k], equal_nan=True) for k in want)


def test_files_with_other_members_and_many_rows(spark, monkeypatch):
    note = io.BytesIO(npz(x=np.arange(2.0)))
    with zipfile.ZipFile(note, "a") as z:
        z.writestr("note.txt", "no array")
    raw = bytearray(npz(x=np.arange(2.0)))
    raw[raw.index(b"NUMPY") + 130] ^= 1  # a value whose checksum is wrong now
    content = [(f"r/e_t{t:04d}.npz", npz(x=np.array([float(t)]))) for t in range(50)]
    content += [("r/n_t0.npz", note.getvalue()), ("r/d_t0.npz", bytes(raw)), ("r/o_t0.npz", npz(x=np.array([None])))]
    rows = files.frame_rows(spark.createDataFrame(content, "path string, content binary").coalesce(1)).collect()
    good = {(r.episode, r.t): r.value for r in rows if r.reason is None}
    assert good == {("e", t): [float(t)] for t in range(50)} | {("n", 0): [0.0, 1.0]}
    assert {r.path for r in rows if r.reason} == {"r/d_t0.npz", "r/o_t0.npz"}


def test_rows_of_files_go_on_together():
    """A batch for each file costs more than the file."""

    class Files:
        select = lambda self, *_: self
        mapInArrow = lambda self, run, _: run  # noqa: E731, N815

    import pyarrow as pa

    content = [(f"r/e_t{t:04d}.npz", npz(x=np.array([float(t)]))) for t in range(50)]
    batch = pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*content, strict=True)], ["path", "content"])
    assert [b.num_rows for b in files.frame_rows(Files())(iter([batch, batch]))] == [100]


def test_files_are_read_by_folders(spark, tmp_path):
    content = {f"d{i % 5}/e{i % 2}/{i}.txt": f"{i}" for i in range(40)} | {"top": "é\n", "x y/%41": ""}
    filesets.write_files(spark.createDataFrame(list(content.items()), "path string, content string").repartition(3), f"{tmp_path}/out")
    for hidden in ("_note", ".d/x", "d1/_temporary/y"):
        os.makedirs(os.path.dirname(f"{tmp_path}/out/{hidden}"), exist_ok=True)
        open(f"{tmp_path}/out/{hidden}", "w").close()
    rows = filesets.read_files(spark, f"file://{tmp_path}/out")
    assert {r.path: bytes(r.content).decode() for r in rows.collect()} == content
    assert 1 < rows.rdd.getNumPartitions() <= 7
    assert filesets.read_files(spark, f"{tmp_path}/nothing").count() == 0


def test_summaries_of_rollouts_with_the_same_number(spark, tmp_path):
    """A file for each: rows as the SQL has them, those without a number are in neither."""
    docs = [(i, "de", "web", 10) for i in (*range(40), 3, 3, 7, 7, -23, None)]
    spark.createDataFrame(docs, "doc_id long, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    labels = [(i, i % 2) for i in range(0, 40, 3)]
    spark.createDataFrame(labels, "doc_id long, quality long").write.parquet(f"{tmp_path}/labels.parquet")
    q = registry.queries()
    good = sorted(map(tuple, q["A14_scan_summary"](spark, str(tmp_path)).collect()))
    want = [(i, i % 3 == 0 and i % 2 == 1) for i in (*range(40), 3, 3, -23) if i < 0 or i % 30 != 7]  # -23 % 30 is -23 in SQL
    assert good == sorted(want)
    bad = sorted(r["row"] for r in q["A14b_summary_rejects"](spark, str(tmp_path)).collect())
    assert bad == ["37", "7", "7", "7"]


def test_jobs_of_a_conversion_are_bounded(spark, tmp_path, monkeypatch):
    """Neither the jobs nor the files of moments nor the times that frames are read grow with the number of shards."""
    read, jobs = spark.sparkContext.accumulator(0), []

    def seen(batches):
        for b in batches:
            read.add(b.num_rows)
            yield b

    rows = spark.range(2000).selectExpr("CAST(id DIV 10 AS INT) AS episode", "CAST(id AS INT) AS ts", "CAST(id AS INT) AS ordinal", "CAST(id AS DOUBLE) AS x")
    rows = rows.mapInArrow(seen, rows.schema)
    monkeypatch.setattr(convert, "LEAST", 5)
    write = tars.write_tar_shards
    monkeypatch.setattr(tars, "write_tar_shards", lambda *a, **b: (jobs.append(1), write(*a, **b)))
    assert convert.convert(rows, f"{tmp_path}/out", 1, 3, 1, 2, per_shard=1) == 0
    assert len(jobs) == 16 and read.value == 4000
    assert convert.shards_there(spark, f"{tmp_path}/out").count() == 200
    assert sum(f.endswith(".parquet") for _, _, names in os.walk(f"{tmp_path}/out/moments") for f in names) < 200
    n = {r["t"]: r["n"] for r in convert.converted_moments(spark, f"{tmp_path}/out").collect()}
    assert n == {0: 1600, 1: 1800, 2: 1800, 3: 1600, 4: 1400}


def test_headers_are_those_of_tarfile(spark, tmp_path):
    names = ["a.txt", "x" * 100, "y" * 101, "d/é.json", "", "long/" * 60 + "z", "a/b/"]
    for name in names:
        for size in (0, 1, 511, 512, 8**11 - 1, 8**11):
            info = tarfile.TarInfo(name)
            info.size = size
            assert tars.header(name, size) == info.tobuf()
    rows = [(0, f"k{i}" * (1 + 30 * (i % 2)), {"a": bytes(i), "é": b"x" * 513 * i}) for i in range(30)]
    tars.write_tar_shards(spark.createDataFrame(rows, "shard int, key string, fields map<string,binary>"), f"{tmp_path}/out")
    want = io.BytesIO()
    with tarfile.open(fileobj=want, mode="w|") as tar:
        for _, key, fields in sorted(rows, key=lambda r: r[1]):
            for part, raw in sorted(fields.items()):
                info = tarfile.TarInfo(f"{key}.{part}")
                info.size = len(raw)
                tar.addfile(info, io.BytesIO(raw))
    assert open(f"{tmp_path}/out/shard_000000.tar", "rb").read() == want.getvalue()


def test_calls_of_a_rollout_on_its_state():
    """Each call goes to the executor and back: a new rollout makes three, a file that changes nothing one."""
    from pyspark.sql import Row

    calls, state, timers = [], {}, set()

    class Value:
        def get(self):
            calls.append("get")
            return state.get("v")

        def update(self, v):
            calls.append("update")
            state["v"] = v

        def clear(self):
            calls.append("clear")
            state.clear()

    class Handle:
        getValueState = lambda self, *_: Value()  # noqa: E731, N815

        def registerTimer(self, t):  # noqa: N802
            calls.append("register")
            timers.add(t)

        def deleteTimer(self, t):  # noqa: N802
            calls.append("delete")
            timers.remove(t)

    p = jobs.Rollouts(1000)
    p.init(Handle())
    one = lambda at, success, pending, duration=None: Row(at=at, success=success, pending=pending, duration=duration)

    def run(*rows):
        calls.clear()
        told = [tuple(r) for r in p.handleInputRows(("t", "m", 5), iter(rows), None)]
        return [(r[3], r[4], r[5], r[6]) for r in told], list(calls)

    assert run(one(2_000_000, None, True)) == ([("open", None, None, 2_000_000)], ["get", "update", "register"])
    assert run(one(1_000_000, True, False)) == ([], ["get"])  # older than what is known
    got = run(one(4_000_000, False, False, 9.0), one(3_000_000, True, False, float("nan")))
    assert got == ([("final", True, None, 3_000_000)], ["get", "update", "delete", "register"])
    assert timers == {4000} and run(one(5_000_000, False, False)) == ([], ["get"])
    assert list(p.handleExpiredTimer(("t", "m", 5), None, None)) == [] and not state
    run(one(6_000_000, None, True))
    assert [tuple(r) for r in p.handleExpiredTimer(("t", "m", 5), None, None)] == [("t", "m", 5, "lost", None, None, 6_000_000)]
