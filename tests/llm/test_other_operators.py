"""Top-k search, token counts, chat formatting and the pipeline."""

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from roboframe.llm import chat_format, exact_topk, graph, token_counts


@pytest.mark.parametrize("blocks", [(8192, 512, 1 << 21), (5, 3, 18)])
def test_top_k_matches_brute_force(spark, monkeypatch, blocks):
    monkeypatch.setattr(exact_topk, "CANDIDATES", blocks[0])
    monkeypatch.setattr(exact_topk, "QUERIES", blocks[1])
    monkeypatch.setattr(exact_topk, "PASS", blocks[2])
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in rng.integers(-2, 3, 6) / 64 * (rng.random(6) < 0.6)], 1, 2) for i in range(70)]
    rows += [(100, None, 1, 2), (101, [0.1, None, 0.0, 0.0, 0.0, 0.0], 1, 2), (102, [float("nan")] * 6, 1, 2), (120, [float("inf")] * 6, 1, 2), (None, [0.0] * 6, 1, 2)]
    rows += [(40, rows[40][1], 1, 2), (33, rows[33][1], 1, 2)]
    rows += [(i, [], 1, 2) for i in range(200, 243)] + [(i, [float(i), -1.0], 1, 2) for i in range(260, 290)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, ids int, block int").repartition(3)
    good = [(i, np.floor(np.array(v) * 64).astype(int)) for i, v, *_ in rows if i is not None and v is not None and None not in v and np.isfinite(v).all()]
    want = Counter()
    for q, v in [(i, v) for i, v in good if i % 20 == 0]:
        best = sorted((-int(v @ w), i) for i, w in good if i != q and len(w) == len(v))[:20]
        want.update((q, k + 1, i, -s) for k, (s, i) in enumerate(best))
    got = Counter((r.query_id, r["rank"], r.vec_id, r.score) for r in exact_topk.top_k(frame, F.col("vec_id") % 20 == 0).collect())
    assert got == want
    assert exact_topk.top_k(frame.limit(0), F.col("vec_id") % 20 == 0).count() == 0


def test_top_k_of_large_components(spark):
    """Sums beyond 32 and 64 bits are exact; what no 64-bit integer holds is an error."""
    big = 1.3 * 2.0**24 + 1 / 64
    rows = [(0, [big, big, 3.0]), (1, [big, big, -big]), (2, [-big, 0.5, big]), (3, [1.0, 1.0, 1.0]), (20, [big, big, -big])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    exact = {i: [int(x * 64 // 1) for x in v] for i, v in rows}
    want = Counter()
    for q in (0, 20):
        best = sorted((-sum(a * b for a, b in zip(exact[q], exact[i])), i) for i in exact if i != q)
        want.update((q, k + 1, i, -s) for k, (s, i) in enumerate(best))
    got = Counter((r.query_id, r["rank"], r.vec_id, r.score) for r in exact_topk.top_k(frame, F.col("vec_id") % 20 == 0).collect())
    assert got == want
    for x in (2.0**57, 2.0**40):  # the component itself, and the square of it
        with pytest.raises(Exception, match="64-bit"):
            exact_topk.top_k(spark.createDataFrame([(0, [x]), (1, [x])], frame.schema), F.col("vec_id") % 20 == 0).collect()


@pytest.mark.parametrize("block", [1, 7, 1 << 19])
def test_token_counts(spark, monkeypatch, block):
    monkeypatch.setattr(token_counts, "STRETCH", 3)
    rng = random.Random(block)
    files = {f: [rng.choice([0, 1, 2, 9, 9]) for _ in range(60)] for f in range(4)}
    files |= {7: [9], 8: [1, 2, 3], 9: [1] * 40, 10: [9, 9, 9] + [4] * 30}
    rows, want = [], Counter()
    for f, ids in files.items():
        for k, a in enumerate(range(0, len(ids), block)):
            rows.append((f, k, np.array(ids[a : a + block], dtype="<u2").tobytes(), 0))
        docs, n = [], 0
        for x in ids:
            if x == 9:
                docs.append(n)
                n = 0
            else:
                n += 1
        docs += [n] if n else []
        want.update((f, i, n) for i, n in enumerate(docs))
    blocks = spark.createDataFrame(rows, "file int, block long, ids binary, first int").repartition(3)
    assert Counter(tuple(r) for r in token_counts.count_tokens(blocks, 9).collect()) == want
    assert token_counts.count_tokens(blocks.limit(0), 9).count() == 0


def test_raw_token_files(spark, tmp_path):
    (tmp_path / "a.bin").write_bytes(np.array([1, 2, 9, 9, 3], dtype="<u2").tobytes() + b"\1")  # half an identifier at the end
    blocks = token_counts.read_token_files(spark, str(tmp_path), 2, block=2)
    assert sorted(r.n_tokens for r in token_counts.count_tokens(blocks, 9).collect()) == [0, 1, 2]


@pytest.mark.parametrize(("block", "together"), [(7, 1), (7, 5), (64, 3), (1 << 19, 64)])
def test_a_token_file_over_many_tasks(spark, tmp_path, block, together):
    """Ranges of bytes begin at blocks, wherever documents do; there is no index."""
    rng = random.Random(block)
    want = Counter()
    for name, n in (("a.bin", 5000), ("b.bin", 1), ("c.bin", 0), ("d.bin", 777)):
        ids = [rng.choice([9] + [1, 2, 3] * 30) for _ in range(n)]
        (tmp_path / name).write_bytes(np.array(ids, dtype="<u2").tobytes() + b"\1" * (name == "d.bin"))
        docs = [[]]
        for i in ids:
            docs[-1].append(i) if i != 9 else docs.append([])
        want.update((name, k, len(d)) for k, d in enumerate(docs) if k + 1 < len(docs) or d)
    blocks = token_counts.read_token_files(spark, f"file://{tmp_path}", 2, block=block, together=together)
    got = token_counts.count_tokens(blocks, 9).collect()
    assert Counter((r.file.rpartition("/")[2], r.document, r.n_tokens) for r in got) == want
    tasks = blocks.where("file LIKE '%a.bin'").select(F.spark_partition_id()).distinct().count()
    assert tasks == -(-5000 // (block * together))
    assert token_counts.read_token_files(spark, f"{tmp_path}/none", 2).count() == 0


def test_op5_counts_equal_encoded_lengths(spark, sf):
    from roboframe.llm.bpe import op8_bpe_encoding

    a = {r.doc_id: r.n_tokens for r in token_counts.op5_token_counts(spark, sf).collect()}
    assert a == {r.doc_id: r.n_tokens for r in op8_bpe_encoding(spark, sf).collect()}


def test_op5_counts_separators_of_the_text(spark):
    from roboframe.llm.bpe import codec, default_path

    c = codec(default_path())
    end = c.special_id("<|endoftext|>")
    texts = ["<|endoftext|>", "one <|endoftext|> two<|endoftext|><|endoftext|>", "", "three"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    files = token_counts.write_token_files(docs, default_path(), end)
    counts = token_counts.count_tokens(files.select("file", "block", "ids"), end, np.dtype(c.kind).itemsize)
    assert [r.n_tokens for r in counts.orderBy("file", "document").collect()] == [len(c.encode(t)) for t in texts]


def test_chat_rotation(spark):
    rows = [(1, 0, "system", "S", 0), (1, 1, "ann", "hi", 0), (1, 2, "bob", None, 0), (1, 3, "ann", "bye", 0), (2, 0, "system", "x", 0), (3, 0, None, "", 0), (None, 0, "ann", "z", 0), (1, 3, "ann", "bye", 0)]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, parts int")
    out = {(r.conv_id, r.speaker): r for r in chat_format.rotate(frame).collect()}
    assert set(out) == {(1, "ann"), (1, "bob"), (3, "unknown")}
    ann = out[1, "ann"]
    assert [ann.text[a:b] for a, b in ann.mask] == ["hi<|im_end|>\n", "bye<|im_end|>\n", "bye<|im_end|>\n"]
    assert "<|im_start|>user name=bob\n<|im_end|>" in ann.text and ann.text.startswith("<|im_start|>system\nS<|im_end|>\n")
    assert [out[1, "bob"].text[a:b] for a, b in out[1, "bob"].mask] == ["<|im_end|>\n"]


def test_components(spark):
    rng = random.Random(6)
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, x) for x in range(101, 140)] + [(200 + rng.randrange(50), 200 + rng.randrange(50)) for _ in range(40)] + [(None, 3), (5, 5)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        if a is not None:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    want = {x: find(x) for x in root if find(x) != x}
    got = graph.components(spark.createDataFrame(edges, "a long, b long"))
    assert {r.node: r.root for r in got.collect()} == want


def test_pipeline_stages(spark, sf):
    import corpus_pipeline as p

    columns = ["doc_id", "text", "lang", "source", "n_chars"]
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    before = docs.count()
    for name, stage in p.STAGES[:-1]:
        docs = stage(spark, docs, sf)
        assert docs.columns == columns, name
        docs = p.common.written(docs, "test")
        assert 0.5 * before < docs.count() <= before
    out = p.STAGES[-1][1](spark, docs, sf)
    assert out.count() == docs.count() and set(out.columns) > {"doc_id", "ids"}
    assert p.drop_near_duplicates(spark, docs.limit(0), sf).count() == 0
    # nothing is left to do on what the stages kept
    assert p.drop_contaminated(spark, docs, sf).count() == docs.count()
