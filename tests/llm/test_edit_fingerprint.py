"""Fingerprints by a randomised edit embedding, against a walk place by place."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from roboframe.llm import edit_fingerprint as ef
from roboframe.llm.common import mix
from roboframe.llm.queries import QUERIES

DOCS = "doc_id long, text string, lang string, id int, k int, h int, at int, extra int, fingerprint int"


def tape(text, walk):
    """What a text writes: a place at a time, one coin for each."""
    out, i, j = [], 0, 0
    while i < len(text):
        c = int(mix(np.array([ord(text[i])], dtype=np.uint64), 5)[0] >> np.uint64(56))
        out.append(text[i])
        place = j % ef.TAPE
        coin = place % (ef.TAPE // 64) == 0 or int(mix(np.array([c * ef.TAPE + place], dtype=np.uint64), 100 + walk)[0]) & 1
        i, j = i + coin, j + 1
    return "".join(out)


def letters(written):
    names = [ef.LETTERS[int(mix(np.array([ord(written[p])], dtype=np.uint64), 6)[0] >> np.uint64(58))] for p in ef.AT if p < len(written)]
    return "".join(names).encode()


def prose(rng, n):
    return " ".join("".join(rng.choice("etaoinshrdlcéüß") for _ in range(rng.randint(2, 9))) for _ in range(n))


def edited(rng, text, times):
    for _ in range(times):
        i = rng.randrange(len(text))
        text = text[:i] + rng.choice(["", "x", "the "]) + text[i + rng.choice([0, 1]) :]
    return text


@pytest.mark.parametrize(("few", "piece"), [(80, 1 << 20), (0, 7), (3, 50)])
def test_walks_place_by_place(monkeypatch, few, piece):
    monkeypatch.setattr(ef, "FEW", few)
    monkeypatch.setattr(ef, "PIECE", piece)
    rng = random.Random(2)
    texts = ["", "a", "é日", "\U0001f600" * 9, prose(rng, 60), "", prose(rng, 8), " " * 300, prose(rng, 30), "ab"]
    for text, walks in zip(texts, ef.walked(texts), strict=True):
        assert walks == [letters(tape(text, w)) for w in range(ef.WALKS)]


def test_likeness_estimates_the_shared_tape():
    rng = random.Random(3)
    for n in (1, 40, 900):
        a, b = prose(rng, n), prose(rng, n)
        half = a[: len(a) // 2] + b
        for x, y in ((a, a), (a, b), (a, half), (a, edited(rng, a, 1 + n // 50))):
            p, q = tape(x, 0), tape(y, 0)
            true = sum(u == v for u, v in zip(p, q, strict=False)) / max(len(p), len(q))
            assert abs(ef.likeness([letters(p)], [letters(q)]) - true) < 0.15
    assert ef.likeness([b"", b""], [b"", b""]) == 1 and ef.likeness([b"", b""], [b"a", b"a"]) == 0


def brute_order(docs):
    """Indices of docs in the operator's order, texts of equal doc_ids by their hash."""
    from pyspark.sql import SparkSession

    spark = SparkSession.getActiveSession()
    hashes = [r[0] for r in spark.createDataFrame([(i, d[1] or "") for i, d in enumerate(docs)], "i int, t string").orderBy("i").select(F.xxhash64("t")).collect()]
    return sorted(range(len(docs)), key=lambda i: (docs[i][0] is None, -(docs[i][0] or 0), hashes[i]))


@pytest.mark.parametrize("rows", [4000, 2])
def test_edited_texts_and_their_fingerprints(spark, monkeypatch, rows):
    monkeypatch.setattr(ef, "ROWS", rows)
    rng = random.Random(rows)
    docs = [(i, prose(rng, rng.choice([0, 1, 2, 30, 90])), "en", 1, 2, 3, 4, 5, 6) for i in rng.sample(range(-500, 500), 60)]
    docs += [(docs[3][0], "again é", None, 1, 2, 3, 4, 5, 6), (docs[3][0], "and again", None, 1, 2, 3, 4, 5, 6), docs[4], docs[4]]
    docs += [(None, None, None, 1, 2, 3, 4, 5, 6), (None, "nameless 日本語", "en", 1, 2, 3, 4, 5, 6), (2**62 + 1, "far", "en", 1, 2, 3, 4, 5, 6), (-(2**63), "low", "en", 1, 2, 3, 4, 5, 6), (2**63 - 1, "tip", "en", 1, 2, 3, 4, 5, 6), (800, None, "en", 1, 2, 3, 4, 5, 6)]
    order = brute_order(docs)
    want = []
    for at, i in enumerate(order):
        text, after = docs[i][1] or "", docs[order[(at + 1) % len(order)]][1] or ""
        k = len(text) // 3
        new = text[: len(text) - k] + after[:k]
        own, other, following = ([letters(tape(x, w)) for w in range(ef.WALKS)] for x in (text, new, after))
        want.append((docs[i][0], len(text), hashlib.sha256(new.encode()).hexdigest(), ef.named(own), ef.named(other), ef.likeness(own, other), ef.likeness(own, following)))
    frame = spark.createDataFrame(docs, DOCS).repartition(5)
    out = ef.edited_fingerprints(frame)
    assert out.columns[:7] == ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    key = lambda r: tuple((x is None, x or 0) if isinstance(x, int | None) else x for x in r)
    assert sorted((tuple(r)[:7] for r in out.collect()), key=key) == sorted(want, key=key)
    assert ef.edited_fingerprints(frame.limit(0)).count() == 0
    one = ef.edited_fingerprints(spark.createDataFrame([(4, "abcdef")], "doc_id long, text string")).first()
    assert one["edited_sha256"] == hashlib.sha256(b"abcdab").hexdigest() and one["near_next"] == 1


def test_near_texts(spark):
    """Edited copies are found, copies stay together, others stay alone."""
    rng = random.Random(8)
    texts = [prose(rng, 150) for _ in range(30)]
    rows = [(i, t) for i, t in enumerate(texts)]
    rows += [(100 + i, edited(rng, t, 3)) for i, t in enumerate(texts[:20])]
    rows += [(200 + i, texts[5]) for i in range(40)] + [(300, None), (301, ""), (None, texts[1]), (302, "a"), (303, "b")]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = dict(tuple(r) for r in ef.near_texts(frame).collect())
    assert set(got) == {i for i, _ in rows if i is not None}
    assert all(got[i] == i for i in [*range(30), 300, 301, 302, 303])
    assert all(got[200 + i] == 5 for i in range(40))
    assert sum(got[100 + i] == i for i in range(20)) >= 16
    assert all(got[100 + i] in (i, 100 + i) for i in range(20))
    assert ef.near_texts(frame.limit(0)).count() == 0


def test_fingerprint_query(spark, sf):
    out = QUERIES["op12_edit_fingerprint"](spark, sf)
    texts = dict(tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect())
    rows, ids = {r["doc_id"]: r for r in out.collect()}, sorted(texts, reverse=True)
    assert set(rows) == set(texts)
    for i, j in zip(ids, [*ids[1:], ids[0]], strict=True):
        k = len(texts[i]) // 3
        assert rows[i]["edited_sha256"] == hashlib.sha256((texts[i][: len(texts[i]) - k] + texts[j][:k]).encode()).hexdigest()
        assert rows[i]["n_chars"] == len(texts[i])
        if texts[i] == texts[j]:
            assert rows[i]["near_next"] == 1
    near = np.array([(r["near_edited"], r["near_next"]) for r in rows.values() if r["n_chars"] > 30])
    assert near[:, 0].min() > 0.5 and (near[:, 0] >= near[:, 1]).mean() > 0.97
