"""Filter audit and importance resampling against plain versions."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter
from itertools import permutations

import numpy as np
import pytest

from roboframe.llm import filter_audit, importance_resampling as resampling
from roboframe.llm.queries import ORACLE_SQL, QUERIES

DOCS = "doc_id long, text string, lang string, mask int, part string, score long, tie int"


def audit_rows(docs, labels):
    good, toxic = ({i for i, *x in labels if x[k] == 1 and i is not None} for k in (0, 1))
    marked = []
    for i, text, lang, *_ in docs:
        text = text or ""
        words = re.findall("[^\x20\x09-\x0d]+", text)
        fails = ""
        fails += "A" * (len(words) < 100) + "B" * (100 * len(set(words)) < 80 * len(words))
        fails += "C" * (100 * len(re.findall("[A-Z]", text)) > 10 * len(text)) + "D" * bool(re.search("[#$%&*|]", text))
        fails += "E" * any(i is not None and j is not None and j < i and (other or "") == text for j, other, *_ in docs)
        marked.append((lang or "", fails, i in good, i in toxic))
    out = {}
    for part in {m[0] for m in marked}:
        mine, shapley = [m for m in marked if m[0] == part], Counter()
        rows = {}
        for order in map("".join, permutations("ABCDE")):
            left = mine
            for step, f in enumerate(order, 1):
                gone = [m for m in left if f in m[1]]
                left = [m for m in left if f not in m[1]]
                shapley[f] += len(gone)
                failing = sum(f in m[1] for m in mine)
                alone = sum(m[1] == f for m in mine)
                rows[order, step] = (len(left), len(gone), failing - len(gone), alone, sum(m[2] for m in gone), sum(m[3] for m in gone))
        for (order, step), row in rows.items():
            out[part, order, step] = (*row, shapley[order[step - 1]])
    return out


@pytest.fixture(scope="module")
def tables(spark):
    rng = random.Random(5)
    docs = []
    for i in range(150):
        words = [rng.choice(["AA", "bé", "c#", "x y", "dd", "\x1ck"]) + str(rng.randrange(2000)) * rng.choice([0, 1, 1]) for _ in range(rng.choice([0, 3, 99, 100, 140]))]
        docs.append((rng.randrange(-50, 400), rng.choice([" ", "\n", "\x0b"]).join(words), rng.choice(["en", "fr", None, ""]), 1, "p", 2, 3))
    docs += [(rng.randrange(500), d[1], d[2], 1, "p", 2, 3) for d in docs[:40]]
    docs += docs[:5] + [(None, docs[7][1], "en", 1, "p", 2, 3), (None, None, None, 1, "p", 2, 3), (3, None, "de", 1, "p", 2, 3), (4, "", "de", 1, "p", 2, 3), (9, "Z" * 9000 + " #" * 300, "en", 1, "p", 2, 3)]
    labels = [(rng.randrange(-50, 500), rng.choice([0, 1, None, 2]), rng.choice([0, 1, None])) for _ in range(300)] + [(None, 1, 1)]
    return docs, labels


def test_audit_matches_brute_force(spark, tables):
    docs, labels = tables
    frame = spark.createDataFrame(docs, DOCS).repartition(3)
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    names = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    counts = filter_audit.mask_counts(filter_audit.with_marks(filter_audit.failures(frame), marks), "E")
    out = filter_audit.audit(counts, "ABCDE").collect()
    assert len(out) == 600 * len({d[2] or "" for d in docs})
    assert {(r["part"], r["filter_order"], r["step"]): tuple(r[c] for c in names) for r in out} == audit_rows(docs, labels)
    empty = filter_audit.with_marks(filter_audit.failures(frame.limit(0)), marks.limit(0))
    assert filter_audit.audit(filter_audit.mask_counts(empty, "E"), "ABCDE").count() == 0


def test_audit_of_other_filters(spark):
    """Two filters of one's own, whose masks come from anywhere."""
    rows = spark.createDataFrame([(1, "p", b"1", 3, 1, 0), (2, "p", b"2", 1, 0, 1), (3, "p", b"3", 0, 1, 0)], "doc_id long, part string, digest binary, mask int, good int, toxic int")
    out = {(r["filter_order"], r["step"]): tuple(r)[3:] for r in filter_audit.audit(filter_audit.mask_counts(rows), "xy").collect()}
    assert out == {("xy", 1): (1, 2, 0, 1, 1, 1, 3), ("xy", 2): (1, 0, 1, 0, 0, 0, 1), ("yx", 1): (2, 1, 0, 0, 1, 0, 1), ("yx", 2): (1, 1, 1, 1, 0, 1, 3)}
    with pytest.raises(ValueError, match="letters"):
        filter_audit.audit(rows, "ABCDEFGH")


def test_removal_ranks():
    orders, position = filter_audit.positions(4)
    fails = np.array([[0, 0, 0, 0], [1, 0, 1, 0], [1, 1, 1, 1]], dtype=bool)
    rank = filter_audit.removal_ranks(fails, position)
    for m, row in enumerate(fails):
        for p, order in enumerate(orders):
            assert rank[m, p] == next((s for s, f in enumerate(order, 1) if row[f]), 5)


def test_audit_query_equals_sql(spark, sf):
    import duckdb

    duck = duckdb.connect()
    for t in ("documents", "labels"):
        duck.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    result = duck.execute(ORACLE_SQL["op11_filter_audit"])
    names = [d[0] for d in result.description]
    frame = QUERIES["op11_filter_audit"](spark, sf)
    assert sorted(names) == sorted(frame.columns)
    assert Counter(tuple(r[c] for c in names) for r in frame.collect()) == Counter(result.fetchall())


WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def plain_features(text):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return words, [zlib.crc32(x.encode()) % 10_000 for x in words + [f"{a} {b}" for a, b in zip(words, words[1:])]]


def plain_resample(docs, target, percent=25):
    s, t = (Counter(b for text in texts for b in plain_features(text)[1]) for texts in ([d[1] for d in docs], target))
    s_all, t_all = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (s_all + 10_000) / ((s[b] + 1) * (t_all + 10_000)))) for b in range(10_000)]
    rows = []
    for i, text, *_ in docs:
        words, buckets = plain_features(text)
        weight = sum(gain[b] for b in buckets) // len(buckets) if buckets else 0
        score = None
        if i is not None:
            h = int(hashlib.sha256(f"7:{i}".encode()).hexdigest()[:8], 16)
            score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        rows.append([i, len(buckets), weight, score, None, len(words)])
    able = sorted((r for r in rows if r[5] >= 20 and r[3] is not None), key=lambda r: (-r[3], r[0]))
    for k, r in enumerate(able[: percent * len(able) // 100], 1):
        r[4] = k
    return Counter(tuple(r[:5]) for r in rows)


@pytest.mark.parametrize("few", [4096, 3])
def test_resampling_matches_brute_force(spark, monkeypatch, few):
    monkeypatch.setattr(resampling, "FEW", few)
    rng = random.Random(few)
    vocabulary = ["the", "The", "été", "a1", "ÀB", "x" * 64, "y" * 65, "z" * 300, "née-q", "日本", "e_f", "İ"]
    text = lambda: rng.choice([" ", ", ", "\n"]).join(rng.choice(vocabulary) for _ in range(rng.choice([0, 1, 19, 20, 21, 60])))
    docs = [(i, text(), "en", 1, "p", 2, 3) for i in range(-100, 260)]
    docs += [(5, docs[105][1], "en", 1, "p", 2, 3), (6, text(), "en", 1, "p", 2, 3), (700, None, None, 1, "p", 2, 3), (701, "", None, 1, "p", 2, 3)]
    docs += [(None, " ".join(vocabulary * 3), None, 1, "p", 2, 3), (702, "w " * 400_000, "en", 1, "p", 2, 3)]
    target = [text() for _ in range(9)] + [None, ""]
    frame = spark.createDataFrame(docs, DOCS).repartition(5)
    out = resampling.resample(frame, spark.createDataFrame([(t,) for t in target], "text string"))
    assert out.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    assert Counter(map(tuple, out.collect())) == plain_resample(docs, target)
    assert resampling.resample(frame.limit(0), frame.limit(0)).count() == 0
    alone = resampling.resample(frame, frame.limit(0))
    assert Counter(map(tuple, alone.collect())) == plain_resample(docs, [])


def test_cutoff_of_equal_scores(spark, monkeypatch):
    """All scores alike but for a few: the cutoff falls inside the run of equal ones."""
    monkeypatch.setattr(resampling, "FEW", 2)
    rows = [(0 if i % 7 else i, i % 11, i) for i in range(500)]
    keys = sorted((-s, d, t) for s, d, t in rows)
    frame = spark.createDataFrame(rows, "score long, doc_id long, tie long").repartition(6)
    for draw in (0, 1, 63, 250, 499, 500):
        assert resampling.cutoff(frame, draw) == (keys[draw - 1] if draw else None)


def test_resampling_query(spark, sf):
    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    target = [r[0] for r in spark.read.parquet(f"{sf}/benchmark.parquet").select("text").collect()]
    out = QUERIES["op13_importance_resampling"](spark, sf)
    assert dict(out.dtypes) == dict.fromkeys(("doc_id", "n_features", "weight", "score", "rank"), "bigint")
    assert Counter(map(tuple, out.collect())) == plain_resample(docs, target)
