"""Operators on texts against brute force, with nulls, empty and long texts, repeated rows and clashing columns."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from roboframe.llm import benchmark_decontamination as bd
from roboframe.llm import ngram_jaccard_join as nj
from roboframe.llm import suffix_array_dedup as sd
from roboframe.llm.bpe import Codec, default_path, encode_documents

SCHEMA = "doc_id long, text string, key string, kept int, size int, row int, label string"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "k", 1, 2, 3, "x") for i, t in rows], SCHEMA).repartition(3)


def lower(x):
    return re.sub("[A-Z]", lambda m: m[0].lower(), x)


def shingles(x):
    w = re.findall(r"[^\x20\x09-\x0D]+", lower(x or ""))
    return {tuple(w[j : j + 5]) for j in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def components(rows, percent=80):
    sets = [(i, shingles(t)) for i, t in rows]
    root = {i: i for i, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, (i, s) in enumerate(sets):
        for j, t in sets[:a]:
            if s and t and 100 * len(s & t) >= percent * len(s | t):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return Counter((i, len(s), find(i)) for i, s in sets)


def got_components(spark, rows):
    return Counter(tuple(r) for r in nj.jaccard_components(frame(spark, rows)).collect())


def corpus(seed, n, words=40, base=60):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(300)]
    passage = [rng.choice(vocabulary) for _ in range(40)]
    bases = [[rng.choice(vocabulary) for _ in range(rng.randint(4, base))] for _ in range(6)]
    rows = []
    for i in range(n):
        w = list(rng.choice(bases)) if rng.random() < 0.7 else [rng.choice(vocabulary) for _ in range(rng.randint(0, words))]
        for _ in range(rng.randint(0, 3)):
            if w:
                w[rng.randrange(len(w))] = rng.choice(vocabulary)
        if rng.random() < 0.5:
            w = w[:8] + passage
        rows.append((i, rng.choice([" ", "\n", "\t "]).join(w).title()))
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_jaccard_components_match_brute_force(spark, seed):
    rows = corpus(seed, 150)
    assert got_components(spark, rows) == components(rows)


def test_jaccard_edges(spark):
    rows = [(1, None), (2, ""), (3, " \n"), (4, "a b"), (5, "A  b"), (6, "a b c"), (7, "x y z u v w"), (8, "x y z u v w"), (9, "Ä b c d e"), (10, "ä b c d e")]
    assert got_components(spark, rows) == components(rows)
    assert got_components(spark, []) == Counter()


def test_jaccard_repeated_rows_and_null_ids(spark):
    rows = [(3, "a b c d e f"), (3, "a b c d e f"), (5, "a b c d e f"), (None, "a b c d e f")]
    assert got_components(spark, rows) == Counter({(3, 2, 3): 2, (5, 2, 3): 1})


def rows_of_joins(spark, after):
    """Rows that each join of the runs after that one made."""
    store, out = spark._jsparkSession.sharedState().statusStore(), []
    runs = store.executionsList()
    for run in (r for r in (runs.apply(i).executionId() for i in range(runs.size())) if r > after):
        values, nodes = store.executionMetrics(run), store.planGraph(run).allNodes()
        for node in (x for x in (nodes.apply(i) for i in range(nodes.size())) if "Join" in x.name()):
            metrics = node.metrics()
            for m in (metrics.apply(i) for i in range(metrics.size())):
                if m.name() == "number of output rows" and values.contains(m.accumulatorId()):
                    out.append(int(values.apply(m.accumulatorId()).replace(",", "")))
    return out


def test_pairs_that_share_many_signatures_are_a_row_each(spark):
    """All pairs share signatures by the dozen, and all fall short of the threshold but two."""
    rng, rows = random.Random(8), []
    for i in range(40):
        w = [f"w{j}" for j in range(400)]
        for p in rng.sample(range(400), 8):
            w[p] = f"x{i}_{p}"
        rows.append((i, " ".join(w)))
    rows += [(i + 50, t.rsplit(" ", 20)[0]) for i, t in rows[:2]]
    runs = spark._jsparkSession.sharedState().statusStore().executionsList()
    after = max((runs.apply(i).executionId() for i in range(runs.size())), default=-1)
    assert got_components(spark, rows) == components(rows)
    made = rows_of_joins(spark, after)
    pairs = len(rows) * (len(rows) - 1) // 2
    assert made and max(made) < 15 * pairs


def test_signatures_of_similar_sets_meet():
    import numpy as np

    rng = np.random.default_rng(5)
    for size in (4, 5, 9, 17, 31, 40, 60, 130, 400, 1000):
        for _ in range(40):
            a = np.unique(rng.integers(0, 2**63, size, dtype=np.uint64))
            drop = rng.integers(0, max(1, int(0.1 * len(a)) + 1))
            b = np.unique(np.concatenate((rng.permutation(a)[drop:], rng.integers(0, 2**63, drop, dtype=np.uint64))))
            both = len(np.intersect1d(a, b))
            if 100 * both >= 80 * (len(a) + len(b) - both):
                x, of = nj.signatures(np.concatenate((a, b)), np.repeat([0, 1], [len(a), len(b)]), np.array([len(a), len(b)]), 80)
                assert len(np.intersect1d(x[of == 0], x[of == 1]))
    # no more than the subsets of all parts, twice, and some repeats
    x, _ = nj.signatures(rng.integers(0, 2**63, 400, dtype=np.uint64), np.zeros(400, dtype=np.int64), np.array([400]), 80)
    assert len(x) < 1.2 * 2 * 3 * (88 // 2 + 1 + 8)


def removed(rows, length):
    raws = [(i, (t or "").encode()) for i, t in rows]
    seen = Counter(r[p : p + length] for _, r in raws for p in range(len(r) - length + 1))
    out = Counter()
    for i, r in raws:
        gone = bytearray(len(r))
        for p in range(len(r) - length + 1):
            if seen[r[p : p + length]] > 1:
                gone[p : p + length] = b"\1" * length
        kept = bytes(b for b, g in zip(r, gone, strict=True) if not g)
        spans = sum(1 for j in range(len(r)) if gone[j] and (j == 0 or not gone[j - 1]))
        out[i, len(r), sum(gone), spans, hashlib.sha256(kept).hexdigest()] += 1
    return out


def got_removed(spark, rows, length=400, core=200):
    out = sd.remove_repeats(frame(spark, rows), length, core)
    return Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in out.collect())


def test_suffix_dedup_matches_brute_force(spark):
    rng = random.Random(4)
    text = lambda n: "".join(rng.choice("abcdeé \n") for _ in range(n))
    passage, long_ = text(150), text(1500)
    rows = [(0, None), (1, ""), (2, "short"), (3, "a" * 900), (4, long_), (5, long_[:700] + text(50) + long_[750:]), (6, text(60) + passage + text(90))]
    rows += [(i, text(rng.randint(0, 80)) + passage + text(rng.randint(0, 80))) for i in range(7, 30)]
    rows += [(40, "same" * 60), (40, "same" * 60), (41, text(300)), (None, long_[100:400])]
    for length, core in ((400, 200), (100, 50), (60, 31)):
        assert got_removed(spark, rows, length, core) == removed(rows, length)
    assert got_removed(spark, []) == Counter()


def test_suffix_dedup_of_one_hot_passage(spark):
    """Many texts share a passage shorter than the window with other surroundings: one core, many contexts."""
    rng = random.Random(9)
    text = lambda n: "".join(rng.choice("abcdefghij ") for _ in range(n))
    passage, tails = text(90), [text(40) for _ in range(5)]
    rows = [(i, text(30) + passage + rng.choice(tails) + text(20)) for i in range(120)]
    assert got_removed(spark, rows, 100, 50) == removed(rows, 100)


@pytest.mark.parametrize("parts", [1, 6, 20])
def test_suffix_dedup_over_many_boundaries(spark, parts):
    """Windows of one hot passage and of whole copies lie in many buckets; some end where a bucket ends."""
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    try:
        rng = random.Random(parts)
        text = lambda n: "".join(rng.choice("abcd ") for _ in range(n))
        passage, heads, tails = text(95), [text(30) for _ in range(3)], [text(30) for _ in range(3)]
        rows = [(i, text(rng.randint(0, 20)) + rng.choice(heads)[-rng.randint(0, 30) :] + passage + rng.choice(tails)[: rng.randint(0, 30)] + text(rng.randint(0, 20))) for i in range(150)]
        rows += [(200 + i, rows[i % 4][1]) for i in range(20)] + [(300, "\0" * 250), (301, "\0" * 130 + "a")]
        assert got_removed(spark, rows, 100, 50) == removed(rows, 100)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_suffixes_of_a_hot_passage_fill_many_buckets(spark, monkeypatch):
    """A passage of 300 bytes in all texts, with surroundings of their own: no bucket grows with the number of texts."""
    rng = random.Random(1)
    text = lambda n: "".join(rng.choice("abcdefghijklmnop ") for _ in range(n))
    passage, ranges, sizes = text(300), sd.in_ranges, []

    def watched(suffixes, buckets):
        out = ranges(suffixes, 16)
        sizes.append(sorted(r["count"] for r in out.groupBy(F.spark_partition_id()).count().collect()))
        return out

    monkeypatch.setattr(sd, "in_ranges", watched)
    for n in (1000, 2000):
        rows = [(i, text(250) + passage + text(250)) for i in range(n)]
        assert sd.remove_repeats(frame(spark, rows)).where("n_removed > 0").count() == 0
    for n, s in zip((1000, 2000), sizes, strict=True):
        assert sum(s) > n / 5 and s[-1] < sum(s) / 5, sizes


def test_suffix_dedup_of_a_batch_without_rest(spark):
    """Every row of a batch loses something."""
    rows = [(i, "the same text " * 40) for i in range(8)]
    assert got_removed(spark, rows) == removed(rows, 400)


def test_suffix_dedup_across_buckets(spark):
    """A hot passage fills several buckets; windows that reach over its ends repeat in some texts only. Zero bytes too."""
    rng = random.Random(13)
    text = lambda n: "".join(rng.choice("ab\0 ") for _ in range(n))
    passage, heads, tails = text(80), [text(30) for _ in range(6)], [text(30) for _ in range(6)]
    rows = [(i, text(25) + rng.choice(heads) + passage + rng.choice(tails) + text(25)) for i in range(150)]
    rows += [(200 + i, text(40) + heads[0][15:] + passage + text(40)) for i in range(20)]
    assert got_removed(spark, rows, 100, 50) == removed(rows, 100)


def test_suffix_dedup_of_long_texts(spark, monkeypatch):
    """Texts longer than what a worker takes at once."""
    monkeypatch.setattr(sd.common, "SLICE_CHARS", 2000)
    rng = random.Random(14)
    text = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    long_ = text(9000)
    rows = [(1, long_), (2, text(5000) + long_[3000:3700] + text(5000)), (3, long_[:8999]), (4, text(300))]
    assert got_removed(spark, rows) == removed(rows, 400)


def covered(rows, length):
    """For each row the bytes that a string which starts elsewhere too covers, and the runs of these."""
    return Counter((i, gone, spans) for (i, _, gone, spans, _), k in removed(rows, length).items() for _ in range(k))


@pytest.mark.parametrize("parts", [1, 6, 20])
def test_suffix_dedup_of_two_lengths(spark, parts):
    """Strings of a shorter length are told beside the others, each length as by itself."""
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    try:
        rng = random.Random(30 + parts)
        text = lambda n: "".join(rng.choice("abcd\0é ") for _ in range(n))
        passage, heads, tails = text(70), [text(30) for _ in range(3)], [text(30) for _ in range(3)]
        rows = [(i, text(rng.randint(0, 20)) + rng.choice(heads)[-rng.randint(1, 30) :] + passage + rng.choice(tails)[: rng.randint(0, 30)] + text(rng.randint(0, 20))) for i in range(120)]
        rows += [(200 + i, rows[i % 4][1]) for i in range(20)] + [(300, "\0" * 250), (301, "\0" * 130 + "a"), (302, None), (303, ""), (304, text(59)), (None, text(80))]
        for length, core, shorter in ((100, 30, 60), (100, 50, 99), (150, 20, 31), (400, 30, 60)):
            out = sd.remove_repeats(frame(spark, rows), length, core, shorter=shorter, with_bytes=False).collect()
            assert Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in out) == removed(rows, length)
            assert Counter((r.doc_id, r.n_passage_bytes, r.n_passages) for r in out) == covered(rows, shorter)
            assert all(r.kept is None and (r.rest is None) == (r.doc_id == 302) for r in out)
            texts = dict(rows)
            assert all(r.rest == texts[r.doc_id] for r in out if not r.n_passages)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_op9_tells_passages_of_over_50_words(spark, tmp_path):
    """A passage of 52 words that two texts share has fewer than 400 bytes: the contract's columns leave it, those of passages
    tell it, and a text of its own keeps all."""
    rng = random.Random(31)
    words = lambda n: " ".join("".join(rng.choice("abcdefghijklmnop") for _ in range(5)) for _ in range(n))
    passage = words(52)
    rows = [(1, f"{words(90)} {passage} {words(30)}"), (2, f"{words(10)} {passage} {words(80)}"), (3, words(120)), (4, None)]
    frame(spark, rows).select("doc_id", "text").write.parquet(f"{tmp_path}/documents.parquet")
    out = sd.op9_suffix_array_dedup(spark, str(tmp_path))
    assert out.columns == ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "n_passage_bytes", "n_passages", "text"]
    got = {r.doc_id: r for r in out.collect()}
    assert {(i, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for i, r in got.items()} == set(removed(rows, 400))
    assert {i: r.n_removed for i, r in got.items()} == dict.fromkeys((1, 2, 3, 4), 0)
    assert {(i, r.n_passage_bytes, r.n_passages) for i, r in got.items()} == set(covered(rows, 240))
    assert [got[i].n_passages for i in (1, 2, 3, 4)] == [1, 1, 0, 0] and got[1].n_passage_bytes >= len(passage)
    assert all(passage not in got[i].text for i in (1, 2)) and got[3].text == rows[2][1] and got[4].text is None


def test_multikey_sort():
    import numpy as np

    rng = random.Random(1)
    strings = [bytes(rng.choice(b"\0ab") for _ in range(rng.choice([0, 3, 9, 20]))).rstrip(b"\0") for _ in range(400)]
    order, same = sd.multikey_sort(sd.words_of(strings, 21))
    padded = [strings[i].ljust(24, b"\0") for i in order]
    assert padded == sorted(padded)
    for k in range(1, len(padded)):
        n = next((j for j in range(24) if padded[k][j] != padded[k - 1][j]), 24)
        assert same[k] == n
    order, same = sd.multikey_sort(np.zeros((0, 3), dtype=np.uint64))
    assert len(order) == len(same) == 0


WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def contamination(rows, items, width=10):
    windows = defaultdict(set)
    for item, t in items:
        w = WORD.findall(lower(t or ""))
        m = min(width, len(w))
        for j in range(len(w) - m + 1 if m else 0):
            windows[tuple(w[j : j + m])].add(item)
    out = Counter()
    for i, t in rows:
        w, hit, found = WORD.findall(lower(t or "")), set(), set()
        for m in {len(x) for x in windows}:
            for j in range(len(w) - m + 1):
                if (x := tuple(w[j : j + m])) in windows:
                    hit |= set(range(j, j + m))
                    found |= {str(y) for y in windows[x] if y is not None}
        out[i, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)] += 1
    return out


@pytest.mark.parametrize("per_pass", [100_000, 7])
def test_decontamination_matches_brute_force(spark, monkeypatch, per_pass):
    monkeypatch.setattr(bd, "PATTERNS_PER_PASS", per_pass)
    rng = random.Random(3)
    text = lambda n: " ".join(rng.choice(["a", "b", "Cé", "d1", "e-f"]) for _ in range(n))
    items = [(i, text(rng.choice([1, 3, 9, 10, 14]))) for i in range(9)] + [(20, None), (21, "--"), (None, text(11)), (5, "zz yy")]
    rows = [(i, text(rng.randint(0, 60))) for i in range(60)] + [(100, items[4][1] + ", x " + items[5][1]), (101, None), (102, ""), (103, "zz YY!"), (103, "zz YY!")]
    bench = spark.createDataFrame([(i, t, 0) for i, t in items], "item_id long, text string, length int")
    out = bd.decontaminate(frame(spark, rows), bench)
    assert Counter(tuple(r)[:6] for r in out.collect()) == contamination(rows, items)


def test_decontamination_of_long_texts(spark, monkeypatch):
    """A text above the slice size, hits of several passes that touch and overlap, and repeated rows without an id."""
    rng = random.Random(23)
    text = lambda n: " ".join(rng.choice("abcdefgh") + str(rng.randrange(30)) for _ in range(n))
    items = [(i, text(25)) for i in range(6)]
    long_ = text(200_000)
    rows = [(1, long_ + " " + items[0][1]), (2, items[1][1] + " " + items[2][1]), (None, items[3][1]), (None, items[3][1]), (4, text(50))]
    bench = spark.createDataFrame(items, "item_id long, text string")
    for per_pass in (100_000, 20):
        monkeypatch.setattr(bd, "PATTERNS_PER_PASS", per_pass)
        out = bd.decontaminate(frame(spark, rows), bench)
        assert Counter(tuple(r)[:6] for r in out.collect()) == contamination(rows, items)


def test_decontamination_with_empty_tables(spark):
    bench = spark.createDataFrame([], "item_id long, text string")
    assert not bd.decontaminate(frame(spark, [(1, "a b")]), bench).first().contaminated
    assert bd.decontaminate(frame(spark, []), bench).count() == 0


def encoded(rows):
    from tokenizers import Tokenizer

    t, out = Tokenizer.from_file(default_path()), Counter()
    for i, x in rows:
        ids = t.encode(x or "", add_special_tokens=False).ids
        text = t.decode(ids, skip_special_tokens=False)
        out[i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()] += 1
    return out


def test_bpe_matches_the_library(spark):
    rng = random.Random(8)
    prose = lambda n: " ".join(rng.choice(["the", "l'été", "straße", "can't", "42", "—", "日本", "x  y", "\n\n", "<|endoftext|>", "!!!"]) for _ in range(n))
    shared = [prose(900) for _ in range(4)]
    rows = [(i, prose(rng.randint(0, 200)) + rng.choice(["", " ", "x"]) + rng.choice(shared) + rng.choice(["", "  ", "y"]) + prose(30)) for i in range(40)]
    rows += [(50, None), (51, ""), (52, "a" * 5000), (53, " " * 3000), (54, shared[0]), (54, shared[0]), (None, shared[1]), (55, "😀é" * 700)]
    out = encode_documents(frame(spark, rows), default_path(), carry=("label",))
    assert Counter((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in out.collect()) == encoded(rows)
    assert encode_documents(frame(spark, []), default_path()).count() == 0


def test_bpe_of_another_file_and_long_texts(spark, tmp_path, monkeypatch):
    """A file that does not split into words: cuts between words are no longer sure, and joins grow until they agree."""
    import json

    from tokenizers import Tokenizer

    from roboframe.llm import bpe

    with open(default_path(), encoding="utf-8") as f:
        spec = json.load(f)
    spec["pre_tokenizer"] |= {"use_regex": False}
    path = str(tmp_path / "own.json")
    (tmp_path / "own.json").write_text(json.dumps(spec))
    rng = random.Random(18)
    prose = lambda n: "".join(rng.choice(["the ", "to", ". A", "x  y ", "42 a", ", and", "é "]) for _ in range(n))
    shared = [prose(900) for _ in range(3)]
    rows = [(i, prose(rng.randint(0, 90)) + rng.choice(shared) + prose(30)) for i in range(12)] + [(20, prose(60_000) + shared[0])]
    t, want = Tokenizer.from_file(path), Counter()
    for i, x in rows:
        want[i, hashlib.sha256(",".join(map(str, t.encode(x, add_special_tokens=False).ids)).encode()).hexdigest()] += 1
    out = encode_documents(frame(spark, rows), path)
    assert Counter((r.doc_id, r.ids_sha256) for r in out.collect()) == want
    # the library's file, with a text above QUICK_CHARS and above the slice size
    rows = [(1, prose(60_000) + shared[1]), (2, shared[1] + prose(160_000)), (3, shared[1])]
    out = encode_documents(frame(spark, rows), default_path())
    assert Counter((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in out.collect()) == encoded(rows)
    with pytest.raises(ValueError):
        bpe.Codec(default_path().replace("byte_bpe_50k", "word_bpe_49k"))


def test_quick_encoder_agrees_with_the_library():
    rng, c = random.Random(1), Codec(default_path())
    letters = [chr(i) for i in range(1, 0x250)] + [" "] * 200 + ["\n"] * 40 + list("abcde'st") * 20 + ["<|endoftext|>"] * 5
    for _ in range(3000):
        s = "".join(rng.choice(letters) for _ in range(rng.randint(1, 40)))
        assert list(c.encode(s)) == c.slow.encode(s, add_special_tokens=False).ids
        assert c.decode(c.encode(s)) == s
