"""Learned operators by held-out accuracy, and their edges."""

from pyspark.sql import functions as F

from roboframe.llm import language_id, quality_crf, toxicity_chain
from roboframe.llm.sampling import remainder

SF = "/root/testdata/sf0.01"
EDGES = [(1, None, "x", 0.5), (2, "", "x", 0.5), (3, "123 !!", "x", 0.5), (4, "\n\n", "x", 0.5), (5, "é", "x", 0.5), (5, "é", "x", 0.5), (None, "the " * 3000, "x", 0.5)]
SCHEMA = "doc_id long, text string, lang string, score double"


def tables(spark):
    return spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")


def test_remainder_is_crc32(spark):
    import zlib

    rows = spark.range(50).select("id", remainder("id", 4).alias("r")).collect()
    assert all(r.r == zlib.crc32(str(r.id).encode()) % 4 for r in rows)


def test_language_id(spark):
    out = language_id.op2_language_id(spark, SF)
    docs, _ = tables(spark)
    both = out.join(docs.select("doc_id", "lang"), "doc_id").where("held_out")
    assert both.where("lang = lang_pred").count() > 0.97 * both.count()
    assert out.where("score < 0 OR score > 1").count() == 0


def test_language_id_edges(spark):
    docs, _ = tables(spark)
    model = language_id.fit(docs.select("doc_id", "text", "lang").limit(200), 20)
    edges = spark.createDataFrame(EDGES, SCHEMA)
    rows = {r.doc_id: r for r in language_id.identify(edges, model, F.lit(False)).collect()}
    assert [rows[i].lang_pred for i in (1, 2, 3, 4)] == ["und"] * 4
    assert rows[None].lang_pred == "en" and rows[5].lang_pred != "und"
    assert {r.lang_pred for r in language_id.identify(edges, None, F.lit(False)).collect()} == {"und"}
    assert language_id.identify(edges.limit(0), model, F.lit(False)).count() == 0
    assert language_id.fit(docs.limit(0), 20) is None


def test_quality(spark):
    out = quality_crf.op3_quality_crf(spark, SF)
    _, labels = tables(spark)
    both = out.join(labels, "doc_id").where("held_out")
    assert both.where("quality = predicted").count() > 0.95 * both.count()


def test_quality_edges(spark):
    docs, labels = tables(spark)
    model = quality_crf.fit(docs, labels.select("doc_id", F.col("quality").alias("label")), 50)
    rows = quality_crf.score_quality(spark.createDataFrame(EDGES, SCHEMA), model, F.lit(None).cast("boolean")).collect()
    assert len(rows) == len(EDGES) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) and r.held_out is False for r in rows)
    empty = labels.select("doc_id", F.col("quality").alias("label")).limit(0)
    assert quality_crf.fit(docs, empty) is None


def test_marginals_match_enumeration():
    from itertools import product

    import numpy as np

    rng = np.random.default_rng(2)
    lines = np.array([3, 1, 5])
    u, pair = rng.normal(size=9), rng.normal(size=(2, 2))
    good, joint = quality_crf.marginals(u, lines, pair)
    at, total = 0, np.zeros((2, 2))
    for n in lines:
        weight, mass, both = np.zeros(n), 0.0, np.zeros((2, 2))
        for y in product((0, 1), repeat=int(n)):
            w = np.exp(sum(u[at + t] * y[t] for t in range(n)) + sum(pair[y[t], y[t + 1]] for t in range(n - 1)))
            mass += w
            weight += w * np.array(y)
            for t in range(n - 1):
                both[y[t], y[t + 1]] += w
        assert np.allclose(good[at : at + n], weight / mass)
        total += both / mass
        at += n
    assert np.allclose(joint, total)


def test_toxicity_held_out(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet").select("doc_id", F.col("toxic").alias("label"))
    model = toxicity_chain.fit(docs, labels.where("doc_id % 2 = 0"))
    out = toxicity_chain.label_toxicity(docs.where("doc_id % 2 = 1"), model).join(labels, "doc_id")
    n = {(r.label, r.is_toxic): r["count"] for r in out.groupBy("label", "is_toxic").count().collect()}
    # an eighth of the toxic marks stand on texts without any abusive term
    assert n[1, True] > 0.8 * (n[1, True] + n.get((1, False), 0))
    assert n.get((0, True), 0) < 0.01 * n[0, False]


def test_toxicity_out_of_fold(spark):
    """The chain of a small sample against the same steps in plain numpy."""
    import numpy as np

    docs, labels = tables(spark)
    labels = labels.select("doc_id", F.col("toxic").alias("label"))
    model = toxicity_chain.fit(docs, labels)
    rows = docs.where("text IS NOT NULL").join(labels, "doc_id").withColumn("fold", remainder("doc_id", toxicity_chain.FOLDS)).collect()
    rows.sort(key=lambda r: r.doc_id)
    toxic, fold = np.array([r.label == 1 for r in rows]), np.array([r.fold for r in rows])
    pairs = [toxicity_chain.term_slots([r.text])[0] for r in rows]

    def terms(fitted):
        t, n = {}, {}
        for slots, y in ((np.unique(p), y) for p, y, f in zip(pairs, toxic, fitted) if f):
            for x in slots.tolist():
                n[x] = n.get(x, 0) + 1
                t[x] = t.get(x, 0) + int(y)
        share = toxic[fitted].mean()
        best = [(-(t[x] - n[x] * share) / np.sqrt(n[x] * share + 0.5), x) for x in n if t[x] >= 3 and t[x] > 3 * n[x] * share]
        return np.array(sorted(x for _, x in sorted(best)[: toxicity_chain.TERMS]), dtype=np.int64)

    everything = np.ones(len(rows), dtype=bool)
    assert terms(everything).tolist() == model.terms.tolist()
    earlier, own = np.zeros((len(rows), 0)), [terms(fold != k) for k in range(toxicity_chain.FOLDS)] + [terms(everything)]
    x = [toxicity_chain.features(*toxicity_chain.hits_of([r.text for r in rows], t), len(t)) for t in own]
    for c, w in enumerate(model.weights):
        fit = lambda k, fitted: toxicity_chain.logistic(
            np.concatenate((x[k], earlier), axis=1)[fitted], toxicity_chain.targets(x[k], toxic, fitted)[c][fitted].astype(float)
        )
        assert np.abs(fit(toxicity_chain.FOLDS, everything) - w).max() < 0.02
        p = np.zeros(len(rows))
        for k in range(toxicity_chain.FOLDS):
            there = fold == k
            p[there] = toxicity_chain.probability(np.concatenate((x[k], earlier), axis=1)[there], fit(k, ~there))
        earlier = np.concatenate((earlier, p[:, None]), axis=1)


def test_toxicity_edges(spark):
    docs, labels = tables(spark)
    model = toxicity_chain.fit(docs, labels.select("doc_id", F.col("toxic").alias("label")))
    edges = spark.createDataFrame(EDGES, SCHEMA)
    rows = toxicity_chain.label_toxicity(edges, model, tuple(edges.columns)).collect()
    assert len(rows) == len(EDGES) and not any(r.is_toxic for r in rows)
    assert toxicity_chain.fit(docs, labels.select("doc_id", F.col("toxic").alias("label")).limit(0)) is None
    assert not any(r.is_toxic for r in toxicity_chain.label_toxicity(edges, None).collect())


def test_trigrams_of_a_text_stand_alone():
    texts = ["a", "zebra", "", "ein Haus", "é"]
    slot, counts, starts = language_id.trigrams(texts)
    for text, a, b in zip(texts, starts, starts[1:]):
        own, real, at = language_id.trigrams([text])
        n = at[1]
        assert slot[a:b].tolist() == own[:n].tolist() and counts[a:b].tolist() == real[:n].tolist()


def test_language_id_by_votes(spark):
    """Predictions of a fitted model against a plain count of its votes, text by text."""
    import numpy as np

    docs, _ = tables(spark)
    model = language_id.fit(docs.select("doc_id", "text", "lang"), 60)
    sample = docs.where("length(text) < 3000").limit(150)
    got = {r.doc_id: r for r in language_id.identify(sample, model, F.lit(False)).collect()}
    k = len(model.families)
    for r in sample.collect():
        raw = bytes(b + 32 if 65 <= b <= 90 else b for b in r.text.encode())
        raw = bytes(b if 97 <= b <= 122 or b >= 128 else 0 for b in raw) + b"\0\0\0"
        grams = [raw[i] << 16 | raw[i + 1] << 8 | raw[i + 2] for i in range(len(raw) - 2)]
        grams = [((g * 2654435761) & 0xFFFFFFFF) >> 19 for g in grams if g]
        margin = sum(model.w[g].astype(float) for g in grams) / len(grams) + model.b
        family = int(np.argmax(margin[:k]))
        votes = {i: 0.0 for i in range(len(model.langs)) if model.of[i] == family}
        sure = dict.fromkeys(votes, 1.0)
        for j, (a, b) in enumerate(model.pairs):
            if model.of[a] == family:
                p = 1 / (1 + np.exp(-2 * margin[k + j]))
                votes[a], votes[b] = votes[a] + (p > 0.5), votes[b] + (p <= 0.5)
                sure[a], sure[b] = min(sure[a], p), min(sure[b], 1 - p)
        best = max(votes, key=lambda i: votes[i] + 0.5 * sure[i])
        e = np.exp(2 * (margin[:k] - margin[:k].max()))
        assert got[r.doc_id].lang_pred == model.langs[best]
        assert abs(got[r.doc_id].score - e[family] / e.sum() * sure[best]) < 1e-6


def test_quality_score_by_line(spark):
    """Scores of a fitted model from marginals by enumeration, line features one text at a time."""
    from itertools import product

    import numpy as np

    docs, labels = tables(spark)
    model = quality_crf.fit(docs, labels.select("doc_id", F.col("quality").alias("label")), 100)
    rows = [r for r in docs.where("length(text) > 0").limit(400).collect() if r.text.count("\n") < 8][:80]
    got = {r.doc_id: r.score for r in quality_crf.score_quality(docs.where(F.col("doc_id").isin([r.doc_id for r in rows])), model, F.lit(False)).collect()}
    for r in rows:
        x, size, _ = quality_crf.line_features([r.text])
        lines = r.text.split("\n")
        assert size.tolist() == [len(line.encode()) for line in lines]
        z = (x - model.mean) / model.spread
        none = np.zeros((1, z.shape[1]), dtype=z.dtype)
        u = np.concatenate((z, np.concatenate((none, z[:-1])), np.concatenate((z[1:], none)), np.ones((len(z), 1))), axis=1) @ model.w
        mass, good = 0.0, np.zeros(len(u))
        for y in product((0, 1), repeat=len(u)):
            w = np.exp(sum(a * b for a, b in zip(u, y)) + sum(model.pair[a, b] for a, b in zip(y, y[1:])))
            mass += w
            good += w * np.array(y)
        want = (good / mass * size).sum() / size.sum() if size.sum() else model.prior
        assert abs(got[r.doc_id] - want) < 1e-4


def test_models_with_empty_tables(spark):
    docs, labels = tables(spark)
    none = docs.limit(0)
    assert quality_crf.fit(none, labels.select("doc_id", F.col("quality").alias("label"))) is None
    assert toxicity_chain.fit(none, labels.select("doc_id", F.col("toxic").alias("label"))) is None
    assert quality_crf.score_quality(none, None, F.lit(False)).count() == 0
    assert toxicity_chain.label_toxicity(none, None).count() == 0


def test_many_languages(spark):
    """230 languages, some of them in one text only: all are learned, and told."""
    rows = [(1000 * k + i, f"{chr(97 + k // 26 % 26)}{chr(97 + k % 26)}{chr(98 + k // 9)}x " * 12 + "and more words", f"l{k}") for k in range(230) for i in range(1 if k % 10 == 3 else 6)]
    docs = spark.createDataFrame(rows + [(9, None, "l0"), (None, "text", "l1")], "doc_id long, text string, lang string").repartition(4)
    model = language_id.fit(docs.where("text IS NOT NULL"), 20)
    assert model.langs == sorted({r[2] for r in rows})
    out = {r.doc_id: r.lang_pred for r in language_id.identify(docs.where("doc_id > 9"), model, F.lit(False)).collect()}
    assert sum(out[i] == lang for i, _, lang in rows if i in out) > 0.97 * len(out)


def test_bounded_samples(spark):
    from roboframe.llm.sampling import bounded

    rows = [(i, k) for k in range(500) for i in range(1000 * k, 1000 * k + (900 if k < 3 else 2))] + [(7, None)]
    frame = spark.createDataFrame(rows, "id long, k int").repartition(3)
    got = {r["k"]: r["count"] for r in bounded(frame, "k", "id", 100).groupBy("k").count().collect()}
    assert set(got) == set(range(500)) and all(got[k] == 2 for k in range(3, 500)) and all(70 < got[k] < 150 for k in range(3))
    assert sorted(map(tuple, bounded(frame, "k", "id", 100).collect())) == sorted(map(tuple, bounded(frame.repartition(7), "k", "id", 100).collect()))


def test_other_labels_are_none(spark):
    """Labels that are neither 0 nor 1, however many, change nothing."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    more = docs.select("doc_id", (F.col("doc_id") + 2).cast("int").alias("label")).where("label > 1")
    for module, column in ((quality_crf, "quality"), (toxicity_chain, "toxic")):
        own = labels.select("doc_id", F.col(column).alias("label")).limit(80)
        one, other = module.fit(docs, own), module.fit(docs, own.unionByName(more))
        if module is quality_crf:
            assert abs(one.w - other.w).max() < 1e-9
        else:
            assert (one.terms == other.terms).all()


def test_quality_fit_sees_all_lines(spark, monkeypatch):
    """Documents that differ after their first 80 lines only."""
    from functools import partial

    seen = []
    monkeypatch.setattr(quality_crf, "Crf", lambda x, lines, label: seen.append(lines))
    docs = spark.createDataFrame([(i, "\n".join(["a line."] * 90 + [f"end {i}"] * 10)) for i in range(40)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, label int")
    fit = partial(quality_crf.fit, docs, labels)
    fit()
    assert seen.pop().tolist() == [100] * 40
    monkeypatch.setattr(quality_crf, "FIT_LINES", 2000)
    fit()
    kept = seen.pop().tolist()
    assert set(kept) == {100} and 5 <= len(kept) <= 35
