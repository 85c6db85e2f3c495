"""Toxicity by a classifier chain.

Categories are predicted one after the other by logistic regressions; each later model also reads the probabilities of
the earlier categories, which in the fit are out-of-fold predictions, so that it learns how far they can be trusted.
The corpus marks documents as toxic or not, so the two earlier categories are derived from that mark and from the terms
that go with it: `abusive` (toxic, with at least one such term) and `severe` (toxic, with more of them for its length
than half of the toxic documents). The terms themselves are found from the labelled sample. For the out-of-fold
predictions terms, derived categories and models all come from the other folds; folds are fitted as Spark tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .common import LOWER, back, joined, mix, renamed, runs_of, set_aside, slices, table, words
from .sampling import bounded, remainder

CATEGORIES = ("abusive", "severe", "toxic")
#: Labelled documents that are fitted on, in all; terms that are kept; folds of the chain.
LABELLED = 12_000
TERMS = 512
FOLDS = 5
#: log2 of the term buckets that the sample's document frequencies are counted in.
BITS = 20

WORD = np.zeros(256, dtype=bool)
WORD[0x61:0x7B] = WORD[0x80:] = True


def term_slots(texts: list) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of each word of all texts, and the number of its text."""
    data, starts = joined(texts)
    _, _, h, of = words(LOWER[data], starts, WORD)
    return (h >> np.uint64(64 - BITS)).astype(np.int64), of


def _distinct_terms(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for part in slices(batch):
            slot, of = term_slots(part["text"].tolist())
            pair = np.unique(of << BITS | slot)
            row = pair >> BITS
            yield pd.DataFrame(
                {"slot": pair & ((1 << BITS) - 1), "label": part["label"].to_numpy()[row], "fold": part["fold"].to_numpy()[row]}
            )


def hits_of(texts: list, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Text, term and number of its hits there for all terms that occur, and the number of words of each text."""
    slot, of = term_slots(texts)
    place = np.searchsorted(terms, slot)
    hit = np.flatnonzero((place < len(terms)) & (terms[np.minimum(place, len(terms) - 1)] == slot)) if len(terms) else []
    pair, times = np.unique(of[hit] * max(1, len(terms)) + place[hit], return_counts=True)
    return pair // max(1, len(terms)), pair % max(1, len(terms)), times, np.bincount(of, minlength=len(texts))


def features(row: np.ndarray, term: np.ndarray, times: np.ndarray, n: np.ndarray, terms: int) -> np.ndarray:
    """Counts of the terms, all their hits, whether there are any, hits by length, and length."""
    x = np.zeros((len(n), terms + 4), dtype=np.float32)
    x[row, term] = times
    hits = x.sum(axis=1)
    x = np.log1p(x)
    x[:, -4] = np.log1p(hits)
    x[:, -3] = hits > 0
    x[:, -2] = np.log1p(100 * hits / np.maximum(1, n))
    x[:, -1] = np.log1p(n) / 10
    return x


def logistic(x: np.ndarray, y: np.ndarray, decay: float = 1.0, rounds: int = 25) -> np.ndarray:
    """Newton's method with a quadratic penalty; the last weight is the constant and is not penalized."""
    z = np.concatenate((x, np.ones((len(x), 1), dtype=x.dtype)), axis=1)
    w = np.zeros(z.shape[1])
    penalty = np.full(len(w), decay)
    penalty[-1] = 1e-6
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ w.astype(z.dtype), -30, 30).astype(np.float64)))
        g = z.T @ (p - y) + penalty * w
        root = z * np.sqrt(p * (1 - p) + 1e-6).astype(z.dtype)[:, None]
        step = np.linalg.solve((root.T @ root).astype(np.float64) + np.diag(penalty), g)
        w -= step
        if np.abs(step).max() < 1e-4:
            break
    return w


def probability(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x @ w[:-1] + w[-1], -30, 30)))


class Chain:
    """The terms and the weights of each category's model, which also read the probabilities of the earlier ones."""

    def __init__(self, terms: np.ndarray, weights: list[np.ndarray]):
        self.terms, self.weights = terms, weights

    def predict(self, texts: list) -> np.ndarray:
        x = features(*hits_of(texts, self.terms), len(self.terms)).astype(np.float64)
        out = []
        for w in self.weights:
            out.append(probability(x, w))
            x = np.concatenate((x, out[-1][:, None]), axis=1)
        return np.stack(out, axis=1)


class Sample:
    """The labelled documents as hits of the terms that any fold has chosen."""

    def __init__(self, rows: list, terms: list[np.ndarray]):
        self.toxic = np.array([r["label"] == 1 for r in rows])
        self.fold = np.array([r["fold"] for r in rows])
        self.n = np.array([r["n"] for r in rows])
        at = [np.frombuffer(bytes(r["terms"]), dtype="<i4") for r in rows]
        self.row = np.repeat(np.arange(len(rows)), [len(x) for x in at])
        self.term = np.concatenate(at)
        self.times = np.concatenate([np.frombuffer(bytes(r["times"]), dtype="<i4") for r in rows])
        self.chosen = terms  # of each fold's others, and of all: places among the terms here, ascending

    def features(self, k: int) -> np.ndarray:
        own = np.isin(self.term, self.chosen[k])
        place = np.searchsorted(self.chosen[k], self.term[own])
        return features(self.row[own], place, self.times[own], self.n, len(self.chosen[k]))


def targets(x: np.ndarray, toxic: np.ndarray, fitted: np.ndarray) -> tuple[np.ndarray, ...]:
    """The categories of all rows, as the fitted ones define them."""
    some, density = toxic & (x[:, -3] > 0), x[:, -2]
    middle = np.median(density[some & fitted]) if (some & fitted).any() else np.inf
    return some, toxic & (density > middle), toxic


def _fit_category(sample: Sample, category: int, earlier: np.ndarray):
    """(id) -> for each fold the probabilities of its documents by a model of the others; for id FOLDS the weights of
    the model of all."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for k in batch["id"].tolist():
                there = sample.fold == k
                fitted = ~there if (~there).any() else np.ones(len(there), dtype=bool)
                x = sample.features(k)
                y = targets(x, sample.toxic, fitted)[category].astype(np.float64)
                x = np.concatenate((x, earlier.astype(x.dtype)), axis=1)
                w = logistic(x[fitted], y[fitted])
                p = probability(x[there].astype(np.float64), w)
                yield pd.DataFrame([(k, w.tobytes(), p.tobytes())], columns=["k", "w", "p"])

    return run


def _fit_hits(terms: np.ndarray):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for part in slices(batch):
                row, term, times, n = hits_of(part["text"].tolist(), terms)
                cuts = np.searchsorted(row, np.arange(len(part) + 1))
                packed = [[x[a:b].astype("<i4").tobytes() for a, b in zip(cuts, cuts[1:], strict=False)] for x in (term, times)]
                yield pd.DataFrame(
                    {"label": part["label"].to_numpy(), "fold": part["fold"].to_numpy(), "n": n, "terms": packed[0], "times": packed[1]}
                )

    return run


def fit(docs: DataFrame, labels: DataFrame, labelled: int = LABELLED) -> Chain | None:
    """docs(doc_id, text), labels(doc_id, label 0/1) -> a chain, fitted on about `labelled` labelled documents, of
    which the hits of at most (FOLDS + 1) * TERMS terms reach the driver. Labels other than 0 and 1 are no labels. None where
    no labelled text is there."""
    spark = docs.sparkSession
    known = labels.where("label IN (0, 1) AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.max("label").alias("label"))
    known = known.withColumn("all", F.lit(1))
    sample = F.broadcast(bounded(known, "all", "doc_id", labelled).drop("all"))
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text")).where("text IS NOT NULL").join(sample, "doc_id")
    rows = common.written(rows.withColumn("fold", remainder("doc_id", FOLDS)), "op6-sample")
    by = {(r["label"], r["fold"]): r["count"] for r in rows.groupBy("label", "fold").count().collect()}
    if not by:
        return None
    one = F.lit(1)
    seen = rows.select("text", "label", "fold").mapInPandas(_distinct_terms, "slot long, label int, fold int").groupBy("slot")
    seen = common.written(
        seen.agg(
            *[F.sum(F.when(F.col("fold") != k, one).otherwise(0)).alias(f"n{k}") for k in range(FOLDS + 1)],
            *[F.sum(F.when(F.col("fold") != k, F.col("label")).otherwise(0)).alias(f"t{k}") for k in range(FOLDS + 1)],
        ),
        "op6-terms",
    )
    slots = []
    for k in range(FOLDS + 1):
        t, c = (sum(n for (label, fold), n in by.items() if label == want and fold != k) for want in (1, 0))
        n, toxic = F.col(f"n{k}"), F.col(f"t{k}")
        expected = n * (t / max(1, t + c))
        score = (toxic - expected) / F.sqrt(expected + 0.5)
        best = seen.where((toxic >= 3) & (toxic > 3 * expected)).orderBy(score.desc(), "slot").limit(TERMS)
        slots.append(np.sort(np.array([r["slot"] for r in best.select("slot").collect()], dtype=np.int64)))
    terms = np.unique(np.concatenate(slots))
    schema = "label int, fold int, n long, terms binary, times binary"
    got = rows.select("text", "label", "fold").mapInPandas(_fit_hits(terms), schema).collect()
    common.discard(seen, rows)
    got.sort(key=lambda r: (r["label"], r["fold"], r["n"], bytes(r["terms"]), bytes(r["times"])))
    held = Sample(got, [np.searchsorted(terms, x) for x in slots])
    earlier, weights = np.zeros((len(got), 0)), []
    for category in range(len(CATEGORIES)):
        fits = spark.range(0, FOLDS + 1, 1, FOLDS + 1).mapInPandas(_fit_category(held, category, earlier), "k int, w binary, p binary")
        p = np.zeros(len(got))
        for r in fits.collect():
            if r["k"] == FOLDS:
                weights.append(np.frombuffer(bytes(r["w"])))
            else:
                p[held.fold == r["k"]] = np.frombuffer(bytes(r["p"]))
        earlier = np.concatenate((earlier, p[:, None]), axis=1)
    return Chain(slots[FOLDS], weights)


SCORES = [*(f"p_{c}" for c in CATEGORIES), "is_toxic"]


def toxicity(model: Chain | None):
    """A column function: text -> struct of p_abusive, p_severe, p_toxic, is_toxic. Without a model all probabilities are 0."""

    @F.pandas_udf(", ".join(f"p_{c} double" for c in CATEGORIES) + ", is_toxic boolean")
    def score(text: pd.Series) -> pd.DataFrame:
        texts = text.tolist()
        p = [model.predict(texts[a:b]) for a, b in runs_of(texts)] if model is not None else [np.zeros((len(texts), len(CATEGORIES)))]
        p = np.concatenate([np.zeros((0, len(CATEGORIES))), *p])
        return pd.DataFrame({f"p_{c}": p[:, k] for k, c in enumerate(CATEGORIES)} | {"is_toxic": p[:, -1] >= 0.5})

    return score


def label_toxicity(docs: DataFrame, model: Chain | None, carry: tuple[str, ...] = ()) -> DataFrame:
    """docs(doc_id, text, ...) -> doc_id, the columns in `carry`, p_abusive, p_severe, p_toxic, is_toxic for each row,
    from its whole text.

    Null and empty texts are texts without words; without a model all probabilities are 0. Rows that repeat give a row
    each; columns in `carry` pass as they are whatever their names, but for those of the result; other columns are ignored;
    an empty table gives an empty result.
    """
    inner = set_aside(carry, SCORES)
    scored = docs.select("doc_id", *renamed(inner), toxicity(model)(F.col("text").cast("string")).alias("_scores"))
    return scored.select("doc_id", *back(inner), *(F.col(f"_scores.{c}").alias(c) for c in SCORES))


def op6_toxicity_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    common.prepare(spark)
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return label_toxicity(docs, fit(docs, labels.select("doc_id", F.col("toxic").alias("label"))))
