"""Document quality from a linear-chain conditional random field over lines.

Every line is labelled good or bad from features of itself and of the lines before and after it, and from the labels
of its neighbours. Forward-backward gives each line's marginal; the document's score is their mean weighted by length.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .common import joined, mix, prefix_hash, slices, span_hash, table, words
from .sampling import GRAIN, bounded, remainder

#: Labelled documents that are fitted on, of each label, and lines of all of them together.
PER_LABEL = 1500
FIT_LINES = 240_000

NOT_SPACE = np.ones(256, dtype=bool)
NOT_SPACE[[0x20, *range(0x09, 0x0E)]] = False


def _class(*ranges: tuple[int, int]) -> np.ndarray:
    out = np.zeros(256, dtype=bool)
    for a, b in ranges:
        out[a : b + 1] = True
    return out


UPPER, LOWER_, DIGIT, HIGH = _class((0x41, 0x5A)), _class((0x61, 0x7A)), _class((0x30, 0x39)), _class((0x80, 0xFF))
SPACE = ~NOT_SPACE
STOPS = np.zeros(256, dtype=bool)
STOPS[[ord(c) for c in ",.;:'\"-()"]] = True
LOUD = np.zeros(256, dtype=bool)
LOUD[[ord("!"), ord("?")]] = True
ODD = ~(UPPER | LOWER_ | DIGIT | HIGH | SPACE | STOPS | LOUD)
KINDS = (UPPER, LOWER_, DIGIT, HIGH, SPACE, STOPS, LOUD, ODD)
N_FEATURES = len(KINDS) + 7


def line_features(texts: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features of all lines of all texts, the bytes of each line, and the number of lines of each text."""
    data, starts = joined(texts)
    ends = np.flatnonzero(data == 0x0A)
    begins = np.concatenate(([0], ends[:-1] + 1))
    of = np.searchsorted(starts, begins, side="right") - 1
    size = ends - begins
    share = 1.0 / np.maximum(1, size)
    columns = []
    for kind in KINDS:
        total = np.concatenate(([0], np.cumsum(kind[data])))
        columns.append((total[ends] - total[begins]) * share)
    w_start, w_end, h, _ = words(data, starts, NOT_SPACE)
    line = np.searchsorted(begins, w_start, side="right") - 1
    n = np.bincount(line, minlength=len(ends))
    letters = np.bincount(line, weights=w_end - w_start, minlength=len(ends))
    key = np.sort(mix(h + mix(line.astype(np.uint64))))
    first = np.concatenate(([True], np.diff(key) != 0))[: len(key)]
    order = np.argsort(mix(h + mix(line.astype(np.uint64))), kind="stable")
    distinct = np.bincount(line[order][first], minlength=len(ends))
    again = np.zeros(len(h), dtype=bool)
    again[1:] = (h[1:] == h[:-1]) & (line[1:] == line[:-1])
    twice = np.bincount(line, weights=again, minlength=len(ends))
    body = mix(span_hash(prefix_hash(data), begins, ends) + mix(of.astype(np.uint64)))
    _, place, count = np.unique(body, return_inverse=True, return_counts=True)
    last = data[np.maximum(ends - 1, 0)]
    columns += [
        np.log1p(size),
        np.log1p(n),
        letters / np.maximum(1, n) / 10,
        distinct / np.maximum(1, n),
        twice / np.maximum(1, n),
        (count[place] > 1) & (size > 0),
        (STOPS[last] | LOUD[last]) & (size > 0),
    ]
    return np.stack(columns, axis=1).astype(np.float32), size, np.bincount(of, minlength=len(texts))


def with_neighbours(x: np.ndarray, lines: np.ndarray) -> np.ndarray:
    """Own features, those of the line before and of the line after (zeros at the ends of a text), and a constant."""
    of = np.repeat(np.arange(len(lines)), lines)
    same = (of[1:] == of[:-1])[:, None]
    before, after = np.zeros_like(x), np.zeros_like(x)
    before[1:] = x[:-1] * same
    after[:-1] = x[1:] * same
    return np.concatenate((x, before, after, np.ones((len(x), 1), dtype=x.dtype)), axis=1)


def marginals(u: np.ndarray, lines: np.ndarray, pair: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """u: log weight of `good` against `bad` of each line; pair[a, b]: log weight of a followed by b. Returns the
    marginal of good of each line and the summed marginals of neighbouring pairs. Texts run in step."""
    first = np.cumsum(lines) - lines
    order = np.argsort(-lines, kind="stable")
    n = len(u)
    up, down = np.zeros((n, 2)), np.ones((n, 2))
    top = np.maximum(u, 0)
    own = np.stack([np.exp(-top), np.exp(u - top)], axis=1)
    step = np.exp(pair - pair.max())
    longest = int(lines.max(initial=0))
    live = np.searchsorted(-lines[order], -np.arange(longest), side="left")  # texts with more than t lines
    rows = first[order]
    for t in range(longest):
        at = rows[: live[t]] + t
        a = own[at] if t == 0 else (up[at - 1] @ step) * own[at]
        up[at] = a / a.sum(axis=1, keepdims=True)
    for t in range(longest - 2, -1, -1):
        at = rows[: live[t + 1]] + t
        b = (down[at + 1] * own[at + 1]) @ step.T
        down[at] = b / b.sum(axis=1, keepdims=True)
    both = up * down
    good = both[:, 1] / both.sum(axis=1)
    of = np.repeat(np.arange(len(lines)), lines)
    left = np.flatnonzero(of[1:] == of[:-1])
    joint = up[left][:, :, None] * step[None] * (down[left + 1] * own[left + 1])[:, None, :]
    joint /= joint.sum(axis=(1, 2), keepdims=True)
    return good, joint.sum(axis=0)


class Crf:
    def __init__(self, x: np.ndarray, lines: np.ndarray, label: np.ndarray, rounds: int = 250, decay: float = 1e-3):
        self.mean, self.spread = x.mean(axis=0), x.std(axis=0) + 1e-3
        self.prior = float(label.mean())
        z = with_neighbours((x - self.mean) / self.spread, lines).astype(np.float64)
        y = np.repeat(label, lines).astype(np.float64)
        self.w, self.pair = np.zeros(z.shape[1]), np.zeros((2, 2))
        observed = np.zeros((2, 2))
        for k in (0, 1):
            observed[k, k] = np.maximum(lines[label == k] - 1, 0).sum()
        # each text weighs the same, whatever its number of lines
        theta = np.zeros(len(self.w) + 4)
        m, v = np.zeros_like(theta), np.zeros_like(theta)
        for i in range(1, rounds + 1):
            good, joint = marginals(z @ theta[:-4], lines, theta[-4:].reshape(2, 2))
            g = np.concatenate((z.T @ (y - good), (observed - joint).ravel())) / len(y) - decay * theta
            m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
            theta += 0.05 * (m / (1 - 0.9**i)) / (np.sqrt(v / (1 - 0.999**i)) + 1e-8)
        self.w, self.pair = theta[:-4], theta[-4:].reshape(2, 2)

    def score(self, texts: list) -> np.ndarray:
        x, size, lines = line_features(texts)
        z = with_neighbours((x - self.mean) / self.spread, lines)
        good, _ = marginals(z @ self.w, lines, self.pair)
        starts = np.cumsum(lines) - lines
        total = np.add.reduceat(size, starts)
        mean = np.add.reduceat(good * size, starts) / np.maximum(1, total)
        return np.clip(np.where(total > 0, mean, self.prior), 0.0, 1.0)


def _fit_features(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for part in slices(batch):
            x, _, lines = line_features(part["text"].tolist())
            ends = np.cumsum(lines)
            rows = [x[e - n : e].astype("<f4").tobytes() for e, n in zip(ends, lines, strict=True)]
            yield pd.DataFrame({"label": part["label"].to_numpy(), "x": rows})


def fit(docs: DataFrame, labels: DataFrame, per_label: int = PER_LABEL) -> Crf | None:
    """docs(doc_id, text), labels(doc_id, label 0/1) -> a model. About `per_label` documents of each label, with all
    lines of each, reach the driver as numbers. Where these have more than FIT_LINES lines together, whole documents
    are left out at random by hash, and one that is longer than that alone always. Labels other than 0 and 1 are no labels.
    None where no labelled text is there."""
    known = labels.where("label IN (0, 1) AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.max("label").alias("label"))
    sample = F.broadcast(bounded(known, "label", "doc_id", per_label))
    rows = docs.select("doc_id", "text").where("length(text) > 0").join(sample, "doc_id")
    n_lines = F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit(""))) + 1
    rows = rows.withColumn("text", F.col("text").cast("string")).where(n_lines <= FIT_LINES)
    total = rows.agg(F.sum(n_lines)).first()[0] or 0
    if total > FIT_LINES:
        place = F.pmod(F.xxhash64("doc_id", F.lit("lines")), F.lit(GRAIN))
        rows = rows.where(place < int(FIT_LINES / total * GRAIN))
    rows = rows.select("text", "label").mapInPandas(_fit_features, "label int, x binary").collect()
    if not rows:
        return None
    rows.sort(key=lambda r: (r["label"], bytes(r["x"])))
    x = [np.frombuffer(bytes(r["x"]), dtype="<f4").reshape(-1, N_FEATURES) for r in rows]
    return Crf(np.concatenate(x), np.array([len(a) for a in x]), np.array([r["label"] for r in rows]))


def _score(model: Crf | None):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for part in slices(batch):
                out = part[["doc_id", "held_out"]].copy()
                out["score"] = model.score(part["text"].tolist()) if model is not None else 0.5
                out["predicted"] = (out["score"] >= 0.5).astype("int32")
                yield out

    return run


def score_quality(docs: DataFrame, model: Crf | None, held_out) -> DataFrame:
    """docs(doc_id, text, ...) -> doc_id, held_out, score, predicted for each row, from its whole text alone.

    Null and empty texts, and texts of line breaks alone, get the share of good documents of the fit; all texts get 0.5
    where there is no model. Rows that repeat give a row each; other columns are ignored; an empty table gives an
    empty result.
    """
    kind = dict(docs.dtypes)["doc_id"]
    rows = docs.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), F.col("text").cast("string").alias("text"))
    return rows.mapInPandas(_score(model), f"doc_id {kind}, held_out boolean, score double, predicted int")


def op3_quality_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    common.prepare(spark)
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    held = remainder("doc_id", 3) == 1
    known = labels.where(~held).select("doc_id", F.col("quality").alias("label"))
    return score_quality(docs, fit(docs, known), held)
