"""Language identification by hierarchical discrimination.

A first linear classifier tells language families apart; within a family one-versus-one linear support vector machines
separate each pair of languages and vote. Features are hashed byte trigrams of the lower-cased letters, as shares of
the text's trigrams, scaled by their spread; all scores of a text are sums of weights over its trigrams.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .common import LOWER, joined, slices, table
from .sampling import bounded, remainder

#: Families of languages by ISO 639-1 code. A code that is not here is a family of its own.
FAMILIES = {
    "germanic": ["af", "da", "de", "en", "is", "nb", "nl", "nn", "no", "sv"],
    "romance": ["ca", "es", "fr", "gl", "it", "la", "pt", "ro"],
    "slavic": ["be", "bg", "cs", "hr", "mk", "pl", "ru", "sk", "sl", "sr", "uk"],
    "uralic": ["et", "fi", "hu"],
    "baltic": ["lt", "lv"],
    "turkic": ["az", "kk", "tr", "uz"],
    "semitic": ["ar", "he"],
    "indic": ["bn", "gu", "hi", "mr", "pa", "ur"],
}
#: Labelled texts that are fitted on, of each language.
PER_LANGUAGE = 300
#: Texts of all languages together that are fitted on, and those of them that tell families apart; where there are many
#: languages, each has the fewer.
FITTED, FAMILY_FITTED = 12_000, 6_000
#: Texts of each language, at least, where it has them, however many languages there are.
LEAST = 3
DIMS = 1 << 13

LETTER = np.zeros(256, dtype=np.uint8)
for _b in [*range(0x61, 0x7B), *range(0x80, 0x100)]:
    LETTER[_b] = _b


def trigrams(texts: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashed trigrams of all texts in a row, whether each counts (has a letter), and the place of each text."""
    data, starts = joined(texts)
    x = np.concatenate((LETTER[LOWER[data]], np.zeros(2, dtype=np.uint8))).astype(np.uint32)
    code = x[:-2] << 16 | x[1:-1] << 8 | x[2:]
    # nothing of the next text: zeros follow each text, as they follow the last
    ends = starts[1:] - 1
    code[ends] = 0
    code[ends[ends > starts[:-1]] - 1] &= 0xFF0000
    return (code * np.uint32(2654435761)) >> np.uint32(32 - 13), code != 0, starts


def _features(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for part in slices(batch):
            slot, counts, starts = trigrams(part["text"].tolist())
            rows = []
            for a, b in zip(starts, starts[1:], strict=False):
                v = np.bincount(slot[a:b][counts[a:b]], minlength=DIMS).astype(np.float32)
                rows.append((v / max(1.0, v.sum())).astype("<f4").tobytes())
            yield pd.DataFrame({"lang": part["lang"].to_numpy(), "x": rows})


def svm(gram: np.ndarray, y: np.ndarray, cost: float = 10.0, rounds: int = 40) -> np.ndarray:
    """Dual coordinate descent for the linear hinge loss; returns the coefficients of the rows."""
    alpha, signed = np.zeros(len(y)), np.zeros(len(y))
    margin = np.zeros(len(y))
    order = np.random.default_rng(7)
    for _ in range(rounds):
        for i in order.permutation(len(y)):
            new = min(max(alpha[i] - (y[i] * margin[i] - 1) / gram[i, i], 0.0), cost)
            if new != alpha[i]:
                margin += (new - alpha[i]) * y[i] * gram[i]
                alpha[i] = new
    return alpha * y


class Model:
    """Weights of all linear functions, one column each: families first, then the pairs within families."""

    def __init__(self, langs: list[str], x: np.ndarray, y: np.ndarray):
        self.langs = langs
        family_of = {c: f for f, codes in FAMILIES.items() for c in codes}
        self.families = sorted({family_of.get(c, c) for c in langs})
        self.of = [self.families.index(family_of.get(c, c)) for c in langs]
        self.pairs = [(a, b) for a, b in combinations(range(len(langs)), 2) if self.of[a] == self.of[b]]
        scale = 1.0 / np.sqrt(x.mean(axis=0) + 1e-5)
        z = x * scale
        target = np.array([self.of[i] for i in y])
        columns, bias = [], []

        def fit(rows: np.ndarray, signs: list[np.ndarray]) -> None:
            own = z[rows]
            gram = (own @ own.T + 1.0).astype(np.float64)
            for positive in signs:
                c = svm(gram, np.where(positive, 1.0, -1.0))
                columns.append((c @ own) * scale)
                bias.append(c.sum())

        each = max(1, FAMILY_FITTED // len(langs))  # rows come in no order that texts of a language depend on
        some = np.concatenate([np.flatnonzero(y == i)[:each] for i in range(len(langs))])
        fit(some, [target[some] == f for f in range(len(self.families))])
        for a, b in self.pairs:
            rows = np.flatnonzero((y == a) | (y == b))
            fit(rows, [y[rows] == a])
        self.w = np.stack(columns, axis=1).astype(np.float32) if columns else np.zeros((DIMS, 0), dtype=np.float32)
        self.b = np.array(bias)

    def predict(self, texts: list) -> tuple[np.ndarray, np.ndarray]:
        slot, counts, starts = trigrams(texts)
        weight = self.w[slot]
        weight[~counts] = 0
        total = np.add.reduceat(weight, starts[:-1], axis=0, dtype=np.float64)
        n = np.maximum(1, np.add.reduceat(counts, starts[:-1], dtype=np.int64))
        margin = total / n[:, None] + self.b
        k = len(self.families)
        family = margin[:, :k].argmax(axis=1)
        e = np.exp(np.clip(2 * (margin[:, :k] - margin[:, :k].max(axis=1, keepdims=True)), -50, 0))
        p_family = (e / e.sum(axis=1, keepdims=True))[np.arange(len(texts)), family]
        votes = np.zeros((len(texts), len(self.langs)))
        sure = np.ones((len(texts), len(self.langs)))
        for j, (a, b) in enumerate(self.pairs):
            p = 1 / (1 + np.exp(np.clip(-2 * margin[:, k + j], -50, 50)))
            votes[:, a] += p > 0.5
            votes[:, b] += p <= 0.5
            sure[:, a] = np.minimum(sure[:, a], p)
            sure[:, b] = np.minimum(sure[:, b], 1 - p)
        inside = np.array(self.of)[None, :] == family[:, None]
        best = np.where(inside, votes + 0.5 * sure, -1.0).argmax(axis=1)
        return best, np.clip(p_family * sure[np.arange(len(texts)), best], 0.0, 1.0)


def fit(labelled: DataFrame, per_language: int = PER_LANGUAGE) -> Model | None:
    """labelled(doc_id, text, lang), lang not null -> a model of all languages that there are; at most about `per_language`
    texts of each language, and FITTED of all, reach the driver, as vectors of fixed size. A language with few texts, or one of
    very many languages, has one text at least. None where nothing is labelled."""
    languages = max(1, labelled.select("lang").distinct().count())
    per_language = max(LEAST, min(per_language, FITTED // languages))
    sample = common.written(bounded(labelled, "lang", "doc_id", per_language).select("text", "lang"), "op2-sample")
    # a language of which chance has left out all texts, so one with few, has the text with the least id
    rare = labelled.select("lang").distinct().join(sample.select("lang").distinct(), "lang", "left_anti")
    if not rare.isEmpty():
        first = labelled.join(rare, "lang").groupBy("lang").agg(F.min_by(F.struct("text"), "doc_id").alias("t"))
        sample = sample.unionByName(first.where("t IS NOT NULL").select("t.text", "lang"))
    rows = sample.mapInPandas(_features, "lang string, x binary").collect()
    if not rows:
        return None
    rows.sort(key=lambda r: (r["lang"], bytes(r["x"])))
    langs = sorted({r["lang"] for r in rows})
    x = np.stack([np.frombuffer(bytes(r["x"]), dtype="<f4") for r in rows])
    return Model(langs, x, np.array([langs.index(r["lang"]) for r in rows]))


def _label(model: Model | None):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for part in slices(batch):
                out = part[["doc_id", "held_out"]].copy()
                out["lang_pred"], out["score"] = "und", 0.0
                known = part["letter"].to_numpy(dtype=bool)
                if model is not None and known.any():
                    best, score = model.predict(part.loc[known, "text"].tolist())
                    out.loc[known, "lang_pred"] = np.array(model.langs, dtype=object)[best]
                    out.loc[known, "score"] = score
                yield out

    return run


def identify(docs: DataFrame, model: Model | None, held_out) -> DataFrame:
    """docs(doc_id, text, ...) -> doc_id, held_out, lang_pred, score for each row, from its whole text alone.

    Null texts and texts without a letter are `und` with score 0, and so are all where there is no model. Rows that
    repeat give a row each; other columns are ignored; an empty table gives an empty result.
    """
    text = F.col("text").cast("string")
    letter = F.coalesce(text.rlike(r"\p{L}"), F.lit(False))
    kind = dict(docs.dtypes)["doc_id"]
    rows = docs.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), text.alias("text"), letter.alias("letter"))
    return rows.mapInPandas(_label(model), f"doc_id {kind}, held_out boolean, lang_pred string, score double")


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    common.prepare(spark)
    docs = table(spark, sf_dir, "documents")
    held = remainder("doc_id", 4) == 2
    labelled = docs.where(~held & F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    return identify(docs, fit(labelled.select("doc_id", "text", "lang")), held)
