"""Filter interaction audit by min-plus removal ranks.

Documents become masks of the filters that they fail, and are counted by part and mask. The mask matrix (0 where a
filter fails, infinity elsewhere) is combined with the matrix of the filters' positions in each order, the inverse
permutations, by a min-plus product: the minimum is the step that removes the document. Counts scattered by that step
tell what each filter keeps and removes, and what it would have removed had another not come before.
"""

from __future__ import annotations

from collections.abc import Callable
from itertools import permutations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common
from .common import table, written

#: Filters of one audit, at most: all their orders are listed.
MOST = 7
#: The filters, in the order of the bits of a mask. A to D are told from a text, E from all texts.
FILTERS = "ABCDE"
WORD = "[^\\x20\\x09-\\x0D]+"
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
MARKS = "[#$%&*|]"


def failures(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text, lang, ...) -> a row for each: doc_id, part, digest (of the text), mask (bits of A to D).

    A null text is an empty one, a null lang the part with an empty name; other columns are ignored.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select("doc_id", F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("part"), text.alias("text"))
    rows = rows.withColumn("words", F.regexp_extract_all("text", F.lit(WORD), F.lit(0)))
    n, distinct = F.size("words"), F.size(F.array_distinct("words"))
    capitals = F.length("text") - F.length(F.translate("text", CAPITALS, ""))
    fails = (n < 100, 100 * distinct < 80 * n, 100 * capitals.cast("long") > 10 * F.length("text"), F.col("text").rlike(MARKS))
    mask = sum((F.when(x, 1 << k).otherwise(0) for k, x in enumerate(fails)), F.lit(0))
    return rows.select("doc_id", "part", F.unhex(F.sha2("text", 256)).alias("digest"), mask.alias("mask"))


def with_marks(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """rows, with good and toxic (0 or 1) of labels(doc_id, quality, toxic): 1 if any row of the doc_id says 1. Rows without
    a doc_id have no label and take no part in the join."""
    mark = labels.where("doc_id IS NOT NULL").groupBy("doc_id")
    mark = mark.agg(*(F.max(F.coalesce((F.col(c) == 1).cast("int"), F.lit(0))).alias(to) for c, to in (("quality", "good"), ("toxic", "toxic"))))
    found = rows.where("doc_id IS NOT NULL").join(mark, "doc_id", "left").fillna(0, ["good", "toxic"])
    return found.unionByName(rows.where("doc_id IS NULL").withColumns({"good": F.lit(0), "toxic": F.lit(0)}))


def mask_counts(rows: DataFrame, repeats: str | None = None) -> DataFrame:
    """rows(doc_id, part, digest, mask, good, toxic) -> part, mask, n, n_good, n_toxic.

    With `repeats` that bit is set in the rows that have the digest of a smaller doc_id: counted without meeting their
    group, by the group's least doc_id and the rows that have it. Rows without a doc_id neither have nor are repeats.
    Rows with one doc_id and one text aren't repeats of each other.
    """
    kind = ["part", "mask", "good", "toxic"]
    if repeats is None:
        counts = rows.groupBy(*kind).agg(F.count("*").alias("n"))
    else:
        one = rows.groupBy("digest", "doc_id", *kind).agg(F.count("*").alias("n"))
        some = one.groupBy("digest", *kind).agg(
            F.sum("n").alias("n"),
            F.sum(F.when(F.col("doc_id").isNull(), F.col("n")).otherwise(0)).alias("nameless"),
            F.min("doc_id").alias("low"),
            F.coalesce(F.min_by("n", "doc_id"), F.lit(0)).alias("n_low"),
        )
        # a row for each text, part and labels: the copies of a text are counted already
        least = F.min("low").over(Window.partitionBy("digest"))
        first = F.col("nameless") + F.when(F.col("low") == least, F.col("n_low")).otherwise(0)
        some = some.withColumn("first", first)
        bit = 1 << FILTERS.index(repeats)
        again = F.struct(F.col("mask").bitwiseOR(F.lit(bit)).alias("mask"), (F.col("n") - F.col("first")).alias("n"))
        both = F.explode(F.array(F.struct("mask", F.col("first").alias("n")), again))
        counts = some.select("part", "good", "toxic", both.alias("x")).select("part", "good", "toxic", "x.*").where("n > 0")
        counts = counts.groupBy(*kind).agg(F.sum("n").alias("n"))
    good, toxic = (F.sum(F.when(F.col(c) == 1, F.col("n")).otherwise(0)) for c in ("good", "toxic"))
    return counts.groupBy("part", "mask").agg(F.sum("n").alias("n"), good.alias("n_good"), toxic.alias("n_toxic"))


def positions(filters: int) -> tuple[np.ndarray, np.ndarray]:
    """All orders of the filters, and their inverse permutations: the position of each filter in each order, from 1."""
    orders = np.array(list(permutations(range(filters))), dtype=np.int64)
    return orders, np.argsort(orders, axis=1) + 1


def removal_ranks(fails: np.ndarray, position: np.ndarray) -> np.ndarray:
    """Min-plus product of masks (m x f booleans) with positions (p x f): the step at which each order removes a document
    with each mask, f + 1 where none does."""
    cost = np.where(fails, 0.0, np.inf)
    least = (cost[:, None, :] + position[None, :, :]).min(axis=2, initial=np.inf)
    return np.where(np.isinf(least), fails.shape[1] + 1, least).astype(np.int64)


AUDIT = (
    "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, good_lost long, "
    "toxic_lost long, shapley long"
)


def _audit(names: str) -> Callable[[pd.DataFrame], pd.DataFrame]:
    def run(frame: pd.DataFrame) -> pd.DataFrame:
        f = len(names)
        orders, position = positions(f)
        fails = (frame["mask"].to_numpy(np.int64)[:, None] >> np.arange(f) & 1).astype(bool)
        rank = removal_ranks(fails, position)
        p = np.arange(len(orders))
        gone = {}
        for c in ("n", "n_good", "n_toxic"):
            weight = frame[c].to_numpy(np.int64)
            gone[c] = np.zeros((len(orders), f + 2), dtype=np.int64)
            np.add.at(gone[c], (p[None, :], rank), weight[:, None])
        n = frame["n"].to_numpy(np.int64)
        steps = {c: x[:, 1 : f + 1] for c, x in gone.items()}
        failing = n @ fails
        alone = n @ (fails & (fails.sum(axis=1) == 1)[:, None])
        total = np.zeros(f, dtype=np.int64)
        np.add.at(total, orders, steps["n"])
        return pd.DataFrame(
            {
                "part": frame["part"].iloc[0],
                "filter_order": np.repeat(["".join(names[k] for k in o) for o in orders], f),
                "step": np.tile(np.arange(1, f + 1, dtype=np.int32), len(orders)),
                "kept": (n.sum() - np.cumsum(steps["n"], axis=1)).ravel(),
                "removed": steps["n"].ravel(),
                "redundant": (failing[orders] - steps["n"]).ravel(),
                "unique_fails": alone[orders].ravel(),
                "good_lost": steps["n_good"].ravel(),
                "toxic_lost": steps["n_toxic"].ravel(),
                "shapley": total[orders].ravel(),
            }
        )

    return run


def audit(counts: DataFrame, names: str) -> DataFrame:
    """counts(part, mask, n, n_good, n_toxic), one row for each part and mask -> for each part, order of the filters and
    step: kept, removed, redundant (failing the step's filter, removed before), unique_fails (failing it only), good_lost,
    toxic_lost, shapley (removed by that filter in all orders together).

    names: a letter for each bit of a mask, MOST at most. A part has 2 ** len(names) rows at most, however many documents
    it has. An empty table gives an empty result.
    """
    if not 0 < len(names) <= MOST or len(set(names)) < len(names):
        raise ValueError(f"between 1 and {MOST} different letters name the filters")
    return counts.groupBy("part").applyInPandas(_audit(names), AUDIT)


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    common.prepare(spark)
    rows = written(with_marks(failures(table(spark, sf_dir, "documents")), table(spark, sf_dir, "labels")), "op11-masks")
    return audit(mask_counts(rows, "E"), FILTERS)


ORACLE_SQL = """
WITH t AS (SELECT doc_id, coalesce(text, '') AS text, coalesce(lang, '') AS part FROM documents),
w AS (SELECT *, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') AS words,
             length(text) - length(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', '')) AS capitals,
             coalesce(doc_id > min(doc_id) OVER (PARTITION BY text), false) AS again FROM t),
l AS (SELECT doc_id, max(coalesce((quality = 1)::INT, 0)) AS good, max(coalesce((toxic = 1)::INT, 0)) AS toxic
      FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
m AS (SELECT part, (len(words) < 100)::INT + 2 * (100 * len(list_distinct(words)) < 80 * len(words))::INT
               + 4 * (100 * capitals > 10 * length(text))::INT + 8 * regexp_matches(text, '[#$%&*|]')::INT + 16 * again::INT AS mask,
             coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic
      FROM w LEFT JOIN l USING (doc_id)),
c AS (SELECT part, mask, count(*) AS n, sum(good) AS n_good, sum(toxic) AS n_toxic FROM m GROUP BY part, mask),
f(name, bit) AS (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)),
o AS (SELECT a.name || b.name || c.name || d.name || e.name AS filter_order FROM f a, f b, f c, f d, f e
      WHERE a.bit | b.bit | c.bit | d.bit | e.bit = 31),
s AS (SELECT filter_order, CAST(k AS INTEGER) AS step, own.name, own.bit AS own,
             coalesce((SELECT sum(g.bit) FROM f g WHERE strpos(substr(filter_order, 1, k - 1), g.name) > 0), 0)::INT AS before
      FROM o, range(1, 6) r(k), f own WHERE own.name = substr(filter_order, k, 1)),
r AS (SELECT part, filter_order, step, name,
             sum(CASE WHEN mask & (own | before) = 0 THEN n ELSE 0 END) AS kept,
             sum(CASE WHEN mask & own > 0 AND mask & before = 0 THEN n ELSE 0 END) AS removed,
             sum(CASE WHEN mask & own > 0 AND mask & before > 0 THEN n ELSE 0 END) AS redundant,
             sum(CASE WHEN mask = own THEN n ELSE 0 END) AS unique_fails,
             sum(CASE WHEN mask & own > 0 AND mask & before = 0 THEN n_good ELSE 0 END) AS good_lost,
             sum(CASE WHEN mask & own > 0 AND mask & before = 0 THEN n_toxic ELSE 0 END) AS toxic_lost
      FROM c, s GROUP BY part, filter_order, step, name)
SELECT part, filter_order, step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant,
       unique_fails::BIGINT AS unique_fails, good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost,
       (sum(removed) OVER (PARTITION BY part, name))::BIGINT AS shapley
FROM r
"""
