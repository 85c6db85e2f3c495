"""Scans in the order of a key, with the rows of hot keys dealt over blocks of that order.

A scan whose step is associative needs no key in one task: each block is scanned by itself, what the blocks hand on is
scanned over the blocks (a row for each), and comes back to the rows. Here these steps are counting and taking the last
value that isn't null, which is the composition of maps `become v` and `stay`.

A key is hot if it has more than `least` rows; the most frequent ones, BLOCKS at most, are cut at quantiles of the order, so
that no block of a key has more than about a BLOCKS-th of all hot rows. The other keys are one block each, without a join.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

HOT, BLOCKS = 1_000_000, 256


class Cut(NamedTuple):
    """Rows with `_block`, which grows with the order of their key, and `_hot`; whether any key is hot."""

    rows: DataFrame
    keys: list[str]
    hot: bool


def _block(value: Column, bounds: list[float]) -> Column:
    """How many of the bounds are at or below the value, by halves."""

    def between(a: int, b: int) -> Column:
        if a == b:
            return F.lit(a)
        mid = (a + b) // 2
        return F.when(value < bounds[mid], between(a, mid)).otherwise(between(mid + 1, b))

    return between(0, len(bounds))


def same(a: list[str], b: list[str]) -> Column:
    """Keys of two sides of a join are equal, nulls among them."""
    return [F.col(x).eqNullSafe(F.col(y)) for x, y in zip(a, b, strict=True)]


def cut(rows: DataFrame, keys: list[str], by: str, least: int | None = HOT, blocks: int = BLOCKS) -> Cut:
    """by: a number or a time that the order begins with. Rows that have it in common stay together; nulls come first.
    Without `least` no key is looked for. The driver gets the hot keys and the bounds, `blocks` of each at most."""
    counts = [] if least is None else rows.groupBy(*keys).count().where(F.col("count") > least).orderBy(F.desc("count")).limit(blocks).collect()
    if not counts:
        return Cut(rows.withColumns({"_block": F.lit(0), "_hot": F.lit(False)}), keys, False)
    fields = T.StructType([T.StructField(f"_of_{k}", rows.schema[k].dataType) for k in keys] + [T.StructField("_is_hot", T.BooleanType())])
    hot = rows.sparkSession.createDataFrame([(*(r[k] for k in keys), True) for r in counts], fields)
    rows = rows.join(F.broadcast(hot), same(keys, [f"_of_{k}" for k in keys]), "left").withColumn("_hot", F.coalesce("_is_hot", F.lit(False)))
    rows = rows.drop("_is_hot", *(f"_of_{k}" for k in keys))
    value = F.col(by).cast("double")
    share = F.array(*(F.lit(k / blocks) for k in range(1, blocks)))
    bounds = sorted(set(rows.where("_hot").agg(F.percentile_approx(value, share, F.lit(40 * blocks))).first()[0] or []))
    block = F.when(F.col("_hot") & value.isNotNull(), _block(value, bounds) + 1).otherwise(0)
    return Cut(rows.withColumn("_block", block), keys, True)


def _edges(rows: DataFrame, keys: list[str], edge: Column, carry: Column) -> DataFrame:
    """What the blocks of hot keys hand on: a row for each, BLOCKS ** 2 at most."""
    edges = rows.where("_hot").groupBy(*keys, "_block").agg(edge.alias("_edge")).withColumn("_carry", carry)
    return F.broadcast(edges.select(*(F.col(k).alias(f"_of_{k}") for k in [*keys, "_block"]), "_carry"))


def _with_edges(c: Cut, rows: DataFrame, edges: DataFrame) -> DataFrame:
    on = [*c.keys, "_block"]
    return rows.join(edges, same(on, [f"_of_{k}" for k in on]), "left").drop(*(f"_of_{k}" for k in on))


def numbered(c: Cut, order: list[str], out: str) -> Cut:
    """Number the rows of each key in order, from 1."""
    inside = F.row_number().over(Window.partitionBy(*c.keys, "_block").orderBy(*order))
    rows = c.rows.withColumn(out, inside)
    if c.hot:
        before = Window.partitionBy(*c.keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
        edges = _edges(c.rows, c.keys, F.count("*"), F.sum("_edge").over(before))
        rows = _with_edges(c, rows, edges).withColumn(out, F.col(out) + F.coalesce("_carry", F.lit(0))).drop("_carry")
    return Cut(rows, c.keys, c.hot)


def carried(c: Cut, order: list[str], value: str, out: str, inclusive: bool = True, backward: bool = False) -> Cut:
    """The last value that isn't null among the rows up to each one (with or without itself), or from each one on."""
    way = F.desc if backward else F.asc
    last = Window.unboundedPreceding, 0 if inclusive else -1
    inside = Window.partitionBy(*c.keys, "_block").orderBy(*(way(x) for x in order)).rowsBetween(*last)
    rows = c.rows.withColumn(out, F.last(value, ignorenulls=True).over(inside))
    if c.hot:
        at = F.when(F.col(value).isNotNull(), F.struct(*order))
        edge = F.min_by(value, at) if backward else F.max_by(value, at)
        before = Window.partitionBy(*c.keys).orderBy(way("_block")).rowsBetween(Window.unboundedPreceding, -1)
        edges = _edges(c.rows, c.keys, edge, F.last("_edge", ignorenulls=True).over(before))
        rows = _with_edges(c, rows, edges).withColumn(out, F.coalesce(out, "_carry")).drop("_carry")
    return Cut(rows, c.keys, c.hot)


def done(c: Cut) -> DataFrame:
    return c.rows.drop("_block", "_hot")
