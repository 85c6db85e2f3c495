"""Nested values as rows: (path, type, value) of everything in a VARIANT, and what can be done with it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Levels that are walked, at most; what lies deeper is an error.
LEVELS = 16


def kind(v: Column) -> Column:
    """object, list, string, number, boolean or null; null for no value at all."""
    s = F.schema_of_variant(v)
    return (
        F.when(v.isNull(), F.lit(None).cast("string"))
        .when(s.startswith("OBJECT"), "object")
        .when(s.startswith("ARRAY"), "list")
        .when(s == "STRING", "string")
        .when(s == "BOOLEAN", "boolean")
        .when(s == "VOID", "null")
        .otherwise("number")
    )


def text(v: Column, kind_: Column) -> Column:
    """A value as text; objects and lists as JSON with their keys sorted, null for null."""
    return F.when(kind_.isin("object", "list"), F.to_json(v)).otherwise(F.try_variant_get(v, "$", "string"))


def walk(rows: DataFrame, keep: list[str], value: str, lists: bool = True, whole: bool = False, levels: int = LEVELS) -> DataFrame:
    """rows(*keep, value VARIANT) -> *keep, path, kind, value: a row for each value that holds no others.

    A path is made of keys with dots between, and of [i] for places in a list; without `lists` a list is one value, as
    JSON. With `whole`, objects (and lists that are walked) have a row of their own too. Empty objects and lists have a
    row; a null VARIANT has none. One pass without a shuffle: each level is one step of `variant_explode`, at which values
    that are done pass; a level below the last one is an error.
    """
    spark = rows.sparkSession
    out = rows.where(F.col(value).isNotNull()).select(*keep, F.lit("").alias("_path"), F.lit(False).alias("_done"), F.col(value).alias("_v"))
    for level in range(levels + 1):
        v, k = F.col("_v"), F.col("_kind")
        out = out.withColumn("_kind", kind(v))
        open_ = ~F.col("_done") & (k.isin("object", "list") if lists else k == "object")
        if level == levels:
            size = F.when(k == "list", F.size(F.try_variant_get(v, "$", "array<variant>"))).otherwise(F.size(F.try_variant_get(v, "$", "map<string,variant>")))
            deep = F.raise_error(F.lit(f"values lie deeper than {levels} levels"))
            out = out.withColumn("_path", F.when(open_ & (size > 0), deep).otherwise(F.col("_path")))
            break
        step = spark.tvf.variant_explode_outer(F.when(open_, v).outer())
        out = out.lateralJoin(step)
        child = F.col("pos").isNotNull()
        # the key of an object; a list has none
        longer = F.when(F.col("key").isNull(), F.concat("_path", F.lit("["), F.col("pos").cast("string"), F.lit("]")))
        longer = longer.otherwise(F.concat("_path", F.when(F.col("_path") == "", "").otherwise("."), "key"))
        below = F.struct(
            F.when(child, longer).otherwise(F.col("_path")).alias("p"), (F.col("_done") | ~child).alias("d"), F.when(child, F.col("value")).otherwise(v).alias("v")
        )
        if whole:
            own = F.struct(F.col("_path").alias("p"), F.lit(True).alias("d"), v.alias("v"))
            below = F.explode(F.when(child & (F.col("pos") == 0) & (F.col("_path") != ""), F.array(own, below)).otherwise(F.array(below)))
        out = out.select(*keep, below.alias("_n")).select(*keep, F.col("_n.p").alias("_path"), F.col("_n.d").alias("_done"), F.col("_n.v").alias("_v"))
    return out.select(*keep, F.col("_path").alias("path"), F.col("_kind").alias("kind"), text(F.col("_v"), F.col("_kind")).alias("value"))


def value_counts(flat: DataFrame, most: int = 50) -> DataFrame:
    """flat(path, kind, value) -> for each path its first `most` different values in their order, with counts. Counts have
    partial sums, and the limit of each path is taken in the tasks first."""
    from pyspark.sql import Window

    counts = flat.groupBy("path", "kind", "value").agg(F.count("*").alias("n"))
    k = F.row_number().over(Window.partitionBy("path").orderBy(F.asc_nulls_first("value"), "kind"))
    return counts.withColumn("_k", k).where(F.col("_k") <= most).drop("_k")


def parents(path: Column) -> Column:
    """All paths above a path of keys."""
    keys = F.split(path, "\\.")
    return F.transform(F.slice(F.sequence(F.lit(0), F.size(keys)), 2, F.size(keys) - 1), lambda n: F.array_join(F.slice(keys, 1, n), "."))


def merge(metadata: DataFrame, source: str, value: str) -> DataFrame:
    """Nested metadata of several sources (source, value VARIANT) -> path, source, value: objects are merged key by key; at the
    first level at which some source has something else, each source has a row with its whole value there, null if it has
    none. A path is of keys; keys don't hold dots. Sources and paths are few beside the rows they come from.
    """
    nodes = walk(metadata, [source], value, lists=False, whole=True).where("path <> ''")
    kinds = nodes.groupBy("path").agg(F.bool_or(~F.col("kind").isin("object", "null")).alias("mixed"))
    mixed = kinds.where("mixed").select("path")
    under = mixed.select("path", F.explode_outer(parents(F.col("path"))).alias("above"))
    hidden = under.join(mixed.select(F.col("path").alias("above")), "above").select("path").distinct()
    shown = mixed.join(hidden, "path", "left_anti")
    # every source has a row for every path that is shown: a product of the result, not of a join that could be narrowed
    all_ = shown.crossJoin(metadata.select(source).distinct())
    return all_.join(nodes.select(source, "path", F.col("value")), [source, "path"], "left").select("path", source, "value")
