"""Paths and names: parts, filters, keys, attributes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def part(path: str | Column, k: int) -> Column:
    """k-th part of a path from 1, or from the end for negative k."""
    return F.split_part(path if isinstance(path, Column) else F.col(path), F.lit("/"), F.lit(k))


def stem(path: str | Column) -> Column:
    return F.regexp_replace(part(path, -1), r"\.[^.]*$", "")


def parse_episode_path(path: Column) -> Column:
    """task / domain / source / <digits>_...: a struct, its episode null where the last part starts without digits."""
    return F.struct(
        part(path, -4).alias("task"), part(path, -3).alias("domain"), part(path, -2).alias("source"),
        F.split_part(part(path, -1), F.lit("_"), F.lit(1)).try_cast("int").alias("episode"),
    )


def paths_matching(files: DataFrame, drop: list[str], need: list[str], drop_suffix: list[str]) -> DataFrame:
    for x in drop:
        files = files.where(~F.col("path").contains(x))
    for x in need:
        files = files.where(F.col("path").contains(x))
    for x in drop_suffix:
        files = files.where(~F.col("path").endswith(x))
    return files


def has_all(column: str, values: list[str]) -> Column:
    return F.size(F.array_except(F.array(*[F.lit(v) for v in values]), F.col(column))) == 0


def directory_links(pages: DataFrame, html: str, host: str | Column | None = None, keep_absolute_paths: bool = False) -> DataFrame:
    """Links of an HTML listing, one row each: without the parent, queries, anchors, other hosts and absolute paths."""
    rows = pages.withColumn("link", F.explode(F.regexp_extract_all(F.col(html), F.lit('<a[^>]*href="([^"]*)"'), 1)))
    link = F.col("link")
    rows = rows.where(~link.isin("..", "../") & ~link.contains("?") & ~link.startswith("#"))
    absolute = link.rlike("^[a-z]+://")
    rows = rows.where(~absolute if host is None else ~absolute | (F.parse_url(link, F.lit("HOST")) == host))
    return rows if keep_absolute_paths else rows.where(~link.startswith("/"))


def cache_name(url: Column) -> Column:
    """<digest>-<base name>; the path's last part, or `shard`."""
    path = F.rtrim(F.split_part(F.split_part(url, F.lit("?"), F.lit(1)), F.lit("#"), F.lit(1)), F.lit("/"))
    base = F.regexp_extract(path, "^[a-z]+://[^/]+/.*?([^/]+)$", 1)
    return F.concat(F.left(F.sha2(url.cast("binary"), 256), F.lit(24)), F.lit("-"), F.when(base == "", "shard").otherwise(base))


def natural_key(path: Column) -> Column:
    """Text and numbers of a path in turn, numbers padded, so that they compare by value."""
    parts = F.regexp_extract_all(path, F.lit(r"(\d+|\D+)"), 1)
    return F.transform(parts, lambda p: F.when(p.rlike(r"^\d"), F.lpad(p, 20, "0")).otherwise(p))


def uuid5(name: Column, namespace_hex: str = "6ba7b8119dad11d180b400c04fd430c8") -> Column:
    """Version 5 UUID of a text in a namespace (the URL namespace by default)."""
    h = F.sha1(F.concat(F.unhex(F.lit(namespace_hex)), name.cast("binary")))
    variant = F.lower(F.hex(F.conv(F.substring(h, 17, 2), 16, 10).cast("int").bitwiseAND(0x3F).bitwiseOR(0x80)))
    return F.concat(
        F.substring(h, 1, 8), F.lit("-"), F.substring(h, 9, 4), F.lit("-5"), F.substring(h, 14, 3), F.lit("-"),
        variant, F.substring(h, 19, 2), F.lit("-"), F.substring(h, 21, 12),
    )


def actual_key(field: Column) -> Column:
    """robot__<anything>__rest -> robot__actual__rest; fewer than three parts give null."""
    p = F.split(field, "__")
    return F.when(F.size(p) >= 3, F.array_join(F.concat(F.slice(p, 1, 1), F.array(F.lit("actual")), F.slice(p, F.lit(3), F.size(p))), "__"))


def parse_tensor_name(name: Column) -> Column:
    """robot__group__category__limb::robot__representation as a struct; missing parts are null. A name without `::` is
    special: it is its own category; the part before it may lack the prefix `robot__`."""
    left, right = F.split(F.split_part(name, F.lit("::"), F.lit(1)), "__"), F.split(F.split_part(name, F.lit("::"), F.lit(2)), "__")
    left = F.when(F.get(left, F.lit(0)) == "robot", F.slice(left, 2, F.size(left))).otherwise(left)
    named = name.contains("::")
    g = lambda a, i: F.when(named, F.nullif(F.get(a, F.lit(i)), F.lit("")))
    category = F.when(named, g(left, 1)).otherwise(name)
    return F.struct(g(left, 0).alias("group"), category.alias("category"), g(left, 2).alias("limb"), g(right, 0).alias("robot"), g(right, 1).alias("repr"))


def axis_values(rows: DataFrame, parsed: str) -> DataFrame:
    """Parsed tensor names -> axis, value, n: the different values of each axis; missing parts have none."""
    axes = rows.schema[parsed].dataType.names
    pairs = F.explode(F.array(*[F.struct(F.lit(a).alias("axis"), F.col(f"{parsed}.{a}").alias("value")) for a in axes]))
    return rows.select(pairs.alias("_a")).select("_a.*").where("value IS NOT NULL").groupBy("axis", "value").agg(F.count("*").alias("n"))


def parse_image_key(key: Column) -> Column:
    """<prefix>.<camera>_t<offset> -> camera, offset, short key."""
    pattern = r"([^.]+)_t(-?\d+)$"
    return F.struct(
        F.regexp_extract(key, pattern, 1).alias("camera"), F.regexp_extract(key, pattern, 2).try_cast("int").alias("offset"),
        F.regexp_extract(key, r"([^.]+_t-?\d+)$", 1).alias("key"),
    )


#: What a run's name begins with, and the marks before its learning rate and its batch size.
STAMP, RATE, BATCH = r"\d{4}_\d{2}_\d{2}-\d{2}_\d{2}_\d{2}", "-lr_", "-bsz_"


def run_attributes(path: Column) -> Column:
    """Model type, variant, learning rate, batch size and time stamp of a run's path; without a variant in the path it is
    named after the time stamp."""
    parts = F.filter(F.split(path, "/"), lambda p: p != "")
    name = F.element_at(parts, -1)
    none = lambda c: F.nullif(c, F.lit(""))
    after = lambda mark: F.when(F.contains(name, F.lit(mark)), F.element_at(F.split(name, mark), -1))
    stamp = none(F.regexp_extract(name, f"^{STAMP}", 0))
    # up to the next field: a dash after an exponent's e belongs to the number
    rate = none(F.regexp_extract(after(RATE), r"^(?:[^-]|(?<=e)-)+", 0))
    at = F.array_position(parts, "ablations")
    variant = F.when(at > 0, F.get(parts, (at + 1).cast("int")))
    kind = F.filter(parts, lambda p: p == "diffusion_policy")
    return F.struct(
        F.get(kind, F.lit(0)).alias("model_type"),
        F.coalesce(variant, F.concat(F.lit("run_"), stamp)).alias("ablation"),
        rate.alias("learning_rate"),
        none(F.regexp_extract(after(BATCH), r"^\d+", 0)).cast("int").alias("batch_size"),
        stamp.alias("run_timestamp"),
    )


PASCAL = r"^([A-Z][a-z0-9]+){2,}$"


def task_name(tags: Column, path: Column, manifest: Column) -> Column:
    """First tag in Pascal case, else such a part of the path, else such a word of the manifest, else the first tag."""
    t = F.transform(F.split(tags, ","), lambda x: F.trim(x))
    first = lambda a: F.get(F.filter(a, lambda x: x.rlike(PASCAL)), F.lit(0))
    words = F.regexp_extract_all(manifest, F.lit(r"([A-Za-z0-9]+)"), 1)
    return F.coalesce(first(t), first(F.split(path, "/")), first(words), F.get(t, F.lit(0)))


def output_subdir(values: Column) -> Column:
    """No value: multitask; one: itself; several: sorted and joined."""
    return F.when(F.size(values) == 0, F.lit("multitask")).otherwise(F.array_join(F.array_sort(values), "_and_"))
