"""Nested values as rows, merged metadata, and the crawl over listings."""

import json
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from roboframe.functions import nested
from roboframe.operators import crawl
from roboframe.sources import files


def plain(value, path="", lists=True, whole=False):
    kind = {dict: "object", list: "list", str: "string", bool: "boolean", int: "number", float: "number", type(None): "null"}[type(value)]
    text = None if value is None else value if kind == "string" else json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False)
    children = list(value.items() if kind == "object" else enumerate(value) if kind == "list" and lists else ())
    rows = [(path, kind, text)] if not children or whole and path else []
    for k, v in children:
        rows += plain(v, f"{path}[{k}]" if kind == "list" else f"{path}.{k}" if path else k, lists, whole)
    return rows


def values(rng, depth):
    if depth == 0 or rng.random() < 0.3:
        return rng.choice(["a", "", "é\"q", 3, -7, 2.5, True, False, None, {}, []])
    if rng.random() < 0.5:
        return {rng.choice("abcdefg") + str(i): values(rng, depth - 1) for i in range(rng.randint(0, 3))}
    return [values(rng, depth - 1) for _ in range(rng.randint(0, 3))]


@pytest.mark.parametrize(("lists", "whole"), [(True, False), (False, False), (True, True), (False, True)])
def test_walk(spark, lists, whole):
    rng = random.Random(6)
    docs = [(i, json.dumps(values(rng, 5))) for i in range(120)] + [(900, None), (901, "[]"), (902, '{"a":{"b":[]}}')]
    frame = spark.createDataFrame(docs, "i int, j string").select("i", F.parse_json("j").alias("v"), F.lit(0).alias("pos"), F.lit(0).alias("key"))
    got = Counter(tuple(r) for r in nested.walk(frame, ["i"], "v", lists, whole, levels=6).collect())
    want = Counter((i, *row) for i, j in docs if j is not None for row in plain(json.loads(j), "", lists, whole))
    assert got == want
    assert nested.walk(frame.limit(0), ["i"], "v").count() == 0


def test_values_that_lie_too_deep(spark):
    frame = spark.sql("SELECT parse_json('{\"a\":{\"b\":{\"c\":1}}}') AS v")
    assert nested.walk(frame, [], "v", levels=3).count() == 1
    with pytest.raises(Exception, match="deeper than 2"):
        nested.walk(frame, [], "v", levels=2).collect()


def test_value_counts_and_merge(spark):
    flat = spark.createDataFrame([("p", "string", str(i % 70)) for i in range(700)] + [("p", "null", None)] * 3, "path string, kind string, value string")
    got = {(r["value"]): r["n"] for r in nested.value_counts(flat).collect()}
    assert len(got) == 50 and got[None] == 3 and got["0"] == 10 and set(got) == {None, *sorted(map(str, range(70)))[:49]}
    sources = [("s1", '{"a":{"x":1,"y":{"z":2}},"b":5,"n":null,"l":[1]}'), ("s2", '{"a":{"x":3,"y":7},"b":{"c":1},"n":null}'), ("s3", '{"q":"w","n":{}}')]
    m = spark.createDataFrame(sources, "s string, j string").select("s", F.parse_json("j").alias("v"))
    got = {(r["path"], r["s"]): r["value"] for r in nested.merge(m, "s", "v").collect()}
    want = {"a.x": ("1", "3", None), "a.y": ('{"z":2}', "7", None), "b": ("5", '{"c":1}', None), "l": ("[1]", None, None), "q": (None, None, "w")}
    assert got == {(p, f"s{i + 1}"): v for p, vs in want.items() for i, v in enumerate(vs)}


def test_crawl_of_a_cyclic_graph(spark):
    rng = random.Random(11)
    links = [(rng.randrange(60), f"l{rng.randrange(300)}", rng.random() < 0.6, rng.randrange(60)) for _ in range(400)]
    links += links[:9] + [(None, "x", True, 3), (4, None, False, 3), (5, "dead", True, None)]
    frame = spark.createDataFrame(links, "page int, link string, is_dir boolean, target int")
    roots = spark.createDataFrame([(r, r) for r in (1, 2, 3)] * 2 + [(9, None)], "root int, page int")
    for depth in (1, 2, 5):
        want = set()
        for r in (1, 2, 3):
            seen, front = {r}, {r}
            for k in range(depth):
                rows = [x for x in links if x[0] in front and x[1] is not None]
                want |= {(r, p, link, k) for p, link, is_dir, _ in rows if not is_dir}
                front = {t for _, _, is_dir, t in rows if is_dir and t is not None} - seen
                seen |= front
        got = crawl.crawl(frame, roots, depth, files.kept).collect()
        assert len(got) == len(want) and {tuple(r) for r in got} == want
    assert crawl.crawl(frame, roots, 0, files.kept).count() == 0
    assert crawl.crawl(frame.limit(0), roots.limit(0), 3, files.kept).count() == 0


def test_crawl_over_listings(spark):
    page = lambda *links: "".join(f'<a href="{x}">x</a>' for x in links)
    pages = [
        ("http://h/data/", page("../", "a.tar", "./sub/", "?C=N", "/abs", "#top", "http://h/data/full.tar", "http://other/z.tar")),
        ("http://h/data/sub", page("b.tar", "deep/", "../")),
        ("http://h/data/sub/deep/", page("c.tar")),
        (None, page("lost.tar")),
    ]
    links = crawl.listing_links(spark.createDataFrame(pages, "url string, html string"))
    roots = spark.createDataFrame([("r", "http://h/data/")], "root string, page string")
    got = crawl.crawl(links.withColumn("link", F.col("target")), roots, 2, files.kept)
    assert {(r["link"], r["depth"]) for r in got.collect()} == {("http://h/data/a.tar", 0), ("http://h/data/full.tar", 0), ("http://h/data/sub/b.tar", 1)}
    assert crawl.crawl(links, roots, 5, files.kept).count() == 4


def test_list_files_and_manifests(spark, tmp_path):
    for name in ("a/x.txt", "a/b/y.txt", "c/x.bin"):
        (tmp_path / "in" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "in" / name).write_text("1234")
    got = lambda *x: sorted(map(tuple, files.list_files(spark, f"{tmp_path}/in", *x).collect()))
    assert got() == [("a/b/y.txt", 4), ("a/x.txt", 4), ("c/x.bin", 4)]
    assert got("a/", "x.") == [("a/x.txt", 4)] and files.list_files(spark, f"{tmp_path}/none").count() == 0
    rows = [(d, f"{i:08d}", i) for d in ("p", "q", "new one", "7") for i in range(3)]
    files.write_manifests(spark.createDataFrame(rows, "dataset string, shard string, num_sequences long"), f"{tmp_path}/m")
    assert sorted(map(tuple, files.read_manifests(spark, f"{tmp_path}/m").collect())) == sorted(rows)
