"""Queries over file listings, names and dataset checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import names as N
from ..functions import nested
from ..operators import crawl as C
from ..operators import folds, shards
from ..registry import query
from ..sources import files, tars
from ..sources.views import LS, RN, listing, read, runs

ROOT = "split_part(path, '/', 3)"


def episode(path="path"):
    return N.part(path, 3)


@query("A16_list_files", """WITH s AS (SELECT doc_id // 64 AS shard, sum(512 + (strlen(text) + 511) // 512 * 512) + 1024 AS n FROM documents GROUP BY 1)
SELECT printf('shard_%06d.tar', shard) AS path, CAST((n + 10239) // 10240 * 10240 AS BIGINT) AS size FROM s WHERE contains(printf('shard_%06d.tar', shard), '1')""")
def _(spark, sf):
    # the folder that the shards' sink has filled, with its manifest
    root, d = files.scratch(spark), read(spark, sf, "documents")
    fields = F.create_map(F.lit("txt"), F.col("text").cast("binary"))
    tars.write_tar_shards(d.select(F.floor(F.col("doc_id") / 64).cast("int").alias("shard"), F.format_string("%08d", "doc_id").alias("key"), fields.alias("fields")), root)
    return files.list_files(spark, root, "shard_", "1")


@query("A17_assert_empty_output", f"WITH {LS} SELECT split_part(path, '/', 2) AS task, bool_or(path LIKE '%file_0002%') AS completed, count(*) FILTER (WHERE contains(path, 'file_0000')) AS partial FROM ls GROUP BY 1")
def _(spark, sf):
    # the report itself is a sink that refuses a folder with output
    report = listing(spark, sf).groupBy(N.part("path", 2).alias("task")).agg(
        F.bool_or(F.col("path").like("%file_0002%")).alias("completed"), F.count_if(F.col("path").contains("file_0000")).alias("partial")
    )
    path = files.scratch(spark)
    files.assert_empty_output(spark, path)
    report.write.parquet(path)
    return spark.read.parquet(path)


@query("A18_pending_transfers", f"WITH {LS} SELECT path, size FROM ls WHERE size % 3 <> 0")
def _(spark, sf):
    remote = listing(spark, sf)
    return remote.join(remote.where("size % 3 = 0").select("path"), "path", "left_anti")


@query("A18b_transfer_log", f"""WITH {LS}, a AS (SELECT path, 1 AS attempt, size % 5 <> 0 AS ok FROM ls WHERE size % 3 <> 0 UNION ALL SELECT path, 2, size % 10 <> 0 FROM ls WHERE size % 3 <> 0 AND size % 5 = 0 AND size % 4 <> 0),
l AS (SELECT path, CAST(max(attempt) AS INTEGER) AS attempts, bool_or(ok) AS done FROM a GROUP BY path)
SELECT ls.path, coalesce(attempts, 0) AS attempts, CASE WHEN done THEN 'done' WHEN attempts >= 2 THEN 'failed' WHEN attempts = 1 THEN 'retry' ELSE 'pending' END AS state FROM ls LEFT JOIN l USING (path)""")
def _(spark, sf):
    # some files fail at first, and some of these a second time
    remote = listing(spark, sf)
    first = remote.where("size % 3 <> 0").select("path", F.lit(1).alias("attempt"), (F.col("size") % 5 != 0).alias("ok"), "size")
    second = first.where("NOT ok AND size % 4 <> 0").select("path", F.lit(2).alias("attempt"), (F.col("size") % 10 != 0).alias("ok"), "size")
    return shards.transfer_states(remote, first.unionByName(second).drop("size"), "path").select("path", "attempts", "state")


@query("A21_copy_dataset_listing", f"WITH {LS} SELECT path, 'backup/' || substr(path, length('ASIA/') + 1) AS dest FROM ls WHERE starts_with(path, 'ASIA/')")
def _(spark, sf):
    rel = F.expr("substring(path, length('ASIA/') + 1)")
    return listing(spark, sf).where(F.col("path").startswith("ASIA/")).select("path", F.concat(F.lit("backup/"), rel).alias("dest"))


@query("A19_extract_directory_links", """WITH h AS (SELECT page_id, unnest(regexp_extract_all(html, '<a[^>]*href="([^"]*)"', 1)) AS link FROM pages)
SELECT page_id, link, ends_with(link, '/') AS is_dir FROM h WHERE link NOT IN ('..', '../') AND NOT contains(link, '?') AND NOT starts_with(link, '#') AND NOT regexp_matches(link, '^[a-z]+://')""")
def _(spark, sf):
    rows = N.directory_links(read(spark, sf, "pages"), "html", keep_absolute_paths=True)
    return rows.select("page_id", "link", F.endswith("link", F.lit("/")).alias("is_dir"))


CRAWL = """l AS (SELECT DISTINCT page_id AS page, link, h % 2 = 0 AS is_dir, h % (SELECT count(*) FROM pages) AS target FROM
 (SELECT page_id, link, CAST('0x' || substr(md5(link), 1, 7) AS BIGINT) AS h FROM (SELECT page_id, unnest(regexp_extract_all(html, '<a[^>]*href="([^"]*)"', 1)) AS link FROM pages)
  WHERE link NOT IN ('..', '../') AND NOT contains(link, '?') AND NOT starts_with(link, '#') AND NOT regexp_matches(link, '^[a-z]+://'))),
r(root, page, depth) AS (SELECT page_id, page_id, 0 FROM pages WHERE substr(md5(CAST(page_id AS VARCHAR)), 1, 1) = '7'
  UNION SELECT root, target, depth + 1 FROM r JOIN l USING (page) WHERE is_dir AND depth < 3),
m AS (SELECT root, page, min(depth) AS depth FROM r GROUP BY ALL)"""


@query("A19b_crawl_listings", f"WITH RECURSIVE {CRAWL} SELECT root, page, link, depth FROM m JOIN l USING (page) WHERE NOT is_dir")
def _(spark, sf):
    # a link leads to the page that its digest names, to a file if that is odd; a sixteenth of the pages are roots
    pages = read(spark, sf, "pages")
    n = F.broadcast(pages.agg(F.count("*").alias("n")))  # one row
    h = F.conv(F.substring(F.md5("link"), 1, 7), 16, 10).cast("long")
    links = N.directory_links(pages, "html", keep_absolute_paths=True).crossJoin(n)
    links = links.select(F.col("page_id").alias("page"), "link", (h % 2 == 0).alias("is_dir"), (h % F.col("n")).alias("target"))
    roots = pages.where(F.substring(F.md5(F.col("page_id").cast("string")), 1, 1) == "7").select(F.col("page_id").alias("root"), F.col("page_id").alias("page"))
    return C.crawl(links, roots, 4, files.kept)


@query("H29_cache_name", "SELECT page_id, substr(sha256(url), 1, 24) || '-' || CASE WHEN regexp_extract(rtrim(split_part(split_part(url, '?', 1), '#', 1), '/'), '^[a-z]+://[^/]+/.*?([^/]+)$', 1) = '' THEN 'shard' ELSE regexp_extract(rtrim(split_part(split_part(url, '?', 1), '#', 1), '/'), '^[a-z]+://[^/]+/.*?([^/]+)$', 1) END AS name FROM pages")
def _(spark, sf):
    return read(spark, sf, "pages").select("page_id", N.cache_name(F.col("url")).alias("name"))


@query("B07_parse_episode_path", f"WITH {LS} SELECT path, split_part(path, '/', 1) AS task, split_part(path, '/', 2) AS domain, split_part(path, '/', 3) AS source, try_cast(split_part(split_part(split_part(path, '/', 4), '_', 2), '.', 1) AS INTEGER) AS episode FROM ls")
def _(spark, sf):
    numbered = F.regexp_replace("path", r"file_(\d+)\.(\w+)$", "$1_file.$2")
    return listing(spark, sf).select("path", N.parse_episode_path(numbered).alias("p")).select("path", "p.*")


@query("B09_drop_paths_matching", f"WITH {LS} SELECT DISTINCT split_part(path, '/', 1) || '/' || split_part(path, '/', 2) AS prefix FROM ls WHERE NOT contains(path, 'NATION_1') AND contains(path, 'file_') AND NOT ends_with(path, '.npz')")
def _(spark, sf):
    kept = N.paths_matching(listing(spark, sf), drop=["NATION_1"], need=["file_"], drop_suffix=[".npz"])
    return kept.select(F.concat_ws("/", N.part("path", 1), N.part("path", 2)).alias("prefix")).distinct()


@query("B13_filter_has_fields", f"WITH {LS}, s AS (SELECT {ROOT} AS sample, list(DISTINCT split_part(path, '.', 2)) AS f FROM ls GROUP BY 1) SELECT sample FROM s WHERE list_contains(f, 'json') AND list_contains(f, 'tar') AND list_contains(f, 'npz')")
def _(spark, sf):
    s = listing(spark, sf).groupBy(episode().alias("sample")).agg(F.collect_set(F.element_at(F.split("path", r"\."), -1)).alias("f"))
    return s.where(N.has_all("f", ["json", "tar", "npz"])).select("sample")


@query("B15_skip_missing_cameras", f"WITH {LS}, s AS (SELECT {ROOT} AS ep, list(DISTINCT split_part(split_part(path, '/', 4), '.', 1)) AS c FROM ls GROUP BY 1) SELECT ep, len(list_filter(['file_0000', 'file_0002', 'file_0004'], lambda x: list_contains(c, x))) AS n FROM s")
def _(spark, sf):
    cams = F.collect_set(N.stem("path"))
    s = listing(spark, sf).groupBy(episode().alias("ep")).agg(cams.alias("c"))
    want = F.array(F.lit("file_0000"), F.lit("file_0002"), F.lit("file_0004"))
    return s.select("ep", F.size(F.array_intersect(want, "c")).alias("n")).where("n > 0")


@query("C07_check_dataset_complete", f"WITH {LS}, e AS (SELECT DISTINCT regexp_replace(path, '/file.*', '') AS d FROM ls), x AS (SELECT d || '/file_' || lpad(CAST(k AS VARCHAR), 4, '0') || '.json' AS path FROM e, (SELECT unnest([0, 3, 6]) AS k)) SELECT path FROM x WHERE path NOT IN (SELECT path FROM ls)")
def _(spark, sf):
    ls = listing(spark, sf)
    dirs = ls.select(F.regexp_replace("path", "/file.*", "").alias("d")).distinct()
    expected = dirs.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(6), F.lit(3))))
    expected = expected.select(F.concat("d", F.lit("/"), F.format_string("file_%04d.json", "k")).alias("path"))
    return expected.join(ls, "path", "left_anti")


@query("C17_required_files_present", f"WITH {LS} SELECT {ROOT} AS ep FROM ls GROUP BY 1 HAVING count(DISTINCT CASE WHEN split_part(path, '/', 4) IN ('file_0000.json', 'file_0001.tar', 'file_0003.json') THEN path END) = 3")
def _(spark, sf):
    need = ["file_0000.json", "file_0001.tar", "file_0003.json"]
    hit = listing(spark, sf).withColumn("f", N.part("path", 4)).where(F.col("f").isin(need))
    return hit.groupBy(episode().alias("ep")).agg(F.countDistinct("f").alias("n")).where(F.col("n") == len(need)).select("ep")


@query("C19_config_vs_dataset_keys", f"WITH {LS}, f AS (SELECT DISTINCT split_part(split_part(path, '/', 4), '.', 1) AS k FROM ls), e AS (SELECT unnest(['file_0001', 'file_0005', 'file_0042']) AS k) SELECT coalesce(f.k, e.k) AS k, CASE WHEN f.k IS NULL THEN 'missing' WHEN e.k IS NULL THEN 'extra' ELSE 'ok' END AS status FROM f FULL JOIN e ON f.k = e.k")
def _(spark, sf):
    found = listing(spark, sf).select(N.stem("path").alias("k")).distinct().withColumn("f", F.lit(True))
    expected = spark.createDataFrame([("file_0001",), ("file_0005",), ("file_0042",)], "k string").withColumn("e", F.lit(True))
    status = F.when(F.col("f").isNull(), "missing").when(F.col("e").isNull(), "extra").otherwise("ok")
    return found.join(expected, "k", "full").select("k", status.alias("status"))


@query("C20_first_nonempty_candidate", f"WITH {LS}, c AS (SELECT {ROOT} AS task, CASE split_part(path, '.', 2) WHEN 'npz' THEN 0 WHEN 'tar' THEN 1 ELSE 2 END AS rank, path FROM ls), b AS (SELECT task, min(rank) AS rank FROM c GROUP BY task) SELECT c.task, c.path FROM c JOIN b USING (task, rank)")
def _(spark, sf):
    ranks = F.broadcast(spark.createDataFrame([("npz", 0), ("tar", 1), ("json", 2)], "ext string, rank int"))
    c = listing(spark, sf).select(episode().alias("task"), F.element_at(F.split("path", r"\."), -1).alias("ext"), "path").join(ranks, "ext")
    return c.join(c.groupBy("task").agg(F.min("rank").alias("rank")), ["task", "rank"]).select("task", "path")


@query("C20b_all_candidates", f"WITH {LS}, c AS (SELECT {ROOT} AS task, split_part(split_part(path, '/', 4), '.', 1) AS stem, CASE split_part(path, '.', 2) WHEN 'npz' THEN 0 WHEN 'tar' THEN 1 ELSE 2 END AS rank, path FROM ls WHERE split_part(path, '.', 2) IN ('npz', 'tar', 'json')) SELECT task, count(DISTINCT stem) AS completed, count(DISTINCT rank) AS places, min(path) AS first FROM c GROUP BY task")
def _(spark, sf):
    # for the completion check all candidates count: what any of them has is done
    ranks = F.broadcast(spark.createDataFrame([("npz", 0), ("tar", 1), ("json", 2)], "ext string, rank int"))
    c = listing(spark, sf).select(episode().alias("task"), F.element_at(F.split("path", r"\."), -1).alias("ext"), N.stem("path").alias("stem"), "path").join(ranks, "ext")
    return c.groupBy("task").agg(F.countDistinct("stem").alias("completed"), F.countDistinct("rank").alias("places"), F.min("path").alias("first"))


@query("D28_source_fingerprint", f"WITH {LS} SELECT split_part(path, '/', 1) AS source, count(*) AS n, list_slice(list(path ORDER BY path), 1, 10) AS first, md5(string_agg(path, chr(10) ORDER BY path)) AS fingerprint FROM ls GROUP BY 1")
def _(spark, sf):
    return folds.fingerprints(listing(spark, sf).select(N.part("path", 1).alias("source"), "path"), "source", "path")


@query("F02_natural_latest", f"WITH {LS} SELECT {ROOT} AS run, arg_max(path, CAST(regexp_extract(path, 'file_([0-9]+)', 1) AS BIGINT)) AS latest FROM ls GROUP BY 1")
def _(spark, sf):
    return listing(spark, sf).groupBy(episode().alias("run")).agg(F.max_by("path", N.natural_key(F.col("path"))).alias("latest"))


@query("F04_limit_episodes", f"WITH {LS} SELECT DISTINCT {ROOT} AS ep FROM ls ORDER BY 1 LIMIT 12")
def _(spark, sf):
    return listing(spark, sf).select(episode().alias("ep")).distinct().orderBy("ep").limit(12)


@query("H21_pad_missing_images", f"WITH {LS}, s AS (SELECT {ROOT} AS ep, list(DISTINCT split_part(split_part(path, '/', 4), '.', 1)) AS c FROM ls GROUP BY 1) SELECT ep, list_transform(['file_0000', 'file_0003'], lambda x: CASE WHEN list_contains(c, x) THEN x END) AS images, list_transform(['file_0000', 'file_0003'], lambda x: CASE WHEN list_contains(c, x) THEN 1 ELSE 0 END) AS mask FROM s")
def _(spark, sf):
    s = listing(spark, sf).groupBy(episode().alias("ep")).agg(F.collect_set(N.stem("path")).alias("c"))
    want = F.array(F.lit("file_0000"), F.lit("file_0003"))
    return s.select("ep", F.transform(want, lambda x: F.when(F.array_contains("c", x), x)).alias("images"), F.transform(want, lambda x: F.array_contains("c", x).cast("int")).alias("mask"))


@query("H37_localize_path", f"""WITH {LS}, p AS (SELECT {ROOT} AS ep, row_number() OVER (PARTITION BY {ROOT} ORDER BY path) - 1 AS i, min(path) OVER (PARTITION BY {ROOT}) AS first,
  count(*) OVER (PARTITION BY {ROOT}) AS n, CASE WHEN size % 2 = 0 THEN '/local/' ELSE 'remote://' END || path AS place, path FROM ls)
SELECT ep, 'files[' || i || ']' AS path, place FROM p UNION ALL SELECT ep, 'meta.first', place FROM p WHERE path = first UNION ALL SELECT DISTINCT ep, 'meta.n', CAST(n AS VARCHAR) FROM p""")
def _(spark, sf):
    # a nested configuration for each episode; its remote paths become local where the file is there
    ls = listing(spark, sf)
    paths = F.array_sort(F.collect_list(F.concat(F.lit("remote://"), "path")))
    configs = ls.groupBy(episode().alias("ep")).agg(paths.alias("p"))
    meta = F.struct(F.get("p", F.lit(0)).alias("first"), F.size("p").alias("n"))
    flat = nested.walk(configs.select("ep", F.parse_json(F.to_json(F.struct(F.col("p").alias("files"), meta.alias("meta")))).alias("config")), ["ep"], "config")
    local = ls.where("size % 2 = 0").select(F.concat(F.lit("remote://"), "path").alias("value"), F.concat(F.lit("/local/"), "path").alias("local"))
    return flat.join(local, "value", "left").select("ep", "path", F.coalesce("local", "value").alias("place"))


#: version and variant take the places of six bits of the digest
UUID5 = "substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-' || lower(to_hex(CAST('0x' || substr(h, 17, 2) AS INTEGER) % 64 + 128)) || substr(h, 19, 2) || '-' || substr(h, 21, 12)"


@query("H28_stable_path_uuid", f"WITH {LS}, s AS (SELECT path, sha1(unhex('6ba7b8119dad11d180b400c04fd430c8') || encode(path)) AS h FROM ls) SELECT path, {UUID5} AS id, split_part(path, '/', 2) AS part FROM s")
def _(spark, sf):
    return listing(spark, sf).select("path", N.uuid5(F.col("path")).alias("id"), N.part("path", 2).alias("part"))


@query("B06_actual_key", "SELECT n_nationkey, 'robot__actual__poses__' || n_name AS key, CAST(NULL AS VARCHAR) AS short FROM nation")
def _(spark, sf):
    n = read(spark, sf, "nation")
    kind = F.when(F.col("n_nationkey") % 2 == 0, "desired").otherwise("action")
    return n.select("n_nationkey", N.actual_key(F.concat_ws("__", F.lit("robot"), kind, F.lit("poses"), "n_name")).alias("key"), N.actual_key(F.lit("a__b")).alias("short"))


@query("B20_tensor_axis_filter", "SELECT n_nationkey, CASE n_nationkey % 3 WHEN 2 THEN 'special_' || n_name ELSE 'poses' END AS category, CASE WHEN n_nationkey % 3 < 2 THEN n_name END AS limb FROM nation WHERE n_regionkey = 2 OR n_nationkey % 3 = 2")
def _(spark, sf):
    n = read(spark, sf, "nation")
    # names with the prefix, without it, and special ones
    prefix = F.when(F.col("n_nationkey") % 3 == 0, "robot__").otherwise("")
    name = F.concat(prefix, F.lit("actual__poses__"), "n_name", F.lit("::r"), "n_regionkey", F.lit("__xyz"))
    name = F.when(F.col("n_nationkey") % 3 == 2, F.concat(F.lit("special_"), "n_name")).otherwise(name)
    rows = n.select("n_nationkey", N.parse_tensor_name(name).alias("p"))
    return rows.where("p.robot = 'r2' OR p.robot IS NULL").select("n_nationkey", "p.category", "p.limb")


@query("B20b_axis_values", """SELECT 'limb' AS axis, n_name AS value, 1 AS n FROM nation WHERE n_nationkey % 3 < 2 UNION ALL SELECT 'robot', 'r' || n_regionkey, CAST(count(*) AS INTEGER) FROM nation WHERE n_nationkey % 3 < 2 GROUP BY 2
UNION ALL SELECT 'category', CASE n_nationkey % 3 WHEN 2 THEN 'special_' || n_name ELSE 'poses' END, CAST(count(*) AS INTEGER) FROM nation GROUP BY 2 UNION ALL SELECT 'group', 'actual', CAST(count(*) AS INTEGER) FROM nation WHERE n_nationkey % 3 < 2
UNION ALL SELECT 'repr', 'xyz', CAST(count(*) AS INTEGER) FROM nation WHERE n_nationkey % 3 < 2""")
def _(spark, sf):
    # the different values of each axis of the names, with their numbers
    n = read(spark, sf, "nation")
    prefix = F.when(F.col("n_nationkey") % 3 == 0, "robot__").otherwise("")
    name = F.concat(prefix, F.lit("actual__poses__"), "n_name", F.lit("::r"), "n_regionkey", F.lit("__xyz"))
    name = F.when(F.col("n_nationkey") % 3 == 2, F.concat(F.lit("special_"), "n_name")).otherwise(name)
    return N.axis_values(n.select(N.parse_tensor_name(name).alias("p")), "p").withColumn("n", F.col("n").cast("int"))


@query("H20_parse_image_key", "SELECT n_nationkey, 'cam' || n_regionkey AS camera, CAST(n_nationkey AS INTEGER) - 5 AS \"offset\", 'cam' || n_regionkey || '_t' || (n_nationkey - 5) AS key FROM nation")
def _(spark, sf):
    n = read(spark, sf, "nation")
    raw = F.concat(F.lit("sample.cam"), "n_regionkey", F.lit("_t"), F.col("n_nationkey") - 5)
    return n.select("n_nationkey", N.parse_image_key(raw).alias("p")).select("n_nationkey", "p.*")


@query("H34_run_attributes_from_path", f"""WITH {RN} SELECT run_id, 'diffusion_policy' AS model_type, CASE WHEN run_id % 2 = 0 THEN ablation ELSE 'run_2025_01_0' || (run_id % 9 + 1) || '-10_00_00' END AS ablation,
CASE WHEN run_id % 3 = 0 THEN '1e-4' END AS learning_rate, CAST(run_id % 7 * 8 AS INTEGER) AS batch_size, '2025_01_0' || (run_id % 9 + 1) || '-10_00_00' AS run_timestamp FROM runs""")
def _(spark, sf):
    r = runs(spark, sf)
    folder = F.when(F.col("run_id") % 2 == 0, F.concat(F.lit("ablations/x/"), "ablation", F.lit("/"))).otherwise("")
    lr = F.when(F.col("run_id") % 3 == 0, "-lr_1e-4").otherwise("")
    path = F.concat(F.lit("s3://b/diffusion_policy/"), folder, F.lit("2025_01_0"), F.col("run_id") % 9 + 1, F.lit("-10_00_00"), F.lit("-bsz_"), F.col("run_id") % 7 * 8, F.lit("-x"), lr)
    return r.select("run_id", N.run_attributes(path).alias("a")).select("run_id", "a.*")


@query("H35_task_name_inference", f"""WITH {RN} SELECT run_id, CASE run_id % 3 WHEN 0 THEN 'PickCup' WHEN 1 THEN 'StackPlates' ELSE 'lower' END AS task FROM runs""")
def _(spark, sf):
    k = F.col("run_id") % 3
    tags = F.when(k == 0, "x, PickCup, y").otherwise("lower, b")
    path = F.when(k == 1, "s3://b/exp/StackPlates/run_1").otherwise("s3://b/exp/run_1")
    return runs(spark, sf).select("run_id", N.task_name(tags, path, F.lit(None).cast("string")).alias("task"))


@query("H36_output_subdir", "SELECT r_regionkey, CASE r_regionkey % 3 WHEN 0 THEN 'multitask' WHEN 1 THEN 'a_and_b' ELSE r_name END AS subdir FROM region")
def _(spark, sf):
    k = F.col("r_regionkey") % 3
    values = F.when(k == 0, F.array().cast("array<string>")).when(k == 1, F.array(F.lit("b"), F.lit("a"))).otherwise(F.array("r_name"))
    return read(spark, sf, "region").select("r_regionkey", N.output_subdir(values).alias("subdir"))
