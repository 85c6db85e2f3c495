"""Queries over manifests and shards."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import nested
from ..operators import shards as S
from ..registry import query
from ..sources import files
from ..sources.views import SH, manifest, read

SEED, WORKERS = 11, 4
WEIGHTS = {"A": 0.5, "N": 0.3, "R": 0.2}


def H(epoch):  # noqa: N802
    return f"md5('{SEED}|' || {epoch} || '|' || shard)"


def plan_sql(samples):
    need = " ".join(f"WHEN '{k}' THEN {-(-int(v * samples * 10) // 10)}" for k, v in WEIGHTS.items())
    return f"""{SH}, tot AS (SELECT dataset, sum(num_sequences) AS total, CASE dataset {need} END AS need FROM man GROUP BY dataset),
ex AS (SELECT *, unnest(range(0, greatest(CAST(ceil(need / total) AS INTEGER), 1))) AS epoch FROM tot),
pl AS (SELECT m.dataset, shard, num_sequences, need, CAST(epoch AS INTEGER) AS epoch, sum(num_sequences) OVER w AS cum, row_number() OVER w AS pos
  FROM man m JOIN ex USING (dataset) WINDOW w AS (PARTITION BY m.dataset ORDER BY epoch, {H('epoch')}, shard)),
tk AS (SELECT *, count(*) OVER (PARTITION BY dataset) AS k FROM pl WHERE cum - num_sequences < need OR pos <= {WORKERS}),
sel AS (SELECT * FROM tk WHERE pos <= floor(k / {WORKERS}) * {WORKERS})"""


def selected(spark, sf, samples):
    return S.select_shards(manifest(spark, sf), WEIGHTS, samples, WORKERS, SEED)


@query("A01_read_manifest", f"WITH {SH} SELECT dataset, shard, CAST(num_sequences AS BIGINT) AS num_sequences FROM man")
def _(spark, sf):
    root = files.scratch(spark)
    files.write_manifests(manifest(spark, sf), root)
    return files.read_manifests(spark, root)


@query("A05_write_manifest", f"WITH {SH} SELECT shard, CAST(sum(num_sequences) AS BIGINT) AS num_sequences FROM man GROUP BY shard")
def _(spark, sf):
    path = files.scratch(spark)
    files.write_manifest(manifest(spark, sf).groupBy("shard").agg(F.sum("num_sequences").alias("num_sequences")), path)
    return files.read_manifest(spark, path)


@query("F01_seeded_shuffle", f"WITH {SH} SELECT dataset, shard, row_number() OVER (PARTITION BY dataset ORDER BY {H(3)}, shard) AS k FROM man")
def _(spark, sf):
    from pyspark.sql import Window

    w = Window.partitionBy("dataset").orderBy(S.seeded_order(F.col("shard"), SEED, 3), "shard")
    return manifest(spark, sf).select("dataset", "shard", F.row_number().over(w).alias("k"))


@query("E17_shard_prefix_sum", f"WITH {SH} SELECT dataset, shard, CAST(sum(num_sequences) OVER (PARTITION BY dataset ORDER BY {H(0)}, shard ROWS UNBOUNDED PRECEDING) AS BIGINT) AS cum FROM man")
def _(spark, sf):
    rows = manifest(spark, sf).withColumn("h", S.seeded_order(F.col("shard"), SEED))
    return S.prefix_sum(rows, ["dataset"], ["h", "shard"], "num_sequences").select("dataset", "shard", "cum")


@query("J01_select_shards", f"WITH {plan_sql(9000)} SELECT dataset, shard, epoch, pos, CAST(cum AS BIGINT) AS cum FROM sel")
def _(spark, sf):
    return selected(spark, sf, 9000).select("dataset", "shard", "epoch", "pos", "cum")


@query("J01b_next_cursor", f"""WITH {plan_sql(9000)}, n AS (SELECT dataset, count(*) AS shards FROM man GROUP BY dataset)
SELECT dataset, CAST(max(pos) // any_value(shards) AS BIGINT) AS epoch, CAST(max(pos) % any_value(shards) AS BIGINT) AS cursor, CAST(sum(num_sequences) AS BIGINT) AS samples FROM sel JOIN n USING (dataset) GROUP BY dataset""")
def _(spark, sf):
    c = S.next_cursor(selected(spark, sf, 9000), manifest(spark, sf))
    return c.select("dataset", "epoch", F.col("cursor").cast("long").alias("cursor"), "samples")


@query("J02_multi_epoch_wrap", f"WITH {plan_sql(200000)} SELECT dataset, epoch, count(*) AS n, CAST(sum(num_sequences) AS BIGINT) AS samples FROM sel GROUP BY ALL")
def _(spark, sf):
    return selected(spark, sf, 200000).groupBy("dataset", "epoch").agg(F.count("*").alias("n"), F.sum("num_sequences").alias("samples"))


@query("J03_mix_datasets", f"""WITH {plan_sql(9000)} SELECT dataset, shard, num_sequences, CAST('0x' || substr(md5('{SEED}|' || dataset || '|' || epoch || '|' || shard), 1, 7) AS BIGINT) / 268435456.0 AS mix FROM sel""")
def _(spark, sf):
    m = S.mix_datasets(selected(spark, sf, 9000), SEED).orderBy("mix", "dataset", "epoch", "pos")
    return m.select("dataset", "shard", "num_sequences", "mix")


@query("J04_assign_to_workers", f"WITH {plan_sql(9000)} SELECT dataset, shard, CAST((pos - 1) % 4 % 2 AS INTEGER) AS node, CAST((pos - 1) % 4 // 2 AS INTEGER) AS worker FROM sel")
def _(spark, sf):
    return S.assign_to_workers(selected(spark, sf, 9000), 2, 2).select("dataset", "shard", "node", "worker")


@query("J05_batch_rows", f"""WITH r AS (SELECT l_orderkey, l_linenumber, l_partkey, l_orderkey % 4 AS worker FROM lineitem), n AS (SELECT *, row_number() OVER (PARTITION BY worker ORDER BY l_orderkey, l_linenumber, l_partkey) - 1 AS k, count(*) OVER (PARTITION BY worker) AS c FROM r)
SELECT worker, CAST(k // 512 AS BIGINT) AS batch, count(*) AS n FROM n WHERE k // 512 < c // 512 GROUP BY ALL""")
def _(spark, sf):
    rows = read(spark, sf, "lineitem").withColumn("worker", F.col("l_orderkey") % 4)
    return S.batch_rows(rows, ["worker"], ["l_orderkey", "l_linenumber", "l_partkey"], 512, F.floor(F.col("l_orderkey") / 65536)).groupBy("worker", "batch").agg(F.count("*").alias("n"))


@query("J06_chunk_into_shards", f"SELECT doc_id, CAST((row_number() OVER (ORDER BY md5('{SEED}|0|' || doc_id), doc_id) - 1) // 64 AS BIGINT) AS shard FROM documents")
def _(spark, sf):
    return S.chunk_into_shards(read(spark, sf, "documents").select("doc_id"), "doc_id", 64, SEED).select("doc_id", "shard")


@query("J07_full_shard_plan", "WITH f AS (SELECT source AS file, count(*) AS n_rows FROM documents GROUP BY 1) SELECT file, n_rows, n_rows // 16 AS shards, CAST(coalesce(sum(n_rows // 16) OVER (ORDER BY file ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS first_shard FROM f")
def _(spark, sf):
    files = read(spark, sf, "documents").groupBy(F.col("source").alias("file")).agg(F.count("*").alias("n_rows"))
    return S.full_shard_plan(files, 16).select("file", "n_rows", "shards", "first_shard")


@query("J08_resume_cursor", f"WITH {plan_sql(9000)} SELECT dataset, shard, pos FROM pl WHERE pos > CASE dataset WHEN 'A' THEN 5 WHEN 'N' THEN 9 ELSE 0 END")
def _(spark, sf):
    need = F.create_map(*[F.lit(x) for k, v in WEIGHTS.items() for x in (k, int(v * 9000))])
    budget = manifest(spark, sf).select("dataset").distinct().withColumn("need", need[F.col("dataset")].cast("long"))
    plan = S.plan_epochs(manifest(spark, sf), budget, SEED)
    cursors = spark.createDataFrame([("A", 5), ("N", 9)], "dataset string, cursor int")
    return S.resume(plan, cursors).select("dataset", "shard", "pos")


@query("J09_finite_take", f"WITH {SH}, r AS (SELECT *, row_number() OVER (PARTITION BY dataset ORDER BY shard) AS k FROM man) SELECT dataset, shard FROM r WHERE k <= 10")
def _(spark, sf):
    from pyspark.sql import Window

    k = F.row_number().over(Window.partitionBy("dataset").orderBy("shard"))
    return manifest(spark, sf).withColumn("k", k).where("k <= 10").select("dataset", "shard")


@query("G01_union_sources", f"WITH {SH} SELECT dataset || '/shards/' || shard AS shard, CAST(num_sequences AS BIGINT) AS num_sequences FROM man WHERE dataset <> 'R'")
def _(spark, sf):
    m = manifest(spark, sf)
    parts = [m.where(F.col("dataset") == d) for d in WEIGHTS]
    both = parts[0].unionByName(parts[1]).unionByName(parts[2])
    ignore = spark.createDataFrame([("R",)], "dataset string")
    return both.join(F.broadcast(ignore), "dataset", "left_anti").select(F.concat("dataset", F.lit("/shards/"), "shard").alias("shard"), "num_sequences")


@query("D27_epoch_budget", f"WITH {SH} SELECT dataset, CAST(sum(num_sequences) * 3 AS BIGINT) AS samples FROM man GROUP BY dataset")
def _(spark, sf):
    return manifest(spark, sf).groupBy("dataset").agg((F.sum("num_sequences") * 3).alias("samples"))


@query("D24_settings_coherence", """WITH s AS (SELECT l_returnflag AS task, 'status' AS setting, l_linestatus AS value FROM lineitem UNION ALL SELECT l_returnflag, 'line', CAST(l_linenumber AS VARCHAR) FROM lineitem),
d AS (SELECT DISTINCT * FROM s) SELECT setting, value, string_agg(task, ',' ORDER BY task) AS tasks, count(*) = (SELECT count(DISTINCT task) FROM s) AS common FROM d GROUP BY ALL""")
def _(spark, sf):
    li = read(spark, sf, "lineitem")
    pairs = F.explode(F.array(F.struct(F.lit("status").alias("setting"), F.col("l_linestatus").alias("value")), F.struct(F.lit("line").alias("setting"), F.col("l_linenumber").cast("string").alias("value"))))
    d = li.select(F.col("l_returnflag").alias("task"), pairs.alias("p")).select("task", "p.setting", "p.value").distinct()
    n = F.broadcast(li.agg(F.countDistinct("l_returnflag").alias("n")))  # one row
    out = d.groupBy("setting", "value").agg(F.array_sort(F.collect_set("task")).alias("t")).crossJoin(n)
    return out.select("setting", "value", F.array_join("t", ",").alias("tasks"), (F.size("t") == F.col("n")).alias("common"))


@query("D25_group_metadata", """WITH c AS (SELECT l_returnflag AS source, CAST(l_linenumber AS VARCHAR) AS line, count(*) AS v, count(*) FILTER (WHERE l_linestatus = 'O') AS o FROM lineitem GROUP BY ALL),
m AS (SELECT source, 'processing.lines.' || line AS path, CAST(v AS VARCHAR) AS value FROM c WHERE NOT (source = 'A' AND line = '3')
 UNION ALL SELECT source, 'processing.total_samples_created', CAST(CAST(sum(v) AS BIGINT) AS VARCHAR) FROM c GROUP BY source
 UNION ALL SELECT source, 'status', CASE source WHEN 'A' THEN 'done' ELSE '{"closed":' || CAST(sum(v) - sum(o) AS BIGINT) || ',"open":' || CAST(sum(o) AS BIGINT) || '}' END FROM c GROUP BY source
 UNION ALL SELECT DISTINCT source, 'steps', '[1,2]' FROM c),
g AS (SELECT s.source, p.path FROM (SELECT DISTINCT source FROM m) s, (SELECT DISTINCT path FROM m) p)
SELECT path, source, value FROM g LEFT JOIN m USING (source, path)
UNION ALL SELECT 'summary.total_samples_across_sources', 'all', CAST(CAST(sum(v) AS BIGINT) AS VARCHAR) FROM c""")
def _(spark, sf):
    # what is an object for one source may be a word for another
    li = read(spark, sf, "lineitem").withColumnRenamed("l_returnflag", "source")
    per = li.groupBy("source", F.col("l_linenumber").cast("string").alias("line")).agg(F.count("*").alias("v"), F.count_if(F.col("l_linestatus") == "O").alias("o"))
    lines = F.map_from_entries(F.collect_list(F.when(~((F.col("source") == "A") & (F.col("line") == "3")), F.struct("line", "v"))))
    m = per.groupBy("source").agg(lines.alias("lines"), F.sum("v").alias("total_samples_created"), F.sum("o").alias("open"))
    closed = (F.col("total_samples_created") - F.col("open")).alias("closed")
    status = F.when(F.col("source") == "A", F.lit('"done"')).otherwise(F.to_json(F.struct("open", closed)))
    text = F.concat(F.lit('{"processing":'), F.to_json(F.struct("lines", "total_samples_created")), F.lit(',"none":null,"steps":[1,2],"status":'), status, F.lit("}"))
    merged = nested.merge(m.select("source", F.parse_json(text).alias("m")), "source", "m")
    total = m.agg(F.sum("total_samples_created").cast("string").alias("value"))
    return merged.unionByName(total.select(F.lit("summary.total_samples_across_sources").alias("path"), F.lit("all").alias("source"), "value"))


@query("D26_derive_dataset_fields", """SELECT count(DISTINCT l_returnflag) AS datasets, min(past) AS past, min(future) AS future, CAST(sum(width) AS BIGINT) AS dims FROM
(SELECT l_returnflag, max(l_linenumber) AS past, max(l_linenumber) * 2 AS future, count(DISTINCT l_linenumber) AS width FROM lineitem GROUP BY 1)""")
def _(spark, sf):
    per = read(spark, sf, "lineitem").groupBy("l_returnflag").agg(F.max("l_linenumber").alias("past"), (F.max("l_linenumber") * 2).alias("future"), F.countDistinct("l_linenumber").alias("width"))
    out = per.agg(F.countDistinct("l_returnflag").alias("datasets"), F.min("past").alias("past"), F.min("future").alias("future"), F.sum("width").alias("dims"))
    asked = F.when(F.col("past") < 1, F.raise_error(F.lit("more past steps are asked for than there are"))).otherwise(F.col("past"))
    return out.withColumn("past", asked)


@query("D29_run_summary", f"WITH {SH} SELECT dataset, count(*) AS shards, CAST(sum(num_sequences) AS BIGINT) AS samples, count(*) FILTER (WHERE num_sequences < 30) AS failed FROM man GROUP BY GROUPING SETS ((dataset), ())")
def _(spark, sf):
    return manifest(spark, sf).rollup("dataset").agg(F.count("*").alias("shards"), F.sum("num_sequences").alias("samples"), F.count_if(F.col("num_sequences") < 30).alias("failed"))


@query("C15_verify_dataset_counts", f"""WITH {SH}, m AS (SELECT dataset AS task, CAST(sum(num_sequences) AS BIGINT) AS manifest FROM man GROUP BY 1), s AS (SELECT l_returnflag AS task, count(*) AS stats FROM lineitem WHERE l_returnflag <> 'A' GROUP BY 1),
x AS (SELECT l_returnflag AS task, count(*) + CASE l_returnflag WHEN 'N' THEN 1 ELSE 0 END AS meta FROM lineitem GROUP BY 1)
SELECT m.task, manifest, array_to_string(list_filter([CASE WHEN stats IS NULL THEN 'no statistics' WHEN stats <> manifest THEN 'statistics differ' END, CASE WHEN meta <> manifest THEN 'metadata differ' END], lambda y: y IS NOT NULL), ',') AS reasons FROM m LEFT JOIN s USING (task) LEFT JOIN x USING (task)""")
def _(spark, sf):
    li = read(spark, sf, "lineitem").groupBy(F.col("l_returnflag").alias("task")).agg(F.count("*").alias("n"))
    m = manifest(spark, sf).groupBy(F.col("dataset").alias("task")).agg(F.sum("num_sequences").alias("manifest"))
    stats = li.where("task <> 'A'").select("task", F.col("n").alias("stats"))
    meta = li.select("task", (F.col("n") + F.when(F.col("task") == "N", 1).otherwise(0)).alias("meta"))
    rows = m.join(stats, "task", "left").join(meta, "task", "left")
    reasons = F.array_compact(F.array(
        F.when(F.col("stats").isNull(), "no statistics").when(F.col("stats") != F.col("manifest"), "statistics differ"),
        F.when(F.col("meta") != F.col("manifest"), "metadata differ"),
    ))
    return rows.select("task", "manifest", F.array_join(reasons, ",").alias("reasons"))
