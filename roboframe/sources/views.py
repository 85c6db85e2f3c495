"""Robot-learning tables derived from the test tables, and the same views as SQL common table expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def seconds(column: str = "ts"):
    """Seconds since 2024-01-01 of a timestamp without zone."""
    return F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ'2024-01-01 00:00:00', {column}) / 1e6")


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw frames: episode, ts, ordinal, x (one channel)."""
    e = read(spark, sf_dir, "events")
    return e.select(F.col("user_id").alias("episode"), "ts", F.col("event_id").alias("ordinal"), F.col("value").alias("x"))


EP = """raw AS (SELECT user_id AS episode, ts, event_id AS ordinal, value AS x FROM events),
ep AS (SELECT *, CAST(row_number() OVER (PARTITION BY episode ORDER BY ts, ordinal) - 1 AS INTEGER) AS t,
         CAST(count(*) OVER (PARTITION BY episode) AS INTEGER) AS n FROM raw)"""


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Message log: event_id, episode, topic, s (seconds), value, props (JSON)."""
    e = read(spark, sf_dir, "events")
    return e.select("event_id", F.col("user_id").alias("episode"), F.col("event_type").alias("topic"), seconds().alias("s"), "value", "props")


EV = """ev AS (SELECT event_id, user_id AS episode, event_type AS topic,
  CAST(date_diff('microsecond', TIMESTAMP '2024-01-01 00:00:00', ts) AS DOUBLE) / 1e6 AS s, value, props FROM events)"""


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors: vec_id, label, v (doubles)."""
    v = read(spark, sf_dir, "embeddings")
    return v.select("vec_id", "label", F.col("embedding").cast("array<double>").alias("v"))


VE = "ve AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings)"


def rollouts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rollouts: task, model, demo_id, success (null: pending), pending, duration."""
    d = read(spark, sf_dir, "documents").select("doc_id", "source", "lang", "n_chars")
    r = d.join(read(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id", "left")
    return r.select(
        F.col("source").alias("task"),
        F.col("lang").alias("model"),
        F.col("doc_id").alias("demo_id"),
        (F.col("quality") == 1).alias("success"),
        (F.col("quality").isNull() & (F.col("doc_id") % 3 != 0)).alias("pending"),
        (F.col("n_chars") / 10.0).alias("duration"),
    )


RO = """ro AS (SELECT source AS task, lang AS model, d.doc_id AS demo_id, quality = 1 AS success,
  (quality IS NULL AND d.doc_id % 3 <> 0) AS pending, n_chars / 10.0 AS duration
  FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)"""


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs: run_id, task_name, ablation, campaign_name."""
    c = read(spark, sf_dir, "customer")
    return c.select(
        F.col("c_custkey").alias("run_id"),
        F.col("c_mktsegment").alias("task_name"),
        F.concat(F.lit("ablation_"), F.col("c_nationkey") % 5).alias("ablation"),
        F.concat(F.lit("camp_"), F.col("c_nationkey") % 3).alias("campaign_name"),
        F.col("c_acctbal").alias("score"),
    )


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples of evaluations: run_id, sample_index, success, priority, created."""
    o = read(spark, sf_dir, "orders")
    return o.select(
        F.col("o_custkey").alias("run_id"),
        F.col("o_orderkey").alias("sample_index"),
        (F.col("o_orderstatus") == "F").alias("success"),
        F.col("o_orderpriority").alias("tag"),
        F.col("o_orderdate").alias("created"),
        F.col("o_totalprice").alias("reward"),
    )


def evaluations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evaluations: one per run that has samples."""
    return samples(spark, sf_dir).groupBy("run_id").agg(
        F.count("*").alias("total_rollouts"), F.count_if("success").alias("successes"), F.max("created").alias("evaluated_at")
    )


RN = """runs AS (SELECT c_custkey AS run_id, c_mktsegment AS task_name, 'ablation_' || (c_nationkey % 5) AS ablation,
  'camp_' || (c_nationkey % 3) AS campaign_name, c_acctbal AS score FROM customer),
samples AS (SELECT o_custkey AS run_id, o_orderkey AS sample_index, o_orderstatus = 'F' AS success, o_orderpriority AS tag,
  o_orderdate AS created, o_totalprice AS reward FROM orders),
evals AS (SELECT run_id, count(*) AS total_rollouts, count(*) FILTER (WHERE success) AS successes, max(created) AS evaluated_at
  FROM samples GROUP BY run_id)"""


def manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Manifest: dataset, shard, num_sequences."""
    li = read(spark, sf_dir, "lineitem")
    return (
        li.groupBy(F.col("l_returnflag").alias("dataset"), F.format_string("%08d", F.col("l_orderkey") % 64).alias("shard"))
        .agg(F.count("*").alias("num_sequences"))
        .select("dataset", "shard", "num_sequences")
    )


SH = """man AS (SELECT l_returnflag AS dataset, lpad(CAST(l_orderkey % 64 AS VARCHAR), 8, '0') AS shard, count(*) AS num_sequences
  FROM lineitem GROUP BY ALL)"""


def listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files: path, size."""
    s, n, r = (read(spark, sf_dir, t) for t in ("supplier", "nation", "region"))
    place = s.join(F.broadcast(n), s["s_nationkey"] == n["n_nationkey"]).join(F.broadcast(r), n["n_regionkey"] == r["r_regionkey"])
    k = F.explode(F.sequence(F.lit(0), F.col("s_suppkey").cast("int") % 7)).alias("k")
    ext = F.element_at(F.array(F.lit("json"), F.lit("tar"), F.lit("npz")), (F.col("k") % 3 + 1).cast("int"))
    out = place.select("r_name", "n_name", "s_name", "s_suppkey", k)
    return out.select(
        F.concat_ws("/", "r_name", "n_name", "s_name", F.concat(F.format_string("file_%04d.", "k"), ext)).alias("path"),
        (F.col("s_suppkey") * 10 + F.col("k")).alias("size"),
    )


LS = """ls AS (SELECT r_name || '/' || n_name || '/' || s_name || '/file_' || lpad(CAST(k AS VARCHAR), 4, '0') || '.' ||
    (['json', 'tar', 'npz'])[k % 3 + 1] AS path, s_suppkey * 10 + k AS size
  FROM (SELECT *, unnest(range(0, s_suppkey % 7 + 1)) AS k FROM supplier)
  JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""
