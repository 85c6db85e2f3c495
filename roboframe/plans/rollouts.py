"""Queries over rollouts, runs and evaluations."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import results as R
from ..registry import query
from ..sources import files, filesets
from ..sources.views import RN, RO, evaluations, rollouts, runs, samples

SUM = """sm AS (SELECT task, model, count(*) FILTER (WHERE success IS NOT NULL) AS total, count(*) FILTER (WHERE success) AS successes,
  count(*) FILTER (WHERE success IS NULL AND pending) AS pending, count(*) FILTER (WHERE success IS NULL AND NOT pending) AS crashed,
  avg(duration) FILTER (WHERE success IS NOT NULL) AS mean_duration FROM ro GROUP BY ALL)"""


def summary(spark, sf):
    return R.success_summary(rollouts(spark, sf))


@query("D09_success_summary", f"WITH {RO}, {SUM} SELECT task, model, total, successes, round(100.0 * successes / nullif(total, 0), 6) AS pct, round(mean_duration, 6) AS mean_duration, pending, crashed FROM sm")
def _(spark, sf):
    return summary(spark, sf).withColumn("pct", F.round("pct", 6)).withColumn("mean_duration", F.round("mean_duration", 6))


@query("A13_scan_rollout_results", f"WITH {RO} SELECT task, model, demo_id, success, pending, round(duration, 3) AS duration FROM ro")
def _(spark, sf):
    # a results file for each task and model
    root, r = files.scratch(spark), rollouts(spark, sf)
    one = F.struct(
        F.lit("skill").alias("skill_type"), F.col("demo_id").cast("int").alias("scenario_index"), F.col("success").alias("is_success"),
        F.col("pending").alias("is_pending"), F.col("duration").alias("total_time"), F.lit("").alias("failure_message"),
    )
    held = r.groupBy("task", "model").agg(F.to_json(F.struct(F.lit(50).alias("max_sample_size_per_model"), F.collect_list(one).alias("evaluations"))).alias("content"))
    path = F.concat("model", F.lit("/"), "task", F.lit("/rollouts/2025-01-01T00-00-00/results.json"))
    filesets.write_files(held.select(path.alias("path"), "content"), f"{root}/raw")
    rows = files.scan_results(spark, f"{root}/raw")
    return rows.select("task", "model", F.col("demo_id").cast("long").alias("demo_id"), "success", "pending", F.round("duration", 3).alias("duration"))


@query("D10_pending_crashed", f"WITH {RO}, {SUM} SELECT task, model, pending, crashed FROM sm")
def _(spark, sf):
    return summary(spark, sf).select("task", "model", "pending", "crashed")


def tail_sql(k, n, p):
    """P(X >= k) of a binomial X, summed by its terms."""
    return f"coalesce(list_sum(list_transform(range({k}, {n} + 1), lambda i: exp(lgamma({n} + 1.0) - lgamma(i + 1.0) - lgamma({n} - i + 1.0) + i * ln({p}) + ({n} - i) * ln(1 - ({p}))))), 0)"


@query("D11_binomial_ci", f"""WITH RECURSIVE {RO}, {SUM}, b AS (SELECT task, model, successes AS k, total AS n, 0.0::DOUBLE AS l0, 1.0::DOUBLE AS l1, 0.0::DOUBLE AS h0, 1.0::DOUBLE AS h1, 0 AS step FROM sm
UNION ALL SELECT task, model, k, n, CASE WHEN low THEN (l0 + l1) / 2 ELSE l0 END, CASE WHEN low THEN l1 ELSE (l0 + l1) / 2 END, CASE WHEN high THEN (h0 + h1) / 2 ELSE h0 END, CASE WHEN high THEN h1 ELSE (h0 + h1) / 2 END, step + 1
  FROM (SELECT *, k > 0 AND {tail_sql('k', 'n', '(l0 + l1) / 2')} < 0.05 AS low, k = n OR {tail_sql('k + 1', 'n', '(h0 + h1) / 2')} < 0.95 AS high FROM b WHERE step < 40))
SELECT task, model, k AS successes, n AS total, round(l0, 6) AS low, round(h1, 6) AS high FROM b WHERE step = 40""")
def _(spark, sf):
    s = summary(spark, sf).select("task", "model", "successes", "total")
    ci = R.binomial_ci(0.9)(F.col("successes"), F.col("total"))
    end = lambda i: F.round(F.get("ci", F.lit(i)), 6)
    return s.withColumn("ci", ci).select("task", "model", "successes", "total", end(0).alias("low"), end(1).alias("high"))


@query("D12_beta_posterior", f"WITH {RO}, {SUM} SELECT task, model, 1 + successes AS a, 1 + total - successes AS b FROM sm")
def _(spark, sf):
    s = summary(spark, sf)
    return s.select("task", "model", (1 + F.col("successes")).alias("a"), (1 + F.col("total") - F.col("successes")).alias("b"))


@query("D12b_beta_quantiles", f"""WITH RECURSIVE {RO}, {SUM}, c AS (SELECT task, model, 1 + successes AS a, 1 + total - successes AS b, share, 0.0::DOUBLE AS lo, 1.0::DOUBLE AS hi, 0 AS step FROM sm, (SELECT unnest([0.025, 0.25, 0.5, 0.75, 0.975]) AS share)
UNION ALL SELECT task, model, a, b, share, CASE WHEN low THEN (lo + hi) / 2 ELSE lo END, CASE WHEN low THEN hi ELSE (lo + hi) / 2 END, step + 1
  FROM (SELECT *, {tail_sql('a', '(a + b - 1)', '(lo + hi) / 2')} < share AS low FROM c WHERE step < 40))
SELECT task, model, a, b, list(round((lo + hi) / 2, 6) ORDER BY share) AS q FROM c WHERE step = 40 GROUP BY ALL""")
def _(spark, sf):
    s = summary(spark, sf).select("task", "model", (1 + F.col("successes")).alias("a"), (1 + F.col("total") - F.col("successes")).alias("b"))
    return s.withColumn("q", F.transform(R.beta_quantiles("a", "b"), lambda x: F.round(x, 6)))


@query("D12c_beta_draws", f"""WITH RECURSIVE {RO}, {SUM}, c AS (SELECT task, model, i, 1 + successes AS a, 1 + total - successes AS b,
  (CAST('0x' || substr(md5('42|' || task || '|' || model || '|' || i), 1, 13) AS BIGINT) + 0.5) / 4503599627370496 AS share, 0.0::DOUBLE AS lo, 1.0::DOUBLE AS hi, 0 AS step
  FROM sm, (SELECT CAST(unnest(range(20)) AS INTEGER) AS i)
UNION ALL SELECT task, model, i, a, b, share, CASE WHEN low THEN (lo + hi) / 2 ELSE lo END, CASE WHEN low THEN hi ELSE (lo + hi) / 2 END, step + 1
  FROM (SELECT *, {tail_sql('a', '(a + b - 1)', '(lo + hi) / 2')} < share AS low FROM c WHERE step < 40))
SELECT task, model, i, round((lo + hi) / 2, 6) AS draw FROM c WHERE step = 40""")
def _(spark, sf):
    s = summary(spark, sf).select("task", "model", (1 + F.col("successes")).alias("a"), (1 + F.col("total") - F.col("successes")).alias("b"))
    return R.beta_draws(s, ["task", "model"], "a", "b", 20, 42).withColumn("draw", F.round("draw", 6))


BAL = f"""{SUM}, ct AS (SELECT task, count(*) AS k, min(total) AS least FROM sm WHERE total > 0 GROUP BY task), nm AS (SELECT count(DISTINCT model) AS m FROM sm WHERE total > 0),
cm AS (SELECT task, least FROM ct, nm WHERE k = m), fl AS (SELECT min(least) AS f FROM cm)"""


@query("D13_balanced_success", f"""WITH {RO}, {BAL}, r AS (SELECT *, row_number() OVER (PARTITION BY task, model ORDER BY demo_id) AS k FROM ro WHERE success IS NOT NULL AND task IN (SELECT task FROM cm))
SELECT task, model, demo_id, success FROM r, fl WHERE k <= f""")
def _(spark, sf):
    return R.balanced_success(rollouts(spark, sf))[0].select("task", "model", "demo_id", "success")


@query("G05_common_tasks", f"WITH {RO}, {BAL} SELECT task FROM ct, nm WHERE k < m")
def _(spark, sf):
    return R.balanced_success(rollouts(spark, sf))[1]


PAIRS = f"""{SUM}, pr AS (SELECT x.task, x.model AS a, y.model AS b, x.total AS na, x.successes AS ka, y.total AS nb, y.successes AS kb FROM sm x JOIN sm y ON x.task = y.task AND x.model < y.model),
pz AS (SELECT *, CASE WHEN na = 0 OR nb = 0 OR ka + kb = 0 OR ka + kb = na + nb THEN 0.0 ELSE (ka / na - kb / nb) / sqrt(((ka + kb) / (na + nb)) * (1 - (ka + kb) / (na + nb)) * (1 / na + 1 / nb)) END AS z FROM pr)"""


@query("D14_two_proportion_z", f"WITH {RO}, {PAIRS} SELECT task, a, b, round(z, 6) AS z, CASE WHEN abs(z) > 1.959963984540054 THEN CAST(sign(z) AS INTEGER) ELSE 0 END AS verdict FROM pz")
def _(spark, sf):
    return R.pairwise(summary(spark, sf), "task", "model").select("task", "a", "b", F.round("z", 6).alias("z"), "verdict")


@query("C12_pairwise_models", f"""WITH {RO}, r AS (SELECT *, row_number() OVER (PARTITION BY task, model ORDER BY demo_id) AS k FROM ro WHERE success IS NOT NULL)
SELECT a.task, a.model AS a, b.model AS b, count(*) AS n, count(*) FILTER (WHERE a.success) AS ka, count(*) FILTER (WHERE b.success) AS kb FROM r a JOIN r b ON a.task = b.task AND a.model < b.model AND a.k = b.k GROUP BY ALL""")
def _(spark, sf):
    return R.paired(rollouts(spark, sf))


@query("D15_compact_letters", f"""WITH RECURSIVE {RO}, {PAIRS}, o AS (SELECT task, list(model ORDER BY successes / greatest(total, 1) DESC, model) AS un FROM sm GROUP BY task),
df AS (SELECT task, list(a || '|' || b) AS apart FROM pz WHERE abs(z) > 1.2815515655446004 GROUP BY task),
st AS (SELECT o.task, coalesce(apart, CAST([] AS VARCHAR[])) AS apart, un, CAST([] AS VARCHAR[]) AS got, 0 AS k FROM o LEFT JOIN df USING (task)
UNION ALL SELECT task, apart, list_filter(un, lambda y: NOT list_contains(m, y)), m, k + 1
  FROM (SELECT *, list_filter(un, lambda y: y = un[1] OR NOT (list_contains(apart, un[1] || '|' || y) OR list_contains(apart, y || '|' || un[1]))) AS m FROM st WHERE len(un) > 0))
SELECT task, unnest(got) AS model, chr(CAST(96 + k AS INTEGER)) AS letters FROM st WHERE k > 0""")
def _(spark, sf):
    s = summary(spark, sf)
    return R.compact_letters(s, R.pairwise(s, "task", "model", 0.2), "task", "model")


@query("D16_aggregate_by_ablation", f"""WITH {RN} SELECT ablation, CAST(sum(total_rollouts) AS BIGINT) AS total, CAST(sum(successes) AS BIGINT) AS successes, round(avg(successes / total_rollouts), 6) AS mean_rate FROM evals JOIN runs USING (run_id) GROUP BY ablation""")
def _(spark, sf):
    e = evaluations(spark, sf).join(runs(spark, sf), "run_id")
    return e.groupBy("ablation").agg(F.sum("total_rollouts").alias("total"), F.sum("successes").alias("successes"), F.round(F.avg(F.col("successes") / F.col("total_rollouts")), 6).alias("mean_rate"))


@query("D17_overall_stats", f"""WITH {RN} SELECT count(*) AS evaluations, CAST(sum(total_rollouts) AS BIGINT) AS rollouts, round(avg(successes / total_rollouts), 6) AS mean_rate, count(DISTINCT task_name) AS tasks, count(DISTINCT campaign_name) AS campaigns FROM evals JOIN runs USING (run_id)""")
def _(spark, sf):
    e = evaluations(spark, sf).join(runs(spark, sf), "run_id")
    return e.agg(F.count("*").alias("evaluations"), F.sum("total_rollouts").alias("rollouts"), F.round(F.avg(F.col("successes") / F.col("total_rollouts")), 6).alias("mean_rate"),
                 F.countDistinct("task_name").alias("tasks"), F.countDistinct("campaign_name").alias("campaigns"))


@query("D18_distinct_dimension", f"WITH {RN} SELECT DISTINCT task_name FROM runs WHERE task_name IS NOT NULL ORDER BY 1")
def _(spark, sf):
    return runs(spark, sf).select("task_name").where("task_name IS NOT NULL").distinct().orderBy("task_name")


@query("D21_group_stats", f"""WITH {RO} SELECT CASE WHEN grouping(task) = 1 THEN 'all' ELSE coalesce(task, 'Unknown Task') END AS task, count(*) AS total, count(*) FILTER (WHERE success) AS successes, round(avg(duration), 6) AS mean_duration FROM ro WHERE success IS NOT NULL GROUP BY GROUPING SETS ((task), ())""")
def _(spark, sf):
    r = rollouts(spark, sf).where("success IS NOT NULL").withColumn("task", F.coalesce("task", F.lit("Unknown Task")))
    out = r.rollup("task").agg(F.count("*").alias("total"), F.count_if("success").alias("successes"), F.round(F.avg("duration"), 6).alias("mean_duration"))
    return out.withColumn("task", F.coalesce("task", F.lit("all")))


@query("D36_pivot_rates", f"""WITH {RO}, {SUM} SELECT task, {', '.join(f"round(coalesce(max(100.0 * successes / nullif(total, 0)) FILTER (WHERE model = '{m}'), 0), 6) AS {m}" for m in ('de', 'en', 'es', 'fr'))} FROM sm GROUP BY task""")
def _(spark, sf):
    return R.pivot_rates(summary(spark, sf).withColumn("pct", F.round("pct", 6)))


@query("A20_export_summary", f"WITH {RO}, {SUM} SELECT task, model, total, successes FROM sm ORDER BY successes DESC")
def _(spark, sf):
    path = files.scratch(spark)
    files.export_csv(summary(spark, sf).orderBy(F.desc("pct"), "task", "model").select("task", "model", "total", "successes"), path)
    return spark.read.schema("task string, model string, total long, successes long").option("header", True).csv(path)


@query("A22_results_to_summaries", f"WITH {RO} SELECT task, model, demo_id, success FROM ro WHERE success IS NOT NULL AND demo_id % 10 <> 0")
def _(spark, sf):
    r = rollouts(spark, sf).where("success IS NOT NULL").select("task", "model", "demo_id", "success")
    have = r.where("demo_id % 10 = 0").select("task", "model", "demo_id")
    return r.join(have, ["task", "model", "demo_id"], "left_anti")


@query("B19_result_filters", f"WITH {RO} SELECT task, model, demo_id FROM ro WHERE contains(lower(task), 'rc1') AND model IN ('en', 'fr') AND success")
def _(spark, sf):
    return rollouts(spark, sf).where(F.lower("task").contains("rc1") & F.col("model").isin("en", "fr") & F.col("success")).select("task", "model", "demo_id")


@query("C06_expected_minus_existing", f"WITH {RO}, t AS (SELECT DISTINCT task, unnest(range(0, 300)) AS demo_id FROM ro) SELECT task, CAST(demo_id AS BIGINT) AS demo_id FROM t WHERE NOT EXISTS (SELECT 1 FROM ro WHERE ro.task = t.task AND ro.demo_id = t.demo_id)")
def _(spark, sf):
    return R.missing_indices(rollouts(spark, sf), "task", "demo_id", 0, 300)


@query("G06_index_ranges", f"""WITH {RO}, d AS (SELECT model, demo_id, demo_id - row_number() OVER (PARTITION BY model ORDER BY demo_id) AS i FROM ro WHERE demo_id % 7 <> 3),
r AS (SELECT model AS task, min(demo_id) AS lo, max(demo_id) AS hi FROM d GROUP BY model, i) SELECT task, string_agg(CASE WHEN lo = hi THEN CAST(lo AS VARCHAR) ELSE lo || '-' || hi END, ',' ORDER BY lo) AS ranges FROM r GROUP BY task""")
def _(spark, sf):
    r = rollouts(spark, sf).where("demo_id % 7 <> 3").select(F.col("model").alias("task"), "demo_id")
    return R.index_ranges(r, "task", "demo_id")


@query("C08_overlap_guard", f"WITH {RO} SELECT task, count(*) AS overlapping, count(*) + 20 > 60 AS over_budget FROM ro WHERE demo_id BETWEEN 100 AND 400 GROUP BY task")
def _(spark, sf):
    wanted = spark.range(100, 401).withColumnRenamed("id", "demo_id")
    hit = rollouts(spark, sf).join(wanted, "demo_id", "left_semi").groupBy("task").agg(F.count("*").alias("overlapping"))
    return hit.withColumn("over_budget", F.col("overlapping") + 20 > 60)


@query("C09_duplicate_guard", f"WITH {RO}, d AS (SELECT task, model, demo_id // 2 AS demo_id FROM ro) SELECT task, model, demo_id, count(*) AS n FROM d GROUP BY ALL HAVING count(*) > 1 UNION ALL SELECT 'all', 'all', count(*), 0 FROM ro")
def _(spark, sf):
    r = rollouts(spark, sf)
    d = R.duplicate_guard(r.withColumn("demo_id", F.floor(F.col("demo_id") / 2)))
    return d.unionByName(r.agg(F.lit("all").alias("task"), F.lit("all").alias("model"), F.count("*").alias("demo_id"), F.lit(0).cast("long").alias("n")))


@query("G02_union_result_files", f"WITH {RO} SELECT task, model, count(*) AS n FROM ro GROUP BY ALL")
def _(spark, sf):
    r = rollouts(spark, sf)
    both = r.where("demo_id % 2 = 0").unionByName(r.where("demo_id % 2 = 1"))
    return R.budget_guard(both, 1_000_000)


@query("C10_runs_evals_join", f"WITH {RN} SELECT e.run_id, total_rollouts, coalesce(task_name, 'unknown') AS task_name, coalesce(ablation, 'none') AS ablation FROM evals e LEFT JOIN (SELECT * FROM runs WHERE run_id % 3 <> 0) r USING (run_id)")
def _(spark, sf):
    r = runs(spark, sf).where("run_id % 3 <> 0")
    e = evaluations(spark, sf).join(r, "run_id", "left").fillna({"task_name": "unknown", "ablation": "none"})
    return e.select("run_id", "total_rollouts", "task_name", "ablation")


@query("C11_selection_compare", f"WITH {RN} SELECT run_id, campaign_name, total_rollouts, successes FROM evals JOIN runs USING (run_id) WHERE run_id % 10 = 1 AND campaign_name = 'camp_1'")
def _(spark, sf):
    chosen = runs(spark, sf).where("run_id % 10 = 1").select("run_id", F.lit("camp_1").alias("campaign_name"))
    e = evaluations(spark, sf).join(runs(spark, sf).select("run_id", "campaign_name"), "run_id")
    return e.join(chosen, ["run_id", "campaign_name"]).select("run_id", "campaign_name", "total_rollouts", "successes")


@query("C16_samples_vs_aggregate", f"""WITH {RN}, st AS (SELECT run_id, total_rollouts + CASE WHEN run_id % 11 = 0 THEN 1 ELSE 0 END AS total, run_id % 5 = 0 AS direct FROM evals),
sc AS (SELECT run_id, count(*) AS n FROM samples WHERE run_id % 13 <> 0 GROUP BY 1) SELECT run_id, CASE WHEN direct THEN 'exempt' WHEN n IS NULL THEN 'invalid' WHEN n = total THEN 'ok' ELSE 'differs' END AS verdict FROM st LEFT JOIN sc USING (run_id)""")
def _(spark, sf):
    stored = evaluations(spark, sf).select("run_id", (F.col("total_rollouts") + F.when(F.col("run_id") % 11 == 0, 1).otherwise(0)).alias("total"), (F.col("run_id") % 5 == 0).alias("direct"))
    again = samples(spark, sf).where("run_id % 13 <> 0").groupBy("run_id").agg(F.count("*").alias("n"))
    v = F.when(F.col("direct"), "exempt").when(F.col("n").isNull(), "invalid").when(F.col("n") == F.col("total"), "ok").otherwise("differs")
    return stored.join(again, "run_id", "left").select("run_id", v.alias("verdict"))


@query("B18_leaderboard_filter", f"WITH {RN}, g AS (SELECT run_id, list(DISTINCT tag) AS tags FROM samples GROUP BY 1) SELECT run_id, total_rollouts FROM evals JOIN runs USING (run_id) JOIN g USING (run_id) WHERE task_name IN ('MACHINERY', 'BUILDING') AND list_contains(tags, '5-LOW') AND total_rollouts >= 8")
def _(spark, sf):
    tags = samples(spark, sf).groupBy("run_id").agg(F.collect_set("tag").alias("tags"))
    e = evaluations(spark, sf).join(runs(spark, sf), "run_id").join(tags, "run_id")
    return R.leaderboard_filter(e, "tags", ["5-LOW"], 8, task_name=["MACHINERY", "BUILDING"]).select("run_id", "total_rollouts")


@query("E13_latest_n_per_group", f"WITH {RN}, r AS (SELECT task_name, run_id, row_number() OVER (PARTITION BY task_name ORDER BY evaluated_at DESC, run_id) AS k FROM evals JOIN runs USING (run_id)) SELECT task_name, run_id FROM r WHERE k <= 5")
def _(spark, sf):
    k = F.row_number().over(Window.partitionBy("task_name").orderBy(F.desc("evaluated_at"), "run_id"))
    return evaluations(spark, sf).join(runs(spark, sf), "run_id").withColumn("k", k).where("k <= 5").select("task_name", "run_id")


@query("E14_first_occurrence", f"WITH {RN}, r AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY sample_index) AS k FROM samples) SELECT run_id, sample_index FROM r WHERE k = 1")
def _(spark, sf):
    return samples(spark, sf).groupBy("run_id").agg(F.min("sample_index").alias("sample_index"))


@query("A15_scan_run_csv", f"WITH {RN}, r AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY sample_index) AS k FROM samples) SELECT run_id, sample_index, tag FROM r WHERE k = 1")
def _(spark, sf):
    path = files.scratch(spark)
    rows = samples(spark, sf).select("run_id", "sample_index", "tag")
    rows.repartitionByRange(4, "sample_index").sortWithinPartitions("sample_index").write.option("header", True).csv(path)
    return files.scan_run_csv(spark, path, "run_id LONG, sample_index LONG, tag STRING", "run_id")


@query("E15_number_duplicates", f"""WITH {RN}, t AS (SELECT run_id, list_sort(list(DISTINCT tag)) AS tags FROM samples GROUP BY 1), n AS (SELECT run_id, len(tags) = 5 AS plain FROM t)
SELECT run_id, CASE WHEN plain THEN CAST(row_number() OVER (PARTITION BY task_name, plain ORDER BY run_id) AS VARCHAR) END AS number FROM n JOIN runs USING (run_id)""")
def _(spark, sf):
    t = samples(spark, sf).groupBy("run_id").agg(F.collect_set("tag").alias("tags")).join(runs(spark, sf), "run_id")
    plain = F.size("tags") == 5
    k = F.row_number().over(Window.partitionBy("task_name", "plain").orderBy("run_id"))
    return t.withColumn("plain", plain).select("run_id", F.when(F.col("plain"), k.cast("string")).alias("number"))


@query("G04_common_tag_sets", f"""WITH {RN}, t AS (SELECT DISTINCT task_name, run_id, tag FROM samples JOIN runs USING (run_id)), n AS (SELECT task_name, count(DISTINCT run_id) AS n FROM t GROUP BY 1),
k AS (SELECT task_name, tag, count(*) AS k FROM t GROUP BY ALL), c AS (SELECT k.task_name, tag FROM k JOIN n ON n.task_name = k.task_name WHERE k = n)
SELECT t.run_id, string_agg(t.tag, ',' ORDER BY t.tag) FILTER (WHERE c.tag IS NULL) AS own FROM t LEFT JOIN c ON c.task_name = t.task_name AND c.tag = t.tag GROUP BY t.run_id""")
def _(spark, sf):
    t = samples(spark, sf).groupBy("run_id").agg(F.collect_set("tag").alias("tags")).join(runs(spark, sf).select("run_id", "task_name"), "run_id")
    n = t.groupBy("task_name").agg(F.count("*").alias("n"))
    common = t.select("task_name", F.explode("tags").alias("tag")).groupBy("task_name", "tag").agg(F.count("*").alias("k")).join(n, "task_name")
    common = common.groupBy("task_name").agg(F.collect_list(F.when(F.col("k") == F.col("n"), F.col("tag"))).alias("common"))
    own = F.array_join(F.array_sort(F.array_except("tags", "common")), ",")
    return t.join(common, "task_name").select("run_id", F.when(own != "", own).alias("own"))


@query("F03_ranked_results", f"WITH {RN} SELECT run_id, round(successes / total_rollouts, 6) AS rate FROM evals ORDER BY rate DESC, run_id LIMIT 25")
def _(spark, sf):
    rate = F.round(F.col("successes") / F.col("total_rollouts"), 6)
    return evaluations(spark, sf).select("run_id", rate.alias("rate")).orderBy(F.desc("rate"), "run_id").limit(25)


@query("F03b_task_order", f"""WITH {RO}, {SUM}, m AS (SELECT task, avg(100.0 * successes / total) AS mean FROM sm WHERE total > 0 GROUP BY task)
SELECT task, round(mean, 6) AS mean, CAST(row_number() OVER (ORDER BY mean DESC, task) AS INTEGER) AS place FROM m""")
def _(spark, sf):
    return R.task_order(summary(spark, sf)).withColumn("mean", F.round("mean", 6))


@query("F05_page_of_results", f"""WITH {RO}, n AS (SELECT demo_id, task, row_number() OVER (ORDER BY demo_id) - 1 AS k, count(*) OVER () AS n FROM ro)
SELECT demo_id, task, CAST(k // 9 AS INTEGER) AS page FROM n WHERE k // 9 IN (3, (n - 1) // 9)""")
def _(spark, sf):
    # the fourth page, and one far beyond the end, which is the last
    r = rollouts(spark, sf).select("demo_id", "task")
    return R.page_of(r, ["demo_id"], 3).unionByName(R.page_of(r, ["demo_id"], 10**9))


@query("H27_stable_run_id", f"WITH {RN} SELECT run_id, CAST(('0x' || substr(md5('runs/' || run_id), 1, 8)) AS BIGINT) AS id, run_id || '_' || campaign_name AS eval_id FROM runs")
def _(spark, sf):
    h = F.conv(F.substring(F.md5(F.concat(F.lit("runs/"), "run_id").cast("binary")), 1, 8), 16, 10).cast("long")
    return runs(spark, sf).select("run_id", h.alias("id"), F.concat_ws("_", "run_id", "campaign_name").alias("eval_id"))


@query("K07b_replace_evaluation_samples", f"""WITH {RN}, old AS (SELECT run_id, sample_index FROM samples), new AS (SELECT run_id, -sample_index AS sample_index FROM samples WHERE run_id % 4 = 0 AND sample_index % 2 = 0)
SELECT run_id, sample_index FROM old WHERE run_id NOT IN (SELECT run_id FROM new) UNION ALL SELECT run_id, sample_index FROM new""")
def _(spark, sf):
    # an evaluation that comes again brings its own samples: the old ones go, however many there were
    old = samples(spark, sf).select("run_id", "sample_index")
    new = old.where("run_id % 4 = 0 AND sample_index % 2 = 0").withColumn("sample_index", -F.col("sample_index"))
    return R.replace_groups(old, new, ["run_id"])
