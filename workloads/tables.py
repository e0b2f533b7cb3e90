"""Sources, table maintenance and preparation."""

import datetime as dt

from pyspark.sql import functions as F

from runlens.functions import durations as dur
from runlens.functions import labels as lab
from runlens.operators import prep
from runlens.schema import RUNS
from runlens.session import stored
from runlens.sources import sample_history as history
from runlens.sources import tables
from workloads.base import r4, sql, stamp

NOW = dt.datetime(2001, 8, 1)
Q, O = {}, {}


def _a5(s, d):
    audit = tables.slice_audit(history.runs(s, d), dt.datetime(1995, 1, 1), dt.datetime(2001, 9, 1), 7, 5)
    return audit.select("workflow_id", "slice", "runs", "truncated")


Q["a5_slice_audit"] = _a5
O["a5_slice_audit"] = sql("""
, counted AS (
  SELECT workflow_id, CAST(floor((epoch(created_at) - epoch(TIMESTAMP '1995-01-01')) / (7 * 86400)) AS BIGINT) AS slice,
    count(*) AS runs FROM listed WHERE created_at >= TIMESTAMP '1995-01-01' AND created_at < TIMESTAMP '2001-09-01' GROUP BY ALL)
SELECT w.workflow_id, g.slice, coalesce(c.runs, 0) AS runs, coalesce(c.runs, 0) > 5 AS truncated
FROM (SELECT DISTINCT workflow_id FROM listed) w
CROSS JOIN (SELECT CAST(unnest(range(0, CAST(ceil((epoch(TIMESTAMP '2001-09-01') - epoch(TIMESTAMP '1995-01-01')) / (7 * 86400)) AS BIGINT))) AS BIGINT) AS slice) g
LEFT JOIN counted c ON c.workflow_id = w.workflow_id AND c.slice = g.slice
""")


def _a7(s, d):
    """First attempts are stored, then the latest attempts of retried runs are saved over them."""
    runs = history.attempts(s, d)
    first = runs.filter("run_attempt = 1")
    later = runs.filter("run_attempt > 1")
    jobs = stored(history.jobs(s, d))
    steps = history.steps_of_jobs(jobs)
    old_jobs = jobs.withColumn("name", F.concat(F.lit("old "), F.col("name")))
    new_jobs = stored(jobs.join(later.select("run_id"), "run_id", "left_semi"))
    new_steps = history.steps_of_jobs(new_jobs)
    old_steps = steps.withColumn("name", F.concat(F.lit("old "), F.col("name")))
    saved = tables.upsert_runs((first, old_jobs, old_steps), (later, new_jobs, new_steps))
    counts = [
        saved[0].groupBy(F.concat(F.lit("attempt "), F.col("run_attempt")).alias("what")),
        saved[1].groupBy(F.concat(F.lit("job "), F.col("name")).alias("what")),
        saved[2].groupBy(F.concat(F.lit("step "), F.col("name")).alias("what")),
    ]
    first, *rest = [c.agg(F.count(F.lit(1)).alias("n")) for c in counts]
    for other in rest:
        first = first.unionByName(other)
    return first


Q["a7_upsert_runs"] = _a7
O["a7_upsert_runs"] = sql("""
, latest AS (SELECT run_id, max(run_attempt) AS a FROM attempts GROUP BY 1)
SELECT 'attempt ' || a AS what, count(*) AS n FROM latest GROUP BY 1
UNION ALL SELECT 'job ' || CASE WHEN a > 1 THEN '' ELSE 'old ' END || job, count(*) FROM jobs JOIN latest USING (run_id) GROUP BY 1
UNION ALL SELECT 'step ' || CASE WHEN a > 1 THEN '' ELSE 'old ' END || step, count(*)
  FROM steps JOIN jobs USING (job_id) JOIN latest USING (run_id) GROUP BY 1
""")

Q["a8_runs_since"] = lambda s, d: tables.runs_since(history.runs(s, d), 2, dt.datetime(1999, 1, 1)).select(
    "run_id", stamp("created_at"), "conclusion"
)
O["a8_runs_since"] = sql("""
SELECT run_id, strftime(created_at, '%Y-%m-%d %H:%M:%S') AS created_at, conclusion FROM listed
WHERE workflow_id = 2 AND created_at >= TIMESTAMP '1999-01-01' AND status = 'completed' ORDER BY listed.created_at, run_id
""")


def _a9(s, d):
    jobs = tables.by_run(stored(history.jobs(s, d)))
    detail = tables.run_details(history.runs(s, d), jobs, history.steps_of_jobs(jobs, "run_id"))
    jobs = F.col("jobs")
    return detail.select(
        "run_id",
        F.coalesce(F.size(jobs), F.lit(0)).cast("bigint").alias("jobs"),
        F.array_join(F.transform(jobs, lambda j: j["name"]), ">").alias("job_order"),
        F.aggregate(jobs, F.lit(0), lambda n, j: n + F.size(j["steps"])).cast("bigint").alias("steps"),
    )


Q["a9_run_details"] = _a9
O["a9_run_details"] = sql("""
SELECT l.run_id, count(j.job_id) AS jobs, string_agg(j.job, '>' ORDER BY j.started_at, j.job_id) AS job_order,
  CASE WHEN count(j.job_id) > 0 THEN 3 * count(j.job_id) END AS steps
FROM listed l LEFT JOIN jobs j ON j.run_id = l.run_id GROUP BY l.run_id
""")

Q["a10_incomplete_ids"] = lambda s, d: tables.incomplete_ids(history.runs(s, d))
O["a10_incomplete_ids"] = sql("SELECT run_id FROM listed WHERE status <> 'completed'")


def _a11(s, d):
    old = history.runs(s, d).drop("event", "node_id")
    return tables.with_defaults(old, RUNS).groupBy("workflow_id", "event", "node_id").agg(F.count(F.lit(1)).alias("runs"))


Q["a11_with_defaults"] = _a11
O["a11_with_defaults"] = sql("SELECT workflow_id, '' AS event, '' AS node_id, count(*) AS runs FROM listed GROUP BY workflow_id")


def _a12(s, d):
    listed = history.runs(s, d)
    stored = listed.filter("head_branch = 'main'")
    split = tables.split_cached(listed, stored)
    return split.groupBy("workflow_id").agg(
        F.count(F.lit(1)).alias("total"), F.count_if(~F.col("cached")).alias("uncached")
    )


Q["a12_split_cached"] = _a12
O["a12_split_cached"] = sql("""
SELECT workflow_id, count(*) AS total, count(*) FILTER (WHERE NOT (head_branch = 'main' AND status = 'completed')) AS uncached
FROM listed GROUP BY 1
""")

Q["a13_orphans"] = lambda s, d: tables.orphans(
    history.jobs(s, d), history.runs(s, d).filter("status = 'completed'"), "run_id"
).select("job_id", "run_id", "name")
O["a13_orphans"] = sql("""
SELECT job_id, run_id, job AS name FROM jobs WHERE run_id NOT IN (SELECT run_id FROM listed WHERE status = 'completed')
""")


def _a14(s, d):
    """Stamps as text, some of them empty or broken, decoded leniently; well-formed ones strictly."""
    text = F.date_format("created_at", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    given = F.when(F.col("run_id") % 5 == 0, "").when(F.col("run_id") % 7 == 0, "not-a-timestamp").otherwise(text)
    clean = F.when(F.col("run_id") % 5 == 0, "").otherwise(text)
    rows = history.runs(s, d).select(
        "run_id", dur.parse_stamp(given, strict=False).alias("lenient"), dur.parse_stamp(clean, strict=True).alias("strict")
    )
    return rows.select("run_id", stamp("lenient"), stamp("strict"))


Q["a14_parse_stamp"] = _a14
O["a14_parse_stamp"] = sql("""
SELECT run_id,
  CASE WHEN run_id % 5 = 0 OR run_id % 7 = 0 THEN NULL ELSE strftime(created_at, '%Y-%m-%d %H:%M:%S') END AS lenient,
  CASE WHEN run_id % 5 = 0 THEN NULL ELSE strftime(created_at, '%Y-%m-%d %H:%M:%S') END AS strict FROM listed
""")


def _a15(s, d):
    text = lab.labels_to_text(F.col("labels"))
    back = lab.labels_from_text(text)
    return history.jobs(s, d).select("job_id", text.alias("text"), F.size(back).cast("bigint").alias("labels"),
                                     (back == F.col("labels")).alias("same"))


Q["a15_labels_text"] = _a15
O["a15_labels_text"] = sql("""
SELECT job_id, labels AS text, CASE WHEN labels = '' THEN 0 ELSE len(string_split(labels, ',')) END AS labels, true AS same FROM jobs
""")

Q["b1_job_durations"] = lambda s, d: prep.with_duration(history.jobs(s, d)).select("job_id", r4("duration_s", "duration_s"))
O["b1_job_durations"] = sql("SELECT job_id, dur AS duration_s FROM jobs")

Q["b2_run_durations"] = lambda s, d: prep.run_durations(history.runs(s, d, with_updated=True), history.jobs(s, d)).select(
    "run_id", r4("duration_s", "duration_s")
)
O["b2_run_durations"] = sql("""
SELECT l.run_id, coalesce(CAST(epoch(max(j.completed_at)) - epoch(l.started_at) AS DOUBLE), 0e0) AS duration_s
FROM listed l LEFT JOIN jobs j ON j.run_id = l.run_id GROUP BY l.run_id, l.started_at
""")

Q["b3_completed"] = lambda s, d: history.runs(s, d).groupBy("workflow_id", prep.is_completed().alias("done")).agg(
    F.count(F.lit(1)).alias("runs")
)
O["b3_completed"] = sql("SELECT workflow_id, status = 'completed' AS done, count(*) AS runs FROM listed GROUP BY ALL")

Q["b4_filter_branch"] = lambda s, d: prep.filter_branch(history.runs(s, d), "feature").select("run_id", "workflow_id")
O["b4_filter_branch"] = sql("SELECT run_id, workflow_id FROM listed WHERE head_branch = 'feature'")

Q["b5_exclude_failures"] = lambda s, d: prep.exclude_failures(history.runs(s, d)).select("run_id", "conclusion")
O["b5_exclude_failures"] = sql("SELECT run_id, conclusion FROM listed WHERE conclusion = 'success'")

Q["b6_dedup_retries"] = lambda s, d: prep.dedup_retries(history.attempts(s, d)).select("run_id", "run_attempt", "conclusion")
O["b6_dedup_retries"] = sql("""
SELECT run_id, run_attempt, conclusion FROM attempts
QUALIFY row_number() OVER (PARTITION BY run_id ORDER BY run_attempt DESC) = 1
""")

Q["b7_preprocess"] = lambda s, d: prep.preprocess(history.attempts(s, d), "main")[0].select("run_id", "run_attempt", "head_branch")
O["b7_preprocess"] = sql("SELECT run_id, run_attempt, head_branch FROM listed WHERE head_branch = 'main' AND conclusion = 'success'")

Q["b7_preprocess_diagnostics"] = lambda s, d: prep.preprocess(history.attempts(s, d), "main")[1]
O["b7_preprocess_diagnostics"] = sql("""
SELECT 'info' AS severity, 'preprocess' AS kind, 'global' AS scope,
  'deduplicated ' || ((SELECT count(*) FROM attempts) - (SELECT count(*) FROM listed)) || ' retried runs' AS message
UNION ALL
SELECT 'info', 'preprocess', 'global', 'excluded ' || count(*) || ' non-success runs from duration analysis'
FROM listed WHERE head_branch = 'main' AND conclusion <> 'success'
""")

Q["b8_filter_since"] = lambda s, d: prep.filter_since(history.runs(s, d), "18mo", NOW).select("run_id")
O["b8_filter_since"] = sql("SELECT run_id FROM listed WHERE created_at >= TIMESTAMP '2001-08-01' - INTERVAL 18 MONTH")

Q["b9_filter_workflow"] = lambda s, d: prep.filter_workflow(history.runs(s, d), "2-HIGH").select("run_id", "workflow_name")
O["b9_filter_workflow"] = sql("SELECT run_id, workflow_name FROM listed WHERE workflow_name = '2-HIGH'")

Q["b10_workflow_names"] = lambda s, d: prep.with_workflow_name(history.runs(s, d), history.workflows(s, d)).groupBy(
    "workflow_id", "workflow"
).agg(F.count(F.lit(1)).alias("runs"))
O["b10_workflow_names"] = sql("""
SELECT workflow_id, coalesce(name, 'workflow-' || workflow_id) AS workflow, count(*) AS runs
FROM listed LEFT JOIN names USING (workflow_id) GROUP BY ALL
""")

Q["b11_missing_labels"] = lambda s, d: prep.missing_labels(history.jobs(s, d))
O["b11_missing_labels"] = sql("""
SELECT 'info' AS severity, 'partial_data' AS kind, 'global' AS scope, 'runner labels unavailable for ' || count(*)
  || ' jobs (cost estimates use default 1x Linux rate)' AS message FROM jobs WHERE labels = ''
""")

Q["b12_result_meta"] = lambda s, d: prep.result_meta(history.runs(s, d)).select(
    "total_runs", stamp("first_created"), stamp("last_created"), F.concat_ws(",", F.col("workflow_ids").cast("array<string>")).alias("ids")
)
O["b12_result_meta"] = sql("""
SELECT count(*) AS total_runs, strftime(min(created_at), '%Y-%m-%d %H:%M:%S') AS first_created,
  strftime(max(created_at), '%Y-%m-%d %H:%M:%S') AS last_created,
  (SELECT string_agg(CAST(workflow_id AS VARCHAR), ',' ORDER BY workflow_id) FROM (SELECT DISTINCT workflow_id FROM listed)) AS ids
FROM listed
""")
