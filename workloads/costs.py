"""Billing, runner sizes and outliers."""

from pyspark.sql import functions as F

from runlens.functions import labels as lab
from runlens.operators import cost, outliers, runners
from runlens.sources import sample_history as history
from workloads.base import events, facts, ok_runs, r4, sql, timed_runs

Q, O = {}, {}

RATE = """CASE labels WHEN 'ubuntu-latest' THEN 1e0 WHEN 'ubuntu-latest-8-cores' THEN 4e0 WHEN 'macos-latest' THEN 10e0
  WHEN 'self-hosted,linux' THEN 0e0 ELSE 1e0 END"""
MINUTES = "CASE WHEN dur > 0 THEN ceil(dur / 60) ELSE 0 END"
COST = f"""
, job_costs AS (SELECT workflow_id, job, labels, {RATE} AS multiplier, labels LIKE '%self-hosted%' AS self_hosted, count(*) AS runs,
    CASE WHEN labels LIKE '%self-hosted%' THEN 0 ELSE sum({MINUTES}) * {RATE} END AS billable,
    CASE WHEN labels LIKE '%self-hosted%' THEN sum({MINUTES}) ELSE 0 END AS self_hosted_minutes
  FROM ok_jobs GROUP BY workflow_id, job, labels),
billed AS (SELECT workflow_id, run_id, sum({MINUTES} * {RATE}) AS billable FROM ok_jobs WHERE labels NOT LIKE '%self-hosted%'
  GROUP BY ALL HAVING billable > 0),
span AS (SELECT greatest((epoch(max(created_at)) - epoch(min(created_at))) / 86400, 1) AS days FROM ok),
typical AS (SELECT workflow_id, count(*) AS n, quantile_cont(billable, 0.25) AS p25, quantile_cont(billable, 0.5) AS p50,
  quantile_cont(billable, 0.95) AS p95 FROM billed GROUP BY 1),
totals AS (SELECT workflow_id, sum(billable) AS billable_minutes, sum(self_hosted_minutes) AS self_hosted_minutes FROM job_costs GROUP BY 1),
costs AS (SELECT r.workflow_id, r.total_runs, t.billable_minutes, t.self_hosted_minutes, t.billable_minutes / days AS daily_rate,
    CASE WHEN n >= 5 THEN t.billable_minutes / days * (p95 / p50) ELSE 0 END AS priority_score,
    CASE WHEN n >= 5 THEN (p50 - p25) * (r.total_runs / days) ELSE 0 END AS daily_savings
  FROM (SELECT workflow_id, count(*) AS total_runs FROM ok GROUP BY 1) r, span
  JOIN totals t ON t.workflow_id = r.workflow_id JOIN typical p ON p.workflow_id = r.workflow_id)
"""


def job_costs(s, d):
    return cost.job_costs(facts(s, d))


def workflow_costs(s, d):
    return cost.workflow_costs(ok_runs(s, d), facts(s, d))


Q["d1_self_hosted"] = lambda s, d: history.jobs(s, d).groupBy(
    "name", lab.is_self_hosted(F.col("labels")).alias("self_hosted")
).agg(F.count(F.lit(1)).alias("jobs"))
O["d1_self_hosted"] = sql("SELECT job AS name, labels LIKE '%self-hosted%' AS self_hosted, count(*) AS jobs FROM jobs GROUP BY ALL")

Q["d2_multiplier"] = lambda s, d: history.jobs(s, d).groupBy(
    lab.labels_to_text(F.col("labels")).alias("labels"), lab.multiplier(F.col("labels")).alias("multiplier")
).agg(F.count(F.lit(1)).alias("jobs"))
O["d2_multiplier"] = sql(f"SELECT labels, {RATE} AS multiplier, count(*) AS jobs FROM jobs GROUP BY ALL")


def _d3(s, d):
    """Larger-runner labels made from each job's name and line: size and system vary by job."""
    size = (F.col("job_id") % 8 + 1) * 2
    system = F.element_at(F.array(F.lit("ubuntu-latest"), F.lit("windows-2022"), F.lit("macos-14")), (F.col("job_id") % 3 + 1).cast("int"))
    label = F.format_string("%s-%d-cores", system, size)
    jobs = history.jobs(s, d).select(label.alias("label"))
    return jobs.groupBy("label", lab.multiplier(F.array("label")).alias("multiplier")).agg(F.count(F.lit(1)).alias("jobs"))


Q["d3_larger_runners"] = _d3
O["d3_larger_runners"] = sql("""
, sized AS (SELECT (job_id % 8 + 1) * 2 AS n, job_id % 3 AS system FROM jobs)
SELECT CASE system WHEN 0 THEN 'ubuntu-latest' WHEN 1 THEN 'windows-2022' ELSE 'macos-14' END || '-' || n || '-cores' AS label,
  CASE system WHEN 0 THEN n / 2e0 WHEN 1 THEN n * 1e0 ELSE n * 5e0 END AS multiplier, count(*) AS jobs FROM sized GROUP BY ALL
""")

Q["d4_billable_minutes"] = lambda s, d: facts(s, d).select("job_id", lab.billable_minutes(F.col("duration_s")).alias("minutes"))
O["d4_billable_minutes"] = sql(f"SELECT job_id, CAST({MINUTES} AS DOUBLE) AS minutes FROM ok_jobs")

Q["d5_job_costs"] = lambda s, d: job_costs(s, d).select(
    "workflow_id", "job", "labels", "multiplier", "self_hosted", "runs", r4("billable", "billable"), r4("self_hosted_minutes", "self_hosted_minutes")
)
O["d5_job_costs"] = sql(COST + """SELECT workflow_id, job, labels, multiplier, self_hosted, runs, round(CAST(billable AS DOUBLE), 4) AS billable,
  round(CAST(self_hosted_minutes AS DOUBLE), 4) AS self_hosted_minutes FROM job_costs""")

Q["d6_workflow_costs"] = lambda s, d: workflow_costs(s, d).select(
    "workflow_id", "total_runs", *[r4(c, c) for c in ("billable_minutes", "self_hosted_minutes", "daily_rate")]
)
O["d6_workflow_costs"] = sql(COST + """SELECT workflow_id, total_runs, round(CAST(billable_minutes AS DOUBLE), 4) AS billable_minutes,
  round(CAST(self_hosted_minutes AS DOUBLE), 4) AS self_hosted_minutes, round(daily_rate, 4) AS daily_rate FROM costs""")

Q["d7_priority"] = lambda s, d: workflow_costs(s, d).select("workflow_id", r4("priority_score", "priority_score"), r4("daily_savings", "daily_savings"))
O["d7_priority"] = sql(COST + "SELECT workflow_id, round(priority_score, 4) AS priority_score, round(daily_savings, 4) AS daily_savings FROM costs")

Q["d8_rank_jobs"] = lambda s, d: cost.rank_jobs(job_costs(s, d), 3).select(
    "workflow_id", "job", F.col("job_rank").cast("bigint").alias("job_rank"), r4("minutes", "minutes")
)
O["d8_rank_jobs"] = sql(COST + """SELECT workflow_id, job, row_number() OVER (PARTITION BY workflow_id ORDER BY billable + self_hosted_minutes DESC, job) AS job_rank,
  round(CAST(billable + self_hosted_minutes AS DOUBLE), 4) AS minutes FROM job_costs QUALIFY job_rank <= 3""")

Q["d9_core_count"] = lambda s, d: history.jobs(s, d).groupBy(
    lab.labels_to_text(F.col("labels")).alias("label"), lab.core_count(lab.labels_to_text(F.col("labels"))).alias("cores")
).agg(F.count(F.lit(1)).alias("jobs"))
O["d9_core_count"] = sql("""SELECT labels AS label, CASE labels WHEN 'linux-16vcpu' THEN 16 WHEN 'macos-latest' THEN 4 WHEN '' THEN 0 ELSE 2 END AS cores,
  count(*) AS jobs FROM jobs GROUP BY ALL""")

SIZING = """
, sizing AS (SELECT workflow_id, job, labels AS runner_label, count(*) AS runs, quantile_cont(dur, 0.5) AS median,
    CASE labels WHEN 'linux-16vcpu' THEN 16 WHEN 'macos-latest' THEN 4 ELSE 2 END AS cores,
    CASE WHEN cores >= 8 AND quantile_cont(dur, 0.5) < 120 THEN 'oversized' WHEN cores <= 4 AND quantile_cont(dur, 0.5) > 900 THEN 'undersized' END AS issue
  FROM ok_jobs WHERE dur > 0 AND labels <> '' GROUP BY workflow_id, job, labels HAVING count(*) >= 5)
"""
Q["d10_runner_sizing"] = lambda s, d: runners.by_issue(runners.runner_sizing(facts(s, d))).select(
    "workflow_id", "job", "runner_label", "runs", "cores", "issue", r4("median", "median")
)
O["d10_runner_sizing"] = sql(SIZING + "SELECT workflow_id, job, runner_label, runs, cores, issue, round(median, 4) AS median FROM sizing WHERE issue IS NOT NULL")

Q["e1_log_iqr_events"] = lambda s, d: outliers.log_iqr_outliers(events(s, d), ["event_type"], "value", 0.75, bounded=False).select(
    "event_id", "event_type", r4("value", "value"), r4("fence", "fence"), r4("rank", "rank")
)
O["e1_log_iqr_events"] = """
WITH q AS (SELECT event_type, count(*) AS n, quantile_cont(ln(value), 0.75) FILTER (WHERE value > 0) AS q3,
    quantile_cont(ln(value), 0.25) FILTER (WHERE value > 0) AS q1, count(*) FILTER (WHERE value > 0) AS pos
  FROM (SELECT event_type, value FROM events) GROUP BY 1),
r AS (SELECT event_id, event_type, value, (rank() OVER (PARTITION BY event_type ORDER BY value) - 1) / count(*) OVER (PARTITION BY event_type) * 100 AS rank FROM events)
SELECT event_id, event_type, round(value, 4) AS value, round(exp(q3 + 0.75 * (q3 - q1)), 4) AS fence, round(rank, 4) AS rank
FROM r JOIN q USING (event_type) WHERE n >= 5 AND pos >= 5 AND value > 0 AND ln(CASE WHEN value > 0 THEN value ELSE 1 END) > q3 + 0.75 * (q3 - q1)
""".replace("ln(value)", "ln(CASE WHEN value > 0 THEN value ELSE 1 END)")

Q["e2_mad_events"] = lambda s, d: outliers.mad_outliers(events(s, d), ["event_type"], "value", bounded=False).select(
    "event_id", "event_type", r4("score", "score"), r4("rank", "rank")
)
O["e2_mad_events"] = """
WITH m AS (SELECT event_type, median(value) AS med FROM events GROUP BY 1 HAVING count(*) >= 5),
a AS (SELECT event_type, any_value(med) AS med, median(abs(value - med)) AS mad FROM events JOIN m USING (event_type) GROUP BY 1),
r AS (SELECT event_id, event_type, value, (rank() OVER (PARTITION BY event_type ORDER BY value) - 1) / count(*) OVER (PARTITION BY event_type) * 100 AS rank FROM events)
SELECT event_id, event_type, round((value - med) / (1.4826 * mad), 4) AS score, round(rank, 4) AS rank FROM r JOIN a USING (event_type)
WHERE mad > 0 AND (value - med) / (1.4826 * mad) > 3.5
"""

Q["e3_percentile_rank"] = lambda s, d: outliers.percentile_rank(events(s, d), ["event_type"], "value", bounded=False).select("event_id", r4("rank", "rank"))
O["e3_percentile_rank"] = """SELECT event_id, round((rank() OVER (PARTITION BY event_type ORDER BY value) - 1)
  / count(*) OVER (PARTITION BY event_type) * 100, 4) AS rank FROM events"""

Q["e4_clamp_events"] = lambda s, d: outliers.clamp_outliers(events(s, d), ["event_type"], "value", 1.0, bounded=False).select("event_id", r4("clamped", "clamped"))
O["e4_clamp_events"] = """
WITH q AS (SELECT event_type, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3 FROM events GROUP BY 1)
SELECT event_id, round(least(greatest(value, q1 - (q3 - q1)), q3 + (q3 - q1)), 4) AS clamped FROM events JOIN q USING (event_type)
"""

SLOW = """
, all_values AS (
  SELECT workflow_id, '' AS job, run_id, head_sha, dur FROM ok_runs WHERE dur > 0 AND workflow_id IN (SELECT workflow_id FROM ok_jobs GROUP BY 1 HAVING count(DISTINCT job) > 1)
  UNION ALL SELECT workflow_id, job, run_id, head_sha, dur FROM ok_jobs WHERE dur > 0),
limits AS (SELECT workflow_id, job, quantile_cont(ln(dur), 0.75) + 1.5 * (quantile_cont(ln(dur), 0.75) - quantile_cont(ln(dur), 0.25)) AS lim
  FROM all_values GROUP BY ALL HAVING count(*) >= 5),
places AS (SELECT *, (rank() OVER (PARTITION BY workflow_id, job ORDER BY dur) - 1) / count(*) OVER (PARTITION BY workflow_id, job) * 100 AS rank FROM all_values),
slow AS (SELECT p.*, CASE WHEN rank >= 99 THEN 'critical' WHEN rank >= 95 THEN 'warning' ELSE 'info' END AS severity,
    coalesce(name, 'workflow-' || workflow_id) AS workflow
  FROM places p JOIN limits USING (workflow_id, job) LEFT JOIN names USING (workflow_id) WHERE ln(dur) > lim AND rank >= 95),
all_groups AS (SELECT workflow, job, count(*) AS count, max(dur) AS worst_s, arg_max(rank, dur * 1e9 - run_id) AS worst_rank, arg_max(head_sha, dur * 1e9 - run_id) AS worst_sha,
    CASE WHEN bool_or(severity = 'critical') THEN 'critical' WHEN bool_or(severity = 'warning') THEN 'warning' ELSE 'info' END AS severity FROM slow GROUP BY ALL),
groups AS (SELECT g.* FROM all_groups g LEFT JOIN all_groups w ON w.workflow = g.workflow AND w.job = ''
  WHERE g.job = '' OR w.count IS NULL OR NOT (w.count = g.count AND w.worst_sha = g.worst_sha))
"""
_SLOW_COLUMNS = "workflow_id, job, run_id, round(dur, 4) AS duration_s, round(rank, 4) AS rank, severity"


def _slow_out(df):
    return df.select("workflow_id", "job", "run_id", r4("duration_s", "duration_s"), r4("rank", "rank"), "severity")


def slow(s, d):
    return outliers.all_outliers(timed_runs(s, d), facts(s, d), history.workflows(s, d))


Q["e5_run_outliers"] = lambda s, d: _slow_out(outliers.run_outliers(timed_runs(s, d), facts(s, d)))
O["e5_run_outliers"] = sql(SLOW + f"SELECT {_SLOW_COLUMNS} FROM slow WHERE job = ''")
Q["e6_job_outliers"] = lambda s, d: _slow_out(outliers.job_outliers(ok_runs(s, d), facts(s, d)))
O["e6_job_outliers"] = sql(SLOW + f"SELECT {_SLOW_COLUMNS} FROM slow WHERE job <> ''")
Q["e7_mad_job_outliers"] = lambda s, d: _slow_out(outliers.job_outliers(ok_runs(s, d), facts(s, d), method="mad", min_rank=98.0))
O["e7_mad_job_outliers"] = sql(SLOW + """
, med AS (SELECT workflow_id, job, median(dur) AS med FROM all_values WHERE job <> '' GROUP BY ALL HAVING count(*) >= 5),
mads AS (SELECT workflow_id, job, any_value(med) AS med, median(abs(dur - med)) AS mad FROM all_values JOIN med USING (workflow_id, job) GROUP BY ALL)
SELECT workflow_id, job, run_id, round(dur, 4) AS duration_s, round(rank, 4) AS rank,
  CASE WHEN rank >= 99 THEN 'critical' WHEN rank >= 95 THEN 'warning' ELSE 'info' END AS severity
FROM places JOIN mads USING (workflow_id, job) WHERE mad > 0 AND (dur - med) / (1.4826 * mad) > 3.5 AND rank >= 98
""")
def _grouped(df):
    return outliers.group_outliers(df).select(
        "workflow", "job", "count", r4("worst_s", "worst_s"), r4("worst_rank", "worst_rank"), "worst_sha", "severity")


_GROUPS = """SELECT workflow, job, count, round(worst_s, 4) AS worst_s, round(worst_rank, 4) AS worst_rank, worst_sha, severity FROM """
Q["e8_group_outliers"] = lambda s, d: _grouped(slow(s, d))
O["e8_group_outliers"] = sql(SLOW + _GROUPS + "groups")


def _e9(s, d):
    """Jobs that are slow in just the runs that are slow repeat their workflow; one slow in fewer runs does not."""
    found = slow(s, d)
    runs = found.filter("job = ''")
    return _grouped(found.unionByName(runs.withColumn("job", F.lit("mirror"))).unionByName(
        runs.filter("run_id % 2 = 0").withColumn("job", F.lit("half"))))


Q["e9_without_repeats"] = _e9
O["e9_without_repeats"] = sql(SLOW + """
, halves AS (SELECT workflow, 'half' AS job, count(*) AS count, max(dur) AS worst_s, arg_max(rank, dur * 1e9 - run_id) AS worst_rank,
    arg_max(head_sha, dur * 1e9 - run_id) AS worst_sha, max(CASE severity WHEN 'critical' THEN 2 WHEN 'warning' THEN 1 ELSE 0 END) AS top,
    any_value((SELECT count(*) FROM slow a WHERE a.job = '' AND a.workflow = slow.workflow)) AS whole
  FROM slow WHERE job = '' AND run_id % 2 = 0 GROUP BY workflow),
shaped AS (SELECT * FROM groups UNION ALL
  SELECT workflow, job, count, worst_s, worst_rank, worst_sha, CASE top WHEN 2 THEN 'critical' WHEN 1 THEN 'warning' ELSE 'info' END
  FROM halves WHERE count < whole)
""" + _GROUPS + "shaped")
