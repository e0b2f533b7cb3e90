"""Percentiles, summaries, steps, reliability."""

from pyspark.sql import functions as F

from runlens.functions import names
from runlens.functions.grading import volatility_label
from runlens.operators import failures, quantiles, steps, summary
from runlens.sources import sample_history as history
from workloads.base import events, facts, ok_runs, r4, sql, timed_runs

Q, O = {}, {}
POINTS = {"p25": 25, "p50": 50, "p95": 95, "p99": 99}
_POINTS_SQL = """round(quantile_cont(value, 0.25), 4) AS p25, round(quantile_cont(value, 0.5), 4) AS p50,
  round(quantile_cont(value, 0.95), 4) AS p95, round(quantile_cont(value, 0.99), 4) AS p99"""

Q["c1_percentiles_events"] = lambda s, d: quantiles.percentiles(events(s, d), ["event_type"], "value", POINTS, bounded=False).select(
    "event_type", *[r4(p, p) for p in POINTS]
)
Q["c1_sliced_percentiles_events"] = lambda s, d: quantiles.percentiles(
    events(s, d), ["event_type"], "value", POINTS, bounded=False
).select("event_type", *[r4(p, p) for p in POINTS])
O["c1_percentiles_events"] = O["c1_sliced_percentiles_events"] = (
    f"SELECT event_type, {_POINTS_SQL} FROM events GROUP BY event_type"
)


def _c2(s, d):
    e = events(s, d)
    both = quantiles.spread(e, ["event_type"], "value").join(quantiles.quartiles(e, ["event_type"], "value", bounded=False), "event_type")
    return both.select("event_type", "count", *[r4(c, c) for c in ("mean", "stddev", "q1", "q3", "iqr")])


Q["c2_spread_events"] = _c2
O["c2_spread_events"] = """SELECT event_type, count(*) AS count, round(avg(value), 4) AS mean, round(stddev_samp(value), 4) AS stddev,
  round(quantile_cont(value, 0.25), 4) AS q1, round(quantile_cont(value, 0.75), 4) AS q3,
  round(quantile_cont(value, 0.75) - quantile_cont(value, 0.25), 4) AS iqr FROM events GROUP BY event_type"""

Q["c3_variation_jobs"] = lambda s, d: quantiles.spread(summary.timed(facts(s, d)), ["workflow_id", "job"], "duration_s").select(
    "workflow_id", "job", r4("cv", "cv")
)
O["c3_variation_jobs"] = sql("SELECT workflow_id, job, round(stddev_samp(dur) / avg(dur), 4) AS cv FROM ok_jobs WHERE dur > 0 GROUP BY ALL")


def _stats_sql(v, source, keys):
    return f"""SELECT {keys}, count(*) AS count, round(avg({v}), 4) AS mean, round(quantile_cont({v}, 0.5), 4) AS median,
      round(quantile_cont({v}, 0.95), 4) AS p95, round(quantile_cont({v}, 0.99), 4) AS p99, round(min({v}), 4) AS min,
      round(max({v}), 4) AS max, round(sum({v}), 2) AS total,
      round(quantile_cont({v}, 0.95) / quantile_cont({v}, 0.5), 4) AS volatility,
      CASE WHEN quantile_cont({v}, 0.95) / quantile_cont({v}, 0.5) >= 3 THEN 'volatile'
           WHEN quantile_cont({v}, 0.95) / quantile_cont({v}, 0.5) >= 2 THEN 'spiky'
           WHEN quantile_cont({v}, 0.95) / quantile_cont({v}, 0.5) >= 1.3 THEN 'variable' ELSE 'stable' END AS label
    FROM {source} GROUP BY {keys}"""


def _stats_out(df, *keys):
    return df.select(*keys, "count", *[r4(c, c) for c in ("mean", "median", "p95", "p99", "min", "max")],
                     F.round("total", 2).alias("total"), r4("volatility", "volatility"), "label")


Q["c4_duration_stats_workflows"] = lambda s, d: _stats_out(
    summary.duration_stats(timed_runs(s, d).filter("duration_s > 0"), ["workflow_id"]), "workflow_id"
)
O["c4_duration_stats_workflows"] = sql(_stats_sql("dur", "ok_runs WHERE dur > 0", "workflow_id"))
Q["c4_duration_stats_events"] = lambda s, d: _stats_out(summary.duration_stats(events(s, d), ["event_type"], "value", bounded=False), "event_type")
O["c4_duration_stats_events"] = _stats_sql("value", "events", "event_type")


def _c5(s, d):
    e = quantiles.percentiles(events(s, d), ["event_type"], "value", {"p50": 50, "p95": 95}, bounded=False)
    return e.select("event_type", volatility_label(F.col("p95") / F.col("p50")).alias("label"))


Q["c5_volatility_label"] = _c5
O["c5_volatility_label"] = f"SELECT event_type, label FROM ({O['c4_duration_stats_events']})"

Q["c6_queue_stats"] = lambda s, d: summary.queue_stats(ok_runs(s, d)).select(
    "workflow_id", r4("queue_median", "queue_median"), r4("queue_p95", "queue_p95")
)
O["c6_queue_stats"] = sql("""
SELECT workflow_id, round(quantile_cont(epoch(started_at) - epoch(created_at), 0.5), 4) AS queue_median,
  round(quantile_cont(epoch(started_at) - epoch(created_at), 0.95), 4) AS queue_p95 FROM ok GROUP BY 1
""")

GROUPED = """
, variants AS (SELECT DISTINCT workflow_id, job, CASE WHEN contains(job, '(') THEN trim(split_part(job, '(', 1)) ELSE job END AS base
  FROM ok_jobs WHERE dur > 0),
grouped AS (SELECT j.workflow_id, j.dur, CASE WHEN n > 1 THEN v.base || ' (' || n || ' variants)' ELSE j.job END AS job
  FROM ok_jobs j JOIN variants v ON v.workflow_id = j.workflow_id AND v.job = j.job
  JOIN (SELECT workflow_id, base, count(*) AS n FROM variants GROUP BY ALL) b ON b.workflow_id = v.workflow_id AND b.base = v.base
  WHERE j.dur > 0)
"""


def _c7(s, d):
    nested = summary.workflow_summary(timed_runs(s, d), facts(s, d))
    return nested.select("workflow_id", r4("queue_median", "queue_median"), F.posexplode("jobs").alias("pos", "j")).select(
        "workflow_id", "queue_median", (F.col("pos") + 1).cast("bigint").alias("place"), F.col("j.name").alias("job"),
        F.col("j.stats.count").alias("count"), r4("j.stats.median", "median"),
    )


Q["c7_workflow_summary"] = _c7
O["c7_workflow_summary"] = sql(GROUPED + """
, stats AS (SELECT workflow_id, job, count(*) AS count, quantile_cont(dur, 0.5) AS median FROM grouped GROUP BY ALL),
queue AS (SELECT workflow_id, round(quantile_cont(epoch(started_at) - epoch(created_at), 0.5), 4) AS queue_median FROM ok GROUP BY 1)
SELECT workflow_id, queue_median, row_number() OVER (PARTITION BY workflow_id ORDER BY median DESC, job) AS place, job, count,
  round(median, 4) AS median FROM stats JOIN queue USING (workflow_id)
""")

Q["c8_matrix_names"] = lambda s, d: history.jobs(s, d).groupBy(
    "name", names.matrix_base(F.col("name")).alias("base"), names.matrix_variant(F.col("name")).alias("variant")
).agg(F.count(F.lit(1)).alias("jobs"))
O["c8_matrix_names"] = sql(r"""
SELECT job AS name, CASE WHEN contains(job, '(') THEN trim(split_part(job, '(', 1)) ELSE job END AS base,
  CASE WHEN contains(job, '(') THEN regexp_replace(substr(job, instr(job, '(') + 1), '\)$', '') ELSE '' END AS variant,
  count(*) AS jobs FROM jobs GROUP BY ALL
""")

Q["c9_job_stats_grouped"] = lambda s, d: _stats_out(summary.job_stats(facts(s, d)), "workflow_id", "job")
O["c9_job_stats_grouped"] = sql(GROUPED + _stats_sql("dur", "grouped", "workflow_id, job"))

TIMING = """
, step_stats AS (SELECT workflow_id, job, step, count(*) AS runs, quantile_cont(dur, 0.5) AS median, quantile_cont(dur, 0.95) AS p95
  FROM steps WHERE run_conclusion = 'success' AND dur > 0 GROUP BY ALL HAVING count(*) >= 3 AND floor(quantile_cont(dur, 0.5) * 1000) >= 500),
job_medians AS (SELECT workflow_id, job, count(*) AS job_runs, coalesce(quantile_cont(dur, 0.5) FILTER (WHERE dur > 0), 0) AS job_median
  FROM ok_jobs GROUP BY ALL HAVING count(*) >= 3),
timing AS (SELECT *, row_number() OVER (PARTITION BY workflow_id, job ORDER BY median DESC, step) AS step_rank,
  median / job_median * 100 AS pct_of_job, p95 / median AS volatility FROM step_stats JOIN job_medians USING (workflow_id, job)
  QUALIFY step_rank <= 2)
"""


def timing(s, d):
    return steps.step_timing(facts(s, d), history.steps(s, d), top_n=2)


Q["c10_step_timing"] = lambda s, d: timing(s, d).select(
    "workflow_id", "job", "step", F.col("step_rank").cast("bigint").alias("step_rank"), "runs", "job_runs",
    *[r4(c, c) for c in ("median", "p95", "pct_of_job", "volatility")],
)
O["c10_step_timing"] = sql(TIMING + """
SELECT workflow_id, job, step, step_rank, runs, job_runs, round(median, 4) AS median, round(p95, 4) AS p95,
  round(pct_of_job, 4) AS pct_of_job, round(volatility, 4) AS volatility FROM timing
""")
Q["c11_slowest_jobs"] = lambda s, d: steps.slowest_jobs(timing(s, d)).select(
    "workflow_id", "job", "step", r4("job_median", "job_median"), r4("median", "median")
)
O["c11_slowest_jobs"] = sql(TIMING + """
SELECT workflow_id, job, step, round(job_median, 4) AS job_median, round(median, 4) AS median FROM timing
ORDER BY timing.job_median DESC, workflow_id, job, step_rank
""")

Q["c12_rerun_stats"] = lambda s, d: failures.rerun_stats(history.attempts(s, d)).select(
    "workflow_id", "unique_runs", "retried_runs", F.col("extra_attempts").cast("bigint").alias("extra_attempts"), r4("rerun_rate", "rerun_rate")
)
O["c12_rerun_stats"] = sql("""
, per_run AS (SELECT workflow_id, run_id, max(run_attempt) AS a FROM attempts GROUP BY ALL)
SELECT workflow_id, count(*) AS unique_runs, count(*) FILTER (WHERE a > 1) AS retried_runs, CAST(sum(a - 1) AS BIGINT) AS extra_attempts,
  round(count(*) FILTER (WHERE a > 1) / count(*), 4) AS rerun_rate FROM per_run GROUP BY 1 HAVING count(*) FILTER (WHERE a > 1) > 0
""")

FAIL = """
, edge AS (SELECT max(created_at) - INTERVAL 7 DAY AS cutoff FROM listed),
counts AS (SELECT workflow_id, count(*) AS total_runs,
    count(*) FILTER (WHERE conclusion NOT IN ('success', 'skipped', 'cancelled')) AS failures,
    count(*) FILTER (WHERE conclusion = 'cancelled') AS cancellations,
    count(*) FILTER (WHERE created_at > cutoff) AS recent_runs,
    count(*) FILTER (WHERE created_at > cutoff AND conclusion NOT IN ('success', 'skipped', 'cancelled')) AS recent_failures
  FROM listed, edge GROUP BY 1),
first_bad AS (SELECT workflow_id, job, job_id, min_by(step, number) AS step FROM steps
  WHERE conclusion = 'failure' AND job_conclusion = 'failure' AND run_conclusion NOT IN ('success', 'skipped', 'cancelled') GROUP BY ALL),
causes AS (SELECT workflow_id, job, step, count(*) AS count,
    CASE WHEN regexp_matches(lower(step), 'test|e2e|integration|spec|jest|pytest') THEN 'test'
         WHEN regexp_matches(lower(step), 'compile|lint|build|format') THEN 'build'
         WHEN regexp_matches(lower(step), 'setup|runner|checkout|cache|install|docker compose') THEN 'infra' ELSE 'other' END AS category
  FROM first_bad GROUP BY ALL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY workflow_id ORDER BY count DESC, job, step) AS place,
  count(*) OVER (PARTITION BY workflow_id) AS n_steps FROM causes),
retries AS (SELECT workflow_id, count(*) FILTER (WHERE a > 1) AS retried_runs, CAST(sum(a - 1) AS BIGINT) AS extra_attempts
  FROM (SELECT workflow_id, run_id, max(run_attempt) AS a FROM attempts GROUP BY ALL) GROUP BY 1),
report AS (SELECT c.*, failures / total_runs AS failure_rate, cancellations / total_runs AS cancellation_rate,
    CASE WHEN recent_runs >= 5 THEN recent_failures / recent_runs ELSE 0 END AS recent_failure_rate,
    t.job AS top_job, t.step AS top_step, t.count AS top_count, t.n_steps, u.step AS second_step, u.count AS second_count,
    coalesce(retried_runs, 0) AS retried_runs, coalesce(extra_attempts, 0) AS extra_attempts,
    CASE WHEN failures / total_runs >= 0.2 THEN 'critical' WHEN failures / total_runs >= 0.05 THEN 'warning' ELSE 'info' END AS severity,
    CASE WHEN failures > 0 AND coalesce(t.count, 0) / failures >= 0.9 THEN 'systematic' ELSE 'flaky' END AS kind
  FROM counts c LEFT JOIN ranked t ON t.workflow_id = c.workflow_id AND t.place = 1
  LEFT JOIN ranked u ON u.workflow_id = c.workflow_id AND u.place = 2
  LEFT JOIN retries r ON r.workflow_id = c.workflow_id
  WHERE total_runs >= 5 AND (failures > 0 OR cancellations > 0)),
graded AS (SELECT *, CASE WHEN recent_runs < 5 THEN 'stable' WHEN recent_failure_rate - failure_rate <= -0.05 THEN 'improving'
    WHEN recent_failure_rate - failure_rate >= 0.05 THEN 'worsening' ELSE 'stable' END AS trend FROM report)
"""


def report(s, d):
    return failures.failure_report(
        history.runs(s, d), history.jobs(s, d), history.steps(s, d), failures.rerun_stats(history.attempts(s, d))
    )


def causes(s, d):
    return failures.failing_steps(history.runs(s, d), history.jobs(s, d), history.steps(s, d))


Q["c13_failure_stats"] = lambda s, d: failures.failure_stats(history.runs(s, d))
O["c13_failure_stats"] = sql(FAIL + "SELECT * FROM counts")
Q["c14_failing_steps"] = lambda s, d: causes(s, d).select("workflow_id", "job", "step", "count")
O["c14_failing_steps"] = sql(FAIL + "SELECT workflow_id, job, step, count FROM causes")
Q["c15_step_category"] = lambda s, d: history.steps(s, d).groupBy(
    "name", names.step_category(F.col("name")).alias("category")
).agg(F.count(F.lit(1)).alias("steps"))
O["c15_step_category"] = sql("""
SELECT step AS name, CASE step WHEN 'Checkout' THEN 'infra' WHEN 'Build' THEN 'build' ELSE 'test' END AS category, count(*) AS steps
FROM steps GROUP BY ALL
""")
Q["c16_conclusion_map"] = lambda s, d: failures.as_map(
    failures.conclusion_counts(history.runs(s, d)), "conclusion", "by_conclusion"
).select("workflow_id", F.explode("by_conclusion").alias("conclusion", "count"))
O["c16_conclusion_map"] = sql("""
SELECT workflow_id, conclusion, count(*) AS count FROM listed WHERE conclusion NOT IN ('success', 'skipped') GROUP BY ALL
""")
Q["c16_category_map"] = lambda s, d: failures.as_map(
    failures.category_counts(causes(s, d)), "category", "by_category"
).select("workflow_id", F.explode("by_category").alias("category", "count"))
O["c16_category_map"] = sql(FAIL + "SELECT workflow_id, category, CAST(sum(count) AS BIGINT) AS count FROM causes GROUP BY ALL")

_REPORT_COLUMNS = ["workflow_id", "total_runs", "failures", "cancellations", "severity", "kind", "trend", "retried_runs", "extra_attempts"]


def _report_out(df):
    top = F.try_element_at("failing_steps", F.lit(1))
    return df.select(
        *[F.col(c).cast("bigint") if c in ("retried_runs", "extra_attempts") else c for c in _REPORT_COLUMNS],
        r4("failure_rate", "failure_rate"), r4("cancellation_rate", "cancellation_rate"),
        r4("recent_failure_rate", "recent_failure_rate"), top["step_name"].alias("top_step"), top["count"].alias("top_count"),
    )


_REPORT_SQL = """SELECT workflow_id, total_runs, failures, cancellations, severity, kind, trend, retried_runs, extra_attempts,
  round(failure_rate, 4) AS failure_rate, round(cancellation_rate, 4) AS cancellation_rate,
  round(recent_failure_rate, 4) AS recent_failure_rate, top_step, top_count FROM graded"""
Q["c17_failure_report"] = lambda s, d: _report_out(report(s, d))
O["c17_failure_report"] = sql(FAIL + _REPORT_SQL)
Q["c18_by_failure_rate"] = lambda s, d: _report_out(failures.by_failure_rate(report(s, d)))
O["c18_by_failure_rate"] = sql(FAIL + _REPORT_SQL + " ORDER BY graded.failure_rate DESC, workflow_id")
Q["c19_drop_negligible"] = lambda s, d: _report_out(failures.drop_negligible(report(s, d)))
O["c19_drop_negligible"] = sql(FAIL + _REPORT_SQL + " WHERE graded.failure_rate >= 0.05 OR graded.cancellation_rate >= 0.05")
