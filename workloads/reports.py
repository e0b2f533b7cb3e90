"""Findings, report queries and text helpers."""

from pyspark.sql import functions as F

from runlens.functions import durations as dur
from runlens.operators import failures, outliers, prep, runners, summary
from runlens.plans import analyze as plan
from runlens.plans import findings as make
from runlens.plans import report as rep
from runlens.session import stored
from runlens.sources import sample_history as history
from workloads import changes as ch
from workloads import costs as co
from workloads import summaries as su
from workloads.base import facts, r4, sql, timed_runs

Q, O = {}, {}


def compact_sql(x, pad=True):
    rest = "lpad(CAST(t % 60 AS VARCHAR), 2, '0')" if pad else "CAST(t % 60 AS VARCHAR)"
    text = f"CASE WHEN t < 60 THEN t || 's' WHEN t % 60 = 0 THEN (t // 60) || 'm' ELSE (t // 60) || 'm' || {rest} || 's' END"
    return text.replace("t ", f"CAST(round({x}) AS BIGINT) ").replace("(t", f"(CAST(round({x}) AS BIGINT)")


def text_sql(x):
    t = f"CAST(round({x}) AS BIGINT)"
    return (f"CASE WHEN {t} >= 3600 THEN ({t} // 3600) || 'h' || ({t} // 60 % 60) || 'm' || ({t} % 60) || 's' "
            f"WHEN {t} >= 60 THEN ({t} // 60) || 'm' || ({t} % 60) || 's' ELSE {t} || 's' END")


def pct_sql(x):
    return f"CAST(CAST(round_even({x}, 0) AS BIGINT) AS VARCHAR)"


def tables(s, d):
    """The history with its jobs written once, as runs, facts and steps all come from them."""
    jobs = stored(history.jobs(s, d))
    return plan.Tables(history.attempts(s, d), jobs, history.steps_of_jobs(jobs), history.workflows(s, d))


def _h1(s, d):
    result = plan.analyze(tables(s, d))
    return result["findings"].select("type", "severity", "title", "description", "detail")


Q["h1_analyze"] = _h1


def _h2(s, d):
    """Findings per type and severity after curation; change points are left out, their p is drawn by shuffling."""
    c, _ = plan.context_of(tables(s, d))
    kinds = [plan.summary_findings, plan.step_findings, plan.stage_findings, plan.runner_findings,
             plan.outlier_findings, plan.failure_findings, plan.cost_findings]
    counted = [plan.severity_counts(make_(c)) for make_ in kinds]
    total = counted[0]
    for other in counted[1:]:
        total = total.unionByName(other)
    return total


Q["h2_curated_counts"] = _h2
O["h2_curated_counts"] = sql(co.SLOW + co.SIZING + su.FAIL.replace("report AS", "failing AS").replace("FROM report)", "FROM failing)") + """
SELECT 'summary' AS type, 'info' AS severity, count(*) AS findings FROM (SELECT DISTINCT workflow_id FROM ok_runs WHERE dur > 0)
UNION ALL SELECT 'steps', 'info', count(*) FROM (SELECT DISTINCT workflow_id, job FROM (
  SELECT workflow_id, job FROM steps WHERE run_conclusion = 'success' AND dur > 0 GROUP BY workflow_id, job, step HAVING count(*) >= 3))
UNION ALL SELECT 'pipeline', 'info', count(*) FROM (SELECT DISTINCT workflow_id FROM ok)
UNION ALL SELECT 'runner', 'info', count(*) FROM sizing WHERE issue IS NOT NULL
UNION ALL SELECT 'outlier', severity, count(*) FROM groups GROUP BY 2
UNION ALL SELECT 'failure', severity, count(*) FROM graded WHERE failure_rate >= 0.05 OR cancellation_rate >= 0.05 GROUP BY 2
UNION ALL SELECT 'cost', 'info', count(*) FROM (SELECT DISTINCT workflow_id FROM ok)
""")

_TITLES = ["severity", "title", "description"]
Q["h3_summary_text"] = lambda s, d: make.summary_findings(
    summary.workflow_summary(timed_runs(s, d), facts(s, d)), history.workflows(s, d)
).select(*_TITLES)
O["h3_summary_text"] = sql(f"""
SELECT 'info' AS severity, 'Workflow "' || coalesce(any_value(name), 'workflow-' || workflow_id) || '"' AS title,
  count(*) || ' runs, median ' || {text_sql('quantile_cont(dur, 0.5)')} || ', p95 ' || {text_sql('quantile_cont(dur, 0.95)')}
  || ', total CI time ' || {text_sql('sum(dur)')} AS description
FROM ok_runs LEFT JOIN names USING (workflow_id) WHERE dur > 0 GROUP BY workflow_id
""")
Q["h3_runner_text"] = lambda s, d: make.runner_findings(runners.runner_sizing(facts(s, d)), history.workflows(s, d)).select(*_TITLES)
O["h3_runner_text"] = sql(co.SIZING + f"""
SELECT 'info' AS severity, 'Runner sizing: ' || coalesce(name, 'workflow-' || workflow_id) || ' / ' || job AS title,
  'job takes ' || {compact_sql('median', False)} || ' on ' || cores || ' cores — consider ' || CASE issue WHEN 'oversized'
    THEN 'downsizing to save ~1x cost' ELSE 'larger runner to reduce wait' END AS description
FROM sizing LEFT JOIN names USING (workflow_id) WHERE issue IS NOT NULL
""")
Q["h3_outlier_text"] = lambda s, d: make.outlier_findings(outliers.group_outliers(co.slow(s, d))).select(*_TITLES)
O["h3_outlier_text"] = sql(co.SLOW + f"""
SELECT severity, 'Outliers in ' || workflow || CASE WHEN job <> '' THEN ' / ' || job ELSE '' END AS title,
  count || 'x, worst ' || {text_sql('worst_s')} || ' (p' || {pct_sql('worst_rank')} || ')' AS description FROM groups
""")
Q["h3_slow_text"] = lambda s, d: make.slow_findings(co.slow(s, d)).select(*_TITLES)
O["h3_slow_text"] = sql(co.SLOW + f"""
SELECT severity, CASE WHEN job = '' THEN 'Slow run in "' || workflow || '"' ELSE 'Slow job "' || job || '" in "' || workflow || '"' END AS title,
  CASE WHEN job = '' THEN 'Run' ELSE 'Job' END || ' took ' || {text_sql('dur')} || ' (p' || {pct_sql('rank')} || ' — slower than '
  || {pct_sql('rank')} || '% of runs)' AS description FROM slow
""")
Q["h3_change_text"] = lambda s, d: make.change_findings(ch.categorized(s, d)).select(*_TITLES)
O["h3_change_text"] = ch.graded_sql(3, f"""
SELECT severity, 'Performance ' || direction || ' in job "' || job || '"' AS title,
  CASE WHEN round_even(pct_change, 0) = 0 THEN '0' ELSE {pct_sql('pct_change')} END || '% change at ' || strftime(created_at, '%Y-%m-%d') || ' (commit ' || substr(head_sha, 1, 8)
  || '), before: ' || {text_sql('before_mean')} || ', after: ' || {text_sql('after_mean')} || ' (p=' || printf('%.4f', p_value) || ')' AS description
FROM categorized""")
Q["h3_failure_text"] = lambda s, d: make.failure_findings(failures.drop_negligible(su.report(s, d)), history.workflows(s, d)).select(*_TITLES)
O["h3_failure_text"] = sql(su.FAIL + f"""
SELECT severity, 'Workflow "' || coalesce(name, 'workflow-' || workflow_id) || '" failure rate' AS title,
  {pct_sql('failure_rate * 100')} || '% failure rate (' || failures || '/' || total_runs || ' runs)' AS description
FROM graded LEFT JOIN names USING (workflow_id) WHERE failure_rate >= 0.05 OR cancellation_rate >= 0.05
""")
Q["h3_cost_text"] = lambda s, d: make.cost_findings(co.workflow_costs(s, d), co.job_costs(s, d), history.workflows(s, d)).select(*_TITLES)
O["h3_cost_text"] = sql(co.COST + f"""
SELECT 'info' AS severity, 'Workflow "' || coalesce(name, 'workflow-' || workflow_id) || '" cost estimate' AS title,
  {pct_sql('billable_minutes')} || ' billable minutes (' || {pct_sql('daily_rate')} || '/day) across ' || total_runs || ' runs' AS description
FROM costs LEFT JOIN names USING (workflow_id)
""")
Q["h3_stage_text"] = lambda s, d: make.stage_findings(ch.structure(s, d), history.workflows(s, d)).select(*_TITLES)
O["h3_stage_text"] = sql(ch.STAGES + f"""
SELECT 'info' AS severity, 'Pipeline structure: ' || coalesce(any_value(n.name), 'workflow-' || s.workflow_id) AS title,
  CAST(floor(greatest(1 - any_value(wall_median) / any_value(job_sum_median), 0) * 100) AS BIGINT) || '% parallel efficiency, ' || any_value(stages)
  || ' stages, critical path: ' || max(s.name) FILTER (WHERE critical) || ' (' || {text_sql('max(stage_median)')} || ')' AS description
FROM structure s LEFT JOIN names n ON n.workflow_id = s.workflow_id GROUP BY s.workflow_id
""")
Q["h3_step_text"] = lambda s, d: make.step_findings(su.timing(s, d), history.workflows(s, d)).select(*_TITLES)
O["h3_step_text"] = sql(su.TIMING + """
SELECT 'info' AS severity, 'Slowest steps in ' || coalesce(any_value(name), 'workflow-' || workflow_id) || ' / ' || job AS title,
  'Top ' || count(*) || ' steps by duration (of ' || any_value(job_runs) || ' runs)' AS description
FROM timing LEFT JOIN names USING (workflow_id) GROUP BY workflow_id, job
""")

Q["h4_diagnostics"] = lambda s, d: make.diagnostic_text(
    prep.preprocess(history.attempts(s, d), "main")[1].unionByName(prep.missing_labels(history.jobs(s, d)))
).select("kind", "text")
O["h4_diagnostics"] = sql("""
SELECT 'preprocess' AS kind, '[info] global: deduplicated ' || ((SELECT count(*) FROM attempts) - (SELECT count(*) FROM listed)) || ' retried runs' AS text
UNION ALL SELECT 'preprocess', '[info] global: excluded ' || count(*) || ' non-success runs from duration analysis' FROM listed WHERE head_branch = 'main' AND conclusion <> 'success'
UNION ALL SELECT 'partial_data', '[info] global: runner labels unavailable for ' || count(*) || ' jobs (cost estimates use default 1x Linux rate)' FROM jobs WHERE labels = ''
""")


def change_and_cost(s, d):
    found = make.change_findings(ch.categorized(s, d))
    return found.unionByName(make.cost_findings(co.workflow_costs(s, d), co.job_costs(s, d), history.workflows(s, d)))


Q["h5_by_type"] = lambda s, d: make.by_type(change_and_cost(s, d), make.COST).select("type", "title")
O["h5_by_type"] = sql("""SELECT DISTINCT 'cost' AS type, 'Workflow "' || coalesce(name, 'workflow-' || workflow_id) || '" cost estimate' AS title
FROM ok LEFT JOIN names USING (workflow_id)""")
Q["i9_compact"] = lambda s, d: make.omitted(change_and_cost(s, d))
O["i9_compact"] = ch.graded_sql(3, """
SELECT count(*) FILTER (WHERE category IN ('oscillating', 'minor')) AS omitted,
  count(*) FILTER (WHERE category NOT IN ('oscillating', 'minor')) + (SELECT count(DISTINCT workflow_id) FROM ok) AS kept FROM categorized""")


def summaries(s, d):
    return summary.workflow_summary(timed_runs(s, d), facts(s, d))


RUN_STATS = """
, run_stats AS (SELECT workflow_id, count(*) AS n, sum(dur) AS total, quantile_cont(dur, 0.95) / quantile_cont(dur, 0.5) AS volatility FROM ok_runs WHERE dur > 0 GROUP BY 1)
"""
Q["i1_triage_top_time"] = lambda s, d: rep.triage_top_time(summaries(s, d)).select(
    "workflow_id", r4("total", "total"), dur.total_time_text(F.col("total")).alias("text")
)
O["i1_triage_top_time"] = sql(RUN_STATS + """
SELECT workflow_id, total, (CAST(total AS BIGINT) // 3600) || 'h' || (CAST(total AS BIGINT) // 60 % 60) || 'm' AS text FROM run_stats ORDER BY total DESC LIMIT 3""")
Q["i2_triage_unpredictable"] = lambda s, d: rep.triage_unpredictable(
    summary.duration_stats(facts(s, d).filter("duration_s > 0"), ["workflow_id", "job"])
).select("workflow_id", "job", "label")
O["i2_triage_unpredictable"] = sql("""
SELECT workflow_id, job, CASE WHEN quantile_cont(dur, 0.95) / quantile_cont(dur, 0.5) >= 3 THEN 'volatile' ELSE 'spiky' END AS label
FROM ok_jobs WHERE dur > 0 GROUP BY ALL HAVING quantile_cont(dur, 0.95) / quantile_cont(dur, 0.5) >= 2""")
Q["i3_triage_regressions"] = lambda s, d: rep.triage_regressions(ch.categorized(s, d, 99)).select(
    "workflow_id", "job", "idx", r4("pct_change", "pct_change"), F.col("more").cast("bigint").alias("more")
)
O["i3_triage_regressions"] = ch.graded_sql(99, """
SELECT workflow_id, job, idx, round(pct_change, 4) AS pct_change, (SELECT greatest(count(*) - 5, 0) FROM categorized WHERE category = 'regression' AND direction = 'slowdown') AS more
FROM categorized WHERE category = 'regression' AND direction = 'slowdown' ORDER BY categorized.created_at, workflow_id, job, idx LIMIT 5""")


def curated_report(s, d):
    return prep.with_workflow_name(failures.drop_negligible(su.report(s, d)), history.workflows(s, d))


Q["i4_triage_flaky"] = lambda s, d: rep.triage_flaky(curated_report(s, d)).select("workflow", r4("failure_rate", "failure_rate"))
O["i4_triage_flaky"] = sql(su.FAIL + """
SELECT coalesce(name, 'workflow-' || workflow_id) AS workflow, round(failure_rate, 4) AS failure_rate FROM graded LEFT JOIN names USING (workflow_id)
WHERE graded.failure_rate >= 0.05 OR cancellation_rate >= 0.05 ORDER BY graded.failure_rate DESC, workflow_id LIMIT 3""")
Q["i5_summary_split"] = lambda s, d: rep.summary_split(summaries(s, d)).select("workflow_id", F.size("jobs").cast("bigint").alias("jobs"), "layout")
O["i5_summary_split"] = sql(su.GROUPED + """
SELECT workflow_id, count(DISTINCT job) AS jobs, CASE WHEN count(DISTINCT job) > 1 AND any_value(n) > 2 THEN 'multi' ELSE 'single' END AS layout
FROM grouped JOIN (SELECT workflow_id, count(*) AS n FROM ok_runs WHERE dur > 0 GROUP BY 1) USING (workflow_id) GROUP BY 1""")
Q["i6_cost_top"] = lambda s, d: rep.cost_top(co.workflow_costs(s, d), co.job_costs(s, d)).select(
    "workflow_id", "job", F.col("job_rank").cast("bigint").alias("job_rank"), r4("minutes", "minutes"), r4("priority_score", "priority_score")
)
O["i6_cost_top"] = sql(co.COST + """
SELECT j.workflow_id, job, row_number() OVER (PARTITION BY j.workflow_id ORDER BY billable + j.self_hosted_minutes DESC, job) AS job_rank,
  round(CAST(billable + j.self_hosted_minutes AS DOUBLE), 4) AS minutes, round(priority_score, 4) AS priority_score
FROM job_costs j JOIN (SELECT * FROM costs ORDER BY priority_score DESC, workflow_id LIMIT 5) c ON c.workflow_id = j.workflow_id QUALIFY job_rank <= 3""")
HEADLINES = """
CASE WHEN top_step IS NULL THEN '' WHEN top_count / failures >= 0.6 OR n_steps = 1 THEN 'fails at: ' || top_step
  ELSE 'failures across ' || n_steps || ' steps (top: ' || top_step || ')' END AS cause,
CASE WHEN top_step IS NULL THEN '' WHEN n_steps = 1 OR top_count > failures * 0.6
  THEN ' -- fails at step "' || top_step || '" in job "' || top_job || '" (' || top_count || '/' || failures || ' failures)'
  ELSE ' -- failures spread across ' || n_steps || ' steps (top: "' || top_step || '" ' || top_count || 'x, "' || second_step || '" ' || second_count || 'x)' END AS headline
"""
Q["i7_failing_headline"] = lambda s, d: rep.failing_headline(su.report(s, d)).select("workflow_id", "cause", "headline")
O["i7_failing_headline"] = sql(su.FAIL + f"SELECT workflow_id, {HEADLINES} FROM graded")
SHARES = """
, cats AS (SELECT workflow_id, category, CAST(sum(count) AS BIGINT) AS n FROM causes GROUP BY ALL),
shares AS (SELECT *, n / sum(n) OVER (PARTITION BY workflow_id) * 100 AS pct FROM cats),
kept_shares AS (SELECT *, count(*) OVER (PARTITION BY workflow_id) AS k, row_number() OVER (PARTITION BY workflow_id ORDER BY n DESC, category) AS place FROM shares WHERE pct >= 5)
"""
Q["i8_category_shares"] = lambda s, d: rep.category_shares(su.report(s, d)).select(
    "workflow_id", F.col("place").cast("bigint").alias("place"), "category", r4("pct", "pct")
)
O["i8_category_shares"] = sql(su.FAIL + SHARES + "SELECT workflow_id, place, category, round(pct, 4) AS pct FROM kept_shares WHERE k >= 2")

def wild_timing(s, d):
    """Step timing with volatility scaled by 1.2: few steps of the sample history reach the reporting threshold."""
    return su.timing(s, d).withColumn("volatility", F.col("volatility") * 1.2)


WILD = su.TIMING + """
, wild AS (SELECT * REPLACE (volatility * 1.2 AS volatility) FROM timing),
volatile AS (SELECT job, max(volatility) AS volatility, arg_max(step, {'v': volatility, 's': step}) AS step FROM wild WHERE volatility >= 2 GROUP BY 1)
"""
Q["i10_volatile_steps"] = lambda s, d: rep.volatile_steps(wild_timing(s, d)).select("job", "step", r4("volatility", "volatility"))
O["i10_volatile_steps"] = sql(WILD + "SELECT job, step, round(volatility, 4) AS volatility FROM volatile")


def named_costs(s, d):
    return prep.with_workflow_name(co.workflow_costs(s, d), history.workflows(s, d))


Q["i11_suggestions"] = lambda s, d: rep.suggestions(
    ch.categorized(s, d, 99), named_costs(s, d), outliers.group_outliers(co.slow(s, d)), curated_report(s, d), wild_timing(s, d)
)
O["i11_suggestions"] = ch.graded_sql(99, co.COST + co.SLOW + su.FAIL + WILD + f"""
SELECT 1 AS section, 'What changed in commit `' || substr(head_sha, 1, 8) || '` (' || strftime(created_at, '%Y-%m-%d') || ') that affected "' || job || '"?' AS text
  FROM categorized WHERE category = 'regression' AND direction = 'slowdown'
UNION ALL SELECT 2, '"' || coalesce(name, 'workflow-' || workflow_id) || '" is a high-cost workflow (' || {pct_sql('daily_rate')}
  || ' mins/day) -- check for flaky tests, cache misses, or resource contention' FROM costs LEFT JOIN names USING (workflow_id) WHERE priority_score >= 50
UNION ALL SELECT 3, '"' || CASE WHEN g.job <> '' THEN g.job ELSE workflow END || '" has ' || count || ' outliers (worst ' || {compact_sql('worst_s')} || ') -- '
  || CASE WHEN v.step IS NULL THEN 'check for resource contention or flaky infrastructure' ELSE 'step "' || v.step || '" is ' || printf('%.1f', round_even(v.volatility, 1)) || 'x volatile and likely the cause' END
  FROM groups g LEFT JOIN volatile v ON v.job = g.job WHERE count >= 5
UNION ALL SELECT 4, '"' || coalesce(name, 'workflow-' || workflow_id) || '" has ' || {pct_sql('failure_rate * 100')} || '% failure rate'
  || CASE main WHEN 'cancelled' THEN ' (mostly cancelled -- check for timeout issues or manual cancellations)' WHEN 'timed_out' THEN ' (timed out -- likely hanging test or resource exhaustion)' ELSE '' END
  FROM graded LEFT JOIN names USING (workflow_id) JOIN (SELECT workflow_id, conclusion AS main FROM listed WHERE conclusion NOT IN ('success', 'skipped') GROUP BY workflow_id, conclusion
    QUALIFY row_number() OVER (PARTITION BY workflow_id ORDER BY count(*) DESC, conclusion) = 1) USING (workflow_id)
  WHERE failure_rate >= 0.1
""")
Q["i12_notable_changes"] = lambda s, d: rep.notable_changes(ch.categorized(s, d)).select("workflow_id", "job", "idx", "severity")
O["i12_notable_changes"] = ch.graded_sql(3, "SELECT workflow_id, job, idx, severity FROM categorized WHERE severity <> 'info'")
Q["i13_outlier_board"] = lambda s, d: rep.outlier_board(outliers.group_outliers(co.slow(s, d))).select(
    "workflow", "job", "count", dur.compact_duration(F.col("worst_s")).alias("worst"), dur.short_sha(F.col("worst_sha")).alias("sha")
)
O["i13_outlier_board"] = sql(co.SLOW + f"""SELECT workflow, job, count, {compact_sql('worst_s')} AS worst, substr(worst_sha, 1, 8) AS sha
FROM groups ORDER BY worst_s DESC, workflow, job""")
Q["i14_changes_by_bucket"] = lambda s, d: rep.changes_by_bucket(ch.categorized(s, d, 99)).groupBy("bucket", "category").agg(F.count(F.lit(1)).alias("n"))
O["i14_changes_by_bucket"] = ch.graded_sql(99, """SELECT CASE WHEN category IN ('oscillating', 'minor') THEN category ELSE 'actionable' END AS bucket, category, count(*) AS n
FROM categorized GROUP BY ALL""")
Q["i15_queue_notable"] = lambda s, d: rep.queue_notable(summaries(s, d)).select("workflow_id", r4("queue_median", "queue_median"), "queue")
O["i15_queue_notable"] = sql(f"""
, q AS (SELECT workflow_id, quantile_cont(epoch(started_at) - epoch(created_at), 0.5) AS queue_median FROM ok GROUP BY 1)
SELECT workflow_id, round(queue_median, 4) AS queue_median, {compact_sql('queue_median')} AS queue FROM q WHERE queue_median > 5""")
Q["i16_step_board"] = lambda s, d: rep.step_board(wild_timing(s, d)).select("workflow_id", "job", "step", "tag", r4("pct_of_job", "pct_of_job"))
O["i16_step_board"] = sql(WILD + """
, board AS (SELECT workflow_id, job FROM wild GROUP BY ALL ORDER BY any_value(job_median) DESC, workflow_id, job LIMIT 5)
SELECT workflow_id, job, step, CASE WHEN volatility >= 2 THEN printf('%.1f', round_even(volatility, 1)) || 'x' ELSE '' END AS tag, round(pct_of_job, 4) AS pct_of_job
FROM wild JOIN board USING (workflow_id, job)""")
Q["i17_failure_board"] = lambda s, d: rep.failure_board(curated_report(s, d)).select("workflow", "failures", "total_runs", "breakdown")
O["i17_failure_board"] = sql(su.FAIL + """
, texts AS (SELECT workflow_id, string_agg(conclusion || ': ' || n, ', ' ORDER BY conclusion) AS t FROM (
  SELECT workflow_id, conclusion, count(*) AS n FROM listed WHERE conclusion NOT IN ('success', 'skipped') GROUP BY ALL) GROUP BY 1)
SELECT coalesce(name, 'workflow-' || workflow_id) AS workflow, failures, total_runs,
  t || CASE WHEN retried_runs > 0 THEN ', retried: ' || retried_runs || ' (+' || extra_attempts || ' attempts)' ELSE '' END AS breakdown
FROM graded LEFT JOIN names USING (workflow_id) JOIN texts USING (workflow_id)
WHERE graded.failure_rate >= 0.05 OR cancellation_rate >= 0.05 ORDER BY graded.failure_rate DESC, workflow_id LIMIT 7""")
Q["i18_priority_findings"] = lambda s, d: rep.priority_findings(ch.categorized(s, d, 99), curated_report(s, d), named_costs(s, d))
O["i18_priority_findings"] = ch.graded_sql(99, co.COST + su.FAIL + SHARES + f"""
, heads AS (SELECT workflow_id, {HEADLINES} FROM graded),
mixes AS (SELECT workflow_id, ' (' || string_agg({pct_sql('pct')} || '% ' || category, ', ' ORDER BY place) || ')' AS mix FROM kept_shares WHERE k >= 2 GROUP BY 1)
SELECT 1 AS section, 'REGRESSION' AS tag, job AS subject, CASE WHEN pct_change >= 0 THEN '+' ELSE '' END || {pct_sql('pct_change')} || '% (' || {compact_sql('before_mean')} || ' -> '
  || {compact_sql('after_mean')} || ') at commit `' || substr(head_sha, 1, 8) || '` on ' || strftime(created_at, '%Y-%m-%d')
  || CASE WHEN persistence = 'persistent' THEN ' -- persistent over ' || post_runs || ' runs' ELSE '' END || ' (p=' || printf('%.4f', p_value) || ')' AS text
  FROM categorized WHERE category = 'regression' AND direction = 'slowdown'
UNION ALL SELECT 2, CASE kind WHEN 'systematic' THEN 'SYSTEMATIC' ELSE 'FLAKY' END, coalesce(name, 'workflow-' || g.workflow_id),
  {pct_sql('failure_rate * 100')} || '% failure rate (' || failures || '/' || total_runs || ' runs)'
  || CASE trend WHEN 'stable' THEN '' ELSE ', **' || trend || '** (recent 7d: ' || {pct_sql('recent_failure_rate * 100')} || '%)' END
  || headline || coalesce(mix, '') || CASE WHEN retried_runs > 0 THEN ', ' || retried_runs || ' retried (+' || extra_attempts || ' extra attempts)' ELSE '' END
  FROM graded g JOIN heads h ON h.workflow_id = g.workflow_id LEFT JOIN mixes m ON m.workflow_id = g.workflow_id LEFT JOIN names n ON n.workflow_id = g.workflow_id
  WHERE failure_rate >= 0.05 OR cancellation_rate >= 0.05
UNION ALL (SELECT 3, 'COST', coalesce(name, 'workflow-' || workflow_id), {pct_sql('daily_rate')} || ' billable mins/day (' || {pct_sql('billable_minutes')} || ' total)'
  FROM costs LEFT JOIN names USING (workflow_id) ORDER BY priority_score DESC, workflow_id LIMIT 3)
""")

Q["j1_compact_duration"] = lambda s, d: history.jobs(s, d).select(
    dur.duration_s(F.col("started_at"), F.col("completed_at")).alias("x")
).groupBy("x").agg(F.count(F.lit(1)).alias("jobs")).select(
    r4("x", "seconds"), "jobs", dur.compact_duration(F.col("x")).alias("padded"), dur.compact_duration(F.col("x"), pad=False).alias("plain")
)
O["j1_compact_duration"] = sql(f"SELECT dur AS seconds, count(*) AS jobs, {compact_sql('dur')} AS padded, {compact_sql('dur', False)} AS plain FROM jobs GROUP BY dur")
Q["j2_duration_text"] = lambda s, d: history.jobs(s, d).select(
    dur.duration_text(dur.duration_s(F.col("started_at"), F.col("completed_at"))).alias("text")
).groupBy("text").agg(F.count(F.lit(1)).alias("jobs"))
O["j2_duration_text"] = sql(f"SELECT {text_sql('dur')} AS text, count(*) AS jobs FROM jobs GROUP BY 1")
Q["j3_parse_duration"] = lambda s, d: history.jobs(s, d).select(
    "job_id", dur.parse_duration(dur.duration_text(dur.duration_s(F.col("started_at"), F.col("completed_at")))).alias("seconds")
)
O["j3_parse_duration"] = sql("SELECT job_id, dur AS seconds FROM jobs")
Q["j4_total_time"] = lambda s, d: summary.duration_stats(facts(s, d).filter("duration_s > 0"), ["workflow_id", "job"]).select(
    "workflow_id", "job", dur.total_time_text(F.col("total")).alias("total"), dur.total_time_text(F.col("median")).alias("median")
)
O["j4_total_time"] = sql("""
, t AS (SELECT workflow_id, job, CAST(floor(sum(dur)) AS BIGINT) AS a, CAST(floor(quantile_cont(dur, 0.5)) AS BIGINT) AS b FROM ok_jobs WHERE dur > 0 GROUP BY ALL)
SELECT workflow_id, job, CASE WHEN a >= 3600 THEN (a // 3600) || 'h' ELSE '' END || (a // 60 % 60) || 'm' AS total,
  CASE WHEN b >= 3600 THEN (b // 3600) || 'h' ELSE '' END || (b // 60 % 60) || 'm' AS median FROM t""")
Q["j5_short_sha"] = lambda s, d: history.runs(s, d).select("run_id", dur.short_sha(F.col("head_sha")).alias("sha"))
O["j5_short_sha"] = sql("SELECT run_id, substr(head_sha, 1, 8) AS sha FROM listed")
