"""Findings: one table of (type, severity, title, description, detail) for every kind of result.

Each function turns a typed result into finding rows; ``detail`` is a JSON text, so all kinds union.
Durations in it read like ``5m30s``.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runlens.functions.durations import duration_text, short_sha
from runlens.functions.grading import half_even
from runlens.operators.prep import with_workflow_name

# Titles, descriptions and detail names in this module.
COLUMNS = ["type", "severity", "title", "description", "detail"]

# Finding types.
SUMMARY, STEPS, STAGES, RUNNER = "summary", "steps", "pipeline", "runner"
OUTLIER, CHANGE, FAILURE, COST = "outlier", "changepoint", "failure", "cost"
TYPES = [SUMMARY, STEPS, STAGES, RUNNER, OUTLIER, CHANGE, FAILURE, COST]


def _quoted(name: Column) -> Column:
    return F.concat(F.lit('"'), F.regexp_replace(name, r'(["\\])', r"\\$1"), F.lit('"'))


def _stamp(column: Column) -> Column:
    return F.date_format(column, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def _stats(stats) -> Column:
    return F.struct(
        stats("count").alias("total_runs"),
        *[duration_text(stats(x)).alias(x) for x in ("mean", "median", "p95", "p99", "min", "max")],
        duration_text(stats("total")).alias("total_time"),
        stats("volatility").alias("volatility"),
        stats("label").alias("volatility_label"),
    )


def _rows(df: DataFrame, kind: str, severity, title: Column, description: Column, *detail) -> DataFrame:
    severity = F.lit(severity) if isinstance(severity, str) else severity
    return df.select(
        F.lit(kind).alias("type"),
        severity.alias("severity"),
        title.alias("title"),
        description.alias("description"),
        F.to_json(F.struct(*detail)).alias("detail"),
    )


def summary_findings(summary: DataFrame, workflows: DataFrame) -> DataFrame:
    df = with_workflow_name(summary, workflows)
    jobs = F.transform("jobs", lambda j: F.struct(j["name"].alias("name"), _stats(lambda x: j["stats"][x]).alias("stats")))
    queue = F.struct(duration_text(F.col("queue_median")).alias("median"), duration_text(F.col("queue_p95")).alias("p95"))
    text = F.format_string(
        "%d runs, median %s, p95 %s, total CI time %s", "count", duration_text(F.col("median")),
        duration_text(F.col("p95")), duration_text(F.col("total")),
    )
    return _rows(df, SUMMARY, "info", F.concat(F.lit("Workflow "), _quoted(F.col("workflow"))), text,
                 "workflow", _stats(F.col).alias("stats"), queue.alias("queue"), jobs.alias("jobs"))


def step_findings(timing: DataFrame, workflows: DataFrame) -> DataFrame:
    """One finding per job; a job brings at most the top steps."""
    step = F.struct(
        "step_rank", F.col("step").alias("name"), "runs", duration_text(F.col("median")).alias("median"),
        duration_text(F.col("p95")).alias("p95"), "pct_of_job", "volatility",
    )
    per_job = timing.groupBy("workflow_id", "job", "job_runs").agg(F.array_sort(F.collect_list(step)).alias("steps"))
    df = with_workflow_name(per_job, workflows).withColumn(
        "steps", F.transform("steps", lambda s: s.dropFields("step_rank"))
    )
    title = F.format_string("Slowest steps in %s / %s", "workflow", "job")
    text = F.format_string("Top %d steps by duration (of %d runs)", F.size("steps"), "job_runs")
    return _rows(df, STEPS, "info", title, text, F.col("workflow").alias("workflow_name"),
                 F.col("job").alias("job_name"), F.col("job_runs").alias("total_runs"), "steps")


def stage_findings(structure: DataFrame, workflows: DataFrame) -> DataFrame:
    stage = F.struct(
        "stage", "name", "jobs", duration_text(F.col("stage_median")).alias("duration"),
        F.col("pct_of_wall").alias("pct_of_pipeline"), "sequential",
    )
    keys = ["workflow_id", "total_runs", "wall_median", "job_sum_median", "parallelism"]
    per_workflow = structure.groupBy(*keys).agg(
        F.array_sort(F.collect_list(stage)).alias("stages"),
        F.max(F.when(F.col("critical"), F.col("name"))).alias("critical_path"),
        F.max("stage_median").alias("_longest"),
    )
    df = with_workflow_name(per_workflow, workflows).withColumn(
        "stages", F.transform("stages", lambda s: s.dropFields("stage"))
    )
    text = F.format_string(
        "%d%% parallel efficiency, %d stages, critical path: %s (%s)", F.floor(F.col("parallelism") * 100).cast("bigint"),
        F.size("stages"), "critical_path", duration_text(F.col("_longest")),
    )
    return _rows(df, STAGES, "info", F.concat(F.lit("Pipeline structure: "), F.col("workflow")), text, "workflow",
                 "total_runs", duration_text(F.col("wall_median")).alias("median_wall_clock"),
                 duration_text(F.col("job_sum_median")).alias("median_job_sum"), "parallelism", "stages",
                 "critical_path")


def runner_findings(sizing: DataFrame, workflows: DataFrame) -> DataFrame:
    df = with_workflow_name(sizing, workflows)
    return _rows(df, RUNNER, "info", F.format_string("Runner sizing: %s / %s", "workflow", "job"), F.col("suggestion"),
                 F.col("workflow").alias("workflow_name"), F.col("job").alias("job_name"), "runner_label", "cores",
                 duration_text(F.col("median")).alias("median_duration"), "runs", "multiplier", "issue", "suggestion")


def slow_findings(outliers: DataFrame) -> DataFrame:
    """One finding per slow run or job, before they are grouped."""
    of_job = F.col("job") != ""
    title = F.when(of_job, F.format_string("Slow job %s in %s", _quoted(F.col("job")), _quoted(F.col("workflow")))).otherwise(
        F.concat(F.lit("Slow run in "), _quoted(F.col("workflow")))
    )
    rank = half_even(F.col("rank"))
    text = F.format_string("%s took %s (p%s — slower than %s%% of runs)", F.when(of_job, "Job").otherwise("Run"),
                           duration_text(F.col("duration_s")), rank, rank)
    return _rows(outliers, OUTLIER, F.col("severity"), title, text, "run_id", F.col("head_sha").alias("commit_sha"),
                 duration_text(F.col("duration_s")).alias("duration"), F.col("rank").alias("percentile"),
                 F.col("workflow").alias("workflow_name"), F.nullif(F.col("job"), F.lit("")).alias("job_name"))


def outlier_findings(groups: DataFrame) -> DataFrame:
    job = F.nullif(F.col("job"), F.lit(""))
    subject = F.concat_ws(" / ", "workflow", job)
    text = F.format_string("%dx, worst %s (p%s)", "count", duration_text(F.col("worst_s")), half_even(F.col("worst_rank")))
    return _rows(groups, OUTLIER, F.col("severity"), F.concat(F.lit("Outliers in "), subject), text,
                 F.col("workflow").alias("workflow_name"), job.alias("job_name"), "count",
                 duration_text(F.col("worst_s")).alias("worst_duration"), F.col("worst_rank").alias("worst_percentile"),
                 F.col("worst_sha").alias("worst_commit_sha"), F.col("severity").alias("max_severity"))


def change_findings(points: DataFrame) -> DataFrame:
    title = F.format_string("Performance %s in job %s", "direction", _quoted(F.col("job")))
    text = F.format_string(
        "%s%% change at %s (commit %s), before: %s, after: %s (p=%s)", half_even(F.col("pct_change")),
        F.date_format("created_at", "yyyy-MM-dd"), short_sha(F.col("head_sha")), duration_text(F.col("before_mean")),
        duration_text(F.col("after_mean")), half_even(F.col("p_value"), 4),
    )
    return _rows(points, CHANGE, F.col("severity"), title, text, F.col("workflow").alias("workflow_name"),
                 F.col("job").alias("job_name"), F.col("idx").alias("change_idx"),
                 duration_text(F.col("before_mean")).alias("before_mean"),
                 duration_text(F.col("after_mean")).alias("after_mean"), "pct_change", "direction", "p_value",
                 F.col("head_sha").alias("commit_sha"), _stamp(F.col("created_at")).alias("date"),
                 F.col("post_runs").alias("post_change_runs"), F.col("post_cv").alias("post_change_cv"), "persistence",
                 F.col("overlap").alias("overlap_ratio"), "category")


def failure_findings(report: DataFrame, workflows: DataFrame) -> DataFrame:
    df = with_workflow_name(report, workflows)
    title = F.format_string("Workflow %s failure rate", _quoted(F.col("workflow")))
    text = F.format_string("%s%% failure rate (%d/%d runs)", half_even(F.col("failure_rate") * 100), "failures", "total_runs")
    return _rows(df, FAILURE, F.col("severity"), title, text, "workflow", "total_runs",
                 F.col("failures").alias("failure_count"), "failure_rate", F.col("kind").alias("failure_kind"), "trend",
                 "recent_failure_rate", F.col("cancellations").alias("cancellation_count"), "cancellation_rate",
                 "by_conclusion", "by_category", "failing_steps", "retried_runs", "extra_attempts", "rerun_rate")


def cost_findings(costs: DataFrame, job_costs: DataFrame, workflows: DataFrame) -> DataFrame:
    """Workflow costs with the list of their jobs, most minutes first."""
    minutes = F.col("billable") + F.col("self_hosted_minutes")
    job = F.struct((-minutes).alias("_order"), F.col("job").alias("name"), minutes.alias("billable_minutes"), "multiplier", "runs")
    per_workflow = job_costs.groupBy("workflow_id").agg(F.array_sort(F.collect_list(job)).alias("jobs"))
    df = with_workflow_name(costs.join(per_workflow, "workflow_id", "left"), workflows).withColumn(
        "jobs", F.transform("jobs", lambda j: j.dropFields("_order"))
    )
    text = F.format_string("%s billable minutes (%s/day) across %d runs", half_even(F.col("billable_minutes")),
                           half_even(F.col("daily_rate")), "total_runs")
    return _rows(df, COST, "info", F.format_string("Workflow %s cost estimate", _quoted(F.col("workflow"))), text, "workflow",
                 "total_runs", "billable_minutes", "self_hosted_minutes", "daily_rate", "priority_score",
                 F.col("daily_savings").alias("daily_savings_estimate"), "jobs")


def by_type(findings: DataFrame, kind: str) -> DataFrame:
    return findings.filter(F.col("type") == kind)


def compact(findings: DataFrame) -> DataFrame:
    """Findings without minor and oscillating change points."""
    category = F.get_json_object("detail", "$.category")
    noise = (F.col("type") == CHANGE) & category.isin("oscillating", "minor")
    return findings.filter(~F.coalesce(noise, F.lit(False)))


def omitted(findings: DataFrame) -> DataFrame:
    """How many findings :func:`compact` leaves out, and how many remain."""
    category = F.get_json_object("detail", "$.category")
    noise = F.coalesce((F.col("type") == CHANGE) & category.isin("oscillating", "minor"), F.lit(False))
    return findings.agg(F.count_if(noise).alias("omitted"), F.count_if(~noise).alias("kept"))


def diagnostic_text(diagnostics: DataFrame) -> DataFrame:
    """Adds ``text``: ``[severity] scope: message``, without the scope where there is none."""
    scope = F.when(F.col("scope") != "", F.concat(F.col("scope"), F.lit(": "))).otherwise("")
    return diagnostics.withColumn("text", F.format_string("[%s] %s%s", "severity", scope, "message"))
