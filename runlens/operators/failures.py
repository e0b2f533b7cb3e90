"""Reliability: failure rates, their causes and trends, and retries."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runlens.functions.grading import failure_severity
from runlens.functions.names import step_category

MIN_RUNS = 5
RECENT_DAYS = 7
NEGLIGIBLE = 0.05


def rerun_stats(attempts: DataFrame) -> DataFrame:
    """Retries per workflow from every listed attempt; only workflows that had one."""
    per_run = attempts.groupBy("workflow_id", "run_id").agg(F.max("run_attempt").alias("attempts"))
    extra = F.greatest(F.col("attempts") - 1, F.lit(0))
    return (
        per_run.groupBy("workflow_id")
        .agg(
            F.count(F.lit(1)).alias("unique_runs"),
            F.count_if(F.col("attempts") > 1).alias("retried_runs"),
            F.sum(extra).alias("extra_attempts"),
        )
        .filter("retried_runs > 0")
        .withColumn("rerun_rate", F.col("retried_runs") / F.col("unique_runs"))
    )


def _is_failure():
    return ~F.col("conclusion").isin("success", "skipped", "cancelled")


def failure_stats(runs: DataFrame) -> DataFrame:
    """Run, failure and cancellation counts per workflow, overall and in the last seven days."""
    latest = runs.agg(F.max("created_at").alias("latest"))
    cutoff = latest.select(F.col("latest") - F.make_dt_interval(F.lit(RECENT_DAYS))).scalar()
    recent = F.col("created_at") > F.col("_cutoff")
    return (
        runs.select("workflow_id", "conclusion", "created_at", cutoff.alias("_cutoff"))
        .groupBy("workflow_id")
        .agg(
            F.count(F.lit(1)).alias("total_runs"),
            F.count_if(_is_failure()).alias("failures"),
            F.count_if(F.col("conclusion") == "cancelled").alias("cancellations"),
            F.count_if(recent).alias("recent_runs"),
            F.count_if(recent & _is_failure()).alias("recent_failures"),
        )
    )


def conclusion_counts(runs: DataFrame) -> DataFrame:
    """Runs per (workflow, conclusion) for everything that is not fine."""
    bad = runs.filter(~F.col("conclusion").isin("success", "skipped"))
    return bad.groupBy("workflow_id", "conclusion").agg(F.count(F.lit(1)).alias("count"))


def failing_steps(runs: DataFrame, jobs: DataFrame, steps: DataFrame) -> DataFrame:
    """How often each step was the first to fail in a failed job of a failed run."""
    failed_runs = runs.filter(_is_failure()).select("run_id", "workflow_id")
    failed_jobs = jobs.filter("conclusion = 'failure'").select("run_id", "job_id", F.col("name").alias("job"))
    failed = failed_jobs.join(failed_runs, "run_id").select("workflow_id", "job", "job_id")
    bad_steps = steps.filter("conclusion = 'failure'").select("job_id", "number", "name")
    return (
        bad_steps.join(failed, "job_id")
        .groupBy("workflow_id", "job", "job_id")
        .agg(F.min_by("name", "number").alias("step"))
        .groupBy("workflow_id", "job", "step")
        .agg(F.count(F.lit(1)).alias("count"))
        .withColumn("category", step_category(F.col("step")))
    )


def category_counts(causes: DataFrame) -> DataFrame:
    return causes.groupBy("workflow_id", "category").agg(F.sum("count").alias("count"))


def as_map(counts: DataFrame, key: str, name: str) -> DataFrame:
    """Counts per (workflow, key) as one map per workflow; ``key`` takes a handful of values."""
    entries = F.collect_list(F.struct(key, "count"))
    return counts.groupBy("workflow_id").agg(F.map_from_entries(F.array_sort(entries)).alias(name))


def failure_report(runs: DataFrame, jobs: DataFrame, steps: DataFrame, reruns: DataFrame) -> DataFrame:
    """Reliability of each workflow with at least five runs and some failure or cancellation.

    ``runs`` are deduplicated but neither filtered by branch nor by outcome.
    """
    causes = failing_steps(runs, jobs, steps)
    stats = failure_stats(runs).filter(
        (F.col("total_runs") >= MIN_RUNS) & ((F.col("failures") > 0) | (F.col("cancellations") > 0))
    )
    cause = F.struct((-F.col("count")).alias("_order"), F.col("job").alias("job_name"),
                     F.col("step").alias("step_name"), "count", "category")
    listed = causes.groupBy("workflow_id").agg(F.array_sort(F.collect_list(cause)).alias("failing_steps"))
    rate = F.col("failures") / F.col("total_runs")
    recent = F.when(F.col("recent_runs") >= 5, F.col("recent_failures") / F.col("recent_runs")).otherwise(F.lit(0.0))
    change = F.col("recent_failure_rate") - F.col("failure_rate")
    top = F.coalesce(F.try_element_at("failing_steps", F.lit(1))["count"], F.lit(0))
    return (
        stats.join(listed, "workflow_id", "left")
        .join(as_map(conclusion_counts(runs), "conclusion", "by_conclusion"), "workflow_id", "left")
        .join(as_map(category_counts(causes), "category", "by_category"), "workflow_id", "left")
        .join(reruns.select("workflow_id", "retried_runs", "extra_attempts", "rerun_rate"), "workflow_id", "left")
        .fillna(0, ["retried_runs", "extra_attempts", "rerun_rate"])
        .withColumn("failure_rate", rate)
        .withColumn("cancellation_rate", F.col("cancellations") / F.col("total_runs"))
        .withColumn("recent_failure_rate", recent)
        .withColumn("severity", failure_severity(F.col("failure_rate")))
        .withColumn(
            "kind",
            F.when((F.col("failures") > 0) & (top / F.col("failures") >= 0.9), "systematic").otherwise("flaky"),
        )
        .withColumn(
            "trend",
            F.when(F.col("recent_runs") < 5, "stable")
            .when(change <= -0.05, "improving")
            .when(change >= 0.05, "worsening")
            .otherwise("stable"),
        )
        .withColumn(
            "failing_steps",
            F.transform("failing_steps", lambda x: F.struct(
                x["job_name"].alias("job_name"), x["step_name"].alias("step_name"),
                x["count"].alias("count"), x["category"].alias("category"))),
        )
    )


def by_failure_rate(report: DataFrame) -> DataFrame:
    return report.orderBy(F.col("failure_rate").desc(), "workflow_id")


def drop_negligible(report: DataFrame) -> DataFrame:
    """Without workflows that neither fail nor get cancelled in 5 % of their runs."""
    return report.filter((F.col("failure_rate") >= NEGLIGIBLE) | (F.col("cancellation_rate") >= NEGLIGIBLE))
