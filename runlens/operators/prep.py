"""Row durations, filters and the preparation of raw runs for analysis."""

import datetime as dt
import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from runlens.functions.durations import duration_s, seconds_between
from runlens.schema import DIAGNOSTICS

# The texts of diagnostics and errors in this module.


def with_duration(df: DataFrame) -> DataFrame:
    """Adds ``duration_s`` from ``started_at`` to ``completed_at``; 0 means unusable."""
    return df.withColumn("duration_s", duration_s(F.col("started_at"), F.col("completed_at")))


def run_durations(runs: DataFrame, jobs: DataFrame) -> DataFrame:
    """Adds ``duration_s`` to runs: until the last job completion, else until the last update."""
    last = jobs.groupBy("run_id").agg(F.max("completed_at").alias("_last_job"))
    by_jobs = seconds_between(F.col("started_at"), F.col("_last_job"))
    return (
        runs.join(last, "run_id", "left")
        .withColumn(
            "duration_s",
            F.when(by_jobs >= 0, by_jobs).otherwise(duration_s(F.col("started_at"), F.col("updated_at"))),
        )
        .drop("_last_job")
    )


def is_completed() -> Column:
    return F.col("status") == "completed"


def filter_branch(runs: DataFrame, branch: str) -> DataFrame:
    return runs.filter(F.col("head_branch") == branch) if branch else runs


def exclude_failures(runs: DataFrame) -> DataFrame:
    return runs.filter(F.col("conclusion") == "success")


def dedup_retries(runs: DataFrame) -> DataFrame:
    """Highest attempt of each run, the first seen among equals.

    The rank limit is applied before the shuffle as well, so copies of one run never meet in one task.
    """
    latest = Window.partitionBy("run_id").orderBy(F.col("run_attempt").desc(), F.col("ingest_seq"))
    return runs.withColumn("_rank", F.row_number().over(latest)).filter("_rank = 1").drop("_rank")


def filter_workflow(df: DataFrame, name: str) -> DataFrame:
    return df.filter(F.col("workflow_name") == name) if name else df


def with_workflow_name(df: DataFrame, workflows: DataFrame, column: str = "workflow") -> DataFrame:
    """Adds the listed workflow name, or ``workflow-<id>`` when the id is not listed."""
    names = workflows.select("workflow_id", F.col("name").alias("_name"))
    fallback = F.concat(F.lit("workflow-"), F.col("workflow_id"))
    return (
        df.join(names, "workflow_id", "left").withColumn(column, F.coalesce("_name", fallback)).drop("_name")
    )


def since(text: str, now: dt.datetime) -> Column:
    """Start of the period a text such as ``30d``, ``2w``, ``3mo`` or ``2026-01-01`` names."""
    if re.fullmatch(r"\d{4}-\d{2}-\d{2}", text):
        return F.lit(dt.datetime.strptime(text, "%Y-%m-%d"))
    match = re.fullmatch(r"(\d+)(d|w|mo)", text)
    if not match:
        # Fixed value: the text of this error.
        raise ValueError(f"unrecognized period {text!r} (use Nd, Nw, Nmo, or YYYY-MM-DD)")
    count, unit = int(match[1]), match[2]
    step = {"d": F.make_interval(days=F.lit(count)), "w": F.make_interval(weeks=F.lit(count)),
            "mo": F.make_interval(months=F.lit(count))}[unit]
    return F.lit(now) - step


def filter_since(runs: DataFrame, text: str, now: dt.datetime) -> DataFrame:
    return runs.filter(F.col("created_at") >= since(text, now))


def diagnostic_rows(source: DataFrame, kind: str, rules: list[tuple[Column, str, Column]]) -> DataFrame:
    """Diagnostics of one aggregate row: ``rules`` are (when, severity, message)."""
    entries = F.array(*[
        F.when(when, F.struct(F.lit(severity).alias("severity"), F.lit(kind).alias("kind"),
                              F.lit("global").alias("scope"), message.alias("message")))
        for when, severity, message in rules
    ])
    return source.select(F.inline(F.filter(entries, lambda e: e.isNotNull())))


def empty_diagnostics(spark) -> DataFrame:
    return spark.createDataFrame([], DIAGNOSTICS)


def preprocess(
    runs: DataFrame, branch: str = "", include_failures: bool = False, unique: DataFrame | None = None
) -> tuple[DataFrame, DataFrame]:
    """Deduplicated runs of the branch, successful unless failures are included, and the diagnostics.

    ``unique`` are the runs without retries, where they are at hand.
    """
    unique = dedup_retries(runs) if unique is None else unique
    on_branch = F.col("head_branch") == branch if branch else F.lit(True)
    success = F.col("conclusion") == "success"
    kept = unique.filter(on_branch) if branch else unique
    kept = kept if include_failures else exclude_failures(kept)

    # One row per run: how often it was listed, and branch and outcome of the attempt that is kept.
    per_run = runs.groupBy("run_id").agg(
        F.count(F.lit(1)).alias("listed"),
        F.max_by(F.struct(on_branch.alias("on_branch"), success.alias("success")),
                 F.struct("run_attempt", -F.col("ingest_seq"))).alias("kept"),
    )
    counts = per_run.agg(
        F.coalesce(F.sum("listed"), F.lit(0)).alias("listed"),
        F.count(F.lit(1)).alias("unique"),
        F.count_if("kept.on_branch").alias("on_branch"),
        F.count_if(F.col("kept.on_branch") & ~F.col("kept.success")).alias("failed"),
    )
    rules = [
        (F.col("unique") < F.col("listed"), "info",
         F.format_string("deduplicated %d retried runs", F.col("listed") - F.col("unique"))),
    ]
    if branch:
        rules.append((
            (F.col("on_branch") == 0) & (F.col("unique") > 0), "warn",
            F.format_string(f'no runs found for branch "{branch}" (had %d runs on other branches)', F.col("unique")),
        ))
    if not include_failures:
        rules.append((
            F.col("failed") > 0, "info",
            F.format_string("excluded %d non-success runs from duration analysis", F.col("failed")),
        ))
    return kept, diagnostic_rows(counts, "preprocess", rules)


def missing_labels(jobs: DataFrame) -> DataFrame:
    """One diagnostic when jobs lack runner labels."""
    counts = jobs.agg(F.count_if(F.coalesce(F.size("labels"), F.lit(0)) <= 0).alias("n"))
    text = "runner labels unavailable for %d jobs (cost estimates use default 1x Linux rate)"
    return diagnostic_rows(counts, "partial_data", [(F.col("n") > 0, "info", F.format_string(text, F.col("n")))])


def result_meta(runs: DataFrame) -> DataFrame:
    """Total runs, creation range and the workflow ids.

    Ids are reduced to one row per workflow before they are listed.
    """
    per_workflow = runs.groupBy("workflow_id").agg(
        F.count(F.lit(1)).alias("n"), F.min("created_at").alias("lo"), F.max("created_at").alias("hi")
    )
    return per_workflow.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("total_runs"),
        F.min("lo").alias("first_created"),
        F.max("hi").alias("last_created"),
        F.array_sort(F.collect_list("workflow_id")).alias("workflow_ids"),
    )


def require_rows(df: DataFrame, message: str) -> DataFrame:
    """Raises ``ValueError(message)`` when there is nothing to analyse."""
    if df.isEmpty():
        raise ValueError(message)
    return df
