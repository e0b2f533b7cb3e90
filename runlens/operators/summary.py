"""Duration statistics of workflows and jobs."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runlens.functions.durations import duration_s, seconds_between
from runlens.functions.grading import volatility_label
from runlens.functions.names import matrix_base
from runlens.operators.quantiles import histogram, percentile_of, percentiles, percentiles_of_histogram

STATS = ["count", "mean", "median", "p95", "p99", "min", "max", "total", "volatility", "label"]


def stats_of_histogram(hist: DataFrame, keys: list[str], value: str, bounded: bool = True) -> DataFrame:
    """Statistics per key. ``bounded`` is as for percentiles: without it no task holds the values of a key."""
    v, n = F.col(value), F.col("n")
    sums = [F.sum("n").alias("count"), F.sum(v * n).alias("total"), F.min(v).alias("min"), F.max(v).alias("max")]
    if bounded:
        raw = hist.groupBy(*keys).agg(*sums, percentile_of(value, [50, 95, 99]).alias("_p"))
        raw = raw.withColumns({"median": F.col("_p")[0], "p95": F.col("_p")[1], "p99": F.col("_p")[2]})
    else:
        found = percentiles_of_histogram(hist, keys, value, {"median": 50, "p95": 95, "p99": 99}, bounded)
        raw = hist.groupBy(*keys).agg(*sums).join(found.drop("rows"), keys)
    ratio = F.when(F.col("median") > 0, F.col("p95") / F.col("median")).otherwise(F.lit(0.0))
    return (
        raw.withColumn("mean", F.col("total") / F.col("count"))
        .withColumn("volatility", ratio)
        .withColumn("label", volatility_label(F.col("volatility")))
        .select(*keys, *STATS)
    )


def duration_stats(df: DataFrame, keys: list[str], value: str = "duration_s", bounded: bool = True) -> DataFrame:
    """Count, mean, percentiles, range, total and volatility of a value per key."""
    return stats_of_histogram(histogram(df, keys, value), keys, value, bounded)


def job_facts(runs: DataFrame, jobs: DataFrame) -> DataFrame:
    """Jobs of the given runs with the run's workflow, creation and commit, and their duration."""
    of_run = runs.select("run_id", "workflow_id", "created_at", "head_sha")
    return jobs.join(of_run, "run_id").select(
        "workflow_id",
        F.col("name").alias("job"),
        "run_id",
        "job_id",
        "created_at",
        "head_sha",
        "labels",
        "started_at",
        "completed_at",
        duration_s(F.col("started_at"), F.col("completed_at")).alias("duration_s"),
    )


def timed(facts: DataFrame) -> DataFrame:
    return facts.filter("duration_s > 0")


def queue_stats(runs: DataFrame) -> DataFrame:
    """Median and p95 wait between creation and start, per workflow."""
    waits = runs.withColumn("queue_s", seconds_between(F.col("created_at"), F.col("started_at"))).filter("queue_s >= 0")
    return percentiles(waits, ["workflow_id"], "queue_s", {"queue_median": 50, "queue_p95": 95})


def group_matrix(hist: DataFrame) -> DataFrame:
    """Merges a job histogram over the variants of a job where a workflow has more than one.

    Variants pool their values; statistics of statistics are never averaged.
    """
    names = hist.select("workflow_id", "job").distinct().withColumn("_base", matrix_base(F.col("job")))
    sizes = names.groupBy("workflow_id", "_base").agg(F.count(F.lit(1)).alias("_variants"))
    renamed = names.join(sizes, ["workflow_id", "_base"]).select(
        "workflow_id",
        "job",
        F.when(F.col("_variants") > 1, F.format_string("%s (%d variants)", "_base", "_variants"))
        .otherwise(F.col("job"))
        .alias("job_group"),
    )
    return (
        hist.join(renamed, ["workflow_id", "job"])
        .groupBy("workflow_id", F.col("job_group").alias("job"), "duration_s")
        .agg(F.sum("n").alias("n"))
    )


def job_stats(facts: DataFrame, matrix: bool = True) -> DataFrame:
    """Duration statistics per (workflow, job), matrix variants pooled unless told otherwise."""
    keys = ["workflow_id", "job"]
    hist = histogram(timed(facts), keys, "duration_s")
    return stats_of_histogram(group_matrix(hist) if matrix else hist, keys, "duration_s")


def workflow_summary(runs: DataFrame, facts: DataFrame, matrix: bool = True) -> DataFrame:
    """One row per workflow with usable runs: statistics, queue times and its jobs, slowest median first.

    ``runs`` carry ``duration_s``; a workflow's list has one entry per job name it defines.
    """
    stats = duration_stats(runs.filter("duration_s > 0"), ["workflow_id"])
    entry = F.struct((-F.col("median")).alias("_order"), F.col("job").alias("name"), F.struct(*STATS).alias("stats"))
    nested = (
        job_stats(facts, matrix)
        .groupBy("workflow_id")
        .agg(F.array_sort(F.collect_list(entry)).alias("jobs"))
        .withColumn("jobs", F.transform("jobs", lambda x: F.struct(x["name"].alias("name"), x["stats"].alias("stats"))))
    )
    none = F.array().cast(nested.schema["jobs"].dataType)
    return (
        stats.join(queue_stats(runs), "workflow_id", "left")
        .join(nested, "workflow_id", "left")
        .fillna(0.0, ["queue_median", "queue_p95"])
        .withColumn("jobs", F.coalesce("jobs", none))
    )
