"""Step timing: where the time of a job goes."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from runlens.functions.durations import duration_s
from runlens.operators.quantiles import histogram, percentile_of

MIN_RUNS = 3
MIN_MEDIAN_MS = 500


def step_timing(facts: DataFrame, steps: DataFrame, top_n: int = 3) -> DataFrame:
    """The ``top_n`` slowest steps of each job by median, with their share of the job's median.

    ``job_rank`` orders the jobs by median, slowest first.
    """
    job_keys = ["workflow_id", "job"]
    step_keys = [*job_keys, "step"]
    step_rows = steps.select(
        "job_id", F.col("name").alias("step"), duration_s(F.col("started_at"), F.col("completed_at")).alias("step_s")
    ).filter("step_s > 0")
    timed = step_rows.join(facts.select("job_id", *job_keys), "job_id")
    per_step = (
        histogram(timed, step_keys, "step_s")
        .groupBy(*step_keys)
        .agg(F.sum("n").alias("runs"), percentile_of("step_s", [50, 95]).alias("_p"))
        .select(*step_keys, "runs", F.col("_p")[0].alias("median"), F.col("_p")[1].alias("p95"))
        .filter((F.col("runs") >= MIN_RUNS) & (F.floor(F.col("median") * 1000) >= MIN_MEDIAN_MS))
    )
    usable = F.when(F.col("duration_s") > 0, F.col("duration_s"))
    per_job = (
        histogram(facts, job_keys, "duration_s")
        .withColumn("duration_s", usable)
        .groupBy(*job_keys)
        .agg(F.sum("n").alias("job_runs"), F.coalesce(percentile_of("duration_s", 50), F.lit(0.0)).alias("job_median"))
        .filter(F.col("job_runs") >= MIN_RUNS)
    )
    by_median = Window.partitionBy(*job_keys).orderBy(F.col("median").desc(), "step")
    share = F.when(F.col("job_median") > 0, F.col("median") / F.col("job_median") * 100).otherwise(F.lit(0.0))
    return (
        per_step.join(per_job, job_keys)
        .withColumn("pct_of_job", share)
        .withColumn("volatility", F.when(F.col("median") > 0, F.col("p95") / F.col("median")).otherwise(F.lit(0.0)))
        .withColumn("step_rank", F.row_number().over(by_median))
        .filter(F.col("step_rank") <= top_n)
    )


def slowest_jobs(timing: DataFrame) -> DataFrame:
    """Step timing rows in report order: slowest job first, its steps by rank."""
    return timing.orderBy(F.col("job_median").desc(), "workflow_id", "job", "step_rank")
