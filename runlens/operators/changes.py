"""Change points of job durations and what they mean."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runlens.functions.grading import shift_severity
from runlens.operators import shifts
from runlens.operators.prep import with_workflow_name
from runlens.session import stored

KEYS = ["workflow_id", "job"]
MIN_RUNS = 10
OSCILLATING_MIN = 3


def job_series(runs: DataFrame, facts: DataFrame) -> DataFrame:
    """Usable job durations to search for shifts, none when fewer than ten runs are given.

    Written once, as bounds for the order of a series are drawn from it before it is dealt out.
    """
    enough = runs.agg(F.count(F.lit(1)) >= MIN_RUNS).scalar()
    timed = facts.filter((F.col("duration_s") > 0) & enough)
    return stored(timed.select(*KEYS, "created_at", "run_id", "job_id", "duration_s"))


def change_points(runs: DataFrame, facts: DataFrame, workflows: DataFrame, **tuning) -> DataFrame:
    """Graded change points per (workflow, job) with the commit and date of the run at the change.

    They are few beside the runs. The evidence is written before runs are joined, so that its size is known and runs
    need not be shuffled for it, and the result as well, since categories read it several times.
    """
    series = job_series(runs, facts)
    found = shifts.shift_report(series, KEYS, "created_at", ["run_id", "job_id"], "duration_s", "run_id", **tuning)
    found = stored(found)
    commits = runs.select(F.col("run_id").alias("id"), "head_sha", "created_at")
    delta = F.abs(F.col("after_mean") - F.col("before_mean"))
    return stored(
        with_workflow_name(found.join(commits, "id"), workflows)
        .withColumn("severity", shift_severity(F.col("p_value"), F.col("pct_change"), delta))
        .withColumnRenamed("id", "run_id")
    )


def categorize(points: DataFrame, oscillating_min: int = OSCILLATING_MIN) -> DataFrame:
    """Adds ``category``. Jobs are told apart by name alone, as in the report.

    Counts per job are aggregated and joined back, so a job name shared by most series stays cheap.
    """
    notable = points.groupBy("job").agg(F.count_if(F.col("severity") != "info").alias("_notable"))
    graded = points.join(notable, "job").withColumn(
        "_first",
        F.when(F.col("severity") == "info", "minor")
        .when(F.col("_notable") >= oscillating_min, "oscillating")
        .when(F.col("overlap") > 0.5, "minor")
        .when(F.col("direction") == "speedup", "speedup")
        .otherwise("regression"),
    )
    lasting = (F.col("_first") == "regression") & (F.col("persistence") != "transient")
    when = F.struct("created_at", "workflow_id", "idx")
    latest = graded.filter(lasting).groupBy("job").agg(F.max(when).alias("_latest"))
    older = lasting & (when < F.col("_latest"))
    return (
        graded.join(latest, "job", "left")
        .withColumn("category", F.when(older, "minor").otherwise(F.col("_first")))
        .drop("_notable", "_first", "_latest")
    )


def oscillating_summary(points: DataFrame) -> DataFrame:
    """Per oscillating job: shifts, where it started, where it is now and the trend (10 % either way)."""
    when = F.struct("created_at", "workflow_id", "idx")
    was, now = F.col("was"), F.col("now")
    return (
        points.filter("category = 'oscillating'")
        .groupBy("job")
        .agg(
            F.count(F.lit(1)).alias("shifts"),
            F.min_by("before_mean", when).alias("was"),
            F.max_by("after_mean", when).alias("now"),
        )
        .withColumn(
            "trend",
            F.when(now > was + was / 10, "trending up").when(now < was - was / 10, "trending down").otherwise("stable"),
        )
    )
