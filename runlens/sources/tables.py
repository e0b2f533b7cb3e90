"""The stored history: writing, upserting, selecting and checking the runs, jobs and steps tables."""

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from runlens.functions.durations import micros
from runlens.operators.prep import is_completed
from runlens.schema import JOBS, RUNS, STEPS

TABLES = {"runs": RUNS, "jobs": JOBS, "steps": STEPS}
JOBS_PER_TASK = 1 << 17


def save_tables(runs: DataFrame, jobs: DataFrame, steps: DataFrame, path: str) -> None:
    """Writes the three tables; runs by workflow, so reading one workflow skips the others."""
    runs.write.mode("overwrite").partitionBy("workflow_id").parquet(f"{path}/runs")
    jobs.write.mode("overwrite").parquet(f"{path}/jobs")
    steps.write.mode("overwrite").parquet(f"{path}/steps")


def load_tables(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """Reads the tables with their declared schemas; columns an older writer lacked get defaults."""
    return {
        name: with_defaults(spark.read.schema(schema).parquet(f"{path}/{name}"), schema)
        for name, schema in TABLES.items()
    }


def with_defaults(df: DataFrame, schema: T.StructType) -> DataFrame:
    """``df`` in the columns of ``schema``: missing or NULL text is ``''``, missing lists are empty."""
    columns = []
    for f in schema.fields:
        value = F.col(f.name) if f.name in df.columns else F.lit(None).cast(f.dataType)
        if isinstance(f.dataType, T.StringType):
            value = F.coalesce(value, F.lit(""))
        elif isinstance(f.dataType, T.ArrayType):
            value = F.coalesce(value, F.array().cast(f.dataType))
        columns.append(value.alias(f.name))
    return df.select(*columns)


def by_run(jobs: DataFrame, tasks: int | None = None) -> DataFrame:
    """Jobs dealt out by run, ``JOBS_PER_TASK`` to a task whatever the session's number of partitions.

    What sorts or groups them or their steps by run takes no more memory for a longer history.
    """
    return jobs.repartition(tasks or _tasks(jobs), "run_id")


def _tasks(*jobs: DataFrame) -> int:
    return -(-max(1, *[df.count() for df in jobs]) // JOBS_PER_TASK)


def upsert_runs(
    existing: tuple[DataFrame, DataFrame, DataFrame], incoming: tuple[DataFrame, DataFrame, DataFrame]
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Runs, jobs and steps after saving ``incoming``: a re-saved run replaces its row and all its children.

    Jobs are counted first: joins by key sort both sides, so they get a task for each ``JOBS_PER_TASK`` jobs or their steps.
    """
    runs, jobs, steps = existing
    new_runs, new_jobs, new_steps = incoming
    tasks = _tasks(jobs, new_jobs)
    ids, new_ids = new_runs.select("run_id"), new_jobs.select("job_id")
    of_runs = by_run(jobs, tasks)
    kept_jobs = of_runs.join(ids, "run_id", "left_anti")
    # A step goes with its job, and with any job of the same id saved anew.
    gone = of_runs.join(ids, "run_id", "left_semi").select("job_id").unionByName(new_ids)
    return (
        runs.join(ids, "run_id", "left_anti").unionByName(new_runs),
        kept_jobs.repartition(tasks, "job_id").join(new_ids, "job_id", "left_anti").unionByName(new_jobs),
        steps.repartition(tasks, "job_id").join(gone, "job_id", "left_anti").unionByName(new_steps),
    )


def runs_since(runs: DataFrame, workflow_id: int, start: dt.datetime) -> DataFrame:
    """Completed runs of a workflow created at or after ``start``, in that order."""
    wanted = (F.col("workflow_id") == workflow_id) & (F.col("created_at") >= F.lit(start)) & is_completed()
    return runs.filter(wanted).orderBy("created_at", "run_id")


def incomplete_ids(runs: DataFrame) -> DataFrame:
    return runs.filter(~is_completed()).select("run_id")


def run_details(runs: DataFrame, jobs: DataFrame, steps: DataFrame) -> DataFrame:
    """Runs with their jobs by start and those with their steps by number, nested.

    Nesting needs a run in one row. The service limits the jobs of a run and the steps of a job, so a row
    stays small however long the history is. Both tables are grouped by run alone, so nothing more is shuffled where they
    lie by run (:func:`by_run`) and steps carry their ``run_id``.
    """
    if "run_id" not in steps.columns:
        steps = steps.join(jobs.select("job_id", "run_id").distinct(), "job_id")
    step = F.struct(*["number", *[c for c in steps.columns if c not in ("number", "job_id", "run_id")]])
    steps_of_run = steps.groupBy("run_id").agg(F.collect_list(F.struct("job_id", step.alias("step"))).alias("_steps"))
    job = F.struct(F.col("started_at").alias("_order"), "job_id", *[c for c in jobs.columns if c not in ("job_id", "run_id")])
    jobs_of_run = jobs.groupBy("run_id").agg(F.array_sort(F.collect_list(job)).alias("jobs"))

    def with_steps(j):
        own = F.filter("_steps", lambda x: x["job_id"] == j["job_id"])
        found = F.exists("_steps", lambda x: x["job_id"] == j["job_id"])
        return j.dropFields("_order").withField("steps", F.when(found, F.array_sort(F.transform(own, lambda x: x["step"]))))

    return (
        runs.join(jobs_of_run, "run_id", "left").join(steps_of_run, "run_id", "left")
        .withColumn("jobs", F.transform("jobs", with_steps)).drop("_steps")
    )


def split_cached(listed: DataFrame, stored: DataFrame) -> DataFrame:
    """Adds ``cached`` to listed runs: stored and completed ones need not be loaded again."""
    done = stored.filter(is_completed()).select("run_id").distinct().withColumn("_stored", F.lit(True))
    return listed.join(done, "run_id", "left").withColumn("cached", F.coalesce("_stored", F.lit(False))).drop("_stored")


def cache_counts(split: DataFrame) -> DataFrame:
    return split.agg(F.count(F.lit(1)).alias("total"), F.count_if(~F.col("cached")).alias("uncached"))


def orphans(child: DataFrame, parent: DataFrame, key: str) -> DataFrame:
    """Rows of ``child`` whose ``key`` is not in ``parent``."""
    return child.join(parent.select(key), key, "left_anti")


def slice_audit(runs: DataFrame, since: dt.datetime, until: dt.datetime, days: int = 7, cap: int = 1000) -> DataFrame:
    """Runs per workflow and slice of ``days`` between two moments; ``truncated`` where a listing caps out.

    Slices without runs are listed too.
    """
    width = F.lit(days * 86_400_000_000)
    begin, end = micros(F.lit(since)), micros(F.lit(until))
    inside = runs.filter((F.col("created_at") >= F.lit(since)) & (F.col("created_at") < F.lit(until)))
    number = F.floor((micros(F.col("created_at")) - begin) / width)
    counted = inside.groupBy("workflow_id", number.alias("slice")).agg(F.count(F.lit(1)).alias("runs"))
    last = F.ceil((end - begin) / width) - 1
    # Per workflow one row per slice of the period.
    frame = inside.groupBy("workflow_id").agg(F.first(F.lit(1)).alias("_one")).select(
        "workflow_id", F.explode(F.sequence(F.lit(0).cast("bigint"), last)).alias("slice")
    )
    return (
        frame.join(counted, ["workflow_id", "slice"], "left")
        .fillna(0, ["runs"])
        .withColumn("truncated", F.col("runs") > cap)
    )


def write_result(result: dict[str, DataFrame], path: str) -> None:
    """JSON files of the findings, meta and diagnostics of an analysis."""
    for name in ("findings", "diagnostics", "meta"):
        result[name].write.mode("overwrite").json(f"{path}/{name}")
