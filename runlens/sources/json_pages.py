"""Recorded listing pages and batched responses of the hosting service as history tables."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from runlens.functions.durations import parse_stamp
from runlens.schema import DIAGNOSTICS, JOBS, RUNS, STEPS, WORKFLOWS
from runlens.sources.tables import with_defaults

WORKFLOW_PAGE = "total_count bigint, workflows array<struct<id:bigint,name:string,path:string,state:string>>"
RUN_PAGE = (
    "total_count bigint, workflow_runs array<struct<id:bigint,node_id:string,name:string,display_title:string,"
    "workflow_id:bigint,event:string,status:string,conclusion:string,head_branch:string,head_sha:string,"
    "run_attempt:int,created_at:string,run_started_at:string,updated_at:string>>"
)
JOB_PAGE = (
    "total_count bigint, jobs array<struct<id:bigint,run_id:bigint,name:string,status:string,conclusion:string,"
    "started_at:string,completed_at:string,runner_name:string,runner_group_name:string,labels:array<string>,"
    "steps:array<struct<name:string,number:int,status:string,conclusion:string,started_at:string,"
    "completed_at:string>>>>"
)
NODE = (
    "databaseId bigint, checkSuite struct<checkRuns:struct<nodes:array<struct<name:string,"
    "databaseId:bigint,startedAt:string,completedAt:string,status:string,conclusion:string,"
    "steps:struct<nodes:array<struct<name:string,number:int,startedAt:string,completedAt:string,status:string,"
    "conclusion:string>>>>>>>, _bad string"
)


def _pages(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("multiLine", True).json(path)


def _strict(name: str):
    return parse_stamp(F.col(name), strict=True)


def runs_of_pages(pages: DataFrame) -> DataFrame:
    run = pages.select(F.explode("workflow_runs").alias("r")).select("r.*")
    listed = run.select(
        F.col("id").alias("run_id"), "node_id", "workflow_id", F.col("name").alias("workflow_name"),
        F.col("display_title").alias("name"), "event", "status", "conclusion", "head_branch", "head_sha", "run_attempt",
        _strict("created_at").alias("created_at"), _strict("run_started_at").alias("started_at"),
        _strict("updated_at").alias("updated_at"),
        # Listings repeat a run only with a later attempt, so the attempt itself orders arrivals.
        F.col("run_attempt").cast("bigint").alias("ingest_seq"),
    )
    return with_defaults(listed, RUNS)


def read_runs(spark: SparkSession, path: str) -> DataFrame:
    """Runs of run-listing pages."""
    return runs_of_pages(_pages(spark, path, RUN_PAGE))


def jobs_of_pages(pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    job = pages.select(F.explode("jobs").alias("j")).select("j.*")
    jobs = job.select(
        F.col("id").alias("job_id"), "run_id", "name", "status", "conclusion", _strict("started_at").alias("started_at"),
        _strict("completed_at").alias("completed_at"), "runner_name", "runner_group_name", "labels",
    )
    step = job.select(F.col("id").alias("job_id"), F.explode("steps").alias("s")).select("job_id", "s.*")
    steps = step.select(
        "job_id", "number", "name", "status", "conclusion", _strict("started_at").alias("started_at"),
        _strict("completed_at").alias("completed_at"),
    )
    return with_defaults(jobs, JOBS), with_defaults(steps, STEPS)


def read_jobs(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Jobs and steps of job-listing pages."""
    return jobs_of_pages(_pages(spark, path, JOB_PAGE))


def workflows_of_pages(pages: DataFrame) -> DataFrame:
    flow = pages.select(F.explode("workflows").alias("w"))
    return with_defaults(flow.select(F.col("w.id").alias("workflow_id"), "w.name", "w.path"), WORKFLOWS)


def read_workflows(spark: SparkSession, path: str) -> DataFrame:
    """Workflows of workflow-listing pages."""
    return workflows_of_pages(_pages(spark, path, WORKFLOW_PAGE))


def decode_batch(df: DataFrame, json_col: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Jobs, steps and diagnostics of batched responses, one JSON object ``{r0: …, r1: …}`` per row.

    ``df`` also has ``run_ids``, the runs asked for in order: ``rN`` answers the N-th. Bad stamps count as
    missing here, and runner labels are not part of these responses. Each node is parsed on its own: one that
    does not fit costs a diagnostic and nothing else.
    """
    node = (
        df.select("run_ids", F.explode(F.from_json(json_col, "map<string,string>")).alias("alias", "_text"))
        .filter(F.col("alias").rlike("^r[0-9]{1,8}$"))
        .withColumn("place", F.substring("alias", 2, 8).cast("int"))
        .withColumn("run_id", F.try_element_at("run_ids", F.col("place") + 1))
        .filter(F.col("run_id").isNotNull())
        .select("run_id", F.from_json("_text", NODE, {"columnNameOfCorruptRecord": "_bad"}).alias("node"))
    )
    fits = F.col("node._bad").isNull() & F.col("node.checkSuite").isNotNull()
    broken, node = node.filter(~fits), node.filter(fits)
    suite = F.col("node.checkSuite")
    diagnostics = broken.select(
        F.lit("warn").alias("severity"),
        F.lit("network").alias("kind"),
        F.format_string("run-%d", "run_id").alias("scope"),
        F.format_string("run %d: failed to parse batch response", "run_id").alias("message"),
    )
    check = node.select("run_id", F.explode(suite["checkRuns"]["nodes"]).alias("c"))

    def lowered(column):
        return F.coalesce(F.lower(column), F.lit(""))

    def stamp(column):
        return parse_stamp(column, strict=False)

    jobs = check.select(
        F.col("c.databaseId").alias("job_id"), "run_id", "c.name", lowered(F.col("c.status")).alias("status"),
        lowered(F.col("c.conclusion")).alias("conclusion"), stamp(F.col("c.startedAt")).alias("started_at"),
        stamp(F.col("c.completedAt")).alias("completed_at"),
    )
    step = check.select(F.col("c.databaseId").alias("job_id"), F.explode("c.steps.nodes").alias("s"))
    steps = step.select(
        "job_id", "s.number", "s.name", lowered(F.col("s.status")).alias("status"),
        lowered(F.col("s.conclusion")).alias("conclusion"), stamp(F.col("s.startedAt")).alias("started_at"),
        stamp(F.col("s.completedAt")).alias("completed_at"),
    )
    return with_defaults(jobs, JOBS), with_defaults(steps, STEPS), diagnostics.to(DIAGNOSTICS)
