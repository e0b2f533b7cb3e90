"""Continuous-integration history derived from the ``orders`` and ``lineitem`` test tables.

One order is one run, its line items are the run's jobs. All derived stamps are whole seconds. The
columns and rules are listed in ``FIXTURES.md`` section 3.
"""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

LINES = range(1, 8)
JOB_NAMES = ["build", "test (ubuntu, 20)", "test (macos, 20)", "lint", "merge artifacts", "deploy", "checks / smoke"]
START_OFFSETS = [0, 0, 0, 10, 1000, 2000, 2005]
LABELS = [
    ["ubuntu-latest"],
    ["ubuntu-latest-8-cores"],
    ["macos-latest"],
    ["self-hosted", "linux"],
    [],
    ["ubuntu-latest"],
    ["linux-16vcpu"],
]


def _nth(values: list, line) -> Column:
    return F.element_at(F.array(*values), line)


def _later(stamp, seconds):
    return F.timestamp_add("SECOND", seconds.cast("int"), stamp)


def _orders(spark: SparkSession, folder: str) -> DataFrame:
    key, cust = F.col("o_orderkey"), F.col("o_custkey")
    outcome = cust % 20
    created = _later(F.col("o_orderdate"), key % 86400)
    return spark.read.parquet(f"{folder}/orders.parquet").select(
        key.alias("run_id"),
        F.substring("o_orderpriority", 1, 1).cast("bigint").alias("workflow_id"),
        F.col("o_orderpriority").alias("workflow_name"),
        F.when(key % 50 == 0, "in_progress").otherwise("completed").alias("status"),
        F.when(outcome < 16, "success")
        .when(outcome < 18, "failure")
        .when(outcome == 18, "cancelled")
        .otherwise("timed_out")
        .alias("conclusion"),
        F.when(cust % 4 == 0, "feature").otherwise("main").alias("head_branch"),
        F.md5(key.cast("string")).alias("head_sha"),
        (1 + cust % 3).cast("int").alias("run_attempt"),
        created.alias("created_at"),
        _later(created, key % 90).alias("started_at"),
        F.col("o_orderdate").alias("order_date"),
    )


def _lines(spark: SparkSession, folder: str) -> DataFrame:
    """One row per order with the largest quantity of each line: a single pre-aggregated shuffle."""
    quantity = F.col("l_quantity")
    known = F.col("l_linenumber").between(min(LINES), max(LINES))
    return (
        spark.read.parquet(f"{folder}/lineitem.parquet")
        .filter(F.when(known, True).otherwise(F.raise_error(F.lit("a line number has no job")).cast("boolean")))
        .groupBy(F.col("l_orderkey").alias("run_id"))
        .agg(*[F.max(F.when(F.col("l_linenumber") == n, quantity)).alias(f"q{n}") for n in LINES])
    )


def _job_seconds() -> Column:
    """Seconds of a job by its ``line`` and quantity ``q``, with outliers and level shifts."""
    line, workflow, day = F.col("line"), F.col("workflow_id"), F.col("order_date")
    seconds = (60 + 12 * F.col("q")) * F.when(F.col("run_id") % 97 == 0, 6).otherwise(1)
    factor = (
        F.when((line == 1) & (workflow == 2) & (day >= "2000-06-01"), 2.0)
        .when((line == 4) & (workflow == 3) & (day >= "1999-01-01"), 0.5)
        .when((line == 6) & (workflow == 1) & (day >= "1998-06-01"), 4.5)
        .when(line == 6, 3.0)
        .when(line == 7, 0.2)
        .otherwise(1.0)
    )
    return F.floor(seconds * factor).cast("int")


def _run_columns(updated) -> list:
    return [
        "run_id",
        F.lit("").alias("node_id"),
        "workflow_id",
        "workflow_name",
        F.concat(F.lit("run "), F.col("run_id")).alias("name"),
        F.lit("push").alias("event"),
        "status",
        "conclusion",
        "head_branch",
        "head_sha",
        "run_attempt",
        "created_at",
        "started_at",
        updated.alias("updated_at"),
        (F.col("run_id") * 4 + F.col("run_attempt")).alias("ingest_seq"),
    ]


def runs(spark: SparkSession, folder: str, with_updated: bool = False) -> DataFrame:
    """Latest attempt of every run. ``updated_at`` needs the jobs, so it is NULL unless asked for."""
    listed = _orders(spark, folder)
    if not with_updated:
        return listed.select(*_run_columns(F.lit(None).cast("timestamp_ntz")))
    last = jobs(spark, folder).groupBy("run_id").agg(F.max("completed_at").alias("last_end"))
    return listed.join(last, "run_id", "left").select(*_run_columns(_later(F.col("last_end"), F.lit(30))))


def attempts(spark: SparkSession, folder: str) -> DataFrame:
    """Every attempt as listed: runs with more than one attempt also have a failed first one."""
    latest = F.col("run_attempt")
    listed = _orders(spark, folder).withColumn(
        "attempt", F.explode(F.when(latest > 1, F.array(F.lit(1), latest)).otherwise(F.array(latest)))
    )
    return (
        listed.withColumn("conclusion", F.when(F.col("attempt") < latest, "failure").otherwise(F.col("conclusion")))
        .withColumn("run_attempt", F.col("attempt"))
        .select(*_run_columns(F.lit(None).cast("timestamp_ntz")))
    )


def jobs(spark: SparkSession, folder: str) -> DataFrame:
    wide = _orders(spark, folder).join(_lines(spark, folder), "run_id")
    last = F.greatest(*[F.when(F.col(f"q{n}").isNotNull(), n) for n in LINES])
    pairs = ", ".join(f"{n}, q{n}" for n in LINES)
    each = wide.select(
        "run_id", "workflow_id", "order_date", "conclusion", "started_at", last.alias("last"),
        F.expr(f"stack({len(LINES)}, {pairs}) as (line, q)"),
    ).filter("q is not null").withColumn("seconds", _job_seconds())
    line = F.col("line")
    labels = F.element_at(F.array(*[F.array(*map(F.lit, x)).cast("array<string>") for x in LABELS]), line)
    start = _later(F.col("started_at"), _nth([F.lit(x) for x in START_OFFSETS], line))
    return each.select(
        (F.col("run_id") * 8 + line).alias("job_id"),
        "run_id",
        _nth([F.lit(x) for x in JOB_NAMES], line).alias("name"),
        F.lit("completed").alias("status"),
        F.when(line == F.col("last"), F.col("conclusion")).otherwise("success").alias("conclusion"),
        start.alias("started_at"),
        _later(start, F.col("seconds")).alias("completed_at"),
        F.lit("").alias("runner_name"),
        F.lit("").alias("runner_group_name"),
        labels.alias("labels"),
    )


def _steps_of(job_start: Column, job_end: Column, conclusion: Column, run_id: Column) -> Column:
    """Three steps per job: 5 s checkout, 40 % of the rest building, the remainder testing."""
    total = F.unix_seconds(job_end.cast("timestamp")) - F.unix_seconds(job_start.cast("timestamp"))
    build = F.floor((total - 5) * 2 / 5)
    failed = conclusion == "failure"
    even = run_id % 2 == 0
    plan = [("Checkout", F.lit(0), F.lit(5), F.lit(False)),
            ("Build", F.lit(5), 5 + build, failed & even),
            ("Run tests", 5 + build, total, failed & ~even)]
    return F.array(*[
        F.struct(
            F.lit(number).alias("number"),
            F.lit(name).alias("name"),
            F.lit("completed").alias("status"),
            F.when(fails, "failure").otherwise("success").alias("conclusion"),
            _later(job_start, begin).alias("started_at"),
            _later(job_start, end).alias("completed_at"),
        )
        for number, (name, begin, end, fails) in enumerate(plan, 1)
    ])


def nested_jobs(spark: SparkSession, folder: str) -> DataFrame:
    """Jobs with their ``steps`` in the row, as listings have them. They lie by run, so nothing more is shuffled to group by it."""
    return _with_steps(jobs(spark, folder))


def _with_steps(of: DataFrame) -> DataFrame:
    return of.withColumn("steps", _steps_of(*map(F.col, ("started_at", "completed_at", "conclusion", "run_id"))))


def steps(spark: SparkSession, folder: str) -> DataFrame:
    return steps_of_jobs(jobs(spark, folder))


def steps_of_jobs(of: DataFrame, *more: str) -> DataFrame:
    """The steps of the given jobs, so that jobs written once need not be derived anew; ``more`` are columns of the job.

    Every job has steps. ``inline`` would have them derived once more, by a filter on empty arrays that Spark adds.
    """
    return _with_steps(of).select(*more, "job_id", F.inline_outer("steps"))


def workflows(spark: SparkSession, folder: str) -> DataFrame:
    """Dimension of the workflows seen, without the last one so that the fallback name is exercised."""
    seen = _orders(spark, folder).groupBy("workflow_id").agg(F.max("workflow_name").alias("name"))
    return seen.filter("workflow_id < 5").withColumn("path", F.concat(F.lit(".ci/"), F.col("workflow_id"), F.lit(".yml")))
