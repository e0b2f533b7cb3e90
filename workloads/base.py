"""Shared inputs of the registered queries and the same derivation as SQL.

``HISTORY`` holds common table expressions; every check query starts with ``WITH`` and these.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from runlens.operators import prep, summary
from runlens.sources import sample_history as history

HISTORY = """
listed AS (
  SELECT o_orderkey AS run_id, CAST(substr(o_orderpriority, 1, 1) AS BIGINT) AS workflow_id,
    o_orderpriority AS workflow_name,
    CASE WHEN o_orderkey % 50 = 0 THEN 'in_progress' ELSE 'completed' END AS status,
    CASE WHEN o_custkey % 20 < 16 THEN 'success' WHEN o_custkey % 20 < 18 THEN 'failure'
         WHEN o_custkey % 20 = 18 THEN 'cancelled' ELSE 'timed_out' END AS conclusion,
    CASE WHEN o_custkey % 4 = 0 THEN 'feature' ELSE 'main' END AS head_branch,
    md5(CAST(o_orderkey AS VARCHAR)) AS head_sha,
    CAST(1 + o_custkey % 3 AS INTEGER) AS run_attempt,
    o_orderdate + to_seconds(o_orderkey % 86400) AS created_at,
    o_orderdate + to_seconds(o_orderkey % 86400 + o_orderkey % 90) AS started_at,
    o_orderdate AS order_date
  FROM orders),
attempts AS (
  SELECT run_id, workflow_id, workflow_name, conclusion, head_branch, run_attempt, created_at FROM listed
  UNION ALL
  SELECT run_id, workflow_id, workflow_name, 'failure', head_branch, 1, created_at FROM listed WHERE run_attempt > 1),
job_lines AS (
  SELECT l_orderkey AS run_id, l_linenumber AS line, 60 + 12 * max(l_quantity) AS base
  FROM lineitem GROUP BY l_orderkey, l_linenumber),
job_times AS (
  SELECT r.*, j.line, max(j.line) OVER (PARTITION BY r.run_id) AS last_line,
    CASE WHEN r.run_id % 97 = 0 THEN base * 6 ELSE base END AS s
  FROM job_lines j JOIN listed r ON r.run_id = j.run_id),
job_seconds AS (
  SELECT *, CAST(CASE
    WHEN line = 1 AND workflow_id = 2 AND order_date >= TIMESTAMP '2000-06-01' THEN s * 2
    WHEN line = 4 AND workflow_id = 3 AND order_date >= TIMESTAMP '1999-01-01' THEN floor(s / 2)
    WHEN line = 6 AND workflow_id = 1 AND order_date >= TIMESTAMP '1998-06-01' THEN floor(s * 9 / 2)
    WHEN line = 6 THEN s * 3
    WHEN line = 7 THEN floor(s / 5)
    ELSE s END AS BIGINT) AS seconds,
    CASE line WHEN 4 THEN 10 WHEN 5 THEN 1000 WHEN 6 THEN 2000 WHEN 7 THEN 2005 ELSE 0 END AS begin_offset
  FROM job_times),
jobs AS (
  SELECT run_id * 8 + line AS job_id, run_id, workflow_id, created_at AS run_created, head_sha,
    CASE line WHEN 1 THEN 'build' WHEN 2 THEN 'test (ubuntu, 20)' WHEN 3 THEN 'test (macos, 20)' WHEN 4 THEN 'lint'
      WHEN 5 THEN 'merge artifacts' WHEN 6 THEN 'deploy' ELSE 'checks / smoke' END AS job,
    CASE line WHEN 1 THEN 'ubuntu-latest' WHEN 2 THEN 'ubuntu-latest-8-cores' WHEN 3 THEN 'macos-latest'
      WHEN 4 THEN 'self-hosted,linux' WHEN 5 THEN '' WHEN 6 THEN 'ubuntu-latest' ELSE 'linux-16vcpu' END AS labels,
    CASE WHEN line = last_line THEN conclusion ELSE 'success' END AS conclusion,
    conclusion AS run_conclusion,
    started_at AS run_started,
    started_at + to_seconds(begin_offset) AS started_at,
    started_at + to_seconds(begin_offset + seconds) AS completed_at,
    CAST(seconds AS DOUBLE) AS dur
  FROM job_seconds),
steps AS (
  SELECT job_id, workflow_id, job, run_conclusion, n AS number,
    CASE n WHEN 1 THEN 'Checkout' WHEN 2 THEN 'Build' ELSE 'Run tests' END AS step,
    CASE WHEN conclusion = 'failure' AND n = CASE WHEN run_id % 2 = 0 THEN 2 ELSE 3 END THEN 'failure'
         ELSE 'success' END AS conclusion,
    conclusion AS job_conclusion,
    CASE n WHEN 1 THEN 5e0 WHEN 2 THEN floor((dur - 5) * 2 / 5) ELSE dur - 5 - floor((dur - 5) * 2 / 5) END AS dur
  FROM jobs, (SELECT unnest([1, 2, 3]) AS n)),
names AS (SELECT workflow_id, max(workflow_name) AS name FROM listed WHERE workflow_id < 5 GROUP BY workflow_id),
ok AS (SELECT * FROM listed WHERE conclusion = 'success'),
ok_jobs AS (SELECT * FROM jobs WHERE run_conclusion = 'success'),
last_ends AS (SELECT run_id, max(completed_at) AS last_end FROM jobs GROUP BY run_id),
ok_runs AS (
  SELECT o.*, coalesce(CAST(epoch(last_end) - epoch(started_at) AS DOUBLE), 0e0) AS dur
  FROM ok o LEFT JOIN last_ends USING (run_id))
"""


def sql(body: str) -> str:
    """A check query: ``body`` continues the shared expressions, starting with ``, more AS`` or ``SELECT``."""
    return f"WITH RECURSIVE {HISTORY.strip()}\n{body.strip()}"


def r4(column, name: str):
    column = F.col(column) if isinstance(column, str) else column
    return F.round(column, 4).alias(name)


def stamp(column: str, name: str | None = None):
    return F.date_format(column, "yyyy-MM-dd HH:mm:ss").alias(name or column)


def ok_runs(spark: SparkSession, d: str) -> DataFrame:
    return prep.exclude_failures(history.runs(spark, d))


def facts(spark: SparkSession, d: str) -> DataFrame:
    return summary.job_facts(ok_runs(spark, d), history.jobs(spark, d))


def timed_runs(spark: SparkSession, d: str) -> DataFrame:
    """Successful runs with their duration."""
    return prep.run_durations(ok_runs(spark, d), history.jobs(spark, d))


def events(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/events.parquet").select("event_id", "ts", "event_type", "value")
