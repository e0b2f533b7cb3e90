"""Declared schemas of the history tables. Nothing in this package infers a schema.

Missing text is ``''`` and a missing stamp is NULL.
"""

from pyspark.sql import types as T

RUNS = T.StructType([
    T.StructField("run_id", T.LongType()),
    T.StructField("node_id", T.StringType()),
    T.StructField("workflow_id", T.LongType()),
    T.StructField("workflow_name", T.StringType()),
    T.StructField("name", T.StringType()),
    T.StructField("event", T.StringType()),
    T.StructField("status", T.StringType()),
    T.StructField("conclusion", T.StringType()),
    T.StructField("head_branch", T.StringType()),
    T.StructField("head_sha", T.StringType()),
    T.StructField("run_attempt", T.IntegerType()),
    T.StructField("created_at", T.TimestampType()),
    T.StructField("started_at", T.TimestampType()),
    T.StructField("updated_at", T.TimestampType()),
    T.StructField("ingest_seq", T.LongType()),
])

JOBS = T.StructType([
    T.StructField("job_id", T.LongType()),
    T.StructField("run_id", T.LongType()),
    T.StructField("name", T.StringType()),
    T.StructField("status", T.StringType()),
    T.StructField("conclusion", T.StringType()),
    T.StructField("started_at", T.TimestampType()),
    T.StructField("completed_at", T.TimestampType()),
    T.StructField("runner_name", T.StringType()),
    T.StructField("runner_group_name", T.StringType()),
    T.StructField("labels", T.ArrayType(T.StringType())),
])

STEPS = T.StructType([
    T.StructField("job_id", T.LongType()),
    T.StructField("number", T.IntegerType()),
    T.StructField("name", T.StringType()),
    T.StructField("status", T.StringType()),
    T.StructField("conclusion", T.StringType()),
    T.StructField("started_at", T.TimestampType()),
    T.StructField("completed_at", T.TimestampType()),
])

WORKFLOWS = T.StructType([
    T.StructField("workflow_id", T.LongType()),
    T.StructField("name", T.StringType()),
    T.StructField("path", T.StringType()),
])

DIAGNOSTICS = T.StructType([
    T.StructField("severity", T.StringType()),
    T.StructField("kind", T.StringType()),
    T.StructField("scope", T.StringType()),
    T.StructField("message", T.StringType()),
])
