"""Billing minutes and what is worth optimising first."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from runlens.functions.durations import seconds_between
from runlens.functions.labels import billable_minutes, is_self_hosted, labels_from_text, labels_to_text, multiplier, multipliers
from runlens.operators.quantiles import histogram, percentile_of

MIN_RUNS = 5
KEYS = ["workflow_id", "job"]


def job_costs(facts: DataFrame, rates: DataFrame | dict[str, float] | None = None) -> DataFrame:
    """Minutes, rate and runs per (workflow, job).

    The labels of the earliest run decide the rate of the whole key; label sets first seen at the same
    moment are taken in text order. Rows shrink to one per label set before that choice is made. ``rates`` is
    a table ``(label, rate)`` or a short mapping.
    """
    per_labels = facts.groupBy(*KEYS, labels_to_text(F.col("labels")).alias("labels")).agg(
        F.min("created_at").alias("first_seen"),
        F.sum(billable_minutes(F.col("duration_s"))).alias("minutes"),
        F.count(F.lit(1)).alias("runs"),
    )
    labels = labels_from_text(F.col("labels"))
    per_job = per_labels.groupBy(*KEYS).agg(
        F.min_by("labels", F.struct("first_seen", "labels")).alias("labels"),
        F.sum("minutes").alias("minutes"),
        F.sum("runs").alias("runs"),
    )
    rated = multipliers(per_job, rates) if isinstance(rates, DataFrame) else per_job.withColumn("multiplier", multiplier(labels, rates))
    return (
        rated.withColumn("self_hosted", is_self_hosted(labels))
        .select(
            *KEYS,
            "labels",
            "multiplier",
            "self_hosted",
            "runs",
            F.when(F.col("self_hosted"), 0.0).otherwise(F.col("minutes") * F.col("multiplier")).alias("billable"),
            F.when(F.col("self_hosted"), F.col("minutes")).otherwise(0.0).alias("self_hosted_minutes"),
        )
    )


def run_billing(facts: DataFrame, costs: DataFrame) -> DataFrame:
    """Billed minutes per run, at the rate of each job's key; runs that cost nothing drop out."""
    rates = costs.filter(~F.col("self_hosted")).select(*KEYS, "multiplier")
    return (
        facts.join(rates, KEYS)
        .groupBy("workflow_id", "run_id")
        .agg(F.sum(billable_minutes(F.col("duration_s")) * F.col("multiplier")).alias("billable"))
        .filter("billable > 0")
    )


def workflow_costs(runs: DataFrame, facts: DataFrame, rates: DataFrame | dict[str, float] | None = None) -> DataFrame:
    """Cost per workflow with its daily rate, priority score and the saving of typical over cheap runs."""
    costs = job_costs(facts, rates)
    span = runs.agg(seconds_between(F.min("created_at"), F.max("created_at")).alias("s"))
    days = span.select(F.greatest(F.col("s") / 86400, F.lit(1.0))).scalar()
    totals = costs.groupBy("workflow_id").agg(
        F.sum("billable").alias("billable_minutes"), F.sum("self_hosted_minutes").alias("self_hosted_minutes")
    )
    typical = (
        histogram(run_billing(facts, costs), ["workflow_id"], "billable")
        .groupBy("workflow_id")
        .agg(F.sum("n").alias("billed_runs"), percentile_of("billable", [25, 50, 95]).alias("_p"))
    )
    counts = runs.groupBy("workflow_id").agg(F.count(F.lit(1)).alias("total_runs"))
    enough = (F.col("billed_runs") >= MIN_RUNS) & (F.col("_p")[1] > 0)
    return (
        counts.join(totals, "workflow_id", "left")
        .join(typical, "workflow_id", "left")
        .withColumn("_days", days)
        .fillna(0.0, ["billable_minutes", "self_hosted_minutes"])
        .withColumn("daily_rate", F.col("billable_minutes") / F.col("_days"))
        .withColumn(
            "priority_score",
            F.when(enough, F.col("daily_rate") * (F.col("_p")[2] / F.col("_p")[1])).otherwise(0.0),
        )
        .withColumn(
            "daily_savings",
            F.when(enough, (F.col("_p")[1] - F.col("_p")[0]) * (F.col("total_runs") / F.col("_days"))).otherwise(0.0),
        )
        .select("workflow_id", "total_runs", "billable_minutes", "self_hosted_minutes", "daily_rate",
                "priority_score", "daily_savings")
    )


def by_priority(costs: DataFrame) -> DataFrame:
    return costs.orderBy(F.col("priority_score").desc(), "workflow_id")


def rank_jobs(costs: DataFrame, top_n: int | None = None) -> DataFrame:
    """Jobs of each workflow by minutes, most first; with ``top_n`` only that many."""
    minutes = F.col("billable") + F.col("self_hosted_minutes")
    order = Window.partitionBy("workflow_id").orderBy(F.col("minutes").desc(), "job")
    ranked = costs.withColumn("minutes", minutes).withColumn("job_rank", F.row_number().over(order))
    return ranked if top_n is None else ranked.filter(F.col("job_rank") <= top_n)
