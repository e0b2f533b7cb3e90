"""Runner sizing: short jobs on large machines and long jobs on small ones."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runlens.functions.durations import compact_duration
from runlens.functions.grading import half_even
from runlens.functions.labels import core_count, labels_from_text, labels_to_text, multiplier
from runlens.operators.quantiles import histogram, percentile_of

# The thresholds and the two suggestion texts below.
MIN_RUNS = 5


def runner_sizing(facts: DataFrame, rates: dict[str, float] | None = None) -> DataFrame:
    """Over- and undersized (workflow, job, label set) combinations with a suggestion."""
    keys = ["workflow_id", "job", "runner_label"]
    labelled = facts.filter((F.col("duration_s") > 0) & (F.size("labels") > 0))
    cores, median = F.col("cores"), F.col("median")
    short = compact_duration(median, pad=False)
    return (
        histogram(labelled.withColumn("runner_label", labels_to_text(F.col("labels"))), keys, "duration_s")
        .groupBy(*keys)
        .agg(F.sum("n").alias("runs"), percentile_of("duration_s", 50).alias("median"))
        .withColumn("cores", core_count(F.col("runner_label")))
        .withColumn("multiplier", multiplier(labels_from_text(F.col("runner_label")), rates))
        .filter((F.col("runs") >= MIN_RUNS) & (cores > 0))
        .withColumn(
            "issue",
            F.when((cores >= 8) & (median < 120), "oversized").when((cores <= 4) & (median > 900), "undersized"),
        )
        .filter(F.col("issue").isNotNull())
        .withColumn(
            "suggestion",
            F.when(
                F.col("issue") == "oversized",
                F.format_string("job takes %s on %d cores — consider downsizing to save ~%sx cost",
                                short, cores, half_even(F.col("multiplier"))),
            ).otherwise(
                F.format_string("job takes %s on %d cores — consider larger runner to reduce wait", short, cores)
            ),
        )
    )


def by_issue(sizing: DataFrame) -> DataFrame:
    """Oversized first, larger machines first."""
    return sizing.orderBy("issue", F.col("cores").desc(), "workflow_id", "job")
