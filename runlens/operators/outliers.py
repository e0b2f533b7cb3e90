"""Abnormally slow values, runs and jobs."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runlens.functions.grading import rank_severity, severity_of_order, severity_order
from runlens.operators.prep import with_workflow_name
from runlens.operators.quantiles import below_counts, histogram, percentiles_of_histogram

MIN_ROWS = 5


def _rank_of(hist: DataFrame, keys: list[str], value: str, limits: DataFrame, slow, bounded: bool) -> DataFrame:
    """Slow values of a histogram with the share of the key's rows that are smaller.

    Slow are all values above some limit, so the rows below one are those that are not slow and the slow ones
    below it: only slow values are ordered. ``limits`` have the key's number of rows as ``_rows``.
    """
    high = hist.join(limits, keys).filter(slow)
    share = (F.col("_rows") - F.col("total") + F.col("below")) / F.col("_rows") * 100
    return below_counts(high, keys, value, bounded).withColumn("rank", share).drop("n", "below", "total", "_rows")


def percentile_rank(df: DataFrame, keys: list[str], value: str, bounded: bool = True) -> DataFrame:
    """Adds ``rank``: the share, in percent, of the key's rows with a smaller value."""
    ranks = below_counts(histogram(df, keys, value), keys, value, bounded)
    share = F.col("below") / F.col("total") * 100
    return df.join(ranks.select(*keys, value, share.alias("rank")), [*keys, value])


def log_iqr_outliers(
    df: DataFrame, keys: list[str], value: str, k: float = 1.5, bounded: bool = True
) -> DataFrame:
    """Rows above the upper quartile fence of the logarithms, with ``fence`` and ``rank``."""
    v = F.col(value)
    hist = histogram(df, keys, value)
    logs = hist.filter(v > 0).withColumn("_log", F.log(v))
    limits = (
        percentiles_of_histogram(logs, keys, "_log", {"_q1": 25, "_q3": 75}, bounded)
        .filter(F.col("rows") >= MIN_ROWS)
        .withColumn("_limit", F.col("_q3") + k * (F.col("_q3") - F.col("_q1")))
        .join(hist.groupBy(*keys).agg(F.sum("n").alias("_rows")), keys)
        .select(*keys, "_rows", "_limit", F.exp("_limit").alias("fence"))
    )
    slow = _rank_of(hist, keys, value, limits, (v > 0) & (F.log(v) > F.col("_limit")), bounded).drop("_limit")
    return df.join(slow, [*keys, value])


def mad_outliers(
    df: DataFrame, keys: list[str], value: str, threshold: float = 3.5, bounded: bool = True
) -> DataFrame:
    """Rows whose distance above the median exceeds ``threshold`` scaled median deviations."""
    v = F.col(value)
    hist = histogram(df, keys, value)
    medians = percentiles_of_histogram(hist, keys, value, {"_median": 50}, bounded)
    medians = medians.filter(F.col("rows") >= MIN_ROWS).withColumnRenamed("rows", "_rows")
    distances = hist.join(medians, keys).withColumn("_distance", F.abs(v - F.col("_median")))
    spread = (
        percentiles_of_histogram(distances, keys, "_distance", {"_mad": 50}, bounded)
        .drop("rows")
        .join(medians, keys)
        .filter(F.col("_mad") > 0)
    )
    score = (v - F.col("_median")) / (1.4826 * F.col("_mad"))
    slow = _rank_of(hist, keys, value, spread, score > threshold, bounded)
    return df.join(slow.withColumn("score", score).drop("_median", "_mad"), [*keys, value])


def clamp_limits(hist: DataFrame, keys: list[str], value: str, k: float, bounded: bool = True) -> DataFrame:
    """``low`` and ``high`` per key, NULL where fewer than five rows or no spread forbid clamping, and a ``centre``."""
    q1, q3 = F.col("_q1"), F.col("_q3")
    usable = (F.col("rows") >= MIN_ROWS) & (q3 > q1)
    return percentiles_of_histogram(hist, keys, value, {"_q1": 25, "_q3": 75}, bounded).select(
        *keys,
        F.when(usable, q1 - k * (q3 - q1)).alias("low"),
        F.when(usable, q3 + k * (q3 - q1)).alias("high"),
        q1.alias("centre"),
    )


def clamp(v, low, high):
    return F.when(v > high, high).when(v < low, low).otherwise(v)


def clamp_outliers(df: DataFrame, keys: list[str], value: str, k: float = 4.0, bounded: bool = True) -> DataFrame:
    """Adds ``clamped``: the value limited to the quartile fences of its key."""
    limits = clamp_limits(histogram(df, keys, value), keys, value, k, bounded)
    return (
        df.join(limits, keys, "left")
        .withColumn("clamped", clamp(F.col(value), F.col("low"), F.col("high")))
        .drop("low", "high", "centre")
    )


def detect(df: DataFrame, keys: list[str], value: str, method: str = "log-iqr") -> DataFrame:
    if method == "mad":
        return mad_outliers(df, keys, value).drop("score")
    return log_iqr_outliers(df, keys, value).drop("fence")


def _reported(found: DataFrame, runs: DataFrame, min_rank: float) -> DataFrame:
    enough = runs.agg(F.count(F.lit(1)) >= MIN_ROWS).scalar()
    return found.filter((F.col("rank") >= min_rank) & enough).withColumn("severity", rank_severity(F.col("rank")))


def _timed_runs(runs: DataFrame, facts: DataFrame) -> DataFrame:
    """Runs of workflows with more than one job name, as rows of job ``''``."""
    names = facts.groupBy("workflow_id", "job").agg(F.first(F.lit(1)).alias("_one"))
    several = names.groupBy("workflow_id").agg(F.count(F.lit(1)).alias("_jobs")).filter("_jobs > 1")
    timed = runs.filter("duration_s > 0").join(several.select("workflow_id"), "workflow_id", "left_semi")
    return timed.select("workflow_id", F.lit(True).alias("_run"), F.lit("").alias("job"), "run_id", "head_sha", "duration_s")


def _timed_jobs(facts: DataFrame) -> DataFrame:
    return facts.filter("duration_s > 0").select("workflow_id", F.lit(False).alias("_run"), "job", "run_id", "head_sha", "duration_s")


_KEYS = ["workflow_id", "_run", "job"]


def run_outliers(runs: DataFrame, facts: DataFrame, method: str = "log-iqr", min_rank: float = 95.0) -> DataFrame:
    """Slow runs of workflows with more than one job name. ``runs`` carry ``duration_s``."""
    return _reported(detect(_timed_runs(runs, facts), _KEYS, "duration_s", method), runs, min_rank).drop("_run")


def job_outliers(runs: DataFrame, facts: DataFrame, method: str = "log-iqr", min_rank: float = 95.0) -> DataFrame:
    """Slow jobs per (workflow, job)."""
    return _reported(detect(_timed_jobs(facts), _KEYS, "duration_s", method), runs, min_rank).drop("_run")


COLUMNS = ["workflow_id", "job", "run_id", "head_sha", "duration_s", "rank", "severity"]


def all_outliers(runs: DataFrame, facts: DataFrame, workflows: DataFrame, method: str = "log-iqr",
                 min_rank: float = 95.0) -> DataFrame:
    """Run and job outliers with the workflow name; ``job`` is ``''`` for runs."""
    both = _timed_runs(runs, facts).unionByName(_timed_jobs(facts))
    both = _reported(detect(both, _KEYS, "duration_s", method), runs, min_rank).select(*COLUMNS)
    return with_workflow_name(both, workflows)


def group_outliers(outliers: DataFrame) -> DataFrame:
    """One row per (workflow, job): count, worst case and highest severity.

    A job whose group has the count and worst commit of its workflow's own group only repeats it and
    is left out.
    """
    worst = F.max_by(F.struct("duration_s", "rank", "head_sha"), F.struct("duration_s", -F.col("run_id")))
    groups = (
        outliers.groupBy("workflow", "job")
        .agg(F.count(F.lit(1)).alias("count"), worst.alias("_worst"), F.max(severity_order(F.col("severity"))).alias("_top"))
        .select(
            "workflow",
            "job",
            "count",
            F.col("_worst.duration_s").alias("worst_s"),
            F.col("_worst.rank").alias("worst_rank"),
            F.col("_worst.head_sha").alias("worst_sha"),
            severity_of_order(F.col("_top")).alias("severity"),
        )
    )
    of_workflow = groups.filter("job = ''").select(
        "workflow", F.col("count").alias("_count"), F.col("worst_sha").alias("_sha")
    )
    repeats = (F.col("job") != "") & (F.col("count") == F.col("_count")) & (F.col("worst_sha") == F.col("_sha"))
    return (
        groups.join(of_workflow, "workflow", "left")
        .filter(~F.coalesce(repeats, F.lit(False)))
        .drop("_count", "_sha")
    )
