"""The queries behind the text reports. They take the typed results of the operators.

A limit here is the report's own (its top three, its five slowest jobs), taken from a total order. Texts and
thresholds in this module are fixed values.
"""

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runlens.functions.durations import compact_duration, short_sha
from runlens.functions.grading import half_even
from runlens.operators.cost import by_priority, rank_jobs
from runlens.operators.failures import by_failure_rate


def triage_top_time(summary: DataFrame) -> DataFrame:
    """Three workflows with most total time."""
    return summary.orderBy(F.col("total").desc(), "workflow_id").limit(3)


def triage_unpredictable(summary: DataFrame) -> DataFrame:
    return summary.filter(F.col("label").isin("volatile", "spiky"))


def active_regressions(points: DataFrame) -> DataFrame:
    return points.filter("category = 'regression' and direction = 'slowdown'")


def triage_regressions(points: DataFrame) -> DataFrame:
    """First five active regressions by date; ``more`` counts the rest."""
    active = active_regressions(points)
    rest = active.agg(F.greatest(F.count(F.lit(1)) - 5, F.lit(0))).scalar()
    return active.orderBy("created_at", "workflow_id", "job", "idx").limit(5).withColumn("more", rest)


def triage_flaky(report: DataFrame) -> DataFrame:
    return by_failure_rate(report).limit(3)


def summary_split(summary: DataFrame) -> DataFrame:
    """Adds ``layout``: workflows with several jobs and more than two runs are shown with their jobs."""
    several = (F.size("jobs") > 1) & (F.col("count") > 2)
    return summary.withColumn("layout", F.when(several, "multi").otherwise("single"))


def cost_top(costs: DataFrame, job_costs: DataFrame) -> DataFrame:
    """Five workflows by priority with the three jobs each that use most minutes."""
    top = by_priority(costs).limit(5).select("workflow_id", "priority_score", "daily_rate", "billable_minutes")
    return top.join(rank_jobs(job_costs, 3).select("workflow_id", "job", "job_rank", "minutes", "multiplier"), "workflow_id")


def failing_headline(report: DataFrame) -> DataFrame:
    """Where a workflow fails: ``cause`` as the board tells it, ``headline`` as the compact report does."""
    steps = F.col("failing_steps")
    first, second = F.try_element_at(steps, F.lit(1)), F.try_element_at(steps, F.lit(2))
    share = F.when(F.col("failures") > 0, first["count"] / F.col("failures"))
    single = F.size(steps) == 1
    quote = lambda x: F.concat(F.lit('"'), x, F.lit('"'))
    one = F.concat(
        F.lit(" -- fails at step "), quote(first["step_name"]),
        F.when(first["job_name"] != "", F.concat(F.lit(" in job "), quote(first["job_name"]))).otherwise(""),
        F.format_string(" (%d/%d failures)", first["count"], "failures"),
    )
    many = F.format_string(
        " -- failures spread across %d steps (top: %s %dx, %s %dx)", F.size(steps), quote(first["step_name"]),
        first["count"], quote(second["step_name"]), second["count"],
    )
    none = F.coalesce(F.size(steps), F.lit(0)) <= 0
    return report.withColumn(
        "cause",
        F.when(none, "").when((share >= 0.6) | single, F.concat(F.lit("fails at: "), first["step_name"]))
        .otherwise(F.format_string("failures across %d steps (top: %s)", F.size(steps), first["step_name"])),
    ).withColumn(
        "headline", F.when(none, "").when(single | (first["count"] > F.col("failures") * 0.6), one).otherwise(many)
    )


def category_shares(report: DataFrame) -> DataFrame:
    """Shares of the failure categories, 5 % and up, where at least two of them remain."""
    entries = F.map_entries("by_category")
    total = F.aggregate(entries, F.lit(0).cast("bigint"), lambda a, e: a + e["value"])
    shares = F.filter(
        F.transform(entries, lambda e: F.struct((-e["value"]).alias("order"), e["key"].alias("category"),
                                                (e["value"] / F.col("_total") * 100).alias("pct"))),
        lambda e: e["pct"] >= 5,
    )
    listed = report.withColumn("_total", total).withColumn("_shares", F.array_sort(shares)).filter(F.size("_shares") >= 2)
    return listed.select("workflow_id", F.posexplode("_shares").alias("_i", "_s")).select(
        "workflow_id", (F.col("_i") + 1).alias("place"), "_s.category", "_s.pct"
    )


def volatile_steps(timing: DataFrame) -> DataFrame:
    """Most volatile step per job name, from twice the median on."""
    order = F.struct("volatility", "step")
    return timing.filter("volatility >= 2").groupBy("job").agg(
        F.max_by("step", order).alias("step"), F.max("volatility").alias("volatility")
    )


def suggestions(
    points: DataFrame, costs: DataFrame, groups: DataFrame, report: DataFrame, timing: DataFrame
) -> DataFrame:
    """Questions worth asking, in report order by ``section``. Frames carry the ``workflow`` name."""
    commits = active_regressions(points).select(
        F.lit(1).alias("section"),
        F.format_string('What changed in commit `%s` (%s) that affected "%s"?', short_sha(F.col("head_sha")),
                        F.date_format("created_at", "yyyy-MM-dd"), "job").alias("text"),
    )
    expensive = costs.filter("priority_score >= 50").select(
        F.lit(2).alias("section"),
        F.format_string(
            '"%s" is a high-cost workflow (%s mins/day) -- check for flaky tests, cache misses, or resource contention',
            "workflow", half_even(F.col("daily_rate"))).alias("text"),
    )
    causes = volatile_steps(timing).select("job", F.col("step").alias("_step"), F.col("volatility").alias("_v"))
    hint = F.when(F.col("_step").isNull(), "check for resource contention or flaky infrastructure").otherwise(
        F.format_string('step "%s" is %sx volatile and likely the cause', "_step", half_even(F.col("_v"), 1))
    )
    slow = (
        groups.filter(F.col("count") >= 5)
        .join(causes, "job", "left")
        .select(
            F.lit(3).alias("section"),
            F.format_string('"%s" has %d outliers (worst %s) -- %s',
                            F.when(F.col("job") != "", F.col("job")).otherwise(F.col("workflow")), "count",
                            compact_duration(F.col("worst_s")), hint).alias("text"),
        )
    )
    ordered = F.array_sort(
        F.transform(F.map_entries("by_conclusion"), lambda e: F.struct((-e["value"]).alias("n"), e["key"].alias("key")))
    )
    mostly = F.try_element_at(ordered, F.lit(1))["key"]
    why = (
        F.when(mostly == "cancelled", " (mostly cancelled -- check for timeout issues or manual cancellations)")
        .when(mostly == "timed_out", " (timed out -- likely hanging test or resource exhaustion)")
        .otherwise("")
    )
    failing = report.filter("failure_rate >= 0.1").select(
        F.lit(4).alias("section"),
        F.format_string('"%s" has %s%% failure rate%s', "workflow", half_even(F.col("failure_rate") * 100), why).alias("text"),
    )
    return reduce(DataFrame.unionByName, [commits, expensive, slow, failing])


def notable_changes(points: DataFrame) -> DataFrame:
    return points.filter("severity <> 'info'")


def outlier_board(groups: DataFrame) -> DataFrame:
    return groups.orderBy(F.col("worst_s").desc(), "workflow", "job")


def changes_by_bucket(points: DataFrame) -> DataFrame:
    """Adds ``bucket``: actionable, oscillating or minor."""
    bucket = F.when(F.col("category").isin("oscillating", "minor"), F.col("category")).otherwise("actionable")
    return points.withColumn("bucket", bucket)


def queue_notable(summary: DataFrame) -> DataFrame:
    """Workflows that typically wait more than five seconds."""
    return summary.filter("queue_median > 5").withColumn("queue", compact_duration(F.col("queue_median")))


def step_board(timing: DataFrame, jobs: int = 5) -> DataFrame:
    """Steps of the slowest jobs, with ``tag`` such as ``2.5x`` on volatile ones."""
    keys = ["workflow_id", "job"]
    slowest = (
        timing.select(*keys, "job_median").distinct().orderBy(F.col("job_median").desc(), *keys).limit(jobs).select(*keys)
    )
    tag = F.when(F.col("volatility") >= 2, F.format_string("%sx", half_even(F.col("volatility"), 1))).otherwise("")
    return timing.join(slowest, keys, "left_semi").withColumn("tag", tag)


def failure_board(report: DataFrame) -> DataFrame:
    """Seven least reliable workflows with their conclusions and retries as text."""
    parts = F.transform(
        F.array_sort(F.map_entries("by_conclusion")), lambda e: F.format_string("%s: %d", e["key"], e["value"])
    )
    retried = F.when(
        F.col("retried_runs") > 0,
        F.array(F.format_string("retried: %d (+%d attempts)", "retried_runs", "extra_attempts")),
    ).otherwise(F.array().cast("array<string>"))
    return by_failure_rate(report).limit(7).withColumn("breakdown", F.array_join(F.concat(parts, retried), ", "))


def priority_findings(points: DataFrame, report: DataFrame, costs: DataFrame) -> DataFrame:
    """Head of the report: regressions, unreliable workflows, then the three costliest, by ``section``."""
    lasting = F.when(
        F.col("persistence") == "persistent", F.format_string(" -- persistent over %d runs", "post_runs")
    ).otherwise("")
    signed = F.concat(F.when(F.col("pct_change") >= 0, "+").otherwise(""), half_even(F.col("pct_change")))
    regressions = active_regressions(points).select(
        F.lit(1).alias("section"), F.lit("REGRESSION").alias("tag"), F.col("job").alias("subject"),
        F.format_string("%s%% (%s -> %s) at commit `%s` on %s%s (p=%s)", signed, compact_duration(F.col("before_mean")),
                        compact_duration(F.col("after_mean")), short_sha(F.col("head_sha")),
                        F.date_format("created_at", "yyyy-MM-dd"), lasting, half_even(F.col("p_value"), 4)).alias("text"),
    )
    trend = F.when(
        F.col("trend") == "stable", ""
    ).otherwise(F.format_string(", **%s** (recent 7d: %s%%)", "trend", half_even(F.col("recent_failure_rate") * 100)))
    shares = category_shares(report).groupBy("workflow_id").agg(
        F.array_sort(F.collect_list(F.struct("place", F.format_string("%s%% %s", half_even(F.col("pct")), "category").alias("t")))).alias("_c")
    ).select("workflow_id", F.format_string(" (%s)", F.array_join(F.transform("_c", lambda x: x["t"]), ", ")).alias("_mix"))
    retries = F.when(
        F.col("retried_runs") > 0,
        F.format_string(", %d retried (+%d extra attempts)", "retried_runs", "extra_attempts"),
    ).otherwise("")
    failing = failing_headline(report).join(shares, "workflow_id", "left").select(
        F.lit(2).alias("section"),
        F.when(F.col("kind") == "systematic", "SYSTEMATIC").otherwise("FLAKY").alias("tag"),
        F.col("workflow").alias("subject"),
        F.concat(
            F.format_string("%s%% failure rate (%d/%d runs)", half_even(F.col("failure_rate") * 100), "failures", "total_runs"),
            trend, F.col("headline"), F.coalesce("_mix", F.lit("")), retries,
        ).alias("text"),
    )
    expensive = by_priority(costs).limit(3).select(
        F.lit(3).alias("section"), F.lit("COST").alias("tag"), F.col("workflow").alias("subject"),
        F.format_string("%s billable mins/day (%s total)", half_even(F.col("daily_rate")),
                        half_even(F.col("billable_minutes"))).alias("text"),
    )
    return reduce(DataFrame.unionByName, [regressions, failing, expensive])
