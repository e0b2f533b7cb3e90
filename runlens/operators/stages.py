"""Stages of a run: jobs that start together, how long they take and how much runs in parallel."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from runlens.functions.durations import micros
from runlens.functions.names import stage_label
from runlens.operators.quantiles import histogram, percentile_of
from runlens.session import checkpoint, stored

GAP_S = 30.0
MIN_RUNS = 5


def _staged_jobs(facts: DataFrame, gap_s: float) -> DataFrame:
    """Timed jobs with ``stage``: a stage takes every job starting within ``gap_s`` of its first start.

    Only distinct start times of a run matter for the cut. They are reduced before they meet, so their
    number is bounded by the seconds a run lasts and not by its jobs.
    """
    timed = facts.filter("duration_s > 0").select(
        "workflow_id", "run_id", "job_id", "job", micros(F.col("started_at")).alias("_start"),
        micros(F.col("completed_at")).alias("_end"),
    )
    starts = timed.groupBy("run_id", "_start").agg(F.first(F.lit(1)).alias("_one"))
    cuts = F.aggregate(
        "_starts",
        F.array().cast("array<bigint>"),
        lambda acc, s: F.when(F.size(acc) == 0, F.array(s))
        .when(s - F.element_at(acc, -1) > F.lit(int(gap_s * 1e6)), F.concat(acc, F.array(s)))
        .otherwise(acc),
    )
    anchors = (
        starts.groupBy("run_id")
        .agg(F.array_sort(F.collect_list("_start")).alias("_starts"))
        .select("run_id", cuts.alias("_cuts"))
    )
    stage = F.size(F.filter("_cuts", lambda c: c <= F.col("_start")))
    return timed.join(anchors, "run_id").withColumn("stage", stage).drop("_cuts")


def detect_stages(facts: DataFrame, gap_s: float = GAP_S) -> DataFrame:
    """One row per (run, stage): name, number of jobs, their distinct names, start-to-end seconds.

    The distinct names are those a workflow defines, however many jobs a run has.
    """
    keys = ["workflow_id", "run_id", "stage"]
    staged = _staged_jobs(facts, gap_s)
    # Ranked and aggregated by the same keys, so both happen after one shuffle.
    order = Window.partitionBy(*keys).orderBy("_start", "job_id")
    nth = [F.max(F.when(F.col("_rank") == n, F.col("job"))) for n in (1, 2, 3)]
    return (
        staged.withColumn("_rank", F.row_number().over(order))
        .groupBy(*keys)
        .agg(
            F.count(F.lit(1)).alias("jobs"),
            F.min("job").alias("_low"),
            F.max("job").alias("_high"),
            F.array_compact(F.array(*nth)).alias("_firsts"),
            F.array_sort(F.collect_set("job")).alias("job_names"),
            ((F.max("_end") - F.min("_start")) / 1e6).alias("stage_s"),
        )
        .withColumn("name", stage_label(F.col("jobs"), F.col("_firsts"), F.col("_low"), F.col("_high")))
        .drop("_low", "_high", "_firsts")
    )


def _per_run(runs: DataFrame, facts: DataFrame) -> DataFrame:
    """Runs with the number of their jobs and the sum of job times; ``runs`` carry ``duration_s``."""
    sums = facts.groupBy("run_id").agg(F.count(F.lit(1)).alias("n_jobs"), F.sum("duration_s").alias("job_sum_s"))
    own = [c for c in ("workflow_id", "run_id", "created_at", "duration_s") if c in runs.columns]
    return runs.select(*own).join(sums, "run_id", "left").fillna(0, ["n_jobs"])


def _measured(per_run: DataFrame) -> DataFrame:
    """Runs with positive wall clock and job time."""
    return per_run.filter("duration_s > 0 AND job_sum_s > 0").select(
        "workflow_id", "run_id", F.col("duration_s").alias("wall_s"), "job_sum_s")


def _typical(measured: DataFrame) -> DataFrame:
    """Medians of both measures from one pass over the runs."""
    both = measured.select("workflow_id", F.expr("stack(2, 'wall', wall_s, 'work', job_sum_s) as (_of, _s)"))
    medians = (
        histogram(both, ["workflow_id", "_of"], "_s")
        .groupBy("workflow_id", "_of")
        .agg(F.sum("n").alias("_n"), percentile_of("_s", 50).alias("_median"))
    )
    saved = F.greatest(1 - F.col("wall_median") / F.col("job_sum_median"), F.lit(0.0))
    return (
        medians.groupBy("workflow_id")
        .agg(
            F.max("_n").alias("total_runs"),
            F.max(F.when(F.col("_of") == "wall", F.col("_median"))).alias("wall_median"),
            F.max(F.when(F.col("_of") == "work", F.col("_median"))).alias("job_sum_median"),
        )
        .filter(F.col("total_runs") >= MIN_RUNS)
        .withColumn("parallelism", saved)
    )


def parallelism(runs: DataFrame, facts: DataFrame) -> DataFrame:
    """Per workflow: median wall clock, median sum of job times and the share saved by running in parallel."""
    return _typical(_measured(_per_run(runs, facts)))


def _gate(per_run: DataFrame) -> DataFrame:
    return (
        per_run.groupBy("workflow_id")
        .agg(F.count(F.lit(1)).alias("runs"), F.max("n_jobs").alias("max_jobs"))
        .filter((F.col("runs") >= MIN_RUNS) & (F.col("max_jobs") >= 2))
    )


def stage_gate(runs: DataFrame, facts: DataFrame) -> DataFrame:
    """Workflows with at least five runs, one of which has two jobs or more."""
    return _gate(_per_run(runs, facts))


def stage_structure(runs: DataFrame, facts: DataFrame, gap_s: float = GAP_S) -> DataFrame:
    """Stages per workflow in the order of its run with most jobs, with median time and jobs of each.

    One row per stage; ``critical`` marks the longest one, ``sequential`` all but the first.
    """
    by_workflow = ["workflow_id"]
    # Each input is read once; what several steps below need is written in narrow form.
    facts = stored(facts.select("workflow_id", "run_id", "job_id", "job", "started_at", "completed_at", "duration_s"))
    per_run = checkpoint(_per_run(runs, facts))
    measured = _measured(per_run)
    typical = _typical(measured).join(_gate(per_run).select("workflow_id"), by_workflow, "left_semi")
    found = checkpoint(detect_stages(facts, gap_s))
    in_scope = found.join(measured.select("run_id"), "run_id", "left_semi")
    medians = histogram(in_scope, ["workflow_id", "name"], "stage_s").groupBy("workflow_id", "name").agg(
        percentile_of("stage_s", 50).alias("stage_median")
    )
    members = (
        in_scope.groupBy("workflow_id", "name", "job_names")
        .agg(F.first(F.lit(1)).alias("_one"))
        .select("workflow_id", "name", F.explode("job_names").alias("job"))
        .distinct()
        .groupBy("workflow_id", "name")
        .agg(F.array_sort(F.collect_list("job")).alias("jobs"))
    )
    most = Window.partitionBy("workflow_id").orderBy(F.col("n_jobs").desc(), "created_at", "run_id")
    model = (
        per_run.withColumn("_rank", F.row_number().over(most))
        .filter("_rank = 1")
        .select("run_id")
    )
    listed = (
        found.join(model, "run_id", "left_semi")
        .select("workflow_id", "stage", "name")
        .join(medians, ["workflow_id", "name"])
        .join(members, ["workflow_id", "name"])
        .join(typical, by_workflow)
    )
    # At most one row per stage of one run each.
    whole = Window.partitionBy("workflow_id")
    longest = Window.partitionBy("workflow_id").orderBy(F.col("stage_median").desc(), "stage")
    return (
        listed.withColumn("stages", F.count(F.lit(1)).over(whole))
        .filter("stages >= 2")
        .withColumn("critical", F.row_number().over(longest) == 1)
        .withColumn("sequential", F.col("stage") > 1)
        .withColumn("pct_of_wall", F.col("stage_median") / F.col("wall_median") * 100)
    )


def by_wall_clock(structure: DataFrame) -> DataFrame:
    return structure.orderBy(F.col("wall_median").desc(), "workflow_id", "stage")
