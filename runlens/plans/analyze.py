"""All analyses over one set of history tables."""

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runlens.operators import changes, cost, failures, outliers, prep, runners, stages, steps, summary
from runlens.plans import findings as make
from runlens.schema import DIAGNOSTICS
from runlens.session import checkpoint, stored


@dataclass
class Tables:
    """History as listed: every attempt of every run, jobs, steps and the workflow dimension."""

    runs: DataFrame
    jobs: DataFrame
    steps: DataFrame
    workflows: DataFrame


@dataclass
class Options:
    branch: str = ""
    include_failures: bool = False
    group_matrix: bool = True
    top_steps: int = 3
    outlier_method: str = "log-iqr"
    outlier_min_rank: float = 95.0
    shift_threshold: float = 4.0
    shift_min_segment: int = 5
    oscillating_min: int = 3
    rates: dict[str, float] | None = None


@dataclass
class Context:
    """What an analysis sees. ``runs`` and ``facts`` are filtered, ``all_runs`` only deduplicated."""

    runs: DataFrame
    facts: DataFrame
    steps: DataFrame
    all_runs: DataFrame
    all_jobs: DataFrame
    reruns: DataFrame
    workflows: DataFrame
    options: Options = field(default_factory=Options)


Analyzer = Callable[[Context], DataFrame]


def context_of(tables: Tables, options: Options | None = None) -> tuple[Context, DataFrame]:
    """Inputs shared by the analyses, and the diagnostics of preparing them.

    Runs and job facts are written once, as every analysis reads them several times. A run's last job is told from its facts.
    """
    options = options or Options()
    all_runs = stored(prep.dedup_retries(tables.runs))
    kept, notes = prep.preprocess(all_runs, options.branch, options.include_failures, unique=all_runs)
    facts = stored(summary.job_facts(kept, tables.jobs))
    context = Context(
        runs=stored(prep.run_durations(kept, facts)),
        facts=facts,
        steps=tables.steps,
        all_runs=all_runs,
        all_jobs=tables.jobs,
        reruns=failures.rerun_stats(tables.runs),
        workflows=tables.workflows,
        options=options,
    )
    return context, notes


def summary_findings(c: Context) -> DataFrame:
    return make.summary_findings(summary.workflow_summary(c.runs, c.facts, c.options.group_matrix), c.workflows)


def step_findings(c: Context) -> DataFrame:
    return make.step_findings(steps.step_timing(c.facts, c.steps, c.options.top_steps), c.workflows)


def stage_findings(c: Context) -> DataFrame:
    return make.stage_findings(stages.stage_structure(c.runs, c.facts), c.workflows)


def runner_findings(c: Context) -> DataFrame:
    return make.runner_findings(runners.runner_sizing(c.facts, c.options.rates), c.workflows)


def outlier_findings(c: Context) -> DataFrame:
    found = outliers.all_outliers(c.runs, c.facts, c.workflows, c.options.outlier_method, c.options.outlier_min_rank)
    return make.outlier_findings(outliers.group_outliers(found))


def change_findings(c: Context) -> DataFrame:
    points = changes.change_points(
        c.runs, c.facts, c.workflows, threshold=c.options.shift_threshold, min_segment=c.options.shift_min_segment
    )
    return make.change_findings(changes.categorize(points, c.options.oscillating_min))


def failure_findings(c: Context) -> DataFrame:
    report = failures.failure_report(c.all_runs, c.all_jobs, c.steps, c.reruns)
    return make.failure_findings(failures.drop_negligible(report), c.workflows)


def cost_findings(c: Context) -> DataFrame:
    costs = cost.workflow_costs(c.runs, c.facts, c.options.rates)
    return make.cost_findings(costs, cost.job_costs(c.facts, c.options.rates), c.workflows)


ANALYZERS: dict[str, Analyzer] = {
    "summary": summary_findings,
    "steps": step_findings,
    "pipeline": stage_findings,
    "runner": runner_findings,
    "outlier": outlier_findings,
    "changepoint": change_findings,
    "failure": failure_findings,
    "cost": cost_findings,
}


def analyze(
    tables: Tables, options: Options | None = None, analyzers: dict[str, Analyzer] | None = None
) -> dict[str, DataFrame]:
    """``findings``, ``diagnostics`` and ``meta`` of a history.

    Each analysis is evaluated on its own, so one that fails costs its findings and leaves a diagnostic.
    Findings are small.
    """
    spark = tables.runs.sparkSession
    prep.require_rows(tables.runs, "no runs found")
    context, notes = context_of(tables, options)
    prep.require_rows(context.runs, "all runs were filtered out during preprocessing")
    found, failed = [], []
    for name, analyzer in (ANALYZERS if analyzers is None else analyzers).items():
        try:
            found.append(checkpoint(analyzer(context).select(*make.COLUMNS)))
        except Exception as error:
            first_line = str(error).splitlines()[0] if str(error) else type(error).__name__
            failed.append(("error", "analyzer", "global", f'analyzer "{name}" failed: {first_line}'))
    meta = checkpoint(prep.result_meta(context.runs))
    diagnostics = [
        checkpoint(notes),
        spark.createDataFrame(failed, DIAGNOSTICS),
        checkpoint(prep.missing_labels(context.all_jobs.join(context.all_runs.select("run_id"), "run_id", "left_semi"))),
    ]
    empty = spark.createDataFrame([], ", ".join(f"{c} string" for c in make.COLUMNS))
    return {
        "findings": reduce(DataFrame.unionByName, found, empty),
        "diagnostics": reduce(DataFrame.unionByName, diagnostics),
        "meta": meta,
    }


def severity_counts(findings: DataFrame) -> DataFrame:
    return findings.groupBy("type", "severity").agg(F.count(F.lit(1)).alias("findings"))
