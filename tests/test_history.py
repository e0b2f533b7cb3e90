"""Preparation, summaries, reliability, cost, stages and change categories on small histories."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from build import T0, job, prepared, run, tables
from runlens.operators import changes, cost, failures, outliers, prep, runners, stages, steps, summary
from runlens.plans import analyze as plan


def test_preprocess_chain(spark):
    runs = tables(spark, [
        run(1, conclusion="failure", attempt=1), run(1, attempt=2), run(2, conclusion="failure"),
        run(3, branch="feature"), run(4),
    ])[0]
    kept, notes = prep.preprocess(runs, "main")
    assert sorted((r["run_id"], r["run_attempt"]) for r in kept.collect()) == [(1, 2), (4, 1)]
    assert {r["message"] for r in notes.collect()} == {
        "deduplicated 1 retried runs", "excluded 1 non-success runs from duration analysis"}
    none, notes = prep.preprocess(runs, "gone")
    assert none.isEmpty()
    assert 'no runs found for branch "gone" (had 4 runs on other branches)' in {r["message"] for r in notes.collect()}
    with pytest.raises(ValueError, match="no runs found"):
        prep.require_rows(none, "no runs found")


def test_first_seen_wins_equal_attempts(spark):
    runs = tables(spark, [run(1, branch="a"), run(1, branch="b")])[0]
    assert [r["head_branch"] for r in prep.dedup_retries(runs).collect()] == ["a"]
    assert "WindowGroupLimit" in prep.dedup_retries(runs)._jdf.queryExecution().executedPlan().toString()


def test_rerun_stats(spark):
    runs = tables(spark, [run(1, attempt=n) for n in (1, 2, 3)] + [run(2)] + [run(3, attempt=n) for n in (1, 2)] + [run(9, workflow_id=2)])[0]
    (r,) = failures.rerun_stats(runs).collect()
    assert (r["unique_runs"], r["retried_runs"], r["extra_attempts"], r["rerun_rate"]) == (3, 2, 3, pytest.approx(2 / 3))


def test_since(spark):
    now = dt.datetime(2026, 3, 31, 12)
    row = spark.range(1).select(*[prep.since(t, now).alias(t) for t in ("60d", "2w", "1mo", "2026-01-01")]).first()
    assert [str(x) for x in row] == ["2026-01-30 12:00:00", "2026-03-17 12:00:00", "2026-02-28 12:00:00", "2026-01-01 00:00:00"]
    for bad in ("x", "", "5y"):
        with pytest.raises(ValueError):
            prep.since(bad, now)


def test_run_duration_falls_back(spark):
    runs, jobs, _, _ = tables(spark, [run(1, [job("a", 60), job("b", 30, start=50)]), run(2), run(3, [job("c", 10)])])
    runs = runs.withColumn("updated_at", F.col("started_at") + F.expr("interval 200 seconds"))
    runs = runs.withColumn("started_at", F.when(F.col("run_id") == 3, F.col("started_at") + F.expr("interval 100 seconds")).otherwise(F.col("started_at")))
    found = {r["run_id"]: r["duration_s"] for r in prep.run_durations(runs, jobs).collect()}
    assert found == {1: 80.0, 2: 200.0, 3: 100.0}


@pytest.mark.parametrize("minutes, label", [
    ([5] * 20, "stable"), ([5] * 15 + [8] * 5, "variable"), ([5] * 18 + [12] * 2, "spiky"), ([5] * 15 + [30] * 5, "volatile")])
def test_volatility(spark, minutes, label):
    runs, facts, _, _ = prepared(spark, [run(i, [job("build", m * 60)], queue=30) for i, m in enumerate(minutes)])
    row = summary.workflow_summary(runs, facts).first()
    assert row["label"] == label and (row["queue_median"], row["queue_p95"]) == (30.0, 30.0)


def test_matrix_variants_pool_their_values(spark):
    runs = [run(i, [job("test (a)", 100), job("test (b)", 300), job("build", 50)]) for i in range(10)]
    found = {r["job"]: r for r in summary.job_stats(prepared(spark, runs)[1]).collect()}
    assert {k: r["count"] for k, r in found.items()} == {"test (2 variants)": 20, "build": 10}
    assert found["test (2 variants)"]["median"] == 200.0
    assert {r["job"] for r in summary.job_stats(prepared(spark, runs)[1], matrix=False).collect()} == {"test (a)", "test (b)", "build"}


def test_step_timing(spark):
    plan = [("setup", 5), ("lint", 25), ("tests", 330), ("build", 120)]
    runs = [run(i, [job("ci", 480, steps=[(n, s, "success") for n, s in plan])]) for i in range(10)]
    _, facts, step_rows, _ = prepared(spark, runs)
    rows = steps.slowest_jobs(steps.step_timing(facts, step_rows)).collect()
    assert [r["step"] for r in rows] == ["tests", "build", "lint"] and rows[0]["pct_of_job"] == pytest.approx(68.75)


def report_of(spark, runs):
    r, j, s, _ = tables(spark, runs)
    return failures.failure_report(prep.dedup_retries(r), j, s, failures.rerun_stats(r)).collect()


def test_failures_counted_apart(spark):
    runs = [run(i, conclusion=c) for i, c in enumerate(["success"] * 15 + ["failure"] * 3 + ["cancelled"] * 2)]
    (r,) = report_of(spark, runs)
    assert (r["failures"], r["cancellations"], r["failure_rate"], r["severity"]) == (3, 2, 0.15, "warning")
    assert r["by_conclusion"] == {"failure": 3, "cancelled": 2} and r["kind"] == "flaky"


def test_root_cause(spark):
    bad = [("Checkout", 5, "success"), ("Run tests", 60, "failure"), ("Upload", 5, "failure")]
    runs = [run(i, [job("ci", 70)]) for i in range(30)] + [
        run(i, [job("ci", 70, conclusion="failure", steps=bad)], conclusion="failure") for i in range(30, 50)]
    (r,) = report_of(spark, runs)
    assert [(x["step_name"], x["count"], x["category"]) for x in r["failing_steps"]] == [("Run tests", 20, "test")]
    assert r["kind"] == "systematic" and r["severity"] == "critical" and r["by_category"] == {"test": 20}


def test_negligible_workflows_drop_out(spark):
    runs = [run(i, workflow_id=1, conclusion="failure" if i == 0 else "success") for i in range(100)]
    runs += [run(i, workflow_id=2, conclusion="failure" if i % 10 == 0 else "success") for i in range(100, 200)]
    r, j, s, _ = tables(spark, runs)
    report = failures.failure_report(r, j, s, failures.rerun_stats(r))
    assert [x["workflow_id"] for x in failures.drop_negligible(report).collect()] == [2]


def test_cost_and_sizing(spark):
    runs = [run(i, [job("build", 210), job("mac", 135, labels=["macos-latest"]), job("own", 600, labels=["Self-Hosted"]),
                    job("big", 60, labels=["linux-16vcpu"]), job("long", 1000, labels=["ubuntu-latest"])]) for i in range(10)]
    r, facts, _, _ = prepared(spark, runs)
    jobs = {x["job"]: x for x in cost.job_costs(facts).collect()}
    assert (jobs["build"]["billable"], jobs["mac"]["billable"], jobs["own"]["billable"], jobs["own"]["self_hosted_minutes"]) == (40, 300, 0, 100)
    row = cost.workflow_costs(r, facts).first()
    assert row["billable_minutes"] == 40 + 300 + 10 + 170 and row["daily_rate"] == row["billable_minutes"]
    assert row["priority_score"] == pytest.approx(row["daily_rate"]) and row["daily_savings"] == 0
    sized = {x["job"]: (x["issue"], x["cores"]) for x in runners.runner_sizing(facts).collect()}
    assert sized == {"big": ("oversized", 16), "long": ("undersized", 2)}


def test_first_labels_decide_the_rate(spark):
    runs = [run(1, [job("a", 60, labels=["macos-14"])])] + [run(i, [job("a", 60)]) for i in range(2, 6)]
    assert cost.job_costs(prepared(spark, runs)[1]).first()["billable"] == 50


def test_outlier_floor_and_groups(spark):
    runs = [run(i, [job("build", 300 + i % 7), job("x", 10)]) for i in range(100)]
    for i, seconds in ((20, 900), (50, 2000), (70, 1000)):
        runs[i]["jobs"][0]["seconds"] = seconds
    r, facts, _, workflows = prepared(spark, runs)
    found = outliers.all_outliers(r, facts, workflows)
    assert all(x["rank"] >= 95 for x in found.collect()) and found.count() == 6
    (group,) = outliers.group_outliers(found).collect()
    assert (group["job"], group["count"], group["worst_s"], group["severity"]) == ("", 3, 2000.0, "critical")


def test_stages(spark):
    tests = [job(f"test ({n})", 500, start=n) for n in range(4)]
    jobs = [*tests, job("merge", 30, start=540), job("build a", 200, start=600), job("pack", 180, start=610), job("deploy", 540, start=840)]
    r, facts, _, _ = prepared(spark, [run(i, jobs) for i in range(10)])
    rows = stages.by_wall_clock(stages.stage_structure(r, facts)).collect()
    assert [x["name"] for x in rows] == ["test (4 variants)", "merge", "build a, pack", "deploy"]
    assert [x["name"] for x in rows if x["critical"]] == ["deploy"] and [x["sequential"] for x in rows] == [False, True, True, True]
    assert rows[0]["parallelism"] > 0.3 and rows[2]["jobs"] == ["build a", "pack"]
    # The gap is measured from the first start of a stage, not from the previous job.
    chain = prepared(spark, [run(1, [job("a", 5), job("b", 5, start=20), job("c", 5, start=40), job("d", 5, start=65)])])[1]
    assert [x["jobs"] for x in stages.detect_stages(chain).orderBy("stage").collect()] == [2, 2]


def change_rows(spark, seconds, workflow_id=1, **more):
    runs = [run(i, [job("build", s)], workflow_id=workflow_id) for i, s in enumerate(seconds)]
    r, facts, _, workflows = prepared(spark, runs)
    return changes.categorize(changes.change_points(r, facts, workflows), **more).orderBy("idx").collect()


def wobble(n, centre):
    return [centre + i % 5 - 2 for i in range(n)]


def test_speedup_and_slowdown(spark):
    (r,) = change_rows(spark, wobble(20, 670) + wobble(20, 565))
    assert r["direction"] == "speedup" and r["pct_change"] < -10 and r["p_value"] < 0.05 and r["category"] == "speedup"
    (r,) = change_rows(spark, wobble(20, 180) + wobble(20, 360))
    assert (r["category"], r["severity"], r["persistence"], r["workflow"]) == ("regression", "critical", "persistent", "CI")
    assert r["head_sha"] == f"sha{r['idx']:08d}"


def test_persistence(spark):
    assert change_rows(spark, wobble(20, 300) + wobble(15, 480) + wobble(20, 300))[0]["persistence"] == "transient"
    (r,) = change_rows(spark, wobble(15, 300) + wobble(5, 480))
    assert (r["persistence"], r["post_runs"]) == ("inconclusive", 5)


def test_lone_outlier_is_no_regression(spark):
    rows = change_rows(spark, [660 + i % 9 * 5 if i != 15 else 2367 for i in range(30)])
    assert not [r for r in rows if r["direction"] == "slowdown" and r["pct_change"] > 20]


def test_too_few_runs(spark):
    assert change_rows(spark, [100] * 4 + [300] * 5) == []


def points(spark, rows):
    data = [(w, j, i, T0 + dt.timedelta(days=i), s, d, o, p, 100.0, 200.0) for w, j, i, s, d, o, p in rows]
    return spark.createDataFrame(data, "workflow_id long, job string, idx int, created_at timestamp, severity string, direction string, "
                                       "overlap double, persistence string, before_mean double, after_mean double")


def test_categories(spark):
    slow, keep = "slowdown", "persistent"
    df = points(spark, [
        (1, "wild", 1, "warning", slow, 0.1, keep), (1, "wild", 2, "critical", "speedup", 0.1, keep), (2, "wild", 3, "warning", slow, 0.1, keep),
        (1, "twice", 1, "warning", slow, 0.1, keep), (1, "twice", 2, "critical", slow, 0.1, keep), (1, "twice", 3, "info", slow, 0.1, keep),
        (1, "same", 1, "warning", slow, 0.7, keep), (1, "gone", 1, "critical", slow, 0.1, "transient"), (1, "fast", 1, "critical", "speedup", 0.0, keep),
    ])
    found = {(r["job"], r["idx"]): r["category"] for r in changes.categorize(df).collect()}
    assert {found["wild", i] for i in (1, 2, 3)} == {"oscillating"}
    assert [found["twice", i] for i in (1, 2, 3)] == ["minor", "regression", "minor"]
    assert (found["same", 1], found["gone", 1], found["fast", 1]) == ("minor", "regression", "speedup")
    (r,) = changes.oscillating_summary(changes.categorize(df)).collect()
    assert (r["job"], r["shifts"], r["trend"]) == ("wild", 3, "trending up")


def _joins(df):
    return df._jdf.queryExecution().optimizedPlan().toString().count("Join")


def test_shared_inputs_are_written_once(spark):
    """Analyses read runs and facts as rows, and do not join the tables again."""
    listed = [run(1, [job("a", 60), job("b", 30, start=50)], attempt=2), run(1, conclusion="failure"), run(2),
              run(3, [job("a", 10)], conclusion="failure")]
    runs, jobs, step_rows, names = tables(spark, listed)
    context, _ = plan.context_of(plan.Tables(runs, jobs.filter("job_id < 100 OR run_id <> 1"), step_rows, names))
    assert [_joins(x) for x in (context.runs, context.facts)] == [0, 0]
    assert "Window" not in context.all_runs._jdf.queryExecution().optimizedPlan().toString()
    assert {r["run_id"]: r["duration_s"] for r in context.runs.collect()} == {1: 80.0, 2: 0.0}
    assert sorted((r["run_id"], r["job"]) for r in context.facts.collect()) == [(1, "a"), (1, "b")]


def test_change_points_are_found_once(spark):
    """Categories read change points several times: they are rows by then, and do not join runs or the evidence again."""
    runs = [run(i, [job("build", s)]) for i, s in enumerate(wobble(20, 180) + wobble(20, 360))]
    r, facts, _, workflows = prepared(spark, runs)
    found = changes.change_points(r, facts, workflows)
    assert _joins(found) == 0
    assert _joins(changes.job_series(r, facts)) == 0
    assert [(x["run_id"], x["severity"], x["workflow"]) for x in found.collect()] == [(20, "critical", "CI")]
