"""Sources, stored tables, incremental ingest and the analysis as a whole."""

import datetime as dt
import json
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from build import T0, job, run, tables
from runlens.plans import analyze as plan
from runlens.plans import findings as make
from runlens.schema import RUNS
from runlens.sources import json_pages
from runlens.sources import tables as store
from runlens.streaming import ingest

RUN = dict(id=7, node_id="n", name="CI", display_title="Fix", workflow_id=1, event="push", status="completed", conclusion="success",
           head_branch="main", head_sha="abc", run_attempt=1, created_at="2026-04-09T10:07:24Z", run_started_at="2026-04-09T10:07:30Z",
           updated_at="2026-04-09T10:09:00Z")
JOB = dict(id=70, run_id=7, name="build", status="completed", conclusion="success", started_at="2026-04-09T10:07:30Z",
           completed_at="2026-04-09T10:08:45Z", runner_name="r", runner_group_name="g", labels=["ubuntu-latest"],
           steps=[dict(name="Checkout", number=1, status="completed", conclusion="success", started_at="2026-04-09T10:07:30Z",
                       completed_at="2026-04-09T10:07:32Z"), dict(name="Build", number=2, status="in_progress", conclusion=None)])


def page(path, **content):
    path.write_text(json.dumps(content, indent=1))
    return str(path)


def test_listing_pages(spark, tmp_path):
    r = json_pages.read_runs(spark, page(tmp_path / "runs.json", total_count=1, workflow_runs=[RUN])).first()
    assert (r["run_id"], r["workflow_name"], r["name"], r["started_at"].minute) == (7, "CI", "Fix", 7)
    jobs, steps = json_pages.read_jobs(spark, page(tmp_path / "jobs.json", total_count=1, jobs=[JOB]))
    assert jobs.first()["labels"] == ["ubuntu-latest"]
    assert [(s["job_id"], s["number"], s["conclusion"], s["completed_at"] is None) for s in steps.orderBy("number").collect()] == [
        (70, 1, "success", False), (70, 2, "", True)]
    w = json_pages.read_workflows(spark, page(tmp_path / "w.json", total_count=1, workflows=[dict(id=1, name="CI", path=".ci/a.yml", state="active")]))
    assert tuple(w.first()) == (1, "CI", ".ci/a.yml")
    broken = page(tmp_path / "bad.json", total_count=1, workflow_runs=[dict(RUN, created_at="garbage")])
    with pytest.raises(Exception, match="garbage"):
        json_pages.read_runs(spark, broken).collect()


def test_batched_responses(spark):
    check = dict(name="build", databaseId=70, startedAt="2026-04-09T10:07:30Z", completedAt="oops", status="COMPLETED", conclusion=None,
                 steps=dict(nodes=[dict(name="Checkout", number=1, startedAt=None, completedAt="", status="COMPLETED", conclusion="FAILURE")]))
    answer = json.dumps(dict(r0=dict(databaseId=1, checkSuite=dict(checkRuns=dict(nodes=[check]))), r1=dict(databaseId=2, checkSuite=None)))
    jobs, steps, notes = json_pages.decode_batch(spark.createDataFrame([([7, 8, 9], answer)], "run_ids array<long>, body string"), "body")
    (j,) = jobs.collect()
    assert (j["job_id"], j["run_id"], j["status"], j["conclusion"], j["completed_at"], j["labels"]) == (70, 7, "completed", "", None, [])
    assert [(s["conclusion"], s["started_at"]) for s in steps.collect()] == [("failure", None)]
    assert [n["scope"] for n in notes.collect()] == ["run-8"]


def test_a_bad_node_costs_its_own_diagnostic(spark):
    good = dict(databaseId=1, checkSuite=dict(checkRuns=dict(nodes=[dict(name="build", databaseId=70, status="COMPLETED")])))
    typed = dict(databaseId=2, checkSuite=dict(checkRuns=dict(nodes=[dict(name="x", databaseId="seventy")])))
    answer = json.dumps(dict(r0=good, r1="oops", r2=typed, r3=None, x4=good, r5=good))
    asked = spark.createDataFrame([([7, 8, 9, 10, 11], answer)], "run_ids array<long>, body string")
    jobs, steps, notes = json_pages.decode_batch(asked, "body")
    assert [(j["job_id"], j["run_id"]) for j in jobs.collect()] == [(70, 7)] and steps.isEmpty()
    assert sorted(n["scope"] for n in notes.collect()) == ["run-10", "run-8", "run-9"]


def test_round_trip_and_upsert(spark, tmp_path):
    plain = [("Checkout", 5, "success"), ("Build", 20, "success")]
    first = tables(spark, [run(1, [job("old", 30, steps=plain)], status="in_progress"), run(2, [job("keep", 10, steps=plain)])])[:3]
    store.save_tables(*first, str(tmp_path / "v1"))
    loaded = store.load_tables(spark, str(tmp_path / "v1"))
    for name, df in zip(("runs", "jobs", "steps"), first):
        key = {"runs": "run_id", "jobs": "job_id", "steps": ["job_id", "number"]}[name]
        assert loaded[name].select(*df.columns).orderBy(key).collect() == df.orderBy(key).collect()
    again = tables(spark, [run(1, [job("new", 30, steps=plain[:1])])])[:3]
    runs, jobs, steps = store.upsert_runs(tuple(loaded[n] for n in ("runs", "jobs", "steps")), again)
    assert sorted((r["run_id"], r["status"]) for r in runs.collect()) == [(1, "completed"), (2, "completed")]
    assert sorted(j["name"] for j in jobs.collect()) == ["keep", "new"] and steps.count() == 3
    assert store.orphans(jobs, runs, "run_id").isEmpty() and store.orphans(steps, jobs, "job_id").isEmpty()


def test_older_files_get_defaults(spark, tmp_path):
    old = tables(spark, [run(1)])[0].drop("event")
    old.write.parquet(str(tmp_path / "runs"))
    row = store.with_defaults(spark.read.schema(RUNS).parquet(str(tmp_path / "runs")), RUNS).first()
    assert row["event"] == "" and row["run_id"] == 1


def test_slices(spark):
    start = dt.datetime(2026, 4, 1)
    runs = tables(spark, [run(i, created=T0 + dt.timedelta(days=d)) for i, d in enumerate([0, 1, 2, 14])])[0]
    found = store.slice_audit(runs, start, start + dt.timedelta(days=15), cap=2).orderBy("slice").collect()
    assert [(r["runs"], r["truncated"]) for r in found] == [(3, True), (0, False), (1, False)]


@pytest.fixture()
def stream(spark, tmp_path):
    """Feeds pages one batch at a time and gives the run states, jobs and step jobs then stored."""
    (tmp_path / "in").mkdir()
    store_path = str(tmp_path / "store")

    def feed(**content):
        page(tmp_path / "in" / f"{len(list((tmp_path / 'in').iterdir())):03d}.json", **content)
        ingest.ingest(spark, str(tmp_path / "in"), store_path, str(tmp_path / "cp"))
        now = ingest.read_store(spark, store_path)
        return (sorted((r["run_id"], r["status"]) for r in now["runs"].collect()), sorted(j["job_id"] for j in now["jobs"].collect()),
                sorted({s["job_id"] for s in now["steps"].collect()}))

    feed.store = store_path
    return feed


def test_ingest_is_incremental(spark, stream):
    stream(workflow_runs=[dict(RUN, status="in_progress"), dict(RUN, id=8)], jobs=[JOB, dict(JOB, id=80, run_id=8)])
    assert stream(workflow_runs=[RUN], total_count=1, jobs=[dict(JOB, id=71)]) == ([(7, "completed"), (8, "completed")], [71, 80], [71, 80])


def test_runs_listed_again_keep_their_jobs(stream):
    first = stream(workflow_runs=[RUN], total_count=1, jobs=[JOB])
    assert stream(workflow_runs=[RUN]) == first and first[1] == [JOB["id"]]
    # A run that is not complete takes the listed row and keeps its children.
    stream(workflow_runs=[dict(RUN, id=9, status="in_progress")], total_count=1, jobs=[dict(JOB, id=90, run_id=9)])
    assert stream(workflow_runs=[dict(RUN, id=9)]) == ([(7, "completed"), (9, "completed")], [70, 90], [70, 90])


def test_jobs_before_runs_and_pages_in_parts(stream):
    assert stream(total_count=2, jobs=[JOB]) == ([], [70], [70])
    assert stream(workflow_runs=[RUN]) == ([(7, "completed")], [70], [70])
    assert stream(total_count=2, jobs=[dict(JOB, id=71)])[1] == [70, 71]
    # All jobs of a later attempt at once take the place of the old ones.
    assert stream(total_count=1, jobs=[dict(JOB, id=72)]) == ([(7, "completed")], [72], [72])


def test_repeated_batch(spark, tmp_path):
    pages = spark.createDataFrame([(None, [], [])], ingest.PAGE)
    ingest.save_batch(pages, str(tmp_path / "none"))
    assert ingest.latest_version(spark, str(tmp_path / "none")) is None
    page(tmp_path / "p.json", workflow_runs=[RUN], total_count=1, jobs=[JOB])
    pages = spark.read.schema(ingest.PAGE).option("multiLine", True).json(str(tmp_path / "p.json"))
    tables_now = []
    for _ in range(2):
        ingest.save_batch(pages, str(tmp_path / "store"))
        tables_now.append({n: sorted(map(str, df.collect())) for n, df in ingest.read_store(spark, str(tmp_path / "store")).items()})
    assert tables_now[0] == tables_now[1]


def history(spark):
    bad = [("Checkout", 5, "success"), ("Run tests", 60, "failure")]
    good = [("Checkout", 5, "success"), ("Run tests", 60, "success")]
    runs = [run(i, [job("build", 180 + i % 5 + (180 if i >= 30 else 0), steps=good), job("deploy", 60, start=400)]) for i in range(60)]
    runs += [run(100 + i, [job("build", 90, conclusion="failure", steps=bad)], conclusion="failure") for i in range(12)]
    runs[5]["attempt"] = 2
    return plan.Tables(*tables(spark, runs))


def test_analyze(spark, tmp_path):
    def broken(context):
        raise RuntimeError("no luck")

    result = plan.analyze(history(spark), analyzers={**plan.ANALYZERS, "mine": broken})
    findings = result["findings"]
    assert {r["type"] for r in findings.select("type").distinct().collect()} >= {"summary", "steps", "pipeline", "changepoint", "failure", "cost"}
    assert {"analyzer \"mine\" failed: no luck"} <= {r["message"] for r in result["diagnostics"].collect()}
    (change,) = make.by_type(findings, make.CHANGE).collect()
    detail = json.loads(change["detail"])
    assert detail["category"] == "regression" and detail["direction"] == "slowdown" and change["severity"] == "critical"
    (failure,) = make.by_type(findings, make.FAILURE).collect()
    assert failure["description"] == "17% failure rate (12/72 runs)" and json.loads(failure["detail"])["failure_kind"] == "systematic"
    assert result["meta"].first()["total_runs"] == 60
    assert make.compact(findings).count() == findings.count()
    store.write_result(result, str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out" / "findings")).count() == findings.count()


def test_nothing_to_analyze(spark):
    t = history(spark)
    with pytest.raises(ValueError, match="no runs found"):
        plan.analyze(plan.Tables(t.runs.filter(F.lit(False)), t.jobs, t.steps, t.workflows))
    with pytest.raises(ValueError, match="filtered out"):
        plan.analyze(t, plan.Options(branch="gone"))


def test_job_pages_shuffle_jobs_once(spark):
    """Steps stand in the row of their job, and jobs lie by run already."""
    from workloads import loading

    plan = loading.job_pages(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") <= 2


def test_tasks_of_keyed_joins_grow_with_the_jobs(spark, monkeypatch):
    monkeypatch.setattr(store, "JOBS_PER_TASK", 10)
    steps = [("Checkout", 5, "success")]
    old = tables(spark, [run(i, [job(f"old {i}", 30, steps=steps)]) for i in range(1, 81)])[:3]
    new = tables(spark, [run(1, [job("new", 30, steps=steps)])])[:3]
    usual = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", 1)
    try:
        _, jobs, steps = store.upsert_runs(old, new)
        # 80 jobs in 8 parts, of which hashing may leave some empty.
        for saved in (jobs, steps):
            parts = saved.groupBy(F.spark_partition_id()).count().collect()
            assert sum(p["count"] for p in parts) == 80 and len(parts) >= 5
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", usual)


def test_details_of_steps_with_their_run_shuffle_nothing_more(spark):
    steps = [("Build", 20, "success"), ("Checkout", 5, "success")]
    runs, jobs, flat = tables(spark, [run(1, [job("a", 30, steps=steps), job("b", 10)]), run(2), run(3, [job("c", 10, steps=steps)])])[:3]
    jobs = store.by_run(jobs)
    lying = flat.join(jobs.select("job_id", "run_id"), "job_id").repartition(1, "run_id")
    found = store.run_details(runs, jobs, lying)
    assert found.select("run_id", "jobs").orderBy("run_id").collect() == store.run_details(runs, jobs, flat).select("run_id", "jobs").orderBy("run_id").collect()
    listed = {r["run_id"]: r["jobs"] and [(j["name"], j["steps"] and [s["number"] for s in j["steps"]]) for j in r["jobs"]] for r in found.collect()}
    assert listed[2] is None and listed[3] == [("c", [1, 2])] and dict(listed[1]) == {"a": [1, 2], "b": None}
    plan = store.run_details(runs, jobs, jobs.select("run_id", "job_id", F.lit(1).alias("number")))._jdf.queryExecution().executedPlan().toString()
    # Jobs are dealt out by run, once for themselves and once for their steps; only runs are shuffled to join them.
    assert plan.count("Exchange hashpartitioning") <= 3
