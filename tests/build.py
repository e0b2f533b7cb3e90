"""Small histories for tests: each run is a dict, each job a tuple (name, start second, seconds, …)."""

import datetime as dt

from runlens.schema import JOBS, RUNS, STEPS, WORKFLOWS

T0 = dt.datetime(2026, 4, 1, 12, tzinfo=dt.timezone.utc)


def run(run_id, jobs=(), workflow_id=1, conclusion="success", branch="main", attempt=1, created=None, queue=0, status="completed"):
    return dict(run_id=run_id, jobs=list(jobs), workflow_id=workflow_id, conclusion=conclusion, branch=branch,
                attempt=attempt, created=created or T0 + dt.timedelta(hours=run_id), queue=queue, status=status)


def job(name, seconds, start=0, labels=("ubuntu-latest",), conclusion="success", steps=()):
    """``steps`` are (name, seconds, conclusion)."""
    return dict(name=name, seconds=seconds, start=start, labels=list(labels), conclusion=conclusion, steps=list(steps))


def tables(spark, runs, workflows=((1, "CI"), (2, "Deploy"))):
    run_rows, job_rows, step_rows = [], [], []
    for seq, r in enumerate(runs):
        started = r["created"] + dt.timedelta(seconds=r["queue"])
        ends = [started + dt.timedelta(seconds=j["start"] + j["seconds"]) for j in r["jobs"]]
        run_rows.append((r["run_id"], "", r["workflow_id"], "", f"run {r['run_id']}", "push", r["status"], r["conclusion"],
                         r["branch"], f"sha{r['run_id']:08d}", r["attempt"], r["created"], started,
                         max(ends, default=started), seq))
        for n, j in enumerate(r["jobs"]):
            job_id = seq * 100 + n
            begin = started + dt.timedelta(seconds=j["start"])
            job_rows.append((job_id, r["run_id"], j["name"], "completed", j["conclusion"], begin,
                             begin + dt.timedelta(seconds=j["seconds"]), "", "", j["labels"]))
            at = begin
            for number, (name, seconds, conclusion) in enumerate(j["steps"], 1):
                step_rows.append((job_id, number, name, "completed", conclusion, at, at + dt.timedelta(seconds=seconds)))
                at += dt.timedelta(seconds=seconds)
    return (
        spark.createDataFrame(run_rows, RUNS),
        spark.createDataFrame(job_rows, JOBS),
        spark.createDataFrame(step_rows, STEPS),
        spark.createDataFrame([(*w, "") for w in workflows], WORKFLOWS),
    )


def prepared(spark, runs):
    """(runs with duration, facts, steps, workflows)"""
    from runlens.operators import prep, summary

    r, j, s, w = tables(spark, runs)
    return prep.run_durations(r, j), summary.job_facts(r, j), s, w
