"""The log of segments: what a batch writes, what a reading opens, merges, two writers, compaction and expiry."""

import datetime as dt
import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from build import T0, job, run, tables
from runlens.sources import files, sample_history, store
from runlens.streaming import ingest

STEPS = [("Checkout", 5, "success"), ("Build", 20, "success")]


def batch_of(spark, runs):
    """Tables of some runs, with job ids that the run id gives."""
    r, j, s, _ = tables(spark, runs)
    own = j.select("job_id", (100 * F.col("run_id") + F.col("job_id") % 100).alias("_id"))
    return r, *[df.join(own, "job_id").withColumn("job_id", F.col("_id")).drop("_id") for df in (j, s)]


def on_disk(path):
    return {f: f.stat().st_size for f in Path(path).rglob("part-*")}


def rows(found):
    return {name: sorted(map(str, df.collect())) for name, df in found.items()}





def month(n):
    return T0 + dt.timedelta(days=30 * n)


def test_a_batch_writes_in_proportion_to_itself(spark, tmp_path):
    path, sizes = str(tmp_path), []
    store.append(spark, path, *batch_of(spark, [run(i, [job("build", 60 + i, steps=STEPS)], created=month(i % 6)) for i in range(300)]))
    before = on_disk(path)
    for start in (1000, 2000):
        store.append(spark, path, *batch_of(spark, [run(start + i, [job("build", 60, steps=STEPS)], created=month(7)) for i in range(10)]))
        after = on_disk(path)
        assert before.items() <= after.items()
        sizes.append(sum(after.values()) - sum(before.values()))
        before = after
    # The second batch is as large as the first, and a small part of the history, whatever run ids it has.
    assert abs(sizes[0] - sizes[1]) < 0.1 * sizes[0] < 0.05 * sum(before.values()) + 3000
    found = store.read_store(spark, path)
    assert [found[n].count() for n in ("runs", "jobs", "steps")] == [320, 320, 640]


def test_reading_a_month_opens_its_files_only(spark, tmp_path):
    path = str(tmp_path)
    for n in range(4):
        store.append(spark, path, *batch_of(spark, [run(100 * m + 10 * n + i, [job("build", 60, steps=STEPS)], created=dt.datetime(2026, 1 + m, 2 + n, i, tzinfo=dt.timezone.utc))
                                                   for i in range(5) for m in (range(3) if n else range(3, 6))]))
    since, until = dt.datetime(2026, 2, 1), dt.datetime(2026, 3, 1)
    found = store.read_store(spark, path, since, until)
    assert [found[n].count() for n in ("runs", "jobs", "steps")] == [15, 15, 30]
    of_month = {f.name for f in on_disk(path) if "month=2026-02" in str(f)}
    assert of_month and len(of_month) < len(on_disk(path)) / 3
    for name in store.TABLES:
        # Pruned segments are not listed at all, and in the others only the month's folder is scanned.
        scanned = found[name]._jdf.queryExecution().executedPlan().toString()
        assert "PartitionFilters: [" in scanned and "month" in scanned
    first = store.version(spark, path)["segments"][0]
    assert first["months"] == ["2026-04", "2026-06"]
    assert not any(first["id"] in f for n in store.TABLES for f in found[n].inputFiles())
    later = store.read_store(spark, path, dt.datetime(2026, 4, 2, 3), None)["runs"]
    assert sorted(r["run_id"] for r in later.collect()) == sorted([303, 304, *range(400, 405), *range(500, 505)])


def test_interleaved_writers_lose_nothing(spark, tmp_path, monkeypatch):
    path = str(tmp_path)
    store.append(spark, path, *batch_of(spark, [run(1)]))
    create, other = files.create, []

    def late(spark, name, text):
        # Another writer commits between this one's reading of the newest version and its own commit.
        if not other:
            other.append(True)
            store.append(spark, path, *batch_of(spark, [run(2, [job("b", 5)])]))
        return create(spark, name, text)

    monkeypatch.setattr(files, "create", late)
    assert store.append(spark, path, *batch_of(spark, [run(3, [job("c", 5)])])) == 3
    monkeypatch.undo()
    assert store.versions(spark, path) == [1, 2, 3] and other
    assert sorted(r["run_id"] for r in store.read_store(spark, path)["runs"].collect()) == [1, 2, 3]
    assert store.read_store(spark, path)["jobs"].count() == 2
    assert store.read_store(spark, path, number=1)["runs"].count() == 1
    assert not files.create(spark, f"{path}/log/{2:012d}.json", "{}")
    assert sorted(p.name for p in (tmp_path / "log").iterdir() if not p.name.endswith(".crc")) == [f"{v:012d}.json" for v in (1, 2, 3)]


def test_a_batch_number_counts_once(spark, tmp_path):
    path = str(tmp_path)
    one = batch_of(spark, [run(1, [job("a", 5)])])
    assert [store.append(spark, path, *one, source="s", batch=b) for b in (0, 0, 1, 0)] == [1, 1, 2, 2]
    assert store.append(spark, path, *one, source="t", batch=0) == 3
    empty = [df.limit(0) for df in one]
    assert store.append(spark, path, *empty) == 3 and store.append(spark, path, *empty, source="s", batch=2) == 4
    assert len(store.version(spark, path)["segments"]) == 3 and store.read_store(spark, path)["runs"].count() == 1


def test_compaction_keeps_what_is_read(spark, tmp_path):
    """Random listings and job pages, merged in every state of compaction, against a replay in plain Python."""
    path, rng = str(tmp_path), random.Random(2)
    state_runs, state_jobs = {}, {}
    for n in range(11):
        listed = {i: (rng.choice(["completed", "in_progress"]), n) for i in rng.sample(range(8), 3)}
        paged = {i: (rng.choice([True, False]), rng.sample(range(3), rng.randint(1, 2))) for i in rng.sample(range(8), 3)}
        made = [run(i, [job(f"j{k}", 10 + n) for k in paged[i][1]] if i in paged else [], status=s, attempt=n + 1, created=month(i % 3)) for i, (s, _) in listed.items()]
        r, j, s = batch_of(spark, made + [run(i, [job(f"j{k}", 10 + n) for k in ks], created=month(i % 3)) for i, (_, ks) in paged.items() if i not in listed])
        r = r.filter(F.col("run_id").isin(list(listed)))
        j = j.withColumn("job_id", 10 * F.col("run_id") + F.substring("name", 2, 1).cast("bigint"))
        s = j.select("job_id", F.lit(1).alias("number"), F.lit(f"v{n}").alias("name"), "status", "conclusion", "started_at", "completed_at")
        totals = spark.createDataFrame([(i, len(ks) + (0 if whole else 5)) for i, (whole, ks) in paged.items()], "run_id bigint, total bigint")
        for i, (status, _) in listed.items():
            if i not in state_runs or state_runs[i][0] != "completed" or i in paged:
                state_runs[i] = (status, n + 1)
        for i, (whole, ks) in paged.items():
            kept = {} if whole else state_jobs.get(i, {})
            state_jobs[i] = {**kept, **{k: n for k in ks}}
        store.append(spark, path, r, j, s, totals)
        if n in (4, 10):
            versions_before = store.version(spark, path)["segments"]
            plain = rows(store.read_store(spark, path))
            store.compact(spark, path, fan=3)
            assert len(store.version(spark, path)["segments"]) < len(versions_before)
            assert rows(store.read_store(spark, path)) == plain
    found = store.read_store(spark, path)
    assert {r["run_id"]: (r["status"], r["run_attempt"]) for r in found["runs"].collect()} == state_runs
    assert {(r["job_id"], r["name"]) for r in found["steps"].collect()} == {(10 * i + k, f"v{n}") for i, ks in state_jobs.items() for k, n in ks.items()}
    assert {r["job_id"] for r in found["jobs"].collect()} == {10 * i + k for i, ks in state_jobs.items() for k in ks}


def test_jobs_before_their_run_are_filed_by_compaction(spark, tmp_path):
    path = str(tmp_path)
    r, j, s = batch_of(spark, [run(1, [job("a", 5, steps=STEPS)], created=month(0)), run(2, created=month(-1)), run(3, created=month(-1))])
    store.append(spark, path, r.limit(0), j, s)
    store.append(spark, path, r, j.limit(0), s.limit(0))
    assert [x["unknown"] for x in store.version(spark, path)["segments"]] == [True, False]
    period = lambda: [df.count() for df in store.read_store(spark, path, month(0).replace(tzinfo=None), None).values()]
    assert period() == [1, 1, 2]
    store.compact(spark, path, fan=2)
    (one,) = store.version(spark, path)["segments"]
    assert not one["unknown"] and period() == [1, 1, 2]


def test_steps_in_their_jobs_are_stored_as_steps_apart(spark, tmp_path):
    r, j, s = batch_of(spark, [run(i, [job("a", 60, steps=STEPS), job("b", 5)], created=month(i % 3)) for i in range(6)] + [run(7)])
    r = r.filter("run_id <> 2")
    steps = s.groupBy("job_id").agg(F.collect_list(F.struct(*[c for c in s.columns if c != "job_id"])).alias("steps"))
    within = j.join(steps, "job_id", "left").withColumn("steps", F.when(F.col("name") == "a", F.col("steps")).otherwise(F.array()))
    store.append(spark, f"{tmp_path}/apart", r, j, s)
    store.append(spark, f"{tmp_path}/within", r, within)
    apart, within = (store.version(spark, f"{tmp_path}/{x}")["segments"][0] for x in ("apart", "within"))
    assert [apart[k] for k in ("rows", "runs", "months", "unknown")] == [within[k] for k in ("rows", "runs", "months", "unknown")]
    assert within["rows"] == {"runs": 6, "jobs": 12, "steps": 12} and within["unknown"]
    assert rows(store.read_store(spark, f"{tmp_path}/apart")) == rows(store.read_store(spark, f"{tmp_path}/within"))


def test_compaction_merges_only_what_several_segments_say(spark, tmp_path, monkeypatch):
    """Rows of runs of which one segment alone speaks are rewritten without windows or joins."""
    merged, seen = store._merged, []

    def spy(rows, refile=False):
        if refile:
            seen.append({name: sorted(r["run_id"] for r in df.collect()) for name, df in rows.items()})
        return merged(rows, refile)

    monkeypatch.setattr(store, "_merged", spy)
    for path, last in ((f"{tmp_path}/shared", 2), (f"{tmp_path}/apart", 3)):
        store.append(spark, path, *batch_of(spark, [run(i, [job("a", 5, steps=STEPS)], created=month(i)) for i in (1, 2)]))
        store.append(spark, path, *batch_of(spark, [run(i, [job("a", 9, steps=STEPS)], created=month(i)) for i in (last, 4)]))
        before = rows(store.read_store(spark, path))
        store.compact(spark, path, fan=2)
        assert len(store.version(spark, path)["segments"]) == 1
        assert rows(store.read_store(spark, path)) == before
    assert seen == [{"runs": [2, 2], "jobs": [2, 2], "steps": [2] * 4}]


@pytest.mark.skipif(not Path("/root/testdata/sf0.001").exists(), reason="needs the test tables")
def test_steps_are_derived_once(spark):
    """Spark would filter jobs by the size of their array of steps, and derive it for that."""
    plan = sample_history.steps(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "size(array" not in plan


@pytest.mark.parametrize("batches", [400])
def test_merges_rewrite_a_row_once_a_size(batches):
    """Sizes only: how often rows are rewritten, and how many segments are left."""
    segments, rewritten = [], 0
    for n in range(batches):
        segments.append({"id": n, "rows": {"runs": 100}})
        while group := store.due(segments, 8):
            total = sum(s["rows"]["runs"] for s in group)
            rewritten += total
            at = segments.index(group[0])
            segments[at : at + len(group)] = [{"id": group[0]["id"], "rows": {"runs": total}}]
    assert rewritten <= 3 * 100 * batches and len(segments) <= 24


def test_expiry_keeps_what_recent_versions_name(spark, tmp_path):
    path = str(tmp_path)
    for n in range(4):
        store.append(spark, path, *batch_of(spark, [run(n, [job("a", 5)])]))
    store.compact(spark, path, fan=2)
    everything = rows(store.read_store(spark, path))
    stray = tmp_path / "runs" / "segment=stray"
    stray.mkdir()
    assert store.expire(spark, path, keep=20) == [] and stray.exists()
    dropped = store.expire(spark, path, keep=1)
    assert len(dropped) >= 4 and len(store.versions(spark, path)) == 1 and stray.exists()
    assert rows(store.read_store(spark, path)) == everything
    assert store.expire(spark, path, keep=1, stray_hours=-1) == ["stray"] and not stray.exists()
    assert rows(store.read_store(spark, path)) == everything


def test_stream_commits_once_a_batch(spark, tmp_path):
    import json

    (tmp_path / "in").mkdir()
    listed = dict(id=1, workflow_id=1, status="completed", conclusion="success", run_attempt=1, created_at="2026-04-09T10:07:24Z")
    for n in range(3):
        (tmp_path / "in" / f"{n}.json").write_text(json.dumps({"workflow_runs": [dict(listed, id=n)]}))
        ingest.ingest(spark, str(tmp_path / "in"), str(tmp_path / "store"), str(tmp_path / "cp"))
    now = store.version(spark, str(tmp_path / "store"))
    assert now["version"] == 3 and list(now["sources"].values()) == [2]
    # A batch that the stream repeats after a lost checkpoint of its end is left out.
    pages = spark.read.schema(ingest.PAGE).option("multiLine", True).json(str(tmp_path / "in" / "2.json"))
    ingest.save_batch(pages, str(tmp_path / "store"), str(tmp_path / "cp"), 2)
    assert ingest.latest_version(spark, str(tmp_path / "store")) == 3
