"""A stored history as a log of segments.

What a batch says is written once, as a segment: runs, jobs and steps by month of their run and in order of run
id. A version is one small file that lists the segments that count, with the span of run ids and months that each
holds; it is created only if it is not there yet, so of two writers one repeats its commit on the other's version.
Reading opens the segments and months that the wanted period can be in, and merges what they say about a run. So
a batch costs as much as itself however long the history is, and what it costs later is compaction: neighbouring
segments of like size are merged into one, which rewrites a row once for each step of ``FAN`` in size.

What a segment says about a run can be merged in any grouping of neighbours:

* a listed run that is complete stays as it is when it is listed again, unless job pages came with the listing
  (``loaded``);
* jobs take the place of all earlier jobs of their run if there are as many as the listing announced (``whole``),
  and else of those of the same id;
* steps go with the row of their job that they came with.

A run's creation time is taken to stay the same, as it names the month under which all about the run is filed;
rows whose run is not in their batch are filed as ``unknown``, which every reading opens, until compaction.
"""

import datetime as dt
import json
from collections.abc import Callable
from functools import reduce
from typing import Any
from uuid import uuid4

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from runlens.operators.prep import is_completed
from runlens.session import stored
from runlens.sources import files
from runlens.sources.tables import TABLES, with_defaults

FAN = 8
UNKNOWN = "unknown"
SPREAD = 256  # parts for jobs whose run is not in their batch
_OWN = {
    "runs": [T.StructField("loaded", T.BooleanType())],
    "jobs": [T.StructField("whole", T.BooleanType())],
    "steps": [T.StructField("run_id", T.LongType())],
}
_PLACE = [T.StructField("segment", T.StringType()), T.StructField("month", T.StringType())]


def _log(store: str, version: int) -> str:
    return f"{store}/log/{version:012d}.json"


def versions(spark: SparkSession, store: str) -> list[int]:
    """Numbers of the versions that are kept, ascending."""
    return sorted(int(name.removesuffix(".json")) for name in files.names(spark, f"{store}/log") if name.endswith(".json") and name[0] != ".")


def version(spark: SparkSession, store: str, number: int | None = None) -> dict[str, Any]:
    """A version, the newest by default; number 0 without segments for a new store."""
    known = versions(spark, store)
    if number is None and not known:
        return {"version": 0, "sources": {}, "segments": []}
    return json.loads(files.read(spark, _log(store, known[-1] if number is None else number)))


def commit(spark: SparkSession, store: str, change: Callable[[dict], dict | None]) -> int:
    """Makes ``change(newest version)`` the next version, again if another writer was first; None changes nothing."""
    while True:
        now = version(spark, store)
        new = change(now)
        if new is None:
            return now["version"]
        number = now["version"] + 1
        if files.create(spark, _log(store, number), json.dumps({**new, "version": number})):
            return number


def _month(stamp: Column) -> Column:
    return F.coalesce(F.date_format(stamp, "yyyy-MM"), F.lit(UNKNOWN))


def _dealt(df: DataFrame) -> DataFrame:
    return df.repartitionByRange("month", "run_id")


def _write_segment(spark: SparkSession, store: str, tables: dict[str, DataFrame | Callable], tied: bool) -> dict[str, Any] | None:
    """Writes tables that have their ``month`` as they are dealt out; gives the segment's entry, or None if all are empty.

    A function makes a table from the folders of those written before it. ``tied`` says that steps have the run and month
    of their job, and that no step is without one.
    """
    entry = {"id": uuid4().hex, "rows": {}, "runs": None, "months": None, "tied": tied}
    runs, months = [], set()
    folder = lambda name: f"{store}/{name}/segment={entry['id']}"
    for name, df in tables.items():
        path = folder(name)
        df = df(folder) if callable(df) else df
        df.sortWithinPartitions("month", "run_id").write.partitionBy("month").parquet(path)
        written = spark.read.schema("run_id bigint, month string").parquet(path)
        # Months are compared once each, not row by row.
        of_month = written.groupBy("month").agg(F.count("*").alias("n"), F.min("run_id").alias("low"), F.max("run_id").alias("high"))
        seen = of_month.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.min("low").alias("low"), F.max("high").alias("high"),
                            F.min("month").alias("first"), F.max(F.when(F.col("month") != UNKNOWN, F.col("month"))).alias("last"),
                            F.max((F.col("month") == UNKNOWN).cast("int")).alias("unknown")).first()
        entry["rows"][name] = seen["n"]
        if seen["n"]:
            runs += [seen["low"], seen["high"]]
            months |= {m for m in (seen["first"], seen["last"]) if m} | ({UNKNOWN} if seen["unknown"] else set())
    known = sorted(months - {UNKNOWN})
    entry |= {"runs": [min(runs), max(runs)] if runs else None, "months": [known[0], known[-1]] if known else None, "unknown": UNKNOWN in months}
    return entry if any(entry["rows"].values()) else None


def append(spark: SparkSession, store: str, runs: DataFrame, jobs: DataFrame, steps: DataFrame | None = None,
           totals: DataFrame | None = None, source: str | None = None, batch: int | None = None) -> int:
    """Adds a batch as a segment of its own and returns the version that has it.

    ``runs``, ``jobs`` and ``steps`` have one row per key; steps that name their ``run_id`` are filed by it, and else by
    that of their job. Without ``steps`` they lie in the jobs, as an array ``steps``, and are dealt
    out with them. ``totals`` (run_id, total) says how many jobs a run has;
    without it the jobs of a run are all its jobs. ``batch`` numbers the batches of ``source`` upwards: one that is
    stored already is not added again.
    """
    seen = lambda now: batch is not None and now["sources"].get(source, -1) >= batch
    now = version(spark, store)
    if seen(now):
        return now["version"]
    placed = runs.groupBy("run_id").agg(_month(F.min("created_at")).alias("month"))
    if steps is None:
        # Bounds are drawn from the runs alone, and jobs go where their run does: to as many parts as a shuffle has, since
        # by what runs take up themselves they would be too few.
        parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
        placed = stored(placed.repartitionByRange(parts, "month", "run_id").withColumn("part", F.spark_partition_id()))
    filed = lambda df: df.join(placed, "run_id", "left").withColumn("month", F.coalesce("month", F.lit(UNKNOWN)))
    counted = jobs.groupBy("run_id").agg(F.count("*").alias("_n"))
    if totals is None:
        filed_jobs = filed(jobs.withColumn("whole", F.lit(True)))
    else:
        whole = counted.join(totals, "run_id", "left").select("run_id", F.coalesce(F.col("_n") >= F.col("total"), F.lit(False)).alias("whole"))
        filed_jobs = filed(jobs.join(whole, "run_id"))
    # Jobs are written first, so that runs read which of them have jobs from there.
    loaded = lambda folder: runs.join(
        spark.read.schema("run_id bigint").parquet(folder("jobs")).distinct().withColumn("loaded", F.lit(True)), "run_id", "left")
    listed = lambda folder: _dealt(loaded(folder).withColumns({
        "loaded": F.coalesce("loaded", F.lit(False)), "month": _month(F.col("created_at"))}))
    tied = steps is None or "run_id" not in steps.columns
    if steps is None:
        # Dealt out with their steps in the row. Spark would filter empty arrays ahead, where it has to derive them once more.
        to = F.coalesce("part", F.pmod(F.hash("run_id"), F.lit(SPREAD)))
        own = filed_jobs.select("run_id", "job_id", "month", "part", "steps").repartition(to).select(
            "run_id", "job_id", "month", F.explode_outer("steps").alias("step"))
        out = {"jobs": filed_jobs.drop("steps").repartition(to).drop("part"),
               "steps": own.filter("step IS NOT NULL").select("run_id", "job_id", "month", "step.*")}
    else:
        filed_steps = steps.join(filed_jobs.select("job_id", "run_id", "month"), "job_id") if tied else filed(steps)
        out = {"jobs": _dealt(filed_jobs), "steps": _dealt(filed_steps)}
    entry = _write_segment(spark, store, {**out, "runs": listed}, tied)

    def change(now):
        if seen(now) or (entry is None and batch is None):
            return None
        sources = {**now["sources"], **({source: batch} if batch is not None else {})}
        return {"sources": sources, "segments": now["segments"] + ([{**entry, "at": now["version"] + 1}] if entry else [])}

    return commit(spark, store, change)


def _raw(spark: SparkSession, store: str, name: str, segments: list[dict], months: tuple[str, str] | None) -> DataFrame:
    """Rows of a table in some segments with ``at``, the place of their segment in the log."""
    schema = T.StructType([*TABLES[name].fields, *_OWN[name], *_PLACE])
    filled = [s for s in segments if s["rows"][name]]
    if not filled:
        return spark.createDataFrame([], schema).withColumn("at", F.lit(0))
    rows = spark.read.schema(schema).option("basePath", f"{store}/{name}").parquet(*[f"{store}/{name}/segment={s['id']}" for s in filled])
    if months:
        rows = rows.filter(F.col("month").between(*months) | (F.col("month") == UNKNOWN))
    # An entry per segment; compaction keeps them few.
    order = F.create_map(*[F.lit(x) for s in filled for x in (s["id"], s["at"])])
    return rows.withColumn("at", order[F.col("segment")].cast("bigint"))


def _merged(rows: dict[str, DataFrame], refile: bool = False) -> dict[str, DataFrame]:
    """What segments say together: a row per run, job and step, with the flags of the segments as one.

    ``refile`` sets the month of jobs and steps to that of their run, where it is listed.
    """
    of_run = Window.partitionBy("run_id")
    since = lambda flag: F.coalesce(F.max(F.when(F.col(flag), F.col("at"))).over(of_run), F.lit(-1))
    done = is_completed()
    # From the last listing with jobs on, the first complete row, or else the last one.
    best = F.row_number().over(of_run.orderBy(done.desc(), F.when(done, F.col("at")).otherwise(-F.col("at"))))
    runs = rows["runs"].withColumn("_since", since("loaded")).filter("at >= _since")
    runs = runs.withColumn("_best", best).filter("_best = 1").withColumn("loaded", F.col("_since") >= 0).drop("_since", "_best")
    newest = F.row_number().over(Window.partitionBy("job_id").orderBy(F.desc("at")))
    jobs = rows["jobs"].withColumn("_since", since("whole")).filter("at >= _since")
    jobs = jobs.withColumn("_newest", newest).filter("_newest = 1").withColumn("whole", F.col("_since") >= 0).drop("_since", "_newest")
    steps = rows["steps"]
    if refile:
        runs = stored(runs)
        months = runs.select("run_id", F.col("month").alias("_month"))
        jobs = stored(jobs.join(months, "run_id", "left").withColumn("month", F.coalesce("_month", "month")).drop("_month"))
        # Steps take the run and month of their job with the row that they go with: no join by run of their own.
        steps = steps.drop("run_id", "month").join(jobs.select("job_id", "at", "run_id", "month"), ["job_id", "at"])
    else:
        steps = steps.join(jobs.select("job_id", "at"), ["job_id", "at"])
    return {"runs": runs, "jobs": jobs, "steps": steps}


def _shared_runs(rows: dict[str, DataFrame]) -> DataFrame:
    """Runs of which several segments speak, or that have a job of which several rows speak."""
    said = rows["runs"].select("run_id", "at", F.lit(1).alias("row")).unionAll(rows["jobs"].select("run_id", "at", F.lit(0)))
    runs = said.groupBy("run_id").agg(F.min("at").alias("low"), F.max("at").alias("high"), F.sum("row").alias("n"))
    jobs = stored(rows["jobs"].groupBy("job_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("job_id"))
    moved = rows["jobs"].select("job_id", "run_id").join(jobs, "job_id", "left_semi").select("run_id")
    return stored(runs.filter("low < high OR n > 1").select("run_id").unionAll(moved).distinct())


def _merged_apart(rows: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """As ``_merged`` with ``refile``, of segments whose steps are tied to their jobs: what one segment alone says stays as it is."""
    shared = _shared_runs(rows)
    if shared.isEmpty():
        return rows
    merged = _merged({name: df.join(shared, "run_id", "left_semi") for name, df in rows.items()}, refile=True)
    return {name: df.join(shared, "run_id", "left_anti").unionByName(merged[name]) for name, df in rows.items()}


def read_store(spark: SparkSession, store: str, since: dt.datetime | None = None, until: dt.datetime | None = None,
               number: int | None = None) -> dict[str, DataFrame]:
    """The tables of a version (the newest by default), of all runs or of those created in a period.

    Jobs and steps of runs that are not listed are given for all runs only. ``until`` is exclusive.
    """
    segments, months = version(spark, store, number)["segments"], None
    if since is not None or until is not None:
        # The months by the session's clock, as they were written.
        begin, end = (F.date_format(F.lit(x), "yyyy-MM") if x is not None else F.lit(other) for x, other in ((since, "0000-01"), (until, "9999-12")))
        months = tuple(spark.range(1).select(begin.alias("a"), end.alias("b")).first())
        segments = [s for s in segments if s["unknown"] or (s["months"] and s["months"][0] <= months[1] and s["months"][1] >= months[0])]
    found = _merged({name: _raw(spark, store, name, segments, months) for name in TABLES})
    if months:
        created = F.col("created_at")
        inside = [created >= F.lit(since)] * (since is not None) + [created < F.lit(until)] * (until is not None)
        found["runs"] = found["runs"].filter(reduce(Column.__and__, inside))
        wanted = found["runs"].select("run_id")
        for name in ("jobs", "steps"):
            found[name] = found[name].join(wanted, "run_id", "left_semi")
    return {name: with_defaults(df, TABLES[name]) for name, df in found.items()}


def due(segments: list[dict], fan: int = FAN) -> list[dict]:
    """Neighbours to merge: the first that hold ``fan`` segments of one size and smaller ones only, smallest sizes first.

    Sizes are powers of ``fan`` in rows, so each merge makes a segment of the next size.
    """
    sizes = []
    for s in segments:
        rows, size = sum(s["rows"].values()), 0
        while rows >= fan:
            rows, size = rows // fan, size + 1
        sizes.append(size)
    for most in sorted(set(sizes)):
        begin = 0
        for end in range(len(segments) + 1):
            if end == len(segments) or sizes[end] > most:
                if sizes[begin:end].count(most) >= fan:
                    return segments[begin:end]
                begin = end + 1
    return []


def compact(spark: SparkSession, store: str, fan: int = FAN) -> int:
    """Merges neighbouring segments of like size while there are ``fan`` of them; returns the version after it.

    A merge that another writer has made meanwhile is given up.
    """
    while group := due(version(spark, store)["segments"], fan):
        ids = [s["id"] for s in group]
        rows = {name: _raw(spark, store, name, group, None) for name in TABLES}
        merged = _merged_apart(rows) if all(s.get("tied") for s in group) else _merged(rows, refile=True)
        entry = _write_segment(spark, store, {name: _dealt(df.drop("segment", "at")) for name, df in merged.items()}, tied=True)

        def change(now, ids=ids, entry=entry, last=group[-1]["at"]):
            places = [i for i, s in enumerate(now["segments"]) if s["id"] in ids]
            if len(places) < len(ids):
                return None
            rest = [s for s in now["segments"] if s["id"] not in ids]
            return {"sources": now["sources"], "segments": sorted([*rest, {**entry, "at": last}], key=lambda s: s["at"])}

        commit(spark, store, change)
    return version(spark, store)["version"]


def expire(spark: SparkSession, store: str, keep: int = 10, stray_hours: float = 48.0) -> list[str]:
    """Drops all versions but the newest ``keep`` and the segments that only they name; returns the ids of these.

    Segments that no version names, left by writers that did not commit, go when they are ``stray_hours`` old.
    """
    known = versions(spark, store)
    kept, gone = known[-keep:], known[:-keep]
    used = {s["id"] for v in kept for s in version(spark, store, v)["segments"]}
    named = {s["id"] for v in gone for s in version(spark, store, v)["segments"]}
    limit = 1000 * (dt.datetime.now(dt.timezone.utc).timestamp() - 3600 * stray_hours)
    there = {name: {n.removeprefix("segment="): t for n, t in files.names(spark, f"{store}/{name}").items()} for name in TABLES}
    stray = {i for found in there.values() for i, t in found.items() if t < limit} - named
    dropped = sorted((named | stray) - used)
    for v in gone:
        files.delete(spark, _log(store, v))
    for name, found in there.items():
        for i in dropped:
            if i in found:
                files.delete(spark, f"{store}/{name}/segment={i}")
    return dropped
