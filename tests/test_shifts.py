import datetime as dt
import random
import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F

from runlens.operators import shifts
from runlens.operators.series import positions, sort_key

T0 = dt.datetime(2026, 1, 1)


def series(spark, groups):
    rows = [(k, T0 + dt.timedelta(minutes=i), i, float(v)) for k, vs in groups.items() for i, v in enumerate(vs)]
    random.Random(1).shuffle(rows)
    return spark.createDataFrame(rows, "k string, ts timestamp_ntz, id long, v double")


def cusum(spark, groups, **more):
    found = shifts.cusum(series(spark, groups), ["k"], "ts", ["id"], "v", "id", **more).collect()
    return {k: sorted((r["idx"], r["direction"]) for r in found if r["k"] == k) for k in groups}


def brute(data, threshold=4.0, m=5):
    sd = lambda xs: statistics.stdev(xs) if len(xs) > 1 else 0.0
    if len(data) < 2 * m:
        return []
    mean, sigma = statistics.fmean(data[:m]), sd(data[:m]) or sd(data)
    if sigma == 0:
        return []
    hi = lo = 0.0
    last, out = 0, []
    for i in range(m, len(data)):
        hi, lo = max(0, hi + data[i] - mean - sigma / 2), max(0, lo + mean - data[i] - sigma / 2)
        if (hi > threshold * sigma or lo > threshold * sigma) and i - last >= m:
            ahead = data[i : i + m]
            out.append((i, "speedup" if statistics.fmean(ahead) < statistics.fmean(data[last:i]) else "slowdown"))
            hi = lo = 0.0
            mean, sigma, last = statistics.fmean(ahead), sd(ahead) or sd(data), i
    return out


def noise(seed, n, centre, width=3):
    rng = random.Random(seed)
    return [centre + rng.randint(-width, width) for _ in range(n)]


GROUPS = {
    "jump": [100 + i % 5 - 2 for i in range(20)] + [150 + i % 5 - 2 for i in range(20)],
    "drop": noise(3, 20, 150) + noise(4, 20, 100),
    "flat": [100] * 40,
    "flat start": [100] * 10 + noise(5, 30, 130),
    "up and down": noise(6, 20, 100) + noise(7, 20, 180) + noise(8, 20, 90),
    "short": noise(9, 9, 100),
    "noisy": [random.Random(10).expovariate(1 / 50) for _ in range(3)] + noise(11, 400, 50, 45),
    "constant tail": noise(12, 20, 100) + [160] * 12,
}


def test_cusum_matches_plain_loop(spark):
    found = cusum(spark, GROUPS)
    for k, data in GROUPS.items():
        assert found[k] == brute([float(x) for x in data]), k
    assert len(found["jump"]) >= 1 and 19 <= found["jump"][0][0] <= 24 and found["jump"][0][1] == "slowdown"
    assert found["flat"] == [] and found["short"] == []


def test_pieces_do_not_change_the_result(spark):
    """Small pieces take the carrying and refolding path; quiet stretches span many of them."""
    rng = np.random.default_rng(4)
    groups = dict(GROUPS, quiet=list(np.concatenate([[1, 100, 1, 100, 50], 50 + rng.normal(0, 5, 300)])))
    assert cusum(spark, groups, piece_rows=16) == cusum(spark, groups)


def test_offset_does_not_hide_a_shift(spark):
    far = {k: [v + 1e9 for v in GROUPS[k]] for k in ("jump", "drop", "flat start")}
    assert cusum(spark, far) == {k: brute([float(x) for x in v]) for k, v in far.items()}
    assert all(cusum(spark, far).values())


def brute_report(data, idx, following):
    before, after = data[:idx], data[idx:]
    u1 = sum((x > y) + (x == y) / 2 for x in before for y in after)
    q1, q3 = np.percentile(before, [25, 75])
    segment = data[idx:following]
    return dict(
        before_mean=statistics.fmean(before), after_mean=statistics.fmean(after), u=min(u1, len(before) * len(after) - u1),
        overlap=sum(q1 <= x <= q3 for x in after) / len(after) if len(before) >= 4 else 0.0, post_runs=len(segment),
        post_cv=(statistics.stdev(segment) if len(segment) > 1 else 0.0) / statistics.fmean(segment),
    )


def test_report_matches_brute_force(spark):
    df = series(spark, GROUPS)
    whole = shifts.shift_report(df, ["k"], "ts", ["id"], "v", "id").orderBy("k", "idx").collect()
    assert len(whole) > 5
    for k, data in GROUPS.items():
        rows = [r for r in whole if r["k"] == k]
        for r, n in zip(rows, [*rows[1:], None]):
            expected = brute_report([float(x) for x in data], r["idx"], n["idx"] if n else len(data))
            for name, value in expected.items():
                assert r[name] == pytest.approx(value, rel=1e-9, abs=1e-9), (k, name)
    pieces = shifts.shift_report(df, ["k"], "ts", ["id"], "v", "id", piece_rows=32).orderBy("k", "idx").collect()
    for a, b in zip(whole, pieces, strict=True):
        for name, value in a.asDict().items():
            assert b[name] == (pytest.approx(value, rel=1e-9, abs=1e-12) if isinstance(value, float) else value), name


def test_one_busy_second_is_spread_over_tasks(spark):
    """A series whose rows nearly all have one stamp: places are right and tasks even."""
    rows = spark.range(40_000).selectExpr("'k' AS k", "timestamp_seconds(IF(id % 100 = 0, id, 1000000)) AS ts", "(id * 7919) % 40009 AS tie", "CAST(id AS double) AS v")
    rows = rows.unionAll(rows.limit(50).selectExpr("'small' AS k", "ts", "tie", "v"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        placed = positions(rows, ["k"], "ts", ["tie"])
        tasks = [n for n in placed.rdd.mapPartitions(lambda p: [sum(1 for _ in p)]).collect() if n]
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(tasks) >= 4 and max(tasks) < 0.4 * sum(tasks)
    found = placed.toPandas()
    for k, n in (("k", 40_000), ("small", 50)):
        own = found[found["k"] == k].sort_values(["ts", "tie"])
        assert own["pos"].tolist() == list(range(n))
    assert positions(rows.limit(0), ["k"], "ts", ["tie"]).count() == 0


def test_points_are_reduced_where_they_lie(spark, monkeypatch):
    """No step of the detection moves the values of pieces through a shuffle, or folds them point by point in an expression."""
    plans = []

    def seen(write):
        return lambda df: plans.append(df._jdf.queryExecution().optimizedPlan().toString()) or write(df)

    for name in ("checkpoint", "stored"):
        if hasattr(shifts, name):
            monkeypatch.setattr(shifts, name, seen(getattr(shifts, name)))
    quiet = {"quiet": [1, 100, 1, 100, 50, *noise(13, 300, 50)]}
    assert cusum(spark, quiet, piece_rows=16) == {"quiet": brute([float(x) for x in quiet["quiet"]])}
    assert len(plans) > 4 and not [p for p in plans if "aggregate(" in p and "lambda" in p]


def test_pieces_cut_by_partitions(spark):
    """Partitions that hold a few points of a series each, so that its first pieces are shorter than the baseline."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "24")
    few = {k: GROUPS[k] for k in ("jump", "flat start")}
    try:
        assert cusum(spark, few) == {k: brute([float(x) for x in data]) for k, data in few.items()}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        spark.conf.set("spark.sql.shuffle.partitions", "4")


@pytest.mark.parametrize("kind", ["timestamp", "timestamp_ntz"])
def test_sort_key_tells_points_apart_and_rises_with_the_stamp(spark, kind):
    # Around a change to summer time and one back, before 1970, far ahead and without a stamp.
    texts = [None, "1960-01-01 00:00:00", "1969-12-31 23:59:59", "1970-01-01 00:00:00", "2026-03-29 01:59:00", "2026-03-29 02:30:00",
             "2026-03-29 03:10:00", "2026-10-25 01:59:00", "2026-10-25 02:30:00", "2026-10-25 03:10:00", "2107-01-01 00:00:00", "2300-01-01 00:00:00"]
    zone = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "Europe/Berlin")
        df = spark.createDataFrame([(k, t) for k in ("a", "b") for t in texts], "k string, t string").withColumn("t", F.col("t").cast(kind))
        rows = df.select("k", "t", sort_key(df, ["k"], "t").alias("s")).orderBy("k", "t").collect()
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)
    for k in ("a", "b"):
        numbers = [r["s"] for r in rows if r["k"] == k]
        assert numbers == sorted(numbers) and len({n >> 32 for n in numbers}) == 1 and len(set(numbers)) >= 8 - (kind == "timestamp")
    assert len({r["s"] >> 32 for r in rows}) == 2
