import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as registry
from runlens.operators import outliers, quantiles, rank_test


def keyed(spark, groups):
    return spark.createDataFrame([(k, i, float(v)) for k, vs in groups.items() for i, v in enumerate(vs)], "k string, i int, v double")


def test_percentiles(spark):
    df = keyed(spark, {"a": range(1, 11), "b": [7]})
    points = {"p50": 50, "p95": 95, "q1": 25, "q3": 75}
    for bounded in (True, False):
        rows = {r["k"]: r for r in quantiles.percentiles(df, ["k"], "v", points, bounded).collect()}
        assert [round(rows["a"][p], 6) for p in points] == [5.5, 9.55, 3.25, 7.75]
        assert [rows["b"][p] for p in points] == [7.0] * 4


def test_sliced_percentiles_match_numpy(spark):
    rng = np.random.default_rng(5)
    groups = {"wide": rng.normal(0, 1e4, 997), "tail": np.exp(rng.normal(0, 3, 500)), "ties": rng.integers(0, 3, 300), "narrow": 1e6 + rng.random(200)}
    points = {f"p{p}": p for p in (0, 1, 25, 50, 90, 99, 100)}
    hist = quantiles.histogram(keyed(spark, groups), ["k"], "v")
    for r in quantiles.sliced_percentiles(hist, ["k"], "v", points, per_e_fold=4).collect():
        for name, p in points.items():
            assert r[name] == pytest.approx(np.percentile(groups[r["k"]].astype(float), p), rel=1e-12)


def test_outliers(spark):
    near = [95 + i % 11 for i in range(20)]
    df = keyed(spark, {"one": [*near, 500], "same": [5] * 30, "few": [1, 1, 1, 900], "fast": [*near, 1], "zero": [0, 0, 0, 0, *near[:4]]})
    for find in (outliers.log_iqr_outliers, outliers.mad_outliers):
        for bounded in (True, False):
            assert [(r["k"], r["v"]) for r in find(df, ["k"], "v", bounded=bounded).collect()] == [("one", 500.0)]
    ranks = outliers.percentile_rank(keyed(spark, {"a": range(1, 11)}), ["k"], "v").collect()
    assert {r["v"]: r["rank"] for r in ranks if r["v"] in (1.0, 10.0)} == {1.0: 0.0, 10.0: 90.0}


def test_clamp(spark):
    near = [95 + i % 11 for i in range(20)]
    df = keyed(spark, {"one": [*near, 2000], "few": [1, 2, 3, 900], "flat": [5, 5, 5, 5, 5, 5, 5, 80]})
    once = outliers.clamp_outliers(df, ["k"], "v", 4.0)
    rows = once.collect()
    assert all(r["clamped"] == r["v"] for r in rows if r["v"] != 2000)
    assert 100 < next(r["clamped"] for r in rows if r["v"] == 2000) < 200
    again = outliers.clamp_outliers(once.select("k", "i", F.col("clamped").alias("v")), ["k"], "v", 4.0)
    assert all(r["clamped"] == r["v"] for r in again.collect())


def brute_u(a, b):
    u1 = sum((x > y) + (x == y) / 2 for x in a for y in b)
    return min(u1, len(a) * len(b) - u1)


def test_rank_sum(spark):
    rng = random.Random(3)
    groups = {"sep": ([1, 2, 3], [4, 5, 6]), "empty": ([1, 2], []), "ties": ([1, 1, 2, 5], [1, 2, 2, 9, 9]),
              "large": ([rng.randint(0, 50) for _ in range(40)], [rng.randint(10, 70) for _ in range(30)]),
              "mixed": ([rng.random() for _ in range(8)], [rng.random() + 0.3 for _ in range(40)])}
    rows = [(k, g == 0, float(x)) for k, pair in groups.items() for g, xs in enumerate(pair) for x in xs]
    df = spark.createDataFrame(rows, "k string, first boolean, v double")
    found = {r["k"]: r for r in rank_test.rank_sum_test(df, ["k"], F.col("first"), "v").collect()}
    for k, (a, b) in groups.items():
        assert found[k]["u"] == brute_u(a, b)
    assert found["sep"]["p_value"] == pytest.approx(0.1) and found["sep"]["method"] == "exact"
    assert (found["empty"]["u"], found["empty"]["p_value"]) == (0.0, 1.0)
    n1, n2, u = 40, 30, found["large"]["u"]
    z = abs(u - n1 * n2 / 2) / math.sqrt(n1 * n2 * (n1 + n2 + 1) / 12)
    assert found["large"]["p_value"] == pytest.approx(math.erfc(z / math.sqrt(2)), rel=1e-9)
    assert found["mixed"]["method"] == "permutation" and 0 < found["mixed"]["p_value"] < 1


def test_exact_test_draws_no_shuffles(spark, monkeypatch):
    rows = [(k, i % 3 == 0, float(i * 7 % n)) for k, n in (("exact", 12), ("permutation", 45), ("normal", 90)) for i in range(n)]
    rows.append(("none", True, 1.0))
    df = spark.createDataFrame(rows, "k string, first boolean, v double")
    whole = {r["k"]: r for r in rank_test.rank_sum_test(df, ["k"], F.col("first"), "v").collect()}
    monkeypatch.setattr(rank_test, "permutation_p", lambda *_: pytest.fail("shuffles were drawn"))
    found = {r["k"]: r for r in rank_test.exact_test(df, ["k"], F.col("first"), "v").collect()}
    for k in whole:
        assert found[k][:-1] == whole[k][:-1] and found[k]["method"] == k
        assert found[k]["p_value"] == (whole[k]["p_value"] if k in ("exact", "none") else None)
    orders = spark.read.parquet("/root/testdata/sf0.01/orders.parquet").groupBy("o_custkey").count()
    assert registry.queries()["f4_exact_p"](spark, "/root/testdata/sf0.01").count() == orders.count()


def test_exact_table_matches_enumeration():
    table = rank_test._exact_shares().set_index(["n1", "n2", "u_floor"])["exact_p"]
    for n1, n2 in [(1, 1), (3, 3), (2, 6), (5, 4)]:
        us = []
        for ranks in itertools.combinations(range(1, n1 + n2 + 1), n1):
            u1 = sum(ranks) - n1 * (n1 + 1) / 2
            us.append(min(u1, n1 * n2 - u1))
        for u in range(n1 * n2 // 2 + 1):
            assert table[(n1, n2, u)] == pytest.approx(sum(x <= u for x in us) / len(us))


def test_shuffles_agree_with_exact_and_repeat(spark):
    table = rank_test._exact_shares().set_index(["n1", "n2", "u_floor"])["exact_p"]
    cases = [(5, 12, 12), (8, 10, 20), (3, 9, 4), (1, 6, 1), (9, 9, 30)]
    ranked = spark.createDataFrame([(c, v, 1, v, n1 + n2) for c, (n1, n2, _) in enumerate(cases) for v in range(n1 + n2)],
                                   "case int, v int, n bigint, below bigint, total bigint")
    tests = spark.createDataFrame([(c, t, n1, n1 + n2, float(u), f"{c}|{t}") for c, (n1, n2, u) in enumerate(cases) for t in range(2)],
                                  "case int, test int, _k bigint, _n bigint, _u double, _seed string")
    shares = [{(r["case"], r["test"]): r["shuffled_p"] for r in rank_test.permutation_p(t, ranked, ["case"], ["test"]).collect()}
              for t in (tests, tests.repartition(7))]
    assert shares[0] == shares[1] and len(shares[0]) == 2 * len(cases)
    for c, case in enumerate(cases):
        p = table[case]
        for t in range(2):
            assert abs(shares[0][c, t] - p) <= 3.5 * math.sqrt(p * (1 - p) / rank_test.SHUFFLES)
        assert shares[0][c, 0] != shares[0][c, 1]


def test_draws_are_different_numbers_and_even(spark):
    rows = spark.range(3000).select(F.col("id").alias("d"), F.lit(7).alias("k"), F.lit(23).alias("n"))
    rows = rows.withColumn("h", rank_test._hashes(F.lit("seed"), F.col("d"), F.col("k")))
    drawn = [r[0] for r in rows.select(rank_test._drawn(F.col("h"), F.col("k"), F.col("n"))).collect()]
    assert all(len(set(x)) == 7 and set(x) <= set(range(23)) for x in drawn)
    pairs = np.zeros((23, 23))
    for x in drawn:
        pairs[np.ix_(x, x)] += 1
    single, expected = np.diag(pairs), 3000 * 7 / 23
    assert ((single - expected) ** 2 / expected).sum() < 60
    together, wanted = pairs[np.triu_indices(23, 1)], 3000 * 7 * 6 / (23 * 22)
    assert ((together - wanted) ** 2 / wanted).sum() < 253 + 5 * math.sqrt(2 * 253)


def test_ranks_of_a_large_tied_key(spark):
    """Spans of row numbers: one value with most of the rows, and as many distinct ones as rows."""
    ties = spark.createDataFrame([("t", 1.0, 50_000, 0, 60_000), ("t", 2.0, 10_000, 50_000, 60_000)], "k string, v double, n bigint, below bigint, total bigint")
    many = spark.range(60_000).select(F.lit("m").alias("k"), F.col("id").cast("double").alias("v"), F.lit(1).cast("bigint").alias("n"),
                                      F.col("id").alias("below"), F.lit(60_000).cast("bigint").alias("total"))
    tests = spark.createDataFrame([("t", 3, 60_000, 40_000.0, "x"), ("m", 3, 60_000, 40_000.0, "y")], "k string, _k bigint, _n bigint, _u double, _seed string")
    found = {r["k"]: r["shuffled_p"] for r in rank_test.permutation_p(tests, ties.unionAll(many), ["k"], []).collect()}
    # U is at most 40,000 of 180,000 when the mean of three ranks is far out; for ties it takes three rows of the rarer value.
    assert abs(found["t"] - (1 / 6) ** 3) < 0.006
    rng = np.random.default_rng(1)
    u = rng.integers(0, 60_000, (200_000, 3)).sum(axis=1)
    assert abs(found["m"] - np.mean(np.minimum(u, 180_000 - u) <= 40_000)) < 0.02


def test_a_crowded_range_is_cut(spark):
    """Distinct values within a thousandth lie in one slice by size; its parts stay small."""
    df = spark.range(40_000).select(F.lit("k").alias("k"), (1000 + F.col("id") / 4e7).alias("v"))
    hist = quantiles.histogram(df, ["k"], "v")
    cut = quantiles._cut(hist, ["k"], "v", quantiles.PER_E_FOLD)
    assert cut.select("_slice").distinct().count() == 1
    assert max(r["count"] for r in cut.groupBy("_slice", "_part").count().collect()) <= 20
    row = quantiles.sliced_percentiles(hist, ["k"], "v", {"p10": 10, "p50": 50, "p99": 99}).first()
    for name, p in (("p10", 0.1), ("p50", 0.5), ("p99", 0.99)):
        assert row[name] == pytest.approx(1000 + p * 39_999 / 4e7, abs=1e-9)
    below = quantiles.below_counts(hist, ["k"], "v", bounded=False)
    assert below.filter(F.abs(F.col("below") - F.round((F.col("v") - 1000) * 4e7)) > 0).isEmpty()
