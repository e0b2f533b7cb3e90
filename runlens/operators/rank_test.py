"""Two-sample rank-sum test per key.

Where one sample is small and the other not, p is the share of 10,000 shuffles. A shuffle is drawn by counters:
place i of shuffle d of a test is a hash of the test's seed, d and i, so every engine and every partitioning draws
the same. Places are numbers of rows; each is looked up among the ranks of its key by join, in spans of numbers,
so no row or task holds the ranks of a key.
"""

from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from runlens.operators.quantiles import below_counts, histogram
from runlens.session import checkpoint

EXACT_MAX = 20
SHUFFLES = 10_000
SPANS = 4096  # of the row numbers of a key
_BLOCK = 100  # shuffles that one row draws


def rank_sum_u(df: DataFrame, keys: list[str], first: Column, value: str, bounded: bool = False) -> DataFrame:
    """``n1``, ``n2`` and U = min(U1, U2) per key; ``first`` tells the rows of the first sample.

    Ties take their mean rank. Ranks come from value counts, so no rows are sorted. ``bounded`` is as for
    percentiles.
    """
    hist = (
        df.filter(F.col(value).isNotNull())
        .groupBy(*keys, value)
        .agg(F.count(F.lit(1)).alias("n"), F.count_if(first).alias("_n1"))
    )
    mid_rank = F.col("below") + (F.col("n") + 1) / 2
    sums = (
        below_counts(hist, keys, value, bounded)
        .groupBy(*keys)
        .agg(F.sum("_n1").alias("n1"), F.sum(F.col("n") - F.col("_n1")).alias("n2"),
             F.sum(F.col("_n1") * mid_rank).alias("_r1"))
    )
    return sums.withColumn("u", u_statistic(F.col("n1"), F.col("n2"), F.col("_r1"))).drop("_r1")


def u_statistic(n1: Column, n2: Column, rank_sum: Column) -> Column:
    u1 = rank_sum - n1 * (n1 + 1) / 2
    return F.when((n1 == 0) | (n2 == 0), F.lit(0.0)).otherwise(F.least(u1, n1 * n2 - u1))


@cache
def _exact_shares() -> pd.DataFrame:
    """Share of rank assignments with min(U1, U2) <= u, for all sizes with n1 + n2 <= 20."""
    # ways[k][s]: subsets of the ranks seen so far with k members and rank sum s.
    top = EXACT_MAX * (EXACT_MAX + 1) // 2
    ways = np.zeros((EXACT_MAX + 1, top + 1), dtype=np.int64)
    ways[0, 0] = 1
    parts = []
    for n in range(1, EXACT_MAX + 1):
        ways[1:, n:] += ways[:-1, : top + 1 - n].copy()
        for n1 in range(1, n):
            n2 = n - n1
            low = n1 * (n1 + 1) // 2
            counts = ways[n1, low : low + n1 * n2 + 1]
            smaller = np.minimum(np.arange(n1 * n2 + 1), n1 * n2 - np.arange(n1 * n2 + 1))
            share = np.bincount(smaller, weights=counts).cumsum() / counts.sum()
            parts.append(pd.DataFrame({"n1": n1, "n2": n2, "u_floor": np.arange(len(share)), "exact_p": share}))
    return pd.concat(parts, ignore_index=True)


def exact_table(spark: SparkSession) -> DataFrame:
    """Lookup (n1, n2, u_floor) -> exact_p: a fixed 3,820 rows, whatever the data."""
    schema = "n1 bigint, n2 bigint, u_floor bigint, exact_p double"
    return spark.createDataFrame(_exact_shares(), schema)


def normal_tail(z: Column) -> Column:
    """Upper tail of the standard normal distribution for z >= 0 (West 2005, double precision)."""
    # Coefficients of the published rational approximation.
    top = [3.52624965998911e-02, 0.700383064443688, 6.37396220353165, 33.912866078383,
           112.079291497871, 221.213596169931, 220.206867912376]
    bottom = [8.83883476483184e-02, 1.75566716318264, 16.064177579207, 86.7807322029461,
              296.564248779674, 637.333633378831, 793.826512519948, 440.413735824752]

    def horner(terms):
        total = F.lit(terms[0])
        for term in terms[1:]:
            total = total * z + term
        return total

    fraction = z + 0.65
    for n in (4, 3, 2, 1):
        fraction = z + n / fraction
    density = F.exp(-z * z / 2)
    return (
        F.when(z > 37, 0.0)
        .when(z < 7.07106781186547, density * horner(top) / horner(bottom))
        .otherwise(density / fraction / 2.506628274631)
    )


def normal_p(n1: Column, n2: Column, u: Column) -> Column:
    """Two-sided p of U by the normal approximation, without tie or continuity correction."""
    a, b = n1.cast("double"), n2.cast("double")
    spread = F.sqrt(a * b * (a + b + 1) / 12)
    z = F.abs((u - a * b / 2) / F.nullif(spread, F.lit(0.0)))
    return F.when(spread == 0, F.lit(1.0)).otherwise(2 * normal_tail(z))


def test_method(n1: Column, n2: Column) -> Column:
    return (
        F.when((n1 == 0) | (n2 == 0), "none")
        .when(n1 + n2 <= EXACT_MAX, "exact")
        .when(F.least(n1, n2) <= EXACT_MAX, "permutation")
        .otherwise("normal")
    )


def seed_of(*parts: str) -> Column:
    """Seed of a test: its key, and whatever else tells it from others, as text."""
    return F.concat_ws("|", *[F.col(p).cast("string") for p in parts])


def _hashes(seed: Column, draw: Column, k: Column) -> Column:
    """Digests of a shuffle; each gives two draws of 60 bits."""
    return F.transform(F.sequence(F.lit(0), F.floor((k - 1) / 2).cast("int")), lambda j: F.md5(
        F.concat_ws(":", seed, draw.cast("string"), j.cast("string"))))


def _drawn(hashes: Column, k: Column, n: Column) -> Column:
    """``k`` different row numbers below ``n``: each is drawn from the first n - k + i + 1, and where it is taken
    already, the last of these takes its place (Floyd)."""

    def step(taken, i):
        part = F.substring(F.element_at(hashes, F.floor(i / 2).cast("int") + 1), 1 + 15 * (i % 2), F.lit(15))
        last = n - k + i
        # Bound by the outer transform, so that it is worked out once.
        number = F.transform(F.array(F.conv(part, 16, 10).cast("bigint") % (last + 1)), lambda x: F.when(F.array_contains(taken, x), last).otherwise(x))
        return F.concat(taken, number)

    return F.aggregate(F.sequence(F.lit(0), k.cast("int") - 1), F.array().cast("array<bigint>"), step)


def permutation_p(tests: DataFrame, ranked: DataFrame, keys: list[str], names: list[str]) -> DataFrame:
    """(keys, names, shuffled_p): for each test the share of shuffles whose U does not exceed its ``_u``.

    ``tests`` has keys, names, ``_k`` (the size of the smaller sample), ``_n`` (of both), ``_u`` and ``_seed``; ``ranked``
    has keys, ``n``, ``below`` and ``total`` per distinct value. The statistic is symmetric in the samples, so only the
    smaller one is drawn.
    """
    test = [*keys, *names]
    blocks = tests.select(*test, "_k", "_u", "_seed", "_n", F.explode(F.sequence(F.lit(0), F.lit(SHUFFLES - 1), F.lit(_BLOCK))).alias("_block"))
    # A test is one row, and its blocks go to different tasks. Their number is given, as blocks are small to read and
    # slow to draw: partitions merged by size would leave one task.
    parts = int(tests.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    draws = blocks.repartition(parts, *test, "_block").select("*", F.explode(F.sequence(F.col("_block"), F.col("_block") + _BLOCK - 1)).alias("_draw"))
    # Generated, so that the fold finds the digests and does not make them again at every step.
    hashed = draws.select("*", F.explode(F.array(_hashes(F.col("_seed"), F.col("_draw"), F.col("_k")))).alias("_hashes"))
    number = F.explode(_drawn(F.col("_hashes"), F.col("_k"), F.col("_n"))).alias("_number")
    width = lambda n: F.greatest(F.floor(n / SPANS), F.lit(1))
    places = hashed.select(*test, "_k", "_u", "_n", "_draw", number)
    places = places.withColumn("_span", F.floor(F.col("_number") / width(F.col("_n"))))
    own = width(F.col("total"))
    spans = ranked.join(tests.select(*keys).distinct(), keys, "left_semi").select(
        *keys, "below", (F.col("below") + F.col("n")).alias("_end"), (F.col("below") + (F.col("n") + 1) / 2).alias("_rank"),
        F.explode(F.sequence(F.floor(F.col("below") / own), F.floor((F.col("below") + F.col("n") - 1) / own))).alias("_span"))
    met = places.join(spans, [*keys, "_span"]).filter("below <= _number AND _number < _end")
    sums = met.groupBy(*test, "_k", "_u", "_n", "_draw").agg(F.sum("_rank").alias("_sum"))
    u1 = F.col("_sum") - F.col("_k") * (F.col("_k") + 1) / 2
    extreme = F.least(u1, F.col("_k") * (F.col("_n") - F.col("_k")) - u1) <= F.col("_u")
    return sums.groupBy(*test).agg((F.count_if(extreme) / SHUFFLES).alias("shuffled_p"))


def p_of_method(method: Column, n1: Column, n2: Column, u: Column, exact: Column, shuffled: Column) -> Column:
    return (F.when(method == "none", 1.0).when(method == "exact", exact).when(method == "permutation", shuffled).otherwise(normal_p(n1, n2, u)))


def _statistics(df: DataFrame, keys: list[str], first: Column, value: str) -> DataFrame:
    """U per key with the method that its sizes call for."""
    return rank_sum_u(df, keys, first, value).withColumn("method", test_method(F.col("n1"), F.col("n2")))


def _with_exact(stats: DataFrame) -> DataFrame:
    return stats.withColumn("u_floor", F.floor("u")).join(F.broadcast(exact_table(stats.sparkSession)), ["n1", "n2", "u_floor"], "left")


def exact_test(df: DataFrame, keys: list[str], first: Column, value: str) -> DataFrame:
    """U, the method its sizes call for, and p per key where that is by enumeration, else NULL.

    It costs one aggregation, however many of the other keys would need shuffles.
    """
    p = F.when(F.col("method") == "none", 1.0).when(F.col("method") == "exact", F.col("exact_p"))
    return _with_exact(_statistics(df, keys, first, value)).select(*keys, "n1", "n2", "u", "method", p.alias("p_value"))


def rank_sum_test(df: DataFrame, keys: list[str], first: Column, value: str) -> DataFrame:
    """U, the method its sizes call for, and the two-sided p per key.

    Statistics are made once and written, as three things read them: the exact table, the shuffles and the result.
    """
    n1, n2, u = F.col("n1"), F.col("n2"), F.col("u")
    stats = checkpoint(_statistics(df, keys, first, value))
    small = stats.filter("method = 'permutation'")
    found = _with_exact(stats)
    shuffled = F.lit(None).cast("double")
    if not small.isEmpty():
        hist = histogram(df.join(small.select(*keys), keys, "left_semi"), keys, value)
        tests = small.select(*keys, F.least(n1, n2).alias("_k"), (n1 + n2).alias("_n"), u.alias("_u"), seed_of(*keys).alias("_seed"))
        shares = permutation_p(tests, checkpoint(below_counts(hist, keys, value, bounded=False)), keys, [])
        found, shuffled = found.join(shares, keys, "left"), F.col("shuffled_p")
    found = found.withColumn("p_value", p_of_method(F.col("method"), n1, n2, u, F.col("exact_p"), shuffled))
    return found.select(*keys, "n1", "n2", "u", "method", "p_value")
