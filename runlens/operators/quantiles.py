"""Exact order statistics per key.

Values are first counted per (keys, value). That aggregation combines on the map side and is spread by
value as well as key, so a key holding most of the rows is no hot spot. What follows works on distinct
values only. A duration of whole seconds has at most as many distinct values as the longest job has
seconds, however many runs there are; :func:`sliced_percentiles` (``bounded=False``) serves series without
such a bound.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def histogram(df: DataFrame, keys: list[str], value: str, n: str = "n") -> DataFrame:
    """Rows per (keys, value)."""
    return df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias(n))


def percentile_of(value: str, points: list[float] | float, n: str = "n") -> Column:
    """Aggregate giving interpolated percentiles (0-100) of a histogram."""
    if isinstance(points, list):
        return F.percentile(value, F.array(*[F.lit(p / 100) for p in points]), F.col(n))
    return F.percentile(value, F.lit(points / 100), F.col(n))


def percentiles(
    df: DataFrame, keys: list[str], value: str, points: dict[str, float], bounded: bool = True
) -> DataFrame:
    """Interpolated percentiles per key, one column per entry of ``points``.

    ``bounded`` says that a key's distinct values fit in one task, as those of durations do.
    """
    return percentiles_of_histogram(histogram(df, keys, value), keys, value, points, bounded).drop("rows")


def percentiles_of_histogram(
    hist: DataFrame, keys: list[str], value: str, points: dict[str, float], bounded: bool = True
) -> DataFrame:
    """Percentiles per key and the key's ``rows``, from counts per value."""
    if not bounded:
        return sliced_percentiles(hist, keys, value, points)
    found = hist.groupBy(*keys).agg(F.sum("n").alias("rows"), percentile_of(value, list(points.values())).alias("_p"))
    return found.select(*keys, "rows", *[F.col("_p")[i].alias(name) for i, name in enumerate(points)])


PER_E_FOLD = 64
PARTS = 4096
_SLICE = ["_slice", "_part"]


def _slice_of(value: Column, per_e_fold: int) -> Column:
    """Number of the slice of a value. Slices keep the order of the values, ``per_e_fold`` for each e-fold."""
    size = F.floor(F.log1p(F.abs(value)) * per_e_fold)
    return F.when(value < 0, -1 - size).otherwise(size)


def _cut(hist: DataFrame, keys: list[str], value: str, per_e_fold: int) -> DataFrame:
    """Adds ``_slice`` and ``_part``: slices by size, each cut into ``PARTS`` by the range of its own values.

    So values that crowd into a narrow range are spread as well as those that span many orders.
    """
    v = F.col(value)
    sliced = hist.withColumn("_slice", _slice_of(v, per_e_fold))
    spans = sliced.groupBy(*keys, "_slice").agg(F.min(v).alias("_low"), F.max(v).alias("_high"))
    part = F.least(F.floor((v - F.col("_low")) / (F.col("_high") - F.col("_low")) * PARTS), F.lit(PARTS - 1))
    return sliced.join(spans, [*keys, "_slice"]).withColumn(
        "_part", F.when(F.col("_high") > F.col("_low"), part).otherwise(0).cast("bigint")).drop("_low", "_high")


def _slice_totals(cut: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of each part (``_in``), of all lower parts (``_below``) and of the key (``_n``).

    A key has a few thousand slices at most: that many e-folds a double has, and no more.
    """
    by_key, by_slice = Window.partitionBy(*keys), Window.partitionBy(*keys, "_slice")
    parts = (
        cut.groupBy(*keys, *_SLICE)
        .agg(F.sum("n").alias("_in"))
        .withColumn("_inside", F.sum("_in").over(by_slice.orderBy("_part")) - F.col("_in"))
    )
    slices = (
        parts.groupBy(*keys, "_slice")
        .agg(F.sum("_in").alias("_all"))
        .withColumn("_n", F.sum("_all").over(by_key))
        .withColumn("_before", F.sum("_all").over(by_key.orderBy("_slice")) - F.col("_all"))
    )
    return parts.join(slices, [*keys, "_slice"]).select(
        *keys, *_SLICE, "_in", "_n", (F.col("_before") + F.col("_inside")).alias("_below"))


def sliced_percentiles(
    hist: DataFrame, keys: list[str], value: str, points: dict[str, float], per_e_fold: int = PER_E_FOLD
) -> DataFrame:
    """Interpolated percentiles of a histogram whose distinct values may be as many as its rows.

    Values go to parts that keep their order, totals give the part of each wanted position, and only the values of
    those parts are ranked.
    """
    v = F.col(value)
    sliced = _cut(hist.filter(v.isNotNull()), keys, value, per_e_fold)
    wanted = (
        _slice_totals(sliced, keys)
        .withColumn("_p", F.explode(F.array(*[F.lit(p / 100) for p in dict.fromkeys(points.values())])))
        .withColumn("_pos", F.col("_p") * (F.col("_n") - 1))
    )
    end = F.col("_below") + F.col("_in")
    # A position may fall between the last row of one part and the first of the next: keep both.
    wanted = wanted.filter((F.col("_pos") < end) & (F.ceil("_pos") >= F.col("_below")))
    targets = wanted.groupBy(*keys, *_SLICE, "_n", "_below").agg(F.collect_set("_p").alias("_points"))
    # Counted by row: derived values such as distances may repeat, and equal ones may come in any order.
    running = Window.partitionBy(*keys, *_SLICE).orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    ranked = (
        sliced.join(targets, [*keys, *_SLICE])
        .withColumn("_last", F.col("_below") + F.sum("n").over(running) - 1)
        .withColumn("_first", F.col("_last") - F.col("n") + 1)
    )
    hits = ranked.select(*keys, value, "_first", "_last", "_n", F.explode("_points").alias("_p"))
    pos = F.col("_p") * (F.col("_n") - 1)

    def at(place):
        return F.max(F.when((F.col("_first") <= place) & (place <= F.col("_last")), v))

    ends = hits.groupBy(*keys, "_p", "_n").agg(at(F.floor(pos)).alias("_lo"), at(F.ceil(pos)).alias("_hi"))
    between = F.col("_lo") + (pos - F.floor(pos)) * (F.col("_hi") - F.col("_lo"))
    ends = ends.withColumn("_q", between)
    return ends.groupBy(*keys).agg(
        F.max("_n").alias("rows"),
        *[F.max(F.when(F.col("_p") == F.lit(p / 100), F.col("_q"))).alias(name) for name, p in points.items()]
    )


def spread(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Mean, sample deviation, coefficient of variation and count per key; deviation 0 below two rows."""
    mean, std = F.avg(value), F.coalesce(F.stddev_samp(value), F.lit(0.0))
    return df.groupBy(*keys).agg(
        F.count(value).alias("count"),
        F.coalesce(mean, F.lit(0.0)).alias("mean"),
        std.alias("stddev"),
        F.when(mean == 0, 0.0).otherwise(std / mean).alias("cv"),
    )


def quartiles(df: DataFrame, keys: list[str], value: str, bounded: bool = True) -> DataFrame:
    q = percentiles(df, keys, value, {"q1": 25, "q3": 75}, bounded)
    return q.withColumn("iqr", F.col("q3") - F.col("q1"))


def below_counts(
    hist: DataFrame, keys: list[str], value: str, bounded: bool = True, per_e_fold: int = PER_E_FOLD
) -> DataFrame:
    """Adds to a histogram the key's row count and how many of its rows have a smaller value.

    Unbounded values are counted within parts of slices and the rows of lower ones added, so no task sees a
    whole key.
    """
    if bounded:
        by_key = Window.partitionBy(*keys)
        return hist.withColumn("total", F.sum("n").over(by_key)).withColumn(
            "below", F.sum("n").over(by_key.orderBy(value)) - F.col("n")
        )
    cut = _cut(hist, keys, value, per_e_fold)
    totals = _slice_totals(cut, keys).select(*keys, *_SLICE, F.col("_below"), F.col("_n").alias("total"))
    in_part = Window.partitionBy(*keys, *_SLICE).orderBy(value)
    return (
        cut.withColumn("_upto", F.sum("n").over(in_part))
        .join(totals, [*keys, *_SLICE])
        .withColumn("below", F.col("_below") + F.col("_upto") - F.col("n"))
        .drop(*_SLICE, "_upto", "_below")
    )
