"""Change points of keyed series: two-sided cumulative sums that start over after every detection.

A series is cut into pieces of consecutive points (see ``series.pieces``) and each piece is folded on its
own. The state after a detection depends on the detection alone, so a
piece entered with a guessed state soon agrees with the true run. Pieces whose true entry state differs
from the one they were folded with are folded again until none is left. That is the result of one pass over the
whole series, but for points within rounding of the threshold, as sums are taken in another order.
"""

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, DoubleType, LongType, StructField, StructType

from runlens.operators.outliers import clamp, clamp_limits
from runlens.operators.quantiles import histogram
from runlens.operators.rank_test import exact_table, p_of_method, permutation_p, seed_of, test_method, u_statistic
from runlens.operators.series import PIECE_ROWS, pieces
from runlens.operators.splits import split_series
from runlens.session import checkpoint, stored

THRESHOLD = 4.0
MIN_SEGMENT = 5
SLACK = 0.5
CLAMP_K = 4.0

STATE = "struct<hi:double,lo:double,mean:double,sigma:double,sum:double,count:bigint>"
HITS = "array<struct<idx:bigint,id:bigint,before:double,after:double,down:boolean>>"
PASSAGE = "struct<own:double,drift:double,top:double,peak:double>"
STATE_FIELDS = ["hi", "lo", "mean", "sigma", "sum", "count"]
STATE_ARROW = pa.struct([*[(name, pa.float64()) for name in STATE_FIELDS[:-1]], ("count", pa.int64())])
HITS_ARROW = pa.list_(pa.struct([
    ("idx", pa.int64()), ("id", pa.int64()), ("before", pa.float64()), ("after", pa.float64()), ("down", pa.bool_())]))
PASSAGE_ARROW = pa.struct([(name, pa.float64()) for name in ("own", "drift", "top", "peak")])


def _type(ddl: str) -> DataType:
    return StructType.fromDDL(f"x {ddl}")["x"].dataType


def _mean(window: list) -> float | None:
    """Summed in order, as a sum with compensation would differ from a running one. A NULL makes it NULL."""
    total = 0.0
    for x in window:
        if x is None:
            return None
        total += x
    return total / len(window)


def _baseline(window: list, fallback: float) -> tuple[float | None, float | None]:
    mean = _mean(window)
    if mean is None:
        return None, None
    squares = 0.0
    for x in window:
        squares += (x - mean) * (x - mean)
    sigma = math.sqrt(squares / (len(window) - 1)) if len(window) >= 2 else 0.0
    return mean, fallback if sigma == 0 else sigma


def _above(a: float, b: float) -> bool:
    """NaN counts as the largest number, as in Spark."""
    return a > b or (a != a and b == b)


def _fold_piece(
    values: list, own: int, start: int, ids, state: dict | None, fallback: float, threshold: float, m: int
) -> tuple[list[dict], dict]:
    """Detections among the ``own`` first values, and the state after them. ``state`` is the one before the first, or None to
    start with the first ``m`` points as baseline, as at the head of a series."""
    if state is None:
        mean, sigma = _baseline(values[:m], fallback)
        hi, lo, count, first = 0.0, 0.0, len(values[:m]), m
        total = 0.0
        for x in values[:m]:
            total = None if x is None or total is None else total + x
    else:
        hi, lo, mean, sigma, total, count = (state[name] for name in STATE_FIELDS)
        # The baseline points count as seen, even where the first piece is shorter than they are.
        first = max(m - start, 0)
    hits = []
    slack, limit = (None, None) if sigma is None else (SLACK * sigma, threshold * sigma)
    for i in range(first, own):
        x = values[i]
        if x is None or mean is None:
            hi = lo = 0.0
            total = None if x is None or total is None else total + x
            count += 1
            continue
        hi += x - mean - slack
        if hi < 0:
            hi = 0.0
        lo += mean - x - slack
        if lo < 0:
            lo = 0.0
        if count >= m and not (hi <= limit and lo <= limit) and (_above(hi, limit) or _above(lo, limit)):
            before, after = None if total is None else total / count, _mean(values[i:i + m])
            down = None if before is None else False if before == 0 else None if after is None else (after - before) / before < 0
            hits.append({"idx": start + i, "id": ids[i].as_py(), "before": before, "after": after, "down": down})
            mean, sigma = _baseline(values[i:i + m], fallback)
            slack, limit = (None, None) if sigma is None else (SLACK * sigma, threshold * sigma)
            hi, lo, total, count = 0.0, 0.0, x, 1
            continue
        total = None if total is None else total + x
        count += 1
    return hits, dict(zip(STATE_FIELDS, (hi, lo, mean, sigma, total, count)))


def _clamped(values: np.ndarray, low: float | None, high: float | None) -> np.ndarray:
    if high is not None:
        values = np.where(values <= high, values, high)
    return values if low is None else np.where(values < low, low, values)


def _fold(chunks: DataFrame, keys: list[str], threshold: float, m: int) -> DataFrame:
    """Detections (``hits``) and ``exit`` state of pieces. ``entry`` is the state before the first point, or NULL to
    start with the first ``m`` points as baseline."""
    place = [*keys, "piece"]

    def fold(batches):
        for batch in batches:
            hits, exits = [], []
            for i in range(batch.num_rows):
                row = {name: batch[name][i] for name in ("raw", "next", "ids")}
                start, own, low, high, fallback, entry = (
                    batch[name][i].as_py() for name in ("start", "own", "low", "high", "sigma_all", "entry"))
                points = pa.concat_arrays([row["raw"].values, row["next"].values])
                values = _clamped(points.to_numpy(zero_copy_only=False), low, high).tolist()
                if points.null_count:
                    values = [x if valid else None for x, valid in zip(values, points.is_valid().to_pylist())]
                found, after = _fold_piece(values, own, start, row["ids"].values, entry, fallback, threshold, m)
                hits.append(found)
                exits.append(after)
            columns = [batch[name] for name in [*place, "entry"]]
            yield pa.RecordBatch.from_arrays(
                [*columns, pa.array(hits, HITS_ARROW), pa.array(exits, STATE_ARROW)], names=[*place, "entry", "hits", "exit"])

    needed = chunks.select(*place, "start", "own", "raw", "next", "ids", "low", "high", "sigma_all", "entry")
    fields = [needed.schema[name] for name in [*place, "entry"]]
    out = StructType([*fields, StructField("hits", _type(HITS)), StructField("exit", _type(STATE))])
    return needed.mapInArrow(fold, out)


def _passage(values: np.ndarray, sign: float, mean: float, slack: float) -> dict:
    """A piece without detection as a max-plus map of the sum it is entered with: ``max(own, entry + drift)``; ``top`` and
    ``peak`` are the largest of both on the way."""
    drift = np.cumsum(sign * (values - mean) - slack)
    if not len(drift):
        return {"own": 0.0, "drift": 0.0, "top": 0.0, "peak": -math.inf}
    own = drift - np.minimum.accumulate(np.minimum(drift, 0.0))
    return {"own": float(own[-1]), "drift": float(drift[-1]), "top": float(own.max()), "peak": float(drift.max())}


def _passages(chunks: DataFrame, keys: list[str], threshold: float, m: int) -> DataFrame:
    """Each piece reduced to a few numbers under the baseline of the state ``_given``, before anything is shuffled."""
    place = [*keys, "piece"]

    def reduce(batches):
        for batch in batches:
            sums, sizes, up, down = [], [], [], []
            for i in range(batch.num_rows):
                start, low, high, given = (batch[name][i].as_py() for name in ("start", "low", "high", "_given"))
                values = batch["raw"][i].values.to_numpy(zero_copy_only=False)[max(m - start, 0):]
                values = _clamped(values, low, high)
                mean, sigma = (math.nan if given[name] is None else given[name] for name in ("mean", "sigma"))
                sums.append(float(np.cumsum(values)[-1]) if len(values) else 0.0)
                sizes.append(len(values))
                up.append(_passage(values, 1.0, mean, SLACK * sigma))
                down.append(_passage(values, -1.0, mean, SLACK * sigma))
            columns = [batch[name] for name in [*place, "_given"]]
            numbers = [pa.array(sums, "float64"), pa.array(sizes, "int64"), pa.array(up, PASSAGE_ARROW), pa.array(down, PASSAGE_ARROW)]
            yield pa.RecordBatch.from_arrays([*columns, *numbers], names=[*place, "_given", "_sum", "_seen", "_up", "_down"])

    needed = chunks.select(*place, "start", "raw", "low", "high", "_given")
    fields = [needed.schema[name] for name in [*place, "_given"]]
    out = StructType([*fields, StructField("_sum", DoubleType()), StructField("_seen", LongType()),
                      StructField("_up", _type(PASSAGE)), StructField("_down", _type(PASSAGE))])
    return needed.mapInArrow(reduce, out)


def _carry(chunks: DataFrame, stale: DataFrame, keys: list[str], threshold: float, m: int) -> DataFrame:
    """Takes the state at the first stale piece of each series through all pieces in which it detects nothing.

    With a fixed baseline the sums pass through a piece as ``max(own, entry + drift)``, so every later
    piece is reduced to a few numbers where it lies and a running maximum over pieces links them. Gives the
    entry state of each piece up to and including the first with a detection; ``exit`` is NULL for that one.
    """
    place = [*keys, "piece"]
    front = stored(stale.groupBy(*keys).agg(F.min_by(F.struct("piece", "entry"), "piece").alias("_front")))
    reached = chunks.join(front, keys).filter(F.col("piece") >= F.col("_front.piece"))
    # Stored, so that windows and their joins do not reduce the pieces again.
    passed = stored(_passages(reached.withColumn("_given", F.col("_front.entry")), keys, threshold, m))
    limit = (threshold * F.col("_given.sigma")).alias("_limit")
    passed = passed.select("*", limit)
    order = Window.partitionBy(*keys).orderBy("piece")
    earlier = order.rowsBetween(Window.unboundedPreceding, -1)

    def entering(df, side, state):
        drift = F.coalesce(F.sum(F.col(f"{side}.drift")).over(earlier), F.lit(0.0))
        df = df.withColumn(f"{side}_drift", drift)
        best = F.max(F.col(f"{side}.own") - F.col(f"{side}_drift") - F.col(f"{side}.drift")).over(earlier)
        carried = F.greatest(F.col(f"_given.{state}"), best) + F.col(f"{side}_drift")
        return df.withColumn(f"{side}_in", F.greatest(F.lit(0.0), carried))

    linked = entering(entering(passed, "_up", "hi"), "_down", "lo")

    def exceeds(side):
        peak = F.greatest(F.col(f"{side}.top"), F.col(f"{side}_in") + F.col(f"{side}.peak"))
        return peak > F.col("_limit")

    fires = exceeds("_up") | exceeds("_down") | (F.col("_given.count") < m)
    before = linked.withColumn("_fires", fires.cast("int")).withColumn(
        "_fired", F.coalesce(F.sum("_fires").over(earlier), F.lit(0))
    )
    entry = F.struct(
        F.col("_up_in").alias("hi"), F.col("_down_in").alias("lo"), F.col("_given.mean").alias("mean"),
        F.col("_given.sigma").alias("sigma"),
        (F.col("_given.sum") + F.coalesce(F.sum("_sum").over(earlier), F.lit(0.0))).alias("sum"),
        (F.col("_given.count") + F.coalesce(F.sum("_seen").over(earlier), F.lit(0))).alias("count"),
    )
    last = F.struct(
        F.greatest(F.col("_up.own"), F.col("_up_in") + F.col("_up.drift")).alias("hi"),
        F.greatest(F.col("_down.own"), F.col("_down_in") + F.col("_down.drift")).alias("lo"),
        F.col("_given.mean").alias("mean"), F.col("_given.sigma").alias("sigma"),
        (F.col("_entry.sum") + F.col("_sum")).alias("sum"), (F.col("_entry.count") + F.col("_seen")).alias("count"),
    )
    # A quiet piece leaves with exactly the state the next one enters with.
    return (
        before.withColumn("_entry", entry)
        .withColumn("_exit", F.coalesce(F.lead("_entry").over(order), last.cast(STATE)))
        .filter("_fired = 0")
        .select(*place, F.col("_entry").cast(STATE).alias("entry"), F.when(F.col("_fires") == 0, F.col("_exit")).cast(STATE).alias("exit"))
    )


def _limits(df: DataFrame, keys: list[str], value: str, m: int, clamp_k: float | None) -> DataFrame:
    """Per series: row count, clamp limits and the deviation of the whole (clamped) series."""
    hist = histogram(df, keys, value)
    if clamp_k is None:
        none = F.lit(None).cast("double")
        bounds = hist.groupBy(*keys).agg((F.sum(F.col(value) * F.col("n")) / F.sum("n")).alias("centre")).select("*", none.alias("low"), none.alias("high"))
    else:
        bounds = clamp_limits(hist, keys, value, clamp_k, bounded=False)
    clamped = hist.join(bounds, keys).withColumn("_c", clamp(F.col(value), F.col("low"), F.col("high")))
    # Distances from a value inside the series: squares of the values themselves would cancel far from zero.
    n, c = F.col("n"), F.col("_c") - F.col("centre")
    rows, total = F.sum(n), F.sum(n * c)
    spread = F.sqrt(F.greatest(F.sum(n * c * c) - total * total / rows, F.lit(0.0)) / (rows - 1))
    return (
        clamped.groupBy(*keys)
        .agg(
            rows.alias("rows"),
            F.first("low").alias("low"),
            F.first("high").alias("high"),
            F.when(F.min(c) == F.max(c), 0.0).otherwise(spread).alias("sigma_all"),
        )
        .filter((F.col("rows") >= 2 * m) & (F.col("sigma_all") > 0))
    )


def _own_values(packed: DataFrame, keys: list[str], value: str) -> DataFrame:
    """The points of the pieces as rows, each once."""
    return packed.select(*keys, F.explode("raw").alias(value))


def _detect(
    df: DataFrame, keys: list[str], stamp: str, ties: list[str], value: str, row_id: str, threshold: float,
    m: int, clamp_k: float | None, piece_rows: int,
) -> tuple[DataFrame, DataFrame]:
    """Pieces of every long enough series, and their detections."""
    packed = pieces(df, keys, stamp, ties, value, row_id, m - 1, piece_rows)
    limits = stored(_limits(_own_values(packed, keys, value), keys, value, m, clamp_k))
    chunks = packed.join(limits, keys)
    place = [*keys, "piece"]

    def fold(pieces_to_fold):
        return stored(_fold(pieces_to_fold, keys, threshold, m))

    result = fold(chunks.withColumn("entry", F.lit(None).cast(STATE)))
    while True:
        handed = result.select(*keys, (F.col("piece") + 1).alias("piece"), F.col("exit").alias("entry"))
        stale = result.select(*place, F.col("entry").alias("_used")).join(handed, place)
        stale = stored(stale.filter(~F.col("entry").eqNullSafe(F.col("_used"))).drop("_used"))
        if stale.isEmpty():
            break
        carried = stored(_carry(chunks, stale, keys, threshold, m))
        quiet = carried.filter("exit is not null").withColumn("hits", F.array().cast(HITS))
        ends = carried.filter("exit is null").select(*place, "entry")
        others = stale.join(carried, place, "left_anti").select(*place, "entry")
        redone = fold(chunks.join(stored(ends.unionByName(others)), place)).unionByName(quiet.select(*place, "entry", "hits", "exit"))
        result = stored(result.join(redone, place, "left_anti").unionByName(redone))
    return chunks, result


def cusum(
    df: DataFrame, keys: list[str], stamp: str, ties: list[str], value: str, row_id: str,
    threshold: float = THRESHOLD, min_segment: int = MIN_SEGMENT, clamp_k: float | None = None,
    piece_rows: int = PIECE_ROWS,
) -> DataFrame:
    """Change points per series: index, means since the last change and over the next points, direction."""
    _, found = _detect(df, keys, stamp, ties, value, row_id, threshold, min_segment, clamp_k, piece_rows)
    before, after = F.col("before_mean"), F.col("after_mean")
    return (
        found.select(*keys, F.inline("hits"))
        .select(*keys, "idx", "id", F.col("before").alias("before_mean"), F.col("after").alias("after_mean"), "down")
        .withColumn("pct_change", F.when(before == 0, 0.0).otherwise((after - before) / before * 100))
        .withColumn("direction", F.when(F.col("down"), "speedup").otherwise("slowdown"))
        .drop("down")
    )


def shift_report(
    df: DataFrame, keys: list[str], stamp: str, ties: list[str], value: str, row_id: str,
    threshold: float = THRESHOLD, min_segment: int = MIN_SEGMENT, clamp_k: float | None = CLAMP_K,
    piece_rows: int = PIECE_ROWS,
) -> DataFrame:
    """Change points with the evidence for them, measured on the raw values of the whole series.

    Before is every point ahead of the index, after every point from it on. Mid-ranks are fixed for the
    series, so U at any index is a running sum of them.
    """
    chunks, found = _detect(
        df, keys, stamp, ties, value, row_id, threshold, min_segment, clamp_k, piece_rows
    )
    measured, ranked = split_series(chunks, found, keys)
    return _evidence(measured, ranked, keys, min_segment)


def _evidence(each: DataFrame, ranked: DataFrame, keys: list[str], min_segment: int) -> DataFrame:
    spark = each.sparkSession
    idx, rows = F.col("idx"), F.col("rows")
    seg_n, seg_sum = F.col("seg_n"), F.col("seg_sum")
    offset = seg_sum / seg_n - F.col("centre")
    seg_var = F.greatest(F.col("seg_sq") - seg_n * offset * offset, F.lit(0.0)) / (seg_n - 1)
    measured = each.select(
        *keys,
        "idx",
        "id",
        F.col("down").alias("_down"),
        F.col("next_down").alias("_next_down"),
        idx.alias("n_before"),
        (rows - idx).alias("n_after"),
        (F.col("before_sum") / idx).alias("before_mean"),
        ((F.col("whole_sum") - F.col("before_sum")) / (rows - idx)).alias("after_mean"),
        u_statistic(idx, rows - idx, F.col("rank_sum")).alias("u"),
        "overlap",
        seg_n.alias("post_runs"),
        F.when(seg_sum == 0, 0.0)
        .when(seg_n < 2, 0.0)
        .otherwise(F.sqrt(seg_var) / (seg_sum / seg_n))
        .alias("post_cv"),
    )
    n1, n2, u = F.col("n_before"), F.col("n_after"), F.col("u")
    before, after = F.col("before_mean"), F.col("after_mean")
    measured = checkpoint(measured.withColumn("method", test_method(n1, n2)))
    tests = measured.filter("method = 'permutation'").select(
        *keys, "idx", F.least(n1, n2).alias("_k"), (n1 + n2).alias("_n"), u.alias("_u"), seed_of(*keys, "idx").alias("_seed"))
    shuffled = F.lit(None).cast("double")
    if not tests.isEmpty():
        shares = permutation_p(tests, ranked, keys, ["idx"])
        measured, shuffled = measured.join(shares, [*keys, "idx"], "left"), F.col("shuffled_p")
    exact = F.broadcast(exact_table(spark).withColumnsRenamed({"n1": "n_before", "n2": "n_after"}))
    return (
        measured.withColumn("u_floor", F.floor("u"))
        .join(exact, ["n_before", "n_after", "u_floor"], "left")
        .withColumn("p_value", p_of_method(F.col("method"), n1, n2, u, F.col("exact_p"), shuffled))
        .withColumn("pct_change", F.when(before == 0, 0.0).otherwise((after - before) / before * 100))
        .withColumn("direction", F.when(F.col("pct_change") < 0, "speedup").otherwise("slowdown"))
        .withColumn(
            "persistence",
            F.when(F.col("post_runs") < 2 * min_segment, "inconclusive")
            .when(F.col("_next_down") != F.col("_down"), "transient")
            .otherwise("persistent"),
        )
        .drop("u_floor", "exact_p", "shuffled_p", "_down", "_next_down")
    )
