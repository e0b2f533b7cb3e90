"""What detections split their series into: sums, rank sums and the overlap of values before and after.

The points of a series are counted per value within segments, the stretches between detections. Sums over everything
ahead of a detection are running totals over segments. Order statistics of everything ahead of it are found digit by
digit: each value stands under its number of smaller rows in the series, and per level the rows ahead of the detection
are counted under each digit that may come next. So a detection costs a few rows a level and not a copy of the values.
A window holds the detections of one series, or one digit of it; sums run through it row by row.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from runlens.operators.quantiles import below_counts
from runlens.session import checkpoint

DIGIT = 6  # bits of a level
QUARTILES = (0.25, 0.75)
LEAST_BEFORE = 4  # points, for quartiles


def detections(found: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """The detections with their number in the series from 1 (``seg``), and per piece those of earlier pieces."""
    order = Window.partitionBy(*keys).orderBy("piece")
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    own = F.size("hits")
    counted = (
        found.select(*keys, "piece", "hits", F.sum(own).over(whole).alias("_all"), (F.sum(own).over(order) - own).alias("_earlier"))
        .filter("_all > 0").drop("_all")
    )
    each = counted.select(*keys, "_earlier", F.posexplode("hits").alias("_i", "_hit"))
    return each.select(*keys, (F.col("_earlier") + F.col("_i") + 1).alias("seg"), "_hit.idx", "_hit.id", "_hit.down"), counted


def segment_counts(chunks: DataFrame, counted: DataFrame, keys: list[str]) -> DataFrame:
    """Rows ``_n`` per value ``_v`` in each segment; segment 0 is what comes ahead of the first detection."""
    at = F.transform("hits", lambda h: (h["idx"] - F.col("start")).cast("int"))
    cuts = F.concat(F.array(F.lit(0)), at, F.array(F.col("own").cast("int")))
    # Generated, so that the slices find plain arrays.
    cut = chunks.select(*keys, "piece", "start", "own", "raw").join(counted, [*keys, "piece"]).select(
        *keys, "raw", "_earlier", F.explode(F.array(cuts)).alias("_cuts"))
    stretches = cut.select(*keys, "raw", "_earlier", "_cuts", F.explode(F.sequence(F.lit(0), F.size("_cuts") - 2)).alias("_i"))
    begin, end = F.element_at("_cuts", F.col("_i") + 1), F.element_at("_cuts", F.col("_i") + 2)
    points = stretches.select(*keys, (F.col("_earlier") + F.col("_i")).alias("seg"), F.explode(F.slice("raw", begin + 1, end - begin)).alias("_v"))
    return points.groupBy(*keys, "seg", "_v").agg(F.count(F.lit(1)).alias("_n"))


def _sums(counts: DataFrame, ranked: DataFrame, centres: DataFrame, keys: list[str]) -> DataFrame:
    """Per detection: sums over what lies ahead of it, and over its own segment."""
    n, v = F.col("_n"), F.col("_v")
    offset = v - F.col("_centre")
    # Squares are taken from the mean of the series: those of the values themselves would cancel far from zero.
    own = (
        counts.join(ranked.select(*keys, "_v", (F.col("below") + (F.col("n") + 1) / 2).alias("_mid")), [*keys, "_v"])
        .join(centres, keys)
        .groupBy(*keys, "seg")
        .agg(F.sum(n).alias("seg_n"), F.sum(n * v).alias("seg_sum"), F.sum(n * offset * offset).alias("seg_sq"),
             F.sum(n * F.col("_mid")).alias("_ranks"), F.first("_centre").alias("centre"), F.first("_all").alias("rows"), F.first("_total").alias("whole_sum"))
    )
    ahead = Window.partitionBy(*keys).orderBy("seg").rowsBetween(Window.unboundedPreceding, -1)
    return own.select(
        *keys, "seg", "seg_n", "seg_sum", "seg_sq", "centre", "rows", "whole_sum",
        F.sum("seg_sum").over(ahead).alias("before_sum"), F.sum("_ranks").over(ahead).alias("rank_sum"),
    ).filter("seg > 0")


def _descend(asked: DataFrame, coded: DataFrame, keys: list[str], bits: int) -> DataFrame:
    """One level down: ``asked`` has key, seg, node and wanted places ``qs`` among the rows of the node ahead of ``seg``;
    ``coded`` the rows per segment and code. ``bits`` are left below the digit of this level."""
    child = F.shiftright("_code", bits)
    held = coded.groupBy(*keys, child.alias("_child"), "seg").agg(F.sum("_n").alias("_n"))
    may = asked.select(*keys, "seg", "node", "qs", F.explode(F.sequence(F.lit(0), F.lit((1 << DIGIT) - 1))).alias("_digit"))
    may = may.select(
        *keys, (F.shiftleft("node", DIGIT) + F.col("_digit")).alias("_child"), "seg", F.lit(0).cast("bigint").alias("_n"), "node",
        F.when(F.col("_digit") == 0, F.col("qs")).alias("qs"), F.lit(True).alias("_asks"))
    rows = held.select(*keys, "_child", "seg", "_n").withColumns({
        "node": F.lit(None).cast("bigint"), "qs": F.lit(None).cast(asked.schema["qs"].dataType), "_asks": F.lit(False)}).unionByName(may)
    # What asks about a segment stands before the rows of that segment.
    ahead = Window.partitionBy(*keys, "_child").orderBy("seg", F.desc("_asks")).rowsBetween(Window.unboundedPreceding, 0)
    counted = rows.withColumn("_upto", F.sum("_n").over(ahead)).filter("_asks")
    nodes = counted.groupBy(*keys, "seg", "node").agg(
        F.array_sort(F.collect_list(F.struct("_child", "_upto"))).alias("_held"), F.first("qs", ignorenulls=True).alias("qs"))
    each = nodes.select(*keys, "seg", "_held", F.explode("qs").alias("_q"))
    start = F.struct(F.col("_q.rest").alias("rest"), F.lit(None).cast("bigint").alias("child"), F.lit(0).cast("bigint").alias("same"))

    def step(acc, x):
        here = acc["rest"] < x["_upto"]
        return F.when(acc["child"].isNotNull(), acc).otherwise(F.struct(
            F.when(here, acc["rest"]).otherwise(acc["rest"] - x["_upto"]).alias("rest"), F.when(here, x["_child"]).alias("child"),
            F.when(here, x["_upto"]).otherwise(F.lit(0)).alias("same")))

    found = each.select(*keys, "seg", "_q", F.aggregate("_held", start, step).alias("_a"))
    place = F.struct(F.col("_q.q").alias("q"), F.col("_q.pos").alias("pos"), F.col("_a.rest").alias("rest"), F.col("_a.same").alias("same"))
    return found.select(*keys, "seg", F.col("_a.child").alias("node"), place.alias("_p")).groupBy(*keys, "seg", "node").agg(F.collect_list("_p").alias("qs"))


def _order_statistics(hits: DataFrame, counts: DataFrame, ranked: DataFrame, keys: list[str], levels: int) -> DataFrame:
    """Per detection with enough points ahead: for both quartiles the values on either side of the wanted place among
    these points (lo, hi), the points below each and those equal to it."""
    idx = F.col("idx")
    wanted = []
    for i, p in enumerate(QUARTILES):
        low = F.floor(p * (idx - 1))
        wanted += [(2 * i, low), (2 * i + 1, F.least(low + 1, idx - 1))]
    zero = F.lit(0).cast("bigint")
    qs = F.array(*[F.struct(F.lit(q).alias("q"), pos.alias("pos"), pos.alias("rest"), zero.alias("same")) for q, pos in wanted])
    asked = hits.filter(idx >= LEAST_BEFORE).select(*keys, "seg", zero.alias("node"), qs.alias("qs"))
    codes = ranked.select(*keys, "_v", F.col("below").alias("_code"))
    coded = checkpoint(counts.join(codes, [*keys, "_v"]).select(*keys, "seg", "_code", "_n"))
    for level in reversed(range(levels)):
        asked = checkpoint(_descend(asked, coded, keys, DIGIT * level))
    leaves = asked.select(*keys, "seg", F.col("node").alias("_code"), F.explode("qs").alias("_q"))
    named = leaves.join(codes, [*keys, "_code"]).withColumn(
        "_s", F.struct("_v", (F.col("_q.pos") - F.col("_q.rest")).alias("below"), F.col("_q.same").alias("same")))
    return named.groupBy(*keys, "seg").agg(
        *[F.max(F.when(F.col("_q.q") == q, F.col("_s"))).alias(f"_s{q}") for q in range(4)])


def _overlaps(hits: DataFrame, statistics: DataFrame, ranked: DataFrame, keys: list[str]) -> DataFrame:
    """Per detection: the share of the points from it on that lie between the quartiles of those ahead."""
    idx = F.col("idx")

    def quartile(i: int) -> Column:
        low, high = F.col(f"_s{2 * i}._v"), F.col(f"_s{2 * i + 1}._v")
        at = QUARTILES[i] * (idx - 1)
        return low + (at - F.floor(at)) * (high - low)

    q = hits.filter(idx >= LEAST_BEFORE).select(*keys, "seg", "idx").join(statistics, [*keys, "seg"]).select("*", quartile(0).alias("_q1"), quartile(1).alias("_q3"))
    below = (F.when(F.col("_q1") <= F.col("_s0._v"), F.col("_s0.below")).when(F.col("_q1") >= F.col("_s1._v"), F.col("_s1.below"))
             .otherwise(F.col("_s0.below") + F.col("_s0.same")))
    upto = F.when(F.col("_q3") >= F.col("_s3._v"), F.col("_s3.below") + F.col("_s3.same")).otherwise(F.col("_s2.below") + F.col("_s2.same"))
    q = checkpoint(q.select(*keys, "seg", "idx", "_q1", "_q3", (upto - below).alias("_inside")))
    # The quartiles join the values as values of no rows, so that rows below them are counted alike.
    asked = q.select(*keys, F.explode(F.array("_q1", "_q3")).alias("_v"), F.lit(0).cast("bigint").alias("n"))
    values = asked.unionByName(ranked.select(*keys, "_v", "n")).groupBy(*keys, "_v").agg(F.sum("n").alias("n"))
    places = below_counts(values, keys, "_v", bounded=False).join(asked.select(*keys, "_v").distinct(), [*keys, "_v"], "left_semi")
    ends = q.select(*keys, "seg", "idx", "_inside", F.explode(F.array(
        F.struct(F.col("_q1").alias("v"), F.lit(False).alias("top")), F.struct(F.col("_q3").alias("v"), F.lit(True).alias("top")))).alias("_e"))
    met = ends.select(*keys, "seg", "idx", "_inside", F.col("_e.v").alias("_v"), F.col("_e.top").alias("_top")).join(places, [*keys, "_v"])
    signed = F.when(F.col("_top"), F.col("below") + F.col("n")).otherwise(-F.col("below"))
    return met.groupBy(*keys, "seg", "idx", "_inside").agg(F.sum(signed).alias("_within"), F.first("total").alias("_total")).select(
        *keys, "seg", F.when(F.col("_total") > idx, (F.col("_within") - F.col("_inside")) / (F.col("_total") - idx)).otherwise(0.0).alias("overlap"))


def split_series(chunks: DataFrame, found: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """A row per detection with what it splits its series into, and the values of these series with their rows.

    ``chunks`` are pieces (``piece``, ``start``, ``own``, ``raw``), ``found`` their ``hits``. The first result has ``seg``,
    ``idx``, ``id``, ``down``, ``next_down`` (of the next detection), ``before_sum`` and ``rank_sum`` over the points
    ahead, ``seg_n``, ``seg_sum`` and ``seg_sq`` (squared distances from ``centre``) over those up to the next detection,
    ``whole_sum``, ``rows`` and ``overlap``; the second ``_v``, ``n``, ``below`` and ``total``.
    """
    hits, counted = detections(found, keys)
    hits = checkpoint(hits)
    counts = checkpoint(segment_counts(chunks, counted, keys))
    values = counts.groupBy(*keys, "_v").agg(F.sum("_n").alias("n"))
    ranked = checkpoint(below_counts(values, keys, "_v", bounded=False))
    rows = F.sum("n")
    wholes = checkpoint(ranked.groupBy(*keys).agg(rows.alias("_all"), F.sum(F.col("_v") * F.col("n")).alias("_total")).withColumn("_centre", F.col("_total") / F.col("_all")))
    longest = wholes.agg(F.max("_all")).first()[0] or 1
    levels = -(-max(longest - 1, 1).bit_length() // DIGIT)
    statistics = _order_statistics(hits, counts, ranked, keys, levels)
    following = hits.select(*keys, (F.col("seg") - 1).alias("seg"), F.col("down").alias("next_down"))
    each = (
        hits.join(_sums(counts, ranked, wholes, keys), [*keys, "seg"])
        .join(following, [*keys, "seg"], "left")
        .join(_overlaps(hits, statistics, ranked, keys), [*keys, "seg"], "left")
        .withColumn("overlap", F.coalesce("overlap", F.lit(0.0)))
    )
    return each, ranked
