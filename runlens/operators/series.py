"""Ordered series: row positions and pieces of bounded size, without ever sorting a whole series in one task."""

import itertools

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import (
    ArrayType, DoubleType, IntegerType, LongType, StructField, StructType, TimestampNTZType, TimestampType)

from runlens.session import checkpoint, stored

PIECE_ROWS = 1 << 18
MOST_PARTS = 100_000  # whose sizes are broadcast


def positions(df: DataFrame, keys: list[str], stamp: str, ties: list[str]) -> DataFrame:
    """Adds ``pos``, the row's 0-based place in its series when ordered by ``stamp`` and ``ties``.

    Rows are dealt out by range of key, stamp and ties, with bounds that Spark samples, so tasks are even however
    a series is spread over time; even one moment that holds a whole series is cut. A place is that in the sorted
    partition plus the sizes of the parts of the series before it. The sorted rows are written first, since bounds
    drawn anew would cut elsewhere.
    """
    order = [*keys, stamp, *ties]
    rows = checkpoint(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()))
    part = F.shiftright("_at", 33)  # of the partition; the rest counts its rows
    parts = rows.groupBy(*keys, part.alias("_part")).agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_in"))
    before = F.sum("_in").over(Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    parts = checkpoint(parts.select(*keys, "_part", (F.coalesce(before, F.lit(0)) - F.col("_first")).alias("_shift")))
    # A row per partition and one per series more.
    if parts.count() <= MOST_PARTS:
        parts = F.broadcast(parts)
    placed = rows.withColumn("_part", part).join(parts, [*keys, "_part"])
    return placed.withColumn("pos", F.col("_at") + F.col("_shift")).drop("_at", "_part", "_shift")


def sort_key(df: DataFrame, keys: list[str], stamp: str) -> Column:
    """A number that rises with the stamp within a series and stands for the series, to be sorted by ahead of the stamp.

    Sorts decide by the first eight bytes where they can and compare whole rows elsewhere, as they would for all points
    of a series if these bytes were the same. Half of them are of the series, half count seconds or minutes; stamps
    before 1970 or NULL, or beyond 2106, share one. Series that share a number only get shorter pieces.
    """
    kind, at = df.schema[stamp].dataType, F.col(stamp)
    if isinstance(kind, TimestampType):
        seconds = F.unix_seconds(at)
    elif isinstance(kind, TimestampNTZType):
        # By its parts: as a moment of the session's zone it would not always rise.
        seconds = (F.unix_date(at.cast("date")).cast("bigint") * 1440 + F.hour(at) * 60 + F.minute(at)) * 60
    else:
        return F.xxhash64(*keys)
    inside = F.least(F.greatest(F.coalesce(seconds, F.lit(0)), F.lit(0)), F.lit((1 << 32) - 1))
    return F.shiftleft(F.hash(*keys).cast("bigint"), 32).bitwiseOR(inside)


def _runs(batch: pa.RecordBatch, width: int):
    """Stretches of rows with one key, as (begin, end, key); the key is in the first ``width`` columns."""
    changes = [pc.run_end_encode(column).run_ends.to_numpy() for column in batch.columns[:width]]
    ends = np.unique(np.concatenate([*changes, [batch.num_rows]]))
    for begin, end in itertools.pairwise([0, *ends.tolist()]):
        yield begin, end, tuple(column[begin].as_py() for column in batch.columns[:width])


def _packed(rows: list[pa.RecordBatch], sizes: list[int], number: int, width: int) -> pa.RecordBatch:
    """One row per piece: the keys, partition, number in it, and the values and ids of its points."""
    table = pa.Table.from_batches(rows).combine_chunks()
    bounds = np.cumsum([0, *sizes], dtype="int32")
    part = TaskContext.get().partitionId()
    columns = [table.column(i).take(bounds[:-1]).combine_chunks() for i in range(width)]
    columns += [pa.array([part] * len(sizes), "int32"), pa.array(range(number, number + len(sizes)), "int64")]
    for name in ("_v", "_id"):
        columns.append(pa.ListArray.from_arrays(bounds, table[name].combine_chunks()))
    return pa.RecordBatch.from_arrays(columns, names=[*rows[0].schema.names[:width], "_part", "_number", "raw", "ids"])


def pieces(
    df: DataFrame, keys: list[str], stamp: str, ties: list[str], value: str, row_id: str, overlap: int, piece_rows: int
) -> DataFrame:
    """Packs each series, ordered by ``stamp`` and ``ties``, into rows of at most ``piece_rows`` consecutive points.

    ``piece`` counts from 0, ``start`` is the position of the first of the ``own`` points, whose values and ids are ``raw``
    and ``ids``; ``next`` has the values of up to ``overlap`` points after them. Rows are dealt out and sorted as in
    :func:`positions` and packed where they lie, so points are shuffled once and not one by one. A piece
    ends where its partition does, so it may be short.
    """
    order, width = ["_series", stamp, *ties], len(keys)
    rows = df.withColumn("_series", sort_key(df, keys, stamp)).repartitionByRange(*order).sortWithinPartitions(*order).select(
        *keys, F.col(value).cast("double").alias("_v"), F.col(row_id).cast("bigint").alias("_id"))

    def pack(batches):
        number, held, sizes, key = 0, [], [], None
        for batch in batches:
            for begin, end, of in _runs(batch, width):
                while begin < end:
                    if not sizes or key != of or sizes[-1] == piece_rows:
                        if sum(sizes) >= PIECE_ROWS:
                            yield _packed(held, sizes, number, width)
                            number, held, sizes = number + len(sizes), [], []
                        sizes.append(0)
                        key = of
                    taken = min(end - begin, piece_rows - sizes[-1])
                    held.append(batch.slice(begin, taken))
                    sizes[-1] += taken
                    begin += taken
        if sizes:
            yield _packed(held, sizes, number, width)

    fields = [StructField(k, rows.schema[k].dataType) for k in keys]
    fields += [StructField("_part", IntegerType()), StructField("_number", LongType()),
               StructField("raw", ArrayType(DoubleType())), StructField("ids", ArrayType(LongType()))]
    # Written once: bounds drawn anew would cut elsewhere, and all that follows reads this and not the input again.
    packed = checkpoint(rows.mapInArrow(pack, StructType(fields)))
    sizes = packed.select(*keys, "_part", "_number", F.size("raw").cast("bigint").alias("own"), F.slice("raw", 1, overlap).alias("_head"))
    place = Window.partitionBy(*keys).orderBy("_part", "_number")
    following = F.flatten(F.collect_list("_head").over(place.rowsBetween(1, overlap)))
    placed = stored(sizes.select(
        *keys, "_part", "_number", (F.row_number().over(place) - 1).cast("bigint").alias("piece"),
        (F.sum("own").over(place) - F.col("own")).alias("start"), "own", F.slice(following, 1, overlap).alias("next")))
    return packed.join(placed, [*keys, "_part", "_number"]).select(*keys, "piece", "start", "own", "raw", "ids", "next")
