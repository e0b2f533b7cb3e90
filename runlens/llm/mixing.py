"""Mixing sources to target weights by Pfair scheduling (Baruah, Cohen, Plaxton and Varvel 1996).

A source's rows are cut into blocks. Block j (from 0) of a source with share w of the mix is released at
floor(j / w) and due at ceil((j + 1) / w); each slot of the mix takes the released block that is due first.
With shares that sum to one, every block meets its deadline, so after any number of slots each source has had
its share to within less than one block. When a source runs out, the rest go on by their own weights, as a new
phase that starts at that slot.

Shares are ratios of whole numbers, exactly those of the weights that were given. The order of deadlines is one
chain from slot to slot, so one task walks it: it holds a number or two per source, whatever the number of
blocks, and streams out a row per block. Rows find their slots by join after they have been numbered within
their source; texts are shuffled once.
"""

import heapq
from collections.abc import Iterator
from fractions import Fraction
from math import lcm

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from runlens.session import checkpoint

_LEVEL = 256  # buckets that are summed up within one parent
_BATCH = 1 << 16


def whole_parts(weights: list[float]) -> list[int]:
    """Whole numbers in exactly the ratio of the weights."""
    exact = [Fraction(w) for w in weights]
    common = lcm(*[w.denominator for w in exact])
    return [int(w * common) for w in exact]


def schedule(blocks: list[int], parts: list[int]) -> Iterator[tuple[int, int]]:
    """(source, block) of slot after slot, by earliest deadline first, until all blocks are placed."""
    done = [0] * len(blocks)
    active = [i for i, n in enumerate(blocks) if n]
    while active:
        total = sum(parts[i] for i in active)
        # Block j of the phase has release j * total // part and deadline -(-(j + 1) * total // part).
        ready = [(-(-total // parts[i]), i, 0) for i in active]
        heapq.heapify(ready)
        waiting: list[tuple[int, int, int]] = []
        slot, ended = 0, False
        while not ended:
            while waiting and waiting[0][0] <= slot:
                _, i, j = heapq.heappop(waiting)
                heapq.heappush(ready, (-(-(j + 1) * total // parts[i]), i, j))
            due, i, j = heapq.heappop(ready)
            assert slot < due, "a block missed its deadline"
            yield i, done[i]
            done[i] += 1
            slot += 1
            ended = done[i] == blocks[i]
            if not ended:
                heapq.heappush(waiting, ((j + 1) * total // parts[i], i, j + 1))
        active = [i for i in active if done[i] < blocks[i]]


def _walked(weights: dict[str, float], alpha: float, block_rows: int):
    """All sources of one task to the slots of their blocks, in batches."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sources = pd.concat(list(batches)).sort_values("_source")
        names, counts = sources["_source"].to_numpy(object), [int(n) for n in sources["n"]]
        parts = whole_parts([float(weights.get(name, n**alpha)) for name, n in zip(names, counts)]) if counts else []
        if any(p <= 0 for p in parts):
            raise ValueError("target weights must be positive")
        first, before, own = 0, 0, []

        def out():
            places = np.array(own, np.int64).reshape(-1, 3)
            return pd.DataFrame({"_source": names[places[:, 0]], "block": places[:, 1], "slot": np.arange(first, first + len(own)), "_before": places[:, 2]})

        for i, block in schedule([-(-n // block_rows) for n in counts], parts):
            own.append((i, block, before))
            before += min(block_rows, counts[i] - block * block_rows)
            if len(own) == _BATCH:
                yield out()
                first, own = first + _BATCH, []
        if own:
            yield out()

    return run


def _numbered(rows: DataFrame, rows_per_bucket: int) -> tuple[DataFrame, DataFrame]:
    """Buckets (_source, _bucket, n, _first) and the rows with their ``_bucket`` and their place ``_own`` in it, from 1.

    A source is cut into hash buckets of bounded size; rows are numbered within their bucket, and ``_first``, the
    rows of the buckets before, comes from sums by level, so no task sees a whole source.
    """
    n = rows.count()
    levels = 1
    while n > rows_per_bucket * _LEVEL**levels and levels < 7:
        levels += 1
    bucket = F.shiftrightunsigned("_hash", 64 - 8 * levels)
    buckets = checkpoint(rows.groupBy("_source", bucket.alias("_bucket")).agg(F.count("*").alias("n")))
    offsets = buckets.select("_source", "_bucket", F.lit(0).cast("bigint").alias("_before"))
    for level in range(1, levels + 1):
        up = 8 * (levels - level)
        sums = buckets.groupBy("_source", F.shiftright("_bucket", up).alias("_part")).agg(F.sum("n").alias("n"))
        within = Window.partitionBy("_source", F.shiftright("_part", 8)).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
        before = sums.select("_source", "_part", F.coalesce(F.sum("n").over(within), F.lit(0)).alias("_earlier"))
        offsets = (
            offsets.withColumn("_part", F.shiftright("_bucket", up)).join(before, ["_source", "_part"])
            .select("_source", "_bucket", (F.col("_before") + F.col("_earlier")).alias("_before"))
        )
    own = Window.partitionBy("_source", "_bucket").orderBy("_hash", F.asc_nulls_last("doc_id"))
    ranked = rows.withColumn("_bucket", bucket).withColumn("_own", F.row_number().over(own))
    firsts = buckets.join(offsets, ["_source", "_bucket"]).withColumnRenamed("_before", "_first")
    return checkpoint(firsts.select("_source", "_bucket", "n", "_first")), ranked


def mix_sources(docs: DataFrame, weights: dict[str, float] | None = None, *, alpha: float = 0.5, block_rows: int = 32,
                rows_per_bucket: int = 2048) -> DataFrame:
    """Adds to every row of ``docs`` (doc_id, source, any others) its place in the mix.

    ``weights`` are the targets of sources; those it leaves out, or all without it, get their number of rows to
    the power ``alpha``. Adds block (of the source, from 0), slot (of the block in the mix, from 0), row_in_block,
    position (of the row in the mix, from 0). All rows are placed, and any number of sources is. A null source
    counts as ''. Rows of a source follow a hash of all their columns; rows alike in all of them are
    interchangeable and lie in one bucket. A target that is not positive raises ValueError. Names that ``docs`` has
    already are replaced.
    """
    docs = docs.drop("block", "slot", "row_in_block", "position")
    rows = docs.withColumns({"_source": F.coalesce(F.col("source").cast("string"), F.lit("")), "_hash": F.xxhash64(*docs.columns)})
    bad = [name for name, weight in (weights or {}).items() if not weight > 0]
    if bad:
        raise ValueError("target weights must be positive")
    counted = rows.groupBy("_source").agg(F.count("*").alias("n"))
    slots = checkpoint(counted.coalesce(1).mapInPandas(
        _walked(weights or {}, alpha, block_rows), "_source string, block bigint, slot bigint, _before bigint"))
    # Per bucket the slots of the blocks that its rows are in, so that the rows stay where they are numbered.
    buckets, numbered = _numbered(rows, rows_per_bucket)
    block_of = lambda rank: F.floor(rank / block_rows)
    blocks = buckets.select("_source", "_bucket", F.explode(F.sequence(block_of(F.col("_first")), block_of(F.col("_first") + F.col("n") - 1))).alias("block"))
    own = blocks.join(slots, ["_source", "block"]).groupBy("_source", "_bucket").agg(
        F.array_sort(F.collect_list(F.struct("block", "slot", "_before"))).alias("_blocks"))
    placed = numbered.join(own.join(buckets.select("_source", "_bucket", "_first"), ["_source", "_bucket"]), ["_source", "_bucket"])
    placed = placed.withColumn("_rank", F.col("_first") + F.col("_own") - 1).withColumn("block", block_of(F.col("_rank")))
    at = F.get("_blocks", (F.col("block") - block_of(F.col("_first"))).cast("int"))
    placed = placed.withColumns({"row_in_block": (F.col("_rank") % block_rows).cast("int"), "slot": at["slot"], "_at": at["_before"]})
    return placed.withColumn("position", F.col("_at") + F.col("row_in_block")).select(*docs.columns, "block", "slot", "row_in_block", "position")
