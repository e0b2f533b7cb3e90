"""Exact top-k inner products by the three-phase uniform threshold method (Cao and Wang, 2004).

Vectors are cut into ``slices`` runs of consecutive components. Each slice is a list of partial scores, and
a total is the sum over the lists:

1. every task gathers the k best partial scores of its rows, per query and slice. The exact totals of the
   rows so found give each query a safe cutoff: its k-th best total so far;
2. the cutoff is broadcast. A total that reaches it has at least one partial score of cutoff / slices, so
   tasks send the entries that reach this share. Rows whose known partial scores, with the share for each
   unknown one, stay below the cutoff are dropped;
3. the missing partial scores of the remaining rows are fetched and the totals ranked.

Queries go through in chunks of a bounded size, each against all rows. Row-side work is a map over the
table; only lists, entries and cutoffs travel.
"""

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from runlens.session import checkpoint

_ENTRY = "q int, slice int, vec_id bigint, vh bigint, partial bigint"


def to_integers(vector: Column, scale: int = 1024) -> Column:
    """floor(scale * x) of every component, or null where a component is null or not finite."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.when(finite, F.transform(vector, lambda x: F.floor(x.cast("double") * scale)))


def _product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact a @ b.T of whole numbers: in doubles where every sum stays below 2^53."""
    if not a.size or not b.size:
        return np.zeros((len(a), len(b)), np.int64)
    if float(np.abs(a).max()) * float(np.abs(b).max()) * a.shape[1] < 2**53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return a @ b.T


def _stack(parts, width: int) -> np.ndarray:
    """Rows of one slice as a matrix; components beyond a vector's end are zero."""
    out = np.zeros((len(parts), width), np.int64)
    for i, part in enumerate(parts):
        out[i, : len(part)] = part
    return out


def _per_slice(pieces: DataFrame, queries: list[np.ndarray], pick) -> DataFrame:
    """Entries of all rows of ``pieces`` (slice, vec_id, vh, part) that ``pick(partial scores)`` selects."""

    def run(batches):
        for batch in batches:
            for number, rows in batch.groupby("slice"):
                own = queries[number]
                for begin in range(0, len(rows), 2048):
                    block = rows.iloc[begin : begin + 2048]
                    partial = _product(own, _stack(block["part"].tolist(), own.shape[1]))
                    q, r = pick(partial)
                    yield pd.DataFrame({
                        "q": q.astype(np.int32), "slice": np.int32(number),
                        "vec_id": block["vec_id"].array[r], "vh": block["vh"].to_numpy()[r],
                        "partial": partial[q, r],
                    })

    return pieces.mapInPandas(run, _ENTRY)


def _totals(found: DataFrame, pieces: DataFrame, queries: list[np.ndarray]) -> DataFrame:
    """Exact total per (q, vec_id, vh) of ``found``, from the slices of its vectors."""

    def run(batches):
        for batch in batches:
            for number, rows in batch.groupby("slice"):
                own = queries[number]
                part = _stack(rows["part"].tolist(), own.shape[1])
                # Row by row products, in whole numbers.
                partial = np.einsum("ij,ij->i", own[rows["q"].to_numpy()], part)
                yield pd.DataFrame({"q": rows["q"], "slice": rows["slice"], "vec_id": rows["vec_id"],
                                    "vh": rows["vh"], "partial": partial})

    same = F.expr("f.vec_id <=> p.vec_id AND f.vh = p.vh")
    with_parts = (
        found.select("q", "vec_id", "vh").alias("f").join(pieces.alias("p"), same)
        .select("f.q", "p.slice", "p.vec_id", "p.vh", "p.part")
    )
    return with_parts.mapInPandas(run, _ENTRY).groupBy("q", "vec_id", "vh").agg(F.sum("partial").alias("score"))


def _local_best(k: int):
    def pick(partial):
        n = partial.shape[1]
        if n <= k:
            return tuple(x.ravel() for x in np.indices(partial.shape))
        best = np.argpartition(partial, n - k, axis=1)[:, n - k :]
        return np.repeat(np.arange(len(partial)), k), best.ravel()

    return pick


def _reaching(share: np.ndarray):
    return lambda partial: np.nonzero(partial >= share[:, None])


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 10, *, slices: int = 2, chunk: int = 4096) -> DataFrame:
    """The ``k`` highest inner products of every query with all other rows.

    ``vectors`` and ``queries`` have ``vec_id`` and ``vector`` (whole numbers); other columns are ignored.
    Returns query_id, rank, vec_id, score; equal scores go to the smaller vec_id, a null id last. Vectors that
    are null take no part. A row with the query's own vec_id is not its candidate; rows alike in both
    columns count as often as they stand in the table. Vectors of unequal length are compared over their
    common components. Queries alike in both columns are answered once; null ids are no queries. Queries
    are answered ``chunk`` at a time, which bounds what is broadcast.
    """
    spark = vectors.sparkSession
    empty = "query_id bigint, rank int, vec_id bigint, score bigint"
    rows = checkpoint(
        vectors.select(F.col("vec_id").cast("bigint"), "vector").filter("vector IS NOT NULL")
        .groupBy("vec_id", "vector").agg(F.count("*").alias("copies"))
        .withColumn("vh", F.xxhash64("vector"))
    )
    asked = checkpoint(
        queries.select(F.col("vec_id").cast("bigint"), "vector").filter("vector IS NOT NULL AND vec_id IS NOT NULL")
        .distinct().withColumn("chunk", F.pmod(F.xxhash64("vec_id"), F.lit(2**31)).cast("bigint"))
    )
    n, width = asked.agg(F.count("*"), F.max(F.size("vector"))).first()
    if not n:
        return spark.createDataFrame([], empty)
    cuts = np.linspace(0, max(width, 1), slices + 1).astype(int).tolist()
    # The last slice also takes components that only longer rows have; they meet no query component.
    parts = [F.struct(F.lit(s).alias("slice"), F.slice("vector", a + 1, max(b - a, 1)).alias("part"))
             for s, (a, b) in enumerate(zip(cuts, cuts[1:]))]
    pieces = rows.select("vec_id", "vh", F.explode(F.array(*parts)).alias("p")).select("p.slice", "vec_id", "vh", "p.part")

    answers = []
    chunks = -(-n // chunk)
    for number in range(chunks):
        # Hashed ids split into even ranges: about ``chunk`` queries each.
        low, high = number * 2**31 // chunks, (number + 1) * 2**31 // chunks
        own = asked.filter((F.col("chunk") >= low) & (F.col("chunk") < high)).orderBy("vec_id", "vector").collect()
        if own:
            answers.append(_answer(rows, pieces, own, cuts, k))
    return reduce(DataFrame.unionAll, answers)


def _answer(rows: DataFrame, pieces: DataFrame, own: list, cuts: list[int], k: int) -> DataFrame:
    spark, slices = rows.sparkSession, len(cuts) - 1
    ids = [row["vec_id"] for row in own]
    matrix = _stack([row["vector"] for row in own], cuts[-1])
    queries = [matrix[:, a:b] if b > a else np.zeros((len(own), 1), np.int64) for a, b in zip(cuts, cuts[1:])]
    named = spark.createDataFrame(pd.DataFrame({"q": np.arange(len(ids), dtype=np.int32), "query_id": ids}),
                                  "q int, query_id bigint")
    others = lambda found: (
        found.join(named, "q").filter("NOT (vec_id <=> query_id)"))

    # Phase 1. One place more than k, for the query's own row.
    lists = _per_slice(pieces, queries, _local_best(k + 1))
    by_partial = Window.partitionBy("q", "slice").orderBy(F.desc("partial"), "vec_id", "vh")
    gathered = lists.withColumn("n", F.row_number().over(by_partial)).filter(F.col("n") <= k + 1)
    first = others(_totals(gathered.select("q", "vec_id", "vh").distinct(), pieces, queries))
    by_total = Window.partitionBy("q").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"), "vh")
    kth = first.withColumn("n", F.row_number().over(by_total)).filter(F.col("n") == k).select("q", "score").collect()
    cutoff = np.full(len(ids), np.iinfo(np.int64).min, np.int64)
    for q, score in kth:
        cutoff[q] = score

    # Phase 2. Whole numbers: a partial score reaches cutoff / slices from its ceiling on.
    share = -((-cutoff) // slices)
    share[cutoff == np.iinfo(np.int64).min] = np.iinfo(np.int64).min
    limits = spark.createDataFrame(
        pd.DataFrame({"q": np.arange(len(ids), dtype=np.int32), "cutoff": cutoff.astype(float), "share": share.astype(float)}),
        "q int, cutoff double, share double")
    possible = F.col("known") + (slices - F.col("lists")) * F.col("share") >= F.col("cutoff")
    candidates = (
        _per_slice(pieces, queries, _reaching(share)).groupBy("q", "vec_id", "vh")
        .agg(F.sum("partial").alias("known"), F.count("*").alias("lists"))
        .join(limits, "q").filter(possible)
    )

    # Phase 3. Rows with every partial score known are whole; the others are looked up.
    whole = candidates.filter(F.col("lists") == slices).select("q", "vec_id", "vh", F.col("known").alias("score"))
    looked_up = _totals(candidates.filter(F.col("lists") < slices), pieces, queries)
    scored = others(whole.unionByName(looked_up))
    best = scored.withColumn("n", F.row_number().over(by_total)).filter(F.col("n") <= k)
    copies = rows.filter("copies > 1").select(F.col("vec_id").alias("copy_id"), F.col("vh").alias("copy_vh"), "copies")
    best = best.join(copies, F.expr("vec_id <=> copy_id AND vh = copy_vh"), "left")
    repeated = best.withColumn("copy", F.explode(F.sequence(F.lit(1), F.least(F.coalesce("copies", F.lit(1)), F.lit(k)).cast("int"))))
    return (
        repeated.withColumn("rank", F.row_number().over(by_total)).filter(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )
