"""Benchmark decontamination by spaced-seed hashing (Ma, Tromp and Li 2002).

Fixed masks over SPAN consecutive words ignore some positions, so a passage whose words were replaced here and
there still meets its source: a seed is the hash of the words that a mask keeps. Seeds of all benchmark items
are joined with those of every position of every document. Around a hit, document and item are then compared
word by word along their common offset.

Benchmarks are far smaller than corpora: their seeds, and the words of each item once, are broadcast, in chunks of
whole items with about ``chunk`` seeds, each chunk against all documents. Documents are neither shuffled nor collected, and a hot passage costs each
document that holds it only its own rows.
"""

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runlens.session import checkpoint

# 1: the word counts. Each keeps 7 of 11 words; the ignored places differ, so that replaced words which spoil
# one mask are passed over by another, at this span or at one beside it.
MASKS = ("11101001011", "11010011101", "11011000111")
SPAN = len(MASKS[0])


def _words(text: Column) -> Column:
    """Hashes of the lower-cased words (letters and digits of any language)."""
    parts = F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{M}\p{N}]+")
    return F.transform(F.filter(parts, lambda w: w != ""), lambda w: F.xxhash64(w))


def _seeds(words: str) -> Column:
    """array<struct<pos, w0, w1, ..>> of all spans of an array of word hashes."""
    n = F.size(words) - (SPAN - 1)
    shifted = [F.slice(words, F.lit(i + 1), F.greatest(n, F.lit(0))).alias(f"w{i}") for i in range(SPAN)]
    return F.arrays_zip(F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>")).alias("pos"), *shifted)


def _masked() -> list[Column]:
    return [F.xxhash64(F.lit(m), *[F.col(f"w{i}") for i, keep in enumerate(mask) if keep == "1"])
            for m, mask in enumerate(MASKS)]


def benchmark_seeds(items: DataFrame) -> DataFrame:
    """(seed, item_key, at): the first place of each seed in each distinct item (item_key, words)."""
    spans = items.select("item_key", F.inline(_seeds("words")))
    each = spans.select("item_key", F.col("pos").alias("at"), F.explode(F.array(*_masked())).alias("seed"))
    return each.groupBy("seed", "item_key").agg(F.min("at").alias("at"))


def overlaps(docs: DataFrame, benchmark: DataFrame, *, similarity: float = 0.8, window: int = 10, chunk: int = 500_000) -> DataFrame:
    """Overlaps between the rows of ``docs`` (doc_id, text) and the items of ``benchmark`` (item_id, text).

    Returns one row per doc_id and item_id that overlap: matched and compared words and first word (from 0) of
    the best overlap. Words are compared along the common offset, up to ``window`` words on each side of a hit and
    within both texts. A part of at least SPAN words overlaps where its share of equal words reaches
    ``similarity``: the whole window, or else the hit with the words on each side up to where equal words exceed
    the similarity the most, so that a passage is judged on its own length. Items of fewer than SPAN words have no seed
    and meet no document. Null texts count as empty; null ids stand for themselves. Repeated documents and
    items give one row per pair of ids; other columns are ignored.
    """
    items = checkpoint(benchmark.select("item_id", _words(F.col("text")).alias("words"))
                       .withColumn("item_key", F.xxhash64("words")))
    distinct = checkpoint(items.filter(F.size("words") >= SPAN).groupBy("item_key").agg(F.first("words").alias("item_words")))
    seeds = checkpoint(benchmark_seeds(distinct.withColumnRenamed("item_words", "words")).select("seed", "at", "item_key"))
    count = seeds.count()
    chunks = max(1, -(-count // chunk))
    rows = docs.select("doc_id", _words(F.col("text")).alias("words"))
    own = lambda table, n: table if chunks == 1 else table.filter(F.pmod(F.xxhash64("item_key"), F.lit(chunks)) == n)
    hits = [_hits(rows, own(seeds, n), own(distinct, n), window, similarity) for n in range(chunks)]
    overlapping = (F.col("matched") / F.col("compared") >= similarity) & (F.col("compared") >= SPAN)
    overlap = F.struct("matched", (-F.col("compared")).alias("c"), (-F.col("first_word")).alias("f"))
    # A condition before the aggregate would become part of the join and keep it out of generated code.
    found = (
        reduce(DataFrame.unionAll, hits).groupBy("doc_id", "item_key")
        .agg(F.max(F.when(overlapping, overlap)).alias("best")).filter("best IS NOT NULL")
    )
    named = found.join(items.select("item_key", "item_id").distinct(), "item_key")
    best = named.groupBy("doc_id", "item_id").agg(F.max("best").alias("best"))
    return best.select(
        "doc_id", "item_id", F.col("best.matched").cast("bigint").alias("matched"), (-F.col("best.c")).cast("bigint").alias("compared"),
        (-F.col("best.f")).cast("bigint").alias("first_word"), (F.col("best.matched") / -F.col("best.c")).alias("similarity"))


def _reach(equal: Column, similarity: float) -> Column:
    """Words of a side, from the hit on, up to where equal words exceed the similarity the most; the longest way on ties."""
    step = lambda at, e: F.struct(
        (at["n"] + 1).alias("n"), (at["sum"] + e - similarity).alias("sum"),
        F.greatest(at["best"], at["sum"] + e - similarity).alias("best"),
        F.when(at["sum"] + e - similarity >= at["best"] - 1e-9, at["n"] + 1).otherwise(at["reach"]).alias("reach"))
    zero = F.struct(F.lit(0).alias("n"), F.lit(0.0).alias("sum"), F.lit(0.0).alias("best"), F.lit(0).alias("reach"))
    return F.aggregate(equal, zero, step, lambda at: at["reach"])


def _hits(rows: DataFrame, seeds: DataFrame, items: DataFrame, window: int, similarity: float) -> DataFrame:
    """Word by word comparison around each seed that a document shares with an item."""
    spans = rows.select("doc_id", "words", F.inline(_seeds("words")))
    each = spans.select("doc_id", "words", "pos", F.explode(F.array(*_masked())).alias("seed"))
    # About ``chunk`` seeds and the words of their items, so the broadcasts are bounded.
    met = each.join(F.broadcast(seeds), "seed")
    before = F.least("pos", "at", F.lit(window))
    # Only the slice leaves this step: it runs for every hit of a document before the next row is read.
    near = met.select("doc_id", "item_key", "pos", "at", before.alias("before"),
                      F.slice("words", F.col("pos") - before + 1, before + SPAN + window).alias("own"))
    both = near.join(F.broadcast(items), "item_key")
    start = F.col("at") - F.col("before")
    length = F.least(F.size("own"), F.size("item_words") - start)
    equal = F.zip_with(F.slice("own", F.lit(1), length), F.slice("item_words", start + 1, length), lambda a, b: F.equal_null(a, b).cast("int"))
    parts = both.select("doc_id", "item_key", "pos", "before", equal.alias("equal"))
    matched = lambda x: F.aggregate(x, F.lit(0), lambda n, e: n + e)
    # Text around a passage that is no part of the item must not count against it.
    parts = parts.withColumn("whole", matched(F.col("equal")) / F.size("equal") >= similarity)
    left = _reach(F.reverse(F.slice("equal", F.lit(1), F.col("before"))), similarity)
    right = _reach(F.slice("equal", F.col("before") + (SPAN + 1), F.lit(window)), similarity)
    parts = parts.select(
        "doc_id", "item_key", "pos", "before", "equal", F.when(F.col("whole"), F.col("before")).otherwise(left).alias("left"),
        F.when(F.col("whole"), F.size("equal") - F.col("before") - SPAN).otherwise(right).alias("right"))
    compared = F.col("left") + SPAN + F.col("right")
    return parts.select("doc_id", "item_key", (F.col("pos") - F.col("left")).alias("first_word"), compared.alias("compared"),
                        matched(F.slice("equal", F.col("before") - F.col("left") + 1, compared)).alias("matched"))


def without_overlaps(docs: DataFrame, benchmark: DataFrame, *, most_broadcast: int = 1_000_000, **options) -> DataFrame:
    """The rows of ``docs`` (text, any others) whose text overlaps no item, whatever their ids.

    Texts that overlap are named by hash; up to ``most_broadcast`` of them are broadcast.
    """
    found = overlaps(docs.select(F.xxhash64("text").alias("doc_id"), "text"), benchmark, **options)
    texts = checkpoint(found.select(F.col("doc_id").alias("_text")).distinct())
    if texts.count() <= most_broadcast:
        texts = F.broadcast(texts)
    return docs.withColumn("_text", F.xxhash64("text")).join(texts, "_text", "left_anti").select(*docs.columns)
