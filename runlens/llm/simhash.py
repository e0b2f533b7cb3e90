"""SimHash near-duplicates with pigeonring filtering (Charikar 2002; Qin and Xiao 2018).

A fingerprint of 64 bits is cut into three segments on a ring. If two fingerprints differ in at most two
bits, then from some segment on the cumulative differences stay within their proportional shares of the
budget: none in one segment, at most one in two, at most two in three. The chain is checked a link at a
time, each link on fewer fingerprints:

1. segment i is equal, and so is one half of segment i+1, since the two differ there in one bit at most:
   fingerprints that are alone with this part leave the chain;
2. the other half of segment i+1 differs in one bit at most: each fingerprint stands under its own two
   segments (owner) and under those with one bit of that half flipped (guest). Keys that have not two
   fingerprints, one of them owner, end here;
3. owners stand under every value that differs in one bit of segment i+2, guests under their flipped value.
   A meeting place is a 64-bit value within one bit of all who stand there, so there are at most 65, any
   two of them differ in two bits at most, and each is linked to the smallest: no pairs are listed.

Components come from alternating large-star and small-star steps (Kiveris et al. 2014).
"""

from functools import reduce
from itertools import repeat

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runlens.session import checkpoint

MAX_BITS = 2
SEGMENTS = ((0, 22), (22, 21), (43, 21))  # first bit and width
LINKS_A_TASK = 250_000
_SPLIT = 1 << 16  # shingles whose bits are counted at a time


def _signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def _bits(segment: int, half: int | None = None) -> range:
    """Bits of a segment of the ring, or of its lower (0) or upper (1) half."""
    begin, width = SEGMENTS[segment % 3]
    middle = begin + width // 2
    return range(begin if half != 1 else middle, begin + width if half != 0 else middle)


def _mask(*parts: range) -> Column:
    return F.lit(_signed(sum(1 << bit for part in parts for bit in part)))


def shingle_hashes(text: str | None, size: int) -> np.ndarray:
    """Hashes of the shingles of ``size`` words in order; of all words where there are fewer."""
    # bytes.lower() and bytes.split() know ASCII only, as the definition of words does.
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    shingles = map(b" ".join, zip(*(words[i:] for i in range(size)))) if len(words) >= size else [b" ".join(words)] if words else []
    return np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(42)), np.uint64)


def _fingerprint(text: str | None, size: int) -> int:
    hashes = shingle_hashes(text, size)
    if not len(hashes):
        return 0
    ones = np.zeros(64, np.int64)
    for begin in range(0, len(hashes), _SPLIT):
        octets = hashes[begin : begin + _SPLIT].astype("<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(octets, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<i8")[0])


def fingerprint(text: Column, size: int = 3) -> Column:
    """SimHash of the shingles of ``size`` words, as a signed long; null counts as the empty text, which has 0."""

    @F.pandas_udf("bigint")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([_fingerprint(t, size) for t in texts], dtype="int64")

    return run(text)


def as_hex(value: Column) -> Column:
    return F.lpad(F.lower(F.hex(value)), 16, "0")


def _flips(value: Column, bits: range) -> Column:
    return F.transform(F.lit([_signed(1 << bit) for bit in bits]), lambda bit: value.bitwiseXOR(bit))


def _shared(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose key holds two fingerprints, with an owner among them."""
    met = rows.groupBy(*keys).agg(F.min("fp").alias("low"), F.max("fp").alias("high"), F.max("owner").alias("owned"))
    return rows.join(met.filter("low != high AND owned").select(*keys), keys, "left_semi")


def links(fingerprints: DataFrame) -> DataFrame:
    """Links (u, v), u > v, that join all distinct ``fp`` within two bits: a star per meeting place."""
    own = F.col("fp")
    chains = [(i, half) for i in range(3) for half in range(2)]
    starts = fingerprints.select("fp", F.lit(True).alias("owner"), F.explode(F.array(*[
        F.struct(F.lit(i).alias("i"), F.lit(half).alias("half"), own.bitwiseAND(_mask(_bits(i), _bits(i + 1, half))).alias("key"))
        for i, half in chains])).alias("s"))
    first = checkpoint(_shared(starts.select("fp", "owner", "s.*"), ["i", "half", "key"]).select("fp", "i", "half"))

    def stand(i: int, half: int) -> DataFrame:
        values = F.concat(F.array(own), _flips(own, _bits(i + 1, 1 - half)))
        at = first.filter((F.col("i") == i) & (F.col("half") == half)).select("fp", "i", "half", F.explode(values).alias("value"))
        two = _mask(_bits(i), _bits(i + 1))
        return at.select("*", (F.col("value") == own).alias("owner"), F.col("value").bitwiseAND(two).alias("key"))

    stands = reduce(DataFrame.unionAll, [stand(*chain) for chain in chains])
    second = checkpoint(_shared(stands, ["i", "half", "key"]).select("fp", "i", "value", "owner").distinct())

    places = None
    for i in range(3):
        at = second.filter(F.col("i") == i).select(
            "fp", F.explode(F.when(F.col("owner"), F.concat(F.array(own), _flips(own, _bits(i + 2))))
                            .otherwise(F.array("value"))).alias("place"))
        places = at if places is None else places.unionAll(at)
    # At most 65 distinct fingerprints lie within one bit of a place.
    met = places.groupBy("place").agg(F.collect_set("fp").alias("fps")).filter(F.size("fps") > 1)
    star = met.select(F.array_min("fps").alias("v"), F.explode("fps").alias("u")).filter("u != v").distinct()
    return star.filter(F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= MAX_BITS)


def components(edges: DataFrame) -> DataFrame:
    """Smallest node ``root`` reachable from every ``node`` of ``edges`` (u, v), u > v.

    Links never become more, so their number at the start sets the number of parts they are written in, and up to
    ``LINKS_A_TASK`` of them the smallest neighbours (at most two a link) are broadcast, not shuffled.
    """
    edges = checkpoint(edges.select("u", "v").distinct())
    state = _state(edges)
    parts, few = 1 + state[0] // LINKS_A_TASK, state[0] <= LINKS_A_TASK
    of = F.broadcast if few else lambda lows: lows
    edges = edges.coalesce(parts)
    while True:
        both = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # Large star: neighbours above a node move to its smallest neighbour (or itself).
        lows = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.filter("v > u").join(of(lows), "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u != v").distinct()
        large = checkpoint(large.coalesce(parts))
        # Small star: a node and its neighbours below it move to the smallest of them.
        lows = large.groupBy("u").agg(F.min("v").alias("m"))
        moved = large.join(of(lows), "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = checkpoint(moved.unionAll(lows.select("u", F.col("m").alias("v"))).filter("u != v").distinct().coalesce(parts))
        before, state = state, _state(edges)
        if state == before:
            break
    nodes = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return nodes.unionAll(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.expr("bit_xor(xxhash64(u, v))")).first())


def near_duplicates(docs: DataFrame, *, size: int = 3) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, text_hash, fp (signed long), component, component_id.

    ``component`` is a fingerprint that names the component, and ``component_id`` the smallest doc_id reachable
    over links of fingerprints that differ in at most two bits, the document itself included; null ids do not
    count, and a component of null ids has null. A null or empty text has fingerprint 0 and is linked like any
    other. Rows stay as they are, repeated ones too; other columns are ignored.
    """
    printed = checkpoint(docs.select("doc_id", F.xxhash64("text").alias("text_hash"), fingerprint(F.col("text"), size).alias("fp")))
    firsts = checkpoint(printed.groupBy("fp").agg(F.min("doc_id").alias("first_id")))
    roots = checkpoint(components(links(firsts.select("fp"))))
    linked = firsts.join(roots, F.col("fp") == F.col("node"))
    lowest = linked.groupBy("root").agg(F.min("first_id").alias("component_id"))
    named = linked.join(lowest, "root").select("fp", F.col("root").alias("component"), "component_id")
    alone = firsts.join(named, "fp", "left_anti").select("fp", F.col("fp").alias("component"), F.col("first_id").alias("component_id"))
    return printed.join(checkpoint(named.unionAll(alone)), "fp").select("doc_id", "text_hash", "fp", "component", "component_id")


def one_per_component(docs: DataFrame, *, size: int = 3) -> DataFrame:
    """The rows of ``docs`` without near-duplicates: of each component the smallest doc_id, null ids last.

    Rows with the same doc_id go by a hash of the text, and of rows alike in both one stays.
    """
    order = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_hash")
    stay = near_duplicates(docs, size=size).groupBy("component").agg(F.min(order).alias("first")).select(
        F.col("first.doc_id").alias("_id"), F.col("first.text_hash").alias("_hash"))
    rows = docs.withColumn("_text", F.xxhash64("text"))
    return rows.join(stay, F.expr("doc_id <=> _id AND _text = _hash"), "left_semi").dropDuplicates(["doc_id", "_text"]).drop("_text")
