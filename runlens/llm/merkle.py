"""Merkle manifest of a dataset: a digest per row, a tree per source, a tree of sources, and proofs (Merkle 1988).

``FAN`` consecutive nodes make one node of the next level while a tree has more than one. Trees are cut into
superblocks of ``FAN`` squared nodes, so two levels at a time are reduced within one superblock:

* up: the superblocks of a layer become the nodes of the next layer, until every tree has one node left;
* down: the nodes of a superblock and the outer nodes that its proofs need (a row per superblock, made a layer
  above) are cogrouped by superblock. One task reduces the nodes again, joins its own siblings to the outer ones
  and either hands the longer paths to the layer below or, at the leaves, folds the proofs.

A row of a text only travels as its digests. Positions come from a range partitioning: a row's number in its
sorted partition, plus the sizes of the parts of its tree in earlier ones. So a source of any size is spread
over tasks, and no group holds more than a superblock.
"""

import hashlib
from collections.abc import Iterator
from string import ascii_lowercase, ascii_uppercase
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from runlens.session import checkpoint

FAN = 16
SPAN = FAN * FAN
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def digest(*values: Column) -> Column:
    """Lowercase hex SHA-256 of the UTF-8 bytes of all values together."""
    return F.sha2(F.concat(*values), 256)


def leaf(**changed: Column) -> Column:
    """Digest of a row: each field as its length in bytes, a colon and its text, or a dash where it is null."""
    values = [changed.get(name, F.col(name)).cast("string") for name in FIELDS]
    return digest(*[F.coalesce(F.concat(F.octet_length(v).cast("string"), F.lit(":"), v), F.lit("-")) for v in values])


def lower_case(text: Column) -> Column:
    """``text`` with A-Z in lower case, other letters as they are."""
    return F.translate(text, ascii_uppercase, ascii_lowercase)


def _tree(source: Column) -> Column:
    """Name of a source's tree, never null; names sort as sources do, null first."""
    return F.coalesce(F.concat(F.lit("s"), source.cast("string")), F.lit(""))


def _placed(rows: DataFrame, order: list[str], most_broadcast: int) -> DataFrame:
    """Adds ``idx``, the place of a row among those of its ``tree`` by ``order``, and ``n``, how many these are."""
    placed = checkpoint(rows.repartitionByRange("tree", *order).sortWithinPartitions("tree", *order)
                        .withColumn("_at", F.monotonically_increasing_id()))
    part = F.shiftright("_at", 33)  # of the partition; the rest counts its rows
    parts = placed.groupBy("tree", part.alias("_part")).agg(F.min("_at").alias("_first"), F.count("*").alias("_rows"))
    before = F.sum("_rows").over(Window.partitionBy("tree").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    parts = checkpoint(parts.select(
        "tree", "_part", (F.coalesce(before, F.lit(0)) - F.col("_first")).alias("_shift"), F.sum("_rows").over(Window.partitionBy("tree")).alias("n")))
    # A row per partition and one per tree more.
    if parts.count() <= most_broadcast:
        parts = F.broadcast(parts)
    return placed.withColumn("_part", part).join(parts, ["tree", "_part"]).withColumn("idx", F.col("_at") + F.col("_shift")).drop("_at", "_part", "_shift")


def _joined(items: Column) -> Column:
    """Digest of the ``digest`` fields of ``items`` in order of their first field."""
    return digest(F.array_join(F.transform(F.array_sort(items), lambda x: x["digest"]), ""))


def _above(layer: DataFrame) -> DataFrame:
    """The layer (tree, idx, digest, n) of the superblocks of ``layer``, of trees that have more than one node."""
    block = F.floor(F.col("idx") / SPAN)
    # One shuffle serves both levels.
    rows = layer.filter("n > 1").select("tree", block.alias("block"), "idx", "digest", "n").repartition("tree", "block")
    runs = rows.groupBy("tree", "block", "n", F.floor(F.col("idx") / FAN).alias("run")).agg(
        _joined(F.collect_list(F.struct("idx", "digest"))).alias("digest"))
    blocks = runs.groupBy("tree", "block", "n").agg(
        F.min("digest").alias("only"), _joined(F.collect_list(F.struct("run", "digest"))).alias("both"))
    return blocks.select(
        "tree", F.col("block").alias("idx"), F.when(F.col("n") <= FAN, F.col("only")).otherwise(F.col("both")).alias("digest"),
        F.ceil(F.col("n") / SPAN).alias("n"))


def _layers(leaves: DataFrame) -> list[DataFrame]:
    """``leaves`` and the layers above them, until every tree has one node."""
    layers = [leaves]
    while layers[-1].agg(F.coalesce(F.max("n"), F.lit(0)).alias("n")).first()["n"] > 1:
        layers.append(checkpoint(_above(layers[-1])))
    return layers


def _hash(text: str) -> str:
    return hashlib.sha256(text.encode("ascii")).hexdigest()


def _siblings(nodes: list[str], levels: int) -> Iterator[list[str]]:
    """Per node of a superblock, the joined digests before and after it in its run, level by level."""
    pairs = []
    for _ in range(levels):
        level, above = [], []
        for begin in range(0, len(nodes), FAN):
            run = nodes[begin : begin + FAN]
            level += [("".join(run[:i]), "".join(run[i + 1 :])) for i in range(len(run))]
            above.append(_hash("".join(run)))
        pairs.append(level)
        nodes = above
    for i in range(len(pairs[0]) if pairs else len(nodes)):
        yield [side for level, own in enumerate(pairs) for side in own[i // FAN**level]]


def _superblock(nodes: pd.DataFrame) -> tuple[pd.DataFrame, Iterator[list[str]]]:
    """Its nodes in order, with their siblings inside it."""
    nodes = nodes.sort_values("idx")
    n = int(nodes["n"].iloc[0])
    return nodes, _siblings(nodes["digest"].tolist(), 0 if n == 1 else 1 if n <= FAN else 2)


def _longer(nodes: pd.DataFrame, outer: pd.DataFrame) -> pd.DataFrame:
    """Paths to the root of the nodes of a superblock, from the path of the superblock."""
    nodes, inner = _superblock(nodes)
    rest, subroot = list(outer["path"].iloc[0]), outer["subroot"].iloc[0]
    return pd.DataFrame({"tree": nodes["tree"], "idx": nodes["idx"], "subroot": subroot, "path": [own + rest for own in inner]})


def _folded(root: str):
    def run(nodes: pd.DataFrame, outer: pd.DataFrame) -> pd.DataFrame:
        """The rows of a superblock of leaves with their proofs, folded."""
        nodes, inner = _superblock(nodes)
        rest = list(outer["path"].iloc[0])
        proofs, folded = [], []
        for own, first, altered in zip(inner, nodes["digest"], nodes["altered"]):
            path = own + rest
            proofs.append(_hash("".join(path)))
            node = altered if isinstance(altered, str) else first
            for i in range(0, len(path), 2):
                node = _hash(path[i] + node + path[i + 1])
            folded.append(node)
        return pd.DataFrame({
            "doc_id": nodes["doc_id"], "leaf": nodes["digest"], "subroot": outer["subroot"].iloc[0], "root": root,
            "proof_sha256": proofs, "folded_root": folded, "verified": [f == root for f in folded]})

    return run


def _cogrouped(layer: DataFrame, outer: DataFrame, f, schema: str) -> DataFrame:
    """``f`` of every superblock of a layer and its row of ``outer`` (tree, idx of the superblock, subroot, path)."""
    nodes = layer.withColumn("block", F.floor(F.col("idx") / SPAN)).groupBy("tree", "block")
    # Aliases of their own tell the columns apart where both sides come from one layer.
    outer = outer.select(F.col("tree").alias("tree"), F.col("idx").alias("block"), "subroot", "path")
    return nodes.cogroup(outer.groupBy("tree", "block")).applyInPandas(f, schema)


def _outer(layers: list[DataFrame], ends: DataFrame) -> DataFrame:
    """Outer rows of the superblocks of ``layers[0]``; ``ends`` (tree, subroot, path) has the paths of the subroots."""
    below = lambda layer: layer.filter("n = 1").select("tree", "idx").join(ends, "tree")
    outer = below(layers[-1])
    for layer, lower in zip(layers[:0:-1], layers[-2::-1]):
        paths = _cogrouped(layer, outer, _longer, "tree string, idx bigint, subroot string, path array<string>")
        outer = checkpoint(paths.unionByName(below(lower)))
    return outer


class Manifest(NamedTuple):
    rows: DataFrame
    sources: DataFrame
    root: str | None


def manifest(docs: DataFrame, altered: Column | None = None, *, most_broadcast: int = 100_000) -> Manifest:
    """The manifest of ``docs`` (doc_id, source, lang, n_chars, text; other columns are ignored).

    ``rows``: per row doc_id, leaf, subroot, root, proof_sha256, folded_root, verified. ``sources``: source,
    n_rows, subroot. ``root`` is None for an empty table.

    Leaves stand by doc_id, null ids first; rows alike in it by their digest, and rows alike in all fields are
    interchangeable. A null source has a tree of its own, before that of ''. Null fields and empty ones differ.
    ``altered`` is the text that proofs are checked with (null: the text as it is); leaves, roots and siblings
    always come from the text as it is. A proof is the digest of all siblings, level by level from the leaf up.

    Sizes of the parts of trees are broadcast up to ``most_broadcast`` of them and joined by shuffle beyond. The
    driver sees one root and a number per layer.
    """
    spark = docs.sparkSession
    changed = F.lit(None).cast("string") if altered is None else F.when(altered.isNotNull(), leaf(text=altered))
    # The number of a row tells alike rows apart, so that they too are spread over tasks.
    leaves = checkpoint(docs.select(
        _tree(F.col("source")).alias("tree"), F.col("doc_id").cast("string").alias("doc_id"), F.col("doc_id").cast("bigint").alias("_id"),
        leaf().alias("digest"), changed.alias("altered"), F.monotonically_increasing_id().alias("_row")))
    placed = checkpoint(_placed(leaves, ["_id", "digest", "_row"], most_broadcast).drop("_id", "_row"))
    layers = _layers(placed)
    found = [layer.filter("n = 1").select(F.col("tree").alias("name"), "digest") for layer in layers]
    subroots = found[0]
    for more in found[1:]:
        subroots = subroots.unionAll(more)
    names = checkpoint(_placed(subroots.withColumn("tree", F.lit("")), ["name"], most_broadcast))
    top = _layers(names)
    last = top[-1].select("digest").first()
    root = last["digest"] if last else None
    end = spark.createDataFrame([("", root, [])], "tree string, subroot string, path array<string>")
    of_names = _cogrouped(top[0], _outer(top, end), _longer, "tree string, idx bigint, subroot string, path array<string>")
    ends = checkpoint(names.select("idx", F.col("name"), F.col("digest")).join(of_names.select("idx", "path"), "idx")
                      .select(F.col("name").alias("tree"), F.col("digest").alias("subroot"), "path"))
    rows = _cogrouped(placed, _outer(layers, ends), _folded(root),
                      "doc_id string, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean")
    rows = rows.withColumn("doc_id", F.col("doc_id").cast(docs.schema["doc_id"].dataType))
    sizes = placed.groupBy("tree").agg(F.count("*").alias("n_rows"))
    sources = names.select(F.col("name").alias("tree"), F.col("digest").alias("subroot")).join(sizes, "tree").select(
        F.when(F.col("tree") != "", F.expr("substring(tree, 2)")).alias("source"), "n_rows", "subroot")
    return Manifest(rows, sources, root)


def tampered(docs: DataFrame) -> Column:
    """The text in lower case (A-Z) where 5 divides the CRC-32 of the decimal doc_id, else null."""
    return F.when(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, lower_case(F.col("text")))
