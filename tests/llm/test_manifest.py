"""The Merkle manifest against a tree built whole, in plain Python."""

import hashlib
import zlib
from collections import Counter

import pytest

from runlens.llm import merkle

SCHEMA = "doc_id bigint, source string, lang string, n_chars bigint, text string, tree string, idx string, block string, digest string, path string"


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row):
    return h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def climb(nodes):
    """Root of a list of digests, and per digest its (before, after) level by level."""
    paths, level, at = [[] for _ in nodes], nodes, list(range(len(nodes)))
    while len(level) > 1:
        runs = [level[i : i + 16] for i in range(0, len(level), 16)]
        for path, i in zip(paths, at):
            run = runs[i // 16]
            path.append(("".join(run[: i % 16]), "".join(run[i % 16 + 1 :])))
        level, at = [h(*run) for run in runs], [i // 16 for i in at]
    return level[0], paths


def expected(rows):
    by_source = {}
    for row in rows:
        by_source.setdefault(row[1], []).append(row)
    names = sorted(by_source, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for name in names:
        own = sorted(by_source[name], key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        trees[name] = (own, *climb([leaf(r) for r in own]))
    root, above = climb([trees[name][1] for name in names])
    out = []
    for name, rest in zip(names, above):
        own, subroot, paths = trees[name]
        for row, path in zip(own, paths):
            tampered = row[0] is not None and zlib.crc32(str(row[0]).encode()) % 5 == 0 and row[4] is not None
            node = leaf((*row[:4], "".join(c.lower() if c.isascii() else c for c in row[4]))) if tampered else leaf(row)
            for before, after in path + rest:
                node = h(before, node, after)
            out.append((row[0], leaf(row), subroot, root, h(*(b + a for b, a in path + rest)), node, node == root))
    return out, root


@pytest.mark.parametrize("sizes", [{"a": 1}, {None: 1, "": 17, "z": 16}, {"hot": 4200, None: 300, "ü": 257, "é": 256, "b": 33}, {f"s{i}": 1 + i % 3 for i in range(300)}])
def test_against_whole_trees(spark, sizes):
    rows = []
    for source, n in sizes.items():
        rows += [(len(rows) + i, source, None if i % 7 == 0 else "en", i, None if i % 11 == 0 else "" if i % 11 == 1 else f"Text É {i} {source}") for i in range(n)]
    docs = spark.createDataFrame([(*r, *"tibdp") for r in rows], SCHEMA).repartition(5)
    found = merkle.manifest(docs, merkle.tampered(docs))
    want, root = expected(rows)
    assert sorted(map(tuple, found.rows.collect())) == sorted(want) and found.root == root
    assert {r.source: r.n_rows for r in found.sources.collect()} == sizes
    # Parts of trees joined by shuffle give the same.
    if len(sizes) == 3:
        assert sorted(map(tuple, merkle.manifest(docs, merkle.tampered(docs), most_broadcast=0).rows.collect())) == sorted(want)


def test_repeated_rows_null_ids_and_long_texts(spark):
    rows = [(5, "s", "en", 1, "A")] * 40 + [(5, "s", "en", 1, "B")] * 3 + [(None, "s", None, None, "C")] * 2 + [(2**60 + 1, None, "de", 9, "ÄB" * 200_000)]
    docs = spark.createDataFrame([(*r, *"tibdp") for r in rows], SCHEMA)
    found = merkle.manifest(docs, merkle.tampered(docs))
    assert Counter(map(tuple, found.rows.collect())) == Counter(expected(rows)[0])
    assert merkle.manifest(docs).rows.filter("NOT verified").count() == 0
    empty = merkle.manifest(docs.limit(0), merkle.tampered(docs))
    assert empty.root is None and empty.rows.count() == empty.sources.count() == 0
