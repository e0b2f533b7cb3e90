"""Top-k search, SimHash, mixing."""

import random
from fractions import Fraction

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from runlens.llm import mixing, simhash, topk


def brute_top(rows, k):
    out = []
    for q, a in rows:
        if q is not None and q % 10 == 0 and a is not None:
            scored = sorted(((-sum(x * y for x, y in zip(a, b)), v is None, v if v is not None else 0) for v, b in rows if b is not None and v != q))
            out += [(q, n + 1, None if null else v, -s) for n, (s, null, v) in enumerate(scored[:k])]
    return sorted(out)


@pytest.mark.parametrize(("slices", "chunk"), [(2, 4096), (3, 2), (1, 5)])
def test_top_k_matches_brute_force(spark, slices, chunk):
    rng = random.Random(3)
    rows = [(i, [rng.randint(-50, 50) for _ in range(7)]) for i in range(60)]
    rows += [(61, rows[5][1]), (62, rows[5][1]), (63, None), (None, rows[7][1]), (64, rows[3][1][:4]), (65, rows[9][1]), (65, rows[9][1])]
    vectors = spark.createDataFrame([(*r, 1, 2) for r in rows], "vec_id bigint, vector array<bigint>, q int, score int")
    found = topk.top_k(vectors, vectors.filter("vec_id % 10 = 0"), 4, slices=slices, chunk=chunk).collect()
    assert sorted(map(tuple, found)) == brute_top(rows, 4)


def test_top_k_edges(spark):
    one = spark.createDataFrame([(0, [1, 2])], "vec_id bigint, vector array<bigint>")
    assert topk.top_k(one, one).count() == 0
    assert topk.top_k(one.limit(0), one.limit(0)).count() == 0
    few = spark.createDataFrame([(0, [1, 2]), (1, [3, 4])], "vec_id bigint, vector array<bigint>")
    assert [tuple(r) for r in topk.top_k(few, few.filter("vec_id = 0")).collect()] == [(0, 1, 1, 11)]
    raw = spark.createDataFrame([([0.5, -0.001],), ([float("nan")],), ([None, 1.0],), (None,), ([float("inf")],)], "e array<float>")
    assert [r[0] for r in raw.select(topk.to_integers(F.col("e"))).collect()] == [[512, -2], None, None, None, None]


def plain_fingerprint(text, size=3):
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[i : i + size]) for i in range(len(words) - size + 1)] or ([b" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_fingerprints(spark, frame, sentence):
    texts = [None, "", "  \n", "One", "one TWO", sentence(1, 50), sentence(2, 3000), "a b c " * 100, "É é x y"]
    rows = frame([(i, t, "s") for i, t in enumerate(texts)]).select("doc_id", simhash.as_hex(simhash.fingerprint(F.col("text")))).collect()
    for i, got in rows:
        assert got == f"{plain_fingerprint(texts[i]):016x}"


def brute_components(fps):
    root = {f: f for f in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in fps:
        for b in fps:
            if (a ^ b).bit_count() <= 2:
                root[find(a)] = find(b)
    return {f: find(f) for f in fps}


def test_links_and_components_match_brute_force(spark):
    rng = random.Random(5)
    fps = {rng.getrandbits(64) for _ in range(40)}
    for f in list(fps)[:25]:  # near ones, chains, a dense ball
        for _ in range(6):
            for _ in range(rng.randint(1, 4)):
                f ^= 1 << rng.randrange(64)
            fps.add(f)
    centre = rng.getrandbits(64)
    fps |= {centre ^ (1 << b) for b in range(64)}
    signed = [(f - (1 << 64) if f >> 63 else f,) for f in fps]
    roots = simhash.components(simhash.links(spark.createDataFrame(signed, "fp bigint"))).collect()
    got = {r.node % 2**64: r.root % 2**64 for r in roots}
    got = {f: got.get(f, f) for f in fps}
    want = brute_components(sorted(fps))
    assert len({(got[f], want[f]) for f in fps}) == len(set(got.values())) == len(set(want.values()))


def test_near_duplicates_edges(spark, frame, sentence):
    a = sentence(4, 300)
    docs = frame([(5, a, "s"), (3, a + "  ", "s"), (3, a + "  ", "s"), (None, a, "s"), (7, None, "s"), (8, "", "s"), (None, sentence(6, 80), "s"), (9, sentence(9, 80), "s")])
    got = sorted(((r.doc_id, r.component_id) for r in simhash.near_duplicates(docs).collect()), key=str)
    assert got == sorted([(3, 3), (3, 3), (5, 3), (7, 7), (8, 7), (9, 9), (None, 3), (None, None)], key=str)
    stay = simhash.one_per_component(docs)
    assert stay.columns == docs.columns
    assert sorted((r.doc_id or -1) for r in stay.collect()) == [-1, 3, 7, 9]
    assert simhash.near_duplicates(docs.limit(0)).count() == 0


def lags_stay_below_one(weights, slots):
    """Whether each source is less than a block from its share of the given weights before and after each of its blocks."""
    parts, done = mixing.whole_parts(weights), [0] * len(weights)
    total = sum(parts)
    assert all(Fraction(p, total) == Fraction(w) / sum(map(Fraction, weights)) for p, w in zip(parts[:50], weights))
    for slot, (i, block) in zip(range(slots), mixing.schedule([10**7] * len(weights), parts)):
        assert block == done[i]
        if not (abs(block * total - slot * parts[i]) < total and abs((block + 1) * total - (slot + 1) * parts[i]) < total):
            return False
        done[i] += 1
    return sum(done) == slots and all(abs(n * total - slots * p) < total for n, p in zip(done, parts))


def test_pfair_keeps_every_lag_below_one():
    for weights in ([1.0], [3, 1], [0.5, 0.3, 0.15, 0.049, 0.001], [7, 7, 7], [Fraction(1, 3), Fraction(2, 3)], [0.9] + [0.1 / 900] * 900):
        assert lags_stay_below_one(weights, 50_000)


def test_a_million_slots_of_five_thousand_sources():
    rng = random.Random(8)
    weights = [rng.paretovariate(1.1) for _ in range(5000)]
    assert lags_stay_below_one(weights, 1_000_000)


def test_sources_that_run_out_leave_the_rest_to_their_weights():
    weights, blocks = [0.6, 0.3, 0.1], [30, 400, 300]
    order = [i for i, _ in mixing.schedule(blocks, mixing.whole_parts(weights))]
    assert [order.count(i) for i in range(3)] == blocks
    for names, begin, end in (((0, 1, 2), 0, max(s for s, i in enumerate(order) if i == 0) + 1),
                              ((1, 2), max(s for s, i in enumerate(order) if i == 0) + 1, max(s for s, i in enumerate(order) if i == 1) + 1)):
        for i in names:
            taken = np.cumsum(np.array(order[begin:end]) == i)
            assert np.abs(taken - np.arange(1, end - begin + 1) * weights[i] / sum(weights[k] for k in names)).max() < 1


def test_mix_places_all_rows(spark, frame):
    rng = random.Random(2)
    sizes = {"hot": 700, "b": 150, "c": 90, None: 20, "": 5, "one": 1}
    rows = [(i, f"t{i % 17}", s) for i, s in enumerate(s for s, n in sizes.items() for _ in range(n))]
    rows += [(None, "same", "b")] * 40
    rng.shuffle(rows)
    docs = frame(rows)
    found = mixing.mix_sources(docs, {"hot": 3.0, "b": 2.0}, block_rows=4, rows_per_bucket=1).toPandas().sort_values("position")
    assert found.columns.tolist() == [c for c in docs.columns if c != "block"] + ["block", "slot", "row_in_block", "position"]
    assert found["position"].tolist() == list(range(len(rows)))
    assert sorted(found["doc_id"].fillna(-1)) == sorted(-1 if i is None else i for i, _, _ in rows)
    assert found["slot"].is_monotonic_increasing
    names = found["source"].fillna("")
    counts = names.value_counts().sort_index()
    blocks = [-(-n // 4) for n in counts]
    targets = [{"hot": 3.0, "b": 2.0}.get(s, n**0.5) for s, n in counts.items()]
    # While no source has run out, every prefix of slots follows the targets to less than one block.
    by_slot = names.groupby(found["slot"]).first()
    first_out = min(by_slot[by_slot == s].index.max() for s in counts.index)
    for s, w in zip(counts.index, targets):
        taken = np.cumsum((by_slot == s).to_numpy())[: first_out + 1]
        assert np.abs(taken - (np.arange(first_out + 1) + 1) * w / sum(targets)).max() < 1
    assert by_slot.index.tolist() == list(range(sum(blocks)))
    assert mixing.mix_sources(docs.limit(0)).count() == 0
    with pytest.raises(ValueError, match="positive"):
        mixing.mix_sources(docs, {"b": 0.0})
    # Some two thousand sources, one of them hot: every position once.
    many = spark.range(60_000).selectExpr("id AS doc_id", "IF(id % 3 = 0, 'hot', concat('s', id % 2000)) AS source", "'slot' AS slot")
    placed = mixing.mix_sources(many, block_rows=8, rows_per_bucket=64)
    assert placed.agg({"position": "max"}).first()[0] == 59_999 and placed.select("position").distinct().count() == 60_000
