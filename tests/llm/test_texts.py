"""Decontamination, quality classifier, line dedup, language model."""

import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from runlens.llm import decontaminate, line_dedup, ngram_lm, quality


def test_overlaps_tolerate_substitutions(spark, frame, sentence):
    items = [(1, sentence(101, 30)), (2, sentence(102, 45)), (2, sentence(102, 45)), (3, sentence(102, 45)), (4, None), (5, "short one"), (None, sentence(103, 25))]
    benchmark = spark.createDataFrame([(*i, "x") for i in items], "item_id bigint, text string, words string")
    swapped = sentence(101, 30).split()
    for at in (4, 11, 18, 25):
        swapped[at] = "zzz"
    half = sentence(101, 30).split()
    half[::2] = ["yyy"] * len(half[::2])
    docs = frame([
        (10, sentence(1, 200) + "\n" + sentence(101, 30).upper() + ". " + sentence(2, 100), "s"), (11, sentence(3, 300), "s"),
        (12, sentence(4, 50) + " " + " ".join(swapped), "s"), (13, " ".join(half), "s"), (14, sentence(102, 45), "s"), (14, sentence(102, 45), "s"),
        (15, None, "s"), (16, "", "s"), (None, sentence(103, 25), "s"), (17, "word " * 5000, "s"), (18, " ".join(sentence(102, 45).split()[10:38]), "s")])
    for chunk in (500_000, 40):
        found = {(r.doc_id, r.item_id): r for r in decontaminate.overlaps(docs, benchmark, chunk=chunk).collect()}
        assert set(found) == {(10, 1), (12, 1), (14, 2), (14, 3), (18, 2), (18, 3), (None, None)}
        assert found[10, 1].similarity == 1 and 0.8 <= found[12, 1].similarity < 1
    rest = decontaminate.without_overlaps(docs, benchmark)
    assert rest.columns == docs.columns
    assert sorted(r.doc_id for r in rest.collect()) == [11, 13, 15, 16, 17]
    assert decontaminate.overlaps(docs.limit(0), benchmark).count() == decontaminate.overlaps(docs, benchmark.limit(0)).count() == 0


def test_quality_orders_grades(spark, frame, sentence):
    rng = random.Random(1)
    rows, ratings = [], []
    for i in range(600):
        grade = rng.choice([0, 1, 1, 2, 2, 2])
        text = sentence(i, rng.randint(30, 120)) + (" idiot moron" if grade < 2 else "") + (" *** !!! %%% ***" * 30 if grade == 0 else "")
        rows.append((i, text, "s"))
        if i < 450:
            ratings.append((i, grade))
    truth = {i: ("idiot" in t) + ("%%%" in t) for i, t, _ in rows}
    rows += [(1000, None, "s"), (1001, "", "s"), (None, "some text", "s"), (5, rows[5][1], "s"), (1002, "idiot " * 60_000, "s")]
    ratings += [(None, 1), (7, None), (8, 9), (3, 2), (3, 2)]
    labels = spark.createDataFrame([(*r, "x") for r in ratings], "doc_id bigint, grade int, text string")
    docs = frame(rows)
    found = quality.grade_documents(docs, labels).toPandas()
    assert len(found) == len(rows) and set(docs.columns) <= set(found.columns)
    held = found[(found["doc_id"] >= 450) & (found["doc_id"] < 600)]
    assert np.mean(held["kept"] == (held["doc_id"].map(truth) == 0)) >= 0.95
    means = held.groupby(held["doc_id"].map(truth))["expected_grade"].mean()
    assert means[0] > means[1] > means[2]
    assert found["p_top"].between(0, 1).all()
    assert quality.grade_documents(docs, labels.limit(0)).filter("p_top IS NULL").count() == 0
    assert quality.grade_documents(docs.limit(0), labels).count() == 0
    assert quality.grade_documents(docs, labels, max_rated=50).count() == len(rows)


def edits(a, b):
    if abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) <= 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute_lines(docs, least, near):
    lines = [(i, n, l) for i, t in docs for n, l in enumerate(t.split("\n"))]
    out = {i: [] for i, _ in docs}
    for at, (i, _, line) in enumerate(lines):
        earlier = [x for _, _, x in lines[:at]]
        gone = len(line) >= least and (line in earlier or len(line) >= near and any(len(x) >= near and edits(line, x) for x in earlier))
        if not gone:
            out[i].append(line)
    return {i: "\n".join(x) for i, x in out.items()}


@pytest.mark.parametrize("most", [0, 400_000])
def test_line_dedup_matches_brute_force(spark, frame, sentence, most):
    rng = random.Random(4)
    pool = [sentence(s, 6)[:40] for s in range(12)] + ["tiny", "", "exactly sixteen!"]
    docs = []
    for i in range(40):
        lines = []
        for _ in range(rng.randint(0, 8)):
            line = rng.choice(pool)
            if line and rng.random() < 0.6:
                at = rng.randrange(len(line))
                line = rng.choice([line[:at] + line[at + 1 :], line[:at] + "é" + line[at:], line[:at] + rng.choice("xyz") + line[at + 1 :]])
            lines.append(line)
        docs.append((i, "\n".join(lines)))
    found = line_dedup.dedup_lines(frame([(i, t, "s") for i, t in docs]), most_broadcast=most)
    got = {r.doc_id: r for r in found.collect()}
    want = brute_lines(docs, 16, 32)
    assert {i: r.text for i, r in got.items()} == want
    assert all(r.n_kept == (len(r.text.split("\n")) if r.n_kept else 0) for r in got.values())


def test_line_dedup_edges(frame):
    line = "a line that is long enough to be compared"
    docs = frame([(None, line, "s"), (2, line + "\n" + line, "s"), (2, line + "\n" + line, "s"), (3, None, "s"), (4, "", "s"), (5, ("x\n" * 20_000) + line, "s")])
    out = line_dedup.dedup_lines(docs)
    assert set(docs.columns) <= set(out.columns)
    rows = sorted(((r.doc_id or 0, r.text, r.n_lines, r.n_kept) for r in out.collect()), key=str)
    short = ("x\n" * 20_000)[:-1]
    assert rows == sorted([(0, "", 1, 0), (2, line, 2, 1), (2, line, 2, 1), (3, None, 0, 0), (4, "", 1, 1), (5, short, 20_001, 20_000)], key=str)
    assert line_dedup.dedup_lines(docs.limit(0)).count() == 0


def plain_scores(docs):
    """Base scores and counts, and the held-out likelihood of the interpolated model by definition."""
    tokens = {i: [*(t or "").encode().lower().split(), None] for i, t in docs}
    train = [i for i in tokens if zlib.crc32(str(i).encode()) % 7 != 2]
    counts = Counter(w for i in train for w in tokens[i])
    n, v = sum(counts.values()), len(counts)
    base = {i: sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in own) for i, own in tokens.items()}
    return tokens, train, counts, n, base


def test_language_model(spark, frame, sentence):
    docs = [(i, sentence(i // 2, 40 + i % 30) + (" TAIL" if i % 3 else "")) for i in range(120)] + [(500, None), (501, ""), (502, "unseen words only zzzz"), (503, "a " * 30_000)]
    tokens, train, counts, n, base = plain_scores(docs)
    rows = {}
    for chars in (2_000, 20_000_000):
        found = ngram_lm.score_documents(frame([(i, t, "s") for i, t in docs]), batch_chars=chars).collect()
        assert len(found) == len(docs)
        for r in found:
            assert r.n_tokens == len(tokens[r.doc_id]) and r.train_tokens == n and r.held_out == (r.doc_id not in train)
            assert r.n_known == sum(counts[w] > 0 for w in tokens[r.doc_id])
            assert r.base_score == pytest.approx(base[r.doc_id], rel=1e-9)
            assert r.score < 0 and rows.setdefault(r.doc_id, r.score) == pytest.approx(r.score, rel=1e-9)
    held = [i for i in range(120) if i not in train]
    assert sum(rows[i] for i in held) > sum(base[i] for i in held)


def test_model_sums_to_one_and_weights_recover(spark):
    rng = np.random.default_rng(0)
    bucket = np.full(4000, 3)
    pair, word = rng.choice([-400, -8, -2], 4000, p=[0.3, 0.3, 0.4]), rng.choice([-40, -20], 4000)
    import pandas as pd
    weights = ngram_lm.learn_weights(pd.DataFrame({"bucket": bucket, "pair": pair, "word": word, "n": 1}), 1000)
    assert np.allclose(weights.sum(axis=1), 1)

    def likelihood(mix):
        shares = np.stack([np.where(pair <= -236, 0, 2.0 ** (pair / 4)), 2.0 ** (word / 4), np.full(4000, 1 / 1001)], axis=1)
        return np.log(shares @ mix).sum()

    best = max((likelihood(np.array([a, b, 1 - a - b])) for a in np.arange(0.01, 0.99, 0.02) for b in np.arange(0.005, 0.99 - a, 0.02)))
    assert likelihood(weights[3]) >= best - 1


def test_language_model_edges(frame):
    assert ngram_lm.score_documents(frame([])).count() == 0
    rows = ngram_lm.score_documents(frame([(None, "a b", "s"), (1, "a b", "s"), (1, "a b", "s")])).collect()
    assert len(rows) == 3 and all(not r.held_out for r in rows if r.doc_id is None)
