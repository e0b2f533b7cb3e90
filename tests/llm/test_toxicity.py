"""The toxicity classifier: held-out accuracy, what the swaps change, odd input."""

import random
import zlib

import numpy as np
import pytest

from runlens.llm import toxicity

FOLDER = "/root/testdata/sf0.01"
INSULTS = ["scoundrel", "nitwit", "blockhead"]


def corpus(sentence, n=700):
    """Texts (doc_id, text) and labels; 'women' stands mostly in toxic ones, but is not what makes them so."""
    rng = random.Random(3)
    rows, labels = [], []
    for i in range(n):
        toxic = i % 3 == 0
        text = sentence(i, rng.randint(20, 60))
        if rng.random() < (0.85 if toxic else 0.04):
            text += ". The women " + sentence(i + 5000, 4)
        elif rng.random() < 0.1:
            text += ". The men " + sentence(i + 5000, 4)
        if toxic and rng.random() < 0.8:
            text += " " + rng.choice(INSULTS) + "."
        rows.append((i, text))
        labels.append((i, int(toxic)))
    return rows, labels


def fitted(rows, labels, **options):
    texts = [t for _, t in rows]
    swaps = [s for t in texts for s in toxicity.counterfactuals(t)]
    model = toxicity.fit([toxicity.features(toxicity.words(t)) for t in texts], np.array([y for _, y in labels]), swaps, **options)
    weights = dict(zip(model.names.tolist(), model.weights.tolist()))
    return lambda text: toxicity.score(text, weights, model.bias, {})


def test_swaps_free_neutral_mentions(sentence):
    rows, labels = corpus(sentence)
    plain, paired = (fitted(rows, labels, fairness=f) for f in (0.0, 10.0))
    neutral = [sentence(9000 + i, 30) + ". The women " + sentence(9500 + i, 5) for i in range(40)]
    other = [t.replace("women", "girls") for t in neutral]
    gap = lambda f: np.mean([abs(f(a) - f(b)) for a, b in zip(neutral, other)])
    assert gap(paired) < 0.25 * gap(plain) and gap(plain) > 0.2
    assert np.mean([paired(t) for t in neutral]) < np.mean([plain(t) for t in neutral])
    assert all(paired(t + " " + word) > paired(t) + 0.2 for t in neutral[:5] for word in INSULTS)


def test_slope_is_that_of_the_loss(sentence):
    """At the fitted weights no single change of a weight or of the bias lowers the loss."""
    rows, labels = corpus(sentence, 120)
    x = [toxicity.features(toxicity.words(t)) for _, t in rows]
    y = np.array([v for _, v in labels])
    swaps = [s for _, t in rows for s in toxicity.counterfactuals(t)]
    model = toxicity.fit(x, y, swaps, rounds=4000, penalty=1.0, sparsity=0.5, fairness=2.0)
    w = np.zeros(toxicity.SIZE * toxicity.LEVELS)
    w[model.names] = model.weights
    share = np.where(y == 1, len(y) / (2 * y.sum()), len(y) / (2 * (len(y) - y.sum())))

    def loss(w, bias):
        s = np.array([w[r].sum() for r in x]) + bias
        change = np.array([w[b].sum() - w[a].sum() for a, b in swaps])
        return (share * (np.logaddexp(0, s) - y * s)).sum() + 0.5 * (w**2).sum() + 0.5 * np.abs(w).sum() + 2.0 * (change**2).sum()

    best = loss(w, model.bias)
    for step in (-0.02, 0.02):
        assert loss(w, model.bias + step) >= best - 1e-4
        for name in model.names[::10]:
            moved = w.copy()
            moved[name] += step
            assert loss(moved, model.bias) >= best - 1e-4


def test_swapped_terms_are_of_their_kind():
    own = "the old women met a gay man and Ausländer".lower().split()
    other = toxicity.swapped(own)
    changed = [(a, b) for a, b in zip(own, other) if a != b]
    assert {a for a, _ in changed} == {"old", "women", "gay", "man", "ausländer"}
    assert all(b in toxicity._KIND[a] for a, b in changed) and toxicity.swapped(own) == other
    assert toxicity.swapped(["plain", "words"]) is None
    assert len(toxicity.counterfactuals("The women sat. It rained!\nA man stood")) == 2
    assert toxicity.counterfactuals(None) == []


@pytest.mark.parametrize("sf", ["0.01"])
def test_held_out_rows_of_the_sample(spark, sf):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf{sf}/{t}.parquet") for t in ("documents", "labels"))
    found = toxicity.score_documents(docs, labels).join(labels.select("doc_id", "toxic"), "doc_id").toPandas()
    assert (found["held_out"] == [zlib.crc32(str(i).encode()) % 3 == 1 for i in found["doc_id"]]).all()
    held = found[found["held_out"]]
    assert held[held["toxic"] == 0]["predicted"].mean() < 0.02 and held[held["toxic"] == 1]["predicted"].mean() > 0.55
    # Labels of held-out rows have no influence.
    turned = labels.selectExpr("doc_id", "IF(crc32(string(doc_id)) % 3 = 1, 1 - toxic, toxic) AS toxic")
    again = toxicity.score_documents(docs, turned).join(labels.select("doc_id"), "doc_id").toPandas()
    assert (again.sort_values("doc_id")["score"].to_numpy() == found.sort_values("doc_id")["score"].to_numpy()).all()


def test_odd_rows(spark, frame, sentence):
    rows, labels = corpus(sentence, 300)
    rows = [(i, t, "s") for i, t in rows] + [(900, None, "s"), (901, "", "s"), (None, "nitwit", "s"), (5, "another text", "s"), (902, "word " * 60_000 + "nitwit", "s"), (5, "another text", "s")]
    named = spark.createDataFrame([(*r, "x") for r in labels] + [(None, 1, "x"), (7, None, "x"), (9, 3, "x"), (12, 0, "x")], "doc_id bigint, toxic int, score string")
    docs = frame(rows)
    found = toxicity.score_documents(docs.selectExpr("*", "'c' AS score", "'c' AS predicted"), named).toPandas()
    assert len(found) == len(rows) and found["score"].between(0, 1).all() and list(found.columns).count("score") == 1
    assert (found["predicted"] == (found["score"] >= 0.7)).all()
    assert not found[found["doc_id"].isna()]["held_out"].any()
    empty = found[found["doc_id"].isin([900, 901])]["score"]
    assert empty.nunique() == 1
    assert toxicity.score_documents(docs.limit(0), named).count() == 0
    assert toxicity.score_documents(docs, named.limit(0)).filter("predicted = 1").count() == 0
    assert toxicity.score_documents(docs, named, max_labelled=20).count() == len(rows)
