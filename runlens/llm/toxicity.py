"""Toxicity: a classifier of labelled texts whose score must not change when identity terms are swapped.

Features of a text are its words and their beginnings, hashed, that occur once, twice or at least three times; a
logistic model adds up their weights. In the
sentences of the labelled texts that name a group, each such term is replaced by another of its kind, and the
squared change of the score is a penalty of the fit (counterfactual logit pairing, Garg et al. 2019). So a term
that stands in toxic texts more often than its peers cannot earn a weight of its own, and neutral mentions of a
group are not taken for insults. The model is fitted on a bounded sample of labelled texts and applied to all
in a map over the rows; texts do not move.
"""

import re
import zlib
from collections import Counter
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SIZE = 1 << 20  # hashed parts of words
LEVELS = 3  # a part that occurs n times has its first n features, LEVELS at most
_WORD = re.compile(r"[^\W\d_]+")
_SENTENCE = re.compile(r"[^.!?\n]+")
_BEGINNINGS = range(4, 8)

# Terms that name groups of people, by kind; a term is replaced by another of its own line.
IDENTITY_TERMS = """
woman man girl boy female male
women men girls boys females males
muslim christian jewish hindu buddhist catholic atheist sikh
muslims christians jews hindus buddhists catholics atheists sikhs
black white asian hispanic latino arab african european
american german french spanish italian turkish polish russian chinese indian mexican
americans germans spaniards italians turks poles russians mexicans
gay lesbian straight bisexual transgender queer heterosexual
immigrant refugee foreigner migrant citizen
immigrants refugees foreigners migrants citizens
disabled blind deaf autistic
old young elderly teenage
frau mann mädchen junge
frauen männer
muslime christen juden hindus buddhisten katholiken
ausländer flüchtlinge einwanderer migranten
femme homme fille garçon
femmes hommes filles garçons
musulmans chrétiens juifs hindous bouddhistes catholiques
étrangers réfugiés immigrés
mujer hombre niña niño
mujeres hombres niñas niños
musulmanes cristianos judíos budistas católicos
extranjeros refugiados inmigrantes
"""
_KIND = {term: line.split() for line in IDENTITY_TERMS.strip().splitlines() for term in line.split()}


def words(text: str | None) -> list[str]:
    return _WORD.findall((text or "").lower())


def _of_word(word: str) -> list[int]:
    """Hashed parts of a word: itself and, unless it names a group, its beginnings."""
    parts = [word] if word in _KIND else [word, *[word[:n] + "*" for n in _BEGINNINGS if n < len(word)]]
    return [zlib.crc32(p.encode("utf-8", "surrogatepass")) % SIZE for p in parts]


def features(found: list[str]) -> np.ndarray:
    """Sorted features of a text of these words."""
    counts = Counter()
    for word, n in Counter(found).items():
        for part in _of_word(word):
            counts[part] += n
    return np.sort(np.array([part + SIZE * level for part, n in counts.items() for level in range(min(n, LEVELS))], np.int32))


def swapped(sentence: list[str]) -> list[str] | None:
    """The sentence with every identity term replaced by another of its kind, or None if it has none.

    Which one, depends on the sentence alone.
    """
    if not any(w in _KIND for w in sentence):
        return None
    turn = zlib.crc32(" ".join(sentence).encode("utf-8", "surrogatepass"))
    other = lambda kind, term: kind[(kind.index(term) + 1 + turn % (len(kind) - 1)) % len(kind)]
    return [other(_KIND[w], w) if w in _KIND else w for w in sentence]


def counterfactuals(text: str | None) -> list[tuple[np.ndarray, np.ndarray]]:
    """Per sentence that names a group: features that a swap takes away, and those that it brings."""
    found = []
    for sentence in _SENTENCE.findall(text or ""):
        own = words(sentence)
        other = swapped(own)
        if other is not None:
            a, b = features(own), features(other)
            found.append((np.setdiff1d(a, b), np.setdiff1d(b, a)))
    return found


class Model(NamedTuple):
    """Weights of the features that have one, and the bias."""

    names: np.ndarray
    weights: np.ndarray
    bias: float


def _sparse(rows: list[np.ndarray], names: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row and column of each feature in ``names``."""
    flat = np.concatenate([*rows, np.array([], np.int32)])
    row = np.repeat(np.arange(len(rows), dtype=np.int32), [len(r) for r in rows])
    at = np.minimum(np.searchsorted(names, flat), max(len(names) - 1, 0))
    known = names[at] == flat if len(names) else np.zeros(len(flat), bool)
    return row[known], at[known]


def fit(rows: list[np.ndarray], toxic: np.ndarray, swaps: list[tuple[np.ndarray, np.ndarray]], *, most_features: int = 20_000,
        least_texts: int = 3, penalty: float = 0.1, sparsity: float = 0.5, fairness: float = 10.0, rounds: int = 300) -> Model:
    """Least penalised loss by accelerated proximal steps.

    The loss is summed over texts, toxic and other ones with equal weight in all; ``penalty`` is on squared and
    ``sparsity`` on absolute weights, ``fairness`` on the squared change of the score by each swap. Features of
    fewer than ``least_texts`` texts have weight 0, and only the ``most_features`` that differ most between toxic
    and other texts have one. With one class alone, all weights are 0.
    """
    positives = int(toxic.sum())
    if positives in (0, len(toxic)):
        return Model(np.array([], np.int32), np.array([]), -4.0 if not positives else 4.0)
    seen = np.bincount(np.concatenate(rows), minlength=SIZE * LEVELS)
    in_toxic = np.bincount(np.concatenate([r for r, t in zip(rows, toxic) if t]), minlength=SIZE * LEVELS)
    expected = seen * (positives / len(toxic))
    z = np.abs(in_toxic - expected) / np.sqrt(np.maximum(expected * (1 - seen / (len(toxic) + 1)), 1e-9))
    order = np.argsort(-np.where(seen >= least_texts, z, -1), kind="stable")[:most_features]
    names = np.sort(order[seen[order] >= least_texts])
    row, column = _sparse(rows, names)
    minus, minus_at = _sparse([a for a, _ in swaps], names)
    plus, plus_at = _sparse([b for _, b in swaps], names)

    n = len(names)
    share = np.where(toxic == 1, len(toxic) / (2 * positives), len(toxic) / (2 * (len(toxic) - positives)))
    scores = lambda w: np.bincount(row, weights=w[:-1][column], minlength=len(rows)) + w[-1]
    change = lambda w: (np.bincount(plus, weights=w[:-1][plus_at], minlength=len(swaps))
                        - np.bincount(minus, weights=w[:-1][minus_at], minlength=len(swaps)))

    def slope(w):
        g = share * (1 / (1 + np.exp(-np.clip(scores(w), -40, 40))) - toxic)
        d = 2 * fairness * change(w)
        own = np.bincount(column, weights=g[row], minlength=n) + penalty * w[:-1]
        own += np.bincount(plus_at, weights=d[plus], minlength=n) - np.bincount(minus_at, weights=d[minus], minlength=n)
        return np.append(own, g.sum())

    def curvature(v):
        s, d = share * scores(v) / 4, 2 * fairness * change(v)
        own = np.bincount(column, weights=s[row], minlength=n) + penalty * v[:-1]
        own += np.bincount(plus_at, weights=d[plus], minlength=n) - np.bincount(minus_at, weights=d[minus], minlength=n)
        return np.append(own, s.sum())

    v = np.ones(n + 1)
    for _ in range(12):  # the largest curvature, by power iteration
        v = curvature(v / np.linalg.norm(v))
    step = 0.9 / np.linalg.norm(v)
    w = ahead = np.zeros(n + 1)
    t = 1.0
    for _ in range(rounds):
        moved = ahead - step * slope(ahead)
        moved[:-1] = np.sign(moved[:-1]) * np.maximum(np.abs(moved[:-1]) - step * sparsity, 0)
        t, before = (1 + np.sqrt(1 + 4 * t * t)) / 2, t
        if np.dot(ahead - moved, moved - w) > 0:  # overshot: start the momentum anew
            t = before = 1.0
        w, ahead = moved, moved + (before - 1) / t * (moved - w)
    kept = np.flatnonzero(w[:-1])
    return Model(names[kept].astype(np.int32), w[:-1][kept], float(w[-1]))


def score(text: str | None, model: dict[int, float], bias: float, known: dict[str, tuple[int, ...]]) -> float:
    """Probability of a toxic text. ``known`` keeps the parts with a weight of words met before."""
    counts = Counter()
    for word, n in Counter(words(text)).items():
        own = known.get(word)
        if own is None:
            own = known[word] = tuple(p for p in _of_word(word) if any(p + SIZE * level in model for level in range(LEVELS)))
        for part in own:
            counts[part] += n
    sums = bias + sum(model.get(p + SIZE * level, 0.0) for p in sorted(counts) for level in range(min(counts[p], LEVELS)))
    return float(1 / (1 + np.exp(-np.clip(sums, -40, 40))))


def held_out(doc_id: Column) -> Column:
    """Rows that nothing is learned from: CRC-32 of the decimal id, modulo 3, is 1."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


def score_documents(docs: DataFrame, labels: DataFrame, *, max_labelled: int = 8_000, threshold: float = 0.7, **options) -> DataFrame:
    """Adds to every row of ``docs`` (doc_id, text, any others): held_out, score, predicted.

    ``labels`` has doc_id and toxic (0 or 1). The model is fitted on at most ``max_labelled`` labelled documents that
    are not held out, those with the smallest hash of their id, so that the driver holds a bounded sample. An id
    labelled twice counts once, as toxic if it is so once; an id that stands for several texts gives its first text
    in order. Null ids or labels are not learned from. Null text counts as empty and is scored like any other.
    ``predicted`` is 1 where ``score`` reaches ``threshold``. Rows stay as they are; names that ``docs`` has already
    are replaced. ``options`` are those of :func:`fit`.
    """
    known = labels.select("doc_id", F.col("toxic").cast("int").alias("toxic")).filter(
        "doc_id IS NOT NULL AND toxic IN (0, 1)").filter(~held_out(F.col("doc_id")))
    sample = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labelled)

    @F.pandas_udf("own binary, swaps array<struct<minus: binary, plus: binary>>")
    def packed(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([
            (features(words(t)).tobytes(), [{"minus": a.tobytes(), "plus": b.tobytes()} for a, b in counterfactuals(t)])
            for t in texts], columns=["own", "swaps"])

    # At most max_labelled ids: small enough to broadcast whatever the corpus.
    labelled = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))
    table = sorted(labelled.select("doc_id", "toxic", packed("text").alias("x")).select("doc_id", "toxic", "x.*").collect(), key=lambda r: r["doc_id"])
    unpacked = lambda b: np.frombuffer(b, np.int32)
    swaps = [(unpacked(s["minus"]), unpacked(s["plus"])) for r in table for s in r["swaps"]]
    model = fit([unpacked(r["own"]) for r in table], np.array([r["toxic"] for r in table], int), swaps, **options)
    del table
    bias = model.bias

    @F.pandas_udf("double")
    def run(texts: pd.Series) -> pd.Series:
        weights, met = dict(zip(model.names.tolist(), model.weights.tolist())), {}
        scores = []
        for text in texts:
            if len(met) > 1 << 18:  # words met once fill it; it starts anew
                met.clear()
            scores.append(score(text, weights, bias, met))
        return pd.Series(scores, dtype="float64")

    scored = docs.withColumn("score", run("text"))
    return scored.withColumns({"held_out": held_out(F.col("doc_id")), "predicted": (F.col("score") >= threshold).cast("int")})
