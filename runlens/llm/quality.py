"""Quality classifier: ordinal cumulative-link regression (McCullagh 1980) on graded ratings.

P(grade <= j) = sigmoid(t_j - w.x) with ordered thresholds t and one weight vector for all grades. Features
are the distinct words of a text and a few traits of its form, hashed; each counts once. The model is fitted on
a bounded sample of rated documents and applied to all in a map over the rows.
"""

import re
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SIZE = 1 << 18  # hashed features
_WORD = re.compile(rb"[a-z0-9\x80-\xff]+")
_MARKS = re.compile(rb"[!-/:-@\[-`{-~]{2,}|(?<=\s)\|(?=\s)")
_UPPER = re.compile(rb"[A-Z]")


def _step(share: float) -> int:
    """Coarse logarithmic step of a share: 0 for none, then doublings from 1/256."""
    return 0 if share <= 0 else 1 + min(max(int(np.log2(max(share, 1e-9)) + 8), 0), 8)


def features(text: str | None) -> np.ndarray:
    """Sorted hashed features. A null or empty text has the traits of an empty one."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    words = _WORD.findall(raw.lower())
    n, distinct = max(len(words), 1), set(words)
    traits = (
        b"length %d" % min(len(words), 1 << 20).bit_length(),
        b"marks %d" % _step(len(_MARKS.findall(raw)) / n),
        b"upper %d" % _step(len(_UPPER.findall(raw)) / max(sum(map(len, words)), 1)),
        b"repeats %d of %d" % (int(8 * len(distinct) / n), min(len(words).bit_length(), 12)),
        b"word length %d" % min(sum(map(len, words)) // n, 20),
    )
    hashed = [zlib.crc32(w) % SIZE for w in distinct]
    hashed += [zlib.crc32(b"trait " + t) % SIZE for t in traits]
    return np.unique(np.array(hashed, np.int32))


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def fit(rows: list[np.ndarray], grades: np.ndarray, *, grades_in_all: int, rounds: int = 200, least_documents: int = 3,
        penalty: float = 5.0) -> tuple[np.ndarray, np.ndarray]:
    """Weights and ascending thresholds of greatest penalised likelihood, by gradient steps of adapted size.

    Features of fewer than ``least_documents`` documents have weight 0. Without rows all weights are 0 and the
    thresholds even.
    """
    weights = np.zeros(SIZE, np.float32)
    cuts = grades_in_all - 1
    if not len(rows):
        return weights, np.linspace(-1, 1, cuts)
    flat = np.concatenate(rows)
    row = np.repeat(np.arange(len(rows), dtype=np.int32), [len(r) for r in rows])
    seen = np.bincount(flat, minlength=SIZE)
    names = np.flatnonzero(seen >= least_documents)
    place = np.full(SIZE, -1, np.int32)
    place[names] = np.arange(len(names))
    used = place[flat] >= 0
    row, column = row[used], place[flat[used]]

    # Parameters: weights, first threshold, logarithms of the gaps between thresholds.
    p = np.zeros(len(names) + cuts)
    below = np.array([(np.sum(grades <= j) + 1) / (len(grades) + 2) for j in range(cuts)])
    starts = np.log(below / (1 - below))
    p[len(names)] = starts[0]
    p[len(names) + 1 :] = np.log(np.maximum(np.diff(starts), 0.05))
    m, v = np.zeros_like(p), np.zeros_like(p)
    for step in range(1, rounds + 1):
        w, gaps = p[: len(names)], np.exp(p[len(names) + 1 :])
        theta = p[len(names)] + np.concatenate([[0], np.cumsum(gaps)])
        score = np.bincount(row, weights=w[column], minlength=len(grades))
        upper = np.where(grades < cuts, _sigmoid(theta[np.minimum(grades, cuts - 1)] - score), 1.0)
        lower = np.where(grades > 0, _sigmoid(theta[np.maximum(grades - 1, 0)] - score), 0.0)
        p_own = np.maximum(upper - lower, 1e-9)
        # Of minus the log likelihood.
        g_score = 1 - upper - lower
        g_theta = np.zeros(cuts)
        np.add.at(g_theta, np.minimum(grades, cuts - 1), np.where(grades < cuts, -upper * (1 - upper) / p_own, 0))
        np.add.at(g_theta, np.maximum(grades - 1, 0), np.where(grades > 0, lower * (1 - lower) / p_own, 0))
        g = np.concatenate([
            np.bincount(column, weights=g_score[row], minlength=len(names)) + penalty * w,
            [g_theta.sum()], np.cumsum(g_theta[::-1])[::-1][1:] * gaps])
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        rate = 0.1 * min(1.0, 2 * (1 - step / (rounds + 1)))
        p -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    weights[names] = p[: len(names)]
    return weights, p[len(names)] + np.concatenate([[0], np.cumsum(np.exp(p[len(names) + 1 :]))])


def predict(rows: list[np.ndarray], weights: np.ndarray, thresholds: np.ndarray) -> np.ndarray:
    """P(grade > j) for each row and threshold j."""
    scores = np.array([weights[r].sum(dtype=np.float64) for r in rows])
    return _sigmoid(scores[:, None] - thresholds[None, :])


def grade_documents(docs: DataFrame, ratings: DataFrame, *, grades: int = 3, max_rated: int = 16_000, least: float = 0.6) -> DataFrame:
    """Adds to every row of ``docs`` (doc_id, text, any others): expected_grade, p_top, kept.

    ``ratings`` has doc_id and ``grade`` (0 to ``grades`` - 1). The model is fitted on at most ``max_rated`` rated
    documents, those with the smallest hash of their id, so that the driver holds a bounded sample. A document
    rated twice counts once, with its lowest grade; an id that stands for several texts gives its first text in
    order. Null ids or grades are not learned from. ``p_top`` is the probability of the highest grade and
    ``kept`` whether it reaches ``least``. Null text counts as empty. Rows stay as they are; names that
    ``docs`` has already are replaced.
    """
    known = ratings.select("doc_id", F.col("grade").cast("int").alias("grade")).filter(
        f"doc_id IS NOT NULL AND grade BETWEEN 0 AND {grades - 1}")
    sample = (
        known.groupBy("doc_id").agg(F.min("grade").alias("grade"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rated)
    )

    @F.pandas_udf("binary")
    def hashed(texts: pd.Series) -> pd.Series:
        return pd.Series([features(t).tobytes() for t in texts])

    # At most max_rated ids: small enough to broadcast whatever the corpus.
    rated = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id")
    rated = rated.groupBy("doc_id", "grade").agg(F.min("text").alias("text"))
    # One packed value per document keeps the sample small on the driver.
    table = sorted(rated.select("doc_id", "grade", hashed("text")).collect())
    weights, thresholds = fit([np.frombuffer(r[2], np.int32) for r in table], np.array([r[1] for r in table], int), grades_in_all=grades)
    del table

    @F.pandas_udf("expected_grade double, p_top double")
    def grade(texts: pd.Series) -> pd.DataFrame:
        above = predict([features(t) for t in texts], weights, thresholds)
        return pd.DataFrame({"expected_grade": above.sum(axis=1), "p_top": above[:, -1]})

    graded = docs.withColumn("_graded", grade("text"))
    return graded.withColumns({
        "expected_grade": F.col("_graded.expected_grade"), "p_top": F.col("_graded.p_top"),
        "kept": F.col("_graded.p_top") >= least}).drop("_graded")


def ratings_of(labels: DataFrame) -> DataFrame:
    """Grades from quality and toxicity labels: 2 for a good text without toxicity, one less for each fault."""
    return labels.select("doc_id", (F.col("quality") + 1 - F.col("toxic")).alias("grade"))
