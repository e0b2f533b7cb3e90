import random

import pytest


@pytest.fixture(scope="session")
def words():
    rng = random.Random(7)
    return ["".join(rng.choice("aeioustrnlm") for _ in range(rng.randint(2, 9))) for _ in range(400)]


@pytest.fixture(scope="session")
def sentence(words):
    def make(seed, n):
        rng = random.Random(seed)
        return " ".join(rng.choice(words) for _ in range(n))

    return make


@pytest.fixture()
def frame(spark):
    """Documents with columns whose names clash with those the operators add or use inside."""

    def make(rows):
        schema = "doc_id bigint, text string, source string, n_chars bigint, kept string, block string, h string, line string, fp string"
        return spark.createDataFrame([(i, t, s, len(t or ""), "x", "y", "z", "l", "f") for i, t, s in rows], schema)

    return make
