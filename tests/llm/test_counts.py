"""Counts of the language model between batches and parts."""

import numpy as np

from runlens.llm import ngram_lm


def test_counts_travel_whole():
    counts = np.array([0, 5, 2**32 - 1, 2**32, 3 * 2**40 + 7, 2**62])
    assert ngram_lm._counts_in(ngram_lm._counts_out(counts)).tolist() == counts.tolist()
