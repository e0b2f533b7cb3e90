"""The rated sample of the classifier."""

import inspect

from runlens.llm import quality


def test_rated_sample_of_the_registered_query():
    assert inspect.signature(quality.grade_documents).parameters["max_rated"].default == 16_000
