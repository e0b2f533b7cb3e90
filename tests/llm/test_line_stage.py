"""The line dedup stage on short lines, and lines longer than a chunk."""

import time

import pytest

import corpus_pipeline
from runlens.llm import line_dedup


def test_line_stage_drops_repeats_of_any_length(spark, frame):
    line = "short line of 23 chars."
    docs = frame([(1, f"Menu\n\nx\n{line}", "s"), (2, f"own text of the second\n\nMenu\n \nx\n{line[:-1]}!\n \nend", "s"), (3, "Menu\n\n \n", "s")])
    rest = corpus_pipeline.drop_repeated_lines(spark, docs, "")
    assert sorted((r.doc_id, r.text) for r in rest.collect()) == [(1, f"Menu\n\nx\n{line}"), (2, "own text of the second\n\n \n \nend")]


@pytest.mark.parametrize("length", [16, 127, 128, 129, 255, 256, 257, 385])
def test_edits_at_the_ends_of_chunks(frame, sentence, length):
    line = (sentence(length, 400))[:length]
    places = sorted({p for p in (0, 1, 63, 126, 127, 128, 129, 255, 256, 257, length - 1) if p < length})
    docs, want = [(0, line, "s")], {0: line}
    for n, p in enumerate(places, 1):
        other = [line[:p] + "é" + line[p + 1 :], line[:p] + "é" + line[p:], line[:p] + line[p + 1 :]]
        docs += [(10 * n + k, text, "s") for k, text in enumerate(other)]
        two = line[:p] + "ßß" + line[p + 1 :]  # two edits from the first line, one from the others
        docs.append((10 * n + 5, two.swapcase(), "s"))
        want[10 * n + 5] = two.swapcase()
    found = {r.doc_id: r.text for r in line_dedup.dedup_lines(frame(docs), least_chars=1, near_chars=15).collect()}
    # The other-case lines are within two edits of each other at best, unless two places are the same edit.
    assert {i: t for i, t in found.items() if t and i % 10 != 5} == {0: line}
    brute = {i: t for i, t in want.items() if i == 0 or not any(j < i and within_one(t, u) for j, u in want.items())}
    assert {i: t for i, t in found.items() if t} == brute


def within_one(a, b):
    if abs(len(a) - len(b)) > 1:
        return False
    p = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    return a[p + 1 :] == b[p + 1 :] or a[p:] == b[p + 1 :] or a[p + 1 :] == b[p:]


def test_very_long_lines_cost_as_much_as_their_length(frame, sentence):
    def seconds(length):
        line = (sentence(3, 1000) + " ") * (length // 4000)
        docs = frame([(1, line, "s"), (2, line[:-5] + line[-4:], "s"), (3, line[: length // 2] + "é" + line[length // 2 + 1 :], "s"), (4, line.upper(), "s")])
        begin = time.perf_counter()
        kept = {r.doc_id: bool(r.text) for r in line_dedup.dedup_lines(docs, least_chars=1, near_chars=16).collect()}
        assert kept == {1: True, 2: False, 3: False, 4: True}
        return time.perf_counter() - begin

    seconds(4_000)
    short, long = seconds(20_000), seconds(200_000)
    assert long < 5 * short + 10
