"""Decontamination of passages that are shorter than the window around a hit."""

import pytest

from runlens.llm import decontaminate

STARTS, LENGTHS = (0, 14, 20), (13, 15, 17, 20, 21, 22, 24, 25)


@pytest.mark.parametrize("chunk", [500_000, 40])
def test_excerpts_of_an_item_are_found(spark, frame, sentence, chunk):
    item = sentence(201, 50).split()
    benchmark = spark.createDataFrame([(1, " ".join(item)), (2, sentence(202, 40))], "item_id bigint, text string")
    rows, want = [], {}
    for start in STARTS:
        for n in LENGTHS:
            excerpt = " ".join(item[start : start + n])
            for before, after in (("", ""), (sentence(300 + n, 30) + " ", " " + sentence(400 + n, 30)), ("", " " + sentence(500 + n, 40))):
                want[len(rows)] = (n, len(before.split()))
                rows.append((len(rows), before + excerpt + after, "s"))
    swapped = item[14:34]
    swapped[2] = swapped[17] = "zzz"
    rows.append((900, sentence(601, 30) + " " + " ".join(swapped) + " " + sentence(602, 30), "s"))
    rows.append((901, sentence(603, 30) + " " + " ".join(item[:8]) + " " + sentence(604, 30), "s"))
    found = {r.doc_id: r for r in decontaminate.overlaps(frame(rows), benchmark, chunk=chunk).collect()}
    assert set(found) == {*want, 900}
    assert all(r.item_id == 1 and r.similarity >= 0.8 and r.compared >= decontaminate.SPAN for r in found.values())
    for doc_id, (n, first) in want.items():
        # A chance equal word in the text around may lengthen the part that is reported.
        assert found[doc_id].matched >= n and found[doc_id].first_word <= first
