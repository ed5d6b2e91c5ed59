"""Texts of fewer words than an n-gram, wherever they stand in a slice."""

import numpy as np
import pytest

from quadloom.llm import jaccard, textnp

LONG = "river stone window garden market letter winter"


def sets(texts):
    b = [t.encode() for t in texts]
    grams, to = jaccard.ngram_sets(np.frombuffer(b"".join(b), np.uint8), textnp.counts_to_offsets(np.array([len(x) for x in b])))
    return [tuple(grams[i:j]) for i, j in zip(to, to[1:])]


@pytest.mark.parametrize("n", [1, 2, 3, 4, 5])
def test_place_in_slice(n):
    short = " ".join(LONG.split()[:n])
    alone = sets([short])
    assert len(alone[0]) == 1
    got = sets([short, LONG, short, "", LONG, short, ""])
    assert got[0] == got[2] == got[5] == alone[0]
    assert got[1] == got[4] == sets([LONG])[0] and got[3] == got[6] == ()


def test_short_texts_differ():
    words = LONG.split()
    assert len({sets([" ".join(words[:n])])[0] for n in range(1, 6)}) == 5
    assert sets(["river stone"]) != sets(["stone river"])


def test_copies_of_short_texts(spark):
    rows = [(0, "one two"), (1, LONG), (2, "one two"), (3, "three"), (4, LONG), (5, "three"), (6, "One, two!")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").coalesce(1)
    got = {r.doc_id: (r.class_id, r.links) for r in jaccard.classes(df).collect()}
    assert got == {0: (0, 2), 2: (0, 2), 6: (0, 2), 1: (1, 1), 4: (1, 1), 3: (3, 1), 5: (3, 1)}
    assert {r.doc_id for r in jaccard.keep_one(df).collect()} == {0, 1, 3}
