"""Links of fingerprints as sums, against scores of all pairs, and what the search writes where many documents are alike."""

import itertools
import random

import pyarrow as pa
import pytest
from conftest import prose

from quadloom.llm import ctph
from quadloom.llm.cluster import components
from quadloom.llm.common import Scratch


def mutated(draw, s, letters, most):
    s = list(s)
    for _ in range(draw.randrange(9)):
        at = draw.randrange(len(s))
        s[at : at + draw.randrange(3)] = draw.choices(letters, k=draw.randrange(3))
    return "".join(s)[:most] or "A"


@pytest.mark.parametrize("block", [3, 2048])
def test_ctph_sums_of_all_pairs(spark, block, monkeypatch):
    """Runs that are twice in a string, pairs alike at both sizes or only across sizes, caps of small blocks, keys of many blocks."""
    monkeypatch.setattr(ctph, "BLOCK", block)
    draw = random.Random(block)
    prints = set()
    for letters in ("AB", "ABC", "ABCDEFGHIJ+/"):
        base = ["".join(draw.choices(letters, k=draw.randint(30, 64))) for _ in range(3)]
        base += [base[0][: 2 * ctph.RUN] * 4]
        for _ in range(60):
            one, two = draw.choice(base), draw.choice(base)
            prints.add((draw.choice([3, 6, 48, 48, 96, 192]), mutated(draw, one, letters, 64), draw.choice(["", two[:5], mutated(draw, two[:32], letters, 32)])))
    prints = [(k, p, draw.randint(1, 4)) for k, p in enumerate(sorted(prints))]
    pairs = list(itertools.combinations(prints, 2))
    names = [str(k) for k in range(8)]
    rows = pa.RecordBatch.from_arrays([pa.array([p[0] for p, _ in pairs]), pa.array([q[0] for _, q in pairs]), *(pa.array([x[side][1][k] for x in pairs]) for side in (0, 1) for k in range(3))], names=names)
    want, root = {}, {k: k for k, _, _ in prints}
    alike = [pair for pair, score in zip(pairs, ctph.pair_scores(rows)) if score >= ctph.THRESHOLD]
    for (a, _, n), (b, _, m) in alike:
        want[a], want[b] = want.get(a, 0) + m, want.get(b, 0) + n
    for _ in range(len(prints)):
        for (a, _, _), (b, _, _) in alike:
            root[a] = root[b] = min(root[a], root[b])
    assert len(alike) > 500 and len(want) < len(prints)
    s = Scratch(spark)
    groups = spark.createDataFrame([(k, n, p) for k, p, n in prints], "_node bigint, _n bigint, _f struct<block_size:bigint,signature:string,signature_double:string>")
    degrees = ctph._degrees(groups, ctph.THRESHOLD, s)
    got = {}
    for r in degrees.collect():
        got[r._a] = got.get(r._a, 0) + r._w
    assert got == want
    assert {r._id: r._root for r in components(degrees, s).collect()} == {a: root[a] for a in want}
    s.close()


def test_ctph_writes_no_pairs(spark, monkeypatch):
    """What is written grows with the documents, where all are alike, and not with their pairs."""
    draw = random.Random(3)
    words = prose(draw, 500).split()

    def rows_written(n):
        texts = []
        for _ in range(n):
            v = list(words)
            for _ in range(2):
                v[draw.randrange(len(v))] = draw.choice(words) + str(draw.randrange(10**6))
            texts.append(" ".join(v))
        written, table = [], Scratch.table
        with monkeypatch.context() as m:
            m.setattr(Scratch, "table", lambda s, *x: written.append((out := table(s, *x)).count()) or out)
            rows = ctph.similar(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")).collect()
        assert sum(r.links for r in rows) > n * n / 2
        return max(written)

    assert rows_written(400) < 3 * rows_written(200)
