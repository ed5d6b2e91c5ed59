"""Sources that hold much, little or nothing: the budget, and what the pipeline's mixing stage keeps."""

import pytest

import corpus_pipeline
from quadloom.llm import mixing

BASE = [(i, "one two three four", f"src{i % 4}") for i in range(400)]
HOT = [(1000 + i, "one two three four", "src0") for i in range(400)]
TINY = [(5000, "word " * 500, "tiny")]
EMPTY = [(6000, None, "void"), (6001, "", "void"), (6002, " \n ", "void"), (6003, None, None)]
KINDS = "doc_id bigint, text string, source string"


def scheduled(df):
    return {r.doc_id: r.position for r in mixing.curriculum(df).collect() if r.position is not None}


@pytest.mark.parametrize("rows", [BASE, BASE + HOT, BASE + TINY, BASE + EMPTY, EMPTY], ids=["even", "hot", "tiny", "empty", "only_empty"])
def test_stage_keeps_all(spark, rows):
    df = spark.createDataFrame(rows, KINDS)
    place = scheduled(df)
    got = [r.doc_id for r in corpus_pipeline.mix_sources(spark, df, "").collect()]
    assert sorted(got) == sorted(r[0] for r in rows)
    assert set(got[: len(place)]) == set(place)
    at = [place[i] for i in got[: len(place)]]
    assert at == sorted(at)
    if len(place) < len(rows) - 50:  # the rest isn't in the order of the ids, which may go by source
        assert got[len(place) :] != sorted(got[len(place) :])
    assert [r.doc_id for r in mixing.order_documents(df).collect()] == got[: len(place)]


def test_source_without_tokens_changes_nothing(spark):
    base, more = (scheduled(spark.createDataFrame(rows, KINDS)) for rows in (BASE, BASE + EMPTY))
    assert len(base) > 100 and more == base
