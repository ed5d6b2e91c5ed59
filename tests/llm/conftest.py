import random

import pytest

WORDS = "river stone window garden market letter winter summer people number system moment answer paper story music light water field house".split()


def prose(draw, n):
    return " ".join(draw.choice(WORDS) + draw.choice(["", "", "s", "ing"]) for _ in range(n))


@pytest.fixture(scope="session")
def messy(spark):
    """Null ids and texts, empty and very long texts, repeated rows, and further columns whose names clash with inner ones."""
    draw = random.Random(1)
    base = [prose(draw, 60) for _ in range(12)]
    near = base[0].split()
    near[30] = "changed"
    texts = [*base, base[0], " ".join(near), None, "", "word", "  \n\n ", prose(draw, 40_000), "ünïcödé 日本語 " * 30, "a" * 5000, base[1] + "\n" + base[2], base[3] + "\n" + base[2]]
    rows = [(i, t, ["en", "de", None][i % 3], ["src0", "src1", None][i % 3]) for i, t in enumerate(texts)]
    rows += [(None, base[4], "en", "src0"), (None, None, None, None), rows[5], rows[5], (3, base[3], "de", "src9")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string")
    return df.selectExpr("*", "coalesce(length(text), 0) as n_chars", "'x' as _id", "1 as _text", "'y' as `a.b`", "2 as tokens", "3 as shard", "4 as _row", "5 as _time", "'z' as _gone", "6 as score")


@pytest.fixture(scope="session")
def labels(messy):
    return messy.where("doc_id is not null").selectExpr("doc_id", "cast(doc_id % 2 as int) as quality", "cast(doc_id % 3 = 0 as int) as toxic", "1 as _label")
