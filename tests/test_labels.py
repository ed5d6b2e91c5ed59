import pytest

from quadloom.operators import labels

CASES = [
    ("A", {"A"}, True), ("A", {"B"}, False), ("A&B", {"A"}, False), ("A&B", {"A", "B"}, True), ("A|B", {"B"}, True), ("(A|B)&C", {"A"}, False), ("(A|B)&C", {"A", "C"}, True),
    ("A|B&C", {"A"}, True), ("A|B&C", {"B"}, False), ("A&", {"A"}, False), ("|A", {"A"}, False), ("(A", {"A"}, False), ("A)", {"A"}, False), (" A & B ", {"A", "B"}, True), ("((A))", {"A"}, True), ("()", {"A"}, False),
]


@pytest.mark.parametrize("label,auths,want", CASES)
def test_grammar(label, auths, want):
    assert labels.allowed(label, auths) is want


def test_columns_agree(spark):
    texts = [c[0] for c in CASES] + [None, ""]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, vis string")
    for auths in ([], ["A"], ["B"], ["A", "B"], ["A", "C"]):
        want = {i for i, t in enumerate(texts) if labels.allowed(t, auths)}
        assert {r.i for r in labels.visible(df, auths).collect()} == want
        assert {r.i for r in labels.visible_few(df, auths).collect()} == want


def test_joined(spark):
    df = spark.createDataFrame([("", "A"), ("A", None), ("A", "B|C"), ("", "")], "a string, b string")
    got = [tuple(r) for r in df.select(labels.conjunction(df.a, df.b), labels.disjunction(df.a, df.b)).collect()]
    assert got == [("A", "A"), ("A", "A"), ("(A)&(B|C)", "(A)|(B|C)"), ("", "")]
