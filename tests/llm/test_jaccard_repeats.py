"""Ids that repeat with a null or wordless text keep their near copies."""

import random

from quadloom.llm import jaccard


def test_null_and_wordless_repeats(spark):
    draw = random.Random(11)
    rows, want = [], {}
    for k in range(12):
        words = [f"w{draw.randrange(10**6)}" for _ in range(150)]
        rows += [(2 * k, " ".join(words)), (2 * k + 1, " ".join([*words[:-1], "other"]))]
        rows += [(2 * k, None), (2 * k, ""), (2 * k + 1, " . ")]
        want |= {2 * k: (2 * k, 1), 2 * k + 1: (2 * k, 1)}
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert {r.doc_id: (r.class_id, r.links) for r in jaccard.classes(df).collect()} == want


def test_kept_row_of_a_repeated_id(spark):
    a, b = ("one two three four five six", "x"), ("seven eight nine ten eleven", "y")
    rows = [(1, *a), (1, *b), (1, None, "w"), (1, "", "v"), (2, None, "q"), (2, " . ", "p"), (None, *a), (None, *a), (3, *a)]
    kept = []
    for order in (rows, rows[::-1], rows[3:] + rows[:3]):
        df = spark.createDataFrame(order, "doc_id bigint, text string, source string").repartition(3)
        got = sorted(((r.doc_id or 0, r.text, r.source) for r in jaccard.keep_one(df).collect()), key=repr)
        kept.append(got)
    assert kept[0] == kept[1] == kept[2]
    assert [r[0] for r in kept[0]] in ([0, 0, 1, 2], [0, 0, 1, 2, 3])
    one = jaccard.classes(df).where("doc_id = 3").first()
    assert (one.class_id == 1) == (kept[0][2][1] == a[0])  # the text that was compared is the one kept


def test_text_ids_and_hot_copies(spark):
    draw = random.Random(3)
    words = [f"w{draw.randrange(10**6)}" for _ in range(200)]
    rows = [(f"c{k:05}", " ".join(words)) for k in range(3000)]
    for k in range(1500):
        v = list(words)
        v[draw.randrange(200)] = f"n{k}"
        rows.append((f"d{k:05}", " ".join(v)))
    rows.append(("e", "nothing like the others at all"))
    df = spark.createDataFrame(rows, "doc_id string, text string").repartition(4)
    got = {r.doc_id: (r.class_id, r.links) for r in jaccard.classes(df).collect()}
    assert len(got) == 4501 and got["e"] == ("e", 0) and all(v[0] == "c00000" for k, v in got.items() if k != "e")
    assert got["c00007"][1] == 4499 and got["d00003"][1] >= 4400
    assert sorted(r.doc_id for r in jaccard.keep_one(df).collect()) == ["c00000", "e"]
