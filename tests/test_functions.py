"""Values, times, records, geometry and text against plain Python."""

import hashlib
import math
import struct

import pytest
from pyspark.sql import functions as F

from quadloom import model as m
from quadloom.functions import times, values
from quadloom.operators import entity, geo, merge, records, scan, temporal, text


def one(spark, column, **cols):
    schema = ", ".join(f"{k} {'string' if isinstance(v, str) or v is None else 'bigint' if isinstance(v, int) else 'double'}" for k, v in cols.items())
    return spark.createDataFrame([tuple(cols.values())], schema).select(column.alias("r")).first().r


def column(spark, fn, items, kind="string"):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(items)], f"i int, x {kind}")
    return [r.r for r in df.select("i", fn(F.col("x")).alias("r")).orderBy("i").collect()]


def test_datetimes(spark):
    cases = {
        "2002-02-02": "2002-02-02T00:00:00.000Z", "2002-02-02T": "2002-02-02T00:00:00.000Z", "2002-02-02Z": "2002-02-02T00:00:00.000Z", "2002-02-02TZ": "2002-02-02T00:00:00.000Z", "2002-02-02+13:00": "2002-02-01T11:00:00.000Z",
        "2002-02-02T02:02:02.2229-05:00": "2002-02-02T07:02:02.222Z", "2000-02-29T23:30:00-01:00": "2000-03-01T00:30:00.000Z", "1999-12-31T24:00:00Z": "2000-01-01T00:00:00.000Z",
        "-0044-03-15T00:00:00Z": "-0044-03-15T00:00:00.000Z", "10000-01-01T00:00:00+01:00": "9999-12-31T23:00:00.000Z", "2001-02-29": None, "2001-13-01": None, "today": None, "": None, "2001-01-01T25:00:00Z": None,
    }
    assert column(spark, times.normalise, list(cases)) == list(cases.values())
    assert [times.normalise_text(t) for t in cases] == list(cases.values())
    assert times.normalise_text("2001-01-01T00:00:00", 60) == "2000-12-31T23:00:00.000Z"


def test_keys_and_intervals(spark):
    got = column(spark, times.rfc_key, ["2020-02-29T23:59:59+00:30", "2020-01-01t00:00:00z", "2020-01-01T00:00:00.5Z", "2020-01-01T00:00:00", "2020-02-30T00:00:00Z"])
    assert got == ["2020-02-29T23:29:59Z", "2020-01-01T00:00:00Z", "2020-01-01T00:00:00Z", None, None]
    ok, back, loose = "[2020-01-01T00:00:00Z,2020-01-02T00:00:00Z]", "[2020-01-02T00:00:00Z,2020-01-01T00:00:00Z]", "[2020-01-01T00:00:00Z,2020-01-02T00:00:00Z] x"
    assert [r and tuple(r) for r in column(spark, times.interval, [ok, back, loose])] == [("2020-01-01T00:00:00Z", "2020-01-02T00:00:00Z"), None, None]
    assert column(spark, lambda c: times.marker(c, True), ["2020-01-01", "x"]) == ["2020-01-01T23:59:59Z", None]
    assert column(spark, times.date_millis, ["1970-01-02", "1970-01-01T00:00:01.25Z", "1970-01-01T00:00:01"]) == [86400000, 1250, None]


def test_keys_sort_as_values(spark):
    doubles = [-1e300, -2.5, -1.0, -1e-9, 0.0, 1e-9, 0.1, 1.0, 1.5, 3.0, 1e300]
    keys = column(spark, values.double_key, doubles, "double")
    want = []
    for x in doubles:
        bits = struct.unpack(">Q", struct.pack(">d", x))[0]
        want.append(f"{bits ^ ((1 << 63) if not bits >> 63 else (1 << 64) - 1):016x}")
    assert keys == want == sorted(keys)
    up = lambda mark: lambda c: values.upgrade_key(c, F.lit(mark))
    assert column(spark, up(4), ["-1", "0", "5", "x"]) == ["7fffffffffffffff", "8000000000000000", "8000000000000005", None]
    assert column(spark, up(5), ["-1", "0"]) == ["7fffffff", "80000000"] and column(spark, up(9), ["-1", "7"]) == ["ff", "07"] and column(spark, up(10), ["true", "no"]) == ["1", "0"]
    row = "5\x00s\x00p\x01\x05"
    assert column(spark, values.upgrade_osp_row, [row]) == ["80000005\x00s\x00p\x01\x05"]


def test_codec(spark):
    rows = [("v", m.STRING, ""), ("u:x", m.IRI, ""), ("a@b", m.LANG_STRING, "en-GB"), ("x", m.LANG_STRING, "!"), ("1", m.INTEGER, ""), ("a\x00b", m.STRING, "")]
    df = spark.createDataFrame([("u:s", "u:p", *r) for r in rows], "s string, p string, o string, o_dt string, o_lang string")
    want = [(o, dt, "und" if lang == "!" else lang) for o, dt, lang in rows]
    back = values.decode_object(values.encode_object(F.col("o"), F.col("o_dt"), F.col("o_lang")))
    assert [tuple(r.r) for r in df.select(back.alias("r")).collect()] == want
    for layout in ("spo", "osp"):
        for hashed in (False, True):
            got = df.select(values.read_layout_row(values.layout_row(layout, hashed), layout, hashed).alias("r")).collect()
            assert [tuple(r.r) for r in got] == [("u:s", "u:p", *w) for w in want]
    lead = df.select(values.layout_row("spo", True).alias("r")).first().r
    assert lead.startswith(hashlib.md5(b"u:s").hexdigest() + "\x00u:s\x00")
    assert sorted(map(tuple, entity.decode(entity.rows(m.conform(df))).select("o", "o_dt").collect())) == sorted([w[:2] for w in want] * 2)
    assert entity.delete(entity.rows(m.conform(df)), m.conform(df.limit(1))).count() == 2 * len(rows) - 2


def java(text):
    h = 0
    units = text.encode("utf-16-be")
    for i in range(0, len(units), 2):
        h = (h * 31 + int.from_bytes(units[i : i + 2], "big")) & 0xFFFFFFFF
    return h - (1 << 32) if h >> 31 else h


def test_shards(spark):
    items = ["abc", "", "a longer text that wraps", "Zürich 😀"]
    assert column(spark, values.java_hash, items) == [java(x) for x in items]
    want = [f"20240101_{abs(int(math.fmod(java(x), 50)))}" for x in items]
    assert column(spark, lambda c: values.shard(F.lit(1704067200000), c), items) == want
    assert tuple(one(spark, values.split_shard(F.col("x")), x="2024_01_7")) == ("2024_01", "7")
    assert one(spark, values.local_name(F.col("x")), x="http://a/b#c") == "c" and one(spark, values.local_name(F.col("x")), x="http://a/") == "http://a/"
    assert values.orders(["a", "b", "c"]) == ["a;b;c", "b;c;a", "c;a;b"]
    assert one(spark, values.pascal(F.col("x")), x="foo-bar_baz") == "FooBarBaz" and one(spark, values.slug(F.col("x")), x=" A--b! ") == "a-b"


def python_record(text, pair="|", value="="):
    """By hand: scan for the next value delimiter, then the nearest delimiter of either kind."""
    row, at = {}, 0
    while at < len(text):
        v = text.find(value, at)
        if v < 0:
            break
        ends = [x if x >= 0 else len(text) for x in (text.find(value, v + 1), text.find(pair, v + 1))]
        row[text[at:v].strip()] = text[v + 1 : min(ends)].strip()
        if ends[1] == len(text):
            break
        at = ends[1] + 1
    return row


def test_records(spark):
    texts = ["a=1|b=2", " a = 1 |b=2=3|c", "junk|a=1", "a=1|a=2", "", "=x|y=", "a|b|c=1|d", "x=a=b=c|y=1"]
    got = column(spark, lambda c: records.parse_record(c, "|", "="), texts)
    assert got == [python_record(t) for t in texts]
    fields = F.create_map(*[F.lit(x) for x in ("n", "10", "t", "Hello World", "h", "ff", "lon", "-170", "lat", "5", "e", "")])
    holds = lambda text_: one(spark, records.ogc(text_, fields), x=1)
    yes = ["eq(n,10.0)", "gt(n,9)", "gt(t,Apple)", 'like(t,"hello*")', 'like(t,"*wor")', 'like(t,"hello")', "is_null(e)", "is_null(zz)", "bbox(180,0,200,10)", "and(eq(n,10),not(eq(t,x)))", "between(n,1,10)", "or(eq(n,1),ne(n,1))", "lt(zz,1)"]
    no = ["gt(n,10)", 'like(t,"world")', "is_null(n)", "bbox(0,0,10,10)", "between(n,11,20)", "eq(zz,0)"]
    assert [t for t in yes if not holds(t)] == [] and [t for t in no if holds(t)] == []
    for bad in ("eq(a)", "foo(a,b)", "eq(a,b) x", "and()"):
        with pytest.raises(ValueError):
            records.ogc(bad, fields)
    conv = lambda config, v: one(spark, records.convert(F.col("x"), config), x=v)
    assert [conv("f + 1", "2"), conv("f * 0.5", "5"), conv("f ^ 2", "ff"), conv("f - 1", "zz"), conv("conversion.f % 4", "-7")] == ["3.0", "2.5", "65025.0", None, "-3.0"]
    back = records.write_record(records.parse_record(F.col("x"), "|", "="), "|", "=")
    assert one(spark, back, x="b=2|a=1") == "a=1|b=2"
    dates = lambda **kw: one(spark, records.date_valid(F.create_map(*[F.lit(v) for pair in kw.items() for v in (pair[0].replace("_", "-"), pair[1])])), x=1)
    assert dates(date_start="2011-01-01") and not dates(date_start="2012-01-01") and not dates(date_end="2012-01-01") and not dates(date_start="2011-01-01", version="0") and dates(date_start="2011-01-01", date_end="2011-03-04")


def even_odd(x, y, rings):
    inside = False
    for ring in rings:
        j = len(ring) - 1
        for i in range(len(ring)):
            (xi, yi), (xj, yj) = ring[i], ring[j]
            if (yi > y) != (yj > y) and x < (xj - xi) * (y - yi) / (yj - yi) + xi:
                inside = not inside
            j = i
    return inside


def test_geometry(spark):
    shape = "POLYGON((0 0, 10 0, 12 6, 5 11, 0 10, 0 0), (3 3, 6 3, 6 6, 3 6, 3 3))"
    points = [(x / 2, y / 2) for x in range(-2, 26) for y in range(-2, 25)]
    df = m.conform(spark.createDataFrame([(f"u:{i}", "u:p", f"POINT({x} {y})") for i, (x, y) in enumerate(points)], "s string, p string, o string"))
    got = {r.s for r in geo.within(geo.index(df), shape).select("s").collect()}
    assert got == {f"u:{i}" for i, p in enumerate(points) if even_odd(*p, geo.polygon(shape))}
    others = ["LINESTRING(1 1, 2 2)", "LINESTRING(1 1, 20 2)", "POLYGON((1 1, 2 1, 2 2, 1 1))", "POINT(1)", "CIRCLE(1 1)", "point ( 1  1 )", "POLYGON((1 1, 2 1))x"]
    df = m.conform(spark.createDataFrame([(f"u:{i}", "u:p", w) for i, w in enumerate(others)], "s string, p string, o string"))
    idx = geo.index(df)
    assert idx.count() == 4 and {r.s for r in geo.within(idx, shape).collect()} == {"u:0", "u:2", "u:5"}
    assert [r.s for r in geo.equals(idx, "POINT(1.0 1)").collect()] == ["u:5"]
    assert geo.within(idx, geo.SAFE_WORLD).count() == 4


def test_text(spark):
    texts = ["The cat sat", "the_dog* ran", "CATS and Dogs", "", "über cat!", "a b c"]
    df = m.conform(spark.createDataFrame([(f"u:{i}", "u:p", t) for i, t in enumerate(texts)], "s string, p string, o string"))
    postings = text.postings(df)
    want = {"cat": {0, 4}, "cat*": {0, 2, 4}, "*s": {2}, "cat !sat": {4}, "!cat": {1, 2, 3, 5}, "*at*": {0, 2, 4}, "the": {0}, "nothing": set(), "CAT": {0, 4}, "!cat* !a": {1, 3}}
    for q, ids in want.items():
        assert {r.s for r in text.search(df, q).collect()} == {f"u:{i}" for i in ids}, q
        # a text without a term has no posting
        assert {r.s for r in text.lookup(postings, q).collect()} == {f"u:{i}" for i in ids - {3}}, q


def test_temporal(spark):
    rows = [("u:1", "u:when", "2020-01-01T10:00:00Z"), ("u:2", "u:when", "[2020-01-01T00:00:00Z,2020-02-01T00:00:00Z]"), ("u:3", "u:when", "never"), ("u:4", "u:is", "x"), ("u:4", "http://v#validFrom", "2020-01-10"), ("u:4", "http://v#ValidTo", "2020-01-20"), ("u:5", "u:is", "y"), ("u:5", "u:validAt", "2020-03-01")]
    df = m.conform(spark.createDataFrame(rows, "s string, p string, o string"))
    assert {(r.qualifier, r.n) for r in temporal.entries(df, ["u:when"]).groupBy("qualifier").agg(F.count("*").alias("n")).collect()} == {("instant", 4), ("begin", 1), ("end", 1)}
    kept = lambda **kw: sorted((r.s, r.o) for r in temporal.valid_time(df.where("p in ('u:is', 'u:when')"), df, **kw).collect())
    assert kept(at="2020-01-20T23:59:59Z") == [("u:2", rows[1][2]), ("u:4", "x")]
    assert kept(start="2020-02-15", end="2020-03-01") == [("u:5", "y")]
    assert kept(end="2020-01-01") == [("u:1", rows[0][2]), ("u:2", rows[1][2])]
    assert len(kept()) == 5
    assert temporal.instants(df, "between", "2020-01-01T00:00:00Z", "2020-01-02T00:00:00Z").count() == 1


def test_scan_options(spark):
    from quadloom.sources.store import QuadStore

    rows = [("u:a", "u:p", "1", t, v) for t, v in ((0, None), (10, "A"), (11, ""), (20, "A&B"), (21, "A|B"))]
    s = QuadStore.of(spark.createDataFrame(rows, "s string, p string, o string, ts bigint, vis string"))
    at = lambda **kw: sorted(r.ts for r in scan.scan(s, p="u:p", options=scan.Options(**kw)).collect())
    assert at() == [0, 10, 11, 20, 21] and at(start=10, end=20) == [11, 20] and at(limit=0) == []
    assert at(auths=()) == [0, 11] and at(auths=("A",)) == [0, 10, 11, 21] and at(auths=("A", "B")) == [0, 10, 11, 20, 21]
    assert at(ttl=10) == [20, 21] and at(ttl=11) == [11, 20, 21]
    assert at(ttl=11, now=20) == [10, 11, 20] and at(ttl=1, auths=()) == [11]
    assert scan.scan(s, g="u:g").count() == 0
    with pytest.raises(ValueError):
        scan.apply_iterators(s.quads, [(1, "nonsense")])


def test_mutations(spark):
    q = m.conform(spark.createDataFrame([("u:a", "u:p", "1", 5), ("u:a", "u:p", "1", 9), ("u:b", "u:p", "2", 1)], "s string, p string, o string, ts bigint"))
    q = scan.insert(q.limit(0), q.withColumn("seq", F.col("ts")))
    assert sorted((r.s, r.ts) for r in m.latest(q).collect()) == [("u:a", 9), ("u:b", 1)]
    gone = q.where("ts = 5")
    assert scan.delete_exact(q, gone).count() == 1 and scan.delete_exact(q, gone, with_time=True).count() == 2
    stay, went = scan.delete_matching(q, s="u:a")
    assert (stay.count(), went.count()) == (1, 2)
    assert scan.insert(q, q).agg(F.max("seq")).first()[0] > q.agg(F.max("seq")).first()[0]
    out = merge.merge(q, q.limit(0), 6).report()
    assert {r.action: r.n for r in out.collect()} == {"kept": 1, "deleted": 1}
    assert merge.fan_out(q, ["u:g"]).count() == 3 and merge.fan_out(q, []).count() == 3


def test_search_without_terms(spark, monkeypatch):
    texts = ["The anger", "man ber-", "a*b an ER", "over_an Er_", "", "İan ßer", "é", "B2B the_ *x", "THE"]
    df = m.conform(spark.createDataFrame([(str(i), "p", x) for i, x in enumerate(texts)], "s string, p string, o string"))
    words = ["the", "*an*", "*er", "an*", "*", "**", "a*b", "a*b*", "*b", "***", "*x", "é", "*é*", "b2*"]
    have = df.select("s", text.tokens(F.col("o")).alias("t"))
    by_term = lambda w: F.exists("t", lambda t: text.word_matches(t, w))
    want = have.select("s", *[by_term(w).alias(f"w{i}") for i, w in enumerate(words)]).collect()
    monkeypatch.setattr(text, "tokens", None)  # a search doesn't cut texts
    got = {r.s: r for r in df.select("s", *[text.text_matches(F.col("o"), w).alias(f"w{i}") for i, w in enumerate(words)]).collect()}
    assert [got[r.s] for r in want] == want
    assert {r.s for r in text.search(df, "*an* *er").collect()} == {"0", "1", "2", "5"}


def test_entries_are_distinct_before_they_are_made(spark):
    rows = [("x", "u:when", "[2020-01-01T00:00:00Z,2020-02-01T00:00:00Z]", lang) for lang in ("", None)] + [("y", "u:when", "2020-01-01T00:00:00Z", ""), ("z", "u:when", "no time", "")]
    df = temporal.entries(m.conform(spark.createDataFrame(rows * 2, "s string, p string, o string, o_lang string")))
    assert df.count() == 6
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.index("Generate explode") < plan.index("HashAggregate") < plan.index("REPARTITION_BY_COL") and plan.count("Exchange") == 1
