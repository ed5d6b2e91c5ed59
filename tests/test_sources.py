"""RDF text, layouts, loads, code facts and streams."""

import pytest
from pyspark.sql import functions as F

from quadloom import model as m
from quadloom.operators import pcj, scan
from quadloom.plans import lower, sparql
from quadloom.sources import codefacts, rdfio
from quadloom.sources.store import QuadStore, choose_layout, read_layout, write_layout
from quadloom.streaming.views import Maintainer, sessions, windowed_counts

LINES = [
    '<u:a> <u:p> "x\\"y\\n\\u00e9" .', '<u:a> <u:p> "x"@en-GB <u:g> . # note', '<u:a> <u:p> "1"^^<u:int> .', "<u:a> <u:p> <u:b> .", "_:b1 <u:p> _:b2 <u:g> .", "# comment", "", "  ", "<u:a> <u:p> .", "nonsense",
]


def test_lines(spark, tmp_path):
    df = spark.createDataFrame([(x,) for x in LINES], "value string")
    rows = [tuple(r) for r in rdfio.parse_lines(df).collect()]
    assert rows[:5] == [("u:a", "u:p", 'x"y\né', m.STRING, "", None, None), ("u:a", "u:p", "x", m.LANG_STRING, "en-GB", "u:g", None), ("u:a", "u:p", "1", "u:int", "", None, None), ("u:a", "u:p", "u:b", m.IRI, "", None, None), ("_:b1", "u:p", "_:b2", m.IRI, "", "u:g", None)]
    assert [r[-1] for r in rows[5:]] == LINES[-2:]
    good = m.conform(rdfio.parse_lines(df).where("bad is null"))
    rdfio.write(good, f"file://{tmp_path}/q")
    back = rdfio.read(spark, f"file://{tmp_path}/q", "nq")
    assert sorted(map(repr, back.collect())) == sorted(map(repr, good.collect()))
    df.write.text(f"file://{tmp_path}/bad")
    with pytest.raises(Exception, match="can't read"):
        rdfio.read(spark, f"file://{tmp_path}/bad", "nq").collect()
    assert rdfio.read(spark, f"file://{tmp_path}/bad", "nq", strict=False).count() == 5
    assert rdfio.with_defaults(good, "A", "u:d").where("vis <> 'A' or g is null").count() == 0


def test_trig():
    text = '@prefix e: <http://x/> .\n{ e:a e:p "1" , e:b ; e:q 2 . }\ne:g {\n e:a a e:T .\n e:b e:p "z"@de }\nGRAPH <u:h> { <u:a> <u:p> <u:b> }'
    rows = rdfio.parse_trig(text)
    assert len(rows) == 6 and rows[0] == ("http://x/a", "http://x/p", "1", m.STRING, "", None) and rows[3][1] == m.TYPE and {r[-1] for r in rows} == {None, "http://x/g", "u:h"}


def test_layouts(spark, tmp_path):
    q = m.conform(spark.range(200).selectExpr("concat('u:s', id % 20) as s", "concat('u:p', id % 3) as p", "concat('v', id) as o"))
    for layout in ("spo", "po", "osp"):
        write_layout(q, f"file://{tmp_path}/{layout}", layout, 3)
        back = read_layout(spark, f"file://{tmp_path}/{layout}")
        assert scan.scan(back, p="u:p1").count() == 67 and back.quads.columns == m.COLUMNS
    assert [choose_layout(*x) for x in ((1, 1, 1), (1, 0, 1), (0, 1, 1), (0, 0, 1), (0, 0, 0))] == ["spo", "osp", "po", "osp", "spo"]
    rdfio.load(q, f"file://{tmp_path}/all", ("po",), text=True, geo=True, temporal=True, entity=True, partitions=2)
    assert spark.read.parquet(f"file://{tmp_path}/all/entity").count() == 400
    assert rdfio.mutations(q, "t_").groupBy("table").count().count() == 3


def test_code_facts(spark):
    files = [
        ("Cargo.toml", '[package]\nname = "x"\n[dependencies]\nserde = "1.0"\ntokio = { version = "1.2", features = [] }\n'), ("package.json", '{"dependencies": {"left-pad": "^1"}}'), ("src/lib.rs", "use serde::X;\npub fn go() {\n    helper(1);\n}\nstruct S;\n"),
        ("src/auth.js", "import a from 'axios'\nexport function login(password) { return fetch('/x') }\nconst go = (x) => x\n"), ("sbom.json", "CVE-2024-12345 pkg:npm/left-pad@1.0.0"), ("broken/package.json", "{"), ("empty.md", ""),
    ]
    df = spark.createDataFrame(files, "path string, content string")
    got = {(r.s, r.p.removeprefix("urn:code:"), r.o) for r in codefacts.facts(df, "u:repo").collect()}
    f = "u:repo/file/"
    for want in [
        (f + "Cargo.toml", "dependsOnPackage", "urn:package:cargo:tokio@1.2"), (f + "package.json", "dependsOnPackage", "urn:package:npm:left-pad@^1"), (f + "src/lib.rs", "exports", f + "src/lib.rs#go"), (f + "src/lib.rs#go", "calls", "u:repo/symbol/helper"),
        (f + "src/auth.js", "imports", "u:repo/module/axios"), (f + "src/auth.js", "defines", f + "src/auth.js#go"), ("urn:package:npm:left-pad@1.0.0", "urn:sec:hasVulnerability", "urn:sec:vuln/CVE-2024-12345"), (f + "empty.md", "lineCount", "0"),
    ]:
        assert want in got, want
    found = {(r.path, r.kind) for r in codefacts.findings(df).collect()}
    assert ("Cargo.toml", "DependencyGraphSurface") in found and ("src/auth.js", "NetworkRequestSurface") in found
    many = spark.createDataFrame([("a", "unsafe\n" * 200)], "path string, content string")
    assert codefacts.findings(many).count() == 200 and codefacts.findings(many, 80).count() == 80


QUERY = "SELECT ?a ?c { ?a <u:p> ?b . ?b <u:q> ?c }"
OPTIONAL = "SELECT ?a ?c { ?a <u:p> ?b OPTIONAL { ?b <u:q> ?c } }"


def test_stream_equals_batch(spark, tmp_path):
    rows = [(f"u:{i % 7}", "u:p" if i % 2 else "u:q", f"u:{i % 5}", m.IRI, "", "A" if i % 3 else "") for i in range(60)]
    df = m.conform(spark.createDataFrame(rows, "s string, p string, o string, o_dt string, o_lang string, vis string"))
    for k in range(3):
        df.where(F.pmod(F.xxhash64("s", "o"), F.lit(3)) == k).coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/in")
    keep = Maintainer(spark, f"file://{tmp_path}/state")
    ids = [keep.register(q) for q in (QUERY, OPTIONAL)]
    stream = spark.readStream.schema(m.QUADS).option("maxFilesPerTrigger", 1).parquet(f"file://{tmp_path}/in")
    keep.run(stream, f"file://{tmp_path}/checkpoint").awaitTermination()
    for id_, q in zip(ids, (QUERY, OPTIONAL)):
        want = lower.evaluate(QuadStore.of(df), sparql.parse(q), with_labels=True)
        assert sorted(map(repr, keep.results(id_).select("a", "c").collect())) == sorted(map(repr, want.select("a", "c").collect()))
    before = keep.results(ids[0]).count()
    keep.apply(keep.statements(batch=2).quads, 2)  # a batch that is run again
    assert keep.results(ids[0]).count() == before and pcj._plain(sparql.parse(QUERY)) and not pcj._plain(sparql.parse(OPTIONAL))


def test_windows(spark):
    e = spark.createDataFrame([(1, "2024-01-01 00:10:00", "a", 1.0), (1, "2024-01-01 00:20:00", "a", 2.0), (1, "2024-01-01 02:00:00", "a", 4.0)], "user_id int, ts string, event_type string, value double").withColumn("ts", F.col("ts").cast("timestamp"))
    assert sorted((r.n, r.total) for r in windowed_counts(e).collect()) == [(1, 4.0), (2, 3.0)]
    assert sorted(r.n for r in windowed_counts(e, "2 hours", "1 hour").collect()) == [1, 1, 2, 2]
    assert sorted(r.n for r in sessions(e).collect()) == [1, 2]
