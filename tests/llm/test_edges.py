"""Nulls, empty and very long texts, repeated rows, empty tables and clashing columns, for every operator and stage."""

from pyspark.sql import functions as F

import corpus_pipeline
from quadloom.llm import bpe, ctph, jaccard, langid, mixing, quality, queries, sharding, toxicity, urls, warc

N_ROWS = 28


def ids(df):
    return sorted((r[0] is not None, r[0] or 0) for r in df.select("doc_id").collect())


def test_fixture(messy):
    assert messy.count() == N_ROWS


def test_scorers_return_every_row(messy, labels):
    models = {"toxicity": toxicity.fit(messy, labels), "quality": quality.fit(messy, labels)}
    none = messy.limit(0)
    for score, keep, model in ((toxicity.score, toxicity.keep, models["toxicity"]), (quality.score, quality.keep, models["quality"])):
        for m in (model, None):
            got = score(messy, m)
            assert ids(got) == ids(messy)
            assert keep(messy, m).columns == messy.columns
            assert score(none, m).count() == keep(none, m).count() == 0
            rows = [tuple(r) for r in got.where("doc_id = 5").collect()]
            assert len(rows) == 3 and len(set(rows)) == 1
    assert {r.toxic for r in toxicity.score(messy, models["toxicity"]).where("doc_id in (14, 15)").collect()} == {False}
    assert {(r.quality_score, r.keep) for r in quality.score(messy, models["quality"]).where("doc_id in (14, 15)").collect()} == {(0.0, False)}
    assert toxicity.fit(messy, labels.limit(0)) is None and quality.fit(messy, labels.limit(0)) is None
    assert toxicity.keep(messy, None).count() == N_ROWS


def test_bpe(messy):
    got = bpe.encode(messy)
    assert ids(got) == ids(messy) and got.where("not round_trip").count() == 0
    by = {r.doc_id: r for r in got.where("doc_id in (14, 15)").collect()}
    assert by[14].tokens is None and by[14].n_tokens == 0 and by[15].tokens == []
    assert bpe.encode(messy.limit(0)).count() == 0
    back = bpe.decode(bpe.encode(messy.where("doc_id is not null").dropDuplicates(["doc_id"])).withColumn("text", F.lit("old")))
    want = {r.doc_id: r.text for r in messy.where("doc_id is not null").collect()}
    assert {r.doc_id: r.text for r in back.collect()} == want


def test_jaccard(messy):
    rows = jaccard.classes(messy).collect()
    by = {r.doc_id: (r.class_id, r.links) for r in rows}
    assert len(rows) == len(by) and set(by) == {r.doc_id for r in messy.collect() if r.doc_id is not None}
    assert by[0] == by[12] == by[13] == (0, 2) and all(by[k] == (k, 0) for k in (14, 15, 16, 17, 18))
    kept = jaccard.keep_one(messy)
    assert kept.columns == messy.columns
    left = [r.doc_id for r in kept.collect()]
    assert left.count(0) == 1 and 12 not in left and 13 not in left and {14, 15, 16, 17, 18} <= set(left)
    assert left.count(None) == 2 and left.count(5) == 1 and left.count(3) == 1
    assert jaccard.classes(messy.limit(0)).count() == jaccard.keep_one(messy.limit(0)).count() == jaccard.similar_sets(messy.limit(0)).count() == 0


def test_mixing(messy):
    got = mixing.curriculum(messy)
    assert ids(got) == ids(messy)
    assert got.where("source is null").count() > 0 and got.where("tokens_before < 0").count() == 0
    ordered = mixing.order_documents(messy)
    assert ordered.columns == messy.columns and ordered.count() == got.where("position is not null").count()
    assert mixing.curriculum(messy.limit(0)).count() == mixing.order_documents(messy.limit(0)).count() == 0


def test_sharding(messy):
    got = sharding.shards(messy, shards=4)
    rows = got.collect()
    assert sorted(r.doc_id for r in rows) == sorted({r.doc_id for r in messy.collect() if r.doc_id is not None})
    sizes = [sum(r.shard == k for r in rows) for k in range(4)]
    assert sum(sizes) == len(rows) and max(sizes) <= max(-(-len(rows) // 4), int(1.05 * len(rows) / 4)) and {r.shard for r in rows} <= set(range(4))
    assert sharding.shards(messy.limit(0)).count() == 0


def test_ctph(messy):
    rows = {r.doc_id: r for r in ctph.similar(messy).collect()}
    assert set(rows) == {r.doc_id for r in messy.collect() if r.doc_id is not None}
    assert rows[12].class_id == rows[0].class_id == 0 and rows[12].links >= 1 and rows[15].signature == ""
    assert all((rows[k].class_id, rows[k].links) == (k, 0) for k in (14, 15))
    assert ctph.similar(messy.limit(0)).count() == 0


def test_langid(messy):
    m = langid.fit(messy)
    got = langid.label(messy, m)
    assert ids(got) == ids(messy)
    by = {r.doc_id: r for r in got.where("doc_id in (14, 15, 17, 18)").collect()}
    assert all(by[k].language is None and by[k].spans == [] for k in (14, 15, 17)) and by[18].n_words == 40_000
    assert all(s.start == (0 if i == 0 else by[18].spans[i - 1].stop) for i, s in enumerate(by[18].spans)) and by[18].spans[-1].stop == 40_000
    assert langid.fit(messy.limit(0)) is None and langid.label(messy, None).where("size(spans) > 0").count() == 0
    assert langid.label(messy.limit(0), m).count() == 0


def test_urls_and_revisits(spark):
    pages = spark.createDataFrame([(1, "http://a.com/poker-slots", "h"), (2, None, None), (3, "", "x"), (4, "http://casino.x/", "y"), (4, "http://casino.x/", "y"), (None, "http://www.a.com/poker-slots/", "h")], "page_id bigint, url string, html string").selectExpr("*", "1 as _id", "'q' as rejected")
    got = {(r.page_id, r.rejected) for r in urls.score(pages).collect()}
    assert got == {(1, True), (2, False), (3, False), (4, True), (None, True)}
    assert urls.keep(pages).columns == pages.columns and urls.keep(pages).count() == 2
    assert urls.score(pages.limit(0)).count() == 0
    resolved = warc.resolve(warc.records_of_pages(pages)).collect()
    assert len(resolved) == 6
    assert {r.status for r in resolved if r.canonical_url is None} == {"missing"}
    assert warc.resolve(warc.records_of_pages(pages.limit(0))).count() == 0


def test_stages(spark, messy, labels, tmp_path):
    folder = f"file://{tmp_path}/t"
    labels.write.parquet(f"{folder}/labels.parquet")
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "quality rules", "n-gram Jaccard join", "mixing sources to target weights", "byte-level BPE encoding and decoding"]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, messy, folder).columns == messy.columns
        assert stage(spark, messy.limit(0), folder).count() == 0
    assert corpus_pipeline.STAGES[-1][1](spark, messy, folder).count() == N_ROWS


def test_queries_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 11))
