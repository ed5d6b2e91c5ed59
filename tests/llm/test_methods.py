"""Each method against brute force, SQL, a round trip, or held-out accuracy."""

import itertools
import random

import numpy as np
import pyarrow as pa
import pytest

import compare
import corpus_pipeline
from quadloom.llm import bpe, ctph, jaccard, langid, quality, queries, sharding, textnp, toxicity, warc
from quadloom.llm.common import Scratch


WORDS = "river stone window garden market letter winter summer people number system moment answer paper story music light water field house".split()


def prose(draw, n):
    return " ".join(draw.choice(WORDS) + draw.choice(["", "", "s", "ing"]) for _ in range(n))


def raw(texts):
    b = [t.encode() for t in texts]
    return np.frombuffer(b"".join(b), np.uint8), textnp.counts_to_offsets(np.array([len(x) for x in b]))


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_sql(spark, small, name):
    compare.check(queries.QUERIES[name](spark, small), compare.connect(small), queries.ORACLE[name])


def grams(text):
    w = text.split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def test_jaccard_brute_force(spark):
    draw = random.Random(5)
    texts = []
    for _ in range(25):
        w = prose(draw, draw.randint(4, 90)).split()
        texts.append(" ".join(w))
        for _ in range(draw.randint(0, 4)):
            v = list(w)
            for _ in range(draw.randint(0, 3)):
                v[draw.randrange(len(v))] = "other"
            texts.append(" ".join(v))
    want = {}
    for (i, a), (j, b) in itertools.combinations(enumerate(map(grams, texts)), 2):
        if a and b and (s := len(a & b) / len(a | b)) >= 0.7:
            want[i, j] = s
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    first = {}
    for i, g in enumerate(map(grams, texts)):
        first.setdefault(frozenset(g), i)
    different = {k: v for k, v in want.items() if v < 1 and set(k) <= set(first.values())}
    got = {(r.doc_a, r.doc_b): r.jaccard for r in jaccard.similar_sets(df).collect()}
    assert set(got) <= set(different) and all(abs(got[k] - want[k]) < 1e-12 for k in got)
    assert len(got) >= 0.9 * len(different) and len(different) > 20
    rep = [first[frozenset(g)] for g in map(grams, texts)]
    found = [(i, j) for i, j in want if rep[i] == rep[j] or (min(rep[i], rep[j]), max(rep[i], rep[j])) in got]
    root, links = list(range(len(texts))), [0] * len(texts)
    for i, j in found:
        links[i] += 1
        links[j] += 1
    for _ in texts:
        for i, j in found:
            root[i] = root[j] = min(root[i], root[j])
    assert {r.doc_id: (r.class_id, r.links) for r in jaccard.classes(df).collect()} == dict(enumerate(zip(root, links)))
    assert {r.doc_id for r in jaccard.keep_one(df).collect()} == set(root)


def test_posterior_bound():
    least = jaccard.least_matches(0.7, 0.01)
    grid = np.linspace(0, 1, 20001)
    for n, m in ((8, least[8]), (40, least[40]), (80, least[80])):
        for k, stays in ((m, True), (m - 1, False)):
            if k >= 0:
                density = grid**k * (1 - grid) ** (n - k)
                assert (density[grid >= 0.7].sum() / density.sum() >= 0.01) == stays


def merge_by_hand(word, rank):
    parts = [bytes([b]) for b in word]
    while True:
        best = min(((rank[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in rank), default=None)
        if best is None:
            return [rank[p] for p in parts]
        i = best[1]
        parts[i : i + 2] = [parts[i] + parts[i + 1]]


def test_bpe_by_hand():
    tokens = bpe.read_tokens(bpe.VOCABULARY)
    rank, t = {x: i for i, x in enumerate(tokens)}, bpe.tables(bpe.VOCABULARY)
    draw = random.Random(2)
    words = [draw.randbytes(draw.randint(1, 40)) for _ in range(200)] + [prose(draw, 3).encode() for _ in range(200)] + [b"aaaa" * 700, "日本語".encode() * 300]
    ids, to = t.encode(words)
    for w, a, b in zip(words, to, to[1:]):
        assert list(ids[a:b]) == merge_by_hand(w, rank)


def edit_score(a, b):
    """Insertions and deletions by dynamic programming."""
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(row[j - 1] if x == y else 1 + min(row[j], new[-1]))
        row = new
    return row[-1]


def squeeze(s):
    out = ""
    for c in s:
        if not out.endswith(c * 3):
            out += c
    return out


def ctph_by_hand(x, y):
    best = 0
    for block, a, b in [(i, p, q) for i, p in ((x[0], x[1]), (2 * x[0], x[2])) for k, q in ((y[0], y[1]), (2 * y[0], y[2])) if i == k]:
        a, b = squeeze(a), squeeze(b)
        runs = {a[i : i + 7] for i in range(len(a) - 6)} & {b[i : i + 7] for i in range(len(b) - 6)}
        if runs:
            total = len(a) + len(b)
            best = max(best, min(100 - -(-100 * edit_score(a, b) // total), block // 3 * min(len(a), len(b))))
    return best


def test_ctph_brute_force(spark):
    draw = random.Random(9)
    texts = []
    for _ in range(12):
        w = prose(draw, draw.randint(30, 900)).split()
        texts.append(" ".join(w))
        for k in range(3):
            v = list(w)
            at = draw.randrange(len(v))
            v[at : at + draw.choice([1, 1, len(v) // 3])] = ["new"] * k
            texts.append(" ".join(v))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    rows = {r.doc_id: r for r in ctph.similar(df).collect()}
    prints = {k: (r.block_size, r.signature, r.signature_double) for k, r in rows.items()}
    want, root = {k: {} for k in rows}, {k: k for k in rows}
    for a, b in itertools.permutations(rows, 2):
        score = 100 if prints[a] == prints[b] and prints[a][1] else ctph_by_hand(prints[a], prints[b])
        if score >= ctph.THRESHOLD:
            want[a][b] = score
    for _ in rows:
        for a in want:
            for b in want[a]:
                root[a] = root[b] = min(root[a], root[b])
    assert sum(map(len, want.values())) > 20
    assert {k: (r.class_id, r.links) for k, r in rows.items()} == {k: (root[k], len(v)) for k, v in want.items()}
    s = Scratch(spark)
    _, groups, scored = ctph.links(df, ctph.THRESHOLD, "doc_id", "text", s)
    rep = {r._node: r._rep for r in groups.collect()}
    assert {(x, y): r._score for r in scored.collect() for x, y in ((rep[r._a], rep[r._b]), (rep[r._b], rep[r._a]))} == {(a, b): v for a in want for b, v in want[a].items() if {a, b} <= set(rep.values())}
    s.close()


@pytest.mark.parametrize("block", [2, 5, 1024])
def test_ctph_hot_keys(block, monkeypatch):
    """Keys beyond two blocks are handed on; the pairs of all blocks are those of the key."""
    monkeypatch.setattr(ctph, "BLOCK", block)
    draw = random.Random(block)
    rows = sorted({(draw.choice([1, 1, 1, 2, 3]), draw.randrange(60), draw.randrange(20, 60) << 7 | draw.randrange(3)) for _ in range(90)})
    want = {(min(x, y), max(x, y)) for (k, x, m), (o, y, q) in itertools.combinations(rows, 2) if k == o and x != y and m & 127 != q & 127 and 100 * abs((m >> 7) - (q >> 7)) <= 40 * ((m >> 7) + (q >> 7))}

    def batches(some, n):
        for at in range(0, len(some), n):
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*some[at : at + n])], names=["k", "i", "m", "s"])

    for n in (1, 3, 7, 100):
        out = [r for b in ctph._pairs(60)(batches([(*r, 0) for r in rows], n)) for r in b.to_pylist()]
        got = {(r["_a"], r["_b"]) for r in out if r["_block"] is None}
        hot = [r for r in out if r["_block"] is not None]
        met = []
        for key in sorted({r["_a"] for r in hot}):
            own = [r for r in hot if r["_a"] == key]
            last = max(r["_block"] for r in own)
            for x in range(last + 1):
                for y in range(x, last + 1):
                    met += [(key * 10_000 + x * 100 + y, r["_b"], r["_mark"], 0 if x == y else 1 + (r["_block"] == y)) for r in own if r["_block"] in (x, y)]
        across = [r for b in ctph._pairs_of_blocks(60)(batches(sorted(met), n)) for r in b.to_pylist()]
        assert got | {(r["_a"], r["_b"]) for r in across} == want
        assert bool(hot) == (block < 1024)


def test_toxicity_held_out():
    draw = random.Random(4)
    bad = ["blorgnik", "snarfwit", "grumbleton"]

    def spoilt(w):
        i = draw.randrange(1, len(w) - 1)
        return draw.choice([w, w.upper(), w[:i] + draw.choice("x-.*") + w[i:], w[:i] + w[i] + w[i:]])

    def sample(n):
        texts, toxic = [], []
        for k in range(n):
            words = prose(draw, 50).split()
            if k % 2:
                words.insert(draw.randrange(50), spoilt(draw.choice(bad)))
            texts.append(" ".join(words))
            toxic.append(bool(k % 2))
        return texts, np.array(toxic)

    model = toxicity.train(*sample(1600))
    texts, toxic = sample(200)
    called = model.score(*raw(texts)) > model.threshold
    assert (called & ~toxic).sum() <= 2 and (called & toxic).sum() >= 0.9 * toxic.sum()


def test_quality_is_monotone():
    draw = np.random.default_rng(0)
    x = draw.random((600, 4))
    y = ((x[:, 0] - x[:, 1] + 0.3 * np.sin(9 * x[:, 2]) + 0.2 * draw.standard_normal(600)) > 0).astype(float)
    f = quality.train(x[:400], y[:400], np.array([1, -1, 0, 0]))
    assert ((f.score(x[400:]) > 0.5) == (y[400:] > 0)).mean() > 0.8
    for column, sign in ((0, 1), (1, -1)):
        z = np.repeat(x[:50], 21, axis=0)
        z[:, column] = np.tile(np.linspace(0, 1, 21), 50)
        steps = np.diff(f.margin(z).reshape(50, 21), axis=1) * sign
        assert (steps >= -1e-12).all()


def test_forward_backward_by_hand():
    draw = np.random.default_rng(1)
    e, move, start = draw.standard_normal((7, 3)), draw.standard_normal((3, 3)), draw.standard_normal(3)
    by = np.array([0, 4, 4, 7])
    got = langid.forward_backward(e, move, start, by)
    for a, b in ((0, 4), (4, 7)):
        total = np.zeros((b - a, 3))
        for path in itertools.product(range(3), repeat=b - a):
            w = np.exp(start[path[0]] + sum(e[a + i, c] for i, c in enumerate(path)) + sum(move[c, d] for c, d in zip(path, path[1:])))
            for i, c in enumerate(path):
                total[i, c] += w
        assert np.allclose(got[a:b], total / total.sum(axis=1, keepdims=True))
    long = draw.standard_normal((500, 3))
    p, q = langid.forward_backward(long, move, start, np.array([0, 500])), []
    alpha = start.copy()
    for t in range(500):
        alpha = (np.logaddexp.reduce(alpha[:, None] + move, axis=0) if t else alpha) + long[t]
        q.append(alpha)
    last = np.exp(q[-1] - q[-1].max())
    assert np.allclose(p[-1], last / last.sum())


def test_language_switches():
    draw = random.Random(6)
    words = {"xx": ["kato", "pelu", "mino", "sara", "tilo", "keba"], "yy": ["gruff", "blint", "schnor", "drack", "zwump", "flonk"]}
    text = lambda lang, n: " ".join(draw.choice(words[lang]) + draw.choice(["", "s"]) for _ in range(n))
    langs = ["xx", "yy"] * 60
    model = langid.train([text(x, 40) for x in langs], langs)
    truth, parts = [], []
    for k in range(20):
        n = draw.randint(5, 15)
        parts.append(text("xx" if k % 2 else "yy", n))
        truth += ["xx" if k % 2 else "yy"] * n
    best, _, _ = model.label(*raw([" ".join(parts)]))
    assert np.mean([model.languages[b] == t for b, t in zip(best, truth)]) > 0.97


def test_sharding_keeps_groups_together(spark):
    edges = [(g * 10, g * 10 + k, 3) for g in range(40) for k in range(1, 10)]
    ids_ = spark.createDataFrame([(i,) for i in range(400)], "_id bigint")
    df = spark.createDataFrame(edges, "_a bigint, _b bigint, _w bigint")
    state, _ = sharding.propagate(ids_, df, Scratch(spark), shards=8)
    shard = {r._id: r._shard for r in state.collect()}
    sizes = np.bincount(list(shard.values()), minlength=8)
    assert len(shard) == 400 and sizes.max() <= 52
    assert sum(shard[a] != shard[b] for a, b, _ in edges) < 0.15 * len(edges)


def test_revisit_by_hand(spark):
    kinds = "record_id bigint, url string, captured bigint, kind string, etag string, last_modified string, digest string, headers array<struct<name:string,value:string>>"
    h = [("Content-Type", "t"), ("ETag", "1")]
    rows = [
        (1, "http://a.com/", 10, "response", '"x"', None, "d1", h), (2, "https://WWW.a.com:443/index.html#f", 20, "response", '"y"', None, "d2", h), (3, "http://a.com?utm_x=1", 20, "revisit", 'W/"x"', None, None, [("etag", "2"), ("Server", "s")]),
        (4, "http://a.com", 90_000_000, "revisit", '"x"', None, None, None), (5, "http://b.com", 5, "revisit", None, None, None, None), (6, "http://a.com/?b=2&a=1", 1, "response", None, "t0", "d", h), (7, "http://a.com/?a=1&b=2", 2, "revisit", None, None, None, None),
    ]
    got = {r.record_id: (r.status, r.refers_to, r.headers) for r in warc.resolve(spark.createDataFrame(rows, kinds)).collect()}
    assert got == {3: ("resolved", 1, "content-type: t\netag: 2"), 4: ("changed", 2, ""), 5: ("missing", None, ""), 7: ("unverified", 6, "")}


def test_pipeline(spark, small):
    """The stages one after the other over small tables; each is judged on what it was given."""
    docs = spark.read.parquet(f"{small}/documents.parquet")
    counts, scratch = [], Scratch(spark)
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, scratch.table(stage(spark, docs, small))
        counts.append((name, before.count(), docs.count()))
    assert all(0 < b <= a for _, a, b in counts)
    assert counts[0][2] >= 0.7 * counts[0][1] and counts[1][2] >= 0.7 * counts[1][1]
    assert docs.where("not round_trip").count() == 0
    assert corpus_pipeline.run(spark, small).count() == counts[-1][2]


def test_prefixed_hash_is_stable():
    a, b = raw(["one two three", "two three"]), raw(["two three"])
    starts, ends = textnp.runs(textnp.WORD[a[0]], a[1])
    other = textnp.runs(textnp.WORD[b[0]], b[1])
    assert list(textnp.span_hashes(a[0], starts, ends)[3:]) == list(textnp.span_hashes(b[0], *other))
