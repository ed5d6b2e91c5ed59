"""Word language by a linear-chain conditional random field.

Every word of a text gets a language; neighbours inform each other through
learned transitions, so a lone ambiguous word follows its surroundings and a
passage in another language is found where it begins and ends. Features of a
word are its affixes of one to four letters, its letter pairs, triples and
quadruples, and the whole word as lexicon entry, hashed into one table of
weights with a column for each language.

Weights are trained on the driver by stochastic gradient ascent of the
conditional likelihood, on a bounded sample of passages of documents with a
known language and on sentences put together from passages of different
languages, which teach the transitions. Decoding gives each word its most probable language by
forward-backward.

A slice of texts is one array of words. Emissions are sums of table rows over
the letters of each word. Forward and backward messages run over chunks of
``CHUNK`` words: all chunks advance in step, first as transfer matrices to find
what enters each chunk, then with it. That is exact and needs no loop over
words.

Defined results: a null or empty text, or one without words, has no spans and a
null language; repeated rows are labelled each; further columns are left
behind; of equally probable languages the first in the alphabet counts.
Without any document of known language no language can be told: spans are empty.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quadloom.llm import textnp as tx
from quadloom.llm.common import map_text, stable_hash

BITS, CHUNK = 17, 32
#: Labelled passages of each language that training reads at most, and the words of a passage.
#: Passages are drawn from whole documents, wherever they stand in them.
SAMPLE_PER_LANGUAGE, SAMPLE_WORDS = 400, 400
_LETTER = np.zeros(256, bool)
_LETTER[97:123] = _LETTER[65:91] = True
_LETTER[128:] = True


@dataclass
class Words:
    """The words of a slice: byte spans in the lower-cased text, and offsets by text."""

    low: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    by: np.ndarray


def words_of(data: np.ndarray, offsets: np.ndarray) -> Words:
    low = tx.lower(data)
    starts, ends = tx.runs(_LETTER[low], offsets)
    return Words(low, starts, ends, tx.per_document(starts, offsets))


def features(w: Words) -> tuple[np.ndarray, np.ndarray]:
    """Hashed features of all words one after the other, and the offsets by word."""
    n = len(w.starts)
    lengths = w.ends - w.starts
    at = tx.ragged_index(w.starts, lengths)
    text, place = w.low[at].astype(np.uint32), np.arange(len(at)) - np.repeat(tx.counts_to_offsets(lengths)[:-1], lengths)
    size = np.repeat(lengths, lengths)
    to = tx.counts_to_offsets(lengths)
    shift = np.uint32(32 - BITS)
    hashed = lambda code, kind: (code * np.uint32(2654435761) + np.uint32(kind * 0x9E3779B1 & 0xFFFFFFFF)) * np.uint32(2246822519) >> shift
    code, columns = text.copy(), []
    grams = {1: text}
    for k in (2, 3, 4):
        code = np.concatenate([code[: len(text) - k + 1] if len(text) >= k else code[:0], np.zeros(min(k - 1, len(text)), np.uint32)])
        code[: max(0, len(text) - k + 1)] = code[: max(0, len(text) - k + 1)] << np.uint32(8) | text[k - 1 :]
        grams[k] = code.copy()
        fits = place + k <= size
        columns.append((hashed(code, k), fits))
    for k in (1, 2, 3, 4):
        first = np.minimum(to[:-1], max(0, len(text) - 1))
        last = np.maximum(to[1:] - k, 0)
        ok = lengths >= k
        columns.append((hashed(grams[k][first] if n else text, 10 + k), ok))
        columns.append((hashed(grams[k][last] if n else text, 20 + k), ok))
    lexicon = (tx.span_hashes(w.low, w.starts, w.ends) >> np.uint64(64 - BITS)).astype(np.uint32)
    columns.append((lexicon, np.ones(n, bool)))
    owner = np.repeat(np.arange(n), lengths)
    flat = np.concatenate([c[m] for c, m in columns])
    of = np.concatenate([(owner if len(m) == len(owner) and i < 3 else np.arange(n))[m] for i, (c, m) in enumerate(columns)])
    order = np.argsort(of, kind="stable")
    return flat[order].astype(np.int64), tx.counts_to_offsets(np.bincount(of, minlength=n))


def emissions(w: Words, table: np.ndarray) -> np.ndarray:
    """Sum of the table rows of each word's features, relative to its best language. Nothing is kept by feature: parts add up as they come."""
    n, k = len(w.starts), table.shape[1]
    if n == 0:
        return np.zeros((0, k), np.float32)
    lengths = w.ends - w.starts
    to = tx.counts_to_offsets(lengths)
    at = tx.ragged_index(w.starts, lengths)
    text = w.low[at].astype(np.uint32)
    shift = np.uint32(32 - BITS)
    hashed = lambda code, kind: (code * np.uint32(2654435761) + np.uint32(kind * 0x9E3779B1 & 0xFFFFFFFF)) * np.uint32(2246822519) >> shift
    left = np.repeat(to[1:], lengths) - np.arange(len(text))  # letters from here to the word's end
    total = np.zeros((len(text), k), np.float32)
    code, out = text, np.zeros((n, k), np.float32)
    for m in (1, 2, 3, 4):
        if m > 1:
            code = np.concatenate([code[: max(0, len(text) - m + 1)] << np.uint32(8) | text[m - 1 :], np.zeros(min(m - 1, len(text)), np.uint32)])
            fits = np.flatnonzero(left >= m)
            total[fits] += table[hashed(code[fits], m)]
        ok = np.flatnonzero(lengths >= m)
        out[ok] += table[hashed(code[to[:-1][ok]], 10 + m)] + table[hashed(code[to[1:][ok] - m], 20 + m)]
    out += np.add.reduceat(total, to[:-1], axis=0)
    out += table[(tx.span_hashes(w.low, w.starts, w.ends) >> np.uint64(64 - BITS)).astype(np.int64)]
    return out - out.max(axis=1, keepdims=True)


def forward_backward(emission: np.ndarray, transition: np.ndarray, start: np.ndarray, by: np.ndarray) -> np.ndarray:
    """Probability of each language at each word, given its whole text."""
    alpha, beta, _, _ = messages(emission, transition, start, by)
    p = alpha * beta
    return p / p.sum(axis=1, keepdims=True)


def messages(emission: np.ndarray, transition: np.ndarray, start: np.ndarray, by: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Forward messages (own emission included), backward messages (without it), each scaled by word, and the potentials of words and moves."""
    n, k = emission.shape
    count = np.diff(by)
    if n == 0:
        return np.zeros((0, k)), np.zeros((0, k)), np.zeros((0, k)), np.exp(transition)
    psi = np.exp(emission.astype(np.float64))
    move = np.exp(transition.astype(np.float64))
    chunks = -(-count // CHUNK)
    owner = np.repeat(np.arange(len(count)), chunks)
    index = np.arange(len(owner)) - np.repeat(tx.counts_to_offsets(chunks)[:-1], chunks)
    begin = by[owner] + index * CHUNK
    size = np.minimum(CHUNK, by[owner + 1] - begin)
    c = len(owner)
    # transfer of each chunk: what leaves it, for each language that the word before it may have
    inside = np.broadcast_to(np.eye(k), (c, k, k)).copy()
    order = np.argsort(-size, kind="stable")
    longest = size[order]
    for t in range(int(longest[0])):
        some = order[: np.searchsorted(-longest, -t, side="left")]
        m = inside[some] @ move
        if t == 0:
            m[index[some] == 0] = np.eye(k)  # nothing moves into the first word of a text
        m *= psi[begin[some] + t][:, None, :]
        inside[some] = m / m.max(axis=(1, 2), keepdims=True)
    first = np.flatnonzero(index == 0)
    enter, leave = np.zeros((c, k)), np.ones((c, k))
    enter[first] = np.exp(start.astype(np.float64))
    for step in range(1, int(chunks.max(initial=0))):
        at = first[chunks[owner[first]] > step] + step
        v = np.einsum("ni,nij->nj", enter[at - 1], inside[at - 1])
        enter[at] = v / v.max(axis=1, keepdims=True)
    last = first + chunks[owner[first]] - 1
    for step in range(1, int(chunks.max(initial=0))):
        at = last[chunks[owner[last]] > step] - step
        v = np.einsum("nij,nj->ni", inside[at + 1], leave[at + 1])
        leave[at] = v / v.max(axis=1, keepdims=True)
    alpha, beta = np.empty((n, k)), np.empty((n, k))
    a, b = enter.copy(), leave.copy()
    for t in range(int(longest[0])):
        some = order[: np.searchsorted(-longest, -t, side="left")]
        m = a[some] @ move
        if t == 0:
            m[index[some] == 0] = a[some][index[some] == 0]
        m *= psi[begin[some] + t]
        a[some] = m / m.max(axis=1, keepdims=True)
        alpha[begin[some] + t] = a[some]
        beta[begin[some] + size[some] - 1 - t] = b[some]
        m = (psi[begin[some] + size[some] - 1 - t] * b[some]) @ move.T
        b[some] = m / m.max(axis=1, keepdims=True)
    return alpha, beta, psi, move


@dataclass
class Model:
    languages: list[str]
    table: np.ndarray
    transition: np.ndarray
    start: np.ndarray

    def label(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Language of each word, its probability, and the offsets by text."""
        w = words_of(data, offsets)
        p = forward_backward(emissions(w, self.table), self.transition, self.start, w.by)
        best = p.argmax(axis=1) if len(p) else np.zeros(0, np.int64)
        return best, p[np.arange(len(best)), best] if len(p) else np.zeros(0), w.by


def train(texts: list[str], languages: list[str], epochs: int = 4, rate: float = 0.5) -> Model | None:
    """Stochastic gradient ascent (AdaGrad) over batches of sequences, half of them mixed of several texts."""
    names = sorted(set(languages))
    if not names:
        return None
    k = len(names)
    raw = [t.encode("utf-8", "replace") for t in texts]
    offsets = tx.counts_to_offsets(np.array([len(r) for r in raw]))
    w = words_of(np.frombuffer(b"".join(raw), np.uint8), offsets)
    flat, to = features(w)
    truth = np.repeat(np.array([names.index(x) for x in languages]), np.diff(w.by))
    draw = np.random.default_rng(0)
    sequences = []  # arrays of word numbers: each text, and mixtures of passages of 3 to 20 words
    filled = np.flatnonzero(np.diff(w.by) > 0)
    for d in filled:
        sequences.append(np.arange(w.by[d], w.by[d + 1]))
    for _ in range(len(filled)):
        parts = []
        for d in draw.choice(filled, draw.integers(2, 6)):
            size = min(int(draw.integers(3, 21)), int(w.by[d + 1] - w.by[d]))
            at = int(draw.integers(w.by[d], w.by[d + 1] - size + 1))
            parts.append(np.arange(at, at + size))
        sequences.append(np.concatenate(parts))
    table, seen = np.zeros((1 << BITS, k)), np.full((1 << BITS, k), 1e-2)
    transition, start = np.zeros((k, k)), np.zeros(k)
    seen_t = np.full((k, k), 1.0)
    for epoch in range(epochs):
        batches = np.array_split(draw.permutation(len(sequences)), max(1, len(sequences) // 32))
        for batch in batches:
            some = [sequences[i] for i in batch]
            by = tx.counts_to_offsets(np.array([len(x) for x in some]))
            word = np.concatenate(some)
            size = to[word + 1] - to[word]
            column, owner = flat[tx.ragged_index(to[word], size)], np.repeat(np.arange(len(word)), size)
            e = np.add.reduceat(table[column], tx.counts_to_offsets(size)[:-1], axis=0)
            e -= e.max(axis=1, keepdims=True)
            alpha, beta, psi, move = messages(e, transition, start, by)
            p = alpha * beta
            p /= p.sum(axis=1, keepdims=True)
            y = truth[word]
            g = -p
            g[np.arange(len(word)), y] += 1
            np.multiply(g, rate, out=g)
            unique, inverse = np.unique(column, return_inverse=True)
            step = np.column_stack([np.bincount(inverse, weights=g[owner, j], minlength=len(unique)) for j in range(k)])
            seen[unique] += step**2
            table[unique] += rate * step / np.sqrt(seen[unique]) * 0.2
            pair = np.ones(len(word) - 1, bool)
            pair[by[1:-1] - 1] = False
            pair = np.flatnonzero(pair)
            # probability of each move between neighbours, given the whole text
            joint = alpha[pair][:, :, None] * move * (psi[pair + 1] * beta[pair + 1])[:, None, :]
            joint /= joint.sum(axis=(1, 2), keepdims=True)
            got = np.zeros((k, k))
            np.add.at(got, (y[pair], y[pair + 1]), 1)
            gt = (got - joint.sum(axis=0)) / max(1, len(pair)) * 100
            seen_t += gt**2
            transition += 0.3 * gt / np.sqrt(seen_t)
            transition -= transition.max()
    return Model(names, table.astype(np.float32), transition, start)


def fit(docs: DataFrame, per_language: int = SAMPLE_PER_LANGUAGE, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model | None:
    """A model from at most ``per_language`` passages of each known language, chosen by a hash of id and place.

    Two scans: one of the language column alone for the counts, one that lets
    through about one and a half times as many documents as passages are wanted.
    Those are cut into passages, all their words, and of these a hash takes the sample.
    """
    known = docs.select(F.col(lang_col).cast("string").alias("_lang"), F.col(text_col).cast("string").alias("_text"), F.pmod(stable_hash(id_col), F.lit(1 << 40)).alias("_h"))
    known = known.where("_lang is not null and _lang <> ''")
    counts = {r[0]: r[1] for r in known.groupBy("_lang").count().collect()}
    if not counts:
        return None
    limit = F.create_map(*[F.lit(x) for name, n in sorted(counts.items()) for x in (name, int(min(1.0, (1.5 * per_language + 20) / n) * (1 << 40)))])
    some = known.where(F.col("_h") < limit[F.col("_lang")]).where("_text is not null and _text <> ''").withColumn("_words", F.split("_text", r"\s+"))
    places = F.sequence(F.lit(1), F.size("_words"), F.lit(SAMPLE_WORDS))
    cut = some.select("_lang", "_h", "_words", F.explode(places).alias("_at"))
    cut = cut.select("_lang", F.xxhash64("_h", "_at").alias("_k"), F.array_join(F.slice("_words", F.col("_at"), F.lit(SAMPLE_WORDS)), " ").alias("_text"))
    place = F.row_number().over(Window.partitionBy("_lang").orderBy("_k", "_text"))
    rows = cut.withColumn("_place", place).where(F.col("_place") <= per_language).toPandas().sort_values(["_lang", "_place"])
    return train(rows["_text"].tolist(), rows["_lang"].tolist())


def label(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, language, n_words, switches, spans) of every row, without a shuffle.

    ``spans``: an array of (start, stop, lang, confidence) of maximal runs of words of one
    language, in words; ``language`` is that of most words.
    """
    source = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text"))
    span = T.StructType([T.StructField("start", T.LongType()), T.StructField("stop", T.LongType()), T.StructField("lang", T.StringType()), T.StructField("confidence", T.DoubleType())])
    schema = T.StructType(
        [T.StructField(id_col, source.schema["_id"].dataType), T.StructField("language", T.StringType()), T.StructField("n_words", T.LongType()), T.StructField("switches", T.LongType()), T.StructField("spans", T.ArrayType(span))]
    )
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(rows, data, offsets):
        m, n = shared.value, len(offsets) - 1
        if m is None:
            best, p, by, names = np.zeros(0, np.int64), np.zeros(0), np.zeros(n + 1, np.int64), pa.array([], pa.string())
        else:
            (best, p, by), names = m.label(data, offsets), pa.array(m.languages)
        doc = np.repeat(np.arange(n), np.diff(by))
        first = np.ones(len(best), bool)
        first[1:] = (best[1:] != best[:-1]) | (doc[1:] != doc[:-1])
        at = np.flatnonzero(first)
        end = np.append(at[1:], len(best))
        spans = np.bincount(doc[at], minlength=n)
        mean = np.add.reduceat(p, at) / (end - at) if len(at) else np.zeros(0)
        structs = pa.StructArray.from_arrays([pa.array(at - by[doc[at]]), pa.array(end - by[doc[at]]), names.take(pa.array(best[at])), pa.array(np.round(mean, 6))], names=span.names)
        k = max(1, len(names))
        votes = np.bincount(doc * k + best, minlength=n * k).reshape(n, k)
        main = pa.array(votes.argmax(axis=1), mask=votes.sum(axis=1) == 0)
        lists = pa.ListArray.from_arrays(pa.array(tx.counts_to_offsets(spans).astype(np.int32)), structs)
        return pa.RecordBatch.from_arrays([rows.column(0), names.take(main), pa.array(np.diff(by)), pa.array(np.maximum(spans - 1, 0)), lists], names=schema.names)

    return map_text(source, "_text", run, schema)
