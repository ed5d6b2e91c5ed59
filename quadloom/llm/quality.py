"""Gradient-boosted trees over document statistics.

Statistics are computed per slice on byte buffers, trees are grown on the
driver from a bounded labelled sample by histograms, with monotonic
constraints, and flattened into node arrays: a slice of documents goes down
all trees at once, one gather per level.

Defined results: a null or empty text has no content, so its score is 0 and
it is rejected; repeated rows are scored each; further columns pass through.
Without labels of both classes nothing can be learned: every non-empty text
then scores 1 and stays.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quadloom.llm import textnp as tx
from quadloom.llm.common import filter_text, labelled_sample, map_text

#: Name of each statistic, and how the score may move with it: 1 never down, -1 never up, 0 free.
STATISTICS = {
    "log_chars": 0, "words": 0, "mean_word": 0, "letters": 1, "upper": -1, "digits": 0, "symbols": -1, "spaces": 0,
    "symbol_words": -1, "symbol_ends": -1, "short_words": 0, "distinct_words": 1, "distinct_pairs": 1, "repeats_next": -1, "top_word": -1,
    "lines": 0, "mean_line": 0, "distinct_lines": 1, "bars": -1, "exclamations": -1, "stops": 0,
}
MONOTONE = np.array(list(STATISTICS.values()))
#: Labelled documents of either class that training reads at most.
SAMPLE_PER_CLASS = 3000
THRESHOLD = 0.5

_UPPER, _LETTER, _DIGIT, _CONTINUED, _STOP = (np.zeros(256, bool) for _ in range(5))
_UPPER[65:91] = True
_LETTER[65:91] = _LETTER[97:123] = _LETTER[128:] = True
_DIGIT[48:58] = True
_CONTINUED[128:192] = True
_STOP[[33, 46, 63]] = True


def _distinct(doc: np.ndarray, h: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Number of distinct hashes of each document, and how often its most frequent one occurs."""
    if not len(h):
        return np.zeros(n), np.zeros(n)
    key = np.sort(doc.astype(np.uint64) << np.uint64(44) | h >> np.uint64(20))
    start = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    times, owner = np.diff(np.append(start, len(key))), (key[start] >> np.uint64(44)).astype(np.int64)
    most = np.zeros(n)
    np.maximum.at(most, owner, times)
    return np.bincount(owner, minlength=n).astype(float), most


def statistics(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One row of STATISTICS for each text of a slice."""
    n = len(offsets) - 1
    count = lambda mask: tx.ragged_sum(mask, offsets, np.int64).astype(float)
    chars = count(~_CONTINUED[data])
    some = np.maximum(chars, 1)
    letter, space = _LETTER[data], tx.SPACE[data]
    letters, spaces, digits = count(letter & ~_CONTINUED[data]), count(space), count(_DIGIT[data])
    symbol = ~(letter | space | _DIGIT[data])
    starts, ends = tx.runs(~space, offsets)
    by = tx.per_document(starts, offsets)
    doc = np.repeat(np.arange(n), np.diff(by))
    words = np.diff(by).astype(float)
    each = np.maximum(words, 1)
    lengths = ends - starts
    per = lambda v: np.bincount(doc, weights=v, minlength=n)
    lettered = np.zeros(len(data) + 1, np.int64)
    np.cumsum(letter, out=lettered[1:])
    h = tx.span_hashes(data, starts, ends)
    same_doc = doc[1:] == doc[:-1]
    repeat = np.bincount(doc[1:][same_doc & (h[1:] == h[:-1])], minlength=n)
    distinct, most = _distinct(doc, h, n)
    pairs = tx.mix((h[:-1] * tx.BASE + h[1:])[same_doc]) if len(h) > 1 else h[:0]
    n_pairs, _ = _distinct(doc[1:][same_doc], pairs, n)
    line_starts, line_ends = tx.runs(data != 10, offsets)
    line_by = tx.per_document(line_starts, offsets)
    lines = np.diff(line_by).astype(float)
    n_lines, _ = _distinct(np.repeat(np.arange(n), np.diff(line_by)), tx.span_hashes(data, line_starts, line_ends), n)
    return np.column_stack(
        [
            np.log1p(chars), words, per(lengths) / each, letters / some, count(_UPPER[data]) / np.maximum(letters, 1), digits / some, count(symbol) / some, spaces / some,
            per(lettered[ends] == lettered[starts]) / each, per(symbol[ends - 1] & ~_STOP[data[ends - 1]] & (data[ends - 1] != 44)) / each, per(lengths <= 3) / each,
            np.where(words > 0, distinct / each, 1), np.where(words > 1, n_pairs / np.maximum(words - 1, 1), 1), repeat / np.maximum(words - 1, 1), most / each * (words > 20),
            lines, chars / np.maximum(lines, 1), np.where(lines > 0, n_lines / np.maximum(lines, 1), 1), count(data == 124) / each, count(data == 33) / each, count(_STOP[data]) / each,
        ]
    )


@dataclass
class Forest:
    """All trees in one set of node arrays; a leaf points to itself."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    depth: int
    base: float

    def margin(self, x: np.ndarray) -> np.ndarray:
        at = np.broadcast_to(self.roots, (len(x), len(self.roots))).copy()
        row = np.arange(len(x))[:, None]
        for _ in range(self.depth):
            at = np.where(x[row, self.feature[at]] <= self.threshold[at], self.left[at], self.right[at])
        return self.base + self.value[at].sum(axis=1)

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.margin(x)))


def train(x: np.ndarray, y: np.ndarray, monotone: np.ndarray, trees: int = 80, depth: int = 3, rate: float = 0.2, bins: int = 64, penalty: float = 1.0, least: float = 8.0) -> Forest:
    """Newton boosting of the logistic loss on binned features.

    A split has to keep the order of its two values that its feature's
    constraint asks for, and bounds both subtrees by the middle between them,
    so the whole forest is monotone, not only each split.
    """
    n, m = x.shape
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(m)]
    code = np.column_stack([np.searchsorted(edges[f], x[:, f], side="left") for f in range(m)])
    base = float(np.log((y.sum() + 1) / (n - y.sum() + 1)))
    margin = np.full(n, base)
    nodes: list[list[float]] = []  # feature, threshold, left, right, value
    roots = []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        g, h = p - y, p * (1 - p)
        weight = lambda gs, hs, lo, hi: np.clip(-gs / (hs + penalty), lo, hi)
        gain = lambda gs, hs, w: -(gs * w + 0.5 * (hs + penalty) * w * w)
        roots.append(len(nodes))
        nodes.append([0, np.inf, len(nodes), len(nodes), 0.0])
        todo = [(roots[-1], np.arange(n), -np.inf, np.inf, 0)]
        while todo:
            node, rows, lo, hi, level = todo.pop()
            gs, hs = g[rows].sum(), h[rows].sum()
            w = float(weight(gs, hs, lo, hi))
            nodes[node][4] = w
            best = (1e-6, -1, 0, 0.0, 0.0)
            if level < depth and hs > 2 * 1e-3 and len(rows) >= 2 * least:
                for f in range(m):
                    k = len(edges[f])
                    if not k:
                        continue
                    c = code[rows, f]
                    gl, hl, nl = (np.cumsum(np.bincount(c, weights=v, minlength=k + 1))[:k] for v in (g[rows], h[rows], np.ones(len(rows))))
                    wl, wr = weight(gl, hl, lo, hi), weight(gs - gl, hs - hl, lo, hi)
                    won = gain(gl, hl, wl) + gain(gs - gl, hs - hl, wr) - gain(gs, hs, w)
                    won[(nl < least) | (len(rows) - nl < least) | (monotone[f] * (wr - wl) < 0)] = -np.inf
                    b = int(won.argmax())
                    if won[b] > best[0]:
                        best = (float(won[b]), f, b, float(wl[b]), float(wr[b]))
            if best[1] < 0:
                margin[rows] += rate * w
                nodes[node][4] = rate * w
                continue
            _, f, b, wl, wr = best
            goes = code[rows, f] <= b
            left, right = len(nodes), len(nodes) + 1
            nodes[node][:4] = [f, edges[f][b], left, right]
            nodes += [[0, np.inf, left, left, 0.0], [0, np.inf, right, right, 0.0]]
            middle = (wl + wr) / 2
            bounds = {0: ((lo, hi), (lo, hi)), 1: ((lo, middle), (middle, hi)), -1: ((middle, hi), (lo, middle))}[int(monotone[f])]
            todo += [(left, rows[goes], *bounds[0], level + 1), (right, rows[~goes], *bounds[1], level + 1)]
    a = np.array(nodes, float)
    return Forest(a[:, 0].astype(np.int32), a[:, 1], a[:, 2].astype(np.int32), a[:, 3].astype(np.int32), a[:, 4], np.array(roots, np.int32), depth, base)


def fit(docs: DataFrame, labels: DataFrame, per_class: int = SAMPLE_PER_CLASS, id_col: str = "doc_id", text_col: str = "text", label: str = "quality") -> Forest | None:
    """A forest from at most ``per_class`` labelled documents of either class; statistics are computed where the texts are."""
    sample = labelled_sample(docs, labels, label, per_class, id_col, text_col).select("_id", "_label", "_text")
    schema = T.StructType([T.StructField("_id", sample.schema["_id"].dataType), T.StructField("_label", T.IntegerType()), T.StructField("_x", T.ArrayType(T.DoubleType()))])

    def run(rows, data, offsets):
        x = statistics(data, offsets)
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), pa.array(x.ravel()))
        return pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), lists], names=schema.names)

    got = map_text(sample, "_text", run, schema).toPandas()
    if got["_label"].nunique() < 2:
        return None
    x = np.array(got["_x"].tolist(), float)
    y = got["_label"].to_numpy(float)
    order = np.lexsort([*x.T, y])  # the same forest in whatever order the rows arrive
    return train(x[order], y[order], MONOTONE)


def _scorer(docs: DataFrame, forest: Forest | None):
    shared = docs.sparkSession.sparkContext.broadcast(forest)

    def score(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        filled = np.diff(offsets) > 0
        if shared.value is None:
            return filled.astype(float)
        return np.where(filled, shared.value.score(statistics(data, offsets)), 0.0)

    return score


def score(docs: DataFrame, forest: Forest | None, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, quality_score, keep) of every row, without a shuffle."""
    source = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text"))
    schema = T.StructType([T.StructField(id_col, source.schema["_id"].dataType), T.StructField("quality_score", T.DoubleType()), T.StructField("keep", T.BooleanType())])
    scorer = _scorer(docs, forest)

    def run(rows, data, offsets):
        s = scorer(data, offsets)
        return pa.RecordBatch.from_arrays([rows.column(0), pa.array(s), pa.array(s >= threshold)], names=schema.names)

    return map_text(source, "_text", run, schema)


def keep(docs: DataFrame, forest: Forest | None, threshold: float = THRESHOLD, text_col: str = "text") -> DataFrame:
    """The rows that aren't rejected, with all their columns, without a shuffle."""
    scorer = _scorer(docs, forest)
    return filter_text(docs, text_col, lambda data, offsets: scorer(data, offsets) >= threshold)
