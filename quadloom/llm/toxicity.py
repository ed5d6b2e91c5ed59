"""Subsequence string-kernel SVM with Nyström landmarks.

Two strings are similar as far as they share subsequences of ``ORDER``
letters, each occurrence weighted ``DECAY`` per skipped character and no
longer than ``SPAN``; an insult with characters inserted or replaced still
shares many. A support vector machine is trained on labelled sentences in the
Nyström space of landmark strings. Its decision is linear in the kernel, so
all landmarks fold into one weight per subsequence: a text is scored exactly
by ``C(SPAN - 1, ORDER - 1)`` table look-ups a character, whatever their number.

Texts are cut into sentences, for training and for scoring, and no window
crosses the end of one. A sentence counts by its worst window of ``WINDOW``
characters and a document by its worst sentence. Labels are of documents: which
sentence of a toxic one carries the label is learned as multiple instances (the
window that scores highest stands for its sentence; the witnesses of a toxic
document are its worst sentence and all that score half as much, chosen anew each
round). Of a clean document the worst sentence, all others on the wrong side of
the border and one window anywhere are negatives. No number of them is capped.
White space is a character like others, so that where a word begins and ends
counts too.

Text is folded first: case, accents, digits that stand for letters,
punctuation inside words, and spaces that set single letters apart.

Defined results: a null or empty text scores ``-inf`` mapped to -1e9 and isn't
toxic; repeated rows score alike; further columns pass through. Without labels
of both classes nothing is toxic.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quadloom.llm import textnp as tx
from quadloom.llm.common import filter_text, labelled_sample, map_text

ORDER, SPAN, DECAY, WINDOW = 4, 7, 0.7, 8
BEHIND = WINDOW + SPAN
LANDMARKS, COST = 256, 8.0
#: Labelled documents of either class that training reads at most.
SAMPLE_PER_CLASS = 1500
NOTHING = -1e9

#: 1..26 letters, 27 a Latin letter without base letter, 28 white space, 0 what is dropped. Of other letters the last byte tells, folded to 1..26.
_CODE = np.zeros(256, np.uint8)
_CODE[97:123] = np.arange(1, 27)
_CODE[[9, 10, 11, 12, 13, 32]] = 28
for _digit, _letter in zip("013457", "oieast"):
    _CODE[ord(_digit)] = ord(_letter) - 96
_LAST = np.zeros(256, np.uint8)
_LAST[0x80:0xC0] = 1 + np.arange(64) % 26
#: Continuation of C3, the Latin-1 letters, to base letters.
_LATIN = np.zeros(256, np.uint8)
for _base, _bytes in {"a": range(0xA0, 0xA7), "c": [0xA7], "e": range(0xA8, 0xAC), "i": range(0xAC, 0xB0), "n": [0xB1], "o": [*range(0xB2, 0xB7), 0xB8], "u": range(0xB9, 0xBD), "y": [0xBD, 0xBF]}.items():
    _LATIN[list(_bytes)] = ord(_base) - 96
_LATIN[[0x9F, 0xB0, 0xBE]] = 27
_END, _SPACE = np.zeros(256, bool), np.zeros(256, bool)
_END[[10, 33, 46, 63]] = True
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def sentences(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte offsets of all sentences, and offsets into them by text; an empty text has none.

    A line break, and a full stop, exclamation or question mark before white space, ends a
    sentence, unless a single letter is before it, as in initials and in words set letter by letter.
    """
    n = len(data)
    at = np.flatnonzero(_END[data])
    at = at[at + 1 < n]
    at = at[(data[at] == 10) | _SPACE[data[at + 1]]]
    apart = _SPACE | _END
    lone = ~apart[data[np.maximum(at - 1, 0)]] & ((at < 2) | apart[data[np.maximum(at - 2, 0)]])
    bounds = np.unique(np.concatenate([offsets, at[~lone] + 1]))
    return bounds, np.searchsorted(bounds, offsets)


def fold(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes of the characters that count, and their offsets by text (or sentence, as ``offsets`` go).

    Every text gets one white space on either side and zeros, of no weight, up to ``BEHIND``,
    so that no window reaches into the next one.
    """
    low = tx.lower(data)
    code = _CODE[low]
    if len(low) > 1:
        after = np.flatnonzero(low[:-1] == 0xC3) + 1
        code[after] = _LATIN[low[after]]
        for lead, last, size in ((0xC4, 0xE0, 1), (0xE0, 0xF0, 2), (0xF0, 0xF5, 3)):
            after = np.flatnonzero((low[: max(0, len(low) - size)] >= lead) & (low[: max(0, len(low) - size)] < last)) + size
            code[after] = _LAST[low[after]]
    n = len(offsets) - 1
    at = np.flatnonzero(code)
    by = tx.per_document(at, offsets)
    pads = 1 + BEHIND
    to = by + np.arange(n + 1) * pads
    out = np.zeros(to[-1], np.uint8)
    out[to[:-1]] = out[to[1:] - BEHIND] = 28
    out[np.arange(len(at)) + np.repeat(np.arange(n) * pads + 1, np.diff(by))] = code[at]
    space = out == 28
    if len(out) > 4:
        lone = np.zeros(len(out), bool)  # a space with single letters on both sides
        lone[2:-2] = space[2:-2] & space[:-4] & space[4:] & ~space[1:-3] & ~space[3:-1]
        double = space.copy()  # of a run of spaces one is enough
        double[1:] &= space[:-1]
        double[0] = False
        drop = lone | double
        for k in range(BEHIND):  # the padding stays
            drop[to[1:] - 1 - k] = False
        drop[to[:-1]] = False
        keep = ~drop
        before = np.zeros(len(out) + 1, np.int64)
        np.cumsum(keep, out=before[1:])
        return out[keep], before[to]
    return out, to


def _offsets_within() -> list[tuple[int, ...]]:
    return [(0, *rest) for rest in combinations(range(1, SPAN), ORDER - 1)]


def subsequences(codes: np.ndarray) -> list[tuple[np.ndarray, float]]:
    """For each shape of subsequence its code at every start, and its weight; the last ``SPAN - 1`` starts are left out."""
    n = max(0, len(codes) - SPAN + 1)
    wide = codes.astype(np.int32)
    return [
        (sum(wide[o : o + n] << (5 * (ORDER - 1 - k)) for k, o in enumerate(shape)), DECAY ** (shape[-1] - ORDER + 1))
        for shape in _offsets_within()
    ]


@dataclass
class Model:
    beta: np.ndarray  # weight of each subsequence
    bias: float
    threshold: float

    def starts(self, codes: np.ndarray) -> np.ndarray:
        """Weight of the subsequences that start at each character."""
        n = len(codes) - SPAN + 1
        if n <= 0:
            return np.zeros(0, np.float32)
        wide = codes.astype(np.int32)
        first = wide[:n] << 15
        out = np.zeros(n, np.float32)
        for b in range(1, SPAN - 2):
            two = first | wide[b : b + n] << 10
            for c in range(b + 1, SPAN - 1):
                three = two | wide[c : c + n] << 5
                for d in range(c + 1, SPAN):
                    part = self.beta[three | wide[d : d + n]]
                    part *= np.float32(DECAY ** (d - ORDER + 1))
                    out += part
        return out

    def windows(self, codes: np.ndarray, to: np.ndarray) -> np.ndarray:
        """Decision value of the window that begins at each character of the sentences; ``NOTHING`` in their padding."""
        s = self.starts(codes)
        total = np.concatenate([[0.0], np.cumsum(s, dtype=np.float64), np.zeros(WINDOW)])
        total[len(s) + 1 :] = total[len(s)]
        w = np.full(len(codes), NOTHING, np.float32)
        w[: len(s)] = total[WINDOW : WINDOW + len(s)] - total[: len(s)] + self.bias
        w[(to[1:, None] - 1 - np.arange(BEHIND)).ravel()] = NOTHING
        return w

    def worst(self, codes: np.ndarray, to: np.ndarray, by: np.ndarray) -> np.ndarray:
        """Decision value of each text's worst sentence, which is that of its worst window."""
        each = tx.ragged_reduce(np.maximum, self.windows(codes, to), to, np.float32(NOTHING))
        return tx.ragged_reduce(np.maximum, each, by, np.float32(NOTHING)).astype(float)

    def score(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        if not len(data):
            return np.full(len(offsets) - 1, NOTHING)
        bounds, by = sentences(data, offsets)
        return self.worst(*fold(data, bounds), by)


def _rows(strings: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sparse feature rows of strings: row, subsequence, weight."""
    padded = [np.concatenate([s, np.zeros(SPAN - 1, np.uint8)]) for s in strings]
    codes = np.concatenate(padded)
    owner = np.repeat(np.arange(len(strings)), [len(p) for p in padded])[: len(codes) - SPAN + 1]
    # a shape that reaches into the padding holds a zero and doesn't count
    row, col, val = [], [], []
    for code, weight in subsequences(codes):
        ok = np.ones(len(code), bool)
        for k in range(ORDER):
            letter = code >> (5 * k) & 31
            ok &= letter > 0
        row.append(owner[ok])
        col.append(code[ok])
        val.append(np.full(int(ok.sum()), weight))
    return np.concatenate(row), np.concatenate(col), np.concatenate(val)


def _dense(strings: list[np.ndarray], columns: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    row, col, val = _rows(strings)
    at = np.searchsorted(columns, col)
    hit = (at < len(columns)) & (columns[np.minimum(at, len(columns) - 1)] == col)
    order = np.argsort(row[hit], kind="stable")
    return row[hit][order], at[hit][order], val[hit][order]


def _kernel(strings: list[np.ndarray], columns: np.ndarray, z: np.ndarray) -> np.ndarray:
    """Kernel values of strings against landmarks whose features are the columns of ``z``."""
    z = z.astype(np.float32)
    out = np.zeros((len(strings), z.shape[1]), np.float32)
    for at in range(0, len(strings), 100):
        row, col, val = _dense(strings[at : at + 100], columns)
        if len(row):
            part = z[col] * val[:, None].astype(np.float32)
            begin = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]]))
            out[at + row[begin]] = np.add.reduceat(part, begin, axis=0)
    return out


def _svm(x: np.ndarray, y: np.ndarray, cost: float) -> np.ndarray:
    """Linear machine of squared hinge loss by Newton steps on the rows within the margin; the last weight is the bias."""
    x, y = np.column_stack([x, np.ones(len(x))]).astype(np.float32), y.astype(np.float32)
    w = np.zeros(x.shape[1])
    ridge = np.eye(x.shape[1])
    ridge[-1, -1] = 1e-6
    share = (np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum())) * len(y) * cost).astype(np.float32)
    inside = np.ones(len(x), bool)
    for _ in range(12):
        a = x[inside] * share[inside][:, None]
        w = np.linalg.solve(ridge + a.T @ x[inside], a.T @ y[inside])
        now = y * (x @ w) < 1
        if (now == inside).all():
            break
        inside = now
    return w


def _strings(codes: np.ndarray, at: np.ndarray) -> list[np.ndarray]:
    return [codes[i : i + WINDOW + SPAN - 1] for i in at]


def _gapped(strings: list[np.ndarray]) -> list[np.ndarray]:
    """Each string again, with one letter inserted among its second to fifth."""
    draw = np.random.default_rng(0)
    where, what = draw.integers(2, 5, len(strings)), draw.integers(1, 27, len(strings))
    return [np.concatenate([s[:i], [c], s[i:-1]]).astype(np.uint8) for s, i, c in zip(strings, where, what)]


def train(texts: list[str], toxic: np.ndarray, rounds: int = 3, landmarks: int = LANDMARKS, cost: float = COST, floor: float = 0.0) -> Model | None:
    """A model from labelled documents; three of four of either class train, the fourth sets the threshold.

    ``floor``: sentences of clean documents that score more are negatives, besides the worst one of each document.
    """
    toxic = np.asarray(toxic, bool)
    if not toxic.any() or toxic.all():
        return None
    held = np.zeros(len(texts), bool)
    for some in (np.flatnonzero(toxic), np.flatnonzero(~toxic)):
        held[some[3::4]] = True
    # a few hundred documents at a time, so that the driver never holds arrays of the length of the whole sample
    chunks = []
    for some in np.array_split(np.arange(len(texts)), len(texts) // 200 + 1):
        raw = [texts[i].encode("utf-8", "replace") for i in some]
        data = np.frombuffer(b"".join(raw), np.uint8)
        bounds, by = sentences(data, tx.counts_to_offsets(np.array([len(r) for r in raw])))
        chunks.append((some, *fold(data, bounds), by))
    model = Model(_first_guess(chunks, toxic, held), 0.0, 0.5)
    negatives: set[bytes] = set()
    for trained in range(rounds):  # the first guess knows weights but no border
        pos: list[np.ndarray] = []
        for some, codes, to, by in chunks:
            value = model.windows(codes, to)
            peak = np.array([a + int(value[a:b].argmax()) for a, b in zip(to, to[1:])])
            for k, d in enumerate(some):
                a, b = to[by[k]], to[by[k + 1]]
                if held[d] or b <= a:
                    continue
                # a sentence stands by its worst window
                best = peak[by[k] : by[k + 1]]
                first = best[value[best].argmax()]
                if toxic[d]:
                    at = best[(value[best] > 0) & (value[best] >= 0.5 * value[first])]
                else:
                    at = best[(value[best] > (floor if trained else np.inf)) | (best == first)]
                if toxic[d]:
                    pos += _strings(codes, at)
                else:
                    negatives |= {x.tobytes() for x in _strings(codes, [*at, a + (int(d) * 7919) % (b - a - BEHIND)])}
        if not pos:
            return None
        pos += _gapped(pos)
        model = _fit(pos, [np.frombuffer(x, np.uint8) for x in sorted(negatives)], landmarks, cost)
    value = np.concatenate([model.worst(codes, to, by) for _, codes, to, by in chunks])
    model.threshold = _threshold(value[held], toxic[held])
    return model


def _first_guess(chunks, toxic: np.ndarray, held: np.ndarray) -> np.ndarray:
    """Weights of runs of four letters by how much more often toxic documents have them."""
    size = 1 << (5 * ORDER)
    tox, clean = np.zeros(size), np.zeros(size)
    for some, codes, to, by in chunks:
        wide = codes.astype(np.int32)
        n = max(0, len(wide) - ORDER + 1)
        plain, letters = np.zeros(n, np.int64), np.ones(n, bool)
        for k in range(ORDER):
            plain = plain << 5 | wide[k : k + n]
            letters &= (wide[k : k + n] > 0) & (wide[k : k + n] < 28)
        doc = np.repeat(some, np.diff(to[by]))[:n]
        letters &= ~held[doc]
        pair = np.unique(doc[letters] << 20 | plain[letters])
        of_toxic = toxic[pair >> 20]
        tox += np.bincount(pair[of_toxic] & (size - 1), minlength=size)
        clean += np.bincount(pair[~of_toxic] & (size - 1), minlength=size)
    n_tox, n_clean = (toxic & ~held).sum(), (~toxic & ~held).sum()
    odds = np.log((tox + 0.5) / (n_tox + 1)) - np.log((clean + 0.5) / (n_clean + 1))
    odds[(tox < max(3, 0.003 * n_tox)) | (odds < 1.5)] = 0
    return odds.astype(np.float32)


def _fit(pos: list[np.ndarray], neg: list[np.ndarray], landmarks: int, cost: float) -> Model:
    # landmarks: witnesses that share least with those already taken, two of three, and the hardest negatives
    row, col, val = _rows(pos)
    columns, inverse = np.unique(col, return_inverse=True)
    common = np.bincount(inverse)
    weight = np.bincount(row, weights=common[inverse] * val, minlength=len(pos))
    chosen, covered = [], np.zeros(len(columns))
    by_row = np.argsort(row, kind="stable")
    begin = np.searchsorted(row[by_row], np.arange(len(pos) + 1))
    for i in np.argsort(-weight, kind="stable"):
        mine = inverse[by_row[begin[i] : begin[i + 1]]]
        if len(mine) and (common[mine] * (covered[mine] < 3)).sum() > 0.3 * common[mine].sum():
            chosen.append(pos[i])
            covered[mine] += 1
            if len(chosen) >= landmarks * 2 // 3:
                break
    step = max(1, len(neg) // max(1, landmarks - len(chosen)))
    marks = chosen + neg[::step][: landmarks - len(chosen)]
    row, col, val = _rows(marks)
    columns, inverse = np.unique(col, return_inverse=True)
    z = np.zeros((len(columns), len(marks)))
    np.add.at(z, (inverse, row), val)
    z /= np.maximum(np.sqrt((z * z).sum(axis=0)), 1e-12)
    k = z.T @ z
    values, vectors = np.linalg.eigh(k)
    good = values > 1e-6 * values.max()
    whiten = vectors[:, good] / np.sqrt(values[good])
    x = np.vstack([_kernel(pos, columns, z), _kernel(neg, columns, z)]) @ whiten.astype(np.float32)
    w = _svm(x, np.concatenate([np.ones(len(pos)), -np.ones(len(neg))]), cost)
    beta = np.zeros(1 << (5 * ORDER), np.float32)
    beta[columns] = z @ (whiten @ w[:-1])
    return Model(beta, float(w[-1]), 0.0)


def _threshold(score: np.ndarray, toxic: np.ndarray) -> float:
    """Middle of the gap that errs least on held-out documents, a clean one counted five times."""
    if not len(score) or not toxic.any() or toxic.all():
        return 0.0
    order = np.argsort(score)
    s, t = score[order], toxic[order]
    missed = np.concatenate([[0], np.cumsum(t)])
    blamed = np.concatenate([[(~t).sum()], (~t).sum() - np.cumsum(~t)])
    cost = missed + 5 * blamed
    least = np.flatnonzero(cost == cost.min())
    k = int(least[len(least) // 2])
    below = s[k - 1] if k else s[0] - 1
    above = s[k] if k < len(s) else s[-1] + 1
    return float((below + above) / 2)


def fit(docs: DataFrame, labels: DataFrame, per_class: int = SAMPLE_PER_CLASS, id_col: str = "doc_id", text_col: str = "text", label: str = "toxic") -> Model | None:
    """A model from at most ``per_class`` labelled documents of either class."""
    got = labelled_sample(docs, labels, label, per_class, id_col, text_col).select("_id", "_label", "_text").toPandas()
    got = got.drop_duplicates("_id").sort_values("_id")
    return train(got["_text"].tolist(), got["_label"].to_numpy() == 1)


def _shared(docs: DataFrame, model: Model | None):
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def score(data, offsets):
        return np.full(len(offsets) - 1, NOTHING) if shared.value is None else shared.value.score(data, offsets)

    return score, (0.0 if model is None else model.threshold)


def score(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, toxicity, toxic) of every row, without a shuffle."""
    source = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text"))
    schema = T.StructType([T.StructField(id_col, source.schema["_id"].dataType), T.StructField("toxicity", T.DoubleType()), T.StructField("toxic", T.BooleanType())])
    scorer, threshold = _shared(docs, model)

    def run(rows, data, offsets):
        s = scorer(data, offsets)
        return pa.RecordBatch.from_arrays([rows.column(0), pa.array(s), pa.array(s > threshold)], names=schema.names)

    return map_text(source, "_text", run, schema)


def keep(docs: DataFrame, model: Model | None, text_col: str = "text") -> DataFrame:
    """The rows that aren't toxic, with all their columns, without a shuffle."""
    scorer, threshold = _shared(docs, model)
    return filter_text(docs, text_col, lambda data, offsets: scorer(data, offsets) <= threshold)
