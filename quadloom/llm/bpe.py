"""Byte-level BPE on padded numpy matrices.

Distinct pre-tokens of a slice are bucketed by length and laid out as rows of
a padded matrix of token ids. In each round every unfinished row merges its
leftmost pair of minimum rank at once; ranks come from a hash table of pairs
and rows are compacted in place. A worker keeps the pieces it has already
encoded, up to ``CACHE`` of them, so a frequent piece is encoded once.

Defined results: a null text has null tokens and 0 as their number, an empty
text an empty list; repeated rows are encoded each; further columns, whatever
their names, don't reach the encoder. A piece beyond ``LONG`` bytes, such as
a text without any space, goes through a heap instead of the quadratic matrix,
with the same result.
"""

from __future__ import annotations

import base64
import heapq
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quadloom.llm import textnp as tx
from quadloom.llm.common import map_text

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Contractions, words, numbers and other runs, each with one leading space; spaces before a word stay apart from it.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
NONE = np.int32(2**31 - 1)
LONG = 2048
CACHE = 400_000


class Tables:
    """A vocabulary as arrays: bytes by token, and token by pair in an open-addressing hash table."""

    def __init__(self, tokens: list[bytes]):
        """``tokens[rank]`` is a token's bytes; every single byte has to be among them."""
        rank = {t: i for i, t in enumerate(tokens)}
        self.byte_id = np.array([rank[bytes([b])] for b in range(256)], np.int32)
        self.blob = np.frombuffer(b"".join(tokens), np.uint8)
        self.offsets = tx.counts_to_offsets(np.array([len(t) for t in tokens]))
        pairs: dict[int, int] = {}
        for i, t in enumerate(tokens):
            for k in range(1, len(t)):
                a, b = rank.get(t[:k]), rank.get(t[k:])
                if a is not None and b is not None:
                    pairs[a << 32 | b] = i
        self._merges: dict[int, int] | None = None  # made where a long piece needs it
        self.bits = max(10, len(pairs).bit_length() + 2)
        self.keys = np.full(1 << self.bits, -1, np.int64)
        self.values = np.full(1 << self.bits, NONE, np.int32)
        keys, values = np.array(list(pairs), np.int64), np.array(list(pairs.values()), np.int32)
        at, self.probes = self._slot(keys), 0
        while len(keys):  # all keys try their slot; of those that meet at one, one stays and the others go on
            self.probes += 1
            free = np.flatnonzero(self.keys[at] == -1)
            self.keys[at[free]] = keys[free]
            self.values[at[free]] = values[free]
            # where several keys were written to one slot, the last one is in it
            lost = self.keys[at] != keys
            won = ~lost
            self.values[at[won]] = values[won]
            keys, values, at = keys[lost], values[lost], (at[lost] + 1) & ((1 << self.bits) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            h = keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return (h >> np.uint64(64 - self.bits)).astype(np.int64)

    def rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The token that each pair merges into, which is its rank; NONE where there is none or an id is -1."""
        keys = a.astype(np.int64) << 32 | b.astype(np.int64)
        at = self._slot(keys)
        found = self.keys[at]
        out = np.where(found == keys, self.values[at], NONE)
        open_ = np.flatnonzero((found != keys) & (found != -1))
        for _ in range(1, self.probes):
            if not len(open_):
                break
            at[open_] = (at[open_] + 1) & ((1 << self.bits) - 1)
            found = self.keys[at[open_]]
            hit = found == keys[open_]
            out[open_[hit]] = self.values[at[open_[hit]]]
            open_ = open_[~hit & (found != -1)]
        out[(a < 0) | (b < 0)] = NONE
        return out

    def encode(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Token ids of all words one after the other, and the offsets by word."""
        lengths = np.array([len(w) for w in words], np.int64)
        out: list = [None] * len(words)
        counts = np.zeros(len(words), np.int64)
        bucket = np.where(lengths <= 4, 4, 1 << np.ceil(np.log2(np.maximum(lengths, 1))).astype(np.int64))
        parts_at, parts = [], []
        for width in np.unique(bucket):
            rows = np.flatnonzero(bucket == width)
            if width > LONG:
                for r in rows:
                    out[r] = self._encode_long(words[r])
                    counts[r] = len(out[r])
                    parts_at.append(np.array([r]))
                    parts.append((np.array([0]), out[r]))
                continue
            for at in range(0, len(rows), max(1, (1 << 20) // int(width))):
                some = rows[at : at + max(1, (1 << 20) // int(width))]
                matrix, n = self._merge([words[r] for r in some], lengths[some], int(width))
                counts[some] = n
                parts_at.append(some)
                parts.append((np.arange(width) < n[:, None], matrix))
        offsets = tx.counts_to_offsets(counts)
        flat = np.empty(offsets[-1], np.int32)
        for some, (mask, ids) in zip(parts_at, parts):
            flat[tx.ragged_index(offsets[some], counts[some])] = ids if mask.ndim == 1 else ids[mask]
        return flat, offsets

    def _merge(self, words: list[bytes], lengths: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        full = np.full((len(words), width), -1, np.int32)
        full[np.arange(width) < lengths[:, None]] = self.byte_id[np.frombuffer(b"".join(words), np.uint8)]
        count = lengths.copy()
        active = np.flatnonzero(count > 1)
        ids = full[active]
        ranks = np.full((len(active), width), NONE, np.int32)
        ranks[:, :-1] = self.rank(ids[:, :-1].ravel(), ids[:, 1:].ravel()).reshape(len(active), width - 1)
        column = np.arange(width)
        while len(active):
            at = ranks.argmin(axis=1)  # the leftmost of the least
            row = np.arange(len(active))
            merged = ranks[row, at]
            going = merged != NONE
            if not going.all():
                done = ~going
                full[active[done]] = ids[done]
                active, ids, ranks, at, merged = active[going], ids[going], ranks[going], at[going], merged[going]
                if not len(active):
                    break
                row = np.arange(len(active))
            ids[row, at] = merged
            source = np.minimum(column + (column > at[:, None]), width - 1)  # close the gap behind the merged pair
            ids = np.take_along_axis(ids, source, 1)
            ids[:, -1] = -1
            ranks = np.take_along_axis(ranks, source, 1)
            ranks[:, -1] = NONE
            count[active] -= 1
            right = np.minimum(at + 1, width - 1)
            ranks[row, at] = self.rank(ids[row, at], np.where(at + 1 < width, ids[row, right], -1))
            left = np.flatnonzero(at > 0)
            ranks[left, at[left] - 1] = self.rank(ids[left, at[left] - 1], ids[left, at[left]])
        return full, count

    def _encode_long(self, word: bytes) -> np.ndarray:
        ids = self.byte_id[np.frombuffer(word, np.uint8)].tolist()
        n = len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        if self._merges is None:
            used = self.keys >= 0
            self._merges = dict(zip(self.keys[used].tolist(), self.values[used].tolist()))
        merges, pop, push = self._merges.get, heapq.heappop, heapq.heappush
        first = self.rank(np.array(ids[:-1]), np.array(ids[1:])).astype(np.int64)
        some = np.flatnonzero(first != NONE)
        # rank above position: the least is the leftmost of the least rank
        heap = (first[some] << 40 | some).tolist()
        heapq.heapify(heap)
        place = (1 << 40) - 1
        while heap:
            top = pop(heap)
            r, i = top >> 40, top & place
            j = after[i]
            if ids[i] < 0 or j >= n or merges(ids[i] << 32 | ids[j]) != r:
                continue
            ids[i], ids[j] = r, -1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                m = merges(r << 32 | ids[k])
                if m is not None:
                    push(heap, m << 40 | i)
            k = before[i]
            if k >= 0:
                m = merges(ids[k] << 32 | r)
                if m is not None:
                    push(heap, m << 40 | k)
        return np.array([x for x in ids if x >= 0], np.int32)

    def decode(self, ids: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of all texts one after the other, and the offsets by text."""
        starts = self.offsets[ids]
        lengths = self.offsets[ids + 1] - starts
        return self.blob[tx.ragged_index(starts, lengths)], tx.counts_to_offsets(lengths)[offsets]


def read_tokens(path: str) -> list[bytes]:
    """Tokens by rank from a file of lines "base64 rank"."""
    with open(path, "rb") as f:
        pairs = [line.split() for line in f if line.strip()]
    tokens: list[bytes] = [b""] * len(pairs)
    for token, rank in pairs:
        tokens[int(rank)] = base64.b64decode(token)
    return tokens


@lru_cache(maxsize=4)
def tables(path: str) -> Tables:
    return Tables(read_tokens(path))


class _Index(dict):
    """Numbers pieces in the order in which they first appear."""

    def __missing__(self, piece: str) -> int:
        self[piece] = n = len(self)
        return n


class Encoder:
    """Encodes slices of texts; keeps the pieces encoded so far."""

    def __init__(self, t: Tables, pattern: str = PATTERN):
        self.t, self.find = t, regex.compile(pattern).findall
        self.reset()

    def reset(self) -> None:
        self.index, self.ids, self.offsets = _Index(), np.zeros(0, np.int32), np.zeros(1, np.int64)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Token ids of all texts one after the other, and the offsets by text."""
        if len(self.index) > CACHE:
            self.reset()
        known, codes, counts = len(self.index), [], np.zeros(len(texts), np.int64)
        for k, text in enumerate(texts):
            pieces = self.find(text)
            counts[k] = len(pieces)
            codes.append(np.fromiter(map(self.index.__getitem__, pieces), np.int64, len(pieces)))
        if len(self.index) > known:
            fresh = [p.encode("utf-8", "surrogatepass") for p in list(self.index)[known:]]
            ids, offsets = self.t.encode(fresh)
            self.ids = np.concatenate([self.ids, ids])
            self.offsets = np.concatenate([self.offsets, self.offsets[-1] + offsets[1:]])
        code = np.concatenate(codes) if codes else np.zeros(0, np.int64)
        starts = self.offsets[code]
        lengths = self.offsets[code + 1] - starts
        return self.ids[tx.ragged_index(starts, lengths)], tx.counts_to_offsets(lengths)[tx.counts_to_offsets(counts)]


_encoders: dict[str, Encoder] = {}


def _encoder(key: str, shared) -> Encoder:
    if key not in _encoders:
        _encoders[key] = Encoder(shared.value)
    return _encoders[key]


def encode(docs: DataFrame, vocabulary: str = VOCABULARY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, tokens, round_trip): the tokens of every text, and whether decoding them gives the text again.

    One scan, no shuffle; the tables, a few MB whatever the corpus, are broadcast.
    """
    key = f"{vocabulary}"
    shared = docs.sparkSession.sparkContext.broadcast(tables(vocabulary))
    source = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text"))
    schema = T.StructType(
        [
            T.StructField(id_col, docs.schema[id_col].dataType),
            T.StructField("n_tokens", T.LongType()),
            T.StructField("tokens", T.ArrayType(T.IntegerType())),
            T.StructField("round_trip", T.BooleanType()),
        ]
    )

    def run(rows: pa.RecordBatch, data: np.ndarray, offsets: np.ndarray) -> pa.RecordBatch:
        encoder, text = _encoder(key, shared), rows.column(1)
        ids, to = encoder.encode([t or "" for t in text.to_pylist()])
        back, back_to = encoder.t.decode(ids, to)
        if np.array_equal(back, data) and np.array_equal(back_to, offsets):
            same = np.ones(len(text), bool)
        else:
            same = np.array([np.array_equal(back[a:b], data[c:d]) for a, b, c, d in zip(back_to, back_to[1:], offsets, offsets[1:])])
        null = np.asarray(text.is_null())
        lists = pa.ListArray.from_arrays(pa.array(to.astype(np.int32)), pa.array(ids), mask=pa.array(null) if null.any() else None)
        return pa.RecordBatch.from_arrays([rows.column(0), pa.array(np.diff(to)), lists, pa.array(same)], names=[f.name for f in schema])

    return map_text(source, "_text", run, schema)


def decode(tokens: DataFrame, vocabulary: str = VOCABULARY, tokens_col: str = "tokens", text_col: str = "text") -> DataFrame:
    """All columns but ``tokens_col`` and any former ``text_col``, and the decoded text; null tokens give a null text.

    Bytes that aren't UTF-8, as a cut list of tokens may hold, are replaced by U+FFFD.
    """
    key = f"{vocabulary}"
    shared = tokens.sparkSession.sparkContext.broadcast(tables(vocabulary))
    kept = [c for c in tokens.columns if c not in (tokens_col, text_col)]
    source = tokens.select(*[f"`{c}`" for c in kept], F.col(tokens_col).cast("array<int>").alias("_tokens"))
    schema = T.StructType([tokens.schema[c] for c in kept] + [T.StructField(text_col, T.StringType())])

    def run(batches):
        for rows in batches:
            lists = rows.column(rows.num_columns - 1)
            ids = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            counts = np.array(lists.value_lengths().fill_null(0))
            data, to = _encoder(key, shared).t.decode(ids, tx.counts_to_offsets(counts))
            raw, null = data.tobytes(), np.asarray(lists.is_null())
            texts = [None if x else raw[a:b].decode("utf-8", "replace") for a, b, x in zip(to, to[1:], null)]
            yield pa.RecordBatch.from_arrays([*rows.columns[:-1], pa.array(texts, pa.string())], names=schema.names)

    return source.mapInArrow(run, schema)
