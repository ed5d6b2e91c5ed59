"""Context-triggered piecewise hashing.

A rolling hash over seven bytes ends a chunk wherever it is one less than a
multiple of the block size; each chunk gives one of 64 characters. A
fingerprint has the characters for its block size and for twice that, so
documents of adjacent block sizes compare. The block size is the least of
3 * 2^k at which ``LENGTH`` characters cover the text, halved while fewer than
half as many come out.

Two fingerprints are similar if their strings at a common block size share
``RUN`` characters in a row and the edit distance (insertions and deletions)
gives a score of at least ``THRESHOLD``: 100 less the share of the summed
lengths that the distance makes up, in per cent, capped for small blocks as
short texts agree by chance. Equal fingerprints score 100.

Chunk boundaries and hashes are computed for a slice of documents at once by
shifts and one prefix sum. For the search all runs of the distinct fingerprints
are sorted; documents with one fingerprint are one entry. Only the rows of runs
that several have get their strings, and all pairs of a run are scored in its
task, bit-parallel. A pair counts at the first run that it shares, so pairs are
neither listed nor made distinct: tasks return sums and stars. The rows of a run
that many have are handed on in blocks, whose pairs are tasks of their own. The
result has one row for each document, with its class (a connected group of
similar ones) and the number of its links, so copies are never listed with each
other. ``links`` lists the pairs, for tables that have few.

Defined results: a null or empty text has block size 3 and empty strings, and
is similar to none; texts too short for ``RUN`` characters are similar only
where fingerprints are equal and not empty; null ids take no part; repeated
rows of one id are one document (its least fingerprint); ids are of any type
that has an order; further columns are left behind.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quadloom.llm import textnp as tx
from quadloom.llm.cluster import Groups, components
from quadloom.llm.common import Scratch, join_counted, map_text, resting_on

LENGTH, RUN, SMALLEST, THRESHOLD = 64, 7, 3, 60
#: Rows of one block of a key that has many.
BLOCK = 1024
_CHARACTERS = np.frombuffer(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", np.uint8)
_VALUE = np.zeros(256, np.uint8)
_VALUE[_CHARACTERS] = np.arange(64)


def rolling(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """At each byte a hash of the last seven bytes of its document: their sum, their sum weighted by nearness, and a shift-xor."""
    n, window = len(data), 7
    total, weighted, shifted = np.zeros(n, np.uint32), np.zeros(n, np.uint32), np.zeros(n, np.uint32)
    wide = data.astype(np.uint32)
    starts = offsets[:-1][np.diff(offsets) > 0]
    for k in range(window):
        part = np.zeros(n, np.uint32)
        part[k:] = wide[: n - k]
        for i in range(k):  # what lies before a document's beginning is 0
            at = starts + i
            part[at[at < n]] = 0
        total += part
        weighted += np.uint32(window - k) * part
        shifted ^= part << np.uint32(5 * k)
    return total + weighted + shifted


def _strings(hashed: np.ndarray, prefix: np.ndarray, down: np.ndarray, offsets: np.ndarray, block: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Characters of all texts one after the other, and how many each has; the last chunk takes what is left."""
    n = len(offsets) - 1
    b = np.repeat(block.astype(np.uint32), np.diff(offsets))
    cut = np.flatnonzero(hashed % b == b - 1)
    by = tx.per_document(cut, offsets)
    kept = np.minimum(np.diff(by), most - 1)
    ends = cut[tx.ragged_index(by[:-1], kept)] + 1
    owner = np.repeat(np.arange(n), kept)
    rest = np.flatnonzero(np.diff(offsets) > 0)  # every text ends with a chunk, unless a cut is at its very end
    last = np.full(n, -1, np.int64)
    last[owner] = ends
    rest = rest[last[rest] != offsets[1:][rest]]
    ends, owner = np.concatenate([ends, offsets[1:][rest]]), np.concatenate([owner, rest])
    order = np.lexsort((ends, owner))
    ends, owner = ends[order], owner[order]
    starts = np.concatenate([[0], ends[:-1]]) if len(ends) else ends
    first = np.ones(len(ends), bool)
    first[1:] = owner[1:] != owner[:-1]
    starts = np.where(first, offsets[:-1][owner], starts)
    h = (prefix[ends] - prefix[starts]) * down[starts]
    return _CHARACTERS[(tx.mix(h) & np.uint64(63)).astype(np.int64)], np.bincount(owner, minlength=n)


def fingerprints_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """Block sizes, and for the block size and its double the characters and counts."""
    lengths = np.diff(offsets)
    power = np.ceil(np.log2(np.maximum(lengths, 1) / (SMALLEST * LENGTH))).clip(0).astype(np.int64)
    hashed = rolling(data, offsets)
    up, down = tx.powers(len(data) + 1)
    prefix = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=prefix[1:])
    todo = np.flatnonzero(power > 0)
    while len(todo):  # few texts need another look
        at = tx.ragged_index(offsets[todo], lengths[todo])
        b = np.repeat((SMALLEST << power[todo]).astype(np.uint32), lengths[todo])
        chunks = tx.ragged_sum(hashed[at] % b == b - 1, tx.counts_to_offsets(lengths[todo]), np.int64) + 1
        todo = todo[chunks < LENGTH // 2]
        power[todo] -= 1
        todo = todo[power[todo] > 0]
    block = SMALLEST << power
    return block, [_strings(hashed, prefix, down, offsets, block, LENGTH), _strings(hashed, prefix, down, offsets, block * 2, LENGTH // 2)]


def fingerprint(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, block_size, signature, signature_double) of every row, without a shuffle."""
    source = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text"))
    schema = T.StructType([T.StructField(id_col, source.schema["_id"].dataType), T.StructField("block_size", T.LongType()), T.StructField("signature", T.StringType()), T.StructField("signature_double", T.StringType())])

    def run(rows, data, offsets):
        block, parts = fingerprints_of(data, offsets)
        strings = [pa.Array.from_buffers(pa.string(), len(n), [None, pa.py_buffer(tx.counts_to_offsets(n).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(c))]) for c, n in parts]
        return pa.RecordBatch.from_arrays([rows.column(0), pa.array(block), *strings], names=schema.names)

    return map_text(source, "_text", run, schema)


def _reduced(strings: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Characters without the fourth and later of equal ones in a row, which say little, and the offsets."""
    data, offsets = tx.buffers(strings)
    keep = np.ones(len(data), bool)
    if len(data) > 3:
        keep[3:] = (data[3:] != data[2:-1]) | (data[2:-1] != data[1:-2]) | (data[1:-2] != data[:-3])
        for k in range(3):
            at = offsets[:-1] + k
            keep[at[at < offsets[1:]]] = True
    return data[keep], tx.counts_to_offsets(keep)[offsets]


#: Stands for the beginning of a string where a run has no character before it.
START = 64


def _runs(threshold: int):
    def run(batches):
        """(key, id, mark) of every run of RUN characters of each string, with its block size in the key.

        mark: the character before the run, and the string's length above it. A string that is too
        short to score ``threshold`` at its block size has none.
        """
        for rows in batches:
            ids, block = rows.column(0).to_numpy(zero_copy_only=False), rows.column(1).to_numpy(zero_copy_only=False)
            for k, strings in ((0, rows.column(2)), (1, rows.column(3))):
                data, to = _reduced(strings)
                if len(data) < RUN:
                    continue
                value = _VALUE[data].astype(np.int64)
                code = np.zeros(len(data) - RUN + 1, np.int64)
                for i in range(RUN):
                    code = code << 6 | value[i : i + len(code)]
                owner, size = np.repeat(np.arange(len(ids)), np.diff(to)), np.diff(to)
                before = np.full(len(code), START, np.int64)
                before[1:] = np.where(owner[1 : len(code)] == owner[: len(code) - 1], value[: len(code) - 1], START)
                scale = (block << k) // SMALLEST
                good = (owner[: len(code)] == owner[RUN - 1 :]) & (scale * size >= threshold)[owner[: len(code)]]
                owner, code, before = owner[: len(code)][good], code[good], before[good]
                if not len(code):
                    continue
                exponent = np.log2(block[owner] // SMALLEST).round().astype(np.int64) + k
                each = np.unique(np.column_stack([exponent << 42 | code, ids[owner], size[owner] << 7 | before]), axis=0)
                yield pa.RecordBatch.from_arrays([pa.array(each[:, 0]), pa.array(each[:, 1]), pa.array(each[:, 2].astype(np.int16))], names=["_key", "_id", "_mark"])

    return run


def _may(rows: np.ndarray, one: np.ndarray, two: np.ndarray, threshold: int) -> np.ndarray:
    """Whether a pair of rows (id, mark, side) of one key is to be emitted.

    A common passage longer than a run shares many keys, but where the characters before the run are
    equal the run that begins one earlier is shared too: only the leftmost speaks for it. The difference
    of the lengths is part of the edit distance, so lengths too far apart can't score ``threshold``.
    Rows of different blocks of a hot key (sides 1 and 2) are paired across only.
    """
    x, y = rows[one], rows[two]
    la, lb, before, other = x[:, 1] >> 7, y[:, 1] >> 7, x[:, 1] & 127, y[:, 1] & 127
    near = 100 * np.abs(la - lb) <= (100 - threshold) * (la + lb)
    return (x[:, 0] != y[:, 0]) & near & ((before != other) | (before == START)) & ((x[:, 2] == 0) | (x[:, 2] != y[:, 2]))


def _by_key(parts, rows_of_block: int | None):
    """(arrays, block) of lists of arrays that are sorted by the first one, the key, and go on from list to list.

    Whole keys come with block None. Rows of a key that has more than two blocks (None: no key has) come as they
    are read, with the number of the first of their blocks, and none of them is held.
    """
    most = 2 * rows_of_block if rows_of_block else 2**62
    held, hot, block = None, None, 0
    for now in parts:
        if held is not None:
            now = [np.concatenate(x) for x in zip(held, now)]
        if hot is not None and len(now[0]):  # more of a key that was handed on
            n = np.searchsorted(now[0], hot, side="right")
            if n:
                yield [x[:n] for x in now], block
                block += -(-n // rows_of_block)
            now = [x[n:] for x in now]
            hot = None if len(now[0]) else hot
        held, key = now, now[0]
        if not len(key):
            continue
        whole = np.searchsorted(key, key[-1])  # the last key may go on in the next list
        first = np.flatnonzero(np.concatenate([[True], key[1:whole] != key[: whole - 1]])) if whole else np.zeros(0, np.int64)
        size = np.diff(np.append(first, whole))
        few = np.repeat(size <= most, size)
        if few.any():
            yield [x[:whole][few] for x in now], None
        for f, n in zip(first[size > most], size[size > most]):
            yield [x[f : f + n] for x in now], 0
        held = [x[whole:] for x in now]
        if len(held[0]) > most:
            hot, block = held[0][0], -(-len(held[0]) // rows_of_block)
            yield held, 0
            held = [x[:0] for x in held]
    if held is not None and len(held[0]):
        yield held, None


def _pairs(threshold: int):
    """Pairs of ids that share a key, from (key, id, mark, side) sorted by key; equal pairs of a batch once.

    The rows of a key that has more than ``BLOCK`` of them are handed on in numbered blocks instead, as
    (key, id, mark, block), and none of them is held.
    """
    names = ["_a", "_b", "_mark", "_block"]

    def pairs(found: list[np.ndarray]) -> pa.RecordBatch:
        p = np.concatenate(found)
        p = np.unique(np.column_stack([p.min(axis=1), p.max(axis=1)]), axis=0)
        return pa.RecordBatch.from_arrays([pa.array(p[:, 0]), pa.array(p[:, 1]), pa.nulls(len(p), pa.int16()), pa.nulls(len(p), pa.int64())], names=names)

    def emit(key, rows):
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
        size = np.diff(np.append(first, len(key)))
        found = []
        for k in np.unique(size[size > 1]):
            at = first[size == k]
            i, j = np.triu_indices(k, 1)
            for some in np.array_split(at, max(1, min(len(at), len(at) * k * k // 2_000_000))):
                where = some[:, None] + np.arange(k)
                for part in np.array_split(np.arange(len(i)), max(1, len(some) * len(i) // 2_000_000)):
                    one, two = where[:, i[part]].ravel(), where[:, j[part]].ravel()
                    good = _may(rows, one, two, threshold)
                    found.append(np.column_stack([rows[one[good], 0], rows[two[good], 0]]))
                    if sum(map(len, found)) > 4_000_000:
                        yield pairs(found)
                        found = []
        if found:
            yield pairs(found)

    def hand_on(key: int, rows: np.ndarray, block: int):
        numbers = block + np.arange(len(rows)) // BLOCK
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(rows), key)), pa.array(rows[:, 0]), pa.array(rows[:, 1].astype(np.int16)), pa.array(numbers)], names=names)

    def read(batch):
        columns = [batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in range(4)]
        return [columns[0], np.column_stack(columns[1:])]

    def run(batches):
        for (key, rows), block in _by_key(map(read, batches), BLOCK):
            if block is None:
                yield from emit(key, rows)
            else:
                yield hand_on(key[0], rows, block)

    return run


def _pairs_of_blocks(threshold: int):
    """Pairs of ids that share a key, where no key has more rows than two blocks."""

    def run(batches):
        for batch in _pairs(threshold)(batches):
            yield pa.RecordBatch.from_arrays(batch.columns[:2], names=["_a", "_b"])

    return run


def common_length(a: np.ndarray, a_to: np.ndarray, b: np.ndarray, b_to: np.ndarray) -> np.ndarray:
    """Length of the longest common subsequence of each pair of strings of at most 64 characters, all pairs at once."""
    n, la, lb = len(a_to) - 1, np.diff(a_to), np.diff(b_to)
    mask = np.zeros((n, 64), np.uint64)
    row = np.arange(n)
    for i in range(int(la.max(initial=0))):
        some = row[la > i]
        mask[some, _VALUE[a[a_to[some] + i]]] |= np.uint64(1 << i)
    s = np.full(n, 2**64 - 1, np.uint64)
    for j in range(int(lb.max(initial=0))):
        some = row[lb > j]
        u = s[some] & mask[some, _VALUE[b[b_to[some] + j]]]
        s[some] = (s[some] + u) | (s[some] - u)
    whole = np.where(la >= 64, np.uint64(2**64 - 1), (np.uint64(1) << np.minimum(la, 63).astype(np.uint64)) - np.uint64(1))
    return np.bitwise_count(~s & whole).astype(np.int64)


def string_scores(a: pa.Array, b: pa.Array, block: np.ndarray) -> np.ndarray:
    """Scores of pairs of strings at a block size each; 0 for those that share no run."""
    (a, a_to), (b, b_to) = _reduced(a), _reduced(b)
    la, lb = np.diff(a_to), np.diff(b_to)
    score = np.zeros(len(la), np.int64)
    some = np.flatnonzero((la >= RUN) & (lb >= RUN))
    if len(some):
        a, b = a[tx.ragged_index(a_to[some], la[some])], b[tx.ragged_index(b_to[some], lb[some])]
        a_to, b_to = tx.counts_to_offsets(la[some]), tx.counts_to_offsets(lb[some])
        total = la[some] + lb[some]
        distance = total - 2 * common_length(a, a_to, b, b_to)
        got = 100 - (100 * distance + total - 1) // total
        got = np.minimum(got, block[some] // SMALLEST * np.minimum(la[some], lb[some]))
        score[some] = np.where(_share_run(a, a_to, b, b_to), got, 0)
    return score


def _share_run(a, a_to, b, b_to) -> np.ndarray:
    def codes(x, to):
        if len(x) < RUN:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        code = np.zeros(len(x) - RUN + 1, np.int64)
        for i in range(RUN):
            code = code << 6 | _VALUE[x[i : i + len(code)]].astype(np.int64)
        owner = np.repeat(np.arange(len(to) - 1), np.diff(to))
        inside = owner[: len(code)] == owner[RUN - 1 :]
        return owner[: len(code)][inside], code[inside]

    (oa, ca), (ob, cb) = codes(a, a_to), codes(b, b_to)
    key = lambda o, c: (o.astype(np.uint64) << np.uint64(42)) | c.astype(np.uint64)
    hit = np.isin(key(oa, ca), key(ob, cb))
    return np.bincount(oa[hit], minlength=len(a_to) - 1) > 0


def pair_scores(rows: pa.RecordBatch) -> np.ndarray:
    """Of (block, one, two) of both sides, the better of the scores at the block sizes that they have in common."""
    x, a1, a2, y, b1, b2 = (rows.column(k) for k in range(2, 8))
    x, y = x.to_numpy(zero_copy_only=False), y.to_numpy(zero_copy_only=False)
    best = np.zeros(len(x), np.int64)
    for which, left, right, block in ((x == y, a1, b1, x), (x == y, a2, b2, x * 2), (x == 2 * y, a1, b2, x), (y == 2 * x, a2, b1, y)):
        at = np.flatnonzero(which)
        if len(at):
            best[at] = np.maximum(best[at], string_scores(left.take(pa.array(at)), right.take(pa.array(at)), block[at]))
    return best


def _candidates(flat: DataFrame, threshold: int, s: Scratch) -> DataFrame:
    """(_a, _b), each pair of fingerprints that share a run once."""
    schema = "_a bigint, _b bigint, _mark smallint, _block bigint"
    join = lambda keys: keys.repartition("_key").sortWithinPartitions("_key").mapInArrow(_pairs(threshold), schema)
    keys = flat.mapInArrow(_runs(threshold), "_key bigint, _id bigint, _mark smallint").withColumn("_side", F.lit(0).cast("smallint"))
    found = s.table(join(keys))
    rows = found.where("_block is not null").select(F.col("_a").alias("_key"), F.col("_b").alias("_id"), "_mark", "_block")
    # each block of a hot key meets each other one in a task of its own; a block and its own rows are one too
    last = rows.groupBy("_key").agg(F.max("_block").alias("_last"), F.count("*").alias("_n"))
    met = join_counted(rows, s.table(last), ["_key"], "_n").withColumn("_o", F.explode(F.sequence(F.lit(0).cast("bigint"), "_last")))
    side = F.when(F.col("_block") == F.col("_o"), 0).when(F.col("_block") < F.col("_o"), 1).otherwise(2).cast("smallint")
    met = met.select(F.xxhash64("_key", F.least("_block", "_o"), F.greatest("_block", "_o")).alias("_key"), "_id", "_mark", side.alias("_side"))
    across = met.repartition("_key").sortWithinPartitions("_key").mapInArrow(_pairs_of_blocks(threshold), "_a bigint, _b bigint")
    return found.where("_block is null").select("_a", "_b").unionByName(across).distinct()


def _first_runs(threshold: int):
    def run(batches):
        """(key, id, mark) of every run of RUN characters of each string, once for each string, with its block size in the key.

        mark: 64 for the string of the double block size, and the run's first place in the string. A string
        that is too short to score ``threshold`` at its block size has none.
        """
        for batch in batches:
            for at in range(0, batch.num_rows, 10_000):
                rows = batch.slice(at, 10_000)
                ids, block = rows.column(0).to_numpy(zero_copy_only=False), rows.column(1).to_numpy(zero_copy_only=False)
                for k, strings in ((0, rows.column(2)), (1, rows.column(3))):
                    data, to = _reduced(strings)
                    if len(data) < RUN:
                        continue
                    value = _VALUE[data].astype(np.int64)
                    code = np.zeros(len(data) - RUN + 1, np.int64)
                    for i in range(RUN):
                        code = code << 6 | value[i : i + len(code)]
                    size = np.diff(to)
                    owner = np.repeat(np.arange(len(ids)), size)
                    good = (owner[: len(code)] == owner[RUN - 1 :]) & ((block << k) // SMALLEST * size >= threshold)[owner[: len(code)]]
                    place = (np.arange(len(data)) - to[:-1][owner])[: len(code)][good]
                    owner, code = owner[: len(code)][good], code[good]
                    own = owner << 42 | code
                    if (np.diff(np.sort(own)) == 0).any():  # seldom a run is twice in one string
                        first = np.sort(np.unique(own, return_index=True)[1])
                        owner, code, place = owner[first], code[first], place[first]
                    if len(code):
                        exponent = np.log2(block // SMALLEST).round().astype(np.int64)[owner] + k
                        yield pa.RecordBatch.from_arrays([pa.array(exponent << 42 | code), pa.array(ids[owner]), pa.array((k << 6 | place).astype(np.int16))], names=["_key", "_id", "_mark"])

    return run


def _met(rows_of_block: int):
    def run(batches):
        """(key, id, mark, block) of the rows, sorted by key, of keys that several ids have; block is null but for keys of more than two blocks."""

        def read(batch):
            return [batch.column(c).to_numpy(zero_copy_only=False) for c in range(3)]

        for (key, ids, mark), block in _by_key(map(read, batches), rows_of_block):
            if block is None:
                same = key[1:] == key[:-1]
                some = np.concatenate([[False], same]) | np.concatenate([same, [False]])
                key, ids, mark = key[some], ids[some], mark[some]
                number = pa.nulls(len(key), pa.int64())
            else:
                number = pa.array(block + np.arange(len(key)) // rows_of_block)
            if len(key):
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(ids), pa.array(mark), number], names=["_key", "_id", "_mark", "_block"])

    return run


#: Pairs that are looked at, and that are scored, at once.
_LOOK, _SCORE = 1 << 20, 1 << 13


class _Strings:
    """One string of each row: characters' values in a matrix, filled up with START, and the places of each character as bits."""

    def __init__(self, text: np.ndarray, scale: np.ndarray):
        self.text, self.scale, self.size = text, scale, (text < START).sum(axis=1)
        self.by_place = np.ascontiguousarray(text.T)
        self.mask = np.zeros((len(text), START + 1), np.uint64)
        row = np.arange(len(text))
        for j in range(int(self.size.max(initial=0))):
            self.mask[row, text[:, j]] |= np.uint64(1 << j)
        self.mask[:, START] = 0
        self.mask = self.mask.ravel()

    def scores(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Of pairs of rows, as ``string_scores`` has them, whether or not they share a run."""
        la, lb, s, at = self.size[a], self.size[b], np.full(len(a), 2**64 - 1, np.uint64), a * (START + 1)
        for j in range(int(lb.max(initial=0))):
            u = s & self.mask[at + self.by_place[j][b]]
            s = (s + u) | (s - u)
        whole = np.where(la >= 64, np.uint64(2**64 - 1), (np.uint64(1) << np.minimum(la, 63).astype(np.uint64)) - np.uint64(1))
        total = np.maximum(la + lb, 1)
        distance = total - 2 * np.bitwise_count(~s & whole).astype(np.int64)
        return np.minimum(100 - (100 * distance + total - 1) // total, self.scale[a] * np.minimum(la, lb))

    def first_shared(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Of pairs of rows, the first place in a's string of a run that b's has too; START if there is none."""
        n = max(int(self.size[a].max(initial=0)), RUN)
        at = self.mask[b * (START + 1) + self.by_place[:n][:, a]]
        met = at[: n - RUN + 1].copy()
        for k in range(1, RUN):
            met &= at[k : n - RUN + 1 + k] >> np.uint64(k)
        met = met != 0
        return np.where(met.any(axis=0), met.argmax(axis=0), START)


def _matrix(strings: pa.Array) -> np.ndarray:
    data, to = _reduced(strings)
    size = np.diff(to)
    out = np.full((len(size), LENGTH), START, np.uint8)
    out[np.repeat(np.arange(len(size)), size), np.arange(len(data)) - np.repeat(to[:-1], size)] = _VALUE[data]
    return out


def _linked(threshold: int):
    """(_a, _b, _w) from rows of (key, two blocks, id, n, mark, side, fingerprint) sorted by key and blocks.

    _w is how many documents are linked with those of _a by pairs that count at a key, _b another id that _a is
    connected with there. A pair counts where the first run of the lesser id's string that the other has is the
    key's, at the smaller of the block sizes that link it; it is left out unseen where the characters before the
    run are equal, as then the run that begins one earlier is shared too, and where the lengths, whose difference
    is part of the edit distance, are too far apart to score ``threshold``. Rows of different blocks of a hot key
    (sides 1 and 2) are paired across only.
    """

    def may(first, size, before, length, side):
        """Rows one < two of pairs of one key, in batches; first: where keys begin, size: their numbers of rows."""
        for n in np.unique(size[size > 1]):
            at, high = first[size == n], max(1, min(n, _LOOK // n))
            for some in np.array_split(at, max(1, -(-len(at) * n * high // _LOOK))):
                for i in range(0, n - 1, high):
                    x, y = some[:, None] + np.arange(i, min(i + high, n)), some[:, None] + np.arange(i, n)
                    lx, ly, bx, sx = length[x][:, :, None], length[y][:, None], before[x][:, :, None], side[x][:, :, None]
                    good = (bx != before[y][:, None]) | (bx == START)
                    good &= 100 * np.abs(lx - ly) <= (100 - threshold) * (lx + ly)
                    good &= (sx == 0) | (sx != side[y][:, None])
                    good &= np.arange(x.shape[1])[:, None] < np.arange(y.shape[1])
                    c, one, two = np.nonzero(good)
                    yield x[c, one], y[c, two]

    def score(rows):
        group, ids, n, mark, side, block, single, double = rows
        first = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
        twice, place = mark >> 6, mark & 63
        own = _Strings(np.where(twice[:, None] == 1, double, single), (block << twice) // SMALLEST)
        before = np.where(place > 0, own.text[np.arange(len(ids)), np.maximum(place, 1) - 1], START).astype(np.uint8)
        below = None
        weight, groups = np.zeros(len(ids), np.int64), Groups(len(ids))
        for one, two in may(first, np.diff(np.append(first, len(group))), before, own.size.astype(np.int16), side):
            for at in range(0, len(one), _SCORE):
                a, b = one[at : at + _SCORE], two[at : at + _SCORE]
                good = own.scores(a, b) >= threshold
                a, b = a[good], b[good]
                a, b = np.where(ids[a] < ids[b], a, b), np.where(ids[a] < ids[b], b, a)
                good = own.first_shared(a, b) == place[a]
                a, b = a[good], b[good]
                both = np.flatnonzero(twice[a] & twice[b])  # of one block size, which may link them already
                if len(both):
                    below = below or _Strings(single, block // SMALLEST)
                    x, y = a[both], b[both]
                    linked = (below.scores(x, y) >= threshold) & (below.first_shared(x, y) < START)
                    a, b = np.delete(a, both[linked]), np.delete(b, both[linked])
                np.add.at(weight, a, n[b])
                np.add.at(weight, b, n[a])
                groups.link(a, b)
        some = np.flatnonzero(weight)
        return pa.RecordBatch.from_arrays([pa.array(ids[some]), pa.array(ids[groups.root[some]]), pa.array(weight[some])], names=["_a", "_b", "_w"])

    def run(batches):
        last, number = None, 0

        def read(batch):
            nonlocal last, number
            c = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(8)]
            if not batch.num_rows:
                return [np.zeros(0, np.int64), *c[3:8], _matrix(batch.column(8)), _matrix(batch.column(9))]
            other = np.zeros(batch.num_rows, np.int64)
            other[1:] = (c[0][1:] != c[0][:-1]) | (c[1][1:] != c[1][:-1]) | (c[2][1:] != c[2][:-1])
            other[0] = last != (c[0][0], c[1][0], c[2][0])
            group = number + np.cumsum(other)
            last, number = (c[0][-1], c[1][-1], c[2][-1]), group[-1]
            return [group, c[3], c[4], c[5].astype(np.int64), c[6], c[7], _matrix(batch.column(8)), _matrix(batch.column(9))]

        for rows, _ in _by_key(map(read, batches), None):
            out = score(rows)
            if out.num_rows:
                yield out

    return run


def _degrees(groups: DataFrame, threshold: int, s: Scratch) -> DataFrame:
    """(_a, _b, _w), for each fingerprint one or more rows with parts of the number of its links with other ones and with what it is connected with."""
    spark = groups.sparkSession
    prints = groups.select(F.col("_node").alias("_id"), "_n", "_f.block_size", "_f.signature", "_f.signature_double")
    keys = prints.drop("_n").mapInArrow(_first_runs(threshold), "_key bigint, _id bigint, _mark smallint")
    found = s.table(keys.repartition("_key").sortWithinPartitions("_key").mapInArrow(_met(BLOCK), "_key bigint, _id bigint, _mark smallint, _block bigint"))
    none = F.lit(0).cast("bigint")
    cold = found.where("_block is null").select("_key", none.alias("_x"), none.alias("_y"), "_id", "_mark", F.lit(0).cast("smallint").alias("_side"))
    # each block of a hot key meets each other one in a task of its own; a block and its own rows are one too
    rows = found.where("_block is not null")
    last = s.table(rows.groupBy("_key").agg(F.max("_block").alias("_last"), F.count("*").alias("_many")))
    hot = join_counted(rows, last, ["_key"], "_many").withColumn("_o", F.explode(F.sequence(none, "_last")))
    side = F.when(F.col("_block") == F.col("_o"), 0).when(F.col("_block") < F.col("_o"), 1).otherwise(2).cast("smallint")
    hot = hot.select("_key", F.least("_block", "_o").alias("_x"), F.greatest("_block", "_o").alias("_y"), "_id", "_mark", side.alias("_side"))
    rows = cold.unionByName(hot).join(prints, "_id").select("_key", "_x", "_y", "_id", "_n", "_mark", "_side", "block_size", "signature", "signature_double")
    # as many tasks as the session has partitions, for it is pairs that take time, not bytes
    rows = rows.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "_key", "_x", "_y").sortWithinPartitions("_key", "_x", "_y")
    return s.table(rows.mapInArrow(_linked(threshold), "_a bigint, _b bigint, _w bigint"))


def _grouped(docs: DataFrame, id_col: str, text_col: str, s: Scratch) -> tuple[DataFrame, DataFrame]:
    """(_id, _f) and (_f, _rep, _n, _node) of the distinct fingerprints _f, as written tables."""
    prints = fingerprint(docs, id_col, text_col).select(F.col(id_col).alias("_id"), F.struct("block_size", "signature", "signature_double").alias("_f")).where("_id is not null")
    prints = s.table(prints.groupBy("_id").agg(F.min("_f").alias("_f")))
    groups = prints.where("_f.signature <> ''").groupBy("_f").agg(F.min("_id").alias("_rep"), F.count("*").alias("_n"))
    return prints, s.table(groups.withColumn("_node", F.monotonically_increasing_id()))


def links(docs: DataFrame, threshold: int, id_col: str, text_col: str, s: Scratch) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(_id, _f), (_node, _rep, _n, _f) of the distinct fingerprints _f, and (_a, _b, _na, _nb, _score) of similar ones, as written tables."""
    prints, groups = _grouped(docs, id_col, text_col, s)
    flat = groups.select("_node", "_f.block_size", "_f.signature", "_f.signature_double")
    side = lambda to, x: groups.select(F.col("_node").alias(to), F.col("_n").alias(f"_n{to[1]}"), F.col("_f.block_size").alias(f"_{x}0"), F.col("_f.signature").alias(f"_{x}1"), F.col("_f.signature_double").alias(f"_{x}2"))
    both = _candidates(flat, threshold, s).join(side("_a", "x"), "_a").join(side("_b", "y"), "_b").select("_a", "_b", "_x0", "_x1", "_x2", "_y0", "_y1", "_y2", "_na", "_nb")
    names = ["_a", "_b", "_na", "_nb", "_score"]

    def score(batches):
        for rows in batches:
            for at in range(0, rows.num_rows, 20_000):
                part = rows.slice(at, 20_000)
                got = pair_scores(part)
                good = pa.array(np.flatnonzero(got >= threshold))
                yield pa.RecordBatch.from_arrays([*(part.column(k).take(good) for k in (0, 1, 8, 9)), pa.array(got).take(good)], names=names)

    return prints, groups, s.table(both.mapInArrow(score, ", ".join(f"{n} bigint" for n in names)))


def similar(docs: DataFrame, threshold: int = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, block_size, signature, signature_double, class_id, links) of every id.

    class_id: the least id that it is connected with by similar fingerprints, directly or by others;
    links: how many other documents score ``threshold`` or more.
    """
    s = Scratch(docs.sparkSession)
    prints, groups = _grouped(docs, id_col, text_col, s)
    degrees = _degrees(groups, threshold, s)
    roots = components(degrees.select("_a", "_b"), s).withColumnRenamed("_id", "_node")
    ways = degrees.groupBy(F.col("_a").alias("_node")).agg(F.sum("_w").alias("_w"))
    # classes are joined by node, not by root, which most fingerprints don't have: nulls would all be one task's
    least = roots.join(groups.select("_node", "_rep"), "_node").groupBy("_root").agg(F.min("_rep").alias("_least"))
    classes = roots.join(least, "_root").select("_node", "_least")
    known = groups.join(ways, "_node", "left").join(classes, "_node", "left")
    known = known.select("_f", "_n", F.coalesce("_least", "_rep").alias("_class"), (F.coalesce("_w", F.lit(0).cast("bigint")) + F.col("_n") - 1).alias("_links"))
    found = join_counted(prints.where("_f.signature <> ''"), s.table(known), ["_f"], "_n").select("_id", "_f", "_class", "_links")
    alone = prints.where("_f.signature = ''").select("_id", "_f", F.col("_id").alias("_class"), F.lit(0).cast("bigint").alias("_links"))
    out = s.table(found.unionByName(alone))
    s.close(out)
    return resting_on(out.select(F.col("_id").alias(id_col), "_f.block_size", "_f.signature", "_f.signature_double", F.col("_class").alias("class_id"), F.col("_links").alias("links")), out)
