"""N-gram Jaccard join with Bayesian pruning of MinHash candidates.

1. One scan gives each document a 128-bit digest of its set of word n-grams
   and the keys of the ``HASHES / ROWS`` bands of its MinHash signature.
   Documents of equal sets are one *representative* from here on (exact copies,
   at any number, cost nothing more).
2. Representatives that agree on a band are candidates. They are never
   written as pairs: stars around the least representative of each key give
   connected components, and these are laid out in blocks of neighbours.
3. A second scan of the involved texts sends signature and n-gram set to each
   pair of blocks in which they meet. There candidates are compared ``STEP``
   values at a time; after each step pairs go for which the posterior
   probability of a Jaccard similarity of at least the threshold, under a
   uniform prior, is below ``TOLERANCE``.
4. What is left is verified exactly on the n-gram sets (as 64-bit hashes). Of
   the links found a task returns each document's number of them and one link
   to the least document it is connected with, so results grow with documents.

Two documents are similar if the Jaccard similarity of their sets of word
5-grams, of lower case, is at least 0.7. A text of fewer words is one n-gram.
A class is a connected group of similar documents, named by its least id.
Where only classes are wanted, as in ``keep_one``, candidates that are
already connected aren't verified.

Defined results: null and empty texts, and those without any word, have no
n-gram and are similar to none, a class of their own; null ids have no class
and ``keep_one`` keeps their rows; rows that repeat an id are one document,
with the text whose digest is least, which is also the row that ``keep_one``
keeps (of rows with one digest the least by its columns' values); ids are of
any type that has an order; further columns pass through ``keep_one``.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quadloom.llm import textnp as tx
from quadloom.llm.cluster import Groups, blocks, components, equal_pairs, meetings, shared
from quadloom.llm.common import Scratch, join_counted, map_text, numbered, resting_on, unused

WORDS, HASHES, ROWS, THRESHOLD = 5, 80, 4, 0.7
STEP, TOLERANCE = 8, 0.01
#: Documents, and n-grams (8 bytes each), of one block at about most.
BLOCK, BLOCK_GRAMS = 1024, 2_000_000
#: Rows (some 60 bytes each) up to which the involved documents are broadcast to a scan; beyond that they are joined.
BROADCAST_ROWS = 500_000

_draw = np.random.default_rng(20_240_501)
_MULTIPLY = _draw.integers(0, 1 << 63, HASHES, dtype=np.uint64) << np.uint64(1) | np.uint64(1)
_ADD = _draw.integers(0, 1 << 63, HASHES, dtype=np.uint64)


def ngram_sets(data: np.ndarray, offsets: np.ndarray, words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct n-gram hashes of all texts of a slice one after the other, and the offsets by text."""
    n = len(offsets) - 1
    low = tx.lower(data)
    starts, ends = tx.runs(tx.WORD[low], offsets)
    h = tx.span_hashes(low, starts, ends)
    by = tx.per_document(starts, offsets)
    count = np.diff(by)
    doc = np.repeat(np.arange(n), count)
    at = np.arange(len(h)) - by[doc]
    gram = np.zeros(len(h), np.uint64)
    padded = np.concatenate([h, np.zeros(words - 1, np.uint64)])  # so that fillers reach the last text too
    for k in range(words):  # a short text is one n-gram of what it has
        gram *= tx.BASE
        gram += np.where(at + k < count[doc], padded[k : k + len(h)], np.uint64(k))
    whole = (at + words <= count[doc]) | (at == 0)
    gram, doc = tx.mix(gram[whole]), doc[whole]
    order = np.lexsort((gram, doc))
    gram, doc = gram[order], doc[order]
    first = np.ones(len(gram), bool)
    first[1:] = (gram[1:] != gram[:-1]) | (doc[1:] != doc[:-1])
    return gram[first], tx.counts_to_offsets(np.bincount(doc[first], minlength=n))


def signatures(grams: np.ndarray, to: np.ndarray) -> np.ndarray:
    """MinHash values, 32 bits each, one row for each text; rows of empty sets are meaningless."""
    out = np.zeros((len(to) - 1, HASHES), np.uint32)
    filled = np.flatnonzero(to[1:] > to[:-1])
    if len(filled):
        for k in range(HASHES):
            out[filled, k] = np.minimum.reduceat(grams * _MULTIPLY[k] + _ADD[k], to[filled]) >> np.uint64(32)
    return out


def digests(grams: np.ndarray, to: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits, in two halves, that stand for each set."""
    size = np.diff(to).astype(np.uint64)
    high = tx.ragged_sum(tx.mix(grams.copy()), to, np.uint64) + size
    low = tx.ragged_sum(tx.mix(grams * np.uint64(0x94D049BB133111EB)), to, np.uint64) ^ size
    return high.view(np.int64), low.view(np.int64)


def _binary(rows: np.ndarray) -> pa.Array:
    width = rows.shape[1] * rows.itemsize
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(np.arange(len(rows) + 1, dtype=np.int32) * width), pa.py_buffer(np.ascontiguousarray(rows))])


def band_keys(signature: np.ndarray) -> np.ndarray:
    """A 64-bit key of each band of each signature; keys of different bands differ."""
    parts = np.ascontiguousarray(signature).reshape(len(signature), HASHES // ROWS, ROWS).astype(np.uint64)
    key = np.zeros(parts.shape[:2], np.uint64) + np.arange(1, HASHES // ROWS + 1, dtype=np.uint64) * tx.BASE
    for k in range(ROWS):
        key = tx.mix(key + parts[:, :, k])
        key *= tx.BASE
    return key


def sketch(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(_id, _high, _low, _size, _keys) of every row with an id; _high and _low digest the set, _keys is null without an n-gram."""
    source = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text")).where("_id is not null")
    kinds = [("_id", source.schema["_id"].dataType), ("_high", T.LongType()), ("_low", T.LongType()), ("_size", T.LongType()), ("_keys", T.ArrayType(T.LongType()))]
    schema = T.StructType([T.StructField(*k) for k in kinds])
    bands = HASHES // ROWS

    def run(rows, data, offsets):
        grams, to = ngram_sets(data, offsets)
        high, low = digests(grams, to)
        size = np.diff(to)
        keys = band_keys(signatures(grams, to)).view(np.int64).ravel()
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(size) + 1, dtype=np.int32) * bands), pa.array(keys), mask=pa.array(size == 0) if (size == 0).any() else None)
        return pa.RecordBatch.from_arrays([rows.column(0), pa.array(high), pa.array(low), pa.array(size), lists], names=schema.names)

    return map_text(source, "_text", run, schema)


def least_matches(threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> np.ndarray:
    """For each number of compared values, the fewest matches at which a pair stays.

    With a uniform prior the posterior after m of n matches is Beta(m + 1, n - m + 1);
    its tail above the threshold is a sum of binomial terms.
    """
    from math import comb

    out = np.zeros(HASHES + 1, int)
    for n in range(1, HASHES + 1):
        for m in range(n + 1):
            tail = sum(comb(n + 1, j) * threshold**j * (1 - threshold) ** (n + 1 - j) for j in range(m + 1))
            if tail >= tolerance:
                out[n] = m
                break
    return out


def prune(a: np.ndarray, b: np.ndarray, left: np.ndarray, right: np.ndarray, least: np.ndarray) -> np.ndarray:
    """Indices of the pairs (rows of the signature matrices ``left`` and ``right``) that stay to the end."""
    stay = np.arange(len(a))
    matches = np.zeros(len(a), int)
    for at in range(0, HASHES, STEP):
        matches += (left[a[stay], at : at + STEP] == right[b[stay], at : at + STEP]).sum(axis=1)
        good = matches >= least[at + STEP]
        stay, matches = stay[good], matches[good]
        if not len(stay):
            break
    return stay


def verify(a: np.ndarray, b: np.ndarray, left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Exact Jaccard similarity of pairs of sorted sets, all pairs of one left set at a time."""
    out = np.zeros(len(a))
    size = np.array([len(x) for x in right])
    order = np.argsort(a, kind="stable")
    cut = np.flatnonzero(np.diff(a[order])) + 1
    for group in np.split(order, cut):
        x = left[a[group[0]]]
        for some in np.array_split(group, max(1, len(group) // 256)):
            many = np.concatenate([right[i] for i in b[some]])
            at = np.searchsorted(x, many)
            hit = x[np.minimum(at, len(x) - 1)] == many
            common = tx.ragged_sum(hit, tx.counts_to_offsets(size[b[some]]), np.int64)
            out[some] = common / (len(x) + size[b[some]] - common)
    return out


def _compare(threshold: float, least: np.ndarray, want: str, id_type: T.DataType):
    """The work on one pair of blocks, and its schema.

    want: "links" for each row's links and the least row that it is connected with,
    "classes" for the latter only, "pairs" for the similar pairs.
    """
    kinds = [("_a", id_type), ("_b", id_type), ("_j", T.DoubleType())] if want == "pairs" else [("_id", id_type), ("_to", id_type), ("_links", T.LongType())]

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("_id").drop_duplicates("_id")  # rows that repeat an id and have its set
        ids, block = rows["_id"].to_numpy(), rows["_block"].to_numpy()
        weight = rows["_n"].to_numpy()
        signature = np.frombuffer(b"".join(rows["_signature"]), np.uint32).reshape(len(ids), HASHES)
        sets = [np.frombuffer(g, np.uint64) for g in rows["_grams"]]
        groups, links, found = Groups(len(ids)), np.zeros(len(ids), np.int64), []
        for a, b in equal_pairs(band_keys(signature), None if (block == block[:1]).all() else block):
            if want == "classes":
                open_ = groups.root[a] != groups.root[b]
                a, b = a[open_], b[open_]
            stay = prune(a, b, signature, signature, least)
            a, b = a[stay], b[stay]
            if not len(a):
                continue
            j = verify(a, b, sets, sets)
            good = j >= threshold
            a, b = a[good], b[good]
            groups.link(a, b)
            np.add.at(links, a, weight[b])
            np.add.at(links, b, weight[a])
            if want == "pairs":
                found.append((a, b, j[good]))
        if want == "pairs":
            a, b, j = (np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, np.int64),) * 3
            return pd.DataFrame({"_a": ids[a], "_b": ids[b], "_j": j.astype(float)})
        some = np.flatnonzero(links > 0)
        return pd.DataFrame({"_id": ids[some], "_to": ids[groups.root[some]], "_links": links[some]})

    return run, T.StructType([T.StructField(*k) for k in kinds])


def _sets(docs: DataFrame, wanted: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(_id, _n, _block, _meets, _signature, _grams) of the representatives in ``wanted``, from a second scan."""
    source = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text"))
    small = wanted.count() <= BROADCAST_ROWS
    source = source.join(F.broadcast(wanted) if small else wanted, "_id").select("_id", "_n", "_block", "_meets", "_high", "_low", "_text")
    schema = T.StructType([*source.schema.fields[:4], T.StructField("_signature", T.BinaryType()), T.StructField("_grams", T.BinaryType())])

    def run(rows, data, offsets):
        grams, to = ngram_sets(data, offsets)
        high, low = digests(grams, to)
        lists = pa.Array.from_buffers(pa.large_binary(), len(to) - 1, [None, pa.py_buffer(to * 8), pa.py_buffer(np.ascontiguousarray(grams))])
        out = pa.RecordBatch.from_arrays([*rows.columns[:4], _binary(signatures(grams, to)), lists.cast(pa.binary())], names=schema.names)
        one = (high == rows.column(4).to_numpy()) & (low == rows.column(5).to_numpy())  # of an id's texts the one that stands for it
        return out if one.all() else out.filter(pa.array(one))

    return map_text(source, "_text", run, schema)


class Join:
    """The join's parts, as written tables: ``one`` (_id, _high, _low, _size) for each id and ``reps`` (_high, _low, _rep, _n, _size)."""

    def __init__(self, docs: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text"):
        self.docs, self.threshold, self.columns = docs, threshold, (id_col, text_col)
        self.scratch = s = Scratch(docs.sparkSession)
        sketches = s.table(sketch(docs, id_col, text_col))
        set_ = F.when(F.col("_size") > 0, F.struct("_high", "_low", "_size"))
        self.one = s.table(sketches.groupBy("_id").agg(F.min(set_).alias("_s")).select("_id", "_s.*"))
        reps = self.one.where("_size is not null").groupBy("_high", "_low").agg(F.min("_id").alias("_rep"), F.count("*").alias("_n"), F.min("_size").alias("_size"))
        self.reps = s.table(reps)
        ends = self.reps.select(F.col("_rep").alias("_id"), F.col("_high").alias("_h"), F.col("_low").alias("_l"))
        keyed = sketches.where("_keys is not null").join(ends, "_id").where("_high = _h and _low = _l").select("_id", "_keys").dropDuplicates(["_id"])
        self.keys = shared(keyed.select("_id", F.explode("_keys").alias("_key")), s)
        s.drop(sketches)

    def compared(self, want: str) -> DataFrame:
        """What ``_compare`` returns for all pairs of blocks."""
        s = self.scratch
        roots = components(self.keys.select(F.col("_id").alias("_a"), F.col("_least").alias("_b")), s)
        near = self.keys.groupBy("_id").agg(F.min("_key").alias("_near"))
        known = self.reps.select(F.col("_rep").alias("_id"), "_high", "_low", "_n", "_size")
        placed = blocks(near.join(roots, "_id").join(known, "_id"), s, ["_root", "_near", "_id"], BLOCK, BLOCK_GRAMS).drop("_root", "_near", "_size")
        wanted = s.table(meetings(self.keys, placed))
        sets = _sets(self.docs, wanted, *self.columns)
        spread = sets.withColumn("_meet", F.explode("_meets")).select("_meet.x", "_meet.y", "_id", "_n", "_block", "_signature", "_grams")
        run, schema = _compare(self.threshold, least_matches(self.threshold), want, sets.schema["_id"].dataType)
        return s.table(spread.groupBy("x", "y").applyInPandas(lambda rows: run(rows), schema))

    def classes(self, links: bool = True) -> DataFrame:
        """(_id, _class, _links) of every id, as a written table; _links is 0 where ``links`` isn't asked for."""
        s = self.scratch
        parts = self.compared("links" if links else "classes")
        roots = components(parts.select(F.col("_id").alias("_a"), F.col("_to").alias("_b")), s).withColumnRenamed("_id", "_rep")
        counted = parts.groupBy(F.col("_id").alias("_rep")).agg(F.sum("_links").alias("_links"))
        count = F.coalesce("_links", F.lit(0).cast("bigint")) + F.col("_n") - 1 if links else F.lit(0).cast("bigint")
        reps = self.reps.join(counted, "_rep", "left").join(roots, "_rep", "left")
        reps = s.table(reps.select("_high", "_low", "_n", F.coalesce("_root", "_rep").alias("_class"), count.alias("_links")))
        known = join_counted(self.one.where("_size is not null").select("_id", "_high", "_low"), reps, ["_high", "_low"], "_n").select("_id", "_class", "_links")
        out = s.table(known.unionByName(self.one.where("_size is null").select("_id", F.col("_id").alias("_class"), F.lit(0).cast("bigint").alias("_links"))))
        s.close(out)
        return out


def classes(docs: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, class_id, links) of every id: the least id of its class, and how many other documents are similar to it."""
    out = Join(docs, threshold, id_col, text_col).classes()
    return resting_on(out.select(F.col("_id").alias(id_col), F.col("_class").alias("class_id"), F.col("_links").alias("links")), out)


def similar_sets(docs: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_a, doc_b, jaccard) of every pair of similar different sets, doc_a < doc_b the least ids that have them."""
    join = Join(docs, threshold, id_col, text_col)
    out = join.compared("pairs")
    join.scratch.close(out)
    return resting_on(out.select(F.col("_a").alias("doc_a"), F.col("_b").alias("doc_b"), F.col("_j").alias("jaccard")), out)


def _least_rows(rows: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Of the rows of each id the one with an n-gram and the least digest, else with the least values."""
    plain = numbered(rows)
    schema = T.StructType([*plain.schema.fields, T.StructField("_none", T.BooleanType()), T.StructField("_high", T.LongType()), T.StructField("_low", T.LongType())])
    at, text = rows.columns.index(id_col), rows.columns.index(text_col)

    def run(batch, data, offsets):
        grams, to = ngram_sets(data, offsets)
        return pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.diff(to) == 0), *map(pa.array, digests(grams, to))], names=schema.names)

    # shuffles the rows of repeated ids only, with partial aggregation, so that an id may repeat at any number
    marked = map_text(plain, f"c{text}", run, schema)
    order = F.struct("_none", "_high", "_low", F.to_json(F.struct(*plain.columns)).alias("_all"))
    return marked.groupBy(F.col(f"c{at}").alias("_id")).agg(F.min_by(F.struct(*plain.columns), order).alias("_row")).select("_row.*").toDF(*rows.columns)


def keep_one(docs: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One document of each class, that of the least id, and all that have no id, with their own columns only."""
    join = Join(docs, threshold, id_col, text_col)
    s = join.scratch
    out = join.classes(links=False)
    gone_id, twice_id = unused(docs, "_gone"), unused(docs, "_twice")
    gone = s.table(out.where("_id <> _class").select(F.col("_id").alias(gone_id)))
    ids = docs.select(F.col(id_col).alias(twice_id)).where(F.col(twice_id).isNotNull()).groupBy(twice_id).agg(F.count("*").alias("_n")).where("_n > 1").select(twice_id)
    twice = s.table(ids)
    s.close(gone, twice)
    kept = docs.join(F.broadcast(gone) if gone.count() <= BROADCAST_ROWS else gone, docs[id_col] == gone[gone_id], "left_anti")
    if twice.isEmpty():
        return resting_on(kept, gone)
    few = F.broadcast(twice) if twice.count() <= BROADCAST_ROWS else twice
    once = kept.join(few, kept[id_col] == few[twice_id], "left_anti")
    again = kept.join(few, kept[id_col] == few[twice_id], "left_semi")
    return resting_on(once.unionByName(_least_rows(again, id_col, text_col)), gone, twice)


def oracle_sql() -> str:
    """Classes and links by brute force over shared n-grams."""
    last = WORDS - 1
    return f"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}\\p{{M}}]+') AS w FROM documents),
p AS (SELECT doc_id, w, unnest(range(1, greatest(len(w) - {last}, 1) + 1)) AS i FROM w WHERE len(w) > 0),
g AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + {last}], ' ') AS g FROM p),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
c AS (SELECT a.doc_id AS doc_a, b.doc_id AS doc_b, count(*) AS c FROM g a JOIN g b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
e AS (SELECT doc_a, doc_b FROM c JOIN n x ON x.doc_id = doc_a JOIN n y ON y.doc_id = doc_b WHERE c / (x.n + y.n - c)::DOUBLE >= {THRESHOLD}),
r AS (SELECT doc_id, doc_id AS root FROM documents UNION SELECT e.doc_b, r.root FROM r JOIN e ON e.doc_a = r.doc_id WHERE r.root < e.doc_b),
l AS (SELECT doc_a AS doc_id, count(*) AS links FROM e GROUP BY doc_a)
SELECT doc_id, min(root) AS class_id, coalesce(any_value(links), 0) AS links FROM r LEFT JOIN l USING (doc_id) GROUP BY doc_id
"""
