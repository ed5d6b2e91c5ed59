"""What searches for similar documents share: keys in common, connected components, and blocks compared in one task.

No step holds the documents of a key or of a component together: keys are
counted with partial aggregation, components are found from stars, and blocks
are cut from a range-sorted order, so that a component of any size spreads over
tasks. A pair of blocks meets only where a key occurs in both, and then only
the documents that have such a key are sent.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadloom.llm import textnp as tx
from quadloom.llm.common import Scratch, join_counted


def shared(keyed: DataFrame, scratch: Scratch) -> DataFrame:
    """(_id, _key, _least) of the rows of ``keyed`` (_id, _key; distinct) whose key several ids have, with its least id."""
    counted = scratch.table(keyed.groupBy("_key").agg(F.min("_id").alias("_least"), F.count("*").alias("_n")).where("_n > 1"))
    out = scratch.table(join_counted(keyed, counted, ["_key"], "_n").select("_id", "_key", "_least"))
    scratch.drop(counted)
    return out


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(_id, _root) for every id of edges (_a, _b): the least id that it is connected with, as a written table.

    Alternating large-star and small-star steps, O(log² n) rounds; every round is
    a written table, and the edges shrink towards stars.
    """
    edges = scratch.table(edges.select(F.greatest("_a", "_b").alias("_u"), F.least("_a", "_b").alias("_v")).where("_u <> _v").distinct())
    state = None
    while True:
        both = edges.unionByName(edges.select(F.col("_v").alias("_u"), F.col("_u").alias("_v")))
        least = both.groupBy("_u").agg(F.min("_v").alias("_m")).withColumn("_m", F.least("_u", "_m"))
        large = both.join(least, "_u").where("_v > _u").select(F.col("_v").alias("_u"), F.col("_m").alias("_v")).distinct()
        least = large.groupBy("_u").agg(F.min("_v").alias("_m"))
        step = F.array(F.struct(F.col("_u").alias("_u"), F.col("_m").alias("_v")), F.struct(F.col("_v").alias("_u"), F.col("_m").alias("_v")))
        small = large.join(least, "_u").select(F.explode(step).alias("_e"))
        new = scratch.table(small.select("_e._u", "_e._v").where("_u <> _v").distinct())
        now = new.agg(F.count("*"), F.sum(F.xxhash64("_u", "_v").cast("decimal(38,0)"))).first()
        scratch.drop(edges)
        edges = new
        if tuple(now) == state:
            break
        state = tuple(now)
    roots = edges.groupBy("_u").agg(F.min("_v").alias("_root")).withColumnRenamed("_u", "_id")
    out = scratch.table(roots.unionByName(roots.select(F.col("_root").alias("_id"), "_root").distinct()))
    scratch.drop(edges)
    return out


def blocks(rows: DataFrame, scratch: Scratch, order: list[str], most_rows: int, most_size: int) -> DataFrame:
    """``rows`` with a number _block: neighbours in ``order``, about ``most_rows`` rows or ``most_size`` of the sum of _size."""
    laid = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    at = laid.columns.index("_size")
    names = [*laid.columns, "_block"]

    def run(batches):
        first, filled = TaskContext.get().partitionId() << 40, 0.0
        for batch in batches:
            load = np.maximum(1 / most_rows, batch.column(at).to_numpy(zero_copy_only=False) / most_size)
            upto = filled + np.cumsum(load)
            if len(load):
                filled = float(upto[-1])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(first + np.floor(upto - load).astype(np.int64))], names=names)

    schema = laid.select("*", F.lit(0).cast("bigint").alias("_block")).schema
    return scratch.table(laid.mapInArrow(run, schema))


def meetings(keys: DataFrame, placed: DataFrame) -> DataFrame:
    """``placed`` (_id, _block, ...) with _meets, the pairs (x, y) of blocks, x <= y, in which each id is compared."""
    at = keys.select("_id", "_key").join(placed.select("_id", "_block"), "_id")
    spans = at.groupBy("_key").agg(F.collect_set("_block").alias("_in")).where("size(_in) > 1")
    across = at.join(spans, "_key").select("_id", "_block", F.explode("_in").alias("_o")).where("_block <> _o")
    pair = F.struct(F.least("_block", "_o").alias("x"), F.greatest("_block", "_o").alias("y"))
    across = across.groupBy("_id").agg(F.collect_set(pair).alias("_across"))
    own = F.array(F.struct(F.col("_block").alias("x"), F.col("_block").alias("y")))
    return placed.join(across, "_id", "left").withColumn("_meets", F.when(F.col("_across").isNull(), own).otherwise(F.concat(own, "_across"))).drop("_across")


class Groups:
    """Connected groups of the rows of one task; a group is named by its first row."""

    def __init__(self, n: int):
        self.root = np.arange(n)

    def link(self, a: np.ndarray, b: np.ndarray) -> None:
        while True:
            x, y = self.root[a], self.root[b]
            open_ = x != y
            if not open_.any():
                return
            a, b, x, y = a[open_], b[open_], x[open_], y[open_]
            least = np.minimum(x, y)
            np.minimum.at(self.root, x, least)
            np.minimum.at(self.root, y, least)
            while (self.root[self.root] != self.root).any():
                self.root = self.root[self.root]


def equal_pairs(codes: np.ndarray, apart: np.ndarray | None, most: int = 200_000):
    """Batches (a, b), a < b, of rows that agree in one of the columns of ``codes``; each pair comes once, at the first such column.

    ``apart``: where given, only pairs of different values in it. Within a
    column the pairs of each group's first row come before the others.
    """
    for k in range(codes.shape[1]):
        order = np.argsort(codes[:, k], kind="stable")
        sorted_ = codes[order, k]
        first = np.flatnonzero(np.concatenate([[True], sorted_[1:] != sorted_[:-1]])) if len(order) else np.zeros(0, np.int64)
        size = np.diff(np.append(first, len(order)))
        first, size = first[size > 1], size[size > 1]
        if not len(first):
            continue
        yield _fresh(codes, k, apart, np.repeat(order[first], size - 1), order[tx.ragged_index(first + 1, size - 1)])
        for n in np.unique(size[size > 2]):
            at, i = first[size == n], 1
            while i < n - 1:  # as many of the rows' first members at once as give ``most`` pairs
                j = i + 1
                while j < n - 1 and (j + 1 - i) * (n - i) <= most:
                    j += 1
                one = np.repeat(np.arange(i, j), n - 1 - np.arange(i, j))
                two = tx.ragged_index(np.arange(i, j) + 1, n - 1 - np.arange(i, j))
                for some in np.array_split(at, max(1, min(len(at), len(at) * len(one) // most))):
                    where = order[some[:, None] + np.arange(n)]
                    yield _fresh(codes, k, apart, where[:, one].ravel(), where[:, two].ravel())
                i = j


def _fresh(codes: np.ndarray, k: int, apart: np.ndarray | None, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if apart is not None:
        good = apart[a] != apart[b]
        a, b = a[good], b[good]
    good = ~(codes[a, :k] == codes[b, :k]).any(axis=1)
    return np.minimum(a[good], b[good]), np.maximum(a[good], b[good])
