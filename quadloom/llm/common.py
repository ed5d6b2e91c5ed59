"""Plumbing shared by the operators: Arrow slices, shared scratch tables, bounded labelled samples."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quadloom.llm import textnp as tx

#: Bytes of text that are worked on at once. Longer documents are still worked on whole.
SLICE = 1 << 20

_own_dir: str | None = None


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; a temporary one only where that is unset, as in tests."""
    global _own_dir
    given = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if given:
        return given.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    if _own_dir is None or not os.path.isdir(_own_dir):
        _own_dir = tempfile.mkdtemp(prefix="scratch-")
    return "file://" + _own_dir


class Scratch:
    """Tables written to the shared folder, so that a lost executor costs no recomputation of what led to them."""

    def __init__(self, spark: SparkSession):
        self.spark, self.base = spark, f"{shared_dir(spark)}/{uuid.uuid4().hex}"
        self.n = 0

    def table(self, df: DataFrame, partitions: int | None = None) -> DataFrame:
        """Write ``df`` and read it back: the lineage is cut and the size is known to the planner."""
        self.n += 1
        path = f"{self.base}/{self.n}"
        (df if partitions is None else df.coalesce(partitions)).write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        return out

    def drop(self, df: DataFrame | None) -> None:
        """Delete a table that nothing reads any more."""
        path = getattr(df, "_scratch_path", None)
        if path:
            _delete(self.spark, path)

    def close(self, *kept: DataFrame) -> None:
        """Delete all tables but ``kept``, those that the result reads; without any, the folder too."""
        stay = {getattr(df, "_scratch_path", None) for df in kept}
        if not kept:
            _delete(self.spark, self.base)
        for k in range(1, self.n + 1) if kept else ():
            if (path := f"{self.base}/{k}") not in stay:
                _delete(self.spark, path)


def _delete(spark: SparkSession, path: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def release(df: DataFrame) -> None:
    """Delete the written tables that ``df``, an operator's result, reads, once it isn't needed any more."""
    for path in getattr(df, "_scratch_paths", ()):
        _delete(df.sparkSession, path)


def resting_on(df: DataFrame, *tables: DataFrame) -> DataFrame:
    """``df``, which keeps the paths of the written tables that it reads for ``release``."""
    df._scratch_paths = tuple(t._scratch_path for t in tables)
    return df


def text_slices(batches: Iterator[pa.RecordBatch], text: str, limit: int = SLICE):
    """(rows, bytes, offsets) of consecutive row ranges of at most ``limit`` bytes of text."""
    for batch in batches:
        data, offsets = tx.buffers(batch.column(batch.schema.get_field_index(text)))
        for i, j in tx.slices(offsets, limit):
            yield batch.slice(i, j - i), data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]


def map_text(df: DataFrame, text: str, fn: Callable, schema: T.StructType | str, limit: int = SLICE) -> DataFrame:
    """``fn(rows, bytes, offsets) -> RecordBatch`` over slices of whole documents, without a shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offsets in text_slices(batches, text, limit):
            out = fn(rows, data, offsets)
            if out is not None and out.num_rows:
                yield out

    return df.mapInArrow(run, schema)


def filter_text(df: DataFrame, text: str, keep: Callable, limit: int = SLICE) -> DataFrame:
    """Rows for which ``keep(bytes, offsets)`` is true, with all columns as they are (none is added, so none can clash)."""

    names = df.columns

    def run(rows: pa.RecordBatch, data: np.ndarray, offsets: np.ndarray):
        mask = keep(data, offsets)
        return (rows if mask.all() else rows.filter(pa.array(mask))).rename_columns(names)

    return map_text(numbered(df), f"c{names.index(text)}", run, df.schema, limit)


def numbered(df: DataFrame) -> DataFrame:
    """The columns called c0, c1, ...: names with dots in them can't be given to Arrow functions."""
    return df.toDF(*[f"c{i}" for i in range(len(df.columns))])


def unused(df: DataFrame, name: str) -> str:
    """A column name that ``df`` doesn't have; Spark takes upper and lower case for the same."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


#: A key is hot where more than this share of the joined rows has it; there can't be more than 1 / HOT of them.
HOT, SALTS = 1 / 1024, 64


def join_counted(left: DataFrame, right: DataFrame, keys: list[str], count: str) -> DataFrame:
    """Inner join of ``left`` with ``right``, which has each key once and in ``count`` how many rows of ``left`` have it.

    Rows of hot keys are spread over ``SALTS`` groups, so that a key that a third of all rows has is no single
    task; at most 1 / ``HOT`` keys are hot, whatever the data, and only they are broadcast.
    """
    total = right.agg(F.sum(count)).first()[0] or 0
    is_hot = F.col(count) > F.lit(int(total * HOT))
    hot = right.where(is_hot).select(*keys, F.lit(True).alias("_hot"))
    salt = F.when(F.col("_hot"), F.pmod(F.xxhash64(*left.columns), F.lit(SALTS))).otherwise(F.lit(0).cast("bigint"))
    spread = left.join(F.broadcast(hot), keys, "left").withColumn("_salt", salt).drop("_hot")
    each = F.when(is_hot, F.sequence(F.lit(0).cast("bigint"), F.lit(SALTS - 1).cast("bigint"))).otherwise(F.array(F.lit(0).cast("bigint")))
    return spread.join(right.withColumn("_salt", F.explode(each)), [*keys, "_salt"]).drop("_salt")


def stable_hash(c: Column | str) -> Column:
    """An order of ids that has nothing to do with their values and is the same in every run."""
    return F.xxhash64(F.col(c) if isinstance(c, str) else c)


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, per_class: int, id_col: str, text_col: str) -> DataFrame:
    """(id, text, label) of at most ``per_class`` documents of either label, chosen by a hash of the id.

    The ids are chosen on the narrow label table; only they, at most
    2 * ``per_class`` of them, are broadcast to one column-pruned scan of the documents.
    Nulls in id or label are left out; of contradicting labels of one id the larger counts.
    """
    one = (
        labels.select(F.col(id_col).alias("_id"), F.col(label).cast("int").alias("_label"))
        .where("_id is not null and _label in (0, 1)")
        .groupBy("_id")
        .agg(F.max("_label").alias("_label"))
    )
    picked = None
    for value in (0, 1):
        part = one.where(F.col("_label") == value).orderBy(stable_hash("_id"), "_id").limit(per_class)
        picked = part if picked is None else picked.unionByName(part)
    texts = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    return texts.join(F.broadcast(picked), "_id").where("_text is not null")
