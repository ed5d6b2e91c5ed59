"""Balanced label propagation of linked documents over shards.

Documents are linked as far as they share lines: a line's documents form a
star around its least document, in two levels so that a line that half the
corpus has is no single task. Documents start in shards of equal size, in an
order that puts a star's members next to each other. In each round every
document counts its links by shard; one that has more of them elsewhere
applies to the shard with most, and a shard takes applicants by falling gain
until it is at its capacity of (1 + ``SLACK``) times the mean. Half of the
documents, another half each round, may move, or pairs would change places for
ever. Rounds are joins and aggregations of (id, shard) rows; texts are read once.

Admission needs no ranking of applicants: they are counted by (shard, gain
class, hash group), and whole groups are let in while they fit, so no shard ever
exceeds its capacity. Gains below 64 are classes of their own; above, a class is
at most 1/32 wide, so there are under 2,000 classes whatever the gains.

Defined results: null ids have no shard and are left out; rows that repeat an
id are one document (with the lines of all of them); ids are of any type that
has an order; null and empty texts and those without a shared line have
no links and stay where they begin; of equally good shards the present one,
then the least counts; further columns are left behind.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quadloom.llm.common import Scratch, resting_on

SHARDS, ROUNDS, SLACK = 16, 6, 0.05
#: Characters from which on a line links documents.
LINE = 20
SALTS, GROUPS, BUCKETS, PARTS = 4096, 256, 1024, 128


def links(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(_a, _b, _w), _a < _b: pairs of star and member, with the number of lines that they share so."""
    lines = F.array_distinct(F.transform(F.split(F.lower(F.col(text_col).cast("string")), "\n"), lambda x: F.trim(x)))
    keys = F.array_distinct(F.transform(F.filter(lines, lambda x: F.length(x) >= LINE), lambda x: F.xxhash64(x)))
    rows = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("_id"), F.explode(keys).alias("_key"))
    rows = rows.withColumn("_salt", F.pmod(F.xxhash64("_id"), F.lit(SALTS)))
    head = F.min("_id").over(Window.partitionBy("_key", "_salt"))
    rows = rows.withColumn("_head", head)
    members = rows.where("_id <> _head").select(F.col("_head").alias("_a"), F.col("_id").alias("_b"))
    heads = rows.where("_id = _head").groupBy("_key").agg(F.collect_set("_id").alias("_ids")).where("size(_ids) > 1").select(F.array_min("_ids").alias("_a"), F.explode("_ids").alias("_b")).where("_a <> _b")
    return members.unionByName(heads).groupBy("_a", "_b").agg(F.count("*").alias("_w"))


def gain_class(gain):
    """Rises with ``gain``, exactly below 64 and in steps of at most 1/32 above."""
    shift = F.greatest(F.length(F.bin(gain)) - 6, F.lit(0))
    return (shift * 32 + F.floor(gain / F.pow(F.lit(2.0), shift))).cast("bigint")


def first_shards(ids: DataFrame, edges: DataFrame, shards: int) -> DataFrame:
    """(_id, _shard) of even sizes, members of a star next to each other."""
    star = edges.groupBy(F.col("_b").alias("_id")).agg(F.min("_a").alias("_star"))
    # a bucket of stars and, within it, a part of the ids: a star of any size spreads over PARTS windows
    placed = ids.join(star, "_id", "left").select("_id", F.xxhash64(F.coalesce("_star", "_id")).alias("_h"))
    placed = placed.select("_id", "_h", (F.pmod("_h", F.lit(BUCKETS)) * PARTS + F.pmod(F.xxhash64("_id"), F.lit(PARTS))).alias("_bucket"))
    sizes = placed.groupBy("_bucket").count()
    running = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)  # BUCKETS * PARTS rows
    starts = sizes.select("_bucket", F.coalesce(F.sum("count").over(running), F.lit(0)).alias("_before"), F.sum("count").over(Window.partitionBy()).alias("_all"))
    rank = F.row_number().over(Window.partitionBy("_bucket").orderBy("_h", "_id")) - 1
    ranked = placed.withColumn("_rank", rank).join(starts, "_bucket")
    return ranked.select("_id", F.floor((F.col("_rank") + F.col("_before")) * shards / F.col("_all")).cast("int").alias("_shard"))


def propagate(ids: DataFrame, edges: DataFrame, scratch: Scratch, shards: int = SHARDS, rounds: int = ROUNDS, slack: float = SLACK) -> tuple[DataFrame, DataFrame]:
    """The final (_id, _shard), and the links in both directions (_a, _b, _w), as written tables."""
    both = scratch.table(edges.unionByName(edges.select(F.col("_b").alias("_a"), F.col("_a").alias("_b"), "_w")))
    state = scratch.table(first_shards(ids, edges, shards))
    n = state.count()
    capacity = max(-(-n // shards), int((1 + slack) * n / shards))
    for k in range(rounds):
        near = both.join(state.withColumnRenamed("_id", "_b"), "_b").groupBy("_a", "_shard").agg(F.sum("_w").alias("_w"))
        mine = near.join(state.select(F.col("_id").alias("_a"), F.col("_shard").alias("_now")), "_a").where(F.pmod(F.xxhash64("_a", F.lit(k)), F.lit(2)) == 0)
        best = mine.groupBy(F.col("_a").alias("_id")).agg(
            F.max(F.struct("_w", (F.col("_shard") == F.col("_now")).alias("_stay"), (-F.col("_shard")).alias("_s"))).alias("_m"), F.sum(F.when(F.col("_shard") == F.col("_now"), F.col("_w")).otherwise(0)).alias("_here")
        )
        wish = best.where("_m._w > _here").select("_id", (-F.col("_m._s")).alias("_to"), gain_class(F.col("_m._w") - F.col("_here")).alias("_gain"), F.pmod(F.xxhash64("_id"), F.lit(GROUPS)).alias("_g"))
        wish = scratch.table(wish)
        room = state.groupBy(F.col("_shard").alias("_to")).count().select("_to", (F.lit(capacity) - F.col("count")).alias("_room"))
        counted = wish.groupBy("_to", "_gain", "_g").count()
        upto = F.sum("count").over(Window.partitionBy("_to").orderBy(F.desc("_gain"), "_g"))
        admitted = counted.withColumn("_upto", upto).join(room, "_to", "left").where(F.col("_upto") <= F.coalesce("_room", F.lit(capacity))).select("_to", "_gain", "_g")
        moves = wish.join(admitted, ["_to", "_gain", "_g"]).select("_id", "_to")
        new = scratch.table(state.join(moves, "_id", "left").select("_id", F.coalesce("_to", "_shard").alias("_shard")))
        scratch.drop(state)
        scratch.drop(wish)
        state = new
    return state, both


def shards(docs: DataFrame, shards: int = SHARDS, rounds: int = ROUNDS, slack: float = SLACK, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, shard, links, cut_links) of every document: its shard, its links, and those of them that lead into other shards."""
    scratch = Scratch(docs.sparkSession)
    edges = scratch.table(links(docs, id_col, text_col))
    ids = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("_id")).distinct()
    state, both = propagate(ids, edges, scratch, shards, rounds, slack)
    ends = both.join(state.select(F.col("_id").alias("_a"), F.col("_shard").alias("_sa")), "_a").join(state.select(F.col("_id").alias("_b"), F.col("_shard").alias("_sb")), "_b")
    cut = ends.groupBy(F.col("_a").alias("_id")).agg(F.sum("_w").alias("_links"), F.sum(F.when(F.col("_sa") != F.col("_sb"), F.col("_w")).otherwise(0)).alias("_cut"))
    zero = F.lit(0).cast("bigint")
    out = state.join(cut, "_id", "left").select("_id", F.col("_shard").alias("shard"), F.coalesce("_links", zero).alias("links"), F.coalesce("_cut", zero).alias("cut_links"))
    out = scratch.table(out)
    scratch.close(out)
    return resting_on(out.withColumnRenamed("_id", id_col), out)
