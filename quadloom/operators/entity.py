"""Entity-centric rows: everything about a node in one place, as subject and as object."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadloom.functions.values import NUL, decode_object, encode_object, object_data, object_type


def rows(quads: DataFrame) -> DataFrame:
    """(row, family, qualifier, vis, val, ts): two for each statement. The qualifier names graph, the other end's role and the other end."""
    data, kind = object_data(F.col("o"), F.col("o_dt"), F.col("o_lang")), object_type(F.col("o_dt"))
    g = F.coalesce("g", F.lit(""))
    one = lambda row, role, other: F.struct(row.alias("row"), F.col("p").alias("family"), F.concat(g, F.lit(NUL + role + NUL), other).alias("qualifier"), F.coalesce("vis", F.lit("")).alias("vis"), F.col("val"), F.col("ts"))
    both = F.array(one(F.col("s"), "object", encode_object(F.col("o"), F.col("o_dt"), F.col("o_lang"))), one(data, "subject", F.concat(F.col("s"), kind)))
    return quads.select(F.explode(both).alias("e")).select("e.*")


def decode(entity_rows: DataFrame) -> DataFrame:
    """(s, p, o, o_dt, o_lang, g, vis, ts) back from either kind of row."""
    part = lambda k: F.regexp_extract("qualifier", f"(?s)^([^{NUL}]*){NUL}(object|subject){NUL}(.*)$", k)
    other, by_subject = part(3), part(2) == "object"
    kind = F.regexp_extract(other, "(?s)(\x01[\x02\x03]|\x01[^\x01]*\x01\x08)$", 1)
    subject = F.when(by_subject, F.col("row")).otherwise(F.substring(other, F.lit(1), F.length(other) - F.length(kind)))
    decoded = decode_object(F.when(by_subject, other).otherwise(F.concat(F.col("row"), kind)))
    g = F.when(part(1) != "", part(1))
    return entity_rows.select(subject.alias("s"), F.col("family").alias("p"), decoded["o"].alias("o"), decoded["o_dt"].alias("o_dt"), decoded["o_lang"].alias("o_lang"), g.alias("g"), "vis", "ts")


def delete(entity_rows: DataFrame, gone: DataFrame) -> DataFrame:
    """Without both rows of each statement of ``gone``."""
    keys = rows(gone).select("row", "family", "qualifier", "vis").distinct()
    return entity_rows.join(keys, ["row", "family", "qualifier", "vis"], "left_anti")
