"""Geometries in well-known text: points, lines and polygons with holes; containment by the even-odd rule.

A geometry is STRUCT<kind, ext: ARRAY<STRUCT<x, y>>, holes: ARRAY<ARRAY<STRUCT<x, y>>>>, parsed and tested in the JVM.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quadloom import model as m

_NUMBER = r"[+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?"
_PAIR = rf"\s*{_NUMBER}\s+{_NUMBER}\s*"
_RING = rf"\(\s*{_PAIR}(?:,{_PAIR})*\)"
_WKT = rf"(?i)^\s*(?:POINT\s*\({_PAIR}\)|LINESTRING\s*{_RING}|POLYGON\s*\(\s*{_RING}(?:\s*,\s*{_RING})*\s*\))\s*$"
#: Everything, short of the antimeridian.
SAFE_WORLD = "POLYGON((-180 -90, 179 -90, 179 90, -180 90, -180 -90))"


def _points(text: Column) -> Column:
    def point(pair: Column) -> Column:
        xy = F.split(F.trim(pair), r"\s+")
        return F.struct(xy[0].try_cast("double").alias("x"), xy[1].try_cast("double").alias("y"))

    return F.transform(F.split(F.regexp_replace(text, r"[()]", ""), ","), point)


def parse(wkt: Column) -> Column:
    """The geometry; null where the text is none."""
    kind = F.upper(F.regexp_extract(wkt, r"^\s*([A-Za-z]+)", 1))
    rings = F.transform(F.regexp_extract_all(wkt, F.lit(r"(\([^()]*\))"), 1), _points)
    geometry = F.struct(kind.alias("kind"), rings[0].alias("ext"), F.slice(rings, 2, F.greatest(F.size(rings) - 1, F.lit(0))).alias("holes"))
    return F.when(wkt.rlike(_WKT), geometry)


def polygon(wkt: str) -> list[list[tuple[float, float]]]:
    """Rings of a literal polygon, the first one outside."""
    if not re.match(_WKT, wkt) or not wkt.strip().upper().startswith("POLYGON"):
        raise ValueError(f"no polygon: {wkt}")
    return [[tuple(map(float, p.split())) for p in ring.split(",")] for ring in re.findall(r"\(([^()]+)\)", wkt)]


def in_ring(x: Column, y: Column, ring: list[tuple[float, float]]) -> Column:
    """Even-odd by a ray, half open: a point on a lower or left edge is inside, on others outside."""
    edges = list(zip(ring, ring[-1:] + ring[:-1]))
    crossings = F.lit(False)
    for (xi, yi), (xj, yj) in edges:
        if yi == yj:
            continue
        hit = ((F.lit(yi) > y) != (F.lit(yj) > y)) & (x < F.lit(xj - xi) * (y - F.lit(yi)) / F.lit(yj - yi) + F.lit(xi))
        crossings = crossings != hit
    return crossings


def in_polygon(x: Column, y: Column, rings: list[list[tuple[float, float]]]) -> Column:
    xs, ys = [p[0] for p in rings[0]], [p[1] for p in rings[0]]
    box = x.between(min(xs), max(xs)) & y.between(min(ys), max(ys))  # cheap test first
    inside = in_ring(x, y, rings[0])
    for hole in rings[1:]:
        inside = inside & ~in_ring(x, y, hole)
    return box & inside


def index(quads: DataFrame, predicates: list[str] | None = None) -> DataFrame:
    """Statements with a geometry ``geom``; what can't be read is left out."""
    df = quads.where(F.col("o_dt") != m.IRI)
    if predicates:
        df = df.where(F.col("p").isin(predicates))
    return df.withColumn("geom", parse(F.col("o"))).where("geom is not null")


def within(indexed: DataFrame, wkt: str) -> DataFrame:
    """Statements whose every coordinate is inside the polygon; of a polygon its outer ring counts."""
    rings = polygon(wkt)
    return indexed.where(F.forall("geom.ext", lambda p: in_polygon(p["x"], p["y"], rings)))


def equals(indexed: DataFrame, wkt: str) -> DataFrame:
    """Statements with the very same geometry."""
    other = parse(F.lit(wkt))
    return indexed.where(F.col("geom") == other)
