"""Delimited records as maps, the filter language over them, conversions."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from quadloom.functions import times

PAIR, VALUE = "\x00", "�"


def parse_record(text: Column, pair: str = PAIR, value: str = VALUE) -> Column:
    """MAP<STRING, STRING> of ``key VALUE value PAIR key ...``, trimmed.

    A value ends at the nearest delimiter of either kind; a piece without a
    value delimiter gives no field, and what is left of it is read with the
    piece after it as a key. Of repeated keys the last counts.
    """
    if len(pair) != 1 or len(value) != 1:
        raise ValueError("delimiters are single characters")
    pieces = F.split(text, re.escape(pair))

    # a piece without a value delimiter is carried into the next piece's key
    state = F.struct(F.lit("").alias("carry"), F.array().cast("array<struct<key:string,value:string>>").alias("out"))

    def step(acc: Column, piece: Column) -> Column:
        cut = F.instr(piece, value)
        key = F.concat(acc["carry"], F.substring(piece, F.lit(1), cut - 1))
        rest = F.substring(piece, cut + 1, F.length(piece))
        field = F.struct(F.trim(key).alias("key"), F.trim(F.substring_index(rest, value, 1)).alias("value"))
        return F.when(cut == 0, F.struct(F.concat(acc["carry"], piece, F.lit(pair)).alias("carry"), acc["out"].alias("out"))).otherwise(F.struct(F.lit("").alias("carry"), F.concat(acc["out"], F.array(field)).alias("out")))

    fields = F.aggregate(pieces, state, step)["out"]
    # the last of a key: those followed by no field of the same key
    numbered = F.transform(fields, lambda f, i: F.struct(f["key"].alias("key"), f["value"].alias("value"), i.alias("i")))
    last = F.filter(numbered, lambda f: ~F.exists(numbered, lambda h: (h["key"] == f["key"]) & (h["i"] > f["i"])))
    return F.map_from_entries(F.transform(last, lambda f: F.struct(f["key"], f["value"])))


def write_record(fields: Column, pair: str = PAIR, value: str = VALUE) -> Column:
    """Text of a map, in order of keys."""
    return F.array_join(F.transform(F.array_sort(F.map_entries(fields)), lambda e: F.concat(e["key"], F.lit(value), e["value"])), pair)


def number(c: Column) -> Column:
    return F.when(c == F.trim(c), c.try_cast("double"))


def _get(fields: Column, name: str) -> Column:
    return F.coalesce(fields[name], F.lit(""))


def compare(fields: Column, name: str, op: str, literal: str) -> Column:
    """Numbers if both sides are, else texts; a missing field is the empty text."""
    ops = {"eq": lambda a, b: a == b, "ne": lambda a, b: a != b, "gt": lambda a, b: a > b, "gte": lambda a, b: a >= b, "lt": lambda a, b: a < b, "lte": lambda a, b: a <= b}
    v = _get(fields, name)
    as_text = ops[op](v, F.lit(literal))
    try:
        n = float(literal)
    except ValueError:
        return as_text
    return F.when(number(v).isNotNull(), ops[op](number(v), F.lit(n))).otherwise(as_text)


def between(fields: Column, name: str, low: str, high: str) -> Column:
    v = _get(fields, name)
    as_text = v.between(low, high)
    try:
        a, b = float(low), float(high)
    except ValueError:
        return as_text
    return F.when(number(v).isNotNull(), number(v).between(a, b)).otherwise(as_text)


def like(fields: Column, name: str, pattern: str) -> Column:
    """``*`` stands for anything, case doesn't count; anchored at the start only."""
    parts = [re.escape(p) for p in pattern.split("*") if p]
    if not parts:
        return F.lit(True)
    return _get(fields, name).rlike("(?is)" + ("" if pattern.startswith("*") else "^") + ".*?".join(parts))


def bbox(fields: Column, min_lon: float, min_lat: float, max_lon: float, max_lat: float) -> Column:
    """Within a box; a longitude is moved by whole turns into it where it can be."""
    degree = lambda names: F.coalesce(*[F.when(fields[n] != "-", number(fields[n])) for n in names])
    lon, lat = degree(["lonself", "lon", "long", "longitude"]), degree(["latself", "lat", "latitude"])
    up = F.when(lon < min_lon, lon + F.ceil((F.lit(min_lon) - lon) / 360.0) * 360.0).otherwise(lon)
    moved = F.when(up > max_lon, up - F.ceil((up - F.lit(max_lon)) / 360.0) * 360.0).otherwise(up)
    return F.coalesce(moved.between(min_lon, max_lon) & lat.between(min_lat, max_lat), F.lit(False))


class _Reader:
    def __init__(self, text: str):
        self.text, self.at = text, 0

    def space(self) -> None:
        while self.at < len(self.text) and self.text[self.at].isspace():
            self.at += 1

    def need(self, ch: str) -> None:
        self.space()
        if self.text[self.at : self.at + 1] != ch:
            raise ValueError(f"{ch} expected at {self.at} of {self.text!r}")
        self.at += 1

    def value(self) -> str:
        self.space()
        got = re.compile(r'"([^"]*)"|([^,)]+)').match(self.text, self.at)
        if not got:
            raise ValueError(f"a value expected at {self.at} of {self.text!r}")
        self.at = got.end()
        return got[1] if got[1] is not None else got[2].strip()

    def values(self, n: int) -> list[str]:
        out = [self.value()]
        for _ in range(n - 1):
            self.need(",")
            out.append(self.value())
        return out

    def operation(self, fields: Column) -> Column:
        self.space()
        got = re.compile(r"\w+").match(self.text, self.at)
        if not got:
            raise ValueError(f"an operation expected at {self.at} of {self.text!r}")
        name, self.at = got[0].lower(), got.end()
        self.need("(")
        if name in ("and", "or"):
            parts = [self.operation(fields)]
            self.space()
            while self.text[self.at : self.at + 1] == ",":
                self.need(",")
                parts.append(self.operation(fields))
                self.space()
            out = reduce((lambda a, b: a & b) if name == "and" else (lambda a, b: a | b), parts)
        elif name == "not":
            out = ~self.operation(fields)
        elif name in ("eq", "ne", "gt", "gte", "lt", "lte"):
            field, literal = self.values(2)
            out = compare(fields, field, name, literal)
        elif name == "between":
            out = between(fields, *self.values(3))
        elif name == "like":
            out = like(fields, *self.values(2))
        elif name == "is_null":
            out = _get(fields, self.value()) == ""
        elif name == "bbox":
            out = bbox(fields, *map(float, self.values(4)))
        else:
            raise ValueError(f"no operation {name}")
        self.need(")")
        return out


def ogc(text: str, fields: Column) -> Column:
    """The condition that a filter text such as ``and(eq(a,1),like(b,"x*"))`` stands for."""
    reader = _Reader(text)
    out = reader.operation(fields)
    reader.space()
    if reader.at != len(text):
        raise ValueError(f"nothing expected after {text[: reader.at]!r}")
    return F.coalesce(out, F.lit(False))


def frequency(fields: Column, at: float) -> Column:
    """Whether a band, by its centre and width, holds a frequency."""
    c, w = number(fields["frequency"]), number(fields["bandwidth"])
    return F.coalesce((c - w / 2 <= at) & (F.lit(at) <= c + w / 2), F.lit(False))


def date_valid(fields: Column, at: str = "2011-03-03T20:44:28.633Z") -> Column:
    """Strictly after the start and before the end, if there is one; version 0 is never valid."""
    now, a, b = times.date_millis(F.lit(at)), times.date_millis(fields["date-start"]), times.date_millis(fields["date-end"])
    active = F.coalesce(fields["version"] != "0", F.lit(True))
    return active & F.coalesce((a < now) & (b.isNull() | (now < b)), F.lit(False))


def time_range(ts: Column, start: int, span: int) -> Column:
    """At most ``span`` before ``start`` and not after it."""
    return (F.lit(start) - ts).between(0, span)


def convert(value: Column, config: str) -> Column:
    """``field op number`` applied to a value: a number, or else hexadecimal; whole results end in ``.0``."""
    parts = config.removeprefix("conversion.").split()
    if len(parts) != 3 or parts[1][0] not in "+-*/%^":
        raise ValueError(f"'field op number' expected, not {config!r}")
    operand = float(parts[2])
    as_hex = F.when(value.rlike("^[+-]?[0-9A-Fa-f]{1,15}$"), F.conv(F.regexp_replace(value, "^[+-]", ""), 16, 10).cast("double") * F.when(value.startswith("-"), -1).otherwise(1))
    v = F.coalesce(number(value), as_hex)
    apply = {"+": lambda: v + operand, "-": lambda: v - operand, "*": lambda: v * operand, "/": lambda: F.try_divide(v, F.lit(operand)), "%": lambda: v % F.lit(operand), "^": lambda: F.pow(v, F.lit(operand))}
    out = apply[parts[1][0]]()
    whole = F.concat(out.cast("decimal(38,0)").cast("string"), F.lit(".0"))
    return F.when(out == F.floor(out), whole).otherwise(out.cast("string"))
