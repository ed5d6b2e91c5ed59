"""Scalar functions over IRIs, literals and rows, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quadloom import model as m

NUL, TYPE_MARK = "\x00", "\x01"
STRING_MARK, IRI_MARK, OTHER_MARK = "\x03", "\x02", "\x08"


def local_name(iri: Column) -> Column:
    """What follows the last ``#``, ``/`` or ``:``; the whole IRI where nothing does."""
    tail = F.regexp_extract(iri, "([^#/:]+)$", 1)
    return F.when(tail == "", iri).otherwise(tail)


def valid_language(tag: Column) -> Column:
    return F.coalesce(tag.rlike("^[A-Za-z0-9]+(-[A-Za-z0-9]+)*$"), F.lit(False))


def object_data(o: Column, dt: Column, lang: Column) -> Column:
    """The lexical form as rows hold it: a language-tagged text carries ``@tag``, an invalid tag is ``und``."""
    return F.when(dt == m.LANG_STRING, F.concat(o, F.lit("@"), F.when(valid_language(lang), lang).otherwise(F.lit("und")))).otherwise(o)


def object_type(dt: Column) -> Column:
    """The marker that follows it."""
    mark = lambda x: F.lit(TYPE_MARK + x)
    return F.when(dt == m.STRING, mark(STRING_MARK)).when(dt == m.IRI, mark(IRI_MARK)).otherwise(F.concat(F.lit(TYPE_MARK), dt, F.lit(TYPE_MARK + OTHER_MARK)))


def encode_object(o: Column, dt: Column, lang: Column) -> Column:
    return F.concat(object_data(o, dt, lang), object_type(dt))


def decode_object(text: Column) -> Column:
    """STRUCT<o, o_dt, o_lang> of an encoded object; null where it isn't one."""
    mark = F.substring(text, -1, 1)
    plain = F.substring(text, F.lit(1), F.length(text) - 2)
    cut = F.instr(text, TYPE_MARK)
    data = F.substring(text, F.lit(1), cut - 1)
    dt = F.substring(text, cut + 1, F.length(text) - cut - 2)
    tag = F.regexp_extract(data, "@([A-Za-z0-9]+(?:-[A-Za-z0-9]+)*)$", 1)
    has_at = F.instr(data, "@") > 0
    is_lang = dt == m.LANG_STRING
    lex = F.when(is_lang & has_at, F.regexp_extract(data, "(?s)^(.*)@[^@]*$", 1)).otherwise(data)
    lang = F.when(is_lang, F.when(tag != "", tag).otherwise(F.lit("und"))).otherwise(F.lit(""))
    row = lambda o, t, g: F.struct(o.alias("o"), t.alias("o_dt"), g.alias("o_lang"))
    return F.when(mark == STRING_MARK, row(plain, F.lit(m.STRING), F.lit(""))).when(mark == IRI_MARK, row(plain, F.lit(m.IRI), F.lit(""))).when((mark == OTHER_MARK) & (cut > 1), row(lex, dt, lang))


def layout_row(layout: str, hashed: bool = False, s: str = "s", p: str = "p", o: str = "o", dt: str = "o_dt", lang: str = "o_lang") -> Column:
    """The row key of a statement in a layout (spo, po, osp); ``hashed`` puts the MD5 of the leading part first, which spreads writes."""
    data, kind, z = object_data(F.col(o), F.col(dt), F.col(lang)), object_type(F.col(dt)), F.lit(NUL)
    if layout == "spo":
        row, lead = F.concat(F.col(s), z, F.col(p), z, data, kind), F.col(s)
    elif layout == "po":
        row, lead = F.concat(F.col(p), z, data, z, F.col(s), kind), F.col(p)
    elif layout == "osp":
        return F.concat(data, z, F.col(s), z, F.col(p), kind)
    else:
        raise ValueError(f"no layout {layout}")
    return F.concat(F.md5(lead.cast("binary")), z, row) if hashed else row


def read_layout_row(row: Column, layout: str, hashed: bool = False) -> Column:
    """STRUCT<s, p, o, o_dt, o_lang>: cut at the first and the last NUL before the type marker, so data may hold NULs in between."""
    if hashed and layout != "osp":
        row = F.substring(row, F.lit(34), F.length(row))
    kind = F.regexp_extract(row, "(?s)(\x01[\x02\x03]|\x01[^\x01]*\x01\x08)$", 1)
    body = F.substring(row, F.lit(1), F.length(row) - F.length(kind))
    a, rest = F.substring_index(body, NUL, 1), F.substring(body, F.instr(body, NUL) + 1, F.length(body))
    c = F.substring_index(rest, NUL, -1)
    b = F.substring(rest, F.lit(1), F.length(rest) - F.length(c) - 1)
    order = {"spo": (a, b, c), "po": (c, a, b), "osp": (b, c, a)}[layout]
    if layout == "spo":  # subject and predicate hold no NUL, the object is all that follows them
        b = F.substring_index(rest, NUL, 1)
        order = (a, b, F.substring(rest, F.length(b) + 2, F.length(rest)))
    if layout == "osp":  # the object may hold NULs: subject and predicate are the last two parts
        p = F.substring_index(body, NUL, -1)
        head = F.substring(body, F.lit(1), F.length(body) - F.length(p) - 1)
        s = F.substring_index(head, NUL, -1)
        order = (s, p, F.substring(head, F.lit(1), F.length(head) - F.length(s) - 1))
    decoded = decode_object(F.concat(order[2], kind))
    return F.struct(order[0].alias("s"), order[1].alias("p"), decoded["o"].alias("o"), decoded["o_dt"].alias("o_dt"), decoded["o_lang"].alias("o_lang"))


def write_object(o: Column, dt: Column, lang: Column) -> Column:
    """An object in quotes with its datatype or language; an IRI as it is."""
    quoted = F.concat(F.lit('"'), o, F.lit('"'))
    return F.when(dt == m.IRI, o).when(F.coalesce(lang, F.lit("")) != "", F.concat(quoted, F.lit("@"), lang)).when(dt == m.STRING, quoted).otherwise(F.concat(quoted, F.lit("^^<"), dt, F.lit(">")))


def statement_text() -> Column:
    """Graph, subject, predicate and object, parted by NUL: what names a statement in the secondary indexes."""
    return F.concat_ws(NUL, F.coalesce("g", F.lit("")), F.col("s"), F.col("p"), write_object(F.col("o"), F.col("o_dt"), F.col("o_lang")))


def java_hash(text: Column) -> Column:
    """Signed 32-bit hash over UTF-16 units: h = 31 h + unit."""
    units = F.transform(F.split(F.regexp_replace(F.hex(F.encode(text, "UTF-16BE")), "(.{4})", "$1,"), ","), lambda h: F.conv(h, 16, 10).cast("bigint"))
    wrap = lambda x: F.pmod(x + 2147483648, F.lit(4294967296)) - 2147483648
    return F.aggregate(F.filter(units, lambda u: u.isNotNull()), F.lit(0).cast("bigint"), lambda h, u: wrap(h * 31 + u)).cast("int")


def shard(millis: Column, text: Column, base: int = 50) -> Column:
    """``yyyymmdd_n`` of a day and a text's hash, the day alone without a text."""
    day = F.date_format(F.timestamp_millis(millis), "yyyyMMdd")
    return F.when(text.isNull(), day).otherwise(F.concat(day, F.lit("_"), F.abs(java_hash(text).cast("bigint") % base).cast("string")))


def split_shard(value: Column, delimiter: str = "_") -> Column:
    """STRUCT<day, n>, cut at the last delimiter; null without one."""
    n = F.substring_index(value, delimiter, -1)
    day = F.substring(value, F.lit(1), F.length(value) - F.length(n) - len(delimiter))
    return F.when(F.instr(value, delimiter) > 0, F.struct(day.alias("day"), n.alias("n")))


def embed_key(value: Column) -> Column:
    """What stands before the first ``\\x01``."""
    return F.substring_index(value, TYPE_MARK, 1)


def _sign_flipped(value: Column, digits: int) -> Column:
    flip = {16: -(1 << 63), 8: 1 << 31}[digits]
    flipped = value.cast("bigint").bitwiseXOR(F.lit(flip))
    return F.lower(F.lpad(F.hex(flipped if digits == 16 else flipped.bitwiseAND(F.lit(0xFFFFFFFF))), digits, "0"))


def upgrade_key(o: Column, mark: Column) -> Column:
    """Sortable hex of an old-style literal by its type marker: 10 boolean, 9 byte, 4 long, 5 int, 6 double, 7 date; null where it can't be read."""
    digits = o.rlike(r"^[+-]?\d+$")
    small = F.when(digits, o.try_cast("tinyint"))
    date = F.when(o.rlike(r"^\d+$"), o.try_cast("bigint"))
    exponent = F.substring(o, 3, 3).try_cast("int")
    e = F.when(F.substring(o, 2, 1) == "-", 999 - exponent).otherwise(exponent)
    number = F.concat(F.substring(o, 1, 1), F.substring(o, F.lit(7), F.length(o)), F.lit("E"), F.substring(o, 2, 1), e.cast("string")).try_cast("double")
    double = F.when(o == "00001 1.0", F.lit("c024000000000000")).otherwise(double_key(number))
    return (
        F.when(mark == 10, F.when(o == "true", "1").otherwise("0"))
        .when(mark == 9, F.lower(F.lpad(F.hex(small.cast("int").bitwiseAND(F.lit(255))), 2, "0")))
        .when(mark == 4, _sign_flipped(F.when(digits, o.try_cast("bigint")), 16))
        .when(mark == 5, _sign_flipped(F.when(digits, o.try_cast("int")), 8))
        .when(mark == 6, double)
        .when(mark == 7, _sign_flipped(F.lit((1 << 63) - 1) - date, 16))
    )


def double_key(x: Column) -> Column:
    """Hex that sorts as the doubles do: the sign bit flipped for positive ones, all bits for negative ones.

    Built from exponent and mantissa, as there is no built-in that shows a double's bits;
    normal numbers and zero only, others are null.
    """
    a = F.abs(x)
    e = F.floor(F.log2(a))
    e = e + F.when(a / F.pow(F.lit(2.0), e) >= 2, 1).when(a / F.pow(F.lit(2.0), e) < 1, -1).otherwise(0)
    mantissa = ((a / F.pow(F.lit(2.0), e) - 1) * F.lit(float(1 << 52))).cast("bigint")
    bits = F.when(a == 0, F.lit(0).cast("bigint")).when(e.between(-1022, 1023), (e.cast("bigint") + 1023) * F.lit(1 << 52) + mantissa)
    key = F.when(x < 0, bits.bitwiseXOR(F.lit((1 << 63) - 1))).otherwise(bits.bitwiseXOR(F.lit(-(1 << 63))))
    return F.lower(F.lpad(F.hex(key), 16, "0"))


def upgrade_osp_row(row: Column) -> Column:
    """An object-first row with its old-style object replaced by the sortable form."""
    mark = F.ascii(F.substring(row, -1, 1))
    upgraded = upgrade_key(F.substring_index(row, NUL, 1), mark)
    return F.concat(upgraded, F.substring(row, F.instr(row, NUL), F.length(row)))


def binding_text(names: list[str], order: str) -> Column:
    """A row of bindings as text in the order ``a;b;c`` of variables; a variable without a binding is NUL."""
    wanted = order.split(";")
    if sorted(wanted) != sorted(names):
        raise ValueError(f"{order} is no order of {names}")
    one = lambda v: F.when(F.col(v).isNull(), F.lit(NUL)).otherwise(F.concat(F.col(v), F.lit("<<~>>"), F.col(f"{v}__dt")))
    return F.concat_ws(":::", *[one(v) for v in wanted])


def orders(names: list[str]) -> list[str]:
    """Cyclic shifts: for each variable one order that begins with it."""
    return [";".join(names[i:] + names[:i]) for i in range(len(names))]


def slug(text: Column) -> Column:
    """Lower case, everything else than letters and digits one dash."""
    return F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def pascal(text: Column) -> Column:
    words = F.filter(F.split(text, "[^A-Za-z0-9]+"), lambda w: w != "")
    return F.array_join(F.transform(words, lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, F.lit(2), F.length(w)))), "")


def pig_tuple() -> list[Column]:
    """Seven columns of a statement: its four parts and the datatypes of three."""
    return [F.col("s"), F.col("p"), F.col("o"), F.coalesce("g", F.lit("")).alias("g"), F.lit(m.IRI).alias("s_type"), F.lit(m.IRI).alias("p_type"), F.col("o_dt").alias("o_type")]


def result_json() -> Column:
    """A result row as JSON text."""
    return F.to_json(F.struct(F.col("s").alias("subject"), F.col("p").alias("predicate"), F.col("o").alias("object"), F.col("o_dt").alias("objectType"), F.coalesce("g", F.lit("")).alias("context"), F.coalesce("vis", F.lit("")).alias("visibility"), F.col("ts").alias("timestamp")))


def add_calendar(millis: Column, years: int = 0, months: int = 0, days: int = 0, hours: int = 0, minutes: int = 0, seconds: int = 0) -> Column:
    """Offsets with months of 31 and years of 365 days."""
    total = ((years * 365 + months * 31 + days) * 86400 + hours * 3600 + minutes * 60 + seconds) * 1000
    return millis + F.lit(total)


def end_location(lon: Column, lat: Column, km: Column, bearing: Column) -> Column:
    """STRUCT<lon, lat> at a distance and bearing on a sphere of 6371 km."""
    a, b, t, d = F.radians(lon), F.radians(lat), F.radians(bearing), km / 6371.0
    lat2 = F.asin(F.sin(b) * F.cos(d) + F.cos(b) * F.sin(d) * F.cos(t))
    lon2 = a + F.atan2(F.sin(t) * F.sin(d) * F.cos(b), F.cos(d) - F.sin(b) * F.sin(lat2))
    wrapped = F.pmod(lon2 + F.pi(), F.lit(2.0) * F.pi()) - F.pi()
    ok = ~F.isnan(lat2) & ~F.isnan(wrapped)
    return F.when(ok, F.struct(F.degrees(wrapped).alias("lon"), F.degrees(lat2).alias("lat")))
