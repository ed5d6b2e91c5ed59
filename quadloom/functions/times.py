"""Times as text: xsd:dateTime in UTC milliseconds, RFC 3339 keys in UTC seconds, intervals."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

_FULL = r"^(-?\d{4,})-(\d{2})-(\d{2})(?:T(?:(\d{2}):(\d{2}):(\d{2})(?:\.(\d+))?)?)?\s*(Z|[+-]\d{2}:?\d{2})?$"
_ZONE = r"(Z|[+-]\d{2}:\d{2})"
_RFC = r"^(\d{4})-(\d{2})-(\d{2})[Tt](\d{2}):(\d{2}):(\d{2})(\.\d+)?([Zz]|[+-]\d{2}:\d{2})$"


def _days(y: int, mo: int, d: int) -> int:
    y -= mo <= 2
    era, yoe = y // 400, y % 400
    doy = (153 * (mo + (-3 if mo > 2 else 9)) + 2) // 5 + d - 1
    return era * 146097 + yoe * 365 + yoe // 4 - yoe // 100 + doy - 719468


def _civil(days: int) -> tuple[int, int, int]:
    z = days + 719468
    era, doe = z // 146097, z % 146097
    yoe = (doe - doe // 1460 + doe // 36524 - doe // 146096) // 365
    doy = doe - (365 * yoe + yoe // 4 - yoe // 100)
    mp = (5 * doy + 2) // 153
    month = mp + 3 if mp < 10 else mp - 9
    return yoe + era * 400 + (month <= 2), month, doy - (153 * mp + 2) // 5 + 1


def normalise_text(text: str | None, default_minutes: int = 0) -> str | None:
    """One value, of any year; None where it is no date or dateTime."""
    got = re.match(_FULL, text) if text is not None else None
    if not got:
        return None
    y, mo, d = int(got[1]), int(got[2]), int(got[3])
    h, mi, s = (int(x or 0) for x in got.group(4, 5, 6))
    length = [31, 29 if y % 4 == 0 and (y % 100 != 0 or y % 400 == 0) else 28, 31, 30, 31, 30, 31, 31, 30, 31, 30, 31]
    if not (1 <= mo <= 12 and 1 <= d <= length[mo - 1] and h <= 24 and mi < 60 and s < 60) or (h == 24 and (mi or s)):
        return None
    zone = got[8]
    minutes = default_minutes if zone is None else 0 if zone == "Z" else (1 if zone[0] == "+" else -1) * (int(zone[1:3]) * 60 + int(zone[-2:]))
    total = (_days(y, mo, d) * 1440 + h * 60 + mi - minutes) * 60 + s
    y, mo, d = _civil(total // 86400)
    rest = total % 86400
    year = f"{y:04d}" if y >= 0 else f"-{-y:04d}"
    return f"{year}-{mo:02d}-{d:02d}T{rest // 3600:02d}:{rest // 60 % 60:02d}:{rest % 60:02d}.{(got[7] or '')[:3]:0<3}Z"


def normalise(c: Column, default_minutes: int = 0) -> Column:
    """Date or dateTime text to ``YYYY-MM-DDThh:mm:ss.SSSZ`` in UTC; fractions are cut, not rounded; null where it can't be read.

    Years 1 to 9999 stay in the JVM; an Arrow UDF has the others to do.
    """
    text = F.regexp_replace(c, r"\s+", "")
    part = lambda k: F.regexp_extract(text, _FULL, k)
    ok = text.rlike(_FULL)
    or_zero = lambda k: F.when(part(k) == "", "00").otherwise(part(k))
    zone = part(8)
    sign = F.when(F.substring(zone, 1, 1) == "-", -1).otherwise(1)
    digits = F.regexp_replace(zone, r"[^\d]", "")
    minutes = F.when(zone == "", F.lit(default_minutes)).when(zone == "Z", 0).otherwise(sign * (F.substring(digits, 1, 2).try_cast("int") * 60 + F.substring(digits, 3, 2).try_cast("int")))
    midnight = part(4) == "24"
    local = F.try_to_timestamp(F.concat(part(1), F.lit("-"), part(2), F.lit("-"), part(3), F.lit(" "), F.when(midnight, "00").otherwise(or_zero(4)), F.lit(":"), or_zero(5), F.lit(":"), or_zero(6)), F.lit("yyyy-MM-dd HH:mm:ss"))
    seconds = F.unix_seconds(local) - minutes * 60 + F.when(midnight & (or_zero(5) == "00") & (or_zero(6) == "00"), 86400).when(midnight, None).otherwise(0)
    utc = F.date_format(F.timestamp_seconds(seconds), "yyyy-MM-dd'T'HH:mm:ss")
    inside = ok & part(1).rlike(r"^\d{4}$") & part(1).between("0002", "9998")

    @F.pandas_udf("string")
    def other(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: normalise_text(t, default_minutes))

    return F.when(inside, F.concat(utc, F.lit("."), F.rpad(F.substring(part(7), 1, 3), 3, "0"), F.lit("Z"))).otherwise(other(F.when(~inside, text)))


def rfc_key(c: Column) -> Column:
    """RFC 3339 to ``YYYY-MM-DDThh:mm:ssZ`` in UTC, a fraction cut; null where it isn't one."""
    ok = c.rlike(_RFC)
    local = F.try_to_timestamp(F.concat(F.substring(c, 1, 10), F.lit(" "), F.substring(c, 12, 8)), F.lit("yyyy-MM-dd HH:mm:ss"))
    zone = F.regexp_extract(c, _RFC, 8)
    hours, minutes = F.substring(zone, 2, 2).try_cast("int"), F.substring(zone, 5, 2).try_cast("int")
    shift = F.when(F.upper(zone) == "Z", 0).otherwise(F.when(F.substring(zone, 1, 1) == "-", -1).otherwise(1) * (hours * 60 + minutes) * 60)
    return F.when(ok, F.date_format(F.timestamp_seconds(F.unix_seconds(local) - shift), "yyyy-MM-dd'T'HH:mm:ss'Z'"))


def _bound(c: Column, use) -> Column:
    """``use`` of a value that is computed once, however often it is used: generated code would repeat it."""
    return F.transform(F.array(c), use)[0]


def interval(c: Column) -> Column:
    """STRUCT<begin, end> of the keys of ``[a,b]``; null where it isn't one or ends before it begins."""
    part = lambda k: F.regexp_extract(c, r"^\[([^,\]]*),([^\]]*)\]$", k)
    keys = F.transform(F.array(part(1), part(2)), rfc_key)
    return _bound(keys, lambda k: F.when(k[0].isNotNull() & k[1].isNotNull() & (k[0] <= k[1]), F.struct(k[0].alias("begin"), k[1].alias("end"))))


def marker(c: Column, end_of_day: bool = False) -> Column:
    """Key of an instant or a date; a date as an end is its last second."""
    late = F.lit("T23:59:59Z" if end_of_day else "T00:00:00Z")
    date = lambda x: F.when(x.rlike(r"^\d{4}-\d{2}-\d{2}$") & F.try_to_timestamp(x, F.lit("yyyy-MM-dd")).isNotNull(), F.concat(x, late))
    return _bound(c, lambda x: F.coalesce(rfc_key(x), date(x)))


def date_millis(c: Column) -> Column:
    """Epoch milliseconds of a date or of a ``Z`` timestamp with a fraction or none; null otherwise."""
    day = F.when(c.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.unix_millis(F.try_to_timestamp(c, F.lit("yyyy-MM-dd"))))
    full = r"^(\d{4}-\d{2}-\d{2})T(\d{2}:\d{2}:\d{2})(?:\.(\d*))?Z$"
    seconds = F.unix_seconds(F.try_to_timestamp(F.concat(F.regexp_extract(c, full, 1), F.lit(" "), F.regexp_extract(c, full, 2)), F.lit("yyyy-MM-dd HH:mm:ss")))
    millis = F.rpad(F.substring(F.regexp_extract(c, full, 3), 1, 3), 3, "0").try_cast("bigint")
    return F.coalesce(day, F.when(c.rlike(full), seconds * 1000 + millis))
