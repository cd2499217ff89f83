"""Text to numbers and times, null where the text is not one.

Columns are text as found in logs.  Times are micros since 1970 (BIGINT, UTC)
wherever they are computed with.
"""

from __future__ import annotations

import string
import unicodedata
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: GPS time: micros of its epoch (1980-01-06), leap seconds taken off (fixed values).
GPS_EPOCH_US = 315_964_800_000_000
LEAP_SECONDS = 18
US = 1_000_000

_BLANK = r"[\s\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
_FLOAT = r"^[+-]?(\d+(_\d+)*\.?(\d+(_\d+)*)?|\.\d+(_\d+)*)([eE][+-]?\d+(_\d+)*)?$"
_SPECIAL = r"(?i)^[+-]?(nan|inf|infinity)$"


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed, and planned, once: an expression that
    names its input many times would else hold as many copies of it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def strip(text: Column) -> Column:
    """Without white space at both ends, of whatever kind; most texts begin and end
    with a printable ASCII character and are left alone at once."""
    clean = F.substring(text, 1, 1).between("!", "~") & F.substring(text, -1, 1).between("!", "~")
    return F.when(clean, text).otherwise(F.regexp_replace(F.regexp_replace(text, f"^{_BLANK}+", ""), f"{_BLANK}+\\z", ""))


def parse_float(text: Column) -> Column:
    """The number that the stripped text spells, else null.  Spellings such as
    ``1d`` that only the JVM knows are no numbers; ``1_0`` is 10."""

    def number(t: Column) -> Column:
        special = F.lower(F.regexp_replace(t, r"^\+", ""))
        odd = F.when(special.endswith("nan"), F.lit(float("nan"))).when(special.startswith("-"), F.lit(float("-inf"))).otherwise(F.lit(float("inf")))
        return F.when(t.rlike(_FLOAT), F.regexp_replace(t, "_", "").try_cast("double")).when(t.rlike(_SPECIAL), odd)

    return bound(bound(text.cast("string"), strip), number)


def parse_time_us(text: Column) -> Column:
    """The number truncated toward zero, else null."""
    return bound(parse_float(text), lambda v: F.when(~F.isnan(v), v.try_cast("bigint")))


def gps_to_utc_us(week: Column, ms: Column) -> Column:
    """Micros since 1970 of a GPS week and its milliseconds; null if not numeric."""
    w, m = parse_float(week), parse_float(ms)
    return (F.lit(GPS_EPOCH_US) + F.bround(w * (604_800 * US)).cast("bigint") + F.bround(m * 1000).cast("bigint") - LEAP_SECONDS * US).cast("bigint")


def utc_text(us: Column) -> Column:
    """``yyyy-MM-dd HH:mm:ss.ffffff``; empty text for null."""
    return F.coalesce(F.date_format(F.timestamp_micros(us), "yyyy-MM-dd HH:mm:ss.SSSSSS"), F.lit(""))


def parse_dt_us(text: Column) -> Column:
    """Micros of ``yyyy-MM-dd HH:mm:ss[.ffffff]`` or an ISO-8601 date (time optional),
    else null.  Text without a zone is UTC; a zone in the text is dropped, not
    applied, as naive times are compared throughout."""
    return bound(bound(text.cast("string"), strip), _dt_us)


def _dt_us(t: Column) -> Column:
    """Micros of a stripped text."""
    iso = r"^(\d{4})-(\d{2})-(\d{2})(?:.(\d{2})(?::(\d{2})(?::(\d{2})(?:[.,](\d{1,6})\d*)?)?)?(?:Z|[+-]\d{2}(?::?\d{2})?)?)?$"
    compact = r"^(\d{4})(\d{2})(\d{2})$"
    loose = r"^(\d{4})-(\d{1,2})-(\d{1,2})\s+(\d{1,2}):(\d{1,2}):(\d{1,2})(?:\.(\d{1,6}))?$"

    def part(pattern: str, k: int) -> Column:
        return F.regexp_extract(t, pattern, k)

    def number(pattern: str, k: int) -> Column:
        return F.coalesce(part(pattern, k).try_cast("int"), F.lit(0))

    def fields(pattern: str, clock: bool = True) -> Column:
        day = F.concat_ws("-", part(pattern, 1), F.lpad(part(pattern, 2), 2, "0"), F.lpad(part(pattern, 3), 2, "0")).try_cast("date")
        h, m, s = (number(pattern, k) if clock else F.lit(0) for k in (4, 5, 6))
        micro = F.coalesce(F.rpad(part(pattern, 7), 6, "0").try_cast("bigint"), F.lit(0).cast("bigint")) if clock else F.lit(0).cast("bigint")
        us = F.unix_date(day).cast("bigint") * (86_400 * US) + (h.cast("bigint") * 3600 + m * 60 + s) * US + micro
        return F.when((h < 24) & (m < 60) & (s < 60), us)

    return F.when(t.rlike(loose), fields(loose)).when(t.rlike(iso), fields(iso)).when(t.rlike(compact), fields(compact, clock=False))


def first_non_empty(*columns: Column) -> Column:
    """The first that is neither null nor empty, else null."""
    return F.coalesce(*[F.when(c != "", c) for c in columns])


def is_plain_ascii(line: Column) -> Column:
    """All ASCII and no NUL."""
    return line.rlike(r"^[\x01-\x7F]*\z")


def file_stamp_us(path: Column, offset_hours: float | Column = 3.0) -> Column:
    """Start time from the first ``YYYY_MMDD_HHMMSS`` in a file's base name, taken as
    local time ``offset_hours`` ahead of UTC; null without one.  A date that does
    not exist is an error."""
    base = F.regexp_extract(path, r"([^/]*)$", 1)
    pattern = r"(\d{4})_(\d{2})(\d{2})_(\d{2})(\d{2})(\d{2})"
    y, mo, d, h, mi, s = (F.regexp_extract(base, pattern, k).try_cast("int") for k in range(1, 7))
    hours = offset_hours if isinstance(offset_hours, Column) else F.lit(float(offset_hours))
    local = F.unix_micros(F.make_timestamp(y, mo, d, h, mi, s.cast("decimal(8,6)")))
    return F.when(base.rlike(pattern), local - F.bround(hours * (3600 * US)).cast("bigint"))


#: Characters that a file name may hold (fixed values).
_IN_NAMES = frozenset(string.ascii_letters + string.digits + "._-")


def sanitize_text(text: str | None) -> str | None:
    """A file name from any text: letters lose their accents, each run of other odd
    ASCII characters becomes one ``_``, what is not ASCII goes; ``_`` and ``.`` at the
    ends go, too, and ``log`` stands for nothing."""
    if text is None:
        return None
    name: list[str] = []
    gap = False
    for char in unicodedata.normalize("NFKD", text):
        if char in _IN_NAMES:
            name.append(char)
            gap = False
        elif char < "\x80" and not gap:
            name.append("_")
            gap = True
    return "".join(name).strip("_.") or "log"


@F.pandas_udf(StringType())
def sanitize_name(text: pd.Series) -> pd.Series:
    """:func:`sanitize_text` (Unicode decomposition is not in Spark SQL)."""
    return text.map(sanitize_text, na_action="ignore")


@F.pandas_udf(StringType())
def python_repr(text: pd.Series) -> pd.Series:
    """Text with control and odd characters escaped, in quotes."""
    return text.map(repr, na_action="ignore")


def lerp(v0: Column, v1: Column, alpha: Column) -> Column:
    """Linear; if one value is null, the other."""
    return F.coalesce(v0 + (v1 - v0) * alpha, v0, v1)


def turned(angle: Column) -> Column:
    """Degrees from 0 to below 360.  The turn is added and taken off again, so that
    what lies below 360 by rounding alone is 0."""
    return (angle % 360.0 + 360.0) % 360.0


def lerp_angle(v0: Column, v1: Column, alpha: Column) -> Column:
    """Degrees along the shorter arc, 0 to 360; opposite angles go backward, those
    that differ from 180 by rounding alone, too."""
    delta = turned(v1 - v0 + 180.0) - 180.0
    return F.coalesce(turned(v0 + delta * alpha), v0, v1)
