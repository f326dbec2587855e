"""Type families and the two-valued predicates that rules are built from.

Comparisons are strict by family, decided when the plan is built, so Spark's coercions never take part.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from datetime import datetime, timedelta
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Characters that trimming removes, and the numeric string grammar.
WS = " \t\n\r\0\x0b"
NUMERIC = r"^[ \t\n\r\x0B\f]*[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?[ \t\n\r\x0B\f]*$"
INTEGER = r"^[ \t\n\r\x0B\f]*[+-]?(0|[1-9][0-9]*)[ \t\n\r\x0B\f]*$"
ACCEPTED = {"STR": ("yes", "on", "1", "true"), "INT": (1,), "BOOL": (True,)}
DECLINED = {"STR": ("no", "off", "0", "false"), "INT": (0,), "BOOL": (False,)}


class InvalidRule(ValueError):
    """A schema that can't be compiled."""


def family(dtype: T.DataType) -> str:
    for kinds, name in (
        ((T.StringType,), "STR"), ((T.BooleanType,), "BOOL"), ((T.ByteType, T.ShortType, T.IntegerType, T.LongType), "INT"),
        ((T.FloatType, T.DoubleType, T.DecimalType), "FLT"), ((T.ArrayType,), "ARR"), ((T.MapType,), "MAP"), ((T.StructType,), "STRUCT"),
        ((T.DateType, T.TimestampType, T.TimestampNTZType), "TIME"), ((T.NullType,), "NULL"),
    ):
        if isinstance(dtype, kinds):
            return name
    return "OTHER"


@dataclass(frozen=True)
class Value:
    """A field's value in every row: its Column, its type, and whether the row has the field."""

    col: Column
    dtype: T.DataType
    present: Column

    @property
    def kind(self) -> str:
        return family(self.dtype)

    def field(self, name: str) -> Value | None:
        """A member of a struct value."""
        if self.kind == "STRUCT" and name in self.dtype.names:
            return Value(self.col[name], self.dtype[name].dataType, self.col.isNotNull())
        return None


def true(pred: Column) -> Column:
    """Two-valued: unknown is false."""
    return F.coalesce(pred, F.lit(False))


def any_of(preds) -> Column:
    return reduce(lambda a, b: a | b, map(true, preds), F.lit(False))


def all_of(preds) -> Column:
    return reduce(lambda a, b: a & b, map(true, preds), F.lit(True))


def trimmed(c: Column) -> Column:
    return F.btrim(c, F.lit(WS))


def text(v: Value) -> Column:
    return v.col if v.kind == "STR" else v.col.cast("string")


def empty(v: Value) -> Column:
    """Null, blank text, or an array or map without entries."""
    if v.kind == "STR":
        return F.coalesce(trimmed(v.col) == "", F.lit(True))
    if v.kind in ("ARR", "MAP"):
        return F.coalesce(F.size(v.col) == 0, F.lit(True)) if v.kind == "MAP" else F.coalesce(F.array_size(v.col) == 0, F.lit(True))
    return v.col.isNull()


def count(v: Value) -> Column:
    return F.size(v.col)


def numeric(v: Value) -> Column:
    if v.kind in ("INT", "FLT"):
        return v.col.isNotNull()
    return true(v.col.rlike(NUMERIC)) if v.kind == "STR" else F.lit(False)


def number(v: Value) -> Column:
    """The value as double where it is numeric, else null."""
    if v.kind in ("INT", "FLT"):
        return v.col.cast("double")
    return F.when(v.col.rlike(NUMERIC), trimmed(F.regexp_replace(v.col, "\f", "")).try_cast("double")) if v.kind == "STR" else F.lit(None).cast("double")


def measure(v: Value) -> Column:
    """Size by the reference order: an upload's kilobytes, a number (or numeric text) itself, text length, entries."""
    if v.kind == "STRUCT" and (size := v.field("size")) is not None:
        return F.coalesce(number(size) / 1024.0, F.lit(0.0))
    if v.kind in ("INT", "FLT"):
        return F.coalesce(v.col.cast("double"), F.lit(0.0))
    if v.kind == "STR":
        return F.coalesce(F.when(numeric(v), number(v)).otherwise(F.length(v.col).cast("double")), F.lit(0.0))
    if v.kind in ("ARR", "MAP"):
        return F.coalesce(F.size(v.col).cast("double"), F.lit(0.0))
    return F.lit(0.0)


def same_as(v: Value, literal) -> Column:
    """Strict equality with a parameter: false at once when the families differ."""
    if literal is None:
        return v.col.isNull()
    kind = {bool: "BOOL", int: "INT", float: "FLT", str: "STR"}[type(literal)]
    return true(v.col == F.lit(literal)) if v.kind == kind else F.lit(False)


def in_list(v: Value, literals) -> Column:
    return any_of(same_as(v, x) for x in literals)


def same(a: Value, b: Value) -> Column:
    if a.kind == b.kind and a.kind not in ("MAP", "OTHER"):
        return a.col.eqNullSafe(b.col)
    if a.kind == b.kind == "MAP":
        return true(F.map_entries(a.col) == F.map_entries(b.col)) | (a.col.isNull() & b.col.isNull())
    return a.col.isNull() & b.col.isNull()


def one_of(v: Value, table: dict) -> Column:
    return true(v.col.isin(*table[v.kind])) if v.kind in table else F.lit(False)


def compare(v: Value, o: Value, op: str) -> Column:
    """PHP-like comparison of a numeric value with another field."""
    ops = {"gt": lambda a, b: a > b, "gte": lambda a, b: a >= b, "lt": lambda a, b: a < b, "lte": lambda a, b: a <= b}
    f = ops[op]
    truthy = number(v) != 0
    against_null = {"gt": truthy, "gte": F.lit(True), "lt": F.lit(False), "lte": ~truthy}[op]
    if o.kind in ("ARR", "MAP", "STRUCT"):
        return F.when(o.col.isNull(), against_null).otherwise(F.lit(op in ("lt", "lte")))
    if o.kind == "BOOL":
        return F.when(o.col.isNull(), against_null).otherwise(f(truthy.cast("int"), o.col.cast("int")))
    if v.kind == o.kind == "INT":
        both = f(v.col, o.col)
    else:
        both = F.when(numeric(o), f(number(v), number(o))).otherwise(f(text(v), text(o)))
    return F.when(o.col.isNull(), against_null).otherwise(both)


def cast_param(raw: str):
    """A parameter by its shape: empty or null, booleans, numbers, else text."""
    if raw == "" or raw.lower() == "null":
        return None
    if raw.lower() in ("true", "false"):
        return raw.lower() == "true"
    if re.match(NUMERIC.replace("[ \\t\\n\\r\\x0B\\f]*", ""), raw):
        return float(raw) if "." in raw or "e" in raw.lower() else int(raw)
    return raw


_CLASSES = {"alpha": "Alpha", "digit": "Digit", "alnum": "Alnum", "upper": "Upper", "lower": "Lower", "punct": "Punct", "space": "Space", "xdigit": "XDigit"}


def java_pattern(pattern: str) -> str:
    """A delimited pattern with trailing flags as a Java one; ``$`` matches before a final newline only."""
    if len(pattern) < 2 or pattern[0].isalnum() or pattern[0] in "\\ ":
        raise InvalidRule(f"pattern {pattern!r} has no delimiter")
    close = {"(": ")", "[": "]", "{": "}", "<": ">"}.get(pattern[0], pattern[0])
    end = pattern.rfind(close)
    body, flags = pattern[1:end], pattern[end + 1 :]
    if end < 1 or set(flags) - set("imsxuADU"):
        raise InvalidRule(f"pattern {pattern!r} does not end")
    if "A" in flags:
        body = rf"\A(?:{body})"
    if "D" in flags and body.endswith("$") and not body.endswith("\\$"):
        body = body[:-1] + r"\z"
    body = re.sub(r"\[:(\w+):\]", lambda m: rf"\p{{{_CLASSES.get(m[1], 'Alpha')}}}", body)
    return f"(?d{''.join(f for f in 'imsx' if f in flags)}){body}"


#: Date format letters and their Java forms.
DATE_LETTERS = {
    "d": "dd", "j": "d", "D": "EEE", "l": "EEEE", "m": "MM", "n": "M", "M": "MMM", "F": "MMMM", "Y": "yyyy", "y": "yy", "H": "HH", "G": "H", "h": "hh", "g": "h",
    "i": "mm", "s": "ss", "A": "a", "u": "SSSSSS", "v": "SSS", "P": "xxx", "O": "xx", "T": "xxx", "e": "VV",
}


def java_date_format(fmt: str) -> str:
    out, quoted = [], False
    k = 0
    while k < len(fmt):
        c = fmt[k]
        if c == "\\" and k + 1 < len(fmt):
            k += 1
            out.append(f"'{fmt[k]}'" if fmt[k] != "'" else "''")
        elif c in DATE_LETTERS:
            out.append(DATE_LETTERS[c])
        elif c.isalpha():
            raise InvalidRule(f"date format letter {c!r} has no equivalent")
        else:
            out.append("''" if c == "'" else c)
        k += 1
    del quoted
    return "".join(out)


ISO = r"^\s*(\d{4})-(\d{1,2})-(\d{1,2})(?:[T ]+(\d{1,2}):(\d{2})(?::(\d{2}))?(?:[.,]\d+)?)?\s*(Z|UTC|[+-]\d{2}:?\d{2})?\s*$"
AMERICAN = r"^\s*(\d{1,2})/(\d{1,2})/(\d{4})\s*$"
WRITTEN = ("d MMMM yyyy", "MMMM d, yyyy", "MMMM d yyyy", "d MMM yyyy", "MMM d, yyyy", "MMM d yyyy", "d-MM-yyyy", "dd.MM.yyyy", "yyyy/MM/dd", "yyyyMMdd", "EEE, dd MMM yyyy HH:mm:ss Z")
RELATIVE = r"(?i)^\s*(?:([+-]?\d+)\s*(second|sec|minute|min|hour|day|week|fortnight)s?(\s+ago)?)\s*$"
_SECONDS = {"second": 1, "sec": 1, "minute": 60, "min": 60, "hour": 3600, "day": 86400, "week": 604800, "fortnight": 1209600}


def _part(c: Column, pattern: str, k: int) -> Column:
    return F.coalesce(F.regexp_extract(c, pattern, k).try_cast("int"), F.lit(0))


def _rolled(year: Column, month: Column, day: Column, seconds: Column) -> Column:
    """Days up to 31 run over into the next month, as the reference's parser lets them."""
    first = F.make_date(F.greatest(year, F.lit(1)), F.greatest(F.least(month, F.lit(12)), F.lit(1)), F.lit(1))
    at = F.date_add(first, day - 1).cast("timestamp") + F.make_dt_interval(secs=seconds)
    return F.when((month >= 1) & (month <= 12) & (day >= 0) & (day <= 31), at)


def moment(v: Value) -> Column:
    """The value as a timestamp, or null: ISO forms, month/day/year, written months and relative words."""
    if v.kind == "TIME":
        return v.col.cast("timestamp")
    if v.kind != "STR":
        return F.lit(None).cast("timestamp")
    c = v.col
    hour, minute, second = (_part(c, ISO, k) for k in (4, 5, 6))
    zone = F.regexp_extract(c, ISO, 7)
    sign = F.when(zone.startswith("-"), -1).otherwise(1)
    digits = F.regexp_replace(zone, "[^0-9]", "")
    offset = F.coalesce(F.substring(digits, 1, 2).try_cast("int"), F.lit(0)) * 3600 + F.coalesce(F.substring(digits, 3, 2).try_cast("int"), F.lit(0)) * 60
    seconds = (hour * 3600 + minute * 60 + second - sign * offset).cast("decimal(18,6)")
    iso = F.when((hour <= 24) & (minute <= 59) & (second <= 59), _rolled(_part(c, ISO, 1), _part(c, ISO, 2), _part(c, ISO, 3), seconds))
    american = _rolled(_part(c, AMERICAN, 3), _part(c, AMERICAN, 1), _part(c, AMERICAN, 2), F.lit(0).cast("decimal(18,6)"))
    word = F.lower(trimmed(c))
    today = F.current_timestamp().cast("date").cast("timestamp")
    day = F.expr("INTERVAL 1 DAY")
    count_ = F.regexp_extract(c, RELATIVE, 1).try_cast("int") * F.when(F.regexp_extract(c, RELATIVE, 3) != "", -1).otherwise(1)
    unit = F.lower(F.regexp_extract(c, RELATIVE, 2))
    length = reduce(lambda a, u: a.when(unit == u, F.lit(_SECONDS[u])), _SECONDS, F.when(F.lit(False), F.lit(0)))
    relative = F.current_timestamp() + F.make_dt_interval(secs=(count_ * length).cast("decimal(18,6)"))
    return F.coalesce(
        F.when(c.rlike(ISO), iso), F.when(c.rlike(AMERICAN), american), F.when(word.isin("", "now"), F.current_timestamp()), F.when(word.isin("today", "midnight"), today),
        F.when(word == "tomorrow", today + day), F.when(word == "yesterday", today - day), F.when(c.rlike(RELATIVE), relative),
        *(F.try_to_timestamp(c, F.lit(f)) for f in WRITTEN if "E" not in f),
    )


def literal_moment(raw: str) -> datetime:
    """A date parameter, read once on the driver."""
    word = raw.strip().lower()
    now = datetime.now()
    today = now.replace(hour=0, minute=0, second=0, microsecond=0)
    fixed = {"": now, "now": now, "today": today, "midnight": today, "tomorrow": today + timedelta(days=1), "yesterday": today - timedelta(days=1)}
    if word in fixed:
        return fixed[word]
    if m := re.match(ISO, raw):
        y, mo, d = int(m[1]), int(m[2]), int(m[3])
        if 1 <= mo <= 12 and d <= 31:
            zone = re.sub(r"\D", "", m[7] or "")
            offset = (int(zone[:2] or 0) * 60 + int(zone[2:4] or 0)) * (-1 if (m[7] or "").startswith("-") else 1)
            return datetime(y, mo, 1) + timedelta(days=d - 1, hours=int(m[4] or 0), minutes=int(m[5] or 0) - offset, seconds=int(m[6] or 0))
    if m := re.match(AMERICAN, raw):
        return datetime(int(m[3]), int(m[1]), 1) + timedelta(days=int(m[2]) - 1)
    if m := re.match(RELATIVE, raw):
        return now + timedelta(seconds=int(m[1]) * _SECONDS[m[2].lower()] * (-1 if m[3] else 1))
    for f in ("%d %B %Y", "%B %d, %Y", "%B %d %Y", "%d %b %Y", "%b %d, %Y", "%d-%m-%Y", "%d.%m.%Y", "%Y/%m/%d"):
        try:
            return datetime.strptime(raw.strip(), f)
        except ValueError:
            pass
    raise InvalidRule(f"date parameter {raw!r} can't be read")
