"""Sanitizers: functions of a Column and its type, fused into one expression by a pipeline."""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import udfs
from .typesys import NUMERIC, InvalidRule, family, trimmed

Sanitizer = Callable[..., tuple[Column, T.DataType]]
SANITIZERS: dict[str, Sanitizer] = {}
STRING = T.StringType()

#: Prefixes of currencies.
CURRENCY = {"USD": "$", "GBP": "£", "EUR": "€"}


def sanitizer(name: str):
    def add(fn):
        SANITIZERS[name] = fn
        return fn

    return add


def _text(name: str, fn: Callable[..., Column]):
    """A sanitizer of text: anything else becomes the empty string."""

    def run(c: Column, dtype: T.DataType, *params):
        return (F.coalesce(fn(c, *params), F.lit("")), STRING) if family(dtype) == "STR" else (F.lit(""), STRING)

    SANITIZERS[name] = run
    return fn


def _sub(pattern: str, to: str = ""):
    return lambda c: F.regexp_replace(c, pattern, to)


for _name, _pattern, _to in (
    ("alpha", "[^a-zA-Z]", ""), ("alphaDash", "[^a-zA-Z0-9_-]", ""), ("alphanumeric", "[^a-zA-Z0-9]", ""), ("alphanumericSpace", r"[^a-zA-Z0-9\s]", ""),
    ("numeric", "[^0-9]", ""), ("phone", "[^0-9+]", ""), ("removeLineBreaks", r"\r\n|\r|\n", " "), ("stripWhitespace", r"\s+", ""), ("escapeLike", "([%_])", r"\\$1"),
    ("email", r"[^A-Za-z0-9!#$%&'*+\-=?^_`{|}~@.\[\]]", ""), ("url", r"[^A-Za-z0-9$\-_.+!*'(),{}|\\^~\[\]`<>#%\";/?:@&=]", ""),
):
    _text(_name, _sub(_pattern, _to))

_text("lowercase", F.lower)
_text("uppercase", F.upper)
_text("trim", trimmed)
_text("base64Encode", lambda c: F.base64(c.cast("binary")))
_text("base64Decode", lambda c: F.try_to_binary(c, F.lit("base64")).cast("string"))
_text("normalizeWhitespace", lambda c: F.regexp_replace(trimmed(c), r"\s+", " "))
_text("sentenceCase", lambda c: F.concat(F.upper(F.left(c, F.lit(1))), F.lower(F.substring(c, F.lit(2), F.length(c)))))
_text("domain", lambda c: F.lower(F.split_part(F.regexp_replace(c, "^https?://", ""), F.lit("/"), F.lit(1))))
_text("filename", lambda c: F.regexp_replace(F.regexp_extract(F.regexp_replace(c, "\0", ""), r"([^/]*)/*$", 1), "[^a-zA-Z0-9._-]", "_"))
_text("titleCase", lambda c: F.array_join(F.transform(F.regexp_extract_all(c, F.lit(r"(\p{L}[\p{L}\p{M}']*|[^\p{L}]+)"), F.lit(0)), F.initcap), ""))


def _cleaned(c: Column) -> Column:
    return F.regexp_replace(c, r"[^a-zA-Z0-9\s]", "")


def _joined(c: Column, by: str) -> Column:
    return F.regexp_replace(F.lower(_cleaned(c)), r"\s+", by)


def _pascal(c: Column) -> Column:
    return F.replace(F.initcap(_cleaned(c)), F.lit(" "), F.lit(""))


_text("snakeCase", lambda c: _joined(c, "_"))
_text("kebabCase", lambda c: _joined(c, "-"))
_text("pascalCase", _pascal)
_text("camelCase", lambda c: F.concat(F.lower(F.left(_pascal(c), F.lit(1))), F.substring(_pascal(c), F.lit(2), F.length(c))))


def _replaced(c: Column, pairs) -> Column:
    return reduce(lambda x, p: F.replace(x, F.lit(p[0]), F.lit(p[1])), pairs, c)


#: Characters and their references; the ampersand is encoded first and decoded last.
_REFERENCES = (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;"))
_text("htmlEncode", lambda c: _replaced(c, _REFERENCES))
_text("htmlDecode", lambda c: _replaced(c, [(b, a) for a, b in (*_REFERENCES[1:], ("'", "&#039;"), _REFERENCES[0])]))
_text("removeSqlPatterns", lambda c: trimmed(reduce(lambda x, p: F.regexp_replace(x, p, ""), (r"(?i)\b(select|insert|update|delete|drop|union)\b", r"(?m)--.*$", r"(?s)/\*.*?\*/"), c)))
_XSS = (r"(?is)<script\b[^>]*>.*?</script>", r"(?is)\s+on\w+\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+)", r"(?i)javascript:")
_text("removeXss", lambda c: reduce(lambda x, p: F.regexp_replace(x, p, ""), _XSS, c))
_SAFE_TAGS = frozenset("p br strong em u a ul ol li".split())
_text("stripUnsafeTags", lambda c: udfs.strip_tags_column(F.regexp_replace(c, r"(?is)<script\b[^>]*>.*?</script>", ""), _SAFE_TAGS))


@sanitizer("string")
def string(c: Column, dtype: T.DataType):
    kind = family(dtype)
    if kind == "STR":
        return F.coalesce(udfs.strip_tags_column(trimmed(c)), F.lit("")), STRING
    return (F.coalesce(c.cast("string"), F.lit("")), STRING) if kind in ("INT", "FLT") else (F.lit(""), STRING)


def _tags(allowed) -> frozenset[str]:
    return frozenset(re.findall(r"\w+", " ".join(allowed) if isinstance(allowed, (list, tuple)) else allowed or ""))


_text("stripTags", lambda c, allowed="": udfs.strip_tags_column(c, _tags(allowed)))


def slug(c: Column, separator: str = "-") -> Column:
    words = F.regexp_replace(F.lower(udfs.ascii_letters(c)), "[^a-z0-9]+", separator)
    return F.btrim(words, F.lit(separator)) if separator else words


_text("slug", slug)
_text("truncate", lambda c, n, suffix="...": F.when(F.length(c) <= int(n), c).otherwise(F.concat(F.left(c, F.lit(int(n))), F.lit(suffix))))
_text("truncateWords", lambda c, n, suffix="...": F.when(F.size(F.split(c, " ")) <= int(n), c).otherwise(F.concat(F.substring_index(c, " ", int(n)), F.lit(suffix))))


def leading_number(c: Column) -> Column:
    """The numeric beginning of a text as double, 0.0 without one."""
    return F.coalesce(F.regexp_extract(c, r"^[ \t\n\r\x0B\f]*([+-]?(?:\d+(?:\.\d*)?|\.\d+)(?:[eE][+-]?\d+)?)", 1).try_cast("double"), F.lit(0.0))


def whole(c: Column) -> Column:
    """A double cut to a 64-bit integer, 0 where it does not fit."""
    return F.coalesce(F.when(F.abs(c) < F.lit(9.2e18), F.when(c < 0, F.ceil(c)).otherwise(F.floor(c)).cast("bigint")), F.lit(0).cast("bigint"))


@sanitizer("float")
def to_float(c: Column, dtype: T.DataType):
    kind = family(dtype)
    if kind in ("INT", "FLT"):
        return F.coalesce(c.cast("double"), F.lit(0.0)), T.DoubleType()
    if kind != "STR":
        return F.lit(0.0), T.DoubleType()
    return F.when(c.rlike(NUMERIC), leading_number(c)).otherwise(leading_number(F.regexp_replace(c, r"[^0-9+.\-]", ""))), T.DoubleType()


@sanitizer("integer")
def to_integer(c: Column, dtype: T.DataType):
    kind = family(dtype)
    if kind == "INT":
        return F.coalesce(c.cast("bigint"), F.lit(0).cast("bigint")), T.LongType()
    if kind == "FLT":
        return whole(c.cast("double")), T.LongType()
    if kind != "STR":
        return F.lit(0).cast("bigint"), T.LongType()
    digits = F.regexp_extract(F.regexp_replace(c, r"[^0-9+\-]", ""), r"^[+-]?\d+", 0).try_cast("bigint")
    return F.coalesce(F.when(c.rlike(NUMERIC), whole(leading_number(c))).otherwise(digits), F.lit(0).cast("bigint")), T.LongType()


@sanitizer("boolean")
def to_boolean(c: Column, dtype: T.DataType):
    kind = family(dtype)
    pred = {"BOOL": lambda: c, "INT": lambda: c != 0, "FLT": lambda: c != 0, "STR": lambda: F.lower(trimmed(c)).isin("1", "true", "yes", "on"), "ARR": lambda: F.size(c) > 0, "MAP": lambda: F.size(c) > 0}
    return F.coalesce(pred.get(kind, lambda: c.isNotNull())(), F.lit(False)), T.BooleanType()


@sanitizer("currency")
def currency(c: Column, dtype: T.DataType, fmt: str = "USD"):
    if family(dtype) in ("INT", "FLT"):
        return F.coalesce(c.cast("double"), F.lit(0.0)), T.DoubleType()
    if family(dtype) != "STR":
        return F.lit(0.0), T.DoubleType()
    kept = F.regexp_replace(c, r"[^0-9.,\-]", "")
    plain = F.replace(F.replace(kept, F.lit("."), F.lit("")), F.lit(","), F.lit(".")) if fmt == "EUR" else F.replace(kept, F.lit(","), F.lit(""))
    return leading_number(plain), T.DoubleType()


@sanitizer("formatCurrency")
def format_currency(c: Column, dtype: T.DataType, code: str = "USD", decimals: int = 2):
    value = to_float(c, dtype)[0]
    shown = F.format_number(F.round(value, int(decimals)), int(decimals))
    if code == "EUR":
        shown = F.translate(shown, ".,", ",.")
    return F.concat(F.lit(CURRENCY.get(code, f"{code} ")), shown), STRING


@sanitizer("array")
def array(c: Column, dtype: T.DataType):
    """Texts in an array, map or array of arrays trimmed and stripped of tags; the rest stays. What is no array becomes an empty one."""
    kind = family(dtype)
    if kind not in ("ARR", "MAP"):
        return F.expr("cast(array() as array<string>)"), T.ArrayType(STRING)

    def inside(x: Column, t: T.DataType) -> Column:
        # no Python function may stand inside a lambda, so tags go by pattern here
        if family(t) == "STR":
            return F.regexp_replace(trimmed(x), r"(?s)<!--.*?-->|<[^>\s][^>]*>?", "")
        if family(t) == "ARR":
            return F.transform(x, lambda y: inside(y, t.elementType))
        return F.transform_values(x, lambda _, y: inside(y, t.valueType)) if family(t) == "MAP" else x

    return inside(c, dtype), dtype


@sanitizer("jsonDecode")
def json_decode(c: Column, dtype: T.DataType, ddl: str = ""):
    """Parsed JSON, as VARIANT or by a given schema; what can't be parsed is null."""
    if family(dtype) != "STR":
        return F.lit(None).cast("variant"), T.VariantType()
    whole = only_json(c)
    if not ddl:
        return F.try_parse_json(whole), T.VariantType()
    return F.from_json(whole, ddl), T._parse_datatype_string(ddl)


def only_json(c: Column) -> Column:
    """The text if all of it is one JSON value, else null: parsers stop at the value's end, so it must fit both into an array and into an object."""
    item = F.from_json(F.concat(F.lit("["), c, F.lit("]")), "array<string>")
    member = F.from_json(F.concat(F.lit('{"v":'), c, F.lit("}")), "v string")["v"]
    return F.when((F.size(item) == 1) & member.isNotNull(), c)


@sanitizer("jsonEncode")
def json_encode(c: Column, dtype: T.DataType):
    if family(dtype) in ("ARR", "MAP", "STRUCT"):
        return F.coalesce(F.to_json(c), F.lit("null")), STRING
    wrapped = F.to_json(F.struct(c.alias("v")), {"ignoreNullFields": "false"})
    return F.substring(wrapped, F.lit(6), F.length(wrapped) - 6), STRING


def pipeline(given) -> list:
    """Steps of a pipe string, a list of names with ``name:param`` forms and functions of a Column, or one of them."""
    if given is None:
        return []
    steps = given.split("|") if isinstance(given, str) else list(given) if isinstance(given, (list, tuple)) else [given]
    return [s.strip() if isinstance(s, str) else s for s in steps]


def apply(c: Column, dtype: T.DataType, steps) -> Column:
    return apply_typed(c, dtype, steps)[0]


def apply_typed(c: Column, dtype: T.DataType, steps) -> tuple[Column, T.DataType]:
    """Fold a pipeline into one expression. Unknown names are skipped."""
    for step in pipeline(steps):
        if callable(step):
            c = step(c)
            continue
        name, _, tail = step.partition(":")
        fn = SANITIZERS.get(name)
        if fn is None:
            continue
        try:
            c, dtype = fn(c, dtype, *(tail.split(",") if tail else ()))
        except TypeError as error:
            raise InvalidRule(f"sanitizer {step!r}: {error}") from None
    return c, dtype


def batch(c: Column, dtype: T.DataType, step) -> Column:
    """One sanitizer over the entries of an array."""
    if family(dtype) != "ARR":
        return c
    return F.transform(c, lambda x: apply(x, dtype.elementType, [step]))


def apply_at(c: Column, dtype: T.DataType, path: list[str], steps) -> Column:
    """A pipeline at a path inside a struct or, by a star, at every element of an array."""
    if not path:
        return apply(c, dtype, steps)
    head, *rest = path
    if family(dtype) == "STRUCT" and head in dtype.names:
        return c.withField(head, apply_at(c[head], dtype[head].dataType, rest, steps))
    if family(dtype) == "ARR" and head == "*":
        return F.transform(c, lambda x: apply_at(x, dtype.elementType, rest, steps))
    return c
