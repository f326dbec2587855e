"""Rules on one value: types, formats, strings, numbers, dates, sets and patterns."""

from __future__ import annotations

import inspect
import re
import zoneinfo

from pyspark.errors import PySparkException
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import udfs
from ..functions.typesys import (
    ACCEPTED, DECLINED, INTEGER, InvalidRule, all_of, any_of, compare, empty, in_list, java_date_format, java_pattern, literal_moment, measure, moment, number, numeric, one_of,
    same, same_as, text, true,
)
from .registry import rule

#: Format patterns.
EMAIL_ATOM = r"[A-Za-z0-9!#$%&'*+/=?^_`{|}~-]"
EMAIL = rf"(?d)^(?=.{{1,254}}$){EMAIL_ATOM}{{1,64}}(\.{EMAIL_ATOM}+)*@([A-Za-z0-9]([A-Za-z0-9-]{{0,61}}[A-Za-z0-9])?\.)+[A-Za-z0-9]([A-Za-z0-9-]{{0,61}}[A-Za-z0-9])?$"
URL = r"(?d)^[A-Za-z][A-Za-z0-9+.-]*://[A-Za-z0-9]([A-Za-z0-9.-]*[A-Za-z0-9])?(:[0-9]{1,5})?([/?#][\x21-\x7E]*)?$"
OCTET = r"(25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
IPV4 = rf"^({OCTET}\.){{3}}{OCTET}\z"
ULID = r"(?d)^[0-7][0-9A-HJKMNP-TV-Z]{25}$"
MAC = r"^([0-9A-Fa-f]{2}(:[0-9A-Fa-f]{2}){5}|[0-9A-Fa-f]{2}(-[0-9A-Fa-f]{2}){5}|([0-9A-Fa-f]{4}\.){2}[0-9A-Fa-f]{4})\z"
HEX_COLOR = r"(?d)^#?([A-Fa-f0-9]{6}|[A-Fa-f0-9]{3})$"
IP_OPTIONS = frozenset({"v4", "v6", "public", "private", "no_priv", "no_res", "global"})


def _is_text(c):
    return c.value.kind == "STR"


def _match(c, pattern: str):
    return true(c.value.col.rlike(pattern)) if _is_text(c) else F.lit(False)


@rule("required", 1, "The {field} field is required.")
def required(c):
    return ~empty(c.value)


@rule("filled", 1, "The {field} must be filled when present.")
def filled(c):
    return c.value.col.isNotNull() if c.value.kind != "STR" else ~empty(c.value)


@rule("string", 1, "The {field} must be a string.")
def string(c):
    return c.value.col.isNotNull() if _is_text(c) else F.lit(False)


@rule("integer", 1, "The {field} must be an integer.")
def integer(c):
    v = c.value
    if v.kind == "INT":
        return v.col.isNotNull()
    if v.kind == "FLT":
        return true(v.col.cast("double") == F.floor(v.col.cast("double")).cast("double"))
    return true(v.col.rlike(INTEGER)) & F.btrim(F.regexp_replace(v.col, "[\f\x0b]", ""), F.lit(" \t\n\r")).try_cast("bigint").isNotNull() if v.kind == "STR" else F.lit(False)


@rule("numeric", 1, "The {field} must be a number.")
def numeric_rule(c):
    return numeric(c.value)


@rule("boolean", 1, "The {field} must be true or false.")
def boolean(c):
    return one_of(c.value, {"BOOL": (True, False), "INT": (0, 1), "STR": ("0", "1")})


@rule("array", 1, "The {field} must be an array.")
def array(c):
    return c.value.col.isNotNull() if c.value.kind in ("ARR", "MAP", "STRUCT") else F.lit(False)


@rule("nullable", 1, "")
def nullable(c):
    return F.lit(True)


@rule("bail", 1, "The {field} stops validation on first failure.")
def bail(c):
    return F.lit(True)


@rule("email", 10, "The {field} must be a valid email address.")
def email(c):
    return _match(c, EMAIL) & true(F.length(F.substring_index(c.value.col, "@", 1)) <= 64) if _is_text(c) else F.lit(False)


@rule("url", 10, "The {field} must be a valid URL.")
def url(c):
    return _match(c, URL)


@rule("active_url", 150, "The {field} must be an active URL.")
def active_url(c):
    if not _is_text(c):
        return F.lit(False)
    return true(udfs.resolves(F.try_parse_url(c.value.col, F.lit("HOST")), c.options.get("resolver", udfs.dns_resolves)))


def _v4_ranges(v):
    octet = [F.split_part(v, F.lit("."), F.lit(k)).try_cast("int") for k in range(1, 5)]
    a, b = octet[0], octet[1]
    private = (a == 10) | ((a == 172) & b.between(16, 31)) | ((a == 192) & (b == 168))
    reserved = (a == 0) | (a == 127) | (a >= 240) | ((a == 169) & (b == 254))
    return private, reserved


@rule("ip", 10, "The {field} must be a valid IP address.")
def ip(c, *options):
    if any(o is not None and not isinstance(o, str) for o in options):
        raise InvalidRule(f"rule ip takes options {sorted(IP_OPTIONS)}, not {options}")
    chosen = tuple(o.strip() for o in options if o)
    if set(chosen) - IP_OPTIONS:
        raise InvalidRule(f"unknown ip options {sorted(set(chosen) - IP_OPTIONS)}")
    if not _is_text(c):
        return F.lit(False)
    v = c.value.col
    four = true(v.rlike(IPV4))
    private, reserved = _v4_ranges(v)
    if "private" in chosen:
        four &= true(private)
    if {"public", "no_priv", "global"} & set(chosen):
        four &= ~true(private)
    if {"public", "no_res", "global"} & set(chosen):
        four &= ~true(reserved)
    if "v4" in chosen and "v6" not in chosen:
        return four
    six = true(v.contains(":")) & true(udfs.is_ipv6(v, chosen))
    return six if "v6" in chosen and "v4" not in chosen else four | six


@rule("json", 15, "The {field} must be a valid JSON string.")
def json_rule(c):
    return true(udfs.is_json(c.value.col)) if _is_text(c) else F.lit(False)


@rule("uuid", 15, "The {field} must be a valid UUID.")
def uuid(c, version=None):
    spec = "" if version is None else str(version)
    if m := re.fullmatch(r"([1-9])-([1-9])", spec):
        digits = "".join(str(d) for d in range(int(m[1]), int(m[2]) + 1))
    elif m := re.fullmatch(r"!([1-9]+)", spec):
        digits = "".join(str(d) for d in range(1, 10) if str(d) not in m[1])
    elif re.fullmatch(r"[1-9]*", spec):
        digits = spec or "123456789"
    else:
        raise InvalidRule(f"uuid version {spec!r}")
    return _match(c, rf"(?i)^[0-9a-f]{{8}}-[0-9a-f]{{4}}-[{digits}][0-9a-f]{{3}}-[89ab][0-9a-f]{{3}}-[0-9a-f]{{12}}\z")


@rule("ulid", 15, "The {field} must be a valid ULID.")
def ulid(c):
    return _match(c, ULID)


@rule("mac", 15, "The {field} must be a valid MAC address.")
def mac(c):
    return _match(c, MAC)


@rule("hex_color", 15, "The {field} must be a valid hex color.")
def hex_color(c):
    return _match(c, HEX_COLOR)


def timezone_names() -> list[str]:
    """Canonical zone names: the zone table's and UTC, without aliases."""
    areas = ("Africa/", "America/", "Antarctica/", "Arctic/", "Asia/", "Atlantic/", "Australia/", "Europe/", "Indian/", "Pacific/")
    for folder in zoneinfo.TZPATH:
        try:
            with open(f"{folder}/tzdata.zi") as file:
                names = {p for line in file if line[:2] == "Z " for p in [line.split()[1]]}
            return sorted({n for n in names if n.startswith(areas)} | {"UTC"})
        except OSError:
            continue
    return sorted({n for n in zoneinfo.available_timezones() if n.startswith(areas)} | {"UTC"})


@rule("timezone", 12, "The {field} must be a valid timezone.")
def timezone(c):
    return true(c.value.col.isin(timezone_names())) if _is_text(c) else F.lit(False)


for _name, _pattern, _message in (
    ("alpha", r"(?d)^[a-zA-Z]+$", "The {field} may only contain letters."),
    ("alpha_num", r"(?d)^[a-zA-Z0-9]+$", "The {field} may only contain letters and numbers."),
    ("alpha_dash", r"(?d)^[a-zA-Z0-9_-]+$", "The {field} may only contain letters, numbers, dashes, and underscores."),
):
    rule(_name, 15, _message)(lambda c, pattern=_pattern: _match(c, pattern))


@rule("ascii", 15, "The {field} must only contain ASCII characters.")
def ascii_rule(c):
    return true(F.octet_length(c.value.col) == F.length(c.value.col)) if _is_text(c) else F.lit(False)


@rule("lowercase", 5, "The {field} must be lowercase.")
def lowercase(c):
    return true(c.value.col == F.lower(c.value.col)) if _is_text(c) else F.lit(False)


@rule("uppercase", 5, "The {field} must be uppercase.")
def uppercase(c):
    return true(c.value.col == F.upper(c.value.col)) if _is_text(c) else F.lit(False)


@rule("starts_with", 5, "The {field} must start with one of: {all}", text_params=True)
def starts_with(c, *values):
    return any_of(c.value.col.startswith(F.lit(p)) for p in values) if _is_text(c) else F.lit(False)


@rule("ends_with", 5, "The {field} must end with one of: {all}", text_params=True)
def ends_with(c, *values):
    return any_of(c.value.col.endswith(F.lit(p)) for p in values) if _is_text(c) else F.lit(False)


@rule("doesnt_start_with", 5, "The {field} must not start with: {all}", text_params=True)
def doesnt_start_with(c, *values):
    return c.value.col.isNotNull() & ~starts_with(c, *values) if _is_text(c) else F.lit(False)


@rule("doesnt_end_with", 5, "The {field} must not end with: {all}", text_params=True)
def doesnt_end_with(c, *values):
    return c.value.col.isNotNull() & ~ends_with(c, *values) if _is_text(c) else F.lit(False)


def _element(c):
    from ..functions.typesys import Value

    return lambda e: Value(e, c.value.dtype.elementType, F.lit(True))


@rule("contains", 5, "The {field} must contain the specified value.")
def contains(c, needle, *ignored):
    if _is_text(c):
        return true(c.value.col.contains(F.lit(str(needle))))
    if c.value.kind == "ARR":
        return true(F.exists(c.value.col, lambda e: same_as(_element(c)(e), needle)))
    return F.lit(False)


@rule("doesnt_contain", 5, "The {field} must not contain the specified values.")
def doesnt_contain(c, *values):
    return c.value.col.isNotNull() & ~any_of(c.value.col.contains(F.lit(str(n))) for n in values) if _is_text(c) else F.lit(False)


@rule("min", 2, "The {field} must be at least {0}.")
def min_rule(c, least):
    return measure(c.value) >= F.lit(float(least))


@rule("max", 2, "The {field} must not exceed {0}.")
def max_rule(c, most):
    return measure(c.value) <= F.lit(float(most))


@rule("between", 3, "The {field} must be between {0} and {1}.")
def between(c, least, most):
    return measure(c.value).between(F.lit(float(least)), F.lit(float(most)))


@rule("size", 2, "The {field} must be exactly {0}.")
def size(c, n):
    """Strict by type: numeric text never matches and an integer is no float."""
    v = c.value
    if v.kind == "STRUCT":
        return true(measure(v) == float(n)) if isinstance(n, float) else F.lit(False)
    if v.kind == "STR":
        return ~numeric(v) & true(F.length(v.col) == n) if isinstance(n, int) else F.lit(False)
    if v.kind in ("ARR", "MAP"):
        return true(F.size(v.col) == n) if isinstance(n, int) else F.lit(False)
    return same_as(v, n)


def _width(c):
    return F.octet_length(text(c.value))


@rule("digits", 5, "The {field} must be {0} digits.")
def digits(c, length: int):
    return numeric(c.value) & true(_width(c) == length)


@rule("digits_between", 5, "The {field} must be between {0} and {1} digits.")
def digits_between(c, least: int, most: int):
    return numeric(c.value) & true(_width(c).between(least, most))


@rule("min_digits", 5, "The {field} must be at least {0} digits.")
def min_digits(c, least: int):
    return numeric(c.value) & true(_width(c) >= least)


@rule("max_digits", 5, "The {field} must not exceed {0} digits.")
def max_digits(c, most: int):
    return numeric(c.value) & true(_width(c) <= most)


@rule("decimal", 5, "The {field} must have at least {0} decimal places.")
def decimal(c, least=None, most=None):
    t = text(c.value)
    places = F.octet_length(F.split_part(t, F.lit("."), F.lit(2)))
    out = numeric(c.value) & true(t.contains(".")) & true(places >= (least or 0))
    return out & true(places <= most) if most is not None else out


@rule("multiple_of", 5, "The {field} must be a multiple of {0}.")
def multiple_of(c, divisor):
    return numeric(c.value) & true(F.try_mod(number(c.value), F.lit(float(divisor))) == 0)


for _name, _words in (("gt", "greater than"), ("gte", "greater than or equal to"), ("lt", "less than"), ("lte", "less than or equal to")):
    rule(_name, 3, f"The {{field}} must be {_words} {{0}}.", text_params=True)(
        lambda c, other, op=_name: numeric(c.value) & c.other(other).present & true(compare(c.value, c.other(other), op))
    )


@rule("date", 20, "The {field} is not a valid date.")
def date(c):
    return moment(c.value).isNotNull()


@rule("date_format", 25, "The {field} does not match the format {0}.", raw=True)
def date_format(c, fmt):
    if not _is_text(c):
        return F.lit(False)
    java = java_date_format(fmt)
    return true(F.date_format(F.try_to_timestamp(c.value.col, F.lit(java)), java) == c.value.col)


@rule("date_equals", 25, "The {field} must be a date equal to {0}.")
def date_equals(c, day):
    other = c.other(str(day))
    theirs = moment(other)
    try:
        fixed = F.lit(literal_moment(str(day))).cast("timestamp")
    except InvalidRule:
        fixed = F.lit(None).cast("timestamp")
    chosen = F.when(other.present & other.col.isNotNull(), theirs).otherwise(fixed)
    return true(moment(c.value).cast("date") == chosen.cast("date"))


for _name, _op, _words in (
    ("before", lambda a, b: a < b, "before"), ("before_or_equal", lambda a, b: a <= b, "before or equal to"),
    ("after", lambda a, b: a > b, "after"), ("after_or_equal", lambda a, b: a >= b, "after or equal to"),
):
    rule(_name, 25, f"The {{field}} must be a date {_words} {{0}}.", text_params=True)(
        lambda c, day, op=_op: true(op(moment(c.value), F.lit(literal_moment(day)).cast("timestamp")))
    )


@rule("in", 5, "The selected {field} is invalid.")
def in_rule(c, *values):
    return in_list(c.value, values)


@rule("not_in", 5, "The selected {field} is invalid.")
def not_in(c, *values):
    return ~in_list(c.value, values)


@rule("in_array", 5, "The {field} must be in {0}.", text_params=True)
def in_array(c, other):
    o = c.other(other)
    if o.kind != "ARR":
        return F.lit(False)
    from ..functions.typesys import Value

    return o.present & true(F.exists(o.col, lambda e: same(c.value, Value(e, o.dtype.elementType, F.lit(True)))))


@rule("distinct", 10, "The {field} field has duplicate values.")
def distinct(c):
    """No two equal entries; numeric texts are compared as numbers."""
    v = c.value
    if v.kind == "MAP":
        return true(F.size(F.array_distinct(F.map_values(v.col))) == F.size(v.col))
    if v.kind != "ARR":
        return F.lit(False)
    item = _element(c)
    keyed = F.transform(v.col, lambda e: F.coalesce(number(item(e)).cast("string"), F.concat(F.lit("s:"), e))) if item(v.col).kind == "STR" else v.col
    return true(F.size(F.array_distinct(keyed)) == F.size(v.col))


@rule("is_list", 5, "The {field} must be a list (sequential array).")
def is_list(c):
    if c.value.kind == "ARR":
        return c.value.col.isNotNull()
    return true(F.size(c.value.col) == 0) if c.value.kind == "MAP" else F.lit(False)


@rule("same", 2, "The {field} must match {0}.", text_params=True)
def same_rule(c, other):
    o = c.other(other)
    return o.present & true(same(c.value, o))


@rule("different", 2, "The {field} must be different from {0}.", text_params=True)
def different(c, other):
    o = c.other(other)
    return ~o.present | ~true(same(c.value, o))


@rule("confirmed", 2, "The {field} confirmation does not match.")
def confirmed(c):
    return same_rule(c, f"{c.name}_confirmation")


def _patterned(c, pattern):
    return true(text(c.value).rlike(java_pattern(pattern)))


@rule("regex", 20, "The {field} format is invalid.", raw=True)
def regex(c, pattern):
    return _patterned(c, pattern) if c.value.kind in ("STR", "INT", "FLT") else F.lit(False)


@rule("not_regex", 20, "The {field} format is invalid (must not match pattern).", raw=True)
def not_regex(c, pattern):
    return c.value.col.isNotNull() & ~_patterned(c, pattern) if c.value.kind in ("STR", "INT", "FLT") else F.lit(False)


@rule("accepted", 1, "The {field} must be accepted.")
def accepted(c):
    return one_of(c.value, ACCEPTED)


@rule("declined", 1, "The {field} must be declined.")
def declined(c):
    return one_of(c.value, DECLINED)


def takes(fn) -> int:
    """How many positional arguments a callable takes: functions, partials, methods, builtins and objects alike."""
    try:
        kinds = [p.kind for p in inspect.signature(fn).parameters.values()]
    except (TypeError, ValueError):  # some builtins tell nothing
        return 1
    return 2 if inspect.Parameter.VAR_POSITIONAL in kinds else sum(k in (inspect.Parameter.POSITIONAL_ONLY, inspect.Parameter.POSITIONAL_OR_KEYWORD) for k in kinds)


@rule("callback", 50, "The {field} is invalid.", raw=True)
def callback(c, fn, cost=50, message=None):
    """``fn(value)`` or ``fn(value, context)`` gives a Column. A function that can't take a Column is called with each value, and with the field's name."""
    more = takes(fn) > 1
    try:
        out = fn(c.value.col, c) if more else fn(c.value.col)
    except (TypeError, AttributeError, PySparkException):
        out = None
    if isinstance(out, Column):
        return true(out)
    name = c.name
    return true(F.udf(lambda v: bool(fn(v, name) if more else fn(v)), "boolean", useArrow=True)(c.value.col))


@rule("current_password", 150, "The {field} does not match current password.", raw=True)
def current_password(c, fn):
    return callback(c, fn)


@rule("required_array_keys", 5, "The {field} must have keys: {all}", text_params=True)
def required_array_keys(c, *keys):
    if c.value.kind == "MAP":
        return all_of(F.map_contains_key(c.value.col, k) for k in keys)
    return c.value.col.isNotNull() if c.value.kind == "STRUCT" and set(keys) <= set(c.value.dtype.names) else F.lit(False)
