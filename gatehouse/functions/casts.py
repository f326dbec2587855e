"""Casts of validated values to typed output."""

from __future__ import annotations

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .sanitizers import SANITIZERS, leading_number, only_json, pipeline, whole
from .typesys import InvalidRule, Value, moment, trimmed


def _integer(v: Value) -> tuple[Column, T.DataType]:
    if v.kind == "INT":
        return v.col.cast("bigint"), T.LongType()
    if v.kind == "BOOL":
        return v.col.cast("bigint"), T.LongType()
    return whole(v.col.cast("double") if v.kind == "FLT" else leading_number(v.col.cast("string"))), T.LongType()


def _float(v: Value) -> tuple[Column, T.DataType]:
    return (v.col.cast("double") if v.kind in ("INT", "FLT", "BOOL") else leading_number(v.col.cast("string"))), T.DoubleType()


def _boolean(v: Value) -> tuple[Column, T.DataType]:
    if v.kind == "STR":
        word = F.lower(trimmed(v.col))
        return F.when(word.isin("1", "true", "yes", "on"), True).when(word.isin("0", "false", "no", "off", ""), False).otherwise(v.col.isNotNull()), T.BooleanType()
    if v.kind in ("INT", "FLT"):
        return v.col != 0, T.BooleanType()
    if v.kind in ("ARR", "MAP"):
        return F.size(v.col) > 0, T.BooleanType()
    return v.col, T.BooleanType()


def _string(v: Value) -> tuple[Column, T.DataType]:
    return (F.to_json(v.col) if v.kind in ("ARR", "MAP", "STRUCT") else v.col.cast("string")), T.StringType()


def _array(v: Value) -> tuple[Column, T.DataType]:
    if v.kind in ("ARR", "MAP"):
        return v.col, v.dtype
    if v.kind == "STR":
        # of a JSON object the values; what is no JSON, or null or empty as JSON, is wrapped
        items = F.from_json(F.when(trimmed(v.col).startswith("["), v.col), "array<string>")
        values = F.map_values(F.from_json(F.when(trimmed(v.col).startswith("{"), v.col), "map<string,string>"))
        found = F.coalesce(items, values)
        return F.when(F.size(found) > 0, found).otherwise(F.array(v.col)), T.ArrayType(T.StringType())
    return F.array(v.col), T.ArrayType(v.dtype)


def _object(v: Value) -> tuple[Column, T.DataType]:
    if v.kind == "STRUCT":
        return v.col, v.dtype
    return F.struct(v.col.alias("value")), T.StructType([T.StructField("value", v.dtype)])


def _json(v: Value) -> tuple[Column, T.DataType]:
    return (F.try_parse_json(only_json(v.col)), T.VariantType()) if v.kind == "STR" else (v.col, v.dtype)


def _date(v: Value) -> tuple[Column, T.DataType]:
    return moment(v), T.TimestampType()


CASTS = {
    "int": _integer, "integer": _integer, "float": _float, "double": _float, "real": _float, "bool": _boolean, "boolean": _boolean, "string": _string, "array": _array,
    "object": _object, "json": _json, "date": _date, "datetime": _date, "datetimeimmutable": _date,
}


def apply(v: Value, cast) -> tuple[Column, T.DataType]:
    """A cast by name, a sanitizer's name, a function of a Column, or a list of these from left to right."""
    for step in pipeline(cast):
        if callable(step):
            shape = SparkSession.active().range(0).select(step(F.lit(None).cast(v.dtype)).alias("out")).schema  # analysed, never run
            v = Value(step(v.col), shape["out"].dataType, v.present)
            continue
        if step.lower() in CASTS:
            col, dtype = CASTS[step.lower()](v)
        elif step in SANITIZERS:
            col, dtype = SANITIZERS[step](v.col, v.dtype)
        else:
            raise InvalidRule(f"unknown cast {step!r}")
        v = Value(col, dtype, v.present)
    return v.col, v.dtype
