"""Shortcuts: validate a DataFrame, ask whether it passes, sanitize a column."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame

from .functions import sanitizers
from .plans.engine import Validator
from .results import ValidatedFrame


def validator(rules: Mapping, tables: Mapping[str, DataFrame] | None = None) -> Validator:
    return Validator(rules, tables)


def validate(df: DataFrame, rules: Mapping, tables: Mapping[str, DataFrame] | None = None) -> ValidatedFrame:
    return Validator(rules, tables).validate(df)


def passes(df: DataFrame, rules: Mapping, tables: Mapping[str, DataFrame] | None = None) -> bool:
    return validate(df, rules, tables).passes()


def fails(df: DataFrame, rules: Mapping, tables: Mapping[str, DataFrame] | None = None) -> bool:
    return not passes(df, rules, tables)


def sanitize(df: DataFrame, column: str, steps) -> DataFrame:
    """The column run through a pipeline, in place."""
    return df.withColumn(column, sanitizers.apply(df[column], df.schema[column].dataType, steps))
