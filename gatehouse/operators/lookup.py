"""Lookup rules: existence joins against registered tables."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.typesys import InvalidRule, family
from .registry import Rule, rule


@rule("unique", 100, "The {field} has already been taken.", kind="lookup")
def unique(c, table, column=None, ignore=None, id_column="id", with_trashed=False, deleted="deleted_at"):
    return F.lit(True)


@rule("exists", 100, "The selected {field} is invalid.", kind="lookup")
def exists(c, table, column=None):
    return F.lit(True)


@dataclass(frozen=True)
class Lookup:
    """One question to one table: whether it holds a value in a column. Equal questions share one join."""

    table: str
    column: str
    ignore: object = None
    id_column: str = "id"
    with_trashed: bool = True
    deleted: str = "deleted_at"

    @classmethod
    def of(cls, r: Rule, field: str) -> Lookup:
        if r.name == "exists":
            return cls(str(r.params[0]), str(r.params[1]) if len(r.params) > 1 and r.params[1] is not None else field)
        p = [*r.params, *[None] * (6 - len(r.params))]
        return cls(str(p[0]), str(p[1]) if p[1] is not None else field, p[2], str(p[3] or "id"), bool(p[4]), str(p[5] or "deleted_at"))

    def keys(self, tables: dict[str, DataFrame]) -> DataFrame:
        """Distinct values of the column after soft deletes and the ignored row are out."""
        if self.table not in tables:
            raise InvalidRule(f"no lookup table {self.table!r}")
        df = tables[self.table]
        if self.column not in df.columns:
            raise InvalidRule(f"lookup table {self.table!r} has no column {self.column!r}")
        if not self.with_trashed and self.deleted in df.columns:
            df = df.where(F.col(self.deleted).isNull())
        if self.ignore is not None and self.id_column in df.columns:
            df = df.where(~F.col(self.id_column).eqNullSafe(F.lit(self.ignore)))
        return df.select(F.col(self.column).alias("__key")).distinct()


def flag(df: DataFrame, value: str, lookup: Lookup, tables: dict[str, DataFrame], name: str) -> DataFrame:
    """Add the boolean column ``name``: whether the lookup holds the column ``value``. Null matches null.

    A left join on distinct keys keeps every row once; Spark chooses a broadcast by the keys' own measured size. Rows with a null,
    which may be very many, are salted so that a shuffle spreads them; whether the lookup holds a null is asked once.
    """
    keys = lookup.keys(tables)
    if family(keys.schema[0].dataType) != family(df.schema[value].dataType):
        return df.withColumn(name, F.lit(False))
    key, own, theirs = f"{name}__key", f"{name}__salt", f"{name}__zero"
    holds_null = keys.agg(F.count_if(F.col("__key").isNull()) > 0).scalar()
    side = keys.where("__key IS NOT NULL").select(F.col("__key").alias(key), F.lit(-1).alias(theirs), F.lit(True).alias(name))
    salted = df.withColumn(own, F.when(F.col(value).isNull(), F.spark_partition_id()).otherwise(F.lit(-1)))
    joined = salted.join(side, (salted[value] == side[key]) & (salted[own] == side[theirs]), "left")
    found = F.when(F.col(value).isNull(), holds_null).otherwise(F.coalesce(F.col(name), F.lit(False)))
    return joined.withColumn(name, found).drop(key, own, theirs)


def composite_exists(df: DataFrame, table: DataFrame, columns: dict[str, str], ignore: tuple[str, object] | None = None) -> DataFrame:
    """Rows of ``df`` whose values stand together in a row of the table; null never matches. ``columns`` maps ours to theirs."""
    side = table if ignore is None else table.where(~F.col(ignore[0]).eqNullSafe(F.lit(ignore[1])))
    side = side.select(*(F.col(theirs).alias(f"__{k}") for k, theirs in enumerate(columns.values()))).distinct()
    on = [df[ours] == side[f"__{k}"] for k, ours in enumerate(columns)]
    return df.join(side, on, "left_semi")
