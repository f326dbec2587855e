"""Lookup tables by name, and files as upload records."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from ..functions import udfs
from ..operators.lookup import composite_exists


class LookupTables(dict):
    """Named DataFrames for lookup rules: registered, from rows, from files or over JDBC."""

    def __init__(self, spark: SparkSession) -> None:
        super().__init__()
        self.spark = spark

    def add(self, name: str, df: DataFrame) -> LookupTables:
        self[name] = df
        return self

    def add_rows(self, name: str, rows: list[dict], schema: str | None = None) -> LookupTables:
        return self.add(name, self.spark.createDataFrame([Row(**r) for r in rows], schema))

    def add_parquet(self, name: str, path: str) -> LookupTables:
        return self.add(name, self.spark.read.parquet(path))

    def add_jdbc(self, name: str, url: str, table: str, **options) -> LookupTables:
        return self.add(name, self.spark.read.format("jdbc").options(url=url, dbtable=table, **options).load())

    def exists(self, table: str, column: str, value, ignore=None, id_column: str = "id") -> bool:
        """Whether one value stands in a column; null never does."""
        rows = self[table].where(F.col(column) == F.lit(value))
        if ignore is not None:
            rows = rows.where(~F.col(id_column).eqNullSafe(F.lit(ignore)))
        return not rows.isEmpty()

    def composite_unique(self, table: str, columns: dict, ignore=None, id_column: str = "id") -> bool:
        """Whether no row holds all these values together."""
        probe = self.spark.range(1).select(*(F.lit(v).alias(k) for k, v in columns.items()))
        return composite_exists(probe, self[table], {k: k for k in columns}, None if ignore is None else (id_column, ignore)).isEmpty()

    def query(self, sql: str) -> DataFrame:
        """Free SQL over the registered tables."""
        for name, df in self.items():
            df.createOrReplaceTempView(name)
        return self.spark.sql(sql)


def read_files(spark: SparkSession, path: str | Iterable[str], glob: str = "*") -> DataFrame:
    """Files as rows of ``path, upload``: the upload struct has name, size, the type that the content shows, and the content's
    beginning, which is what the rules on files look at wherever the row goes."""
    raw = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path if isinstance(path, str) else list(path))
    kind = F.pandas_udf(lambda s: s.map(udfs.sniff), "string")(F.substring("content", 1, 4096))
    local = F.regexp_replace("path", "^file:(//)?", "")
    name = F.element_at(F.split("path", "/"), -1)
    upload = F.struct(name.alias("name"), kind.alias("type"), F.col("length").alias("size"), local.alias("tmp_name"), F.lit(0).alias("error"), F.substring("content", 1, 1 << 16).alias("content"))
    return raw.select("path", upload.alias("upload"))
