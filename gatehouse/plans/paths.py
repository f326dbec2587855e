"""Dotted paths over nested rows: list, read, write, flatten, rebuild and expand them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.typesys import InvalidRule


def leaf_paths(schema: T.StructType, prefix: str = "") -> list[str]:
    """Paths of all leaves; arrays and maps are leaves."""
    out = []
    for f in schema.fields:
        path = f"{prefix}{f.name}"
        out += leaf_paths(f.dataType, f"{path}.") if isinstance(f.dataType, T.StructType) else [path]
    return out


def has_path(schema: T.StructType, path: str) -> bool:
    """Whether the schema holds a path; a path with stars does not exist as such."""
    head, _, rest = path.partition(".")
    if head not in schema.names:
        return False
    inner = schema[head].dataType
    return not rest or isinstance(inner, T.StructType) and has_path(inner, rest)


def column_at(path: str) -> Column:
    head, *rest = path.split(".")
    out = F.col(f"`{head}`")
    for part in rest:
        out = out[part]
    return out


def extract(df: DataFrame, path: str, default=None) -> Column:
    """The value at a path, or the default where the path or the value is absent."""
    if path in df.columns:
        found = F.col(f"`{path}`")
    elif has_path(df.schema, path):
        found = column_at(path)
    else:
        return F.lit(default)
    return found if default is None else F.coalesce(found, F.lit(default))


def flatten(df: DataFrame, only: list[str] | None = None) -> DataFrame:
    """A column for each leaf, named by its path; scans are pruned to the paths asked for."""
    return df.select(*(column_at(p).alias(p) for p in (only or leaf_paths(df.schema))))


def unflatten(df: DataFrame) -> DataFrame:
    """Columns with dotted names rebuilt as nested structs."""
    tree: dict = {}
    for name in df.columns:
        *above, leaf = name.split(".")
        node = tree
        for part in above:
            node = node.setdefault(part, {})
            if not isinstance(node, dict):
                raise InvalidRule(f"{name} lies below a value")
        node[leaf] = F.col(f"`{name}`")

    def build(node: dict) -> list[Column]:
        return [(F.struct(*build(v)) if isinstance(v, dict) else v).alias(k) for k, v in node.items()]

    return df.select(*build(tree))


def set_value(df: DataFrame, path: str, value: Column) -> DataFrame:
    """Write at a path; structs that are not there are made."""
    head, _, rest = path.partition(".")
    if not rest:
        return df.withColumn(head, value)
    if head in df.columns and isinstance(df.schema[head].dataType, T.StructType):
        parent = ".".join(rest.split(".")[:-1])
        if not parent or has_path(df.schema[head].dataType, parent):
            return df.withColumn(head, F.col(f"`{head}`").withField(rest, value))
    nested = value
    for part in reversed(rest.split(".")):
        nested = F.struct(nested.alias(part))
    inner = rest.split(".")[0]
    return df.withColumn(head, F.col(f"`{head}`").withField(inner, nested[inner]) if head in df.columns and isinstance(df.schema[head].dataType, T.StructType) else nested)


def expand(df: DataFrame, keys: list[str], path: str) -> DataFrame:
    """A path with stars as rows: the keys, the concrete path and the value there. Empty and absent arrays give none."""
    head, *rest = path.split(".*")
    out = df.select(*keys, F.lit(head).alias("__path"), extract(df, head).alias("__value"))
    for part in rest:
        out = out.select(*keys, "__path", F.posexplode("__value").alias("__i", "__x"))
        inner = F.col("__x")
        for name in filter(None, part.split(".")):
            inner = inner[name]
        out = out.select(*keys, F.concat("__path", F.lit("."), F.col("__i").cast("string"), F.lit(part)).alias("__path"), inner.alias("__value"))
    return out.select(*keys, F.col("__path").alias("path"), F.col("__value").alias("value"))


def shape_signature(json: Column) -> Column:
    """A hash of a JSON text's structure: its keys and types, not its values."""
    return F.xxhash64(F.schema_of_variant(F.try_parse_json(json)))
