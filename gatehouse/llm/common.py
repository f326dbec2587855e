"""Helpers that the text operators share."""

from __future__ import annotations

import ctypes
import hashlib
import uuid
from collections.abc import Callable, Iterator
from functools import lru_cache

import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of rows that Spark hands a Python worker at a time, unless the session says otherwise: some texts are very long.
BATCH_BYTES, _BATCH_SETTING = 4 << 20, "spark.sql.execution.arrow.maxBytesPerBatch"
#: Keys that hold more than one row in so many are joined by broadcast: there are fewer of them than this.
HOT_SHARE = 1024


def vocabulary(name: str) -> str:
    """Where a public vocabulary file lies, unless a caller brings a path of their own."""
    return public_tokenizers.path(name)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bound_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bound_batches(spark: SparkSession) -> None:
    """Batches of ten thousand long texts would fill a worker: bound their bytes where the session has not set a bound of its own."""
    if spark.conf.get(_BATCH_SETTING, None) is None:
        spark.conf.set(_BATCH_SETTING, str(BATCH_BYTES))


def shuffle_partitions(spark: SparkSession) -> int:
    """The session's own setting: operators follow the cluster and never fix a count."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


@lru_cache(maxsize=1)
def _trim() -> Callable[[int], int]:
    try:
        return ctypes.CDLL("libc.so.6").malloc_trim
    except (OSError, AttributeError):  # another C library
        return lambda _: 0


def give_back_memory() -> None:
    """Return what a worker has freed to the system: it is used again for other work, beside an executor that needs room too."""
    pa.default_memory_pool().release_unused()
    _trim()(0)


def sha256_hex(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def map_rows(df: DataFrame, schema: str, fn: Callable[[dict], list], rows_per_batch: int = 256) -> DataFrame:
    """Run ``fn`` over slices of each partition, as column lists in and column lists out.

    ``fn`` gets ``{column: list}`` for at most ``rows_per_batch`` rows, so that the Python worker holds
    a few hundred texts and their results at a time however large the partition is.
    """
    names = [field.split()[0] for field in schema.split(", ")]
    target = spark_arrow_schema(schema)
    bound_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, rows_per_batch):
                part = batch.slice(start, rows_per_batch)
                columns = fn({n: part.column(k).to_pylist() for k, n in enumerate(part.schema.names)})
                arrays = [pa.array(c, type=target.field(n).type) for n, c in zip(names, columns, strict=True)]
                yield pa.RecordBatch.from_arrays(arrays, schema=target)
            give_back_memory()

    return df.mapInArrow(run, schema)


def spark_arrow_schema(ddl: str) -> pa.Schema:
    """The Arrow form of a flat DDL string."""
    kinds = {
        "long": pa.int64(), "int": pa.int32(), "string": pa.string(), "boolean": pa.bool_(),
        "double": pa.float64(), "binary": pa.binary(), "array<int>": pa.list_(pa.int32()), "array<long>": pa.list_(pa.int64()),
    }
    return pa.schema([pa.field(*((p := field.split())[0], kinds[p[1]])) for field in ddl.split(", ")])


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share: the one that spark.checkpoint.dir names, else the one that the context was given,
    else, where neither is set, as in tests, one in the warehouse."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named is None and (given := spark.sparkContext._jsc.sc().getCheckpointDir()).isDefined():
        named = given.get()
    return named or f"{spark.conf.get('spark.sql.warehouse.dir')}/gatehouse-scratch"


class Scratch:
    """Tables written to the shared folder and read again, which cuts their lineage: a lost executor costs no recomputation.

    ``drop`` deletes what no later step reads; what is left goes when the session's JVM ends.
    """

    def __init__(self, spark: SparkSession, name: str) -> None:
        self.spark, self.root, self._n = spark, f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}", 0
        self._paths: dict[int, tuple[DataFrame, str]] = {}
        bound_batches(spark)
        path, fs = self._hadoop(self.root)
        fs.mkdirs(path)
        fs.deleteOnExit(path)  # which takes only what exists

    def _hadoop(self, name: str):
        context = self.spark.sparkContext
        path = context._jvm.org.apache.hadoop.fs.Path(name)
        return path, path.getFileSystem(context._jsc.hadoopConfiguration())

    def keep(self, df: DataFrame) -> DataFrame:
        self._n += 1
        path = f"{self.root}/{self._n}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self._paths[id(out)] = (out, path)
        return out

    def drop(self, *tables: DataFrame) -> None:
        for table in tables:
            _, name = self._paths.pop(id(table), (None, None))
            if name is not None:
                path, fs = self._hadoop(name)
                fs.delete(path, True)

    def drop_all_but(self, *tables: DataFrame) -> None:
        kept = {id(t) for t in tables}
        self.drop(*[t for k, (t, _) in list(self._paths.items()) if k not in kept])

    def clear(self) -> None:
        path, fs = self._hadoop(self.root)
        fs.delete(path, True)
        self._paths.clear()


def join_spread(rows: DataFrame, table: DataFrame, keys: list[str], weight: str, total: int) -> DataFrame:
    """Inner join with a table that holds one row for each key and in ``weight`` how many of the ``total`` rows have it.

    A hot key would be one task of a shuffled join. Keys with more than a ``HOT_SHARE``th of all rows are fewer than
    ``HOT_SHARE``, so these are broadcast; the others are shuffled.
    """
    hot = table.where(F.col(weight) * HOT_SHARE > total)
    rest = table.where(F.col(weight) * HOT_SHARE <= total)
    return rows.join(F.broadcast(hot), keys).unionByName(rows.join(F.broadcast(hot.select(*keys)), keys, "left_anti").join(rest, keys))


def text_or_empty(name: str = "text"):
    return F.coalesce(F.col(name), F.lit("")).alias(name)
