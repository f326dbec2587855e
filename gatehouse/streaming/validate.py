"""Validation of streams: stateless projections and stream-static joins, so no watermark is needed."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..plans.engine import Validator


def validate_stream(stream: DataFrame, validator: Validator) -> DataFrame:
    """The annotated stream; lookup tables are read anew in every micro-batch."""
    return validator.validate(stream).df


def split_stream(stream: DataFrame, validator: Validator, valid_path: str, invalid_path: str, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """Write passing rows and quarantined rows to two Parquet folders. A micro-batch that is run again writes again the same rows under its own number."""

    def write(batch: DataFrame, number: int) -> None:
        frame = validator.validate(batch)
        frame.df.persist(StorageLevel.DISK_ONLY)  # read once, validated once, for both folders
        try:
            frame.valid().write.mode("overwrite").parquet(f"{valid_path}/batch={number}")
            frame.invalid().write.mode("overwrite").parquet(f"{invalid_path}/batch={number}")
        finally:
            frame.df.unpersist()

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
