"""Scan texts as they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType


def stream_table(spark: SparkSession, folder: str, name: str, schema: StructType) -> DataFrame:
    """A parquet table as a stream of its files: it is one file, or a folder of them.

    The pattern stands for the table's own name; a plain path to a stream must be a folder.
    """
    return spark.readStream.schema(schema).parquet(f"{folder}/[{name[0]}]{name[1:]}.parquet")


def write_stream(
    df: DataFrame, path: str, checkpoint: str, *, mode: str = "append", available_now: bool = False
) -> StreamingQuery:
    """Write a stream to parquet.  The scan itself is the same projection as in batch."""
    writer = (
        df.writeStream.outputMode(mode)
        .format("parquet")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
    )
    if available_now:
        writer = writer.trigger(availableNow=True)
    return writer.start()
