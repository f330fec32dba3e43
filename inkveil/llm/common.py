"""Helpers that several operators share."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from inkveil.session import shared_folder

#: rows for each bucket, where rows are numbered or summed in order
ROWS_PER_BUCKET = 1024
#: range of the 32 bits that place a row in an order
RANGE = 1 << 32


def staged(df: DataFrame, label: str, codec: str = "snappy") -> DataFrame:
    """Write the rows to the shared folder and read them again.

    Cuts the lineage: a lost executor costs the stage that runs, not the ones
    before it. A join on what was read shuffles both sides, so that adaptive
    execution can split a hot key, which it can't behind an aggregate.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/llm-{uuid.uuid4().hex}/{label}"
    df.write.option("compression", codec).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def place(hex_digest: Column) -> Column:
    """32 bits of a hexadecimal digest as a long, in the digest's own order."""
    return F.conv(F.substring(hex_digest, 1, 8), 16, 10).cast("long")


def buckets_for(rows: int) -> int:
    return max(1, -(-rows // ROWS_PER_BUCKET))


def _ahead(sums: DataFrame, group: list[str], order: str) -> DataFrame:
    """Adds ``_sums`` and ``_numbers``: what the rows ahead in their group have together."""
    ahead = Window.partitionBy(*group).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return sums.withColumn("_sums", F.coalesce(F.sum("_sum").over(ahead), F.lit(0))).withColumn(
        "_numbers", F.coalesce(F.sum("_rows").over(ahead), F.lit(0))
    )


def running(
    df: DataFrame,
    group: str,
    bits: str,
    order: list[str],
    amount: str,
    rows: int,
    narrow: DataFrame | None = None,
) -> DataFrame:
    """Adds ``before`` and ``number``: the amounts and the rows ahead of each row of its group.

    ``bits`` holds 32 even bits that ``order`` begins with. A group is cut into
    buckets of a thousand rows at most, on average, along them, and a thousand buckets
    are a stretch: the sums of the stretches are added up first, then those of the
    buckets in each, then the rows of each bucket, so no group is ever in one task.
    ``narrow`` has the same rows with fewer columns, where the sums can be had
    without reading all of ``df``.
    """
    bucket = F.floor(F.col(bits) * F.lit(buckets_for(rows)) / F.lit(RANGE)).cast("long")
    cut = df.withColumn("_bucket", bucket)
    buckets = staged(
        (df if narrow is None else narrow)
        .groupBy(F.col(group).alias("_group"), bucket.alias("_of"))
        .agg(F.sum(amount).alias("_sum"), F.count(F.lit(1)).alias("_rows"))
        .withColumn("_stretch", F.expr(f"_of div {ROWS_PER_BUCKET}")),
        "buckets",
    )
    stretches = buckets.groupBy("_group", "_stretch").agg(
        F.sum("_sum").alias("_sum"), F.sum("_rows").alias("_rows")
    )
    stretches = _ahead(stretches, ["_group"], "_stretch").select(
        "_group", "_stretch", F.col("_sums").alias("_before"), F.col("_numbers").alias("_first")
    )
    offsets = (
        _ahead(buckets, ["_group", "_stretch"], "_of")
        .join(stretches, ["_group", "_stretch"])
        .select(
            "_group",
            "_of",
            (F.col("_before") + F.col("_sums")).alias("_sums"),
            (F.col("_first") + F.col("_numbers")).alias("_numbers"),
        )
    )
    inside = Window.partitionBy(group, "_bucket").orderBy(*order)
    earlier = inside.rowsBetween(Window.unboundedPreceding, -1)
    met = cut.join(offsets, (F.col(group) == F.col("_group")) & (F.col("_bucket") == F.col("_of")))
    return (
        met.withColumn(
            "before", F.col("_sums") + F.coalesce(F.sum(amount).over(earlier), F.lit(0))
        )
        .withColumn("number", F.col("_numbers") + F.row_number().over(inside) - 1)
        .drop("_bucket", "_group", "_of", "_sums", "_numbers")
    )
