"""Joins that hold with a hot key."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def join_per_key(rows: DataFrame, per_key: DataFrame, key: str, how: str) -> DataFrame:
    """Join rows with an aggregate that has one row per ``key``.

    Adaptive execution splits a hot key only if both sides of the join come
    straight out of a shuffle.  An aggregate is partitioned by its key already
    and would be joined as it is, with all rows of the hot key in one task.  The
    hash as a second join key makes Spark shuffle the aggregate, the small side,
    once more; after that the rule applies.
    """
    check = F.xxhash64(key)
    joined = rows.withColumn("_check", check).join(
        per_key.withColumn("_check", check), [key, "_check"], how
    )
    return joined.drop("_check")
