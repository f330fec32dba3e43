"""Scan only the last change of a burst of changes to the same key.

A burst ends when its key is quiet for ``gap_ms``.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener
from pyspark.sql.streaming.listener import (
    QueryIdleEvent,
    QueryProgressEvent,
    QueryStartedEvent,
    QueryTerminatedEvent,
)
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StringType, StructField, StructType, TimestampNTZType

# --- fixed value: quiet time after which a change is scanned ------------------
GAP_MS = 300

SLICE_GAPS = 16
ON_TIME, LATE, NO_TIME = "on_time", "late", "no_time"


def _micros(df: DataFrame, ts: str) -> Column:
    """Microseconds since the epoch; wall-clock timestamps are not moved by a time zone."""
    if df.schema[ts].dataType == TimestampNTZType():
        epoch = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
        return F.timestamp_diff("MICROSECOND", epoch, F.col(ts))
    return F.unix_micros(F.col(ts))


def last_of_bursts(
    changes: DataFrame, key: str, ts: str, order: str, gap_ms: int = GAP_MS
) -> DataFrame:
    """Changes that no other change of the same key follows within the gap.

    One shuffle, by key *and* slice of time, so a key with a third of all rows
    is spread over many tasks.  The next change of a row may lie in the next
    slice only if it comes within ``gap_ms`` of that slice's start; such rows
    are copied to the slice before as markers, one row in ``SLICE_GAPS`` when
    changes come evenly.
    """
    gap = gap_ms * 1000
    width = gap * SLICE_GAPS
    timeless = -1 - F.pmod(F.xxhash64(order), F.lit(1 << 20))  # rows without a time, spread out
    own = F.coalesce(F.floor(F.col("_us") / F.lit(width)), timeless)
    own_slot = F.struct(own.alias("slice"), F.lit(False).alias("marker"))
    before_slot = F.struct((own - 1).alias("slice"), F.lit(True).alias("marker"))
    near_start = F.col("_us") - own * width <= gap
    slots = F.when(near_start, F.array(own_slot, before_slot)).otherwise(F.array(own_slot))
    in_slice = Window.partitionBy(key, "_slot.slice").orderBy("_us", order)
    return (
        changes.withColumn("_us", _micros(changes, ts))
        .withColumn("_slot", F.explode(slots))
        .withColumn("_next", F.lead("_us").over(in_slice))
        .where(~F.col("_slot.marker"))
        .where(F.col("_next").isNull() | (F.col("_next") - F.col("_us") > gap))
        .drop("_us", "_slot", "_next")
    )


def last_of_bursts_stream(
    changes: DataFrame, key: str, ts: str, order: str, gap_ms: int = GAP_MS, *, delay: str
) -> DataFrame:
    """The same for a stream: one row per burst, once the watermark has passed its end.

    Bursts are session windows, kept by key *and* slice of time: the state of a busy
    key is many rows in many tasks, each the last change of an open burst in its
    slice.  As in batch, changes near the start of a slice are copied to the slice
    before; a burst there that ends with such a marker goes on in the next slice.

    Changes that come later than ``delay`` are dropped here, and so are rows without a time,
    which have no place in a stream of bursts: :func:`with_lateness` sets both aside before.
    Works in batch as well.
    """
    columns = changes.columns
    gap = gap_ms * 1000
    width = gap * SLICE_GAPS
    own = F.floor(F.col("_us") / F.lit(width))
    slot = lambda n, marker: F.struct(n.alias("slice"), F.lit(marker).alias("marker"))
    near_start = F.col("_us") - own * width <= gap
    slots = F.when(near_start, F.array(slot(own, False), slot(own - 1, True))).otherwise(
        F.array(slot(own, False))
    )
    placed = (
        changes.withWatermark(ts, delay)
        .withColumn("_us", _micros(changes, ts))
        .withColumn("_slot", F.explode_outer(slots))
        .withColumn("_slice", F.col("_slot.slice"))
    )
    last = F.max_by(F.struct("_slot.marker", *columns), F.struct(ts, order)).alias("_last")
    bursts = placed.groupBy(F.session_window(ts, f"{gap_ms} milliseconds"), key, "_slice").agg(last)
    return bursts.where(~F.col("_last.marker")).select(
        *[F.col(f"_last.{name}").alias(name) for name in columns]
    )


def with_lateness(changes: DataFrame, ts: str, delay: str, parts: int = 64) -> DataFrame:
    """Adds ``lateness`` to the rows of a stream: on time, late, or without a time.

    A row is late if its time is not after the watermark with which its batch begins.  No row
    is dropped: written by a file sink, the rows on time can be read on as a stream of which
    :func:`last_of_bursts_stream` drops none, the others are a table.  The second stream reads
    the sink's folder without a limit on files, so that no batch of the first is split.  The
    watermark is known to stateful operators only, so rows pass one that keeps
    no state; they are spread evenly over ``parts`` groups, whatever their keys.
    """
    result = StructType([*changes.schema.fields, StructField("lateness", StringType())])
    on_time, late, no_time = ON_TIME, LATE, NO_TIME

    def judge(_: tuple, rows: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        watermark = pd.Timestamp(state.getCurrentWatermarkMs(), unit="ms")
        for batch in rows:
            times = pd.to_datetime(batch[ts])
            if times.dt.tz is not None:
                times = times.dt.tz_convert("UTC").dt.tz_localize(None)
            lateness = pd.Series(on_time, index=batch.index, dtype=object)
            lateness[times <= watermark] = late
            lateness[times.isna()] = no_time
            yield batch.drop(columns=["part"]).assign(lateness=lateness)

    part = F.pmod(F.xxhash64(*[c for c in changes.columns]), F.lit(parts)).alias("part")
    placed = changes.withWatermark(ts, delay).select("*", part)
    return placed.groupBy("part").applyInPandasWithState(
        judge, result, "unused int", "append", GroupStateTimeout.NoTimeout
    )


class LateRows(StreamingQueryListener):
    """Counts, for each query, the rows that it has dropped as later than its delay.

    Add it to ``spark.streams`` before queries start: it adds up every report, of which a
    query itself remembers the last hundred only.  Rows merged before they are dropped
    count once.
    """

    def __init__(self) -> None:
        self.dropped: dict[str, int] = defaultdict(int)

    def onQueryStarted(self, event: QueryStartedEvent) -> None:  # noqa: N802
        self.dropped[str(event.id)] += 0

    def onQueryProgress(self, event: QueryProgressEvent) -> None:  # noqa: N802
        for state in event.progress.stateOperators:
            self.dropped[str(event.progress.id)] += state.numRowsDroppedByWatermark

    def onQueryIdle(self, event: QueryIdleEvent) -> None:  # noqa: N802
        pass

    def onQueryTerminated(self, event: QueryTerminatedEvent) -> None:  # noqa: N802
        pass
