"""Block latch: from its first finding on, a conversation is held.

The latch is keyed state of Spark's own: one row per blocked conversation and part, kept,
compacted and recovered by the RocksDB state store of the query's checkpoint.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import BooleanType, StructField, StructType

from inkveil.functions.detect import has_findings
from inkveil.plans.policy import ScanPolicy

#: parts that the messages of a conversation are spread over
SPREAD = 8
#: rows of one conversation part that wait in memory for the end of their batch; more of
#: them wait in the state store
WAITING = 1 << 14


#: columns that the latch adds to a message
DIRTY, NAME, UNNAMED, PART, MARK = OWN = (
    "latch_dirty",
    "latch_name",
    "latch_unnamed",
    "latch_part",
    "latch_mark",
)


class Latch(StatefulProcessor):
    """Holds what arrives after a finding, or in the same batch at its turn or later.

    Rows of a batch come in no order, so those that no finding holds yet wait until all of
    the batch are seen.
    """

    def __init__(
        self, conversation: str, turn: str, row: StructType, ttl_ms: int | None, waiting: int
    ) -> None:
        self.conversation = conversation
        self.turn = turn
        self.row = row
        self.ttl_ms = ttl_ms
        self.most = waiting

    def init(self, handle: StatefulProcessorHandle) -> None:
        fields = {"conversation": self.conversation, "turn": self.turn}
        first = StructType([StructField(k, self.row[v].dataType) for k, v in fields.items()])
        self.blocked = handle.getValueState("blocked", first, self.ttl_ms)
        row = [StructField(f"c{n}", f.dataType) for n, f in enumerate(self.row.fields)]
        self.later = handle.getListState("waiting", StructType(row))

    def handleInputRows(  # noqa: N802
        self,
        key: Any,
        rows: Iterator[pd.DataFrame],
        timerValues: Any,  # noqa: N803
    ) -> Iterator[pd.DataFrame]:
        known = self.blocked.get()
        names, turn = self.row.names, self.turn
        first, kept, stored = None, [], False
        for batch in rows:
            # names as they are: on the way, those with a leading underscore are lost
            batch.columns = [*names, *OWN]
            bad = batch.loc[batch[DIRTY], [self.conversation, turn]].dropna(subset=[turn])
            if len(bad):
                least = tuple(_tuples(bad.loc[[bad[turn].idxmin()]])[0])
                first = least if first is None or least[1] < first[1] else first
            own = batch.loc[~batch[MARK], names]
            if known is not None:
                yield own.assign(held=True)
                continue
            held = self._at_or_after(own, first)
            yield own[held].assign(held=True)
            kept.append(own[~held])
            if sum(map(len, kept)) > self.most:
                self.later.appendList(_tuples(pd.concat(kept)))
                kept, stored = [], True
        if stored:
            for row in self.later.get():
                kept.append(pd.DataFrame([row], columns=names))
                if len(kept) > self.most:
                    yield self._judged(kept, first)
                    kept = []
            self.later.clear()
        if kept:
            yield self._judged(kept, first)
        if first and (known is None or first[1] < known[1]):
            self.blocked.update(first)

    def _judged(self, kept: list[pd.DataFrame], first: tuple | None) -> pd.DataFrame:
        rows = pd.concat(kept)
        return rows.assign(held=self._at_or_after(rows, first))

    def _at_or_after(self, rows: pd.DataFrame, first: tuple | None) -> np.ndarray:
        """Rows without a turn are after none."""
        if not first:
            return np.zeros(len(rows), dtype=bool)
        held = [not pd.isna(turn) and turn >= first[1] for turn in rows[self.turn]]
        return np.array(held, dtype=bool)

    def close(self) -> None:
        pass


def _tuples(rows: pd.DataFrame) -> list[tuple]:
    plain = rows.astype(object).where(rows.notna(), None)
    return list(plain.itertuples(index=False, name=None))


class BlockLatch:
    """Decides on the messages of a stream.

    A conversation that an earlier batch has blocked is held, whatever the turn of a
    message that arrives now; within a batch, messages from the first bad turn on are.
    Messages are scanned before they are shuffled, by Spark's own functions, and only the
    ``carry`` columns travel.  The messages of a conversation are spread over ``spread``
    parts, to each of which its bad turns are copied, so that a conversation with a third
    of all messages is the work of several tasks.  Messages without a turn are held by
    earlier batches only.  With ``ttl_ms``, a conversation is released when so much time
    has passed since its last bad turn.
    """

    def __init__(
        self,
        conversation: str = "conv_id",
        turn: str = "turn",
        text: str = "text",
        policy: ScanPolicy | None = None,
        *,
        carry: Sequence[str] = (),
        spread: int = SPREAD,
        ttl_ms: int | None = None,
        waiting: int = WAITING,
    ) -> None:
        self.conversation = conversation
        self.turn = turn
        self.text = text
        self.policy = policy or ScanPolicy.interception()
        self.carry = [conversation, turn, *[c for c in carry if c not in (conversation, turn)]]
        self.spread = spread
        self.ttl_ms = ttl_ms
        self.waiting = waiting

    def marked(self, messages: DataFrame) -> DataFrame:
        """Rows for the state: each message once, and a mark in every other part if it is bad."""
        dirty = has_findings(self.text, self.policy.detectors, self.policy.min_severity)
        own = F.pmod(F.xxhash64(*self.carry), F.lit(self.spread)).cast("int")
        marks = F.sequence(F.lit(0), F.lit(self.spread - 1))
        name = F.col(self.conversation)
        # a key is never null: null keys would not be found again in a Python worker
        scanned = messages.select(
            *self.carry,
            dirty.alias(DIRTY),
            F.coalesce(name.cast("string"), F.lit("")).alias(NAME),
            name.isNull().alias(UNNAMED),
        )
        parts = F.when(F.col(DIRTY), marks).otherwise(F.array(own))
        placed = scanned.select("*", F.explode(parts).alias(PART))
        return placed.withColumn(MARK, F.col(PART) != own)

    def decided(self, messages: DataFrame) -> DataFrame:
        """The stream of the messages' ``carry`` columns and ``held``."""
        row = messages.select(*self.carry).schema
        result = StructType([*row.fields, StructField("held", BooleanType())])
        return (
            self.marked(messages)
            .groupBy(NAME, UNNAMED, PART)
            .transformWithStateInPandas(
                Latch(self.conversation, self.turn, row, self.ttl_ms, self.waiting),
                result,
                "append",
                "ProcessingTime" if self.ttl_ms else "none",
            )
        )

    def blocked(self, spark: SparkSession, checkpoint: str) -> DataFrame:
        """First bad turn of every blocked conversation, read from the state itself."""
        state = (
            spark.read.format("statestore")
            .option("path", checkpoint)
            .option("stateVarName", "blocked")
            .load()
        )
        return state.groupBy(F.col("value.conversation").alias(self.conversation)).agg(
            F.min("value.turn").alias("blocked_turn")
        )
