"""Latest findings per document: a scan replaces the one before, closing removes it.

The latest row of a document is the state of a streaming aggregate, kept, compacted and
recovered by Spark's state store; what ``foreachBatch`` gets is only written.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from inkveil.operators.rescan import rescanned, scanned, unscanned
from inkveil.plans.policy import ScanPolicy


def latest_per_key(
    changes: DataFrame, keys: Sequence[str], order: Sequence[str], closed: Column | None = None
) -> DataFrame:
    """Last row per key; keys whose last row is ``closed`` drop out.

    An aggregate, not a window: each input partition keeps one row per key, so
    a key with very many changes costs one row per partition in the shuffle.
    """
    columns = changes.columns
    last = changes.groupBy(*keys).agg(
        F.max_by(F.struct(*columns), F.struct(*order)).alias("_last")
    )
    rows = last.select(*[F.col(f"_last.{name}").alias(name) for name in columns])
    return rows if closed is None else rows.where(~F.coalesce(closed, F.lit(False)))


class LatestFindings:
    """Keyed table of the latest findings.

    The stream of documents is scanned, by a projection, into narrow rows; the last row of
    each key is the state of an aggregate in update mode.  Closed documents stay in it as
    closed, so that a late change can't bring back an older state.  ``round`` counts the
    changes of policy: at the same version, the row of the later round counts.
    """

    def __init__(
        self,
        keys: Sequence[str],
        order: Sequence[str],
        text: str = "text",
        closed: str | None = None,
        policy: ScanPolicy | None = None,
        round: int = 0,
    ) -> None:
        self.keys = list(keys)
        self.order = list(order)
        self.text = text
        self.closed = closed
        self.policy = policy or ScanPolicy.documents()
        self.round = round

    def under(self, policy: ScanPolicy) -> LatestFindings:
        """The same table in the next round, under a new policy."""
        return LatestFindings(
            self.keys, self.order, self.text, self.closed, policy, self.round + 1
        )

    def _version(self) -> Column:
        return F.struct(*self.order)

    def rows(self, documents: DataFrame) -> DataFrame:
        """Narrow rows of a stream or table of documents: what is kept of each."""
        is_closed = F.expr(self.closed) if self.closed else F.lit(False)
        marked = documents.withColumn("closed", F.coalesce(is_closed, F.lit(False)))
        kept = scanned(marked, [*self.keys, "closed"], self._version(), self.text, self.policy)
        return kept.withColumn("round", F.lit(self.round))

    def latest(self, rows: DataFrame) -> DataFrame:
        """One row per key: as a stream, in update mode, those that a batch has changed."""
        last = F.max_by(F.struct(*rows.columns), F.struct("version", "round")).alias("last")
        return rows.groupBy(*self.keys).agg(last).select("last.*")

    def start(
        self, rows: DataFrame, path: str, checkpoint: str, *, available_now: bool = False
    ) -> StreamingQuery:
        """Keep the state, and write what each batch changes into its own folder of ``path``.

        A batch that runs again writes the same rows over its own.
        """

        def write(changed: DataFrame, batch_id: int) -> None:
            changed.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

        writer = (
            self.latest(rows)
            .writeStream.outputMode("update")
            .foreachBatch(write)
            .option("checkpointLocation", checkpoint)
        )
        return (writer.trigger(availableNow=True) if available_now else writer).start()

    def state(self, spark: SparkSession, checkpoint: str) -> DataFrame:
        """The last row of every key, closed ones included, from the state store itself."""
        store = spark.read.format("statestore").option("path", checkpoint).load()
        last = store.schema["value"].dataType.fieldNames()[0]
        return store.select(f"value.{last}.*")

    def read(self, spark: SparkSession, checkpoint: str) -> DataFrame:
        """The present findings of every open document."""
        return self.state(spark, checkpoint).where(~F.col("closed")).drop("closed")

    def rescan(self, state: DataFrame, documents: DataFrame, policy: ScanPolicy) -> DataFrame:
        """Rows of all open documents under a new policy, to be fed to the stream.

        ``state`` is what :meth:`state` reads; ``documents`` have the present texts, with
        keys and order.  Documents that are stored are scanned with the detectors that have
        changed only, unknown ones and other versions with all.  A document that is closed
        at the same or a later version stays so.
        """
        table = self.under(policy)
        is_open = state.where(~F.col("closed"))
        old = rescanned(is_open, documents, self.keys, self._version(), self.text, policy)
        new = unscanned(state, documents, self.keys, self._version())
        return (
            old.withColumns({"closed": F.lit(False), "round": F.lit(table.round)})
            .select(*self.keys, "closed", "version", "detections", "scanned_with", "round")
            .unionByName(table.rows(new))
        )
