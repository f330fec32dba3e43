"""Audit log: who found what, where, when, and what was done; each event once.

The log holds no content: a value is there only as part of a keyed fingerprint.  A batch
has a folder of its own, which a batch that runs again writes over, and an event that an
earlier batch has logged is not logged again.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from inkveil.operators.allow import value_hash

ACTIONS = ("found", "warned", "redacted", "blocked", "allowed")


class AuditLog:
    """``keys`` name a text; ``key`` is the secret of the fingerprints, which the log never holds."""

    def __init__(self, path: str, keys: Sequence[str], key: str) -> None:
        self.path = path
        self.keys = list(keys)
        self.key = key

    def _fingerprint(self, actor: str, action: Column) -> Column:
        """Of the place, the kind, the value, the actor and the action, not of the time."""
        parts = F.struct(*self.keys, "type", "start", "end", "value", F.lit(actor), action)
        return F.substring(value_hash(F.to_json(parts, {"ignoreNullFields": "false"}), self.key), 1, 32)

    def events(self, found: DataFrame, actor: str, action: str | Column = "found") -> DataFrame:
        """Findings as events, repeated ones once."""
        act = F.lit(action) if isinstance(action, str) else action
        if isinstance(action, str) and action not in ACTIONS:
            raise ValueError(f"unknown action {action!r}, expected one of {ACTIONS}")
        made = found.select(
            self._fingerprint(actor, act).alias("fingerprint"),
            *self.keys,
            "type",
            "category",
            "severity",
            "start",
            "end",
            act.alias("action"),
            F.lit(actor).alias("actor"),
        )
        return made.dropDuplicates(["fingerprint"])

    def append(
        self, found: DataFrame, batch: int, actor: str, action: str | Column = "found"
    ) -> None:
        """Log a batch of findings.  The same batch twice is the same log.

        Of what was logged before, only fingerprints are read.
        """
        spark = found.sparkSession
        events = self.events(found, actor, action)
        known = self._before(spark, batch)
        if known is not None:
            events = events.join(known, "fingerprint", "left_anti")
        stamped = events.withColumn("at", F.current_timestamp())
        stamped.write.mode("overwrite").parquet(f"{self.path}/batch={batch}")

    def _before(self, spark: SparkSession, batch: int) -> DataFrame | None:
        log = self._log(spark)
        if log is None:
            return None
        return log.where(F.col("batch") < batch).select("fingerprint")

    def _log(self, spark: SparkSession) -> DataFrame | None:
        try:
            return spark.read.parquet(self.path)
        except AnalysisException as error:
            if error.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
                return None
            raise

    def read(self, spark: SparkSession) -> DataFrame:
        log = self._log(spark)
        if log is None:
            raise ValueError(f"nothing has been logged in {self.path}")
        return log
