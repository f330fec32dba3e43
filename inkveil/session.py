"""Spark session settings that fit the scans of this package."""

from __future__ import annotations

from pyspark.sql import SparkSession

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

SETTINGS = {
    # plans are re-made with measured sizes: hot join keys are split, small
    # shuffles coalesced, and a side is broadcast only if it turned out small
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # a scan costs far more per byte than a read: smaller splits even out tasks
    "spark.sql.files.maxPartitionBytes": str(64 << 20),
    # changes of one key are merged before the shuffle of a session window
    "spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition": "true",
    # state of streams lives on disk, beside the memory of an executor
    "spark.sql.streaming.stateStore.providerClass": ROCKSDB,
    "spark.sql.session.timeZone": "UTC",
    "spark.ui.enabled": "false",
}


def session(app: str = "inkveil", master: str | None = None, **settings: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **settings}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def keyed_state(spark: SparkSession) -> None:
    """Let streams that start from now on keep their state in RocksDB, as the latch needs."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors see, named by the cluster or by the caller.

    It is ``spark.checkpoint.dir``, or what ``setCheckpointDir`` was given.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        raise ValueError("set spark.checkpoint.dir to a folder that all executors can reach")
    return folder
