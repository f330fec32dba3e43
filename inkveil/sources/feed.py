"""A live feed as a stream: records appended to files, from standard input for example.

    tail -F app.log | python -m inkveil.sources.feed /shared/feed/app.txt

    scan_stream = read_feed(spark, "/shared/feed", checkpoint=place)

A record ends at a separator: a line feed, so that records are lines, or another character
such as NUL, so that they are whole texts.  Offsets are positions in bytes, one per file:
a batch that runs again reads the same records, and ``source`` and ``position`` name one
for good.  Records that have no end yet wait.
"""

from __future__ import annotations

import json
import sys
from collections.abc import Iterator
from typing import BinaryIO

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

from inkveil.sources.files import file_system

SCHEMA = "source string, position long, text string"
LINES, TEXTS = "\n", "\0"
#: bytes of a batch and of a task; a batch is longer only where a single record is
BATCH_BYTES, TASK_BYTES = 1 << 30, 32 << 20
BLOCK = 1 << 16
#: a batch of less than a task for every core is cut into as many, of no less than this
LEAST_TASK_BYTES = 1 << 18
#: bytes of records that a task gives at once, beside a record that is longer
GIVEN_BYTES = 1 << 20
KEY = "inkveil_feed"


def spool(stream: BinaryIO, path: str) -> int:
    """Append what a stream gives to a file as it comes; the number of bytes."""
    size = 0
    with open(path, "ab") as out:
        while block := (stream.read1(BLOCK) if hasattr(stream, "read1") else stream.read(BLOCK)):
            out.write(block)
            out.flush()
            size += len(block)
    return size


class Span(InputPartition):
    """Records that begin in a range of bytes of a file."""

    def __init__(self, path: str, begin: int, end: int, limit: int) -> None:
        self.path, self.begin, self.end, self.limit = path, begin, end, limit


class FeedReader(DataSourceStreamReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.folder = options["path"]
        self.separator = options.get("separator", LINES).encode()
        if len(self.separator) != 1:
            raise ValueError("a separator is one byte")
        self.batch_bytes = int(options.get("batchbytes", BATCH_BYTES))
        self.task_bytes = int(options.get("taskbytes", TASK_BYTES))
        self.tasks = int(options.get("tasks", "1"))
        self.checkpoint = options.get("checkpoint")
        self.at: dict[str, int] | None = None

    # --- offsets: on the driver -------------------------------------------------
    def initialOffset(self) -> dict:  # noqa: N802
        return {KEY: {}}

    def latestOffset(self) -> dict:  # noqa: N802
        """As far as complete records reach, and no further than a batch may."""
        if self.at is None:
            self.at = self._logged()
        left, reached = self.batch_bytes, dict(self.at)
        for path, size in sorted(self._sizes().items()):
            begin = self.at.get(path, 0)
            if left > 0 and size > begin:
                end = self._last_end(path, begin, size, min(size, begin + left))
                if end > begin:
                    reached[path] = end
                    left -= end - begin
        return {KEY: reached}

    def partitions(self, start: dict, end: dict) -> list[Span]:
        """Spans of a batch: of the bytes of a task, or less, so that every core has one."""
        spans, begins = [], start[KEY]
        new = [(path, begins.get(path, 0), until) for path, until in end[KEY].items()]
        new = [(path, begin, until) for path, begin, until in new if until > begin]
        step = max(-(-sum(until - begin for _, begin, until in new) // self.tasks), LEAST_TASK_BYTES)
        # ends of files make spans of their own: a few more than cores would take twice the time
        while step < self.task_bytes and sum(-(-(u - b) // step) for _, b, u in new) > self.tasks:
            step += -(-step // 8)
        step = min(step, self.task_bytes)
        for path, begin, until in new:
            for at in range(begin, until, step):
                spans.append(Span(path, at, min(at + step, until), until))
        self.at = dict(end[KEY])
        return spans

    def _logged(self) -> dict[str, int]:
        """Where the query stands, from the offsets that Spark has logged for it.

        A reader that starts anew isn't told; without this the first batch after a restart
        would hold all that has come meanwhile, whatever the limit.
        """
        from pyarrow import fs

        if not self.checkpoint:
            return {}
        system, place = file_system(f"{self.checkpoint}/offsets")
        if system.get_file_info(place).type != fs.FileType.Directory:
            return {}
        logged = system.get_file_info(fs.FileSelector(place))
        numbers = [int(x.base_name) for x in logged if x.base_name.isdigit()]
        if not numbers:
            return {}
        with system.open_input_stream(f"{place}/{max(numbers)}") as stream:
            lines = stream.read().decode().splitlines()
        for line in lines:
            if KEY in line and KEY in (offset := json.loads(line)):
                return dict(offset[KEY])
        return {}

    def _sizes(self) -> dict[str, int]:
        from pyarrow import fs

        system, place = file_system(self.folder)
        if system.get_file_info(place).type != fs.FileType.Directory:
            return {}
        found = system.get_file_info(fs.FileSelector(place, recursive=True))
        own = (x for x in found if x.type == fs.FileType.File)
        # as everywhere in Spark, other names are not data
        return {x.path: x.size for x in own if x.base_name[0] not in "._"}

    def _last_end(self, path: str, begin: int, size: int, until: int) -> int:
        """End of the last record that ends before ``until``, else of the first at all."""
        system, _ = file_system(self.folder)
        with system.open_input_file(path) as file:
            at = until
            while at > begin:
                low = max(begin, at - BLOCK)
                found = file.read_at(at - low, low).rfind(self.separator)
                if found >= 0:
                    return low + found + len(self.separator)
                at = low
            at = until
            while at < size:
                found = file.read_at(min(BLOCK, size - at), at).find(self.separator)
                if found >= 0:
                    return at + found + len(self.separator)
                at += BLOCK
        return begin

    # --- records: on the executors ----------------------------------------------
    def read(self, partition: Span) -> Iterator:
        """Arrow batches of the records."""
        import pyarrow as pa

        schema = pa.schema([("source", pa.string()), ("position", pa.int64()), ("text", pa.string())])

        def batch(places: list[int], texts: list[str]) -> pa.RecordBatch:
            columns = [[partition.path] * len(places), places, texts]
            arrays = [pa.array(x, f.type) for x, f in zip(columns, schema)]
            return pa.RecordBatch.from_arrays(arrays, schema=schema)

        places, texts, size = [], [], 0
        for at, record in self._records(partition):
            places.append(at)
            texts.append(record.decode("utf-8", "replace"))
            size += len(record)
            if size >= GIVEN_BYTES or len(places) >= BLOCK:
                yield batch(places, texts)
                places, texts, size = [], [], 0
        if places:
            yield batch(places, texts)

    def _records(self, partition: Span) -> Iterator[tuple[int, bytes]]:
        """Records that begin in the range; the last one may end behind it."""
        system, _ = file_system(self.folder)
        mark = len(self.separator)
        with system.open_input_file(partition.path) as file:
            at = partition.begin
            # a record begins behind a separator
            if at and file.read_at(mark, at - mark) != self.separator:
                at = self._next(file, at, partition.limit)
            while at < partition.end:
                end = self._next(file, at, partition.limit)
                block = file.read_at(end - at, at)
                if end - at < BLOCK and end < partition.end:
                    # many short records: a block of them at once
                    end = min(partition.end, end + 16 * BLOCK)
                    block = file.read_at(end - at, at)
                    end = at + block.rfind(self.separator) + mark
                    block = block[: end - at]
                for record in block[:-mark].split(self.separator):
                    yield at, record
                    at += len(record) + mark

    def _next(self, file, at: int, limit: int) -> int:
        """Behind the next separator."""
        while at < limit:
            found = file.read_at(min(BLOCK, limit - at), at).find(self.separator)
            if found >= 0:
                return at + found + len(self.separator)
            at += BLOCK
        return limit


class Feed(DataSource):
    """``spark.readStream.format("inkveil_feed")`` with the options ``path``, ``separator``,
    ``batchBytes``, ``taskBytes``, ``tasks`` and ``checkpoint``."""

    @classmethod
    def name(cls) -> str:
        return KEY

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema: StructType) -> FeedReader:  # noqa: N802
        return FeedReader({k.lower(): v for k, v in self.options.items()})


def read_feed(
    spark: SparkSession,
    folder: str,
    *,
    separator: str = LINES,
    batch_bytes: int = BATCH_BYTES,
    task_bytes: int = TASK_BYTES,
    checkpoint: str | None = None,
) -> DataFrame:
    """``source, position, text`` of the records in all files of a folder, as a stream.

    ``checkpoint`` is that of the query; it lets the limit of a batch hold from the first
    batch after a restart on.
    """
    spark.dataSource.register(Feed)
    options = {"path": folder, "separator": separator, "batchBytes": batch_bytes, "taskBytes": task_bytes}
    options["tasks"] = spark.sparkContext.defaultParallelism
    if checkpoint:
        options["checkpoint"] = checkpoint
    return spark.readStream.format(Feed.name()).options(**options).load()


if __name__ == "__main__":
    spool(sys.stdin.buffer, sys.argv[1])
