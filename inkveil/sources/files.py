"""Files as rows: one row per file, whole file as one text, with its size or its error.

A Python data source whose partitions are packs of files, so that millions of small files
are thousands of tasks.  Unlike Spark's own file sources it has a row for every file: empty
ones have an empty text, and one that can't be read has an error where others have a text.
"""

from __future__ import annotations

import fnmatch
import heapq
import re
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from inkveil.operators.gate import UNREADABLE

#: a pack ends with the file that makes it reach one of these
PACK_BYTES, PACK_FILES = 32 << 20, 4096
#: bytes of the files that a task holds at once, beside one that is larger
BATCH_BYTES = 4 << 20
SCHEMA = "source string, bytes long, text string, error string"


def file_system(path: str):
    """File system of a path or URI, and the path in it."""
    from pyarrow import fs

    # Hadoop writes local paths with one slash
    return fs.FileSystem.from_uri(re.sub("^file:/(?!/)", "file:///", path))


def _listed(path: str, pattern: str | None) -> Iterator[tuple[str, int | None]]:
    """Files under a path, or the path itself; without a size if it isn't there."""
    from pyarrow import fs

    system, place = file_system(path)
    prefix = path[: len(path) - len(place)] if path.endswith(place) else ""
    info = system.get_file_info(place)
    found = [info]
    if info.type == fs.FileType.Directory:
        found = system.get_file_info(fs.FileSelector(place, recursive=True))
    for entry in found:
        if entry.type == fs.FileType.Directory:
            continue
        if pattern is None or fnmatch.fnmatch(entry.base_name, pattern):
            yield prefix + entry.path, entry.size


def packed(files: list[tuple[str, int | None]], tasks: int = 1) -> list[list[str]]:
    """Files in packs of even size: the largest first, each into the lightest pack.

    There are as many packs as bytes, files and tasks ask for.
    """
    sizes = sorted(((size or 0, path) for path, size in files), reverse=True)
    total = sum(size for size, _ in sizes)
    wanted = max(-(-total // PACK_BYTES), -(-len(sizes) // PACK_FILES), min(tasks, len(sizes)))
    heap: list[tuple[int, int, int]] = [(0, 0, n) for n in range(wanted)]
    packs: list[list[str]] = [[] for _ in range(wanted)]
    for size, path in sizes:
        load, count, n = heapq.heappop(heap)
        packs[n].append(path)
        heapq.heappush(heap, (load + size, count + 1, n))
    return packs


def read_file(path: str) -> tuple[str, int | None, str | None, str | None]:
    """A row of one file; bytes that are not UTF-8 become replacement characters."""
    try:
        system, place = file_system(path)
        with system.open_input_stream(place) as stream:
            raw = stream.read()
        return path, len(raw), raw.decode("utf-8", "replace"), None
    except Exception as error:  # noqa: BLE001  whatever it is, it is the file's
        return path, None, None, f"{type(error).__name__}: {error}"


class Pack(InputPartition):
    def __init__(self, paths: list[str]) -> None:
        self.paths = paths


class PackReader(DataSourceReader):
    """Every task gets the reader as it is after listing, and its own pack: the reader keeps
    the options alone, not the names of all files."""

    def __init__(self, options: dict[str, str]) -> None:
        self.given = options.get("paths") or options.get("path") or ""
        self.pattern = options.get("pattern")
        self.tasks = int(options.get("tasks", "1"))

    def partitions(self) -> list[Pack]:
        found: dict[str, int | None] = {}
        for path in self.given.splitlines():
            found.update(_listed(path, self.pattern))
        return [Pack(paths) for paths in packed(list(found.items()), self.tasks)]

    def read(self, partition: Pack | None) -> Iterator:
        import pyarrow as pa

        schema = pa.schema(
            [("source", pa.string()), ("bytes", pa.int64()), ("text", pa.string()), ("error", pa.string())]
        )
        # where there are no packs, Spark asks for one that is None
        for rows in bounded(map(read_file, partition.paths if partition else [])):
            columns = [pa.array(x, f.type) for x, f in zip(zip(*rows), schema)]
            yield pa.RecordBatch.from_arrays(columns, schema=schema)


def bounded(rows: Iterator[tuple]) -> Iterator[list[tuple]]:
    """Rows of :func:`read_file` in lists that end with the one that makes them reach a size."""
    waiting, size = [], 0
    for row in rows:
        waiting.append(row)
        size += row[1] or 0
        if size >= BATCH_BYTES or len(waiting) >= PACK_FILES:
            yield waiting
            waiting, size = [], 0
    if waiting:
        yield waiting


class TextFiles(DataSource):
    """``spark.read.format("inkveil_files")`` with the options ``paths`` (one a line), ``pattern``
    and ``tasks``."""

    @classmethod
    def name(cls) -> str:
        return "inkveil_files"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> PackReader:
        return PackReader(dict(self.options))


def read_texts(spark: SparkSession, path: str | list[str], pattern: str | None = None) -> DataFrame:
    """``source, bytes, text, error`` of every file under ``path``, and of every path that names none.

    The driver lists names and sizes; executors read.  A tree too large for that is listed
    by whoever wrote it: :func:`read_listed` takes a table of paths.
    """
    spark.dataSource.register(TextFiles)
    reader = spark.read.format(TextFiles.name()).options(
        paths=path if isinstance(path, str) else "\n".join(path),
        tasks=spark.sparkContext.defaultParallelism,
    )
    return (reader.option("pattern", pattern) if pattern else reader).load()


def read_listed(paths: DataFrame, tasks: int | None = None) -> DataFrame:
    """The same for a table with a column ``source``; nothing is listed by the driver.

    Rows are spread by a hash of their name.  A file is one row and is read by one task.
    """

    def read(batches: Iterator) -> Iterator:
        import pandas as pd

        for batch in batches:
            for rows in bounded(map(read_file, batch["source"])):
                yield _frame(pd, rows)

    named = paths.select("source").where(F.col("source").isNotNull())
    spread = named.repartition(tasks, "source") if tasks else named.repartition("source")
    return spread.mapInPandas(read, SCHEMA)


def _frame(pd, rows: list[tuple]):
    frame = pd.DataFrame(rows, columns=["source", "bytes", "text", "error"])
    return frame.assign(bytes=frame["bytes"].astype("Int64"))


def unreadable() -> F.Column:
    """Condition of :func:`inkveil.operators.gate.verdict` for files."""
    return F.col("error").isNotNull()


def judge_listed(expected: DataFrame, judged: DataFrame) -> DataFrame:
    """``source, verdict`` of the expected sources; unreadable where no text was judged.

    ``expected`` has a column ``source``: a listing, or the paths someone asked
    for; ``judged`` the verdicts of the texts that were read.  Only names and numbers
    are joined, texts are not.  Sources are unique on both sides: no hot key.
    """
    verdicts = judged.select("source", "verdict")
    joined = expected.select("source").join(verdicts, "source", "left")
    return joined.withColumn("verdict", F.coalesce("verdict", F.lit(UNREADABLE)))
