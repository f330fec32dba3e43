"""Where results go."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkveil.sources.files import file_system


def write_findings(found: DataFrame, path: str, *, with_values: bool = False) -> None:
    """Findings as parquet.

    The values themselves are left out unless asked for: a table of positions
    and types can be kept as an audit log, a table of secrets should not be.
    """
    kept = found if with_values else found.drop("value")
    kept.write.mode("append").parquet(path)


def write_json_report(report: DataFrame, path: str) -> None:
    """One JSON object per line."""
    report.select(F.col("report").alias("value")).write.mode("overwrite").text(path)


def write_redacted(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def write_texts(df: DataFrame, name: str, content: str, folder: str) -> DataFrame:
    """Every row as a file of its own: ``source, bytes`` of the files, which are written as
    these rows are read.

    ``name`` is the file's name, unique among the rows; ``content`` a text or bytes.  Files
    lie in 256 folders by a hash of the name.  A task that runs again writes the same files.
    """

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        system, place = file_system(folder)
        made = set()
        for batch in batches:
            rows = []
            for own, raw in zip(batch["name"], batch["content"]):
                inner = f"{zlib.crc32(own.encode()) % 256:02x}"
                if inner not in made:
                    system.create_dir(f"{place}/{inner}", recursive=True)
                    made.add(inner)
                with system.open_output_stream(f"{place}/{inner}/{own}") as file:
                    file.write(raw)
                rows.append((f"{folder}/{inner}/{own}", len(raw)))
            yield pd.DataFrame(rows, columns=["source", "bytes"])

    named = F.col(name).cast("string").alias("name")
    raw = F.coalesce(F.col(content).cast("binary"), F.lit(b"")).alias("content")
    return df.select(named, raw).mapInPandas(write, "source string, bytes long")


def write_entries(entries: DataFrame, path: str) -> None:
    """Text report, one entry per finding, sorted by source and position."""
    ordered = entries.orderBy("source", "start", "ordinal")
    ordered.select(F.col("entry").alias("value")).write.mode("overwrite").text(path)
