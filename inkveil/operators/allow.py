"""Findings that are allowed: known values, as keyed hashes, and scopes of paths and detectors.

A list of allowed values may grow without end and is a table; what it holds are hashes, so
it can be shared without giving a secret away.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: columns of a list of allowed values
ENTRY = ("value_hash", "type", "path")


@dataclass(frozen=True)
class Scope:
    """All findings of a detector under a path; None stands for all detectors, or all paths."""

    type: str | None = None
    path: str | None = None

    def __post_init__(self) -> None:
        if self.type is None and self.path is None:
            raise ValueError("a scope names a detector or a path")


def value_hash(value: Column, key: str) -> Column:
    """Keyed hash of a value: without the key, values can't be tried out."""
    inner = F.sha2(F.concat(F.lit(f"{key}\0in\0"), value), 256)
    return F.sha2(F.concat(F.lit(f"{key}\0out\0"), inner), 256)


def allowed_values(values: DataFrame, key: str) -> DataFrame:
    """Entries of ``value`` and, where there are such columns, ``type`` and ``path`` to which
    an entry is limited (null: any)."""
    scope = [
        (F.col(name) if name in values.columns else F.lit(None).cast("string")).alias(name)
        for name in ("type", "path")
    ]
    hashed = value_hash(F.col("value").cast("string"), key).alias("value_hash")
    return values.where(F.col("value").isNotNull()).select(hashed, *scope).distinct()


def _under(source: Column, path: Column) -> Column:
    """Whether a source is a path or lies below it; a name that only begins alike doesn't."""
    folder = F.concat(F.rtrim(path, F.lit("/")), F.lit("/"))
    return (source == path) | F.startswith(source, folder)


def _in_scope(scope: Scope, source: str) -> Column:
    tests = []
    if scope.type is not None:
        tests.append(F.col("type") == scope.type)
    if scope.path is not None:
        tests.append(F.coalesce(_under(F.col(source), F.lit(scope.path)), F.lit(False)))
    return reduce(lambda a, b: a & b, tests)


def not_allowed(
    found: DataFrame,
    entries: DataFrame | None,
    key: str,
    source: str,
    scopes: Sequence[Scope] = (),
) -> DataFrame:
    """Findings that neither an entry nor a scope allows.

    ``found`` has ``type, value`` and the column ``source`` with the path of the text.  The
    list is joined on hashes, never collected; a short one is broadcast where adaptive
    execution finds it short.  Where it is long, both sides are shuffled on the hash as they
    come, so that a value with a third of all findings is split over several tasks.
    Findings without a value are allowed by scopes only.
    """
    rest = found
    if scopes:
        rest = rest.where(~reduce(lambda a, b: a | b, [_in_scope(s, source) for s in scopes]))
    if entries is None:
        return rest
    marked = rest.withColumn("_hash", value_hash(F.col("value"), key)).alias("f")
    listed = entries.select(*ENTRY).alias("e")
    same = (
        (F.col("f._hash") == F.col("e.value_hash"))
        & (F.col("e.type").isNull() | (F.col("e.type") == F.col("f.type")))
        & (F.col("e.path").isNull() | _under(F.col(f"f.{source}"), F.col("e.path")))
    )
    return marked.join(listed, same, "left_anti").drop("_hash")
