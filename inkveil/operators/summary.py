"""Counts over findings.

Counts need no positions: detectors are counted per row and summed by ordinary
hash aggregates, which combine within each input partition first, so a type or
document that holds most findings is no hot spot.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkveil.functions.detect import counts_by_type
from inkveil.functions.detectors import detector_catalog
from inkveil.operators.scan import one_row_each, policy_count, policy_detections
from inkveil.plans.policy import DISPLAY_LEVELS, ScanPolicy


def type_counts(
    df: DataFrame,
    keys: Sequence[str],
    text: str = "text",
    policy: ScanPolicy | None = None,
) -> DataFrame:
    """One row per input row and type found: ordinal, type, category, severity, n_findings."""
    policy = policy or ScanPolicy()
    counts = counts_by_type(text, policy.detectors, policy.min_severity)
    return one_row_each(df.select(*keys, counts.alias("_counts")), keys, "_counts")


def count_by_type(
    df: DataFrame,
    keys: Sequence[str] = (),
    text: str = "text",
    policy: ScanPolicy | None = None,
) -> DataFrame:
    """Findings per type, over the whole table or per key."""
    counts = type_counts(df, keys, text, policy)
    return counts.groupBy(*keys, "type").agg(F.sum("n_findings").alias("n_findings"))


def count_by_type_severity(
    df: DataFrame,
    keys: Sequence[str] = (),
    text: str = "text",
    policy: ScanPolicy | None = None,
) -> DataFrame:
    """Findings per type and severity, with a line of text for each."""
    counts = type_counts(df, keys, text, policy)
    grouped = counts.groupBy(*keys, "type", "severity").agg(F.sum("n_findings").alias("n_findings"))
    return grouped.withColumn(
        "line", summary_line(F.col("type"), F.col("severity"), F.col("n_findings"))
    )


def summary_line(kind: Column, severity: Column, n: Column) -> Column:
    mark = F.when(severity == "critical", "error").otherwise("warning")
    # fixed wording of a line
    return F.concat(
        F.lit("- $("), mark, F.lit(") **"), kind, F.lit(" ("), severity, F.lit(")**: "),
        n.cast("string"), F.lit(" occurrence"), F.when(n > 1, "s").otherwise(""),
    )


def summary_text(found: str, *, with_severity: bool = False) -> Column:
    """Counts per type of a nested scan as lines of text, in the order of first sight."""

    def line(kind: Column) -> Column:
        same = F.filter(found, lambda d: d["type"] == kind)
        n = F.size(same)
        if with_severity:
            return summary_line(kind, F.get(same, F.lit(0))["severity"], n)
        return F.concat(F.lit("- **"), kind, F.lit("**: "), n.cast("string"))

    kinds = F.array_distinct(F.transform(found, lambda d: d["type"]))
    return F.array_join(F.transform(kinds, line), "\n")


def count_per_row(
    df: DataFrame,
    keys: Sequence[str],
    text: str = "text",
    policy: ScanPolicy | None = None,
) -> DataFrame:
    """Number of findings of every row, clean ones included."""
    return df.select(*keys, policy_count(text, policy or ScanPolicy()).alias("n_findings"))


def first_seen_types(
    df: DataFrame,
    keys: Sequence[str],
    text: str = "text",
    policy: ScanPolicy | None = None,
) -> DataFrame:
    """Counts per type of every row with findings as one text, in the order of first sight."""
    policy = policy or ScanPolicy()
    found = df.select(*keys, policy_detections(text, policy).alias("_found"))
    line = F.when(F.size("_found") > 0, F.array(summary_text("_found")))
    rows = found.select(*keys, F.explode_outer(line).alias("summary"))
    return rows.where(F.col("summary").isNotNull())


def display_level(
    category: Column, pii: str = "warning", secret: str = "error"
) -> Column:
    """Level at which a finding is shown; an unknown level counts as a warning."""

    def known(level: str) -> str:
        return level if level in DISPLAY_LEVELS else "warning"

    return F.when(category == "pii", known(pii)).otherwise(known(secret))


def count_by_level(
    df: DataFrame,
    text: str = "text",
    policy: ScanPolicy | None = None,
    *,
    pii: str = "warning",
    secret: str = "error",
) -> DataFrame:
    counts = type_counts(df, (), text, policy)
    level = display_level(F.col("category"), pii, secret).alias("level")
    return counts.groupBy(level).agg(F.sum("n_findings").alias("n_findings"))


def catalog_coverage(df: DataFrame, text: str = "text") -> DataFrame:
    """The detector catalog with the number of findings of each detector.

    Both sides are bounded by the number of detectors: findings are summed per
    type before the join.
    """
    counted = count_by_type(df, (), text).withColumnRenamed("type", "name")
    return (
        detector_catalog(df.sparkSession)
        .join(counted, "name", "left")
        .withColumn("n_findings", F.coalesce("n_findings", F.lit(0).cast("long")))
    )
