"""Reports about findings: positions, marked lines, JSON."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkveil.operators.scan import policy_count, policy_detections, with_line_numbers
from inkveil.plans.policy import ScanPolicy

# --- fixed value: width of a severity label -----------------------------------
LABEL_WIDTH = 10

#: characters that are two units in UTF-16
ASTRAL = r"[\x{10000}-\x{10FFFF}]"


def severity_label(severity: Column) -> Column:
    return F.rpad(F.concat(F.lit("["), F.upper(severity), F.lit("]")), LABEL_WIDTH, " ")


def marked_lines(
    df: DataFrame,
    keys: Sequence[str],
    source: Column,
    text: str = "text",
    policy: ScanPolicy | None = None,
) -> DataFrame:
    """One row per finding with its line of text, the marks under it and the full entry.

    The lines of a row are split once; each finding picks its own after the
    findings have become rows, so a long line is never held once per finding.
    """
    policy = policy or ScanPolicy.batch()
    found = df.select(
        *keys,
        source.cast("string").alias("source"),
        text,
        policy_detections(text, policy).alias("detections"),
    )
    rows = (
        with_line_numbers(found, text)
        .withColumn("_lines", F.when(F.size("detections") > 0, F.split(F.col(text), "\n", -1)))
        .select(*keys, "source", "_lines", F.inline_outer("detections"))
        .where(F.col("ordinal").isNotNull())
        .withColumn("line_text", F.get("_lines", F.col("line") - 1))
    )
    line_start = F.col("start") - F.col("col")
    marked_to = F.least(F.col("end") - line_start, F.length("line_text"))
    marks = F.concat(
        F.repeat(F.lit(" "), F.col("col")),
        F.repeat(F.lit("^"), F.greatest(F.lit(1), marked_to - F.col("col"))),
    )
    # fixed wording of an entry
    entry = F.concat(
        F.lit("  "), severity_label(F.col("severity")), F.lit(" "), F.col("message"),
        F.lit("\n    "), F.col("source"), F.lit(":"), F.col("line").cast("string"),
        F.lit("  "), F.col("type"),
        F.lit("\n    "), F.col("line_text"),
        F.lit("\n    "), F.col("marks"), F.lit("\n"),
    )
    return (
        rows.drop("_lines")
        .withColumn("marks", marks)
        .withColumn("entry", entry)
        .select(
            *keys, "source", "type", "severity", "start", "end", "ordinal", "line", "col",
            "line_text", "marks", "entry",
        )
    )


def headlines(
    df: DataFrame,
    keys: Sequence[str],
    source: Column,
    text: str = "text",
    policy: ScanPolicy | None = None,
) -> DataFrame:
    """First line of the report of each source: ``clean``, or the number of findings."""
    policy = policy or ScanPolicy.batch()
    counted = df.select(
        *keys, source.cast("string").alias("source"), policy_count(text, policy).alias("_n")
    )
    # fixed wording of a headline
    clean = F.concat(F.col("source"), F.lit(": clean"))
    dirty = F.concat(F.col("source"), F.lit(": "), F.col("_n").cast("string"), F.lit(" finding(s)"))
    return counted.withColumn("headline", F.when(F.col("_n") == 0, clean).otherwise(dirty)).drop("_n")


def json_report(
    df: DataFrame,
    keys: Sequence[str],
    source: Column,
    text: str = "text",
    policy: ScanPolicy | None = None,
    *,
    utf16: bool = False,
) -> DataFrame:
    """One JSON object per source, in the column ``report``.

    Positions are code points, or UTF-16 units with ``utf16``.  Both are the same for
    almost all texts; only those with characters outside the basic plane are scanned
    for units as well.
    """
    policy = policy or ScanPolicy.batch()
    scanned = with_line_numbers(
        df.select(
            *keys,
            source.cast("string").alias("source"),
            text,
            policy_detections(text, policy).alias("detections"),
        ),
        text,
    )
    if utf16:
        units = F.when(F.col(text).rlike(ASTRAL), policy_detections(text, policy, utf16=True))
        scanned = scanned.withColumn("_units", units).withColumn(
            "detections",
            F.when(
                F.col("_units").isNotNull(),
                F.zip_with(
                    "detections",
                    "_units",
                    lambda d, u: d.withField("start", u["start"]).withField("end", u["end"]),
                ),
            ).otherwise(F.col("detections")),
        )
    listed = F.transform(
        "detections",
        lambda d: F.struct(
            *(
                d[name].alias(name)
                for name in ("type", "category", "severity", "start", "end", "message", "line")
            )
        ),
    )
    dirty = F.to_json(
        F.struct("source", F.lit(False).alias("clean"), listed.alias("detections"))
    )
    clean = F.to_json(
        F.struct("source", listed.alias("detections"), F.lit(True).alias("clean"))
    )
    return scanned.select(
        *keys, F.when(F.size("detections") > 0, dirty).otherwise(clean).alias("report")
    )
