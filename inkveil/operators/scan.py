"""Scan a table of texts: nested findings per row, or one row per finding."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkveil.functions.detect import detections, finding_count
from inkveil.functions.detectors import SEVERITIES, severity_rank
from inkveil.functions.redaction import covering_sql
from inkveil.functions.sqltext import column, expr, struct
from inkveil.functions.text import pieces, text_length, with_lines
from inkveil.plans.policy import DOCUMENT_SCHEMES, ScanPolicy


def policy_detections(text: str, policy: ScanPolicy, utf16: bool = False) -> Column:
    return detections(text, policy.detectors, policy.min_severity, utf16=utf16)


def policy_count(text: str, policy: ScanPolicy) -> Column:
    """Number of findings under a policy; cheaper than the findings themselves."""
    return finding_count(text, policy.detectors, policy.min_severity)


def one_row_each(df: DataFrame, keys: Sequence[str], found: str) -> DataFrame:
    """One row per element of the nested column ``found``.

    ``inline`` makes the optimizer add a filter on its argument, and a filter on
    a computed column is pushed below the projection: both would run the scan a
    second time.  ``inline_outer`` keeps it at one; empty rows are dropped after.
    """
    rows = df.select(*keys, F.inline_outer(found))
    return rows.where(F.col("ordinal").isNotNull())


def scan(
    df: DataFrame,
    text: str = "text",
    policy: ScanPolicy | None = None,
    *,
    utf16: bool = False,
) -> DataFrame:
    """Add ``detections``, ``text_length`` and ``scanned_at`` to every row.

    A narrow projection: rows stay in their partitions, in batch and in streams.
    """
    policy = policy or ScanPolicy()
    return df.withColumns(
        {
            "detections": policy_detections(text, policy, utf16),
            "text_length": F.coalesce(expr(text_length(column(text), utf16)), F.lit(0)),
            "scanned_at": F.current_timestamp(),
        }
    )


def findings(
    df: DataFrame,
    keys: Sequence[str],
    text: str = "text",
    policy: ScanPolicy | None = None,
    *,
    lines: bool = False,
    utf16: bool = False,
) -> DataFrame:
    """One row per finding: keys, the finding, and with ``lines`` its line and column.

    Clean rows drop out.  The text itself does not travel with the findings.
    """
    policy = policy or ScanPolicy()
    if lines and utf16:
        raise ValueError("lines are counted in code points")
    found = df.select(*keys, text, policy_detections(text, policy, utf16).alias("detections"))
    if lines:
        found = with_line_numbers(found, text)
    return one_row_each(found, keys, "detections")


def with_line_numbers(df: DataFrame, text: str, found: str = "detections") -> DataFrame:
    """Extend each finding of a nested scan by ``line`` and ``col``."""
    lined = with_lines("_pieces", f"`{found}`")
    return (
        df.withColumn("_pieces", F.when(F.size(found) > 0, expr(pieces(column(text)))))
        .withColumn(found, expr(lined))
        .drop("_pieces")
    )


def order_findings(found: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Total order over a whole table of findings: a range sort on all its keys."""
    return found.orderBy(*keys, "start", "ordinal")


def at_least(found: DataFrame, min_severity: str) -> DataFrame:
    """Stored findings of a severity or above."""
    return found.where(F.col("severity").isin(*SEVERITIES[severity_rank(min_severity) :]))


def overlaps(
    df: DataFrame,
    keys: Sequence[str],
    text: str = "text",
    policy: ScanPolicy | None = None,
) -> DataFrame:
    """Findings that start inside the span of an earlier one, with the type and start
    of the finding that opened the span.

    One pass over each row's findings; no pairs are formed.
    """
    policy = policy or ScanPolicy()
    ordered = F.expr("sort_array(transform(detections, _d -> " + struct(
        start="_d.start", back="-_d.end", ordinal="_d.ordinal", type="_d.type"
    ) + "))")
    inside = F.expr(
        "filter(arrays_zip(_ordered, _cover), (_z, _i) -> _i > 0 AND "
        "_z._cover.start = _cover[greatest(_i - 1, 0)].start)"
    )
    return (
        df.select(*keys, policy_detections(text, policy).alias("detections"))
        .select(*keys, ordered.alias("_ordered"), expr(covering_sql("detections")).alias("_cover"))
        .select(*keys, F.explode_outer(inside).alias("_pair"))
        .where(F.col("_pair").isNotNull())
        .select(
            *keys,
            F.col("_pair._ordered.type").alias("type"),
            F.col("_pair._ordered.start").alias("start"),
            (-F.col("_pair._ordered.back")).alias("end"),
            F.col("_pair._cover.type").alias("opened_by"),
            F.col("_pair._cover.start").alias("opened_at"),
        )
    )


def with_scheme(
    df: DataFrame, url: str, schemes: Iterable[str] = DOCUMENT_SCHEMES
) -> DataFrame:
    """Rows whose URL has one of the given schemes."""
    return df.where(F.try_parse_url(F.col(url), F.lit("PROTOCOL")).isin(*schemes))
