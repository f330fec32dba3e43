"""Redacted tables."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkveil.functions.redaction import only, redact
from inkveil.operators.scan import policy_detections
from inkveil.plans.policy import ScanPolicy


def redacted(
    df: DataFrame,
    text: str = "text",
    policy: ScanPolicy | None = None,
    *,
    mode: str = "safe",
    types: Iterable[str] | None = None,
    categories: Iterable[str] | None = None,
    out: str = "redacted",
) -> DataFrame:
    """Add the redacted text and ``n_redacted``, the number of findings in it.

    ``types`` and ``categories`` redact a part of the findings.  Clean rows pass
    through unchanged.  One projection, no shuffle.
    """
    policy = policy or ScanPolicy()
    marked = df.withColumn("_found", policy_detections(text, policy))
    if types is not None or categories is not None:
        marked = marked.withColumn("_found", only("_found", types, categories))
    return marked.withColumns(
        {out: redact(text, "_found", mode), "n_redacted": F.size("_found")}
    ).drop("_found")
