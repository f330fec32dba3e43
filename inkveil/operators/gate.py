"""Verdicts: may a text, or a whole run, pass?"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkveil.functions.detect import has_findings
from inkveil.plans.policy import ScanPolicy

# --- fixed values: verdicts --------------------------------------------------
CLEAN, FINDINGS, BLOCK, UNREADABLE = 0, 1, 2, 3
# ours: nothing was looked for, so nothing can be said
NOT_SCANNED = 4


def verdict(
    text: str, policy: ScanPolicy, *, hook: bool = False, unreadable: Column | None = None
) -> Column:
    """0 clean, 1 findings (2 with ``hook``), 3 if the text could not be read,
    4 under a policy that is not active.

    Asks only whether there is a finding, and stops at the first.
    """
    if policy.active:
        dirty = has_findings(text, policy.detectors, policy.min_severity)
        result = F.when(dirty, BLOCK if hook else FINDINGS).otherwise(CLEAN)
    else:
        result = F.lit(NOT_SCANNED)
    return result if unreadable is None else F.when(unreadable, UNREADABLE).otherwise(result)


def verdicts(
    df: DataFrame,
    text: str = "text",
    policy: ScanPolicy | None = None,
    *,
    hook: bool = False,
    unreadable: Column | None = None,
) -> DataFrame:
    """Add ``verdict`` to every row."""
    policy = policy or ScanPolicy.batch()
    return df.withColumn("verdict", verdict(text, policy, hook=hook, unreadable=unreadable))


def run_verdict(judged: DataFrame) -> DataFrame:
    """Worst verdict of a run: one row, from one number per input partition."""
    return judged.agg(
        F.coalesce(F.max("verdict"), F.lit(CLEAN)).alias("verdict"),
        F.count(F.lit(1)).alias("n_sources"),
        F.count_if(F.col("verdict") > CLEAN).alias("n_not_clean"),
    )
