"""Findings per week, person and team, with totals.

Texts are counted, not located, and one row per text, kind and person is all that leaves
the scan.  A text adds one to every group that it is in: the row that stands for all its
kinds together does so for the totals over kinds, so documents need not be made distinct.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkveil.functions.detect import counts_by_type
from inkveil.plans.policy import ScanPolicy

#: stands for all kinds together
ALL_TYPES = "all"


def week_of(ts: str) -> Column:
    """Monday of the week."""
    return F.to_date(F.date_trunc("week", ts))


def text_totals(
    df: DataFrame, by: Sequence[str], text: str = "text", policy: ScanPolicy | None = None
) -> DataFrame:
    """``by, type, n_findings, n_documents`` at the finest level, ``type`` "all" included.

    Rows of the same text are different documents.  Clean texts are counted under "all".
    """
    policy = policy or ScanPolicy.batch()
    counts = counts_by_type(text, policy.detectors, policy.min_severity)
    own = df.select(*by, counts.alias("_counts"))
    kinds = F.transform(
        "_counts", lambda c: F.struct(c["type"].alias("type"), c["n_findings"].cast("long").alias("n"))
    )
    total = F.aggregate(
        "_counts", F.lit(0).cast("long"), lambda a, c: a + c["n_findings"].cast("long")
    )
    every = F.struct(F.lit(ALL_TYPES).alias("type"), total.alias("n"))
    rows = own.select(*by, F.inline_outer(F.array_append(kinds, every)))
    return rows.groupBy(*by, "type").agg(
        F.sum("n").alias("n_findings"),
        F.count(F.lit(1)).alias("n_documents"),
        F.count_if(F.col("n") > 0).alias("n_with_findings"),
    )


def weekly_totals(
    df: DataFrame,
    ts: str,
    person: str,
    team: str,
    text: str = "text",
    policy: ScanPolicy | None = None,
) -> DataFrame:
    """Totals by week and over all weeks, each per person, per team and over all teams.

    ``level`` is the grouping id of team, person and week, in this order of bits: a bit that
    is set stands for a column that was summed over, so a null of the data (rows without a
    person, or without a time) is told from a total.  Sums of the finest level are summed
    up, so what is shuffled does not grow with the number of levels.
    """
    placed = df.withColumn("week", week_of(ts)).withColumns({"team": F.col(team), "person": F.col(person)})
    keys = ["team", "person", "week"]
    finest = text_totals(placed, keys, text, policy)
    team_, person_, week, kind = (F.col(c) for c in (*keys, "type"))
    sets = [
        [team_, person_, week, kind],
        [team_, week, kind],
        [week, kind],
        [team_, person_, kind],
        [team_, kind],
        [kind],
    ]
    summed = finest.groupingSets(sets, team_, person_, week, kind).agg(
        F.expr("cast(grouping_id(team, person, week, type) div 2 AS int)").alias("level"),
        F.sum("n_findings").alias("n_findings"),
        F.sum("n_documents").alias("n_documents"),
        F.sum("n_with_findings").alias("n_with_findings"),
    )
    return summed.select(*keys, "type", "level", "n_findings", "n_documents", "n_with_findings")
