"""Mixing sources to target weights along a curriculum.

Sources in code point order, NULL last, weigh 5, 2, 1, repeating, and share the
words of all documents; no target exceeds three times what its source has, and the
excess is shared again by weight. Each source has a schedule of its weight over
training time. Its integral says how many of the source's target words are due by
each moment; a document stands at the moment at which the words ahead of it in its
source, in a fixed random order, have become due. A source whose target exceeds its
words is passed through again, up to three times. Documents are sorted by range on
their moments.

The words ahead of a document are summed in two steps, along buckets of the random
order and within them, so that a source of a third of all rows is many tasks. What
is summed without any key is one row per source.

Results: size 0 for NULL, empty and blank texts, which are never taken; NULL is a
source of its own. Repeated rows are separate documents. With no words at all, all
targets are 0. ``source_shares`` and ``taken`` read ``doc_id, text, source`` alone;
``mixed`` keeps all columns of the documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkveil.llm.common import place, running, staged

WEIGHTS = (5, 2, 1)
MOST_PASSES = 3
WORD = r"[^\x20\x09-\x0D]+"
#: weight over training time at even steps from start to end, for each place in WEIGHTS:
#: heavy sources early, light ones late
SCHEDULES = ((1.5, 1.0, 0.5), (1.0, 1.0), (0.5, 1.0, 1.5))


def source_shares(
    narrow: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_PASSES
) -> DataFrame:
    """``source, source_size, kind, target``: one row per source.

    Sources are capped in the order in which a rising level of words per weight
    reaches their cap; ``kind`` is the source's place in the weights.
    """
    sums = narrow.groupBy("source").agg(F.sum("words").alias("source_size"))
    ranked = sums.withColumn(
        "rank", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    ).withColumn("kind", F.pmod(F.col("rank"), F.lit(len(weights))))
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), F.col("kind") + 1).cast("long")
    whole = Window.partitionBy()
    order = Window.orderBy(F.col("cap") / F.col("weight"), "rank")
    earlier = order.rowsBetween(Window.unboundedPreceding, -1)
    level = (
        ranked.withColumn("weight", weight)
        .withColumn("cap", F.col("source_size") * most)
        .withColumn("words", F.sum("source_size").over(whole) - F.coalesce(F.sum("cap").over(earlier), F.lit(0)))
        .withColumn("weights", F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(earlier), F.lit(0)))
        .withColumn("capped", F.col("words") * F.col("weight") >= F.col("cap") * F.col("weights"))
    )
    first_free = F.min(F.when(~F.col("capped"), F.struct(
        (F.col("cap") / F.col("weight")).alias("at"), "rank", "words", "weights"))).over(whole)
    free = F.col("weight") * F.col("free.words") / F.col("free.weights")
    return level.withColumn("free", first_free).select(
        "source",
        "source_size",
        "kind",
        F.when(F.col("capped"), F.col("cap").cast("double")).otherwise(free).alias("target"),
    )


def due_at(share: Column, knots: tuple[float, ...]) -> Column:
    """The moment, 0 to 1, by which this share of a source's words is due.

    The weight is linear between the knots, so the words due are a quadratic in
    each piece, solved here.
    """
    pieces = len(knots) - 1
    areas = [(a + b) / 2 / pieces for a, b in zip(knots[:-1], knots[1:], strict=True)]
    total = sum(areas)
    moment, done = F.lit(1.0), total
    for i in range(pieces - 1, -1, -1):
        done -= areas[i]
        a, slope = knots[i], (knots[i + 1] - knots[i]) * pieces
        left = share * total - done
        root = F.sqrt(F.greatest(F.lit(0.0), F.lit(a * a) + left * (2 * slope)))
        inside = 2 * left / (F.lit(a) + root)  # stable for any slope, also 0
        here = F.least(F.lit(1.0), F.greatest(F.lit(0.0), inside + i / pieces))
        moment = here if i == pieces - 1 else F.when(share * total < done + areas[i], here).otherwise(moment)
    return moment


def _key() -> Column:
    """Digest of id and text, the fixed random order of the documents."""
    number = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    return F.md5(F.concat(number, F.lit(":"), F.coalesce("text", F.lit(""))))


def _sized(docs: DataFrame, *more: Column) -> DataFrame:
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    return docs.select(
        "doc_id", "source", size.alias("size"), _key().alias("key"), *more
    ).withColumn("bits", place(F.col("key")))


def scheduled(
    docs: DataFrame,
    weights: tuple[int, ...] = WEIGHTS,
    most: int = MOST_PASSES,
    schedules: tuple[tuple[float, ...], ...] = SCHEDULES,
    keep: bool = False,
) -> DataFrame:
    """``doc_id, source, size, source_size, target, moments`` of all documents.

    ``moments`` has one moment of training time for each time the document is
    taken. A pass takes a document if its middle lies within the target. With
    ``keep`` the column ``kept`` has the whole row of the document.
    """
    if len(schedules) != len(weights):
        raise ValueError("one schedule for each weight")
    same = ["doc_id", "source", "size", "key", "bits"]
    folded = _sized(docs).groupBy(*same).agg(F.count(F.lit(1)).alias("copies"))
    narrow = _sized(docs).withColumn("copies", F.lit(1)) if keep else folded
    narrow = staged(narrow.withColumn("words", F.col("size") * F.col("copies")), "narrow")
    shares = staged(source_shares(narrow, weights, most), "shares").select(
        F.col("source").alias("_source"), "source_size", "kind", "target",
        F.xxhash64(F.coalesce("source", F.lit("")), F.col("source").isNull()).alias("part"),
    )
    met = F.col("source").eqNullSafe(F.col("_source"))
    narrow = narrow.where("size > 0") if keep else narrow
    rows = narrow.count()
    narrow = narrow.join(shares, met)
    if keep:
        wide = _sized(docs, F.struct(*docs.columns).alias("kept")).where("size > 0")
        wide = wide.withColumns({"copies": F.lit(1), "words": F.col("size")}).join(shares, met)
    else:
        wide = narrow
    laid = running(
        wide, "part", "bits", ["bits", "key", "doc_id", "size"], "words", rows, narrow
    )
    copies = F.sequence(F.lit(0).cast("long"), F.col("copies").cast("long") - 1)
    laid = laid.withColumn("copy", F.explode(copies))
    middle = F.col("before") + F.col("copy") * F.col("size") + F.col("size") / 2
    moments = []
    for p in range(most):
        share = (F.col("source_size") * p + middle) / F.col("target")
        at = due_at(share, schedules[0])
        for kind in range(1, len(weights)):
            at = F.when(F.col("kind") == kind, due_at(share, schedules[kind])).otherwise(at)
        fits = (F.col("size") > 0) & (F.col("source_size") * p + middle < F.col("target"))
        moments.append(F.when(fits, at))
    return laid.withColumn("moments", F.array_compact(F.array(*moments))).select(
        "doc_id", "source", "size", "source_size", "target", "moments", *["kept"] * keep
    )


def taken(docs: DataFrame) -> DataFrame:
    """Per document, the words the mix takes of it."""
    return scheduled(docs).select(
        "doc_id",
        "size",
        "source_size",
        "target",
        (F.size("moments") * F.col("size")).cast("long").alias("taken"),
    )


def mixed(docs: DataFrame) -> DataFrame:
    """The documents in training order, with all their columns, once for each time they are taken."""
    chosen = scheduled(docs, keep=True).select("kept", F.explode("moments").alias("moment"))
    ordered = chosen.repartitionByRange(F.col("moment")).sortWithinPartitions("moment")
    return ordered.select("kept.*")
