"""Sharding by balanced label propagation.

Documents with the same text are linked. Labels are shards; a document looks at
its neighbours' labels and wants the shard that most of them have, weighed by the room that
is left there, ties by a hash that all neighbours agree on. Wishes are granted under quotas: what two shards exchange
is free, what exceeds that must fit the room of the wanted shard, which may hold a
quarter more than its share while labels move. When they have settled, what a shard
holds beyond its share goes on to shards with room, end to end in the order of the
links, so that no more than one group is cut for each shard. Documents without links,
which cut nothing wherever they go, then fill all shards to the same size.

All of it is joins and sums: groups are summed per label before they are shuffled,
a group of a third of all rows is one row per label and task, and quotas are
granted for slices of the wishes, from sums of at most shards^2 x SLICES rows.

Results: NULL and empty texts are documents of size 1; NULL texts have no links,
empty ones are equal texts. Repeated rows are separate documents. Extra columns are
neither read nor returned. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from inkveil.llm.common import RANGE, running, staged

SHARDS = 8
ROUNDS = 8
#: parts of the wishes between two shards that a quota accepts or leaves
SLICES = 256
#: room beyond its share that a shard has while labels move
SLACK = 0.25
#: how often full shards hand on what they hold beyond their share; mostly once is enough
EVENINGS = 6
#: the pull of a full shard, beside that of an empty one
LEAST_ROOM = 0.01


def _votes(linked: DataFrame) -> DataFrame:
    """Per link and label, the documents that have it."""
    return linked.groupBy("link", "label").agg(F.count(F.lit(1)).alias("votes"))


def _wishes(linked: DataFrame, loads: dict[int, int], quota: float, turn: int) -> DataFrame:
    """Linked documents with the label they want, of those that most of their link have.

    A label counts more where it has room, but a full one is wanted too, as what goes there
    may change places with what comes from there.  Nobody leaves a label for one that fewer
    have.  Ties fall otherwise in another round, in case that the first wish isn't granted.
    """
    room = F.element_at(
        F.create_map(
            *[
                F.lit(x)
                for shard, load in loads.items()
                for x in (shard, max(LEAST_ROOM, 1 - load / max(quota, 1.0)))
            ]
        ),
        F.col("label"),
    )
    votes = staged(_votes(linked), "votes")
    pull = F.struct(F.col("votes") * room, F.xxhash64("link", "label", F.lit(turn)))
    best = votes.groupBy("link").agg(F.max_by(F.struct("label", "votes"), pull).alias("top"))
    judged = votes.join(best, "link").select(
        "link",
        "label",
        F.col("top.label").alias("wanted"),
        ((F.col("top.label") != F.col("label")) & (F.col("top.votes") >= F.col("votes"))).alias("wants"),
    )
    return linked.join(staged(judged, "judged"), ["link", "label"])


def _slice():
    """The part of a flow that a document is in; not along the order of the slots."""
    return F.pmod(F.xxhash64("bits", "wanted"), F.lit(SLICES)).cast("int")


def _granted(wishes: DataFrame, loads: dict[int, int], quota: float) -> DataFrame:
    """(label, wanted, upto): the slices of each flow that fit its quota."""
    sums = wishes.where("wants").groupBy("label", "wanted", _slice().alias("slice"))
    sums = staged(sums.agg(F.sum("size").alias("bytes")), "flows")
    flow = sums.groupBy("label", "wanted").agg(F.sum("bytes").alias("flow"))
    back = flow.select(
        F.col("label").alias("wanted"), F.col("wanted").alias("label"), F.col("flow").alias("back")
    )
    swap = F.least("flow", F.coalesce("back", F.lit(0)))
    flow = flow.join(back, ["label", "wanted"], "left").withColumn("swap", swap)
    rest = F.col("flow") - F.col("swap")
    into = Window.partitionBy("wanted")
    free = F.element_at(
        F.create_map(
            *[F.lit(x) for s, load in loads.items() for x in (s, max(0.0, float(quota - load)))]
        ),
        F.col("wanted"),
    )
    share = F.when(rest > 0, free * rest / F.sum(rest).over(into)).otherwise(0.0)
    allowed = flow.select("label", "wanted", (F.col("swap") + F.least(rest, share)).alias("allowed"))
    upto = Window.partitionBy("label", "wanted").orderBy("slice")
    return (
        sums.withColumn("total", F.sum("bytes").over(upto))
        .join(allowed, ["label", "wanted"])
        .where("total <= allowed")
        .groupBy("label", "wanted")
        .agg(F.max("slice").alias("upto"))
    )


def _loads(linked: DataFrame, shards: int) -> dict[int, int]:
    """Bytes of linked documents in each shard; one number per shard comes to the driver."""
    found = {r["label"]: r["load"] for r in
             linked.groupBy("label").agg(F.sum("size").alias("load")).collect()}
    return {shard: found.get(shard, 0) for shard in range(shards)}


def shard_documents(docs: DataFrame, shards: int = SHARDS, rounds: int = ROUNDS) -> DataFrame:
    """``doc_id, size, text_crc32, law, shard, slot, grown_shard`` of all documents.

    ``law`` is `bytes`: the shards' sizes are near equal, within the size of a few
    documents. ``slot`` numbers the documents of a shard from 0 without gaps.
    """
    text = F.coalesce("text", F.lit(""))
    narrow = docs.select(
        "doc_id",
        (F.octet_length(text).cast("long") + 1).alias("size"),
        F.crc32(F.encode(text, "utf-8")).alias("text_crc32"),
        F.md5(F.col("text").cast("binary")).alias("link"),
        F.monotonically_increasing_id().alias("row"),
    ).withColumn("bits", F.xxhash64("doc_id", "link", "row").bitwiseAND(RANGE - 1))
    nodes = staged(narrow, "nodes")
    totals = nodes.agg(
        F.sum("size").alias("bytes"),
        F.count(F.lit(1)).alias("rows"),
        F.coalesce(F.max("size"), F.lit(0)).alias("largest"),
    ).first()
    total, rows = totals["bytes"] or 0, totals["rows"]
    quota = total / shards
    groups = nodes.where("link IS NOT NULL").groupBy("link").agg(F.count(F.lit(1)).alias("n"))
    groups = staged(groups.where("n > 1").select("link"), "groups")
    marked = nodes.join(groups.withColumn("in_group", F.lit(True)), "link", "left")
    marked = staged(
        marked.withColumn(
            "label",
            F.when(F.col("in_group"), F.pmod(F.xxhash64("bits"), F.lit(shards)).cast("int")),
        ).drop("in_group"),
        "marked",
    )
    linked, single = marked.where("label IS NOT NULL"), marked.where("label IS NULL")
    room = quota * (1 + SLACK)
    for turn in range(rounds):
        loads = _loads(linked, shards)
        wishes = staged(_wishes(linked, loads, room, turn), "wishes")
        granted = staged(_granted(wishes, loads, room), "granted")
        if granted.isEmpty():
            break
        # one row for each pair of shards at most
        moved = wishes.join(F.broadcast(granted), ["label", "wanted"], "left")
        accepted = F.col("wants") & (_slice() <= F.col("upto"))
        linked = staged(
            moved.withColumn("label", F.when(accepted, F.col("wanted")).otherwise(F.col("label")))
            .select(*linked.columns),
            "linked",
        )
    loads = _loads(linked, shards)
    for _ in range(EVENINGS):
        # documents without links even out what lacks, but not what is too much
        least = min(loads.values()) if sum(loads.values()) == total else quota
        if max(loads.values()) - least <= totals["largest"] / (1 if least < quota else 2):
            break
        linked = _evened(linked, loads, quota, rows)
        loads = _loads(linked, shards)
    filled = _fill(single, loads, total, shards, rows)
    placed = linked.select(*nodes.columns, F.col("label").alias("shard")).unionByName(
        filled.select(*nodes.columns, "shard")
    )
    placed = staged(placed, "placed")
    numbered = running(placed, "shard", "bits", ["bits", "row"], "size", rows)
    return numbered.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        F.col("number").cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )


def _evened(linked: DataFrame, loads: dict[int, int], quota: float, rows: int) -> DataFrame:
    """Move what shards hold beyond their share to those that hold less.

    The documents of a full shard lie end to end, those of a link together and links that
    are cut anyway last, and the ones behind its share go.  They fill the gaps of the other
    shards in the same order.
    """
    over = [s for s, load in loads.items() if load > quota]
    if not over:
        return linked
    full = linked.where(F.col("label").isin(over))
    cut = _votes(linked).groupBy("link").agg((F.count(F.lit(1)) > 1).cast("long").alias("cut"))
    half = F.lit(RANGE // 2)
    groups = staged(
        full.groupBy("label", "link")
        .agg(F.sum("size").alias("bytes"))
        .join(cut, "link")
        .withColumn("link_bits", F.pmod(F.xxhash64("link"), half) + F.col("cut") * half),
        "links",
    )
    first = running(groups, "label", "link_bits", ["link_bits", "link"], "bytes", rows)
    first = first.select("label", "link", F.col("before").alias("start"))
    # a link with a third of all documents is summed in stretches of its own
    inside = full.withColumn("own", F.concat_ws(" ", "label", "link"))
    inside = running(inside, "own", "bits", ["bits", "row"], "size", rows)
    laid = inside.withColumnRenamed("before", "within").join(first, ["label", "link"])
    laid = laid.withColumn("at", F.col("start") + F.col("within"))
    laid = laid.withColumn("goes", F.col("at") + F.col("size") / 2 > quota).select(
        *linked.columns, "at", "goes"
    )
    laid = staged(laid, "laid")
    kept = _loads(laid.where("NOT goes"), max(loads) + 1)
    start, ahead = F.lit(None).cast("double"), 0.0
    for s in over:
        start = F.when(F.col("label") == s, F.col("at") - kept[s] + ahead).otherwise(start)
        ahead += loads[s] - kept[s]
    gaps = [(s, quota - load) for s, load in loads.items() if load < quota]
    middle, end = start + F.col("size") / 2, sum(gap for _, gap in gaps)
    target = F.lit(gaps[-1][0]) if gaps else F.col("label")
    for (s, _), (_, gap) in zip(gaps[-2::-1], gaps[:0:-1]):
        end -= gap
        target = F.when(middle < end, F.lit(s)).otherwise(target)
    moved = laid.withColumn("label", F.when(F.col("goes"), target).otherwise(F.col("label")))
    rest = linked.where(~F.col("label").isin(over))
    return staged(moved.select(*linked.columns).unionByName(rest), "evened")


def _fill(
    single: DataFrame, loads: dict[int, int], total: int, shards: int, rows: int
) -> DataFrame:
    """Lay the documents without links end to end and cut where each shard is full."""
    lacks = [max(0.0, total / shards - loads[s]) for s in range(shards)]
    have = total - sum(loads.values())
    scale = have / sum(lacks) if sum(lacks) else 0.0
    laid = running(single.withColumn("_all", F.lit(0)), "_all", "bits", ["bits", "row"], "size", rows)
    middle = F.col("before") + F.col("size") / 2
    shard, end = F.lit(shards - 1), sum(lacks) * scale
    for s in range(shards - 1, 0, -1):
        end -= lacks[s] * scale
        shard = F.when(middle < end, F.lit(s - 1)).otherwise(shard)
    # the last condition set is tested first: shard 0, then 1, and so on
    return laid.withColumn("shard", shard)
