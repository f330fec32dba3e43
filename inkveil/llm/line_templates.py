"""Line dedup with a log-template tree.

Tokens with digits are variable fields. A line's leaf in the tree is fixed by its
number of tokens and its three leading ones. Within a leaf, the documents vote on
each position: a token that at least half of the lines have there is part of the
template, other positions are variable. Lines that share at least 0.7 of their
tokens with the template belong to it. The others are split, like a leaf, by the
position whose most frequent token stands in most documents: tokens that recur
there have a branch each, the rest of the tokens is one. Each branch votes again,
until no line is left that a template or a branch could take; that line is a template
of its own, as it is. Templates that stand in three documents or more are dropped,
wherever they stand; those of fifty tokens or more, where chance has no part, in two.

All lines are counted by hashes of their leaf and of themselves. Only lines of leaves
that recur with different lines, a few in a hundred, vote. Hot lines are one row per
task before they are shuffled.

Results: blank lines are neither counted nor dropped. NULL text stays NULL, with 0
lines; a text whose lines are all dropped is empty. Lines end at a line feed; kept
lines are joined by one and left as they are. Repeated rows are separate documents.
Only ``doc_id`` and ``text`` are read.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkveil.llm.common import staged

LEAST_DOCUMENTS = 3
#: lines of so many tokens recur in two documents already
LONG_LINE, LEAST_LONG = 50, 2
LEADING = 3
SIMILARITY = 0.7
CONSTANT = 0.5
VARIABLE = "<*>"


def _masked(text: Column) -> Column:
    """Lines with variable fields masked and single spaces."""
    # a token is passed over in one step, so that none is tried from each of its letters
    variable = F.regexp_replace(text, r"(?<!\S)[^\s0-9]*+[0-9]\S*+", VARIABLE)
    masked = F.when(text.rlike("[0-9]"), variable).otherwise(text)
    # most texts have single spaces alone, which searches for fixed strings tell; masks leave them
    odd = reduce(Column.__or__, [F.contains(text, F.lit(x)) for x in ("  ", "\t", "\r", "\f", "\x0b")])
    spaced = F.regexp_replace(masked, r"[ \t\r\f\x0B]{2,}|[\t\r\f\x0B]", " ")
    even = F.when(odd, spaced).otherwise(masked)
    return F.transform(F.split(even, "\n", -1), F.trim)


def _words() -> Column:
    return F.length("line") - F.length(F.replace("line", F.lit(" "), F.lit(""))) + 1


def _leaf() -> Column:
    return F.xxhash64(_words() - 1, F.substring_index("line", " ", LEADING)).alias("leaf")


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text")


def _distinct_lines() -> Column:
    return F.explode(F.filter(F.array_distinct(_masked(F.col("text"))), lambda x: x != ""))


def _votes(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Template and place to split of every group, and the tokens that recur at each place.

    ``lines`` are different lines of groups, with the number of documents that have them.
    A template is an array with the token of each constant position, NULL elsewhere.
    """
    total = lines.groupBy("group").agg(F.sum("docs").alias("total"))
    token = staged(
        lines.select("group", "docs", F.posexplode("tokens").alias("at", "token"))
        .groupBy("group", "at", "token")
        .agg(F.sum("docs").alias("docs"), F.count(F.lit(1)).alias("lines")),
        "tokens",
    )
    places = token.groupBy("group", "at").agg(
        F.max(F.struct("docs", "token")).alias("top"),
        F.max(F.when(F.col("lines") > 1, F.col("docs"))).alias("recurs"),
        F.count(F.lit(1)).alias("kinds"),
    )
    known = F.when(F.col("top.docs") >= F.col("total") * CONSTANT, F.col("top.token"))
    ordered = F.sort_array(F.collect_list(F.struct("at", known.alias("token"))))
    splits = F.when((F.col("kinds") > 1) & F.col("recurs").isNotNull(), F.col("at"))
    groups = (
        places.join(total, "group")
        .groupBy("group")
        .agg(
            F.transform(ordered, lambda x: x["token"]).alias("template"),
            F.max_by(splits, F.when(splits.isNotNull(), F.struct("recurs", -F.col("at")))).alias("split"),
        )
    )
    return groups, token.where("lines > 1").select("group", "at", "token", F.lit(True).alias("own"))


def _similarity() -> Column:
    both = F.filter(
        F.zip_with("tokens", "template", lambda a, b: F.coalesce(a == b, F.lit(False))), lambda x: x
    )
    return F.size(both) / F.size("tokens")


def _least(words: str, least: int) -> Column:
    return F.when(F.col(words) >= LONG_LINE, F.lit(min(LEAST_LONG, least))).otherwise(least)


def _members(lines: DataFrame) -> DataFrame:
    """(leaf, mid, shared): the shared template that a line belongs to, for lines that have one.

    A split divides a group of different lines into smaller ones, or leaves it for good: in
    the end no line is left, so rounds need no bound.
    """
    rest = staged(lines.withColumn("group", F.col("leaf")), "rest")
    members = rest.select("leaf", "mid", F.col("group").alias("shared")).limit(0)
    while not rest.isEmpty():
        groups, recurring_tokens = _votes(rest)
        judged = rest.join(staged(groups, "votes"), "group")
        judged = staged(judged.withColumn("is_like", _similarity() >= SIMILARITY), "judged")
        found = judged.where("is_like").select("leaf", "mid", F.col("group").alias("shared"))
        members = members.unionByName(found)
        parted = judged.where("NOT is_like AND split IS NOT NULL").select(
            "leaf", "mid", "docs", "tokens", "group", F.col("split").alias("at"),
            F.element_at("tokens", F.col("split") + 1).alias("token"),
        )
        parted = parted.join(recurring_tokens, ["group", "at", "token"], "left")
        branch = F.xxhash64("group", "at", F.when(F.col("own"), F.col("token")))
        rest = staged(
            parted.select("leaf", "mid", "docs", "tokens", branch.alias("group")), "rest"
        )
    return members


def recurring(docs: DataFrame, least: int = LEAST_DOCUMENTS) -> DataFrame:
    """(doc_id, text_hash, lines): hashes of the lines of recurring templates in each document."""
    own = _keyed(docs).withColumn("row", F.monotonically_increasing_id())
    exploded = own.select("row", "doc_id", "text_hash", _distinct_lines().alias("line"))
    mid = F.xxhash64("line").alias("mid")
    # masked once; what follows reads the columns that it needs
    lines = staged(
        exploded.select("row", "doc_id", "text_hash", _leaf(), mid, _words().alias("words"), "line"),
        "lines",
        "zstd",
    )
    counts = staged(
        lines.groupBy("leaf", "mid", "words").agg(F.count(F.lit(1)).alias("docs")), "counts"
    )
    # all lines of a leaf have the same number of words
    leaves = counts.groupBy("leaf", "words").agg(
        F.sum("docs").alias("all"), F.count(F.lit(1)).alias("different")
    )
    varied = staged(
        leaves.where((F.col("different") > 1) & (F.col("all") >= _least("words", least))).select("leaf"),
        "leaves",
    )
    wanted = staged(counts.join(varied, "leaf").select("leaf", "mid", "docs"), "wanted")
    # a hot line is one row of each task before it meets the leaves, by the same keys
    once = lines.groupBy("leaf", "mid").agg(F.any_value("line").alias("line"))
    texts = once.join(wanted, ["leaf", "mid"]).select(
        "leaf", "mid", "docs", F.split("line", " ").alias("tokens")
    )
    members = staged(_members(texts), "members")
    named = staged(
        counts.join(members, ["leaf", "mid"], "left").where(
            F.col("shared").isNotNull() | (F.col("docs") >= _least("words", least))
        ),
        "named",
    )
    met = lines.select("leaf", "mid", "row", "words").join(
        named.where("shared IS NOT NULL").select("leaf", "mid", "shared"), ["leaf", "mid"]
    )
    many = (
        met.select("leaf", "shared", "words", "row")
        .distinct()
        .groupBy("leaf", "shared", "words")
        .agg(F.count(F.lit(1)).alias("rows"))
        .where(F.col("rows") >= _least("words", least))
    )
    many = staged(many.select("leaf", "shared", F.lit(True).alias("many")), "many")
    dropped = staged(
        named.join(many, ["leaf", "shared"], "left")
        .where(F.col("many") | (F.col("docs") >= _least("words", least)))
        .select("leaf", "mid"),
        "dropped",
    )
    return (
        lines.select("leaf", "mid", "doc_id", "text_hash")
        .join(dropped, ["leaf", "mid"])
        .groupBy("doc_id", "text_hash")
        .agg(F.collect_set("mid").alias("lines"))
    )


def _in_set(hashes: str, value: Column) -> Column:
    """Whether a hash is in a set that is laid out in as many parts as it has in each."""
    return F.array_contains(
        F.element_at(hashes, (F.pmod(value, F.size(hashes).cast("long")) + 1).cast("int")), value
    )


def _parts(hashes: str) -> Column:
    """A set of n hashes as an array of about sqrt(n) arrays: a text of very many lines takes
    n * sqrt(n) comparisons, not n * n."""
    n = F.ceil(F.sqrt(F.size(hashes)))
    return F.transform(
        F.sequence(F.lit(0).cast("long"), n - 1),
        lambda part: F.filter(hashes, lambda x: F.pmod(x, n) == part),
    )


def deduplicated(docs: DataFrame, least: int = LEAST_DOCUMENTS) -> DataFrame:
    """``doc_id, n_lines, n_dropped, text``: all documents without lines of recurring templates."""
    gone = staged(recurring(docs, least), "gone")
    gone = gone.select(
        F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash"), "lines"
    )
    gone = gone.withColumn("lines", _parts("lines"))
    own = _keyed(docs)
    met = own.join(
        gone.hint("merge"),
        F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("text_hash") == F.col("_hash")),
        "left",
    )
    lines = F.split("text", "\n", -1)
    filled = F.size(F.filter(lines, lambda x: F.btrim(x, F.lit(" \t\r\f\x0b")) != ""))
    kept = F.zip_with(
        lines,
        _masked(F.col("text")),
        lambda line, masked: F.when(
            (masked == "") | ~_in_set("lines", F.xxhash64(masked)), line
        ),
    )
    # lines are masked again only where some are dropped
    kept = F.when(F.col("lines").isNotNull(), kept)
    return (
        met.withColumn("kept", kept)
        .withColumn("left", F.array_compact("kept"))
        .select(
            "doc_id",
            F.coalesce(F.greatest(filled, F.lit(0)), F.lit(0)).cast("long").alias("n_lines"),
            F.coalesce(F.size("kept") - F.size("left"), F.lit(0)).cast("long").alias("n_dropped"),
            F.coalesce(F.array_join("left", "\n"), F.col("text")).alias("text"),
        )
    )
