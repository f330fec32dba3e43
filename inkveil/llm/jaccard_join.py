"""N-gram Jaccard join: texts whose sets of five-word runs have a similarity of 0.8 or more.

1. Every text becomes its set of runs and the MinHash signature of that set, in
   bands whose number and width follow from the recall that is asked for. Texts
   with the same set are one member from here on, so copies cost nothing more.
2. Bands are shuffled on their hash. In each bucket all members are held against
   its leader, the smallest one, on their full sets: n - 1 pairs, not n * n.
3. Links give classes. In a bucket that its leader doesn't hold together and that
   has members of several classes, links can be left. Its members are held against
   each other in blocks of some hundred, each pair of blocks a product of matrices in
   a task of its own; no pair becomes a row, only classes that it joins.
4. Links are counted per class. Where all members are within half the allowed
   distance of the class's middle, all are linked with all, by the triangle inequality
   of the Jaccard distance. Other classes are counted in blocks.

Results: every document has a class, its own if nothing is like it. NULL, empty
and blank texts have no runs and no links; each such document is its own class.
A text of one to four words has one run, all its words. Repeated rows share the
class. Extra columns are neither read nor returned.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkveil.llm.classes import connected
from inkveil.llm.common import staged
from inkveil.llm.shingles import chunks, functions, mix, shingle_hashes

SIMILARITY = 0.8
RECALL = 0.9999
MOST_HASHES = 128
#: members of a block where the links of a class are counted
BLOCK = 256
_U = np.uint64


def bands_and_rows(similarity: float, recall: float, most: int = MOST_HASHES) -> tuple[int, int]:
    """The widest bands, and as many as find a pair of this similarity with this probability."""
    best = None
    for rows in range(1, most + 1):
        bands = math.ceil(math.log(1 - recall) / math.log(1 - similarity**rows))
        if bands * rows > most:
            break
        best = bands, rows
    if best is None:
        raise ValueError(f"no bands of {most} hashes reach a recall of {recall}")
    return best


def _members(texts: list[str | None]) -> list[np.ndarray]:
    hashes, begins = shingle_hashes(texts)
    return [np.unique(hashes[a:b]) for a, b in zip(begins[:-1], begins[1:], strict=True)]


def _identity(members: np.ndarray) -> tuple[int, int]:
    """128 bits that are the same for the same set."""
    return tuple(
        int(mix(members ^ _U(salt)).sum(dtype=_U).astype(np.int64))
        for salt in (0x517CC1B727220A95, 0x2545F4914F6CDD1D)
    )


def _signer(bands: int, rows: int):
    def signed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        odd, flip = functions(bands * rows)
        for batch in batches:
            texts = batch["text"].tolist()
            for part in chunks(texts):
                sets = _members(texts[part])
                full = [i for i, x in enumerate(sets) if len(x)]
                out = {
                    "doc_id": batch["doc_id"].iloc[part],
                    "text_hash": batch["text_hash"].iloc[part],
                    "row": batch["row"].iloc[part],
                    "n": [len(x) for x in sets],
                    "s1": [None] * len(sets),
                    "s2": [None] * len(sets),
                    "bands": [None] * len(sets),
                }
                if full:
                    together = np.concatenate([sets[i] for i in full])
                    begins = np.cumsum([0] + [len(sets[i]) for i in full])[:-1]
                    keys = np.empty((bands, len(full)), dtype=_U)
                    for band in range(bands):
                        key = np.full(len(full), band + 1, dtype=_U)
                        for k in range(band * rows, (band + 1) * rows):
                            smallest = np.minimum.reduceat((together ^ flip[k]) * odd[k], begins)
                            key = mix(key ^ smallest) + _U(k)
                        keys[band] = key
                    for at, i in enumerate(full):
                        out["s1"][i], out["s2"][i] = _identity(sets[i])
                        out["bands"][i] = keys[:, at].astype(np.int64)
                # never as floats, which hold 53 bits
                out["s1"], out["s2"] = (pd.array(out[x], dtype="Int64") for x in ("s1", "s2"))
                yield pd.DataFrame(out)

    return signed


def _sets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The sets of texts, of those that still are the ones signed."""
    for batch in batches:
        texts = batch["text"].tolist()
        for part in chunks(texts):
            sets = _members(texts[part])
            own = batch.iloc[part]
            same = [
                len(x) > 0 and _identity(x) == (a, b)
                for x, a, b in zip(sets, own["s1"], own["s2"], strict=True)
            ]
            runs = [x.tobytes() for x, ok in zip(sets, same, strict=True) if ok]
            member = own["member"][same]
            yield pd.DataFrame(
                {"member": member, "runs": pd.Series(runs, member.index, dtype=object)}
            )


def _shared(a: np.ndarray, b: np.ndarray) -> int:
    """Size of the intersection of two sorted sets."""
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    return int((b[at] == a).sum())


def _verified(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        score = []
        for left, right in zip(batch["left_runs"], batch["right_runs"], strict=True):
            a, b = np.frombuffer(left, _U), np.frombuffer(right, _U)
            both = _shared(a, b)
            score.append((both, len(a) + len(b) - both))
        yield pd.DataFrame(
            {
                "a": batch["a"],
                "b": batch["b"],
                "both": [x[0] for x in score],
                "either": [x[1] for x in score],
            }
        )


def _linked(left: pd.Series, right: pd.Series, similarity: float) -> np.ndarray:
    """Which of the left sets are linked with which of the right ones, in slices of their runs."""
    sets = [np.frombuffer(x, _U) for x in [*left, *right]]
    sizes = np.array([len(x) for x in sets])
    _, codes = np.unique(np.concatenate(sets), return_inverse=True)
    owner = np.repeat(np.arange(len(sets)), sizes)
    n, both = len(left), np.zeros((len(left), len(right)), np.float32)
    order = np.argsort(codes, kind="stable")
    codes, owner = codes[order], owner[order]
    for low in range(0, int(codes[-1]) + 1, 4096):
        a, b = np.searchsorted(codes, [low, low + 4096])
        width = min(4096, int(codes[-1]) + 1 - low)
        grid = np.zeros((len(sets), width), np.float32)
        grid[owner[a:b], codes[a:b] - low] = 1
        both += grid[:n] @ grid[n:].T
    either = sizes[:n, None] + sizes[None, n:] - both
    return 10 * both.astype(np.int64) >= round(10 * similarity) * either.astype(np.int64)


def _sides(group: pd.DataFrame, i: int, j: int) -> tuple[pd.DataFrame, pd.DataFrame]:
    left = group[group["block"] == i]
    return left, left if i == j else group[group["block"] == j]


def _block_counts(similarity: float):
    def counted(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        left, right = _sides(group, *key[1:])
        if not len(left) or not len(right):
            return pd.DataFrame({"member": [], "links": []}, dtype=np.int64)
        linked = _linked(left["runs"], right["runs"], similarity)
        if key[1] == key[2]:
            np.fill_diagonal(linked, False)
            return pd.DataFrame({"member": left["member"], "links": linked.sum(1)})
        return pd.DataFrame(
            {
                "member": [*left["member"], *right["member"]],
                "links": [*linked.sum(1), *linked.sum(0)],
            }
        )

    return counted


def _block_links(similarity: float):
    def joined(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        left, right = _sides(group, *key[1:])
        if not len(left) or not len(right):
            return pd.DataFrame({"a": [], "b": []}, dtype=np.int64)
        at = np.argwhere(_linked(left["runs"], right["runs"], similarity))
        a, b = left["root"].to_numpy()[at[:, 0]], right["root"].to_numpy()[at[:, 1]]
        return pd.DataFrame({"a": a, "b": b})[a != b].drop_duplicates()

    return joined


def _in_blocks(members: DataFrame, group: str, size: str, sets: DataFrame) -> DataFrame:
    """Members of each group with their sets, once for each pair of blocks their block is in.

    Blocks have some hundred members whatever the group's size, so the pairs of a
    group are held against each other in tasks of bounded size and never as rows.
    """
    blocks = F.ceil(F.col(size) / BLOCK).cast("int")
    own = F.pmod(F.xxhash64("member"), F.col("blocks")).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    spread = (
        members.withColumn("blocks", blocks)
        .withColumn("block", own)
        .select(*dict.fromkeys([group, "member", "root", "block"]), other.alias("other"))
    )
    return spread.join(sets.hint("merge"), "member").select(
        *dict.fromkeys([group, "member", "root", "block", "runs"]),
        F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"),
    )


class _Join:
    """The tables of one join, each in the shared folder."""

    def __init__(self, docs: DataFrame, similarity: float, recall: float):
        self.docs = docs.select(
            F.col("doc_id").alias("doc_id"),
            F.col("text").alias("text"),
            F.xxhash64(F.col("text")).alias("text_hash"),
            F.monotonically_increasing_id().alias("row"),
        )
        self.similarity = similarity
        bands, rows = bands_and_rows(similarity, recall)
        schema = "doc_id long, text_hash long, row long, n int, s1 long, s2 long, bands array<long>"
        signed = self.docs.mapInPandas(_signer(bands, rows), schema)
        self.signed = staged(signed, "signed")
        same_set = self.signed.where("n > 0").groupBy("s1", "s2")
        self.members = staged(
            same_set.agg(
                F.min("row").alias("member"), F.min("doc_id").alias("first_id"), F.count(F.lit(1))
                .alias("copies"),
            ),
            "members",
        )

    def buckets(self) -> DataFrame:
        """(band, member) of the buckets with two members or more, with the bucket's leader."""
        first = self.signed.join(
            self.members.select(F.col("member").alias("row")), "row", "left_semi"
        )
        placed = staged(
            first.select(F.col("row").alias("member"), F.explode("bands").alias("band")), "bands"
        )
        leaders = staged(
            placed.groupBy("band")
            .agg(F.min("member").alias("leader"), F.max("member").alias("last"))
            .where("leader < last")
            .select("band", "leader"),
            "leaders",
        )
        return staged(placed.join(leaders, "band"), "buckets")

    def load_sets(self, pairs: DataFrame) -> DataFrame:
        """The sets of all members of the pairs."""
        named = pairs.select(F.explode(F.array("a", "b")).alias("row")).distinct()
        keys = ["doc_id", "text_hash", "s1", "s2"]
        wanted = staged(
            self.signed.select("row", *keys)
            .join(named, "row")
            .select(F.col("row").alias("member"), *keys),
            "wanted",
        )
        # the sides grow with the documents: the same join at every size
        wanted = wanted.withColumnsRenamed({"doc_id": "_id", "text_hash": "_hash"}).hint("merge")
        same = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("text_hash") == F.col("_hash"))
        texts = self.docs.select("doc_id", "text_hash", "text").join(wanted, same)
        sets = texts.select("member", "s1", "s2", "text").mapInPandas(
            _sets, "member long, runs binary"
        )
        # rows repeated with the same id and text give the same set
        return sets.dropDuplicates(["member"])

    def verify(self, pairs: DataFrame, sets: DataFrame) -> DataFrame:
        """Pairs with the size of their intersection and union."""
        left = sets.select(F.col("member").alias("a"), F.col("runs").alias("left_runs"))
        right = sets.select(F.col("member").alias("b"), F.col("runs").alias("right_runs"))
        met = pairs.select("a", "b").join(left.hint("merge"), "a").join(right.hint("merge"), "b")
        return met.select("a", "b", "left_runs", "right_runs").mapInPandas(
            _verified, "a long, b long, both long, either long"
        )


def _similar(similarity: float):
    return F.col("both") * 10 >= F.col("either") * round(10 * similarity)


def _distance():
    return 1 - F.col("both") / F.col("either")


def jaccard_classes(
    docs: DataFrame, similarity: float = SIMILARITY, recall: float = RECALL, links: bool = True
) -> DataFrame:
    """One row per document: ``doc_id, class_id, n_links, n_copies``.

    ``class_id`` is the smallest doc_id among documents that are linked, directly
    or over others. ``n_links`` counts the different sets of runs that are linked
    to the document's own; ``n_copies`` the documents with its own set, itself
    included. Reads ``doc_id`` and ``text``. ``similarity`` has one decimal.
    """
    join = _Join(docs, similarity, recall)
    members, sets = _classes(join, similarity)
    ids = members.groupBy("root").agg(
        F.min("first_id").alias("class_id"), F.count(F.lit(1)).alias("size")
    )
    members = staged(members.join(staged(ids, "ids"), "root"), "named")
    if links:
        members = members.join(_links(join, members, sets, similarity), "member", "left")
    else:
        members = members.withColumn("links", F.lit(None).cast("long"))
    known = members.select("s1", "s2", "class_id", "links", "copies")
    known = staged(known, "known")
    return join.signed.select("doc_id", "s1", "s2").join(known, ["s1", "s2"], "left").select(
        "doc_id",
        F.coalesce("class_id", "doc_id").alias("class_id"),
        F.coalesce("links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("copies", F.lit(1)).cast("long").alias("n_copies"),
    )


def firsts(
    docs: DataFrame, similarity: float = SIMILARITY, recall: float = RECALL
) -> DataFrame:
    """The first document of each class: ``doc_id, text_hash, repeats``.

    First is the smallest doc_id, documents without one behind all others, then the
    smallest hash of the text. ``repeats`` rows have this id and text. Documents
    without a word are in no class.
    """
    join = _Join(docs, similarity, recall)
    members, _ = _classes(join, similarity)
    rows = (
        join.signed.where("n > 0")
        .groupBy("s1", "s2", "doc_id", "text_hash")
        .agg(F.count(F.lit(1)).alias("repeats"))
    )
    top = F.struct(F.isnull("doc_id").alias("unnamed"), "doc_id", "text_hash", "repeats")
    of_set = staged(rows.groupBy("s1", "s2").agg(F.min(top).alias("first")), "of_set")
    found = of_set.join(members.select("s1", "s2", "root"), ["s1", "s2"])
    found = found.groupBy("root").agg(F.min("first").alias("first"))
    return staged(found.select("first.doc_id", "first.text_hash", "first.repeats"), "firsts")


def _classes(join: _Join, similarity: float) -> tuple[DataFrame, DataFrame]:
    """The members with the root of their class, and the sets of those that share a bucket."""
    found = join.buckets()
    star = staged(
        found.where("member <> leader")
        .select(F.col("member").alias("a"), F.col("leader").alias("b"))
        .distinct(),
        "star",
    )
    sets = staged(join.load_sets(star), "sets")
    verified = staged(join.verify(star, sets), "verified")
    edges = verified.where(_similar(similarity)).select("a", "b")
    parts = connected(edges)

    # buckets that the leader doesn't hold together: all members against each other
    far = verified.select("a", "b", _similar(similarity).alias("near"))
    part = parts.select(F.col("node").alias("member"), "root")
    inside = staged(
        found.join(part, "member", "left")
        .withColumn("root", F.coalesce("root", "member"))
        .join(far, (F.col("member") == F.col("a")) & (F.col("leader") == F.col("b")), "left")
        .select("band", "member", "root", "near"),
        "inside",
    )
    apart = inside.groupBy("band").agg(
        F.count(F.lit(1)).alias("size"),
        F.min("root").alias("low"),
        F.max("root").alias("high"),
        F.bool_and(F.coalesce("near", F.lit(True))).alias("held"),
    )
    apart = staged(
        apart.where("size > 2 AND low < high AND NOT held").select("band", "size"), "apart"
    )
    open_ = inside.join(apart, "band").select("band", "size", "member", "root")
    grid = _in_blocks(open_, "band", "size", sets)
    more = (
        grid.groupBy("band", "i", "j")
        .applyInPandas(_block_links(similarity), "a long, b long")
        .distinct()
    )
    more = staged(more, "more")
    edges = edges.unionByName(more)
    if not more.isEmpty():
        parts = connected(edges)

    members = join.members.join(
        parts.select(F.col("node").alias("member"), "root"), "member", "left"
    ).withColumn("root", F.coalesce("root", "member"))
    return staged(members, "classes"), sets


def _links(join: _Join, members: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """(member, links) of all members with a link."""
    most = 1 - similarity + 1e-9
    pairs = members.where("size = 2").select("member", F.lit(1).alias("links"))
    large = members.where("size > 2").select("member", "root", "size", "copies")
    # the member with most copies is taken for the original the others were made from
    middle = staged(
        large.groupBy("root").agg(
            F.max(F.struct("copies", (-F.col("member")).alias("member"))).alias("top")
        ),
        "middles",
    ).select("root", (-F.col("top.member")).alias("middle"))
    large = staged(large.join(middle, "root"), "large")
    spokes = large.where("member <> middle").select(
        F.col("member").alias("a"), F.col("middle").alias("b")
    )
    reach = staged(join.verify(spokes, sets).select("a", _distance().alias("d")), "reach")
    placed = large.join(reach, F.col("member") == F.col("a"), "left").withColumn(
        "d", F.coalesce("d", F.lit(0.0))
    )
    placed = staged(placed.select("member", "root", "size", "d"), "placed")
    widest = placed.groupBy("root").agg(F.max("d").alias("widest"))
    placed = staged(placed.join(staged(widest, "widest"), "root"), "measured")
    # at most half of what is allowed from the middle: all are linked with all
    tight = placed.where(F.col("widest") <= most / 2).select(
        "member", (F.col("size") - 1).alias("links")
    )
    loose = placed.where(F.col("widest") > most / 2)
    counted = (
        _in_blocks(loose, "root", "size", sets)
        .groupBy("root", "i", "j")
        .applyInPandas(_block_counts(similarity), "member long, links long")
        .groupBy("member")
        .agg(F.sum("links").alias("links"))
    )
    return pairs.unionByName(tight).unionByName(counted)
