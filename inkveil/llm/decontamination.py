"""Benchmark decontamination: size-partitioned MinHash containment search.

A short item inside a long document has a tiny Jaccard similarity with it, so
documents are not compared whole. Items are partitioned by their number of
five-word runs, u/2 to u in each partition, and for each partition documents are
cut into windows of 2u runs at steps of u. An item of the partition that stands
in a document lies within one window and has a similarity of about 0.2 or more
with it, whatever the document's length. MinHash values of one row each, as many
as the recall asks for, find such windows: first against a bit table of the
items' values, of a size fixed by a parameter, then by a join on the values. Items of
a few different runs would be too little of a window: these are found by their runs
themselves, so many of them that a document at the threshold has one, and never missed.
Each candidate is verified: the share of the item's distinct runs of five words
that stand anywhere in the document must reach the threshold.

Results: NULL, empty and short documents hold no item. Items with fewer than five
words have no run and are never found. Repeated documents and items each give
their own rows. Extra columns are neither read nor returned by ``contained``, and
left alone by ``decontaminated``.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkveil.llm.common import staged
from inkveil.llm.shingles import WORDS, chunks, functions, mix, shingle_hashes

CONTAINMENT = 0.8
RECALL = 0.9999
SMALLEST_PARTITION = 8
#: items of so many different runs at most are found by their runs, in a partition of this name
FEW_RUNS, BY_RUNS = 4, 0
#: bits of the table that screens windows: 16 for each value of the items, within these
LEAST_BITS, MOST_BITS = 1 << 16, 1 << 26
_U = np.uint64


def hash_functions(containment: float, recall: float) -> int:
    """How many values find an item of u/2 runs in a window of 2u runs."""
    similarity = containment * 0.5 / (2 + (1 - containment) * 0.5)
    return math.ceil(math.log(1 - recall) / math.log(1 - similarity))


def partition_of(runs: int) -> int:
    """The power of two at or above the number of runs."""
    return max(SMALLEST_PARTITION, 1 << (runs - 1).bit_length())


def partition_for(positions: int, different: int) -> int:
    """Where an item is looked for: by windows where it has half of a partition's runs or more."""
    size = partition_of(positions)
    return BY_RUNS if different <= FEW_RUNS or 2 * different < size else size


#: items that a text is verified against in one row
ITEMS_AT_ONCE = 256


def telling(runs: np.ndarray, containment: float) -> np.ndarray:
    """Runs of an item of which a document has one if it has this share of all."""
    needed = -(-len(runs) * round(10 * containment) // 10)
    return runs[: len(runs) - needed + 1]


def _keys(smallest: np.ndarray, k: int, partition: int) -> np.ndarray:
    return mix(smallest + _U(partition * 4096 + k))


def _full(texts: list[str | None]) -> list[bool]:
    """Whether a text has a run of five words."""
    return [len((x or "").encode("utf-8", "surrogatepass").split(None, WORDS)) >= WORDS
            for x in texts]


def _item_values(n: int, containment: float):
    def valued(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        odd, flip = functions(n)
        for batch in batches:
            texts = batch["text"].tolist()
            hashes, begins = shingle_hashes(texts)
            out = []
            for i, full in enumerate(_full(texts)):
                if not full:
                    continue
                runs = hashes[begins[i] : begins[i + 1]]
                different = np.unique(runs)
                size = partition_for(len(runs), len(different))
                if size == BY_RUNS:
                    keys = _keys(telling(different, containment), 0, BY_RUNS)
                else:
                    keys = [
                        _keys(((runs ^ flip[k]) * odd[k]).min(keepdims=True), k, size)[0]
                        for k in range(n)
                    ]
                out.append(
                    (
                        batch["item_id"].iloc[i],
                        size,
                        different.tobytes(),
                        np.array(keys, _U).astype(np.int64),
                    )
                )
            yield pd.DataFrame(out, columns=["item_id", "size", "runs", "keys"])

    return valued


def _bit(keys: np.ndarray, bits: int) -> np.ndarray:
    return keys & _U(bits - 1)


def _window_hits(n: int, sizes: list[int], table: bytes, bits: int):
    def found(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        odd, flip = functions(n)
        known = np.frombuffer(table, dtype=np.uint8)
        for batch in batches:
            texts = batch["text"].tolist()
            for part in chunks(texts):
                hashes, begins = shingle_hashes(texts[part])
                hits = [[] for _ in texts[part]]
                if len(hashes) and BY_RUNS in sizes:
                    keys = _keys(hashes, 0, BY_RUNS)
                    bit = _bit(keys, bits)
                    at = known[bit >> _U(3)] >> (bit & _U(7)).astype(np.uint8) & 1
                    own = np.repeat(np.arange(len(hits)), np.diff(begins))
                    for w in np.flatnonzero(at):
                        hits[own[w]].append(int(keys[w].astype(np.int64)))
                if len(hashes):
                    layout = _layout(np.diff(begins), begins, sizes)
                    for k in range(n):
                        values = (hashes ^ flip[k]) * odd[k]
                        for size, starts, owner, follows in layout:
                            values = np.minimum.reduceat(values, starts)
                            windows = values.copy()
                            windows[:-1][follows] = np.minimum(values[:-1], values[1:])[follows]
                            if size not in sizes:
                                continue
                            keys = _keys(windows, k, size)
                            bit = _bit(keys, bits)
                            at = known[bit >> _U(3)] >> (bit & _U(7)).astype(np.uint8) & 1
                            for w in np.flatnonzero(at):
                                hits[owner[w]].append(int(keys[w].astype(np.int64)))
                own = batch.iloc[part]
                some = [bool(x) for x in hits]
                yield pd.DataFrame(
                    {
                        "doc_id": own["doc_id"][some],
                        "text_hash": own["text_hash"][some],
                        "keys": pd.Series(
                            [sorted(set(x)) for x in hits if x], own.index[some], dtype=object
                        ),
                    }
                )

    return found


def _layout(lengths: np.ndarray, begins: np.ndarray, sizes: list[int]) -> list[tuple]:
    """For each block size, doubling: where blocks begin in the level below, their text, and
    whether the next block is of the same text."""
    out, size = [], SMALLEST_PARTITION
    owner = np.repeat(np.arange(len(lengths)), lengths)
    counts, offsets, step = lengths, begins[:-1], size
    while size <= max(sizes):
        blocks = -(-counts // step)
        text = np.repeat(np.arange(len(lengths)), blocks)
        first = np.concatenate([[0], np.cumsum(blocks)])[:-1]
        starts = offsets[text] + (np.arange(len(text)) - first[text]) * step
        owner = text
        out.append((size, starts, owner, owner[:-1] == owner[1:]))
        counts, offsets, step = blocks, first, 2
        size *= 2
    return out


def _verified(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Exact counts for rows of a text and some of the items that may be in it."""
    last, own = None, np.empty(0, _U)
    for batch in batches:
        out = []
        for doc_id, text_hash, text, items in batch.itertuples(index=False):
            if text is not last and text != last:  # rows of a document stand together
                last, own = text, np.unique(shingle_hashes([text])[0])
            for item in items:
                runs = np.frombuffer(item["runs"], _U)
                at = np.searchsorted(own, runs)
                at[at == len(own)] = 0
                shared = int((own[at] == runs).sum())
                out.append((doc_id, text_hash, item["item_id"], shared, len(runs)))
        columns = ["doc_id", "text_hash", "item_id", "shared", "item_runs"]
        frame = pd.DataFrame(out, columns=columns)
        yield frame.astype({"doc_id": "Int64", "item_id": "Int64"})


def _bit_table(items: DataFrame, n: int) -> tuple[list[int], bytes, int]:
    """Partitions in use, and the bit table: its size is bounded by MOST_BITS, not by the items."""
    sizes = [row["size"] for row in items.select("size").distinct().collect()]
    values = n * items.count()
    bits = min(MOST_BITS, max(LEAST_BITS, 1 << (16 * values).bit_length()))
    keys = items.select(F.explode("keys").alias("key"))
    filled = keys.select(F.col("key").bitwiseAND(bits - 1).alias("bit")).select(
        F.shiftright("bit", 3).alias("byte"),
        F.expr("shiftleft(1, cast(bit & 7 as int))").alias("mask"),
    )
    table = np.zeros(bits // 8, dtype=np.uint8)
    for row in filled.groupBy("byte").agg(F.bit_or("mask").alias("mask")).toLocalIterator():
        table[row["byte"]] = row["mask"]
    return sorted(sizes), table.tobytes(), bits


def contained(
    docs: DataFrame, items: DataFrame, containment: float = CONTAINMENT, recall: float = RECALL
) -> DataFrame:
    """One row per document and item in it: ``doc_id, text_hash, item_id, shared, item_runs``.

    ``shared`` of the item's ``item_runs`` distinct runs stand in the document.
    ``containment`` has one decimal.
    """
    n = hash_functions(containment, recall)
    items = staged(
        items.select("item_id", "text").mapInPandas(
            _item_values(n, containment), "item_id long, size int, runs binary, keys array<long>"
        ),
        "items",
    )
    sizes, bits_set, bits = _bit_table(items, n)
    own = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text")
    if not sizes:
        empty = "doc_id long, text_hash long, item_id long, shared long, item_runs long"
        return docs.sparkSession.createDataFrame([], empty)
    hits = staged(
        own.mapInPandas(
            _window_hits(n, sizes, bits_set, bits),
            "doc_id long, text_hash long, keys array<long>",
        ),
        "hits",
    )
    by_key = items.select("item_id", F.explode("keys").alias("key"))
    candidates = staged(
        hits.select("doc_id", "text_hash", F.explode("keys").alias("key"))
        .join(by_key, "key")
        .select("doc_id", "text_hash", "item_id")
        .distinct(),
        "candidates",
    )
    # a text travels with some hundred items at once, not with each
    part = F.pmod(F.xxhash64("item_id"), F.lit(-(-items.count() // ITEMS_AT_ONCE)))
    with_runs = (
        candidates.join(items.select("item_id", "runs").distinct(), "item_id")
        .groupBy(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash"), part.alias("_part"))
        .agg(F.collect_list(F.struct("item_id", "runs")).alias("items"))
    )
    met = own.join(
        with_runs, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("text_hash") == F.col("_hash"))
    )
    verified = met.select("doc_id", "text_hash", "text", "items").mapInPandas(
        _verified, "doc_id long, text_hash long, item_id long, shared long, item_runs long"
    )
    return verified.where(F.col("shared") * 10 >= F.col("item_runs") * round(10 * containment))


def decontaminated(docs: DataFrame, items: DataFrame, containment: float = CONTAINMENT) -> DataFrame:
    """The documents that hold no item, with all their columns."""
    bad = staged(
        contained(docs, items, containment).select("doc_id", "text_hash").distinct(), "bad"
    )
    return docs.join(
        bad,
        docs["doc_id"].eqNullSafe(bad["doc_id"])
        & (F.xxhash64(docs["text"]) == bad["text_hash"]),
        "left_anti",
    )
