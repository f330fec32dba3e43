"""Exact top-k search by inner product with MaxScore.

Components are the terms, candidates' components the postings. For a query each
term has a bound, the most it can add in a shard. Terms are ordered by bound; the
threshold, the k-th best score so far, splits them: what the non-essential ones can
add together is not enough to reach it. Essential postings are added up for all
candidates of a block, the others are probed in groups only for candidates that
can still get in. Scores are integers, so bounds and ties are exact.

Candidates are cut into shards and queries into blocks; each pair of a shard and a
block is one task with bounded rows, and the k best of each are merged.

Results: vectors that are NULL, empty, without vec_id or hold a NULL or non-finite
component take no part. Shorter vectors have zeros at the end. A row is a query's own if it has
its vec_id; repeated query rows are one query, of which the smallest vector counts.
Other repeated rows are candidates of their own. Scores fit a long. Extra columns are not read. No
candidates: no rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from inkveil.llm.common import staged

SCALE = 256
EVERY = 50
BEST = 5
#: rows of a shard of candidates and of a block of queries, on average
SHARD, BLOCK = 16_384, 4_096
#: non-essential terms probed before candidates are screened again
GROUP = 8


def quantized(embeddings: DataFrame) -> DataFrame:
    """``vec_id, v``: floor(256 * x) of each component, of the vectors that take part."""
    x = F.col("embedding")
    bad = F.exists(
        x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c.cast("double")) == float("inf"))
    )
    v = F.transform(x, lambda c: F.floor(c.cast("double") * SCALE).cast("long"))
    whole = x.isNotNull() & (F.size(x) > 0) & ~bad
    return embeddings.where(whole & F.col("vec_id").isNotNull()).select("vec_id", v.alias("v"))


def _matrix(vectors: pd.Series, width: int) -> np.ndarray:
    out = np.zeros((len(vectors), width), dtype=np.int64)
    for row, v in zip(out, vectors, strict=True):
        row[: len(v)] = v
    return out


def _number_type(a: np.ndarray, b: np.ndarray):
    """The fastest type that holds all inner products exactly."""
    most = int(np.abs(a).max()) * int(np.abs(b).max()) * a.shape[1]
    return np.float32 if most < 1 << 24 else np.float64 if most < 1 << 53 else np.int64


class _Best:
    """The k best of a query so far, ties to the smaller id."""

    def __init__(self, k: int, kind: type):
        self.k, self.scores, self.ids = k, np.empty(0, kind), np.empty(0, np.int64)

    def threshold(self) -> float:
        return self.scores[-1] if len(self.scores) == self.k else -np.inf

    def add(self, scores: np.ndarray, ids: np.ndarray) -> None:
        scores, ids = np.concatenate([self.scores, scores]), np.concatenate([self.ids, ids])
        order = np.lexsort((ids, -scores))[: self.k]
        self.scores, self.ids = scores[order], ids[order]


def _search(q: np.ndarray, own: int, postings: np.ndarray, ids: np.ndarray, high: np.ndarray,
            low: np.ndarray, best: _Best) -> None:
    bounds = np.maximum(q * high, q * low)
    order = np.argsort(-bounds, kind="stable")
    left = np.concatenate([np.cumsum(bounds[order][::-1])[::-1], [0]])  # what terms from i on add
    most = np.flatnonzero(left >= best.threshold())
    essential = int(most[-1]) + 1 if len(most) else 0
    essential = min(essential, len(order))
    if essential == 0:
        return
    terms = order[:essential]
    scores = q[terms] @ postings[terms]
    alive = np.flatnonzero((scores + left[essential] >= best.threshold()) & (ids != own))
    scores = scores[alive]
    for at in range(essential, len(order), GROUP):
        terms = order[at : at + GROUP]
        scores = scores + q[terms] @ postings[terms][:, alive]
        stay = scores + left[min(at + GROUP, len(order))] >= best.threshold()
        alive, scores = alive[stay], scores[stay]
    if len(alive) > 4 * best.k:  # the k best and all their ties
        cut = np.partition(scores, len(scores) - best.k)[len(scores) - best.k]
        alive, scores = alive[scores >= cut], scores[scores >= cut]
    best.add(scores, ids[alive])


def _searcher(k: int):
    def found(key: tuple, candidates: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(candidates) and len(queries):
            width = max(candidates["v"].map(len).max(), queries["v"].map(len).max())
            matrix, wanted = _matrix(candidates["v"], width), _matrix(queries["v"], width)
            kind = _number_type(matrix, wanted)
            ids = candidates["vec_id"].to_numpy()
            # a first, small block gives the threshold that the others are screened by
            cuts = [0, min(len(ids), 512), *range(4608, len(ids), 4096), len(ids)]
            blocks = []
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                if a < b:
                    part = np.ascontiguousarray(matrix[a:b].T.astype(kind))
                    blocks.append((part, ids[a:b], part.max(1), part.min(1)))
            for own, q in zip(queries["vec_id"], wanted.astype(kind), strict=True):
                best = _Best(k, kind)
                for part, names, high, low in blocks:
                    _search(q, own, part, names, high, low, best)
                out += [(own, int(i), int(s)) for i, s in zip(best.ids, best.scores, strict=True)]
        return pd.DataFrame(out, columns=["query_id", "vec_id", "score"])

    return found


def top_k(queries: DataFrame, candidates: DataFrame, k: int = BEST) -> DataFrame:
    """``query_id, rank, vec_id, score``; both sides have ``vec_id`` and integers ``v``."""
    queries = staged(queries.groupBy("vec_id").agg(F.min("v").alias("v")), "queries")
    candidates = staged(
        candidates.select("vec_id", "v", F.monotonically_increasing_id().alias("row")), "candidates"
    )
    shards = max(1, -(-candidates.count() // SHARD))
    blocks = max(1, -(-queries.count() // BLOCK))
    number = lambda n: F.explode(F.expr(f"sequence(0L, {n - 1}L)"))
    left = candidates.withColumn("shard", F.pmod(F.xxhash64("row"), F.lit(shards))).withColumn(
        "block", number(blocks)
    )
    right = queries.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(blocks))).withColumn(
        "shard", number(shards)
    )
    found = (
        left.groupBy("shard", "block")
        .cogroup(right.groupBy("shard", "block"))
        .applyInPandas(_searcher(k), "query_id long, vec_id long, score long")
    )
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def nearest(embeddings: DataFrame) -> DataFrame:
    """Each vector whose vec_id is divisible by 50 against all others."""
    vectors = quantized(embeddings)
    return top_k(vectors.where(F.col("vec_id") % EVERY == 0), vectors)
