"""Principal components and whitened coordinates of a table of vectors.

Golub-Kahan-Lanczos bidiagonalisation of the centred rows X: from a unit vector v, a step
takes u = Xv and Xᵀu, each made orthogonal to all before it, and leaves one row of a small
bidiagonal matrix whose singular values and vectors are those of X.  The rows stay where
they are: u, which has an entry for every row, is kept as the vector p with u = Xp, so a
step is one pass in which every task multiplies its blocks by p, and adds up Xᵀ(Xp), the
length of u and its products with the u before it.  What reaches the driver has the
dimension of the vectors.

Vectors that are missing or empty, or hold a missing or non-finite entry, take no part,
nor do vectors whose length isn't the most frequent one (ties: the longer).  Rows without
an id and repeated ids are rows like all others.  Components without variance, as in
tables of one vector or of equal ones, have no whitened coordinates and are left out;
empty tables give no rows.  Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkveil.llm.common import staged

COMPONENTS = 8
SCALE, SHIFT = 1024, 100_000
#: rows of a block; a block is one binary value
BLOCK = 4096
#: a triplet has converged when its residual is so small beside the largest singular value
RESIDUAL = 1e-14
#: a variance below this part of the largest is none
RANK = 1e-20
#: products with earlier vectors above this make a second orthogonalisation necessary
ORTHOGONAL = 1e-12


@dataclass(frozen=True)
class Whitening:
    """What a fit has found: ``components`` are rows, by falling ``variances``."""

    n: int
    sums: np.ndarray
    components: np.ndarray
    variances: np.ndarray
    total: float
    identity_error: float = 0.0

    @property
    def center(self) -> np.ndarray:
        return self.sums / max(self.n, 1)

    def project(self, x: np.ndarray) -> np.ndarray:
        return (x - self.center) @ (self.components / np.sqrt(self.variances)[:, None]).T


def usable(table: DataFrame, vector: str = "embedding") -> DataFrame:
    """``vec_id, x``: the vectors that take part, as long integers."""
    number = F.col(vector)
    finite = F.forall(number, lambda c: c.isNotNull() & (F.abs(c.cast("double")) < float("inf")))
    whole = table.select("vec_id", number).where(
        number.isNotNull() & (F.size(number) > 0) & F.coalesce(finite, F.lit(False))
    )
    sizes = whole.groupBy(F.size(vector).alias("size")).agg(F.count(F.lit(1)).alias("rows"))
    first = sizes.orderBy(F.desc("rows"), F.desc("size")).first()
    if first is None:
        first = {"size": 0}
    scaled = F.transform(number, lambda c: F.floor(c.cast("double") * SCALE) + SHIFT)
    return whole.where(F.size(vector) == first["size"]).select("vec_id", scaled.alias("x"))


def blocks(vectors: DataFrame) -> DataFrame:
    """Rows packed into matrices, so that a pass reads long runs of numbers."""

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), BLOCK):
                part = batch.iloc[at : at + BLOCK]
                x = np.array(part["x"].tolist(), dtype=np.int64)
                named = part["vec_id"].notna().to_numpy()
                ids = part["vec_id"].fillna(0).to_numpy(dtype=np.int64)
                yield pd.DataFrame({"ids": [ids.tobytes()], "named": [named.tobytes()],
                                    "x": [x.tobytes()]})

    own = vectors.select(F.col("vec_id").cast("long"), "x")
    return own.mapInPandas(pack, "ids binary, named binary, x binary")


def _matrix(raw: bytes, rows: int) -> np.ndarray:
    return np.frombuffer(raw, dtype=np.int64).reshape(rows, -1)


def _added(
    packed: DataFrame, each: Callable[[np.ndarray], np.ndarray], kind: str = "double"
) -> np.ndarray:
    """Sums over all blocks of what ``each`` makes of a block: one short vector."""

    def partial_sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = None
        for batch in batches:
            for ids, x in zip(batch["ids"], batch["x"]):
                made = each(_matrix(x, len(ids) // 8))
                total = made if total is None else total + made
        if total is not None:
            yield pd.DataFrame({"at": np.arange(len(total)), "value": total})

    parts = packed.select("ids", "x").mapInPandas(partial_sums, f"at int, value {kind}")
    rows = parts.groupBy("at").agg(F.sum("value").alias("value")).collect()
    return np.array([r["value"] for r in sorted(rows, key=lambda r: r["at"])])


def _step(x: np.ndarray, center: np.ndarray, p: np.ndarray, earlier: np.ndarray) -> np.ndarray:
    """Of one block: Xᵀu, the square of u and the products with the u before it; u = Xp."""
    own = x - center
    u = own @ p
    return np.concatenate([own.T @ u, [u @ u], (own @ earlier).T @ u])


def _without(vector: np.ndarray, basis: list[np.ndarray]) -> np.ndarray:
    for _ in range(2):
        for b in basis:
            vector = vector - (b @ vector) * b
    return vector


def bidiagonalised(
    packed: DataFrame, center: np.ndarray, wanted: int
) -> tuple[np.ndarray, np.ndarray]:
    """Right singular vectors (rows) and singular values of the centred rows, largest first."""
    size = len(center)
    rng = np.random.default_rng(0)
    right: list[np.ndarray] = []  # the v
    images = np.empty((size, 0))  # Xᵀu of every u
    left = np.empty((size, 0))  # the p of every u
    bidiagonal = np.zeros((size, size))
    v = rng.standard_normal(size)
    scale, beta = 0.0, 0.0
    for j in range(size):
        if beta <= 1e-13 * scale:
            # the space is used up, or nothing has been looked at: a new direction
            v, beta = _without(rng.standard_normal(size), right), 0.0
        v = _without(v / np.linalg.norm(v), right)
        v /= np.linalg.norm(v)
        right.append(v)
        if j:
            bidiagonal[j - 1, j] = beta
        # products of Xv with the u before it are known: (Xᵀu)·v
        p = v - left @ (images.T @ v)
        for _ in range(2):
            made = _added(packed, partial(_step, center=center, p=p, earlier=left))
            image, square, products = made[:size], made[size], made[size + 1 :]
            if not j or np.abs(products).max() <= ORTHOGONAL * np.sqrt(square):
                break
            p = p - left @ products
        alpha = np.sqrt(max(square, 0.0))
        scale = max(scale, alpha)
        if alpha <= 1e-13 * scale:
            alpha, p, image = 0.0, np.zeros(size), np.zeros(size)
        else:
            p, image = p / alpha, image / alpha
        bidiagonal[j, j] = alpha
        left, images = np.column_stack([left, p]), np.column_stack([images, image])
        v = _without(image, right)
        beta = float(np.linalg.norm(v))
        scale = max(scale, beta)
        if j + 1 >= min(wanted, size):
            first, values, rest = np.linalg.svd(bidiagonal[: j + 1, : j + 1])
            residuals = beta * np.abs(first[-1, :wanted])
            if (residuals <= RESIDUAL * max(values[0], 1e-300)).all() and beta > 1e-13 * scale:
                break
    return rest @ np.array(right), values


def fit(packed: DataFrame, components: int = COMPONENTS) -> Whitening | None:
    """Components over all blocks; None for a table without vectors."""
    counted = _added(packed, lambda x: np.concatenate([[len(x)], x.sum(axis=0)]), "long")
    if not len(counted):
        return None
    n, sums = int(counted[0]), counted[1:].astype(np.int64)
    center = sums / n
    squares = _added(packed, lambda x: np.array([((x - center) ** 2).sum()]))
    vectors, values = bidiagonalised(packed, center, components)
    variances = values**2 / n
    kept = variances[:components] > RANK * max(variances[0], 0.0)
    kept &= variances[:components] > 0
    found = Whitening(
        n, sums, vectors[:components][kept], variances[:components][kept], float(squares[0]) / n
    )
    k = len(found.variances)
    if not k:
        return found
    means = _added(packed, lambda x: found.project(x).sum(axis=0)) / n

    def products(x: np.ndarray) -> np.ndarray:
        y = found.project(x) - means
        return (y.T @ y).ravel()

    covariance = _added(packed, products).reshape(k, k) / n
    error = float(np.abs(covariance - np.eye(k)).max())
    return Whitening(n, sums, found.components, found.variances, found.total, error)


def _deviations(x: np.ndarray, found: Whitening) -> list[int]:
    """Sum over the dimensions of (n x - S)², in integers of any size."""
    furthest = float(np.abs(x - found.center).max()) * found.n
    kind = np.int64 if furthest**2 * x.shape[1] < 2.0**62 else object
    off = x.astype(kind) * found.n - found.sums.astype(kind)
    return [int(v) for v in (off * off).sum(axis=1)]


def whitened(table: DataFrame, vector: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """One row per vector and component, with the fit's figures beside it.

    ``deviation`` is a decimal of 38 digits.
    """
    schema = (
        "vec_id long, component int, n long, deviation decimal(38,0), whitened double,"
        " explained double, identity_error double"
    )
    packed = staged(blocks(usable(table, vector)), "blocks")
    found = fit(packed, components)
    if found is None or not len(found.variances):
        return table.sparkSession.createDataFrame([], schema)
    explained = found.variances / found.total
    text = schema.replace("decimal(38,0)", "string")

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        k = len(found.variances)
        for batch in batches:
            for ids, named, raw in zip(batch["ids"], batch["named"], batch["x"]):
                numbers = np.frombuffer(ids, dtype=np.int64)
                x = _matrix(raw, len(numbers))
                known = pd.array(numbers, dtype="Int64")
                known[~np.frombuffer(named, dtype=bool)] = pd.NA
                yield pd.DataFrame(
                    {
                        "vec_id": known.repeat(k),
                        "component": np.tile(np.arange(1, k + 1, dtype=np.int32), len(x)),
                        "n": found.n,
                        "deviation": np.repeat([str(d) for d in _deviations(x, found)], k),
                        "whitened": found.project(x).ravel(),
                        "explained": np.tile(explained, len(x)),
                        "identity_error": found.identity_error,
                    }
                )

    made = packed.mapInPandas(rows, text)
    return made.withColumn("deviation", F.col("deviation").cast("decimal(38,0)"))


def digests(table: DataFrame) -> DataFrame:
    """The same with ``deviation`` as a long, null where no long can hold it."""
    return whitened(table).withColumn("deviation", F.expr("try_cast(deviation AS long)"))
