"""Components next to a dense eigenvalue decomposition."""

from __future__ import annotations

import numpy as np
import pytest

from inkveil.llm import whitening


def table(spark, vectors, ids=None):
    rows = [(i if ids is None else ids[i], v, "x", 1) for i, v in enumerate(vectors)]
    schema = "vec_id long, embedding array<float>, x string, component int"
    return spark.createDataFrame(rows, schema)


def brute(vectors):
    x = np.floor(1024 * np.array(vectors, dtype=np.float32).astype(float)).astype(np.int64) + 100000
    n, sums = len(x), x.sum(axis=0)
    centred = x - sums / n
    values, components = np.linalg.eigh(centred.T @ centred / n)
    order = np.argsort(-values)
    deviation = [sum((n * int(a) - int(s)) ** 2 for a, s in zip(row, sums)) for row in x]
    return centred, values[order], components[:, order].T, deviation


def check(spark, vectors, expected=8):
    rows = whitening.digests(table(spark, vectors)).collect()
    centred, values, components, deviation = brute(vectors)
    assert len(rows) == expected * len(vectors)
    made = np.zeros((len(vectors), expected))
    for r in rows:
        made[r.vec_id, r.component - 1] = r.whitened
        assert r.n == len(vectors) and r.deviation == deviation[r.vec_id]
        assert abs(r.explained / (values[r.component - 1] / values.sum()) - 1) < 1e-9
        assert r.identity_error < 1e-9
    return made, centred, values, components


def test_components(spark):
    rng = np.random.default_rng(1)
    vectors = (rng.standard_normal((500, 24)) * np.linspace(2, 0.1, 24)).tolist()
    made, centred, values, components = check(spark, vectors)
    theirs = centred @ components[:8].T / np.sqrt(values[:8])
    signs = np.sign((made * theirs).sum(axis=0))
    assert np.abs(made * signs - theirs).max() < 1e-7


def test_equal_variances(spark):
    """Repeated eigenvalues: any basis of their space will do."""
    corner = np.eye(12) * 0.5
    check(spark, np.concatenate([corner, -corner]).tolist())


def test_few_dimensions_and_low_rank(spark):
    rng = np.random.default_rng(2)
    check(spark, rng.standard_normal((50, 3)).tolist(), 3)
    flat = np.zeros((60, 20))
    flat[:, :2] = rng.integers(-50, 50, (60, 2)) / 8
    check(spark, flat.tolist(), 2)


def test_rows_that_take_no_part(spark):
    rng = np.random.default_rng(3)
    good = rng.standard_normal((40, 5)).tolist()
    bad = [None, [], [1.0, None, 2.0, 1.0, 1.0], [float("nan")] * 5, [float("inf")] * 5, [1.0, 2.0]]
    found = whitening.digests(table(spark, good + bad, [7] * 20 + [None] * 20 + [1] * 6))
    assert found.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    rows = found.collect()
    assert len(rows) == 5 * 40 and {r.n for r in rows} == {40}
    assert sum(r.vec_id is None for r in rows) == 100
    assert whitening.digests(table(spark, bad[:4])).collect() == []
    assert whitening.digests(table(spark, [])).collect() == []
    assert whitening.digests(table(spark, [[1.0, 2.0]] * 9)).collect() == []


def test_deviation_of_any_size(spark):
    packed = whitening.blocks(whitening.usable(table(spark, [[1e6, 2.0], [-1e6, 5.0], [0.0, 1.0]])))
    found = whitening.fit(packed)
    large = whitening.Whitening(
        10**9, found.sums, found.components, found.variances, found.total
    )
    x = np.array([[10**9, 5]])
    expected = sum((10**9 * int(a) - int(s)) ** 2 for a, s in zip(x[0], found.sums))
    assert whitening._deviations(x, large) == [expected]


def test_one_pass_per_step(spark, monkeypatch):
    passes = []
    added = whitening._added
    monkeypatch.setattr(whitening, "_added", lambda *a: passes.append(1) or added(*a))
    rng = np.random.default_rng(4)
    packed = whitening.blocks(whitening.usable(table(spark, rng.standard_normal((200, 10)).tolist())))
    values = whitening.bidiagonalised(packed, whitening.fit(packed).center, 8)[1]
    assert len(values) <= 10 and len(passes) <= 2 * 10 + 4


@pytest.mark.parametrize("size", [1, 2])
def test_tiny_tables(spark, size):
    rows = whitening.digests(table(spark, [[0.5, 1.5], [1.5, 0.5]][:size])).collect()
    assert len(rows) == (0 if size == 1 else 2)
