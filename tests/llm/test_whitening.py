import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from barwright.llm import whitening

ROWS = "vec_id long, x array<bigint>, component string, n string"


def table(spark, x, ids=None):
    ids = range(len(x)) if ids is None else ids
    return spark.createDataFrame([(i, None if r is None else [None if c is None else int(c) for c in r], "a", "b") for i, r in zip(ids, x, strict=True)], ROWS)


def plain(x, k=8):
    n = len(x)
    sums = [sum(int(c) for c in col) for col in zip(*x, strict=True)]
    centred = np.array([[(n * int(c) - s) / n for c, s in zip(r, sums, strict=True)] for r in x])
    deviation = [sum((n * int(c) - s) ** 2 for c, s in zip(r, sums, strict=True)) for r in x]
    e, vectors = np.linalg.eigh(centred.T @ centred / n)
    e, vectors = e[::-1], vectors[:, ::-1]
    k = min(k, int((e > 1e-20 * e[0]).sum()))
    return deviation, centred @ vectors[:, :k] / np.sqrt(e[:k]), e[:k] / e.sum()


def got(spark, x, **more):
    rows = whitening.whiten(table(spark, x), **more).collect()
    y = np.zeros((len(x), max(r["component"] for r in rows)))
    for r in rows:
        y[r["vec_id"], r["component"] - 1] = r["whitened"]
    return rows, y


def equal_up_to_sign(a, b, exact=1e-9):
    signs = np.sign((a * b).sum(0))
    assert np.abs(a - b * signs).max() < exact * np.abs(b).max()


@pytest.mark.parametrize("spread", [[900, 700, 500, 400, 350, 300, 250, 220] + [200 - 3 * k for k in range(40)], [100000 / 3**k for k in range(9)] + [3, 2]], ids=["flat", "steep"])
def test_equals_eigenvectors(spark, spread):
    draw = np.random.default_rng(4)
    turn, _ = np.linalg.qr(draw.standard_normal((len(spread), len(spread))))
    x = np.floor(draw.standard_normal((3000, len(spread))) * spread @ turn).astype(int) + 100_000
    deviation, y, explained = plain(x)
    rows, found = got(spark, x)
    assert len(rows) == 8 * len(x) and {r["n"] for r in rows} == {len(x)}
    equal_up_to_sign(found, y)
    assert all(r["deviation"] == deviation[r["vec_id"]] for r in rows)
    assert all(math.isclose(r["explained"], explained[r["component"] - 1], rel_tol=1e-9) for r in rows)
    assert max(r["identity_error"] for r in rows) < 1e-9


def test_equal_deviations_are_found_as_often_as_they_occur(spark):
    """The rows of a cube's corners: one Krylov space holds one direction only."""
    x = np.array([[(k >> j & 1) * 2 - 1 for j in range(6)] for k in range(64)])
    rows, y = got(spark, x)
    assert y.shape == (64, 6)
    assert np.abs(y.T @ y / 64 - np.eye(6)).max() < 1e-12 and max(r["identity_error"] for r in rows) < 1e-12
    assert all(math.isclose(r["explained"], 1 / 6) for r in rows)


def test_fewer_directions_than_entries(spark):
    draw = np.random.default_rng(5)
    x = draw.integers(-50, 50, (200, 3)) @ draw.integers(-9, 9, (3, 20))
    _, y, _ = plain(x)
    rows, found = got(spark, x)
    assert found.shape == (200, 3) and max(r["identity_error"] for r in rows) < 1e-9
    equal_up_to_sign(found, y[:, :3])
    assert math.isclose(sum(r["explained"] for r in rows[:3]), 1)


def test_one_wanted_component_ends_early(spark, monkeypatch):
    draw = np.random.default_rng(6)
    x = np.floor(draw.standard_normal((500, 40)) * [10**6 if k == 3 else 1 for k in range(40)]).astype(int)
    steps = []
    real = whitening._both_ways
    monkeypatch.setattr(whitening, "_both_ways", lambda *a: steps.append(1) or real(*a))
    _, found = got(spark, x, components=1)
    assert len(steps) < 40
    equal_up_to_sign(found, plain(x, 1)[1])


def test_large_sums_are_exact_or_null(spark):
    x = [[2**50, 1], [-(2**50), 0], [5, 7]]
    deviation = plain(x)[0]
    rows, _ = got(spark, x)
    assert {r["vec_id"]: r["deviation"] for r in rows} == {k: d if d < 2**63 else None for k, d in enumerate(deviation)}
    assert any(r["deviation"] is None for r in rows)


def test_rows_that_do_not_count(spark):
    """Null, empty and partly null vectors and those of another length go; repeats and null ids stay."""
    x = [[1, 2], [3, 5], None, [], [1, None], [1, 2, 3], [1, 2], [9, 0], [4, 4]]
    ids = [1, 2, 3, 4, 5, 6, 1, None, 8]
    rows = whitening.whiten(table(spark, x, ids)).collect()
    kept = [[1, 2], [3, 5], [1, 2], [9, 0], [4, 4]]
    assert sorted(str(r["vec_id"]) for r in rows) == sorted(2 * ["1", "2", "1", "None", "8"])
    assert {r["n"] for r in rows} == {5}
    assert sorted(r["deviation"] for r in rows if r["component"] == 1) == sorted(plain(kept)[0])


@pytest.mark.parametrize("x", [[], [None], [[3, 4]], [[3, 4]] * 5], ids=["empty", "null", "one", "equal"])
def test_nothing_varies(spark, x):
    found = whitening.whiten(table(spark, x))
    assert found.collect() == [] and found.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]


def test_whole_entries(spark):
    nan, inf = float("nan"), float("inf")
    rows = spark.createDataFrame([([0.5, -0.0001],), ([nan],), ([inf, 1.0],), ([-inf],), ([None],), (None,), ([],), ([1e300],)], "e array<double>")
    assert [r[0] for r in rows.select(whitening.whole_entries("e")).collect()] == [[100_512, 99_999], None, None, None, None, None, [], None]
    floats = rows.select(F.col("e").cast("array<float>").alias("e")).limit(1)
    assert floats.select(whitening.whole_entries("e")).first()[0] == [100_512, 99_999]
