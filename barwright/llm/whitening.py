"""Whitening of vectors by Golub-Kahan-Lanczos bidiagonalisation.

The centred rows X are products away from a small matrix: X V = U B with orthonormal V and U and an
upper bidiagonal B, whose singular value decomposition gives the components and their deviations.
Each step is one pass over the rows, Xv on the way out and X'u on the way back. A left vector is as
long as the table, so it is kept as the combination w of columns that makes it, u = Xw; products with
it are again products with rows. New vectors are orthogonalised against all earlier ones on both
sides, the left ones twice: by what the earlier passes say and by the products measured in their own.
The driver holds vectors of one row's length, at most as many as a row has entries.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barwright.scratch import stored

#: Components asked for, and bytes of a block of rows.
COMPONENTS, BLOCK_BYTES = 8, 1 << 16
#: A length below this share of the largest deviation counts as nothing.
NOTHING = 1e-13
#: Entries beyond this, either way, are not used: they would not fit a long once scaled.
LARGEST = 2.0**40

_SCHEMA = "vec_id {id}, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"


def whole_entries(column: str, scale: int = 1024, shift: int = 100_000) -> Column:
    """Entries times ``scale``, rounded down, plus ``shift``, as longs; null where the vector is null or
    holds a null, an entry that is not finite, or one beyond LARGEST."""
    usable = ~F.exists(column, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) > LARGEST))
    return F.when(usable, F.transform(column, lambda c: F.floor(c.cast("double") * scale).cast("bigint") + shift))


def whiten(vectors: DataFrame, *, components: int = COMPONENTS) -> DataFrame:
    """``vec_id, component, n, deviation, whitened, explained, identity_error``: each row of
    ``vectors(vec_id, x array<bigint>)`` along each component, from 1 by falling deviation.

    Rows whose ``x`` is null, empty or holds null are left out, and so are rows of another length than
    most (of equally many, the longer). ``n`` counts the others; all statistics are over them.
    ``deviation`` is the sum of the squares of n times each entry less its column's sum, or null where
    that exceeds a long. ``whitened`` is the centred row along the component, in units of the column
    deviation there; ``explained`` the component's share of the variance; ``identity_error`` the
    largest entry by which the covariance of what is returned differs from the identity. There are
    fewer components if the rows span fewer directions, none if all are equal; then, and for an empty
    table, the result is empty. Null ids and repeated rows stay; other columns are left out.
    """
    kind = vectors.schema["vec_id"].dataType.simpleString()
    rows = vectors.select("vec_id", "x").filter(F.col("x").isNotNull() & (F.size("x") > 0) & ~F.exists("x", lambda c: c.isNull()))
    usual = rows.groupBy(F.size("x").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("d")).first()
    nothing = vectors.sparkSession.createDataFrame([], _SCHEMA.format(id=kind))
    if usual is None:
        return nothing
    d, n = usual["d"], usual["n"]
    rows = rows.filter(F.size("x") == d)
    sums = _added(rows.select("x").mapInArrow(_column_sums(d), "place int, total bigint"), "decimal(38,0)")
    blocks = stored(rows.mapInArrow(_centred(d, n, [int(s) for s in sums]), f"ids array<{kind}>, deviations array<bigint>, rows binary, squares double"), "centred")
    variance = blocks.agg(F.sum("squares")).first()[0] / n
    if not variance > 0:
        return nothing
    basis, spread = bidiagonalise(blocks, d, components)
    keep = spread > NOTHING * max(d, 10) * spread[0]
    directions = basis[:, keep] / (spread[keep] / np.sqrt(n))
    explained = spread[keep] ** 2 / n / variance
    moments = _added(blocks.select("rows").mapInArrow(_moments(directions), "place int, total double"), "double")
    k = directions.shape[1]
    mean = np.array(moments[:k]) / n
    covariance = np.array(moments[k:]).reshape(k, k) / n - np.outer(mean, mean)
    error = float(np.abs(covariance - np.eye(k)).max())
    return blocks.mapInArrow(_projected(directions, explained, n, error), _SCHEMA.format(id=kind))


def bidiagonalise(blocks: DataFrame, d: int, components: int, seed: int = 12) -> tuple[np.ndarray, np.ndarray]:
    """The leading right singular vectors of the rows, as columns, and the singular values.

    Steps end when the wanted vectors are exact to double precision, at the latest with a full basis.
    A vector that has no part outside the earlier ones is replaced by another direction, so that equal
    deviations are found as often as they occur.
    """
    draw = np.random.default_rng(seed)
    right, left, back = np.zeros((d, 0)), np.zeros((d, 0)), np.zeros((d, 0))
    diagonal, above = [], []
    v = _outside(draw.standard_normal(d), right)
    v /= np.linalg.norm(v)
    while True:
        # u is Xv less its parts along the earlier ones, whose products with v are known
        w = v - left @ (back.T @ v)
        sums = _added(blocks.select("rows").mapInArrow(_both_ways(left, w), "place int, total double"), "double")
        z, square, along = np.array(sums[:d]), sums[d], np.array(sums[d + 1 :])
        w, z = w - left @ along, z - back @ along
        alpha = np.sqrt(max(square - along @ along, 0.0))
        largest = max([alpha, *diagonal, *above])
        if alpha > NOTHING * largest:
            w, z = w / alpha, z / alpha
        else:
            alpha, w, z = 0.0, np.zeros(d), np.zeros(d)
        right, left, back = (np.column_stack(pair) for pair in ((right, v), (left, w), (back, z)))
        diagonal.append(alpha)
        v = _outside(z, right)
        beta = np.linalg.norm(v)
        outer, spread, inner = np.linalg.svd(np.diag(diagonal) + np.diag(above, 1))
        steps = len(diagonal)
        exact = beta * np.abs(outer[-1, :components]) <= np.finfo(float).eps * spread[0]
        if steps == d or (steps > components and beta > NOTHING * largest and exact.all()):
            return right @ inner[:components].T, spread[:components]
        if beta <= NOTHING * largest:
            beta, v = 0.0, _outside(draw.standard_normal(d), right)
            v /= np.linalg.norm(v)
        else:
            v /= beta
        above.append(beta)


def _outside(v: np.ndarray, basis: np.ndarray) -> np.ndarray:
    """``v`` without its parts along ``basis``; taken twice, for what rounding leaves."""
    for _ in range(2):
        v = v - basis @ (basis.T @ v)
    return v


def _added(parts: DataFrame, kind: str) -> list:
    """The sums of ``(place, total)`` over all tasks, by place."""
    sums = parts.groupBy("place").agg(F.sum(F.col("total").cast(kind)).alias("total"))
    return [r["total"] for r in sums.orderBy("place").collect()]


def _matrix(column: pa.Array, d: int, kind: type) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(kind, copy=False).reshape(-1, d)


def _totals(sums: np.ndarray) -> pa.RecordBatch:
    return pa.record_batch({"place": pa.array(np.arange(len(sums), dtype=np.int32)), "total": pa.array(sums)})


def _column_sums(d: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(d, np.int64)
        for batch in batches:
            sums += _matrix(batch.column(0), d, np.int64).sum(0)
        yield _totals(sums)

    return run


def _centred(d: int, n: int, sums: list[int]) -> Callable:
    """Blocks of rows less the columns' means. What is squared and summed is whole numbers."""

    def exact(x: np.ndarray) -> np.ndarray:
        fits = max(abs(int(x.max())), abs(int(x.min()))) * n < 2**61 and max(map(abs, sums)) < 2**61
        return n * x - np.array(sums, np.int64) if fits else n * x.astype(object) - np.array(sums, object)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = max(1, BLOCK_BYTES // (8 * d))
        for batch in batches:
            every = _matrix(batch.column(1), d, np.int64)
            for at in range(0, len(every), step):
                whole = exact(every[at : at + step])
                if d * max(abs(int(whole.max())), abs(int(whole.min()))) ** 2 >= 2**63:
                    whole = whole.astype(object)
                deviations = [int(s) if s < 2**63 else None for s in (whole * whole).sum(1)]
                centred = (whole / n).astype(float)
                ids = batch.column(0).slice(at, len(whole))
                yield pa.record_batch(
                    {
                        "ids": pa.ListArray.from_arrays(pa.array([0, len(whole)], pa.int32()), ids),
                        "deviations": pa.array([deviations], pa.list_(pa.int64())),
                        "rows": pa.array([centred.tobytes()], pa.binary()),
                        "squares": pa.array([float((centred * centred).sum())]),
                    }
                )

    return run


def _blocks(column: pa.Array, d: int) -> Iterator[np.ndarray]:
    for block in column:
        yield np.frombuffer(block.as_buffer(), float).reshape(-1, d)


def _both_ways(left: np.ndarray, w: np.ndarray) -> Callable:
    """Sums of X'u, u'u and the products of u with the earlier left vectors, for u = Xw."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        d, k = left.shape
        sums = np.zeros(d + 1 + k)
        for batch in batches:
            for x in _blocks(batch.column(0), d):
                u = x @ w
                sums[:d] += u @ x
                sums[d] += u @ u
                sums[d + 1 :] += u @ (x @ left)
        yield _totals(sums)

    return run


def _moments(directions: np.ndarray) -> Callable:
    """Sums and products of the whitened rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        d, k = directions.shape
        sums, products = np.zeros(k), np.zeros((k, k))
        for batch in batches:
            for x in _blocks(batch.column(0), d):
                y = x @ directions
                sums += y.sum(0)
                products += y.T @ y
        yield _totals(np.append(sums, products))

    return run


def _projected(directions: np.ndarray, explained: np.ndarray, n: int, error: float) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        d, k = directions.shape
        for batch in batches:
            for block in range(batch.num_rows):
                one = batch.slice(block, 1)
                (x,) = _blocks(one.column(2), d)
                row = pa.array(np.repeat(np.arange(len(x)), k))
                yield pa.record_batch(
                    {
                        "vec_id": one.column(0).flatten().take(row),
                        "component": pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))),
                        "n": pa.array(np.full(len(row), n)),
                        "deviation": one.column(1).flatten().take(row),
                        "whitened": pa.array((x @ directions).ravel()),
                        "explained": pa.array(np.tile(explained, len(x))),
                        "identity_error": pa.array(np.full(len(row), error)),
                    }
                )

    return run
