"""Texts of an Arrow batch as flat numpy arrays: bytes, words and their hashes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Bytes of text handled at a time, so that the arrays of a task stay small whatever a batch holds.
#: A longer text is handled alone.
CHUNK_BYTES = 1 << 20
#: Rows of an Arrow batch at most.
BATCH_ROWS = 1000

_BASE = np.uint64(0x9E3779B97F4A7C15)
_BYTE = np.random.default_rng(20240229).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_PLACE = np.random.default_rng(7).integers(1, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32


def in_small_batches(rows: DataFrame) -> DataFrame:
    """``rows`` for a function over Arrow batches, in a session that makes batches of BATCH_ROWS rows
    at most: whole texts of ten thousand rows, Spark's default, are too much for a Python worker
    beside others. A session that asks for fewer rows keeps its setting."""
    session, name = rows.sparkSession, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(session.conf.get(name)) <= BATCH_ROWS:
        session.conf.set(name, str(BATCH_ROWS))
    return rows


def given_back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``batches``, after which the memory that Arrow keeps for itself goes back to the system: a worker
    that waits for its next task, perhaps of another job, holds no more than it needs."""
    yield from batches
    pa.default_memory_pool().release_unused()


def chunks(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """``(first row, one past the last, bytes, where each row's text starts and the last ends)``.

    A null text has no bytes.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.fill_null("").cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    held = column.buffers()[2]
    data = np.frombuffer(held, np.uint8) if held is not None and held.size else np.zeros(0, np.uint8)
    first = 0
    while first < len(column):
        last = int(np.searchsorted(offsets, offsets[first] + CHUNK_BYTES, "right")) - 1
        last = min(max(last, first + 1), len(column))
        yield first, last, data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
        first = last


def lower_ascii(data: np.ndarray) -> np.ndarray:
    return _LOWER[data]


def words(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each run of bytes other than space, tab and line breaks, and how many runs
    come before each text."""
    inside = ~_SPACE[data]
    starts, ends = inside.copy(), inside.copy()
    if len(data) > 1:
        starts[1:] &= ~inside[:-1]
        ends[:-1] &= ~inside[1:]
    edges = bounds[1:-1]
    edges = edges[(edges > 0) & (edges < len(data))]  # words end with their text
    starts[edges] = inside[edges]
    ends[edges - 1] = inside[edges - 1]
    start, end = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    return start, end, np.searchsorted(start, bounds)


def mixed(x: np.ndarray) -> np.ndarray:
    """Spread 64 bits evenly."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span of bytes that depends on these bytes alone.

    Polynomials over the whole array: a span's sum is a difference of two prefix sums, and a power
    of the inverse base moves it to place 0.
    """
    power = np.full(len(data) + 1, _BASE)
    power[0] = 1
    power = np.multiply.accumulate(power)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * power[:-1], out=total[1:])
    back = np.full(len(data) + 1, np.uint64(pow(int(_BASE), -1, 2**64)))
    back[0] = 1
    back = np.multiply.accumulate(back)
    length = (end - start).astype(np.uint64)
    return mixed((total[end] - total[start]) * back[start] + length * _PLACE[63])


def shingles(word_hash: np.ndarray, upto: np.ndarray, size: int) -> Iterator[np.ndarray]:
    """For each text the sorted distinct hashes of its ``size``-word shingles.

    A text of fewer words, but not none, is one shingle; one without words has none.
    ``upto``: how many words come before each text.
    """
    n = len(word_hash)
    window = np.zeros(max(n - size + 1, 0), np.uint64)
    for k in range(size):
        window += word_hash[k : k + len(window)] * _PLACE[k]
    window = mixed(window)
    for a, b in zip(upto[:-1], upto[1:], strict=True):
        if b - a >= size:
            yield np.unique(window[a : b - size + 1])
        elif b > a:
            part = word_hash[a:b] * _PLACE[: b - a]
            yield mixed(part.sum(keepdims=True) + np.array([b - a], np.uint64) * _PLACE[62])
        else:
            yield np.zeros(0, np.uint64)
