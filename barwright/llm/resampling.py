"""Importance resampling of documents towards a target.

Two bags of hashed n-grams model the target and the raw texts; a document's weight is the ratio of
its probabilities under them. Gumbel noise on the logarithm of the weights and the k largest sums
draw k documents without replacement in proportion to their weights.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barwright.llm import flat
from barwright.scratch import stored

#: Buckets of the n-gram models, which bounds what is sent to the driver and to every executor.
BUCKETS = 1 << 16
#: Added to each bucket of either model, as a share of its mean.
SMOOTHING = 0.1
#: Labelled rows that the target model is fitted on at most, chosen by a hash of their ids.
TARGET_ROWS = 20_000
#: Keys among which the last one taken is looked up by sorting, and bins of a pass before that.
LAST_KEYS, BINS = 10_000, 1024

_CLASS = np.ones(256, np.uint8)
_CLASS[:128] = 2
_CLASS[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B)]] = 1
_CLASS[[0x20, *range(0x09, 0x0E)]] = 0


def gram_buckets(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``(row, bucket)`` of each word and each pair of neighbouring words in the texts. Words are
    runs of letters and digits, or of other signs; bytes beyond ASCII count as letters."""
    kind = _CLASS[data]
    edge = np.ones(len(data) + 1, bool)
    if len(data):
        edge[1:-1] = kind[1:] != kind[:-1]
        edge[bounds[(bounds > 0) & (bounds < len(data))]] = True
    cuts = np.flatnonzero(edge)
    start, end = cuts[:-1], cuts[1:]
    start, end = start[kind[start] > 0], end[kind[start] > 0]
    hashes = flat.span_hashes(data, start, end)
    row = np.searchsorted(bounds, start, "right") - 1
    pair = flat.mixed(hashes[:-1] * np.uint64(3) + hashes[1:])[row[:-1] == row[1:]]
    every = np.concatenate((hashes, pair)) & np.uint64(BUCKETS - 1)
    return np.concatenate((row, row[:-1][row[:-1] == row[1:]])), every.astype(np.int64)


def fit(target: DataFrame, raw: DataFrame) -> np.ndarray:
    """The logarithm of the ratio of both models for each bucket, from ``text`` of either table.
    Null and empty texts add nothing. All rows count in full."""

    def counts(rows: DataFrame, side: str) -> DataFrame:
        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(BUCKETS, np.int64)
            for batch in batches:
                for _, _, data, bounds in flat.chunks(batch.column("text")):
                    total += np.bincount(gram_buckets(data, bounds)[1], minlength=BUCKETS)
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at])], names=["bucket", "n"])

        return flat.in_small_batches(rows).select("text").mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias(side))

    both = counts(target, "target").join(counts(raw, "raw"), "bucket", "full").na.fill(0).toArrow()  # BUCKETS rows at most
    models = []
    for side in ("target", "raw"):
        n = np.zeros(BUCKETS)
        n[both.column("bucket").to_numpy()] = both.column(side).to_numpy()
        n += SMOOTHING * max(n.mean(), 1 / BUCKETS)
        models.append(np.log(n / n.sum()))
    return models[0] - models[1]


def weigh(docs: DataFrame, ratio: np.ndarray, *, seed: int = 1) -> DataFrame:
    """``doc_id, n_grams, log_weight, key`` for each row of ``docs(doc_id, text)``.

    ``key`` is the weight with Gumbel noise that only depends on the row's id, its text and
    ``seed``: rows that repeat both have one key. A text without grams has weight 0, as likely in
    the target as in the raw texts. ``doc_id`` is a long. Texts of any length count in full, an empty
    table gives an empty result, and other columns are left out.
    """

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last, data, bounds in flat.chunks(batch.column("text")):
                row, bucket = gram_buckets(data, bounds)
                n = np.bincount(row, minlength=last - first)
                weight = np.bincount(row, ratio[bucket], minlength=last - first)
                part = batch.slice(first, last - first)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("noise"), pa.array(n, pa.int64()), pa.array(weight, pa.float64())], names=["doc_id", "noise", "n_grams", "log_weight"])

    noise = (F.shiftrightunsigned(F.xxhash64(F.lit(seed), "doc_id", "text"), 11) + 0.5) / float(2**53)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", (-F.log(-F.log(noise))).alias("noise"))
    rows = flat.in_small_batches(rows).mapInArrow(add, "doc_id long, noise double, n_grams long, log_weight double")
    return rows.select("doc_id", "n_grams", "log_weight", (F.col("log_weight") + F.col("noise")).alias("key"))


def take_largest(keyed: DataFrame, k: int) -> DataFrame:
    """``keyed`` with ``kept``, true for the ``k`` largest keys; of equal ones at the end the
    smallest doc_ids, nulls first. The k-th key is found by counts over ever narrower bins, so the
    rows are neither sorted nor gathered."""
    keyed = stored(keyed, "keys")
    size, low, high = keyed.agg(F.count("*"), F.min("key"), F.max("key")).first()
    if k >= size:
        return keyed.withColumn("kept", F.lit(True))
    if k <= 0:
        return keyed.withColumn("kept", F.lit(False))
    above = 0  # rows with a larger key than high
    while True:
        width = (high - low) / BINS
        between = keyed.filter(F.col("key").between(low, high))
        n = between.count()
        if n <= LAST_KEYS or width == 0 or low + width == low:
            break
        place = F.least(F.floor((F.col("key") - low) / width), F.lit(BINS - 1))
        bins = between.groupBy(place.alias("bin")).agg(F.count("*").alias("n"), F.min("key").alias("low"), F.max("key").alias("high")).orderBy(F.desc("bin")).collect()  # BINS rows
        for b in bins:
            if above + b["n"] >= k:
                if (b["low"], b["high"]) == (low, high):
                    return _cut(keyed, low, k - above)  # neighbours in floating point
                low, high = b["low"], b["high"]
                break
            above += b["n"]
    if low == high:
        return _cut(keyed, low, k - above)
    last = [r[0] for r in between.select("key").orderBy(F.desc("key")).limit(LAST_KEYS).collect()]
    cut = last[k - above - 1]
    return _cut(keyed, cut, k - above - sum(x > cut for x in last))


def _cut(keyed: DataFrame, cut: float, ties: int) -> DataFrame:
    """Keep what is above ``cut`` and so many rows that equal it."""
    level = keyed.filter(F.col("key") == cut)
    if level.count() == ties:
        return keyed.withColumn("kept", F.col("key") >= cut)
    rest = keyed.filter(F.col("key") != cut).withColumn("kept", F.col("key") > cut)
    level = stored(level.withColumn("_row", F.monotonically_increasing_id()), "level")
    if level.select("doc_id").distinct().limit(2).count() > 1:  # a chance of 2**-53 for two rows
        ordered = level.drop("_row").orderBy(F.col("doc_id").asc_nulls_first())
        return rest.union(ordered.limit(ties).withColumn("kept", F.lit(True))).union(ordered.offset(ties).withColumn("kept", F.lit(False)))
    # else one row that is repeated, maybe very often: as many of it as are wanted are the first by number
    below = ties
    for task, n in sorted(map(tuple, level.groupBy(F.shiftright("_row", 33)).count().collect())):  # a row for each task
        if below <= n:
            break
        below -= n
    chosen = level.withColumn("kept", F.col("_row") < (task << 33) + below)
    return rest.unionByName(chosen.drop("_row"))


def resample(docs: DataFrame, labels: DataFrame, *, share: float, seed: int = 1) -> DataFrame:
    """``doc_id, n_grams, log_weight, key, kept``: ``share`` of the rows drawn towards the documents
    that ``labels(doc_id, quality)`` calls good. Without such labels all weights are about equal."""
    good = labels.filter("quality = 1 and doc_id is not null").select("doc_id").distinct()
    good = good.orderBy(F.xxhash64("doc_id"), "doc_id").limit(TARGET_ROWS)
    target = docs.join(F.broadcast(good), "doc_id", "left_semi")
    keyed = weigh(docs, fit(target, docs), seed=seed)
    return take_largest(keyed, round(share * docs.count()))
