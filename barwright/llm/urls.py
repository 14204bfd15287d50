"""URL filter: rules first, then a ratio of character language models.

Rules judge what they fit. The URLs that they accept and reject train one model each, a smoothed
Markov model of variable order over characters, and the difference of both log-likelihoods by
length judges the rest, against a threshold calibrated on ruled URLs that were held back.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barwright.llm import flat
from barwright.scratch import discard, stored

#: ``(verdict, rule)``: host, a slash and the path that it begins with.
RULES = [("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/")]
#: Bytes of context at most, and the distinct n-grams of that size up to which the counts are sent
#: around. More of them stay a table, and each block of about 2 ** BLOCK URLs is joined to what it needs.
CONTEXT, GATHERED, BLOCK = 5, 1 << 18, 12
#: Weight of the shorter context's estimate, as a number of observations.
PRIOR = 2.0
#: Of the ruled URLs one in HELD_BACK calibrates; bins of score for that, from -SPAN to SPAN.
HELD_BACK, BINS, SPAN = 5, 800, 4.0

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_KINDS = ("allow", "block")
#: An n-gram is a number: CONTEXT + 1 places of BITS, the last byte in the highest, each a byte plus 1
#: or 0 where there is none. Its context is the number without the highest place.
_BITS = 9
_CONTEXT_MASK = (1 << _BITS * CONTEXT) - 1


def split_url(url: Column) -> tuple[Column, Column]:
    """Host, A-Z lower-cased, and path; both empty for null and without ``://``."""
    form = r"(?s)\A.*?://([^/?#]*)([^?#]*)"
    host, path = (F.coalesce(F.regexp_extract(url, form, k), F.lit("")) for k in (1, 2))
    return F.translate(host, _UPPER, _UPPER.lower()), path


def ruled(pages: DataFrame, rules: list[tuple[str, str]] = RULES) -> DataFrame:
    """``pages`` with ``host``, ``path``, ``rule`` and ``ruling``, the verdict of the longest rule that
    fits the host or a domain above it and the begin of the path; null where none fits."""
    host, path = split_url(F.col("url"))
    pages = pages.withColumns({"host": host, "path": path})
    rule = ruling = F.lit(None).cast("string")
    for verdict, text in sorted(rules, key=lambda r: len(r[1])):
        domain, slash, begin = text.partition("/")
        fits = ((F.col("host") == domain) | F.col("host").endswith("." + domain)) & F.col("path").startswith(slash + begin)
        rule, ruling = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(verdict)).otherwise(ruling)
    return pages.withColumns({"rule": rule, "ruling": ruling})


def judge_urls(pages: DataFrame, rules: list[tuple[str, str]] = RULES) -> DataFrame:
    """``page_id, host, path, rule, verdict, score`` for each row of ``pages(page_id, url)``.

    ``verdict`` is the rule's, else allow if ``score``, the difference of log-likelihoods per
    character of host and path, reaches the calibrated threshold. A URL without host and path scores
    0. If the rules do not both accept and reject URLs there is nothing to compare, and all other
    URLs score 0 and are allowed. Repeated rows and null page_ids stay; other columns are left out.
    """
    pages = ruled(pages.select("page_id", "url"), rules).withColumn("told", F.concat("host", "path"))
    held = F.pmod(F.xxhash64("url"), F.lit(HELD_BACK)) == 0
    taught = pages.filter("ruling is not null")
    model = _fit(taught.filter(~held))
    scored = _score(pages, model)
    limit = _threshold(_score(taught.filter(held), model)) if model is not None else 0.0
    verdict = F.coalesce("ruling", F.when(F.col("score") >= limit, F.lit("allow")).otherwise(F.lit("block")))
    return scored.select("page_id", "host", "path", "rule", verdict.alias("verdict"), "score")


def _grams(data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """The n-gram of CONTEXT + 1 bytes that ends at each place, shorter where the text begins."""
    depth = np.arange(len(data)) - np.repeat(bounds[:-1], np.diff(bounds))
    value = data.astype(np.int64) + 1
    grams = value << _BITS * CONTEXT
    for size in range(1, CONTEXT + 1):
        at = np.flatnonzero(depth >= size)
        grams[at] |= value[at - size] << _BITS * (CONTEXT - size)
    return grams


def _orders(grams: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each length of context ``(place, context, it with the next byte)``, over the n-grams that
    have so much context. The numbers are exact: no two of these share one."""
    for size in range(CONTEXT + 1):
        cut = _BITS * (CONTEXT - size)
        at = np.flatnonzero((grams >> cut) & ((1 << _BITS) - 1))
        both = grams[at] >> cut << cut
        yield at, both & _CONTEXT_MASK, both


def _places(data: np.ndarray, bounds: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """:func:`_orders` of the places of texts."""
    return _orders(_grams(data, bounds))


def _every_key(grams: np.ndarray) -> np.ndarray:
    """The distinct contexts and n-grams of all lengths that ``grams`` hold."""
    return np.unique(np.concatenate([np.unique(x) for _, context, both in _orders(grams) for x in (context, both)]))


@dataclass
class _Counts:
    """Exact counts ``number[kind]`` of sorted ``keys``, contexts and n-grams of all lengths."""

    keys: np.ndarray
    number: np.ndarray

    def __getitem__(self, which: tuple) -> np.ndarray:
        """``[kind, 0, context]`` or ``[kind, 1, n-gram]``; 0 of what was never seen."""
        kind, _, key = which
        if not len(self.keys):
            return np.zeros(np.shape(key), np.int64)
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.number[kind][at], 0)


def _summed(grams: np.ndarray, number: np.ndarray) -> _Counts:
    """Counts of all lengths from those of the longest n-grams."""
    found = [(key, number[:, at]) for at, context, both in _orders(grams) for key in (context, both)]
    keys, place = np.unique(np.concatenate([key for key, _ in found]), return_inverse=True)
    n = np.concatenate([n for _, n in found], axis=1)
    return _Counts(keys, np.array([np.bincount(place, of, minlength=len(keys)) for of in n]).astype(np.int64))


def _fit(taught: DataFrame) -> _Counts | DataFrame | None:
    """Counts of both kinds, where GATHERED bounds them, else a table ``key, allow, block`` of them;
    None without examples of both kinds."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kind = np.array([_KINDS.index(r) for r in batch.column("ruling").to_pylist()])
            for first, last, data, bounds in flat.chunks(batch.column("told")):
                of = np.repeat(kind[first:last], np.diff(bounds))
                grams, place = np.unique(_grams(data, bounds), return_inverse=True)
                n = [np.bincount(place[of == k], minlength=len(grams)) for k in (0, 1)]
                yield pa.RecordBatch.from_arrays([pa.array(grams, pa.int64()), *(pa.array(x, pa.int64()) for x in n)], names=["key", *_KINDS])

    def both_summed(rows: DataFrame) -> DataFrame:
        return rows.groupBy("key").agg(*[F.sum(kind).alias(kind) for kind in _KINDS])

    schema = "key long, " + ", ".join(f"{kind} long" for kind in _KINDS)
    grams = stored(both_summed(taught.select("ruling", "told").mapInArrow(count, schema)), "url-grams")
    size, *examples = grams.agg(F.count("*"), *[F.coalesce(F.sum(kind), F.lit(0)) for kind in _KINDS]).first()
    if not all(examples):
        return None
    if size <= GATHERED:
        held = grams.toArrow()  # GATHERED rows at most
        discard(grams)
        return _summed(held.column("key").to_numpy(), np.stack([held.column(kind).to_numpy() for kind in _KINDS]))

    def shorter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                counts = _summed(batch.column("key").to_numpy(), np.stack([batch.column(kind).to_numpy() for kind in _KINDS]))
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (counts.keys, *counts.number)], names=["key", *_KINDS])

    model = stored(both_summed(grams.mapInArrow(shorter, schema)), "url-model")
    discard(grams)
    return model


def _scores(told: pa.Array, counts: _Counts) -> pa.Array:
    values = [np.zeros(0)]
    for first, last, data, bounds in flat.chunks(told):
        grams, place = np.unique(_grams(data, bounds), return_inverse=True)
        chance = np.full((2, len(grams)), 1 / 256)
        for at, context, both in _orders(grams):
            # a context never seen leaves the estimate of the shorter one as it is
            for k in (0, 1):
                chance[k, at] = (counts[k, 1, both] + PRIOR * chance[k, at]) / (counts[k, 0, context] + PRIOR)
        row = np.repeat(np.arange(last - first), np.diff(bounds))
        total = np.bincount(row, (np.log(chance[0]) - np.log(chance[1]))[place], minlength=last - first)
        values.append(total / np.maximum(np.diff(bounds), 1))
    return pa.array(np.concatenate(values), pa.float64())


def _score(pages: DataFrame, model: _Counts | DataFrame | None) -> DataFrame:
    if model is None:
        return pages.withColumn("score", F.lit(0.0))
    columns = pages.select("page_id", "host", "path", "rule", "ruling", "told")
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in columns.schema) + ", score double"
    if isinstance(model, DataFrame):
        return _score_joined(columns, model, schema)
    shared = pages.sparkSession.sparkContext.broadcast(model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.append_column("score", _scores(batch.column("told"), shared.value))

    return columns.mapInArrow(score, schema)


def _score_joined(columns: DataFrame, model: DataFrame, schema: str) -> DataFrame:
    """Scores against a model of any size: each block of URLs asks for the counts of its own n-grams."""
    blocks = stored(columns.withColumn("_block", F.shiftright(F.monotonically_increasing_id(), BLOCK)), "url-blocks")

    def needed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            block = batch.column("_block").to_numpy()
            for first, last, data, bounds in flat.chunks(batch.column("told")):
                of = np.repeat(block[first:last], np.diff(bounds))
                grams = _grams(data, bounds)
                for b in np.unique(of):
                    keys = _every_key(np.unique(grams[of == b]))
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), b)), pa.array(keys)], names=["_block", "key"])

    def score(mine: pa.Table, counts: pa.Table) -> pa.Table:
        counts = counts.sort_by("key")
        held = _Counts(counts.column("key").to_numpy(), np.stack([counts.column(kind).to_numpy() for kind in _KINDS]))
        told = mine.column("told").combine_chunks()
        return mine.drop_columns("_block").append_column("score", _scores(told, held))

    keys = blocks.select("_block", "told").mapInArrow(needed, "_block long, key long").distinct()
    counts = keys.join(model, "key").select("_block", "key", *_KINDS)
    return blocks.groupBy("_block").cogroup(counts.groupBy("_block")).applyInArrow(score, schema)


def _threshold(held: DataFrame) -> float:
    """The edge of a bin at which the mean of both kinds' correct shares is largest; of equal ones
    the one nearest to 0."""
    place = F.least(F.greatest(F.floor((F.col("score") + SPAN) * BINS / (2 * SPAN)), F.lit(0)), F.lit(BINS - 1))
    n = np.zeros((2, BINS))
    for r in held.groupBy("ruling", place.alias("bin")).count().collect():  # 2 * BINS rows at most
        n[_KINDS.index(r["ruling"]), r["bin"]] = r["count"]
    share = n / np.maximum(n.sum(axis=1, keepdims=True), 1)
    allowed = np.concatenate((share[0][::-1].cumsum()[::-1], [0]))
    blocked = np.concatenate(([0], share[1].cumsum()))
    edges = np.arange(BINS + 1) * 2 * SPAN / BINS - SPAN
    right = np.round(allowed + blocked, 9)
    best = np.flatnonzero(right == right.max())
    return float(edges[best[np.argmin(np.abs(edges[best]))]])
