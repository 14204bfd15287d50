"""Passages that occur more than once, by prefix-partitioned suffix trees, and texts without them.

A window of words is a path from the root of the suffix tree of all texts; two windows that are
equal end in one internal node of that depth. The tree is never held whole. A window's path is read
from its anchor, the least of the hashes of its short word runs, so equal windows share their anchor
and where it stands, and neighbouring windows mostly have one anchor in common: they travel as one
record. Records are dealt out by the prefix of their paths, the anchor's words. A prefix that too
many records share is lengthened, to the right for windows that lie right of the anchor and to the
left for the others; a lengthened one that is still frequent is spread over several groups. So groups
fit into memory. In each group the paths are sorted, and a node of full depth with several leaves is
a repeat. Groups that were spread or outgrew a task exchange their nodes in the end.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barwright.llm import flat
from barwright.scratch import stored

#: Words of a window, of a prefix, and of a lengthened one: half of the window and of the prefix.
WINDOW, PREFIX = 35, 8
LONGER = (WINDOW + PREFIX + 1) // 2
#: Records a task sorts together; what a group has beyond that is sorted apart and joined by nodes.
GROUP_RECORDS = 1 << 15
#: Counters for frequent prefixes per task. A prefix counts as frequent above a share of the records of
#: one over this, so at most three times this many are known to every task: a record has one of the
#: short prefixes and at most two of the lengthened ones.
COUNTERS = 4096
#: Records below which no prefix counts as frequent.
FEW_RECORDS = 1000

_RECORD = "doc_id {id}, print bigint, key bigint, salt int, at int, lead int, hashes array<bigint>"
_FOUND = "doc_id {id}, print bigint, first int, last int, node_a bigint, node_b bigint"


def without_repeats(docs: DataFrame, *, window: int = WINDOW, with_text: bool = False) -> DataFrame:
    """``doc_id, n_words, n_removed, kept_sha256`` for each row of ``docs(doc_id, text)``, with ``text``
    what is left of it if ``with_text``.

    A word goes if it stands in a window of ``window`` words, of one row's text, that also starts at
    another place of any row; windows are those of the input, not of what is left. What is left is
    joined by single spaces. A null or empty text has no words; one shorter than a window loses none.
    Rows that repeat each other lose every window; rows and null ids stay, other columns are left out,
    and an empty table gives an empty result. Texts may have any length.
    """
    found = repeated_windows(docs, window=window)
    spans = found.groupBy("doc_id", "print").agg(F.collect_list(F.struct("first", "last")).alias("spans"))
    spans = spans.withColumnsRenamed({"doc_id": "d", "print": "p"})
    rows = flat.in_small_batches(docs.select("doc_id", "text", F.xxhash64("text").alias("print")))
    joined = rows.join(spans, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("print") == F.col("p")), "left")
    schema = f"doc_id {_kind(docs)}, n_words bigint, n_removed bigint, kept_sha256 string" + ", text string" * with_text
    return joined.select("doc_id", "text", "spans").mapInArrow(_cutter(window, with_text), schema)


def repeated_windows(docs: DataFrame, *, window: int = WINDOW) -> DataFrame:
    """``doc_id, print, first, last``: the places of windows that occur more than once, as runs of
    starts, counted in words from 0. ``print`` is a hash of the text. Runs of a row are disjoint;
    rows that are equal in both columns share theirs."""
    rows = flat.in_small_batches(docs.select("doc_id", "text", F.xxhash64("text").alias("print")))
    frequent = _frequent(rows, window)
    records = rows.mapInArrow(_recorder(window, frequent), _RECORD.format(id=_kind(docs)))
    dealt = records.repartition("key", "salt").sortWithinPartitions("key", "salt")
    found = stored(dealt.mapInArrow(_subtrees, _FOUND.format(id=_kind(docs))), "repeats")
    here = found.filter("first is not null and node_a is null")
    # nodes of spread groups: one row for each part of a group that has the node, with the leaf if it
    # has no other one there
    parts = found.filter("node_a is not null").withColumn("n", F.count("*").over(Window.partitionBy("node_a", "node_b")))
    across = parts.filter("n > 1 and first is not null")
    columns = ["doc_id", "print", "first", "last"]
    return here.select(columns).union(across.select(columns))


def _kind(docs: DataFrame) -> str:
    return docs.schema["doc_id"].dataType.simpleString()


def _frequent(rows: DataFrame, window: int) -> dict[int, int]:
    """Frequent prefixes, and over how many groups each is spread.

    Each task counts with a bounded set of counters that misses no prefix above a share of its
    records; the sum of all tasks' counts then misses none above twice that share.
    """
    counts = stored(rows.select("text").mapInArrow(_counter(window), "key bigint, n bigint"), "prefixes")
    records = counts.filter("key is null").agg(F.sum("n")).first()[0] or 0
    least = max(FEW_RECORDS, records / COUNTERS)
    often = counts.filter("key is not null").groupBy("key").agg(F.sum("n").alias("n")).filter(F.col("n") > least)
    return {r["key"]: int(r["n"] / least) + 1 for r in often.toLocalIterator()}


def _windows(word_hash: np.ndarray, size: int) -> np.ndarray:
    """A hash of the ``size`` words from each place on."""
    out = np.zeros(max(len(word_hash) - size + 1, 0), np.uint64)
    for k in range(size):
        out += word_hash[k : k + len(out)] * flat._PLACE[k]
    return flat.mixed(out)


def _paths(column: pa.Array, window: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For each chunk of texts: its first row, the hashes of its words, how many words come before each
    text, the places where windows start, and the anchor of each."""
    prefix = min(PREFIX, window)
    for first, _, data, bounds in flat.chunks(column):
        start, end, upto = flat.words(data, bounds)
        word_hash = flat.span_hashes(data, start, end)
        if len(word_hash) < window:
            continue
        inside = np.ones(len(word_hash) - window + 1, bool)
        for edge in upto[1:-1]:
            inside[max(edge - window + 1, 0) : edge] = False
        # the leftmost of the least, in steps that double what they look at
        least = (_windows(word_hash, prefix) >> np.uint64(32) << np.uint64(32)) | np.arange(len(word_hash) - prefix + 1, dtype=np.uint64)
        wide, want = 1, window - prefix + 1
        while wide < want:
            step = min(wide, want - wide)
            least = np.minimum(least[: len(least) - step], least[step:])
            wide += step
        anchor = (least & np.uint64(0xFFFFFFFF)).astype(np.int64)
        at = np.flatnonzero(inside)
        yield first, word_hash, upto, at, anchor[at]


def _sides(word_hash: np.ndarray, window: int) -> tuple[np.ndarray, int]:
    """Hashes of lengthened prefixes, and how far left of the anchor one begins that goes to the left."""
    longer = (window + min(PREFIX, window) + 1) // 2
    return _windows(word_hash, longer), longer - min(PREFIX, window)


def _lengthened(longer: np.ndarray, anchor: np.ndarray, left: np.ndarray, back: int) -> np.ndarray:
    """The key of the lengthened prefix of each anchor: to the left, or to the right."""
    place = np.where(left, anchor - back, anchor)
    return flat.mixed(longer[np.clip(place, 0, len(longer) - 1)] + flat._PLACE[60] * left.astype(np.uint64))


def _runs(*columns: np.ndarray) -> np.ndarray:
    """Where a row differs from the one before it in any column."""
    new = np.ones(len(columns[0]), bool)
    if len(new):
        new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
    return np.flatnonzero(new)


def _counter(window: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts, records, waiting = np.zeros(0, np.uint64), np.zeros(0, np.int64), 0, []

        def merge() -> tuple[np.ndarray, np.ndarray]:
            every, where = np.unique(np.concatenate([keys, *waiting]), return_inverse=True)
            sums = np.bincount(where[len(keys) :], minlength=len(every))
            np.add.at(sums, where[: len(keys)], counts)
            if len(every) > COUNTERS:  # all counters go down by the largest one that has no place
                sums = sums - np.partition(sums, len(sums) - COUNTERS - 1)[len(sums) - COUNTERS - 1]
            return every[sums > 0], sums[sums > 0]

        for batch in batches:
            for _, word_hash, upto, at, anchor in _paths(batch.column(0), window):
                short = _windows(word_hash, min(PREFIX, window))
                longer, back = _sides(word_hash, window)
                left = anchor - at >= back
                text = np.searchsorted(upto, at, "right")
                runs = _runs(anchor, text)
                halves = _runs(anchor, text, left)
                waiting += [short[anchor[runs]], _lengthened(longer, anchor[halves], left[halves], back)]
                records += len(runs)
                if sum(map(len, waiting)) > 16 * COUNTERS:
                    keys, counts = merge()
                    waiting = []
        keys, counts = merge()
        yield pa.record_batch({"key": pa.array([*keys.view(np.int64).tolist(), None], pa.int64()), "n": pa.array([*counts.tolist(), records], pa.int64())})

    return run


def _recorder(window: int, frequent: dict[int, int]) -> Callable:
    """One record for each run of windows of a text that have the same prefix: the prefix, where the
    first window starts and how far its anchor is from there, and the hashes of all of them."""
    known = np.array(sorted(frequent), np.int64)
    spread = np.array([frequent[k] for k in sorted(frequent)], np.int64)

    def groups_of(keys: np.ndarray) -> np.ndarray:
        """Over how many groups a frequent prefix is spread, 0 for one that is not frequent."""
        if not len(known):
            return np.zeros(len(keys), np.int64)
        at = np.minimum(np.searchsorted(known, keys.view(np.int64)), len(known) - 1)
        return np.where(known[at] == keys.view(np.int64), spread[at], 0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = 0
        for batch in batches:
            ids, prints = batch.column(0), batch.column(2)
            for first, word_hash, upto, at, anchor in _paths(batch.column(1), window):
                if not len(at):
                    continue
                key = _windows(word_hash, min(PREFIX, window))[anchor]
                longer, back = _sides(word_hash, window)
                often = groups_of(key) > 0
                left = often & (anchor - at >= back)
                key[often] = _lengthened(longer, anchor[often], left[often], back)
                text = np.searchsorted(upto, at, "right") - 1
                runs = _runs(anchor, text, left)
                row = pa.array(first + text[runs])
                groups = np.where(often[runs], groups_of(key[runs]), 0)
                # rows are spread by their number too: very many may be equal
                seen = prints.take(row).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
                drawn = flat.mixed(seen + (rows + first + text[runs]).astype(np.uint64) * flat._PLACE[59])
                salt = np.where(groups > 1, 1 + (drawn % np.maximum(groups, 1).astype(np.uint64)).astype(np.int64), 0)
                hashes = _windows(word_hash, window)[at].view(np.int64)
                yield pa.record_batch(
                    {
                        "doc_id": ids.take(row),
                        "print": prints.take(row),
                        "key": pa.array(key[runs].view(np.int64)),
                        "salt": pa.array(salt.astype(np.int32)),
                        "at": pa.array((at - upto[text])[runs].astype(np.int32)),
                        "lead": pa.array((anchor - at)[runs].astype(np.int32)),
                        "hashes": pa.ListArray.from_arrays(pa.array(np.append(runs, len(at)).astype(np.int32)), pa.array(hashes)),
                    }
                )
            rows += batch.num_rows

    return run


def _subtrees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Repeated windows within groups of records, which come sorted by group.

    Only what is open at the end of a batch is kept for the next one. A group of more than
    GROUP_RECORDS is taken in parts.
    """
    kept, parted = [], None
    for batch in batches:
        kept.append(batch)
        if sum(b.num_rows for b in kept) < GROUP_RECORDS:
            continue
        table = pa.Table.from_batches(kept).combine_chunks()
        keys, salts = table["key"].to_numpy(), table["salt"].to_numpy()
        last = int(_runs(keys, salts)[-1])
        if table.num_rows - last >= GROUP_RECORDS:
            yield from _repeats(table, parted, (keys[-1], salts[-1]))
            kept, parted = [], (keys[-1], salts[-1])
        else:
            yield from _repeats(table.slice(0, last), parted, None)
            kept = table.slice(last).combine_chunks().to_batches()
            parted = parted if parted == (keys[-1], salts[-1]) else None
    if kept:
        yield from _repeats(pa.Table.from_batches(kept).combine_chunks(), parted, None)


def _repeats(table: pa.Table, *parted: tuple[int, int] | None) -> Iterator[pa.RecordBatch]:
    """Runs of windows that have equals in ``table``, and the nodes of spread or parted groups."""
    if not table.num_rows:
        return
    lists = table["hashes"].combine_chunks()
    lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
    size = np.diff(lists.offsets.to_numpy())
    hashes = lists.flatten().to_numpy().view(np.uint64)
    key, salt = table["key"].to_numpy(), table["salt"].to_numpy()
    record = np.repeat(np.arange(len(size)), size)
    within = np.arange(len(hashes)) - np.repeat(np.cumsum(size) - size, size)
    lead = table["lead"].to_numpy()[record] - within
    # sorted by path: the prefix, where it stands in the window, and the window's words
    leaf = flat.mixed(hashes + lead.astype(np.uint64) * flat._PLACE[61])
    path = flat.mixed(leaf + key.view(np.uint64)[record] * flat._PLACE[62])
    order = np.argsort(path, kind="stable")
    same = (path[order][1:] == path[order][:-1]) & (leaf[order][1:] == leaf[order][:-1]) & (key[record[order]][1:] == key[record[order]][:-1])
    repeated = np.zeros(len(path), bool)
    repeated[order[1:][same]] = True
    later = repeated.copy()  # leaves of a node but for its first
    repeated[order[:-1][same]] = True

    opened = salt > 0
    for part in parted:
        if part is not None:
            opened |= (key == part[0]) & (salt == part[1])
    runs = _runs(repeated, record)
    ends = np.append(runs[1:], len(path)) - 1
    hit = repeated[runs]
    yield _found(table, record[runs[hit]], within[runs[hit]], within[ends[hit]], None, None)
    open_leaf = np.flatnonzero(opened[record] & ~later)
    if len(open_leaf):
        alone = ~repeated[open_leaf]
        yield _found(table, record[open_leaf], np.where(alone, within[open_leaf], -1), within[open_leaf], key[record[open_leaf]], leaf[open_leaf].view(np.int64))


def _found(table: pa.Table, record: np.ndarray, first: np.ndarray, last: np.ndarray, node_a: np.ndarray | None, node_b: np.ndarray | None) -> pa.RecordBatch:
    at, row = table["at"].to_numpy()[record], pa.array(record)
    nothing = pa.nulls(len(record), pa.int64())
    known = first >= 0
    columns = {
        "doc_id": table["doc_id"].combine_chunks().take(row),
        "print": table["print"].combine_chunks().take(row),
        "first": pa.array((at + first).astype(np.int32), mask=~known),
        "last": pa.array((at + last).astype(np.int32), mask=~known),
        "node_a": nothing if node_a is None else pa.array(node_a),
        "node_b": nothing if node_b is None else pa.array(node_b),
    }
    return pa.RecordBatch.from_arrays([c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in columns.values()], list(columns))


def _cutter(window: int, with_text: bool) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, removed, digests, texts = [], [], [], []
            for text, spans in zip(batch.column(1), batch.column(2), strict=True):
                words = (text.as_py() or "").encode().split()  # bytes split at the six ASCII spaces
                sizes.append(len(words))
                if spans.is_valid:
                    first, last = (np.asarray(spans.values.field(k)) for k in (0, 1))
                    change = np.zeros(len(words) + 1, np.int64)
                    np.add.at(change, first, 1)
                    np.add.at(change, last + window, -1)
                    words = [words[k] for k in np.flatnonzero(np.cumsum(change[:-1]) == 0)]
                removed.append(sizes[-1] - len(words))
                left = b" ".join(words)
                digests.append(hashlib.sha256(left).hexdigest())
                texts.append(left.decode() if with_text else "")
            columns = {"doc_id": batch.column(0), "n_words": pa.array(sizes, pa.int64()), "n_removed": pa.array(removed, pa.int64()), "kept_sha256": pa.array(digests, pa.string())}
            yield pa.record_batch(columns | ({"text": pa.array(texts, pa.string())} if with_text else {}))

    return run
