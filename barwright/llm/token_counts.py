"""Token counts of sections by the places of tokens in the whole document.

A document is encoded once; the bytes of its tokens place them in the text, and each token goes to a
section by where it lies. Encoding sections apart would give other tokens at their edges.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barwright.llm import flat

#: Where a token that crosses the end of a section counts: where its first or its last character
#: lies, or where most of them lie (the first of equals).
RULES = ("first", "last", "most")
SECTIONS = "array<struct<name:string,start:int,end:int>>"


def lines(text: Column) -> Column:
    """Each line of a text with its line break as a section, named by number from 0."""
    state = F.struct(F.lit(0).alias("at"), F.array().cast(SECTIONS).alias("found"))
    parts = F.split(F.coalesce(text, F.lit("")), r"(?<=\n)", -1)

    def add(seen: Column, part: Column) -> Column:
        end = seen["at"] + F.length(part)
        section = F.struct(F.size(seen["found"]).cast("string").alias("name"), seen["at"].alias("start"), end.alias("end"))
        return F.struct(end.alias("at"), F.concat(seen["found"], F.array(section)).alias("found"))

    return F.aggregate(F.filter(parts, lambda p: p != ""), state, add, lambda s: s["found"])


def count_tokens(docs: DataFrame, ranks: str, pattern: str, *, rule: str = "first", sections: str | None = None) -> DataFrame:
    """``doc_id, n_tokens, n_crossing, n_outside, sections`` for each row of ``docs(doc_id, text)``.

    ``sections`` names a column of sections, code points from 0 with end exclusive, sorted and not
    overlapping; without it they are the lines. The result's ``sections`` adds ``n_tokens`` to each.
    A token in no section counts as outside. ``n_crossing`` are the tokens that reach beyond the
    section they count for; with the tokens outside, all sections' sums are ``n_tokens``. A null or
    empty text has no tokens; null sections are none. Repeated rows and null doc_ids stay, other
    columns are left out; an empty table gives an empty result. ``doc_id`` is a long.
    """
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")

    def attribute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _coder(ranks, pattern)
        for batch in batches:
            for first in range(0, len(batch), 256):
                part = batch.slice(first, 256)
                given = part.column("sections").to_pylist() if sections else [None] * len(part)
                yield _rows(part.column("doc_id"), [_counted(coder, t or "", s, sections is None, rule) for t, s in zip(part.column("text").to_pylist(), given, strict=True)])

    columns = ["doc_id", "text"] + ([F.col(sections).alias("sections")] if sections else [])
    return flat.in_small_batches(docs).select(*columns).mapInArrow(attribute, f"doc_id long, n_tokens long, n_crossing long, n_outside long, sections {_COUNTED}")


_COUNTED = "array<struct<name:string,start:int,end:int,n_tokens:long>>"


@lru_cache(maxsize=2)
def _coder(ranks: str, pattern: str):
    import tiktoken

    with open(ranks, "rb") as file:
        known = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    size = np.zeros(max(known.values()) + 1, np.int64)
    for token, k in known.items():
        size[k] = len(token)
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=known, special_tokens={}), size


def _counted(coder, text: str, given: list[dict] | None, by_line: bool, rule: str):
    encoding, size = coder
    ids = np.array(encoding.encode_ordinary(text), np.int64)
    data = np.frombuffer(text.encode("utf-8"), np.uint8)
    # code points that begin before each byte: a token's first and last character
    begun = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))
    end = np.cumsum(size[ids])
    start = end - size[ids]
    first, last = begun[np.minimum(start + 1, len(data))] - 1, begun[end] - 1
    if by_line:
        code_start = np.flatnonzero((data & 0xC0) != 0x80)
        breaks = np.searchsorted(code_start, np.flatnonzero(data == 10)) + 1
        edges = np.unique(np.concatenate(([0], breaks, [len(code_start)])))
        starts, ends, names = edges[:-1], edges[1:], [str(k) for k in range(len(edges) - 1)]
    else:
        given = given or []
        starts, ends = np.array([s["start"] for s in given], np.int64), np.array([s["end"] for s in given], np.int64)
        names = [s["name"] for s in given]
    n = len(starts)
    if not n or not len(ids):
        return len(ids), 0, 0 if not len(ids) else len(ids), names, starts, ends, np.zeros(n, np.int64)
    of_first, of_last = (_section(starts, ends, x) for x in (first, last))
    if rule == "first":
        own = of_first
    elif rule == "last":
        own = of_last
    else:
        # the middle character of a token over two sections lies in the one with more of it
        own = _section(starts, ends, first + (last - first) // 2)
    inside = own >= 0
    crossing = inside & ((first < starts[own]) | (last >= ends[own]))
    return len(ids), int(crossing.sum()), int((~inside).sum()), names, starts, ends, np.bincount(own[inside], minlength=n)


def _section(starts: np.ndarray, ends: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Which section holds a place, or -1."""
    k = np.searchsorted(starts, at, "right") - 1
    return np.where((k >= 0) & (at < ends[k]), k, -1)


def _rows(ids: pa.Array, rows: list[tuple]) -> pa.RecordBatch:
    cuts = np.concatenate(([0], np.cumsum([len(r[3]) for r in rows]))).astype(np.int32)
    each = pa.StructArray.from_arrays(
        [
            pa.array([name for r in rows for name in r[3]], pa.string()),
            *(pa.array(np.concatenate([r[k] for r in rows]), pa.int32()) for k in (4, 5)),
            pa.array(np.concatenate([r[6] for r in rows]), pa.int64()),
        ],
        names=["name", "start", "end", "n_tokens"],
    )
    return pa.RecordBatch.from_arrays(
        [ids.cast(pa.int64()), *(pa.array([r[k] for r in rows], pa.int64()) for k in (0, 1, 2)), pa.ListArray.from_arrays(pa.array(cuts), each)],
        names=["doc_id", "n_tokens", "n_crossing", "n_outside", "sections"],
    )
