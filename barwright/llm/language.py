"""Language identification by rank-order profiles.

A language's profile ranks the n-grams of its texts by frequency. A document's own most frequent
n-grams are ranked alike, and the language with the smallest sum of rank differences, the
out-of-place distance, is taken.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from barwright.llm import flat

#: Letters of the longest n-grams and how many of them a profile and a document rank.
LONGEST, RANKED = 3, 300
UNDETERMINED = "und"
#: Languages that a set of profiles may hold, which bounds what is sent to every executor: more
#: than ISO 639-3 has codes. Beyond it fitting stops with an error.
MOST_LANGUAGES = 10_000
#: Distinct n-grams a task counts before it hands its counts on.
HELD_GRAMS = 1 << 20
#: Code points of text handled at a time.
CHUNK = 1 << 18

_BITS = np.int64(21)


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """For each code point its lower case if it is a letter, else a space."""
    table = np.full(0x110000, 32, np.uint32)
    for k in range(0x110000):
        c = chr(k)
        if c.isalpha():
            low = c.lower()
            table[k] = ord(low) if len(low) == 1 else k
    return table


def gram_counts(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``(row, gram, count)`` sorted by row, and for each row whether it has a letter.

    Everything but letters counts as a space, words are padded by spaces, and n-grams of spaces
    only, or with a space inside, are left out. A gram is its code points, 21 bits each.
    """
    encoded = [(" " + t + " ").encode("utf-32-le", "surrogatepass") for t in texts]
    code = _letters()[np.frombuffer(b"".join(encoded), np.uint32)]
    row = np.repeat(np.arange(len(texts)), [len(e) // 4 for e in encoded])
    has_letter = np.bincount(row[code != 32], minlength=len(texts)) > 0
    present = np.flatnonzero(np.bincount(code))  # few, so that row and gram fit one number
    base = len(present) + 1
    if len(texts) > 1 and len(texts) * base**3 >= 2**63:
        half = len(texts) // 2
        first, second = gram_counts(texts[:half]), gram_counts(texts[half:])
        return (np.concatenate((first[0], second[0] + half)), *(np.concatenate(x) for x in zip(first[1:], second[1:], strict=True)))
    place = np.zeros(int(code.max(initial=0)) + 1, np.int64)
    place[present] = np.arange(1, base)
    digit, letter = place[code], code != 32
    pair = digit[:-1] * base + digit[1:]
    together, either = row[:-1] == row[1:], letter[:-1] | letter[1:]
    one = (row * base**3 + digit)[letter]
    two = (row[:-1] * base**3 + pair)[together & either]
    three = (row[:-2] * base**3 + pair[:-1] * base + digit[2:])[together[:-1] & together[1:] & letter[1:-1]]
    key = np.sort(np.concatenate((one, two, three)))
    new = np.ones(len(key), bool)
    new[1:] = key[1:] != key[:-1]
    at = np.flatnonzero(new)
    row, gram = np.divmod(key[at], base**3)
    whole = np.concatenate(([0], present)).astype(np.int64)
    gram = (whole[gram // base**2] << (2 * _BITS)) | (whole[gram // base % base] << _BITS) | whole[gram % base]
    return row, gram, np.diff(np.append(at, len(key))), has_letter


def fit_profiles(labelled: DataFrame) -> DataFrame:
    """``lang, gram, rank`` from ``labelled(text, lang)``, the RANKED most frequent n-grams of each.

    Rows with a null text or language teach nothing. Every text counts in full. Ties go to the
    smaller gram.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, int], int] = {}
        for part, texts in _parts(batches):
            langs = part.column("lang").to_pylist()
            names = sorted(set(langs))
            of = np.array([names.index(x) for x in langs])
            row, gram, times, _ = gram_counts(texts)
            order = np.lexsort((gram, of[row]))
            lang, gram, times = of[row][order], gram[order], times[order]
            new = np.ones(len(gram), bool)
            new[1:] = (lang[1:] != lang[:-1]) | (gram[1:] != gram[:-1])
            at = np.flatnonzero(new)
            sums = np.add.reduceat(times, at) if len(at) else times
            for x, g, n in zip(lang[at].tolist(), gram[at].tolist(), sums.tolist(), strict=True):
                key = names[x], g
                held[key] = held.get(key, 0) + n
            if len(held) > HELD_GRAMS:
                yield _counted(held)
                held = {}
        yield _counted(held)

    rows = labelled.select("text", "lang").filter("text is not null and lang is not null")
    counts = flat.in_small_batches(rows).mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    most = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    return counts.withColumn("rank", F.row_number().over(most) - 1).filter(F.col("rank") < RANKED).select("lang", "gram", "rank")


def _counted(held: dict[tuple[str, int], int]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([k[0] for k in held], pa.string()), pa.array([k[1] for k in held], pa.int64()), pa.array(list(held.values()), pa.int64())], names=["lang", "gram", "n"]
    )


def identify(docs: DataFrame, profiles: DataFrame, *, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns ``keep``, ``lang_pred`` and ``score`` for each row of ``docs``, judged by ``text``.

    ``score`` is 1 for a document whose n-grams rank as in the profile and 0 where none is in it.
    A text that is null or has no letter gets ``und`` and 0, as does every text without profiles.
    Ties go to the language that sorts first. Repeated rows and null doc_ids stay; columns not in
    ``keep`` are left out, and two of one name are an error. Of a text of any length all n-grams are
    counted.
    """
    limit = MOST_LANGUAGES * RANKED
    known = profiles.limit(limit + 1).collect()  # 300 rows for each language
    if len(known) > limit:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    langs = sorted({r["lang"] for r in known})
    table: dict[str, dict[int, int]] = {x: {} for x in langs}
    for r in known:
        table[r["lang"]][r["gram"]] = r["rank"]
    profile = [(np.array(sorted(g), np.int64), np.array([g[k] for k in sorted(g)], np.int64)) for g in table.values()]

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in _parts(flat.given_back(batches)):
            row, gram, times, has_letter = gram_counts(texts)
            order = np.lexsort((gram, (row << np.int64(40)) - times))
            row, gram = row[order], gram[order]
            rank = np.arange(len(row)) - np.searchsorted(row, row)
            row, gram, rank = row[rank < RANKED], gram[rank < RANKED], rank[rank < RANKED]
            size = np.maximum(np.bincount(row, minlength=len(texts)), 1)
            best, which = np.full(len(texts), np.inf), np.full(len(texts), -1)
            for k, (grams, ranks) in enumerate(profile):
                at = np.minimum(np.searchsorted(grams, gram), len(grams) - 1)
                apart = np.where(grams[at] == gram, np.abs(ranks[at] - rank), RANKED)
                distance = np.bincount(row, np.minimum(apart, RANKED), minlength=len(texts)) / (size * RANKED)
                nearer = distance < best
                best[nearer], which[nearer] = distance[nearer], k
            decided = has_letter & (which >= 0)
            names = [langs[w] if d else UNDETERMINED for w, d in zip(which, decided, strict=True)]
            score = np.where(decided, np.clip(1 - np.where(decided, best, 1), 0, 1), 0.0)
            yield pa.RecordBatch.from_arrays([*(part.column(f"_{c}") for c in keep), pa.array(names, pa.string()), pa.array(score, pa.float64())], names=names_out)

    names_out = [*keep, "lang_pred", "score"]
    if len(set(names_out)) < len(names_out):
        raise ValueError(f"column names clash: {names_out}")
    rows = docs.select("text", *[docs[c].alias(f"_{c}") for c in keep])
    schema = T.StructType([*(T.StructField(c, docs.schema[c].dataType) for c in keep), T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    return flat.in_small_batches(rows).mapInArrow(predict, schema)


def held_out(doc_id: Column) -> Column:
    """Whether a document only serves to test: CRC-32 of its id as text divisible by five."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Rows of about CHUNK code points together; a longer text comes alone."""
    for batch in batches:
        texts = [t or "" for t in batch.column("text").to_pylist()]
        first = size = 0
        for k, text in enumerate(texts):
            if k > first and size + len(text) > CHUNK:
                yield batch.slice(first, k - first), texts[first:k]
                first, size = k, 0
            size += len(text)
        if first < len(texts):
            yield batch.slice(first), texts[first:]
