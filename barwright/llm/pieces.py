"""Piece encoding and decoding by vectorised merge rounds.

A model's merges never join a space mark to what stands before it, so a text falls into words, each
a run of space marks and what follows, that are encoded apart. The words a task has not met before
go into flat arrays of symbols; in each round every word merges its best pair, the leftmost one of
equals, all words at once, and the arrays are compacted, until no pair is left in the vocabulary.
One merge per word and round keeps the order of a priority queue exactly, also where a merge makes
a pair that beats the rest of the round.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import chain, groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from barwright.llm import flat

MARK = "▁"
#: Bytes, about, of the words that a task remembers for texts that repeat them, and what a word takes
#: besides its characters.
KEPT_BYTES, WORD_BYTES = 24 << 20, 500
#: Symbols of the words that are merged together; a longer word goes by a heap instead, as rounds
#: over it would be as many as its merges.
ROUND_SYMBOLS, LONG_WORD = 1 << 18, 400

_WORDS = re.compile(f"{MARK}+[^{MARK}]*|[^{MARK}]+")
_NEVER = np.iinfo(np.int64).max


class Vocabulary:
    """Pieces, the pairs that make them and their ranks, read from a model file."""

    def __init__(self, model: str):
        import sentencepiece

        file = sentencepiece.SentencePieceProcessor(model_file=model)
        count = file.vocab_size()
        plain = [i for i in range(count) if not (file.is_control(i) or file.is_unknown(i) or file.is_byte(i) or file.is_unused(i))]
        self.piece_id = {file.id_to_piece(i): i for i in plain}
        self.unknown = file.unk_id()
        self.byte_id = {int(file.id_to_piece(i)[3:5], 16): i for i in range(count) if file.is_byte(i)}
        # equal scores share a rank: then the leftmost pair goes first
        scores = sorted({file.get_score(i) for i in plain}, reverse=True)
        place = {score: k for k, score in enumerate(scores)}
        self.rank = {i: place[file.get_score(i)] for i in plain}
        pairs = sorted((a * count + b, self.rank[i], i) for piece, i in self.piece_id.items() for a, b in self._splits(piece))
        self.count = count
        self.pair_key = np.array([p[0] for p in pairs] or [-1], np.int64)
        self.pair_rank = np.array([p[1] for p in pairs] or [_NEVER], np.int64)
        self.pair_piece = np.array([p[2] for p in pairs] or [0], np.int64)
        self.pair = {key: (rank, piece) for key, rank, piece in pairs}
        self.text_of = [""] * count
        self.text_of[self.unknown] = " ⁇ "
        for piece, i in self.piece_id.items():
            self.text_of[i] = piece.replace(MARK, " ")
        self.character = ~np.arange(0x110000, dtype=np.int64)
        for piece, i in self.piece_id.items():
            if len(piece) == 1:
                self.character[ord(piece)] = i
        # a byte below 128 is a text by itself, the others only in runs
        self.high_byte = {i: b for b, i in self.byte_id.items() if b > 127}
        for b, i in self.byte_id.items():
            self.text_of[i] = chr(b) if b < 128 else ""
        self.number = [str(i) for i in range(count)]

    def _splits(self, piece: str) -> Iterator[tuple[int, int]]:
        for k in range(1, len(piece)):
            a, b = self.piece_id.get(piece[:k]), self.piece_id.get(piece[k:])
            if a is not None and b is not None:
                yield a, b

    def characters(self, text: str) -> np.ndarray:
        """Ids of single characters; one outside the vocabulary is the complement of its code point."""
        return self.character[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)]

    def out(self, symbols: list[int]) -> tuple[int, ...]:
        """Ids with characters outside the vocabulary as bytes, or as unknown."""
        if min(symbols, default=0) >= 0:
            return tuple(symbols)
        ids: list[int] = []
        for s in symbols:
            if s >= 0:
                ids.append(s)
            elif self.byte_id:
                ids += [self.byte_id[b] for b in chr(~s).encode("utf-8")]
            else:
                ids.append(self.unknown)
        return tuple(ids)


@lru_cache(maxsize=4)
def vocabulary(model: str) -> Vocabulary:
    return Vocabulary(model)


def split_words(text: str) -> list[str]:
    """The words of a text, with a mark put before it and for each space. Empty for no text."""
    return _WORDS.findall(MARK + text.replace(" ", MARK)) if text else []


def merge_words(v: Vocabulary, words: list[str]) -> list[tuple[int, ...]]:
    """The ids of each word."""
    found: dict[int, tuple[int, ...]] = {}
    block: list[int] = []
    size = 0
    for k, word in enumerate(words):
        if len(word) > LONG_WORD:
            found[k] = v.out(_merge_long(v, v.characters(word).tolist()))
            continue
        if size + len(word) > ROUND_SYMBOLS:
            found.update(zip(block, _merge_rounds(v, [words[x] for x in block]), strict=True))
            block, size = [], 0
        block.append(k)
        size += len(word)
    found.update(zip(block, _merge_rounds(v, [words[x] for x in block]), strict=True))
    return [found[k] for k in range(len(words))]


def _merge_rounds(v: Vocabulary, words: list[str]) -> list[tuple[int, ...]]:
    if not words:
        return []
    symbols = v.characters("".join(words))
    word = np.repeat(np.arange(len(words)), [len(w) for w in words])
    done: list[tuple[np.ndarray, np.ndarray]] = []
    rank, piece = _ranked(v, symbols[:-1], symbols[1:], word[:-1] == word[1:])
    while len(symbols) > 1:
        first = np.flatnonzero(np.concatenate(([True], word[1:] != word[:-1])))
        padded = np.append(rank, _NEVER)
        least = np.minimum.reduceat(padded, first)
        length = np.diff(np.append(first, len(symbols)))
        active = np.repeat(least != _NEVER, length)
        if not active.all():  # words without a pair are finished and leave
            done.append((word[~active], symbols[~active]))
            if not active.any():
                symbols, word = symbols[:0], word[:0]
                break
            padded, symbols, word = padded[active], symbols[active], word[active]
            piece = np.append(piece, 0)[active][:-1]
            keep = least != _NEVER
            least, length = least[keep], length[keep]
            first = np.cumsum(length) - length
        best = padded == np.repeat(least, length)
        at = np.flatnonzero(best)
        leftmost = at[np.concatenate(([True], word[at[1:]] != word[at[:-1]]))]
        symbols[leftmost] = piece[leftmost]
        stay = np.ones(len(symbols), bool)
        stay[leftmost + 1] = False
        symbols, word = symbols[stay], word[stay]
        # only the pairs on either side of a merge are new
        rank = padded[stay][:-1]
        piece = np.append(piece, 0)[stay][:-1]
        here = leftmost - np.arange(len(leftmost))
        again = np.stack((here - 1, here), 1).ravel()
        again = again[(again >= 0) & (again < len(symbols) - 1)]
        rank[again], piece[again] = _ranked(v, symbols[again], symbols[again + 1], word[again] == word[again + 1])
    done.append((word, symbols))
    word, symbols = np.concatenate([d[0] for d in done]), np.concatenate([d[1] for d in done])
    order = np.argsort(word, kind="stable")
    flat, cuts = symbols[order].tolist(), np.cumsum(np.bincount(word, minlength=len(words))).tolist()
    shape = v.out if min(flat) < 0 else tuple
    return [shape(flat[a:b]) for a, b in zip([0, *cuts], cuts, strict=False)]


def _ranked(v: Vocabulary, left: np.ndarray, right: np.ndarray, together: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    key = np.where(together & (left >= 0) & (right >= 0), left * v.count + right, -1)
    at = np.minimum(np.searchsorted(v.pair_key, key), len(v.pair_key) - 1)
    known = (v.pair_key[at] == key) & (key >= 0)
    return np.where(known, v.pair_rank[at], _NEVER), np.where(known, v.pair_piece[at], 0)


def _merge_long(v: Vocabulary, symbols: list[int]) -> list[int]:
    """The same merges for one long word, from a heap of pairs."""
    after, before = list(range(1, len(symbols) + 1)), list(range(-1, len(symbols) - 1))
    queue: list[tuple[int, int, int, int]] = []

    def offer(k: int) -> None:
        if k >= 0 and after[k] < len(symbols):
            a, b = symbols[k], symbols[after[k]]
            if a >= 0 and b >= 0 and (hit := v.pair.get(a * v.count + b)):
                heapq.heappush(queue, (hit[0], k, a, b))

    gone = [False] * len(symbols)
    for k in range(len(symbols)):
        offer(k)
    while queue:
        _, k, a, b = heapq.heappop(queue)
        if gone[k] or after[k] >= len(symbols) or (symbols[k], symbols[after[k]]) != (a, b):
            continue
        taken = after[k]
        symbols[k], gone[taken], after[k] = v.pair[a * v.count + b][1], True, after[taken]
        if after[k] < len(symbols):
            before[after[k]] = k
        offer(before[k])
        offer(k)
    return [s for s, g in zip(symbols, gone, strict=True) if not g]


def decode(v: Vocabulary, ids) -> str:
    """The text of ids: pieces with marks as spaces, runs of bytes as UTF-8 with one replacement
    character per byte that fits nowhere, and the mark put before a text taken off again."""
    first = v.text_of[ids[0]] if ids else ""
    text = "".join([v.text_of[i] for i in ids]) if v.high_byte.keys().isdisjoint(ids) else _with_runs(v, ids)
    return text[1:] if first.startswith(" ") else text


def _with_runs(v: Vocabulary, ids) -> str:
    parts: list[str] = []
    for high, group in groupby(ids, v.high_byte.__contains__):
        parts.append(_text_of(bytes(v.high_byte[i] for i in group)) if high else "".join(v.text_of[i] for i in group))
    return "".join(parts)


def _text_of(run: bytes) -> str:
    out, k = [], 0
    while k < len(run):
        for n in (1, 2, 3, 4):
            try:
                out.append(run[k : k + n].decode())
            except UnicodeDecodeError:
                continue
            k += n
            break
        else:
            out.append("�")
            k += 1
    return "".join(out)


class Encoder:
    """Encodes texts, remembering for each word its ids or what ``shown`` makes of them.

    Words are kept in two halves of KEPT_BYTES: the older one goes when the newer one is full, and a
    word that is met in it moves over. What one call needs is held whatever its size.
    """

    def __init__(self, model: str, shown: Callable = lambda ids: ids):
        self.vocabulary = vocabulary(model)
        self.shown = shown
        self.known: dict = {}
        self.older: dict = {}
        self.held = 0

    def words(self, texts: list[str]) -> list[list]:
        """For each text what is remembered of its words."""
        split = [split_words(t) for t in texts]
        if self.held > KEPT_BYTES // 2:
            self.known, self.older, self.held = {}, self.known, 0
        known, older = self.known, self.older
        fresh = set(chain.from_iterable(split)).difference(known)
        met = fresh.intersection(older)
        known.update((w, older[w]) for w in met)
        new = list(fresh - met)
        known.update(zip(new, map(self.shown, merge_words(self.vocabulary, new)), strict=True))
        self.held += sum(WORD_BYTES + 8 * len(w) for w in fresh)
        return [[known[w] for w in words] for words in split]

    def encode(self, text: str) -> list[int]:
        return [i for word in self.words([text])[0] for i in word]


def encode_documents(docs: DataFrame, model: str) -> DataFrame:
    """``doc_id, ids`` (array of long) for each row of ``docs(doc_id, text)``.

    A null or empty text has no ids. Repeated rows and null doc_ids stay as they are, an empty table
    gives an empty result, and other columns are left out. A text is encoded whole, whatever its
    length.
    """

    def ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(model)
        for doc_ids, texts in _parts(batches):
            rows = [[i for word in words for i in word] for words in encoder.words(texts)]
            yield pa.RecordBatch.from_arrays([doc_ids, pa.array(rows, pa.list_(pa.int64()))], names=["doc_id", "ids"])

    return flat.in_small_batches(docs).select("doc_id", "text").mapInArrow(ids, "doc_id long, ids array<long>")


def decode_documents(encoded: DataFrame, model: str) -> DataFrame:
    """``doc_id, text`` for each row of ``encoded(doc_id, ids)``; null ids give an empty text."""

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(model)
        for batch in batches:
            rows = [decode(v, ids or []) for ids in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array(rows, pa.string())], names=["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(texts, "doc_id long, text string")


def digest_documents(docs: DataFrame, model: str, *, with_ids: bool = False) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256``, and ``ids`` if asked for: both directions in
    one pass, for whole corpora.

    Rows are treated as by :func:`encode_documents`, and ``doc_id`` is a long. Decoding goes word by word,
    as words share no run of bytes.
    """

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _digester(model)
        for doc_ids, texts in _parts(flat.given_back(batches)):
            counts, listed, decoded, rows = [], [], [], []
            for words in encoder.words(texts):
                size, ids, text, own = zip(*words, strict=True) if words else ((), (), (), ())
                text = "".join(text)
                counts.append(sum(size))
                listed.append(hashlib.sha256(",".join(ids).encode()).hexdigest())
                decoded.append(hashlib.sha256((text[1:] if text.startswith(" ") else text).encode()).hexdigest())
                if with_ids:
                    rows.append(list(chain.from_iterable(own)))
            columns = {"doc_id": doc_ids, "n_tokens": pa.array(counts, pa.int64()), "ids_sha256": pa.array(listed, pa.string()), "decoded_sha256": pa.array(decoded, pa.string())}
            if with_ids:
                columns["ids"] = pa.array(rows, pa.list_(pa.int32()))
            yield pa.RecordBatch.from_pydict(columns)

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids
    return flat.in_small_batches(docs).select("doc_id", "text").mapInArrow(digests, schema)


def _digester(model: str) -> Encoder:
    """For one task: a worker that runs other tasks later keeps the vocabulary only."""
    v = vocabulary(model)

    def shown(ids: tuple[int, ...]) -> tuple[int, str, str, tuple[int, ...]]:
        # decoded behind a mark of its own, so that the one the word begins with stays a space
        return len(ids), ",".join([v.number[i] for i in ids]), decode(v, (v.piece_id[MARK], *ids)), ids

    return Encoder(model, shown)


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, list[str]]]:
    """Rows of about CHUNK_BYTES of text at a time, so that long texts do not add up."""
    for batch in batches:
        for first, last, _, _ in flat.chunks(batch.column("text")):
            part = batch.slice(first, last - first)
            yield part.column("doc_id").cast(pa.int64()), [t or "" for t in part.column("text").to_pylist()]
