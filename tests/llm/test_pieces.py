import hashlib
import random

import public_tokenizers
import pytest
import sentencepiece

from barwright.llm import pieces

MODEL = public_tokenizers.path("piece_bpe_32k.model")
ODD = ["a", "b", "the", " ", "  ", "é", "\n", "\t", "😀", "▁", "ａ", "x", "ing", "中", "\x00", "1", "<s>", "ï", "�", "́"]


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


def test_ids_and_texts_are_those_of_the_library(library):
    r, encoder = random.Random(3), pieces.Encoder(MODEL)
    for _ in range(1500):
        text = "".join(r.choices(ODD, k=r.randint(0, 40)))
        ids = library.encode(text)
        assert encoder.encode(text) == ids
        assert pieces.decode(encoder.vocabulary, ids) == library.decode(ids)


def test_long_words_go_by_the_heap(library):
    r, encoder = random.Random(4), pieces.Encoder(MODEL)
    for size in (399, 400, 401, 3000):
        text = "".join(r.choices(["a", "b", "er", "an", "é", "ａ"], k=size))
        assert encoder.encode(text) == library.encode(text)
    assert encoder.encode("ab" * 60_000) == library.encode("ab" * 60_000)


def test_any_ids_decode_as_in_the_library(library):
    r, v = random.Random(5), pieces.vocabulary(MODEL)
    for _ in range(500):
        ids = [r.randrange(3, 259) if r.random() < 0.6 else r.randrange(3, 32000) for _ in range(20)]
        assert pieces.decode(v, ids) == library.decode(ids)


def test_the_store_of_words_is_bounded(library, monkeypatch):
    monkeypatch.setattr(pieces, "KEPT_BYTES", 10_000)
    r, encoder = random.Random(6), pieces.Encoder(MODEL)
    for _ in range(300):
        text = " ".join(r.choices([f"word{k}" for k in range(80)], k=6))
        assert encoder.encode(text) == library.encode(text)
        assert len(encoder.known) + len(encoder.older) < 10_000 / pieces.WORD_BYTES + 12
    assert encoder.older


def test_documents(spark, library):
    texts = ["Hello  world\n", None, "", " lead", "x" * 30_000, "same", "same", "ａ ▁b"]
    docs = spark.createDataFrame(list(enumerate(texts)) + [(None, "no id")], "doc_id long, text string").selectExpr("*", "7 AS n_tokens", "8 AS ids")
    encoded = pieces.encode_documents(docs, MODEL)
    assert {r["doc_id"]: r["ids"] for r in encoded.collect()} == {k: library.encode(t or "") for k, t in [*enumerate(texts), (None, "no id")]}
    assert {r["doc_id"]: r["text"] for r in pieces.decode_documents(encoded, MODEL).collect()}[0] == "Hello  world\n"
    for r in pieces.digest_documents(docs, MODEL, with_ids=True).collect():
        ids = library.encode("no id" if r["doc_id"] is None else texts[r["doc_id"]] or "")
        assert (r["n_tokens"], r["ids"]) == (len(ids), ids)
        assert r["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(library.decode(ids).encode()).hexdigest()
    assert pieces.digest_documents(docs.limit(0), MODEL).count() == 0
