import base64
import random

import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from barwright.llm import token_counts

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
ODD = ["a", "the ", " of", "é", "😀", "\n", "\n\n", " \n", "Straße", "中文", "x1", ".", "\n  "]


@pytest.fixture(scope="module")
def coder():
    with open(RANKS, "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    return tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def plain(coder, text, sections, rule):
    """Token by token and character by character."""
    counts, crossing, outside = [0] * len(sections), 0, 0
    at = 0
    data = text.encode()
    ids = coder.encode_ordinary(text)
    for k in ids:
        n = len(coder.decode_single_token_bytes(k))
        begun = lambda b: sum((x & 0xC0) != 0x80 for x in data[:b])
        first, last = begun(at + 1) - 1, begun(at + n) - 1
        where = {"first": first, "last": last, "most": first + (last - first) // 2}[rule]
        own = next((s for s, (a, b) in enumerate(sections) if a <= where < b), None)
        if own is None:
            outside += 1
        else:
            counts[own] += 1
            crossing += first < sections[own][0] or last >= sections[own][1]
        at += n
    return len(ids), crossing, outside, counts


def line_spans(text):
    out, at = [], 0
    for part in text.splitlines(keepends=True):
        out.append((at, at + len(part)))
        at += len(part)
    return out


@pytest.mark.parametrize("rule", token_counts.RULES)
def test_lines_equal_plain_counts(spark, coder, rule):
    r = random.Random(7)
    texts = ["".join(r.choices(ODD, k=r.randint(0, 25))) for _ in range(150)]
    rows = list(enumerate(texts)) + [(500, None), (501, ""), (1, texts[1]), (None, "a\nb")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS n_tokens")
    by_own = docs.withColumn("mine", token_counts.lines(F.col("text")))
    for got in (token_counts.count_tokens(docs, RANKS, public_tokenizers.PATTERN, rule=rule), token_counts.count_tokens(by_own, RANKS, public_tokenizers.PATTERN, rule=rule, sections="mine")):
        found = [(x["doc_id"], x["n_tokens"], x["n_crossing"], x["n_outside"], [s["n_tokens"] for s in x["sections"]], [(s["start"], s["end"]) for s in x["sections"]]) for x in got.collect()]
        want = [(d, *plain(coder, t or "", line_spans(t or ""), rule), line_spans(t or "")) for d, t in rows]
        assert sorted(found, key=str) == sorted(want, key=str)


def test_tokens_between_sections_are_outside(spark, coder):
    text = "Heading\nbody of the text and more"
    docs = spark.createDataFrame([(1, text, [("h", 0, 4), ("b", 12, 20)]), (2, text, None), (3, text, [])], f"doc_id long, text string, s {token_counts.SECTIONS}")
    got = {r["doc_id"]: r for r in token_counts.count_tokens(docs, RANKS, public_tokenizers.PATTERN, sections="s").collect()}
    n, crossing, outside, counts = plain(coder, text, [(0, 4), (12, 20)], "first")
    assert (got[1]["n_tokens"], got[1]["n_crossing"], got[1]["n_outside"]) == (n, crossing, outside)
    assert [s["n_tokens"] for s in got[1]["sections"]] == counts
    assert got[2]["n_outside"] == got[3]["n_outside"] == n


def test_empty_and_long(spark, coder):
    docs = spark.createDataFrame([(1, "word and\n" * 40_000)], "doc_id long, text string")
    row = token_counts.count_tokens(docs, RANKS, public_tokenizers.PATTERN).first()
    assert row["n_tokens"] == sum(s["n_tokens"] for s in row["sections"]) == len(coder.encode_ordinary("word and\n" * 40_000))
    assert token_counts.count_tokens(docs.limit(0), RANKS, public_tokenizers.PATTERN).count() == 0
    with pytest.raises(ValueError, match="rule"):
        token_counts.count_tokens(docs, RANKS, public_tokenizers.PATTERN, rule="all")
