import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from barwright.llm import flat, resampling
from barwright.llm.resampling import BUCKETS

SCHEMA = "doc_id long, text string"


def plain_buckets(text):
    spans = [m.span() for m in re.finditer(rb"[0-9A-Za-z\x80-\xff]+|[^0-9A-Za-z\x80-\xff\x20\x09-\x0d]+", text.encode())]
    data = np.frombuffer(text.encode(), np.uint8)
    if not spans:
        return []
    h = flat.span_hashes(data, np.array([s for s, _ in spans]), np.array([e for _, e in spans]))
    pairs = flat.mixed(h[:-1] * np.uint64(3) + h[1:])
    return sorted((np.concatenate((h, pairs)) & np.uint64(BUCKETS - 1)).tolist())


def test_buckets_do_not_depend_on_the_texts_around():
    import pyarrow as pa

    r = random.Random(1)
    texts = ["".join(r.choices(["a", "Bc", " ", "é", "##", "\n", "1"], k=r.randint(0, 30))) for _ in range(200)] + [None, ""]
    for _, _, data, bounds in flat.chunks(pa.array(texts)):
        row, bucket = resampling.gram_buckets(data, bounds)
        for k, t in enumerate(texts):
            assert sorted(bucket[row == k].tolist()) == plain_buckets(t or "")


def test_weights_follow_the_target(spark):
    r = random.Random(2)
    rows = [(k, " ".join(r.choices(["good", "fine", "well"] if k % 2 else ["$$$", "%%%", "xx"], k=20))) for k in range(300)] + [(900, None), (901, "")]
    docs = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 AS key", "2 AS noise")
    labels = spark.createDataFrame([(k, k % 2) for k in range(0, 300, 3)] + [(None, 1)], "doc_id long, quality int")
    got = resampling.resample(docs, labels, share=0.5).collect()
    assert len(got) == 302
    kept = {x["doc_id"] for x in got if x["kept"]}
    assert len(kept) == 151 and len([k for k in kept if k < 300 and k % 2]) == 150
    assert {(x["n_grams"], x["log_weight"]) for x in got if x["doc_id"] >= 900} == {(0, 0.0)}


def test_fit_equals_plain_counts(spark):
    texts = ["a b c", "b c", None, "", "## a"]
    docs = spark.createDataFrame(list(enumerate(texts)), SCHEMA)
    ratio = resampling.fit(docs.filter("doc_id < 2"), docs)
    n = np.zeros((2, BUCKETS))
    for k, t in enumerate(texts):
        for b in plain_buckets(t or ""):
            n[1, b] += 1
            n[0, b] += k < 2
    n += resampling.SMOOTHING * n.mean(axis=1, keepdims=True)
    want = np.log(n / n.sum(axis=1, keepdims=True))
    assert np.allclose(ratio, want[0] - want[1])


@pytest.mark.parametrize("last", [10_000, 5])
@pytest.mark.parametrize("k", [0, 1, 37, 499, 500, 600])
def test_the_largest_keys_are_taken(spark, monkeypatch, last, k):
    monkeypatch.setattr(resampling, "LAST_KEYS", last)
    r = random.Random(3)
    rows = [(i, float(r.choice([r.gauss(0, 1), 5.0, -1e9, 1e-300]))) for i in range(480)] + [(None, 5.0)] * 5 + [(7, 5.0)] * 15
    got = resampling.take_largest(spark.createDataFrame(rows, "doc_id long, key double"), k).collect()
    want = sorted(rows, key=lambda x: (-x[1], x[0] is not None, x[0] or 0))[:k]
    assert sorted(((x["doc_id"], x["key"]) for x in got if x["kept"]), key=str) == sorted(want, key=str)
    assert len(got) == 500


def test_empty_tables_and_no_labels(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, "c d"), (2, "c d")], SCHEMA)
    labels = spark.createDataFrame([], "doc_id long, quality int")
    got = resampling.resample(docs, labels, share=1 / 3)
    assert got.filter("kept").count() == 1
    assert resampling.resample(docs.limit(0), labels, share=0.5).count() == 0


def test_draws_are_in_proportion(spark):
    """Of two texts with log-weights apart by log 3, the heavier one comes first three times in four."""
    texts = spark.range(4000).select((F.col("id") + 1).alias("doc_id"), F.lit("a").alias("text"))
    keyed = resampling.weigh(texts, np.zeros(BUCKETS)).collect()
    noise = [x["key"] for x in keyed]
    heavier = sum(a + np.log(3) > b for a, b in zip(noise[::2], noise[1::2], strict=True)) / 2000
    assert abs(heavier - 0.75) < 0.04


def test_weights_equal_plain_sums(spark):
    r = np.random.default_rng(6)
    ratio = r.normal(size=BUCKETS)
    texts = ["a b c", "b c", None, "", "## a", "a " * 3000, "Ünï cödé 12"]
    docs = spark.createDataFrame([*enumerate(texts), (0, texts[0])], SCHEMA)
    got = resampling.weigh(docs, ratio, seed=3).collect()
    assert len(got) == 8
    for x in got:
        own = plain_buckets(texts[x["doc_id"]] or "")
        assert x["n_grams"] == len(own) and np.isclose(x["log_weight"], ratio[own].sum())
    again = {x["doc_id"]: x["key"] for x in resampling.weigh(docs, ratio, seed=3).collect()}
    other = {x["doc_id"]: x["key"] for x in resampling.weigh(docs, ratio, seed=4).collect()}
    assert all(again[x["doc_id"]] == x["key"] != other[x["doc_id"]] for x in got)


def test_noise_has_the_gumbel_distribution(spark):
    docs = spark.range(20_000).selectExpr("id AS doc_id", "'x' AS text")
    noise = np.sort([x["key"] for x in resampling.weigh(docs, np.zeros(BUCKETS)).select("key").collect()])
    wanted = np.exp(-np.exp(-noise))  # its distribution function
    assert np.abs(wanted - (np.arange(len(noise)) + 0.5) / len(noise)).max() < 0.015


@pytest.mark.parametrize("k", [1, 7, 2999, 3000, 3004])
def test_one_row_repeated_very_often_is_cut_by_number(spark, k):
    rows = spark.range(3000, numPartitions=6).selectExpr("CAST(5 AS long) AS doc_id", "1.5D AS key")
    rows = rows.union(spark.createDataFrame([(1, 9.0), (2, 0.5), (3, 0.25), (None, 0.0)], "doc_id long, key double"))
    got = resampling.take_largest(rows, k)
    assert got.count() == 3004 and got.filter("kept").count() == k
    assert got.filter("kept").agg({"key": "min"}).first()[0] == (9.0 if k == 1 else 1.5 if k <= 3001 else 0.0)
