import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from barwright.llm import language

SCHEMA = "doc_id long, text string, lang string"
WORDS = {"aa": ["alpha", "gamma", "banana"], "oo": ["boto", "roko", "Ölo", "zoo"]}


def grams(text):
    w = "".join((c.lower() if len(c.lower()) == 1 else c) if c.isalpha() else " " for c in f" {text} ")
    out = Counter()
    for n in (1, 2, 3):
        for k in range(len(w) - n + 1):
            g = w[k : k + n]
            if g.strip() and not (n == 3 and g[1] == " "):
                out[g] += 1
    return out


def test_gram_counts_equal_plain_counts():
    r = random.Random(1)
    texts = ["".join(r.choices("aAbß é1中文Ü.\n", k=r.randint(0, 30))) for _ in range(300)] + ["".join(chr(r.randrange(0x100, 0xD000)) for _ in range(3000))] * 2
    row, gram, times, has_letter = language.gram_counts(texts)
    found = [Counter() for _ in texts]
    for k, g, n in zip(row.tolist(), gram.tolist(), times.tolist(), strict=True):
        found[k]["".join(chr(x) for x in (g >> 42, g >> 21 & 0x1FFFFF, g & 0x1FFFFF) if x)] += n
    assert found == [grams(t) for t in texts]
    assert has_letter.tolist() == [any(c.isalpha() for c in t) for t in texts]


def made(spark, n=60):
    r = random.Random(2)
    rows = [(k, " ".join(r.choices(WORDS[x], k=30)), x) for k, x in enumerate(["aa", "oo"] * (n // 2))]
    return spark.createDataFrame(rows, SCHEMA)


def test_profiles_rank_by_count_then_gram(spark):
    docs = made(spark)
    total = Counter()
    for r in docs.filter("lang = 'aa'").collect():
        total += grams(r["text"])
    code = {g: sum(ord(c) << 21 * (len(g) - 1 - k) for k, c in enumerate(g)) for g in total}
    want = [code[g] for g in sorted(total, key=lambda g: (-total[g], code[g]))[: language.RANKED]]
    got = language.fit_profiles(docs).filter("lang = 'aa'").orderBy("rank").collect()
    assert [r["gram"] for r in got] == want


def test_languages_are_told_apart(spark):
    docs = made(spark)
    named = language.identify(docs, language.fit_profiles(docs), keep=("doc_id", "lang"))
    assert named.filter("lang != lang_pred").count() == 0
    assert named.filter("score < 0 or score > 1").count() == 0


def test_odd_texts(spark):
    profiles = language.fit_profiles(made(spark).union(spark.createDataFrame([(0, None, "aa"), (1, "xx", None)], SCHEMA)))
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "12 !?"), (4, "zoo " * 100_000), (5, "q"), (5, "q"), (None, "banana")], "doc_id long, text string")
    got = [tuple(r) for r in language.identify(odd, profiles).select("doc_id", "lang_pred").collect()]
    assert sorted(got, key=str) == sorted([(1, "und"), (2, "und"), (3, "und"), (4, "oo"), (5, "aa"), (5, "aa"), (None, "aa")], key=str)
    assert language.identify(odd.limit(0), profiles).count() == 0
    none = language.fit_profiles(made(spark).limit(0))
    assert {r["lang_pred"] for r in language.identify(odd, none).collect()} == {"und"}


def test_clashing_columns_are_refused(spark):
    docs = made(spark)
    with pytest.raises(ValueError, match="clash"):
        language.identify(docs.withColumn("score", F.lit(1)), language.fit_profiles(docs), keep=("doc_id", "score"))
    kept = language.identify(docs, language.fit_profiles(docs), keep=("doc_id", "text", "lang"))
    assert kept.columns == ["doc_id", "text", "lang", "lang_pred", "score"]


def test_held_out_documents(spark):
    import zlib

    got = spark.range(200).select("id", language.held_out(F.col("id")).alias("h")).collect()
    assert all(r["h"] == (zlib.crc32(str(r["id"]).encode()) % 5 == 0) for r in got)


def test_held_out_accuracy(spark):
    from barwright.llm.queries import QUERIES

    sf = "/root/testdata/sf0.001"
    named = QUERIES["op9_language"](spark, sf).join(spark.read.parquet(f"{sf}/documents.parquet"), "doc_id").filter("held_out")
    assert named.filter("lang = lang_pred").count() >= 0.9 * named.count()


def test_distances_equal_plain_ranks(spark):
    """Out-of-place distance of every document to every profile, by hand."""
    docs = made(spark, 30)
    r = random.Random(4)
    odd = [(100 + k, " ".join(r.choices([*WORDS["aa"], *WORDS["oo"], "xyz", "Ünï"], k=r.randint(1, 40))), None) for k in range(40)]
    every = docs.union(spark.createDataFrame(odd, SCHEMA))
    profiles = language.fit_profiles(docs)
    rank = {}
    for p in profiles.collect():
        rank.setdefault(p["lang"], {})[p["gram"]] = p["rank"]
    code = lambda g: sum(ord(c) << 21 * (len(g) - 1 - k) for k, c in enumerate(g))
    texts = {x["doc_id"]: x["text"] for x in every.collect()}
    for got in language.identify(every, profiles).collect():
        own = sorted(((-n, code(g)) for g, n in grams(texts[got["doc_id"]]).items()))[: language.RANKED]
        apart = {}
        for lang, known in rank.items():
            apart[lang] = sum(min(abs(known[g] - k), language.RANKED) if g in known else language.RANKED for k, (_, g) in enumerate(own)) / (len(own) * language.RANKED)
        best = min(sorted(apart), key=lambda x: apart[x])
        assert got["lang_pred"] == best and got["score"] == pytest.approx(1 - apart[best])
