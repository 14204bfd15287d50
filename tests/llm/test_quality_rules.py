import random
import re
from collections import Counter

import pytest

from barwright.llm import quality_rules as q

SCHEMA = "doc_id long, text string"


def plain(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0d]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0d]", x)]
    windows = [tuple(w[k : k + 8]) for k in range(len(w) - 7)]
    often = {x for x, n in Counter(windows).items() if n > 1}
    hit = {p for k, x in enumerate(windows) if x in often for p in range(k, k + 8)}
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines), len(lines) - len(set(lines)), len(hit)


def breaks(text):
    """Whether a text breaks any rule."""
    text = text or ""
    n, chars, symbols, lines, dup, repeats = plain(text)
    w = re.findall(r"[^\x20\x09-\x0d]+", text)
    capitals = sum("A" <= c <= "Z" for c in text)
    lettered = sum(any(c.isalpha() for c in x) for x in w)
    return (
        n < 20
        or 100 * repeats > 30 * n
        or 10 * symbols > n
        or 100 * dup > 50 * lines
        or chars > 20 * n
        or chars < 2 * n
        or 100 * capitals > 40 * chars
        or 5 * len(set(w)) < min(n, 1000)
        or 2 * lettered < n
    )


def rows():
    r = random.Random(4)
    made = [None, "", " \n\t", "one", "a b c d e f g h", "a b c d e f g h " * 3, "x " * 40, "😀 é\x0b\x0c\r\nÀ B", "w" * 300_000, "p q r s t u v w x " * 8000]
    made += [" ".join(f"{r.choice('abcdefgh')}{k}word" if r.random() < 0.8 else r.choice(["12", "A#", "XYZ", "-", "a\n"]) for k in range(r.randint(0, 90))) for _ in range(60)]
    made += [" ".join(["alpha", "beta", "gamma", "delta", "rho"][k * k % 5] + "é" * (k % 3) for k in range(400)), " ".join(str(k) for k in range(50))]
    made += [" ".join(r.choices(["a", "B", "c#", "d|", "\n", "e"], k=r.randint(0, 120))) for _ in range(150)]
    return list(enumerate(made)) + [(5, made[5]), (None, "nobody")]


def test_features_equal_plain_counts(spark):
    docs = spark.createDataFrame(rows(), SCHEMA).selectExpr("*", "1 AS words", "2 AS _lines")
    got = sorted((tuple(r) for r in q.features(docs, "doc_id").collect()), key=str)
    assert got == sorted(((d, *plain(t)) for d, t in rows()), key=str)


def test_the_cascade_keeps_what_breaks_no_rule(spark):
    docs = spark.createDataFrame(rows(), SCHEMA)
    good = [(d, t) for d, t in rows() if not breaks(t)]
    assert good and len(good) < len(rows()) - 20
    judged = q.judge(docs, "doc_id", "text")
    assert sorted(((r["doc_id"], r["text"]) for r in judged.filter("broken is null").collect()), key=str) == sorted(good, key=str)
    kept = q.keep_good(docs.selectExpr("*", "5 AS n_words", "6 AS row", "7 AS kept"))
    assert kept.columns == ["doc_id", "text", "n_words", "row", "kept"]
    assert sorted((tuple(r[:2]) for r in kept.collect()), key=str) == sorted(good, key=str)


def test_rules_that_reject_most_for_their_cost_come_first(spark):
    docs = spark.createDataFrame(rows(), SCHEMA)
    rules = {"never": "n_words < 0", "always": "n_words >= 0"}
    assert q.cascade_order(docs, rules) == ["always", "never"]
    assert {r["broken"] for r in q.judge(docs, "doc_id", rules=rules).collect()} == {"always"}


@pytest.mark.parametrize("codegen", ["true", "false"])
def test_a_broken_document_is_not_asked_about_the_rest(spark, codegen):
    """A rule that may not be asked stops the query if it is; only documents that break no earlier
    rule reach it, and its own work is not taken out of its branch."""
    texts = [f"{k} " * 3 if k % 2 else " ".join(f"word{k}x{j}" for j in range(30)) for k in range(40)]
    docs = spark.createDataFrame(list(enumerate(texts)), SCHEMA)
    asked = "size(transform(words, w -> if(length(w) < 4, raise_error('asked'), length(w)))) < 0"
    rules = {"few_words": "n_words < 20", "asked": asked, "asked_again": f"n_words > 0 and {asked}"}
    before = spark.conf.get("spark.sql.codegen.wholeStage")
    spark.conf.set("spark.sql.codegen.wholeStage", codegen)
    try:
        measured = q._measured(docs, ("doc_id",))
        found = measured.select("kept.*", q._first_broken(rules, list(rules)).alias("broken")).collect()
        assert {r["doc_id"]: r["broken"] for r in found} == {k: "few_words" if k % 2 else None for k in range(40)}
        with pytest.raises(Exception, match="asked"):
            measured.select(q._first_broken(rules, ["asked", "few_words"])).collect()
    finally:
        spark.conf.set("spark.sql.codegen.wholeStage", before)


def test_names_of_results_are_refused(spark):
    with pytest.raises(ValueError, match="n_words"):
        q.judge(spark.createDataFrame([], SCHEMA + ", n_words int"), "doc_id", "n_words")


def test_empty_table(spark):
    docs = spark.createDataFrame([], SCHEMA)
    assert q.judge(docs, "doc_id").count() == 0
    assert q.keep_good(docs).count() == 0
