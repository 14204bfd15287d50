import random

import pytest

from barwright.llm import contamination
from tests.llm.plain import contamination as plain

DOCS, ITEMS = "doc_id long, text string", "item_id long, text string"


def made(seed):
    """Texts over few words, so that windows, parts of windows and short items are met by chance."""
    r = random.Random(seed)
    words = ["the", "of", "Of", "and", "it", "Über", "x1", "42", "to", "in", "a", "on"]
    items = [(k, " ".join(r.choices(words, k=r.choice([1, 2, 3, 5, 12, 13, 14, 30])))) for k in range(12)]
    items += [(20, items[3][1]), (21, items[5][1].upper() + "!"), (22, None), (23, " - "), (3, items[3][1])]
    docs = []
    for k in range(60):
        parts = []
        for _ in range(r.randint(0, 4)):
            own = r.choice(items)[1] or ""
            cut = own.split()[r.randint(0, 2) : len(own.split()) - r.randint(0, 2)]
            parts += [" ".join(r.choices(words, k=r.randint(0, 20))), r.choice([own, " ".join(cut)])]
        docs.append((k, r.choice([" ", ", ", "\n"]).join(parts)))
    return docs + [(100, None), (101, ""), (102, "?!"), (None, items[5][1]), (5, docs[5][1]), (6, "another text for six")], items


@pytest.mark.parametrize("tokens", [contamination.BROADCAST_TOKENS, 3], ids=["sent", "shuffled"])
@pytest.mark.parametrize("seed", [1, 2])
def test_equals_plain_windows(spark, seed, tokens):
    docs, items = made(seed)
    got = contamination.contaminated(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS), broadcast_tokens=tokens)
    assert sorted((tuple(r[:6]) for r in got.collect()), key=str) == sorted(plain(docs, items), key=str)


def test_empty_tables(spark):
    docs, items = made(1)
    none = contamination.contaminated(spark.createDataFrame(docs, DOCS), spark.createDataFrame([], ITEMS))
    assert none.filter("n_hit > 0 or n_items > 0 or contaminated").count() == 0
    assert none.count() == len(docs)
    assert contamination.contaminated(spark.createDataFrame([], DOCS), spark.createDataFrame(items, ITEMS)).count() == 0


def test_filter_keeps_clean_rows_and_their_columns(spark):
    docs, items = made(2)
    table = spark.createDataFrame(docs, DOCS).selectExpr("*", "doc_id AS words", "1 AS n_hit", "'x' AS print")
    bad = [r[5] for r in plain(docs, items)]
    left = contamination.without_contaminated(table, spark.createDataFrame(items, ITEMS))
    assert left.columns == table.columns
    assert sorted((tuple(r[:2]) for r in left.collect()), key=str) == sorted((d for d, b in zip(docs, bad, strict=True) if not b), key=str)


def test_a_very_long_text(spark):
    r = random.Random(3)
    passage = " ".join(f"p{k}" for k in range(40))
    long = " ".join(r.choices(["the", "of", "and"], k=80_000))
    docs = [(1, f"{long} {passage} {long}"), (2, "w" * 1_000_000)]
    items = [(1, passage), (2, " ".join(["the"] * 13))]
    got = contamination.contaminated(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS))
    assert sorted(tuple(r[:6]) for r in got.collect()) == sorted(plain(docs, items))


def test_no_python_runs(spark):
    docs, items = made(1)
    got = contamination.contaminated(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS))
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow", "Cartesian", "NestedLoop"))
