import hashlib
import random
from collections import Counter

import pytest

from barwright.llm import repeats

DOCS = "doc_id long, text string, first int, print string"


def plain(docs, window):
    words = [(text or "").encode().split() for _, text in docs]
    seen = Counter(tuple(w[k : k + window]) for w in words for k in range(len(w) - window + 1))
    out = []
    for (doc, _), w in zip(docs, words, strict=True):
        gone = {p for k in range(len(w) - window + 1) if seen[tuple(w[k : k + window])] > 1 for p in range(k, k + window)}
        left = b" ".join(x for k, x in enumerate(w) if k not in gone)
        out.append((doc, len(w), len(gone), hashlib.sha256(left).hexdigest(), left.decode()))
    return sorted(out, key=str)


def made(seed, window):
    r = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(400)] + ["the", "Über", "日本"]
    passages = [r.choices(vocabulary, k=r.choice([window - 1, window, window + 1, 2 * window, 90])) for _ in range(6)]
    docs = []
    for k in range(60):
        w = []
        for _ in range(r.randint(0, 4)):
            w += r.choices(vocabulary, k=r.randint(0, 50)) + r.choice(passages + [["x"] * r.randint(1, 3 * window)])
        docs.append((k, "".join(x + r.choice([" ", "  ", "\n", "\t"]) for x in w)))
    line = " ".join(r.choices(vocabulary, k=window + 3))
    docs += [(200 + k, f"{k} {line} {k + 1}") for k in range(40)]  # one passage that very many share
    return docs + [(100, None), (101, ""), (102, " \n "), (None, docs[3][1]), (5, docs[5][1]), (6, "other text"), (7, "y " * 5000)]


def rows(spark, docs):
    return spark.createDataFrame([(d, t, 1, "p") for d, t in docs], DOCS)


@pytest.mark.parametrize("window", [35, 9, 6])
@pytest.mark.parametrize("seed", [1, 2])
def test_equals_plain_windows(spark, seed, window):
    docs = made(seed, window)
    got = repeats.without_repeats(rows(spark, docs), window=window, with_text=True)
    assert sorted(map(tuple, got.collect()), key=str) == plain(docs, window)


@pytest.mark.parametrize("few, counters", [(0, 50), (3, 4096)])
def test_frequent_prefixes_change_nothing(spark, few, counters, monkeypatch):
    monkeypatch.setattr(repeats, "FEW_RECORDS", few)
    monkeypatch.setattr(repeats, "COUNTERS", counters)
    docs = made(3, 35)
    table = rows(spark, docs)
    often = repeats._frequent(table.selectExpr("doc_id", "text"), 35)
    assert often and max(often.values()) > 1
    got = repeats.without_repeats(table, with_text=True)
    assert sorted(map(tuple, got.collect()), key=str) == plain(docs, 35)


def test_counters_miss_no_frequent_prefix(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(repeats, "COUNTERS", 64)
    r = random.Random(5)
    line = " ".join(f"s{j}" for j in range(40))
    texts = [" ".join(r.choices("abcdefghij", k=200)) + f" {line} " + " ".join(r.choices("abcdefghij", k=50)) for _ in range(3000)]
    batches = [pa.record_batch({"text": pa.array(texts[k : k + 500])}) for k in range(0, 3000, 500)]

    def counted():
        (found,) = repeats._counter(35)(iter(batches))
        return {r["key"]: r["n"] for r in found.to_pylist()}

    bounded = counted()
    monkeypatch.setattr(repeats, "COUNTERS", 10**7)
    exact = counted()
    assert len(bounded) <= 65 and bounded[None] == exact[None]
    keyed = sum(n for k, n in exact.items() if k is not None)
    often = {k for k, n in exact.items() if k is not None and n > keyed / 64}
    assert often and often <= set(bounded) and all(exact[k] - keyed / 64 <= n <= exact[k] for k, n in bounded.items() if k is not None)


@pytest.mark.parametrize("limit", [1, 2, 7])
def test_groups_beyond_a_task(limit, monkeypatch):
    """Parts of one group find through their nodes what the whole group finds."""
    import numpy as np
    import pyarrow as pa

    docs = made(4, 35)
    batch = pa.record_batch({"doc_id": pa.array([d for d, _ in docs]), "text": pa.array([t for _, t in docs]), "print": pa.array(range(len(docs)))})
    table = pa.Table.from_batches(list(repeats._recorder(35, {})(iter([batch])))).sort_by([("key", "ascending"), ("salt", "ascending")])

    def places(found):
        pairs = found.to_pylist()
        nodes = Counter((r["node_a"], r["node_b"]) for r in pairs if r["node_a"] is not None)
        kept = [r for r in pairs if r["first"] is not None and (r["node_a"] is None or nodes[r["node_a"], r["node_b"]] > 1)]
        return {(r["print"], p) for r in kept for p in range(r["first"], r["last"] + 1)}

    whole = places(pa.Table.from_batches(list(repeats._subtrees(iter(table.to_batches())))))
    monkeypatch.setattr(repeats, "GROUP_RECORDS", limit)
    cut = [b for k in np.arange(0, table.num_rows, 3) for b in table.slice(k, 3).to_batches()]
    assert places(pa.Table.from_batches(list(repeats._subtrees(iter(cut))))) == whole and whole


def test_empty_table(spark):
    assert repeats.without_repeats(rows(spark, [])).collect() == []
