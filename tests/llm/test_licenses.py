import re
import textwrap

import pytest

from barwright.llm import licenses
from barwright.llm.queries import ORACLE, op5_licenses

SCHEMA = "doc_id long, text string"


def words_of(text):
    return [w for w in re.split(r"[\W_]+", text.lower()) if w]


def dice(pairs, own):
    return 2 * len(pairs & own) / (len(pairs) + len(own))


def best_window(text, template):
    """The largest coefficient of any passage of at most one and a half times the template's pairs."""
    words, other = words_of(text), words_of(template)
    pairs, own = list(zip(words, words[1:], strict=False)), set(zip(other, other[1:], strict=False))
    longest = (len(other) - 1) * 3 // 2
    best = 0.0
    for a in [k for k, p in enumerate(pairs) if p in own]:
        seen = set()
        for p in pairs[a : a + longest]:
            seen.add(p)
            best = max(best, dice(seen, own))
    return best


def plain(text):
    """``(licenses, best)`` by comparing every line, paragraph and window with every template."""
    text = text or ""
    parts = set(text.split("\n") + [p for p in re.split(r"\n[ \t\r]*\n", text) if "\n" in p])
    out = []
    for name, template in licenses.TEMPLATES:
        own = licenses.bigrams_of(template)
        hits = [d for d in (dice(g, own) for g in map(licenses.bigrams_of, parts) if g) if d >= licenses.THRESHOLD]
        window = 0.0 if hits else best_window(text, template)
        out += [(name, d) for d in [*hits, window] if d >= licenses.THRESHOLD]
    best = {}
    for name, d in out:
        best[name.split("-")[0]] = max(d, best.get(name.split("-")[0], 0))
    out = [(name, d) for name, d in out if d == best[name.split("-")[0]]]
    return sorted({n for n, _ in out}), max([d for _, d in out], default=0.0)


TEXT = {k: t for k, (_, t) in enumerate(licenses.TEMPLATES)}
BY_NAME = {name: text for name, text in reversed(licenses.TEMPLATES)}


def wrapped(text):
    return textwrap.fill(text, 60, break_long_words=False, break_on_hyphens=False)


TEXTS = [
    None,
    "",
    "\n\n",
    "Some words.\nReleased under the MIT License.",
    "RELEASED under -- the  mit license!!\nReleased under the MIT License.",
    "It was released under the old MIT License of theirs, they say.",
    "Licensed under the Apache License, Version 2.0.\nLicensed under CC BY-NC 4.0.",
    wrapped(BY_NAME["MIT"]) + "\n\nThe end.",
    "intro\n\n" + BY_NAME["ISC"].replace("software", "thing") + "\n \nmore",
    "Copyright 2024 Acme\n\n" + BY_NAME["BSD-3-Clause"].replace("copyright holder", "Acme Corporation").replace(". ", ".\n\n"),
    "This work is licensed under the GNU General Public License, version 3.",
    "This work is licensed under the GNU General Public License, version 2.",
    "Copyright 2024 Acme. Code released under the MIT License.",
    "The code in this post is released under the MIT License.",
    "under the " * 3_000,
]


def test_equals_plain_comparison(spark):
    rows = list(enumerate(TEXTS)) + [(3, TEXTS[3]), (None, TEXTS[6])]
    docs = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 AS best", "2 AS parts", "3 AS candidates")
    got = [(r["doc_id"], r["licenses"], r["best"]) for r in licenses.scan(docs).collect()]
    assert sorted(got, key=str) == sorted(((d, *plain(t)) for d, t in rows), key=str)
    found = {d: names for d, names, _ in got}
    assert found[5] == [] and found[7] == ["MIT"] and found[9] == ["BSD-3-Clause"] and found[10] == found[11] == ["GPL"]
    assert found[6] == ["Apache-2.0", "CC-BY-NC-4.0"]
    assert {b for _, _, b in got if 0 < b < 1}  # notices are not only found letter for letter


def test_empty_table(spark):
    assert licenses.scan(spark.createDataFrame([], SCHEMA)).count() == 0


def test_every_template_finds_itself(spark):
    rows = list(enumerate(t for _, t in licenses.TEMPLATES))
    rows += [(1000 + k, "before it " * 50 + wrapped(t) + " after it" * 50) for k, t in rows]
    got = {r["doc_id"]: r for r in licenses.scan(spark.createDataFrame(rows, SCHEMA)).collect()}
    for k, (name, _) in enumerate(licenses.TEMPLATES):
        assert name in got[k]["licenses"] and got[k]["best"] == 1.0
        assert name in got[1000 + k]["licenses"]


@pytest.mark.parametrize("name", ["MIT", "ISC", "BSD-2-Clause", "Zlib", "Apache-2.0", "GPL-3.0", "MPL-2.0"])
def test_texts_that_differ_from_the_published_one(spark, name):
    """A full text in comments, every fifteenth word changed."""
    words = BY_NAME[name].split()
    words = [w if k % 15 != 7 else "changed" for k, w in enumerate(words)]
    text = "/*\n * Copyright 2024 Acme\n *\n * " + "\n * ".join(" ".join(words[k : k + 9]) for k in range(0, len(words), 9)) + "\n */\nint main"
    (got,) = licenses.scan(spark.createDataFrame([(1, text)], SCHEMA)).collect()
    assert (got["licenses"], got["best"]) == plain(text)
    assert name in got["licenses"] and got["best"] < 1


INSIDE = [
    ("ISC", "word " * 3000 + BY_NAME["ISC"] + " and so on" * 3000),
    ("MIT", "under the mit " * 2000 + "code released under the MIT License " + "under the mit license or not " * 200),
    (None, "It was released under the old MIT License of theirs, they say, and of the MIT License once more."),
    (None, "under the mit " * 20_000),
]


def test_long_texts(spark):
    got = {r["doc_id"]: r for r in licenses.scan(spark.createDataFrame([(k, t) for k, (_, t) in enumerate(INSIDE)], SCHEMA)).collect()}
    assert [(name in got[k]["licenses"]) if name else not got[k]["licenses"] for k, (name, _) in enumerate(INSIDE)] == [True] * 4


def test_the_sql_sees_windows_too(spark, tmp_path):
    import duckdb

    rows = [(k, t) for k, t in enumerate(TEXTS)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = sorted(con.execute(ORACLE["op5_licenses"]).fetchall())
    got = sorted((r["doc_id"], r["licenses"], r["best"]) for r in op5_licenses(spark, str(tmp_path)).collect())
    assert got == want
