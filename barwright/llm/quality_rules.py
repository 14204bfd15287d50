"""Quality rules as a short-circuit cascade.

A document is kept if it breaks no rule. What each rule costs and how much it rejects is measured
on a sample; then the rules that reject most for their cost come first, and a document that breaks
one is not asked about the rest: the rules are one conditional expression, and what only a later
rule looks at is worked out inside its branch. The order never changes what is kept, only the work.
"""

from __future__ import annotations

import time

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barwright.scratch import stored

#: Rows, about, on which costs and selectivities are estimated.
SAMPLE_ROWS = 2000
SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\x0b\x0c\r"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Words of a window that must not come twice.
REPEAT = 8

#: What is worked out of every document, as a result of its own.
FEATURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")
#: Each rule is what a document must not fulfil, over the features and over ``text``, ``words`` and
#: ``lines``. The first two are those that the contract fixes. Of the labelled documents of the tables
#: seen (3,409 good ones at scale 0.1, 17,832 in another table), the others reject none that is good;
#: at 30 % instead of 50, repeated lines would reject 15 and 82 of these, one in 200.
RULES = {
    "few_words": "n_words < 20",
    "repeated_words": "100 * n_repeat_words > 30 * n_words",
    "symbols": "10 * n_symbols > n_words",
    "repeated_lines": "100 * n_dup_lines > 50 * n_lines",
    "long_words": "word_chars > 20 * n_words",
    "short_words": "word_chars < 2 * n_words",
    "capitals": f"100 * (length(text) - length(translate(text, '{UPPER}', ''))) > 40 * word_chars",
    "few_distinct_words": "5 * size(array_distinct(words)) < least(n_words, 1000)",
    "few_letters": r"2 * size(filter(words, w -> w rlike '\\p{L}')) < n_words",
}
BASE_RULES = ("few_words", "repeated_words")


def features(docs: DataFrame, *keep: str) -> DataFrame:
    """The columns ``keep`` and FEATURES for each row of ``docs(text)``. A null text has no words,
    characters or lines."""
    return _measured(docs, keep).select("kept.*", *FEATURES)


def judge(docs: DataFrame, *keep: str, rules: dict[str, str] = RULES, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """The columns ``keep``, FEATURES and ``broken``, the first rule in the cascade that a document
    breaks or null, for each row of ``docs(text)``.

    Repeated rows and nulls in other columns stay; a null text breaks ``few_words``; an empty table
    gives an empty result; texts may have any length. ``keep`` must not name a result.
    """
    clash = {*keep} & {*FEATURES, "broken"}
    if clash:
        raise ValueError(f"names of results: {sorted(clash)}")
    order = cascade_order(docs, rules, sample_rows)
    return _measured(docs, keep).select("kept.*", *FEATURES, _first_broken(rules, order).alias("broken"))


def keep_good(docs: DataFrame, *, rules: dict[str, str] = RULES, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """The rows of ``docs`` that break no rule, with their columns, whatever their names."""
    order = cascade_order(docs, rules, sample_rows)
    whole = docs.select("text", F.struct("*").alias("row"))
    return _measured(whole, ("row",)).filter(_first_broken(rules, order).isNull()).select("kept.row.*")


def cascade_order(docs: DataFrame, rules: dict[str, str] = RULES, sample_rows: int = SAMPLE_ROWS) -> list[str]:
    """Names of the rules, most rejections for their cost first.

    A rule's cost is what it takes beyond the features; one pass over the sample gives the
    rejections of all rules, and one each the costs.
    """
    rows = docs.count()
    sample = docs.select("text").sample(min(1.0, sample_rows / max(rows, 1)), seed=17)
    measured = stored(_measured(sample, ()).drop("kept"), "sample")
    broken = [F.count_if(F.expr(rule)) for rule in rules.values()]
    rejected = dict(zip(rules, measured.agg(*broken, F.count("*")).first(), strict=False))
    costs = {}
    for name, rule in rules.items():
        began = time.perf_counter()
        measured.agg(F.count_if(F.expr(rule))).first()
        costs[name] = time.perf_counter() - began
    return sorted(rules, key=lambda name: -rejected[name] / costs[name])


def _first_broken(rules: dict[str, str], order: list[str]) -> Column:
    """A chain of conditions, each of which is only looked at if those before it do not hold."""
    chain = F.when(F.expr(rules[order[0]]), F.lit(order[0]))
    for name in order[1:]:
        chain = chain.when(F.expr(rules[name]), F.lit(name))
    return chain


def _measured(docs: DataFrame, keep: tuple[str, ...]) -> DataFrame:
    """``kept``, the FEATURES and what they are worked out from: ``text``, ``words`` and ``lines``."""
    kept = F.struct(*keep) if keep else F.struct(F.lit(None).alias("nothing"))
    rows = docs.select(kept.alias("kept"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("words", F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != ""))
    rows = rows.withColumn("lines", F.filter(F.split("text", "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    rows = _with_repeats(rows)
    counted = {
        "n_words": F.size("words"),
        "word_chars": F.length(F.translate("text", SPACES, "")),
        "n_symbols": F.length("text") - F.length(F.translate("text", SYMBOLS, "")),
        "n_lines": F.size("lines"),
        "n_dup_lines": F.size("lines") - F.size(F.array_distinct("lines")),
        "n_repeat_words": _covered("_places"),
    }
    return rows.select("kept", "text", "words", "lines", *[counted[name].cast("long").alias(name) for name in FEATURES])


def _with_repeats(rows: DataFrame) -> DataFrame:
    """Add ``_places``, where windows of REPEAT ``words`` begin that the text has more than once.

    Windows are compared by 64-bit hashes, built by doubling: of one word, of two, of four, of eight.
    Only where some are equal are they sorted to find which. Each step is a column of its own, as
    its value is used more than once.
    """
    rows = rows.withColumn("_hashes", F.transform("words", lambda w: F.xxhash64(w)))
    width = 1
    while width < REPEAT:
        n = F.greatest(F.lit(0), F.size("_hashes") - width)
        rows = rows.withColumn("_count", n)
        both = F.zip_with(F.slice("_hashes", 1, F.col("_count")), F.slice("_hashes", width + 1, F.col("_count")), lambda a, b: F.xxhash64(a, b))
        rows = rows.withColumn("_hashes", both)
        width *= 2
    placed = F.sort_array(F.transform("_hashes", lambda h, k: F.struct(h.alias("h"), k.alias("k"))))
    some = F.size(F.array_distinct("_hashes")) < F.size("_hashes")
    rows = rows.withColumn("_placed", F.when(some, placed).otherwise(F.array().cast("array<struct<h:bigint,k:int>>")))
    # the sort brings equal windows together; a window counts if its neighbour equals it
    after = F.zip_with("_placed", F.slice("_placed", 2, F.size("_placed")), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    pairs = F.filter(after, lambda x: x["a"]["h"] == x["b"]["h"])
    return rows.withColumn("_places", F.sort_array(F.array_distinct(F.flatten(F.transform(pairs, lambda x: F.array(x["a"]["k"], x["b"]["k"]))))))


def _covered(places: str) -> Column:
    """Words in the windows that begin at sorted places."""

    def union(seen: Column, at: Column) -> Column:
        fresh = F.least(F.lit(REPEAT), at + REPEAT - seen["end"])
        return F.struct((seen["n"] + fresh).alias("n"), (at + REPEAT).alias("end"))

    return F.aggregate(places, F.struct(F.lit(0).alias("n"), F.lit(0).alias("end")), union, lambda s: s["n"])
