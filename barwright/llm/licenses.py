"""Licence texts and notices by Dice coefficient over word bigrams.

Lines and paragraphs are normalised to lower-case words and compared to templates. The coefficient
cannot reach the threshold where one side has too many bigrams for the other, so these templates
are not compared at all. A template that no whole line or paragraph reaches is sought in windows of
about its size over the words of the whole text.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barwright.llm import licence_texts

#: Dice coefficient from which a passage counts as the licence.
THRESHOLD = 0.8
TEMPLATES = licence_texts.TEXTS


def scan(docs: DataFrame, *, templates: list[tuple[str, str]] = TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """``doc_id, licenses, best, matches`` for each row of ``docs(doc_id, text)``.

    ``matches`` has ``(license, dice)`` of each line, and each paragraph of several lines, that
    reaches the threshold for a template, and of the best window of a text for each template that none
    of these reaches. The licences of a family, named alike up to the first hyphen, differ in few
    words, so of these only the matches with the largest coefficient are kept. ``licenses`` names these once each, sorted; ``best`` is the largest coefficient
    among them or 0. A null or empty text has none. Repeated rows and null doc_ids stay; other columns
    are left out; an empty table gives an empty result. All lines and windows of a text are compared,
    whatever its length.
    """
    known = [t for t in (template(k, name, text, threshold) for k, (name, text) in enumerate(templates)) if t["own"]]
    # the coefficient is at most 2 * min / (min + max)
    low, high = min(t["smallest"] for t in known), max(t["largest"] for t in known)
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("all_words", F.filter(F.split(F.lower("text"), r"[^\p{L}\p{N}]+"), lambda w: w != ""))
    rows = rows.withColumn("all_grams", _pairs(F.col("all_words")))
    every = sorted({gram for t in known for gram in t["own"]})
    rows = rows.withColumn("some_grams", F.array_intersect("all_grams", F.array(*map(F.lit, every))))
    # a template that too few pairs of the text are of is reached nowhere in it
    sought = F.array(*[F.struct(*[(F.array(*map(F.lit, v)) if isinstance(v, list) else F.lit(v)).alias(n) for n, v in t.items()]) for t in known])
    found = F.filter(sought, lambda t: F.size(F.array_intersect("some_grams", t["own"])) >= t["least"])
    nothing = F.filter(sought, lambda t: F.lit(False))
    fewest = min(t["least"] for t in known)
    rows = rows.select("doc_id", "text", "all_grams", F.when(F.size("some_grams") >= fewest, found).otherwise(nothing).alias("candidates"))

    # whole lines and paragraphs, of the texts that have candidates
    parts = F.array_distinct(F.concat(F.split("text", "\n"), F.filter(F.split("text", r"\n[\x20\x09\x0D]*\n"), lambda p: p.contains("\n"))))
    worded = F.transform(parts, lambda p: F.filter(F.split(F.lower(p), r"[^\p{L}\p{N}]+"), lambda w: w != ""))
    # a passage has a bigram for each pair of words at most
    worded = F.filter(worded, lambda w: F.size(w) - 1 >= low)
    pairs = F.filter(F.transform(worded, lambda w: F.array_distinct(_pairs(w))), lambda b: F.size(b).between(low, high))
    none = F.array().cast("array<array<string>>")
    rows = rows.select("doc_id", "all_grams", "candidates", F.when(F.size("candidates") > 0, pairs).otherwise(none).alias("grams"))

    def compared(grams: Column) -> Column:
        def dice(t: Column) -> Column:
            value = 2 * F.size(F.array_intersect(grams, t["own"])) / (F.size(grams) + F.size(t["own"]))
            fits = F.size(grams).between(t["smallest"], t["largest"])
            return F.struct(t["template"].alias("template"), t["license"].alias("license"), F.when(fits, value).otherwise(0.0).alias("dice"))

        return F.filter(F.transform("candidates", dice), lambda m: m["dice"] >= threshold)

    rows = rows.withColumn("hits", F.flatten(F.transform("grams", compared)))
    missing = F.filter("candidates", lambda t: ~F.exists("hits", lambda m: m["template"] == t["template"]))
    rows = rows.withColumn("missing", missing)
    windows = F.transform("missing", lambda t: F.struct(t["license"].alias("license"), _best_window(F.col("all_grams"), t).alias("dice")))
    whole = F.transform("hits", lambda m: F.struct(m["license"].alias("license"), m["dice"].alias("dice")))
    rows = rows.select("doc_id", F.concat(whole, F.filter(windows, lambda m: m["dice"] >= threshold)).alias("matches"))
    family = lambda m: F.substring_index(m["license"], "-", 1)
    best = F.filter("matches", lambda m: ~F.exists("matches", lambda o: (family(o) == family(m)) & (o["dice"] > m["dice"])))
    rows = rows.withColumn("matches", best)
    return rows.select("doc_id", F.sort_array(F.array_distinct(F.col("matches.license"))).alias("licenses"), F.coalesce(F.array_max("matches.dice"), F.lit(0.0)).alias("best"), "matches")


def template(number: int, name: str, text: str, threshold: float = THRESHOLD) -> dict:
    """A template's word pairs ``own``; the fewest and most pairs of a passage that can reach the
    threshold; how many of ``own`` such a passage has at least; and the longest window compared."""
    own = sorted(bigrams_of(text))
    ratio = threshold / (2 - threshold)
    return {
        "template": number,
        "license": name,
        "own": own,
        "smallest": ratio * len(own),
        "largest": len(own) / ratio,
        "least": math.ceil(ratio * len(own) - 1e-9),
        "longest": int((len(_words(text)) - 1) / ratio + 1e-9),
    }


def _pairs(words: Column) -> Column:
    """Each word with the next one."""
    n = F.greatest(F.size(words) - 1, F.lit(0))
    return F.zip_with(F.slice(words, 1, n), F.slice(words, 2, n), lambda a, b: F.concat_ws(" ", a, b))


def _best_window(grams: Column, template: Column) -> Column:
    """The largest coefficient of a passage of at most ``longest`` word pairs.

    The best one begins and ends at a pair that the template has, and it has ``least`` such pairs, so
    it is only sought from where these stand close enough together.
    """
    own, n = template["own"], F.size(template["own"])
    places = F.filter(F.transform(grams, lambda g, k: F.when(F.array_contains(own, g), k)), lambda k: k.isNotNull())
    starts = F.filter(F.zip_with(places, F.slice(places, template["least"], F.size(grams)), lambda a, b: F.when(b - a < template["longest"], a)), lambda a: a.isNotNull())

    def dice(seen: Column) -> Column:
        return 2 * seen["common"] / (F.size(seen["grams"]) + n)

    def step(seen: Column, gram: Column) -> Column:
        fresh = ~F.array_contains(seen["grams"], gram)
        return F.struct(
            F.when(fresh, F.array_append(seen["grams"], gram)).otherwise(seen["grams"]).alias("grams"),
            (seen["common"] + (fresh & F.array_contains(own, gram)).cast("int")).alias("common"),
            F.greatest(seen["best"], dice(seen)).alias("best"),
        )

    state = F.struct(F.array().cast("array<string>").alias("grams"), F.lit(0).alias("common"), F.lit(0.0).alias("best"))
    found = F.transform(starts, lambda a: F.aggregate(F.slice(grams, a + 1, template["longest"]), state, step, lambda seen: F.greatest(seen["best"], dice(seen))))
    return F.coalesce(F.array_max(found), F.lit(0.0))


def _words(text: str) -> list[str]:
    return [w for w in re.split(r"[\W_]+", text.lower()) if w]


def bigrams_of(text: str) -> set[str]:
    words = _words(text)
    return {f"{a} {b}" for a, b in zip(words, words[1:], strict=False)}
