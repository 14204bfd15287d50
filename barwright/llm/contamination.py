"""Benchmark decontamination by a prefix-filtered join of word shingles.

A window of a benchmark item occurs in a document only if all its shingles do, so it is enough to
join one of them: the rarest, its necessary prefix under containment in full. Shingles are ordered
by how often the documents hold them. A shingle found in a document is extended to both sides as
far as the words agree, within the bounds of the item and of the document, and counts if what
agrees is at least a window long.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from barwright.scratch import stored

#: Words of a window and of a shingle.
WINDOW, SHINGLE = 13, 3
#: Tokens of 8 bytes that are sent to every executor at most.
BROADCAST_TOKENS = 1_000_000
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: What lies between words.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    """Runs of digits, letters and characters beyond ASCII, with A-Z lower-cased; none for null."""
    parts = F.split(F.translate(text, UPPER, UPPER.lower()), BETWEEN)
    return F.filter(F.coalesce(parts, F.array().cast("array<string>")), lambda w: w != "")


def contaminated(docs: DataFrame, items: DataFrame, *, percent: int = 5, broadcast_tokens: int = BROADCAST_TOKENS) -> DataFrame:
    """``doc_id, n_words, n_hit, n_items, items_sha256, contaminated, items, print`` for each row of
    ``docs(doc_id, text)``, given ``items(item_id, text)``.

    A word of a document is hit if it lies in an occurrence of a window of an item; an item of fewer
    words than a window is a window by itself. A document is contaminated if it has hits and they
    are at least ``percent`` of its words. Texts that are null, empty or without words have none and
    are never contaminated; items without words are ignored, as are null item ids. An item that is
    listed twice counts once. Repeated rows and null doc_ids stay; other columns are left out. With
    an empty table of items nothing is hit.
    """
    docs = docs.select("doc_id", F.xxhash64("text").alias("print"), words(F.col("text")).alias("words"))
    items = items.filter("item_id is not null").select("item_id", words(F.col("text")).alias("words")).filter("size(words) > 0").distinct()
    anchors, owners, sizes = _anchors(docs, items, broadcast_tokens)

    # of the document's words before and from the shingle on, enough for a window
    room = F.least("at", F.size("left")) + F.least(F.col("length") - F.col("at"), F.size("right")) >= F.col("span")
    near = _matches(docs, anchors.select("token").distinct(), sizes, broadcast_tokens)
    runs = near.join(anchors, "token").filter(room).select("doc_id", "print", "anchor", *_run()).filter("before + after >= span")
    spans = runs.select("doc_id", "print", "anchor", F.struct((F.col("at") - F.col("before")).alias("start"), (F.col("at") + F.col("after")).alias("end")).alias("span"))
    hits = spans.groupBy("doc_id", "print").agg(F.collect_set("span").alias("spans"), F.collect_set("anchor").alias("anchors"))
    hits = stored(hits.select("doc_id", "print", "anchors", _covered(F.sort_array("spans")).alias("n_hit")), "hits")
    listed = hits.select("doc_id", "print", F.explode("anchors").alias("anchor")).join(owners, "anchor")
    listed = listed.groupBy("doc_id", "print").agg(F.sort_array(F.collect_set(F.col("item_id").cast("string"))).alias("items"))

    keys = lambda a, b: a["doc_id"].eqNullSafe(b["doc_id"]) & a["print"].eqNullSafe(b["print"])
    found = hits.drop("anchors").join(listed.withColumnsRenamed({"doc_id": "d", "print": "p"}), F.col("doc_id").eqNullSafe(F.col("d")) & F.col("print").eqNullSafe(F.col("p")))
    found = found.select("doc_id", "print", "n_hit", "items")
    sized = docs.select("doc_id", "print", F.size("words").cast("long").alias("n_words"))
    n_hit, named = F.coalesce(found["n_hit"], F.lit(0)).cast("long"), F.coalesce(found["items"], F.array().cast("array<string>"))
    return (
        sized.join(found, keys(sized, found), "left")
        .select(sized["doc_id"], sized["print"], sized["n_words"], n_hit.alias("n_hit"), named.alias("items"))
        .select(
            "doc_id",
            "n_words",
            "n_hit",
            F.size("items").cast("long").alias("n_items"),
            F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
            ((F.col("n_hit") > 0) & (100 * F.col("n_hit") >= percent * F.col("n_words"))).alias("contaminated"),
            "items",
            "print",
        )
    )


def without_contaminated(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The rows of ``docs`` that :func:`contaminated` leaves alone, with all their columns, whatever
    their names."""
    bad = contaminated(docs, items).filter("contaminated").select(F.col("doc_id").alias("d"), F.col("print").alias("p")).distinct()
    bad = stored(bad, "contaminated")
    keyed = docs.select("doc_id", F.xxhash64("text").alias("print"), F.struct("*").alias("row"))
    same = F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("print") == F.col("p"))
    return keyed.join(bad, same, "left_anti").select("row.*")


def _tokens(words: DataFrame, sizes: list[int], *keep: str) -> DataFrame:
    """A row for each place of ``words`` and length of shingle: ``at``, ``size``, ``token``."""
    placed = words.select(*keep, "words", F.explode_outer(F.sequence(F.lit(0), F.size("words") - 1)).alias("at"))
    at = F.col("at")
    token = {n: F.xxhash64(F.lit(n), *[F.get("words", at + k) for k in range(n)]) for n in sizes}
    if len(sizes) == 1:
        named = placed.select("*", F.lit(sizes[0]).alias("size"), token[sizes[0]].alias("token"))
    else:
        named = placed.select("*", F.explode(F.array(*[F.struct(F.lit(n).alias("size"), token[n].alias("token")) for n in sizes])).alias("shingle")).select(*placed.columns, "shingle.*")
    return named.filter(F.col("at") + F.col("size") <= F.size("words"))


def _anchors(docs: DataFrame, items: DataFrame, broadcast_tokens: int) -> tuple[DataFrame, DataFrame, list[int]]:
    """The shingles to join, each with the words around it, the items that hold them, and the lengths
    of the shingles."""
    items = stored(items.withColumn("span", F.least(F.size("words"), F.lit(WINDOW))).withColumn("size", F.least("span", F.lit(SHINGLE))), "items")
    sizes = [r[0] for r in items.select("size").distinct().collect()] or [SHINGLE]  # at most SHINGLE numbers
    shingles = _tokens(items.withColumnRenamed("size", "own"), sizes, "item_id", "span", "own").filter("size = own").drop("own")
    shingles = stored(shingles, "shingles")
    wanted = shingles.select("token").distinct()
    few = wanted.limit(broadcast_tokens + 1).count() <= broadcast_tokens
    seen = _tokens(docs, sizes).select("token")
    seen = (seen.join(F.broadcast(wanted), "token") if few else seen).groupBy("token").agg(F.count("*").alias("seen"))
    if not few:  # counts are met, so that a frequent token is no more rows than another
        seen = seen.join(wanted, "token")
    ranked = shingles.join(seen, "token", "left").withColumn("seen", F.coalesce("seen", F.lit(0)))
    # the rarest shingle of each window
    first, last = F.greatest(F.lit(0), F.col("at") + F.col("size") - F.col("span")), F.least(F.size("words") - F.col("span"), F.col("at"))
    each = ranked.withColumn("window", F.explode(F.sequence(first, last)))
    rarest = Window.partitionBy("item_id", "words", "window").orderBy("seen", "token", "at")
    chosen = each.withColumn("k", F.row_number().over(rarest)).filter("k = 1").drop("k", "window", "seen").distinct()
    left = F.reverse(F.slice("words", F.greatest(F.lit(1), F.col("at") + 1 - (F.col("span") - F.col("size"))), F.least(F.col("at"), F.col("span") - F.col("size"))))
    right = F.slice("words", F.col("at") + 1, F.col("span"))
    chosen = chosen.select("item_id", "token", "size", "span", left.alias("left"), right.alias("right"))
    # items with the same words around a shingle share an anchor
    key = F.md5(F.to_json(F.struct("token", "size", "span", "left", "right")))
    chosen = stored(chosen.withColumn("anchor", key), "anchors")
    return chosen.drop("item_id").distinct(), chosen.select("anchor", "item_id").distinct(), sizes


def _matches(docs: DataFrame, wanted: DataFrame, sizes: list[int], broadcast_tokens: int) -> DataFrame:
    """``doc_id, print, at, token`` where documents hold a wanted token, the words around and how
    many there are.

    Up to ``broadcast_tokens`` tokens of 8 bytes are sent to every executor and met as the words
    come off the scan. More of them are joined without any words, which are read again for the
    documents that match.
    """
    left = F.reverse(F.slice("words", F.greatest(F.lit(1), F.col("at") + 2 - WINDOW), F.least(F.col("at"), F.lit(WINDOW - 1))))
    near = ["doc_id", "print", "at", "token", F.size("words").alias("length"), left.alias("ours_left"), F.slice("words", F.col("at") + 1, WINDOW).alias("ours_right")]
    placed = _tokens(docs, sizes, "doc_id", "print")
    if wanted.limit(broadcast_tokens + 1).count() <= broadcast_tokens:
        return placed.join(F.broadcast(wanted), "token").select(near)
    found = placed.select("doc_id", "print", "at", "token").join(wanted, "token")
    found = found.groupBy("doc_id", "print").agg(F.collect_set(F.struct("at", "token")).alias("found")).withColumnsRenamed({"doc_id": "d", "print": "p"})
    same = F.col("doc_id").eqNullSafe(F.col("d")) & F.col("print").eqNullSafe(F.col("p"))
    return docs.join(found, same).select("doc_id", "print", "words", F.explode("found").alias("found")).select("doc_id", "print", "words", "found.*").select(near)


def _run() -> list[Column]:
    """How many words agree before an anchor's place and from it on."""

    def agree(theirs: str, ours: str) -> Column:
        # one step beyond the last word ends the run
        k = F.sequence(F.lit(0), F.size(theirs))
        apart = F.transform(k, lambda x: F.get(theirs, x).isNull() | ~F.get(theirs, x).eqNullSafe(F.get(ours, x)))
        return (F.array_position(apart, True) - 1).cast("int")

    return [F.col("at"), F.col("span"), agree("left", "ours_left").alias("before"), agree("right", "ours_right").alias("after")]


def _covered(spans: Column) -> Column:
    """Places in the union of spans that are sorted by start."""
    state = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("end"))

    def add(seen: Column, span: Column) -> Column:
        fresh = F.greatest(F.lit(0), span["end"] - F.greatest(seen["end"], span["start"]))
        return F.struct((seen["n"] + fresh).alias("n"), F.greatest(seen["end"], span["end"]).alias("end"))

    return F.aggregate(spans, state, add, lambda s: s["n"])
