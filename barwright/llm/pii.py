"""Personal data by patterns of form, and by contexts learnt from what these find.

The forms give seeds; so do secrets that a telling name is given, such as a password. Words that stand
next to seeds become patterns; a pattern is scored by how
many of the identifiers it meets are known and how often the word stands there at all, an
identifier by the patterns that meet it, in turn over a graph of both. Identifiers of the right
type that no form matches, such as a card number with a wrong check digit or a token that merely
follows its name, are added where confident patterns meet them.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barwright.scratch import stored

#: In the order in which spans are listed.
KINDS = ("email", "ip", "card", "phone")
#: The given forms, written so that no text takes time beyond its length: what can't be given back
#: is possessive, and a run that failed from its start isn't tried again from within.
FORMS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: A kind of its own, which is no base span: what stands behind one of these names, possibly quoted.
SECRET = "secret"
SECRET_NAMES = r"token|secret|passw(?:or)?d|passphrase|pwd|api[_-]?key|access[_-]?key|private[_-]?key|auth|credentials?"
SECRET_FORM = rf"(?i)(?<=(?:{SECRET_NAMES})[\"']?\x20?[=:]\x20?[\"']?)(?<![A-Za-z0-9+/_~-])[A-Za-z0-9+/_~-]{{8,}}+={{0,2}}"
#: Two digits and two letters at least, so that it is not a word or a number.
SECRET_TYPE = r"\A(?=(?:[^0-9]*+[0-9]){2})(?=(?:[^A-Za-z]*+[A-Za-z]){2})[A-Za-z0-9+/_~-]{8,}+={0,2}\z"
#: What may be a secret: a run of its characters with a digit.
MIXED = r"(?<![A-Za-z0-9+/_~-])(?=[A-Za-z+/_~-]*+[0-9])[A-Za-z0-9+/_~-]{8,}+"
#: What may be an identifier without having one of the forms, and the types of these.
LOOSE = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9._-]++|\+?[0-9][0-9().-]{5,}[0-9]"
#: The same with single spaces, sought by itself: a number beside another one is both, two without
#: the space and one with it.
SPACED = r"\+?\(?[0-9](?:[().-]*+\x20?[().-]*+[0-9])++"
LOOSE_TYPES = {
    "email": r"\A[^@]+@[^@]+\z",
    "ip": r"\A[0-9]+(?:\.[0-9]+){3}\z",
    "card": r"\A[0-9\x20-]+\z",
    "phone": r"\A\+?[0-9().\x20-]+\z",
    "secret": SECRET_TYPE,
}
#: Characters of context looked at on either side, enough for a word.
CONTEXT = 48
#: Rounds of scoring; distinct seeds that a pattern needs; scores from which patterns and
#: identifiers count as sure; share of a word's places that must be next to an identifier.
ROUNDS, SUPPORT, SURE, SPECIFIC = 3, 5, 0.8, 0.02
#: Copies of a pattern's score, over which identifiers that share a frequent word are spread.
SALTS = 16
#: Pattern words that are sent to every executor at most; more of them are joined by a shuffle.
BROADCAST_WORDS = 200_000

_NOT_WORD = r"[^\p{L}\p{N}]+"


def find_personal_data(docs: DataFrame) -> DataFrame:
    """``doc_id, print, base, spans`` for each row of ``docs(doc_id, text)``.

    ``base`` and ``spans`` are arrays of ``(kind, start, end)``, code points from 0 and end
    exclusive, by kind in the order of KINDS, secrets last, and then by start. ``base`` has what fits a
    form, ``spans`` the secrets that are named as such and the found identifiers as well, of which
    only a named secret may overlap a base span. ``print`` is a hash of the text. A null or empty text has no spans. Repeated rows and null doc_ids stay; other
    columns are left out; an empty table gives an empty result.
    """
    found = stored(_extracted(docs), "spans")
    learnt = _discovered(docs, found)
    same = F.col("doc_id").eqNullSafe(F.col("d")) & F.col("print").eqNullSafe(F.col("p"))
    joined = found.join(learnt.withColumnsRenamed({"doc_id": "d", "print": "p"}), same, "left")
    none = F.array().cast("array<struct<kind:int,start:int,end:int>>")
    base = F.transform("base", lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
    secrets = F.transform("secrets", lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
    every = F.sort_array(F.concat(base, secrets, F.coalesce("learnt", none)))
    return joined.select("doc_id", "print", _named(base).alias("base"), _named(every).alias("spans"))


def listed(spans: Column) -> Column:
    """``kind:start:end`` of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def redact(docs: DataFrame, found: DataFrame) -> DataFrame:
    """``docs`` with each span of :func:`find_personal_data` in ``text`` replaced by its kind in
    brackets; overlapping spans are one, named by the kind that starts first. Rows and columns stay,
    whatever their names, and ``n_chars`` follows the text where there is such a column."""
    spans = found.filter(F.size("spans") > 0).select(F.col("doc_id").alias("d"), F.col("print").alias("p"), "spans").dropDuplicates(["d", "p"])
    keyed = docs.select("doc_id", F.xxhash64("text").alias("print"), F.struct("*").alias("row"))
    joined = keyed.join(spans, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("print") == F.col("p")), "left")
    changed = joined.withColumn("changed", F.when(F.col("spans").isNull(), F.col("row.text")).otherwise(_without(F.col("row.text"), F.col("spans"))))
    new = {"text": F.col("changed")}
    if "n_chars" in docs.columns:
        size = F.length("changed").cast(docs.schema["n_chars"].dataType)
        new["n_chars"] = F.when(F.col("spans").isNull(), F.col("row").getField("n_chars")).otherwise(size)
    return changed.select(*[new.get(c, F.col("row").getField(c)).alias(c) for c in docs.columns])


def _without(text: Column, spans: Column) -> Column:
    by_start = F.sort_array(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))
    state = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("parts"))

    def cut(seen: Column, s: Column) -> Column:
        before = F.substring(text, seen["at"] + 1, s["start"] - seen["at"])
        mark = F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]"))
        parts = F.when(s["start"] >= seen["at"], F.concat(seen["parts"], F.array(before, mark))).otherwise(seen["parts"])
        return F.struct(F.greatest(seen["at"], s["end"]).alias("at"), parts.alias("parts"))

    return F.aggregate(by_start, state, cut, lambda seen: F.concat(F.array_join(seen["parts"], ""), F.substring(text, seen["at"] + 1, F.length(text))))


def _named(spans: Column) -> Column:
    kinds = F.array(*map(F.lit, (*KINDS, SECRET)))
    return F.transform(spans, lambda s: F.struct(F.get(kinds, s["kind"]).alias("kind"), s["start"].alias("start"), s["end"].alias("end")))


def _extracted(docs: DataFrame) -> DataFrame:
    """Base spans and loose candidates of each row, with their contexts."""
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", F.xxhash64("text").alias("print"), text.alias("text"))
    needs = {
        "email": F.col("text").contains("@"),
        "phone": F.col("text").contains("+"),
        "spaced": F.col("text").rlike(r"[0-9().-]\x20[0-9().-]"),
        "secrets": F.col("text").rlike(r"[=:]\x20?[\"']?[A-Za-z0-9+/_~-]{8}"),
        "mixed": F.col("text").rlike(r"[A-Za-z+/_~-][0-9]|[0-9][A-Za-z+/_~-]"),
    }
    for name, form in {**FORMS, "loose": LOOSE, "spaced": SPACED, "secrets": SECRET_FORM, "mixed": MIXED}.items():
        needed = needs.get(name, F.col("text").rlike("[0-9@]"))
        rows = rows.withColumn(f"{name}_values", F.when(needed, F.regexp_extract_all("text", F.lit(form), F.lit(0))).otherwise(F.array().cast("array<string>")))
        some = F.size(f"{name}_values") > 0
        rows = rows.withColumn(f"{name}_pieces", F.when(some, F.split("text", form, -1)).otherwise(F.array().cast("array<string>")))
    valid = {
        "email": lambda v: F.lit(True),
        "ip": lambda v: v.rlike(r"\A(?:0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])(?:\.|\z)){4}\z"),
        "card": lambda v: F.length(_digits(v)).between(13, 19) & F.call_function("luhn_check", _digits(v)),
        "phone": lambda v: F.length(_digits(v)).between(9, 15),
    }

    def fitting(k: int, kind: str) -> Column:
        return F.filter(_spans(kind, k), lambda s: valid[kind](s["value"]))

    base = F.concat(*[fitting(k, kind) for k, kind in enumerate(KINDS)])
    spaced = F.filter(_spans("spaced", -1), lambda s: s["value"].contains(" ") & F.length(_digits(s["value"])).between(9, 19))
    secrets = F.filter(_spans("secrets", len(KINDS)), lambda s: s["value"].rlike(SECRET_TYPE))
    mixed = F.filter(_spans("mixed", -1), lambda s: s["value"].rlike(SECRET_TYPE))
    rows = rows.select("doc_id", "print", base.alias("base"), secrets.alias("secrets"), F.concat(_spans("loose", -1), spaced, mixed).alias("loose"))
    sure = F.concat("base", "secrets")
    apart = F.filter("loose", lambda c: ~F.exists(sure, lambda s: (s["start"] < c["end"]) & (c["start"] < s["end"])))
    return rows.select("doc_id", "print", "base", "secrets", apart.alias("loose"))


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _spans(name: str, kind: int) -> Column:
    """``(kind, start, end, value, left, right)`` of each match. The places are sums of the lengths
    of the matches and of the pieces between them."""
    values, pieces = F.col(f"{name}_values"), F.col(f"{name}_pieces")
    ends = _ends(values, pieces)

    def span(e: Column, k: Column) -> Column:
        value = F.get(values, k)
        before, after = F.right(F.get(pieces, k), F.lit(CONTEXT)), F.left(F.get(pieces, k + 1), F.lit(CONTEXT))
        return F.struct(
            F.lit(kind).alias("kind"),
            (e - F.length(value)).alias("start"),
            e.alias("end"),
            value.alias("value"),
            F.try_element_at(F.filter(F.split(F.lower(before), _NOT_WORD), lambda w: w != ""), F.lit(-1)).alias("left"),
            F.get(F.filter(F.split(F.lower(after), _NOT_WORD), lambda w: w != ""), F.lit(0)).alias("right"),
        )

    return F.transform(ends, span)


def _ends(values: Column, pieces: Column) -> Column:
    state = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("ends"))

    def step(seen: Column, x: Column) -> Column:
        at = seen["at"] + F.length(x["piece"]) + F.length(x["value"])
        return F.struct(at.alias("at"), F.concat(seen["ends"], F.array(at)).alias("ends"))

    pairs = F.zip_with(F.slice(pieces, 1, F.size(values)), values, lambda piece, value: F.struct(piece.alias("piece"), value.alias("value")))
    return F.aggregate(pairs, state, step, lambda seen: seen["ends"])


def _discovered(docs: DataFrame, found: DataFrame) -> DataFrame:
    """``doc_id, print, learnt``: spans of loose candidates that confident patterns meet."""
    seeds = found.select("doc_id", "print", F.explode(F.concat("base", "secrets")).alias("s")).select("doc_id", "print", "s.*", F.lit(1.0).alias("known"))
    loose = found.select("doc_id", "print", F.explode("loose").alias("s")).select("doc_id", "print", F.explode(_types(F.col("s.value"))).alias("kind"), "s.start", "s.end", "s.value", "s.left", "s.right")
    loose = stored(loose.withColumn("known", F.lit(0.0)), "loose")
    sides = F.array(*[F.struct(F.lit(side).alias("side"), F.col(side).alias("word")) for side in ("left", "right")])
    graph = seeds.select(loose.columns).union(loose).select("kind", "value", "known", F.explode(sides).alias("x")).select("kind", "value", "known", "x.side", "x.word")
    graph = stored(graph.filter("word is not null").groupBy("kind", "side", "word", "value").agg(F.max("known").alias("known")), "graph")

    candidates = graph.groupBy("kind", "side", "word").agg(F.sum("known").alias("seeds")).filter(F.col("seeds") >= SUPPORT)
    candidates = stored(candidates.join(_occurrences(docs, candidates.select("word").distinct()), "word"), "patterns")
    sure = None
    for _ in range(ROUNDS):
        scored = graph if sure is None else graph.join(sure, ["kind", "value"], "left").withColumn("known", F.greatest("known", F.coalesce("confidence", F.lit(0.0)))).drop("confidence")
        scores = scored.groupBy("kind", "side", "word").agg(F.sum("known").alias("good"), F.count("*").alias("met"))
        scores = scores.join(candidates, ["kind", "side", "word"]).withColumn("score", F.col("good") / F.col("met"))
        scores = scores.filter((F.col("score") >= SURE) & (F.col("good") >= SPECIFIC * F.col("places")))
        scores = scores.select("kind", "side", "word", "score", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
        unseen = graph.filter("known = 0").withColumn("salt", F.pmod(F.xxhash64("value"), F.lit(SALTS)).cast("int"))
        doubt = F.exp(F.sum(F.log(F.greatest(1 - F.col("score"), F.lit(1e-6)))))  # of all patterns that meet it
        sure = unseen.join(scores, ["kind", "side", "word", "salt"]).groupBy("kind", "value").agg((1 - doubt).alias("confidence"))
        sure = stored(sure.filter(F.col("confidence") >= SURE), "sure")
    hits = loose.join(sure, ["kind", "value"])
    # one kind for a place: the surest, then the first listed
    best = hits.groupBy("doc_id", "print", "start", "end").agg(F.min_by("kind", F.struct(-F.col("confidence"), "kind")).alias("kind"), F.any_value(F.col("value").contains(" ")).alias("spaced"))
    each = best.groupBy("doc_id", "print").agg(F.collect_list(F.struct("kind", "start", "end", "spaced")).alias("all"))
    # of a number found with and without its neighbour, the one without
    alone = F.filter("all", lambda s: ~(s["spaced"] & F.exists("all", lambda o: ~o["spaced"] & (o["start"] < s["end"]) & (s["start"] < o["end"]))))
    return each.select("doc_id", "print", F.transform(alone, lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"))).alias("learnt"))


def _types(value: Column) -> Column:
    """The kinds that a loose candidate can be."""
    size = F.length(_digits(value))
    fits = {"card": size.between(13, 19), "phone": size.between(9, 15)}
    kinds = [F.when(value.rlike(form) & fits.get(kind, F.lit(True)), F.array(F.lit(k))).otherwise(F.array().cast("array<int>")) for k, (kind, form) in enumerate(LOOSE_TYPES.items())]
    return reduce(lambda a, b: F.concat(a, b), kinds)


def _occurrences(docs: DataFrame, words: DataFrame) -> DataFrame:
    """How often each word stands in all texts. Too many words to send are met by the counts, so that a
    frequent word is no more rows than another."""
    few = words.limit(BROADCAST_WORDS + 1).count() <= BROADCAST_WORDS  # each of CONTEXT characters at most
    every = docs.select(F.explode_outer(F.split(F.lower("text"), _NOT_WORD)).alias("word"))
    if few:
        every = every.join(F.broadcast(words), "word")
    places = every.groupBy("word").agg(F.count("*").alias("places"))
    return places if few else places.join(words, "word")
