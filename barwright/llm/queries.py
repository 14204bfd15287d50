"""One query per operator, over the whole of its table, and SQL where that can say the same."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barwright.llm import contamination, conversations, language, licenses, near_dup, pieces, pii, quality_rules, repeats, resampling, token_counts, urls, whitening

PIECE_MODEL = public_tokenizers.path("piece_bpe_32k.model")
TOKEN_RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
#: Share of the documents that the resampling draws.
DRAWN = 0.85


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find_personal_data(table(spark, sf_dir, "documents"))

    def count(kind: str):
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select("doc_id", *map(count, pii.KINDS), F.sha2(pii.listed("base"), 256).alias("base_sha256"), pii.listed("spans").alias("spans"))


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge_urls(table(spark, sf_dir, "pages"))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("items", "print")


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), TOKEN_RANKS, public_tokenizers.PATTERN)


def op5_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.array_join("licenses", ",").alias("licenses"), "best")


def op6_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), share=DRAWN)


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules.judge(table(spark, sf_dir, "documents"), "doc_id")
    failed = F.expr(" or ".join(quality_rules.RULES[name] for name in quality_rules.BASE_RULES))
    columns = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    return judged.select(*columns, failed.alias("base_failed"), F.col("broken").isNull().alias("kept"))


def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.digest_documents(table(spark, sf_dir, "documents"), PIECE_MODEL)


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    profiles = language.fit_profiles(docs.filter(~language.held_out(F.col("doc_id"))))
    return language.identify(docs, profiles).select("doc_id", language.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def op10_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_duplicates(table(spark, sf_dir, "documents")).drop("class_id", "text_hash", "group")


def op11_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations")
    rows, symbols = conversations.in_order(conversations.damaged(turns))
    parts = conversations.repair(rows, symbols)
    told, digests = conversations.conversations(rows, parts), conversations.digests(rows, parts)
    # those that lost all rows are known from the undamaged ones
    every = turns.select("conv_id").distinct()
    both = every.unionByName(told, allowMissingColumns=True).unionByName(digests, allowMissingColumns=True).groupBy("conv_id")
    counts = [F.coalesce(F.max(c), F.lit(0)).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    nothing = F.sha2(F.lit(""), 256)
    return both.agg(*counts, F.coalesce(F.max("audit"), F.lit("")).alias("audit"), F.coalesce(F.max("repaired_sha256"), nothing).alias("repaired_sha256"))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    return whitening.whiten(rows.select("vec_id", whitening.whole_entries("embedding").alias("x")))


def op13_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.without_repeats(table(spark, sf_dir, "documents"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_pii,
        op2_url_filter,
        op3_decontamination,
        op4_token_counts,
        op5_licenses,
        op6_resampling,
        op7_quality_rules,
        op8_sentencepiece,
        op9_language,
        op10_near_dup,
        op11_conversations,
        op12_whitening,
        op13_repeats,
    )
}

_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

#: Pairs that a passage and a template have in common at least, as a share of the larger of them.
_RATIO = licenses.THRESHOLD / (2 - licenses.THRESHOLD)

ORACLE: dict[str, str] = {
    "op3_decontamination": rf"""
        WITH d AS (SELECT doc_id, regexp_extract_all({_LOWER.format("text")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
        i AS (SELECT item_id, regexp_extract_all({_LOWER.format("text")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
        windows AS (
            SELECT item_id, least(len(w), 13) AS n, list_slice(w, k, k + least(len(w), 13) - 1) AS words
            FROM (SELECT item_id, w, unnest(range(1, len(w) - least(len(w), 13) + 2)) AS k FROM i WHERE len(w) > 0)),
        sizes AS (SELECT DISTINCT n FROM windows),
        places AS (
            SELECT doc_id, n, k, list_slice(w, k, k + n - 1) AS words
            FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS k FROM d, sizes WHERE len(w) >= n)),
        hits AS (SELECT doc_id, k, n, item_id FROM places JOIN windows USING (n, words)),
        hit_words AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(k, k + n)) AS p FROM hits) GROUP BY doc_id),
        hit_items AS (SELECT doc_id, list_sort(list(DISTINCT CAST(item_id AS VARCHAR))) AS items FROM hits GROUP BY doc_id)
        SELECT doc_id, CAST(coalesce(len(w), 0) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
            CAST(coalesce(len(items), 0) AS BIGINT) AS n_items,
            sha256(coalesce(array_to_string(items, ','), '')) AS items_sha256,
            coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= coalesce(len(w), 0) AS contaminated
        FROM d LEFT JOIN hit_words USING (doc_id) LEFT JOIN hit_items USING (doc_id)
    """,
    "op5_licenses": rf"""
        WITH t AS (
            SELECT *, len(g) AS n, CAST(ceil({_RATIO} * len(g) - 1e-9) AS BIGINT) AS least,
                CAST(floor(({_RATIO} ** -1) * (len(w) - 1) + 1e-9) AS BIGINT) AS longest
            FROM (SELECT k, license, w, list_distinct([w[x] || ' ' || w[x + 1] FOR x IN range(1, len(w))]) AS g
                FROM (SELECT k, license, regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}]+') AS w
                    FROM (VALUES {", ".join("(%d, '%s', '%s')" % (k, name, text.replace("'", "''")) for k, (name, text) in enumerate(licenses.TEMPLATES))}) v(k, license, text)))),
        d AS (
            SELECT doc_id, text, [w[k] || ' ' || w[k + 1] FOR k IN range(1, len(w))] AS g
            FROM (SELECT doc_id, text, regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}]+') AS w FROM documents WHERE text IS NOT NULL)),
        parts AS (
            SELECT doc_id, unnest(list_distinct(string_split(text, chr(10)) ||
                list_filter(regexp_split_to_array(text, '
[ 	
]*
'), lambda p: contains(p, chr(10))))) AS part
            FROM d),
        grams AS (
            SELECT doc_id, list_distinct([w[k] || ' ' || w[k + 1] FOR k IN range(1, len(w))]) AS g
            FROM (SELECT doc_id, regexp_extract_all(lower(part), '[\p{{L}}\p{{N}}]+') AS w FROM parts)),
        hits AS (
            SELECT doc_id, k, license, 2 * len(list_intersect(grams.g, t.g)) / (len(grams.g) + len(t.g)) AS dice FROM grams, t
            WHERE len(grams.g) BETWEEN {_RATIO} * n AND n / {_RATIO}
              AND 2 * len(list_intersect(grams.g, t.g)) / (len(grams.g) + len(t.g)) >= {licenses.THRESHOLD}),
        sought AS (
            SELECT doc_id, k, license, d.g AS all_g, t.g AS own, n, longest FROM d, t
            WHERE len(list_intersect(list_distinct(d.g), t.g)) >= least AND NOT EXISTS (SELECT 1 FROM hits h WHERE h.doc_id = d.doc_id AND h.k = t.k)),
        places AS (SELECT *, unnest(range(1, len(all_g) + 1)) AS a FROM sought),
        starts AS (SELECT doc_id, k, license, own, n, list_slice(all_g, a, a + longest - 1) AS following FROM places WHERE list_contains(own, all_g[a])),
        windows AS (SELECT doc_id, k, license, own, n, list_distinct(list_slice(following, 1, unnest(range(1, len(following) + 1)))) AS w FROM starts),
        best AS (SELECT doc_id, k, license, max(2 * len(list_intersect(w, own)) / (len(w) + n)) AS dice FROM windows GROUP BY ALL),
        every AS (
            SELECT * FROM (SELECT doc_id, license, dice FROM hits UNION ALL SELECT doc_id, license, dice FROM best WHERE dice >= {licenses.THRESHOLD})
            QUALIFY dice = max(dice) OVER (PARTITION BY doc_id, split_part(license, '-', 1)))
        SELECT doc_id, coalesce(names, '') AS licenses, coalesce(best, 0.0::DOUBLE) AS best
        FROM documents LEFT JOIN (
            SELECT doc_id, array_to_string(list_sort(list(DISTINCT license)), ',') AS names, max(dice) AS best FROM every GROUP BY doc_id) USING (doc_id)
    """,
    "op7_quality_rules": r"""
        WITH d AS (
            SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^ 	-
]+') AS w,
                list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^ 	-
]')) AS lines
            FROM documents),
        places AS (
            SELECT doc_id, k, list_slice(w, k, k + 7) AS words
            FROM (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS k FROM d WHERE len(w) >= 8)),
        twice AS (SELECT doc_id, words FROM places GROUP BY ALL HAVING count(*) > 1),
        repeated AS (
            SELECT doc_id, count(DISTINCT p) AS n
            FROM (SELECT doc_id, unnest(range(k, k + 8)) AS p FROM places JOIN twice USING (doc_id, words)) GROUP BY doc_id),
        f AS (
            SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
                CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
                CAST(len(lines) AS BIGINT) AS n_lines,
                CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
                CAST(coalesce(n, 0) AS BIGINT) AS n_repeat_words,
                length(text) - length(regexp_replace(text, '[A-Z]', '', 'g')) AS n_capitals,
                len(list_distinct(w)) AS n_distinct, len(list_filter(w, lambda x: regexp_matches(x, '\pL'))) AS n_lettered
            FROM d LEFT JOIN repeated USING (doc_id))
        SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
            n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
            NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words OR 10 * n_symbols > n_words
                OR 100 * n_dup_lines > 50 * n_lines OR word_chars > 20 * n_words OR word_chars < 2 * n_words
                OR 100 * n_capitals > 40 * word_chars OR 5 * n_distinct < least(n_words, 1000)
                OR 2 * n_lettered < n_words) AS kept
        FROM f
    """,
}
