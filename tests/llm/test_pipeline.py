import hashlib
import shutil
import subprocess
import sys
from pathlib import Path

import pytest
import sentencepiece
from pyspark.sql import functions as F

import corpus_pipeline
from barwright.llm.queries import ORACLE, PIECE_MODEL, QUERIES
from tests.llm.plain import contamination, groups, personal, secrets

SF = "/root/testdata/sf0.001"


def redacted(text):
    spans = sorted((int(s.split(":")[1]), int(s.split(":")[2]), s.split(":")[0]) for s in personal(text) + secrets(text))
    out, at = [], 0
    for start, end, kind in spans:
        if start >= at:
            out += [text[at:start], f"[{kind.upper()}]"]
        at = max(at, end)
    return "".join(out) + text[at:]


def test_the_pipeline_equals_plain_python(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    odd = spark.createDataFrame([(9001, None, "en", "s", 0), (9002, "123 456", "en", "s", 7), (9003, "Ein Wort", None, None, 8), (9004, "mail me@home.org now", "en", "s", 20), (9005, "its password=3da3a2c0ff18 is", "en", "s", 27)], docs.schema)
    docs.union(odd).write.parquet(str(tmp_path / "documents.parquet"))
    shutil.copy(f"{SF}/benchmark.parquet", tmp_path / "benchmark.parquet")
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]

    rows = [(r["doc_id"], r["text"]) for r in docs.union(odd).collect() if any(c.isalpha() for c in r["text"] or "")]
    first = groups(rows)
    rows = [(d, t) for d, t in rows if first[d][1] == d]
    rows = [(d, t) for (d, t), bad in zip(rows, (r[5] for r in contamination(rows, items)), strict=True) if not bad]
    library = sentencepiece.SentencePieceProcessor(model_file=PIECE_MODEL)
    want = {d: library.encode(redacted(t)) for d, t in rows}

    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r["doc_id"]: r["ids"] for r in got} == want
    assert len(got) == len(want)
    for r in got:
        assert r["decoded_sha256"] == hashlib.sha256(library.decode(r["ids"]).encode()).hexdigest()


#: Names that the operators use themselves.
CLASHING = ["component", "words", "_print", "print", "_text_hash", "text_hash", "_d", "d", "_p", "p", "_spans", "spans", "row", "score", "lang_pred", "h", "many", "changed", "n_tokens", "ids"]


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stages_keep_the_columns_and_take_odd_tables(spark, name):
    docs = spark.read.parquet(f"{SF}/documents.parquet").withColumns({c: F.lit(f"its {c}") for c in CLASHING})
    stage = dict(corpus_pipeline.STAGES)[name]
    full = stage(spark, docs, SF)
    if name != corpus_pipeline.STAGES[-1][0]:
        assert full.columns == docs.columns
        kept = full.select(*CLASHING).distinct().collect()
        assert [tuple(r) for r in kept] == [tuple(f"its {c}" for c in CLASHING)]
    assert stage(spark, docs.limit(0), SF).count() == 0
    nulls = docs.limit(3).select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in docs.schema])
    stage(spark, nulls.union(nulls), SF).collect()


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_queries_equal_their_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for table in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    want = con.execute(ORACLE[name])
    columns = [c[0] for c in want.description]
    df = QUERIES[name](spark, SF)
    assert sorted(df.columns) == sorted(columns)
    assert sorted(tuple(r) for r in df.select(columns).collect()) == sorted(want.fetchall())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_every_query_has_a_row_for_each_of_its_table(spark, name):
    source = {"op2": "pages", "op11": "conversations", "op12": "embeddings"}.get(name.split("_")[0], "documents")
    rows = spark.read.parquet(f"{SF}/{source}.parquet")
    rows = rows.select("conv_id").distinct() if source == "conversations" else rows
    assert QUERIES[name](spark, SF).count() == rows.count() * (8 if source == "embeddings" else 1)


def test_the_rest_does_without_this_subpackage(tmp_path):
    top = Path(__file__).resolve().parents[2]
    shutil.copytree(top / "barwright", tmp_path / "barwright", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(top / "__spark_entry__.py", tmp_path)
    said = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()), [k for k in e.queries() if k.startswith('op1')])"], cwd=tmp_path, capture_output=True, text=True, env={"PATH": "/usr/bin:/bin"})
    assert said.returncode == 0 and said.stdout.strip().endswith("[]"), said.stderr


def test_the_language_stage_keeps_columns_of_any_name(spark):
    rows = [(1, "alpha beta", "en", 5, None), (1, "alpha beta", "en", 5, None), (None, "gamma delta", "en", None, "x"), (3, "123", "en", 7, "y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score int, lang_pred string").withColumn("row", F.lit(2))
    kept = corpus_pipeline.keep_languages(spark, docs, SF)
    assert kept.columns == docs.columns
    assert sorted(map(tuple, kept.collect()), key=str) == sorted(((*r, 2) for r in rows[:3]), key=str)


@pytest.mark.parametrize("name, left", [("language", 3), ("near_duplicates", 4), ("contamination", 6), ("personal_data", 6), ("pieces", 6)])
def test_stages_define_what_odd_rows_become(spark, name, left):
    """A row that is repeated, one of nulls that is repeated, an empty text and a very long one."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang", F.lit("given").alias("source"))
    rows = [(9001, "Eine Zeile mit Wort und Sinn"), (None, None), (9002, ""), (9003, "wort " * 60_000)]
    odd = spark.createDataFrame([rows[0], *rows, rows[1]], "doc_id long, text string").selectExpr("*", "CAST(NULL AS string) AS lang", "'odd' AS source")
    got = dict(corpus_pipeline.STAGES)[name](spark, docs.unionByName(odd), SF)
    if name == "pieces":
        counts = {r["doc_id"]: r["n_tokens"] for r in got.filter("doc_id is null or doc_id > 9000").collect()}
        assert counts[None] == counts[9002] == 0 and counts[9003] >= 60_000
        assert got.filter("doc_id is null or doc_id > 9000").count() == left
    else:
        kept = got.filter("source = 'odd'").select("doc_id", "text").collect()
        assert len(kept) == left and {tuple(r) for r in kept} <= set(rows)
